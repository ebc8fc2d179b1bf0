"""Payout-sheet operators on small literals."""

import pytest
from pyspark.sql import functions as F
from tabulant.functions import scalars as S
from tabulant.operators import detect as D
from tabulant.operators import export as X
from tabulant.operators import people as P
from tabulant.operators import validation as V
from tabulant.sources import grids as G
from tabulant.streaming import drop_folder

GRID = "source_id string, row_idx long, cells array<string>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    cases = [
        (S.sanitize_amount(F.lit(" ¥5,200.50元")), "5200.5"), (S.sanitize_amount(F.lit("3800")), "3800"), (S.sanitize_amount(F.lit("abc")), ""), (S.sanitize_amount(F.lit("12345678.9")), "12345678.9"),
        (S.clean_value(F.lit(" 1101011990010112３ⅹ"), "idCard"), "11010119900101123X"), (S.clean_value(F.lit("王　辉​"), "name"), "王辉"),
        (S.clean_name(F.lit("王辉2")), "王辉"), (S.clean_name(F.lit("陈建新8月")), "陈建新"), (S.clean_name(F.lit("王辉、李四")), "王辉、李四"), (S.clean_name(F.lit("武汉市红枫咨询商行1")), "武汉市红枫咨询商行1"),
        (S.split_amount(F.lit("1e3")), 1000.0), (S.split_amount(F.lit("8月")), None), (S.split_amount(F.lit("0")), None), (S.is_amount_like(F.lit("8月")), True), (S.is_amount_like(F.lit("13800138000")), False),
        (S.gender_of_id(F.lit("110101199001011234")), "男"), (S.id_checksum_valid(F.lit("11010519491231002X")), True), (S.id_checksum_valid(F.lit("110105194912310021")), False),
        (S.pinyin_initial(F.lit("晟")), "S"), (S.pinyin_initial(F.lit("张")), "Z"), (S.batch_short_name(F.lit("武汉-红枫有限公司")), "红枫"), (S.file_name_part(F.lit("a/b:c")), "a b c"),
        (S.js_round2(F.lit(-2.5) / 100 * 100), -2.5), (S.strict_number(F.lit("0x10")), 16.0), (S.strict_number(F.lit("12d")), None), (S.number_prefix(F.lit("-3.")), -3.0),
    ]
    for k, (column, want) in enumerate(cases):
        assert one(spark, column) == want, k


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ('a,b\r\n"x, y",z\r"q ""w""",1\n\n,\n', [["a", "b"], ["x, y", "z"], ['q "w"', "1"]]),
        ('ab"c,d"e,f', [["abc,de", "f"]]),
        ('"line\nbreak",2', [["line\nbreak", "2"]]),
        ("", []),
        ("a,", [["a", ""]]),
        ('"open', [["open"]]),
    ],
)
def test_csv(text, rows):
    assert G.parse_csv(text) == rows


def test_encodings():
    assert G.decode("姓名,金额".encode()) == "姓名,金额"
    assert G.decode("姓名,金额\n王辉,100".encode("gb18030")) == "姓名,金额\n王辉,100"


SHEET = [
    ["2024 年发放表"],
    ["姓名", "身份证号码", "手机号码", "第一笔", "第二笔", "合计"],
    ["王辉", "110101199001011234", "13800138000", "100.5", "200", "300.5"],
    ["李四", "110101199001011235", "13800138001", "10", "", "10"],
    ["王五", "110101199001011236", "13800138002", "7", "8", "16"],
    ["赵六", "110101199001011237", "13800138003", "1", "2", "3"],
    ["钱七", "110101199001011238", "13800138004", "5", "5", "10"],
    ["姓名", "身份证号码", "手机号码", "第一笔", "第二笔", "合计"],
    ["合计", "", "", "123.5", "215", "338.5"],
    ["平台服务费", "", "", "", "", "20"],
    [" ", None],
]


def test_detection(spark):
    grid = spark.createDataFrame([("s", i, r) for i, r in enumerate(SHEET)], GRID)
    tables, rows, columns = D.detect_columns(grid)
    t = tables.first()
    assert (t["header_row"], t["filtered_count"]) == (1, 2) and t["header"][:2] == ["姓名", "身份证号码"]
    assert sorted(r["row_idx"] for r in rows.collect()) == [2, 3, 4, 5, 6]
    types = {r["col_idx"]: r["type"] for r in columns.collect()}
    assert types == {0: "name", 1: "idCard", 2: "phone", 3: "amount", 4: "amount", 5: "amountTotal"}
    split, bad = P.split_amounts(rows.select("source_id", "row_idx", "cells"), [3, 4], 5, labels={3: "第一笔", 4: "第二笔"}, label_note=True)
    got = {(r["row_idx"], r["split_idx"]): (r["cells"][3], r["cells"][4], r["cells"][6]) for r in split.collect()}
    assert got[2, 1] == ("200", "", "第二笔") and (3, 1) not in got and len(got) == 9
    assert [(r["row_idx"], r["sum"], r["declared"]) for r in bad.collect()] == [(4, 15.0, 16.0)]
    assert D.detect_tables(grid.limit(0))[1].count() == 0
    ragged = spark.createDataFrame([("s", 0, ["甲", "1", "2", "n"]), ("s", 1, ["乙", "", "7"]), ("s", 2, ["丙"])], GRID)
    got = {(r["row_idx"], r["split_idx"]): r["cells"] for r in P.split_amounts(ragged, [1, 2], note_col=3, labels={1: "x", 2: "y"}, label_note=True)[0].collect()}
    assert got == {(0, 0): ["甲", "1", "", "n；x"], (0, 1): ["甲", "2", "", "n；y"], (1, 1): ["乙", "7", "", "y"], (2, 0): ["丙", "", "", ""]}


def test_task_parts_and_sheet_text(spark):
    assert one(spark, S.task_parts(F.lit("3.装卸(夜班)(T9)")))["id"] == "T9"
    assert one(spark, S.task_parts(F.lit("3.装卸()"))) is None
    assert one(spark, S.sheet_text(F.lit("6222\u200b 0000  1234"))) == "622200001234"


def test_merge(spark):
    rows = spark.createDataFrame(
        [("s", 0, ["王辉", "1", "100.10", "A店", "n"]), ("s", 1, ["王 辉", "1", "1,000.2", "B店", ""]), ("s", 2, ["李四", "2", "5", "", ""]), ("s", 3, ["赵六", "2", "6", "", ""]), ("s", 4, ["", "", "9", "", ""])], GRID
    )
    out, groups = P.merge_people(rows, {"idCard": 1, "name": 0, "note": 4}, [2], {3: "门店"}, merge=True)
    got = {r["row_idx"]: r["cells"] for r in out.collect()}
    assert got[0] == ["王辉", "1", "1100.30", "A店", "n；门店：A店、B店"] and sorted(got) == [0, 2, 3, 4]
    assert {(r["key"], len(r["conflicts"])) for r in groups.collect()} == {("id:1", 0), ("id:2", 1)}


def test_workbook_round_trip():
    rows = [["姓名", "金额"], ["王辉 <&>", 12.5], ["", "x"]]
    assert G.parse_xlsx(X.xlsx_bytes([("表一", rows), ("b", [])])) == [("表一", [["姓名", "金额"], ["王辉 <&>", "12.5"], ["", "x"]]), ("b", [])]


def test_html_and_json(spark):
    assert G.parse_html_table("<table><tr><td>a</td></tr></table><table><tr><th> x </th><td>y</td></tr><tr><td></td></tr><tr><td>1</td></tr></table>") == [["x", "y"], ["1"]]
    answers = spark.createDataFrame([(1, '```json\n[["a","b"],["",""]]\n```'), (2, '{"header":["h"],"rows":[["1"]]}'), (3, "no json")], "id long, text string")
    got = sorted((r["source_id"], r["cells"]) for r in G.json_rows(answers, "id", "text").collect())
    assert got == [("1", ["a", "b"]), ("2", ["1"]), ("2", ["h"])]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    for _ in range(2):
        drop_folder.write_grids(drop_folder.csv_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["cells"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("row_idx").collect()] == [["a", "b"], ["1", "2"]]


def test_names():
    assert X.strip_common_parts(["发放-甲-1月", "发放-乙-1月"]) == ["甲", "乙"]
    assert X.csv_text(["a", "b"], [("x,y", None)]) == 'a,b\n"x,y",'


def test_recognised_cells(spark):
    assert one(spark, V.clean_ocr_cell(F.lit("|“ ６２２２ 0001 0002 0003，"))) == "6222000100020003"
    assert one(spark, V.clean_ocr_cell(F.lit("郭 卫 杰"))) == "郭卫杰"
    assert one(spark, V.suggested_fix(F.lit("1日O&5"))) == "100.5"
    assert one(spark, V.work_type(F.lit("1.提供数据标注服务(9)"), F.lit(""))) == "技术"
    assert one(spark, V.work_type(F.lit("2.从事绿化养护工作(9)"), F.lit(""))) == "绿化养护"
    assert one(spark, V.bank_place(F.lit("中国银行武汉支行"), ["广州", "武汉"])) == "武汉"
    rows = spark.createDataFrame([("s", 0, ["110101199001011234", "1380013800", "1日.5"]), ("s", 1, ["11010519491231002X", "13800138000", "12.50"])], GRID)
    got = sorted((r["row_idx"], r["col_idx"], r["issue"], r["fix"]) for r in V.cell_issues(rows, {"idCard": 0, "phone": 1, "amount": 2}).collect())
    assert got == [(0, 0, "checksum", None), (0, 1, "phone", None), (0, 2, "amount", "10.5")]
    loose = spark.createDataFrame([("s", 0, ["无", "138 0013 8000", "待定"]), ("s", 1, ["1234567890123456789", "OOO", "1 2"]), ("s", 2, [None])], GRID)
    got = sorted((r["row_idx"], r["col_idx"], r["issue"], r["fix"]) for r in V.cell_issues(loose, {"idCard": 0, "phone": 1, "amount": 2}).collect())
    assert got == [(1, 0, "form", None), (1, 2, "amount", None)]


def test_templates(spark):
    rows = spark.createDataFrame([("s", 0, ["王辉2", "110101199001011234", "1,200.50"]), ("s", 1, ["", "", "3"])], GRID)
    out = X.project(rows, {"name": 0, "idCard": 1, "amount": 2}, X.TEMPLATES["youyi"]).collect()
    assert len(out) == 1 and (out[0]["姓名"], out[0]["性别"], out[0]["税前金额"]) == ("王辉2", "男", "1200.5")
    named = X.clean_name_column(rows, {"name": 0})
    assert [(r["cells"][0], r["_renamed"]) for r in named.orderBy("row_idx").collect()] == [("王辉", True), ("", False)]
    assert X.split_file_names([("a-甲.xlsx", "x"), ("a-乙.xlsx", "x")], "T", "compact") == ["甲", "乙"]
    files = X.group_files(rows.select(F.lit("甲").alias("group"), F.get("cells", F.lit(0)).alias("姓名")), ["姓名"]).collect()
    assert G.parse_xlsx(bytes(files[0]["content"]))[0][1] == [["姓名"], ["王辉2"], [""]]


def test_name_lookups_take_every_client(spark, tmp_path):
    from tabulant.plans import queries as Q

    parts = [(k, f"w{k % 7} v{k % 400}", f"Brand#{k % 3}") for k in range(450)]
    parts += [(500, "solo", "Brand#1"), (501, "so", "V399")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for q in {w for _, name, _ in parts for w in name.split(" ")}:
        for pos, full, brand in parts:
            short = brand.lower()
            rank = 1 if full == q else 2 if short == q else 3 if q in full or q in short else 4 if full in q or short in q else None
            if rank:
                want[q, pos] = rank
    found = {(r["q"], r["pos"]): r["match_rank"] for r in Q.QUERIES["lookup_name_all"](spark, str(tmp_path)).collect()}
    assert found == {k: min(r, 3) for k, r in want.items()} and any(pos >= 200 for _, pos in found)
    first = {r["q"]: r["pos"] for r in Q.QUERIES["lookup_name_first"](spark, str(tmp_path)).collect()}
    assert first == {q: min((r, pos) for (x, pos), r in want.items() if x == q)[1] for q in {q for q, _ in want}}
    assert first["v399"] == 501 and first["solo"] == 500
