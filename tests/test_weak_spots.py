"""Operators that no query runs end to end, on small literals."""

import datetime

from pyspark.sql import functions as F
from tabulant.functions import constants as C
from tabulant.operators import client_match as M
from tabulant.operators import detect as D
from tabulant.operators import export as X
from tabulant.operators import people as P
from tabulant.operators import reference_data as R
from tabulant.operators import reference_io as I
from tabulant.sources import grids as G

GRID = "source_id string, row_idx long, cells array<string>"
PERSON = ["110101199001011234", "13800138000"]


def people(spark, head, rows, source="s"):
    return spark.createDataFrame([(source, i, r) for i, r in enumerate([*head, *rows])], GRID)


def types(columns):
    return {r["col_idx"]: r["type"] for r in columns.collect()}


def test_two_lines_of_a_header(spark):
    rows = [["王辉", *PERSON, "5", "a"], ["李四", *PERSON, "6", "b"]]
    tables, data, columns = D.detect_columns(people(spark, [["姓名", "身份证", "手机", "税前", "其他"], ["", "号码", "", "金额", ""]], rows))
    assert tables.first()["header"] == ["姓名", "身份证号码", "手机", "税前金额", "其他"] and data.count() == 2
    assert types(columns) == {0: "name", 1: "idCard", 2: "phone", 3: "amount", 4: ""}
    for second in (["1", "", "", "", ""], ["", "比十个字还要长的一段文字", "", "", ""], ["a", "b", "c", "d", ""], ["", "", "", "", ""]):
        t = D.detect_tables(people(spark, [["姓名", "身份证", "手机", "税前", "其他"], second], rows))[0].first()
        assert t["header"][1] == "身份证", second


def test_header_patterns_samples_and_names(spark):
    body = [["王辉", *PERSON, str(k), str(2 * k), ""] for k in range(1, 5)]
    for a, b in (("第一笔", "第2笔"), ("1月", "12月")):
        found = D.detect_columns(people(spark, [["姓名", "身份证", "手机", a, b, ""]], body))[2]
        assert types(found) == {0: "name", 1: "idCard", 2: "phone", 3: "amount", 4: "amount"}
    found = {r["col_idx"]: r for r in D.detect_columns(people(spark, [["姓名", "", "手机", "税前金额"]], [["王辉", "", "13800138000", "5"], ["", "x1", "13800138001", "6"], ["李四", "x2", "13800138002", "7"], ["赵六", "x3", "13800138003", "8"]]))[2].collect()}
    assert 1 not in found and found[0]["samples"] == ["王辉", "李四"] and found[3]["samples"] == ["5", "6", "7"]  # a column without a header or a type is no column
    unnamed = people(spark, [["x", "身份证", "手机", "税前金额"]], [[n, *PERSON, "5"] for n in ("王辉", "李四", "赵六", "y")])
    assert types(D.detect_columns(unnamed)[2])[0] == "" and types(D.detect_columns(unnamed, infer_names=True)[2])[0] == "name"


def test_overrides_and_columns_of_types(spark):
    columns = spark.createDataFrame([("s", 0, "name"), ("s", 1, "amount"), ("s", 2, "amount"), ("s", 3, "phone"), ("s", 4, "phone"), ("s", 5, "")], "source_id string, col_idx int, type string")
    assert {r["type"]: r["col_idx"] for r in D.type_columns(columns).collect()} == {"name": 0, "amount": 1, "phone": 4}
    own = spark.createDataFrame([("s", 0, ""), ("s", 5, "note"), ("t", 1, "x")], "source_id string, col_idx int, type string")
    assert types(D.override_types(columns, own)) == {0: "", 1: "amount", 2: "amount", 3: "phone", 4: "phone", 5: "note"}


def test_scores_and_selection_of_sheets(spark):
    good = [["王辉", *PERSON, "5"] for _ in range(4)]
    grid = people(spark, [["姓名", "身份证", "手机", "税前金额"]], good, "a").unionByName(people(spark, [["姓名", "身份证", "手机", "税前金额"]], good[:1], "b")).unionByName(people(spark, [["x"]], [["y"]], "c"))
    names = spark.createDataFrame([("a", "工资明细", "f", 1), ("b", "汇总", "f", 0), ("c", "表", "f", 2), ("d", "空", "g", 0)], "source_id string, sheet_name string, file string, sheet_pos int")
    scores = D.source_scores(*D.detect_columns(grid), names.select("source_id", "sheet_name")).join(names.drop("sheet_name"), "source_id")
    got = {r["source_id"]: (r["score"], r["data_rows"]) for r in scores.collect()}
    # 25 + 20 + 10 + 10 for the header, 8 for three rows, 18 and 12 for full shares, 8 or -12 for the name
    assert got["a"] == (111, 4) and got["b"] == (83, 1) and got["d"] == (-999, 0) and got["c"][0] < 30
    chosen = {r["source_id"]: (r["selected"], r["place"]) for r in D.selected_sheets(scores).collect()}
    assert chosen == {"a": (True, 1), "b": (False, 2), "c": (False, 3), "d": (True, 1)}  # a file without a fit sheet takes its best


def test_lists_streams_and_borders(spark):
    lists = spark.createDataFrame([(0, ["a"]), (1, []), (2, None)], "k int, up array<string>")
    assert [r["x"] for r in lists.select(R.config_list(F.col("up"), ("d", "e")).alias("x")).collect()] == [["a"], ["d", "e"], ["d", "e"]]
    events = spark.createDataFrame([("s", 2, "b"), ("s", 10, "c"), ("s", 1, "a"), ("t", 0, ""), ("u", 0, None), ("u", 1, "x")], "k string, seq int, delta string")
    assert {r["k"]: r["text"] for r in G.sse_text(events, "k", "seq", "delta").collect()} == {"s": "abc", "u": "x"}
    dark = {("a", x) for x in (10, 20, 21, 22, 29)} | {("b", x) for x in (10, 20)}
    pixels = [(s, x, y, 100 if (s, x) in dark or (x == 15 and y < 6) else 255) for s in "ab" for x in range(30) for y in range(10)]
    lines = G.column_borders(spark.createDataFrame(pixels, "source_id string, x int, y int, lum int"))
    assert sorted((r["source_id"], r["x"]) for r in lines.collect()) == [("a", 10), ("a", 21), ("a", 29)]


def test_custom_projection_keeps_everybody(spark):
    rows = spark.createDataFrame([("s", 0, ["", "5"]), ("s", 1, ["王 辉", "x"])], GRID)
    own = X.Template("custom", ("钱", "谁", "空"), (("amount", "钱"), ("name", "谁")))
    got = X.project(rows, {"name": 0, "amount": 1}, own, keep_all=True).orderBy("row_idx").collect()
    assert [(r["钱"], r["谁"], r["空"]) for r in got] == [("5", "", ""), ("", "王辉", "")]
    assert X.project(rows, {"name": 0, "amount": 1}, own).count() == 1


def test_client_info_of_a_batch(spark):
    grids = "source_pos int, row_idx long, cells array<string>"
    empty = spark.createDataFrame([], grids)
    raw = spark.createDataFrame([(0, 0, ["x", "税号", ""]), (1, 3, ["公司名称：", "乙公司"]), (1, 1, ["说明 委托方： 甲公司 "]), (1, 0, [None, "信用代码:9X"]), (0, 5, ["税号：8Y"])], grids)
    mapped = spark.createDataFrame([(1, "图公司", "T1"), (0, " ", None), (2, "later", "T2")], "source_pos int, client_name string, tax_id string")
    first = lambda g, m: tuple(M.client_info(g, m).first())
    assert first(raw, mapped) == ("甲公司", "8Y") and first(empty, mapped) == ("图公司", "T1") and first(raw.where("source_pos = 0"), mapped.limit(0)) == ("", "8Y") and first(empty, mapped.limit(0)) == ("", "")
    data = spark.createDataFrame([(0, 9, ["a", "b"]), (0, 4, ["c", "d"]), (1, 0, ["e"])], grids)
    places = spark.createDataFrame([(0, 1, None), (1, 0, 3)], "source_pos int, client_col int, tax_col int")
    assert sorted(map(tuple, M.first_mapped(data, places).collect())) == [(0, "d", None), (1, "e", None)]
    assert C.CLIENT_LABEL.count("|") == 3


def test_client_sheets_are_merged(spark):
    old = spark.createDataFrame([("1", 5, "甲", "甲公司", "T", 6.0, "佛山", [("a", "x"), ("a", "x")]), ("2", 7, "乙", "", "", None, "", None)], "id string, pos long, short_name string, full_name string, tax_id string, fee_rate double, sign_entity string, tasks array<struct<name:string,content:string>>")
    head = ("id", "short_name", "full_name", "tax_id", "fee_rate", "sign_entity", "task_name", "task_content")
    rows = [(3, "9", "", "九", "", "", "", "t", "u"), (1, " 1 ", "甲新", "", "", "x", "", "a", "x"), (2, "1", "", "", "", "7.5%", "", "b", None), (4, "9", "玖", "", "N", "", "", "t", "u"), (5, "", "nobody", "", "", "", "", "", ""), (6, "9", "", "", "", "", "", "s", ""), (7, "8", None, None, None, None, None, None, None)]
    merged, counts = I.upsert_clients(old, spark.createDataFrame(rows, "row_idx long, " + ", ".join(f"{c} string" for c in head)))
    got = {r["id"]: (r["pos"], r["short_name"], r["full_name"], r["tax_id"], r["fee_rate"], r["sign_entity"], [tuple(t) for t in r["tasks"]], r["added"]) for r in merged.collect()}
    assert got == {
        "1": (5, "甲新", "甲公司", "T", 7.5, "佛山", [("a", "x"), ("a", "x"), ("b", "")], False), "2": (7, "乙", "", "", None, "", [], False),
        "9": (11, "玖", "九", "N", 0.0, "", [("t", "u"), ("s", "")], True), "8": (15, "", "", "", 0.0, "", [], True),
    }
    assert tuple(counts.first()) == (2, 4)
    assert I.upsert_clients(old.limit(0), spark.createDataFrame(rows[:1], "row_idx long, " + ", ".join(f"{c} string" for c in head)))[0].first()["pos"] == 3


def test_remarks_by_preset(spark):
    rows = spark.createDataFrame([("a.b.xlsx", "表", " 1 ", "old"), ("", None, "9", "")], "_file string, _sheet string, `商社编号` string, note string")
    owned = spark.createDataFrame([("1", 0, "", "全称"), ("1", 1, "later", "")], "id string, pos long, short_name string, full_name string")
    value = lambda preset, **k: [r["_remark"] for r in X.remark_values(rows, preset, **k).orderBy(F.desc("_file")).collect()]
    assert value("filename", selected_files=["x.csv", "", "y.csv"]) == ["a.b", "x.csv、y"] and value("sheetname") == ["表", ""] and value("client", clients=owned) == ["全称", ""]
    assert value("date", today=datetime.date(2026, 1, 2)) == ["2026-01-02"] * 2 and value("custom", custom=" c ") == ["c", "c"] and value("none") == ["", ""]
    put = X.apply_remark(X.remark_values(rows, "filename"), "note", F.lit(True), F.col("_remark"), True).orderBy(F.desc("_file"))
    assert [r["note"] for r in put.collect()] == ["old a.b", ""]


def test_upper_median(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("c", None), (None, 1.0), (None, 2.0)], "k string, v double")
    assert {r["k"]: r["median"] for r in P.upper_median(rows, ["k"], "v").collect()} == {"a": 3.0, "b": 5.0, None: 2.0}


def test_rows_of_one_source_are_dealt_over_tasks(spark):
    """The facts of a source come to its rows without a task that holds all of them, also where nothing is broadcast."""
    from tabulant.operators import detect as D

    body = spark.range(1, 3000).select(F.lit("s").alias("source_id"), F.col("id").alias("row_idx"), F.array(F.lit("王辉"), F.lit("110101199003070732"), F.col("id").cast("string")).alias("cells"))
    head = spark.createDataFrame([("s", 0, ["姓名", "身份证", "金额"])], "source_id string, row_idx long, cells array<string>")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        _, rows = D.detect_tables(head.unionByName(body))
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 2999 and len(sizes) >= 4 and max(sizes) < 1500


def test_amounts_are_parsed_once(spark):
    """A cell is cleaned once per amount, not once for each mention in its checks."""
    from tabulant.functions import scalars as S

    cells = [("1,200.50",), ("￥ 3",), ("0",), ("0.00",), ("0x1F",), ("-5e1",), ("abc",), ("",), (None,), ("1.",), ("12元",)]
    df = spark.createDataFrame(cells, "c string").select(S.split_amount("c").alias("n"))
    assert [r["n"] for r in df.collect()] == [1200.5, 3.0, None, None, 31.0, -50.0, None, None, None, 1.0, None]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 4
