"""Workbooks written by the sink and read again."""

import datetime
import io
import zipfile

import pytest
from tabulant.functions import constants as C
from tabulant.operators import workbooks as B
from tabulant.operators.enrichment import Config
from tabulant.operators.export import TEMPLATES
from tabulant.sources import workbook_sink as W
from tabulant.sources.grids import parse_xlsx


def read(folder):
    return {p.name: dict(parse_xlsx(p.read_bytes())) for p in folder.iterdir()}


def part(folder, name, member):
    with zipfile.ZipFile(io.BytesIO((folder / name).read_bytes())) as z:
        return z.read(member).decode()


def rows(spark, headers, data):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], ", ".join(f"`{h}` string" for h in headers) + ", row_no long").repartition(4)


def test_payment_sheet(spark, tmp_path):
    headers = list(TEMPLATES["shenbianyun"].headers)
    data = [["", "", "王辉", "1101", "6222", "1,234.565", "138", "", None], ["", "", "李四", "", "", "x", "", "", ""], ["", "", "王五", "", "", "2.345", "", "", "<&>\x01"]]
    B.write_template(rows(spark, headers, data), "shenbianyun", headers, str(tmp_path), ["row_no"], batch_no="B1", plain_amount=False)
    (name, sheets), *more = read(tmp_path).items()
    assert name == "B1_身边云.xlsx" and not more and list(sheets) == ["Sheet1"]
    grid = sheets["Sheet1"]
    assert grid[0] == [C.PAYMENT_NOTE] and grid[1] == ["商户批次号（非必填）"] and grid[2] == ["B1"] and grid[3] == headers
    assert [r[5] for r in grid[4:]] == ["¥1,234.57", "x", "¥2.35"] and grid[6][8] == "<&>" and grid[4][8] == ""
    xml, styles = part(tmp_path, name, "xl/worksheets/sheet1.xml"), part(tmp_path, name, "xl/styles.xml")
    assert '<mergeCell ref="A1:I1"/>' in xml and "¥#,##0.00" in styles and "wrapText" in styles and 'width="22.6333333333333"' in xml
    assert '<c r="F5" s="3"><v>1234.57</v></c>' in xml and '<c r="A5" s="2" t="inlineStr">' in xml


def test_three_sheets_and_widths(spark, tmp_path):
    headers = ["姓名", "备注"]
    B.write_template(rows(spark, headers, [["王辉", "x" * 40], ["李四", "y"]]), "youyi", headers, str(tmp_path), ["row_no"], config=Config(("P1", "P2"), ("T1",)), tasks=["1.a(b)"], today=datetime.date(2026, 1, 2))
    assert read(tmp_path) == {"本公司_转换结果_20260102.xlsx": {"费用明细": [headers, ["王辉", "x" * 40], ["李四", "y"]], "配置表": [["税源地", "平台"], ["T1", "P1"], ["", "P2"]], "任务清单": [["任务清单"], ["1.a(b)"]]}}
    xml = part(tmp_path, "本公司_转换结果_20260102.xlsx", "xl/worksheets/sheet1.xml")
    assert '<col min="1" max="1" width="4"' in xml and '<col min="2" max="2" width="30"' in xml
    assert len(B.config_rows(Config(("P",)))) == 1 + len(C.PLATFORMS)  # platforms alone do not take the place of the defaults


def test_groups_in_parts(spark, tmp_path):
    data = [[f"n{k}", "a/b" if k % 3 else "c"] for k in range(100)]
    out = rows(spark, ["姓名", "组"], data)
    B.write_template(out, "yidao", ["姓名"], str(tmp_path), ["row_no"], group="组", part_rows=25)
    got = read(tmp_path)
    assert set(got) == {"a b.xlsx", "a b_2.xlsx", "a b_3.xlsx", "c.xlsx", "c_2.xlsx"}
    for base, want in (("a b", [r[0] for r in data if r[1] != "c"]), ("c", [r[0] for r in data if r[1] == "c"])):
        parts = [got[n]["智能模板"] for n in sorted(n for n in got if n.split("_")[0].removesuffix(".xlsx") == base)]
        assert all(p[0] == ["姓名"] and len(p) <= 26 for p in parts) and [r[0] for p in parts for r in p[1:]] == want
    B.write_books(B.sheet_rows(out.where("row_no < 2"), ["姓名"], B.template_book("custom", ["姓名"]), W_name("new"), ["row_no"]), str(tmp_path), overwrite=True)
    assert read(tmp_path) == {"new.xlsx": {"数据": [["姓名"], ["n0"], ["n1"]]}}


def W_name(name):
    from pyspark.sql import functions as F

    return F.lit(name)


def test_failures_leave_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("f.xlsx", 0, "s", i, ["x"]) for i in range(8)], W.SCHEMA).repartition(4, "row_no")
    with pytest.raises(Exception, match="several tasks"):
        B.write_books(bad, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    B.write_books(bad.limit(0), str(tmp_path / "none"))
    assert not list((tmp_path / "none").iterdir())
    with pytest.raises(ValueError):
        B.sheet_rows(bad, [], B.Book("s", [[""]] * (B.MOST_SHARED_ROWS + 1), [], {}), W_name("x"), ["row_no"])


def test_backup(spark, tmp_path):
    clients = spark.createDataFrame([("9", 1, "全", "简", None, 6.5, "佛山", [("a", "b"), ("c", None)]), ("8", 0, None, "", "T", None, None, None)], "id string, pos long, full_name string, short_name string, tax_id string, fee_rate double, sign_entity string, tasks array<struct<name:string,content:string>>")
    B.write_backup(clients, str(tmp_path), "b.xlsx", Config(entities=(("E", ("x", "y")),), platform_taxes=(("P", "T"),)), ["1.a(9)"])
    book = read(tmp_path)["b.xlsx"]
    assert list(book) == ["知识库", "配置表", "任务清单", "签约主体映射", "平台税源地映射"]
    assert book["知识库"] == [list(C.CLIENT_SHEET_HEADERS), ["8", "", "", "", "", "T", "", "", "", ""], ["9", "简", "全", "", "", "", "6.5", "佛山", "a", "b"], ["9", "简", "全", "", "", "", "6.5", "佛山", "c", ""]]
    assert book["任务清单"] == [["任务清单"], ["1.a(9)"]] and book["签约主体映射"][1] == ["E", "x,y"] and book["平台税源地映射"][1] == ["P", "T"] and len(book["配置表"]) == 1 + len(C.PLATFORMS)


def test_names_and_amounts():
    day = datetime.date(2026, 3, 4)
    assert B.file_name("yidao", "B") == "B_移步到岗.xlsx" and B.file_name("youyi", "B", day) == "本公司_转换结果_20260304.xlsx" and B.file_name("?", "", day) == "自定义_转换结果_20260304.xlsx"
    assert [W.amount(x) for x in ("1,234.565", "-.125", " 7元", "x", "", ".5e1")] == [1234.57, -0.12, 7.0, None, None, 5.0]
    assert [W.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_shown_numbers():
    from tabulant.sources.number_formats import shown

    cases = [
        ("5", "General", "5"), ("1234.5", "", "1234.5"), ("0.1", "General", "0.1"), ("0.30000000000000004", "General", "0.3"), ("6222000012345678", "General", "6.222E+15"), ("12345678901", "General", "12345678901"), ("1E-7", "General", "1E-7"),
        ("1234.565", "#,##0.00", "1,234.57"), ("-1234.5", "#,##0.00", "-1,234.50"), ("0.5", "0%", "50%"), ("0.1234", "0.00%", "12.34%"), ("1234.5", "¥#,##0.00", "¥1,234.50"), ("1234.5", '"￥"#,##0.0', "￥1,234.5"), ("5", "000", "005"), ("0.5", "#.##", ".5"), ("3", "0.##", "3"),
        ("-7", "0;(0)", "(7)"), ("0", '0;-0;"无"', "无"), ("12", '0"元"', "12元"), ("6222000012345678", "0", "6222000012345678"), ("1234567", "[$¥-804]#,##0", "¥1,234,567"),
        ("45292", "m/d/yy", "1/1/24"), ("45292", "yyyy-mm-dd", "2024-01-01"), ("45351", 'yyyy"年"m"月"d"日"', "2024年2月29日"), ("45292.75", "yyyy/m/d h:mm", "2024/1/1 18:00"), ("0.5", "h:mm AM/PM", "12:00 PM"), ("45292.0104166667", "mm:ss", "15:00"), ("1", "yyyy-mm-dd", "1900-01-01"), ("45292", "d-mmm-yy", "1-Jan-24"),
        ("abc", "0.00", "abc"), ("", "0", ""), ("15", "@", "15"),
    ]
    assert [(x, c, shown(x, c)) for x, c, _ in cases] == cases
    assert shown("43830", "yyyy-mm-dd", True) == "2024-01-01"
