"""Positioned text and words to grids; coordinates as in payout documents."""

from tabulant.sources import positioned as P

ITEM = "source_id string, page int, str string, x double, y double, w double, h double"
WORD = "source_id string, text string, x double, y double, w double, h double, confidence double"


def grid(frame):
    out = {}
    for r in frame.orderBy("source_id", "row_idx").collect():
        out.setdefault(r["source_id"], []).append(r["cells"])
    return out


def items(spark, *pages, h=10.0):
    rows = [(s, p, x[0], float(x[1]), float(x[2]), float(x[3] if len(x) > 3 else 10), float(x[4] if len(x) > 4 else h)) for s, p, page in pages for x in page]
    return P.items_to_grid(spark.createDataFrame(rows, ITEM).repartition(3))


def test_text_items(spark):
    head = [("服务人员", 104, 113, 40), ("身份", 189, 113, 20), ("序号", 66, 107, 18), ("手机号码", 269, 107, 40), ("银行卡开户行名称", 360, 107, 80), ("姓名", 115, 101, 20), ("证号", 189, 101, 20)]
    glue = [("服务人员", 104, 113, 40), (" ", 145, 113, 1400, 0), ("序号", 66, 107, 18), ("姓名", 115, 101, 20)]
    card = [("1", 70, 80, 5), ("6222", 482, 80, 18), (" ", 501, 80, 4, 0), ("0000", 506, 80, 18), (" ", 524, 80, 4, 0), ("1234", 529, 80, 18), (" ", 548, 80, 4, 0), ("5678", 552, 80, 18)]
    sparse = [("序号", 66, 100, 18), ("姓名", 104, 100, 40), ("岗位", 200, 100, 20), ("备注", 300, 100, 20), ("结算金额", 400, 100, 40), ("1", 70, 80, 5), ("张三", 110, 80, 20), ("录入", 205, 80, 20), ("ok", 305, 80, 10), ("3500.00", 405, 80, 36), ("2", 70, 60, 5), ("4200.00", 402, 60, 36)]
    title = [("测试公司2026年9月结算明细", 209, 140, 300), ("序号", 66, 100, 18), ("姓名", 104, 100, 40), ("结算金额", 400, 100, 40), ("1", 70, 80, 5), ("张三", 110, 80, 20), ("3500.00", 405, 80, 36)]
    got = grid(items(spark, ("head", 0, head), ("glue", 0, glue), ("card", 0, card), ("sparse", 0, sparse), ("title", 0, title), ("short", 0, [("12 34", 66, 100, 20)]), ("blank", 0, [(" ", 1, 1), ("", 2, 2)]), ("two", 1, [("b", 0, 500)]), ("two", 0, [("a", 0, 10), ("c", 0, 90)])))
    assert got["head"] == [["序号", "服务人员姓名", "身份证号", "手机号码", "银行卡开户行名称"]]
    assert got["glue"] == [["序号", "服务人员姓名"]] and got["card"] == [["1", "6222000012345678"]] and got["short"] == [["12 34"]]
    assert got["sparse"][2] == ["2", "", "", "", "4200.00"] and len(got["sparse"]) == 3
    assert got["title"] == [["", "", "测试公司2026年9月结算明细"], ["序号", "姓名", "结算金额"], ["1", "张三", "3500.00"]]
    assert got["two"] == [["c"], ["a"], ["b"]] and "blank" not in got  # pages in order


def test_dense_page_with_overflowing_cells(spark):
    page = [
        ("序号", 22.08, 464.76, 10.78), ("户名", 41.16, 464.76, 10.78), ("手机号码", 163.68, 464.76, 21.61), (" ", 185.29, 464.76, 62.74, 0), ("开户行", 232.34, 464.76, 16.17), (" ", 248.51, 464.76, 90.26, 0), ("账号", 373.32, 464.76, 51.21),
        ("1", 25.19, 452.52, 3.2), ("张三", 41.16, 452.52, 10.78), ("13800000001", 156.95, 452.52, 35.07), (" ", 192.02, 452.52, 21.35, 0), ("虚构银行测试支行", 213.37, 452.52, 86.3), ("6222000012345678", 373.32, 452.52, 51.21),
        ("2", 25.19, 411.36, 3.2), ("李四", 41.16, 411.36, 10.78), ("13900000002", 156.95, 411.36, 35.07), (" ", 192.02, 411.36, 21.35, 0), ("溢出压进邻列测试支行", 186.25, 411.36, 108.23), ("6222000012345679", 373.32, 411.36, 51.21),
        ("3", 25.19, 395.2, 3.2), ("王五", 41.16, 395.2, 10.78), ("13700000003", 156.95, 395.2, 35.07), (" ", 192.02, 395.2, 5.14, 0), ("虚构银行超长测试支行", 197.16, 395.2, 86.62), ("6222000012345670", 373.32, 395.2, 51.21),
    ]
    assert grid(items(spark, ("p", 0, page), h=5.39))["p"] == [
        ["序号", "户名", "手机号码", "开户行", "账号"], ["1", "张三", "13800000001", "虚构银行测试支行", "6222000012345678"],
        ["2", "李四", "13900000002", "溢出压进邻列测试支行", "6222000012345679"], ["3", "王五", "13700000003", "虚构银行超长测试支行", "6222000012345670"],
    ]


def test_bands_fuse_by_half_or_small_gap():
    assert P.bands_of_page([(0, 10), (12, 20), (30, 40)], 3) == [(0, 20), (30, 40)]
    assert P.bands_of_page([(0, 10), (4, 12), (9, 30)], 1) == [(0, 12), (9, 30)]
    assert P.bands_of_page([(0, 4), (5.5, 6), (1, 20)], 1) == [(0, 20)]
    assert P.bands_of_page([], 1) == []


def words(spark, *rows):
    return spark.createDataFrame([(s, t, float(x), float(y), float(w), float(h), 95.0) for s, t, x, y, w, h in rows], WORD).repartition(3)


def lines(spark, **borders):
    return spark.createDataFrame([(s, x) for s, xs in borders.items() for x in xs], "source_id string, x int")


def test_words_between_lines(spark):
    data = [
        ("a", "9月", 10, 5, 30, 16), ("a", "代扣缴后", 160, 5, 70, 16), ("a", "第一笔", 410, 5, 60, 16), ("a", "王辉", 5, 40, 20, 16), ("a", "39315.71", 340, 40, 55, 16), ("a", "20768.06", 580, 40, 58, 16),
        ("b", "甲", 10, 5, 20, 16), ("b", "乙", 150, 5, 20, 16), ("b", "丙", 400, 5, 20, 16), ("b", "a1", 10, 40, 15, 16), ("b", "a2", 170, 40, 15, 16), ("b", "a3", 230, 40, 15, 16), ("b", "b1", 400, 40, 15, 16),
        ("c", "开户行", 150, 5, 40, 16), ("c", "中国农业银行", 305, 40, 320, 16), ("c", "外", 900, 40, 10, 16), ("c", " ", 1, 1, 5, 5), ("c", "x", 1, 1, 0, 5),
        ("d", "6222 0000", 5, 5, 40, 16), ("d", "1111", 50, 5, 30, 16), ("d", "next", 5, 60, 10, 16), ("e", "few", 5, 5, 10, 10),
    ]
    got = grid(P.words_in_borders(words(spark, *data), lines(spark, a=[0, 150, 400, 650], b=[0, 150, 400, 650], c=[650, 0, 150, 400], d=[0, 100, 200], e=[0, 50])))
    assert got["a"] == [["9月", "代扣缴后", "第一笔"], ["王辉", "39315.71", "20768.06"]]
    assert got["b"] == [["甲", "乙", "", "丙"], ["a1", "a2", "a3", "b1"]]
    assert got["c"][0] == ["", "开户行", "", ""] and got["c"][1] == ["", "", "中国农业银行", "外"]  # nothing overlaps the last: the nearest region, a sub-cell of its own
    assert got["d"] == [["622200001111", ""], ["next", ""]] and "e" not in got


def test_words_to_grid(spark):
    data = words(spark, ("a", "9月", 10, 5, 30, 16), ("a", "代扣缴后", 160, 5, 70, 16), ("a", "王辉", 5, 40, 20, 16), ("a", "39315.71", 340, 40, 55, 16), ("b", "上", 0, 0, 10, 10), ("b", "下", 0, 50, 10, 10))
    images = spark.createDataFrame([("a", 80), ("b", 80), ("none", 80)], "source_id string, height int")
    rows, sure = P.words_to_grid(data, images, lines(spark, a=[0, 150, 400]))
    assert grid(rows) == {"a": [["9月", "代扣缴后"], ["王辉", "39315.71"]], "b": [["上"], ["下"]]}
    assert {r["source_id"]: r["confidence"] for r in sure.collect()} == {"a": 95.0, "b": 95.0}
    assert set(grid(P.words_to_grid(data, images)[0])) == {"a", "b"}
    some = data.withColumn("confidence", P.F.when(P.F.col("x") > 5, 90.0).otherwise(90.25))
    assert {r["source_id"]: r["confidence"] for r in P.words_to_grid(some, images)[1].collect()} == {"a": 90.1, "b": 90.3}


def test_boxes_of_polygons(spark):
    nan = float("nan")
    data = [("s", "王1", [[1.0, 2.0], [5.0, 2.5], [5.5, 9.0], [0.5, 8.0]], 0.876), ("s", "|—~", [[0.0, 0.0], [1.0, 1.0]], 1.0), ("s", "x", [[0.0, 0.0]], 1.0), ("s", "y", [[nan, 0.0], [2.0, None], [3.0, 4.0]], 7.0), ("s", "z", None, 1.0), ("s", "v", [[nan, 1.0], [None, 2.0]], 1.0), ("s", None, [[0.0, 0.0], [1.0, 1.0]], 1.0), ("s", "w", [[0.0, 0.0], [1.0, 3.0]], None)]
    got = P.boxes_of_polygons(spark.createDataFrame(data, "source_id string, text string, poly array<array<double>>, score double")).collect()
    assert [(r["text"], r["x"], r["y"], r["w"], r["h"], round(r["confidence"], 6)) for r in got] == [("王1", 0.5, 2.0, 5.0, 7.0, 87.6), ("y", 3.0, 4.0, 0.0, 0.0, 100.0), ("w", 0.0, 0.0, 1.0, 3.0, 0.0)]
