"""Client matching, direct tables and imports on small literals with nulls and empty tables."""

from tabulant.operators import client_match as M
from tabulant.operators import direct as T
from tabulant.operators import reference_io as I

CLIENTS = "id string, pos long, full_name string, short_name string, tax_id string"
BATCHES = "b string, mapped_id string, client_name string, tax_id string"


def test_best_client_with_nulls(spark):
    clients = spark.createDataFrame([("1", 0, "甲公司", "甲", None), ("2", 1, "乙公司", "乙", "x9"), ("3", 2, "乙公司二", "乙二", "")], CLIENTS)
    batches = spark.createDataFrame([("none", None, None, None), ("id", " 2 ", None, None), ("tax", "9", "甲", "X9"), ("name", None, "甲公司", ""), ("several", "", "乙公司", None)], BATCHES)
    got = {r["b"]: r for r in M.best_client(batches, clients).collect()}
    assert len(got) == 5 and {b: (r["client_id"], r["matched_by"]) for b, r in got.items()} == {"none": (None, None), "id": ("2", "id"), "tax": ("2", "tax"), "name": ("1", "name"), "several": (None, None)}
    assert [tuple(c) for c in got["several"]["candidates"]] == [("2", "2 - 乙", "全称精确"), ("3", "3 - 乙二", "模糊匹配")]
    shown = {r["b"]: [tuple(c) for c in r["candidates"]] for r in M.client_candidates(batches, clients).collect()}
    assert shown["tax"] == [("2", "2 - 乙", "税号精确")] and shown["none"] == []
    assert {r["client_id"] for r in M.best_client(batches, clients.limit(0)).collect()} == {None}
    # Without a tax id on both sides the first such client is found.
    assert M.reverse_lookup(spark.createDataFrame([("q", None, "")], "full_name string, short_name string, tax_id string"), clients).first()["client_id"] == "1"


def test_direct_tables_with_ragged_rows(spark):
    rows = spark.createDataFrame([("s", 0, ["王辉2", "5", "7"]), ("s", 1, [None]), ("s", 2, [])], "source_id string, row_idx long, cells array<string>")
    headers, out = T.raw_table(rows, {2: None, 0: "姓名"})
    assert headers == ["姓名", "列3"] and [r["cells"] for r in out.orderBy("row_idx").collect()] == [["王辉2", "7"], ["", ""], ["", ""]]
    headers, out, wrong = T.mapped_table(rows, {0: "name", 1: "amount", 2: "amount"}, {1: "一", 2: "二"}, 0, True)
    assert headers == ["姓名", "税前金额", "备注"]
    assert [r["cells"] for r in out.orderBy("row_idx", "split_idx").collect()] == [["王辉", "5", "一"], ["王辉", "7", "二"], ["", "", ""], ["", "", ""]]


def test_imports_into_empty_tables(spark):
    empty = spark.createDataFrame([], "pos long, entry string")
    new = spark.createDataFrame([(0, "1.a(9)"), (1, "2.a(9)"), (2, "plain")], "pos long, entry string")
    assert [(r["entry"], r["pos"], r["added"]) for r in I.merge_tasks(empty, new).orderBy("pos").collect()] == [("2.a(9)", 0, True), ("plain", 2, True)]
    assert [r["added"] for r in I.merge_tasks(new, empty).collect()] == [False, False]


def test_first_name_needs_no_order_over_matches(spark):
    from pyspark.sql import functions as F
    from tabulant.operators import reference_data as R

    clients = spark.createDataFrame([(5, "ab", "x"), (3, "abc", "ab"), (4, "ab", "q"), (9, "a", ""), (2, "abcd", "z"), (7, "w", "abc")], "pos long, full_name string, short_name string")
    asked = spark.createDataFrame([("ab",), (" abc",), ("zz",), ("ab",), ("wv",), ("",)], "q string")
    found = R.lookup_name_first(asked, "q", clients)
    want = R.first_by(R.lookup_name_all(asked, "q", clients, 4), ["q"], [F.col("match_rank"), F.col("pos")])
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
