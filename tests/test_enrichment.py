"""Enrichment, numbering and containment on small literals."""

import random

import pytest
from pyspark.sql import functions as F
from tabulant.operators import client_match as M
from tabulant.operators import enrichment as E
from tabulant.operators import export as X
from tabulant.operators import numbering as N
from tabulant.operators import reference_data as R
from tabulant.operators.name_index import containment_pairs

CLIENTS = "id string, pos long, full_name string, short_name string, tax_id string, sign_entity string, tasks array<struct<name:string,content:string>>"
ROWS = "k string, `商社编号` string, `平台` string, `税源地` string, `任务清单` string, `工种` string, note string"


def clients(spark):
    rows = [
        ("SS1", 0, "甲", "甲", "", "佛山云杉", [("保洁服务", "打扫"), ("植保", ""), ("保洁服务", "again")]),
        ("SS2", 1, "乙", "乙", "", "东莞云杉", None),
        (" SS3 ", 2, "丙", "丙", "", None, [("快递配送", None)]),
        ("SS1", 3, "later", "", "", "广州国联", [("翻译", "")]),
        (None, 4, "nobody", "", "", "广州国联", []),
    ]
    return spark.createDataFrame(rows, CLIENTS)


def enriched(spark, rows, config=E.Config(), listed=None):
    entries = spark.createDataFrame(listed, "pos long, entry string") if listed is not None else None
    lookup = E.client_lookup(clients(spark), config, entries)
    out = E.enrich_rows(spark.createDataFrame(rows, ROWS), lookup, config, E.RowText(("note",)))
    return {r["k"]: tuple(r[c] for c in (E.PLATFORM, E.TAX, E.TASK, E.WORK, "unmatched")) for r in out.collect()}


def test_only_empty_cells_are_filled(spark):
    got = enriched(
        spark,
        [
            ("fill", " SS1　", "", None, "", "", ""), ("keep", "SS1", "P", "T", "K", "W", ""), ("row", "SS1", "349.河南雅文", "", "", "", ""), ("other", "SS1", "none such", "", "", "", ""),
            ("note", "SS3", "", "", "", "", "开车送货"), ("bare", "SS2", "", "", "", "", ""), ("unknown", "SS9", "", "", "", "", ""), ("empty", None, "P", "", "", "", ""),
        ],
    )
    assert got["fill"] == ("278.甲乙科技", "0001.湖南", "1.保洁服务(SS1)", "保洁", False)
    assert got["keep"] == ("P", "T", "K", "W", False)
    assert got["row"][:2] == ("349.河南雅文", "0003.河南")  # the row's platform decides
    assert got["other"][:2] == ("none such", "0001.湖南")  # and the client's where it leads nowhere
    assert got["note"] == ("", "", "4.快递配送(SS3)", "搬运", False)
    assert got["bare"] == ("", "", "", "", False)
    assert got["unknown"] == ("", "", "", "", True) and got["empty"] == ("P", "", "", "", True)


def test_uploaded_lists_and_task_list(spark):
    config = E.Config(("东莞一号", "甲乙平台"), ("", "税乙"), (("佛山", ("没有", "甲乙")),), (("东莞", "税东"),))
    listed = [(3, "8.外语翻译(SS1)"), (1, "not a task"), (2, "7.植保(SS1)"), (4, "5.a(b)(SS2)"), (5, "6.x(none)"), (6, None)]
    got = enriched(spark, [("one", "SS1", "", "", "", "", ""), ("two", "SS2", "", "", "", "", "")], config, listed)
    assert got["one"] == ("甲乙平台", "税乙", "7.植保(SS1)", "植保", False)  # paired by position
    assert got["two"][:3] == ("东莞一号", "税东", "5.a(b)(SS2)")  # an empty pair falls back to keywords
    tasks = E.tasks_of_clients(clients(spark).where("pos < 3"), spark.createDataFrame(listed, "pos long, entry string"))
    assert sorted((r["id"], r["n"], r["seq"], r["name"], r["content"], r["full"]) for r in tasks.collect()) == [
        ("SS1", 2, 7, "植保", "", "7.植保(SS1)"), ("SS1", 3, 8, "外语翻译", "", "8.外语翻译(SS1)"), ("SS2", 4, 5, "a(b)", "", "5.a(b)(SS2)"), ("SS3", 0, 4, "快递配送", "", "4.快递配送(SS3)"), ("none", 5, 6, "x", "", "6.x(none)"),
    ]
    own = E.tasks_of_clients(clients(spark).where("pos < 3"))
    assert [r["full"] for r in own.orderBy("id", "n").collect()] == ["1.保洁服务(SS1)", "2.植保(SS1)", "1.保洁服务(SS1)", "4.快递配送(SS3)"]


def test_edits_of_platform_and_task(spark):
    rows = spark.createDataFrame([("a", "SS1", "P", "T", "K", "W", ""), ("b", "SS3", "", "", "", "", "开车")], ROWS)
    got = {r["k"]: (r[E.PLATFORM], r[E.TAX]) for r in E.set_platform(rows, "294.湖南清源", F.col("k") == "a").collect()}
    assert got == {"a": ("294.湖南清源", "0001.湖南"), "b": ("", "")}
    assert E.set_platform(rows, "nowhere", F.lit(True)).where("k = 'a'").first()[E.TAX] == "T"
    assert E.set_platform(rows, "", F.lit(True)).where("k = 'a'").first()[E.PLATFORM] == "P"
    tasks = E.tasks_of_clients(clients(spark).where("pos < 3"))
    text = E.RowText(("note",))
    for value, want in (("1.保洁服务(SS1)", ("保洁", "保洁")), ("9.提供园艺工作(X)", ("园艺", "司机")), ("plain", ("plain", "司机")), ("", ("W", ""))):
        got = {r["k"]: (r[E.TASK], r[E.WORK]) for r in E.set_task(rows, F.lit(value), F.lit(True), tasks, text).collect()}
        assert got == {"a": (value, want[0]), "b": (value, want[1])}
    assert E.set_task(rows, F.lit("plain"), F.col("k") == "b", tasks, text).where("k = 'a'").first()[E.WORK] == "W"
    assert [r[E.TAX] for r in E.set_cell(rows, E.TAX, "Z", F.col("k") == "b").orderBy("k").collect()] == ["T", "Z"]


def test_output_of_several_sources(spark):
    grid = "source_id string, row_idx long, cells array<string>"
    one = spark.createDataFrame([("a", 5, ["王辉", "SS1", "1,000元", "开车"]), ("a", 2, ["李四", "", " 5 ", ""]), ("a", 3, ["", "SS1", "7", ""])], grid)
    two = spark.createDataFrame([("b", 0, ["110101199003070732", "x", "SS3"])], grid)
    sources = [E.Source("f1.xlsx", "S", one, {"name": 0, "shangSheId": 1, "amount": 2, "note": 3}), E.Source("f2.csv", "", two, {"idCard": 0, "shangSheId": 2})]
    out = E.generate_output(sources, X.TEMPLATES["youyi"], E.client_lookup(clients(spark)), cities=["深圳"]).orderBy("row_no").collect()
    assert [(r["row_no"], r["_file"], r["_sheet"], r["姓名"], r["税前金额"], r["性别"], r["工种"], r["unmatched"]) for r in out] == [
        (0, "f1.xlsx", "S", "李四", "5", "", "", True), (1, "f1.xlsx", "S", "王辉", "1000", "", "保洁", False), (2, "f2.csv", "", "", "", "男", "搬运", False),
    ]
    assert out[0]["银行名称"] == "0" and out[0]["个税金额"] == "0" and [r["row_no"] for r in out if r["unmatched"]] == [0]
    plain = E.generate_output(sources, X.TEMPLATES["yidao"])
    assert "unmatched" not in plain.columns and plain.count() == 3
    with pytest.raises(ValueError):
        E.generate_output([], X.TEMPLATES["yidao"])


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_numbers_over_chunks(spark, chunk):
    r = random.Random(chunk)
    data = [(s, i, r.randrange(-3, 9)) for s in (None, "a", "b") for i in r.sample(range(-50, 200), 60)]
    rows = spark.createDataFrame(data, "s string, i long, v int").repartition(5)
    want, total = {}, 0
    for n, (s, i, v) in enumerate(sorted(data, key=lambda x: (x[0] is not None, x[0] or "", x[1]))):
        want[s, i] = (n, total)
        total += v
    got = N.running_before(N.numbered(rows, ["s", "i"], chunk=chunk), ["s", "i"], F.col("v"), "before", chunk)
    assert {(x["s"], x["i"]): (x["row_no"], x["before"]) for x in got.collect()} == want
    assert N.numbered(rows.limit(0), ["i"]).count() == 0


def test_containment_against_all_pairs(spark):
    r = random.Random(1)
    text = lambda: "".join(r.choice("ab甲乙 c") for _ in range(r.randrange(0, 9)))
    needles, hays = sorted({text() for _ in range(150)}), sorted({text() for _ in range(150)} | {"abab甲乙" * 200})
    got = containment_pairs(spark.createDataFrame([(x,) for x in [*needles, None]], "needle string"), spark.createDataFrame([(x,) for x in [*hays, None]], "hay string"))
    assert sorted(map(tuple, got.collect())) == [(n, h) for n in needles for h in hays if n and h and n in h]


def test_names_against_all_pairs(spark):
    r = random.Random(2)
    text = lambda: "".join(r.choice("ab甲乙c") for _ in range(r.randrange(0, 6)))
    known = [(f"i{p}", p, r.choice((None, "", " " + text())), text() + " ", "") for p in range(40)]
    asked = [(k, x, p) for k, (x, p) in enumerate((text(), k) for k in range(60))] + [(90, None, 1), (91, " 甲 ", 2), (91, " 甲 ", 2)]
    owned = spark.createDataFrame(known, "id string, pos long, full_name string, short_name string, tax_id string")
    for phases in (3, 4):
        want = []
        for k, q, _ in asked:
            q = (q or "").strip()
            for i, p, full, short, _ in known:
                full, short = (full or "").strip(), short.strip()
                within, around = q in full or q in short, (full and full in q) or (short and short in q)
                rank = 1 if full == q else 2 if short == q else 3 if within else phases if around else None
                if q and rank:
                    want.append((k, i, rank))
        rows = spark.createDataFrame([(k, q) for k, q, _ in asked], "k long, q string")
        found = R.lookup_name_all(rows, "q", owned, phases)
        assert sorted((x["k"], x["id"], x["match_rank"]) for x in found.collect()) == sorted(want)
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_clashing_columns(spark):
    owned = spark.createDataFrame([("1", 0, "甲公司", "甲", "X1"), ("2", 1, "甲公司二", "甲二", "")], "id string, pos long, full_name string, short_name string, tax_id string")
    rows = spark.createDataFrame([("a", "", "甲公司", "", 7, "h", "c", 1), ("b", "", "", "x1", 8, "h", "c", 2)], "b string, mapped_id string, client_name string, tax_id string, pos long, hits string, client_id string, name int")
    got = {r["b"]: r for r in M.best_client(rows, owned).collect()}
    assert got["a"]["pos"] == 7 and got["a"]["hits"] == "h" and got["a"]["name"] == 1 and len(got["a"]["candidates"]) == 2 and got["b"]["client_id"] == "1"
    assert {r["b"]: len(r["candidates"]) for r in M.client_candidates(rows, owned).collect()} == {"a": 2, "b": 1}
    joined = R.lookup_id(rows.withColumn("key", F.lit("1")), "key", owned)
    assert joined.select("pos", "full_name").first()[1] == "甲公司" and {r["pos"] for r in joined.collect()} == {7, 8}
