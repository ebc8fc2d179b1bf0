"""Several templates from one scan, and counts from the pass that writes."""

from pyspark.sql import functions as F
from tabulant.operators import dry_run, people
from tabulant.operators import export as X

GRID = "source_id string, row_idx long, cells array<string>"


def test_one_scan_for_three_templates(spark, tmp_path):
    rows = [("a", 0, ["王辉", "110101199003070732", "1,200", ""]), ("a", 1, ["", "", "3", ""]), ("b", 0, ["李四", "", "7", "中国银行武汉支行"]), ("c", 0, ["不选", "", "1", ""])]
    spark.createDataFrame(rows, GRID).write.parquet(f"{tmp_path}/in")
    types, chosen = {"name": 0, "idCard": 1, "amount": 2, "bankName": 3}, spark.createDataFrame([("a",), ("b",), ("a",)], "source_id string")
    out = X.fan_out(spark.read.parquet(f"{tmp_path}/in"), types, list(X.TEMPLATES.values()), chosen, ["武汉"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    out.write.partitionBy("template").parquet(f"{tmp_path}/out")
    grid = spark.read.parquet(f"{tmp_path}/in").join(chosen.distinct(), "source_id", "left_semi")
    for key, t in X.TEMPLATES.items():
        want = X.project(grid, types, t)
        want = X.fill_constants(want, ["武汉"]) if key == "youyi" else want
        got = spark.read.parquet(f"{tmp_path}/out").where(F.col("template") == key)
        assert sorted((r["source_id"], r["row_idx"], tuple(r["cells"])) for r in got.collect()) == sorted((r["source_id"], r["row_idx"], tuple(r[h] for h in t.headers)) for r in want.collect())
        assert got.count() == 2
    assert X.fan_out(grid, types, [X.TEMPLATES["yidao"]]).count() == 2


def test_counts_come_with_the_rows(spark):
    rows = [("s", 0, ["王辉", "1", "100", "5", "105"]), ("s", 1, ["王辉", "1", "1", "", "1"]), ("s", 2, ["李四", "2", "5", "", "6"]), ("s", 3, ["赵六", "2", "6", "2", "8"]), ("s", 4, ["", "", "9", "0", "9"])]
    grid = spark.createDataFrame(rows, GRID).repartition(3)
    types = {"idCard": 1, "name": 0}
    for merge in (True, False):
        out, counts = dry_run.prepared(grid, types, [2, 3], 4, merge=merge)
        out.write.format("noop").mode("overwrite").save()
        got = counts.get()
        merged, groups = people.merge_people(grid, types, [2, 3], merge=merge)
        split, wrong = people.split_amounts(merged, [2, 3], 4)
        want = {"rows_merged": merged.count(), "rows_out": split.count(), "mismatches": wrong.count()}
        if merge:
            want |= {"rows_in": 5, "without_key": 1, "groups": groups.count(), "conflicting": groups.where("size(conflicts) > 0").count()}
        assert got == want
    out, counts = dry_run.prepared(grid.limit(0), types, [2])
    out.write.format("noop").mode("overwrite").save()
    assert counts.get()["rows_out"] == 0


def test_amounts_of_zero_are_written_in_full(spark, tmp_path):
    import duckdb
    from tabulant.plans import queries as Q

    balances = [0.0, -0.0, 0.5, -12.3, 7.0, 1234567.89, 0.004, 10.0]
    rows = [(k, f"Customer#{k:09d}", k % 3, b, ("BUILDING", "MACHINERY", "FURNITURE")[k % 3]) for k, b in enumerate(balances)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = sorted(duckdb.sql(Q.ORACLE_SQL["fan_out"]).fetchall())
    got = Q.QUERIES["fan_out"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("template", "source_id", "row_idx", "line").collect()) == want
    assert any(line.endswith("|0.00") for _, _, _, line in want)
