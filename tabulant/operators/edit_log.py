"""Logs of edits, replayed: lists and mappings, selections of rows, and cells with those that depend on them.

A log is ordered by ``seq``. What decides in the end is found by key with
aggregates; only the log of one list, which a person has typed, is folded step
by step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.functions import constants as C
from tabulant.functions.scalars import js_trim
from tabulant.operators.enrichment import PLATFORM, TASK, TAX, WORK, Config, RowText, with_work_type

#: Edits of whole selections that are held in one row.
MOST_SELECTIONS = 10_000
_ENTRY = "array<struct<key:string,value:array<string>>>"
_LISTS = ("tax_source", "platform", "task")


def default_entries() -> dict[str, list[tuple[str, list[str]]]]:
    """What is edited where nothing has been uploaded."""
    return {
        "tax_source": [(x, [x]) for x in C.TAX_SOURCES], "platform": [(x, [x]) for x in C.PLATFORMS],
        "sign_entity": [(k, list(v)) for k, v in C.SIGN_ENTITIES], "platform_tax": [(k, [v]) for k, v in C.PLATFORM_TAX], "task": [],
    }


def _seeds(kind: Column) -> Column:
    entries = lambda rows: F.array(*[F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, v)).alias("value")) for k, v in rows]).cast(_ENTRY) if rows else F.array().cast(_ENTRY)
    out = F.array().cast(_ENTRY)
    for name, rows in default_entries().items():
        out = F.when(kind == name, entries(rows)).otherwise(out)
    return out


def replay_lists(lists: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists after the log: owner, kind, pos, key, value; verdicts: owner, kind, seq, accepted).

    ``lists`` has (owner, kind, pos, key, value array<string>) with kinds
    tax_source, platform and task (lists; the value is the key alone), sign_entity
    and platform_tax (mappings). ``log`` has (owner, kind, seq, op, at, target,
    key, value): add; update and delete of position ``at`` (lists) or key
    ``target`` (mappings). Keys and values are trimmed. An edit is rejected if a
    key or value is empty, if the target is not there, or if the key exists
    already; an update keeps the place. A list nobody has uploaded begins with
    the defaults; tax sources and platforms count as uploaded together. Lists
    without a log are returned as they are.
    """
    had = lists.groupBy("owner", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", "value"))), lambda r: F.struct(r["key"].alias("key"), r["value"].alias("value"))).cast(_ENTRY).alias("had"))
    paired = lists.where(F.col("kind").isin("tax_source", "platform")).select("owner").distinct().withColumn("paired", F.lit(True))
    clean = F.filter(F.transform("value", js_trim), lambda v: v != "")
    listed = F.col("kind").isin(*_LISTS)
    edit = F.struct("seq", "op", F.coalesce("at", F.lit(-1)).alias("at"), "target", js_trim("key").alias("key"), F.when(listed, F.array(js_trim("key"))).otherwise(F.coalesce(clean, F.array().cast("array<string>"))).alias("value"))
    logs = log.groupBy("owner", "kind").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    both = logs.join(had, ["owner", "kind"], "left").join(paired, "owner", "left")
    seeded = F.when(F.col("kind").isin("tax_source", "platform") & F.col("paired"), F.array().cast(_ENTRY)).otherwise(_seeds(F.col("kind")))
    both = both.withColumn("had", F.coalesce("had", seeded)).withColumn("listed", listed)

    def step(state: Column, e: Column) -> Column:
        entries = state["entries"]
        keys = F.transform(entries, lambda x: x["key"])
        at = F.when(F.col("listed"), F.when(e["at"] < F.size(entries), e["at"]).otherwise(-1)).otherwise(F.array_position(keys, e["target"]).cast("int") - 1)
        full = (e["key"] != "") & (F.size(e["value"]) > 0)
        there = at >= 0
        other = ~F.array_contains(keys, e["key"])
        ok = F.coalesce(F.when(e["op"] == "add", full & other).when(e["op"] == "update", full & there & (other | (F.get(keys, at) == e["key"]))).when(e["op"] == "delete", there), F.lit(False))
        mine = F.struct(e["key"].alias("key"), e["value"].alias("value"))
        changed = (
            F.when(e["op"] == "add", F.concat(entries, F.array(mine)))
            .when(e["op"] == "update", F.transform(entries, lambda x, i: F.when(i == at, mine).otherwise(x)))
            .otherwise(F.filter(entries, lambda x, i: i != at))
        )
        return F.struct(F.when(ok, changed).otherwise(entries).cast(_ENTRY).alias("entries"), F.concat(state["accepted"], F.array(ok)).alias("accepted"))

    begin = F.struct(F.col("had").alias("entries"), F.array().cast("array<boolean>").alias("accepted"))
    done = both.withColumn("end", F.aggregate("edits", begin, step))
    verdicts = done.select("owner", "kind", F.inline(F.arrays_zip(F.col("edits.seq").alias("seq"), F.col("end.accepted").alias("accepted"))))
    edited = done.select("owner", "kind", F.posexplode("end.entries").alias("pos", "e")).select("owner", "kind", F.col("pos").cast("long").alias("pos"), "e.key", "e.value")
    still = lists.join(logs.select("owner", "kind"), ["owner", "kind"], "left_anti").select("owner", "kind", F.col("pos").cast("long").alias("pos"), "key", "value")
    return still.unionByName(edited), verdicts


def replay_selection(rows: DataFrame, log: DataFrame, file_col: str = "_file", default_file: str = "未命名文件") -> DataFrame:
    """Adds ``selected`` to rows with ``row_no``.

    ``log`` has (seq, op, n, file): ``row`` and ``unrow`` (row n), ``first`` and
    ``unfirst`` (the n rows in view), ``all``, ``clear``, and ``file``, which replaces the
    selection by a file's rows and does nothing where no row has that file. The
    last edit that touches a row decides. Edits of single rows are joined by
    row; the others are at most ``MOST_SELECTIONS``.
    """
    name = F.coalesce(F.nullif(F.col(file_col), F.lit("")), F.lit(default_file))
    wide = log.where(~F.col("op").isin("row", "unrow"))
    there = rows.select(name.alias("file")).distinct()
    wide = wide.where("op <> 'file'").select("seq", "op", "n", "file").unionByName(wide.where("op = 'file'").join(there, "file", "left_semi").select("seq", "op", "n", "file"))
    found = wide.limit(MOST_SELECTIONS + 1).agg(F.collect_list(F.struct("seq", "op", "n", "file")).alias("_wide"))  # one row
    found = found.withColumn("_wide", F.when(F.size("_wide") > MOST_SELECTIONS, F.raise_error(F.lit(f"more than {MOST_SELECTIONS} edits of whole selections"))).otherwise(F.col("_wide")))
    single = log.where(F.col("op").isin("row", "unrow")).groupBy(F.col("n").alias("_n")).agg(F.max(F.struct("seq", (F.col("op") == "row").alias("on"))).alias("_own"))
    placed = rows.join(single, F.col("row_no") == F.col("_n"), "left").crossJoin(F.broadcast(found))
    touching = F.filter("_wide", lambda e: e["op"].isin("all", "clear", "file") | (e["op"].isin("first", "unfirst") & (F.col("row_no") < e["n"])))
    last = F.array_max(F.transform(touching, lambda e: F.struct(e["seq"].alias("seq"), F.when(e["op"].isin("all", "first"), True).when(e["op"] == "file", name == e["file"]).otherwise(False).alias("on"))))
    decided = F.greatest(F.col("_own"), last)
    return placed.withColumn("selected", F.coalesce(decided["on"], F.lit(False))).select(*[c for c in rows.columns if c != "selected"], "selected")


def replay_cells(rows: DataFrame, log: DataFrame, tasks: DataFrame, config: Config = Config(), text: RowText = RowText()) -> DataFrame:
    """Rows (with ``row_no``) after a log (seq, row_no, field, value); a null ``row_no`` is every row.

    ``field`` is platform, tax or task. A platform takes its tax source along where
    it has one, a task its work type; later edits of those win. An empty value
    empties its cell, and for all rows at once an empty platform is no edit.
    """
    value = F.coalesce("value", F.lit(""))
    edits = log.where(~((F.col("field") == "platform") & F.col("row_no").isNull() & (value == ""))).withColumn("value", value)
    tax = config.tax(F.col("value"))
    follows = F.when(F.col("field") == "tax", F.col("value")).when((F.col("field") == "platform") & (F.col("value") != "") & (tax != ""), tax)
    effects = {
        "platform": F.when(F.col("field") == "platform", F.col("value")), "tax": follows,
        "task": F.when(F.col("field") == "task", F.col("value")), "work": F.when((F.col("field") == "task") & (F.col("value") != ""), F.col("value")),
    }
    last = [F.max(F.when(v.isNotNull(), F.struct("seq", v.alias("value")))).alias(k) for k, v in effects.items()]
    own = edits.where("row_no is not null").groupBy(F.col("row_no").alias("_row")).agg(*last)
    every = edits.where("row_no is null").agg(*last)  # one row
    own = own.select("_row", F.struct(*effects).alias("_own"))
    placed = rows.join(own, F.col("row_no") == F.col("_row"), "left").crossJoin(F.broadcast(every.select(F.struct(*effects).alias("_every"))))
    final = {k: F.greatest(F.col(f"_own.{k}"), F.col(f"_every.{k}"))["value"] for k in effects}
    placed = placed.withColumn("_task", final["work"])
    worked = with_work_type(placed, tasks, text)
    columns = {PLATFORM: "platform", TAX: "tax", TASK: "task"}
    new = {c: F.coalesce(final[k], F.col(c)) for c, k in columns.items() if c in rows.columns}
    if WORK in rows.columns:
        new[WORK] = F.coalesce("_work", WORK)
    return worked.withColumns(new).select(*rows.columns)
