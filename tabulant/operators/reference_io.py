"""Imports into the reference data: configuration sheets and patches, task lists, whole clients.

Configuration is one table ``kind, key, value array<string>, pos`` with kinds
tax_source and platform (lists: the value repeats the key), sign_entity (keywords)
and platform_tax (one tax source). A patch is a table of the same form; what it
does not name stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.functions.scalars import js_trim, number_prefix


def split_keywords(x: Column) -> Column:
    """The trimmed parts between half- or full-width commas; empty ones dropped."""
    return F.filter(F.transform(F.split(x, "[,，]"), js_trim), lambda w: w != "")


def _latest(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key: the last one's fields at the first one's place."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "pos").alias("_v"), F.min("pos").alias("pos"))


def merge_keyed(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of both by key, with ``pos`` and ``added``: a new row replaces an old one whole and takes its place; new keys follow.

    ``pos`` of new keys goes on after the greatest of the old table, one number.
    """
    offset = old.agg(F.max("pos")).first()[0]
    a = _latest(old, keys, fields).select(*keys, F.col("_v").alias("_o"), F.col("pos").alias("_p"))
    b = _latest(new, keys, fields).select(*keys, F.col("_v").alias("_n"), F.col("pos").alias("_q"))
    pos = F.coalesce(F.col("_p"), F.col("_q") + F.lit(0 if offset is None else offset + 1))
    merged = a.join(b, keys, "full_outer").withColumn("_v", F.coalesce("_n", "_o"))
    return merged.select(*keys, *[F.col(f"_v.{f}").alias(f) for f in fields], pos.cast("long").alias("pos"), F.col("_p").isNull().alias("added"))


def merge_config(old: DataFrame, patch: DataFrame) -> DataFrame:
    """Lists are united and mappings overwritten by key; absent kinds and keys are unchanged."""
    return merge_keyed(old, patch, ["kind", "key"], ["value"])


def task_key(entry: Column) -> Column:
    """Client id and task name of a task list entry; the entry itself where it has another form."""
    return F.regexp_replace(entry, r"^[0-9]+\.(.+)\((.+)\)\z", "$2|$1")


def merge_tasks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Task list entries (pos, entry) by client and task name."""
    keyed = lambda t: t.withColumn("key", task_key(F.col("entry")))
    return merge_keyed(keyed(old), keyed(new), ["key"], ["entry"])


def import_clients(old: DataFrame, new: DataFrame) -> DataFrame:
    """Clients by id; an imported one replaces the old one whole. Columns one side lacks are null there."""
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in ("id", "pos")]
    kinds = {f: (new if f in new.columns else old).schema[f].dataType for f in fields}
    full = lambda t: t.select("id", "pos", *[(F.col(f) if f in t.columns else F.lit(None).cast(kinds[f])).alias(f) for f in fields])
    return merge_keyed(full(old), full(new), ["id"], fields)


def upsert_clients(old: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clients after the rows of a client sheet, counts: new_rows, updated_rows).

    ``old`` has (id, pos, short_name, full_name, tax_id, fee_rate, sign_entity,
    tasks); ``rows`` has (row_idx, id and those fields as text, task_name,
    task_content). Rows are taken in order, those without an id not at all: a
    later value that is not empty replaces an earlier one, a fee that is no number
    is 0, and a task is added unless the client has one of that name and content.
    New clients follow the old ones by their first row. A client's first row
    counts as new if it was not there before, every other row as an update.
    """
    texts = ["short_name", "full_name", "tax_id", "sign_entity"]
    given = rows.select("row_idx", js_trim("id").alias("id"), *[js_trim(c).alias(c) for c in (*texts, "fee_rate", "task_name", "task_content")]).where("id <> ''")
    latest = [F.max_by(c, F.when(F.col(c) != "", F.col("row_idx"))).alias(f"_{c}") for c in (*texts, "fee_rate")]
    new = given.groupBy("id").agg(*latest, F.min("row_idx").alias("_row"), F.count(F.lit(1)).alias("_n"))
    task = F.struct(F.col("task_name").alias("name"), F.col("task_content").alias("content"))
    had = old.select("id", F.posexplode("tasks").alias("_at", "_t")).select("id", F.lit(0).alias("late"), F.col("_at").cast("long").alias("at"), F.struct(F.col("_t.name").alias("name"), F.coalesce("_t.content", F.lit("")).alias("content")).alias("task"))
    added = given.where("task_name <> ''").select("id", F.lit(1).alias("late"), F.col("row_idx").cast("long").alias("at"), task.alias("task"))
    # tasks that a client had are kept as they are, also repeated ones; each new one comes once
    key = F.when(F.col("late") == 0, F.col("at"))
    every = had.unionByName(added.join(had.select("id", "task"), ["id", "task"], "left_anti")).groupBy("id", "task", key.alias("_had")).agg(F.min(F.struct("late", "at")).alias("place"))
    tasks = every.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "task"))), lambda x: x["task"]).alias("_tasks"))
    last = old.agg(F.max("pos")).first()[0]
    offset = F.lit(-1 if last is None else last)
    both = old.withColumn("_old", F.lit(True)).join(new, "id", "full_outer").join(tasks, "id", "left")
    fee = F.coalesce(number_prefix("_fee_rate"), F.lit(0.0))
    isnew = F.col("_old").isNull()
    merged = both.select(
        "id", F.when(isnew, offset + 1 + F.col("_row")).otherwise(F.col("pos")).cast("long").alias("pos"),
        *[F.coalesce(f"_{c}", F.when(~isnew, F.col(c)).otherwise("")).alias(c) for c in texts],
        F.when(F.col("_fee_rate").isNotNull(), fee).when(isnew, 0.0).otherwise(F.col("fee_rate")).alias("fee_rate"), F.coalesce("_tasks", F.array().cast("array<struct<name:string,content:string>>")).alias("tasks"), isnew.alias("added"),
    )
    counted = new.join(old.select("id", F.lit(1).alias("_old")).distinct(), "id", "left")
    counts = counted.agg(F.count_if(F.col("_old").isNull()).alias("new_rows"), F.coalesce(F.sum(F.col("_n") - F.when(F.col("_old").isNull(), 1).otherwise(0)), F.lit(0)).alias("updated_rows"))
    return merged, counts


def config_sheet(grid: DataFrame) -> DataFrame:
    """The patch in a configuration sheet (source_id, row_idx, cells; row 0 is the header).

    The first two columns list tax sources and platforms. Columns whose header
    names the signing entity or the platform's tax source, the last of each,
    hold key→value cells.
    """
    last = lambda word: F.array_max(F.transform("cells", lambda c, i: F.when(F.contains(c, F.lit(word)), i)))
    head = grid.where("row_idx = 0").select("source_id", last("签约主体").alias("_entity"), last("平台税源地").alias("_tax"))
    rows = grid.where("row_idx > 0").join(head, "source_id")
    cell = lambda i: F.coalesce(js_trim(F.get("cells", i)), F.lit(""))
    side = lambda i, k: js_trim(F.get(F.split(cell(i), "→"), F.lit(k)))

    def part(kind: str, key: Column, value: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"), F.col("row_idx").alias("pos"))

    entity, tax = F.col("_entity"), F.col("_tax")
    lists = part("tax_source", cell(F.lit(0)), F.array(cell(F.lit(0)))).unionByName(part("platform", cell(F.lit(1)), F.array(cell(F.lit(1)))))
    maps = part("sign_entity", side(entity, 0), F.when(side(entity, 1) != "", split_keywords(side(entity, 1)))).unionByName(part("platform_tax", side(tax, 0), F.when(side(tax, 1) != "", F.array(side(tax, 1)))))
    found = lists.unionByName(maps).where("key <> '' and value is not null")
    return _latest(found, ["kind", "key"], ["value"]).select("kind", "key", "_v.value", "pos")


def mapping_sheet(grid: DataFrame, kind: str) -> DataFrame:
    """The patch in a two-column sheet of kind sign_entity (entity, keywords) or platform_tax (keyword, tax source)."""
    cell = lambda i: F.coalesce(js_trim(F.get("cells", F.lit(i))), F.lit(""))
    value = split_keywords(cell(1)) if kind == "sign_entity" else F.array(cell(1))
    found = grid.where("row_idx > 0").where((cell(0) != "") & (cell(1) != "")).select(F.lit(kind).alias("kind"), cell(0).alias("key"), value.alias("value"), F.col("row_idx").alias("pos"))
    return _latest(found, ["kind", "key"], ["value"]).select("kind", "key", "_v.value", "pos")
