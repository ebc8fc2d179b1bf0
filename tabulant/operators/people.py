"""Merging rows of the same person, splitting rows with several amounts, and reconciling totals.

All of these take (source_id, row_idx, cells). Merging shuffles once, by
(source, key); the key of a row never spans sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tabulant.functions.scalars import decimals_of, declared_amount, js_round2, js_trim, merge_amount, split_amount, textual_difference, tolerance, validation_amount, without_space


def merge_key(cells: Column, id_col: int | None, name_col: int | None, phone_col: int | None) -> Column:
    """A1: the id, else name and phone, else null."""
    at = lambda c: without_space(F.get(cells, F.lit(c))) if c is not None else F.lit("")
    by_id = F.when(at(id_col) != "", F.concat(F.lit("id:"), at(id_col)))
    by_name = F.when((at(name_col) != "") & (at(phone_col) != ""), F.concat(F.lit("np:"), at(name_col), F.lit("|"), at(phone_col)))
    return F.coalesce(by_id, by_name)


def exact_sum(value: Column | str) -> Column:
    """A3 as an aggregate: the exact decimal sum, printed with the most decimals of its inputs; null if none is a number."""
    total = F.sum(merge_amount(value))
    scale = F.max(F.when(merge_amount(value).isNotNull(), decimals_of(value)))
    text = total.cast("string")
    return F.when(total.isNotNull(), F.when(scale == 0, F.substring_index(text, ".", 1)).otherwise(F.substring(text, F.lit(1), F.instr(text, ".") + scale)))


def first_filled(value: Column, order: Column) -> Column:
    """A4 as an aggregate: the first value that is not blank."""
    return F.min_by(value, F.when(without_space(value) != "", order))


def distinct_in_order(value: Column, order: Column) -> Column:
    """A5 as an aggregate: distinct values (white space apart) as first written, in order."""
    rows = F.array_sort(F.collect_list(F.when(js_trim(value) != "", F.struct(order.alias("o"), js_trim(value).alias("v"), without_space(value).alias("k")))))
    firsts = F.filter(rows, lambda r, i: F.forall(F.slice(rows, 1, i), lambda x: x["k"] != r["k"]))
    return F.transform(firsts, lambda r: r["v"])


def merge_people(
    rows: DataFrame, types: dict[str, int], amount_cols: list[int], labels: dict[int, str] | None = None, merge: bool = False, watch: dict[str, Observation] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows after merging, groups: source_id, key, name, members, conflicts array<int>).

    A group of rows with one key becomes its first row, unless a typed column
    other than amounts, totals and notes has two different values: then the
    whole group stays. ``merge=False`` only reports (the product's default).
    A person's rows in one source are few; their cells are gathered by key.
    ``watch`` (rows, groups) observes counts on the way (see ``dry_run``).
    """
    if types.get("idCard") is None and types.get("name") is None:
        none = rows.select("source_id", F.lit("").alias("key"), F.lit("").alias("name"), F.lit(0).cast("long").alias("members"), F.array().cast("array<int>").alias("conflicts")).limit(0)
        return rows, none
    elements = sorted({c for t, c in types.items() if c is not None and t not in ("amount", "amountTotal", "note")})
    amounts, note = sorted(set(amount_cols)), types.get("note")
    keyed = rows.withColumn("key", merge_key(F.col("cells"), types.get("idCard"), types.get("name"), types.get("phone")))
    if watch and merge:
        keyed = keyed.observe(watch["rows"], F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("key").isNull()).alias("without_key"))
    grouped = keyed.where("key is not null").groupBy("source_id", "key").agg(
        F.min("row_idx").alias("first_row"),
        F.count(F.lit(1)).alias("members"),
        F.max(F.size("cells")).alias("width"),
        F.min_by("cells", "row_idx").alias("first"),
        *[F.size(F.collect_set(F.when(without_space(F.get("cells", F.lit(c))) != "", without_space(F.get("cells", F.lit(c)))))).alias(f"d{c}") for c in elements],
        *[first_filled(F.get("cells", F.lit(c)), F.col("row_idx")).alias(f"e{c}") for c in elements],
        *[exact_sum(F.get("cells", F.lit(c))).alias(f"s{c}") for c in amounts],
        F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))), lambda r: r["cells"]).alias("all"),
    )
    conflicts = F.filter(F.array(*[F.when(F.col(f"d{c}") > 1, F.lit(c)) for c in elements]).cast("array<int>"), lambda x: x.isNotNull())
    several = grouped.where("members > 1").withColumn("conflicts", conflicts)
    if watch and merge:
        several = several.observe(watch["groups"], F.count(F.lit(1)).alias("groups"), F.count_if(F.size("conflicts") > 0).alias("conflicting"))
    name = F.when(js_trim(F.get("first", F.lit(types.get("name") if types.get("name") is not None else -1))) != "", js_trim(F.get("first", F.lit(types.get("name") or 0)))) if types.get("name") is not None else F.lit(None)
    groups = several.select("source_id", "key", F.coalesce(name, F.regexp_replace("key", "^(id|np):", "")).alias("name"), "members", "conflicts")
    if not merge:
        return rows, groups
    label = F.create_map(*[x for c, t in (labels or {}).items() for x in (F.lit(c), F.lit(t))]) if labels else None

    def value(i: Column) -> Column:
        out = F.coalesce(F.get("first", i), F.lit(""))
        for c in elements:
            out = F.when(i == c, F.coalesce(F.col(f"e{c}"), out)).otherwise(out)
        for c in amounts:
            out = F.when(i == c, F.coalesce(F.col(f"s{c}"), out)).otherwise(out)
        return out

    def different(i: Column) -> Column:
        seen = F.filter(F.transform(F.col("all"), lambda r: js_trim(F.get(r, i))), lambda v: v != "")
        firsts = F.filter(seen, lambda v, k: F.forall(F.slice(seen, 1, k), lambda x: without_space(x) != without_space(v)))
        textual = F.exists(firsts, lambda a: F.exists(firsts, lambda b: (a != b) & textual_difference(a, b)))
        named = F.coalesce(F.element_at(label, i), F.concat(F.lit("第 "), (i + 1).cast("string"), F.lit(" 列"))) if label is not None else F.concat(F.lit("第 "), (i + 1).cast("string"), F.lit(" 列"))
        return F.when((F.size(firsts) > 1) & textual, F.concat(named, F.lit("："), F.array_join(firsts, "、")))

    fixed = F.array(*[F.lit(c) for c in [*elements, *amounts, *([note] if note is not None else [])]])
    cells = F.transform(F.sequence(F.lit(0), F.col("width") - 1), value)
    if note is not None:
        others = F.filter(F.transform(F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda i: ~F.array_contains(fixed, i)), different), lambda x: x.isNotNull())
        text = F.array_join(F.filter(F.concat(F.array(js_trim(F.get("first", F.lit(note)))), others), lambda x: x != ""), "；")
        cells = F.transform(cells, lambda v, i: F.when((i == note) & (F.size(others) > 0), text).otherwise(v))
    merged = several.where(F.size("conflicts") == 0).select("source_id", "key", F.col("first_row").alias("row_idx"), cells.alias("cells"))
    stay = keyed.join(merged.select("source_id", "key"), ["source_id", "key"], "left_anti").select("source_id", "row_idx", "cells")
    return stay.unionByName(merged.select("source_id", "row_idx", "cells")), groups


def split_amounts(rows: DataFrame, amount_cols: list[int], total_col: int | None = None, note_col: int | None = None, labels: dict[int, str] | None = None, label_note: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one row per non-zero amount, with split_idx; mismatches: source_id, row_idx, sum, declared).

    The amount is copied as written to the leftmost amount column and the others
    are blanked; rows without any amount stay once. Without two amount columns
    the rows are returned as they are. A missing note column is appended when
    notes are labelled.
    """
    cols = sorted(amount_cols)
    none = rows.select("source_id", "row_idx", F.lit(0.0).alias("sum"), F.lit(0.0).alias("declared")).limit(0)
    if len(cols) < 2:
        return rows.withColumn("split_idx", F.lit(0)), none
    at = lambda c: F.get("cells", F.lit(c))
    names = labels or {}
    parts = F.filter(
        F.array(*[F.struct(F.lit(i).alias("split_idx"), at(c).alias("raw"), F.lit(names.get(c, f"第 {c + 1} 列")).alias("label"), split_amount(at(c)).alias("v")) for i, c in enumerate(cols)]),
        lambda p: p["v"].isNotNull(),
    )
    # Rows are as wide as their source's widest, and one wider where a note column is appended.
    appended = label_note and note_col is None
    width = rows.groupBy("source_id").agg(F.max(F.size("cells")).alias("_w"))
    source = rows.join(width, "source_id")
    padded = F.concat(F.transform(F.col("cells"), lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), F.col("_w") + int(appended) - F.size("cells")))
    note = "_w" if appended else note_col
    wide = source.withColumn("cells_out", padded).withColumn("p", F.explode_outer(parts))
    others = F.array(*[F.lit(c) for c in cols[1:]])

    def cell(v: Column, i: Column) -> Column:
        out = F.when(i == cols[0], F.col("p.raw")).when(F.array_contains(others, i), F.lit("")).otherwise(v)
        if label_note and note is not None:
            place = F.col(note) if isinstance(note, str) else F.lit(note)
            out = F.when(i == place, F.array_join(F.filter(F.array(js_trim(v), F.col("p.label")), lambda x: x != ""), "；")).otherwise(out)
        return F.when(F.col("p").isNull(), v).otherwise(out)

    out = wide.select("source_id", "row_idx", F.coalesce("p.split_idx", F.lit(0)).alias("split_idx"), F.transform("cells_out", cell).alias("cells"))
    if total_col is None:
        return out, none
    return out, row_mismatches(rows, cols, total_col)


def row_mismatches(rows: DataFrame, amount_cols: list[int], total_col: int) -> DataFrame:
    """Rows whose amounts don't make up their declared total."""
    at = lambda c: F.get("cells", F.lit(c))
    total = sum((F.coalesce(split_amount(at(c)), F.lit(0.0)) for c in amount_cols), F.lit(0.0))
    checked = rows.select("source_id", "row_idx", total.alias("sum"), declared_amount(at(total_col)).alias("declared"))
    return checked.where(F.abs(F.col("sum") - F.col("declared")) > tolerance(F.col("declared"))).select("source_id", "row_idx", js_round2(F.col("sum")).alias("sum"), js_round2(F.col("declared")).alias("declared"))


def column_totals(data: DataFrame, totals: DataFrame, cols: list[int]) -> DataFrame:
    """(source_id, col_idx, declared, sum, ok): the last total row against the sum of the data rows."""
    declared = totals.groupBy("source_id").agg(F.max_by("cells", "row_idx").alias("t"))
    sums = data.groupBy("source_id").agg(*[F.sum(F.coalesce(validation_amount(F.get("cells", F.lit(c))), F.lit(0.0))).alias(f"s{c}") for c in cols])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col_idx"), validation_amount(F.get("t", F.lit(c))).alias("declared"), F.col(f"s{c}").alias("sum")) for c in cols]))
    out = declared.join(sums, "source_id").select("source_id", pairs.alias("x")).select("source_id", "x.*").where("declared is not null")
    return out.withColumn("ok", F.abs(F.col("sum") - F.col("declared")) <= tolerance(F.col("declared")))


def row_clusters(points: DataFrame, partition: list[str], order: str, gap: float) -> DataFrame:
    """Gaps and islands along ``order``."""
    w = Window.partitionBy(*partition).orderBy(order)
    new = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return points.withColumn("cluster", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): per key the upper of the two middle values; nulls do not count.

    Values are counted first, so a key's window runs over its distinct values
    and their counts, and no key's values are gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    up_to = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_to", up_to).withColumn("_all", F.sum("_n").over(w))
    return placed.where("2 * _to > _all").groupBy(*keys).agg(F.min(value).alias("median"))
