"""From what a batch says about its client to a client id: best match, candidates, manual choice.

Clients have ``id, pos, full_name, short_name, tax_id``. All joins have keys but
the containment of names, which runs once per distinct name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.functions import constants as C
from tabulant.functions.scalars import js_trim
from tabulant.operators.reference_data import fill_if_empty, label_values, lookup_name_all, lookup_tax_id

_LIST = "array<struct<id:string,label:string,match_type:string>>"


def _or_empty(x: str) -> Column:
    return F.coalesce(F.col(x), F.lit(""))


def reverse_lookup(rows: DataFrame, clients: DataFrame) -> DataFrame:
    """Adds ``client_id``, the first client with the row's full name, short name or tax id.

    Empty and null values are equal to each other, so a row without a tax id
    finds the first client without one. Three keyed joins on the first client of
    each value take the place of one join on either of three conditions.
    """
    out, firsts = rows, []
    for i, c in enumerate(("full_name", "short_name", "tax_id")):
        own = clients.groupBy(_or_empty(c).alias(f"_k{i}")).agg(F.min(F.struct("pos", "id")).alias(f"_f{i}"))
        out = out.withColumn(f"_k{i}", _or_empty(c)).join(own, f"_k{i}", "left").drop(f"_k{i}")
        firsts.append(f"_f{i}")
    return out.withColumn("client_id", F.least(*firsts)["id"]).drop(*firsts)


def _resolved(clients: DataFrame) -> DataFrame:
    """Clients with ``client_id``, to which a match of the client leads back, and ``name``, by which it is shown."""
    return reverse_lookup(clients, clients).withColumn("name", F.coalesce(F.nullif("short_name", F.lit("")), F.col("full_name"), F.lit("")))


def _label(found: str) -> Column:
    return F.concat(found, F.lit(" - "), "name")


def _named(batches: DataFrame, clients: DataFrame) -> DataFrame:
    """client_name, hits: all clients of each distinct name, exact ones first."""
    names = batches.select("client_name").where(js_trim("client_name") != "").distinct()
    hits = lookup_name_all(names, "client_name", clients)
    kind = F.get(F.array(*map(F.lit, C.NAME_MATCHES)), F.col("match_rank") - 1)
    one = F.struct("match_rank", "pos", F.col("id").alias("id"), _label("id").alias("label"), kind.alias("match_type"), "client_id")
    return hits.groupBy("client_name").agg(F.array_sort(F.collect_list(one)).alias("hits"))  # at most one entry per client


def _shown(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(h["id"].alias("id"), h["label"].alias("label"), h["match_type"].alias("match_type"))).cast(_LIST)


def _rows_with_hits(batches: DataFrame, clients: DataFrame, tax_hit: Column) -> DataFrame:
    """The batches' columns in one struct ``_b``, so that none can clash, with ``_name``, ``_tax_hit`` and ``hits``."""
    own = _resolved(clients)
    rows = batches.select(F.struct(*batches.columns).alias("_b"), js_trim("tax_id").alias("_by_tax"), F.col("client_name").alias("_name"))
    rows = lookup_tax_id(rows, "_by_tax", own.select("pos", "tax_id", tax_hit.alias("_tax_hit"))).drop("pos")
    return rows.join(_named(batches, own).withColumnRenamed("client_name", "_name"), "_name", "left")


def best_client(batches: DataFrame, clients: DataFrame) -> DataFrame:
    """Adds ``client_id``, ``matched_by`` (id, tax, name or null) and ``candidates``.

    A batch has ``mapped_id, client_name, tax_id``, null or empty where it says
    nothing. A known id wins, then the tax id, then a name that only one client
    fits; several such clients are candidates and none is chosen. Columns of
    these three names in the input are replaced, others stay as they are.
    """
    known = clients.select(js_trim("id").alias("_id")).distinct().withColumn("_known", F.lit(True))
    rows = _rows_with_hits(batches, clients, F.col("client_id")).withColumn("_id", js_trim("_b.mapped_id")).join(known, "_id", "left")
    by = F.when(F.col("_known"), "id").when(F.col("_tax_hit").isNotNull(), "tax").when(F.size("hits") == 1, "name")
    chosen = F.when(by == "id", F.col("_id")).when(by == "tax", F.col("_tax_hit")).when(by == "name", F.get("hits", F.lit(0))["client_id"])
    several = F.when(by.isNull() & (F.size("hits") > 1), _shown(F.col("hits"))).otherwise(F.array().cast(_LIST))
    return rows.select(*_kept(batches, "client_id", "matched_by", "candidates"), chosen.alias("client_id"), by.alias("matched_by"), several.alias("candidates"))


def client_candidates(batches: DataFrame, clients: DataFrame) -> DataFrame:
    """Adds ``candidates`` for a choice by hand: the client of the tax id alone, else all that the name fits."""
    hit = F.array(F.struct(F.col("client_id").alias("id"), _label("client_id").alias("label"), F.lit(C.TAX_MATCH).alias("match_type"))).cast(_LIST)
    rows = _rows_with_hits(batches, clients, hit)
    return rows.select(*_kept(batches, "candidates"), F.coalesce("_tax_hit", _shown(F.col("hits")), F.array().cast(_LIST)).alias("candidates"))


def _kept(batches: DataFrame, *replaced: str) -> list[Column]:
    return [F.col(f"_b.`{c}`").alias(c) for c in batches.columns if c not in replaced]


def client_info(grids: DataFrame, mapped: DataFrame) -> DataFrame:
    """J9 for a batch of sources: one row (client_name, tax_id).

    ``grids`` are the sources' raw rows (source_pos, row_idx, cells), ``mapped``
    has (source_pos, client_name, tax_id): what stands in the columns of these
    types in each source's first data row. What a label in the cells says, by
    source, row and column, beats a mapped column; of these the first source that
    has a value counts. Empty where nothing says it.
    """
    def said(label: str, column: str) -> DataFrame:
        found = label_values(grids.withColumn("source_id", F.col("source_pos").cast("string")), label)
        detected = found.agg(F.min_by("value", F.col("source_id").cast("long")).alias("_d"))
        first = mapped.agg(F.min_by(js_trim(column), F.when(js_trim(column) != "", F.col("source_pos"))).alias("_m"))
        return detected.crossJoin(first).select(F.coalesce("_d", "_m", F.lit("")).alias(column))  # one row each

    return said(C.CLIENT_LABEL, "client_name").crossJoin(said(C.TAX_LABEL, "tax_id"))


def first_mapped(data: DataFrame, positions: DataFrame) -> DataFrame:
    """What ``client_info`` takes as ``mapped``: data rows (source_pos, row_idx, cells) and (source_pos, client_col, tax_col), null where not mapped."""
    head = data.groupBy("source_pos").agg(F.min_by("cells", "row_idx").alias("c")).join(positions, "source_pos")
    at = lambda col: F.when(F.col(col).isNotNull(), F.get("c", F.col(col)))
    return head.select("source_pos", at("client_col").alias("client_name"), at("tax_col").alias("tax_id"))


def task_content(tasks: Column, name: Column) -> Column:
    """The content of the first task of that trimmed name; empty without one."""
    found = F.get(F.filter(tasks, lambda t: js_trim(t["name"]) == js_trim(name)), F.lit(0))
    return F.when(name != "", F.coalesce(js_trim(found["content"]), F.lit(""))).otherwise(F.lit(""))


def manual_client(rows: DataFrame, unmatched: str, id_col: str, client_id: str, values: dict[str, Column]) -> DataFrame:
    """On unmatched rows the id is overwritten and other columns are filled where empty; none stays unmatched."""
    chosen = F.coalesce(F.col(unmatched), F.lit(False))
    new = {id_col: F.when(chosen, F.lit(client_id)).otherwise(F.col(id_col))}
    new |= {c: F.when(chosen, fill_if_empty(F.col(c), v)).otherwise(F.col(c)) for c, v in values.items()}
    return rows.withColumns(new).withColumn(unmatched, F.lit(False))


def match_statistic(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows with a client id, and all rows."""
    return rows.agg(F.count_if(js_trim(id_col) != "").alias("matched"), F.count(F.lit(1)).alias("total"))


def reference_status(clients: DataFrame) -> DataFrame:
    """The number of clients and of their tasks."""
    return clients.agg(F.count(F.lit(1)).alias("clients"), F.coalesce(F.sum(F.greatest(F.size("tasks"), F.lit(0))), F.lit(0)).alias("tasks"))
