"""The stored reference document: loading with defaults and migrations, tables, import and saving.

A document is JSON text. It is read with an explicit schema and not as VARIANT,
since a variant sorts the keys of an object and the order of clients and of
mappings decides between equal matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.functions.scalars import number_prefix
from tabulant.operators.reference_io import import_clients, merge_config, merge_tasks

VERSION = 1
SCHEMA = (
    "shangSheMap map<string, struct<id string, shortName string, fullName string, taxId string, feeRate string, signEntity string, tasks array<struct<name string, content string>>>>, "
    "configData struct<taxSources array<string>, platforms array<string>, signEntityMapping map<string, array<string>>, platformTaxSourceMapping map<string, string>>, "
    "taskListData array<string>, lastUpdated string, schemaVersion int"
)
Migration = Callable[[Column], Column]


def to_version_1(doc: Column) -> Column:
    """Documents from before versions: missing lists are empty."""
    none = F.array().cast("array<string>")
    config = doc["configData"]
    lists = config.withField("taxSources", F.coalesce(config["taxSources"], none)).withField("platforms", F.coalesce(config["platforms"], none))
    empty = F.from_json(F.lit('{"taxSources": [], "platforms": []}'), "taxSources array<string>, platforms array<string>, signEntityMapping map<string, array<string>>, platformTaxSourceMapping map<string, string>")
    return doc.withField("configData", F.when(config.isNull(), empty).otherwise(lists)).withField("taskListData", F.coalesce(doc["taskListData"], none))


#: MIGRATIONS[k] takes a document of version k to version k + 1.
MIGRATIONS: tuple[Migration, ...] = (to_version_1,)


def load_documents(docs: DataFrame, id_col: str = "doc", text_col: str = "value", schema: str = SCHEMA, migrations: tuple[Migration, ...] = MIGRATIONS) -> DataFrame:
    """(doc, valid, stored_version, document): each document brought to the newest version, one step after the other.

    Text that is no JSON, or has no clients, gives the empty document and is not
    ``valid``. A missing version is 0. A document of a newer version stays as it is.
    """
    parsed = F.from_json(F.col(text_col), schema)
    rows = docs.select(F.col(id_col).alias("doc"), parsed.alias("_p"))
    valid = F.col("_p.shangSheMap").isNotNull()
    empty = F.from_json(F.lit('{"shangSheMap": {}}'), schema)
    rows = rows.select("doc", valid.alias("valid"), F.when(valid, F.coalesce("_p.schemaVersion", F.lit(0))).alias("stored_version"), F.when(valid, F.col("_p")).otherwise(empty).alias("document"))
    for k, migrate in enumerate(migrations):
        now = F.col("document")
        old = F.coalesce("stored_version", F.lit(0)) <= k
        rows = rows.withColumn("document", F.when(old, migrate(now).withField("schemaVersion", F.lit(k + 1))).otherwise(now))
    return rows


def _in_order(entries: Column, key: Callable[[Column], Column]) -> Column:
    """Entries of an object as its own language lists them: whole numbers ascending, then the others as written."""
    number = lambda e: F.when(F.rlike(key(e), F.lit(r"^(0|[1-9][0-9]{0,9})\z")) & (key(e).try_cast("long") < 4294967295), key(e).try_cast("long"))
    placed = F.transform(entries, lambda e, i: F.struct(F.when(number(e).isNotNull(), 0).otherwise(1).alias("late"), F.coalesce(number(e), i.cast("long")).alias("at"), e.alias("e")))
    return F.transform(F.array_sort(placed, lambda a, b: F.when((a["late"] < b["late"]) | ((a["late"] == b["late"]) & (a["at"] < b["at"])), -1).otherwise(1)), lambda p: p["e"])


def clients_of(docs: DataFrame) -> DataFrame:
    """(doc, pos, id, full_name, short_name, tax_id, fee_rate, sign_entity, tasks) of loaded documents; the key is the id."""
    entries = _in_order(F.map_entries("document.shangSheMap"), lambda e: e["key"])
    rows = docs.select("doc", F.posexplode(entries).alias("pos", "e"))
    v = lambda name: F.col(f"e.value.{name}")
    tasks = F.coalesce(v("tasks"), F.array().cast("array<struct<name:string,content:string>>"))
    return rows.select("doc", F.col("pos").cast("long").alias("pos"), F.col("e.key").alias("id"), v("fullName").alias("full_name"), v("shortName").alias("short_name"), v("taxId").alias("tax_id"), number_prefix(v("feeRate")).alias("fee_rate"), v("signEntity").alias("sign_entity"), tasks.alias("tasks"))


def config_of(docs: DataFrame) -> DataFrame:
    """(doc, kind, key, value, pos) of loaded documents, in the form of ``reference_io``."""
    c = "document.configData"
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    kinds = {
        "tax_source": F.transform(f"{c}.taxSources", lambda x: entry(x, F.array(x))),
        "platform": F.transform(f"{c}.platforms", lambda x: entry(x, F.array(x))),
        "sign_entity": _in_order(F.transform(F.map_entries(f"{c}.signEntityMapping"), lambda e: entry(e["key"], e["value"])), lambda e: e["key"]),
        "platform_tax": _in_order(F.transform(F.map_entries(f"{c}.platformTaxSourceMapping"), lambda e: entry(e["key"], F.array(e["value"]))), lambda e: e["key"]),
    }
    all_kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("entries")) for k, v in kinds.items()])
    rows = docs.select("doc", F.inline(all_kinds)).select("doc", "kind", F.posexplode("entries").alias("pos", "e"))
    return rows.select("doc", "kind", "e.key", "e.value", F.col("pos").cast("long").alias("pos"))


def tasks_of(docs: DataFrame) -> DataFrame:
    """(doc, pos, entry) of loaded documents."""
    return docs.select("doc", F.posexplode("document.taskListData").alias("pos", "entry")).withColumn("pos", F.col("pos").cast("long"))


def import_document(clients: DataFrame, config: DataFrame, tasks: DataFrame, loaded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after one document's import: clients replaced whole, lists united, mappings and tasks overwritten by key.

    ``loaded`` is a valid document of ``load_documents``; an invalid one changes nothing.
    """
    good = loaded.where("valid")
    new = clients_of(good).drop("doc"), config_of(good).drop("doc"), tasks_of(good).drop("doc")
    return import_clients(clients, new[0]), merge_config(config, new[1]), merge_tasks(tasks, new[2])


def documents_of(clients: DataFrame, config: DataFrame, tasks: DataFrame) -> DataFrame:
    """K9: (doc, value): the tables of each document as JSON that ``load_documents`` reads. A document is one value, as long as it is."""
    in_order = lambda fields: F.array_sort(F.collect_list(F.struct("pos", *fields)))
    client = F.struct("id", F.col("short_name").alias("shortName"), F.col("full_name").alias("fullName"), F.col("tax_id").alias("taxId"), F.col("fee_rate").alias("feeRate"), F.col("sign_entity").alias("signEntity"), "tasks")
    people = clients.groupBy("doc").agg(F.map_from_entries(F.transform(in_order(["id", client.alias("c")]), lambda r: F.struct(r["id"], r["c"]))).alias("shangSheMap"))
    listed = lambda kind: F.transform(F.filter("all", lambda r: r["kind"] == kind), lambda r: r["key"])
    mapped = lambda kind, value: F.map_from_entries(F.transform(F.filter("all", lambda r: r["kind"] == kind), lambda r: F.struct(r["key"], value(r))))
    kept = config.groupBy("doc").agg(in_order(["kind", "key", "value"]).alias("all"))
    lists = F.struct(listed("tax_source").alias("taxSources"), listed("platform").alias("platforms"), mapped("sign_entity", lambda r: r["value"]).alias("signEntityMapping"), mapped("platform_tax", lambda r: F.get(r["value"], F.lit(0))).alias("platformTaxSourceMapping"))
    todo = tasks.groupBy("doc").agg(F.transform(in_order(["entry"]), lambda r: r["entry"]).alias("taskListData"))
    whole = people.join(kept.select("doc", lists.alias("configData")), "doc", "left").join(todo, "doc", "left")
    return whole.select("doc", F.to_json(F.struct("shangSheMap", "configData", F.coalesce("taskListData", F.array().cast("array<string>")).alias("taskListData"), F.lit(VERSION).alias("schemaVersion"))).alias("value"))
