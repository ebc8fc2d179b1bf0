"""Payout rows enriched from the client table: platform, tax source, task and work type; rows without a client.

Clients have ``id, pos, full_name, short_name, tax_id, sign_entity, tasks``
(array of name and content). What depends on the client alone is worked out once
per client; a row then takes one keyed join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.functions import constants as C
from tabulant.functions.scalars import js_trim
from tabulant.operators.client_match import task_content
from tabulant.operators.export import Template, fill_constants, project
from tabulant.operators.numbering import numbered, running_before
from tabulant.operators.reference_data import entity_platform, paired_tax, platform_tax
from tabulant.operators.validation import work_type

_TASK = r"^([0-9]+)\.(.+)\((.+)\)\z"
#: The columns of the template that is enriched.
PLATFORM, CLIENT, TASK, TAX, WORK = "平台", "商社编号", "任务清单", "税源地", "工种"


@dataclass(frozen=True)
class Config:
    """What has been uploaded; lists and mappings fall back to the defaults."""

    platforms: tuple[str, ...] = ()
    tax_sources: tuple[str, ...] = ()
    entities: tuple[tuple[str, tuple[str, ...]], ...] = ()
    platform_taxes: tuple[tuple[str, str], ...] = ()

    def platform(self, entity: Column) -> Column:
        """J5 over the uploaded platforms, or the default ones."""
        return entity_platform(F.coalesce(entity, F.lit("")), F.array(*map(F.lit, self.platforms or C.PLATFORMS)), self.entities)

    def tax(self, platform: Column) -> Column:
        """Uploaded lists are paired by position, else keywords decide."""
        if not self.platforms:
            return platform_tax(platform, self.platform_taxes)
        taxes = F.array(*map(F.lit, self.tax_sources)) if self.tax_sources else F.array().cast("array<string>")
        return paired_tax(platform, F.array(*map(F.lit, self.platforms)), taxes, self.platform_taxes)


def parsed_tasks(task_list: DataFrame) -> DataFrame:
    """Entries ``seq.name(id)`` of an uploaded task list (pos, entry) as (id, n, seq, name, full); others are left out."""
    group = lambda i: F.regexp_extract("entry", _TASK, i)
    return task_list.where(F.rlike("entry", F.lit(_TASK))).select(group(3).alias("id"), F.col("pos").cast("long").alias("n"), group(1).cast("long").alias("seq"), group(2).alias("name"), F.col("entry").alias("full"))


def _own_tasks(clients: DataFrame) -> DataFrame:
    """Each client's tasks with the running number over all clients; tasks of one name share the first one's."""
    starts = running_before(clients.select("pos", js_trim("id").alias("id"), "tasks"), ["pos"], F.greatest(F.size("tasks"), F.lit(0)), "_first")
    names = F.transform("tasks", lambda t: F.coalesce(t["name"], F.lit("")))
    rows = starts.select("id", "_first", names.alias("_names"), F.posexplode("tasks").alias("n", "_t"))
    name = F.coalesce("_t.name", F.lit(""))
    seq = F.col("_first") + F.array_position("_names", name)
    return rows.select("id", F.col("n").cast("long").alias("n"), seq.alias("seq"), name.alias("name"), F.coalesce("_t.content", F.lit("")).alias("content"), _full(seq, name))


def _full(seq: Column, name: Column) -> Column:
    return F.concat(seq.cast("string"), F.lit("."), name, F.lit("("), "id", F.lit(")")).alias("full")


def tasks_of_clients(clients: DataFrame, task_list: DataFrame | None = None) -> DataFrame:
    """(id, n, seq, name, content, full): a client's entries in the task list, or if it has none its own tasks."""
    own = _own_tasks(clients)
    if task_list is None:
        return own
    listed = parsed_tasks(task_list)
    content = F.coalesce(task_content(F.col("tasks"), F.col("name")), F.lit(""))
    said = listed.join(clients.select(js_trim("id").alias("id"), "tasks"), "id", "left").select("id", "n", "seq", "name", content.alias("content"), "full")
    return said.unionByName(own.join(listed.select("id").distinct(), "id", "left_anti"))


def client_lookup(clients: DataFrame, config: Config = Config(), task_list: DataFrame | None = None) -> DataFrame:
    """(id, lookup): what an id leads to, worked out once per client: platform, tax source, first task, names.

    Where ids repeat, the first client in order counts. Only the first task of a
    client is held, not the list of all.
    """
    first = clients.groupBy(js_trim("id").alias("id")).agg(F.min_by(F.struct("sign_entity", "short_name", "full_name", "tax_id"), "pos").alias("c"), F.min_by("tasks", "pos").alias("tasks"), F.min("pos").alias("pos"))
    first = first.where("id <> ''")
    tasks = tasks_of_clients(first, task_list).groupBy("id").agg(F.min(F.struct("n", "name", "content", "full")).alias("task"))
    platform = config.platform(F.col("c.sign_entity"))
    rows = first.join(tasks, "id", "left").withColumn("platform", platform).withColumn("tax_source", F.when(F.col("platform") != "", config.tax(F.col("platform"))).otherwise(F.lit("")))
    return rows.select("id", F.struct("platform", "tax_source", F.struct("task.name", "task.content", "task.full").alias("task"), F.col("task").isNotNull().alias("has_task"), "c.sign_entity", "c.short_name", "c.full_name", "c.tax_id").alias("lookup"))


@dataclass(frozen=True)
class RowText:
    """Columns of the rows whose text takes part in the choice of a work type."""

    columns: tuple[str, ...] = field(default_factory=tuple)

    def values(self) -> list[Column]:
        return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in self.columns]


def enrich_rows(rows: DataFrame, lookup: DataFrame, config: Config = Config(), text: RowText = RowText()) -> DataFrame:
    """Fills platform, tax source, task and work type where empty; adds ``unmatched``.

    The tax source is that of the row's own platform, filled or not, and only
    then the client's. Rows whose id is empty or unknown stay as they are and are
    ``unmatched``. A column that the rows do not have is not filled. A null cell
    is empty.
    """
    have = set(rows.columns)
    here = lambda c: F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")
    found = rows.withColumn("_lookup_id", js_trim(CLIENT)).join(lookup.select(F.col("id").alias("_lookup_id"), F.col("lookup").alias("_lookup")), "_lookup_id", "left")
    known = F.col("_lookup").isNotNull()
    fill = lambda c, v: F.when(known & (here(c) == ""), F.coalesce(v, F.lit(""))).otherwise(here(c))
    new: dict[str, Column] = {}
    platform = fill(PLATFORM, F.col("_lookup.platform")) if PLATFORM in have else F.lit("")
    if PLATFORM in have:
        new[PLATFORM] = platform
    if TAX in have:
        by_row = F.when(platform != "", F.nullif(config.tax(platform), F.lit("")))
        new[TAX] = fill(TAX, F.coalesce(by_row, F.col("_lookup.tax_source")))
    if TASK in have:
        new[TASK] = fill(TASK, F.col("_lookup.task.full"))
    if WORK in have:
        new[WORK] = fill(WORK, F.when(F.col("_lookup.has_task"), work_type(F.col("_lookup.task.name"), F.col("_lookup.task.content"), *text.values())))
    return found.withColumns(new).withColumn("unmatched", ~known).select(*[c for c in rows.columns if c != "unmatched"], "unmatched")


@dataclass(frozen=True)
class Source:
    """A selected source: its rows (source_id, row_idx, cells) and typed columns."""

    file_name: str
    sheet_name: str
    rows: DataFrame
    types: dict[str, int]


def generate_output(sources: list[Source], template: Template, lookup: DataFrame | None = None, config: Config = Config(), cities: list[str] | None = None) -> DataFrame:
    """The template's rows of all sources, in order, numbered by ``row_no``.

    Sources follow each other as given; besides the headers a row has its file,
    sheet, source and row, ``_cleaned`` (cells that cleaning shortened) and, with
    ``lookup``, ``unmatched``: the numbers of rows without a client are
    ``where("unmatched").select("row_no")`` of the same result.
    """
    parts = []
    for k, s in enumerate(sources):
        note = [F.coalesce(F.get("cells", F.lit(s.types[c])), F.lit("")) if s.types.get(c) is not None else F.lit("") for c in ("note", "clientName")]
        rows = project(s.rows, s.types, template, also={"_note": note[0], "_client": note[1]})
        parts.append(rows.select("*", F.lit(k).alias("_source"), F.lit(s.file_name).alias("_file"), F.lit(s.sheet_name).alias("_sheet")))
    if not parts:
        raise ValueError("no source is selected")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if template.name == "youyi":
        out = fill_constants(out, cities or [])
    out = numbered(out, ["_source", "row_idx"])
    if lookup is not None and CLIENT in template.headers:
        out = enrich_rows(out, lookup, config, RowText(("_note", "_client")))
    return out.drop("_note", "_client")


def set_platform(rows: DataFrame, value: str, selected: Column, config: Config = Config()) -> DataFrame:
    """The platform of the selected rows; the tax source follows if there is one for it. An empty value changes nothing."""
    if not value:
        return rows
    tax = config.tax(F.lit(value))
    return rows.withColumns({PLATFORM: F.when(selected, F.lit(value)).otherwise(F.col(PLATFORM)), TAX: F.when(selected & (tax != ""), tax).otherwise(F.col(TAX))})


def with_work_type(rows: DataFrame, tasks: DataFrame, text: RowText = RowText()) -> DataFrame:
    """Adds ``_work``, the work type that the task in ``_task`` leads to; null where that is null or empty.

    ``tasks`` is what ``tasks_of_clients`` gives. The task is looked for under the
    id that the entry names, or under the row's; an entry that no client has is
    taken by its own name.
    """
    form = r"^[0-9]+\.(.+)\((.+)\)\z"
    named = F.rlike("_task", F.lit(form))
    keyed = rows.withColumn("_task_id", js_trim(F.when(named, F.regexp_extract("_task", form, 2)).otherwise(F.col(CLIENT))))
    one = tasks.groupBy(F.col("id").alias("_task_id"), F.col("full").alias("_task")).agg(F.min(F.struct("n", "name", "content")).alias("_found"))
    found = keyed.join(one, ["_task_id", "_task"], "left")
    name = F.coalesce("_found.name", F.when(named, F.regexp_extract("_task", form, 1)), "_task")
    kind = work_type(name, F.coalesce("_found.content", F.lit("")), *text.values())
    return found.withColumn("_work", F.when(F.coalesce("_task", F.lit("")) != "", kind))


def set_task(rows: DataFrame, value: Column, selected: Column, tasks: DataFrame, text: RowText = RowText()) -> DataFrame:
    """The task of the selected rows, and the work type that goes with it. An empty value empties the task alone."""
    chosen = with_work_type(rows.withColumn("_task", F.when(selected, F.coalesce(value, F.lit("")))), tasks, text)
    return chosen.withColumns({TASK: F.coalesce("_task", TASK), WORK: F.coalesce("_work", WORK)}).select(*rows.columns)


def set_cell(rows: DataFrame, column: str, value: str, selected: Column) -> DataFrame:
    """One value in a column of the selected rows."""
    return rows.withColumn(column, F.when(selected, F.lit(value)).otherwise(F.col(column)))
