"""Workbooks of the target templates and of the reference data, as rows for the workbook sink."""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulant.functions import constants as C
from tabulant.functions.scalars import file_name_part
from tabulant.operators.enrichment import Config
from tabulant.operators.numbering import numbered
from tabulant.sources.workbook_sink import SCHEMA, Layout, WorkbookSink, layouts_option

#: Rows of one file. Its sheets are held by the task that writes it; further rows go to further parts.
PART_ROWS = 20_000
#: Sheets that are repeated in every file are lists kept by hand, at most so long.
MOST_SHARED_ROWS = 50_000

Sheet = tuple[str, list[list[str]]]


@dataclass(frozen=True)
class Book:
    """What goes around the data of a template: head rows, sheets behind it, and the looks of each sheet."""

    sheet: str
    head: list[list[str]]
    more: list[Sheet]
    layouts: dict[str, Layout]


def config_rows(config: Config) -> list[list[str]]:
    """Tax sources beside platforms, the shorter list filled up; both are the defaults unless tax sources were uploaded."""
    taxes, platforms = (config.tax_sources, config.platforms) if config.tax_sources else (C.TAX_SOURCES, C.PLATFORMS)
    at = lambda x, i: x[i] if i < len(x) else ""
    return [["税源地", "平台"]] + [[at(taxes, i), at(platforms, i)] for i in range(max(len(taxes), len(platforms)))]


def task_rows(entries: list[str]) -> list[list[str]]:
    """One entry a row."""
    return [["任务清单"]] + [[e] for e in entries]


def entity_rows(config: Config) -> list[list[str]]:
    """Uploaded entities and their keywords."""
    return [["签约主体", "关键词"]] + [[k, ",".join(words)] for k, words in config.entities]


def platform_rows(config: Config) -> list[list[str]]:
    """Uploaded platform keywords and tax sources."""
    return [["平台关键词", "税源地"]] + [[k, t] for k, t in config.platform_taxes]


def template_book(key: str, headers: list[str], batch_no: str = "", plain_amount: bool = True, config: Config = Config(), tasks: list[str] | None = None) -> Book:
    """K2-K6: the workbook of a template by its key; an unknown key is a plain table."""
    if key == "shenbianyun":
        money = C.PLAIN_FORMAT if plain_amount else C.CURRENCY_FORMAT
        formats = tuple(money if h == C.PAYMENT_AMOUNT else "@" for h in headers)
        amounts = tuple(i for i, h in enumerate(headers) if h == C.PAYMENT_AMOUNT)
        look = Layout(formats=formats, numbers=amounts, body=4, merged=("A1:I1",), widths=C.PAYMENT_WIDTHS, wrapped=("A1",))
        return Book(C.SHEET_NAMES[key], [[C.PAYMENT_NOTE], [C.PAYMENT_BATCH_LABEL], [batch_no], list(headers)], [], {C.SHEET_NAMES[key]: look})
    if key == "youyi":
        more = [(C.CONFIG_SHEET, config_rows(config)), (C.TASK_SHEET, task_rows(tasks or []))]
        return Book(C.SHEET_NAMES[key], [list(headers)], more, {C.CONFIG_SHEET: Layout(widths=(20, 40)), C.TASK_SHEET: Layout(widths=(40,))})
    return Book(C.SHEET_NAMES.get(key, C.SHEET_NAMES["custom"]), [list(headers)], [], {})


def file_name(key: str, batch_no: str = "", today: datetime.date | None = None) -> str:
    """K6: by batch number where the template has one and it is set, else by date."""
    name = C.TEMPLATE_NAMES.get(key, C.TEMPLATE_NAMES["custom"])
    if batch_no and key in C.BATCH_TEMPLATES:
        return f"{batch_no}_{name}.xlsx"
    return f"{name}_转换结果_{(today or datetime.date.today()).strftime('%Y%m%d')}.xlsx"


def sheet_rows(rows: DataFrame, headers: list[str], book: Book, name: Column, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Rows for the sink: the data of each file ``name`` in parts of ``part_rows``, head rows and further sheets in each part.

    ``order`` ends with a whole number that is unique within the columns before it
    (see ``numbering``). Parts after the first are named ``name_2``, ``name_3``
    and so on. Null cells are empty. A file without rows does not come out.
    """
    shared = sum(len(r) for _, r in book.more) + len(book.head)
    if shared > MOST_SHARED_ROWS:
        raise ValueError(f"{shared} rows that every file repeats are more than {MOST_SHARED_ROWS}")
    cells = F.array(*[F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")) for h in headers]).alias("cells")
    data = rows.select(file_name_part(F.regexp_replace(name, r"\.xlsx\z", "")).alias("_name"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], cells)
    data = numbered(data, ["_name", *[f"_o{i}" for i in range(len(order))]], "_n")
    data = data.join(data.groupBy("_name").agg(F.min("_n").alias("_first")), "_name")
    at = F.col("_n") - F.col("_first")
    part = F.floor(at / part_rows)
    file = F.concat("_name", F.when(part > 0, F.concat(F.lit("_"), (part + 1).cast("string"))).otherwise(F.lit("")), F.lit(".xlsx"))
    body = data.select(file.alias("file"), F.lit(0).alias("sheet_no"), F.lit(book.sheet).alias("sheet"), (at % part_rows + len(book.head)).alias("row_no"), "cells")
    fixed = [(0, book.sheet, i, r) for i, r in enumerate(book.head)] + [(k, n, i, r) for k, (n, rs) in enumerate(book.more, 1) for i, r in enumerate(rs)]
    kind = "array<struct<sheet_no:int,sheet:string,row_no:long,cells:array<string>>>"
    rest = [{"sheet_no": k, "sheet": n, "row_no": i, "cells": r} for k, n, i, r in fixed]
    around = body.select("file").distinct().select("file", F.inline(F.from_json(F.lit(json.dumps(rest, ensure_ascii=False)), kind)))
    every = body.unionByName(around).select("file", F.col("sheet_no").cast("int").alias("sheet_no"), "sheet", F.col("row_no").cast("long").alias("row_no"), "cells")
    return every.repartition("file").sortWithinPartitions("file", "sheet_no", "row_no")


def write_books(rows: DataFrame, folder: str, layouts: dict[str, Layout] | None = None, overwrite: bool = False) -> None:
    """Writes what ``sheet_rows`` gives, in one job: each file whole or not at all."""
    rows.sparkSession.dataSource.register(WorkbookSink)
    rows.write.format("workbooks").option("layouts", layouts_option(layouts or {})).mode("overwrite" if overwrite else "append").save(folder)


def write_template(
    rows: DataFrame, key: str, headers: list[str], folder: str, order: list[str], group: str | None = None, batch_no: str = "", plain_amount: bool = True,
    config: Config = Config(), tasks: list[str] | None = None, today: datetime.date | None = None, part_rows: int = PART_ROWS,
) -> None:
    """K3, K4, K6, K7: a template's workbook, or one for each value of the column ``group``, named by it."""
    book = template_book(key, headers, batch_no, plain_amount, config, tasks)
    name = F.col(group).cast("string") if group else F.lit(file_name(key, batch_no, today))
    write_books(sheet_rows(rows, headers, book, name, order, part_rows), folder, book.layouts)


def client_rows(clients: DataFrame) -> DataFrame:
    """K9: the client sheet: one row for each task of a client, one for a client without; (pos, n, cells)."""
    none = F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("content")))
    tasks = F.when(F.size("tasks") > 0, F.col("tasks")).otherwise(none)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in clients.columns else F.lit("")
    rows = clients.select("*", F.posexplode(tasks).alias("n", "_t"))
    cells = F.array(text("id"), text("short_name"), text("full_name"), F.lit(""), F.lit(""), text("tax_id"), text("fee_rate"), text("sign_entity"), F.coalesce("_t.name", F.lit("")), F.coalesce("_t.content", F.lit("")))
    return rows.select("pos", "n", cells.alias("cells"))


def write_backup(clients: DataFrame, folder: str, name: str, config: Config = Config(), tasks: list[str] | None = None) -> None:
    """K9: the reference data in one workbook of five sheets that ``uploads`` reads again.

    A backup is one file and its client sheet one sheet, so clients are as many
    as a workbook holds; more than a million rows are an error.
    """
    spark: SparkSession = clients.sparkSession
    rows = numbered(client_rows(clients), ["pos", "n"], "row_no")
    data = rows.select(F.lit(0).alias("sheet_no"), F.lit(C.CLIENT_SHEET).alias("sheet"), F.when(F.col("row_no") < 1_048_575, F.col("row_no") + 1).otherwise(F.raise_error(F.lit("a sheet holds 1048576 rows"))).alias("row_no"), "cells")
    sheets = [(C.CONFIG_SHEET, config_rows(config)), (C.TASK_SHEET, task_rows(tasks or [])), (C.ENTITY_SHEET, entity_rows(config)), (C.PLATFORM_SHEET, platform_rows(config))]
    rest = [(0, C.CLIENT_SHEET, 0, list(C.CLIENT_SHEET_HEADERS))] + [(k, n, i, r) for k, (n, rs) in enumerate(sheets, 1) for i, r in enumerate(rs)]
    every = data.unionByName(spark.createDataFrame(rest, "sheet_no int, sheet string, row_no long, cells array<string>")).withColumn("file", F.lit(name))
    every = every.select(*[f.split()[0] for f in SCHEMA.split(", ")]).repartition(1).sortWithinPartitions("sheet_no", "row_no")
    narrow = Layout(widths=(20, 40))
    write_books(every, folder, {C.CONFIG_SHEET: narrow, C.TASK_SHEET: Layout(widths=(40,)), C.ENTITY_SHEET: narrow, C.PLATFORM_SHEET: narrow})
