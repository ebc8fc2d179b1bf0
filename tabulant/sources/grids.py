"""Sources that become grids (source_id, row_idx, cells).

Files are read by Spark (``binaryFile`` or tables), one file per row, and turned
into rows by small stdlib parsers inside ``mapInArrow``: what Spark has no reader
for. ``csv_splits`` reads CSV of any size, ``uploads`` folders with bad files in them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulant.functions.scalars import js_trim, sheet_text
from tabulant.sources import number_formats

GRID = "source_id string, row_idx long, cells array<string>"
_GRID = pa.schema([("source_id", pa.string()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.string()))])
_PIECE = re.compile(r'"((?:[^"]|"")*)(?:"|\Z)|(\r\n|\r|\n)|([^"\r\n]+)')


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    """Quotes open and close anywhere in a cell, ``""`` is a quote, any line end ends a row; empty rows go."""
    rows: list[list[str]] = []
    row, cell, open_row = [], "", False
    for m in _PIECE.finditer(text):
        if m[2] is not None:
            rows.append([*row, cell])
            row, cell, open_row = [], "", False
        elif m[3] is not None:
            first, *rest = m[3].split(delimiter)
            cell += first
            for part in rest:
                row.append(cell)
                cell = part
            open_row = True
        else:
            cell += m[1].replace('""', '"')
            open_row = True
    if open_row and (row or cell):
        rows.append([*row, cell])
    return [r for r in rows if any(r)]


def looks_garbled(text: str) -> bool:
    """Two replacement characters in a row, or over ten odd characters among the first 500."""
    odd = sum(ord(c) > 255 and not ("一" <= c <= "鿿" or "　" <= c <= "〿") for c in text[:500])
    return "��" in text or odd > 10


def decode(data: bytes) -> str:
    text = data.decode("utf-8", "replace")
    if looks_garbled(text):
        text = data.decode("gb18030", "replace")
    return text.removeprefix("﻿")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _GRID)], schema=_GRID)


def _files_to_grids(parse):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                for sheet, rows in parse(content.as_py()):
                    name = path if sheet is None else f"{path}#{sheet}"
                    yield _batch([(name, i, r) for i, r in enumerate(rows)])

    return run


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def parse_xlsx(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """S3: every sheet of a workbook as the text that its cells show, number and date formats included."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = [(s.get("name"), s.get(_REL_ID)) for s in book.find("m:sheets", _NS)]
        settings = book.find("m:workbookPr", _NS)
        year_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        formats = _cell_formats(z.read("xl/styles.xml")) if "xl/styles.xml" in names else []
        parts = {}
        if "xl/_rels/workbook.xml.rels" in names:
            parts = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        return [(name, _sheet_rows(z.read(f"xl/{parts.get(rel, f'worksheets/sheet{i}.xml')}"), shared, formats, year_1904)) for i, (name, rel) in enumerate(sheets, 1)]


def _cell_formats(xml: bytes) -> list[str]:
    """The format code of each cell style."""
    styles = ElementTree.fromstring(xml)
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{{{_NS['m']}}}numFmt")}
    uses = styles.find("m:cellXfs", _NS)
    ids = [int(x.get("numFmtId") or 0) for x in uses] if uses is not None else []
    return [own.get(i, number_formats.BUILT_IN.get(i, "General")) for i in ids]


def _sheet_rows(xml: bytes, shared: list[str], formats: list[str], year_1904: bool) -> list[list[str]]:
    rows = []
    for row in ElementTree.fromstring(xml).iter(f"{{{_NS['m']}}}row"):
        cells: list[str] = []
        for c in row.findall("m:c", _NS):
            col = 0
            for ch in re.match("[A-Z]+", c.get("r", "A"))[0]:
                col = col * 26 + ord(ch) - 64
            v = c.find("m:v", _NS)
            kind = c.get("t", "n")
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else (v.text if v is not None else "") or ""
            if kind == "s":
                text = shared[int(text)]
            elif kind == "b":
                text = "TRUE" if text == "1" else "FALSE"
            elif kind == "n" and text:
                style = int(c.get("s") or 0)
                text = number_formats.shown(text, formats[style] if style < len(formats) else "General", year_1904)
            cells += [""] * (col - 1 - len(cells)) + [text]
        rows.append(cells)
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """S3: one source per sheet."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_files_to_grids(parse_xlsx), GRID)


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self._cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None:
            self.tables[-1][-1].append("".join(self._cell).strip())
            self._cell = None

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)


def parse_html_table(html: str) -> list[list[str]]:
    """The table with most rows; empty rows go."""
    p = _Tables()
    p.feed(html)
    best = max(p.tables, key=len, default=[])
    return [r for r in best if any(r)]


def html_tables(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """S20 over a table of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, html in zip(batch.column("id").to_pylist(), batch.column("html").to_pylist()):
                yield _batch([(name, i, r) for i, r in enumerate(parse_html_table(html or ""))])

    return pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, GRID)


def json_rows(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of a JSON answer, fenced or not: an array of arrays, or an object with header and rows."""
    text = F.coalesce(F.nullif(F.regexp_extract(text_col, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.col(text_col))
    array = F.from_json(text, "array<array<string>>")
    obj = F.from_json(text, "header array<string>, rows array<array<string>>")
    rows = F.when(F.rlike(js_trim(text), F.lit(r"^\[")), array).otherwise(F.concat(F.array(obj["header"]), obj["rows"]))
    kept = F.filter(rows, lambda r: F.exists(F.coalesce(r, F.array().cast("array<string>")), lambda c: js_trim(c) != ""))
    return answers.select(F.col(id_col).cast("string").alias("source_id"), F.posexplode(kept).alias("row_idx", "cells")).withColumn("row_idx", F.col("row_idx").cast("long"))


def sse_text(events: DataFrame, key: str, seq: str, delta: str) -> DataFrame:
    """The deltas of each stream, joined in order. A stream's text is one value, so it is as long as its deltas together."""
    return events.where(F.col(delta) != "").groupBy(F.col(key)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, delta))), lambda s: s[delta]), "").alias("text"))


def kind_of_file(path: Column) -> Column:
    """The reader for a file extension; null for an unknown one."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    return F.when(ext == "csv", "csv").when(ext.isin("xlsx", "xls"), "excel").when(ext == "pdf", "pdf").when(ext.isin("png", "jpg", "jpeg", "webp", "bmp"), "image")


def cells_by_overlap(words: DataFrame, bands: DataFrame) -> DataFrame:
    """Each word to the band it overlaps most (ties: the first); words of a cell are joined from left to right."""
    keyed = words.withColumn("_w", F.xxhash64("row_idx", "x", "y", "str"))
    overlap = F.least(F.col("x") + F.col("w"), F.col("b")) - F.greatest("x", "a")
    best = F.max_by("col_idx", F.struct(overlap, -F.col("col_idx")))
    own = keyed.join(bands, "source_id").groupBy("source_id", "row_idx", "_w", "str", "x").agg(best.alias("col_idx"))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "str"))), lambda s: s["str"]), " ")
    cells = own.groupBy("source_id", "row_idx", "col_idx").agg(sheet_text(cell).alias("cell"))
    width = bands.groupBy("source_id").agg(F.max("col_idx").alias("_last"))
    found = cells.groupBy("source_id", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "cell"))).alias("_m")).join(width, "source_id")
    return found.select("source_id", "row_idx", F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(""))).alias("cells"))


def column_borders(pixels: DataFrame) -> DataFrame:
    """(source_id, x) of vertical lines: 85 % dark pixels, neighbours within two pixels one line; three lines or none."""
    dark = pixels.groupBy("source_id", "x").agg(F.avg((F.col("lum") < 240).cast("int")).alias("share")).where("share >= 0.85")
    w = Window.partitionBy("source_id").orderBy("x")
    line = dark.withColumn("_l", F.sum(F.coalesce((F.col("x") - F.lag("x").over(w) > 2).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = line.groupBy("source_id", "_l").agg(F.floor(F.avg("x") + 0.5).cast("int").alias("x"))
    return lines.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("source_id"))).where("_n >= 3").select("source_id", "x")
