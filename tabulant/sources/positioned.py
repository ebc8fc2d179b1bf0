"""Positioned text and recognised words to grids.

A page, or an image, is the unit: it has as many words as a page holds. Lines,
medians, regions and sub-cells are windows and keyed joins by page; the folds
that put fragments into cells and cells into column bands run over one page.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulant.functions.scalars import js_trim, sheet_text

#: Of the median height: how far apart fragments of one line or one cell may be.
NEAR = 0.75
#: Pages of a source follow each other by so many row numbers.
PAGE_ROWS = 1 << 20


def _median(values: Column) -> Column:
    """The upper of the middle values of a page."""
    return F.element_at(F.array_sort(F.collect_list(values)), F.floor(F.count(values) / 2).cast("int") + 1)


def _lines(rows: DataFrame, page: list[str], along: Column, order: list[Column], name: str) -> DataFrame:
    """Single-link clusters down the page: a gap of more than ``_tol`` begins a new one."""
    down = Window.partitionBy(*page).orderBy(*order)
    new = F.coalesce((along - F.lag(along).over(down) > F.col("_tol")).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


# --- positioned text -------------------------------------------------------------


@dataclass
class _Cell:
    text: str
    left: float
    right: float
    y: float
    spaced: bool = False


def cells_of_line(items: list[tuple[str, bool, float, float, float]], near: float) -> list[_Cell]:
    """Fragments (text, blank, x, y, width) of a line, by x, put into cells.

    A small gap keeps a cell together and an overlap begins a new one, unless the
    fragments stand one above the other. A blank fragment's width means nothing:
    it only puts a space before the next of the same cell.
    """
    cells: list[_Cell] = []
    for text, blank, x, y, width in items:
        now = cells[-1] if cells else None
        if blank:
            if now:
                now.spaced = True
            continue
        stacked = now is not None and abs(now.y - y) > near
        gap = x - now.right if now else 0.0
        if now is None or gap > near or (gap < 0 and not stacked):
            cells.append(_Cell(text, x, x + width, y))
            continue
        now.text += (" " if now.spaced and not stacked else "") + text
        now.left, now.right, now.y, now.spaced = min(now.left, x), max(now.right, x + width), y, False
    return cells


def _overlap(a: tuple[float, float], b: tuple[float, float]) -> float:
    return min(a[1], b[1]) - max(a[0], b[0])


def _half(a: tuple[float, float], b: tuple[float, float]) -> bool:
    return _overlap(a, b) >= 0.5 * min(a[1] - a[0], b[1] - b[0])


def bands_of_page(spans: list[tuple[float, float]], near: float) -> list[tuple[float, float]]:
    """Column bands of cells' spans: a cell widens the band that it overlaps by half, or the one it follows closely."""
    bands: list[tuple[float, float]] = []
    for span in sorted(spans, key=lambda s: s[0]):
        best = max(range(len(bands)), key=lambda i: _overlap(span, bands[i]), default=None)
        if best is not None and _overlap(span, bands[best]) > 0 and _half(span, bands[best]):
            bands[best] = (min(bands[best][0], span[0]), max(bands[best][1], span[1]))
            continue
        close = [i for i, b in enumerate(bands) if 0 < span[0] - b[1] <= near]
        if close:
            best = min(close, key=lambda i: span[0] - bands[i][1])
            bands[best] = (bands[best][0], max(bands[best][1], span[1]))
        else:
            bands.append(span)
    while True:  # neighbours, until none fuse; a band that has just grown waits for the next round
        out, i = [], 0
        while i < len(bands):
            pair = bands[i : i + 2]
            if len(pair) == 2 and (_half(*pair) or 0 < -_overlap(*pair) <= near):
                out.append((min(pair[0][0], pair[1][0]), max(pair[0][1], pair[1][1])))
                i += 2
            else:
                out.append(pair[0])
                i += 1
        if len(out) == len(bands):
            return bands
        bands = out


def band_of(cell: _Cell, bands: list[tuple[float, float]]) -> int:
    """The band that a cell overlaps most, else the one whose middle is nearest; the first of equals."""
    span, middle = (cell.left, cell.right), (cell.left + cell.right) / 2
    best = max(range(len(bands)), key=lambda i: _overlap(span, bands[i]))
    if _overlap(span, bands[best]) > 0:
        return best
    return min(range(len(bands)), key=lambda i: abs(middle - (bands[i][0] + bands[i][1]) / 2))


_PAGE = "source_id string, page long, line long, cells array<string>"


def _page_grid(page: pa.Table) -> pa.Table:
    near = page.column("_tol")[0].as_py()
    lines: dict[int, list[tuple]] = {}
    for line, *item in sorted(zip(*(page.column(c).to_pylist() for c in ("line", "str", "blank", "x", "y", "w"))), key=lambda r: (r[0], r[3], -r[4])):
        lines.setdefault(line, []).append(tuple(item))
    cells = {line: cells_of_line(items, near) for line, items in lines.items()}
    most = max(map(len, cells.values()))
    for least in (max(2, NEAR * most), max(2, 0.5 * most), 0):  # lines with few cells, such as titles, do not make columns
        dense = [c for own in cells.values() if len(own) >= least for c in own]
        if dense:
            break
    bands = bands_of_page([(c.left, c.right) for c in dense], near)
    rows = []
    for line, own in cells.items():
        texts: list[list[str]] = [[] for _ in bands]
        for c in own:
            texts[band_of(c, bands)].append(c.text)
        rows.append([" ".join(t) for t in texts])
    n = len(rows)
    return pa.table({
        "source_id": pa.array([page.column("source_id")[0].as_py()] * n, pa.string()), "page": pa.array([page.column("page")[0].as_py()] * n, pa.int64()),
        "line": pa.array(list(cells), pa.int64()), "cells": pa.array(rows, pa.list_(pa.string())),
    })


def items_to_grid(items: DataFrame) -> DataFrame:
    """Text items (source_id, str, x, y, w, h, and page if there are several; y goes up) to one grid per source.

    Lines are clusters along y with gaps of 0.75 of the page's median height. Pages
    follow each other in order; ``row_idx`` grows but has gaps. Empty items and
    null texts are dropped, rows without a text too; a source of blank items only
    has no rows. Heights that are not positive count as ten.
    """
    page = F.col("page").cast("long") if "page" in items.columns else F.lit(0).cast("long")
    rows = items.where("str <> ''").select("source_id", page.alias("page"), "str", *[F.col(c).cast("double").alias(c) for c in "xywh"], (js_trim("str") == "").alias("blank"))
    height = _median(F.when(F.col("h") > 0, F.col("h")).otherwise(10.0))
    tolerance = rows.where("not blank").groupBy("source_id", "page").agg((height * NEAR).alias("_tol"))
    placed = _lines(rows.join(tolerance, ["source_id", "page"]), ["source_id", "page"], -F.col("y"), [F.desc("y"), F.asc("x")], "line")
    grid = placed.groupBy("source_id", "page").applyInArrow(_page_grid, _PAGE)
    clean = grid.withColumn("cells", F.transform("cells", sheet_text)).where(F.exists("cells", lambda c: c != ""))
    return clean.select("source_id", (F.col("page") * PAGE_ROWS + F.col("line")).alias("row_idx"), "cells")


# --- recognised words ------------------------------------------------------------


def boxes_of_polygons(found: DataFrame) -> DataFrame:
    """(source_id, text, poly array<array<double>>, score 0 to 1) to words with a box and a confidence of 0 to 100.

    Texts without a letter or digit are frame lines and go, and so do polygons of
    fewer than two points or without a finite one. A null score is 0.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    points = F.filter("poly", lambda p: finite(F.get(p, F.lit(0))) & finite(F.get(p, F.lit(1))))
    rows = found.where(F.rlike("text", F.lit(r"[\p{L}\p{N}]")) & (F.size("poly") >= 2)).withColumn("_p", points).where(F.size("_p") > 0)
    at = lambda pick, k: pick(F.transform("_p", lambda p: F.get(p, F.lit(k))))
    x, y = at(F.array_min, 0), at(F.array_min, 1)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("score").cast("double"), F.lit(0.0)) * 100))
    return rows.select("source_id", "text", x.alias("x"), y.alias("y"), (at(F.array_max, 0) - x).alias("w"), (at(F.array_max, 1) - y).alias("h"), score.alias("confidence"))


def words_in_borders(words: DataFrame, borders: DataFrame) -> DataFrame:
    """Words (source_id, text, x, y, w, h; y goes down) to a grid by vertical lines (source_id, x), three or more.

    A word belongs to the region between two lines that it overlaps most, or if
    none, to the nearest; the first of equals. Within a line and region, gaps
    above 0.75 of the median height part sub-cells; a region is as many columns wide
    as its fullest line has sub-cells, and the k-th of every line stand in one
    column. Rows without a text go.
    """
    across = Window.partitionBy("source_id").orderBy("x")
    right = F.lead("x").over(across)
    regions = borders.select("source_id", "x").distinct().withColumn("_right", right).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("source_id")))
    regions = regions.withColumn("region", F.row_number().over(across)).where("_n >= 3 and _right is not null").select("source_id", "region", F.col("x").cast("double").alias("_x0"), F.col("_right").cast("double").alias("_x1"))
    real = words.where((js_trim("text") != "") & (F.col("w") > 0) & (F.col("h") > 0)).select("source_id", "text", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    middle = F.col("y") + F.col("h") / 2
    key = F.row_number().over(Window.partitionBy("source_id").orderBy(middle, "x", "text"))
    real = real.join(real.groupBy("source_id").agg((_median(F.col("h")) * NEAR).alias("_tol")), "source_id").withColumn("_k", key)
    real = _lines(real, ["source_id"], middle, [middle.asc(), F.asc("_k")], "line")
    # a page's words and the few regions of its own image
    overlap = F.least(F.col("x") + F.col("w"), "_x1") - F.greatest("x", "_x0")
    away = F.abs(F.col("x") + F.col("w") / 2 - (F.col("_x0") + F.col("_x1")) / 2)
    rank = F.struct(F.when(overlap > 0, 0).otherwise(1), F.when(overlap > 0, -overlap).otherwise(away), F.col("region"))
    own = real.join(regions, "source_id").groupBy("source_id", "_k").agg(F.min_by("region", rank).alias("region"))
    placed = real.join(own, ["source_id", "_k"])
    along = Window.partitionBy("source_id", "line", "region").orderBy("x", "_k")
    parted = F.coalesce((F.col("x") - F.lag(F.col("x") + F.col("w")).over(along) > F.col("_tol")).cast("int"), F.lit(0))
    placed = placed.withColumn("_new", parted).withColumn("sub", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    wide = regions.select("source_id", "region").join(placed.groupBy("source_id", "region").agg((F.max("sub") + 1).alias("_subs")), ["source_id", "region"], "left").withColumn("_subs", F.coalesce("_subs", F.lit(1)))
    before = F.coalesce(F.sum("_subs").over(Window.partitionBy("source_id").orderBy("region").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = wide.withColumn("_first", before).withColumn("_all", F.sum("_subs").over(Window.partitionBy("source_id")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "_k", "text"))), lambda s: s["text"]), " ")
    cells = placed.join(wide, ["source_id", "region"]).groupBy("source_id", "line", (F.col("_first") + F.col("sub")).alias("_col"), "_all").agg(sheet_text(text).alias("cell"))
    rows = cells.groupBy("source_id", "line", "_all").agg(F.map_from_entries(F.collect_list(F.struct("_col", "cell"))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1), lambda i: F.coalesce(F.get(F.map_values(F.map_filter("_m", lambda k, v: k == i)), F.lit(0)), F.lit("")))
    return rows.select("source_id", F.col("line").alias("row_idx"), filled.alias("cells")).where(F.exists("cells", lambda c: c != ""))


def words_to_grid(words: DataFrame, images: DataFrame, borders: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The grid, and (source_id, confidence): the words' mean, to one decimal, halves up.

    ``images`` has (source_id, height). Images with three vertical lines or more
    (``borders``) are read by them; others, and those where that gives no row, by
    position like text. An image without words has neither rows nor a confidence.
    """
    real = words.where((js_trim("text") != "") & (F.col("w") > 0) & (F.col("h") > 0))
    sure = real.groupBy("source_id").agg((F.floor(F.avg("confidence") * 10 + 0.5) / 10).alias("confidence"))
    items = real.join(images, "source_id").select("source_id", F.col("text").alias("str"), "x", (F.col("height") - (F.col("y") + F.col("h"))).alias("y"), "w", "h")
    if borders is None:
        return items_to_grid(items), sure
    lined = words_in_borders(real, borders)
    return lined.unionByName(items_to_grid(items.join(lined.select("source_id").distinct(), "source_id", "left_anti"))), sure
