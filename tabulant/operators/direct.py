"""Direct tables: a source's rows under their own or standard headers, without a template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.functions import constants as C
from tabulant.functions.scalars import clean_name, clean_value, js_trim, sanitize_amount
from tabulant.operators.people import split_amounts


def _cell(i: int) -> Column:
    return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))


def raw_table(rows: DataFrame, headers: dict[int, str], name_col: int | None = None) -> tuple[list[str], DataFrame]:
    """(headers, rows with the recognised cells in column order, as they are).

    Only the name column, if given, is cleaned; a source edited by hand gives none.
    """
    cols = sorted(headers)
    cells = [F.coalesce(clean_name(_cell(i)), F.lit("")) if i == name_col else _cell(i) for i in cols]
    return [(headers[i] or "").strip() or f"列{i + 1}" for i in cols], rows.select("source_id", "row_idx", F.array(*cells).alias("cells"))


def mapped_table(rows: DataFrame, types: dict[int, str], headers: dict[int, str], name_col: int | None = None, label_note: bool = False) -> tuple[list[str], DataFrame, DataFrame | None]:
    """(standard headers, cleaned rows with split_idx, mismatched totals or None).

    Columns without a type and the declared total are left out. Several amounts
    are split into rows and come out as one column; labels of their origin go to
    the note column, which is appended where the source has none. No row is
    filtered.
    """
    typed = {i: t for i, t in sorted(types.items()) if t}
    of_type = lambda kind: [i for i, t in typed.items() if t == kind]
    amounts, totals, notes = of_type("amount"), of_type("amountTotal"), of_type("note")
    work, wrong = rows.withColumn("split_idx", F.lit(0)), None
    splits = len(amounts) > 1
    if splits:
        labels = {i: headers[i].strip() for i in amounts if (headers.get(i) or "").strip()}
        work, wrong = split_amounts(rows, amounts, totals[0] if totals else None, notes[0] if notes else None, labels, label_note)
    kept = {i: t for i, t in typed.items() if t != "amountTotal" and not (splits and i in amounts[1:])}

    names: list[str] = []
    for i, kind in kept.items():
        n = sum(1 for j, t in kept.items() if t == kind and j <= i)
        names.append(C.TYPE_LABELS.get(kind, kind) + (str(n) if n > 1 else ""))

    def value(i: int, kind: str) -> Column:
        if i == name_col:
            return clean_value(clean_name(_cell(i)), "name")
        return sanitize_amount(_cell(i)) if kind == "amount" else clean_value(_cell(i), kind)

    cells = [js_trim(F.coalesce(value(i, t), F.lit(""))) for i, t in kept.items()]
    if splits and label_note and not notes:
        names.append(C.TYPE_LABELS["note"])
        cells.append(js_trim(F.coalesce(F.element_at("cells", -1), F.lit(""))))
    return names, work.select("source_id", "row_idx", "split_idx", F.array(*cells).alias("cells")), wrong


def date_hints(grid: DataFrame, first_rows: int = 20) -> DataFrame:
    """(source_id, year_hint, month_hint), the first in the leading rows of a source's sheets; empty without one.

    The grid has ``source_id, sheet_idx, row_idx, cells``; rows are filtered
    before cells are read, so a long sheet costs no more than its head.
    """
    cells = grid.where(F.col("row_idx") < first_rows).select("source_id", "sheet_idx", "row_idx", F.posexplode("cells").alias("col_idx", "cell"))
    found = lambda p: F.nullif(F.regexp_extract("cell", p, 1), F.lit(""))
    order = F.struct("sheet_idx", "row_idx", "col_idx")
    hits = cells.select("source_id", order.alias("_at"), found(C.YEAR_HINT).alias("year"), F.coalesce(*map(found, C.MONTH_HINTS)).alias("month"))
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))), F.lit(""))
    return hits.groupBy("source_id").agg(first("year").alias("year_hint"), first("month").alias("month_hint"))


def group_label(file: Column, sheet: Column, by_sheet: bool) -> Column:
    """F18."""
    return F.concat(file, F.lit(" / "), F.coalesce(F.nullif(sheet, F.lit("")), F.lit("默认表"))) if by_sheet else file
