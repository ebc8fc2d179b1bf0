"""Templates, projections, split groups, names and sinks."""

from __future__ import annotations

import datetime
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulant.functions import constants as C
from tabulant.functions.scalars import clean_name, clean_value, file_name_part, gender_of_id, js_trim, sanitize_amount
from tabulant.operators.validation import bank_place
from tabulant.sources.workbook_sink import Book


@dataclass(frozen=True)
class Template:
    name: str
    headers: tuple[str, ...]
    fields: tuple[tuple[str, str], ...]  # (type, header)


TEMPLATES = {k: Template(k, h, C.TEMPLATE_FIELDS[k]) for k, h in C.TEMPLATE_HEADERS.items()}


def cleaned(value: Column, kind: str) -> Column:
    return sanitize_amount(value) if kind == "amount" else clean_value(value, kind)


def clean_name_column(rows: DataFrame, types: dict[str, int]) -> DataFrame:
    """The pass over the name column that goes before merging; adds ``_renamed``, whether it changed the row."""
    col = types.get("name")
    if col is None:
        return rows.withColumn("_renamed", F.lit(False))
    own = F.get("cells", F.lit(col))
    named = F.coalesce(clean_name(own), F.lit(""))
    return rows.withColumn("_renamed", F.coalesce(named != own, F.lit(False))).withColumn("cells", F.transform("cells", lambda v, i: F.when((i == col) & F.col("_renamed"), named).otherwise(v)))


@dataclass(frozen=True)
class Projection:
    """A template's columns over ``cells``: values by header, how many cells cleaning shortened, and whether the row names anybody."""

    values: dict[str, Column]
    shorter: Column
    named: Column


def projection(types: dict[str, int], template: Template) -> Projection:
    """G1, G3, P6 as expressions."""
    at = lambda kind: F.coalesce(F.get("cells", F.lit(types[kind])), F.lit("")) if types.get(kind) is not None else F.lit("")
    values = {header: cleaned(at(kind), kind) for kind, header in template.fields}
    by_type = dict(template.fields)
    if "gender" in by_type:
        own = values[by_type["gender"]]
        values[by_type["gender"]] = F.when(own == "", gender_of_id(cleaned(at("idCard"), "idCard"))).otherwise(own)
    shorter = sum((F.when(F.length(cleaned(at(k), k)) < F.length(js_trim(at(k))), 1).otherwise(0) for k, _ in template.fields), F.lit(0))
    name, card, bank = (cleaned(at(k), k) != "" for k in ("name", "idCard", "bankCard"))
    return Projection({h: values.get(h, F.lit("")) for h in template.headers}, shorter, name | card | bank)


def project(rows: DataFrame, types: dict[str, int], template: Template, keep_all: bool = False, also: dict[str, Column] | None = None) -> DataFrame:
    """Typed columns under the template's headers, cleaned; other headers empty.

    Adds ``_cleaned``, the number of cells that cleaning shortened. Rows without
    name, id and card go unless ``keep_all`` (G2). ``also`` adds columns of the
    rows as they came.
    """
    p = projection(types, template)
    kept = rows if keep_all else rows.where(p.named)
    return kept.select("source_id", "row_idx", *[v.alias(h) for h, v in p.values.items()], p.shorter.alias("_cleaned"), *[v.alias(c) for c, v in (also or {}).items()])


def constant_values(values: dict[str, Column], cities: list[str]) -> dict[str, Column]:
    """What fills of these columns: tax and insurance are "0", a missing bank is "0", a missing place is that of the bank."""
    out = dict(values)
    for c in ("个税金额", "商业保险"):
        if c in out:
            out[c] = F.lit("0")
    if "银行名称" in out:
        out["银行名称"] = F.coalesce(F.nullif(out["银行名称"], F.lit("")), F.lit("0"))
    if "银行所属地" in out:
        out["银行所属地"] = F.coalesce(F.nullif(out["银行所属地"], F.lit("")), bank_place(out.get("银行名称", F.lit("")), cities))
    return out


def fill_constants(rows: DataFrame, cities: list[str]) -> DataFrame:
    """G4 on a table; columns not there stay away."""
    have = {c: F.col(c) for c in ("个税金额", "商业保险", "银行名称", "银行所属地") if c in rows.columns}
    return rows.withColumns(constant_values(have, cities)) if have else rows


def fan_out(rows: DataFrame, types: dict[str, int], templates: list[Template], selected: DataFrame | None = None, cities: list[str] | None = None) -> DataFrame:
    """(template, source_id, row_idx, cells): several templates' rows from one scan of the rows.

    ``selected`` (source_id) are the chosen sources; without it all are. The cells
    stand in the order of each template's headers. Nothing is scanned or
    detected again for a further template: write the result once, parted by
    ``template``, and every sink reads its own part.
    """
    chosen = rows if selected is None else rows.join(selected.select("source_id").distinct(), "source_id", "left_semi")
    parts = []
    for t in templates:
        p = projection(types, t)
        values = constant_values(p.values, cities or []) if t.name == "youyi" else p.values
        parts.append(F.when(p.named, F.struct(F.lit(t.name).alias("template"), F.array(*[values[h] for h in t.headers]).alias("cells"))))
    each = chosen.select("source_id", "row_idx", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("t"))
    return each.select("t.template", "source_id", "row_idx", "t.cells")


def split_groups(rows: DataFrame, by_sheet: bool, default_file: str = "未命名") -> DataFrame:
    """(group, file, sheet, first_row, n_rows) in first-seen order."""
    file = F.coalesce(F.nullif("_file", F.lit("")), F.lit(default_file))
    sheet = F.coalesce("_sheet", F.lit("")) if by_sheet else F.lit("")
    return rows.groupBy(file.alias("file"), sheet.alias("sheet")).agg(F.min("row_idx").alias("first_row"), F.count(F.lit(1)).alias("n_rows"))


def numbered_names(names: DataFrame, base: str, order: str) -> DataFrame:
    """Later uses of a base name get (2), (3) and so on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return names.withColumn("name", F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit("("), n.cast("string"), F.lit(")"))))


def lettered_batches(groups: DataFrame, base: str, order: str) -> DataFrame:
    """-A, -B ... -Z for groups with the same base; -Z from there on."""
    n = F.least(F.row_number().over(Window.partitionBy(base).orderBy(order)), F.lit(26))
    return groups.withColumn("batch_no", F.concat(base, F.lit("-"), F.char(n + 64)))


def strip_common_parts(names: list[str]) -> list[str]:
    """The names without their common prefix, suffix and dash-separated parts; a step that empties a name is left out."""
    import os

    if len(set(names)) < 2:
        return list(names)
    marks = "-—－_·"

    def step(now: list[str], new: list[str]) -> list[str]:
        return new if all(new) else now

    out = list(names)
    head = len(os.path.commonprefix(out))
    out = step(out, [n[head:].lstrip(marks + " \t") for n in out]) if head else out
    tail = len(os.path.commonprefix([n[::-1] for n in out]))
    out = step(out, [n[: len(n) - tail].rstrip(marks + " \t") for n in out]) if tail else out
    parts = [n.split("-") for n in out]
    same = {i for i in range(min(map(len, parts)) - 1) if len({p[i] for p in parts}) == 1}
    return step(out, ["-".join(x for i, x in enumerate(p) if i not in same).strip() for p in parts]) if same else out


def split_file_names(groups: list[tuple[str, str]], template: str, rule: str = "full", by_sheet: bool = False, several_templates: bool = False, batches: list[str] | None = None) -> list[str]:
    """Base names of a batch of (file, sheet) groups by rule full, compact, batchno or batchno-compact."""
    import re

    clean = lambda s: re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|\r\n\t]', " ", s or "")).strip()[:60]
    stems = [clean(re.sub(r"\.[^.]+\Z", "", f or "未命名")) or "未命名" for f, _ in groups]
    compact, many = rule != "full", len(groups) > 1
    same_file, same_sheet = many and len({f for f, _ in groups}) == 1, many and len({s for _, s in groups}) == 1
    short = strip_common_parts(stems) if compact and many and not same_file else stems
    out = []
    for i, (_, sheet) in enumerate(groups):
        parts = [] if compact and same_file else [short[i]]
        if by_sheet and clean(sheet) and not (compact and same_sheet):
            parts.append(clean(sheet))
        if not compact or several_templates:
            parts.append(template)
        base, batch = "_".join(parts) or "拆分结果", clean(batches[i]) if batches else ""
        if batch and rule == "batchno":
            base = f"{batch}_{template}" if several_templates else batch
        elif batch and rule == "batchno-compact":
            base = f"{batch}_{base}"
        out.append(base)
    return out


def csv_line(columns: list[str]) -> Column:
    """K1: quoted only where needed."""

    def cell(c: str) -> Column:
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(F.rlike(v, F.lit('[,"\n]')), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    return F.concat_ws(",", *[cell(c) for c in columns])


def csv_text(headers: list[str], rows: list[tuple]) -> str:
    """K1 for one small file: no line end after the last row."""
    cell = lambda v: '"' + s.replace('"', '""') + '"' if any(ch in (s := str(v or "")) for ch in ',"\n') else s
    return "\n".join(",".join(map(cell, r)) for r in [headers, *rows])


def column_widths(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The longest text plus two, at most 30."""
    return rows.agg(*[F.least(F.max(F.length(F.coalesce(F.col(f"`{c}`"), F.lit("")))) + 2, F.lit(30)).alias(c) for c in columns])


def xlsx_bytes(sheets: list[tuple[str, list[list]]]) -> bytes:
    """K2, K5, K8: one small workbook of texts and numbers; ``workbooks`` writes those of any size."""
    out = io.BytesIO()
    book = Book(out, {})
    for name, rows in sheets:
        book.sheet(name)
        for row in rows:
            book.row(list(row))
    book.close()
    return out.getvalue()


def group_files(rows: DataFrame, headers: list[str], group_col: str = "group") -> DataFrame:
    """K7: one workbook per group: (group, file_name, content). A group is one output file, limited by its sheet to a task's size."""

    def build(table: pa.Table) -> pa.Table:
        body = table.select(headers).to_pylist()
        name = table.column("_g")[0].as_py()
        return pa.table({"group": [name], "file_name": [table.column("_f")[0].as_py()], "content": [xlsx_bytes([("Sheet1", [headers, *[list(r.values()) for r in body]])])]})

    named = rows.withColumn("_g", F.col(group_col).cast("string")).withColumn("_f", F.concat(file_name_part(F.col(group_col).cast("string")), F.lit(".xlsx")))
    return named.select("_g", "_f", *headers).groupBy("_g").applyInArrow(build, "group string, file_name string, content binary")


def zip_bytes(files: Iterator[tuple[str, bytes]]) -> bytes:
    """K7: a stored (not deflated) archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def apply_remark(rows: DataFrame, note_col: str, selected: Column, value: Column, append: bool) -> DataFrame:
    """Writes or appends a remark on selected rows; an empty value changes nothing."""
    text = js_trim(value)
    new = js_trim(F.concat_ws(" ", F.nullif(js_trim(note_col), F.lit("")), text)) if append else text
    return rows.withColumn(note_col, F.when(selected & (text != ""), new).otherwise(F.col(note_col)))


def remark_values(rows: DataFrame, preset: str, clients: DataFrame | None = None, selected_files: list[str] | None = None, custom: str = "", today: datetime.date | None = None, file_col: str = "_file", sheet_col: str = "_sheet", id_col: str = "商社编号") -> DataFrame:
    """Adds ``_remark`` by preset: filename, sheetname, date, client or custom; empty for another.

    The file name is the row's own, or those of all selected files, without the
    last extension. The client's short name comes before its full name; an unknown
    id has neither.
    """
    if preset == "client" and clients is not None:
        name = F.coalesce(F.nullif("short_name", F.lit("")), F.nullif("full_name", F.lit("")), F.lit(""))
        known = clients.groupBy(js_trim("id").alias("_remark_id")).agg(F.min_by(name, "pos").alias("_remark"))
        found = rows.withColumn("_remark_id", js_trim(id_col)).join(known, "_remark_id", "left")
        return found.select(*rows.columns, F.coalesce("_remark", F.lit("")).alias("_remark"))
    all_files = "、".join(f for f in selected_files or [] if f)
    value = {
        "filename": file_stem(F.coalesce(F.nullif(F.col(file_col), F.lit("")), F.lit(all_files))) if file_col in rows.columns else file_stem(F.lit(all_files)),
        "sheetname": F.coalesce(F.col(sheet_col), F.lit("")) if sheet_col in rows.columns else F.lit(""),
        "date": F.lit((today or datetime.date.today()).isoformat()),
        "custom": js_trim(F.lit(custom)),
    }.get(preset, F.lit(""))
    return rows.withColumn("_remark", value)


def patch_cells(rows: DataFrame, patches: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Point updates from a patch table."""
    new = patches.select(*keys, F.col("value").alias("_v"), F.lit(True).alias("_p"))
    return rows.join(new, keys, "left").withColumn(column, F.when(F.col("_p"), F.col("_v")).otherwise(F.col(column))).drop("_v", "_p")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+\z", "")
