"""A sink for workbooks: ``df.write.format("workbooks").mode("append").save(folder)``.

Rows have ``file, sheet_no, sheet, row_no, cells`` and come sorted by them, a file
in one task; ``sheet_rows`` sees to both and cuts files into parts of bounded
size. A task writes its files under a name of its own attempt and reports them;
the driver moves them into place when all tasks have ended, so that a task that
is run again or fails leaves nothing behind. Folders may be local (shared) ones or
whatever ``pyarrow.fs`` opens by URI.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import IO
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "file string, sheet_no int, sheet string, row_no long, cells array<string>"
_MAIN, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
WIDEST = 30
_UNSAFE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


@dataclass(frozen=True)
class Layout:
    """How a sheet looks: number formats and numeric columns from row ``body`` on, merged ranges, widths (none: by content)."""

    formats: tuple[str, ...] = ()
    numbers: tuple[int, ...] = ()
    body: int = 0
    merged: tuple[str, ...] = ()
    widths: tuple[float, ...] = ()
    wrapped: tuple[str, ...] = field(default_factory=tuple)


def letters(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def amount(text: str) -> float | None:
    """The number that a text starts with, thousands' commas aside, rounded to cents with halves up; null without one."""
    found = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", text.replace(",", ""))
    if not found:
        return None
    import math

    return math.floor(float(found[1]) * 100 + 0.5) / 100


class Book:
    """One workbook, written as its rows come; it holds the rows of one sheet."""

    def __init__(self, out: IO[bytes], layouts: dict[str, Layout]):
        self._zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self._layouts = layouts
        self._formats: list[str] = []
        self._sheets: list[str] = []
        self._rows: list[list] = []

    def sheet(self, name: str) -> None:
        self._flush()
        self._sheets.append(name)

    def row(self, cells: list) -> None:
        self._rows.append(cells)

    def _style(self, fmt: str, wrap: bool) -> int:
        key = f"{int(wrap)}{fmt}"
        if key not in self._formats:
            self._formats.append(key)
        return self._formats.index(key) + 1

    def _cell(self, r: int, c: int, v, look: Layout) -> str:
        ref = f"{letters(c)}{r + 1}"
        fmt = look.formats[c] if r >= look.body and c < len(look.formats) else ""
        wrap = ref in look.wrapped
        style = f' s="{self._style(fmt, wrap)}"' if fmt or wrap else ""
        if isinstance(v, str) and c in look.numbers and r >= look.body and (n := amount(v)) is not None:
            v = n
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"{style}><v>{v!r}</v></c>'
        return f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(_UNSAFE.sub("", "" if v is None else str(v)))}</t></is></c>'

    def _flush(self) -> None:
        if not self._sheets:
            return
        look = self._layouts.get(self._sheets[-1], Layout())
        columns = max(map(len, self._rows), default=0)
        widths = look.widths or [min(max((len(str("" if r[c] is None else r[c])) for r in self._rows if c < len(r)), default=0) + 2, WIDEST) for c in range(columns)]
        with self._zip.open(f"xl/worksheets/sheet{len(self._sheets)}.xml", "w") as part:
            cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
            part.write(f'<worksheet xmlns="{_MAIN}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>'.encode())
            for r, row in enumerate(self._rows):
                part.write((f'<row r="{r + 1}">' + "".join(self._cell(r, c, v, look) for c, v in enumerate(row)) + "</row>").encode())
            merged = "".join(f'<mergeCell ref="{m}"/>' for m in look.merged)
            part.write(f"</sheetData>{f'<mergeCells>{merged}</mergeCells>' if merged else ''}</worksheet>".encode())
        self._rows = []

    def close(self) -> None:
        self._flush()
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(self._sheets) + 1))
        styles = f'<Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
        self._zip.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{styles}{parts}</Types>')
        self._zip.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(self._sheets, 1))
        self._zip.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>')
        related = "".join(f'<Relationship Id="s{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(self._sheets) + 1))
        self._zip.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{related}<Relationship Id="y" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        formats = "".join(f'<numFmt numFmtId="{163 + i}" formatCode="{escape(k[1:] or "General", {chr(34): "&quot;"})}"/>' for i, k in enumerate(self._formats, 1))
        uses = "".join(f'<xf numFmtId="{163 + i}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"{" applyAlignment=" + chr(34) + "1" + chr(34) + "><alignment wrapText=" + chr(34) + "1" + chr(34) + "/></xf>" if k[0] == "1" else "/>"}' for i, k in enumerate(self._formats, 1))
        plain = '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        self._zip.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}">{f"<numFmts>{formats}</numFmts>" if formats else ""}{plain}<cellXfs><xf xfId="0"/>{uses}</cellXfs></styleSheet>')
        self._zip.close()


def layouts_option(layouts: dict[str, Layout]) -> str:
    return json.dumps({k: asdict(v) for k, v in layouts.items()})


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        if "path" not in options:
            raise ValueError("a folder is needed: save(folder)")
        self._folder = options["path"].rstrip("/")
        self._layouts = {k: Layout(**{f: tuple(x) if isinstance(x, list) else x for f, x in v.items()}) for k, v in json.loads(options.get("layouts", "{}")).items()}
        self._overwrite = overwrite
        self._scratch = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self._folder)
        mine = f"{root}/{self._scratch}/{uuid.uuid4().hex}"
        now, out, book, done = None, None, None, []
        for batch in iterator:
            for file, number, sheet, cells in zip(*(batch.column(c).to_pylist() for c in ("file", "sheet_no", "sheet", "cells"))):
                if now is None or file != now[0]:
                    if book:
                        book.close()
                        out.close()
                    system.create_dir(mine, recursive=True)
                    done.append((f"{mine}/{len(done)}.xlsx", file))
                    out = system.open_output_stream(done[-1][0])
                    book, now = Book(out, self._layouts), (file, None)
                if number != now[1]:
                    book.sheet(sheet)
                    now = (file, number)
                book.row(cells)
        if book:
            book.close()
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self._folder)
        files = [f for m in messages if m for f in m.files]
        names = {name for _, name in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError("a workbook came out of several tasks: its rows must be in one partition")
        system.create_dir(root, recursive=True)
        if self._overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.path.endswith(".xlsx") and old.base_name not in names:
                    system.delete_file(old.path)
        for temporary, name in files:
            system.move(temporary, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _opened(self._folder)
        if system.get_file_info(f"{root}/{self._scratch}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self._scratch}")


class WorkbookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)
