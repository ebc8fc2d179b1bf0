"""Exact CSV of any size: files are split by bytes, and each split is parsed alone.

Quotes open and close anywhere, so whether a line starts inside a quoted cell
depends on all the file before it. The automaton that decides it has two states,
and every quote changes the state (``""`` twice): a split, started in either
state, ends in that state or in the other one by the parity of its quotes.

1. One pass counts quotes by split (Spark's own splits of a text file).
2. A prefix sum over a file's splits gives each its true first state. There is
   one light row per split, that is per ``spark.sql.files.maxPartitionBytes`` of
   input; at most ``MOST_SPLITS`` are broadcast.
3. Splits are parsed as they are read, without a shuffle. A record that crosses
   splits comes out in pieces, which are put together by file and record.

The first pass also finds each file's encoding (a line is never cut inside a
character: no byte of a longer one is a line end, quote, comma or tab in UTF-8 or GB18030).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulant.sources.grids import GRID, looks_garbled, parse_csv

#: Some 250 TB at 128 MB a split; one takes a few dozen bytes.
MOST_SPLITS = 2_000_000
FLUSH_BYTES = 4_000_000
ROW, TAIL, HEAD, MIDDLE = range(4)
_COUNTS = "path string, start long, size long, n_lines long, n_bytes long, odd long, garbled boolean, head binary"
_PARSED = "path string, start long, n long, kind int, cells array<string>, text binary"
_PARSED_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.binary())


def _lines(spark: SparkSession, path: str | list[str], glob: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line")
    )


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Iterator[bytes]]]:
    """(path, start, size, lines) of runs of lines of one split; a split may come in several runs, one after the other."""
    for batch in batches:
        starts, paths, sizes = batch.column("start").to_pylist(), batch.column("path").to_pylist(), batch.column("size").to_pylist()
        lines, first = batch.column("line").to_pylist(), 0
        for i in range(1, len(starts) + 1):
            if i == len(starts) or (starts[i], paths[i]) != (starts[first], paths[first]):
                yield paths[first], starts[first], sizes[first], iter(lines[first:i])
                first = i


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list] = {}
    for path, start, size, lines in _by_split(batches):
        own = found.setdefault((path, start), [size, 0, 0, 0, False, b""])
        for line in lines:
            own[1] += 1
            own[2] += len(line)
            own[3] ^= line.count(b'"') & 1
            if not start and len(own[5]) < 2000:  # 500 characters at least
                own[5] += line + b"\n"
            if not own[4]:
                try:
                    line.decode()
                except UnicodeDecodeError:
                    own[4] = "��" in line.decode("utf-8", "replace")
                else:
                    own[4] = "��".encode() in line
    rows = [(p, s, *own) for (p, s), own in found.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[f.split()[0] for f in _COUNTS.split(", ")])


class Layout:
    """What the parsing tasks look up: the first state of each split, and each file's encoding."""

    def __init__(self, rows: list) -> None:
        self.states: dict[str, dict[int, int]] = defaultdict(dict)
        self.encoding: dict[str, str] = {}
        self.line_end: dict[str, bool] = {}
        self.crossing: list[tuple[str, int]] = []
        files: dict[str, list] = defaultdict(list)
        for r in rows:
            files[r["path"]].append(r)
        for path, own in files.items():
            state, written = 0, 0
            for r in sorted(own, key=lambda r: r["start"]):
                self.states[path][r["start"]] = state
                before, state = state, state ^ r["odd"]
                if before or state:
                    self.crossing.append((path, r["start"]))
                written += r["n_bytes"] + r["n_lines"]
            head = next((r["head"] for r in own if not r["start"]), b"")
            odd = any(r["garbled"] for r in own) or looks_garbled(bytes(head).decode("utf-8", "replace")[:500])
            self.encoding[path] = "gb18030" if odd else "utf-8"
            # all lines but perhaps the last have an end; a byte-order mark of three bytes is not read
            self.line_end[path] = own[0]["size"] - written in (0, 3)


def _parser(layout, delimiter: str, only_pieces: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        held: list[bytes] = []
        state = size = n = opened = 0
        head = False

        def rows(lines: list[bytes]) -> list[tuple]:
            nonlocal n
            if only_pieces:
                found = parse_csv(b"\n".join(lines).decode(layout.value.encoding[now[0]], "replace"), delimiter)
                n += len(found)
                return []
            found = parse_csv(b"\n".join(lines).decode(layout.value.encoding[now[0]], "replace"), delimiter)
            out = [(*now, n + i, ROW, r, None) for i, r in enumerate(found)]
            n += len(found)
            return out

        def piece(kind: int, lines: list[bytes]) -> list[tuple]:
            return [(*now, n, kind, None, b"\n".join(lines))] if only_pieces else []

        def close() -> list[tuple]:
            if head:
                return piece(MIDDLE, held)
            if state:
                done = rows(held[:opened])
                return done + piece(TAIL, held[opened:])
            return rows(held)

        for path, start, _, lines in _by_split(batches):
            out: list[tuple] = []
            if (path, start) != now:
                out += close() if now else []
                now = (path, start)
                state = layout.value.states.get(path, {}).get(start, -1)
                if state < 0:
                    raise RuntimeError(f"{path} is split in another way than when its quotes were counted (at byte {start}); run the query again")
                held, size, n, opened, head = [], 0, 0, 0, bool(state)
            for line in lines:
                held.append(line)
                size += len(line)
                if line.count(b'"') & 1:
                    state ^= 1
                    if state:
                        opened = len(held) - 1
                    elif head:
                        out += piece(HEAD, held)
                        held, size, head = [], 0, False
                if size > FLUSH_BYTES and not state:
                    out += rows(held)
                    held, size = [], 0
            if out:
                yield _batch(out)
        out = close() if now else []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), _PARSED_TYPES)], names=[f.split()[0] for f in _PARSED.split(", ")])


def _joined(layout, delimiter: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, n, text, last in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "n", "text", "last"))):
                if last and layout.value.line_end[path]:
                    text += b"\n"  # an open quote at the end takes in the last line end
                found = parse_csv(text.decode(layout.value.encoding[path], "replace"), delimiter)
                if found:
                    yield _batch([(path, start, n + i, ROW, r, None) for i, r in enumerate(found)])

    return run


def read_csv(spark: SparkSession, path: str | list[str], delimiter: str = ",", glob: str | None = None) -> DataFrame:
    """Exact CSV or TSV grids, one source per file, files of any size.

    Rows are those of ``parse_csv`` over the whole decoded text. ``row_idx`` runs
    from 0 in a file of one split; later splits go on from their byte offset, so
    it grows with the row but has gaps there. An open quote takes in all that
    follows, as one cell. Compressed files are read by one task each. The
    layout of the splits must not change between counting and parsing; it can
    only where a small input is split by the number of cores, and then the query
    fails and says so.
    """
    lines = _lines(spark, path, glob)
    counts = lines.mapInArrow(_counted, _COUNTS).collect()  # one row per split
    if len(counts) > MOST_SPLITS:
        raise ValueError(f"{len(counts)} splits are more than {MOST_SPLITS}; raise spark.sql.files.maxPartitionBytes or read fewer files at once")
    found = Layout(counts)
    layout = spark.sparkContext.broadcast(found)
    whole = lines.mapInArrow(_parser(layout, delimiter, False), _PARSED).select("path", "start", "n", "cells")
    if found.crossing:
        at = F.broadcast(spark.createDataFrame(found.crossing, "path string, start long"))
        pieces = lines.join(at, ["path", "start"], "left_semi").select("path", "start", "size", "line").mapInArrow(_parser(layout, delimiter, True), _PARSED)
        # by record: a tail, the splits inside it and a head, which is all there is of the record
        record = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("path").orderBy("start", "kind_order").rowsBetween(Window.unboundedPreceding, 0))
        pieces = pieces.withColumn("kind_order", (F.col("kind") == TAIL).cast("int")).withColumn("record", record)
        parts = F.array_sort(F.collect_list(F.struct("start", "kind_order", "text")))
        texts = pieces.groupBy("path", "record").agg(F.min_by(F.struct("start", "n"), F.struct("start", F.lit(0) - F.col("kind_order"))).alias("at"), parts.alias("parts"), F.max(F.col("kind") == HEAD).alias("closed"))
        joined = F.aggregate(F.col("parts"), F.lit(None).cast("binary"), lambda a, p: F.when(a.isNull(), p["text"]).otherwise(F.concat(a, F.lit(b"\n"), p["text"])))
        texts = texts.select("path", "at.start", "at.n", joined.alias("text"), (~F.col("closed")).alias("last"))
        whole = whole.unionByName(texts.mapInArrow(_joined(layout, delimiter), _PARSED).select("path", "start", "n", "cells"))
    return whole.select(F.col("path").alias("source_id"), (F.col("start") + F.col("n")).alias("row_idx"), "cells").to(spark.createDataFrame([], GRID).schema)
