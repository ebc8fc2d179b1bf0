"""Best-fit packing planned on the histogram of lengths.

1. One pass tokenises the texts, cuts those longer than a sequence, and numbers
   the pieces of each length within their task. Only light rows are written.
2. The histogram of lengths has at most ``size`` rows. Best fit in descending
   order runs over its counts: a step places a run of pieces of one length in a
   range of sequences of equal room, so the number of steps depends on ``size``
   and not on the number of documents (a range that takes pieces of some length
   keeps less than half its room, so it is taken up at most log2(size) times).
3. A piece's rank within its length is its number within its task plus the pieces
   of that length in the tasks before. Pieces join the plan on length and rank.

The joins carry no texts. A length that holds many rows is spread over the tasks
that read them; the plan is broadcast, being bounded by ``size``.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulant.llm.common import compact, materialise, text_parts

SIZE = 2048
END_ID = 0
BATCH_BYTES = 8_000_000
#: Bytes of distinct segments that a worker remembers.
CACHE_BYTES = 64_000_000
#: What a remembered segment takes besides its text, about.
ENTRY_BYTES = 200
_MARK = "\x1f"
#: White space next to white space: which characters go together then depends on more than one word.
_RUNS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}|\x1F"


class SegmentIds:
    """Token ids of texts by way of their distinct segments.

    The vocabulary's splitter takes a single space with what follows it, a single
    line end by itself, and never joins a letter with a full stop or comma. Texts
    are cut at these places, and each distinct segment is tokenised once. Texts
    that hold runs of white space are tokenised whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, int] = {}
        self._bytes = 0
        self._ids = np.array([END_ID], dtype=np.uint32)  # entry 0 is the end of a document
        self._first = np.array([0], dtype=np.int64)
        self._count = np.array([1], dtype=np.int64)
        self._uses = np.array([0], dtype=np.int64)  # batches that had the segment

    def _trim(self) -> None:
        """Forgets the segments that fewest batches had, until half of the room is free."""
        order = np.argsort(-self._uses[1:], kind="stable") + 1
        names = np.empty(len(self._first), dtype=object)
        for s, i in self._known.items():
            names[i] = s
        sizes = np.array([len(names[i]) + ENTRY_BYTES for i in order])
        kept = np.concatenate([[0], order[: int(np.searchsorted(np.cumsum(sizes), CACHE_BYTES // 2))]])
        counts = self._count[kept]
        ends = np.cumsum(counts)
        self._ids = self._ids[np.repeat(self._first[kept] - (ends - counts), counts) + np.arange(int(ends[-1]))]
        self._first, self._count, self._uses = ends - counts, counts, self._uses[kept] // 2
        self._known = {names[i]: k for k, i in enumerate(kept.tolist()) if k}
        self._bytes = sum(len(s) + ENTRY_BYTES for s in self._known)

    def _learn(self, segments: list[str]) -> None:
        new = [s for s in segments if s not in self._known]
        if new:
            found = [e.ids for e in self._tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            base = len(self._first)
            self._known.update(zip(new, range(base, base + len(new))))
            self._first = np.concatenate([self._first, len(self._ids) + np.cumsum(counts) - counts])
            self._count = np.concatenate([self._count, counts])
            self._ids = np.concatenate([self._ids, np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(counts.sum()))])
            self._uses = np.concatenate([self._uses, np.zeros(len(new), dtype=np.int64)])
            self._bytes += sum(map(len, new)) + ENTRY_BYTES * len(new)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids, closed by END_ID; a null text is empty."""
        texts = pc.fill_null(compact(texts), "")
        runs = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(texts)
        whole = np.flatnonzero(runs)
        if len(whole):
            for i, e in zip(whole.tolist(), self._tokenizer.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)):
                out[i] = np.array([*e.ids, END_ID], dtype=np.uint32)
        plain = np.flatnonzero(~runs)
        if len(plain):
            for i, ids in zip(plain.tolist(), self._by_segments(texts.take(pa.array(plain)))):
                out[i] = ids
        return out

    def _by_segments(self, texts: pa.Array) -> list[np.ndarray]:
        if self._bytes > CACHE_BYTES:
            self._trim()
        cut = pc.replace_substring(pc.replace_substring(texts, " ", _MARK + " "), "\n", f"{_MARK}\n{_MARK}")
        split = pc.split_pattern(pc.replace_substring_regex(cut, r"([A-Za-z])([.,])", rf"\1{_MARK}\2"), _MARK)
        flat, offsets = split.flatten(), split.offsets.to_numpy()
        coded = flat.dictionary_encode()
        segments = coded.dictionary.to_pylist()
        self._learn(segments)
        entry = np.fromiter((self._known[s] for s in segments), dtype=np.int64, count=len(segments))
        self._uses[entry] += 1
        codes = coded.indices.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        entries = np.insert(entry[codes] if len(codes) else np.empty(0, dtype=np.int64), offsets[1:], 0)
        counts = self._count[entries]
        ends = np.cumsum(counts)
        at = np.repeat(self._first[entries] - (ends - counts), counts) + np.arange(int(ends[-1]))
        bounds = ends[offsets[1:] + np.arange(len(offsets) - 1)]
        return np.split(self._ids[at], bounds[:-1])


@lru_cache(maxsize=1)
def _encoder(path: str) -> SegmentIds:
    """One per worker, so tasks share what it has learnt."""
    return SegmentIds(path)


def cuts(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences behind a first piece that may be shorter."""
    first = length % size or size
    return [(0, min(first, length))] + [(start, size) for start in range(first, length, size)]


def _cutter(tokenizer_path: str, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in batches:
            for rows in text_parts(batch, "text", BATCH_BYTES):
                out: list[tuple] = []
                slices = []
                for name, ids in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text"))):
                    for k, (start, n) in enumerate(cuts(len(ids), size)):
                        own = ids[start : start + n]
                        out.append((name, k, start, n, zlib.crc32(own.astype("<u4").tobytes()), part, seen[n]))
                        seen[n] += 1
                        if with_ids:
                            slices.append(own)
                columns = [pa.array(c, type=t) for c, t in zip(zip(*out), _TYPES)]
                if with_ids:
                    columns.append(pa.array(slices, type=pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*_NAMES, *["ids"] * with_ids])

    return run


_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth")
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _nth long"
_RUN = "length long, _from long, _to long, _sequence long, _offset long, _each long"


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: runs (length, from rank, to rank, first sequence, offset there, pieces in each sequence)."""
    ranges: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, how many)
    rooms: list[int] = []  # those that have sequences, ascending
    runs: list[tuple[int, int, int, int, int, int]] = []
    used = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, n = size, used, -(-left // (size // length))
                used += n
            each = room // length
            for sequences, pieces in ((min(n, left // each), each), (1, left % each)):
                if n and sequences and pieces:
                    runs.append((length, rank, rank + sequences * pieces, first, size - room, pieces))
                    put(room - pieces * length, first, sequences)
                    rank, left, first, n = rank + sequences * pieces, left - sequences * pieces, first + sequences, n - sequences
            put(room, first, n)
    return runs


def best_fit_pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, size: int = SIZE, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A null or empty text is the one end token. Null and repeated ids are kept as
    they are, each row a document of its own; ids must be integers. Documents of
    more than ``size`` tokens, and no others, are cut. An empty table gives an
    empty result.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = _PIECES + ", ids array<long>" * with_ids
    pieces = materialise(rows.mapInArrow(_cutter(str(tokenizer_path), size, with_ids), schema), "packing-pieces")
    counts = materialise(pieces.groupBy("length", "_part").agg(F.count("*").alias("_n")), "packing-lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    runs = F.broadcast(docs.sparkSession.createDataFrame(plan(histogram, size), _RUN))
    ranked = pieces.join(starts, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    placed = ranked.join(runs, (ranked["length"] == runs["length"]) & F.col("_rank").between(F.col("_from"), F.col("_to") - 1)).drop(runs["length"])
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + (nth % F.col("_each")) * F.col("length")).alias("offset"),
        *["ids"] * with_ids,
    )
