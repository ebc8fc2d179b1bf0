"""Cost-balanced packing of documents into token sequences.

A sequence's cost is estimated as ``LINEAR * tokens + QUADRATIC * sum of squared
piece lengths`` (attention stays within a piece). Documents are taken by
descending cost; each goes to the lowest-cost sequence with room for it, or, if
none has room, is cut at what is left of the cheapest one.

Work is dealt in blocks of about ``BLOCK_TOKENS`` tokens that a task packs as it
reads, so memory is bounded, nothing is shuffled, and a lost task is done again
alone. A block of T tokens gets T // 4096 sequences of 4096 tokens and one
sequence for each binary digit of the rest. Capacity is exactly T, so every
sequence is full: 4096 tokens, or a power of two, and none needs padding.

Documents whose order matters are packed in windows of ``WINDOW_TOKENS``, some
32 sequences. A window's last document is cut so that the window is full, and
goes on in the next one, so windows follow each other like the documents do;
only the end of a task has shorter sequences. Numbered by partition and window,
any run of first sequences holds the first documents, give or take one window.

Words are tokenised once per batch and remembered in a bounded cache that a
worker keeps: the vocabulary's splitter lower-cases, never joins characters
across white space, and always cuts between a letter or digit and a full stop or
comma, so a text's ids are those of its lower-cased, so cut words in a row.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import lowered, text_parts, word_codes

SIZE = 4096
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
BLOCK_TOKENS = 4_000_000
#: About what one slot of a mixing schedule holds; a multiple of SIZE.
WINDOW_TOKENS = 32 * SIZE
BATCH_BYTES = 10_000_000
CACHE_WORDS = 500_000
_CUT = r"([a-z0-9])([.,]+)"

_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, size: int = SIZE) -> list[int]:
    full, rest = divmod(total, size)
    return [size] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class _Open:
    """Sequences with room, by room: the cheapest with at least so much, in log(size) steps."""

    def __init__(self, room: list[int], size: int):
        self._leaves = 1 << size.bit_length()
        self._by_room: dict[int, list[tuple[float, int]]] = {}
        self._least = [_NONE] * (2 * self._leaves)
        for s, r in enumerate(room):
            self._by_room.setdefault(r, []).append((0.0, s))
        for r in self._by_room:
            self._update(r)

    def _update(self, r: int) -> None:
        own, least = self._by_room[r], self._least
        at = r + self._leaves
        least[at] = own[0] + (r,) if own else _NONE
        while at > 1:
            at >>= 1
            least[at] = min(least[2 * at], least[2 * at + 1])

    def add(self, cost: float, seq: int, room: int) -> None:
        heapq.heappush(self._by_room.setdefault(room, []), (cost, seq))
        self._update(room)

    def take(self, least_room: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest with room enough, or None."""
        low, high, best = least_room + self._leaves, 2 * self._leaves, _NONE
        while low < high:
            if low & 1:
                best = min(best, self._least[low])
                low += 1
            low, high = low >> 1, high >> 1  # the range's end is a power of two
        if best is _NONE:
            return None
        heapq.heappop(self._by_room[best[2]])
        self._update(best[2])
        return best


_NONE = (float("inf"), 0, 0)


def pack(lengths: list[int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece."""
    room = capacities(sum(lengths), size)
    filled = [0] * len(room)
    open_ = _Open(room, size)
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left, start = lengths[item], 0
        while left:
            cost, seq, free = (open_.take(left) if left <= size else None) or open_.take(1)
            n = min(left, free)
            out.append((item, start, n, seq, filled[seq]))
            filled[seq] += n
            start += n
            left -= n
            if n < free:
                open_.add(cost + LINEAR * n + QUADRATIC * n * n, seq, free - n)
    return out


class WordIds:
    """Token ids of texts by way of their distinct words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        self._ids = np.array([END_ID], dtype=np.uint32)  # entry 0 is the end of a document
        self._first = np.array([0], dtype=np.int64)
        self._count = np.array([1], dtype=np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each document closed by END_ID, and the offsets by document."""
        if len(self._known) > CACHE_WORDS:
            self._clear()
        words, codes, offsets = word_codes(pc.replace_substring_regex(lowered(texts), _CUT, r"\1 \2"))
        words = words.to_pylist()
        new = [w for w in words if w not in self._known]
        if new:
            found = [e.ids for e in self._tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            base = len(self._first)
            self._known.update(zip(new, range(base, base + len(new))))
            self._first = np.concatenate([self._first, len(self._ids) + np.cumsum(counts) - counts])
            self._count = np.concatenate([self._count, counts])
            self._ids = np.concatenate([self._ids, np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(counts.sum()))])
        entry = np.fromiter((self._known[w] for w in words), dtype=np.int64, count=len(words))
        entries = np.insert(entry[codes] if len(codes) else np.empty(0, dtype=np.int64), offsets[1:], 0)
        doc_ends = offsets[1:] + np.arange(1, len(offsets))
        counts = self._count[entries]
        ends = np.cumsum(counts)
        at = np.repeat(self._first[entries] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self._ids[at], np.concatenate([[0], ends[doc_ends - 1]])


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordIds:
    """One per worker, so tasks share what it has learnt."""
    return WordIds(path)


def _packer(tokenizer_path: str, in_order: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        schema = pa.schema([(c.split()[0], pa.int64()) for c in _OUT.split(", ")])
        names: list[int | None] = []
        texts: list[np.ndarray] = []
        starts: list[int] = []
        sizes: list[int] = []
        held, first = 0, part << 36
        most = WINDOW_TOKENS if in_order else BLOCK_TOKENS

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal first, held
            rest = held % SIZE if in_order and not last else 0
            on = None
            if rest:  # the last text reaches beyond the window by less than its length
                keep = len(texts[-1]) - rest
                on = (names[-1], texts[-1][keep:], starts[-1] + keep, sizes[-1])
                texts[-1] = texts[-1][:keep]
                held -= rest
            rows = []
            for item, start, n, seq, offset in pack([len(t) for t in texts]):
                crc = zlib.crc32(texts[item][start : start + n].astype("<u4").tobytes())
                rows.append((names[item], starts[item] + start, n, crc, sizes[item], first + seq, offset))
            first += len(capacities(held))
            for kept in (names, texts, starts, sizes):
                kept.clear()
            held = rest
            if on:
                for kept, value in zip((names, texts, starts, sizes), on):
                    kept.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], schema=schema)

        for batch in batches:
            for piece in text_parts(batch, "text", BATCH_BYTES):
                ids, offsets = encode(piece.column("text"))
                for name, a, b in zip(piece.column("doc_id").to_pylist(), offsets[:-1], offsets[1:]):
                    names.append(name)
                    texts.append(ids[a:b])
                    starts.append(0)
                    sizes.append(int(b - a))
                    held += int(b - a)
                    if held >= most:
                        yield flush(False)
        if held:
            yield flush(True)

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, in_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the one end token. Null and repeated ids are kept
    as they are, each row a document of its own; ids must be integers. A
    sequence is one task's (its number is in the upper bits of ``sequence_id``).
    With ``in_order``, ``docs`` must be sorted over its partitions; sequences are
    then numbered in that order, and all before a sequence hold the rows before
    its own but for one window. An empty table gives an empty result.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_packer(str(tokenizer_path), in_order), _OUT)
