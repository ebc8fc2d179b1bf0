"""Language-model scoring with a weighted backoff automaton.

The model has a state for every word seen in training (and one for the start of
a text). With Dirichlet smoothing of mass ``MASS``

    p(w | h) = (c(h w) + MASS p(w)) / (c(h) + MASS),   p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

a seen pair h w is an arc of h with weight log p(w | h). All other words leave h
by its failure arc, of weight log(MASS / (c(h) + MASS)), to the empty state, whose
arcs weigh log p(w). A text is scored in one traversal from left to right that
carries the state and adds up weights.

No machine holds the model. Documents are dealt by hash into blocks of bounded
size. A block asks for the counts of its distinct words and pairs: one packed row
per hash bucket. A bucket sums the training counts of all blocks and answers in
the order asked. With the answers, the block builds the part of the automaton
that its texts can reach and traverses them. The texts' exchange serves both
times. Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import lowered, mix64, partitions, word_codes

MASS = 2.0
HELD_OUT = 1
BLOCK_BYTES = 16 << 20
#: Blocks may be smaller than that to give each shuffle partition one, but not below this.
LEAST_BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 24 << 20
_G = np.uint64(0x9E3779B97F4A7C15)
# Names that no word can have, since words hold no space.
_END, _BEGIN = " end", " begin"


def _key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Coded:
    """The tokens of some texts: codes into ``keys``, each text closed by the end token."""

    def __init__(self, texts: pa.Array):
        words, codes, offsets = word_codes(lowered(texts))
        n = len(words)
        self.end, self.begin = n, n + 1
        self.keys = np.fromiter((_key(w) for w in [*words.to_pylist(), _END, _BEGIN]), dtype=np.uint64, count=n + 2)
        self.tokens = np.insert(codes, offsets[1:], self.end)
        self.starts = offsets[:-1] + np.arange(len(offsets) - 1)
        self.lengths = np.diff(offsets) + 1

    def histories(self) -> np.ndarray:
        before = np.roll(self.tokens, 1)
        before[self.starts] = self.begin
        return before

    def words(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and training counts of the words, the end and the start."""
        counts = np.bincount(self.tokens, weights=np.repeat(train, self.lengths), minlength=len(self.keys))
        counts[self.begin] = train.sum()
        return self.keys, counts

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (history, word) as codes, their keys, and the pair at each token."""
        codes, at = np.unique(self.histories() * len(self.keys) + self.tokens, return_inverse=True)
        h, w = np.divmod(codes, len(self.keys))
        return codes, mix64(self.keys[h] * _G + mix64(self.keys[w])), at


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by (bucket, key), the same for any order of the texts, and the runs (bucket, from, to)."""
    place = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, place))
    place = place[order]
    cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, dtype=np.int64)
    return order, [(int(place[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], len(place)])]


def _packed(counts: np.ndarray) -> bytes:
    kind = np.uint8 if counts.max(initial=0) < 1 << 8 else np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
    return counts.astype(kind).tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    kind = {1: np.uint8, 4: np.uint32, 8: np.uint64}[len(blob) // n]
    return np.frombuffer(blob, dtype=kind).astype(np.int64)


_ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("grams", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ASKED_DDL = "block long, bucket long, grams int, keys binary, counts binary"
_ANSWERED_DDL = "block long, bucket long, grams int, counts binary"
_SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def _single(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _train(held: pa.Array) -> np.ndarray:
    return (~held.to_numpy(zero_copy_only=False).astype(bool)).astype(np.float64)


def _ask(buckets: int):
    def run(block: pa.Table) -> pa.Table:
        coded, train = Coded(_single(block.column("text"))), _train(_single(block.column("held_out")))
        number = block.column("block")[0].as_py()
        keys, counts = coded.words(train)
        _, pair_keys, at = coded.pairs()
        pair_counts = np.bincount(at, weights=np.repeat(train, coded.lengths))
        rows = []
        for grams, k, c in ((1, keys, counts), (2, pair_keys, pair_counts)):
            order, runs = _dealt(k, buckets)
            k, c = k[order], c[order].astype(np.int64)
            rows += [(number, bucket, grams, k[a:b].tobytes(), _packed(c[a:b])) for bucket, a, b in runs]
        return _rows(rows, _ASKED)

    return run


def _answer(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    out = []
    for grams in (1, 2):
        own = [r for r in rows if r["grams"] == grams]
        if not own:
            continue
        keys = [np.frombuffer(r["keys"], dtype=np.uint64) for r in own]
        counts = [_unpacked(r["counts"], len(k)) for r, k in zip(own, keys)]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)[at]
        ends = np.cumsum([len(k) for k in keys])
        out += [(r["block"], r["bucket"], grams, _packed(part)) for r, part in zip(own, np.split(total, ends[:-1]))]
    return _rows(out, pa.schema([_ASKED.field("block"), _ASKED.field("bucket"), _ASKED.field("grams"), _ASKED.field("counts")]))


class Automaton:
    """The states, arcs and failure arcs that the words of a block can reach."""

    def __init__(self, coded: Coded, counts: np.ndarray, pair_codes: np.ndarray, pair_counts: np.ndarray, total: float, mass: float):
        self._width = len(coded.keys)
        self.empty = np.log10((counts + 0.5) / total)
        self.failure = math.log10(mass) - np.log10(counts + mass)
        seen = pair_counts > 0
        self.arcs = pair_codes[seen]  # sorted: (state, word) as one number
        h, w = np.divmod(self.arcs, self._width)
        self.weights = np.log10((pair_counts[seen] + mass * 10 ** self.empty[w]) / (counts[h] + mass))

    def step(self, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of reading one word in each state, and the states reached."""
        wanted = states * self._width + words
        at = np.minimum(np.searchsorted(self.arcs, wanted), max(0, len(self.arcs) - 1))
        found = self.arcs[at] == wanted if len(self.arcs) else np.zeros(len(wanted), dtype=bool)
        weight = self.failure[states] + self.empty[words]
        weight[found] = self.weights[at[found]]
        return weight, words

    def traverse(self, coded: Coded) -> np.ndarray:
        """Log-probabilities of the texts: all are read left to right side by side, each carrying its state."""
        order = np.argsort(-coded.lengths, kind="stable")
        starts, lengths = coded.starts[order], coded.lengths[order]
        states = np.full(len(order), coded.begin)
        score = np.zeros(len(order))
        running = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
        for t, n in enumerate(running):
            weight, states = self.step(states[:n], coded.tokens[starts[:n] + t])
            score[:n] += weight
        out = np.empty(len(order))
        out[order] = score
        return out


def _score(buckets: int, total: float, mass: float):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, held = _single(block.column("doc_id")), _single(block.column("held_out"))
        coded = Coded(_single(block.column("text")))
        by = {(r["grams"], r["bucket"]): r["counts"] for r in answers.to_pylist()}

        def counts_of(grams: int, keys: np.ndarray) -> np.ndarray:
            order, runs = _dealt(keys, buckets)
            out = np.empty(len(keys), dtype=np.int64)
            for bucket, a, b in runs:
                out[order[a:b]] = _unpacked(by[grams, bucket], b - a)
            return out

        pair_codes, pair_keys, _ = coded.pairs()
        counts = counts_of(1, coded.keys)
        model = Automaton(coded, counts, pair_codes, counts_of(2, pair_keys), total, mass)
        known = np.add.reduceat((counts[coded.tokens] > 0).astype(np.int64), coded.starts)
        base = np.add.reduceat(model.empty[coded.tokens], coded.starts)
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": coded.lengths.astype(np.int64), "n_known": known, "base_score": base, "score": model.traverse(coded)})

    return run


def _count(buckets: int):
    """Distinct training words of each batch of texts, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coded = Coded(batch.column("text"))
                keys, counts = coded.words(_train(batch.column("held_out")))
                keys, counts = keys[:-1], counts[:-1].astype(np.int64)
                keys, counts = keys[counts > 0], counts[counts > 0]
                order, runs = _dealt(keys, buckets)
                k, c = keys[order], counts[order]
                table = _rows([(0, bucket, 1, k[a:b].tobytes(), _packed(c[a:b])) for bucket, a, b in runs], _ASKED)
                yield from table.combine_chunks().to_batches()

    return run


def _total(asked: pa.Table) -> pa.Table:
    rows = asked.to_pylist()
    keys = [np.frombuffer(r["keys"], dtype=np.uint64) for r in rows]
    n = sum(int(_unpacked(r["counts"], len(k)).sum()) for r, k in zip(rows, keys))
    return pa.table({"n": [n], "v": [len(np.unique(np.concatenate(keys)))]})


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mass: float = MASS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32 of the id as text leaves 1 modulo 5 are held out of
    training; a null id trains. A null or empty text is the end token alone.
    Repeated rows count, and are scored, each time. An empty table gives an
    empty result. Without any training token every probability is 1 / 1.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", held.alias("held_out"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fewest, most = math.ceil(size / BLOCK_BYTES), math.ceil(size / LEAST_BLOCK_BYTES)
    blocks = max(1, fewest, min(partitions(spark), most))
    # Words are some six bytes, and a block asks for less than 12 bytes per token in all.
    buckets = max(1, min(partitions(spark), most), math.ceil(2 * size / BUCKET_BYTES))
    facts = rows.select("held_out", "text").mapInArrow(_count(buckets), _ASKED_DDL).groupBy("bucket").applyInArrow(lambda t: _total(t), "n long, v long")
    n, v = facts.agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    total = n + 0.5 * (v + 1)

    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    blocked = rows.select("doc_id", "held_out", "text", number).repartition(blocks, "block")
    asked = blocked.groupBy("block").applyInArrow(_ask(buckets), _ASKED_DDL)
    answers = asked.groupBy("bucket").applyInArrow(lambda t: _answer(t), _ANSWERED_DDL)
    scored = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(buckets, total, mass), _SCORED_DDL)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
