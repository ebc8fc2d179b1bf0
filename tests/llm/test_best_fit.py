"""Best-fit packing against the plain tokenizer and best fit over single documents."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tabulant.llm import best_fit
from tests.llm import cases
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    "a b", " a", "a ", "  a", "a  ", "a  b", "a   b", "a\nb", "a\n\nb", "a \n b", "\na", "a\n", "a\n b", "a \nb", "\n", " ", "\t", "a\tb", "a.b", "a. b", "a., b.", "it's. 's", "x.'s y", "don't.", "A.B,C", "1.5, 2.",
    "<|endoftext|>", "a <|endoftext|> b.", "x<|endoftext|>.y", "é ü.", "漢字 仮名。 x", "🙂 🙂.a", "a  b", "a  b", "a b", "a\x0b b", "a\x1fb c", "a\x1c b", "é. á b", "​ a", "a 　b", "a\x85 b", "...", "a...b", ".a", ",", "a\r\nb",
]


WHOLE = Tokenizer.from_file(PATH)


def plain_ids(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, best_fit.END_ID]


def test_segments_give_the_tokenizers_ids():
    r = random.Random(5)
    alphabet = ["a", "Bc", "the", " ", " ", "\n", ".", ",", "'s", "é", "1", "\t", " ", "!", "<|endoftext|>", "-"]
    texts = [None, "", *ODD] + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 25))) for _ in range(1500)]
    got = best_fit.SegmentIds(PATH)(pa.array(texts, type=pa.string()))
    for t, ids in zip(texts, got):
        assert ids.tolist() == plain_ids(t), repr(t)


def test_a_small_cache_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(best_fit, "CACHE_BYTES", 5_000)
    encode, r = best_fit.SegmentIds(PATH), random.Random(6)
    for _ in range(30):
        texts = [" ".join(r.choice(("the", "of.", f"w{r.randrange(300)},")) for _ in range(20)) for _ in range(5)]
        assert [ids.tolist() for ids in encode(pa.array(texts))] == [plain_ids(t) for t in texts]
        assert len(encode._known) < 200 and "the" in encode._known or " the" in encode._known


def brute_sequences(lengths, size):
    """Best fit in descending order, one piece at a time: the rooms left."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("size", [1, 7, 16, 50])
def test_the_plan_is_best_fit_over_documents(size):
    r = random.Random(size)
    for n in (0, 1, 5, 40, 300):
        lengths = [r.choice((r.randrange(1, size + 1), 1 + size // 3, size)) for _ in range(n)]
        histogram = {x: lengths.count(x) for x in set(lengths)}
        runs = best_fit.plan(histogram, size)
        filled, ranks = defaultdict(list), defaultdict(list)
        for length, a, b, first, offset, each in runs:
            for rank in range(a, b):
                ranks[length].append(rank)
                filled[first + (rank - a) // each].append((offset + (rank - a) % each * length, length))
        assert all(sorted(v) == list(range(histogram[k])) for k, v in ranks.items()) and set(ranks) == set(histogram)
        for places in filled.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size
        assert sorted(filled) == list(range(len(filled)))
        assert sorted(size - sum(x for _, x in v) for v in filled.values()) == brute_sequences(lengths, size)


def test_the_plan_does_not_grow_with_the_documents():
    r = random.Random(2)
    histogram = {n: r.randrange(1, 500) for n in range(1, 2049)}
    few, many = best_fit.plan(histogram), best_fit.plan({n: c * 1_000_003 for n, c in histogram.items()})
    assert len(many) < 2 * len(few) + 100 and len(many) < 3 * 2048 * 11
    tokens = sum(n * c * 1_000_003 for n, c in histogram.items())
    assert sum(-(-(b - a) // each) for n, a, b, _, offset, each in many if offset == 0) < 1.01 * tokens / 2048 + 1


def test_cuts():
    assert best_fit.cuts(1, 4) == [(0, 1)] and best_fit.cuts(4, 4) == [(0, 4)] and best_fit.cuts(5, 4) == [(0, 1), (1, 4)] and best_fit.cuts(12, 4) == [(0, 4), (4, 4), (8, 4)]


@pytest.mark.parametrize("size", [2048, 64])
def test_pieces_against_brute_force(spark, size):
    rows = cases.documents() + [(5000 + k, t, "en", "s", 0, 7, "x", 1, "k", 5, 9) for k, t in enumerate(ODD)] + [(6000 + k, "same words again", "en", "s", 0, 7, "x", 1, "k", 5, 9) for k in range(300)]
    got = best_fit.best_fit_pack(cases.frame(spark, rows).repartition(6), size=size, with_ids=True).collect()
    want, lengths = [], []
    for i, t, *_ in rows:
        ids = plain_ids(t)
        for k, (start, n) in enumerate(best_fit.cuts(len(ids), size)):
            own = np.array(ids[start : start + n], dtype="<u4")
            want.append((i, k, start, n, zlib.crc32(own.tobytes()), own.tolist()))
            lengths.append(n)
    assert sorted([(*tuple(r)[:5], r["ids"]) for r in got], key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(size - sum(x for _, x in v) for v in filled.values()) == brute_sequences(lengths, size)


def test_of_nothing(spark):
    got = best_fit.best_fit_pack(cases.frame(spark, []))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() == 0
