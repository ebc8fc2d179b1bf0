"""Jaccard join, LM scoring, mixing and packing against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from tabulant.llm import jaccard_join, lm_scoring, mixing, packing
from tabulant.llm.common import word_codes
from tests.llm import cases

W = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, n):
    w = W.findall(lower(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, p, q):
    sets = [shingles(t, n) for _, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            both = len(sets[a] & sets[b])
            if sets[a] and i is not None and j is not None and q * both >= p * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), None if i is None else (find(i) if s else i)) for (i, _), s in zip(rows, sets)]


@pytest.mark.parametrize(("n", "p"), [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, n, p):
    rows = cases.plain(cases.documents()) + hot_rows()
    got = [tuple(r) for r in jaccard_join.jaccard_components(cases.frame(spark, wide(rows)), n=n, p=p, q=100).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows, n, p, 100), key=str)


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_links(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW_LINKS", few)
    r = random.Random(8)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(25)] + [(k, k + 1) for k in range(100, 120)] + [(7, 7)]
    parent = {x: x for link in links if link[0] != link[1] for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    schema = "a long, b long"
    got = jaccard_join.components(spark.createDataFrame(links, schema))
    assert {n["node"]: n["comp"] for n in got.collect()} == {x: find(x) for x in parent}
    half = jaccard_join._joined_components(spark.createDataFrame([], "node long, comp long"), spark.createDataFrame(links[::2], schema))
    whole = jaccard_join._joined_components(half, spark.createDataFrame(links[1::2], schema))
    assert {n["node"]: n["comp"] for n in whole.collect() if n["node"] != 7} == {x: find(x) for x in parent if x != 7}
    assert jaccard_join._joined_components(whole, spark.createDataFrame([], schema)).count() == whole.count()


def wide(rows):
    return [(i, t, "en", "s", 0, 7, "x", 1, "k", 5, 9) for i, t in rows]


def hot_rows():
    """A large near-copy group, a passage shared by many unrelated texts, and small texts that differ in one word."""
    r = random.Random(9)
    base = [f"b{r.randrange(500)}" for _ in range(150)]
    out = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"c{r.randrange(50)}"
        out.append((2000 + k, " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(30))
    out += [(3000 + k, " ".join(f"q{r.randrange(300)}" for _ in range(40)) + " " + passage) for k in range(60)]
    short = [f"s{k}" for k in range(14)]
    out += [(4000 + k, " ".join(short + [f"e{k}"])) for k in range(4)] + [(4010, " ".join(short)), (4011, " ".join(short[:-1]))]
    return out


def test_similar_sets_share_a_signature():
    """The pigeonhole rule over all sizes: whatever pair is similar meets, common shingles or not."""
    r = np.random.default_rng(4)
    for p in (40, 50, 60, 80, 90):
        bands = jaccard_join.plan_bands(2000, {b: 50 for b in range(44)}, p, 100)
        lows = np.array([b.low for b in bands])
        assert p < 80 or bands[0].least == 0  # the smallest sets go by one-deletion neighbourhoods
        for size in [*range(2, 60), 99, 150, 333, 590]:
            for trial in range(6):
                a = r.integers(0, 2**63, size=size, dtype=np.uint64)
                most = jaccard_join.differing(size, p, 100)
                gone = int(r.integers(0, most + 1))
                b = np.concatenate([a[gone:], r.integers(0, 2**63, size=int(r.integers(0, most - gone + 1)), dtype=np.uint64)])
                a, b = np.unique(a), np.unique(b)
                both = len(np.intersect1d(a, b))
                if len(a) == both == len(b) or 100 * both < p * (len(a) + len(b) - both):
                    continue
                common = np.unique(a[r.random(len(a)) < trial / 5])
                x, y = (jaccard_join.signatures(s, bands, lows, common, p, 100) for s in (a, b))
                assert np.intersect1d(x, y).size, (p, size, len(b))


def family(seed, size, count, edits):
    """Texts around one base, many of them less than similar to it and to each other, and pairs of a text and its near copy."""
    r = random.Random(seed)
    base = [f"f{r.randrange(900)}" for _ in range(size)]
    out = []
    for k in range(count):
        w = list(base) if k % 3 or not out else out[-1].split(" ")
        for _ in range(r.randrange(*edits) if k % 3 else 1):
            w[r.randrange(len(w))] = f"g{r.randrange(40)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("n", "p", "edits"), [(3, 90, (2, 9))])
def test_large_families_are_whole(spark, monkeypatch, n, p, edits):
    """Groups beyond SMALL, entered anew by differences from their pivots, lose no link."""
    monkeypatch.setattr(jaccard_join, "SMALL", 10)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0.3)
    texts = family(1, 120, 70, edits) + family(2, 90, 45, edits) + [family(3, 60, 1, edits)[0] + " " + family(4, 70, 1, edits)[0]]
    texts += [f"{head} {family(5, 40, 1, (0, 1))[0]}" for head in family(6, 30, 40, (10, 30))]
    rows = list(enumerate(texts))
    got = [tuple(r) for r in jaccard_join.jaccard_components(cases.frame(spark, wide(rows)), n=n, p=p, q=100).collect()]
    want = brute_components(rows, n, p, 100)
    assert sorted(got) == sorted(want)
    assert 5 < len({c for _, _, c in want}) < len(rows) - 20


def test_overlapping_large_groups_are_one_family(spark, monkeypatch):
    """Near copies of one text that meet in many large groups are entered anew once, not once per group."""
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    written, materialise = [], jaccard_join.materialise

    def counted(df, label):
        out = materialise(df, label)
        if label == "met":
            written.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    r = random.Random(5)
    base, rows = [f"f{r.randrange(900)}" for _ in range(100)], []
    for k in range(300):
        w = list(base)
        for at in r.sample(range(100), min(12, 1 + int(r.expovariate(0.35)))):
            w[at] = f"g{r.randrange(4000)}"
        rows.append((k, " ".join(w)))
    got = [tuple(x) for x in jaccard_join.jaccard_components(cases.frame(spark, wide(rows)), n=3, p=90, q=100).collect()]
    assert sorted(got) == sorted(brute_components(rows, 3, 90, 100))
    assert sum(written) <= 60 * len(rows), written


def test_shared_keys_join_nothing(spark):
    """Sets that share a key, as if hashes had collided, are told apart on their words."""
    rows = cases.plain(cases.documents(seed=3, n=60)) + [(7000, "a b a b a b c"), (7001, "a b a b c"), (7002, "b c d e f g")]
    got = [tuple(r) for r in jaccard_join.jaccard_components(cases.frame(spark, wide(rows)), n=2, p=90, q=100, key_bits=4).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows, 2, 90, 100), key=str)


def test_differences_that_have_to_meet():
    """Of any similar pair that is not linked to the pivot as a whole, both enter a difference they share for each other's band."""
    r = np.random.default_rng(8)
    pivot = r.integers(0, 2**63, size=150, dtype=np.uint64)
    pool = r.integers(0, 2**63, size=60, dtype=np.uint64)

    def member(of, edits):
        kept = of[r.random(len(of)) > edits / len(of)]
        return np.unique(np.concatenate([kept, r.choice(pool, size=r.integers(0, edits + 1), replace=False)]))

    none, met = np.empty(0, dtype=np.uint64), 0
    for p in (50, 80, 90):
        for _ in range(400):
            a = member(pivot, int(r.integers(2, 40)))
            b = member(a, int(r.integers(1, 8)))
            similar = lambda x, y: 100 * len(np.intersect1d(x, y)) >= p * len(np.union1d(x, y))
            if not similar(a, b) or (similar(a, pivot) and similar(b, pivot)):
                continue
            found = []
            for s in (a, b):
                d = jaccard_join.differences(s, pivot, none)
                band = jaccard_join._difference_band(len(d))
                found.append((band, {x: set(d[:k].tolist()) for x, k in jaccard_join.entered_differences(len(d), len(s), len(pivot), similar(s, pivot), p, 100)}))
            (ba, xa), (bb, xb) = found
            assert xa.get(bb, set()) & xb.get(ba, set()), p
            met += 1
    assert met > 100


def test_sketches_bound_the_difference():
    r = np.random.default_rng(2)
    for size in (1, 5, 40, 300, 9000):
        a = r.integers(0, 2**63, size=size, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[: size - size // 7], r.integers(0, 2**63, size=size // 5, dtype=np.uint64)])
        assert jaccard_join.apart(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= len(np.setxor1d(a, b))
        assert jaccard_join.apart(jaccard_join.sketch(a), jaccard_join.sketch(a)) == 0


def test_join_of_nothing(spark):
    assert jaccard_join.jaccard_components(cases.frame(spark, [])).count() == 0
    assert jaccard_join.jaccard_components(cases.frame(spark, wide([(1, None), (2, "a"), (3, "b")]))).count() == 3


def test_near_duplicates_go(spark):
    rows = cases.plain(cases.documents()) + hot_rows()
    kept = jaccard_join.drop_near_duplicates(cases.frame(spark, wide(rows)))
    want = [i for i, _, c in brute_components(rows, 5, 80, 100) if i is None or i == c]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)
    assert kept.columns == cases.frame(spark, []).columns


# --- LM ---------------------------------------------------------------------


def brute_scores(rows, mass):
    toks = [[*W.findall(lower(t)), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    uni, bi, hist = Counter(), Counter(), Counter()
    for t, h in zip(toks, held):
        if not h:
            uni.update(t)
            bi.update(zip(["<s>", *t], t))
            hist["<s>"] += 1
    hist.update({w: c for w, c in uni.items() if w is not None})
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for (i, _), t, h in zip(rows, toks, held):
        base = sum(math.log10(p(w)) for w in t)
        score = sum(math.log10((bi[a, w] + mass * p(w)) / (hist[a] + mass)) for a, w in zip(["<s>", *t], t))
        out.append((str(i), h, len(t), sum(uni[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return sorted(out)


def test_scores_against_brute_force(spark):
    rows = cases.plain(cases.documents())
    got = sorted((str(r[0]), *tuple(r)[1:5], round(r[5], 6), round(r[6], 6)) for r in lm_scoring.score_texts(cases.frame(spark)).collect())
    assert got == brute_scores(rows, lm_scoring.MASS)


def test_model_is_a_distribution():
    """Over all words and the end, the arcs and the failure arc of a state sum to one, up to the unseen word's share."""
    coded = lm_scoring.Coded(pa.array(["a b a", "b"]))
    _, counts = coded.words(np.ones(2))
    codes, _, at = coded.pairs()
    n, v = counts[:-1].sum(), len(counts) - 1
    model = lm_scoring.Automaton(coded, counts, codes, np.bincount(at), n + 0.5 * (v + 1), 2.0)
    for state in (coded.begin, 0, 1):
        weights, _ = model.step(np.full(v, state), np.arange(v))
        missing = 10 ** model.failure[state] * 0.5 / (n + 0.5 * (v + 1))
        assert abs((10**weights).sum() + missing - 1) < 1e-9


def test_scores_of_nothing(spark):
    assert lm_scoring.score_texts(cases.frame(spark, [])).count() == 0


# --- mixing -----------------------------------------------------------------


def naive_schedule(sources):
    """The slots made anew: at each of them the released block with the earliest deadline, all sources looked at."""
    exact = {s: Fraction(repr(float(w))) for s, w, _ in sources}
    total, had, t, out = sum(exact.values()), Counter(), 0, []
    windows = {(s, k): (math.floor(k * total / exact[s]), math.ceil((k + 1) * total / exact[s])) for s, _, n in sources for k in range(n)}
    while any(had[s] < n for s, _, n in sources):
        found = []
        for s, _, n in sources:
            k = had[s]
            if k < n and windows[s, k][0] <= t:
                found.append((windows[s, k][1], s, k, windows[s, k][0]))
        if found:
            due, s, k, release = min(found)
            out.append((s, k, t, release, due))
            had[s] += 1
        t += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_schedule_deviates_by_less_than_a_block(seed):
    r = random.Random(seed)
    sources = [(f"s{k:02}", r.choice([r.random() + 0.05, r.random() ** 3 + 0.02, 3.0, 2**0.5]), r.randrange(0, 25)) for k in range((1, 2, 3, 5, 9, 14)[seed])]
    got = list(mixing.edf_schedule(sources))
    assert got == naive_schedule(sources)
    total = sum(Fraction(repr(w)) for _, w, _ in sources)
    for s, w, n in sources:
        share, slots = Fraction(repr(w)) / total, [t for x, _, t, _, _ in got if x == s]
        assert len(slots) == n
        for k, t in enumerate(slots):  # before and after each slot of its own; between them its share only grows
            assert k - share * t < 1 and share * t - k < 1 and abs(k + 1 - share * (t + 1)) < 1
    assert all(release <= t < due for _, _, t, release, due in got)


def test_weights_of_the_schedule():
    assert [s for s, *_ in mixing.edf_schedule([("a", 1 / 3, 2), ("b", 2 / 3, 4)])] == ["b", "a", "b", "b", "a", "b"]
    hot = list(mixing.edf_schedule([("hot", 0.5, 500), *[(f"s{k}", 0.5 / 400, 1) for k in range(400)]]))
    assert sum(s == "hot" for s, *_ in hot[:600]) in range(299, 302)
    far = pa.RecordBatch.from_pylist([{"_stream": "va", "_weight": 1.0, "_blocks": 3}, {"_stream": "vb", "_weight": 1e-300, "_blocks": 2}])
    with pytest.raises(ValueError, match="far apart"):
        list(mixing._schedule(iter([far])))
    assert list(mixing._schedule(iter([]))) == []


def test_given_weights_are_exact_over_many_slots(spark):
    rows = [(k, "x", "en", "ab"[k % 3 > 0], 1, 7, "x", 1, "k", 5, 9) for k in range(6000)]
    got = mixing.mixing_schedule(cases.frame(spark, rows), weights={"a": 1 / 3, "b": 2 / 3}, block_rows=2).collect()
    assert len({r["slot"] for r in got}) == 3000
    assert max(deviation(got, "a", Fraction(1, 3)), deviation(got, "b", Fraction(2, 3))) < 1


def test_mixing_schedules_every_row_once(spark):
    rows = cases.documents()
    got = mixing.mixing_schedule(cases.frame(spark), block_rows=4, chunk_rows=30).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)
    by = defaultdict(list)
    for r in got:
        assert r["release"] <= r["slot"] < r["deadline"]
        by[r["source"]].append((r["block"], r["place"], r["slot"]))
    for own in by.values():
        own.sort()
        assert [b * 4 + p for b, p, _ in own] == list(range(len(own)))
        assert [s for *_, s in own] == sorted(s for *_, s in own)


def deviation(got, source, weight):
    """Of the blocks had after each slot from weight times slots, while the source lasts."""
    slots = sorted({r["slot"] for r in got if r["source"] == source})
    return max(max(abs(k - weight * t), abs(k + 1 - weight * (t + 1))) for k, t in enumerate(slots))


@pytest.mark.parametrize("given", [True, False])
def test_every_source_has_its_own_slots_at_any_number(spark, given):
    sizes = {"hot": 400, **{f"s{k}": 8 + k % 5 for k in range(60)}}
    names = [s for s, n in sizes.items() for _ in range(n)]
    rows = [(k, "t", "en", s, 0, 7, "x", 1, "k", 5, 9) for k, s in enumerate(names)]
    weights = {"hot": 60.0, **{s: 1.0 for s in sizes if s != "hot"}} if given else None
    got = mixing.mixing_schedule(cases.frame(spark, rows), weights=weights, block_rows=4, chunk_rows=100).collect()
    assert Counter(r["source"] for r in got) == sizes and len({(r["slot"], r["place"]) for r in got}) == len(got)
    target = weights or {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    exact = {s: Fraction(repr(w)) for s, w in target.items()}
    for s in sizes:
        assert deviation(got, s, exact[s] / sum(exact.values())) < 1
    want = {(s, k): t for s, k, t, _, _ in naive_schedule([("v" + s, target[s], -(-n // 4)) for s, n in sizes.items()])}
    assert {("v" + r["source"], r["block"]): r["slot"] for r in got} == want


def test_weights_have_to_name_every_source(spark):
    with pytest.raises(ValueError, match="no positive target weight"):
        mixing.mixing_schedule(cases.frame(spark), weights={"a": 1.0, "b": 0.0})


def test_mixed_keeps_rows_and_order(spark):
    rows = [(k, f"t{k}", "en", ("a", "b")[k % 4 == 0], 0, 7, "x", 1, "k", 5, 9) for k in range(400)]
    out = mixing.mixed(cases.frame(spark, rows), weights={"a": 3.0, "b": 1.0}, block_rows=5)
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400)) and out.columns == cases.frame(spark, []).columns
    first = Counter(r["source"] for r in got[:200])
    assert abs(first["b"] - 50) <= 5
    assert mixing.mixed(cases.frame(spark, [])).count() == 0
    assert mixing.mixing_schedule(cases.frame(spark, [])).count() == 0


# --- packing ----------------------------------------------------------------


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = cases.plain(cases.documents())
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in rows)
    got = packing.pack_documents(cases.frame(spark)).collect()
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    single = {i: ids for (i, ids), c in want.items() if sum(v for (j, _), v in want.items() if j == i) == 1}
    for i, ids in single.items():
        at = 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    assert sum(r["length"] for r in got) == sum(len(ids) * c for (_, ids), c in want.items())
    assert packing.pack_documents(cases.frame(spark, [])).count() == 0


def test_costs_are_balanced():
    r = random.Random(2)
    lengths = [int(r.lognormvariate(5.5, 1)) + 1 for _ in range(3000)]
    cost = defaultdict(float)
    for _, _, n, seq, _ in packing.pack(lengths):
        cost[seq] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [cost[s] for s, c in enumerate(packing.capacities(sum(lengths))) if c == 4096]
    assert np.std(full) < 0.35 * np.mean(full)


def test_words_of_sliced_arrays():
    texts = ["Ab c", "", None, " d\te ", "é x" * 3]
    words, codes, offsets = word_codes(pa.array(texts).slice(1))
    assert [[words[int(k)].as_py() for k in codes[a:b]] for a, b in zip(offsets, offsets[1:])] == [W.findall(t or "") for t in texts[1:]]
