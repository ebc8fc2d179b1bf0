"""Centroid clustering against plain Python and SQL."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
from tabulant.llm import centroids
from tabulant.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k, rounds, dims, scale, seed=1):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    points = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        members = [[] for _ in points]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        points = [tuple(sum(x) // len(m) for x in zip(*m)) if m else p for p, m in zip(points, members)]
    found = [(i, *nearest(v)) for i, v in kept]
    whole, by = sum(d for _, d, _ in found), {}
    for _, d, c in found:
        by[c] = by.get(c, 0) + d
    return [(i, c, d, by[c], whole, hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, d, c in found]


def rows(seed=3, n=300, dims=4, span=6):
    """Few distinct values, so that distances tie and rows repeat; awkward vectors among them."""
    r = random.Random(seed)
    out = [(i, [r.randrange(-span, span) / 2 + r.choice((0.0, 0.25)) for _ in range(dims)]) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    out += [(900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [1.0] * (dims + 1)), (904, [None] + [1.0] * (dims - 1)), (905, [nan] * dims), (906, [inf] + [0.0] * (dims - 1))]
    return out + [(907, [-inf] + [0.0] * (dims - 1)), (None, [0.0] * dims), (None, [0.5] * dims), (1, out[1][1]), (1, out[2][1]), (908, [1000.0] * dims)] + [(2000 + i, [0.5] * dims) for i in range(150)]


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "x", 5) for r in data], "vec_id long, embedding array<double>, cluster int, n string, distance long").repartition(5)


@pytest.mark.parametrize(("k", "rounds", "scale"), [(16, 3, 64.0), (40, 2, 1.0), (3, 0, 2.0), (900, 1, 1.0)])
def test_against_brute_force(spark, k, rounds, scale):
    got = centroids.cluster_report(frame(spark, rows()), k=k, rounds=rounds, dims=4, scale=scale)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows(), k, rounds, 4, scale), key=str)


def test_of_nothing(spark):
    for data in ([], [(1, None), (2, [1.0])]):
        got = centroids.cluster_report(frame(spark, data), dims=4)
        assert got.columns == COLUMNS and got.count() == 0


def test_components_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="not below"):
        centroids.cluster_report(frame(spark, [(1, [1e30] * 4)]), dims=4).collect()


@pytest.mark.parametrize("span", [2, 5, 400])
def test_the_tree_finds_the_first_of_the_nearest(span):
    r = np.random.default_rng(span)
    for n in (1, 2, 4, 5, 9, 60, 200):
        points, vectors = r.integers(-span, span, (n, 5)), r.integers(-span, span, (500, 5))
        vectors[:50] = points[r.integers(0, n, 50)]
        far = ((vectors[:, None] - points[None]) ** 2).sum(axis=2)
        label, best = centroids.VantageTree(points).nearest(vectors)
        assert (label == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_the_tree_prunes(monkeypatch):
    """Points in tight groups: most distances are never taken."""
    r = np.random.default_rng(1)
    heart = r.integers(-100_000, 100_000, (16, 8))
    points = (heart[:, None] + r.integers(-50, 50, (16, 16, 8))).reshape(-1, 8)
    vectors = heart[r.integers(0, 16, 400)] + r.integers(-50, 50, (400, 8))
    tree, taken, plain = centroids.VantageTree(points), [], centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda a, b: taken.append(len(a)) or plain(a, b))
    label, _ = tree.nearest(vectors)
    assert (label == ((vectors[:, None] - points[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(taken) < 0.3 * len(points) * len(vectors)


def test_large_integers_stay_exact():
    top = centroids.largest_component(64) - 1
    points = np.full((9, 64), top)
    points[:, 0] -= np.arange(9)
    vectors = np.full((2, 64), -top)
    vectors[1] = points[7]
    label, best = centroids.VantageTree(points).nearest(vectors)
    assert label.tolist() == [8, 7] and best[0] == 63 * (2 * top) ** 2 + (2 * top - 8) ** 2 and best[1] == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")
def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    res = con.execute(ORACLE_SQL["op11_centroid_clustering"])
    assert [d[0] for d in res.description] == COLUMNS
    assert sorted(res.fetchall()) == sorted(map(tuple, QUERIES["op11_centroid_clustering"](spark, DATA).collect()))
