"""Centroid clustering against Lloyd rounds over every pair in Python's integers."""

import hashlib
import math
import random

import numpy as np

from shelfledger.llm import ptolemaic_clusters as P
from shelfledger.llm import queries as Q

SCHEMA = "vec_id long, embedding array<double>, cluster string, near int"


def brute(rows, clusters=P.CLUSTERS, rounds=P.ROUNDS):
    kept = [(i, [math.floor(64 * v) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in order[:clusters]]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((dist(x, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, x in kept:
            own.setdefault(nearest(x)[1], []).append(x)
        for k, xs in own.items():
            centroids[k] = [sum(col) // len(xs) for col in zip(*xs)]
    last = [(i, *nearest(x)) for i, x in kept]
    of = {}
    for _, d, k in last:
        of[k] = of.get(k, 0) + d
    name = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    return sorted(((i, k, d, of[k], sum(of.values()), name(k)) for i, d, k in last), key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], SCHEMA)
    got = sorted((tuple(r) for r in P.cluster(df).collect()), key=repr)
    assert got == brute(rows)
    return got


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], [float(v) for v in r["embedding"]]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in Q.QUERIES["op12_ptolemaic_clusters"](spark, folder).collect()), key=repr) == brute(rows)


def test_odd_vectors(spark):
    rng = random.Random(6)
    vector = lambda: [rng.choice([rng.gauss(0, 1), 0.0, -1 / 64]) for _ in range(64)]
    same = vector()
    rows = [(i, vector()) for i in range(60)] + [(100 + i, same) for i in range(80)] + [(7, same), (7, vector()), (None, vector())]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [0.0] * 63), (205, [float("nan")] * 64),
             (206, [float("inf")] + [0.0] * 63), (207, [0.0] * 64), (208, [-0.0] * 64)]
    got = check(spark, rows)
    assert len(got) == 60 + 80 + 3 + 2
    assert len(check(spark, [(1, same), (2, vector()), (3, same)])) == 3
    assert len(check(spark, [(1, [1e7 + j for j in range(64)]), (2, [-1e7] * 64), (3, [3e6] * 64)])) == 3  # beyond what numpy's squares hold
    assert P.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.cluster(spark.createDataFrame([(1, [1.0], "", 0)], SCHEMA)).count() == 0
    assert P.cluster(spark.createDataFrame([(None, same, "", 0), (None, vector(), "", 0)], SCHEMA)).count() == 2


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 64)) * 300
    x = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 64)) * 10).astype(np.int64)
    c = np.floor(centres).astype(np.int64)
    pivots = P.Pivots(c[:P.PIVOTS])
    near = pivots.distances(x)
    exact = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (pivots.bounds(near, pivots.distances(c)) <= exact).all()
    own, least, taken = P.nearest(x, near, c, pivots)
    assert (own == exact.argmin(1)).all() and (least == exact.min(1)).all()
    assert taken < 0.3 * exact.size
    tied = np.concatenate([c, c])  # equal centroids: the smaller number
    assert (P.nearest(x, near, tied, pivots)[0] < 16).all()
