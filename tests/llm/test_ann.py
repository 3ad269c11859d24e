"""Nearest neighbours along Hilbert curves against brute force."""

import itertools

import numpy as np

from shelfledger.llm import hilbert_ann as A
from shelfledger.llm import queries as Q


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), d[i]) for i in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = A.hilbert_key(points, bits)
        assert sorted(keys.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x, np.flatnonzero(ids % 100 == 0))
    got = by_query(Q.QUERIES["op10_hilbert_neighbours"](spark, folder).collect())
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        exact = {v: s for v, s in want[q]}
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        for _, v, s in found:
            assert abs(s - np.sqrt(((x[ids == q][0] - x[ids == v][0]) ** 2).sum())) < 1e-12
        hits += sum(v in exact for _, v, _ in found)
    assert hits >= 0.9 * 10 * len(want)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700)] + [(i, rng.normal(size=3).tolist()) for i in range(700, 1500)]
    bad = [(2000, None), (2100, [0.0, 0.0, 0.0]), (2200, [1.0, None, 2.0]), (2300, [1.0, float("nan"), 2.0]), (2400, [float("inf"), 0.0, 1.0]),
           (2500, []), (2600, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<double>, rank int")
    got = by_query(A.search(df, A.F.col("vec_id") % 100 == 0).collect())
    assert sorted(got) == list(range(0, 1500, 100))
    assert [(v, s) for _, v, s in got[0]] == [(v, 0.0) for v in range(1, 11)]
    assert [v for _, v, _ in got[100]] == list(range(10))
    few = df.filter("vec_id in (700, 800, 900)")
    assert {q: len(f) for q, f in by_query(A.search(few, A.F.col("vec_id") % 100 == 0).collect()).items()} == {700: 2, 800: 2, 900: 2}
    assert A.search(df.limit(0), A.F.col("vec_id") % 100 == 0).count() == 0
    assert A.search(df.filter("vec_id = 700"), A.F.col("vec_id") % 100 == 0).count() == 0
