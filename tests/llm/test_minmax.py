"""Min-max hashing and the exact check of links against a comparison of all pairs."""

import random
import re

import numpy as np

from shelfledger.llm import alike as A
from shelfledger.llm import minmax_hash as M
from shelfledger.llm import queries as Q

SCHEMA = "doc_id long, text string, node long, size string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(words[i:i + 2]) for i in range(max(1, len(words) - 1))) if words else frozenset()


def brute(rows):
    """(id, set size, smallest id reachable) of every row."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    named = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            up[root(i)] = root(named.setdefault(d, i)) if sets[named.setdefault(d, i)] == sets[i] else root(i)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], SCHEMA)
    got = [tuple(r) for r in M.groups(df).collect()]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def words(rng, n, kinds=10 ** 6):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def test_values_follow_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
    factors = rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    other = base.copy()
    other[:100] = rng.integers(0, 1 << 64, 100, dtype=np.uint64)  # 900 of 1100
    hashes = np.concatenate([np.sort(base), np.sort(other)])
    hits = [int(low[0] == low[1]) + int(high[0] == high[1]) for low, high in M.signature(hashes, np.array([0, 1000]), factors)]
    assert abs(np.mean(hits) / 2 - 900 / 1100) < 0.04


def test_odd_rows(spark):
    long = " ".join(words(random.Random(3), 60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one one"), (7, "one one one"), (None, "a b c d"), (9, "A b C d"), (9, "a b c d"),
            (None, None), (None, "left alone here"), (10, long), (11, long + " more"), (12, "één ÉÉN"), (13, "één één"), (14, "b a")]
    got = check(spark, rows)
    assert (11, 60_000, 10) in got and (5, 1, 4) in got and (7, 1, 6) in got
    empty = spark.createDataFrame([], SCHEMA)
    assert M.groups(empty).count() == 0
    assert M.groups(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).collect()[0]["component_id"] == 1


def test_links_at_the_bound_and_chains(spark):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        base = words(rng, 91)  # 90 shingles: 9 changed words cost 10 of them, exactly 0.8; 10 words fall below
        for j, n in enumerate((8, 9, 10)):
            rows.append((100 * i + j + 1, " ".join([*base[:40], *words(rng, n), *base[40 + n:]])))
        rows.append((100 * i, " ".join(base).upper()))
    link = words(rng, 200)
    for k in range(8):
        rows.append((9000 + k, " ".join(link)))
        link = [*link[18:], *words(rng, 18)]
    got = check(spark, rows)
    assert sum(d == c for d, _, c in got) == 30 * 2 + 1


def edits(rng, base, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10 ** 6)}" for w in base)


def test_one_template_with_many_edits(spark):
    """Copies of a text with between none and a third of the words changed: most pairs lie near the bound, few can be told apart by bands."""
    rng = random.Random(2)
    base, common = words(rng, 120), " ".join(words(rng, 30))
    rows = [(i, edits(rng, base, rng.random() / 3)) for i in range(260)] + [(1000 + i, common + " " + " ".join(words(rng, 40))) for i in range(150)]
    got = check(spark, rows)
    assert 20 < sum(d == c for d, _, c in got if d < 260) < 250


def test_long_lists_in_blocks(spark, monkeypatch):
    """The same with blocks of 16 entries and every list read in windows."""
    monkeypatch.setattr(A, "LIST", 16)
    monkeypatch.setattr(A, "SMALL", 4)
    rng = random.Random(12)
    base = words(rng, 80)
    check(spark, [(i, edits(rng, base, rng.random() / 4)) for i in range(150)])


def test_candidates_do_not_grow_with_the_square(spark):
    """Two thousand texts around one centre: the pairs left for the exact check stay few."""
    rng = random.Random(4)
    base = words(rng, 140)
    rows = [(i, edits(rng, base, rng.random() / 4)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    whole = A.checked
    A.checked = lambda pairs, sets, bound: seen.append(A.cut(pairs).count()) or whole(pairs, sets, bound)
    try:
        M.groups(df).collect()
    finally:
        A.checked = whole
    assert sum(seen) < 40 * len(rows)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = Q.QUERIES["op11_minmax_groups"](spark, folder).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(brute(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
