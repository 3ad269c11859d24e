"""Near copies of the pipeline against a comparison of all pairs of shingle sets."""

import random
import re
import time

import pytest

import corpus_pipeline
from shelfledger.llm import near_copies as N
from shelfledger.llm.shared import FILE_CLEANUP, cut

SF = "/root/testdata/sf0.01"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_roots(texts):
    """texts: [(id, text)]; smallest id reachable over pairs with Jaccard 0.8 or more, by set."""
    least = {}
    for d, t in texts:
        s = shingles(t)
        least[s] = min(least.get(s, d), d)
    sets = sorted(least, key=lambda s: least[s])
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            common = len(s & sets[j])
            if 10 * common >= 8 * (len(s) + len(sets[j]) - common):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {s: least[sets[root(i)]] for i, s in enumerate(sets)}


def check(spark, rows):
    roots = brute_roots(rows)
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted({d for d, t in rows if roots[shingles(t)] == d})
    return roots


def test_links_at_the_bound(spark):
    """Copies with one edited stretch just above and below 0.8, and a chain whose ends are not alike."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    rows = []
    for i in range(40):
        base = words(204)  # 200 shingles
        for j, edited in enumerate((16, 17, 18, 19)):  # 20 to 23 shingles differ: 0.818, 0.810, 0.802 and 0.794
            rows.append((1000 * i + j + 1, " ".join([*base[:50], *words(edited), *base[50 + edited:]])))
        rows.append((1000 * i, " ".join(base).upper()))
    link = words(300)
    for k in range(8):
        rows.append((90_000 + k, " ".join(link)))
        link = [*link[25:], *words(25)]
    rows += [(1, "One two"), (2, "one TWO"), (3, None), (4, " \t"), (5, "one two three")]
    roots = check(spark, rows)
    assert len({roots[shingles(t)] for _, t in rows}) == 40 * 2 + 1 + 3


def test_group_with_a_centre(spark):
    """Copies that are like one text of large id and not like each other: pairs beside the first star count."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    base = words(304)
    rows = [(i, " ".join([*base[:7 * i], *words(26), *base[7 * i + 26:]])) for i in range(1, 39)] + [(99, " ".join(base))]
    roots = check(spark, rows)
    assert set(roots.values()) == {1}


def test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    roots = check(spark, rows)
    assert len(set(roots.values())) < len(roots)
    got = {r["doc_id"]: r["component_id"] for r in N.groups(docs).collect()}
    assert got == {d: roots[shingles(t)] for d, t in rows}
    assert N.keep_one(docs.limit(0)).count() == 0


def test_cut_leaves_no_shuffle_files(spark):
    """What a job dealt out is removed from disk once its result is written, and the result can still be read."""
    jvm = spark.sparkContext._jvm

    def shuffled():
        files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "shuffle_" in f}

    before, setting = shuffled(), spark.conf.get(FILE_CLEANUP, "false")
    rows = spark.range(20000).selectExpr("id", "id % 1000 AS key").repartition(4, "key")
    written = cut(rows.join(rows.groupBy("key").count(), "key"))
    deadline = time.monotonic() + 20
    while shuffled() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before
    assert written.count() == 20000 and written.agg({"count": "max"}).first()[0] == 20
    assert written.groupBy("id").count().count() == 20000 and spark.conf.get(FILE_CLEANUP, "false") == setting
