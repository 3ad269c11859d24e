"""SimHash groups and pattern packing against plain Python."""

import math
import random
import re
import zlib
from collections import defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from shelfledger.llm import pattern_packing, vp_simhash
from shelfledger.llm import queries as Q

SF = "/root/testdata/sf0.01"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """fps: {id: fingerprint}; smallest id reachable over links of at most 4 bits."""
    by = defaultdict(list)
    for i, f in fps.items():
        by[f].append(i)
    keys = np.array(sorted(by), np.uint64)
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys[i + 1:] ^ keys[i]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for i, f in enumerate(keys.tolist()):
        least[root(i)] = min(least.get(root(i), 1 << 60), *by[f])
    return {d: least[root(i)] for i, f in enumerate(keys.tolist()) for d in by[f]}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_simhash_query(spark, texts):
    want = {d: fingerprint(t) for d, t in texts.items()}
    roots = brute_components(want)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.QUERIES["op9_simhash_groups"](spark, SF).collect()}
    assert got == {d: (f"{want[d]:016x}", roots[d]) for d in texts}
    assert len(set(roots.values())) < len(roots)


def test_simhash_odd_rows(spark):
    long_text = " ".join(f"w{i % 997} x{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one TWO"), (6, long_text), (7, long_text + " tail"), (8, "\x0b x")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in vp_simhash.groups(df).collect()}
    want = {d: fingerprint(t) for d, t in rows}
    assert got == {d: (want[d], c) for d, c in brute_components(want).items()}
    assert vp_simhash.groups(df.limit(0)).count() == 0
    named = spark.createDataFrame([(None, "same words in here"), (9, "same words in here")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in vp_simhash.groups(named).collect()} == {(None, 9), (9, 9)}


@pytest.mark.parametrize("size", [40, 3000])
def test_links_keep_components(spark, size):
    """Dense balls of fingerprints, chains and strangers; the large case needs the tree inside a shard."""
    rng = np.random.default_rng(size)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    near = [int(centres[i % 5]) ^ sum(1 << int(b) for b in rng.integers(0, 24, 1 + i % 6)) for i in range(size)]
    chain = [int(centres[0]) ^ ((1 << 40) - 1 & ~((1 << n) - 1)) for n in range(0, 40, 3)]
    fps = {i: f for i, f in enumerate(dict.fromkeys([*near, *chain, *rng.integers(0, 1 << 63, size, dtype=np.uint64).tolist()]))}
    edges = vp_simhash.links(spark.createDataFrame([(f,) for f in fps.values()], "fp long"))
    assert edges.count() <= 5 * len(fps)
    roots = {r["node"]: r["root"] for r in vp_simhash.components(edges).collect()}
    groups = defaultdict(set)
    for i, f in fps.items():
        groups[roots.get(f, f)].add(i)
    want = defaultdict(set)
    for i, c in brute_components(fps).items():
        want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


# -- packing ---------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(rows, texts, tokenizer):
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids = np.array([*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["length"] for r in own[1:]] == [1024] * (len(own) - 1)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(own) == 1 or len(ids) > 1024)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(sequences), -(-sum(r["length"] for r in rows) // 1024)


def test_packing_query(spark, texts, tokenizer):
    used, least = check_packing(Q.QUERIES["op3_pattern_packing"](spark, SF).collect(), texts, tokenizer)
    assert used <= least + 2


def test_packing_odd_rows(spark, tokenizer):
    texts = {1: None, 2: "", 3: " \n\t " * 900, 4: "a<|endoftext|>b <|endoftext|>", 5: "x" * 40000, 6: "é  \U0001F600 don't I'LL 12³ ½" * 50,
             7: "\x00\x1f‍́ ﻿", 8: "word " * 1023, 9: "word " * 2047}
    df = spark.createDataFrame([(d, t, 5) for d, t in texts.items()], "doc_id long, text string, offset int")
    check_packing(Q.packed(df).collect(), texts, tokenizer)
    assert Q.packed(df.limit(0)).count() == 0
    twice = Q.packed(df.filter("doc_id = 8").unionByName(df.filter("doc_id = 8"))).collect()
    assert len(twice) == len({(r["sequence_id"], r["offset"]) for r in twice}) == 4


@pytest.mark.parametrize("blank", [" ", "\n", " \n\t\u3000"])
def test_packing_of_very_long_blanks(spark, tokenizer, blank):
    texts = {1: "a" + blank * (1_200_000 // len(blank)) + "x <|endoftext|>", 2: "few words"}
    check_packing(Q.packed(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts, tokenizer)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.minimum(1024, np.maximum(2, rng.lognormal(5.6, 1.0, 200_000).astype(int)))
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    runs, sequences = pattern_packing.plan_runs(histogram)
    assert {int(k): int(runs[runs[:, 0] == k, 2].sum()) for k in histogram} == histogram
    assert sequences <= 1.001 * -(-lengths.sum() // 1024)


def test_shards_split_as_fingerprints_grow():
    """Comparisons of a fingerprint inside its shards stay few from a hundred thousand to four million random ones."""
    rng = np.random.default_rng(1)

    def key_of(fp, blocks, j):
        mask = np.uint64(((1 << 64 * (j + 1) // blocks) - 1) ^ ((1 << 64 * j // blocks) - 1))
        seen = [np.bitwise_count((fp & mask) ^ (v & mask)).astype(np.uint64) for v in vp_simhash._VANTAGE[j * vp_simhash.LEVELS:(j + 1) * vp_simhash.LEVELS]]
        return reduce(lambda key, d: key * np.uint64(65) + d, seen, np.zeros(len(fp), np.uint64))

    for rows in (10 ** 5, 10 ** 6, 4 * 10 ** 6):
        agreed = vp_simhash.agreed_blocks(rows)
        fp = rng.integers(0, 1 << 64, rows, dtype=np.uint64)
        parts = [key_of(fp, vp_simhash.DISTANCE + agreed, j) for j in range(agreed)]  # one of the choices; all are alike
        _, counts = np.unique(reduce(lambda a, b: a * np.uint64(0x9E3779B97F4A7C15) + b, parts), return_counts=True)
        pairs = (counts * (counts - 1) // 2).sum() * math.comb(vp_simhash.DISTANCE + agreed, agreed)
        assert pairs < 40 * rows and counts.max() < 1000
    assert [vp_simhash.agreed_blocks(n) for n in (1000, 10 ** 6, 10 ** 9)] == [1, 2, 4]


@pytest.mark.parametrize("agreed", [1, 2, 3])
def test_links_at_every_width_of_shards(spark, monkeypatch, agreed):
    monkeypatch.setattr(vp_simhash, "agreed_blocks", lambda rows, distance: agreed)
    rng = random.Random(agreed)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(rng.randrange(4)):
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                f ^= 1 << bit
            fps.add(f)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {(r["node"], r["root"]) for r in vp_simhash.components(vp_simhash.links(df)).collect()}
    roots = {}
    for f in fps:
        near = [g for g in roots if (f ^ g).bit_count() <= 4]
        merged = {roots[g] for g in near}
        roots = {g: f if r in merged else r for g, r in roots.items()} | {f: f}
    groups = {}
    for f, r in roots.items():
        groups.setdefault(r, []).append(signed(f))
    assert got == {(n, min(g)) for g in groups.values() if len(g) > 1 for n in g}
