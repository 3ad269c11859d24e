"""Substring dedup by words and by bytes against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from shelfledger.llm import rlz_dedup, rounds, suffix_dedup
from shelfledger.llm import queries as Q
from shelfledger.llm import textblock as B

SF = "/root/testdata/sf0.01"
GAP = re.compile(r"[^\x20\x09-\x0D]+")


def brute_words(rows, window=13):
    """rows: (id, text); what each row keeps."""
    first = {}
    late = 1 << 63
    split = [(late if d is None else d, GAP.findall(t or "")) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            first[key] = min(first.get(key, late), d)
    out = []
    for d, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_word_dedup_query(spark, texts):
    want = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (d, _), (n, gone, kept) in zip(texts, brute_words(texts))}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in Q.QUERIES["op2_rlz_dedup"](spark, SF).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


def random_rows(seed, vocabulary, n=120):
    rng = random.Random(seed)
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(9, 40))] for _ in range(12)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("seed,words", [(1, 3), (2, 400), (3, 1)])
def test_word_dedup_random(spark, monkeypatch, seed, words):
    monkeypatch.setattr(rounds, "CHUNK_FLOOR", 3000)
    monkeypatch.setattr(rounds, "CHUNK_FACTOR", 1)
    rows = random_rows(seed, [f"w{i}é" for i in range(words)])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_words"]) for r in
           rlz_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute_words(rows))}


def test_word_dedup_odd_rows(spark):
    long_text = " ".join(f"w{i % 997} x{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n "), (5, long_text), (5, long_text), (6, "start " + long_text), (None, long_text), (7, "a b c"),
            (-4, "tail of " + " ".join(f"p{i}" for i in range(30)))]
    df = spark.createDataFrame([(d, t, 3, "k") for d, t in rows], "doc_id long, text string, n_words int, kept_text string")
    got = sorted((r["n_words"], r["n_removed"], r["kept_words"]) for r in rlz_dedup.dedup(df).collect())
    assert got == sorted(brute_words(rows))
    assert rlz_dedup.dedup(df.limit(0)).count() == 0


def test_kept_text_keeps_its_form(spark):
    shared = " ".join(f"s{i}" for i in range(15))
    df = spark.createDataFrame([(1, f"x\n{shared}"), (2, f"head\tof it\n{shared}\n\ntail  end"), (3, shared)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rlz_dedup.dedup(df).collect()}
    assert [got[i]["kept_text"] for i in (1, 2, 3)] == [f"x\n{shared}", "head\tof it\n\ntail  end", ""]
    assert [(f["start"], f["end"]) for f in got[2]["factors"]] == [(3, 18)]


# -- bytes -----------------------------------------------------------------------------------------------------------------

def brute_bytes(texts, length=400):
    often = {}
    data = [(t or "").encode() for t in texts]
    for t in data:
        for i in range(len(t) - length + 1):
            key = hash(t[i:i + length])
            often[key] = often.get(key, 0) + 1
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if often[hash(t[i:i + length])] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def test_byte_dedup_query(spark, texts):
    want = {d: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for (d, _), w in zip(texts, brute_bytes([t for _, t in texts]))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in Q.QUERIES["op1_suffix_dedup"](spark, SF).collect()}
    assert got == want
    assert sum(w[2] for w in want.values()) > 50


@pytest.mark.parametrize("seed,letters,length,crowd", [(1, "ab", 40, 4096), (2, "abcdefgh", 40, 4096), (3, "a", 40, 4096), (4, "abé", 400, 4096), (1, "ab", 40, 2),
                                                       (2, "abcdefgh", 40, 3), (4, "abé", 400, 0)])
def test_byte_dedup_random(spark, monkeypatch, seed, letters, length, crowd):
    monkeypatch.setattr(rounds, "CHUNK_FLOOR", 4000)
    monkeypatch.setattr(rounds, "CHUNK_FACTOR", 1)
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(length - 9, 3 * length))) for _ in range(10)]
    rows = []
    for d in range(150):
        text = ""
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            text += p[a:rng.randint(a, len(p))] if rng.random() < 0.5 else p if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(1, length)))
        rows.append((d, text))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in
           suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length=length,
                              anchor=length * 3 // 4, crowd=crowd).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute_bytes([t for _, t in rows], length))}


def test_byte_dedup_odd_rows(spark):
    long_text = " ".join(f"w{i % 997} x{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "é" * 300), (5, long_text), (5, long_text[:9000]), (None, "start " + long_text[100:700]), (7, "x" * 399), (8, "y" * 401)]
    df = spark.createDataFrame([(d, t, 3, "k") for d, t in rows], "doc_id long, text string, n_bytes int, kept string")
    got = sorted((r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in suffix_dedup.dedup(df).collect())
    assert got == sorted(brute_bytes([t for _, t in rows]))
    assert suffix_dedup.dedup(df.limit(0)).count() == 0


def test_a_passage_in_a_third_of_all_documents(spark, monkeypatch):
    """A passage just shorter, or a little longer, than a string, with other words around it each time: its anchors are crowded."""
    monkeypatch.setattr(rounds, "CHUNK_FLOOR", 20_000)
    monkeypatch.setattr(rounds, "CHUNK_FACTOR", 1)
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    short, long = letters(395), letters(430)
    rows = [(i, letters(rng.randint(0, 300)) + (short if i % 3 == 0 else long if i % 3 == 1 else letters(200)) + letters(rng.randint(0, 300))) for i in range(600)]
    rows += [(1000 + i, letters(50) + short + "z" * 20) for i in range(20)]
    want = {d: w for (d, _), w in zip(rows, brute_bytes([t for _, t in rows]))}
    for crowd in (50, 10 ** 6):
        got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), crowd=crowd).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in got} == want
    assert sum(w[1] for w in want.values()) > 200 * 430


def test_buckets_are_all_used():
    hashes = B.mix(np.arange(3_000_000, dtype=np.uint64))
    assert len(np.unique(rounds.spread(hashes, 1_000_000))) > 900_000
    assert rounds.spread(hashes, 3).max() == 2


def test_clashing_names_and_ids(spark):
    """Columns with the names of helpers come back; many NULL or equal ids spread over the chunks."""
    shared = " ".join(f"s{i}" for i in range(200))
    df = spark.createDataFrame([(None if i < 40 else 7, f"t{i} {shared}", i, i, i) for i in range(80)], "doc_id long, text string, _chunk int, _id int, _text int")
    for module in (rlz_dedup, suffix_dedup):
        got = module.dedup(df).collect()
        assert sorted((r["_chunk"], r["_id"], r["_text"]) for r in got) == [(i, i, i) for i in range(80)]
    assert all(r["n_removed"] > 400 for r in got)
