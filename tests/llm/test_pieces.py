"""Piece lattice against the library that the model files belong to."""

import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from shelfledger.llm import piece_lattice as L
from shelfledger.llm import queries as Q

BPE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", " a", "a ", "Hello  world", "\n x\n\ny", "A\tB", "é\U0001F600 ﬁ ½", "x" * 3000, " " * 200 + "end", "▁a▁", "中文字符没有空格" * 30,
       "aaaabbbbaaaa" * 20, "don't I'LL 1234567890", "\U0001F9FF́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=BPE)


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_pieces"], r["ids_crc32"], r["round_trip"]) for r in Q.QUERIES["op4_piece_lattice"](spark, folder).collect()}
    ids = {d: library.encode(t) for d, t in texts.items()}
    assert got == {d: (len(i), zlib.crc32(",".join(map(str, i)).encode()), True) for d, i in ids.items()}


def test_odd_rows(spark, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(4, ODD[4], 1), (None, "one two", 1)], "doc_id long, text string, ids int")
    model = L.Model(BPE)
    for r in L.decode(L.encode(df, model), model).collect():
        assert r["ids"] == (library.encode(r["text"]) if r["text"] else []), r["text"]
        assert r["decoded"] == library.decode(r["ids"])
    assert L.encode(df.limit(0), model).count() == 0


def test_exchanges_are_small(spark, library):
    """Texts cross once and packed, words as one list for each chunk and bucket; helpers' names and odd ids do no harm."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 12))) for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 400))) for _ in range(900)] + ["same again"] * 200 + [None]
    df = spark.createDataFrame([(None if i % 3 else i % 7, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk int, body string")
    got = L.encode(df, L.Model(BPE))
    plan = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    exchanged = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert exchanged and not [e for e in exchanged if "text#" in e or "word#" in e], exchanged
    rows = got.collect()
    assert sorted((r["chunk"], r["body"]) for r in rows) == [(i, "x") for i in range(len(texts))]
    for r in rows:
        assert r["text"] == texts[r["chunk"]]
        assert r["ids"] == (library.encode(r["text"]) if r["text"] else []), r["text"]
    batch = pa.RecordBatch.from_pydict({"text": [t or "" for t in texts]})
    assert len(L.packed(batch)) < 0.6 * sum(len(t or "") for t in texts)
    assert L.unpacked([L.packed(batch), L.packed(batch.slice(0, 0))])["text"].to_pylist() == [t or "" for t in texts]


def test_replies():
    asked = L.questions(pa.chunked_array([["b a a", None, "", "x" * (L.LONG + 1), "c a"]], pa.string()), 3, True)
    assert sorted(w for ws in asked.values() for w in ws) == [L.MARK + c for c in "abc"]
    words, known = ["a", "b", "c"], {"a": [70000, 1], "c": [5] * (4 * L.LONG)}
    assert L.heard(words, L.reply(words, known, np.dtype("uint32")), np.dtype("uint32")) == known


def test_replies_stay_arrays():
    """Ids are put together from the replies without a list of numbers for each word; what no reply knows is folded alone."""
    asked = {b: [f"w{b}_{i}" for i in range(5000)] for b in range(4)}
    known = {w: [300 + (7 * i + j) % 30000 for j in range(1 + i % 6)] for ws in asked.values() for i, w in enumerate(ws) if i % 10}
    words = [w for pair in zip(*asked.values()) for w in pair] + ["x" * (L.LONG + 1)]
    place, kind = {w: i for i, w in enumerate(words)}, np.dtype("uint16")
    replies = [(b, L.reply(ws, known, kind)) for b, ws in asked.items()]
    tracemalloc.start()
    ids, sizes, at = L.gathered(place, asked, replies, kind, lambda w: [len(w), 1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found, counts = L.strung(ids, sizes, at, np.ones(len(words), np.int64))
    want = [known.get(w, [len(w), 1]) for w in words]
    assert found.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
    assert peak < 130 * len(words), peak
    none = L.gathered({}, {}, [], kind, len)
    assert [len(x) for x in none] == [0, 0, 0]


def test_parts_are_folded_by_themselves(library):
    """Words are cut exactly where no piece holds both neighbours; the parts' ids are the words' ids, and fewer different ones are asked for."""
    pieces = [p for p, _, _ in L.Model(BPE).pieces()]
    held = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
    rng = random.Random(5)
    words = list({L.MARK + "".join(rng.choice("theandinéß\n$#,!9中\U0001F600") for _ in range(rng.randint(0, 14))) for _ in range(400)} | {L.MARK * 5, "x" * 3000})
    parts, sizes = L.parted(words, L.Neighbours(pieces))
    ends = np.cumsum(sizes)
    assert ends[-1] == len(parts)
    for w, n, end in zip(words, sizes.tolist(), ends.tolist()):
        cuts = [0, *(i for i in range(1, len(w)) if w[i - 1:i + 1] not in held), len(w)]
        assert parts[end - n:end] == [w[a:b] for a, b in zip(cuts, cuts[1:])], w
    texts = pa.chunked_array([["the, the. the! the", "and, the? and"]])
    asked = sum(L.questions(texts, 2, True, L.Neighbours(pieces)).values(), [])
    assert sorted(w for w in asked if "the" in w or "and" in w) == [L.MARK + "and", L.MARK + "the"]
    assert L.parted([], L.Neighbours(pieces))[0] == [] and L.parted(["a,"], L.Neighbours([]))[0] == ["a", ","]


@pytest.mark.parametrize("prefix", [True, False])
def test_spelled(prefix):
    texts = [*ODD, "the cat the", "cat  the", "a b c a"]
    words, at, sizes = L.spelled(pa.chunked_array([texts], pa.string()), prefix)
    ends = np.cumsum(sizes)
    assert [[words[i] for i in at[end - n:end]] for n, end in zip(sizes, ends)] == [L.split_words(t, prefix) for t in texts]


def test_decode_in_slabs(spark, library):
    df = spark.createDataFrame([(i, [1000 + i % 50, 300] if i % 7 else None) for i in range(3 * L.ROWS + 5)], "doc_id long, ids array<int>").coalesce(1)
    for r in L.decode(df, L.Model(BPE)).collect():
        assert r["decoded"] == library.decode(r["ids"] or [])


def field(number, payload):
    if isinstance(payload, bytes):
        return bytes([number << 3 | 2]) + varint(len(payload)) + payload
    return bytes([number << 3]) + varint(payload)


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A hand-written unigram model; nothing is trained."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(2, 6))) for _ in range(60)}
    table = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    table += [(p, -rng.uniform(2, 12), 1) for p in sorted({*"abcd", L.MARK, *words, *(L.MARK + w for w in sorted(words)[:25])})]
    body = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + field(3, t)) for p, s, t in table)
    body += field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(body)
    return str(path)


def test_unigram_viterbi(spark, unigram):
    library = sentencepiece.SentencePieceProcessor(model_file=unigram)
    rng = random.Random(9)
    texts = ["".join(rng.choice("aabbccdd e") for _ in range(rng.randint(0, 90))) for _ in range(150)] + ["abcd" * 100, "eee f", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.encode(df, L.Model(unigram, "unigram")).collect():
        assert r["ids"] == library.encode(r["text"]), r["text"]
