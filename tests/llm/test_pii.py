"""Personal data against plain patterns, and the boosted trees on held-out rows."""

import hashlib
import re

import numpy as np
import pytest

from shelfledger.llm import pii_boost as P
from shelfledger.llm import queries as Q

SF = "/root/testdata/sf0.01"
PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        total += sum(map(int, str(int(c) * 2))) if i % 2 else int(c)
    return total % 10 == 0


def brute(text):
    found = []
    for order, (kind, regex) in enumerate(PLAIN):
        for m in re.finditer(regex, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


ODD = ["", "a@b.c_d@e.f x@y a@b..c @x.y me@host.example.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3.4444", "4111 1111-1111 1111 4111  1111 411111111111",
       "+1 (555) 123-4567. +1 +12 ++49 30 1234567 +123456789012345678", "\U0001F600 é@x.fr josé.b+c@mail.example.org", "+49.30.12.34.56.78 10.0.0.1-5",
       "%+-._@a-b.c-d.e", "0000 0000 0000 0000", "9" * 3000 + "." + "9" * 3000, "x" * 20000 + "@" + "y" * 20000, "a.b" * 3000 + " 1 2 3 " * 500]


@pytest.mark.parametrize("text", ODD)
def test_base_spans(text):
    assert [f"{k}:{a}:{b}" for a, b, k in P.base_spans(text)] == brute(text)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in Q.QUERIES["op5_pii_boost"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, base = got[d["doc_id"]], brute(d["text"])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x.startswith(k) for x in base) for k in P.KINDS]
        assert set(base) <= set(filter(None, r["spans"].split(",")))


def test_odd_rows(spark):
    df = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(ODD)), (98, None, "x"), (None, "a@b.c", "x"), (None, "a@b.c", "x")],
                               "doc_id long, text string, spans string")
    rows = P.find(df, P.train(df)).collect()
    assert sorted(",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r["base"]) for r in rows) == sorted(",".join(brute(r["text"])) for r in df.collect())
    assert P.find(df.limit(0), P.train(df.limit(0))).count() == 0
    hidden = {r["doc_id"]: r["text"] for r in P.redact(df, P.Model()).collect()}
    assert hidden[1] == "[EMAIL][EMAIL] x@y a@b..c @x.y [EMAIL]." and hidden[98] is None


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(5)

    def line(kind):
        d = "".join(map(str, rng.integers(0, 10, 20)))
        return {0: f"call +1 ({d[:3]}) 555-{d[3:7]} now", 1: f"on {d[:2]}.{d[2:4]}.{d[4:6]} 20{d[6:8]} it was", 2: f"host {d[:2]}.{d[2:4]}.{d[4:6]}.{d[6:8]} up",
                3: f"write to name.{d[:2]}@mail{d[2]}.example.com today", 4: f"order {d[:8]} and {d[8:16]} x", 5: "no digits@ here"}[kind]

    rows = np.array([r for _ in range(900) for r in P.labelled(line(int(rng.integers(0, 6))))])
    fit, held = rows[: len(rows) // 2], rows[len(rows) // 2:]
    model = P.fit_model(fit)
    right = (model.trees.predict(held[:, :-1]) > 0.5) == (held[:, -1] > 0)
    assert right.mean() > 0.97
    for k, threshold in model.thresholds.items():
        mine = held[held[:, 0] == k]
        passed = mine[model.trees.predict(mine[:, :-1]) >= threshold]
        assert passed[:, -1].mean() > 0.95
    assert 0 in model.thresholds
    assert P.fit_model(rows[:10]).thresholds == {}


def test_model_adds_what_looks_alike():
    """A span that the base rules miss is added when its shape scores like confirmed ones, and base spans stay."""
    class Sure:
        def predict(self, x):
            return np.ones(len(x))

    text = "mail jörg@localhost or a@b.example or 192,168,10,1"
    base, spans = P.all_spans(text, P.Model(Sure(), {0: 0.5, 1: 0.5}))
    assert [(text[a:b], k) for a, b, k in base] == [("a@b.example", "email")]
    assert [(text[a:b], k) for a, b, k in spans] == [("jörg@localhost", "email"), ("a@b.example", "email"), ("192,168,10,1", "ip")]


def test_fitted_model_adds_wide_forms(spark):
    """A model fitted on base matches and decoys finds other forms in texts it has not seen, and leaves the decoys."""
    rng = np.random.default_rng(11)
    n = lambda size: "".join(map(str, rng.integers(0, 10, size)))

    def card():
        head = "4" + n(14)
        return next(head + str(c) for c in range(10) if plain_luhn(head + str(c)))

    def text(i):
        c, decoy = card(), [f"order {n(16)}", f"on {n(2)}.{n(2)}.20{n(2)} {n(2)} we", f"token {n(11)} ended"][i % 3]
        ip = ".".join(map(str, rng.integers(1, 250, 4)))
        found = [f"call +1 ({n(3)}) 555-{n(4)} now", f"host {ip} up", f"write to ann.{n(2)}@mail{n(1)}.example.com today", f"paid {c} then"][i % 4]
        return f"some words {found} and {decoy} at the end"

    docs = spark.createDataFrame([(i, text(i)) for i in range(1600)], "doc_id long, text string")
    model = P.train(docs)
    assert set(model.thresholds) == {0, 1, 2, 3}
    c = card()
    wide = {f"call ({n(3)}) 555-{n(4)} now": "phone", "write to bob.17 [at] mail3.example.com today": "email", "host 2001:db8:1f:2c:7:91:4a:be up": "ip",
            f"paid {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} then": "card"}
    for value, kind in wide.items():
        base, spans = P.all_spans(value, model)
        assert not base and kind in [k for _, _, k in spans], value
        assert f"[{kind.upper()}]" in P.redact(spark.createDataFrame([(value,)], "text string"), model).first()["text"]
    decoys = [P.all_spans(f"some words order {n(16)} and token {n(11)} ended on {n(2)}.{n(2)}.20{n(2)} {n(2)} we", model) for _ in range(200)]
    assert sum(len(spans) - len(base) for base, spans in decoys) <= 12  # of 600; a tenth of the numbers pass Luhn's check and are base


def test_model_is_fitted_on_all_documents(spark):
    """What only documents outside a hash sample of 4000 hold still reaches the fit; where the rows lie does not change the model."""
    n = 6000
    limit = int((4000 / n - 0.5) * 2 ** 64)
    ids = spark.range(n).selectExpr("id AS doc_id", f"xxhash64(id) >= {limit} AS late")
    docs = ids.selectExpr("doc_id", """CASE WHEN late THEN concat('write to ann.', doc_id, '@mail', doc_id % 7, '.example.com, order ', doc_id * 7919 + 10000000)
                          ELSE concat('order ', doc_id * 7919 + 10000000, ' went out') END AS text""")
    model, spread_out = P.train(docs), P.train(docs, most=0)
    assert 0 in model.thresholds
    assert spread_out.thresholds == model.thresholds
    for one, other in zip(model.trees.trees, spread_out.trees.trees, strict=True):
        assert all((a == b).all() for a, b in zip(one, other))


def test_counted_quantiles():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 500) / 7
    assert np.allclose(P.quantile_edges(*np.unique(x, return_counts=True)), np.unique(np.quantile(x, np.linspace(0, 1, P.BINS + 1)[1:-1])))
