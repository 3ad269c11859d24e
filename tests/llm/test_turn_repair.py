"""Repair of conversations against a plain label-by-label search over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from shelfledger.llm import queries as Q
from shelfledger.llm import turn_repair as T

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WANT = {"": "u", "s": "u", "u": "a", "a": "u"}
SCHEMA = "conv_id long, turn long, role string, text string, name string, seg int"


def harm(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def judged(rows):
    """rows of one conversation in order: (initial, fault)."""
    out, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none"
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def inserted(best):
    for _ in range(4):
        for s, (c, a) in list(best.items()):
            t = NEXT[s, WANT[s]]
            best[t] = min(best.get(t, (c + 3, a + "I")), (c + 3, a + "I"))
    return best


def ways(rows, start=""):
    """Cheapest (cost, audit) into every state, row by row."""
    best = inserted({start: (0, "")})
    for initial, fault in rows:
        new = {}
        for s, (c, a) in best.items():
            options = [(s, c + 4, a + "D")]
            if fault not in ("blank", "duplicate"):
                c += 3 * (fault == "truncated")
                options += [(NEXT[s, initial], c, a + "K")] if (s, initial) in NEXT else []
                options.append((NEXT[s, WANT[s]], c + 3, a + "R"))
            for t, *value in options:
                new[t] = min(new.get(t, tuple(value)), tuple(value))
        best = inserted(new)
    return best


def brute(rows):
    by = {c: [] for c, *_ in rows}
    for c, *rest in harm(rows):
        by[c].append(tuple(rest))
    out = []
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks = judged(own)
        best = ways(marks)
        cost, audit = min(best[s] for s in ("", "a") if s in best)
        kept, at, state = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[at][1:]
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else {"u": "user", "a": "assistant"}[WANT[state]]
                state = NEXT[state, role[:1]]
                kept.append(f"{role}:{text}")
        turns = [t for t, _, _ in own if t is not None]
        count = lambda kind: sum(f == kind for _, f in marks)
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
                    sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marks, marks[1:])), cost, audit,
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, tmp_path):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in Q.QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)
    return got


def test_search_is_optimal():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice("suat"), rng.choice(["none", "none", "none", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(10))]
        for i, start in enumerate(("", "s", "u", "a")):
            want = ways(rows, start)
            assert T.search(rows, i, (0, 1, 2, 3)) == {j: want[e] for j, e in enumerate(("", "s", "u", "a")) if e in want}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in Q.QUERIES["op13_turn_repair"](spark, folder).collect()), key=repr) == brute(rows)


def random_rows(rng, n, convs):
    texts = ["Yes.", "No", "", " \t", "Why?", "two\nlines.", "ends here . ", "é!", "ok"]
    return [(rng.choice(convs), rng.choice([None, *range(30)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher"]),
             rng.choice([None, rng.choice(texts), f"{rng.random()}" + rng.choice([".", "", "!"])])) for _ in range(n)]


def test_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = random_rows(rng, 500, [None, *range(40)]) + [(50, 1, "user", "z" * 300_000 + "."), (51, None, None, None)]
    rows += [(60, t, "user", "same.") for t in range(5)] * 7
    dropped = next(t for t in range(1000) if zlib.crc32(f"70:{t}".encode()) % 20 == 0)
    got = check(spark, [*rows, (70, dropped, "user", "Gone.")], tmp_path)
    assert (70, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got
    empty = spark.createDataFrame([], SCHEMA)
    repaired = T.repair(T.damage(empty))
    assert repaired.figures().count() == repaired.digests().count() == repaired.rows().count() == 0


@pytest.mark.parametrize("segment", [1, 3, T.SEGMENT])
def test_a_long_conversation(spark, tmp_path, monkeypatch, segment):
    """One conversation holds most rows; it is cut into segments, and the folded edits are those of the whole."""
    monkeypatch.setattr(T, "SEGMENT", segment)
    rng = random.Random(5)
    rows = random_rows(rng, 60, list(range(100, 110)))
    for t in range(600 if segment > 1 else 150):
        rows.append((1, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"turn {t}" + rng.choice([".", "."])))
    rows += [(2, t, "user", f"again {t}.") for t in range(40)] + [(3, t, ["user", "assistant"][t % 2], "" if t < 90 else f"{t}.") for t in range(95)]
    check(spark, rows, tmp_path)


def test_rows_and_digest_agree(spark):
    rng = random.Random(9)
    rows = random_rows(rng, 200, list(range(20)))
    repaired = T.repair(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    by = {}
    for r in sorted(repaired.rows().collect(), key=lambda r: (r["seg"], r["place"])):
        by.setdefault(r["name"], []).append(r)
    digests = {r["name"]: r["repaired_sha256"] for r in repaired.figures().join(repaired.digests(), "key").collect()}
    for name, digest in digests.items():
        left = by.get(name, [])
        assert digest == hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in left).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in left))
