"""Repair of damaged conversations: the cheapest edits that give a legal order of roles, by depth-first branch and bound.

Rows of one conversation are put in order by a range partitioning of all rows, so a conversation of any length spreads over many tasks.
It is cut into segments of at most ``SEGMENT`` rows; each segment is searched on its own from each state of the role pattern it may
start in to each it may end in.  The search keeps an explicit stack, a lower bound of what each suffix must cost, the best complete
(cost, audit) so far as incumbent, and for every (row, state) the cheapest prefix seen, so worse prefixes are dropped; it ends when
the stack is empty, which proves the incumbent.  Branches are taken in ASCII order, so of prefixes that cost the same the first to
arrive has the least audit.  A conversation's segments are then folded in order, four states wide, and only what still differs between
the states is held.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.shared import cut, free_name

SEGMENT = 128
RECORDS = 256  # segments handed on at a time
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, SPOKEN = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
# States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.  NEXT: the state that an initial leads to.
START, SYSTEM, USER, DONE = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
WANTED = {START: "u", SYSTEM: "u", USER: "a", DONE: "u"}  # what an insert or a rerole must give
ROLE = {"u": "user", "a": "assistant"}
FROM = {START: {START}, SYSTEM: {START, SYSTEM}, USER: {*range(4)}, DONE: {*range(4)}}  # states from which a state can be reached
#: What it costs at most to end as well from the first state as from the second one.
INSTEAD = {(DONE, START): DELETE, (DONE, SYSTEM): 0, (DONE, USER): INSERT, (USER, DONE): INSERT, (USER, START): INSERT + DELETE, (USER, SYSTEM): INSERT}

Best = tuple[int, str]


# -- the search ------------------------------------------------------------------------------------------------------------

def least_cost(initial: str, fault: str) -> int:
    """What a row costs at least, whatever stands around it."""
    if fault in ("blank", "duplicate"):
        return DELETE
    if fault == "truncated":
        return min(DELETE, TRUNCATED if initial in "sua" and initial else REROLE + TRUNCATED)
    return 0 if initial in "sua" and initial else REROLE


def first_guess(rows: list[tuple[str, str]], start: int, end: int) -> Best | None:
    """Some legal edits from ``start`` to ``end``: keep what fits, rerole the rest, insert at the end."""
    if start not in FROM[end]:
        return None
    if end == start and end in (START, SYSTEM):
        return DELETE * len(rows), "D" * len(rows)
    if end == SYSTEM:
        for i, (initial, fault) in enumerate(rows):
            if initial == "s" and fault not in ("blank", "duplicate"):
                return DELETE * (len(rows) - 1) + TRUNCATED * (fault == "truncated"), "D" * i + "K" + "D" * (len(rows) - 1 - i)
        return None
    cost, audit, state = 0, [], start
    for initial, fault in rows:
        if fault in ("blank", "duplicate"):
            cost, edit = cost + DELETE, "D"
        else:
            edit = "K" if (state, initial) in NEXT else "R"
            cost += REROLE * (edit == "R") + TRUNCATED * (fault == "truncated")
            state = NEXT[state, initial if edit == "K" else WANTED[state]]
        audit.append(edit)
    while state != end:
        state = NEXT[state, WANTED[state]]
        cost += INSERT
        audit.append("I")
    return cost, "".join(audit)


def search(rows: list[tuple[str, str]], start: int, ends: tuple[int, ...]) -> dict[int, Best]:
    """The cheapest (cost, audit) from ``start`` to each of ``ends`` over ``rows`` (initial, fault), ties to the ASCII-least audit."""
    n = len(rows)
    suffix = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        suffix[i] = suffix[i + 1] + least_cost(*rows[i])
    incumbent = {end: guess for end in ends if (guess := first_guess(rows, start, end))}
    ends = tuple(incumbent)  # without a guess there is no way at all
    cheapest: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, int, int, str]] = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if cheapest.get((i, state), cost + 1) <= cost:
            continue  # a prefix as cheap came first, and it was less
        floor = cost + suffix[i]
        if not any(state in FROM[e] and (floor < incumbent[e][0] or floor == incumbent[e][0] and audit <= incumbent[e][1][:len(audit)]) for e in ends):
            continue
        cheapest[i, state] = cost
        if i == n and state in ends and (cost, audit) < incumbent[state]:
            incumbent[state] = cost, audit
        wanted = WANTED[state]
        branches = []
        if i < n:
            initial, fault = rows[i]
            branches.append((i + 1, state, cost + DELETE, audit + "D"))
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED * (fault == "truncated")
                if (state, initial) in NEXT:
                    branches.append((i + 1, NEXT[state, initial], cost + extra, audit + "K"))
                branches.append((i + 1, NEXT[state, wanted], cost + REROLE + extra, audit + "R"))
        branches.insert(min(1, len(branches)), (i, NEXT[state, wanted], cost + INSERT, audit + "I"))
        stack += reversed(branches)  # D, I, K, R: the least is taken first
    return incumbent


def fold(held: dict[int, Best], table: dict[tuple[int, int], Best]) -> dict[int, tuple[Best, int, str]]:
    """Best way into each state after one more segment: (cost, audit), the state it came from and the segment's own edits."""
    out: dict[int, tuple[Best, int, str]] = {}
    for (start, end), (cost, audit) in table.items():
        if start in held:
            new = held[start][0] + cost, held[start][1] + audit
            if end not in out or new < out[end][0]:
                out[end] = new, start, audit
    return {s: v for s, v in out.items() if not any(b == s and a in out and out[a][0][0] + extra < v[0][0] for (a, b), extra in INSTEAD.items())}


# -- segments of sorted rows ---------------------------------------------------------------------------------------------------

@dataclass
class Segment:
    """Rows of one conversation that follow each other."""

    name: object
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[str] = field(default_factory=list)
    turns: list[int | None] = field(default_factory=list)

    def record(self, seg: int, whole: bool) -> dict:
        rows = [(r[:1], f) for r, f in zip(self.roles, self.faults)]
        starts, ends = ((START,), (START, DONE)) if whole else (range(4), range(4))
        table = [{"start": s, "end": e, "cost": c, "audit": a} for s in starts for e, (c, a) in search(rows, s, tuple(ends)).items()]
        letters = [r for r, _ in rows]
        known = [t for t in self.turns if t is not None]
        return {"name": self.name, "seg": seg, "first": letters[0], "last": letters[-1], "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])),
                **{k: self.faults.count(k) for k in ("blank", "duplicate", "truncated")},
                "low": known[0] if known else None, "high": known[-1] if known else None, "kinds": sum(a != b for a, b in zip(known, [None, *known])),
                "moves": table, "roles": self.roles, "texts": self.texts}


_MOVES = "array<struct<start:int,end:int,cost:bigint,audit:string>>"
_STATS = "first string, last string, illegal bigint, blank bigint, duplicate bigint, truncated bigint, low bigint, high bigint, kinds bigint"


def segments(rows: DataFrame, kind: str) -> DataFrame:
    """One record per segment of ``rows`` (name, turn, role, text, copies, fault, first); records of a conversation ascend in ``seg``."""
    schema = f"name {kind}, seg bigint, {_STATS}, moves {_MOVES}, roles array<string>, texts array<string>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        done: list[dict] = []
        now: Segment | None = None
        edge = True  # the conversation at hand may have begun in the task before, or has been cut here
        for batch in batches:
            for name, turn, role, text, copies, fault, first in zip(*(batch[c].to_pylist() for c in ("name", "turn", "role", "text", "copies", "fault", "first"))):
                for copy in range(copies):
                    if now is not None and (now.name != name or len(now.roles) == SEGMENT):
                        same = now.name == name
                        done.append(now.record(number, not edge and not same))
                        number, edge, now = number + 1, same, None
                    if now is None:
                        now = Segment(name)
                    now.roles.append(role)
                    now.texts.append(text)
                    now.turns.append(turn)
                    now.faults.append("blank" if fault == "blank" else "duplicate" if copy or not first else fault)
                if len(done) >= RECORDS:
                    yield pa.RecordBatch.from_pylist(done, arrow)
                    done = []
        if now is not None:
            done.append(now.record(number, False))
        yield pa.RecordBatch.from_pylist(done, arrow)

    return rows.mapInArrow(work, schema)


def _by_name(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(whether a new conversation begins, record) of records sorted by name and segment."""
    last: list = []
    for batch in batches:
        for record in batch.to_pylist():
            yield [record["name"]] != last, record
            last = [record["name"]]


def choose(records: DataFrame, kind: str) -> DataFrame:
    """A row per segment with its chosen edits (seg, key, start, edits), and one per conversation (key, name, the figures, audit).

    ``key`` is the conversation's first segment.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        total: dict = {}
        held: dict[int, Best] = {}
        trail: dict[int, tuple | None] = {}
        settled: list[str] = []

        def close() -> None:
            state = min((held[s], s) for s in (START, DONE) if s in held)[1]
            total["cost"], audit = held[state]
            total["audit"] = "".join([*settled, audit])
            total["gaps"] = total["high"] - total["low"] + 1 - total["kinds"] if total["low"] is not None else 0
            step = trail[state]
            while step:
                step, seg, start, edits = step
                out.append({"key": total["key"], "seg": seg, "start": start, "edits": edits})
            out.append({k: v for k, v in total.items() if k in names})

        for new, r in _by_name(batches):
            if new:
                if total:
                    close()
                held, trail, settled = {START: (0, "")}, {START: None}, []
                total = {k: 0 for k in ("illegal", "blank", "duplicate", "truncated", "kinds")} | {"key": r["seg"], "name": r["name"], "low": None, "high": None, "last": None}
            for k in ("illegal", "blank", "duplicate", "truncated", "kinds"):
                total[k] += r[k]
            if total["last"] is not None:
                total["illegal"] += total["last"] + r["first"] not in ("su", "ua", "au")
            total["last"] = r["last"]
            if r["low"] is not None:
                total["kinds"] -= total["high"] == r["low"]
                total["low"] = r["low"] if total["low"] is None else total["low"]
                total["high"] = r["high"]
            found = fold(held, {(m["start"], m["end"]): (m["cost"], m["audit"]) for m in r["moves"]})
            trail = {s: (trail[start], r["seg"], start, edits) for s, (_, start, edits) in found.items()}
            shared = os.path.commonprefix([best[1] for best, _, _ in found.values()])
            settled.append(shared)
            held = {s: (best[0], best[1][len(shared):]) for s, (best, _, _) in found.items()}
            if len(out) >= RECORDS:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if total:
            close()
        yield pa.RecordBatch.from_pylist(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = (f"key bigint, seg bigint, start int, edits string, name {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
              "cost bigint, audit string")
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = set(arrow.names)
    return records.select("name", "seg", *[c.split()[0] for c in _STATS.split(", ")], "moves").repartition("name").sortWithinPartitions("name", "seg").mapInArrow(work, schema)


def applied(roles: list[str], texts: list[str], start: int, edits: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits leave."""
    at, state = 0, start
    for edit in edits:
        if edit == "I":
            yield ROLE[WANTED[state]], ""
            state = NEXT[state, WANTED[state]]
            continue
        if edit != "D":
            role = roles[at] if edit == "K" else ROLE[WANTED[state]]
            yield role, texts[at]
            state = NEXT[state, role[:1]]
        at += 1


# -- the operator ----------------------------------------------------------------------------------------------------------

def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` with the planted damage: by crc32 of ``conv_id:turn`` modulo 20, a row is dropped (0), emptied (1), loses its ``.!?``
    (2), is repeated (3) or becomes the user's (4).  NULLs of role and text, and in the hashed key, stand as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    new_role = F.when(kind == 4, "user").otherwise(space(role))
    new_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    hit = free_name(rows, "_kind")
    return (rows.withColumn(hit, kind).filter(F.col(hit) != 0).withColumns({role: new_role, text: new_text})
            .withColumn(hit, F.explode(F.when(F.col(hit) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop(hit))


def faults(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(name, turn, role, text, copies, fault, first): different rows with their number, and whether role and text occur here first."""
    plain = rows.select(F.col(conv_id).alias("name"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    fault = (F.when(~F.col("text").rlike(SPOKEN), "blank").when(~F.col("text").rlike(rf"[.!?]{BLANK}*\z"), "truncated").otherwise("none"))
    different = plain.groupBy("name", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    # A NULL turn comes first, so it counts as the least of all.
    earliest = different.groupBy("name", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    same = different.join(earliest.select(F.col("name").alias("_name"), F.col("role").alias("_role"), F.col("text").alias("_text"), F.col("least.turn").alias("_turn")),
                          F.col("name").eqNullSafe(F.col("_name")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text")))
    return same.select("name", "turn", "role", "text", "copies", fault.alias("fault"), F.col("turn").eqNullSafe(F.col("_turn")).alias("first"))


@dataclass(frozen=True)
class Repair:
    """``records``: segments of rows; ``chosen``: edits per segment and figures per conversation."""

    records: DataFrame
    chosen: DataFrame

    def figures(self) -> DataFrame:
        """(key, name, gaps, blank, duplicate, truncated, illegal, cost, audit), one row per conversation."""
        return self.chosen.filter("seg IS NULL").drop("seg", "start", "edits")

    def _kept(self) -> DataFrame:
        edits = self.chosen.filter("seg IS NOT NULL").select("key", "seg", "start", "edits")
        return self.records.select("name", "seg", "roles", "texts").join(edits, "seg")

    def rows(self) -> DataFrame:
        """(name, seg, place, role, text): the repaired conversations; ``seg`` and ``place`` give their order."""
        kind = self.records.schema["name"].dataType.simpleString()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(r["name"], r["seg"], i, role, text) for r in batch.to_pylist() for i, (role, text) in enumerate(applied(r["roles"], r["texts"], r["start"], r["edits"]))]
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("name").type, pa.int64(), pa.int32(), pa.string(), pa.string()))],
                                                 ["name", "seg", "place", "role", "text"])

        return self._kept().mapInArrow(work, f"name {kind}, seg bigint, place int, role string, text string")

    def digests(self) -> DataFrame:
        """(key, repaired_sha256): one chained hash per conversation, read as a stream, a segment at a time."""
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, hashes = [], []
            for batch in batches:
                for r in batch.to_pylist():
                    if not keys or keys[-1] != r["key"]:
                        keys.append(r["key"])
                        hashes.append([hashlib.sha256(), ""])
                    for role, text in applied(r["roles"], r["texts"], r["start"], r["edits"]):
                        hashes[-1][0].update(f"{hashes[-1][1]}{role}:{text}".encode())
                        hashes[-1][1] = "\n"
                if len(keys) > RECORDS:
                    yield pa.RecordBatch.from_pydict({"key": keys[:-1], "repaired_sha256": [h.hexdigest() for h, _ in hashes[:-1]]})
                    keys, hashes = keys[-1:], hashes[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([h.hexdigest() for h, _ in hashes], pa.string())], ["key", "repaired_sha256"])

        return self._kept().repartition("key").sortWithinPartitions("key", "seg").mapInArrow(work, "key bigint, repaired_sha256 string")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest repair of every conversation of ``rows``.

    A conversation's rows are taken by turn, NULL turns first, ties by role and text.  A row's fault is blank, else duplicate (role and
    text seen before), else truncated (its last character that is no blank is none of ``.!?``).  Keep costs 0, Rerole to user or assistant
    3, Delete 4 (blank and duplicate rows must go), Insert of an empty user or assistant row 3; a truncated row that stays adds 3.
    What is left has role initials ``(s?(ua)+)?``.  Of repairs that cost the same the one of ASCII-least audit is taken.  NULL roles and
    texts count as one space, NULL conversation ids as one conversation; repeated rows are counted before they are sorted.  Other
    columns, whatever their names, are not read; an empty table gives no conversations.  A very long text is one value in its segment.
    """
    kind = rows.schema[conv_id].dataType.simpleString()
    found = faults(rows, conv_id, turn, role, text)
    order = [F.col("name").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    records = cut(segments(found.repartitionByRange(*order).sortWithinPartitions(*order), kind))
    return Repair(records, cut(choose(records, kind)))
