"""Suffix-array dedup of byte strings by external induced sorting over sampled suffixes.

A full suffix array holds several bytes for each byte of text.  Only suffixes at anchors are sorted instead: each 400-byte string
picks the 300 bytes of smallest hash inside it, equal strings pick equal anchors, and every other suffix is induced from an
anchor's.  Spark's shuffle is the disk-backed queue that brings the tuples of equal anchors together in buckets of bounded size,
so a shard may be far larger than memory.

Step one counts contexts (the bytes that an anchor's strings cover).  A context found twice is repeated whole.  Step two takes one
copy of each context whose anchor has several: their suffix tuples are sorted, neighbours carry the length of their common
prefix, and the order one byte further left is induced from the order at hand (stable by the new byte; the common prefix of new
neighbours is one more than the least value between them).  A 400-byte string is repeated where that length reaches 400.  A passage
with very many different surroundings crowds its anchors; such contexts are not sorted in one place, their 400-byte strings are dealt
one by one by their own hash and counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.llm import rounds as R
from shelfledger.llm import textblock as B
from shelfledger.llm.shared import free_name, text_of

LENGTH = 400
ANCHOR = 300
ANCHOR_BYTES, CONTEXT_BYTES = 6, 8
CROWD = 4096  # different contexts of one anchor that are sorted together, about 2 MB


def gram_hashes(block: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` bytes."""
    at = np.arange(max(0, len(block) - width + 1))
    return B.range_hashes(B.BYTE_VALUE[block], at, at + width)


class Sample:
    """Anchors and contexts of a chunk's texts.  Texts never share a string: windows stay inside a row."""

    def __init__(self, rows: pa.Table, length: int, anchor: int, text: str):
        self.block, self.bounds = B.utf8(rows[text])
        n_windows = max(0, len(self.block) - length + 1)
        row_end = np.repeat(self.bounds[1:], np.diff(self.bounds))
        start = np.flatnonzero(np.arange(n_windows) + length <= row_end[:n_windows])
        grams = gram_hashes(self.block, anchor)
        picked = B.window_minima(grams, length - anchor + 1)[start].astype(np.int64)
        new = (np.diff(picked, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1)
        cuts = np.flatnonzero(new)
        self.begin = start[cuts]  # first string of each context
        self.size = np.diff(np.append(cuts, len(start)))  # strings in it
        self.place = picked[cuts] - self.begin  # the anchor's place in it
        self.anchor = grams[picked[cuts]] if len(cuts) else np.zeros(0, np.uint64)
        values = B.BYTE_VALUE[self.block]
        context = B.range_hashes(values, self.begin, self.begin + self.size - 1 + length)
        self.context = B.mix(context + self.place.astype(np.uint64))
        _, asker, of_asker, counts = np.unique(self.context, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(asker)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.asker, self.of_asker, self.often = asker[order], rank[of_asker], counts[order] > 1

    def bucket(self, buckets: int) -> np.ndarray:
        """An anchor is the least of many hashes, so its own high bits crowd near zero; they are mixed again to spread."""
        return R.spread(B.mix(self.anchor[self.asker]), buckets)

    def strings(self, asker: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all strings of the given askers' contexts, and the asker (its place in ``asker``) of each."""
        run = self.asker[asker]
        sizes = self.size[run]
        at = np.repeat(self.begin[run] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return B.range_hashes(B.BYTE_VALUE[self.block], at, at + length), np.repeat(np.arange(len(asker)), sizes)


def answer_contexts(bodies: list[bytes], crowd: int = CROWD) -> list[bytes]:
    """Per context: bit 0 if it occurs twice or more; if this chunk must show it in step two, bit 1, or bit 2 where its anchor is crowded."""
    step = ANCHOR_BYTES + CONTEXT_BYTES + 1
    sizes = [len(b) // step for b in bodies]
    anchor = np.concatenate([R.long(b[:n * ANCHOR_BYTES], ANCHOR_BYTES) for b, n in zip(bodies, sizes)])
    context = np.concatenate([R.long(b[n * ANCHOR_BYTES:n * (ANCHOR_BYTES + CONTEXT_BYTES)], CONTEXT_BYTES) for b, n in zip(bodies, sizes)])
    often = np.concatenate([np.frombuffer(b[n * (ANCHOR_BYTES + CONTEXT_BYTES):], np.uint8) for b, n in zip(bodies, sizes)])
    order = np.lexsort((context, anchor))
    group, cls = R.ordinals(order, anchor), R.ordinals(order, anchor, context)
    firsts = np.flatnonzero(np.diff(cls, prepend=-1))
    times = np.bincount(cls, 1 + often[order])
    kinds = np.bincount(group[firsts], minlength=group[-1] + 1)  # different contexts of each anchor
    code = (times[cls] > 1).astype(np.uint8)
    code[firsts] |= np.where(kinds[group[firsts]] > crowd, 4, np.where(kinds[group[firsts]] > 1, 2, 0)).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = code
    return [part.tobytes() for part in np.split(out, np.cumsum(sizes)[:-1])]


# -- induced sorting of contexts ---------------------------------------------------------------------------------------------

class RangeMinimum:
    """Least value between two positions, from tables of doubling spans."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        span = 1
        while 2 * span <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low + 1 .. high], low < high."""
        size = high - low
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(low), self.tables[0].dtype)
        for k in np.unique(level):
            at = level == k
            table = self.tables[k]
            out[at] = np.minimum(table[low[at] + 1], table[high[at] - (1 << int(k)) + 1])
        return out


def repeated_starts(group: np.ndarray, texts: list[bytes], place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, counted in each context, of a string that another context of its group holds too; -1 for none."""
    n = len(texts)
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not n:
        return first, last
    suffix = [t[p:] for t, p in zip(texts, place.tolist())]
    ranked = sorted(range(n), key=lambda i: (group[i], suffix[i]))
    order = np.array(ranked, np.int64)
    common = np.zeros(n, np.int64)  # common prefix with the suffix before
    for low in range(0, n, 4096):  # rows of a matrix, a slab at a time
        part = ranked[max(0, low - 1):low + 4096]
        sizes = np.array([len(suffix[i]) for i in part])
        width = int(sizes.max())
        matrix = np.frombuffer(b"".join(suffix[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
        differs = matrix[1:] != matrix[:-1]
        at = np.where(differs.any(1), differs.argmax(1), width)
        common[low + 1 if not low else low:low + 4096] = np.minimum(at, np.minimum(sizes[1:], sizes[:-1]))
    common[1:][group[order][1:] != group[order][:-1]] = 0
    joined = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    step = 0
    while len(order):
        after = np.append(common[1:], 0)
        hit = order[np.maximum(common, after) >= length]
        last[hit] = np.where(last[hit] < 0, place[hit] - step, last[hit])
        first[hit] = place[hit] - step
        step += 1
        on = np.flatnonzero(place[order] >= step)  # contexts that reach one byte further left
        if not len(on):
            break
        byte = joined[begin[order[on]] + place[order[on]] - step]
        kept = on[np.argsort(group[order[on]] * 256 + byte, kind="stable")]
        new = order[kept]
        key = group[new] * 256 + joined[begin[new] + place[new] - step]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        fresh = np.zeros(len(new), np.int64)
        if len(same):
            fresh[same] = 1 + RangeMinimum(common).between(kept[same - 1], kept[same])
        order, common = new, fresh
    return first, last


def answer_strings(bodies: list[bytes]) -> list[bytes]:
    """Per string hash: 1 if it was sent twice or more."""
    sizes = [len(b) // 8 for b in bodies]
    _, which, counts = np.unique(np.concatenate([R.long(b, 8) for b in bodies]), return_inverse=True, return_counts=True)
    return [part.tobytes() for part in np.split((counts[which] > 1).astype(np.uint8), np.cumsum(sizes)[:-1])]


def answer_shown(bodies: list[bytes], length: int) -> list[bytes]:
    """Answers to the contexts that are sorted here and to the strings of crowded anchors, which are dealt by their own hash."""
    both = [R.unpack(b) for b in bodies]
    return [R.pack(*pair) for pair in zip(answer_starts([b[0] for b in both], length), answer_strings([b[1] for b in both]))]


def answer_starts(bodies: list[bytes], length: int) -> list[bytes]:
    """Per shown context: first and last repeated start as two 16-bit numbers."""
    anchors, places, texts, sizes = [], [], [], []
    for body in bodies:
        n = int.from_bytes(body[:8], "little")
        anchors.append(R.long(body[8:8 + 8 * n], 8))
        places.append(np.frombuffer(body, "<u2", n, 8 + 8 * n))
        ends = np.cumsum(np.frombuffer(body, "<u2", n, 8 + 10 * n).astype(np.int64)) + 8 + 12 * n
        texts += [body[a:b] for a, b in zip([8 + 12 * n, *ends.tolist()], ends.tolist())]
        sizes.append(n)
    anchor, place = np.concatenate(anchors), np.concatenate(places).astype(np.int64)
    _, group = np.unique(anchor, return_inverse=True)
    first, last = repeated_starts(group.astype(np.int64), texts, place, length)
    both = np.stack([first, last], 1).astype("<i2")
    return [part.tobytes() for part in np.split(both, np.cumsum(sizes)[:-1])]


def dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = LENGTH,
          anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``removed`` (byte spans [start, end)) and ``kept`` (the remaining bytes).

    A byte goes if a ``length``-byte string that covers it starts anywhere else too, the same text included; strings are judged on
    the input and never cross rows.  ``anchor`` (at most ``length``) and ``crowd`` change the work, not the result.  A NULL text is empty.
    Repeated rows repeat each other, ties don't arise.  Input columns with the names of the new ones are replaced, all others are kept
    whatever their names; an empty table gives an empty table.  ``kept`` is binary: a cut may fall inside a character.  A text is read in
    one piece, so a very long one takes memory in proportion to its bytes.
    """
    docs = docs.drop("n_bytes", "n_removed", "removed", "kept")
    names = docs.columns
    id_name, text_name = free_name(docs, "_id"), free_name(docs, "_text")
    base = docs.select("*", F.col(row_id).cast("bigint").alias(id_name), text_of(text).alias(text_name))

    def codes(s: Sample, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        out = np.zeros(len(s.asker), np.uint8)
        for bucket, part in R.by_bucket(s.bucket(buckets)):
            out[part] = np.frombuffer(answers[bucket], np.uint8)
        return out

    def ask_contexts(rows: pa.Table, answers: dict, buckets: int) -> dict[int, bytes]:
        s = Sample(rows, length, anchor, text_name)
        grams, context = s.anchor[s.asker], s.context[s.asker]
        return {b: R.short(grams[part], ANCHOR_BYTES) + R.short(context[part], CONTEXT_BYTES) + s.often[part].astype(np.uint8).tobytes()
                for b, part in R.by_bucket(s.bucket(buckets))}

    def shown(s: Sample, code: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
        at = np.flatnonzero(code & 2)
        return [(b, at[part]) for b, part in R.by_bucket(s.bucket(buckets)[at])]

    def ask_shown(rows: pa.Table, answers: dict, buckets: int) -> dict[int, bytes]:
        s = Sample(rows, length, anchor, text_name)
        data = s.block.tobytes()
        code = codes(s, answers.get(0, {}), buckets)
        sorted_here = {}
        for bucket, part in shown(s, code, buckets):
            run = s.asker[part]
            sizes = s.size[run] - 1 + length
            sorted_here[bucket] = b"".join([len(part).to_bytes(8, "little"), R.short(s.anchor[run], 8), s.place[run].astype("<u2").tobytes(),
                                    sizes.astype("<u2").tobytes(),
                                            *[data[a:a + n] for a, n in zip(s.begin[run].tolist(), sizes.tolist())]])
        hashes, _ = s.strings(np.flatnonzero(code & 4), length)
        dealt = {b: R.short(hashes[part], 8) for b, part in R.by_bucket(R.spread(B.mix(hashes), buckets))}
        nothing = (0).to_bytes(8, "little")
        return {b: R.pack(sorted_here.get(b, nothing), dealt.get(b, b"")) for b in sorted_here.keys() | dealt.keys()}

    def finish(rows: pa.Table, answers: dict, buckets: int) -> pa.Table:
        s = Sample(rows, length, anchor, text_name)
        code = codes(s, answers.get(0, {}), buckets)
        first, last = np.full(len(s.asker), -1, np.int64), np.full(len(s.asker), -1, np.int64)
        replies = {bucket: R.unpack(body) for bucket, body in answers.get(1, {}).items()}
        for bucket, part in shown(s, code, buckets):
            both = np.frombuffer(replies[bucket][0], "<i2").reshape(-1, 2)
            first[part], last[part] = both[:, 0], both[:, 1]
        crowded = np.flatnonzero(code & 4)
        hashes, owner = s.strings(crowded, length)
        again = np.zeros(len(hashes), bool)
        for bucket, part in R.by_bucket(R.spread(B.mix(hashes), buckets)):
            again[part] = np.frombuffer(replies[bucket][1], np.uint8) > 0
        inner = np.arange(len(hashes)) - np.searchsorted(owner, owner)
        who = owner[again]
        last[crowded[who]] = inner[again]  # ascending, so the last one stays
        first[crowded[who[::-1]]] = inner[again][::-1]
        whole = (code & 1) > 0
        first[whole], last[whole] = 0, s.size[s.asker][whole] - 1
        first, last = first[s.of_asker], last[s.of_asker]
        hit = first >= 0
        edge = np.zeros(len(s.block) + 1, np.int64)
        np.add.at(edge, s.begin[hit] + first[hit], 1)
        np.add.at(edge, s.begin[hit] + last[hit] + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        spans, kept = [], []
        for a, b in zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist()):
            flags = gone[a:b]
            change = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
            spans.append([{"start": x, "end": y} for x, y in zip(change[::2].tolist(), change[1::2].tolist())])
            kept.append(s.block[a:b][~flags].tobytes())
        return pa.table({**{n: rows[n] for n in names}, "n_bytes": pa.array(np.diff(s.bounds), pa.int64()),
                         "n_removed": pa.array(np.diff(total[s.bounds]), pa.int64()),
                         "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         "kept": pa.array(kept, pa.binary())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    steps = [R.Step(ask_contexts, lambda bodies: answer_contexts(bodies, crowd)), R.Step(ask_shown, lambda bodies: answer_shown(bodies, length))]
    return R.converse(base, id_name, text_name, steps, finish,
                      f"{schema}, n_bytes bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
