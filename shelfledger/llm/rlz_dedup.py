"""Substring dedup by relative Lempel-Ziv parsing of documents against an index of all earlier documents.

The reference is indexed in blocks by anchor: each window of 13 words picks the 7 words of smallest hash inside it, and the block
of that anchor keeps the anchor's contexts (the words that its windows cover) with the smallest document that has them.  Equal
windows pick equal anchors, so a document needs only the blocks of its own anchors, not every block of the corpus.  Step one
settles whole contexts: a context found in an earlier document lies inside a factor.  Contexts that differ around a shared anchor
are where factors end; step two compares them window by window, so no window across a factor's boundary is missed.  Factors are
then the maximal runs of consecutive windows found earlier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.llm import rounds as R
from shelfledger.llm import textblock as B
from shelfledger.llm.shared import free_name, text_of

WINDOW = 13
ANCHOR = 7
ANCHOR_BYTES, CONTEXT_BYTES = 6, 8
LAST = np.iinfo(np.int64).max  # stands for a NULL id: no document is later


class Parse:
    """Words, windows, anchors and contexts of a chunk's texts."""

    def __init__(self, rows: pa.Table, window: int, row_id: str, text: str):
        self.block, self.bounds = B.utf8(rows[text])
        self.starts, self.ends, self.first = B.words(self.block, self.bounds)
        ids = rows[row_id].combine_chunks() if isinstance(rows[row_id], pa.ChunkedArray) else rows[row_id]
        self.ids = ids.fill_null(LAST).to_numpy()
        self.word_row = B.row_numbers(self.first)
        values = B.range_hashes(B.BYTE_VALUE[self.block], self.starts, self.ends)
        n = len(values)
        anchor = min(ANCHOR, window)
        at = np.arange(max(0, n - anchor + 1))
        grams = B.range_hashes(values, at, at + anchor)
        start = np.arange(max(0, n - window + 1))
        start = start[self.word_row[start] == self.word_row[start + window - 1]] if len(start) else start
        picked = B.window_minima(grams, window - anchor + 1)[start]
        cuts = np.flatnonzero(np.diff(picked, prepend=-1) | (np.diff(start, prepend=-2) != 1)) if len(start) else np.zeros(0, np.int64)
        self.window_start = start
        self.run = cuts  # first window of each context
        self.run_size = np.diff(np.append(cuts, len(start)))
        self.anchor = grams[picked[cuts]] if n else np.zeros(0, np.uint64)
        begin = start[cuts]
        self.context = B.mix(B.range_hashes(values, begin, begin + self.run_size - 1 + window) + (picked[cuts] - begin).astype(np.uint64))
        self.run_row = self.word_row[begin] if n else np.zeros(0, np.int64)
        self.values = values
        # The same context asks once per chunk, for the first document that has it.
        _, self.asker, self.of_asker = np.unique(self.context, return_index=True, return_inverse=True)
        order = np.argsort(self.asker)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.asker, self.of_asker = self.asker[order], place[self.of_asker]

    def bucket(self, buckets: int) -> np.ndarray:
        """An anchor is the least of several hashes, so its own high bits crowd near zero; they are mixed again to spread."""
        return R.spread(B.mix(self.anchor[self.asker]), buckets)


def _doc_bytes(ids: np.ndarray) -> bytes:
    """Ids column by column, so that the shuffle's compression finds their common bytes."""
    return np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _docs(body: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _split(values: np.ndarray, sizes: list[int]) -> list[bytes]:
    return [part.tobytes() for part in np.split(values, np.cumsum(sizes)[:-1])]


def answer_contexts(bodies: list[bytes]) -> list[bytes]:
    """Per context: 1 if an earlier document has it; 2 if its first document must show its windows; else 0."""
    parts = [R.unpack(b) for b in bodies]
    anchor = np.concatenate([R.long(p[0], ANCHOR_BYTES) for p in parts])
    context = np.concatenate([R.long(p[1], CONTEXT_BYTES) for p in parts])
    doc = np.concatenate([_docs(p[2]) for p in parts])
    order = np.lexsort((doc, context, anchor))
    group, cls = R.ordinals(order, anchor), R.ordinals(order, anchor, context)
    least = doc[order][np.flatnonzero(np.diff(cls, prepend=-1))][cls]
    firsts = np.flatnonzero(np.diff(cls, prepend=-1))
    contested = (np.bincount(group[firsts], minlength=group[-1] + 1) > 1)[group]
    verdict = np.where(doc[order] > least, 1, np.where(contested, 2, 0)).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = verdict
    return _split(out, [len(p[0]) // ANCHOR_BYTES for p in parts])


def answer_windows(bodies: list[bytes]) -> list[bytes]:
    """Per window: 1 if an earlier document has it."""
    parts = [R.unpack(b) for b in bodies]
    window = np.concatenate([R.long(p[0], 8) for p in parts])
    doc = np.concatenate([_docs(p[1]) for p in parts])
    order = np.lexsort((doc, window))
    cls = R.ordinals(order, window)
    least = doc[order][np.flatnonzero(np.diff(cls, prepend=-1))][cls]
    out = np.empty(len(order), np.uint8)
    out[order] = doc[order] > least
    return _split(out, [len(p[0]) // 8 for p in parts])


def _verdicts(parse: Parse, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    out = np.zeros(len(parse.asker), np.uint8)
    for bucket, part in R.by_bucket(parse.bucket(buckets)):
        out[part] = np.frombuffer(answers[bucket], np.uint8)
    return out


def _shown(parse: Parse, verdict: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the windows that contested contexts show, and the asker each belongs to."""
    asker = np.flatnonzero(verdict == 2)
    runs = parse.asker[asker]
    sizes = parse.run_size[runs]
    index = np.repeat(parse.run[runs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return index, np.repeat(asker, sizes)


def dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``factors`` (word spans [start, end) found in earlier documents), ``kept_words``
    (the other words joined by one space) and ``kept_text`` (the text without the removed words and the blanks before them).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id; windows are judged on
    the input.  A NULL text has no words.  Rows with the same id never remove each other's words; a NULL id counts as the latest.
    Input columns with the names of the new ones are replaced, all others are kept whatever their names; an empty table gives an empty
    table.  A text is read in one piece, so a very long one takes memory in proportion to its words.
    """
    docs = docs.drop("n_words", "n_removed", "factors", "kept_words", "kept_text")
    names = docs.columns
    id_name, text_name = free_name(docs, "_id"), free_name(docs, "_text")
    base = docs.select("*", F.col(row_id).cast("bigint").alias(id_name), text_of(text).alias(text_name))

    def ask_contexts(rows: pa.Table, answers: dict, buckets: int) -> dict[int, bytes]:
        p = Parse(rows, window, id_name, text_name)
        anchor, context, doc = p.anchor[p.asker], p.context[p.asker], p.ids[p.run_row[p.asker]]
        return {b: R.pack(R.short(anchor[part], ANCHOR_BYTES), R.short(context[part], CONTEXT_BYTES), _doc_bytes(doc[part]))
                for b, part in R.by_bucket(p.bucket(buckets))}

    def ask_windows(rows: pa.Table, answers: dict, buckets: int) -> dict[int, bytes]:
        p = Parse(rows, window, id_name, text_name)
        index, asker = _shown(p, _verdicts(p, answers.get(0, {}), buckets), window)
        at = p.window_start[index]
        hashes, doc = B.range_hashes(p.values, at, at + window), p.ids[p.word_row[at]]
        # By the window's own hash: the contexts of one anchor may be many, their windows are dealt evenly.
        return {b: R.pack(R.short(hashes[part], 8), _doc_bytes(doc[part])) for b, part in R.by_bucket(R.spread(hashes, buckets))}

    def finish(rows: pa.Table, answers: dict, buckets: int) -> pa.Table:
        p = Parse(rows, window, id_name, text_name)
        verdict = _verdicts(p, answers.get(0, {}), buckets)
        index, asker = _shown(p, verdict, window)
        seen = np.zeros(len(index), np.uint8)
        shown_at = p.window_start[index]
        for bucket, part in R.by_bucket(R.spread(B.range_hashes(p.values, shown_at, shown_at + window), buckets)):
            seen[part] = np.frombuffer(answers[1][bucket], np.uint8)
        # A context is earlier than this occurrence if another chunk has it earlier, or an earlier document of this chunk.
        early = (verdict == 1)[p.of_asker] | (p.ids[p.run_row] > p.ids[p.run_row[p.asker]][p.of_asker])
        found = np.repeat(early, p.run_size)
        shown = np.full(len(p.asker), -1, np.int64)
        first = np.flatnonzero(np.diff(asker, prepend=-1))
        shown[asker[first]] = first
        runs = np.flatnonzero(~early & (shown[p.of_asker] >= 0))
        sizes = p.run_size[runs]
        inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found[np.repeat(p.run[runs], sizes) + inner] = seen[np.repeat(shown[p.of_asker[runs]], sizes) + inner] > 0
        edge = np.zeros(len(p.starts) + 1, np.int64)
        at = p.window_start[found]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        return _result(rows, names, p, gone)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return R.converse(base, id_name, text_name, [R.Step(ask_contexts, answer_contexts), R.Step(ask_windows, answer_windows)], finish,
                      f"{schema}, n_words bigint, n_removed bigint, factors array<struct<start:int,end:int>>, kept_words string, kept_text string")


def _result(rows: pa.Table, names: list[str], p: Parse, gone: np.ndarray) -> pa.Table:
    n_rows = rows.num_rows
    n_words = np.diff(p.first)
    n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[p.first])
    data = p.block.tobytes()
    words_out, text_out, factors = [], [], []
    for r in range(n_rows):
        a, b = p.first[r], p.first[r + 1]
        whole = data[p.bounds[r]:p.bounds[r + 1]]
        flags = gone[a:b]
        change = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
        spans = list(zip(change[::2].tolist(), change[1::2].tolist()))
        factors.append([{"start": s, "end": e} for s, e in spans])
        starts, ends = p.starts[a:b], p.ends[a:b]
        words_out.append(b" ".join([data[s:e] for s, e in zip(starts[~flags].tolist(), ends[~flags].tolist())]).decode())
        if not spans:
            text_out.append(whole.decode())
            continue
        kept, at = [], int(p.bounds[r])
        for s, e in spans:
            kept.append(data[at:int(ends[s - 1]) if s else int(p.bounds[r])])
            at = int(ends[e - 1])
        text_out.append(b"".join([*kept, data[at:p.bounds[r + 1]]]).decode())
    columns = {name: rows[name] for name in names}
    return pa.table({**columns, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                     "factors": pa.array(factors, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                     "kept_words": pa.array(words_out, pa.string()), "kept_text": pa.array(text_out, pa.string())})
