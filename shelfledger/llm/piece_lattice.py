"""SentencePiece encoding over a relational lattice, and decoding.

Words (a run of word marks and the characters up to the next mark) are cut where no piece can stand across two neighbouring
characters, and the parts are encoded once each: their substrings up to the longest piece are exploded and joined to the piece table,
the edges are grouped by part, and a higher-order ``aggregate`` folds them.  For a unigram model the fold is Viterbi's: the best score
and the last edge at each position.  A BPE model's scores are merge ranks, not probabilities, and the best path is not what the model
means; there the fold merges the neighbours of best score until none is left.  Documents are packed into chunks, compressed once for
their only exchange.  A chunk asks buckets of words for each of its different parts once, as one row for each bucket, and hears their
ids by position; numpy strings the ids of parts, words and texts together.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm import textblock as B
from shelfledger.llm.rounds import chunk_counts

MARK = "▁"  # stands for a blank
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
LONG = 48  # longer words are folded where they stand, on a heap; a grouped lattice row stays small, and its cuts fit the bits of a long
NONE = -1e18
ROWS = 1024  # decoded at once
CHUNK = 4 << 20  # bytes of text in a chunk; the larger, the fewer words are asked for twice and the more memory it takes
ZSTD = pa.Codec("zstd", 6)


@dataclass(frozen=True)
class Model:
    """Pieces of a model file whose texts are taken as they are (identity normalisation), with byte fallback if it has bytes."""

    path: str
    kind: str = "bpe"  # or "unigram"
    dummy_prefix: bool = True

    def pieces(self) -> list[tuple[str, int, float]]:
        p = _processor(self.path)
        return [(p.id_to_piece(i), i, p.get_score(i)) for i in range(p.get_piece_size())
                if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]

    def bytes(self) -> list[int]:
        """Id of each byte, or [] without byte fallback."""
        p = _processor(self.path)
        found = {int(p.id_to_piece(i)[3:5], 16): i for i in range(p.get_piece_size()) if p.is_byte(i)}
        return [found[b] for b in range(256)] if found else []


@cache
def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def split_words(text: str, dummy_prefix: bool = True) -> list[str]:
    if not text:
        return []
    return WORD.findall((MARK if dummy_prefix else "") + text.replace(" ", MARK))


class Neighbours:
    """Which two characters stand side by side in a piece."""

    def __init__(self, pieces: Iterable[str]):
        pairs = np.array([[ord(c) for c in pair] for pair in sorted({p[i:i + 2] for p in pieces for i in range(len(p) - 1)})], np.int64).reshape(-1, 2)
        self.limit = int(pairs.max(initial=0)) + 1
        kinds = []
        for column in pairs.T:
            chars, kind = np.unique(column, return_inverse=True)
            numbers = np.zeros(self.limit + 1, np.uint16)  # 0: in no pair
            numbers[chars] = np.arange(1, len(chars) + 1)
            kinds.append((numbers, kind + 1, len(chars) + 1))
        (self.left, a, n), (self.right, b, m) = kinds
        self.table = np.zeros((n, m), bool)
        self.table[a, b] = True

    def joined(self, codes: np.ndarray) -> np.ndarray:
        """For each code point but the last, whether it and the next are neighbours in a piece."""
        known = np.minimum(codes, self.limit)
        return self.table[self.left[known[:-1]], self.right[known[1:]]]


def parted(words: list[str], pairs: Neighbours | None) -> tuple[list[str], np.ndarray]:
    """The words' parts and the number of each word's.  They are cut wherever no piece holds both neighbours: no edge crosses such a place,
    so the parts are folded by themselves.  Words hold no blank.
    """
    if pairs is None or not words:
        return words, np.ones(len(words), np.int64)
    codes = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
    blank = codes == 32
    cuts = np.flatnonzero(~(pairs.joined(codes) | blank[:-1] | blank[1:])) + 1
    sizes = np.bincount(np.cumsum(blank)[cuts], minlength=len(words)) + 1
    return np.insert(codes, cuts, 32).tobytes().decode("utf-32-le").split(" "), sizes


# -- lattice ---------------------------------------------------------------------------------------------------------------

def edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(bucket, word, lattice): for each row of ``words`` (bucket, word) its edges (score, before, size, ends, between, id).

    ``before`` is the start, negated, so that the greatest edge is the leftmost of best score; ``ends`` and ``between`` are bits of places:
    both ends, and all places between them.  Words dealt by their bucket are not dealt again, and are numbered, so that edges are grouped
    by a number in their order.  A word without any piece has no row; the caller folds it where it stands.
    """
    numbered = words.select("bucket", "word", F.monotonically_increasing_id().alias("number"))  # not beside an explode, whose rows it would number
    starts = numbered.select("*", F.explode(F.expr("sequence(0, length(word) - 1)")).alias("start"))
    places = starts.select("*", F.explode(F.expr(f"sequence(1, least({longest}, length(word) - start))")).alias("size"))
    found = (places.withColumn("piece", F.expr("substring(word, start + 1, size)"))
             .join(F.broadcast(pieces), "piece"))  # the piece table has as many rows as the model has pieces
    edge = F.expr("""struct(score, -start AS before, size, shiftleft(1L, start) | shiftleft(1L, start + size) AS ends,
        shiftleft(shiftleft(1L, size - 1) - 1L, start + 1) AS between, id)""")
    return found.groupBy("number", "bucket").agg(F.first("word").alias("word"), F.collect_list(edge).alias("lattice")).drop("number")


# cuts of the word, as bits, after merging the best neighbours, leftmost first, until no two form a piece
MERGE_FOLD = """aggregate(sequence(1, greatest(1, length(word) - 1)), shiftleft(1L, length(word) + 1) - 1L, (cut, n) ->
    cut & ~coalesce(array_max(filter(merges, x -> (cut & x.ends) = x.ends AND bit_count(cut & x.between) = 1)).between, 0L))"""


def _viterbi_fold(longest: int, unknown: float) -> Column:
    """Best score at each position and, negated, where its last edge starts (of equal paths, the one with the longer last edge).

    A character that no piece covers costs ``unknown``.
    """
    return F.expr(f"""aggregate(sequence(1, length(word)), array(struct(0D AS score, 0 AS back)), (state, e) -> concat(state, array(array_max(
        transform(sequence(1, least({longest}, e)), l -> struct(
            state[e - l].score + coalesce(scores[(e - l) * 64 + l], CASE WHEN l = 1 THEN {unknown}D ELSE {NONE}D END) AS score,
            l - e AS back))))))""")


VITERBI_CUTS = """aggregate(sequence(1, length(word)), array(length(word)), (cuts, n) ->
    CASE WHEN cuts[0] > 0 THEN concat(array(-best[cuts[0]].back), cuts) ELSE cuts END)"""


def fold(lattices: DataFrame, model: Model, longest: int) -> DataFrame:
    """(bucket, word, cuts, ids): piece ids between the cuts, NULL where no piece fits (the caller falls back to bytes).

    ``cuts`` is NULL where all ids are known, since only the fallback needs it.
    """
    if model.kind == "bpe":
        merges = lattices.withColumn("merges", F.expr("filter(lattice, x -> x.size > 1)"))
        cut = merges.withColumn("cut", F.expr(MERGE_FOLD)).withColumn("cuts", F.expr("filter(sequence(0, length(word)), p -> (cut & shiftleft(1L, p)) != 0)"))
    else:
        least = min(s for _, _, s in model.pieces())
        scored = lattices.withColumn("scores", F.expr("map_from_entries(transform(lattice, x -> struct(x.size - 64 * x.before, x.score)))"))
        cut = (scored.withColumn("best", _viterbi_fold(longest, least - 10)).withColumn("cuts", F.expr(VITERBI_CUTS))
               .withColumn("cut", F.expr("aggregate(cuts, 0L, (cut, c) -> cut | shiftleft(1L, c))")))
    path = cut.withColumn("path", F.expr("filter(lattice, x -> (cut & x.ends) = x.ends AND (cut & x.between) = 0)")).select("bucket", "word", "cuts", "path")
    ids = path.withColumn("ids", F.expr("transform(slice(cuts, 1, size(cuts) - 1), c -> get(filter(path, x -> x.before = -c), 0).id)"))
    return ids.select("bucket", "word", F.when(F.size("path") < F.size("cuts") - 1, F.col("cuts")).alias("cuts"), "ids")


def with_bytes(word: str, cuts: list[int] | None, ids: list[int | None], byte_ids: list[int], unknown: int) -> list[int]:
    if cuts is None:
        return ids
    out: list[int] = []
    for start, end, one in zip(cuts, cuts[1:], ids):
        if one is not None:
            out.append(one)
        elif byte_ids:
            out += [byte_ids[b] for b in word[start:end].encode()]
        elif not out or out[-1] != unknown:
            out.append(unknown)  # neighbouring unknown characters are one unknown piece
    return out


def merge_long(word: str, table: dict[str, tuple[int, float]]) -> list[int]:
    """Cuts of a long word by the merge rule, with the neighbours' scores on a heap."""
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        b = end[a] if a >= 0 else n
        if a >= 0 and b < n and (hit := table.get(word[a:end[b]])):
            heapq.heappush(heap, (-hit[1], a, end[b]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, a, stop = heapq.heappop(heap)
        b = end[a]
        if not alive[a] or b >= n or not alive[b] or end[b] != stop:
            continue
        alive[b] = False
        end[a] = stop
        if stop < n:
            before[stop] = a
        offer(a)
        offer(before[a])
    return [i for i in range(n) if alive[i]] + [n]


def viterbi_long(word: str, table: dict[str, tuple[int, float]], longest: int, unknown: float) -> list[int]:
    score, back = [0.0], [0]
    for e in range(1, len(word) + 1):
        found = [(score[s] + (table[p][1] if (p := word[s:e]) in table else unknown if e - s == 1 else NONE), -s) for s in range(max(0, e - longest), e)]
        best = max(found)
        score.append(best[0])
        back.append(-best[1])
    cuts = [len(word)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


# -- documents -------------------------------------------------------------------------------------------------------------

def packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=ZSTD)) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def unpacked(bodies: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(body).read_all() for body in bodies)


def spelled(texts: pa.ChunkedArray, prefix: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of the texts, in the order they are met; which of them the texts' words are, and the number of words of each text.

    Where single blanks part a text, its words are told apart without their marks.  A word may be listed twice, by a plain text and another.
    """
    def keys(text: str | None) -> Iterable[str]:
        plain = text and prefix and not (text[0] == " " or text[-1] == " " or "  " in text or MARK in text)
        return text.split(" ") if plain else [" " + w for w in split_words(text, prefix)]

    place: defaultdict[str, int] = defaultdict()
    place.default_factory = place.__len__  # a new word gets the next number
    at = [np.fromiter(map(place.__getitem__, keys(t)), np.int32) for t in texts.to_pylist()]
    words = [k[1:] if k[0] == " " else MARK + k for k in place]
    return words, np.concatenate([np.zeros(0, np.int32), *at]), np.fromiter(map(len, at), np.int64, len(at))


def dealt(parts: Iterable[str], buckets: int) -> dict[int, list[str]]:
    """Different parts by bucket, in order; long ones are not asked for."""
    asked: dict[int, list[str]] = {}
    for w in parts:
        if len(w) <= LONG:
            asked.setdefault(zlib.crc32(w.encode()) % buckets, []).append(w)
    return asked


def questions(texts: pa.ChunkedArray, buckets: int, prefix: bool, pairs: Neighbours | None = None) -> dict[int, list[str]]:
    """The different words of the texts, or their parts, by bucket, in order; long ones are not asked for."""
    return dealt(dict.fromkeys(parted(spelled(texts, prefix)[0], pairs)[0]), buckets)


def reply(words: list[str], known: dict[str, list[int]], kind: np.dtype) -> bytes:
    """Number of ids of each word (none: not known), then all ids.  A word of ``LONG`` characters has at most four times as many."""
    found = [known.get(w, ()) for w in words]
    plain = bytes(map(len, found)) + np.fromiter(chain.from_iterable(found), kind).tobytes()
    return len(plain).to_bytes(8, "little") + ZSTD.compress(plain, asbytes=True)


def opened(n: int, body: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Number of ids of each of ``n`` words, and all ids."""
    plain = ZSTD.decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True)
    return np.frombuffer(plain, np.uint8, n), np.frombuffer(plain, kind, -1, n)


def heard(words: list[str], body: bytes, kind: np.dtype) -> dict[str, list[int]]:
    counts, ids = opened(len(words), body, kind)
    ids, ends = ids.tolist(), np.cumsum(counts, dtype=np.int64).tolist()
    return {w: ids[end - n:end] for w, n, end in zip(words, counts.tolist(), ends) if n}


def gathered(place: dict[str, int], asked: dict[int, list[str]], replies: Iterable[tuple[int, bytes]], kind: np.dtype,
             alone: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of ids end to end, their sizes, and which list each word of ``place`` (by number) has; words without a reply are folded ``alone``.

    The ids stay arrays: a list of numbers for each word takes many times their memory.
    """
    order, counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for bucket, body in replies:
        n, some = opened(len(asked[bucket]), body, kind)
        order.append(np.fromiter(map(place.__getitem__, asked[bucket]), np.int64, len(n)))
        counts.append(n.astype(np.int64))
        ids.append(some.astype(np.int32))
    answered, sizes = np.concatenate(order), np.concatenate(counts)
    at, known = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    at[answered] = np.arange(len(answered))
    known[answered[sizes > 0]] = True
    rest = [np.array(alone(w), np.int32) for w, k in zip(place, known.tolist()) if not k]
    at[~known] = len(answered) + np.arange(len(rest))
    return np.concatenate([*ids, *rest]), np.concatenate([sizes, np.fromiter(map(len, rest), np.int64, len(rest))]), at


def lists(column: pa.ChunkedArray) -> list[list[int]]:
    """Rows of numbers as Python lists; -1 for a NULL number."""
    values = pc.fill_null(pc.list_flatten(column), -1).to_numpy().tolist()
    sizes = pc.list_value_length(column).to_numpy()
    return [values[end - n:end] for n, end in zip(sizes.tolist(), np.cumsum(sizes, dtype=np.int64).tolist())]


def strung(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` are lists of ``sizes`` end to end.  Those at ``at`` end to end, and how many ids each of ``groups`` (numbers of lists) has."""
    n = sizes[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    found = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n) + np.arange(ends[-1])]
    last = np.cumsum(groups)
    return found, ends[last] - ends[last - groups]


def encode(docs: DataFrame, model: Model, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``ids``.  A NULL or empty text has none; repeated rows are encoded alike; an input column ``ids`` is replaced, all
    others are kept.  An empty table gives an empty table.  A very long text is cut into words in one piece, each of which is looked up once.
    Rows need no id: ``row_id`` may repeat or be NULL.
    """
    spark = docs.sparkSession
    docs = docs.drop("ids")
    names = docs.columns
    pieces = model.pieces()
    longest = max(len(p) for p, _, _ in pieces)
    table = {p: (i, s) for p, i, s in pieces}
    byte_ids, unknown_id, unknown = model.bytes(), _processor(model.path).unk_id(), min(s for _, _, s in pieces) - 10
    kind = np.min_scalar_type(_processor(model.path).get_piece_size())
    _, buckets = chunk_counts(docs, text)
    prefix, bpe, pairs = model.dummy_prefix, model.kind == "bpe", Neighbours(table)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's number is a hash of its rows, its task and its place there: rows dealt otherwise in a retry never meet its answers."""
        task = TaskContext.get().partitionId()
        for place, rows in enumerate(B.slabs(batches, text, CHUNK)):
            body = packed(rows)
            chunk = hashlib.blake2b(body, digest_size=8, salt=task.to_bytes(8, "little") + place.to_bytes(8, "little")).digest()
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([int.from_bytes(chunk, "little", signed=True)], pa.int64()), "body": pa.array([body], pa.binary())})

    def ask(rows: pa.Table) -> pa.Table:
        asked = questions(unpacked(rows["body"].to_pylist())[text], buckets, prefix, pairs)
        chunk = str(rows["chunk"][0].as_py())  # in front of the words, so that both readers of the list need the same columns of one exchange
        return pa.table({"bucket": pa.array(list(asked), pa.int32()), "asked": pa.array([" ".join([chunk, *w]) for w in asked.values()], pa.string())})

    def answer(asked: pa.Table, folded: pa.Table) -> pa.Table:
        known = dict(zip(folded["word"].to_pylist(), lists(folded["ids"])))
        for row in folded.filter(pc.is_valid(folded["cuts"])).to_pylist():
            known[row["word"]] = with_bytes(row["word"], row["cuts"], row["ids"], byte_ids, unknown_id)
        replies = [(int((words := row.split(" "))[0]), reply(words[1:], known, kind)) for row in asked["asked"].to_pylist()]
        return pa.table({"chunk": pa.array([c for c, _ in replies], pa.int64()), "bucket": asked["bucket"],
                         "ids": pa.array([body for _, body in replies], pa.binary())})

    def alone(word: str) -> list[int]:
        cuts = merge_long(word, table) if bpe else viterbi_long(word, table, longest, unknown)
        return with_bytes(word, cuts, [table.get(word[a:b], (None,))[0] for a, b in zip(cuts, cuts[1:])], byte_ids, unknown_id)

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        docs = unpacked(rows["body"].to_pylist())
        words, at, sizes = spelled(docs[text], prefix)
        parts, cut_in = parted(words, pairs)
        place = {w: i for i, w in enumerate(dict.fromkeys(parts))}
        ids, counts, lists_at = gathered(place, dealt(place, buckets), zip(answers["bucket"].to_pylist(), answers["ids"].to_pylist()), kind, alone)
        part_at = lists_at[np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))]
        del words, parts, place
        ids, counts = strung(ids, counts, part_at, cut_in)
        ids, counts = strung(ids, counts, at, sizes)
        if not byte_ids:  # neighbouring unknown characters are one unknown piece, in different parts too
            same = np.zeros(len(ids), bool)
            same[1:] = (ids[1:] == unknown_id) & (ids[:-1] == unknown_id)
            same[(np.cumsum(counts) - counts)[counts > 0]] = False
            dropped = np.concatenate([[0], np.cumsum(same)])
            ends = np.cumsum(counts)
            ids, counts = ids[~same], counts - dropped[ends] + dropped[ends - counts]
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
        return pa.table({**{n: docs[n] for n in names}, "ids": out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    chunks = docs.mapInArrow(pack, "chunk bigint, body binary").groupBy("chunk")
    asked = chunks.applyInArrow(ask, "bucket int, asked string").repartition(buckets, "bucket")
    words = asked.select("bucket", F.explode(F.expr("slice(split(asked, ' '), 2, length(asked))")).alias("word")).distinct()  # they hold no blank
    table_rows = spark.createDataFrame(pieces, "piece string, id int, score double")
    folded = fold(edges(words, table_rows, longest), model, longest).withColumnRenamed("bucket", "word_bucket")
    answers = asked.groupBy("bucket").cogroup(folded.groupBy("word_bucket")).applyInArrow(answer, "chunk bigint, bucket int, ids binary")
    return chunks.cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"{schema}, ids array<int>")


def decode(rows: DataFrame, model: Model, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: pieces joined, bytes put together, marks turned to blanks, the dummy blank taken off.

    NULL ids decode to the empty text; bytes that are no valid UTF-8 become replacement characters.
    """
    p = _processor(model.path)
    parts = [p.id_to_piece(i).replace(MARK, " ").encode() for i in range(p.get_piece_size())]
    for b, i in enumerate(model.bytes()):
        parts[i] = bytes([b])
    for i in range(len(parts)):
        if p.is_control(i):
            parts[i] = b""
        elif p.is_unknown(i):
            parts[i] = " ⁇ ".encode()
    prefix = model.dummy_prefix
    rows = rows.drop("decoded")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                some = batch.slice(low, ROWS)
                flat, sizes = some[ids].flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(some[ids]), 0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes, dtype=np.int64).tolist()
                texts = [b"".join(map(parts.__getitem__, flat[end - n:end].tolist())).decode("utf-8", "replace") for n, end in zip(sizes.tolist(), ends)]
                texts = [t[1:] if prefix and t.startswith(" ") else t for t in texts]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*some.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{schema}, decoded string")
