"""The pipeline's rows against stage by stage plain Python."""

import random
import re

import public_tokenizers
import pytest
from test_dedup import brute_words
from test_native import base_counts
from test_near_copies import brute_roots, shingles
from test_pii import brute
from test_simhash_packing import check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from shelfledger.llm import quality_lines

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fault(line, rules):
    solid, tokens = len(line.replace(" ", "")), line.count(" ") + 1
    bars, symbols = line.count("|"), len(re.findall(quality_lines.SYMBOL, line))
    upper = sum(c.isupper() for c in line)
    return ((bars >= rules.bars and tokens <= bars * (rules.words_per_bar + 1) + rules.words_per_bar) or symbols * 100 > solid * rules.symbol_percent
            or (solid >= rules.upper_chars and upper * 100 > solid * rules.upper_percent)
            or (len(line) <= rules.boilerplate_chars and any(p in line.lower() for p in quality_lines.BOILERPLATE)))


def plain_clean(text):
    rules = quality_lines.LineRules()
    counts = base_counts(text)
    good = [x for x in (text or "").split("\n") if not plain_fault(x, rules)]
    left = sum(map(len, GAP.findall("\n".join(good))))
    return None if counts[5] or (counts[1] - left) * 100 > counts[1] * rules.max_lost_percent else "\n".join(good)


def plain_cut(text, window_kept):
    """The text without removed words and the blanks before them; ``window_kept`` says which words stay."""
    out, at = [], 0
    for keep, m in zip(window_kept, GAP.finditer(text)):
        if keep:
            out.append(text[at:m.end()])
        at = m.end()
    return "".join([*out, text[at:]])


def plain_redact(text):
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in brute(text)))
    out, at = [], 0
    for a, b, k in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(900)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    edited = lambda text, n: " ".join([*text.split()[:30], *words(n), *text.split()[30 + n:]])  # 16 words: alike, though fingerprints differ
    passage, original = " ".join(words(60)), " ".join(words(200))
    texts = [None, "", "too short", original, *[original] * 15, original.replace("word1 ", "other ", 1), edited(original, 16), edited(original, 60), "same again and again " * 40]
    for i in range(40):
        body = " ".join(words(80)) + ("\nHome | Shop | News | Help\n" if i % 5 == 0 else "\n") + " ".join(words(60))
        texts.append(body + (f"\n{passage} " if i % 3 == 0 else " ") + (f"mail a.b{i}@host.example or +1 (555) 123-45{i:02d}" if i % 4 == 0 else "end"))
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)] + [(3, original, None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_pipeline_against_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}, []
    for (name, stage), after in zip(corpus_pipeline.STAGES, ("quality", "near", "substring", "pii", None)):
        if after == "quality":
            rows = {d: c for d, t in rows.items() if (c := plain_clean(t)) is not None}
        elif after == "near":
            roots = brute_roots(list(rows.items()))
            rows = {d: t for d, t in rows.items() if roots[shingles(t)] == d}
        elif after == "substring":
            ordered = sorted(rows.items())
            kept = [k for _, _, k in brute_words(ordered)]
            left = {}
            for (d, t), k in zip(ordered, kept):
                marks, want = [], k.split()
                whole = GAP.findall(t)
                # Removed words are those of windows found in a smaller id; the kept list is a subsequence with the same order.
                first = {}
                for e, x in ordered:
                    if e < d:
                        w = GAP.findall(x)
                        first |= dict.fromkeys(tuple(w[i:i + 13]) for i in range(len(w) - 12))
                gone = {i + j for i in range(len(whole) - 12) if tuple(whole[i:i + 13]) in first for j in range(13)}
                marks = [i not in gone for i in range(len(whole))]
                assert [w for w, m in zip(whole, marks) if m] == want
                left[d] = plain_cut(t, marks)
            rows = left
        elif after == "pii":
            rows = {d: plain_redact(t) for d, t in rows.items()}
        docs = stage(spark, docs, folder)
        if after:
            assert docs.columns == columns, name
            got = docs.collect()
            assert {r["doc_id"]: r["text"] for r in got} == rows, name
            if after != "quality":
                assert len(got) == len(rows), name
            assert all(r["n_chars"] in (len(r["text"]), None) for r in got if after in ("quality", "substring", "pii"))
        seen.append(len(rows))
    assert seen[0] > seen[1] > 20
    used, least = check_packing(docs.collect(), rows, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert used <= least + 2
    assert sorted(corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()) == sorted(docs.drop("sequence_id", "offset").collect())


def test_pipeline_of_nothing(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_stage_runs_once(spark, folder, monkeypatch):
    """One pass over what each stage returns: rows counted in the tasks that make them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [spark.sparkContext.accumulator(0) for _ in corpus_pipeline.STAGES[:-1]]

    def counted(stage, seen):
        def work(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return lambda s, d, f: (found := stage(s, d, f)).mapInArrow(work, found.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, counted(f, c)) for (n, f), c in zip(corpus_pipeline.STAGES, counts)] + corpus_pipeline.STAGES[-1:])
    packed = corpus_pipeline.run(spark, folder)
    assert 0 < packed.select("doc_id").distinct().count() <= counts[-1].value <= counts[1].value < counts[0].value < docs.count()
    assert counts[1].value == counts[2].value == counts[3].value
