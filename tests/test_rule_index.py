"""Rules by token index and crawl rules by path prefixes, against every rule on every row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import product as P
from shelfledger.operators import crawl
from shelfledger.operators import rule_index as R
from shelfledger.sources.rules import read_rule_files, rule_rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("pattern, words", [
    (r"\biPhone\s+18\s+Pro(?!\s+max)\b", ["18", "iphone", "pro"]), (r"\bmac\s*mini\b", []), (r"\bipad\b(?=[\s\S]*\bM4\b)", ["ipad", "m4"]),
    (r"apple\s+watch", []), (r"\b(?:one|two)\s+three\b", ["three"]), (r"\ba\s+(b)\s+c\b", ["a", "b", "c"]), (r"\bwatch\s+(?:x)?\b", ["watch"]),
    (r"\bđen\s+không\s+gian\b", ["gian", "không", "đen"]), (r"\bfoo-bar\b", ["bar", "foo"]), (r"\bfoo?\b", []), (r"\b11(?:\s*inch)?\b", []), (r"", [])])
def test_words_that_a_pattern_needs(pattern, words):
    assert R.pattern_words(pattern) == words


def test_every_word_is_needed():
    """A text with the pattern holds the words, whatever stands around it."""
    rng = random.Random(4)
    pieces = [" ", "  ", "-", "iPhone", "17", "Pro", "max", "Mac", "mini", "macmini", "iPad", "A16", "Air", "M4", "11", "11inch", "MacBook", "M5", "apple", "watch", "s11",
              "airpods", "4", "anc", "Ultra", "3", "2", "x"]
    hits = 0
    for _ in range(30_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        words = set(re.split(r"\W+", text.lower()))
        for _, pattern in V.MODEL_RULES:
            if re.search(pattern, text, re.I):
                hits += 1
                assert set(R.pattern_words(pattern)) <= words, (pattern, text)
    assert hits > 300


def test_same_hits_as_every_rule_on_every_text(spark):
    rng = random.Random(6)
    names = [n for n, _ in V.MODEL_RULES]
    texts = [None, "", "Mac  MINI m4", "MACMINI", "iphone 17 và iPhone 16", "Ốp lưng iPhone 17 Pro Max"] + [
        f"{rng.choice(['Máy', 'Ốp', '(new)', ''])} {rng.choice(names)} {rng.choice(['5G', 'pro', '11 inch', 'M5 Pro', 'chống ồn', '13inch'])} {rng.choice(['', rng.choice(names)])}"
        for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "seq int, product_name string")
    got = R.with_hits(rows, R.rule_index(rule_rows(spark, V.MODEL_RULES)))
    want = rows.select("seq", P.rule_hits(F.col("product_name"), V.MODEL_RULES).alias("hits"))
    assert {r.seq: r.hits for r in got.collect()} == {r.seq: r.hits for r in want.collect()}
    assert got.count() == rows.count()


def test_five_thousand_rules_check_few_pairs(spark):
    """What is searched with a pattern follows the hits, not the rules; no pattern column reaches a JVM regex."""
    rules = [(f"phone {i}", rf"\bphone\s+{i}(?!\s+pro)\b") for i in range(5000)] + [("twice", r"\bphone\s+7\b")]
    index = R.rule_index(rule_rows(spark, rules))
    rows = spark.range(3000).selectExpr("id", "concat('A phone ', id * 2, if(id % 5 = 0, ' pro', ''), ' 128GB') AS product_name")
    pairs = R.candidates(rows, index, "product_name")
    assert rows.count() * 1.1 > pairs.count() >= 2500
    got = R.with_hits(rows, index)
    assert "RLIKE" not in plan(got)
    found = {r.id: r.hits for r in got.collect()}
    assert found[3] == ["phone 6"] and found[5] == [] and found[2999] == [] and len(found) == 3000
    assert R.only_hit is not None and got.filter(R.only_hit().isNotNull()).count() == 2000


def test_rules_of_each_brand_from_files(spark, tmp_path):
    for brand, models in (("A", [("one", r"\bx\s+1\b"), ("two", r"\bx\b")]), ("B", [("other", r"\bx\b")])):
        spark.createDataFrame([(brand, models)], "brand string, models array<struct<name:string,pattern:string>>").write.mode("append").json(str(tmp_path / "rules"))
    index = R.rule_index(read_rule_files(spark, str(tmp_path / "rules")), ["brand"])
    rows = spark.createDataFrame([(1, "A", "X 1"), (2, "B", "X 1"), (3, "C", "X 1"), (4, None, "x"), (5, "A", None)], "seq int, brand string, product_name string")
    got = {r.seq: r.hits for r in R.with_hits(rows, index, by=["brand"]).collect()}
    assert got == {1: ["one", "two"], 2: ["other"], 3: [], 4: [], 5: []}


# -- crawl rules -------------------------------------------------------------------------------------------------------------------

def allowed(target, rules):
    best = (-1, True)
    for pattern, allow in rules:
        body = pattern[:-1] if pattern.endswith("$") else pattern
        regex = "^" + ".*".join(map(re.escape, body.split("*"))) + ("$" if pattern.endswith("$") else "")
        if pattern and re.search(regex, target):
            best = max(best, (len(pattern), allow))
    return best[1]


def policy(spark, targets, rules):
    pages = spark.createDataFrame([(i, f"https://h.example{t}") for i, t in enumerate(targets)], "page_id int, url string")
    table = spark.createDataFrame([("h.example", "*", p, a, 1.0) for p, a in rules], "host string, agent string, pattern string, allow boolean, delay double")
    return crawl.crawl_policy(pages, table, "bot")


def test_prefixes_and_wildcards(spark):
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "ab", "/", "?q=", ".html", "aa"])
    targets = ["/" + "".join(part() for _ in range(rng.randrange(0, 7))) for _ in range(250)]
    for _ in range(3):
        rules = [("/" + "".join(rng.choice([part(), "*", "**"]) for _ in range(rng.randrange(0, 4))) + rng.choice(["", "$", "*$"]), rng.random() < 0.5) for _ in range(25)]
        rules += [("*", False), ("", True), ("/x*y*$", True), ("*a", True)][:rng.randrange(5)]
        got = {r.page_id: r.allowed for r in policy(spark, targets, rules).collect()}
        assert got == {i: allowed(t, rules) for i, t in enumerate(targets)}


def test_ten_thousand_rules_on_a_host(spark):
    rules = [(f"/p/{i}/", i % 3 == 0) for i in range(10_000)] + [("/p/", False), ("/p/77*end$", True)]
    targets = [f"/p/{i * 7 % 12_000}/x" for i in range(900)] + ["/p/770/the-end", "/p/770/ends", "/q"]
    df = policy(spark, targets, rules)
    assert "RLIKE" not in plan(df)
    table = dict(rules)
    got = {r.page_id: r.allowed for r in df.collect()}
    for i, t in enumerate(targets[:-3]):
        assert got[i] == table.get("/".join(t.split("/")[:3]) + "/", False)
    assert [got[i] for i in range(900, 903)] == [True, False, True]
