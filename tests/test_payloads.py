"""Payloads as VARIANT: odd fields have named issues, one scan reads all chains, no payload is lost."""

import json

import pytest

from shelfledger.plans.all_queries import QUERIES
from shelfledger.sources import payloads as X

SCHEMA = "seq int, chain string, source_url string, variant_id string, parent_id string, payload string"


def cps(price, special=0, **more):
    return json.dumps({"general": {"name": "iPhone 17-Đen", "odd": [1]}, "filterable": {"price": price, "special_price": special, "stock": 3, **more}, "new": {"a": 1}})


def rows(spark, *payloads, chain="CellphoneS"):
    return spark.createDataFrame([(i, chain, "u", "77", "p1", p) for i, p in enumerate(payloads)], SCHEMA)


def test_numbers_as_text_and_broken_json(spark):
    table = rows(spark, cps(20_000_000), cps("20000000"), cps("20000000", "19000000"), cps("twenty"), cps(20_000_000, "19k"), cps(20_000_000)[:-20],
                 None, "[]", cps({"amount": 5}), cps(20_000_000, stock="x"), cps(5))
    got = {r.seq: (r.quoted_price, r.issue) for r in X.quotes_cps(table).collect()}
    assert got == {0: (20_000_000, None), 1: (20_000_000, None), 2: (19_000_000, None), 3: (None, "price_not_number"), 4: (None, "price_not_number"),
                   5: (None, "broken_json"), 6: (None, "no_payload"), 7: (None, "no_payload"), 8: (None, "price_not_number"), 9: (20_000_000, None),
                   10: (None, "price_range")}


def test_every_payload_gives_one_row(spark):
    known = rows(spark, cps(20_000_000), "{", None)
    table = known.union(rows(spark, cps(1), "x", chain="Other")).union(rows(spark, "{}", None, chain=None)).union(rows(spark, "{}", chain="FPT Shop"))
    got = X.read_all(table).collect()
    assert len(got) == table.count()
    assert sorted((r.chain or "", r.issue or "") for r in got) == sorted([
        ("CellphoneS", ""), ("CellphoneS", "broken_json"), ("CellphoneS", "no_payload"), ("Other", "no_reader"), ("Other", "no_reader"), ("", "no_reader"),
        ("", "no_reader"), ("FPT Shop", "no_payload")])
    assert "payload" not in X.read_all(table).columns
    quotes, issues = X.split_quotes(X.read_all(table))
    assert quotes.count() + issues.count() == table.count()


@pytest.mark.parametrize("name", ["ext1_quotes_cps", "ext2_quotes_fpt", "ext3_quotes_pv", "ext4_quotes_mw", "ext5_quotes_vt", "ext5_quotes_vt_preorder"])
def test_readers_need_no_exchange(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "from_json" not in plan


def test_one_scan_for_all_chains(spark):
    plan = QUERIES["udx1_reader_registry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
