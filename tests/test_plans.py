"""Queries over whole tables against plain Python on small fixtures."""

import pytest
from pyspark.sql import functions as F

from cladespark.plans import queries as plans


@pytest.fixture
def tables(spark, monkeypatch):
    """Sets the stand-ins by name to (rows, schema)."""

    def set_(**given):
        made = {n: spark.createDataFrame(*x) for n, x in given.items()}
        monkeypatch.setattr(plans, "relation", lambda spark, sf_dir, name: made[name])
        monkeypatch.setattr(plans, "table", lambda spark, sf_dir, name: made[name])

    return set_


def test_redundant_patterns(spark, tables):
    held = {1: {1, 9}, 2: {1, 9}, 3: {1, 9}, 4: {1, 9}, 5: {1, 8}, 6: {7}}  # 1 to 5 are equal on samples up to 4
    tables(brand_cells=([(str(s), f"Brand#{v}", 1) for v, on in held.items() for s in on], "sample_id string, variant_id string, value int"))
    got = {r.variant_id: r.n for r in plans.QUERIES["redundant_patterns"](spark, "").collect()}
    assert got == {"Brand#1": 4, "Brand#3": 4, "Brand#4": 4, "Brand#5": 1, "Brand#6": 1}


EVENTS = ([(str(i), f"{kind}_{day}", 1) for i in range(40) for kind in ("view", "click") for day in (1, 2, 5, 30) if i * day % 7 < 4], "sample_id string, variant_id string, value int")


def test_all_regions(spark, tables):
    regions = [(i, 10 * i, 10 * i + 5) for i in range(1, 41)]
    tables(places=([(f"v{p}", p) for p in range(1, 420, 3)], "variant_id string, pos int"), regions=(regions, "idx int, start int, end int"))
    got = {r.variant_id: (r.nearest_idx, r.distance) for r in plans.QUERIES["nearest_region"](spark, "").collect()}
    for p in range(1, 420, 3):
        distance, idx = min((min(abs(p - 1 - a), abs(p - 1 - b)), i) for i, a, b in regions)
        assert got[f"v{p}"] == (idx, distance)
    coding = {r.variant_id for r in plans.QUERIES["coding_annotation"](spark, "").where("rel_pos is not null").collect()}
    assert coding == {f"v{p}" for p in range(1, 420, 3) if any(10 * i <= p - 1 < 10 * i + 9 for i in range(1, 41))}


@pytest.mark.parametrize("name", ["bootstrap_validation", "feature_confidence"])
def test_all_features(spark, tables, name):
    tables(event_cells=EVENTS, segment_labels=([(str(i), "ab"[i % 2]) for i in range(40)], "sample_id string, label string"))
    got = {r.variant_id for r in plans.QUERIES[name](spark, "").collect()}
    assert {v.split("_")[1] for v in got} == {"1", "2", "5", "30"} and len(got) == 8


def test_all_symbols(spark, tables):
    tables(event_cells=EVENTS, debt_labels=([(str(i), "ab"[i % 2]) for i in range(40)], "sample_id string, label string"))
    assert plans.user_symbols(spark, "")[0].select("marker").distinct().count() == 8


def test_circular_context(spark, tables):
    texts = {0: "Été\tà la mer " * 9, 3: "abc", 77: "x" * 59 + "1234567890 and more"}
    tables(documents=([*texts.items(), (5, ""), (6, None)], "doc_id long, text string"))
    got = {r.doc_id: r for r in plans.QUERIES["circular_context"](spark, "").collect()}
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    to = {ord(c): "ACGT"[i % 4] for s in (letters, letters.lower()) for i, c in enumerate(s)} | {32: "G"}
    assert set(got) == set(texts)
    for i, x in texts.items():
        s = x.translate(to)
        assert got[i].context == "".join(s[(i % len(s) + k) % len(s)] for k in range(-10, 11))
        assert got[i].reverse == s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_binary_sequences(spark):
    sf = "/root/testdata/sf0.001"
    whole = plans.QUERIES["binary_sequences"](spark, sf)
    sites = plans.QUERIES["carrier_sites"](spark, sf)
    n = plans.calls.sites(plans.call_table(spark, sf)).count()
    assert {r.n for r in whole.select(F.length("seq").alias("n")).distinct().collect()} == {n} and n >= sites.count() > 8
