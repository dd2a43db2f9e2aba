"""Every dealt query and pipeline stage on tables with nulls, repeated rows, very long texts and clashing columns, and on empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladespark.llm import queries

EXTRA = ["n_lines", "n_dropped", "score", "predicted", "held_out", "kept", "component_id", "id", "th", "key", "sig", "spans", "blob", "size", "chunk", "rep", "family", "head", "seq", "at", "m"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
MORE = [None if i % 3 else "7" for i in range(len(EXTRA))]
LABELS = "doc_id long, quality int, toxic int, text string"
VECTORS = "vec_id long, embedding array<float>, label int, rep string, n string"


def word(rng):
    return "".join(rng.choice("abcdefghijklmno") for _ in range(5))


def spelt(rng, n):
    return " ".join(word(rng) for _ in range(n))


def rows(rng):
    base = spelt(rng, 120)
    out = {i: spelt(rng, 60) for i in range(1, 30)}
    out |= {40: base, 41: base, 42: base + " more", 43: None, 44: "", 45: " \n\t", 46: "x", 47: "é😀 " * 4, 48: "\n".join(spelt(rng, 40) for _ in range(2500)), 49: "z" * 300_000}
    law = "All rights reserved by the owner of this page"
    out |= {50 + i: f"{spelt(rng, 50)}\n{law}\n{spelt(rng, 12)}" for i in range(6)}
    out |= {60: f"password = hunter2hunter2 {spelt(rng, 30)}"}
    return [*out.items(), (41, base), (None, out[5]), (None, None), (None, spelt(rng, 50)), (None, None), (60, "other text of the same id " + spelt(rng, 30))]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rng, d = random.Random(11), str(tmp_path_factory.mktemp("edges"))
    data = rows(rng)
    spark.createDataFrame([(i, t, None if k % 2 else "en", None, 5, *MORE) for k, (i, t) in enumerate(data)], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, 0, "t") for i in range(1, 20)] + [(None, None, None, None), (3, None, None, "t"), (3, 1, 0, None)], LABELS).write.parquet(f"{d}/labels.parquet")
    v = [[float(rng.gauss(0, 1)) for _ in range(8)] for _ in range(20)]
    spark.createDataFrame([(i, x, i % 2, "r", None) for i, x in enumerate(v)] + [(30, v[0], 0, None, None), (None, v[0], 0, None, None), (31, None, 0, None, None), (32, [], 0, None, None), (30, v[0], 0, None, None)], VECTORS).write.parquet(f"{d}/embeddings.parquet")
    return d, data


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nothing"))
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("embeddings", VECTORS)):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, given, nothing, name):
    d, data = given
    out = queries.QUERIES[name](spark, d)
    n = out.count()
    table = spark.read.parquet(f"{d}/{'embeddings' if name.startswith('op7') else 'documents'}.parquet")
    if not name.startswith(("op3", "op4")):
        assert n == table.count()
    assert len(set(out.columns)) == len(out.columns)
    empty = queries.QUERIES[name](spark, nothing)
    assert empty.columns == out.columns and empty.count() == 0


def test_stages(spark, given, nothing):
    d, data = given
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = corpus_pipeline.cut(out)
        texts[name] = [(r.doc_id, r.text) for r in docs.collect()]
        assert [tuple(r) for r in docs.select(EXTRA).distinct().collect()] == [tuple(MORE)]
    order = lambda x: sorted(x, key=str)
    assert order(texts["toxicity"]) == order(data)  # no toxic labels: all stay
    law = "All rights reserved by the owner of this page"
    lines = texts["line dedup"]
    assert sum(law in (t or "") for _, t in lines) == 1 and len(lines) == len(data)
    # one row of each group; blank texts all stay
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sets = [(i, t, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for i, t in lines]
    kept = texts["minhash near-dedup"]
    blank = [(i, t) for i, t, s in sets if not s]
    assert order([(i, t) for i, t in kept if not words(t)]) == order(blank)
    some = [x for x in sets if x[2]]
    left = [x for x in some if (x[0], x[1]) in kept]
    assert len(kept) == len(blank) + len({(i, t) for i, t, _ in left})
    like = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    alone = list({(i, t): s for i, t, s in left}.values())
    assert not any(like(a, b) for k, a in enumerate(alone) for b in alone[:k])
    assert all(any(like(x[2], y[2]) for y in left) for x in some) and (5, dict(data)[5]) in kept and (None, dict(data)[5]) not in kept
    clean = dict(texts["secret scans"])
    assert not any("hunter2hunter2" in (t or "") for _, t in texts["secret scans"]) and len(texts["secret scans"]) == len(kept) and 60 in clean
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    none = spark.read.parquet(f"{nothing}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, nothing).count() == 0
