"""Corpus queries against their SQL, on small tables with links, secrets, nulls and ties."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cladespark.llm.queries import ORACLES, QUERIES


def texts():
    rng = random.Random(11)
    base = [rng.choice("red blue green the a of".split()) + str(rng.randrange(40)) for _ in range(200)]
    out = [None, "", " \t", "one", "ONE", "two words", " ".join(base), " ".join(base).upper()]
    for k in (3, 8, 11, 12, 14, 30):  # more and more words differ
        new = list(base)
        for i in rng.sample(range(200), k):
            new[i] = "new"
        out.append(" ".join(new))
    key = "AKIA" + "ABCDEFGH12345678"
    out += [f"日本 password = \"hunter2hunter\" and Token:abc api-key='{'f' * 30}'", f"é😀 {key} x {key}9 AKIA1 " + "0a" * 12 + " " + "0a" * 11, f"SECRET : {'a1' * 20}\nsecret:{key}", "paſſword=abcdefgh toKen=abcdefgh"]
    out += ["-----BEGIN RSA PRIVATE KEY-----\nx\n-----BEGIN PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij token=eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij"]
    return out


def vectors():
    rng = np.random.default_rng(5)
    out = []
    for label in range(3):
        for _ in range(6):
            v = rng.normal(size=16)
            for noise in (0, 0, 0.1, 0.2, 0.3, 0.35):
                out.append(((v + noise * rng.normal(size=16)).tolist(), label))
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 16]
    return out + [(v, label) for v in odd for label in (0, None)] + [([1.0] * 16, None), ([2.0] * 16, 0)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    t, v = texts(), vectors()
    pq.write_table(pa.table({"doc_id": pa.array(range(len(t)), pa.int64()), "text": t}), path / "documents.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(range(len(v)), pa.int64()), "embedding": pa.array([x[0] for x in v], pa.list_(pa.float32())), "label": pa.array([x[1] for x in v], pa.int32())}), path / "embeddings.parquet")
    return path


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    got = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLES[name]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(tuple(r) for r in got.select(*columns).collect())
    assert rows == sorted(want)
    # the fixture has something to find
    if "kept" in columns:
        assert len({r[columns.index("component_id")] for r in rows}) <= len(rows) - 5
    else:
        assert sum(r[columns.index("n_access")] for r in rows) > 2
