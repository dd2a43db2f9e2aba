"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors are compared only within a label. Equal vectors form a class, of which one is indexed. Labels with more classes than a
shard holds get pivots from a bounded sample, thinned so that no two are alike, and each vector goes to its ``OVERLAP``
nearest pivots' shards. In each shard a graph is built: nearest and random candidates of each node, robustly pruned. The
shards' adjacency lists are united over all shards of a node, and in each shard every vector is searched for from the
shard's medoid: greedily, then expanding through nodes in range. What is found is verified by cosine in double precision.
A pair that shares several shards counts in the first of them; each task returns counts and stars, never pairs.

Vectors that are null, zero or hold null or non-finite components, null labels and null ids link with nothing; their
component is their own id, and rows with a null id are not kept. Vectors of different dimension are not compared. Repeated ids keep
a row each. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import components, cut, lean, only

#: Vectors of a shard, about; shards of each vector; sampled vectors of a label that pivots are drawn from, and pivots, at most.
SHARD, OVERLAP, SAMPLE, PIVOTS = 1500, 3, 4096, 65_536
#: Out-edges to near and to far nodes, near and random candidates, pruning factor, beam width, edges read at a greedy step.
NEAR, FAR, POOL, LONG, ALPHA, BEAM, READ = 16, 6, 48, 12, 1.2, 16, 32
#: Pivots of a label are less alike than this.
APART = 0.6


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(a.flatten(), np.float64).reshape(len(a), -1)


def build(x: np.ndarray) -> list[np.ndarray]:
    """Out-neighbours of every row of unit vectors ``x`` after robust pruning, and the links back."""
    n = len(x)
    y, rng, heads, tails = x.astype(np.float32), np.random.default_rng(n), [], []
    for at in range(0, n, 256):
        b = np.arange(at, min(n, at + 256))
        sim = y[b] @ y.T
        sim[np.arange(len(b)), b] = -2
        k = min(POOL, n - 1)
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        for pool, most in ((near, NEAR), (rng.integers(0, n, (len(b), LONG)), FAR)):
            s = np.take_along_axis(sim, pool, axis=1)
            order = np.argsort(-s, axis=1, kind="stable")
            pool, s = np.take_along_axis(pool, order, axis=1), np.take_along_axis(s, order, axis=1)
            among = np.matmul(y[pool], y[pool].transpose(0, 2, 1))
            alive, rows = s > -2, np.arange(len(b))
            for _ in range(most):
                pick = alive.argmax(axis=1)
                some = alive[rows, pick]
                if not some.any():
                    break
                heads.append(b[some])
                tails.append(pool[rows, pick][some])
                alive &= ALPHA * (1 - among[rows, pick]) > 1 - s
                alive[rows, pick] = False
    if not heads:
        return [np.zeros(0, np.int64)] * n
    h, t = np.concatenate(heads), np.concatenate(tails)
    pair = np.unique(np.concatenate([h * n + t, t * n + h]))
    return np.split(pair % n, np.searchsorted(pair // n, np.arange(1, n)))


def search(x: np.ndarray, lists: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows of ``x`` found to be in range, each once; ``lists``: the adjacency of each row."""
    n = len(x)
    y = x.astype(np.float32)
    size = np.array([len(a) for a in lists])
    flat = np.concatenate(lists) if n and size.sum() else np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    read = np.full((n, READ), -1, np.int64)
    for i, a in enumerate(lists):  # a spread of a long list, the whole of a short one
        a = a if len(a) <= READ else a[np.linspace(0, len(a) - 1, READ).astype(int)]
        read[i, : len(a)] = a
    medoid = int((y @ y.sum(axis=0)).argmax())
    found = []
    for at in range(0, n, 128):
        q = np.arange(at, min(n, at + 128))
        seen = np.zeros((len(q), n), bool)
        rows = np.arange(len(q))
        beam = np.full((len(q), BEAM), -1)
        score = np.full((len(q), BEAM), -3, np.float32)
        open_ = np.zeros((len(q), BEAM), bool)
        beam[:, 0], score[:, 0], open_[:, 0] = medoid, y[q] @ y[medoid], True
        seen[:, medoid] = True
        while open_.any():
            best = np.where(open_, score, -4).argmax(axis=1)
            go = open_[rows, best]
            open_[rows, best] = False
            step = np.where(go[:, None], read[beam[rows, best]], -1)
            ok = (step >= 0) & ~seen[rows[:, None], step]
            r, c = np.nonzero(ok)
            seen[r, step[r, c]] = True
            s = np.full(step.shape, -3, np.float32)
            s[r, c] = np.einsum("ij,ij->i", y[q[r]], y[step[r, c]])
            score, beam, open_ = (np.concatenate(p, axis=1) for p in ((score, s), (beam, step), (open_, ok)))
            top = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
            score, beam, open_ = (np.take_along_axis(a, top, axis=1) for a in (score, beam, open_))
            open_ &= score > -3
            if (hit := beam == q[:, None]).any():  # arrived: what is near lies around it
                open_ &= ~hit.any(axis=1)[:, None]
        # expansion through nodes in range, from what the greedy search reached and from the vector's own node
        inside = np.zeros((len(q), n), bool)
        r, c = np.nonzero((beam >= 0) & (score >= threshold - 1e-4))
        inside[r, beam[r, c]] = True
        inside[rows, q] = True
        tried = inside.copy()
        r, c = np.nonzero(inside)
        good = np.einsum("ij,ij->i", x[q[r]], x[c]) >= threshold
        inside[r[~good], c[~good]] = False
        r, c = r[good], c[good]
        while len(r):
            m = size[c]
            end = np.cumsum(m)
            nbr = flat[np.repeat(begin[c] - (end - m), m) + np.arange(end[-1] if len(end) else 0)]
            key = np.unique(np.repeat(r, m) * n + nbr)
            key = key[~tried.ravel()[key]]
            tried.ravel()[key] = True
            r, c = key // n, key % n
            good = np.zeros(len(r), bool)
            for k in range(0, len(r), 65_536):
                part = slice(k, k + 65_536)
                good[part] = np.einsum("ij,ij->i", x[q[r[part]]], x[c[part]]) >= threshold
            r, c = r[good], c[good]
            inside[r, c] = True
        inside[rows, q] = False
        r, c = np.nonzero(inside)
        a, b = np.minimum(q[r], c), np.maximum(q[r], c)
        found.append(np.unique(a * n + b))
    pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pair // max(1, n), pair % max(1, n)


def roots(n: int, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each of n nodes the node with the least key in its component of the links (a, b)."""
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    top = np.arange(n)
    a, b = rank[a], rank[b]
    while True:
        old = top.copy()
        low = np.minimum(top[a], top[b])
        np.minimum.at(top, a, low)
        np.minimum.at(top, b, low)
        np.minimum.at(top, old[a], low)
        np.minimum.at(top, old[b], low)
        top = top[top]
        if np.array_equal(top, old):
            return order[top[rank]]


def deal(classes: DataFrame, shard: int, overlap: int) -> DataFrame:
    """(shard, rep, m, homes, v): each class in the shards of its nearest pivots."""
    big = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > shard)
    big = big.orderBy(F.desc("n"), "label", "dim").limit(PIVOTS)
    plan = {(r.label, r.dim): r.n for r in big.collect()}  # of labels that need splitting, one row each, at most PIVOTS
    pivots: dict[tuple, np.ndarray] = {}
    whole = sum(plan.values())
    if plan:
        share = {k: max(2, min(PIVOTS * n // whole, -(-n * overlap // shard))) for k, n in plan.items()}
        budget = F.lit(SAMPLE if len(plan) <= 64 else max(4, 64 * SAMPLE // len(plan)))
        from pyspark.sql import Window as W

        some = classes.join(F.broadcast(big.select("label", "dim")), ["label", "dim"]).withColumn("h", F.xxhash64("rep"))
        some = some.where(F.pmod("h", F.lit(1 << 20)) < F.lit(int(min(1.0, 3 * SAMPLE * max(1, min(64, len(plan))) / whole) * (1 << 20)) + 1))
        some = some.withColumn("k", F.row_number().over(W.partitionBy("label", "dim").orderBy("h", "rep"))).where(F.col("k") <= budget)
        rows: dict[tuple, list] = {}
        for r in some.select("label", "dim", "h", "v").collect():  # the bounded sample
            rows.setdefault((r.label, r.dim), []).append((r.h, r.v))
        for key, got in rows.items():
            x = unit(np.array([v for _, v in sorted(got, key=lambda p: p[0])], np.float64))
            kept = x[:1]
            for v in x[1:]:
                if len(kept) >= share[key]:
                    break
                if (kept @ v).max() < APART:
                    kept = np.vstack([kept, v])
            pivots[key] = kept.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keys = list(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
            homes: list[list[str]] = [[f"{k}"] for k in keys]
            for key in set(keys) & set(pivots):
                at = [i for i, k in enumerate(keys) if k == key]
                p = pivots[key]
                sim = unit(matrix(t.column(4).take(pa.array(at)))).astype(np.float32) @ p.T
                k = min(overlap, len(p))
                best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                for i, b in zip(at, best.tolist(), strict=True):
                    homes[i] = [f"{key}{c:05d}" for c in sorted(b)]
            yield pa.RecordBatch.from_arrays([t.column(2), t.column(3), pa.array(homes, pa.list_(pa.string())), t.column(4)], ["rep", "m", "homes", "v"])

    kind = classes.schema["rep"].dataType.simpleString()
    dealt = classes.select("label", "dim", "rep", "m", "v").mapInArrow(lean(run), f"rep {kind}, m bigint, homes array<string>, v array<double>")
    return dealt.select(F.explode("homes").alias("shard"), "rep", "m", "homes", "v")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard: int = SHARD, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector; links: verified pairs with cosine >= ``threshold``."""
    src = only(vectors, id_col, vec_col, label_col).toDF("id", "e", "label").withColumn("v", F.col("e").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(finite & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    src = src.select("id", "label", F.when(fit, F.col("v")).alias("v"))
    k1 = F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "label", "v"))
    k2 = F.when(F.col("v").isNotNull(), F.xxhash64("v", "label", F.lit(2)))
    src = src.withColumn("k1", k1).withColumn("k2", k2)
    classes = src.where("v is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("dim", F.size("v")))
    dealt = cut(deal(classes, shard, overlap))
    kind = classes.schema["rep"].dataType.simpleString()

    def graph(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t.column("rep")))
        rep = np.asarray(t.column("rep"))
        lists = build(unit(matrix(t.column("v"))))
        return pa.table([t.column("rep"), pa.array([rep[a] for a in lists], pa.list_(t.schema.field("rep").type))], ["rep", "nbrs"])

    edges = dealt.groupBy("shard").applyInArrow(graph, f"rep {kind}, nbrs array<{kind}>")
    # a node has at most ``overlap`` lists
    united = edges.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))

    def links(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t.column("rep")))
        here, rep = t.column("shard")[0].as_py(), np.asarray(t.column("rep"))
        nbrs = t.column("nbrs").combine_chunks()
        to, off = np.asarray(nbrs.flatten()), np.asarray(nbrs.offsets)
        off = off - off[0]
        pos = np.minimum(np.searchsorted(rep, to), len(rep) - 1)
        inside = rep[pos] == to
        lists = [pos[i:j][inside[i:j]] for i, j in zip(off, off[1:], strict=False)]
        a, b = search(unit(matrix(t.column("v"))), lists, threshold)
        homes = t.column("homes").to_pylist()
        names = sorted({h for row in homes for h in row if h < here})
        at = {h: i for i, h in enumerate(names)}
        other = np.zeros((len(rep), max(1, len(names))), bool)  # earlier shards of each vector
        for i, row in enumerate(homes):
            other[i, [at[h] for h in row if h < here]] = True
        own = np.ones(len(a), bool)
        for k in range(0, len(a), 65_536):
            p = slice(k, k + 65_536)
            own[p] = ~(other[a[p]] & other[b[p]]).any(axis=1)
        m = np.asarray(t.column("m"), np.int64)
        n = np.bincount(a[own], weights=m[b[own]], minlength=len(rep)) + np.bincount(b[own], weights=m[a[own]], minlength=len(rep))
        return pa.table([t.column("rep"), pa.array(n.astype(np.int64)), pa.array(rep[roots(len(rep), a, b, rep)])], ["rep", "n", "root"])

    found = dealt.join(united, "rep").groupBy("shard").applyInArrow(links, f"rep {kind}, n bigint, root {kind}")
    found = cut(found)
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    n = found.groupBy("rep").agg(F.sum("n").alias("n"))
    per = classes.select("k1", "k2", "rep", "m").join(n, "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per = per.select("k1", "k2", (F.col("n") + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = src.select("id", "k1", "k2").join(per, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def recall(vectors: DataFrame, result: DataFrame, threshold: float = 0.93, every: int = 20) -> float:
    """Share of true links that were found, for queries whose id is divisible by ``every``: brute force in blocks, for audits.

    A task holds the queries of the labels it sees and a batch of rows.
    """
    rows = only(vectors, "vec_id", "embedding", "label").where("embedding is not null and label is not null")
    queries = [(r.vec_id, r.label, r.embedding) for r in rows.where(F.col("vec_id") % every == 0).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([q[0] for q in queries])
        lab = np.array([q[1] for q in queries])
        x = unit(np.array([q[2] for q in queries], np.float64))
        for t in batches:
            y = unit(matrix(t.column(1)))
            hit = (x @ y.T >= threshold) & (lab[:, None] == np.asarray(t.column(2))) & (ids[:, None] != np.asarray(t.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hit.sum(axis=1))], ["vec_id", "n"])

    truth = rows.mapInArrow(lean(run), "vec_id bigint, n bigint").groupBy("vec_id").agg(F.sum("n").alias("n"))
    got = truth.join(result.select("vec_id", "n_links"), "vec_id").agg(F.sum("n"), F.sum("n_links")).first()
    return float(got[1]) / got[0] if got[0] else 1.0
