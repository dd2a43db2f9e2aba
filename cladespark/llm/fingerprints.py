"""Document fingerprints by locally consistent parsing.

A text is parsed bottom-up into phrases. On each level runs of one name become a name, deterministic coin tossing reduces the names to
at most six labels of which neighbours differ (a label is the lowest bit in which a name differs from its left neighbour,
with that bit's value; four rounds), and a phrase starts at each local maximum. A phrase is named by a hash of its
names, and the names are the next level. Cuts depend on a few names around them only, so equal substrings get equal phrases inside,
whatever their offset. A fingerprint holds, for each level, the least phrase names; likeness is the weighted share of names in
common, a bottom-k estimate of the phrase sets' Jaccard index.

Null texts count as empty; an empty text has an empty fingerprint, which is like another empty one (1) and no other (0).
Equal texts have equal fingerprints. Repeated rows are neighbours of each other; ties of ids go by text. A null id comes
last. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import lean, only, small_batches

#: Phrase names kept and weight, for each level from the first.
LEVELS = ((8, 0.15), (16, 0.3), (24, 0.55))
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a range of ids, about, and ranges at most; a range is read as a stream.
RANGE_ROWS, RANGES = 4096, 10_000
SOME = 30_000  # characters parsed at a time


def _toss() -> np.ndarray:
    """The label after a round, by previous label (128: none) and label."""
    a, b = np.meshgrid(np.arange(129), np.arange(128), indexing="ij")
    d = (a ^ b) & 0xFF
    low = d & -d
    k = np.where(d > 0, np.log2(np.maximum(low, 1)).astype(int), 0)
    out = 2 * k + ((b >> k) & 1)
    out[128] = np.arange(128) & 1
    return out.astype(np.uint8).ravel()


TOSS = _toss()
POWER = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of phrases, and where each text's phrases start; ``first``: where each non-empty text's names start."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    if len(at) < len(x):
        run = np.diff(np.append(at, len(x)))
        x = x[at].astype(np.uint64)
        many = run > 1
        x[many] = mixed(x[many] + run[many].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        first = np.searchsorted(at, first)
    d = np.empty_like(x)
    d[0] = 1
    np.bitwise_xor(x[1:], x[:-1], out=d[1:])
    d[first] = 1
    d &= -d
    k = np.bitwise_count(d - x.dtype.type(1)).astype(np.uint8)
    label = (k << 1) | ((x >> k.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)
    prev = np.empty(len(x), np.uint16)
    for _ in range(3):
        prev[0] = 128
        prev[1:] = label[:-1]
        prev[first] = 128
        prev <<= 7
        prev |= label & 127
        label = TOSS[prev]
    begin = np.ones(len(x), bool)
    begin[1:] = label[1:] > label[:-1]
    begin[:-1] &= label[:-1] > label[1:]
    last = np.append(first[1:], len(x)) - 1
    begin[last] = False
    begin[first] = True
    start = np.flatnonzero(begin)
    after = np.minimum(first + 1, len(x) - 1)  # a text's first phrase has two names at least, if it can
    lone = after[begin[after] & ~np.isin(after, first)]
    if len(lone):
        begin[lone] = False
        start = np.flatnonzero(begin)
    size = np.diff(np.append(start, len(x)))
    place = np.arange(len(x)) - np.repeat(start, size)
    names = np.add.reduceat(mixed(x.astype(np.uint64) + np.uint64(1)) * POWER[np.minimum(place, 63)], start)
    return mixed(names), np.searchsorted(start, first)


def sketches(texts: list[str]) -> list[list[np.ndarray]]:
    """The sorted least phrase names, 32 bits each, of every level, for each text."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint32)] * len(LEVELS) for _ in texts]
    at = 0
    while at < len(texts):
        n, size = at, 0
        while n < len(texts) and (size == 0 or size + len(texts[n]) <= SOME):
            size += len(texts[n])
            n += 1
        full = [i for i in range(at, n) if texts[i]]
        at = n
        if not full:
            continue
        x = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum([0, *[len(texts[i]) for i in full[:-1]]])
        for k, (keep, _) in enumerate(LEVELS):
            x, first = level(x, first)
            short = (x >> np.uint64(32)).astype(np.uint32)
            ends = [*first[1:].tolist(), len(x)]
            for i, a, b in zip(full, first.tolist(), ends, strict=True):
                part = short[a:b]
                if len(part) > 4 * keep:
                    part = part[part <= np.partition(part, 4 * keep - 1)[4 * keep - 1]]
                least = distinct(part)
                if len(least) < keep:
                    least = distinct(short[a:b])
                if k == 0:
                    out[i] = list(out[i])
                out[i][k] = least[:keep]
    return out


def written(sketch: list[np.ndarray]) -> str:
    return ".".join(x.astype(">u4").tobytes().hex() for x in sketch)


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Weighted bottom-k estimate of how many phrases two texts share, 0 to 1."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    total = 0.0
    for x, y, (keep, weight) in zip(a, b, LEVELS, strict=True):
        low = sorted({*x.tolist(), *y.tolist()})[:keep]
        total += weight * len({*x.tolist()} & {*y.tolist()} & {*low}) / len(low)
    return min(1.0, total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text; one narrow pass."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [written(s) for s in sketches([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], ["id", "fingerprint"])

    src = only(docs, id_col, text_col)
    return src.mapInArrow(lean(run), f"id {src.schema[0].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt by ranges of ids and sorted by descending id, each range followed by the first rows of the next one.

    Columns: bucket, edge (1: the row belongs to the next range and is there to be seen only), id, text. Bounds come from quantiles
    of the ids; what the driver gathers is one row a range, of which there are ``RANGES`` at most.
    """
    src = only(docs, id_col, text_col).toDF("id", "text")
    rows = src.count()
    n = min(RANGES, max(1, -(-rows // RANGE_ROWS)))
    cuts = src.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n + 100)).first()[0] if n > 1 else None
    cuts = sorted({int(c) for c in cuts or []})

    def array(values: list, kind: str = "bigint"):
        return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)") if values else F.array().cast(f"array<{kind}>")

    bucket = F.lit(0)
    if cuts:  # the number of bounds below the id, by binary search
        halves = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
        bounds = array(cuts)
        bucket = F.aggregate(halves, F.lit(0), lambda a, s: F.when((a + s <= len(cuts)) & (F.get(bounds, a + s - 1) < F.col("id")), a + s).otherwise(a))
    src = src.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(bucket))
    tops = {r.bucket: r.top for r in src.groupBy("bucket").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    shown = {b: a for a, b in zip(order, order[1:], strict=False)} | ({order[0]: order[-1]} if order else {})
    known = range(-1, max(tops, default=-1) + 1)
    top = F.get(array([tops[b] if tops.get(b) is not None else 0 for b in known]), F.col("bucket") + 1)
    also = F.get(array([shown.get(b, -1) for b in known], "int"), F.col("bucket") + 1)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("edge"))
    edge = F.struct(also.alias("bucket"), F.lit(1).alias("edge"))
    places = F.when(F.col("id").isNull() | (F.col("id") == top), F.array(own, edge)).otherwise(F.array(own))
    out = src.select("id", "text", F.explode(places).alias("p")).select("p.bucket", "p.edge", "id", "text")
    return out.repartition("bucket").sortWithinPartitions("bucket", "edge", F.col("id").desc_nulls_last(), "text")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with the likeness to it and to the next document.

    The edited text: the last third of the code points replaced by as many of the first of the next document, by
    descending id (after the last: the first).
    """
    small_batches(docs.sparkSession)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(rows: list[tuple], after: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        nexts = [*texts[1:], after]
        edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts, strict=True)]
        own = sketches([*texts, after])
        new = sketches(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows], kind),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array([written(s) for s in own[:-1]]),
                pa.array([written(s) for s in new]),
                pa.array([likeness(a, b) for a, b in zip(own, new, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, bucket, done = 0, None, True
        for b in batches:
            for where, edge, key, text in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                text = text or ""
                if where != bucket:
                    bucket, done = where, False
                if edge:
                    if not done:
                        yield work(held, text)
                        held, size, done = [], 0, True
                    continue
                if size > 500_000 or len(held) >= 512:
                    yield work(held, text)
                    held, size = [], 0
                held.append((key, text))
                size += len(text)

    rows = with_next(docs, id_col, text_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["id"].dataType)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", "doc_id")
