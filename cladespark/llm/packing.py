"""Packing of documents into sequences by swap-based local search.

A document of more than ``length`` tokens is cut into full pieces, which are sequences of their own, and one shorter first
piece. First pieces are dealt by hash into chunks of about ``chunk`` documents, so a chunk's size does not depend on the
input, and each chunk is packed in one task. A packing starts from a best-fit pass; then the emptiest bin gives documents
away: it moves one to another underfull bin, exchanges one for a shorter one, or one for two, each step raising the sum of
squared fills, until it is empty or no step is left. The search ends when the bins reach the lower bound of their sum.
Chunks cost at most about one underfull sequence each.

Null texts count as empty and still hold the end token; repeated rows and repeated ids are packed as rows of their own;
an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import lean, only, small_batches
from .pieces import from_json

#: Documents dealt to a chunk; a task holds one row a document of it.
CHUNK = 4096


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of positions, longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    spare: list[list[int]] = [[] for _ in range(length + 1)]
    some = 0  # bit r: a bin has r left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fit = some >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = spare[r].pop()
            if not spare[r]:
                some &= ~(1 << r)
        else:
            b, r = len(bins), length
            bins.append([])
        bins[b].append(i)
        r -= n
        if r:
            spare[r].append(b)
            some |= 1 << r
    return bins


def local_search(sizes: list[int], bins: list[list[int]], length: int) -> list[list[int]]:
    """Empties bins by moves, one-for-one and two-for-one exchanges that each raise the sum of squared fills."""
    size = np.asarray(sizes, np.int64)
    home = np.zeros(len(sizes), np.int64)
    for b, x in enumerate(bins):
        home[x] = b
    left = length - np.bincount(home, weights=size, minlength=len(bins)).astype(np.int64)
    live, least = len(bins), -(-int(size.sum()) // length)
    closed = left <= 0  # full, or no step helps them
    while live > least and not closed.all():
        a = int(np.argmax(np.where(closed, -1, left)))
        if not step(size, home, left, a):
            closed[a] = True
        elif left[a] == length:
            live -= 1
            closed[a] = True
    out: dict[int, list[int]] = {}
    for i, b in enumerate(home.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


def step(size: np.ndarray, home: np.ndarray, left: np.ndarray, a: int) -> bool:
    """One improving step that takes tokens from bin ``a``; False if there is none."""

    def put(i: int, b: int) -> None:
        left[home[i]] += size[i]
        left[b] -= size[i]
        home[i] = b

    mine = np.flatnonzero(home == a)
    mine = mine[np.argsort(-size[mine], kind="stable")]
    other = (left <= left[a]) & (left > 0)  # fuller bins with room: what they gain raises the sum of squares
    other[a] = False
    if not other.any():
        return False
    for i in mine.tolist():
        fit = np.flatnonzero(other & (left >= size[i]))
        if len(fit):
            put(i, int(fit[np.argmin(left[fit])]))
            return True
    theirs = np.flatnonzero(other[home])
    room = left[home[theirs]]
    for i in mine.tolist():
        gain = size[i] - size[theirs]
        gain[(gain <= 0) | (gain > room)] = 0
        k = int(np.argmax(gain))
        if gain[k] > 0:
            j, b = int(theirs[k]), int(home[theirs[k]])
            put(i, b)
            put(j, a)
            return True
    order = np.argsort(home[theirs], kind="stable")
    by = theirs[order]
    for d in range(1, 8):  # pairs within a bin: neighbours at distance d in bin order
        x, y = by[:-d], by[d:]
        same = home[x] == home[y]
        if not same.any():
            break
        x, y = x[same], y[same]
        both, room = size[x] + size[y], left[home[x]]
        for i in mine.tolist():
            gain = size[i] - both
            gain[(gain <= 0) | (gain > room)] = 0
            k = int(np.argmax(gain))
            if gain[k] > 0:
                b = int(home[x[k]])
                put(i, b)
                put(int(x[k]), a)
                put(int(y[k]), a)
                return True
    return False


def pack(sizes: list[int], length: int) -> list[list[int]]:
    return local_search(sizes, best_fit(sizes, length), length)


def measure(docs: DataFrame, tokenizer: str, end: int, length: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, crcs array<bigint>): the checksum of each piece, the first one first."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = from_json(tokenizer)
        for b in batches:
            n, crcs = [], []
            for x in coder.encode(b.column(1).to_pylist()):
                data = memoryview(np.append(x, np.uint32(end)).astype("<u4").tobytes())
                n.append(len(data) // 4)
                first = (n[-1] - 1) % length + 1
                cuts = [0, *range(4 * first, len(data) + 1, 4 * length)]
                crcs.append([zlib.crc32(data[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["id", "n_tokens", "crcs"])

    src = only(docs, id_col, text_col)
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(lean(run), f"id {kind}, n_tokens bigint, crcs array<bigint>")


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row a piece: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    chunks = max(1, -(-docs.count() // chunk))
    sized = measure(docs, tokenizer, end, length, id_col, text_col)
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("id", "n_tokens", "crcs"), F.lit(chunks)))

    def run(t: pa.Table) -> pa.Table:
        n = np.asarray(t.column("n_tokens"), np.int64)
        order = np.lexsort((np.asarray(t.column("crcs").combine_chunks().flatten())[np.asarray(t.column("crcs").combine_chunks().offsets)[:-1]], n))
        t, n = t.take(pa.array(order)), n[order]
        first = ((n - 1) % length + 1).tolist()
        bins = pack(first, length)
        seq, at = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        base = t.column("chunk")[0].as_py() << 40
        for b, x in enumerate(bins):
            seq[x] = base + b
            at[x] = np.cumsum([0, *[first[i] for i in x[:-1]]])
        more = (n - 1) // length
        full = base + (1 << 39) + np.cumsum(more) - more
        return pa.table([t.column("id"), pa.array(n), t.column("crcs"), pa.array(seq), pa.array(at), pa.array(full)], ["id", "n_tokens", "crcs", "seq", "at", "full"])

    kind = sized.schema["id"].dataType.simpleString()
    packed = sized.groupBy("chunk").applyInArrow(run, f"id {kind}, n_tokens bigint, crcs array<bigint>, seq bigint, at bigint, full bigint")
    rows = packed.select("*", F.expr(f"(n_tokens - 1) % {length} + 1").alias("head"), F.posexplode("crcs").alias("piece", "ids_crc32"))
    head = F.col("piece") == 0
    return rows.select(
        F.col("id").alias(id_col),
        F.col("piece").cast("int").alias("piece"),
        F.when(head, F.lit(0)).otherwise(F.expr(f"head + (piece - 1) * {length}")).cast("bigint").alias("start"),
        F.when(head, F.col("head")).otherwise(F.lit(length)).cast("bigint").alias("length"),
        "ids_crc32",
        F.when(head, F.col("seq")).otherwise(F.expr("full + piece - 1")).alias("sequence_id"),
        F.when(head, F.col("at")).otherwise(F.lit(0)).cast("bigint").alias("offset"),
    )

