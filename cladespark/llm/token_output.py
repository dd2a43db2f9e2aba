"""Packed id matrices by best-fit decreasing with a segment tree over capacities.

Documents are tokenised and cut losslessly into pieces of at most ``length`` ids. Pieces are dealt by hash into chunks whose
size does not depend on the input; in each, pieces go longest first into the fullest open sequence that takes them, which
a segment tree over free capacity finds in O(log length). A sequence row holds its ids as little-endian unsigned integers,
the cumulative lengths of its segments (from 0), and the places where positions restart.

Null texts count as empty and still hold the end token; repeated rows are packed as rows of their own; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import lean, only, small_batches
from .pieces import from_json

#: Documents dealt to a chunk; a task holds their ids, two or four bytes each.
CHUNK = 4096


class Capacities:
    """Open bins by free capacity, with a segment tree whose nodes tell whether any bin below has that capacity."""

    def __init__(self, length: int) -> None:
        self.n = 1 << length.bit_length()
        self.tree = np.zeros(2 * self.n, bool).tolist()
        self.bins: list[list[int]] = [[] for _ in range(self.n)]

    def add(self, b: int, room: int) -> None:
        self.bins[room].append(b)
        k = self.n + room
        while k and not self.tree[k]:
            self.tree[k] = True
            k //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least capacity of at least ``need``, and that capacity; it is removed."""
        k = self.n + need
        if not self.tree[k]:
            while k > 1 and (k & 1 or not self.tree[k + 1]):  # climb until a right sibling holds a bin
                k //= 2
            if k <= 1:
                return None
            k += 1
            while k < self.n:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        room = k - self.n
        b = self.bins[room].pop()
        if not self.bins[room]:
            self.tree[k] = False
            k //= 2
            while k and not (self.tree[2 * k] or self.tree[2 * k + 1]):
                self.tree[k] = False
                k //= 2
        return b, room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    open_, bins = Capacities(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if found := open_.take(sizes[i]):
            b, room = found
        else:
            b, room = len(bins), length
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            open_.add(b, room - sizes[i])
    return bins


def packed_ids(docs: DataFrame, tokenizer: str, end: int = 50256, length: int = 1024, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row a sequence: (sequence_id, n_tokens, doc_ids, pieces, cu_seqlens, position_resets, input_ids binary).

    ``id_bytes`` is 2 for vocabularies below 65,536 ids and else 4. Concatenating a document's pieces in order gives its ids
    and the end id back.
    """
    small_batches(docs.sparkSession)
    kind = f"<u{id_bytes}"
    chunks = max(1, -(-docs.count() // chunk))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = from_json(tokenizer)
        for b in batches:
            out = [np.append(x, np.uint32(end)).astype(kind).tobytes() for x in coder.encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "ids"])

    def run(t: pa.Table) -> pa.Table:
        keys, data = t.column("id").to_pylist(), t.column("ids").to_pylist()
        order = sorted(range(len(data)), key=lambda i: (keys[i] is not None, keys[i], data[i]))
        pieces = [(i, k, at) for i in order for k, at in enumerate(range(0, len(data[i]), length * id_bytes))]
        view = [memoryview(x) for x in data]
        part = [view[i][at : at + length * id_bytes] for i, _, at in pieces]
        bins = best_fit_decreasing([len(x) // id_bytes for x in part], length)
        base = t.column("chunk")[0].as_py() << 40
        ends = [np.cumsum([0, *[len(part[p]) // id_bytes for p in b]]) for b in bins]
        return pa.table(
            {
                "sequence_id": pa.array(range(base, base + len(bins)), pa.int64()),
                "n_tokens": pa.array([int(e[-1]) for e in ends], pa.int64()),
                "doc_ids": pa.array([[keys[pieces[p][0]] for p in b] for b in bins], pa.list_(t.schema.field("id").type)),
                "pieces": pa.array([[pieces[p][1] for p in b] for b in bins], pa.list_(pa.int32())),
                "cu_seqlens": pa.array([e.astype(np.int32) for e in ends], pa.list_(pa.int32())),
                "position_resets": pa.array([e[:-1].astype(np.int32) for e in ends], pa.list_(pa.int32())),
                "input_ids": pa.array([b"".join(part[p] for p in b) for b in bins], pa.binary()),
            }
        )

    src = only(docs, id_col, text_col)
    k = src.schema[0].dataType.simpleString()
    coded = src.mapInArrow(lean(ids), f"id {k}, ids binary").withColumn("chunk", F.pmod(F.xxhash64("id", "ids"), F.lit(chunks)))
    return coded.groupBy("chunk").applyInArrow(run, f"sequence_id bigint, n_tokens bigint, doc_ids array<{k}>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>, input_ids binary")


def write_matrices(packed: DataFrame, path: str, length: int = 1024, id_bytes: int = 2, pad: int = 0) -> None:
    """Write each sequence as a matrix row of exactly ``length`` ids, padded, with its segment lengths and resets, as Parquet."""
    fill = pad.to_bytes(id_bytes, "little").hex()
    padding = F.unhex(F.expr(f"repeat('{fill}', cast({length} - n_tokens as int))"))
    packed.withColumn("input_ids", F.concat("input_ids", padding)).withColumn("id_bytes", F.lit(id_bytes)).write.mode("overwrite").parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """The sequences that ``write_matrices`` wrote, without their padding."""
    df = spark.read.parquet(path)
    return df.withColumn("input_ids", F.expr("substring(input_ids, 1, cast(n_tokens * id_bytes as int))")).drop("id_bytes")
