"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file.

Every match of the pre-splitting pattern is encoded separately; texts over ``pieces.SEGMENT`` characters are first cut at
places that no match spans. Ids are decoded to raw bytes by the library. One narrow pass over the texts, no shuffle.
Null texts count as empty: no ids, empty bytes. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._util import lean, only, small_batches
from .pieces import encoding, from_ranks


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): little-endian unsigned 32-bit ids of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = from_ranks(ranks)
        for b in batches:
            ids = coder.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["id", "ids"])

    src = only(docs, id_col, text_col)
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(lean(run), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): raw bytes of the ids that ``encode`` made; null ids count as none."""
    small_batches(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(ranks)
        for b in batches:
            out = [e.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    src = only(coded, id_col, ids_col)
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(lean(run), f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, in the one pass that encodes and decodes it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, e = from_ranks(ranks), encoding(ranks)
        names = [str(i) for i in range(e.n_vocab)]
        for b in batches:
            n, a, d = [], [], []
            for x in coder.encode(b.column(1).to_pylist()):
                ids = x.tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                d.append(hashlib.sha256(e.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = only(docs, id_col, text_col)
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(lean(run), f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
