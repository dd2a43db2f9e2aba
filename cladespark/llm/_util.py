"""Helpers shared by the corpus operators: durable cuts, Arrow batch size, hashing, connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote and nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. Spark takes a table it reads for as large as its compressed files and an array for one
    element, so rows exploded from small files would all be built into one table in the driver."""
    return df.hint("merge")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows in an Arrow batch, as a row holds a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trim() -> None:
    """Give freed memory back to the system, as Python workers outlive their stage."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, with ``trim`` at the end."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return whole


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges(a, b)``; component is the smallest node reachable.

    Alternating large-star and small-star steps: each is a group-by on an aggregated minimum and a join, so no node's
    neighbours are ever gathered in one place, and the number of rounds is logarithmic in the longest chain. Each round is
    cut to the shared folder. Null ends and self-loops are ignored; an empty table gives an empty result.
    """
    both = edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
    now = cut(both)
    total = None
    while True:
        # large star: every larger neighbour of u points at the smallest of u and its neighbours
        sym = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: every smaller neighbour of u, and u, point at the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        new = cut(small.where("a <> b").distinct())
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = new
        if seen == total:
            break
        total = seen
    # at the fixed point the edges are stars: a points at its component
    top = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(top)
