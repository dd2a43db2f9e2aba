"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed by id and content into a fixed number of slots. Bytes are summed for each slot, a table of constant size, and
a greedy pass over it, heaviest slot first onto the lightest shard, gives version 1 of the map, which covers every slot, held or empty,
so that later rows find theirs. ``write_map`` and ``read_map`` store the versions side by side. Rebalancing edits the map:
the next version moves only as many slots as the new shard needs, and no others. All of it is DataFrame algebra; the
greedy pass is one ``aggregate`` over the constant number of slots.

Law: ``bytes``. A record's size is the UTF-8 length of its text (null: none) plus 16. A null id is a value like any other.
Repeated rows are records of their own. An empty table gives an empty result; other columns are not read. Slots are hashed
by id and text, so a third of all rows under one id but different texts still spreads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Virtual slots; fixed for the life of a corpus.
SLOTS = 8192


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, vslot) of every record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    size = F.octet_length(text).cast("bigint") + 16
    return docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32")).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_bytes(recs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows): one row of every slot, 0 and 0 of empty ones."""
    held = recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = recs.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").fillna(0, ["bytes", "rows"])


def first_map(totals: DataFrame, shards: int) -> DataFrame:
    """(version 1, vslot, shard): heaviest slot first, each to the shard with the fewest bytes so far."""
    order = F.sort_array(F.collect_list(F.struct(F.col("bytes"), F.col("vslot"))), asc=False)
    start = f"named_struct('load', array_repeat(0L, {shards}), 'to', cast(array() as array<int>))"
    step = """(a, x) -> named_struct(
        'load', transform(a.load, (v, i) -> v + if(i = array_position(a.load, array_min(a.load)) - 1, x.bytes, 0L)),
        'to', a.to || array(cast(array_position(a.load, array_min(a.load)) - 1 as int)))"""
    one = totals.groupBy().agg(order.alias("slots")).selectExpr("slots", f"aggregate(slots, {start}, {step}, a -> a.to) as to")
    return one.select(F.explode(F.arrays_zip("slots", "to")).alias("x")).selectExpr("1 as version", "x.slots.vslot as vslot", "x.to as shard")


def grow(mapping: DataFrame, totals: DataFrame, shards: int) -> DataFrame:
    """The next version, for one shard more: every shard gives up slots, lightest first, while it stays at or above the new mean.

    Other slots keep their shard, so only rows of moved slots travel."""
    held = mapping.join(totals, "vslot")
    run = W.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(W.unboundedPreceding, 0)
    mean = held.groupBy().agg((F.sum("bytes") / (shards + 1)).alias("mean"))
    load = held.groupBy("shard").agg(F.sum("bytes").alias("load"))
    out = held.withColumn("given", F.sum("bytes").over(run)).join(load, "shard").join(F.broadcast(mean))
    moved = F.col("load") - F.col("given") >= F.col("mean")
    return out.select((F.col("version") + 1).alias("version"), "vslot", F.when(moved, F.lit(shards)).otherwise(F.col("shard")).alias("shard"))


def write_map(mapping: DataFrame, path: str) -> None:
    """Add a version to the stored map; a version that is there already is an error, as records may lie by it."""
    mapping.select("version", "vslot", "shard").write.partitionBy("version").mode("append" if not stored(mapping, path) else "error").parquet(path)


def stored(mapping: DataFrame, path: str) -> bool:
    """Whether the map at ``path`` has the version of ``mapping``."""
    spark, version = mapping.sparkSession, mapping.agg(F.max("version")).first()[0]
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={version}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the latest by default."""
    every = spark.read.schema("vslot int, shard int, version int").parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == version).select("version", "vslot", "shard")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", mapping: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every record; ``slot``: its place in the shard, from 0.

    ``mapping``: a stored version of the map, made with the same ``slots``; else the first one is made. Places are counted within virtual slots, and each
    slot starts where those before it in its shard end, so no task holds a whole shard.
    """
    recs = records(docs, slots, id_col, text_col)
    totals = slot_bytes(recs, slots)
    mapping = first_map(totals, shards) if mapping is None else mapping
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    # one row a virtual slot: a constant bound, so it may be broadcast
    places = mapping.join(totals.select("vslot", "rows"), "vslot").withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    within = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    out = recs.withColumn("within", within).join(F.broadcast(places.select("vslot", "shard", "before")), "vslot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("within") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
