"""Variants against coding regions: interval and nearest joins, codon changes, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import amino, reverse_complement

#: Width of the bins that make the interval join an equi-join.
BIN = 10_000
#: Bases on either side of a place in its context, and bases of a genome tile.
FLANK, TILE = 40, 4096


def overlapping(variants: DataFrame, cds: DataFrame, by: list[str] | None = None, bin_: int = BIN) -> DataFrame:
    """Variants (variant_id, pos 1-based) with the first region (idx, start, end: 0-based, half open) that holds them, if any.

    Regions are listed in every bin they touch, so the join has an equality and needs no nested loop."""
    by = by or []
    v = variants.withColumn("bin", F.floor((F.col("pos") - 1) / bin_))
    c = cds.where("end > start").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_), F.floor((F.col("end") - 1) / bin_))))
    names = [x for x in c.columns if x not in ("bin", *by)]
    hit = v.join(c, ["bin", *by]).where("start <= pos - 1 and pos - 1 < end")
    first = hit.groupBy("variant_id").agg(F.min_by(F.struct(*names), "idx").alias("cds"))
    return variants.join(first, "variant_id", "left")


def nearest(variants: DataFrame, cds: DataFrame) -> DataFrame:
    """Variants with the nearest region: least distance of the place to start or end, of equal ones the first.

    Only edges next to a place can be nearest, so places and edges are sorted together in ranges and carry the last edge seen from
    either side; no pair is tried that is not adjacent."""
    from pyspark.sql import Window as W

    edges = cds.select(F.explode(F.array("start", "end")).alias("at"), "idx").groupBy("at").agg(F.min("idx").alias("idx"))
    both = variants.select((F.col("pos") - 1).alias("at"), "variant_id", F.lit(None).cast("int").alias("idx")).union(edges.select("at", F.lit(None).cast("string").alias("variant_id"), F.col("idx").cast("int")))
    both = both.withColumn("bin", F.floor(F.col("at") / (100 * BIN)))
    e = F.when(F.col("idx").isNotNull(), F.struct("at", "idx"))
    w = W.partitionBy("bin")
    left = F.last(e, ignorenulls=True).over(w.orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    right = F.last(e, ignorenulls=True).over(w.orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, 0))
    seen = both.withColumn("l", left).withColumn("r", right).where("variant_id is not null")
    ends = edges.withColumn("bin", F.floor(F.col("at") / (100 * BIN))).groupBy("bin").agg(F.min(F.struct("at", "idx")).alias("lo"), F.max(F.struct("at", "idx")).alias("hi"))
    span = W.orderBy("bin")
    bins = seen.select("bin").distinct().join(ends, "bin", "full")
    around = bins.select("bin", F.last("hi", ignorenulls=True).over(span.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.first("lo", ignorenulls=True).over(span.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    seen = seen.join(around, "bin").withColumn("l", F.coalesce("l", "before")).withColumn("r", F.coalesce("r", "after"))
    options = F.filter(F.array("l", "r"), lambda x: x.isNotNull())
    best = F.array_min(F.transform(options, lambda x: F.struct(F.abs(x["at"] - F.col("at")).alias("distance"), x["idx"].alias("idx"))))
    return seen.select("variant_id", best["idx"].alias("nearest_idx"), best["distance"].cast("bigint").alias("distance"))


def tiles(spark: SparkSession, genome: str, flank: int = FLANK, width: int = TILE) -> DataFrame:
    """(tile, first, bases) of a circular genome: bases from ``first`` (from 0, may be negative) on, ``flank`` more than the tile on either side.

    Variants meet their tile by an equi-join, so no row ever scans the genome."""
    n = len(genome)
    around = genome * (2 + (flank + width) // max(1, n) * 2)
    rows = []
    for t in range(-(-n // width)):
        first, last = t * width - flank, min(n, (t + 1) * width) + flank
        rows.append((t, first, around[first % n : first % n + last - first]))
    return spark.createDataFrame(rows, "tile long, first long, bases string")


def with_tile(variants: DataFrame, spread: DataFrame, n: int, width: int = TILE) -> DataFrame:
    """Variants (pos 1-based, taken around a genome of ``n`` bases) with their place ``at`` (from 0) and tile (first, bases)."""
    return variants.withColumn("at", F.pmod(F.col("pos") - 1, F.lit(n))).withColumn("tile", F.expr(f"at div {width}")).join(spread, "tile", "left").drop("tile")


def contexts(variants: DataFrame, genome: str, flank: int = FLANK) -> DataFrame:
    """(variant_id, pos, context): the ``2 * flank + 1`` bases around each place."""
    v = with_tile(variants, tiles(variants.sparkSession, genome, flank), len(genome))
    return v.select("variant_id", "pos", F.substring("bases", (F.col("at") - flank - F.col("first") + 1).cast("int"), F.lit(2 * flank + 1)).alias("context"))


def annotate(variants: DataFrame, cds: DataFrame, genome: str, complement: bool = True) -> DataFrame:
    """(variant_id, region_type, rel_pos, codon_number, nucleotide_change, amino_change, gene): for variants with ``ref`` and ``alt``.

    On the minus strand the alternate is complemented, unless ``complement`` is off. A codon that reaches past an end of the genome is cut there."""
    n = len(genome)
    o = with_tile(overlapping(variants, cds), tiles(variants.sparkSession, genome), n)
    minus = F.col("cds.strand") < 0
    rel = F.when(minus, F.col("cds.end") - F.col("pos")).otherwise(F.col("pos") - 1 - F.col("cds.start"))
    o = o.withColumn("rel", rel).withColumn("codon", F.floor(F.col("rel") / 3))
    low = F.when(minus, F.col("cds.end") - 3 * (F.col("codon") + 1)).otherwise(F.col("cds.start") + 3 * F.col("codon"))
    o = o.withColumn("low", F.greatest(F.lit(0), low)).withColumn("high", F.least(F.lit(n), low + 3))
    raw = F.substring("bases", (F.col("low") - F.col("first") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    o = o.withColumn("old", F.when(minus, reverse_complement(raw)).otherwise(raw))
    base = F.when(minus & F.lit(complement), F.translate("alt", "ACGT", "TGCA")).otherwise(F.col("alt"))
    o = o.withColumn("new", F.overlay("old", base, (F.col("rel") % 3 + 1).cast("int")))
    coding = F.col("cds").isNotNull()
    near = nearest(variants, cds).join(cds.select(F.col("idx").alias("nearest_idx"), F.struct(*cds.columns).alias("near")), "nearest_idx", "left").select("variant_id", "near")
    gene = lambda c, a, b: F.concat(F.when(F.col(f"{c}.strand") < 0, "-").otherwise("+"), F.col(f"{c}.locus_tag"), F.lit(" | "), F.col(f"{c}.gene"), F.lit(" | "), F.col(f"{c}.product"), F.lit(" | ["), a.cast("string"), F.lit(".."), b.cast("string"), F.lit("]"))
    around = F.substring("bases", (F.col("at") - FLANK - F.col("first") + 1).cast("int"), F.lit(2 * FLANK + 1))
    return o.join(near, "variant_id", "left").select(
        "variant_id", "pos", F.when(coding, "coding").otherwise("non-coding").alias("region_type"), F.when(coding, F.col("rel") + 1).alias("rel_pos"), F.when(coding, F.col("codon") + 1).alias("codon_number"),
        F.when(coding, F.concat_ws("|", "old", "new")).otherwise(F.concat_ws("|", "ref", "alt")).alias("nucleotide_change"), F.when(coding, F.concat_ws("|", amino(F.col("old")), amino(F.col("new")))).otherwise("-").alias("amino_change"),
        F.when(coding, gene("cds", F.col("cds.start") + 1, F.col("cds.end"))).otherwise(gene("near", F.col("near.start") + 1, F.col("near.start") + 1)).alias("gene"), around.alias("context"),
    )
