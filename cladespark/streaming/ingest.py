"""Append-only ingest of call lines as a stream: running carrier counts by site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calls import called_allele, parse_records, passes_qc, snp_like


def carrier_counts(lines: DataFrame) -> DataFrame:
    """``lines(sample_id, line_no, value)``, a stream or a batch, to (chrom, pos, ref, alt, carriers), to be written in complete or update mode."""
    r = parse_records(lines).where(snp_like(F.col("ref"), F.col("alts"))).where(passes_qc(F.col("qual"), F.col("info")))
    r = r.withColumn("alt", called_allele(F.col("ref"), F.col("alts"), F.col("fmt"), F.col("smp"))).where("alt <> ref")
    return r.groupBy("chrom", "pos", "ref", "alt").agg(F.approx_count_distinct("sample_id").alias("carriers"))
