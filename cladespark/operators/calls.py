"""From variant-call records to a sparse sample-by-variant relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import info_value, number

SITE = ["chrom", "pos", "ref", "alt"]


def parse_records(lines: DataFrame) -> DataFrame:
    """Records of ``lines(sample_id, line_no, value)``: comments, short lines and lines without a whole position are skipped."""
    # exploding keeps Catalyst from copying the split into every filter and column that reads a field
    rows = lines.where(~F.col("value").startswith("#")).select("sample_id", "line_no", F.explode(F.array(F.split("value", "\t", 11))).alias("f")).where("size(f) >= 8")
    get = lambda i: F.get("f", F.lit(i))
    return rows.select(
        "sample_id", "line_no", get(0).alias("chrom"), F.trim(get(1)).try_cast("int").alias("pos"), F.upper(F.trim(get(3))).alias("ref"),
        F.transform(F.split(F.upper(get(4)), ","), lambda a: F.trim(a)).alias("alts"), get(5).alias("qual"), get(7).alias("info"),
        F.split(get(8), ":").alias("fmt"), F.split(get(9), ":").alias("smp"),
    ).where("pos is not null")


def snp_like(ref: Column, alts: Column, biallelic: bool = True) -> Column:
    one = F.forall(alts, lambda a: (F.length(a) == 1) & (a != "."))
    good = (F.length(ref) == 1) & (ref != ".") & (F.size(alts) > 0) & one
    return good & (F.size(alts) == 1) if biallelic else good


def passes_qc(qual: Column, info: Column, least_qual: float = 30, depth: float = 10, mapping: float = 40, zero: float = 0.1) -> Column:
    """Quality, depth and mapping quality at least, share of zero mapping quality at most; absent fields count as 0.

    NaN fails no test but the one of depth, where it counts as 0.
    """
    at = lambda k: number(info_value(info, k))
    depth_ok = F.floor(F.nanvl(at("DP"), F.lit(0.0))) >= depth
    # NaN is the largest of numbers here
    return (number(qual) >= least_qual) & depth_ok & (at("MQ") >= mapping) & (F.nanvl(at("MQ0F"), F.lit(zero)) <= zero)


def called_allele(ref: Column, alts: Column, fmt: Column, smp: Column) -> Column:
    """The first alternate in the genotype; the reference if there is none; the first alternate if there is no genotype."""
    at = F.array_position(fmt, "GT")
    gt = F.when(at > 0, F.get(smp, (at - 1).cast("int")))
    parts = F.when(F.contains(gt, F.lit("/")), F.split(gt, "/")).otherwise(F.split(gt, r"\|"))
    hit = F.get(F.filter(F.transform(parts, lambda x: F.trim(x).try_cast("int")), lambda i: i > 0), F.lit(0))
    first = F.get(alts, F.lit(0))
    return F.when(gt.isNull() | (gt == ""), first).when(hit.isNull(), ref).otherwise(F.coalesce(F.get(alts, hit - 1), first))


def sample_field(fmt: Column, smp: Column, key: str) -> Column:
    """The sample's own value of a FORMAT key, null if it has none."""
    at = F.array_position(fmt, key)
    return F.when(at > 0, F.get(smp, (at - 1).cast("int")))


def masked(records: DataFrame, least_quality: float = 0, least_depth: float = 0) -> DataFrame:
    """``records`` whose genotype is missing (``./.``) where the sample's own GQ or DP is too low; absent and unreadable values mask nothing."""
    low = lambda k, least: F.coalesce(sample_field(F.col("fmt"), F.col("smp"), k).try_cast("double") < least, F.lit(False))
    gone = F.transform(F.arrays_zip("fmt", "smp"), lambda x: F.when(x["fmt"] == "GT", F.lit("./.")).otherwise(x["smp"]))
    return records.withColumn("smp", F.when(low("GQ", least_quality) | low("DP", least_depth), gone).otherwise(F.col("smp")))


def genotype_value(fmt: Column, smp: Column) -> Column:
    """1 if the genotype has an alternate, 0 if not, null if any of it is missing or there is none."""
    gt = sample_field(fmt, smp, "GT")
    return F.when(gt.isNull() | (gt == "") | gt.contains("."), F.lit(None).cast("int")).otherwise(gt.rlike("[1-9]").cast("int"))


def away_from_indels(records: DataFrame, gap: int) -> DataFrame:
    """``records`` but those of single bases that lie within ``gap`` bases of an insertion or deletion of any sample.

    Indels are listed in every bin that they reach, so the join has an equality."""
    width = max(1000, 2 * gap)
    long = (F.length("ref") > 1) | F.exists("alts", lambda a: F.length(a) > 1)
    indels = records.where(long).select("chrom", (F.col("pos") - gap).alias("low"), (F.col("pos") + F.length("ref") - 1 + gap).alias("high")).distinct()
    indels = indels.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    snps = records.where(~long).withColumn("bin", F.floor(F.col("pos") / width))
    kept = snps.join(indels.withColumnRenamed("chrom", "c"), (F.col("chrom") == F.col("c")) & (snps["bin"] == indels["bin"]) & F.col("pos").between(F.col("low"), F.col("high")), "left_anti")
    return kept.drop("bin").union(records.where(long))


def calls(records: DataFrame, biallelic: bool = True, **limits: float) -> DataFrame:
    """(sample_id, chrom, pos, ref, called): records that look like SNPs and pass; of several of a sample's site the last wins."""
    good = records.where(snp_like(F.col("ref"), F.col("alts"), biallelic)).where(passes_qc(F.col("qual"), F.col("info"), **limits))
    good = good.withColumn("called", called_allele(F.col("ref"), F.col("alts"), F.col("fmt"), F.col("smp"))).where("length(called) = 1")
    return last_call(good)


def last_call(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct("line_no", "ref", "called")).alias("last")
    return rows.groupBy("sample_id", "chrom", "pos").agg(last).select("sample_id", "chrom", "pos", "last.ref", "last.called")


def sites(calls_: DataFrame, presence: int = 3) -> DataFrame:
    """(chrom, pos, ref, alt, carriers) of alternates that at least ``presence`` samples carry."""
    found = calls_.where("called <> ref").groupBy("chrom", "pos", "ref", F.col("called").alias("alt")).agg(F.count("*").alias("carriers"))
    return found.where(F.col("carriers") >= presence)


def variant_id(*cols: str) -> Column:
    return F.concat_ws(":", *[F.col(c) for c in (cols or SITE)])


def carriers(calls_: DataFrame, sites_: DataFrame) -> DataFrame:
    """(sample_id, variant_id, value 1): the sparse form of samples x sites; what is not there is the reference."""
    hit = calls_.withColumnRenamed("called", "alt").join(sites_, SITE)
    return hit.select("sample_id", variant_id().alias("variant_id"), F.lit(1).alias("value"))


def dense_alleles(calls_: DataFrame, sites_: DataFrame) -> DataFrame:
    """(sample_id, variant_id, base) of all samples and sites; for exports, as it has a row for each pair."""
    samples = calls_.select("sample_id").distinct()
    every = samples.crossJoin(sites_.select(*SITE))
    own = calls_.select("sample_id", "chrom", "pos", F.col("called").alias("alt"), F.lit(True).alias("hit"))
    both = every.join(own, ["sample_id", "chrom", "pos", "alt"], "left")
    return both.select("sample_id", variant_id().alias("variant_id"), F.when(F.col("hit"), F.col("alt")).otherwise(F.col("ref")).alias("base"))


def baselines(calls_: DataFrame, sites_: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(variant_id, baseline, differs): the commonest base of a site; of equals that of the first sample.

    Counted from carriers alone: the reference has the rest of the ``samples``, by default those with calls."""
    samples = calls_.select("sample_id").distinct() if samples is None else samples
    n = samples.agg(F.count("*").alias("n"), F.min("sample_id").alias("first"))
    hit = calls_.withColumnRenamed("called", "alt").join(sites_, SITE)
    per = hit.groupBy(*SITE).agg(F.count("*").alias("ones"), F.min("sample_id").alias("first_alt")).join(F.broadcast(n))
    alt = (2 * F.col("ones") > F.col("n")) | ((2 * F.col("ones") == F.col("n")) & (F.col("first_alt") == F.col("first")))
    return per.select(variant_id().alias("variant_id"), F.when(alt, F.col("alt")).otherwise(F.col("ref")).alias("baseline"), alt.cast("int").alias("differs"))


def binary(carriers_: DataFrame, baselines_: DataFrame, samples: DataFrame) -> DataFrame:
    """Cells that differ from the baseline: carriers where it is the reference, all others where it is the alternate."""
    marked = baselines_.select("variant_id", "differs")
    plain = carriers_.join(marked.where("differs = 0"), "variant_id", "left_semi").select("sample_id", "variant_id")
    turned = marked.where("differs = 1").select("variant_id").crossJoin(samples.select("sample_id")).join(carriers_, ["sample_id", "variant_id"], "left_anti")
    return plain.union(turned.select("sample_id", "variant_id")).withColumn("value", F.lit(1))


def parse_summary(calls_: DataFrame) -> DataFrame:
    return calls_.agg(F.countDistinct("sample_id").alias("samples"), F.count("*").alias("calls")).withColumn("mean_calls", F.col("calls") / F.nullif(F.col("samples"), F.lit(0)))


def landscape(calls_: DataFrame, presence: int = 3) -> DataFrame:
    every = sites(calls_, 1)
    kept = F.col("carriers") >= presence
    return every.agg(
        F.count("*").alias("sites"), F.sum("carriers").alias("events"), F.sum(kept.cast("int")).alias("kept"), (F.sum(kept.cast("int")) / F.count("*")).alias("retention"),
        F.sum((F.col("carriers") == 1).cast("int")).alias("singletons"), F.sum((F.col("carriers") == 2).cast("int")).alias("doubletons"),
    )


def matrix_stats(cells: DataFrame, samples: int) -> DataFrame:
    """Density, mean carriers of a variant and mean burden of a sample, of cells that hold ones."""
    t = cells.agg(F.countDistinct("variant_id").alias("variants"), F.count("*").alias("ones"))
    return t.select("variants", "ones", (F.col("ones") / (F.col("variants") * samples)).alias("density"), (F.col("ones") / F.col("variants")).alias("mean_carriers"), (F.col("ones") / samples).alias("mean_burden"))


def compact_ids(variants: DataFrame) -> DataFrame:
    """(variant_id, short): v0, v1, ... in order of id. Numbers come from counts of id ranges, not from one global sort."""
    ranged = variants.select("variant_id").distinct().withColumn("h", F.substring("variant_id", 1, 4))
    starts = ranged.groupBy("h").agg(F.count("*").alias("c"))
    starts = starts.select("h", (F.sum("c").over(W.orderBy("h")) - F.col("c")).alias("start"))
    own = F.row_number().over(W.partitionBy("h").orderBy("variant_id")) - 1
    return ranged.withColumn("own", own).join(starts, "h").select("variant_id", F.concat(F.lit("v"), (F.col("start") + F.col("own")).cast("string")).alias("short"))


def qc_report(records: DataFrame) -> DataFrame:
    """One row a sample: what a quality check of its records counts."""
    at = F.array_position("fmt", "GT")
    gt = F.coalesce(F.when(at > 0, F.get("smp", (at - 1).cast("int"))), F.lit(""))
    dp = number(info_value(F.col("info"), "DP"))
    alleles = F.split(gt, r"[/|]")
    c = lambda x: F.sum(x.cast("int"))
    return records.groupBy("sample_id").agg(
        F.count("*").alias("records"), F.countDistinct("chrom").alias("contigs"), c(gt.rlike("^[1-9][0-9]*$")).alias("haploid_alt"),
        c((F.size(alleles) == 2) & (F.get(alleles, F.lit(0)) != F.get(alleles, F.lit(1)))).alias("het"), c(gt.contains(".")).alias("missing"),
        c(gt.rlike("^0([/|]0)?$")).alias("hom_ref"), c(number(F.col("qual")) < 30).alias("low_qual"), F.avg(dp).alias("mean_dp"), c(dp < 10).alias("low_dp"),
        c((F.length("ref") > 1) | F.exists("alts", lambda a: F.length(a) > 1)).alias("indels"), c(F.size("alts") > 1).alias("multiallelic"),
    )
