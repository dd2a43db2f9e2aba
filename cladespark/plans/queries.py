"""Queries for the engine's operators and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import workflow
from ..functions import text as fx
from ..operators import annotate, association, calls, columns, models, resample, scoring, tree
from ..sources import sinks
from .grown import bootstrap_sql, grown_sql, relations
from .standins import relation, sql, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED = 42


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero as zero, whole numbers as bigint."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        out.append((F.round(x, digits) + F.lit(0.0)).alias(c) if kind == "double" else x.cast("bigint").alias(c) if kind in ("int", "bigint", "smallint") else x)
    return df.select(*out)


def event_data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return association.align(relation(spark, sf_dir, "event_cells"), relation(spark, sf_dir, "segment_labels"))


CONTINGENCY = """
 t_lab as (select s.sample_id, label from segment_labels s where s.sample_id in (select sample_id from event_cells)),
 t_tot as (select label, count(*) as total from t_lab group by 1),
 t_one as (select variant_id, label, count(*) as ones from event_cells join t_lab using (sample_id) group by 1, 2),
 t_full as (select v.variant_id, t.label, t.total, coalesce(o.ones, 0) as ones from (select distinct variant_id from t_one) v cross join t_tot t left join t_one o on o.variant_id = v.variant_id and o.label = t.label),
 tab as (select variant_id, 1 as value, label, ones as o from t_full union all select variant_id, 0, label, total - ones from t_full)"""
STATISTICS = CONTINGENCY + """,
 m as (select *, sum(o) over (partition by variant_id) as n, sum(o) over (partition by variant_id, value) as r, sum(o) over (partition by variant_id, label) as c from tab),
 st as (select variant_id, max(n) as n, sum((o - cast(r as double) * c / n) * (o - cast(r as double) * c / n) / (cast(r as double) * c / n)) as chi2, (count(distinct value) - 1) * (count(distinct label) - 1) as dof, least(count(distinct value), count(distinct label)) - 1 as side,
   greatest(0, sum(case when o > 0 then cast(o as double) / n * ln(cast(o as double) * n / (cast(r as double) * c)) else 0 end)) as mi from m where r > 0 and c > 0 group by 1),
 pv as (select *, sqrt(chi2 / (n * side)) as v, case when dof = 4 then exp(-chi2 / 2) * (1 + chi2 / 2) when dof = 2 then exp(-chi2 / 2) when chi2 <= 0 then 1.0
   else greatest(0, 1 - list_sum([exp((dof / 2.0 + i) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2.0 + i + 1)) for i in range(0, 400)])) end as p from st)"""
RANKED = STATISTICS + """,
 rk as (select *, count(*) over () as cnt, row_number() over (order by p, variant_id) as rank from pv),
 bh as (select *, least(1, min(p * cnt / rank) over (order by rank desc rows unbounded preceding)) as q from rk)"""
EVENTS = with_("event_cells", "segment_labels") + ","


@query(EVENTS + RANKED + " select variant_id, cast(n as bigint) as n, cast(dof as bigint) as dof, round(chi2, 6) as chi2, round(p, 6) as p, round(q, 6) as q, round(v, 6) as v, round(mi, 6) as mi, case when v < 0.1 then 'negligible' when v < 0.3 then 'small' when v < 0.5 then 'medium' else 'large' end as effect from bh order by p, variant_id limit 20")
def association_top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = event_data(spark, sf_dir)
    found = association.benjamini_hochberg(association.tests(association.contingency(cells, labels).persist()).persist())  # ranked in several steps
    top = found.orderBy("p", "variant_id").limit(20)
    return rounded(top.select("variant_id", "n", "dof", "chi2", "p", "q", "v", "mi", "effect"))


@query(EVENTS + CONTINGENCY + " select variant_id, cast(value as bigint) as value, label, cast(o as bigint) as o from tab")
def contingency_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(association.contingency(*event_data(spark, sf_dir)))


@query(EVENTS + RANKED + ", bf as (select variant_id, least(1, p * cnt) as bonferroni, p <= 0.05 / cnt as kept, q, q <= 0.05 as found from bh) select variant_id, round(bonferroni, 6) as bonferroni, kept, round(q, 6) as q, found from bf")
def multiple_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = association.tests(association.contingency(*event_data(spark, sf_dir)).persist()).select("variant_id", "p").persist()
    bh = association.benjamini_hochberg(p).select("variant_id", "q", F.col("significant").alias("found"))
    bf = association.bonferroni(p).select("variant_id", F.col("q").alias("bonferroni"), F.col("significant").alias("kept"))
    return rounded(bh.join(bf, "variant_id"))


BRAND = with_("brand_cells", "debt_labels") + """,
 lab as (select * from debt_labels where sample_id in (select sample_id from brand_cells)),
 mg as (select count(*) as n, count(*) filter (where label = 'neg') as c0 from lab),
 f as (select variant_id, count(*) as r1, count(*) filter (where label = 'neg') as x from brand_cells join lab using (sample_id) group by 1)"""


@query(BRAND + """,
 d as (select variant_id, n - r1 as r0, r1, c0, n, c0 - x as a from f cross join mg),
 k as (select *, unnest(range(greatest(0, c0 - r1), least(r0, c0) + 1)) as i from d),
 pm as (select *, exp(lgamma(r0 + 1) - lgamma(i + 1) - lgamma(r0 - i + 1) + lgamma(r1 + 1) - lgamma(c0 - i + 1) - lgamma(r1 - c0 + i + 1) - lgamma(n + 1) + lgamma(c0 + 1) + lgamma(n - c0 + 1)) as pmf from k),
 ob as (select variant_id, pmf as po from pm where i = a)
 select variant_id, round(least(1, sum(pmf) filter (where pmf <= po * (1 + 1e-7))), 6) as fisher_p from pm join ob using (variant_id) group by 1""")
def fisher_exact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = association.align(relation(spark, sf_dir, "brand_cells"), relation(spark, sf_dir, "debt_labels"))
    return rounded(association.fisher(association.contingency(cells, labels)))


@query(BRAND + """,
 g as (select variant_id, cast(r1 as double) as r1, cast(n - r1 as double) as r0, cast(c0 as double) as c0, cast(n - c0 as double) as c1, cast(n as double) as n, cast(x as double) as x from f cross join mg),
 o as (select variant_id, n, abs(x - r1 * c0 / n) as gap, r1, r0, c0, c1 from g),
 y as (select variant_id, n, pow(gap - least(0.5, gap), 2) * (n / (r1 * c0) + n / (r1 * c1) + n / (r0 * c0) + n / (r0 * c1)) as chi2 from o where r0 > 0)
 select variant_id, cast(n as bigint) as n, round(chi2, 6) as chi2, round(sqrt(chi2 / n), 6) as v from y""")
def yates_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = association.align(relation(spark, sf_dir, "brand_cells"), relation(spark, sf_dir, "debt_labels"))
    return rounded(association.statistics(association.contingency(cells, labels)).where("dof = 1").select("variant_id", "n", "chi2", "v"))


MUTUAL = """e as (select f1, f2, 'j' as k, 2 * x + y as v, label from j union all select f1, f2, 'a', x, label from j union all select f1, f2, 'b', y, label from j),
 o as (select f1, f2, k, v, label, cast(count(*) as double) as o from e group by all),
 w as (select *, sum(o) over (partition by f1, f2, k) as n, sum(o) over (partition by f1, f2, k, v) as r, sum(o) over (partition by f1, f2, k, label) as c from o),
 mi as (select f1, f2, k, sum(o / n * ln(o * n / (r * c))) as mi from w group by all)"""
PAIRS = "select a.p_brand as f1, b.p_brand as f2 from (select distinct p_brand from {part}) a join (select distinct p_brand from {part}) b on a.p_brand < b.p_brand"
JOINT = with_("brand_cells", "segment_labels") + ", prs as (" + PAIRS.format(part="part") + """),
 lab as (select * from segment_labels where sample_id in (select sample_id from brand_cells)),
 j as (select f1, f2, l.sample_id, l.label, case when a.sample_id is null then 0 else 1 end as x, case when b.sample_id is null then 0 else 1 end as y from prs cross join lab l left join brand_cells a on a.sample_id = l.sample_id and a.variant_id = f1 left join brand_cells b on b.sample_id = l.sample_id and b.variant_id = f2),
 """ + MUTUAL


def brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAIRS.format(part=f"parquet.`{sf_dir}/part.parquet`"))


@query(JOINT + " select f1, f2, round(greatest(0, sum(case when k = 'j' then mi else -mi end)), 6) + 0.0 as strength from mi group by 1, 2")
def feature_synergy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = association.align(relation(spark, sf_dir, "brand_cells"), relation(spark, sf_dir, "segment_labels"))
    return rounded(association.synergy(cells, labels, brand_pairs(spark, sf_dir)))


DEALT = EVENTS + f""" lab as (select * from segment_labels where sample_id in (select sample_id from event_cells)), r as (select unnest(range(-1, 20)) as perm),
 da as (select perm, sample_id, row_number() over (partition by perm order by sample_id) as i from lab cross join r),
 db as (select perm, label, row_number() over (partition by perm order by case when perm < 0 then null else md5(concat_ws('|', '{SEED}', cast(perm as varchar), sample_id)) end, sample_id) as i from lab cross join r),
 prs as (select * from (values ('click_1', 'view_1'), ('click_2', 'purchase_2'), ('view_3', 'purchase_3')) p(g1, g2)),
 j as (select perm || '|' || g1 as f1, g2 as f2, db.label, case when a.sample_id is null then 0 else 1 end as x, case when b.sample_id is null then 0 else 1 end as y from prs cross join da join db using (perm, i) left join event_cells a on a.sample_id = da.sample_id and a.variant_id = g1 left join event_cells b on b.sample_id = da.sample_id and b.variant_id = g2),
 """ + MUTUAL + """, st as (select cast(split_part(f1, '|', 1) as int) as perm, split_part(f1, '|', 2) as f1, f2, sum(case when k = 'j' then mi else -mi end) as s from mi group by 1, 2, 3),
 sh as (select f1, f2, o.s as observed, avg(case when x.s >= o.s - 1e-12 then 1.0 else 0 end) as p from st x join st o using (f1, f2) where x.perm >= 0 and o.perm < 0 group by 1, 2, 3)
 select f1, f2, round(observed, 6) as observed, round(p, 6) as p, p < 0.05 as significant from sh"""


@query(DEALT)
def interaction_permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = association.align(relation(spark, sf_dir, "event_cells"), relation(spark, sf_dir, "segment_labels"))
    pairs = spark.createDataFrame([("click_1", "view_1"), ("click_2", "purchase_2"), ("view_3", "purchase_3")], "f1 string, f2 string")
    return rounded(resample.permutation_test(cells, labels, pairs, 20, SEED))


@query(with_("segment_labels") + f""" , r as (select unnest(range(0, 3)) as perm),
 a as (select perm, sample_id, row_number() over (partition by perm order by sample_id) as i from segment_labels cross join r),
 b as (select perm, label, row_number() over (partition by perm order by md5(concat_ws('|', '{SEED}', cast(perm as varchar), sample_id))) as i from segment_labels cross join r)
 select cast(perm as bigint) as perm, sample_id, label from a join b using (perm, i)""")
def permuted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.permuted(relation(spark, sf_dir, "segment_labels"), 3, SEED))


@query(with_("segment_labels") + f""", nb as (select sample_id, row_number() over (order by substr(md5(sample_id), 1, 2), sample_id) - 1 as i, count(*) over () as n from segment_labels),
 d as (select rep, floor(cast(('0x' || substr(md5(concat_ws('|', '{SEED}', cast(rep as varchar), cast(i as varchar))), 1, 13)) as bigint) / 4503599627370496.0 * n) as i from nb cross join (select unnest(range(0, 3)) as rep))
 select cast(rep as bigint) as rep, sample_id, cast(count(*) as double) as w from d join nb using (i) group by 1, 2""")
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.bootstrap(relation(spark, sf_dir, "segment_labels"), 3, SEED))


@query(f"with s as (select cast(c_custkey as varchar) as sample_id, c_mktsegment as stratum from customer), g as (select stratum, count(*) as size, row_number() over (order by stratum) - 1 as k, count(*) over () as g from s group by 1), q as (select stratum, least(size, 123 // g + case when k < 123 % g then 1 else 0 end) as quota from g), p as (select *, row_number() over (partition by stratum order by md5(concat_ws('|', '{SEED}', sample_id)), sample_id) as place from s) select stratum, sample_id from p join q using (stratum) where place <= quota")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_mktsegment").alias("stratum"))
    return resample.quota_sample(s, "stratum", 123, SEED).select("stratum", "sample_id")


@query(f"select cast(c_custkey as varchar) as sample_id from customer order by md5(concat_ws('|', '{SEED}', cast(c_custkey as varchar))), 1 limit 100")
def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.simple_sample(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id")), 100, SEED)


@query(with_("segment_labels") + f""", p as (select *, count(*) over (partition by label) as n, row_number() over (partition by label order by md5(concat_ws('|', '{SEED}', sample_id)), sample_id) as place from segment_labels)
 select sample_id, label, place <= greatest(1, round(n * 0.2)) as test, cast((place - 1) % 5 as bigint) as fold from p""")
def stratified_split_and_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = relation(spark, sf_dir, "segment_labels")
    return rounded(resample.stratified_split(labels, 0.2, SEED).join(resample.folds(labels, 5, SEED), ["sample_id", "label"]))


# Calls

CALLS = with_("raw_calls") + """, good as (select * from raw_calls where qual >= 30 and dp >= 5 and mq0f <= 0.08),
 last_ as (select *, row_number() over (partition by sample_id, chrom, pos order by line_no desc, ref desc, called desc) as k from good),
 calls as (select sample_id, chrom, pos, ref, called from last_ where k = 1)"""
SITES = CALLS + """, every as (select chrom, pos, ref, called as alt, count(*) as carriers from calls where called <> ref group by all),
 sites as (select * from every where carriers >= 3)"""


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text records as a call file has them, parsed."""
    raw = relation(spark, sf_dir, "raw_calls")
    info = F.concat(F.lit("DB;DP=0;DP="), "dp", F.lit(";MQ=60;MQ0F="), "mq0f")
    line = F.concat_ws("\t", "chrom", "pos", F.lit("."), F.lower("ref"), F.when(F.col("called") == F.col("ref"), F.lit("N")).otherwise(F.col("called")), "qual", F.lit("."), info, F.lit("DP:GT"), F.concat(F.lit("9:"), F.when(F.col("called") == F.col("ref"), "0/0").otherwise("0/1")))
    head = raw.select("sample_id").distinct().select("sample_id", F.lit(0).cast("bigint").alias("line_no"), F.lit("#CHROM\tPOS").alias("value"))
    return calls.parse_records(raw.select("sample_id", "line_no", line.alias("value")).union(head))


def call_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.calls(call_records(spark, sf_dir), depth=5, zero=0.08).persist()  # read several times by a query


@query(CALLS + " select sample_id, chrom, cast(pos as bigint) as pos, ref, called from calls")
def variant_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(call_table(spark, sf_dir))


@query(SITES + " select chrom, cast(pos as bigint) as pos, ref, alt, cast(carriers as bigint) as carriers from sites")
def carrier_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calls.sites(call_table(spark, sf_dir)))


@query(SITES + " select sample_id, concat_ws(':', chrom, cast(pos as varchar), ref, alt) as variant_id, cast(1 as bigint) as value from calls c join sites s using (chrom, pos, ref) where c.called = s.alt")
def sparse_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = call_table(spark, sf_dir)
    return rounded(calls.carriers(c, calls.sites(c)))


BASELINES = SITES + """, smp as (select distinct sample_id from calls),
 dense as (select s.sample_id, chrom, pos, ref, alt, case when c.called = alt then alt else ref end as base from smp s cross join sites left join calls c using (sample_id, chrom, pos, ref)),
 bc as (select chrom, pos, ref, alt, base, count(*) as n, min(sample_id) as f from dense group by all),
 bl as (select *, row_number() over (partition by chrom, pos, ref, alt order by n desc, f) as k from bc),
 baseline as (select chrom, pos, ref, alt, base as baseline, case when base <> ref then 1 else 0 end as differs from bl where k = 1)"""


@query(BASELINES + " select concat_ws(':', chrom, cast(pos as varchar), ref, alt) as variant_id, baseline, cast(differs as bigint) as differs from baseline")
def site_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = call_table(spark, sf_dir)
    return rounded(calls.baselines(c, calls.sites(c)))


@query(BASELINES + """, ones as (select chrom, pos, ref, alt, sample_id from dense join baseline using (chrom, pos, ref, alt) where base <> baseline), ns as (select count(*) as n from smp),
 t as (select count(distinct (chrom, pos, ref, alt)) as variants, count(*) as ones from ones) select cast(variants as bigint) as variants, cast(ones as bigint) as ones, round(ones / (variants * n), 6) as density, round(ones / variants, 6) as mean_carriers, round(ones / n, 6) as mean_burden from t cross join ns""")
def binary_matrix_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = call_table(spark, sf_dir)
    s = calls.sites(c)
    samples = c.select("sample_id").distinct()
    ones = calls.binary(calls.carriers(c, s), calls.baselines(c, s), samples)
    return rounded(calls.matrix_stats(ones, samples.count()))


@query(SITES + ", a as (select count(distinct sample_id) as samples, count(*) as calls from calls), b as (select count(*) as sites, sum(carriers) as events, count(*) filter (where carriers >= 3) as kept, count(*) filter (where carriers = 1) as singletons, count(*) filter (where carriers = 2) as doubletons from every) select cast(samples as bigint) as samples, cast(calls as bigint) as calls, round(calls / samples, 6) as mean_calls, cast(sites as bigint) as sites, cast(events as bigint) as events, cast(kept as bigint) as kept, round(kept / sites, 6) as retention, cast(singletons as bigint) as singletons, cast(doubletons as bigint) as doubletons from a cross join b")
def cohort_landscape(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = call_table(spark, sf_dir)
    return rounded(calls.parse_summary(c).crossJoin(calls.landscape(c)))


@query(SITES + ", d as (select distinct concat_ws(':', chrom, cast(pos as varchar), ref, alt) as variant_id from sites) select variant_id, 'v' || cast(row_number() over (order by substr(variant_id, 1, 4), variant_id) - 1 as varchar) as short from d")
def compact_variant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = calls.sites(call_table(spark, sf_dir))
    return calls.compact_ids(s.select(calls.variant_id().alias("variant_id")))


INDELS = with_("raw_calls") + ", r as (select *, case when line_no % 701 = 0 then 'AT' else ref end as longer from raw_calls), i as (select distinct chrom, pos from r where length(longer) > 1)"


@query(INDELS + """ select r.sample_id, cast(line_no as bigint) as line_no, chrom, cast(pos as bigint) as pos, cast(case when dp < 6 then null when called <> ref then 1 else 0 end as bigint) as value from r
 where length(longer) > 1 or not exists (select 1 from i where i.chrom = r.chrom and r.pos between i.pos - 2 and i.pos + 3)""")
def masked_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes away from indels, missing where the sample's own depth is low."""
    raw = relation(spark, sf_dir, "raw_calls")
    longer = F.when(F.col("line_no") % 701 == 0, "AT").otherwise(F.col("ref"))
    gt = F.when(F.col("called") == F.col("ref"), "0/0").otherwise("0|1")
    r = raw.select("sample_id", "line_no", "chrom", "pos", longer.alias("ref"), F.array("called").alias("alts"), F.array(F.lit("DP"), F.lit("GT")).alias("fmt"), F.array(F.col("dp").cast("string"), gt).alias("smp"))
    kept = calls.masked(calls.away_from_indels(r, 2), least_depth=6)
    return rounded(kept.select("sample_id", "line_no", "chrom", "pos", calls.genotype_value(F.col("fmt"), F.col("smp")).alias("value")))


@query(with_("raw_calls") + " select sample_id, cast(count(*) as bigint) as records, cast(count(distinct chrom) as bigint) as contigs, cast(0 as bigint) as haploid_alt, cast(count(*) filter (where called <> ref) as bigint) as het, cast(0 as bigint) as missing, cast(count(*) filter (where called = ref) as bigint) as hom_ref, cast(count(*) filter (where qual < 30) as bigint) as low_qual, round(avg(dp), 6) as mean_dp, cast(count(*) filter (where dp < 10) as bigint) as low_dp, cast(0 as bigint) as indels, cast(0 as bigint) as multiallelic from raw_calls group by 1")
def call_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calls.qc_report(call_records(spark, sf_dir)))


@query(SITES + ", v as (select concat_ws(':', chrom, cast(pos as varchar), ref, alt) as variant_id, carriers / (select count(distinct sample_id) from calls) as af from every) (select 'low' as side, variant_id, round(af, 6) as af from v order by v.af, variant_id limit 8) union all (select 'high', variant_id, round(af, 6) from v order by v.af desc, variant_id limit 8)")
def allele_frequency_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = call_table(spark, sf_dir)
    v = calls.sites(c, 1).crossJoin(c.agg(F.countDistinct("sample_id").alias("n"))).select(calls.variant_id().alias("variant_id"), (F.col("carriers") / F.col("n")).alias("af"))
    low, high = v.orderBy("af", "variant_id").limit(8), v.orderBy(F.desc("af"), "variant_id").limit(8)
    return rounded(low.select(F.lit("low").alias("side"), "variant_id", "af").union(high.select(F.lit("high"), "variant_id", "af")))


# Columns

COUNTS = with_("event_cells") + ", n_ as (select count(distinct sample_id) as n from event_cells), ct as (select variant_id, count(*) as ones from event_cells group by 1)"


@query(COUNTS + " select variant_id, cast(ones as bigint) as ones, cast(least(ones, n - ones) as bigint) as minor from ct cross join n_ where ones > 0 and ones < n and least(ones, n - ones) >= 45")
def minor_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = relation(spark, sf_dir, "event_cells")
    n = cells.select("sample_id").distinct().count()
    kept = columns.varying(columns.sparse_counts(cells), n, 45)
    return rounded(kept.join(columns.minor_counts(kept, n), "variant_id"))


GATED = "select cast(l_orderkey as string) as sample_id, concat(l_returnflag, l_linestatus, cast(l_linenumber as string)) as variant_id, case when l_tax > 0.06 then null when l_discount > 0.05 then 1 else 0 end as value from {lineitem}"


@query("with c as (" + GATED.format(lineitem="lineitem").replace("as string", "as varchar") + "), n as (select count(distinct sample_id) as n from c), g as (select variant_id, cast(count(value) as double) / max(n) as filled, avg(value) as mean, var_samp(value) as variance from c cross join n group by 1) select variant_id, round(filled, 6) as filled, round(mean, 6) as mean, round(variance, 6) as variance, round(least(mean, 1 - mean), 6) as maf from g where filled >= 0.01 and least(mean, 1 - mean) >= 0.1")
def column_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.sql(GATED.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))
    n = c.select("sample_id").distinct().count()
    return rounded(columns.passing(columns.numeric_gates(c, n), 0.01, 0.1).select("variant_id", "filled", "mean", "variance", "maf"))


@query(with_("brand_cells") + """, pt as (select variant_id, string_agg(sample_id, ',' order by sample_id) as pattern from brand_cells group by 1),
 k as (select variant_id, pattern, row_number() over (partition by pattern order by cast(substr(variant_id, 7) as int), variant_id) - 1 as place, count(*) over (partition by pattern) as n from pt)
 select variant_id, cast(n as bigint) as n from k where n <= 3 or list_contains([cast(round_even(i * (n - 1) / 2.0, 0) as bigint) for i in range(0, 3)], place)""")
def redundant_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = relation(spark, sf_dir, "brand_cells")
    pos = cells.select("variant_id", F.substring("variant_id", 7, 9).cast("int").alias("pos")).distinct()
    p = columns.patterns(cells).join(pos, "variant_id").withColumn("n", F.count("*").over(W.partitionBy("pattern")))
    return rounded(columns.even_pick(p.withColumn("size", F.col("n")), "pattern", ["pos", "variant_id"], 3).select("variant_id", F.col("size").alias("n")))


DIRTY = "select distinct concat(' ', o_orderpriority, case when o_orderkey % 3 = 0 then '' else ' ' end) as raw, concat(' S', cast(o_custkey as string), case when o_orderkey % 2 = 0 then '.vcf.gz' else '_library3' end) as file, case when o_orderkey % 5 = 0 then 'NA' when o_orderkey % 7 = 0 then ' - ' else o_orderstatus end as mark from {orders}"


@query("with d as (" + DIRTY.format(orders="orders").replace("as string", "as varchar") + ") select distinct replace(trim(raw), '-', '_') as label, case when trim(mark) in ('', '-', 'NA', 'N/A', 'None', 'nan', 'NaN') then null else replace(trim(mark), '-', '_') end as mark, regexp_replace(replace(replace(trim(file), '.vcf.gz', ''), '.vcf', ''), '_library[0-9]+$', '') as sample_id from d")
def label_and_sample_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(DIRTY.format(orders=f"parquet.`{sf_dir}/orders.parquet`"))
    return d.select(fx.normal_label(F.col("raw")).alias("label"), fx.normal_label(F.col("mark")).alias("mark"), fx.normal_sample(F.col("file")).alias("sample_id")).distinct()


# Symbols

SYMBOLS = with_("symbols", "segment_labels") + ", sy as (select sample_id, marker, case when lower(trim(symbol)) in ('', 'nd', 'nan') then '' else trim(symbol) end as symbol from symbols)"


@query(SYMBOLS + ", s2 as (select *, case when symbol = '' then '__MISSING__' else symbol end as s from sy), o as (select marker, s, row_number() over (partition by marker order by s) - 1 as code from (select distinct marker, s from s2)) select sample_id, marker, cast(code as bigint) as code from s2 join o using (marker, s)")
def category_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(columns.codes(relation(spark, sf_dir, "symbols")))


@query(SYMBOLS + " select marker, string_agg(symbol, '|' order by symbol) as symbols from (select distinct marker, symbol from sy where symbol <> '') group by 1")
def symbols_of_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.symbols_of(relation(spark, sf_dir, "symbols")).select("marker", F.array_join("symbols", "|").alias("symbols"))


@query(SYMBOLS + " select marker, round(avg(case when symbol is null or trim(symbol) = '' or trim(symbol) = 'nd' then 1 else 0 end), 6) as empty_share from symbols group by 1 having avg(case when symbol is null or trim(symbol) = '' or trim(symbol) = 'nd' then 1 else 0 end) <= 0.05")
def empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = columns.drop_empty(relation(spark, sf_dir, "symbols"), 0.05, "nd")
    return rounded(columns.empty_share(kept, "nd"))


@query(with_("symbols") + ", l as (select sample_id, symbol as label from symbols where marker = 'nation') select sample_id, label from l where label in (select label from l group by 1 having count(*) >= 3)")
def singleton_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = relation(spark, sf_dir, "symbols").where("marker = 'nation'").select("sample_id", F.col("symbol").alias("label"))  # noqa: E741
    return columns.drop_singletons(l, 3).select("sample_id", "label")


@query(SYMBOLS + ", c as (select count(distinct sample_id) as n, count(distinct marker) as p, avg(case when symbol = '' then 1 else 0 end) as missing from sy), per as (select count(*) as classes, cast(max(c) as double) / min(c) as imbalance from (select label, count(*) as c from segment_labels group by 1)) select cast(n as bigint) as n, cast(p as bigint) as p, round(missing, 6) as missing, cast(classes as bigint) as classes, round(imbalance, 6) as imbalance from c cross join per")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = columns.codes(relation(spark, sf_dir, "symbols"), missing=None).withColumn("code", F.when(F.col("code") >= 0, F.col("code")))
    return rounded(scoring.dataset_stats(coded, relation(spark, sf_dir, "segment_labels")).drop("sparsity"))


@query("with t as (select row_number() over (order by p_name) as idx, p_brand || ' ' || p_type as name from (select distinct p_name, p_brand, p_type from part)), p as (select distinct upper(p_brand) || '-' || p_type as marker from part) select marker, min(name) as name from p join (select distinct name from t) on lower(regexp_replace(trim(marker), '[^0-9A-Za-z]', '', 'g')) = lower(regexp_replace(trim(name), '[^0-9A-Za-z]', '', 'g')) group by 1")
def fuzzy_feature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    trained = part.select("p_brand", "p_type").distinct().select(F.concat_ws(" ", "p_brand", "p_type").alias("name")).withColumn("idx", F.col("name"))
    profile = part.select(F.concat_ws("-", F.upper("p_brand"), "p_type").alias("marker")).distinct().withColumn("sample_id", F.lit("s")).withColumn("symbol", F.col("marker"))
    m = scoring.match_features(profile, trained)
    return m.select(F.col("symbol").alias("marker"), F.col("marker").alias("name"))


@query("select cast(count(*) as bigint) as trained, cast(count(*) filter (where p_brand in (select p_brand from part where p_size < 3)) as bigint) as found, round(count(*) filter (where p_brand in (select p_brand from part where p_size < 3)) / count(*), 6) as share from (select distinct p_brand from part)")
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return rounded(scoring.coverage(part.select(F.col("p_brand").alias("name")), part.where("p_size < 3").select(F.col("p_brand").alias("name"))))


@query("select c_nationkey as k, 'both' as part from (select c_nationkey from customer intersect select s_nationkey from supplier) union all select c_nationkey, 'left' from (select c_nationkey from customer where c_acctbal < 0 except select s_nationkey from supplier) union all select k, 'any' from (select c_nationkey as k from customer where c_acctbal > 9900 union select s_nationkey from supplier where s_acctbal > 9000)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    a, b = c.select("c_nationkey"), s.select("s_nationkey")
    both, left = a.intersect(b), c.where("c_acctbal < 0").select("c_nationkey").subtract(b)
    either = c.where("c_acctbal > 9900").select("c_nationkey").union(s.where("s_acctbal > 9000").select("s_nationkey")).distinct()
    tag = lambda d, n: d.toDF("k").withColumn("part", F.lit(n))
    return tag(both, "both").union(tag(left, "left")).union(tag(either, "any"))


# Places

@query(with_("regions", "places") + ', h as (select variant_id, min(idx) as idx from places join regions on start <= pos - 1 and pos - 1 < "end" group by 1) select p.variant_id, cast(p.pos as bigint) as pos, cast(h.idx as bigint) as idx from places p left join h using (variant_id)')
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = annotate.overlapping(relation(spark, sf_dir, "places"), relation(spark, sf_dir, "regions"))
    return rounded(o.select("variant_id", "pos", F.col("cds.idx").alias("idx")))


@query(with_("regions", "places") + ', d as (select variant_id, idx, least(abs(pos - 1 - start), abs(pos - 1 - "end")) as distance from places cross join regions), k as (select *, row_number() over (partition by variant_id order by distance, idx) as k from d) select variant_id, cast(idx as bigint) as nearest_idx, cast(distance as bigint) as distance from k where k = 1')
def nearest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annotate.nearest(relation(spark, sf_dir, "places"), relation(spark, sf_dir, "regions")))


BASES = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz ', '" + "ACGT" * 6 + "AC" + "ACGT" * 6 + "AC" + "G')"


@query(f"""with g as (select doc_id, {BASES} as s, length(text) as n from documents where length(text) > 0)
 select doc_id, substr(repeat(s, cast(ceil(21.0 / n) as int) + 2), cast(((doc_id % n - 10) % n + n) % n + 1 as int), 21) as context, translate(array_to_string(list_reverse(regexp_extract_all(s, '(?s).')), ''), 'ACGT', 'TGCA') as reverse from g""")
def circular_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters A to Z and blanks stand for bases, others stay as they are; empty and null texts have no place and are left out."""
    d = table(spark, sf_dir, "documents").where("char_length(text) > 0").select("doc_id", F.expr(BASES).alias("s"))
    return d.select("doc_id", fx.context(F.col("s"), F.pmod("doc_id", F.length("s")) + 1, 10).alias("context"), fx.reverse_complement(F.col("s")).alias("reverse"))


GENOME = ("ACGTTGCAGT", 2001)
CODED = with_("regions", "places") + f""", gn as (select repeat('{GENOME[0]}', {GENOME[1]}) as g),
 cds as (select idx, start as st, start + 9 as en, idx % 2 = 0 as plus, case when idx % 2 = 0 then '+' else '-' end || 'L' || idx || ' | g | p | [' as gene from regions),
 hit as (select variant_id, min(idx) as idx from places join cds on st <= pos - 1 and pos - 1 < en group by 1),
 near as (select variant_id, arg_min(idx, (least(abs(pos - 1 - st), abs(pos - 1 - en)), idx)) as idx from places cross join cds where variant_id not in (select variant_id from hit) group by 1),
 r as (select p.variant_id, pos, c.*, case when plus then pos - 1 - st else en - pos end as rel from places p join hit using (variant_id) join cds c using (idx)),
 w as (select *, substr(g, case when plus then st + 3 * (rel // 3) + 1 else en - 3 * (rel // 3 + 1) + 1 end, 3) as raw from r cross join gn),
 o as (select *, case when plus then raw else translate(reverse(raw), 'ACGT', 'TGCA') end as old_ from w),
 n as (select *, substr(old_, 1, rel % 3) || case when plus then 'C' else 'G' end || substr(old_, rel % 3 + 2) as new_ from o),
 f as (select variant_id, pos, 'coding' as region_type, rel + 1 as rel_pos, rel // 3 + 1 as codon_number, old_ || '|' || new_ as nucleotide_change, {{old}} || '|' || {{new}} as amino_change, gene || (st + 1) || '..' || en || ']' as gene from n
  union all select p.variant_id, pos, 'non-coding', null, null, 'A|C', '-', gene || (st + 1) || '..' || (st + 1) || ']' from places p join near using (variant_id) join cds using (idx))
 select variant_id, cast(pos as bigint) as pos, region_type, cast(rel_pos as bigint) as rel_pos, cast(codon_number as bigint) as codon_number, nucleotide_change, amino_change, gene, substr(g || g || g, {len(GENOME[0]) * GENOME[1]} + pos - 40, 81) as context from f cross join gn"""


def amino_sql(codon: str) -> str:
    return f"substr('{fx.AMINO}', " + " + ".join(f"{w} * (instr('TCAG', substr({codon}, {i}, 1)) - 1)" for i, w in ((1, 16), (2, 4), (3, 1))) + " + 1, 1)"


@query(CODED.format(old=amino_sql("old_"), new=amino_sql("new_")))
def coding_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cds = relation(spark, sf_dir, "regions").select("idx", "start", (F.col("start") + 9).alias("end"), F.when(F.col("idx") % 2 == 0, 1).otherwise(-1).alias("strand"), F.concat(F.lit("L"), "idx").alias("locus_tag"), F.lit("g").alias("gene"), F.lit("p").alias("product"))
    v = relation(spark, sf_dir, "places").withColumns({"ref": F.lit("A"), "alt": F.lit("C")})
    return rounded(annotate.annotate(v, cds, GENOME[0] * GENOME[1]))


# Trees

SPLITS = EVENTS + """ lab as (select s.sample_id, label from segment_labels s where s.sample_id in (select sample_id from event_cells)),
 tot as (select label, cast(count(*) as double) as t from lab group by 1), one as (select variant_id, label, cast(count(*) as double) as o from event_cells join lab using (sample_id) group by 1, 2),
 gr as (select v.variant_id, t, coalesce(o, 0) as o from (select distinct variant_id from one) v cross join tot left join one on one.variant_id = v.variant_id and one.label = tot.label),
 sc as (select variant_id, sum(t) as n, sum(o) as n1, sum(t - o) as n0, sum(t * t) as tt, sum(o * o) as oo, sum((t - o) * (t - o)) as zz from gr group by 1)
 select cast(1 as bigint) as node_id, variant_id, n, n1, round(1 - tt / (n * n), 6) as gini, round(((n0 - zz / n0) + (n1 - oo / n1)) / n, 6) as child from sc where n0 > 0 and n1 > 0"""


@query(SPLITS)
def root_split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = event_data(spark, sf_dir)
    return rounded(tree.split_scores(cells, labels.withColumns({"node_id": F.lit(1).cast("bigint"), "w": F.lit(1.0)})))


SAMPLES = EVENTS + relations("event_cells", "segment_labels") + ","
GROWN = SAMPLES + grown_sql(4)


@query(GROWN + " select node_id, cast(depth as bigint) as depth, variant_id, cast(left_ as bigint) as \"left\", cast(right_ as bigint) as \"right\", n, round(gain, 6) as gain, label from nodes")
def decision_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tree.grow(*event_data(spark, sf_dir), max_depth=4).rows(spark))


@query(GROWN + " select round(sum(most) filter (where variant_id is null) / (select count(*) from lab), 6) as accuracy from nodes")
def decision_tree_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = event_data(spark, sf_dir)
    grown = tree.grow(cells, labels, max_depth=4)
    return rounded(tree.accuracy(tree.predict(grown, cells, labels), labels))


@query(GROWN + " select variant_id, case when avg(depth) <= 1.5 then 'root' else 'branch' end as role from nodes where variant_id is not null group by 1")
def root_and_branch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, branches = tree.grow(*event_data(spark, sf_dir), max_depth=4).roots_and_branches()
    return spark.createDataFrame([(f, "root") for f in roots] + [(f, "branch") for f in branches], "variant_id string, role string")


@query(GROWN + """, ch as (select x.variant_id as f1, y.variant_id as f2, y.n as support, y.depth from nodes x join nodes y on y.node_id in (x.left_, x.right_) where x.variant_id is not null and y.variant_id is not null),
 j as (select f1, f2, l.label, case when a.sample_id is null then 0 else 1 end as x, case when b.sample_id is null then 0 else 1 end as y from (select distinct f1, f2 from ch) cross join lab l left join cells a on a.sample_id = l.sample_id and a.variant_id = f1 left join cells b on b.sample_id = l.sample_id and b.variant_id = f2),
 """ + MUTUAL + """, st as (select f1, f2, greatest(0, sum(case when k = 'j' then mi else -mi end)) as strength from mi group by 1, 2)
 select f1, f2, support, cast(depth + 1 as bigint) as path_depth, case when depth = 1 then 'pairwise' else 'conditional' end as kind, round(strength, 6) as strength from ch join st using (f1, f2) where strength > 0.001 order by st.strength desc, f1, f2, depth limit 50""")
def epistatic_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = event_data(spark, sf_dir)
    return rounded(tree.interactions(tree.grow(cells, labels, max_depth=4), cells, labels, 0.001))


@query(EVENTS + RANKED + """, good as (select variant_id, p, q from bh where q <= 0.05 order by p, variant_id limit 20), e as (select count(distinct sample_id) as n from t_lab),
 ct as (select variant_id, count(*) as ones, max(n) as n from event_cells join t_lab using (sample_id) cross join e group by 1),
 top as (select variant_id from ct where ones < n order by cast(ones * (n - ones) as double) / (n * (n - 1.0)) desc, variant_id limit 20)
 select variant_id, round(p, 6) as p, round(q, 6) as q, 'significant' as why from good union all select variant_id, null, null, 'variance' from top where not exists (select 1 from good)""")
def prefiltered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = event_data(spark, sf_dir)
    return rounded(association.prefilter(cells, labels, labels.count(), most=20))


@query(SAMPLES + bootstrap_sql(3, 2, SEED) + """, sm as (select variant_id, avg(importance) as mean, quantile_cont(importance, 0.025) as low, quantile_cont(importance, 0.975) as high, stddev_samp(importance) as sd from imp group by 1),
 tt as (select *, abs(mean) / (sd / sqrt(3.0)) as t from sm where sd > 0)
 select variant_id, round(sm.mean, 6) as mean, round(sm.low, 6) as low, round(sm.high, 6) as high, round(stability, 6) as stability, round(1 - t / sqrt(t * t + 2), 6) as p from sm join stable using (variant_id) left join tt using (variant_id)""")
def bootstrap_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = association.align(relation(spark, sf_dir, "event_cells"), relation(spark, sf_dir, "segment_labels"))
    found = resample.bootstrap_validation(cells, labels, 3, SEED, 2)
    return rounded(found.withColumn("p", F.when(~F.isnan("p"), F.col("p"))))  # no p where all importances are 0


@query(SAMPLES + bootstrap_sql(2, 2, SEED) + "," + STATISTICS.replace("with ", "") + " select variant_id, round(mi, 6) as mi, round(v, 6) as v, round(stability, 6) as stability, round(0.4 * mi + 0.4 * stability + 0.2 * v, 6) as confidence from pv join stable using (variant_id)")
def feature_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, labels = association.align(relation(spark, sf_dir, "event_cells"), relation(spark, sf_dir, "segment_labels"))
    s = association.statistics(association.contingency(cells, labels)).select("variant_id", "mi", "v")
    b = resample.bootstrap_validation(cells, labels, 2, SEED, 2).select("variant_id", "stability")
    return rounded(s.join(b, "variant_id").withColumn("confidence", association.confidence(F.col("mi"), F.col("stability"), F.col("v"))))


# Predictions

PREDICTED = with_("predictions") + ", rk as (select *, row_number() over (partition by sample_id order by prob desc, label) as place from predictions), truth as (select sample_id, label from rk where place = 1 + cast(sample_id as int) % 2)"


def truth_of(p: DataFrame) -> DataFrame:
    return scoring.ranked(p).where(F.col("place") == 1 + F.col("sample_id").cast("int") % 2).select("sample_id", "label")


@query(PREDICTED + ", b as (select *, case when prob = 1 then 10 else prob / (1 - prob) end as od from rk) select sample_id, label, round(prob, 6) as prob, cast(place as bigint) as place, round(case when place = 1 then 1 else max(case when place = 1 then od end) over (partition by sample_id) - od end, 6) as odd from b")
def formatted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.formatted(relation(spark, sf_dir, "predictions")))


@query(PREDICTED + ", s as (select sample_id, prob / sum(prob) over (partition by sample_id) as p from predictions) select sample_id, round(case when count(*) < 2 or max(p) >= 1 or min(p) <= 0 then 0 else -sum(p * log2(p)) / log2(count(*)) end, 6) as entropy from s group by 1")
def prediction_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.entropy(relation(spark, sf_dir, "predictions")))


@query(PREDICTED + """, gr as (select round(0.1 + 0.05 * i, 6) as threshold from range(0, 9) t(i)), h as (select threshold, p.sample_id, sum(case when prob >= threshold then 1 else 0 end) as k, max(case when prob >= threshold and p.label = t.label then 1 else 0 end) as m from predictions p join truth t on t.sample_id = p.sample_id cross join gr group by 1, 2),
 a as (select threshold, sum(m) as tp, sum(case when m = 0 and k > 0 then 1 else 0 end) as fp, sum(case when k = 0 then 1 else 0 end) as fn from h group by 1), b as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0 end as rc from a),
 c as (select *, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end as f1 from b) select threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(pr, 6) as precision, round(rc, 6) as recall, round(f1, 6) as f1, row_number() over (order by round(f1, 12) desc, threshold) = 1 as is_best from c""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = relation(spark, sf_dir, "predictions")
    return rounded(scoring.threshold_table(scoring.identified(p, truth_of(p), scoring.thresholds(0.1, 0.5, 0.05))))


PAIRED = PREDICTED + ", pairs as (select t.label, r.label as guess from truth t join rk r on r.sample_id = t.sample_id and r.place = 1)"


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = relation(spark, sf_dir, "predictions")
    top = scoring.ranked(p).where("place = 1").select("sample_id", F.col("label").alias("guess"))
    return truth_of(p).join(top, "sample_id").select("label", "guess")


@query(PAIRED + " select label, guess, cast(count(*) as bigint) as n from pairs group by 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.confusion(guessed(spark, sf_dir)))


@query(PAIRED + ", a as (select label, count(*) as support, count(*) filter (where label = guess) as tp from pairs group by 1), b as (select guess as label, count(*) as predicted from pairs group by 1), c as (select coalesce(a.label, b.label) as label, coalesce(support, 0) as support, coalesce(tp, 0) as tp, coalesce(predicted, 0) as predicted from a full join b on a.label = b.label) select label, cast(support as bigint) as support, cast(tp as bigint) as tp, cast(predicted as bigint) as predicted, round(case when predicted > 0 then tp / predicted else 0 end, 6) as precision, round(case when support > 0 then tp / support else 0 end, 6) as recall, round(2 * tp / (support + predicted), 6) as f1 from c")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.report(guessed(spark, sf_dir)))


SPLIT = SYMBOLS + ", tr as (select * from sy where cast(sample_id as int) % 10 <> 0), qu as (select * from sy where cast(sample_id as int) % 10 = 0), tl as (select * from segment_labels where cast(sample_id as int) % 10 <> 0)"


@query(SPLIT + """, nc as (select label, count(*) as n_c, ln(cast(count(*) as double) / sum(count(*)) over ()) as prior from tl group by 1), km as (select marker, count(distinct symbol) as k from tr join tl using (sample_id) group by 1), sn as (select label, marker, symbol, count(*) as n from tr join tl using (sample_id) group by all)
 select q.sample_id, nc.label, round(max(prior) + sum(ln((coalesce(n, 0) + 1.0) / (n_c + k))), 6) as score from qu q join km using (marker) cross join nc left join sn on sn.label = nc.label and sn.marker = q.marker and sn.symbol = q.symbol group by 1, 2""")
def naive_bayes_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, l = relation(spark, sf_dir, "symbols"), relation(spark, sf_dir, "segment_labels")  # noqa: E741
    held = F.col("sample_id").cast("int") % 10 == 0
    return rounded(scoring.naive_bayes(s.where(~held), l.where(~held), s.where(held)))


@query(SPLIT + """, kn as (select distinct marker, symbol from tr), bs as (select q.sample_id, sum(case when kn.marker is null then 1 else 2 end) as most from qu q left join kn using (marker, symbol) group by 1),
 sm as (select q.sample_id as qid, t.sample_id, count(*) as m from qu q join tr t using (marker, symbol) group by 1, 2), d as (select sm.*, most - 2 * m as d2 from sm join bs on bs.sample_id = qid), k as (select *, row_number() over (partition by qid order by d2, sample_id) as place, min(d2) over (partition by qid) as lo from d),
 w as (select qid, label, sum(case when lo = 0 then (case when d2 = 0 then 1 else 0 end) else 1 / sqrt(d2) end) as w from k join tl using (sample_id) where place <= 5 group by 1, 2) select qid as sample_id, label, round(w / sum(w) over (partition by qid), 6) as prob from w""")
def nearest_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, l = relation(spark, sf_dir, "symbols"), relation(spark, sf_dir, "segment_labels")  # noqa: E741
    held = F.col("sample_id").cast("int") % 10 == 0
    return rounded(scoring.nearest_neighbours(s.where(~held), l.where(~held), s.where(held)))


def user_symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cells, labels = association.align(relation(spark, sf_dir, "event_cells"), relation(spark, sf_dir, "debt_labels"))
    return cells.select("sample_id", F.col("variant_id").alias("marker"), F.lit("1").alias("symbol")), labels


@query()
def logistic_regression_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(models.holdout("LR", *user_symbols(spark, sf_dir)))


@query()
def random_forest_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion(models.holdout("RF", *user_symbols(spark, sf_dir)))


@query()
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return models.cluster_quality(e.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")), 8)


# Exports

@query(SITES + ", h as (select sample_id, concat_ws(':', chrom, cast(pos as varchar), ref, alt) as v from calls c join sites s using (chrom, pos, ref) where c.called = s.alt), vs as (select distinct concat_ws(':', chrom, cast(pos as varchar), ref, alt) as v from sites), smp as (select distinct sample_id from calls) select s.sample_id, string_agg(case when h.v is null then '0' else '1' end, '' order by vs.v) as seq from smp s cross join vs left join h on h.sample_id = s.sample_id and h.v = vs.v group by 1")
def binary_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = call_table(spark, sf_dir)
    s = calls.sites(c)
    dense = calls.dense_alleles(c, s).withColumn("bit", (F.split("variant_id", ":")[2] != F.col("base")).cast("int"))
    order = s.select(calls.variant_id().alias("variant_id")).withColumn("idx", F.col("variant_id"))
    return sinks.sequences(dense, order, "bit")


@query(SITES + """, o as (select chrom, pos, ref, alt, carriers, row_number() over (order by chrom, pos, ref, alt) - 1 as idx from sites)
 select cast(idx as bigint) as idx, concat_ws(':', chrom, cast(pos as varchar), ref, alt) as variant_id, cast(pos as varchar) as "Position", cast(carriers as varchar) as "Count" from o""")
def ordered_site_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.site_table(spark, calls.sites(call_table(spark, sf_dir)), None).select("idx", "variant_id", "Position", "Count")


@query(SITES + """, smp as (select distinct sample_id from calls), d as (select s.sample_id, chrom, pos, ref, alt, case when c.called = alt then alt else ref end as base from smp s cross join sites left join calls c using (sample_id, chrom, pos, ref))
 select sample_id, string_agg(base, '' order by chrom, pos, ref, alt) as seq, string_agg(case when base <> ref then '1' else '0' end, '' order by chrom, pos, ref, alt) as bits from d group by 1""")
def allele_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles and bits of all sites as one string a sample, from carriers alone."""
    c = call_table(spark, sf_dir)
    s = calls.sites(c).persist()
    samples = c.select("sample_id").distinct()
    at = columns.numbered(s.withColumn("variant_id", calls.variant_id()), *calls.SITE).persist()
    refs = "".join(r.ref for r in at.select("idx", "ref").orderBy("idx").collect())  # one base a column of the export
    hits = calls.carriers(c, s).join(at.select("variant_id", "idx", "alt"), "variant_id")
    alleles = sinks.lines(hits.select("sample_id", "idx", F.col("alt").alias("symbol")), samples, refs)
    bits = sinks.lines(hits.select("sample_id", "idx", F.lit("1").alias("symbol")), samples, "0" * len(refs))
    return alleles.join(bits.withColumnRenamed("seq", "bits"), "sample_id")


@query(PREDICTED + """ select r.sample_id, t.label as true_label, coalesce(string_agg(r.label, ',' order by r.prob desc, r.label) filter (where r.prob >= 0.25), '') as identified, max(case when r.prob >= 0.25 and r.label = t.label then 1 else 0 end) = 1 as matched,
 max(case when place = 1 then r.label end) as top_label, round(max(r.prob), 6) as top_prob from rk r join truth t on t.sample_id = r.sample_id group by 1, 2""")
def identified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = relation(spark, sf_dir, "predictions")
    return rounded(scoring.identifications(p, truth_of(p), 0.25))


@query(SYMBOLS + " select marker, coalesce(string_agg(cast(n as varchar), ',' order by n), '') as numbers from (select distinct marker, try_cast(trim(symbol) as int) as n from symbols) group by 1")
def integer_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.integers_of(relation(spark, sf_dir, "symbols")).select("marker", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))


HOT = "select cast(l_orderkey as string) as sample_id, concat('flag=', l_returnflag, '=', cast(l_linenumber as string)) as title, case when l_quantity > 45 and l_linenumber < 4 then 1 else 0 end as value from {lineitem}"


@query("with h as (" + HOT.format(lineitem="lineitem").replace("as string", "as varchar") + "), d as (select distinct split_part(title, '=', 1) as marker, substr(title, instr(title, '=') + 1) as symbol from h where value <> 0) select marker, string_agg(symbol, '|' order by symbol) as symbols from d group by 1")
def used_one_hot_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = spark.sql(HOT.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))
    return columns.used_titles(hot).select("marker", F.array_join("symbols", "|").alias("symbols"))


@query("select o_orderpriority as label, cast(row_number() over (order by min(o_orderkey), o_orderpriority) - 1 as bigint) as code from orders where o_orderpriority is not null group by 1")
def first_seen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), "o_orderkey")
    return rounded(columns.first_seen(orders, "label", "o_orderkey"))


@query("select p_partkey, case when length(n) <= 20 then n else substr(n, 1, 8) || '...' || substr(n, length(n) - 8, 9) end as name, round(greatest(-2.0, least(2.0, (p_retailprice - 1000) / 100)), 6) + 0.0 as clipped from (select p_partkey, p_retailprice, p_name || ' ' || p_type || ' ' || p_brand as n from part)")
def shortened_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return rounded(part.select("p_partkey", fx.elided(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 20).alias("name"), fx.clipped((F.col("p_retailprice") - 1000) / 100).alias("clipped")))


@query("with c as (" + GATED.format(lineitem="lineitem").replace("as string", "as varchar") + "), n as (select count(distinct sample_id) as n from c), g as (select variant_id, cast(count(value) as double) / max(n) as filled, avg(value) as mean from c cross join n group by 1) select variant_id, round(mean * filled, 6) as share from g where filled = 1 or mean * filled between 0.02 and 0.98")
def nearly_constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.sql(GATED.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))
    n = c.select("sample_id").distinct().count()
    g = columns.near_constant(columns.numeric_gates(c, n), 0.02, 0.98)
    return rounded(g.select("variant_id", (F.col("mean") * F.col("filled")).alias("share")))


TYPED = "select idx, case when idx % 3 = 0 then ' Coding' when idx % 3 = 1 then 'coding ' else 'non-coding' end as region_type, case when idx % 4 = 0 then 'A|A' when idx % 4 = 1 then 'A|V' when idx % 4 = 2 then '-|V' else ' K | R' end as amino_change from (select distinct cast(p_partkey as int) as idx from {part})"


@query("with t as (" + TYPED.format(part="part") + "), k as (select *, trim(split_part(amino_change, '|', 1)) as a, trim(split_part(amino_change, '|', 2)) as b from t) select cast(idx as bigint) as idx, (lower(trim(region_type)) = 'coding' and a <> b and a not in ('', '-') and b not in ('', '-')) or idx in (2, 14) as keep from k")
def typed_and_forced_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.sql(TYPED.format(part=f"parquet.`{sf_dir}/part.parquet`"))
    some = columns.type_filter(t, "sense-mutations").select("idx", F.lit(True).alias("hit"))
    mask = t.join(some, "idx", "left").select("idx", F.coalesce("hit", F.lit(False)).alias("keep"))
    return rounded(columns.forced(mask, "2, x 14"))


@query("with e as (select event_id, 'DB;K=0;' || 'K=' || coalesce(json_extract_string(props, '$.k'), '') || ';V=' || event_type as info from events) select event_id, json_extract_string(props, '$.k') as k, event_type as v from events")
def info_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of repeated keys of ``;``-separated text, as a map and one by one."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("DB;K=0;K="), F.get_json_object("props", "$.k"), F.lit(";V="), F.col("event_type")).alias("info"))
    return e.select("event_id", fx.info_value(F.col("info"), "K").alias("k"), fx.info_map(F.col("info"))["V"].alias("v"))


@query("select cast(c_custkey as varchar) as sample_id, c_mktsegment as stratum, 'S' || cast(c_custkey as varchar) || '.vcf.gz' as target from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def subset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that have both metadata and a file."""
    meta = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("n_nationkey"))
    files = table(spark, sf_dir, "nation").where("n_regionkey = 1")
    return meta.join(files, "n_nationkey", "left_semi").select("sample_id", "stratum", F.concat(F.lit("S"), "sample_id", F.lit(".vcf.gz")).alias("target"))


@query()
def classifier_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated accuracies of the linear and the tree probe, and the classifier they speak for."""
    symbols, labels = user_symbols(spark, sf_dir)
    scores = models.probe(symbols, labels, ("LR", "DT"), 3)
    best = scoring.recommend(scores, labels.count(), symbols.select("marker").distinct().count())
    return spark.createDataFrame([(n, v, best) for n, v in scores.items()], "probe string, accuracy double, recommendation string")
