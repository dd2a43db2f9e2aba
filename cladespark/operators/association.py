"""Association of all features with a label at once: one grouped contingency table, then expressions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.special import chi2_sf, fisher_exact
from ..functions.text import effect_class, normal_sample


def align(cells: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells and labels of the samples that both have, by normalised sample id.

    Of a sample's equal labels one counts; a sample with different labels is left out. Labels are joined to cells, so
    Catalyst can broadcast them only where they are small."""
    one = labels.where("label is not null").select(normal_sample(F.col("sample_id")).alias("sample_id"), "label").groupBy("sample_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    one = one.where("label = other").select("sample_id", "label")
    left = cells.withColumn("sample_id", normal_sample(F.col("sample_id")))
    return left.join(one, "sample_id", "left_semi"), one.join(left.select("sample_id").distinct(), "sample_id", "left_semi")


def contingency(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(variant_id, value, label, o) of sparse 0/1 cells, zeros from the label totals; every cell of the table is there."""
    ones = cells.where("value = 1").join(labels, "sample_id").groupBy("variant_id", "label").agg(F.count("*").alias("ones"))
    totals = labels.groupBy("label").agg(F.count("*").alias("total"))
    grid = ones.select("variant_id").distinct().join(F.broadcast(totals))  # labels are few: classes, not samples
    full = grid.join(ones, ["variant_id", "label"], "left").withColumn("ones", F.coalesce("ones", F.lit(0)))
    return full.select("variant_id", "label", F.explode(F.array(F.struct(F.lit(0).alias("value"), (F.col("total") - F.col("ones")).alias("o")), F.struct(F.lit(1).alias("value"), F.col("ones").alias("o")))).alias("x")).select("variant_id", "x.value", "label", "x.o")


def dense_contingency(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """The table of cells that hold all values; null values and labels do not count."""
    return cells.where("value is not null").join(labels.where("label is not null"), "sample_id").groupBy("variant_id", "value", "label").agg(F.count("*").alias("o"))


def statistics(table: DataFrame, yates: bool = True) -> DataFrame:
    """(variant_id, n, min_o, rows, cols, dof, chi2, chi2_raw, mi, v, square) of a contingency table of every feature; square: its four
    counts in order where it is 2 x 2."""
    f, r, c = W.partitionBy("variant_id"), W.partitionBy("variant_id", "value"), W.partitionBy("variant_id", "label")
    t = table.withColumns({"n": F.sum("o").over(f), "r": F.sum("o").over(r), "c": F.sum("o").over(c)}).where("r > 0 and c > 0")
    t = t.withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    gap = F.abs(F.col("o") - F.col("e"))
    corrected = F.pow(gap - F.least(F.lit(0.5), gap), 2) / F.col("e")
    mi = F.when(F.col("o") > 0, F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("r") * F.col("c")))).otherwise(0.0)
    s = t.groupBy("variant_id").agg(
        F.max("n").alias("n"), F.min("o").alias("min_o"), F.countDistinct("value").alias("rows"), F.countDistinct("label").alias("cols"),
        F.array_sort(F.collect_list(F.struct("value", "label", "o"))).alias("square"), F.sum(gap * gap / F.col("e")).alias("chi2_raw"), F.sum(corrected).alias("chi2_yates"), F.greatest(F.sum(mi), F.lit(0.0)).alias("mi"),
    )
    s = s.withColumn("dof", (F.col("rows") - 1) * (F.col("cols") - 1))
    s = s.withColumn("square", F.when((F.col("rows") == 2) & (F.col("cols") == 2) & (F.size("square") == 4), F.transform("square", lambda x: x["o"])))
    chi2 = F.when((F.col("dof") == 1) & F.lit(yates), F.col("chi2_yates")).when(F.col("dof") > 0, F.col("chi2_raw")).otherwise(0.0)
    side = F.least("rows", "cols") - 1
    return s.withColumn("chi2", chi2).withColumn("v", F.when((side > 0) & (F.col("n") > 0), F.sqrt(F.col("chi2") / (F.col("n") * side))).otherwise(0.0)).drop("chi2_yates")


def fisher(table: DataFrame) -> DataFrame:
    """(variant_id, fisher_p) of features with a 2 x 2 table."""
    return statistics(table).where("square is not null").select("variant_id", fisher_of("square").alias("fisher_p"))


def fisher_of(square: str) -> Column:
    """Fisher's exact p of the four counts of a table; null if there are none."""
    return fisher_exact(*[F.get(square, F.lit(i)) for i in range(4)])


def tests(table: DataFrame, fisher_below: int | None = None) -> DataFrame:
    """Statistics with ``p``: chi-square, or Fisher's exact test for 2 x 2 tables (``fisher_below``: only if a cell is lower)."""
    small = F.col("square").isNotNull() if fisher_below is None else F.col("square").isNotNull() & (F.col("min_o") < fisher_below)
    s = statistics(table).withColumn("square", F.when(small, F.col("square"))).withColumn("fisher_p", fisher_of("square"))
    return s.withColumn("p", F.coalesce("fisher_p", chi2_sf("chi2", "dof"))).withColumn("effect", effect_class(F.col("v"))).drop("square")


def benjamini_hochberg(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``p(variant_id, p, ...)`` with q (adjusted p) and significant.

    Ranks are needed over all features, yet no task holds them all: features are counted in buckets of log p, each bucket's start
    rank comes from the bucket counts, and running minima go over the bucket first and over buckets then."""
    p = p.where("p is not null").withColumn("b", F.when(F.col("p") <= 0, -400).otherwise(F.greatest(F.lit(-400), F.floor(F.log2("p") * 8))).cast("int"))
    totals = p.groupBy("b").agg(F.count("*").alias("c")).withColumn("m", F.sum("c").over(W.partitionBy(F.lit(1)))).withColumn("start", F.sum("c").over(W.orderBy("b")) - F.col("c"))
    ranked = p.join(F.broadcast(totals), "b").withColumn("rank", F.col("start") + F.row_number().over(W.partitionBy("b").orderBy("p", "variant_id")))
    ranked = ranked.withColumn("raw", F.col("p") * F.col("m") / F.col("rank"))
    within = F.min("raw").over(W.partitionBy("b").orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0))
    later = ranked.groupBy("b").agg(F.min("raw").alias("low")).select("b", F.min("low").over(W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)).alias("later"))
    out = ranked.withColumn("within", within).join(F.broadcast(later), "b")
    q = F.least(F.lit(1.0), F.col("within"), F.coalesce("later", F.lit(1.0)))
    return out.withColumn("q", q).withColumn("significant", q <= alpha).drop("b", "c", "m", "start", "raw", "within", "later")


def bonferroni(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    m = p.agg(F.count("p").alias("m"))
    return p.join(F.broadcast(m)).withColumn("q", F.least(F.lit(1.0), F.col("p") * F.col("m"))).withColumn("significant", F.col("p") <= alpha / F.col("m")).drop("m")


def mutual_information(table: DataFrame, by: list[str]) -> DataFrame:
    """(by..., mi) in nats of tables (by..., value, label, o)."""
    t = table.groupBy(*by, "value", "label").agg(F.sum("o").alias("o"))
    w = W.partitionBy(*by)
    t = t.withColumns({"n": F.sum("o").over(w), "r": F.sum("o").over(W.partitionBy(*by, "value")), "c": F.sum("o").over(W.partitionBy(*by, "label"))})
    return t.where("o > 0").groupBy(*by).agg(F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("r") * F.col("c")))).alias("mi"))


def pair_table(cells: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(f1, f2, value, label, o): joint values of feature pairs, as 2 * value1 + value2, from ones alone.

    Only samples with both ones are joined; the other counts follow from those of each feature and the label totals."""
    pairs = pairs.select("f1", "f2")
    plain = cells.where("value = 1").select("sample_id", "variant_id").distinct()
    ones = plain.join(labels.select("sample_id", "label"), "sample_id")  # a sample may have several labels, each of its own permutation
    per = ones.groupBy("variant_id", "label").agg(F.count("*").alias("c"))
    one = pairs.join(ones.withColumnRenamed("variant_id", "f1"), "f1")
    both = one.join(plain.withColumnRenamed("variant_id", "f2"), ["sample_id", "f2"]).groupBy("f1", "f2", "label").agg(F.count("*").alias("b"))
    totals = labels.groupBy("label").agg(F.count("*").alias("total"))
    grid = pairs.join(F.broadcast(totals)).join(per.toDF("f1", "label", "c1"), ["f1", "label"], "left").join(per.toDF("f2", "label", "c2"), ["f2", "label"], "left").join(both, ["f1", "f2", "label"], "left").fillna(0, ["c1", "c2", "b"])
    counts = F.array(F.col("total") - F.col("c1") - F.col("c2") + F.col("b"), F.col("c2") - F.col("b"), F.col("c1") - F.col("b"), F.col("b"))
    return grid.select("f1", "f2", "label", F.posexplode(counts).alias("value", "o")).select("f1", "f2", F.col("value").cast("bigint").alias("value"), "label", "o").where("o > 0")


def synergy(cells: DataFrame, labels: DataFrame, pairs: DataFrame, clip: bool = True) -> DataFrame:
    """(f1, f2, strength): what two features tell of the label beyond what each tells."""
    joint = pair_table(cells, labels, pairs.select("f1", "f2").distinct())
    whole = mutual_information(joint, ["f1", "f2"])
    one = mutual_information(joint.withColumn("value", F.floor(F.col("value") / 2)), ["f1", "f2"]).withColumnRenamed("mi", "m1")
    two = mutual_information(joint.withColumn("value", F.col("value") % 2), ["f1", "f2"]).withColumnRenamed("mi", "m2")
    s = whole.join(one, ["f1", "f2"]).join(two, ["f1", "f2"]).withColumn("s", F.col("mi") - F.col("m1") - F.col("m2"))
    return s.select("f1", "f2", (F.greatest(F.lit(0.0), F.col("s")) if clip else F.col("s")).alias("strength"))


def prefilter(cells: DataFrame, labels: DataFrame, n: int, most: int | None = None, alpha: float = 0.05, tested: int | None = None) -> DataFrame:
    """(variant_id, p, q, why): features to model. The most variable are tested; significant ones stay, the least p first; if none
    is significant the most variable stay."""
    counts = cells.where("value = 1").groupBy("variant_id").agg(F.count("*").alias("ones")).where((F.col("ones") > 0) & (F.col("ones") < n))
    var = counts.withColumn("variance", F.col("ones") * (n - F.col("ones")) / F.lit(float(n) * (n - 1)))
    cap = tested if tested is not None else (20_000 if most is None else max(10_000, 2 * most))
    top = var.orderBy(F.desc("variance"), "variant_id").limit(cap)
    found = benjamini_hochberg(tests(contingency(cells.join(top, "variant_id", "left_semi"), labels)), alpha)
    good = found.where("significant").select("variant_id", "p", "q", F.lit("significant").alias("why"))
    if most is not None:
        good = good.orderBy("p", "variant_id").limit(most)
    if not good.isEmpty():
        return good
    return top.limit(min(most or 5000, cap)).select("variant_id", F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("q"), F.lit("variance").alias("why"))


def confidence(mi, stability, v):
    return 0.4 * mi + 0.4 * stability + 0.2 * v
