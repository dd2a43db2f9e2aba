"""Seeded resampling that any SQL engine can repeat: every draw comes from an md5 of seed and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def draw(*parts: Column) -> Column:
    """Sort key of a seeded shuffle."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the key."""
    return F.conv(F.substring(draw(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def bootstrap(samples: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(rep, sample_id, w): n draws with replacement from n samples in each replicate, as counts.

    Samples are numbered within buckets of their hash, so neither numbering nor drawing needs all of them in a task."""
    keyed = samples.select("sample_id").withColumn("b", F.substring(F.md5(F.col("sample_id").cast("string")), 1, 2))
    sizes = keyed.groupBy("b").agg(F.count("*").alias("c")).select("b", (F.sum("c").over(W.orderBy("b")) - F.col("c")).alias("start"), F.sum("c").over(W.partitionBy(F.lit(1))).alias("n"))
    numbered = keyed.join(F.broadcast(sizes), "b").select("sample_id", "n", (F.col("start") + F.row_number().over(W.partitionBy("b").orderBy("sample_id")) - 1).alias("i"))
    reps = numbered.select("i", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    drawn = reps.select("rep", F.floor(uniform(F.lit(seed), F.col("rep"), F.col("i")) * F.col("n")).alias("i")).groupBy("rep", "i").agg(F.count("*").cast("double").alias("w"))
    return drawn.join(numbered.select("i", "sample_id"), "i").select("rep", "sample_id", "w")


def permuted(labels: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(perm, sample_id, label): the labels dealt out anew in each permutation."""
    every = labels.select("sample_id", "label", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    by_id = F.row_number().over(W.partitionBy("perm").orderBy("sample_id"))
    by_draw = F.row_number().over(W.partitionBy("perm").orderBy(draw(F.lit(seed), F.col("perm"), F.col("sample_id"))))
    left = every.select("perm", "sample_id", by_id.alias("i"))
    right = every.select("perm", "label", by_draw.alias("i"))
    return left.join(right, ["perm", "i"]).select("perm", "sample_id", "label")


def permutation_test(cells: DataFrame, labels: DataFrame, pairs: DataFrame, permutations: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """(f1, f2, observed, p, significant): share of permutations whose synergy is at least that seen, all in one job."""
    from .association import mutual_information, pair_table, synergy

    seen = synergy(cells, labels, pairs, clip=False).withColumnRenamed("strength", "observed")
    # a permutation and a label together are a label of the joint table, so samples without ones are never rows
    dealt = permuted(labels, permutations, seed).select("sample_id", F.struct("perm", "label").alias("label"))
    table = pair_table(cells, dealt, pairs.select("f1", "f2").distinct()).select("f1", "f2", "value", "label.perm", "label.label", "o")
    by = ["perm", "f1", "f2"]
    whole = mutual_information(table, by)
    one = mutual_information(table.withColumn("value", F.floor(F.col("value") / 2)), by).withColumnRenamed("mi", "m1")
    two = mutual_information(table.withColumn("value", F.col("value") % 2), by).withColumnRenamed("mi", "m2")
    s = whole.join(one, by).join(two, by).select(*by, (F.col("mi") - F.col("m1") - F.col("m2")).alias("s"))
    out = s.join(seen, ["f1", "f2"]).groupBy("f1", "f2", "observed").agg(F.avg((F.col("s") >= F.col("observed") - 1e-12).cast("int")).alias("p"))
    return out.withColumn("significant", F.col("p") < alpha)


def quota_sample(samples: DataFrame, stratum: str, n: int, seed: int, key: str = "sample_id") -> DataFrame:
    """Equal quotas of each stratum, one more for the first ``n mod strata``, as far as it has rows; drawn by hash."""
    sizes = samples.groupBy(stratum).agg(F.count("*").alias("size"))
    order = sizes.withColumn("s", F.row_number().over(W.orderBy(stratum)) - 1).withColumn("g", F.count("*").over(W.partitionBy(F.lit(1))))
    quota = order.select(stratum, F.least("size", F.floor(n / F.col("g")) + (F.col("s") < n % F.col("g")).cast("int")).alias("quota"))
    place = F.row_number().over(W.partitionBy(stratum).orderBy(draw(F.lit(seed), F.col(key)), key))
    return samples.withColumn("place", place).join(F.broadcast(quota), stratum).where("place <= quota").drop("place", "quota")


def simple_sample(samples: DataFrame, n: int, seed: int, key: str = "sample_id") -> DataFrame:
    return samples.orderBy(draw(F.lit(seed), F.col(key)), key).limit(n)


def stratified_split(labels: DataFrame, test: float, seed: int) -> DataFrame:
    """``labels`` with ``test``: the same share of each label, at least one row; none is held out if a label has one row only."""
    w = W.partitionBy("label")
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(draw(F.lit(seed), F.col("sample_id")), "sample_id"))
    least = labels.groupBy("label").agg(F.count("*").alias("c")).agg(F.min("c").alias("least"))
    out = labels.join(F.broadcast(least)).withColumn("n", n).withColumn("place", place)
    return out.withColumn("test", (F.col("least") >= 2) & (F.col("place") <= F.greatest(F.lit(1), F.round(F.col("n") * test)))).drop("n", "place", "least")


def folds(labels: DataFrame, k: int, seed: int) -> DataFrame:
    """``labels`` with ``fold``, dealt out within each label."""
    place = F.row_number().over(W.partitionBy("label").orderBy(draw(F.lit(seed), F.col("sample_id")), "sample_id"))
    return labels.withColumn("fold", (place - 1) % k)


def bootstrap_summary(importances: DataFrame, features: int) -> DataFrame:
    """Mean, 95 % interval, stability and t test of ``importances(rep, variant_id, importance)``."""
    from ..functions.special import t_two_sided

    rank = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("importance"), "variant_id"))
    r = importances.withColumn("rank", rank).groupBy("variant_id").agg(
        F.avg("importance").alias("mean"), F.percentile("importance", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.avg((F.col("rank") <= max(1, features / 2)).cast("int")).alias("stability"),
        F.stddev_samp("importance").alias("sd"), F.count("*").alias("b"),
    )
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("b"))).when(F.col("mean") != 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return r.select("variant_id", "mean", F.get("ci", F.lit(0)).alias("low"), F.get("ci", F.lit(1)).alias("high"), "stability", t_two_sided(t, F.col("b") - 1).alias("p"))


def bootstrap_validation(cells: DataFrame, labels: DataFrame, replicates: int, seed: int, max_depth: int = 5, cut=None, batch: int = 50, least_split: float = 2, least_leaf: float = 1) -> DataFrame:
    """Summaries of tree importances over replicates that all features share; replicates with one label are left out.

    ``batch`` replicates grow together: each level of their trees is one set of jobs."""
    from .tree import grow_all

    spark = cells.sparkSession
    draws = bootstrap(labels, replicates, seed).join(labels.select("sample_id", "label"), "sample_id")
    features = cells.select("variant_id").distinct()
    some: list[tuple[int, str, float]] = []
    reps: list[tuple[int]] = []
    for at in range(0, replicates, batch):
        mine = draws.where(F.col("rep").between(at, at + batch - 1))
        for rep, tree in grow_all(cells, mine, max_depth, least_split, least_leaf, cut).items():
            if len(tree.nodes[1].counts) > 1:
                reps.append((rep,))
                some += [(rep, f, float(v)) for f, v in tree.importances().items()]
    found = spark.createDataFrame(some, "rep int, variant_id string, importance double")  # at most one row a tree node
    every = features.join(F.broadcast(spark.createDataFrame(reps, "rep int")))
    return bootstrap_summary(every.join(found, ["rep", "variant_id"], "left").fillna(0.0, ["importance"]), features.count())
