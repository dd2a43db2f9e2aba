"""Predictions as rows: ranking, odds, entropy, threshold tables, and relational naive Bayes and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import name_key, normal_symbol


def ranked(predictions: DataFrame) -> DataFrame:
    """``predictions(sample_id, label, prob)`` with place (from 1), likeliest first, ties by label."""
    return predictions.withColumn("place", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("prob"), "label")))


def odds(p: Column) -> Column:
    return F.when(p == 1, F.lit(10.0)).otherwise(p / (1 - p))


def formatted(predictions: DataFrame) -> DataFrame:
    """Ranked rows with ``odd``: 1 for the first, then the first's odds less one's own."""
    best = F.first(odds(F.col("prob"))).over(W.partitionBy("sample_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return ranked(predictions).withColumn("odd", F.when(F.col("place") == 1, F.lit(1.0)).otherwise(best - odds(F.col("prob"))))


def entropy(predictions: DataFrame) -> DataFrame:
    """(sample_id, entropy) of renormalised probabilities, as a share of the most; 0 for one label or a sure one."""
    total = F.sum("prob").over(W.partitionBy("sample_id"))
    p = predictions.withColumn("p", F.col("prob") / total)
    sure = F.max(((F.col("p") <= 0) | (F.col("p") >= 1)).cast("int")) == 1
    s = p.groupBy("sample_id").agg(F.count("*").alias("n"), sure.alias("sure"), F.sum(F.when((F.col("p") > 0), -F.col("p") * F.log2("p")).otherwise(0.0)).alias("h"))
    return s.select("sample_id", F.when((F.col("n") < 2) | F.col("sure"), 0.0).otherwise(F.col("h") / F.log2("n")).alias("entropy"))


def thresholds(low: float, high: float, step: float) -> list[float]:
    """An inclusive grid, rounded to six places."""
    out, i = [], 0
    while low + i * step <= high + step / 10:
        out.append(round(low + i * step, 6))
        i += 1
    return out


def identified(predictions: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """(threshold, sample_id, n_identified, matched): labels at or above each threshold; predictions are scored once."""
    rows = predictions.join(truth.withColumnRenamed("label", "true_label"), "sample_id").withColumn("threshold", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    hit = F.col("prob") >= F.col("threshold")
    return rows.groupBy("threshold", "sample_id").agg(F.sum(hit.cast("int")).alias("n_identified"), F.max((hit & (F.col("label") == F.col("true_label"))).cast("int")).alias("matched"))


def identifications(predictions: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """(sample_id, true_label, identified, matched, top_label, top_prob): labels at or above a threshold, likeliest first and comma-joined."""
    order = F.array_sort(F.collect_list(F.when(F.col("prob") >= threshold, F.struct((-F.col("prob")).alias("p"), "label"))))
    rows = predictions.groupBy("sample_id").agg(order.alias("hits"), F.min(F.struct((-F.col("prob")).alias("p"), "label")).alias("top"))
    names = F.transform("hits", lambda x: x["label"])
    rows = rows.join(truth.select("sample_id", F.col("label").alias("true_label")), "sample_id")
    return rows.select("sample_id", "true_label", F.array_join(names, ",").alias("identified"), F.array_contains(names, F.col("true_label")).alias("matched"), F.col("top.label").alias("top_label"), (-F.col("top.p")).alias("top_prob"))


def threshold_table(hits: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of each threshold, and whether it is the best: the first with the highest f1."""
    t = hits.groupBy("threshold").agg(
        F.sum("matched").alias("tp"), F.sum(((F.col("matched") == 0) & (F.col("n_identified") > 0)).cast("int")).alias("fp"), F.sum((F.col("n_identified") == 0).cast("int")).alias("fn"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t = t.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    t = t.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    best = t.agg(F.max_by("threshold", F.struct(F.round("f1", 12), -F.col("threshold"))).alias("best"))
    return t.join(F.broadcast(best)).withColumn("is_best", F.col("threshold") == F.col("best")).drop("best")


def report(pairs: DataFrame) -> DataFrame:
    """(label, support, predicted, tp, precision, recall, f1) of ``pairs(label, guess)``."""
    true = pairs.groupBy("label").agg(F.count("*").alias("support"), F.sum((F.col("label") == F.col("guess")).cast("int")).alias("tp"))
    said = pairs.groupBy(F.col("guess").alias("label")).agg(F.count("*").alias("predicted"))
    t = true.join(said, "label", "full").fillna(0, ["support", "tp", "predicted"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t = t.withColumn("precision", share(F.col("tp"), F.col("predicted"))).withColumn("recall", share(F.col("tp"), F.col("support")))
    return t.withColumn("f1", share(2 * F.col("tp"), F.col("support") + F.col("predicted")))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("label", "guess").agg(F.count("*").alias("n"))


def naive_bayes(train: DataFrame, labels: DataFrame, query: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(sample_id, label, score): log posterior up to a constant, of categorical cells (sample_id, marker, symbol).

    A symbol that no training sample has counts like an absent one of its marker, for all labels alike."""
    t = train.withColumn("symbol", normal_symbol(F.col("symbol"))).join(labels, "sample_id")
    n_c = labels.groupBy("label").agg(F.count("*").alias("n_c")).withColumn("prior", F.log(F.col("n_c") / F.sum("n_c").over(W.partitionBy(F.lit(1)))))
    k = t.groupBy("marker").agg(F.countDistinct("symbol").alias("k"))
    seen = t.groupBy("label", "marker", "symbol").agg(F.count("*").alias("n"))
    q = query.withColumn("symbol", normal_symbol(F.col("symbol"))).join(k, "marker").join(F.broadcast(n_c))
    q = q.join(seen, ["label", "marker", "symbol"], "left")
    term = F.log((F.coalesce("n", F.lit(0)) + alpha) / (F.col("n_c") + alpha * F.col("k")))
    return q.groupBy("sample_id", "label").agg((F.max("prior") + F.sum(term)).alias("score"))


def profiles(cells: DataFrame) -> DataFrame:
    """(sample_id, profile): a digest of a sample's markers and symbols."""
    return cells.groupBy("sample_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("marker", "symbol")))), 256).alias("profile"))


def nearest_neighbours(train: DataFrame, labels: DataFrame, query: DataFrame, k: int = 5) -> DataFrame:
    """(sample_id, label, prob): distance-weighted votes of the k nearest training samples, one-hot Euclidean distance, ties by sample.

    Samples with equal cells share a profile, and only distinct profiles are compared: by an equi-join on marker and symbol, so pairs
    without a match cost nothing. The k nearest profiles hold the k nearest samples. Only samples that share some symbol can be
    among the nearest unless fewer than k do."""
    t = train.withColumn("symbol", normal_symbol(F.col("symbol")))
    q = query.withColumn("symbol", normal_symbol(F.col("symbol")))
    of_t, of_q = profiles(t), profiles(q)
    members = of_t.withColumn("i", F.row_number().over(W.partitionBy("profile").orderBy("sample_id"))).where(F.col("i") <= k)
    heads = members.where("i = 1").select("sample_id", F.col("profile").alias("near"))
    asks = of_q.groupBy("profile").agg(F.min("sample_id").alias("sample_id"))
    t1, q1 = t.join(heads, "sample_id").withColumnRenamed("sample_id", "first"), q.join(asks, "sample_id")
    markers = t.select("marker").distinct()
    known = t.select("marker", "symbol").distinct().withColumn("known", F.lit(1))
    base = q1.join(markers, "marker").join(known, ["marker", "symbol"], "left").groupBy("profile").agg(F.sum(F.when(F.col("known") == 1, 2).otherwise(1)).alias("most"))
    same = q1.select("profile", "marker", "symbol").join(t1, ["marker", "symbol"]).groupBy("profile", "near").agg(F.count("*").alias("m"), F.min("first").alias("first"))
    d = same.join(base, "profile").withColumn("d2", F.col("most") - 2 * F.col("m"))
    close = d.withColumn("place", F.row_number().over(W.partitionBy("profile").orderBy("d2", "first"))).where(F.col("place") <= k).select("profile", "near", "d2")
    near = close.join(members.select(F.col("profile").alias("near"), "sample_id"), "near")
    near = near.withColumn("place", F.row_number().over(W.partitionBy("profile").orderBy("d2", "sample_id"))).where(F.col("place") <= k)
    exact = F.min("d2").over(W.partitionBy("profile")) == 0
    weight = F.when(exact, (F.col("d2") == 0).cast("double")).otherwise(1 / F.sqrt(F.col("d2")))
    votes = near.withColumn("w", weight).join(labels, "sample_id").groupBy("profile", "label").agg(F.sum("w").alias("w"))
    shares = votes.select("profile", "label", (F.col("w") / F.sum("w").over(W.partitionBy("profile"))).alias("prob"))
    return of_q.join(shares, "profile").select("sample_id", "label", "prob")


def match_features(profile: DataFrame, trained: DataFrame) -> DataFrame:
    """Profile cells (sample_id, marker, symbol) under the trained names (idx, name) that they fuzzily equal; the first trained name wins."""
    names = trained.withColumn("key", name_key(F.col("name"))).groupBy("key").agg(F.min_by("name", "idx").alias("name"))
    return profile.withColumn("key", name_key(F.col("marker"))).join(names, "key").select("sample_id", F.col("name").alias("marker"), "symbol")


def coverage(trained: DataFrame, given: DataFrame) -> DataFrame:
    """(trained, found, share): how many of the trained names a matrix has."""
    t = trained.select("name").distinct().join(given.select("name", F.lit(1).alias("hit")).distinct(), "name", "left")
    return t.agg(F.count("*").alias("trained"), F.sum(F.coalesce("hit", F.lit(0))).alias("found")).withColumn("share", F.col("found") / F.col("trained"))


def dataset_stats(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: samples, features, missing share, sparsity of codes (sample_id, marker, code; null: missing), label imbalance."""
    c = cells.agg(F.countDistinct("sample_id").alias("n"), F.countDistinct("marker").alias("p"), F.avg(F.col("code").isNull().cast("int")).alias("missing"), F.avg((F.coalesce("code", F.lit(0)) == 0).cast("int")).alias("sparsity"))
    per = labels.groupBy("label").agg(F.count("*").alias("c")).agg(F.count("*").alias("classes"), (F.max("c") / F.min("c")).alias("imbalance"))
    return c.crossJoin(per)  # one row each


#: Accepted names of algorithms, and what the unsupported ones fall back to.
ALGORITHMS = {"mlp": "MLP", "rf": "RF", "randomforest": "RF", "svc": "SVC", "scv": "SVC", "lr": "LR", "logisticregression": "LR", "dt": "DT", "decisiontree": "DT", "mbcs": "MBCS", "dnl": "DNL", "knn": "RF", "nbayes": "RF", "xgboost": "RF"}


def resolve_algorithm(recommended: str, requested: str | None = None) -> str:
    """A requested algorithm must be known; an unknown recommendation means RF."""
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    if requested and key(requested) != "auto":
        if key(requested) not in ALGORITHMS:
            raise ValueError(f"unknown algorithm: {requested}")
        return ALGORITHMS[key(requested)]
    return ALGORITHMS.get(key(recommended or ""), "RF")


def recommend(scores: dict[str, float], n: int, p: int, missing: float = 0.0, sparsity: float = 0.0) -> str:
    """A classifier by the scores of probes (LR, LinearSVC, SVC_RBF, RF, DT, MLP_small)."""
    get = lambda *names: max((scores.get(x, float("nan")) for x in names if scores.get(x) == scores.get(x) and x in scores), default=float("nan"))
    linear, bent, tree = get("LR", "LinearSVC"), get("SVC_RBF", "MLP_small", "RF"), get("RF", "DT")
    delta = bent - linear
    if linear >= 0.85 and delta < 0.03:
        return "LR"
    if delta >= 0.05 and n < 10_000:
        if (n >= 2000 or p >= 1000) and get("MLP_small") >= bent - 0.01:
            return "MLP"
        return "SVC"
    best = get(*scores)
    if missing > 0 or sparsity > 0.8 or tree >= best - 0.01:
        return "RF" if not get("DT") > get("RF") else "DT"
    return max(scores, key=lambda k: scores[k] if scores[k] == scores[k] else -1)
