"""Classifiers over one-hot markers: pyspark.ml where it has the model, relational forms elsewhere."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.classification import NaiveBayes as MultinomialBayes
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import drop_singletons
from .resample import folds, stratified_split


def encode(cells: DataFrame, titles: list[str], samples: DataFrame | None = None) -> DataFrame:
    """(sample_id, features): one-hot ``marker=symbol`` vectors over ``titles``; other symbols are ignored. Of ``samples``, by default those
    with cells; without any they get zeros."""
    rows = cells.groupBy("sample_id").agg(F.collect_set(F.concat_ws("=", "marker", "symbol")).alias("on"))
    if samples is not None:
        rows = samples.select("sample_id").distinct().join(rows, "sample_id", "left").withColumn("on", F.coalesce("on", F.array().cast("array<string>")))
    return CountVectorizerModel.from_vocabulary(titles, "on", "features").transform(rows).select("sample_id", "features")


def titles_of(cells: DataFrame, most: int = 20_000) -> list[str]:
    """Distinct ``marker=symbol`` names in order; a model's width, so bounded by ``most``."""
    rows = cells.where("symbol is not null and symbol <> ''").select(F.concat_ws("=", "marker", "symbol").alias("t")).distinct().orderBy("t").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} one-hot columns; prefilter the markers")
    return [r.t for r in rows]


def estimator(name: str, width: int, classes: int, rows: int, seed: int = 42) -> Any:
    if name == "MLP":
        return MultilayerPerceptronClassifier(layers=[width, 100, classes], maxIter=100, seed=seed)
    if name == "MLP_small":
        return MultilayerPerceptronClassifier(layers=[width, 64, classes], maxIter=60, seed=seed)
    if name == "RF":
        return RandomForestClassifier(numTrees=300 if rows < 5000 else 100, featureSubsetStrategy="sqrt", maxDepth=min(30, 12), seed=seed)
    if name == "DT":
        return DecisionTreeClassifier(maxDepth=12, seed=seed)
    if name == "XGBoost":
        g = GBTClassifier(maxIter=50, maxDepth=6, stepSize=0.05, subsamplingRate=0.9, seed=seed)
        return g if classes == 2 else OneVsRest(classifier=g)
    if name == "NBayes":
        return MultinomialBayes(smoothing=1.0, modelType="multinomial")
    if name in ("SVC", "SVC_RBF", "LinearSVC"):
        s = LinearSVC(maxIter=100, regParam=1 / max(1, rows))
        return s if classes == 2 else OneVsRest(classifier=s)
    return LogisticRegression(regParam=1 / max(1, rows), standardization=False, family="multinomial", maxIter=200)


#: Random features that stand for a kernel.
DIMS = 256


def fourier(df: DataFrame, width: int, gamma: float | None = None, dims: int = DIMS, seed: int = 42) -> DataFrame:
    """Random Fourier features of an RBF kernel, so that a linear SVM stands for a kernel one."""
    import numpy as np

    rng = np.random.default_rng(seed)
    g = gamma or 1.0 / max(1, width)
    w, b = rng.normal(0, np.sqrt(2 * g), (width, dims)), rng.uniform(0, 2 * np.pi, dims)
    turn = F.udf(lambda v: Vectors.dense(np.sqrt(2 / dims) * np.cos((w[v.indices].sum(axis=0) if len(v.indices) else 0) + b)), VectorUDT())
    return df.withColumn("features", turn("features"))


@dataclass
class Trained:
    name: str
    titles: list[str]
    labels: list[str]
    model: Any

    def save(self, path: str) -> None:
        """The model and its titles, anywhere Spark can write."""
        import json

        from pyspark.sql import SparkSession

        self.model.write().overwrite().save(f"{path}/model")
        about = json.dumps({"name": self.name, "titles": self.titles, "labels": self.labels})
        SparkSession.active().createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trained:
        import json

        from pyspark.ml.util import DefaultParamsReader

        about = json.loads(spark.read.text(f"{path}/about").first().value)
        return Trained(about["name"], about["titles"], about["labels"], DefaultParamsReader.loadParamsInstance(f"{path}/model", spark))

    def identify(self, profiles: DataFrame, least: float = 0.0) -> DataFrame:
        """(sample_id, label, prob, place, odd) of profiles (sample_id, marker, symbol) whose marker names fuzzily equal the trained ones.

        Samples with less than ``least`` of the trained markers are left out."""
        from .scoring import formatted, match_features

        names = list(dict.fromkeys(t.split("=", 1)[0] for t in self.titles))
        trained = profiles.sparkSession.createDataFrame(list(enumerate(names)), "idx int, name string")
        cells = match_features(profiles, trained)
        known = cells.groupBy("sample_id").agg((F.countDistinct("marker") / len(names)).alias("share")).where(F.col("share") >= least)
        return formatted(self.score(cells.join(known, "sample_id", "left_semi")))

    def score(self, cells: DataFrame, samples: DataFrame | None = None) -> DataFrame:
        """(sample_id, label, prob) of every label, for ``samples``, by default those with cells."""
        x = encode(cells, self.titles, samples)
        if self.name.startswith("SVC"):
            x = fourier(x, len(self.titles))
        out = self.model.transform(x)
        names = F.array(*[F.lit(v) for v in self.labels])
        if "probability" in out.columns:
            p = vector_to_array("probability")
        else:  # margins, as shares
            p = F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-v)))
            p = F.transform(p, lambda v: v / F.aggregate(p, F.lit(0.0), lambda a, y: a + y))
        return out.select("sample_id", F.explode(F.arrays_zip(names.alias("label"), p.alias("prob"))).alias("x")).select("sample_id", "x.label", "x.prob").where("label is not null")


def train(name: str, cells: DataFrame, labels: DataFrame, seed: int = 42) -> Trained:
    labels = drop_singletons(labels)
    order = [r.label for r in labels.groupBy("label").agg(F.min("sample_id").alias("s")).orderBy("s").collect()]
    titles = titles_of(cells.join(labels, "sample_id", "left_semi"))
    index = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(float(i)))])
    x = encode(cells, titles, labels).join(labels, "sample_id").withColumn("label", F.element_at(index, F.col("label")))
    if name.startswith("SVC"):
        x = fourier(x, len(titles))
    width = DIMS if name.startswith("SVC") else len(titles)
    return Trained(name, titles, order, estimator(name, width, len(order), labels.count(), seed).fit(x.select("features", "label")))


def holdout(name: str, cells: DataFrame, labels: DataFrame, test: float = 0.2, seed: int = 42) -> DataFrame:
    """(sample_id, label, guess) of held-out samples; of all if a label has one sample only."""
    split = stratified_split(drop_singletons(labels), test, seed)
    some = not split.where("test").isEmpty()
    model = train(name, cells, split.where("not test").select("sample_id", "label") if some else labels, seed)
    held = split.where("test") if some else labels
    best = model.score(cells.join(held, "sample_id", "left_semi"), held).groupBy("sample_id").agg(F.max_by("label", F.struct("prob", "label")).alias("guess"))
    return held.select("sample_id", "label").join(best, "sample_id")


PROBES = ("LR", "LinearSVC", "SVC_RBF", "RF", "DT", "MLP_small")


def probe(cells: DataFrame, labels: DataFrame, names: tuple[str, ...] = PROBES, k: int = 5, seed: int = 42) -> dict[str, float]:
    """Mean accuracy of each model over folds dealt within labels; NaN where it cannot be had. Vectors are made once for all of them."""
    least = labels.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    k = min(k, max(2, least))
    dealt = folds(labels.select("sample_id", "label"), k, seed).persist()
    order = [r.label for r in labels.select("label").distinct().orderBy("label").collect()]
    held = {(r.fold, r.label) for r in dealt.select("fold", "label").distinct().collect()}  # folds times labels
    if any(len({c for f, c in held if f != i}) < 2 or not any(f == i for f, _ in held) for i in range(k)):
        return {n: float("nan") for n in names}
    titles = titles_of(cells.join(dealt, "sample_id", "left_semi"))
    rows = labels.count()
    index = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(float(i)))])
    plain = encode(cells, titles, dealt).join(dealt, "sample_id").select("features", "fold", F.element_at(index, F.col("label")).alias("label"))
    plain = plain.coalesce(1 + rows // 10_000).persist()  # solvers pass over it many times: few tasks for few rows
    turned = fourier(plain, len(titles)).persist() if any(n.startswith("SVC") for n in names) else plain
    out = {}
    for n in names:
        x, width = (turned, DIMS) if n.startswith("SVC") else (plain, len(titles))
        got = []
        for i in range(k):
            model = estimator(n, width, len(order), rows, seed).fit(x.where(F.col("fold") != i).select("features", "label"))
            got.append(model.transform(x.where(F.col("fold") == i)).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0])
        out[n] = sum(got) / len(got)
    for x in (dealt, plain, turned):
        x.unpersist()
    return out


def cross_validated(name: str, cells: DataFrame, labels: DataFrame, k: int = 5, seed: int = 42) -> float:
    return probe(cells, labels, (name,), k, seed)[name]


def best_by_cv(cells: DataFrame, labels: DataFrame, k: int = 5) -> tuple[str, dict[str, float]]:
    scores = probe(cells, labels, ("LR", "RF", "NBayes", "SVC_RBF"), k)
    return max(scores, key=lambda n: scores[n] if scores[n] == scores[n] else -1), scores


def linearity_gap(cells: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Held-out accuracy of a forest and a linear model on the same split, and the difference."""
    acc = {n: holdout(n, cells, labels).agg(F.avg((F.col("label") == F.col("guess")).cast("int"))).first()[0] for n in ("RF", "LR")}
    return acc | {"delta": acc["RF"] - acc["LR"]}


def cluster_quality(vectors: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """One row: Calinski-Harabasz, Davies-Bouldin and simplified silhouette of k-means clusters of ``vectors(features)``.

    The silhouette compares distances to centres, not to all points, so it is linear in the rows."""
    import numpy as np

    model = KMeans(k=k, seed=seed, featuresCol="features").fit(vectors)
    centres = np.array(model.clusterCenters())

    def dist(v: Any) -> list[float]:
        return [float(x) for x in np.sqrt(((centres - v.toArray()) ** 2).sum(axis=1))]

    d = model.transform(vectors).withColumn("d", F.udf(dist, "array<double>")("features"))
    own = F.get("d", F.col("prediction"))
    other = F.array_min(F.filter("d", lambda x, i: i != F.col("prediction")))
    per = d.select("prediction", own.alias("a"), other.alias("b")).groupBy("prediction").agg(F.count("*").alias("n"), F.sum("a").alias("sum_a"), F.sum(F.col("a") * F.col("a")).alias("ss"), F.sum((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("sil")).collect()
    n, within = sum(r.n for r in per), sum(r.ss for r in per)
    mean = sum(centres[r.prediction] * r.n for r in per) / n
    between = sum(r.n * float(((centres[r.prediction] - mean) ** 2).sum()) for r in per)
    s = {r.prediction: r.sum_a / r.n for r in per}
    gap = lambda i, j: float(np.sqrt(((centres[i] - centres[j]) ** 2).sum())) or float("nan")
    db = sum(max((s[i] + s[j]) / gap(i, j) for j in s if j != i) for i in s) / len(s) if len(s) > 1 else float("nan")
    ch = between / (len(s) - 1) / (within / (n - len(s))) if len(s) > 1 and within > 0 else float("nan")
    return vectors.sparkSession.createDataFrame([(len(s), ch, db, sum(r.sil for r in per) / n)], "clusters int, calinski_harabasz double, davies_bouldin double, silhouette double")
