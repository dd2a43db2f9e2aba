"""Toxicity by a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A text is the set of its hashed character n-grams (lower case, code points). For each n-gram the log ratio of its smoothed
document shares under both labels scales the feature, and logistic regression on the scaled features gives the weights.
The model is fitted on a bounded sample of labelled rows (``SAMPLE`` of each label, by a hash of the id), with the intercept
corrected for the label shares of all labelled rows; every whole text is then scored in one narrow pass.

Null and empty texts have no n-grams and get the score of the intercept. Labelled ids without a document, null labels
and null ids are not learned from; of several labels of one id the larger counts. With no labelled rows, or only one label,
the score is the smoothed share of label 1. Repeated rows get repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import lean, only, small_batches, trim

#: Rows of each label that the model is fitted on, at most.
SAMPLE = 1536
BITS = 18
GRAMS = (3, 4, 5)
#: A longer text is taken in parts that overlap by the longest n-gram.
PART = 1 << 20


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hashed(cp: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the n-grams that start at each place, for each n."""
    out, x = [], cp.astype(np.uint32) + np.uint32(1)
    h = x * np.uint32(0x9E3779B1)
    for n in range(2, GRAMS[-1] + 1):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] ^ (h[: len(x) - n + 1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + x[n - 1 :] * np.uint32(0xC2B2AE3D)
        if n in GRAMS:
            out.append((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS))
    return out


def feature_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted feature numbers of each text."""
    seen = np.zeros(1 << BITS, bool)
    for text in texts:
        text = (text or "").lower()
        for at in range(0, len(text), PART):
            cp = np.frombuffer(text[at : at + PART + GRAMS[-1] - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
            for h in hashed(cp):
                seen[h] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, features: np.ndarray) -> float:
        z = self.intercept + float(self.weights[features].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float, smooth: float = 1.0, l2: float = 1e-2, epochs: int = 12) -> Model:
    """NB-scaled logistic regression. ``share``: of label 1 among all labelled rows."""
    m = 1 << BITS
    ones = int(labels.sum())
    if ones in (0, len(labels)):
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(m, np.float32), float(np.log(p / (1 - p))))
    count = np.zeros((2, m))
    for f, y in zip(rows, labels, strict=True):
        count[y, f] += 1
    r = np.log((count[1] + smooth) / (ones + 2 * smooth)) - np.log((count[0] + smooth) / (len(labels) - ones + 2 * smooth))
    w, g2 = np.zeros(m), np.full(m, 1e-8)
    b, gb, prior = 0.0, 1e-8, float(np.log(ones / (len(labels) - ones)))
    order = np.random.default_rng(7)
    scale = [1 / np.sqrt(max(1.0, float((r[f] ** 2).sum()))) for f in rows]
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f = rows[i]
            x = r[f]
            z = b + prior + float(w[f] @ x)
            d = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[i]
            if abs(d) < 1e-4:
                continue
            g = d * x + l2 * w[f]
            g2[f] += g * g
            w[f] -= 0.5 * scale[i] * g / np.sqrt(g2[f]) * np.sqrt(np.minimum(g2[f], 1))
            gb += d * d
            b -= 0.1 * d / np.sqrt(gb)
    p = min(max(share, 1e-3), 1 - 1e-3)
    return Model((w * r).astype(np.float32), float(b + np.log(p / (1 - p))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of each label whose id is not held out."""
    small_batches(docs.sparkSession)
    lab = only(labels, id_col, label_col).toDF("id", "y").where("id is not null and y is not null")
    lab = lab.where(~held_out(F.col("id"))).groupBy("id").agg(F.max(F.col("y").cast("int")).alias("y"))
    rows, ones = lab.agg(F.count("*"), F.sum("y")).first()
    share = ((ones or 0) + 1) / (rows + 2)
    pick = [lab.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    some = F.broadcast(pick[0].union(pick[1]))  # at most 2 * sample rows
    text = only(docs, id_col, text_col).toDF("id", "text").join(some, "id").groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [x.astype("<u4").tobytes() for x in feature_sets(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sets, pa.binary())], ["id", "y", "f"])

    got = text.mapInArrow(lean(features), f"id {lab.schema['id'].dataType.simpleString()}, y int, f binary").toArrow().sort_by("id")
    model = fit([np.frombuffer(f.as_buffer(), "<u4") for f in got.column("f")], np.asarray(got.column("y"), int), share)
    del got
    trim()
    return model


def scorer(model: Model):
    """A column function from texts to scores, 0 to 1."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            yield pd.Series([model.score(f) for f in feature_sets(text.tolist())], dtype="float64")
        trim()

    return score


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    small_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), scorer(model)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""
    small_batches(docs.sparkSession)
    return docs.where(scorer(model)(F.col(text_col)) < threshold)
