"""From raw documents to packed sequences: toxicity, line dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.llm import line_dedup, minhash, packing, secrets, toxicity
from cladespark.llm._util import cut
from cladespark.llm.queries import TOKENIZER, table, vocabulary


def recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, ``n_chars`` set to the text's code points."""
    return docs.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; those that lose all their lines go."""
    out = line_dedup.dedup_lines(docs, counts=("__lines", "__dropped"))
    return recounted(out.where((F.col("__dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id; blank texts stay."""
    return minhash.keep_one(docs, words=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind."""
    return recounted(secrets.redact(secrets.findings(docs, secrets.scan(docs))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    return packing.pack_documents(docs, vocabulary(TOKENIZER), end=2, length=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_template_lines),
    ("minhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: SQL cannot express a trained classifier, a template tree or a tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
