"""Writers: FASTA and table exports, JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sequence(symbol: str = "base", order: str = "idx") -> Column:
    """The symbols of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, symbol))), lambda x: x[symbol].cast("string")), "")


def sequences(cells: DataFrame, variants: DataFrame, symbol: str = "base") -> DataFrame:
    """(sample_id, seq): dense cells as one string a sample, variants in order of ``idx``."""
    return cells.join(variants.select("variant_id", "idx"), "variant_id").groupBy("sample_id").agg(sequence(symbol).alias("seq"))


def lines(hits: DataFrame, samples: DataFrame, fill: str) -> DataFrame:
    """(sample_id, seq) of sparse ``hits(sample_id, idx, symbol)``: ``fill`` with the symbols of a sample at their places, from 0.

    A row is made from the sample's own hits, so absent cells are never rows."""
    text = F.lit(fill)
    own = hits.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("idx", "symbol"))).alias("h"))
    before = lambda i: F.when(i == 0, F.lit(-1).cast("bigint")).otherwise(F.get("h", i - 1)["idx"])
    part = lambda x, i: F.concat(F.substring(text, (before(i) + 2).cast("int"), (x["idx"] - before(i) - 1).cast("int")), x["symbol"])
    tail = F.substring(text, (F.element_at("h", -1)["idx"] + 2).cast("int"), F.lit(len(fill)))
    seq = F.when(F.col("h").isNull(), text).otherwise(F.concat(F.array_join(F.transform("h", part), ""), tail))
    return samples.select("sample_id").distinct().join(own, "sample_id", "left").select("sample_id", seq.alias("seq"))


def write_matrix(seqs: DataFrame, titles: list[str], path: str, first: str = "Genome") -> None:
    """One-symbol cells as a tab-separated table, a column for each symbol of ``seqs(sample_id, seq)``; any number of columns, as no pivot is made."""
    spark = seqs.sparkSession
    head = spark.createDataFrame([(0, "", "\t".join([first, *titles]))], "kind int, sample_id string, value string")
    body = seqs.select((F.when(F.col("sample_id") == "REF", 1).otherwise(2)).alias("kind"), "sample_id", F.concat_ws("\t", "sample_id", F.array_join(F.split("seq", ""), "\t")).alias("value"))
    head.union(body).orderBy("kind", "sample_id").select("value").write.mode("overwrite").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small report as one text file of a folder, wherever Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def copy_files(manifest: DataFrame, folder: str) -> int:
    """Copy the files of ``manifest(path, target)`` to a folder, byte by byte; the number of files. A cohort's files, listed one by one."""
    spark = manifest.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    for r in manifest.select("path", "target").toLocalIterator():
        a, b = jvm.org.apache.hadoop.fs.Path(r.path), jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{r.target}")
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
        n += 1
    return n


def wrapped(seq: Column, width: int = 80) -> Column:
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"))


def write_fasta(seqs: DataFrame, path: str, wrap: int | None = None) -> None:
    """``seqs(sample_id, seq)``, the reference first, then samples in order, one text file a partition range."""
    body = wrapped(F.col("seq"), wrap) if wrap else F.col("seq")
    out = seqs.withColumn("first", F.col("sample_id") != "REF").orderBy("first", "sample_id")
    out.select(F.concat(F.lit(">"), "sample_id", F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, order: list[str] | None = None, sep: str = "\t") -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, sep=sep)


def wide(cells: DataFrame, variants: list[str], symbol: str = "value") -> DataFrame:
    """One column a variant, for exports of a chosen list; absent cells are 0."""
    return cells.groupBy("sample_id").pivot("variant_id", variants).agg(F.first(symbol)).fillna(0)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
