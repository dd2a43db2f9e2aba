"""Readers of call files, matrices, metadata, markers and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_sample

#: Accepted names of a label column.
LABEL_NAMES = ("label", "class", "group", "y")


def call_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, line_no, value) of every line of ``*.vcf`` and ``*.vcf.gz`` files. ``line_no`` orders the lines of a file, by the
    start of their block and their place in it, so the last of equal records can win and large files are still split."""
    raw = spark.read.option("pathGlobFilter", "*.{vcf,vcf.gz}").text(folder)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return raw.select(file_sample(F.col("_metadata.file_name")).alias("sample_id"), place.alias("line_no"), "value").where("value <> ''")


def cohort_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, line_no, value) as ``call_lines`` has them, of files with a column for each of several samples, named by the ``#CHROM`` line.

    A record becomes one line a sample; samples beyond a record's fields have none. Headers are joined by file: they are few, and AQE
    broadcasts them or splits a large file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    heads = raw.where(F.col("value").startswith("#CHROM\t")).groupBy("file").agg(F.min(F.split("value", "\t")).alias("names"))
    heads = heads.where("size(names) > 9").select("file", F.expr("slice(names, 10, size(names) - 9)").alias("names"))
    rows = raw.where(~F.col("value").startswith("#")).select("file", F.struct("block", "line").alias("line_no"), F.split("value", "\t").alias("f")).where("size(f) > 9")
    one = rows.join(heads, "file").select("line_no", F.expr("array_join(slice(f, 1, 9), '\t')").alias("shared"), F.explode(F.arrays_zip("names", F.expr("slice(f, 10, size(f) - 9)").alias("own"))).alias("x"))
    return one.where("x.names is not null and x.own is not null").select(F.trim("x.names").alias("sample_id"), "line_no", F.concat_ws("\t", "shared", "x.own").alias("value"))


def call_files(spark: SparkSession, folder: str, delimiter: str = "_") -> DataFrame:
    """(sample_id, path) of the call files of a folder: the name up to the delimiter; of several files of a sample the first by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{vcf,vcf.gz}").load(folder).select("path")
    name = file_sample(F.element_at(F.split("path", "/"), -1))
    return files.groupBy(F.substring_index(name, delimiter, 1).alias("sample_id")).agg(F.min("path").alias("path"))


def call_samples(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id) of every call file, also of those without any call."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{vcf,vcf.gz}").load(folder).select("path")
    return files.select(file_sample(F.element_at(F.split("path", "/"), -1)).alias("sample_id")).distinct()


def require_call_files(spark: SparkSession, folder: str) -> None:
    if call_samples(spark, folder).isEmpty():
        raise ValueError(f"no call files in {folder}")


def separator(name: str) -> str:
    return "\t" if name.lower().endswith((".tsv", ".tab", ".txt")) else ","


def table(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A headed text table, all strings; byte order mark and carriage returns are removed, and ``;`` is recognised."""
    first = spark.read.text(path).first()
    head = first[0] if first else ""
    sep = sep or (";" if head.count(";") > head.count(separator(path)) else separator(path))
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def matrix(spark: SparkSession, path: str, label: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(cells, labels) of a prebuilt matrix: the first column holds samples; a label column is kept out of the cells."""
    df = table(spark, path)
    key = df.columns[0]
    label = label or next((c for c in df.columns[1:] if c.lower() in LABEL_NAMES), None)
    df = df.withColumnRenamed(key, "sample_id")
    labels = df.select("sample_id", F.col(f"`{label}`").alias("label")) if label in df.columns else None
    values = [c for c in df.columns if c not in ("sample_id", label)]
    cells = df.unpivot("sample_id", [F.col(f"`{c}`") for c in values], "variant_id", "value").withColumn("value", F.col("value").try_cast("double"))
    return cells, labels


def symbols(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells of (sample_id, marker, symbol), labels) of a labelled matrix of strings; fails without a label column or markers."""
    df = table(spark, path)
    label = next((c for c in df.columns[1:] if c.lower() in LABEL_NAMES), None)
    markers = [c for c in df.columns[1:] if c != label]
    if label is None or not markers:
        raise ValueError("a label column and a marker column are needed")
    df = df.withColumnRenamed(df.columns[0], "sample_id")
    return df.unpivot("sample_id", [F.col(f"`{c}`") for c in markers], "marker", "symbol"), df.select("sample_id", F.col(f"`{label}`").alias("label"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    df = table(spark, path)
    if len(df.columns) < 2:
        raise ValueError("metadata needs an id and another column")
    key = "Sample" if "Sample" in df.columns else df.columns[0]
    return df.withColumnRenamed(key, "sample_id").withColumn("sample_id", F.col("sample_id").cast("string"))


def markers(spark: SparkSession, path: str) -> DataFrame:
    """(idx, marker): distinct markers in order of first appearance."""
    if path.endswith(".txt"):
        raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("idx", "marker"))
        raw = raw.where("trim(marker) <> '' and not trim(marker) like '#%'")
    else:
        df = table(spark, path)
        col = "marker" if "marker" in df.columns else df.columns[0]
        raw = df.select(F.monotonically_increasing_id().alias("idx"), F.col(f"`{col}`").alias("marker")).where("marker is not null")
    return raw.select("idx", F.trim("marker").alias("marker")).groupBy("marker").agg(F.min("idx").alias("idx")).select("idx", "marker")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, seq) of a FASTA file."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "(?m)^>")).alias("idx", "r")).where("trim(r) <> ''")
    name = F.trim(F.substring_index(F.regexp_replace("r", "\r", ""), "\n", 1))
    body = F.regexp_replace(F.regexp_replace("r", r"^[^\n]*(\n|$)", ""), r"\s", "")
    return raw.select("idx", name.alias("name"), body.alias("seq"))


def fasta_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(name, place, symbol); fails unless all sequences are equally long."""
    df = fasta(spark, path)
    if df.select(F.length("seq")).distinct().count() > 1:
        raise ValueError("sequences differ in length")
    return df.select("name", F.posexplode(F.split("seq", "")).alias("place", "symbol")).where("symbol <> ''")


def reference(spark: SparkSession, path: str) -> str:
    """One upper-case sequence of a FASTA or GenBank file; it is broadcast with the plans that use it."""
    whole = spark.read.text(path, wholetext=True).first()[0]
    if path.lower().endswith((".gb", ".gbk", ".gbff")) or not whole.lstrip().startswith(">"):
        parts = [x.split("//")[0] for x in whole.split("ORIGIN")[1:]]
        return "".join(c for p in parts for c in p if c.isalpha()).upper()
    return "".join(r.seq for r in fasta(spark, path).orderBy("idx").collect()).upper()


def coding_regions(spark: SparkSession, path: str) -> DataFrame:
    """(idx, start, end, strand, locus_tag, gene, product) of a GenBank file, start from 0, end exclusive."""
    import re

    text = spark.read.text(path, wholetext=True).first()[0].split("\nORIGIN")[0]
    rows = []
    for block in re.split(r"\n {5}(?=\S)", text):
        m = re.match(r"CDS\s+(complement\()?(?:join\()?<?(\d+)", block)
        if m:
            get = lambda k, b=block: next(iter(re.findall(rf'/{k}="([^"]*)"', b)), "")
            last = max(int(x) for x in re.findall(r"\d+", block.split("\n")[0].split("CDS", 1)[1]))
            rows.append((len(rows), int(m[2]) - 1, last, -1 if m[1] else 1, get("locus_tag"), get("gene"), re.sub(r"\s+", " ", get("product"))))
    return spark.createDataFrame(rows, "idx int, start int, end int, strand int, locus_tag string, gene string, product string")


#: Tried in order for annotation tables.
ENCODINGS = ("UTF-8", "UTF-16", "windows-1252", "ISO-8859-1")


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated annotation table in the first encoding whose header has a Position column."""
    for e in ENCODINGS:
        df = spark.read.csv(path, header=True, sep="\t", encoding=e)
        if any(c.lstrip("﻿").strip() == "Position" for c in df.columns):
            return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    raise ValueError(f"no Position column in {path}")


def load_genotypes(spark: SparkSession, path: str, presence: int = 3, biallelic: bool = True) -> DataFrame:
    """Sparse cells of a folder of call files, or of a matrix file; a single call file is not accepted."""
    from ..operators import calls as c

    if path.lower().endswith((".csv", ".tsv", ".tab")):
        return matrix(spark, path)[0]
    if path.lower().endswith((".vcf", ".vcf.gz")):
        raise ValueError("give the folder that holds the call files")
    found = c.calls(c.parse_records(call_lines(spark, path)), biallelic)
    return c.carriers(found, c.sites(found, presence))
