"""Gates and reductions over the columns of a sample-by-variant relation, one grouped pass for all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normal_symbol


def numbered(rows: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """``rows`` with their place, from 0, in the order of some columns. Ranges of rows are sorted apart and numbered from their counts,
    so no task holds them all."""
    ranges = rows.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()).persist()  # read twice, in one order
    part = F.shiftright("__m", 33)
    counts = ranges.groupBy(part.alias("__p")).agg(F.count("*").alias("c"))
    starts = counts.select("__p", (F.sum("c").over(W.orderBy("__p")) - F.col("c")).alias("__s"))  # one row a partition
    out = ranges.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return out.withColumn(name, F.col("__s") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__s")


def sparse_counts(cells: DataFrame) -> DataFrame:
    """(variant_id, ones) of cells that hold ones."""
    return cells.where("value = 1").groupBy("variant_id").agg(F.count("*").alias("ones"))


def varying(counts: DataFrame, n: int, least_minor: int = 0) -> DataFrame:
    """Columns with both values, and at least ``least_minor`` of the rarer one."""
    return counts.where((F.col("ones") > 0) & (F.col("ones") < n) & (F.least(F.col("ones"), F.lit(n) - F.col("ones")) >= least_minor))


def numeric_gates(cells: DataFrame, n: int) -> DataFrame:
    """(variant_id, filled, mean, maf, variance) of a dense or sparse relation that may hold nulls; ``n``: samples."""
    return cells.groupBy("variant_id").agg((F.count("value") / F.lit(n)).alias("filled"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance")).withColumn("maf", F.least(F.col("mean"), 1 - F.col("mean")))


def passing(gates: DataFrame, filled: float = 0.2, maf: float = 0.0) -> DataFrame:
    return gates.where((F.col("filled") >= filled) & (F.col("maf") >= maf))


def near_constant(gates: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Columns to keep once nulls were filled with 0: not nearly constant. Applies only if there was a null."""
    mean = F.col("mean") * F.col("filled")
    return gates.where((F.col("filled") == 1) | mean.between(low, high))


def minor_counts(counts: DataFrame, n: int) -> DataFrame:
    return counts.select("variant_id", F.least(F.col("ones"), F.lit(n) - F.col("ones")).alias("minor"))


def empty_share(cells: DataFrame, empty: str = "") -> DataFrame:
    """(marker, empty_share) of symbol cells: null, blank or the empty symbol."""
    t = F.trim("symbol")
    return cells.groupBy("marker").agg(F.avg((F.col("symbol").isNull() | (t == "") | (t == empty)).cast("int")).alias("empty_share"))


def drop_empty(cells: DataFrame, most: float, empty: str = "") -> DataFrame:
    """Symbol cells of markers whose empty share is at most ``most``; all of them if that is 1 or more."""
    return cells if most >= 1 else cells.join(empty_share(cells, empty).where(F.col("empty_share") <= most), "marker", "left_semi")


def drop_singletons(labels: DataFrame, least: int = 2) -> DataFrame:
    """Samples of labels that at least ``least`` samples have."""
    return labels.join(labels.groupBy("label").agg(F.count("*").alias("c")).where(F.col("c") >= least), "label", "left_semi")


def codes(cells: DataFrame, missing: str | None = "__MISSING__", first: int = 0) -> DataFrame:
    """Symbols as numbers by order within their marker."""
    s = normal_symbol(F.col("symbol"))
    s = F.when(s == "", F.lit(missing)).otherwise(s) if missing is not None else F.when(s != "", s)
    cells = cells.withColumn("s", s)
    order = cells.where("s is not null").select("marker", "s").distinct()
    order = order.withColumn("code", F.row_number().over(W.partitionBy("marker").orderBy("s")) - 1 + first)
    return cells.join(order, ["marker", "s"], "left").select("sample_id", "marker", F.coalesce("code", F.lit(first - 1)).alias("code"))


def symbols_of(cells: DataFrame) -> DataFrame:
    """(marker, symbols): the distinct symbols of each marker in order."""
    return cells.select("marker", normal_symbol(F.col("symbol")).alias("symbol")).where("symbol <> ''").groupBy("marker").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def integers_of(cells: DataFrame) -> DataFrame:
    """(marker, numbers): the distinct whole numbers among each marker's symbols in order; markers without any have an empty list."""
    return cells.select("marker", F.trim("symbol").try_cast("int").alias("n")).groupBy("marker").agg(F.sort_array(F.collect_set("n")).alias("numbers"))


def used_titles(hot: DataFrame) -> DataFrame:
    """(marker, symbols) of one-hot cells (sample_id, title ``marker=symbol``, value): the symbols whose column holds anything but zero."""
    some = hot.where("value <> 0").select(F.substring_index("title", "=", 1).alias("marker"), F.expr("substring(title, instr(title, '=') + 1)").alias("symbol"))
    return some.groupBy("marker").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def first_seen(rows: DataFrame, value: str, order: str, name: str = "code") -> DataFrame:
    """(value, code): distinct values numbered from 0 by where they first stand."""
    return numbered(rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("__first")), "__first", value, name=name).drop("__first")


def patterns(cells: DataFrame) -> DataFrame:
    """(variant_id, pattern): columns with equal values have equal patterns, a 128-bit sum over the samples that hold a one.

    The sums combine before the shuffle, so no column is gathered anywhere."""
    part = lambda seed: F.sum((F.xxhash64(F.lit(seed), "sample_id") % (1 << 40)).cast("decimal(38,0)"))
    return cells.where("value = 1").groupBy("variant_id").agg(F.concat_ws(":", part(1), part(2), F.count("*")).alias("pattern"))


def even_pick(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """At most ``k`` rows of each group, evenly spaced in order: places round(i (n - 1) / (k - 1)), half to even."""
    if k <= 0:
        return rows
    place = F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1
    rows = rows.withColumn("place", place).withColumn("n", F.count("*").over(W.partitionBy(group)))
    if k == 1:
        wanted: Column = F.col("place") == F.floor(F.col("n") / 2)
    else:
        spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(k - 1), 0).cast("int"))
        wanted = F.array_contains(spots, F.col("place"))
    return rows.where((F.col("n") <= k) | wanted).drop("place", "n")


def reduce_redundant(cells: DataFrame, positions: DataFrame, k: int) -> DataFrame:
    """At most ``k`` variants of each group with equal columns, evenly by position."""
    return even_pick(patterns(cells).join(positions, "variant_id"), "pattern", ["pos", "variant_id"], k)


def forced(mask: DataFrame, fixed: str) -> DataFrame:
    """``mask(idx, keep)`` with the 1-based columns of a list of numbers kept in any case; other tokens are ignored."""
    wanted = F.transform(F.split(F.regexp_replace(F.lit(fixed), ",", " "), " +"), lambda x: x.try_cast("int"))
    return mask.withColumn("keep", F.col("keep") | F.coalesce(F.array_contains(wanted, F.col("idx")), F.lit(False)))


def type_filter(rows: DataFrame, kind: str) -> DataFrame:
    """Annotation rows of a type: all, coding, or sense-mutations (the amino acid changes)."""
    coding = F.lower(F.trim("region_type")) == "coding"
    left, right = (F.trim(F.split_part("amino_change", F.lit("|"), F.lit(i))) for i in (1, 2))
    changed = (left != right) & ~left.isin("", "-") & ~right.isin("", "-")
    return rows if kind == "all" else rows.where(coding & changed if kind == "sense-mutations" else coding)
