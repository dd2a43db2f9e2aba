"""Cleaning and sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that mean none, and the standard genetic code by first, second and third base in the order TCAG.
MISSING_LABELS = ["", "-", "NA", "N/A", "None", "nan", "NaN"]
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def normal_label(x: Column, lower: bool = False) -> Column:
    """Trimmed, null if it means none, dashes as underscores."""
    t = F.trim(x)
    t = F.when(~t.isin(MISSING_LABELS), F.translate(t, "-", "_"))
    return F.lower(t) if lower else t


def normal_sample(x: Column) -> Column:
    """Sample id without VCF suffixes and a trailing library number."""
    return F.regexp_replace(F.replace(F.replace(F.trim(x), F.lit(".vcf.gz"), F.lit("")), F.lit(".vcf"), F.lit("")), "_library[0-9]+$", "")


def file_sample(name: Column) -> Column:
    return F.regexp_replace(name, r"\.vcf(\.gz)?$", "")


def normal_symbol(x: Column) -> Column:
    """Empty for null, blank, nd and nan."""
    t = F.trim(x)
    return F.when(x.isNull() | F.lower(t).isin("", "nd", "nan"), F.lit("")).otherwise(t)


def name_key(x: Column) -> Column:
    """Lower-case letters and digits only, for fuzzy feature names."""
    return F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}]", "")


def reverse_complement(x: Column) -> Column:
    return F.translate(F.reverse(x), "ACGT", "TGCA")


def amino(codon: Column) -> Column:
    """One-letter amino acid of a codon; X if it is not one."""
    place = [F.instr(F.lit("TCAG"), F.substring(codon, i, 1)) - 1 for i in (1, 2, 3)]
    good = (F.length(codon) == 3) & (F.least(*place) >= 0)
    return F.when(good, F.substring(F.lit(AMINO), (place[0] * 16 + place[1] * 4 + place[2] + 1).cast("int"), F.lit(1))).otherwise("X")


def context(genome: Column, pos: Column, flank: int = 40) -> Column:
    """The ``2 * flank + 1`` bases around a 1-based place of a circular genome."""
    n = F.length(genome)
    times = (F.ceil(F.lit(2 * flank + 1) / n) + 2).cast("int")
    start = F.pmod(pos - 1 - flank, n)
    return F.substring(F.repeat(genome, times), (start + 1).cast("int"), F.lit(2 * flank + 1))


def elided(x: Column, most: int = 60) -> Column:
    left = (most - 3) // 2
    right = most - 3 - left
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, left), F.lit("..."), F.substring(x, -right, right)))


def clipped(x: Column, most: float = 2.0) -> Column:
    """A number between ``-most`` and ``most``; 0 for null, NaN and infinities."""
    n = x.cast("double")
    odd = n.isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), n)))


def effect_class(v: Column) -> Column:
    return F.when(v < 0.1, "negligible").when(v < 0.3, "small").when(v < 0.5, "medium").otherwise("large")


def info_map(info: Column) -> Column:
    """``key=value`` fields of ``;``-separated text; flags are dropped and the last of equal keys wins."""
    fields = F.filter(F.split(info, ";"), lambda x: F.instr(x, "=") > 0)
    pairs = F.transform(fields, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substring(x, F.instr(x, "=") + 1, F.length(x)).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, last)


def number(x: Column) -> Column:
    """A number, 0 if it is none."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def info_value(info: Column, key: str) -> Column:
    """The last value of a key in ``;``-separated text, null if there is none; cheaper than a map where few keys are needed."""
    after = F.substring_index(F.concat(F.lit(";"), info), f";{key}=", -1)  # the whole text, from its semicolon, without the key
    return F.nullif(F.substring_index(after, ";", 1), F.lit(""))
