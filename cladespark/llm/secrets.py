"""Secret scans over an incremental ledger of content-addressed texts.

Every version of a text has an address, the SHA-256 of its bytes. The ledger holds one row for an address and the rules, each with
its version, that have scanned it. A scan takes each address once, however many paths hold it, runs on it only the rules
that the ledger does not have yet, and findings go back to every path by a join on the address. All of it is DataFrame
algebra: matches come from ``regexp_extract_all``, their places from the lengths of what ``split`` leaves between them.

A null text counts as empty and has no findings; so has an empty one. Places are code points, ends exclusive. Repeated rows
get the same findings; an empty table gives an empty result; other columns of the versions are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import cut

#: Addresses with findings that may be broadcast: some 100 bytes each.
BROADCAST_BLOBS = 100_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches of ``pattern`` that do not overlap, kept if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules. A run of allowed characters is matched whole, so a lower bound in the pattern finds the
#: same access keys and hex strings as a bound on the match.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds that this scanner adds.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]{2,20} )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start,rank,end,kind>> of a rule's matches in ``text``."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(whole, lambda m: F.length(m))
    kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m) >= rule.least)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), kept.alias("kept"))
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(x["kept"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(zipped, none, add, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text") -> DataFrame:
    """New ledger rows (blob binary, rules array<string>, spans), written to the shared folder, to be appended to ``ledger``.

    They are small beside the texts, so they are gathered into few files; a file for each part of the texts costs every executor
    a process for each file on a local file system (Hadoop sets its permissions by ``chmod``).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(address(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        blobs = blobs.where(F.size(F.array_except(keys, F.col("seen"))) > 0)
    per_rule = [F.when(F.array_contains("seen", r.key), F.array().cast(SPANS)).otherwise(spans(F.col("text"), r, i)) for i, r in enumerate(rules)]
    rows = blobs.select("blob", F.array_except(keys, F.col("seen")).alias("rules"), F.array_sort(F.concat(*per_rule)).alias("spans"))
    return cut(rows.hint("rebalance", "blob"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text") -> DataFrame:
    """``versions`` with a column ``__spans`` of what ``rules``, in their present versions, found in each text.

    Only addresses with findings are joined; they are broadcast if they are few, else joined by shuffle.
    """
    kinds = [r.kind for r in rules]
    found = ledger.where(F.arrays_overlap("rules", F.array(*[F.lit(r.key) for r in rules])))
    found = found.select(F.col("blob").alias("__blob"), F.filter("spans", lambda s: s["kind"].isin(kinds)).alias("s")).where(F.size("s") > 0)
    found = cut(found.groupBy("__blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("__spans")))
    if found.count() <= BROADCAST_BLOBS:
        found = F.broadcast(found)
    out = versions.withColumn("__blob", address(F.col(text_col))).join(found, "__blob", "left").drop("__blob")
    return out.withColumn("__spans", F.coalesce("__spans", F.array().cast(SPANS)))


def redact(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``versions``, each found secret in the text replaced by its kind in brackets; needs ``__spans``."""
    text = F.col(text_col)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    return versions.withColumn(text_col, F.when(F.size("__spans") > 0, clean).otherwise(text)).drop("__spans")


def written(spans_: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
