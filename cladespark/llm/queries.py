"""One query for each corpus operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, line_dedup, minhash, packing, secrets, sharding, token_output, toxicity, vectors

#: Folder-independent names of vocabulary files; a parameter of the operators.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.findings(docs, secrets.scan(docs)).withColumnRenamed("__spans", "spans")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))
    return found.select("doc_id", *[count(r.kind) for r in secrets.BASE], F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(TOKENIZER), end=2, length=1024)


def op4_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_ids(table(spark, sf_dir, "documents"), vocabulary(TOKENIZER), end=50256, length=1024)


def op5_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary(RANKS))


def op8_locally_consistent_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.3)


def op9_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_template_dedup, op2_secret_scan, op3_best_fit_packing, op4_packed_token_ids, op5_virtual_slot_sharding, op6_byte_bpe, op7_embedding_near_duplicates, op8_locally_consistent_fingerprints, op9_minhash_near_duplicates, op10_toxicity)
}



def spans_sql(rule: secrets.Rule, rank: int) -> str:
    """(doc_id, rank, kind, start, end_) of a rule's matches: places are sums of the lengths of matches and of what lies between them."""
    pattern = rule.pattern.replace("'", "''")
    head = "(?i:password|passwd|secret|token|api_?key)"  # RE2 folds letters beyond ASCII too, so either case is written out
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head[4:-1])
    pattern = pattern.replace(head, f"(?:{either})")
    return f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) as start, list_sum(gaps[1:i]) + list_sum(sizes[1:i]) as end_
  from (select *, unnest(range(1, len(sizes) + 1)) as i from (select doc_id, [length(x) for x in regexp_extract_all(t, '{pattern}')] as sizes, [length(x) for x in regexp_extract_all(t, '{pattern}', {rule.group})] as own, [length(x) for x in string_split_regex(t, '{pattern}')] as gaps from texts))
  where own[i] >= {rule.least}"""


RULES = secrets.BASE + secrets.MORE
JOINED = "coalesce(string_agg(kind || ':' || cast(start as varchar) || ':' || cast(end_ as varchar), ',' order by start, rank){}, '')"
BASE_ONLY = f" filter (where rank < {len(secrets.BASE)})"

SECRETS_SQL = f"""with texts as (select doc_id, coalesce(text, '') as t from documents),
 found as ({" union all ".join(spans_sql(r, i) for i, r in enumerate(RULES))})
 select d.doc_id, {", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)},
  sha256({JOINED.format(BASE_ONLY)}) as base_sha256, {JOINED.format("")} as spans
 from texts d left join found f on f.doc_id = d.doc_id group by d.doc_id"""

#: Components as the closure of the links between classes: for the sizes at which SQL is a check.
CLOSURE = "reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)"

NEAR_SQL = rf"""with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 sets as (select doc_id, list_sort(list_distinct(case when len(w) >= 2 then [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] else w end)) as s from words),
 classes as (select s, len(s) as n, min(doc_id) as c from sets where len(s) > 0 group by s),
 items as (select c, n, unnest(s) as item from classes),
 common as (select x.c as a, y.c as b, x.n as an, y.n as bn, count(*) as k from items x join items y on x.item = y.item and x.c <> y.c and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by all),
 links as (select a, b from common where 100 * k >= 80 * (an + bn - k)),
 {CLOSURE},
 least_ as (select a, min(b) as m from reach group by a)
 select d.doc_id, cast(len(d.s) as bigint) as n_shingles, coalesce(least(m, c.c), d.doc_id) as component_id, d.doc_id = coalesce(least(m, c.c), d.doc_id) as kept
 from sets d left join classes c on c.s = d.s left join least_ on least_.a = c.c"""

VECTORS_SQL = f"""with recursive good as (select vec_id, label, [cast(x as double) for x in embedding] as v from embeddings
  where label is not null and len(embedding) > 0 and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding) and len([x for x in embedding if x <> 0]) > 0),
 links as (select x.vec_id as a, y.vec_id as b from good x join good y on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.93),
 {CLOSURE},
 least_ as (select a, min(b) as m from reach group by a), counts as (select a, count(*) as n from links group by a)
 select e.vec_id, coalesce(n, 0) as n_links, coalesce(least(m, e.vec_id), e.vec_id) as component_id, e.vec_id = coalesce(least(m, e.vec_id), e.vec_id) as kept
 from embeddings e left join least_ on least_.a = e.vec_id left join counts on counts.a = e.vec_id"""

#: The others rest on tokenizers, a template tree, hash functions or a trained classifier that SQL does not have.
ORACLES: dict[str, str] = {"op2_secret_scan": SECRETS_SQL, "op7_embedding_near_duplicates": VECTORS_SQL, "op9_minhash_near_duplicates": NEAR_SQL}
