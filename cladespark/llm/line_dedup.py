"""Line dedup by a fixed-depth tree of log templates.

A line is a sequence of tokens (runs without ASCII white space); tokens with a digit are variable fields from the start. The tree's
leaf is the token count and the ``LEADING`` first tokens. In a leaf, distinct lines join the template of whose fixed places they
agree with most, at least a share ``SIMILAR`` and half of all places, and places that differ become variable. A template recurs if it stands in
``min_docs`` unrelated documents, or in two if it has ``LONG`` tokens or more; every line of it but the first (by id) is dropped.

Copies and near copies of one text, whose lines all recur together, are one family and no evidence for a template: families are
the components of documents whose minhash signatures of ``WORDS``-word shingles (digits kept, so logs that differ in their numbers are unrelated)
agree in ``RELATED`` of ``HASHES`` places. Documents are unrelated if their families differ; how many copies a family
has does not matter. Whole copies are for document dedup to find.

A leaf with more than ``LEAF`` distinct lines is dealt by salt to parts of about that size. The parts' templates are then lines
themselves, dealt anew until the leaf fits one task; where dealing stops merging them, every two parts meet, until no two
templates merge. So no task holds an unbounded leaf, and lines generalise the same way at every size. Blank lines and null or empty texts are left alone; a null text
stays null. Rows with equal id and text are one document. An empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import components, cut, forget, lean, small_batches
from .fingerprints import mixed
from .minhash import BLANK, BLOCK
from .pieces import powers

LEADING, SIMILAR, LEAF, MIN_DOCS = 2, 0.7, 2000, 4
WORDS, HASHES, RELATED = 3, 16, 10
#: Signature values held by more documents are matched by a broadcast of their leaders, the others by a shuffle.
HOT = 1000
#: A line of so many tokens hardly repeats by chance, so fewer documents are enough.
LONG, LONG_DOCS = 50, 2
#: Leaves or templates that may be broadcast: 16 MB at most.
BROADCAST_ROWS = 500_000
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def parsed(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every line with tokens: text number, line number, first token, end token; and of the tokens: their hashes, 0 if variable, and their hashes with digits."""
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = BLANK[data]
    word = ~gap
    start = np.flatnonzero(word & np.append(True, gap[:-1]))
    end = np.flatnonzero(gap & np.append(False, word[:-1]))
    up, down = powers(1 << int(len(data)).bit_length())
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)) | np.uint64(1)
    digits = np.append(0, np.cumsum(DIGIT[data], dtype=np.int64))
    exact = h.copy()
    h[digits[end] > digits[start]] = 0
    breaks = np.flatnonzero(data == 10)  # each ends a line
    text_end = np.cumsum([len(r) + 1 for r in raw]) - 1
    text_of = np.searchsorted(text_end, breaks)
    first_line = np.searchsorted(breaks, np.append(0, text_end[:-1] + 1))
    line_no = np.arange(len(breaks)) - first_line[text_of]
    upto = np.searchsorted(start, breaks)
    a, b = np.append(0, upto[:-1]), upto
    some = b > a
    return text_of[some], line_no[some], a[some], b[some], h, exact


def minima(exact: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``HASHES`` minhashes, 32 bits each, of the shingles of every text; texts are adjoining runs of tokens."""
    stop = np.repeat(end, end - start)
    at = np.arange(start[0], end[-1])
    s = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        inside = at + k < stop
        s[inside] += exact[at[inside] + k] * np.uint64(2 * k + 0x9E3779B97F4A7C15)
    s = mixed(s)
    odd = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
    return np.stack([np.minimum.reduceat((s * k) ^ (s >> np.uint64(29)), start - start[0]) >> np.uint64(32) for k in odd], axis=1).astype("<u4")


def line_rows(docs: DataFrame) -> DataFrame:
    """(id, th, line, leaf, key, family, toks, sig) of every line with tokens; toks: 16 bits a token; sig: on a text's first line only."""
    small_batches(docs.sparkSession)
    names = ["id", "th", "line", "leaf", "key", "family", "toks", "sig"]

    def block(ids: pa.Array, th: pa.Array, raw: list[bytes]) -> pa.RecordBatch:
        text, line, a, b, h, exact = parsed(raw)
        n = b - a
        place = np.arange(len(h)) - np.repeat(a, n)
        salted = mixed(h + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        sums = np.append(np.uint64(0), np.cumsum(salted, dtype=np.uint64))
        key = mixed(sums[b] - sums[a] + n.astype(np.uint64))
        leaf = mixed(sums[np.minimum(a + LEADING, b)] - sums[a] + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        family = np.zeros(len(text), np.uint64)
        sig: list[bytes | None] = [None] * len(text)
        if len(text):
            at = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            low = minima(exact, a[at], np.append(a[at[1:]], b[-1]))
            whole = np.zeros(len(at), np.uint64)
            for v in low.T:
                whole = mixed(whole * np.uint64(3) + v)
            family = np.repeat(whole, np.diff(np.append(at, len(text))))
            for i, v in zip(at.tolist(), low, strict=True):
                sig[i] = v.tobytes()
        short = (h & np.uint64(0xFFFF)).astype("<u2").tobytes()
        toks = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer(np.append(2 * a, 2 * len(h)).astype(np.int32)), pa.py_buffer(short)])
        pick = pa.array(text)
        return pa.RecordBatch.from_arrays([ids.take(pick), th.take(pick), pa.array(line.astype(np.int32)), *[pa.array(v.view(np.int64)) for v in (leaf, key, family)], toks, pa.array(sig, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in t.column(2).to_pylist()]
            at = 0
            while at < len(raw):
                n, size = at, 0
                while n < len(raw) and (size == 0 or size + len(raw[n]) < BLOCK):
                    size += len(raw[n]) + 1
                    n += 1
                yield block(t.column(0).slice(at, n - at), t.column(1).slice(at, n - at), raw[at:n])
                at = n

    src = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")
    return src.mapInArrow(lean(run), f"id {src.schema['id'].dataType.simpleString()}, th bigint, line int, leaf bigint, key bigint, family bigint, toks binary, sig binary")


def generalised(toks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The template number of each line of one leaf, and the templates; lines in the order given join the most similar template."""
    out = np.empty(len(toks), np.int64)
    heads = np.empty_like(toks)
    count = 0
    for i in range(len(toks)):
        if count:
            fixed = heads[:count] != 0
            same = ((heads[:count] == toks[i]) & fixed).sum(axis=1)
            share = np.where(2 * same >= toks.shape[1], same / np.maximum(1, fixed.sum(axis=1)), 0)
            best = int(share.argmax())
            if share[best] >= SIMILAR:
                heads[best][heads[best] != toks[i]] = 0
                out[i] = best
                continue
        heads[count] = toks[i]
        out[i] = count
        count += 1
    return out, heads[:count]


def templates(toks: np.ndarray) -> np.ndarray:
    """The template number of each line of one leaf."""
    return generalised(toks)[0]


def joined(lines: DataFrame, *by: str) -> DataFrame:
    """(leaf, key, toks, w, template) of lines (leaf, key, toks, w), each group of ``by`` in one task. A template has the key of its first line,
    which alone has the template's places and the weight of all its lines."""

    def run(t: pa.Table) -> pa.Table:
        t = t.select(["leaf", "key", "toks", "w"]).sort_by([("w", "descending"), ("key", "ascending")])
        raw = t.column("toks").to_pylist()
        key, w = np.asarray(t.column("key")), np.asarray(t.column("w")).copy()
        out = key.copy()
        for size in {len(r) for r in raw}:  # one size, but for a collision of leaf hashes
            at = np.array([i for i, r in enumerate(raw) if len(r) == size])
            which, heads = generalised(np.frombuffer(b"".join(raw[i] for i in at), "<u2").reshape(len(at), -1))
            first = np.full(which.max() + 1, -1)
            first[which[::-1]] = at[::-1]
            out[at] = key[first[which]]
            w[first] = np.bincount(which, w[at]).astype(np.int64)
            for i, head in zip(first.tolist(), heads, strict=True):
                raw[i] = head.tobytes()
        return pa.table([t.column("leaf"), t.column("key"), pa.array(raw, pa.binary()), pa.array(w), pa.array(out)], ["leaf", "key", "toks", "w", "template"])

    return lines.groupBy(*by).applyInArrow(run, "leaf bigint, key bigint, toks binary, w bigint, template bigint")


def sized(lines: DataFrame) -> DataFrame:
    """``lines`` and m, the number of lines of their leaf."""
    return lines.join(lines.groupBy("leaf").agg(F.count("*").alias("m")), "leaf")


def met(lines: DataFrame) -> DataFrame:
    """As ``joined``, of leaves of any size: every two parts of a leaf meet in a task; lines that some task joins to a line
    which itself stays are then joined with all of that line's others."""
    parts = F.expr(f"cast(2 * m div {LEAF} + 1 as int)")
    dealt = lines.withColumns({"parts": parts, "p": F.pmod(F.xxhash64("key"), parts).cast("int")}).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"x": F.least("p", "q"), "y": F.greatest("p", "q")}).where("x < y")
    links = cut(joined(dealt, "leaf", "x", "y").where("key <> template").groupBy("key").agg(F.min("template").alias("home")))
    stay = links.join(links.select(F.col("key").alias("home")), "home", "left_anti")
    homes = stay.select("key", "home").union(stay.select(F.col("home").alias("key"), "home")).distinct()
    with_home = lines.join(homes, "key", "left").withColumn("home", F.coalesce("home", "key"))
    return joined(with_home, "leaf", "home")


def clustered(keys: DataFrame) -> DataFrame:
    """(key, template) of the distinct lines (leaf, key, toks, w) that share a leaf with others."""
    one = sized(keys).where("m > 1")
    done = joined(one.where(F.col("m") <= LEAF), "leaf").select("key", "template")
    now = cut(one.where(F.col("m") > LEAF))
    total, before, maps = now.count(), None, []
    while total:
        salt = F.pmod(F.xxhash64("key", F.lit(len(maps))), F.expr(f"cast((m - 1) div {LEAF} + 1 as int)"))
        dealing = before is None or 8 * total <= 7 * before
        small = joined(now.where(F.col("m") <= LEAF), "leaf")
        large = now.where(F.col("m") > LEAF)
        out = cut(small.union(joined(large.withColumn("salt", salt), "leaf", "salt") if dealing else met(large)))
        maps.append(out.where("key <> template").select("key", "template"))
        heads = out.where("key = template").drop("template")
        left = cut(sized(heads.join(large.select("leaf").distinct(), "leaf", "left_semi")))
        stayed = left.count()
        was = large.count()
        if not dealing and stayed == was:  # every two parts have met and nothing merged
            break
        now, total, before = left, stayed, was
    named = None
    for links in reversed(maps):  # a line's template, that one's template, and so on
        named = links if named is None else cut(links.join(named.toDF("template", "last"), "template", "left").select("key", F.coalesce("last", "template").alias("template")).union(named))
    return done if named is None else done.union(named)


def bounded(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast only if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def agreeing(a: str, b: str):
    """The number of places in which two signatures, hexadecimal, agree."""
    return F.expr(f"aggregate(sequence(0, {HASHES - 1}), 0, (t, i) -> t + if(substring({a}, 8 * i + 1, 8) = substring({b}, 8 * i + 1, 8), 1, 0))")


def related(rows: DataFrame) -> DataFrame:
    """(family, kin): the least family of each component of related ones; families without relations are left out.

    Every family meets the least one of each value of its signature, so links grow with documents, never with pairs of them.
    """
    nodes = cut(rows.where("sig is not null").groupBy("family").agg(F.hex(F.min("sig")).alias("sig")))
    value = F.explode(F.expr(f"transform(sequence(0, {HASHES - 1}), i -> xxhash64(i, substring(sig, 8 * i + 1, 8)))"))
    posts = nodes.select("family", "sig", value.alias("value"))
    lead = posts.groupBy("value").agg(F.min(F.struct("family", "sig")).alias("l"), F.count("*").alias("n")).where("n > 1")
    lead = cut(lead.select("value", F.col("l.family").alias("kin"), F.col("l.sig").alias("other"), "n"))
    hot = bounded(lead.where(F.col("n") > HOT))
    cold = posts.join(hot.select("value"), "value", "left_anti").join(lead.where(F.col("n") <= HOT), "value")
    met = cold.union(posts.join(hot, "value").select(*cold.columns)).where("family <> kin")
    out = cut(components(met.where(agreeing("sig", "other") >= RELATED).selectExpr("family a", "kin b").distinct()).toDF("family", "kin"))
    forget(nodes)
    forget(lead)
    return out


def enough(min_docs: int):
    """Whether ``f`` documents are enough for a line of ``n`` tokens."""
    return F.col("f") >= F.when(F.col("n") >= LONG, F.lit(min(LONG_DOCS, min_docs))).otherwise(F.lit(min_docs))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = True) -> DataFrame:
    """(id, th, lines array<int>): numbers of the lines to drop, of documents that lose any."""
    rows = cut(line_rows(docs))
    kin = bounded(related(rows))
    rows = rows.drop("sig").join(kin, "family", "left").withColumn("family", F.coalesce("kin", "family")).drop("kin")
    rows = rows.withColumn("n", (F.octet_length("toks") / 2).cast("int"))
    leaves = rows.select("leaf", "n", "family").distinct().groupBy("leaf").agg(F.count("*").alias("f"), F.max("n").alias("n")).where(enough(min_docs)).select("leaf")
    leaves = cut(leaves)
    held = cut(rows.join(bounded(leaves), "leaf"))
    keys = held.groupBy("leaf", "key").agg(F.count("*").alias("w"), F.min("toks").alias("toks"))
    named = cut(clustered(keys).where("key <> template"))
    lines = held.select("id", "th", "line", "key", "family", "n").join(bounded(named), "key", "left").withColumn("template", F.coalesce("template", "key"))
    families = lines.select("template", "n", "family").distinct().groupBy("template").agg(F.count("*").alias("f"), F.max("n").alias("n"))
    first = lines.groupBy("template").agg(F.min(F.struct("id", "th", "line")).alias("first"))
    marked = families.where(enough(min_docs)).join(first, "template").select("template", "first")
    gone = lines.join(bounded(cut(marked)), "template")
    if keep_first:
        gone = gone.where(~F.struct("id", "th", "line").eqNullSafe(F.col("first")))
    return gone.groupBy("id", "th").agg(F.array_distinct(F.collect_list("line")).alias("lines"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = True, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All columns of ``docs``, ``text`` without its dropped lines, and two ``counts``, of lines and of dropped ones; columns of these names
    are replaced."""
    gone = dropped_lines(docs, min_docs, keep_first).toDF("__id", "__th", "__gone")
    cols = [c for c in docs.columns if c not in counts]
    src = docs.select(*[F.col(f"`{c}`") for c in cols]).withColumn("__h", F.xxhash64("text"))
    both = src.join(gone, src["doc_id"].eqNullSafe(gone["__id"]) & (src["__h"] == gone["__th"]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines))
    n_dropped = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone"))
    return both.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in cols], n_lines.alias(counts[0]), n_dropped.alias(counts[1]))
