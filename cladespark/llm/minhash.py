"""MinHash near-duplicates by an inverted join of signature coordinates.

Each text becomes its set of distinct word shingles; texts with equal sets form a class, and one member stands for it. A class has
``K`` minimum hashes. It is posted under (coordinate, value) pairs; two classes whose signatures agree in ``MATCHES`` places
must share one of the ``K - MATCHES + 1`` rarest pairs of each, so only these are posted, and pairs that no other class has
need no posting at all (the prefix). Longer postings are skipped: agreement there is counted on the signatures of pairs
that met in a prefix. Pairs above the threshold of matches are confirmed on full shingle sets.

A posting never yields all its pairs. First each member meets one leader of its posting, drawn by a hash for each posting, which
links large groups through many leaders in linear work. Components of the confirmed links are then found, and in postings
that still hold several components only members outside the largest one meet the members of other components, in blocks and
on full sets: pairs within a component cannot change the result. Every pair of texts in different components that share
a prefix posting is checked, so components are those of all confirmed links.

Words are maximal runs of characters other than ASCII white space, A-Z in lower case. A text with fewer words than a shingle
has one shingle, its word sequence. Null, empty and blank texts have no set, are linked with nothing and stand for
themselves. A row is judged by its own text: rows of one id with different texts are not linked by the id. Rows without an id take part;
they get the smallest id of their component, null if none has one, and are not kept. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import components, cut, forget, lean, only, shuffled, small_batches
from .fingerprints import mixed
from .pieces import gather, powers

#: Coordinates of a signature, and how many must agree: at a Jaccard index of 0.8, fewer agree in 1 of 8000 pairs.
K, MATCHES = 48, 28
#: Members of a posting that one salt of a join takes.
SALT_ROWS = 50_000
#: Members of a posting in a block, when components that share it are compared.
GROUP = 4000
#: Shingles of either side of a block of full sets: 16 MB; a longer text is alone on its side.
ITEMS = 2_000_000
#: Ids to look up again that may be broadcast; the driver holds some 100 bytes of each. No other table is broadcast here.
BROADCAST_IDS = 500_000
#: Bytes of text that are split into words at a time.
BLOCK = 1 << 18

_rng = np.random.default_rng(20_260_101)
A = (_rng.integers(1, 2**63, K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
B = _rng.integers(0, 2**63, K, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        n, size = at, 0
        while n < len(raw) and (size == 0 or size + len(raw[n]) < BLOCK):
            size += len(raw[n]) + 1
            n += 1
        yield from _sets(raw[at:n], words)
        at = n


def _sets(raw: list[bytes], words: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = BLANK[data]
    word = ~gap
    start = np.flatnonzero(word & np.append(True, gap[:-1]))
    end = np.flatnonzero(gap & np.append(False, word[:-1]))
    up, down = powers(1 << int(len(data)).bit_length())
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    s = h
    for k in range(1, words):
        s = mixed(s[: max(0, len(h) - k)] + np.uint64(k)) + h[k:]
    ends = np.cumsum([len(r) + 1 for r in raw])
    upto = [0, *np.searchsorted(start, ends).tolist()]
    for a, b in zip(upto, upto[1:], strict=False):
        if b - a >= words:
            x = np.sort(s[a : b - words + 1])
            yield x[np.append(True, x[1:] != x[:-1])]
        elif b > a:  # fewer words than a shingle
            x = h[a : a + 1]
            for k in range(1, b - a):
                x = mixed(x + np.uint64(k)) + h[a + k]
            yield mixed(x ^ np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signature(x: np.ndarray) -> np.ndarray:
    """K minimum hashes, 32 bits each."""
    out = np.full(K, 2**64 - 1, np.uint64)
    for at in range(0, len(x), 4096):
        h = x[at : at + 4096, None] * A[None, :]
        h += B
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(out, h.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n_shingles, key binary, sig array<int>) of every whole text; th: its hash, key: a 128-bit digest of its set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, sig = [], [], []
            for x in shingle_sets(b.column(2).to_pylist(), words):
                n.append(len(x))
                key.append(digest(x))
                sig.append(signature(x))
            flat = pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, K * len(sig) + 1, K, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), lists], ["id", "th", "n_shingles", "key", "sig"])

    src = hashed(docs, id_col, text_col)
    return src.mapInArrow(lean(run), f"id {src.schema[0].dataType.simpleString()}, th bigint, n_shingles bigint, key binary, sig array<int>")


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text); th: a hash of the text."""
    return only(docs, id_col, text_col).toDF("id", "text").select("id", F.xxhash64("text").alias("th"), "text")


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def looked_up(ids: DataFrame) -> DataFrame:
    """A written table of ids as a side of a join, broadcast only if its rows are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else shuffled(ids)


def full_sets(docs: DataFrame, classes: DataFrame, reps: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, items array<bigint>) of the classes ``reps(rep)``, from the texts of their first rows again."""
    wanted = cut(classes.select("rep", "key", F.col("at.id").alias("id"), F.col("at.th").alias("th")).join(shuffled(reps), "rep", "left_semi"))
    where = wanted.select("id", "th")
    where = looked_up(where)
    src = hashed(docs, id_col, text_col).alias("d").join(where.alias("w"), F.col("d.th").eqNullSafe(F.col("w.th")) & F.col("d.id").eqNullSafe(F.col("w.id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(0).to_pylist(), words))
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["key", "items"])

    found = src.mapInArrow(lean(run), "key binary, items array<bigint>").join(shuffled(wanted.select("key", "rep")), "key")
    return found.select("rep", "items").dropDuplicates(["rep"])


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough and whose full sets reach the similarity."""
    sig = classes.select("rep", "sig")
    same = F.expr("aggregate(zip_with(sa, sb, (x, y) -> if(x = y, 1, 0)), 0, (t, x) -> t + x)")
    near = pairs.join(shuffled(sig.toDF("a", "sa")), "a").join(shuffled(sig.toDF("b", "sb")), "b").where(same >= MATCHES).select("a", "b")
    near = cut(near)
    sets = cut(full_sets(docs, classes, near.select(F.col("a").alias("rep")).union(near.select("b")).distinct(), words, id_col, text_col))
    both = near.join(shuffled(sets.toDF("a", "ia")), "a").join(shuffled(sets.toDF("b", "ib")), "b")
    common = F.size(F.array_intersect("ia", "ib"))
    out = cut(both.where(100 * common >= percent * (F.size("ia") + F.size("ib") - common)).select("a", "b"))
    forget(near)
    forget(sets)
    return out


def postings(classes: DataFrame) -> DataFrame:
    """(token, freq, rep): each class under the rarest of its tokens that other classes have too."""
    prefix = K - MATCHES + 1
    tokens = classes.select("rep", F.posexplode("sig").alias("at", "value"))
    tokens = tokens.select("rep", (F.shiftleft(F.col("at").cast("bigint"), 32) + F.col("value").cast("bigint") + F.lit(2**31)).alias("token"))
    freq = tokens.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1")
    shared = tokens.join(shuffled(freq), "token")
    ranked = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("t"))
    kept = F.slice("t", F.lit(1), F.greatest(F.lit(0), F.lit(prefix - K) + F.size("t")))
    return ranked.select("rep", F.explode(kept).alias("t")).select("t.token", "t.freq", "rep")


def completed(held: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): confirmed links between components that share a posting of ``held(token, rep, component)``.

    Members outside a posting's largest component meet all its members, in blocks of both. Blocks of signatures come first; they
    return the rows that any promising pair needs, and only these rows meet again with their full sets, in blocks of bounded size. A task returns one link
    for a member and a component, never the pairs it tried.
    """
    sizes = held.groupBy("token", "component").agg(F.count("*").alias("m"))
    top = sizes.groupBy("token").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("g"), F.count("*").alias("c")).where("c > 1")
    top = top.select("token", F.col("top.component").alias("top"), F.expr(f"cast(g div {GROUP} + 1 as int)").alias("gb"), F.expr(f"cast((g - top.m) div {GROUP} + 1 as int)").alias("mb"))
    rows = cut(held.join(shuffled(top), "token"))
    own = rows.select("token", "rep", "component", F.pmod(F.xxhash64("rep"), "gb").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("y"), F.lit(False).alias("asks"))
    out = rows.where("component <> top").select("token", "rep", "component", F.explode(F.sequence(F.lit(0), F.col("gb") - 1)).alias("x"), F.pmod(F.xxhash64("rep"), "mb").cast("int").alias("y"), F.lit(True).alias("asks"))
    both = own.union(out).join(shuffled(classes.select("rep", "n", "sig")), "rep")
    kind = held.schema["rep"].dataType.simpleString()

    def promising(t: pa.Table) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray]]]:
        """The members, and for each that asks those (by their place) whose size and signature allow a link."""
        asks, n, comp = np.asarray(t.column("asks")), np.asarray(t.column("n")), np.asarray(t.column("component"))
        members = np.flatnonzero(~asks)
        sig = np.asarray(t.column("sig").combine_chunks().flatten()).reshape(len(t), K)
        theirs, sizes, homes = sig[members], n[members], comp[members]

        def pairs() -> Iterator[tuple[int, np.ndarray]]:
            for i in np.flatnonzero(asks).tolist():
                near = np.flatnonzero((homes != comp[i]) & (100 * np.minimum(sizes, n[i]) >= percent * np.maximum(sizes, n[i])))
                near = near[(theirs[near] == sig[i]).sum(axis=1) >= MATCHES]
                if len(near):
                    yield i, near

        return members, pairs()

    def hopeful(t: pa.Table) -> pa.Table:
        """The rows of a block that any promising pair needs, in smaller blocks of at most ``ITEMS`` shingles a side."""
        members, pairs = promising(t)
        n = np.asarray(t.column("n"))
        part = np.zeros(len(t), np.int64)  # askers and members are cut apart in turn, by their running size
        for side in (members, np.flatnonzero(np.asarray(t.column("asks")))):
            part[side] = np.cumsum(n[side]) // ITEMS
        used: dict[tuple[int, int], np.ndarray] = {}
        for i, near in pairs:
            their = members[near]
            for q in np.unique(part[their]).tolist():
                rows = used.setdefault((int(part[i]), q), np.zeros(len(t), bool))
                rows[i] = True
                rows[their[part[their] == q]] = True
        slim = t.select(["token", "x", "y", "rep", "component", "asks", "n", "sig"])
        out = [slim.filter(pa.array(rows)) for rows in used.values()]
        z = [np.full(len(o), k, np.int32) for k, o in enumerate(out)]
        return pa.concat_tables(out or [slim.slice(0, 0)]).append_column("z", pa.array(np.concatenate(z) if z else np.zeros(0, np.int32)))

    left = cut(both.groupBy("token", "x", "y").applyInArrow(hopeful, f"token bigint, x int, y int, rep {kind}, component {kind}, asks boolean, n bigint, sig array<int>, z int"))
    forget(rows)
    sets = full_sets(docs, classes, left.select("rep").distinct(), words, id_col, text_col)

    def run(t: pa.Table) -> pa.Table:
        rep, comp = np.asarray(t.column("rep")), np.asarray(t.column("component"))
        items = t.column("items").combine_chunks()
        off = np.asarray(items.offsets).astype(np.int64)
        code, vocabulary = pd.factorize(np.asarray(items.flatten()))
        off -= off[0]
        n = np.diff(off)
        members, pairs = promising(t)
        flat = gather(code, off[members], n[members])
        begin = np.cumsum(n[members]) - n[members]
        mark = np.zeros(len(vocabulary), np.int32)
        a, b = [], []
        for i, near in pairs:
            mine = code[off[i] : off[i + 1]]
            mark[mine] = 1
            size = n[members[near]]
            common = np.add.reduceat(mark[gather(flat, begin[near], size)], np.cumsum(size) - size)
            mark[mine] = 0
            hit = members[near[100 * common >= percent * (n[i] + size - common)]]
            if len(hit):
                hit = hit[np.unique(comp[hit], return_index=True)[1]]
                a.append(np.full(len(hit), rep[i]))
                b.append(rep[hit])
        none = np.zeros(0, rep.dtype)
        return pa.table([pa.array(np.concatenate(a) if a else none), pa.array(np.concatenate(b) if b else none)], ["a", "b"])

    links = left.join(shuffled(sets), "rep").groupBy("token", "x", "y", "z").applyInArrow(run, f"a {kind}, b {kind}")
    found = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    forget(left)
    return found


def grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n_shingles, component, least) of every row; component: a number, null for texts without a set; least: its smallest id."""
    sigs = cut(signatures(docs, words, id_col, text_col))
    sets = sigs.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct("id", "th")).alias("at"), F.min("id").alias("id"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = cut(sets.withColumn("rep", F.monotonically_increasing_id()))  # numbers are fixed once written
    posts = cut(postings(classes))
    salts = F.expr(f"cast(freq div {SALT_ROWS} + 1 as int)")
    lead = posts.groupBy("token", "freq").agg(F.min(F.struct(F.xxhash64("rep", "token"), F.col("rep"))).alias("l")).select("token", F.col("l.rep").alias("leader"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    met = posts.withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int")).join(shuffled(lead), ["token", "salt"]).where("rep <> leader")
    first = confirmed(met.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct(), classes, docs, words, percent, id_col, text_col)
    comp = cut(components(first))
    # what is left: members of a posting in different components
    held = posts.join(shuffled(comp.withColumnRenamed("node", "rep")), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    held = cut(held.select("token", "rep", "component"))
    forget(posts)
    second = completed(held, classes, docs, words, percent, id_col, text_col)
    if not second.isEmpty():
        old = comp
        comp = cut(components(first.union(second)))
        forget(old)
    of = comp.withColumnRenamed("node", "rep")
    least = of.join(shuffled(classes.select("rep", "id")), "rep").groupBy("component").agg(F.min("id").alias("least"))
    home = classes.select("key", "rep", "id").join(shuffled(of.join(shuffled(least), "component")), "rep", "left")
    home = home.select("key", F.coalesce("component", "rep").alias("component"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("least"))
    return sigs.join(shuffled(home), "key", "left").select("id", "th", "n_shingles", "component", "least")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row. Links: percent of shared shingles of at least ``percent``."""
    rows = grouped(docs, words, percent, id_col, text_col)
    component = F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, of each group of near-duplicates: that of the smallest id, or one without an id if none has one.
    Of repeated rows, equal in id and text, one stays. Texts without a set all stay."""
    rows = cut(grouped(docs, words, percent, id_col, text_col).where("component is not null"))
    per = rows.groupBy("component", "id", "th").agg(F.count("*").alias("rows"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"))
    per = cut(per.join(shuffled(first), "component").select("id", "th", "rows", (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))).alias("stays")))
    gone = per.where("not stays or rows > 1").select("id", "th")
    gone = looked_up(gone)
    src = docs.withColumn("__th", F.xxhash64(F.col(f"`{text_col}`")))

    def picked(some: DataFrame, how: str) -> DataFrame:
        w = some.toDF("__i", "__t")
        return src.join(w, (src["__th"] == w["__t"]) & src[id_col].eqNullSafe(w["__i"]), how)

    out = picked(gone, "left_anti").select(*docs.columns)
    again = per.where("stays and rows > 1").select("id", "th")
    if again.isEmpty():
        return out
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    one = picked(looked_up(again), "left_semi").groupBy(F.col(f"`{id_col}`").alias("__i"), "__th").agg(F.min_by(columns, order).alias("__row"))
    return out.union(one.select("__row.*"))
