import gzip
import math

import pytest
from pyspark.sql import functions as F

from cladespark.operators import annotate, association, calls, columns, resample, scoring, tree
from cladespark.sources import readers, sinks

CELLS = "sample_id string, variant_id string, value int"


@pytest.fixture
def xor(spark):
    rows, labels = [], []
    for i in range(20):
        a, b = i % 2, i // 2 % 2
        rows += [(f"s{i}", n, 1) for n, v in (("a", a), ("b", b)) if v]
        labels.append((f"s{i}", str(a ^ b)))
    return spark.createDataFrame(rows, CELLS), spark.createDataFrame(labels, "sample_id string, label string")


HEAD = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"


def record(pos, ref="A", alt="C", qual="50", info="DP=20;MQ=60;MQ0F=0", fmt="GT", smp="1/1"):
    return f"1\t{pos}\t.\t{ref}\t{alt}\t{qual}\t.\t{info}\t{fmt}\t{smp}\n"


def test_call_files(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(HEAD + record(5, alt="T") + record(5, alt="G") + record(6, ref="a") + record(7, alt=".") + record(8, qual=".") + record(9, info="MQ=60") + record("x") + "1\t2\n")
    with gzip.open(tmp_path / "b.vcf.gz", "wt") as f:
        f.write(HEAD + record(5, alt="G") + record(6, smp="0/0") + record(8, info="DP=12.0;MQ=60") + record(10, alt="C,G", smp="2") + record(11, ref="AT") + record(12, smp="./."))
    (tmp_path / "c.txt").write_text("not read")
    got = calls.calls(calls.parse_records(readers.call_lines(spark, str(tmp_path))))
    assert sorted(map(tuple, got.collect())) == [("a", "1", 5, "A", "G"), ("a", "1", 6, "A", "C"), ("b", "1", 5, "A", "G"), ("b", "1", 6, "A", "A"), ("b", "1", 8, "A", "C"), ("b", "1", 12, "A", "A")]
    s = calls.sites(got, 2)
    assert [tuple(r) for r in s.collect()] == [("1", 5, "A", "G", 2)]
    assert sorted(tuple(r) for r in calls.carriers(got, s).collect()) == [("a", "1:5:A:G", 1), ("b", "1:5:A:G", 1)]
    assert [tuple(r) for r in calls.baselines(got, s).collect()] == [("1:5:A:G", "G", 1)]
    with pytest.raises(ValueError):
        readers.load_genotypes(spark, str(tmp_path / "a.vcf"))


def test_cohort_file(spark, tmp_path):
    head = HEAD.replace("\tS\n", "\ts1\ts2\ts3\n")
    row = lambda pos, *smp, **k: record(pos, fmt="GT:GQ:DP", smp="\t".join(smp), **k)
    body = row(5, "0/1:50:9", "0/0:50:9", "1|1:3:9") + row(6, "./.:50:9", "1:50:2") + row(7, "0/1:50:9", "0/1", "0/0:x:9") + row(400, "0/1:9:9", "1/1:9:9", "1/1:9:9", ref="AT") + row(403, "1/1:9:9", "0/0:9:9", "0/0:9:9") + row(404, "1/1:9:9", "0/0:9:9", "0/0:9:9")
    (tmp_path / "all.vcf").write_text(head + body)
    r = calls.parse_records(readers.cohort_lines(spark, str(tmp_path / "all.vcf")))
    assert r.count() == 17
    got = calls.calls(calls.masked(r, least_quality=5, least_depth=3)).where("called <> ref")
    assert sorted((x.sample_id, x.pos) for x in got.collect()) == [("s1", 5), ("s1", 7), ("s1", 403), ("s1", 404), ("s2", 7)]
    values = calls.masked(r, 5, 3).where("pos < 8").select("sample_id", "pos", calls.genotype_value(r["fmt"], F.col("smp")).alias("v"))
    assert {(x.sample_id, x.pos): x.v for x in values.collect()} == {("s1", 5): 1, ("s2", 5): 0, ("s3", 5): None, ("s1", 6): None, ("s2", 6): None, ("s1", 7): 1, ("s2", 7): 1, ("s3", 7): 0}
    assert sorted({x.pos for x in calls.away_from_indels(r, 2).collect()}) == [5, 6, 7, 400, 404]


def test_matrix_file(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿Strain;Labels;1;2\r\ns1;R;1;0\r\ns2;S;0;\r\n".encode())
    cells, labels = readers.matrix(spark, str(tmp_path / "m.csv"), "Labels")
    assert sorted(map(tuple, labels.collect())) == [("s1", "R"), ("s2", "S")]
    assert sorted((r.sample_id, r.variant_id, r.value) for r in cells.collect() if r.value is not None) == [("s1", "1", 1.0), ("s1", "2", 0.0), ("s2", "1", 0.0)]


def test_references(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a x\nac\ngt\n>b\nGG\n")
    assert readers.reference(spark, str(tmp_path / "r.fa")) == "ACGTGG"
    (tmp_path / "r.gbk").write_text('FEATURES\n     gene            1..9\n     CDS             complement(2..7)\n                     /locus_tag="L1"\n                     /gene="g"\n                     /product="some\n                     thing"\nORIGIN\n        1 acgtacgtac\n//\n')
    assert readers.reference(spark, str(tmp_path / "r.gbk")) == "ACGTACGTAC"
    assert [tuple(r) for r in readers.coding_regions(spark, str(tmp_path / "r.gbk")).collect()] == [(0, 1, 7, -1, "L1", "g", "some thing")]
    (tmp_path / "k.txt").write_text("b\n# no\n\na\nb\n")
    assert [r.marker for r in readers.markers(spark, str(tmp_path / "k.txt")).orderBy("idx").collect()] == ["b", "a"]


def test_association(spark, xor):
    cells, labels = xor
    t = association.contingency(cells, labels)
    assert sum(r.o for r in t.where("variant_id = 'a'").collect()) == 20
    s = {r.variant_id: r for r in association.tests(t).collect()}
    assert s["a"].chi2 == pytest.approx(0) and s["a"].mi == pytest.approx(0, abs=1e-9) and s["a"].p == pytest.approx(1)
    pairs = spark.createDataFrame([("a", "b")], "f1 string, f2 string")
    assert association.synergy(cells, labels, pairs).first().strength == pytest.approx(math.log(2))
    dirty = spark.createDataFrame([("s1.vcf", "x"), ("s1", "x"), ("s2", "x"), ("s2", "y"), ("s3", None)], "sample_id string, label string")
    kept = association.align(spark.createDataFrame([(f"s{i}", "v", 1) for i in range(5)], CELLS), dirty)
    assert [r.sample_id for r in kept[1].collect()] == ["s1"]


@pytest.mark.parametrize("ps", [[0.01, 0.02, 0.03, 0.5], [0.0, 0.0, 1.0], [0.05] * 5, [0.9, 0.2]])
def test_benjamini_hochberg(spark, ps):
    df = spark.createDataFrame([(f"f{i}", p) for i, p in enumerate(ps)], "variant_id string, p double")
    got = {r.variant_id: r.q for r in association.benjamini_hochberg(df).collect()}
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    low, want = 1.0, {}
    for rank in range(len(ps), 0, -1):
        low = min(low, ps[order[rank - 1]] * len(ps) / rank)
        want[f"f{order[rank - 1]}"] = low
    assert got == pytest.approx(want)


def test_tree_takes_split_without_gain(spark, xor):
    cells, labels = xor
    t = tree.grow(cells, labels)
    assert t.nodes[1].feature == "a" and t.nodes[1].gain == pytest.approx(0) and {x.feature for x in t.nodes.values() if x.depth == 1} == {"b"}
    assert tree.accuracy(tree.predict(t, cells, labels), labels).first()[0] == 1.0
    assert t.roots_and_branches() == (["a", "b"], []) and t.pairs()[0][:2] == ("a", "b")
    assert t.rules().count("class:") == 4
    assert tree.interactions(t, cells, labels).first().strength == pytest.approx(math.log(2))


def test_columns(spark):
    cells = spark.createDataFrame([(f"s{i}", v, 1) for v, n in (("all", 4), ("one", 1), ("two", 2), ("two2", 2)) for i in range(n)], CELLS)
    kept = {r.variant_id for r in columns.varying(columns.sparse_counts(cells), 4, 2).collect()}
    assert kept == {"two", "two2"}
    p = {r.variant_id: r.pattern for r in columns.patterns(cells).collect()}
    assert p["two"] == p["two2"] and len(set(p.values())) == 3
    rows = spark.createDataFrame([("g", i) for i in range(7)], "g string, i int")
    assert sorted(r.i for r in columns.even_pick(rows, "g", ["i"], 3).collect()) == [0, 3, 6]
    assert [r.i for r in columns.even_pick(rows, "g", ["i"], 1).collect()] == [3]
    assert columns.even_pick(rows, "g", ["i"], 0).count() == 7
    mask = spark.createDataFrame([(1, False), (2, False), (3, True)], "idx int, keep boolean")
    assert [r.keep for r in columns.forced(mask, "2, x 9").orderBy("idx").collect()] == [False, True, True]
    ann = spark.createDataFrame([("Coding", "A|B"), ("coding", "A|A"), ("coding", "A|-"), ("x", "A|B")], "region_type string, amino_change string")
    assert [columns.type_filter(ann, k).count() for k in ("all", "coding", "sense-mutations")] == [4, 3, 1]


def test_annotation(spark):
    cds = spark.createDataFrame([(0, 0, 9, 1, "L0", "g0", "p"), (1, 3, 12, -1, "L1", "g1", "p")], "idx int, start int, end int, strand int, locus_tag string, gene string, product string")
    v = spark.createDataFrame([("v1", 2, "T", "C"), ("v2", 11, "C", "A"), ("v3", 16, "A", "G")], "variant_id string, pos int, ref string, alt string")
    got = {r.variant_id: r for r in annotate.annotate(v, cds, "ATGAAACCCGGGTTTAAA").collect()}
    assert got["v1"].nucleotide_change == "ATG|ACG" and got["v1"].amino_change == "M|T" and got["v1"].codon_number == 1
    assert got["v2"].region_type == "coding" and got["v2"].gene.startswith("-L1") and got["v2"].nucleotide_change == "CCC|CTC"
    assert got["v3"].region_type == "non-coding" and got["v3"].gene == "-L1 | g1 | p | [4..4]"
    assert {r.variant_id: r.distance for r in annotate.nearest(v, cds).collect()}["v3"] == 3


def test_resampling(spark, xor):
    cells, labels = xor
    draws = resample.bootstrap(labels, 3, 7)
    assert [r[1] for r in draws.groupBy("rep").sum("w").orderBy("rep").collect()] == [20.0] * 3
    perm = resample.permuted(labels, 2, 7)
    assert perm.where("perm = 1 and label = '1'").count() == labels.where("label = '1'").count()
    p = resample.permutation_test(cells, labels, spark.createDataFrame([("a", "b")], "f1 string, f2 string"), 10, 7).first()
    assert p.observed == pytest.approx(math.log(2)) and p.p == 0 and p.significant
    imp = spark.createDataFrame([(i, f, v) for i in range(4) for f, v in (("a", 0.5 + i / 10), ("b", 0.0))], "rep int, variant_id string, importance double")
    s = {r.variant_id: r for r in resample.bootstrap_summary(imp, 2).collect()}
    assert s["a"].stability == 1 and s["b"].stability == 0 and s["a"].p < 0.01 and s["b"].p is None


def test_scoring(spark):
    p = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.5), ("t", "a", 1.0)], "sample_id string, label string, prob double")
    truth = spark.createDataFrame([("s", "a"), ("t", "b")], "sample_id string, label string")
    f = {(r.sample_id, r.label): r for r in scoring.formatted(p).collect()}
    assert f["s", "a"].place == 1 and f["s", "b"].odd == 0 and f["t", "a"].odd == 1
    assert {r.sample_id: r.entropy for r in scoring.entropy(p).collect()} == {"s": 1.0, "t": 0.0}
    t = {r.threshold: r for r in scoring.threshold_table(scoring.identified(p, truth, scoring.thresholds(0.5, 1, 0.25))).collect()}
    assert (t[0.5].tp, t[0.5].fp, t[0.5].fn) == (1, 1, 0) and (t[1.0].tp, t[1.0].fp, t[1.0].fn) == (0, 1, 1) and t[0.5].is_best
    assert scoring.thresholds(0.1, 0.3, 0.1) == [0.1, 0.2, 0.3]


@pytest.mark.parametrize(
    ("scores", "n", "p", "want"),
    [({"LR": 0.9, "SVC_RBF": 0.91, "RF": 0.9, "MLP_small": 0.9}, 100, 10, "LR"), ({"LR": 0.6, "SVC_RBF": 0.8, "RF": 0.7}, 100, 10, "SVC"), ({"LR": 0.6, "MLP_small": 0.8, "RF": 0.7}, 3000, 10, "MLP"), ({"LR": 0.7, "RF": 0.72, "DT": 0.6}, 100, 10, "RF")],
)
def test_recommendation(scores, n, p, want):
    assert scoring.recommend(scores, n, p) == want
    assert scoring.resolve_algorithm("KNN") == "RF" and scoring.resolve_algorithm("?") == "RF" and scoring.resolve_algorithm("RF", "SCV") == "SVC"
    with pytest.raises(ValueError):
        scoring.resolve_algorithm("RF", "nothing")


def test_exports(spark, tmp_path):
    seqs = spark.createDataFrame([("b", "ACGTA"), ("REF", "AAAAA"), ("a", "CCCCC")], "sample_id string, seq string")
    sinks.write_fasta(seqs, str(tmp_path / "f"), wrap=2)
    text = "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*")))
    assert text.startswith(">REF\nAA\nAA\nA\n>a\nCC")
    back = readers.fasta(spark, str(tmp_path / "f"))
    assert {r.name: r.seq for r in back.collect()} == {"REF": "AAAAA", "a": "CCCCC", "b": "ACGTA"}
