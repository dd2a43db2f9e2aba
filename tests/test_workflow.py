"""The whole run and the command line on a small cohort."""

import gzip
import random

import pytest

from cladespark import __main__ as cli
from cladespark import workflow
from cladespark.operators import columns, models
from cladespark.settings import Settings
from cladespark.sources import readers, sinks

HEAD = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"


def record(pos, alt):
    return f"1\t{pos}\t.\tA\t{alt}\t50\t.\tDP=20;MQ=60;MQ0F=0\tGT\t1/1\n"


@pytest.fixture(scope="module")
def cohort(tmp_path_factory):
    """24 samples; 5:A:C tells the label, 8 and 9 are equal columns, the rest is noise."""
    at, rng = tmp_path_factory.mktemp("cohort"), random.Random(4)
    (at / "vcf").mkdir()
    rows = []
    for i in range(24):
        text = HEAD + (record(5, "C") if i % 2 else "") + (record(8, "G") + record(9, "T") if i % 3 == 0 else "") + "".join(record(p, "C") for p in (11, 14, 17) if rng.random() < 0.5)
        if i % 4 == 0:
            with gzip.open(at / "vcf" / f"s{i}.vcf.gz", "wt") as f:
                f.write(text)
        else:
            (at / "vcf" / f"s{i}.vcf").write_text(text)
        rows.append(f"s{i},{'R-x' if i % 2 else 'S'},{'ab'[i % 3 == 0]}\n")
    (at / "meta.csv").write_text("Sample,Class,Site\n" + "".join(rows) + "absent,S,a\n")
    (at / "ref.fasta").write_text(">r\n" + "A" * 20 + "\n")
    (at / "known.txt").write_text("1:5:A:C\n# no\n1:99:A:C\n")
    return at


def content(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_run(spark, cohort, tmp_path):
    s = Settings(n_bootstrap_samples=3, bootstrap_outer_iters=2, n_permutation_tests=3, max_depth=3, matrices_repeat_number=1, epistasis_strength_threshold=-1.0, ml_algorithm="LR", pipeline_mode="both")
    got = workflow.run(spark, str(cohort / "vcf"), str(cohort / "meta.csv"), "Class", str(tmp_path), s, str(cohort / "known.txt"), str(cohort / "ref.fasta"), True, True)
    assert got["samples"] == got["labelled_samples"] == 24 and got["features"] == 6 and (got["known_markers"], got["known_markers_found"]) == (2, 1)
    assert got["discovery"]["root_features"] == ["1:5:A:C"] and got["discovery"]["tree_accuracy"] == 1.0
    assert got["ml"]["selected_algorithm"] == "LR" and got["ml"]["evaluation"]["best_threshold"]["f1"] == 1.0
    g = tmp_path / "genomic"
    lines = content(g / "vcf_counts" / "all_snp.txt").splitlines()
    assert lines[:3] == ["Position\tCount", "5\t12", "8\t8"]
    assert "Context_±40" in content(g / "fasta" / "matrix_filtered.tsv").splitlines()[0]
    fasta = content(g / "fasta" / "matrix_alleles.fasta").split()
    assert fasta[:2] == [">REF", "AAAAAA"] and fasta[fasta.index(">s3") + 1][:3] == "CGT" and fasta[fasta.index(">s2") + 1][:3] == "AAA"
    table = content(g / "matrices" / "matrix_binary.tsv").splitlines()
    assert len(table[0].split("\t")) == 6 and table[1] == "REF\t0\t0\t0\t0\t0" and len(table) == 26  # one of the equal columns is gone
    tests = spark.read.json(str(tmp_path / "statistical_validation" / "chi_squared_results.json")).collect()
    assert min(tests, key=lambda r: r.p).variant_id == "1:5:A:C"
    for name in ("statistical_validation/multiple_testing_results.json", "statistical_validation/bootstrap_results.json", "decision_tree/decision_tree_rules.txt", "decision_tree/feature_confidence.json", "ml_protocol/ml_protocol_thresholds.tsv", "ml_protocol/ml_protocol_sample_predictions.tsv", "ml_protocol/ml_protocol_evaluation.json", "ml_protocol/ml_protocol_results.json", "metadata.normalized.csv"):
        assert (tmp_path / name).is_dir(), name
    model = models.Trained.load(spark, str(tmp_path / "ml_protocol" / "LR_ml_protocol_model"))
    new = spark.createDataFrame([("x", "1-5-a-c", "1"), ("y", "1:8:A:G", "1")], "sample_id string, marker string, symbol string")
    best = {r.sample_id: r.label for r in model.identify(new).where("place = 1").collect()}
    assert best == {"x": "R_x", "y": "S"}


def test_majority_baseline_and_short_names(spark, cohort, tmp_path):
    s = Settings(ancestral_allele="N", use_integer_variant_ids=True, pipeline_mode="matrix_only", min_sample_presence=12)
    got = workflow.load(spark, str(cohort / "vcf"), str(tmp_path), s)
    names = {r.short: r.variant_id for r in spark.read.json(str(tmp_path / "genomic" / "variant_id_lookup.json")).collect()}
    assert names["v0"] >= "1:11:A:C" and {r.variant_id for r in got.cells.select("variant_id").distinct().collect()} == set(names)
    bits = content(tmp_path / "genomic" / "fasta" / "matrix_binary.fasta").split()
    rows = dict(zip(bits[::2], bits[1::2], strict=True))
    assert all(2 * sum(rows[f">s{i}"][k] == "1" for i in range(24)) <= 24 for k in range(len(rows[">REF"])))


def test_matrix_run(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,a,b,c,label\n" + "".join(f"s{i},{i % 2},{i // 2 % 2},,{'RS'[i % 2]}\n" for i in range(12)))
    (tmp_path / "meta.csv").write_text("Sample,label\n" + "".join(f"s{i},{'RS'[i % 2]}\n" for i in range(12)))
    got = workflow.run(spark, str(tmp_path / "m.csv"), str(tmp_path / "meta.csv"), "label", str(tmp_path / "out"), Settings(bootstrap_outer_iters=1))
    assert got["discovery"]["root_features"] == ["a"] and got["discovery"]["tree_depth"] == 1
    with pytest.raises(ValueError, match="no column"):
        workflow.run(spark, str(tmp_path / "m.csv"), str(tmp_path / "meta.csv"), "nothing", str(tmp_path / "out"))
    with pytest.raises(ValueError, match="no call files"):
        workflow.run(spark, str(tmp_path), None, "label", str(tmp_path / "out"))


def test_subset(spark, cohort, tmp_path):
    got = workflow.subset(spark, str(cohort / "vcf"), str(cohort / "meta.csv"), 8, str(tmp_path), "Class", copy=True).collect()
    assert len(got) == 8 and len({r.sample_id for r in got}) == 8 and sum(int(r.sample_id[1:]) % 2 for r in got) == 4
    assert {p.name for p in (tmp_path / "files").glob("s*.vcf*")} == {r.target for r in got}
    assert workflow.subset(spark, str(cohort / "vcf"), str(cohort / "meta.csv"), 5, str(tmp_path), "none").count() == 5


def test_settings_and_flags(tmp_path):
    (tmp_path / "c.json").write_text('{"max_depth": null, "min_sample_presence": 2, "unknown": 1}')
    a = cli.parser().parse_args(["run", "--genomic", "g", "--label", "l", "--output_dir", "o", "--config", str(tmp_path / "c.json"), "--run_ml_protocol", "--ml_algorithm", "DT"])
    s = cli.settings(a)
    assert (s.min_sample_presence, s.max_depth, s.ml_algorithm, s.pipeline_mode) == (2, None, "DT", "both")
    for bad in ({"mq0f_threshold": 2}, {"pipeline_mode": "x"}, {"min_samples_split": 1}, {"ml_step_sensitivity": 0}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_command_line(spark, cohort, tmp_path, monkeypatch):
    probe = models.probe
    monkeypatch.setattr(models, "probe", lambda cells, labels: probe(cells, labels, ("LR", "SVC_RBF", "DT"), 2))
    rows = "".join(f"s{i},{'xy'[i % 2]},{'pq'[i % 3 == 0]},{'RS'[i % 2]}\n" for i in range(24))
    (tmp_path / "m.csv").write_text("id,a,b,class\n" + rows)
    assert cli.main(["quality", "--vcf_dir", str(cohort / "vcf"), "--out", str(tmp_path / "q")]) == 0
    assert content(tmp_path / "q").count("\n") >= 25
    assert cli.main(["recommend", "--in_file", str(tmp_path / "m.csv"), "--out", str(tmp_path / "r")]) == 0
    assert "RECOMMENDATION: LR" in content(tmp_path / "r")


def test_lines_and_numbers(spark):
    hits = spark.createDataFrame([("a", 0, "C"), ("a", 4, "G"), ("b", 2, "T")], "sample_id string, idx long, symbol string")
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    assert dict(map(tuple, sinks.lines(hits, samples, "AAAAA").collect())) == {"a": "CAAAG", "b": "AATAA", "c": "AAAAA"}
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 as x").repartition(5)
    assert all(r.x == r.idx for r in columns.numbered(rows, "x").collect())


def test_line_numbers_follow_the_file(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(HEAD + "".join(f"1\t{i}\tx\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = readers.call_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in lines[2:]] == [f"1\t{i}\tx" for i in range(5000)]
