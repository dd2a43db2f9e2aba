"""The whole run: call files or a matrix and labels, to artifacts, validated features, trees, interactions and a trained classifier.

Each stage takes and returns DataFrames; reports are written below an output folder, which may be in any store Spark can write. The driver
holds settings, tree nodes, scores and titles only.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import elided
from .operators import annotate, association, calls, columns, models, resample, scoring, tree
from .settings import Settings
from .sources import readers, sinks

log = logging.getLogger(__name__)
GENBANK = (".gb", ".gbk", ".gbff")
#: Columns of an annotation table, in order.
ANNOTATION = ["Position", "Count", "Sequence", "Region_type", "Relative_pos", "Codon_number", "Nucleotide_change", "Amino_acid_change", "Gene_annotation"]


@dataclass
class Genotypes:
    """Ones of a sample-by-variant relation, and its samples; ``numeric``: cells of a prebuilt matrix with all values and nulls."""

    cells: DataFrame
    samples: DataFrame
    numeric: DataFrame | None = None


def kept(df: DataFrame, out: str | None, name: str) -> DataFrame:
    """``df`` as a Parquet table below ``out``, read back, so plans stay short and lost executors cost nothing; persisted without a folder."""
    if out is None:
        return df.persist()
    path = f"{out}/tables/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, path: str, out: str | None, s: Settings, reference: str | None = None, label: str | None = None) -> Genotypes:
    """Genotypes of a folder of call files, whose artifacts are written to ``out``, or of a matrix file. A single call file is an error."""
    if path.lower().endswith((".csv", ".tsv", ".tab")):
        cells, _ = readers.matrix(spark, path, label)
        cells = kept(cells, out, "genomic/matrix")
        return Genotypes(cells.where("value = 1"), cells.select("sample_id").distinct(), cells)
    if path.lower().endswith((".vcf", ".vcf.gz")):
        raise ValueError("give the folder that holds the call files")
    readers.require_call_files(spark, path)
    limits = {"least_qual": s.qual_threshold, "depth": s.min_dp_per_sample, "mapping": s.mq_threshold, "zero": s.mq0f_threshold}
    found = kept(calls.calls(calls.parse_records(readers.call_lines(spark, path)), s.biallelic_only, **limits), out, "genomic/calls")
    sites = kept(calls.sites(found, s.min_sample_presence), out, "genomic/sites")
    if sites.isEmpty():
        raise ValueError(f"no site has {s.min_sample_presence} carriers")
    samples = kept(readers.call_samples(spark, path), out, "genomic/samples")
    carried = kept(calls.carriers(found, sites), out, "genomic/carriers")
    turned = calls.baselines(found, sites, samples) if s.ancestral_allele == "N" else sites.select(calls.variant_id().alias("variant_id"), F.lit(0).alias("differs"))
    turned = kept(turned, out, "genomic/baselines")
    ones = kept(calls.binary(carried, turned, samples), out, "genomic/ones") if s.ancestral_allele == "N" else carried
    n = samples.count()
    counts = columns.sparse_counts(ones)
    if s.remove_invariant or s.min_minor_count:
        counts = columns.varying(counts, n, s.min_minor_count)
    cells = kept(ones.join(counts, "variant_id", "left_semi"), out, "genomic/cells")
    if cells.isEmpty():
        raise ValueError("no variant is left after the column filters")
    if out:
        artifacts(spark, f"{out}/genomic", carried, ones, sites, turned, samples, s, reference)
    if s.use_integer_variant_ids:
        short = columns.numbered(cells.select("variant_id").distinct(), "variant_id").select("variant_id", F.concat(F.lit("v"), F.col("idx").cast("string")).alias("short"))
        if out:
            sinks.write_json(short, f"{out}/genomic/variant_id_lookup.json")
        cells = kept(cells.join(short, "variant_id").select("sample_id", F.col("short").alias("variant_id"), "value"), out, "genomic/short_cells")
    return Genotypes(cells, samples)


def site_table(spark: SparkSession, sites: DataFrame, reference: str | None) -> DataFrame:
    """The sites in order (idx) with the annotation columns, or Position and Count where there is no annotated reference."""
    table = columns.numbered(sites, *calls.SITE).withColumn("variant_id", calls.variant_id())
    table = table.withColumns({"Position": F.col("pos").cast("string"), "Count": F.col("carriers").cast("string")})
    if not (reference or "").lower().endswith(GENBANK):
        return table
    notes = annotate.annotate(sites.withColumn("variant_id", calls.variant_id()), readers.coding_regions(spark, reference), readers.reference(spark, reference))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    named = notes.select("variant_id", F.col("region_type").alias("Region_type"), text("rel_pos").alias("Relative_pos"), text("codon_number").alias("Codon_number"), F.col("nucleotide_change").alias("Nucleotide_change"), F.col("amino_change").alias("Amino_acid_change"), F.col("gene").alias("Gene_annotation"))
    return table.join(named, "variant_id").withColumn("Sequence", F.concat_ws(">", "ref", "alt"))


def artifacts(spark: SparkSession, out: str, carried: DataFrame, ones: DataFrame, sites: DataFrame, turned: DataFrame, samples: DataFrame, s: Settings, reference: str | None) -> None:
    """Site tables, FASTA files of alleles and bits, and the reduced matrices."""
    g = s.generic_name
    sinks.write_text(spark, s.as_json(), f"{out}/config.json")
    table = kept(site_table(spark, sites, reference), out, "site_table")
    shown = [c for c in ANNOTATION if c in table.columns]
    ordered = table.orderBy("idx")
    ordered.select(*shown).write.mode("overwrite").csv(f"{out}/vcf_counts/all_snp.txt", header=True, sep="\t")
    positions = sites.select("pos").distinct()
    filtered = table.join(positions, "pos", "left_semi")
    extra = []
    if reference:
        around = annotate.contexts(filtered.select("variant_id", "pos"), readers.reference(spark, reference)).select("variant_id", F.col("context").alias("Context_±40"))
        filtered, extra = filtered.join(around, "variant_id"), ["Context_±40"]
    filtered.orderBy("idx").select(*shown, *extra).write.mode("overwrite").csv(f"{out}/fasta/{g}_filtered.tsv", header=True, sep="\t")
    everything = table.select("variant_id", "idx", "pos", "ref", "alt")
    export(f"{out}/fasta/{g}", everything, carried, turned, samples, wrap=None)
    few = kept(reduced(table, ones, turned, s), out, "reduced")
    export(f"{out}/matrices/{g}", columns.numbered(few.select("variant_id", F.col("idx").alias("old"), "pos", "ref", "alt"), "old"), carried, turned, samples, wrap=80, tables=True)
    few.orderBy("idx").select(*shown).write.mode("overwrite").csv(f"{out}/matrices/{g}_filtered.tsv", header=True, sep="\t")


def reduced(table: DataFrame, ones: DataFrame, turned: DataFrame, s: Settings) -> DataFrame:
    """Sites of the wanted type, at most ``matrices_repeat_number`` of each equal column, and the forced ones."""
    typed = table
    if s.matrices_type != "all" and "Region_type" in table.columns:
        typed = columns.type_filter(table.withColumn("amino_change", F.col("Amino_acid_change")), s.matrices_type)
    # the reference is a row of the matrix too
    rows = ones.select("sample_id", "variant_id", "value").union(turned.where("differs = 1").select(F.lit("REF"), "variant_id", F.lit(1)))
    every = columns.patterns(rows).join(typed.select("variant_id", "pos"), "variant_id", "right").withColumn("pattern", F.coalesce("pattern", F.lit("")))
    some = columns.even_pick(every, "pattern", ["pos", "variant_id"], s.matrices_repeat_number).select("variant_id", F.lit(True).alias("some"))
    mask = table.join(some, "variant_id", "left").select("variant_id", (F.col("idx") + 1).alias("idx"), F.coalesce("some", F.lit(False)).alias("keep"))
    return table.join(columns.forced(mask, s.matrices_fix).where("keep").select("variant_id"), "variant_id", "left_semi")


def export(path: str, variants: DataFrame, carried: DataFrame, turned: DataFrame, samples: DataFrame, wrap: int | None, tables: bool = False) -> None:
    """FASTA files, and tables, of alleles and bits over ``variants(variant_id, idx, pos, ref, alt)``; the reference comes first."""
    spark = variants.sparkSession
    listed = variants.join(turned.select("variant_id", "differs"), "variant_id").orderBy("idx").select("variant_id", "ref", "differs").collect()  # one row a column of the table
    refs, bits = "".join(r.ref for r in listed), "".join(str(r.differs) for r in listed)
    at = variants.select("variant_id", "idx", "alt")
    alleles = sinks.lines(carried.join(at, "variant_id").select("sample_id", "idx", F.col("alt").alias("symbol")), samples, refs)
    # a carrier differs from the reference, whose bit is 1 where the baseline is the alternate
    flipped = carried.join(at, "variant_id").join(turned.select("variant_id", "differs"), "variant_id").select("sample_id", "idx", (1 - F.col("differs")).cast("string").alias("symbol"))
    binary = sinks.lines(flipped, samples, bits)
    for name, seqs, fill in (("alleles", alleles, refs), ("binary", binary, bits)):
        whole = seqs.union(spark.createDataFrame([("REF", fill)], "sample_id string, seq string")).persist()
        sinks.write_fasta(whole, f"{path}_{name}.fasta", wrap)
        if tables:
            sinks.write_matrix(whole, [r.variant_id for r in listed], f"{path}_{name}.tsv")
        whole.unpersist()


def supervised(genotypes: Genotypes, meta: DataFrame, label: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells and clean labels of the samples that both have; an error if there are none."""
    from .functions.text import normal_label

    if label not in meta.columns:
        raise ValueError(f"no column {label} in the metadata")
    raw = meta.select("sample_id", normal_label(F.col(f"`{label}`")).alias("label"))
    known = kept(association.align(genotypes.samples, raw)[1], out, "labels")
    if known.isEmpty():
        raise ValueError("no sample has both genotypes and a label")
    cells = genotypes.cells.withColumn("sample_id", association.normal_sample(F.col("sample_id"))).join(known, "sample_id", "left_semi")
    return kept(cells, out, "labelled_cells"), known


def validate(cells: DataFrame, labels: DataFrame, out: str, s: Settings) -> dict[str, Any]:
    """Association tests of all features, their correction, and bootstrap importances; written, not used as a filter."""
    tested = kept(association.tests(association.contingency(cells, labels), s.chi2_min_expected), out, "tests")
    sinks.write_json(tested, f"{out}/chi_squared_results.json")
    correct = association.benjamini_hochberg if s.multiple_testing_method == "fdr_bh" else association.bonferroni
    corrected = kept(correct(tested.select("variant_id", "p"), s.significance_level), out, "corrected")
    sinks.write_json(corrected.select("variant_id", "p", "q", "significant"), f"{out}/multiple_testing_results.json")
    boot = resample.bootstrap_validation(cells, labels, s.n_bootstrap_samples, s.random_state, s.max_depth or 5, least_split=s.min_samples_split, least_leaf=max(1, s.min_samples_split // 3))
    sinks.write_json(boot, f"{out}/bootstrap_results.json")
    return {"tested": tested.count(), "significant": corrected.where("significant").count()}


def filled(genotypes: Genotypes, cells: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """Cells of the features that pass the gates; of matrices with nulls, those that are not nearly constant once nulls are 0."""
    n = labels.count()
    if genotypes.numeric is None:
        gates = columns.sparse_counts(cells).select("variant_id", F.least(F.col("ones"), F.lit(n) - F.col("ones")).alias("minor"))
        return cells.join(gates.where(F.col("minor") >= s.min_maf_prefilter * n), "variant_id", "left_semi")
    mine = genotypes.numeric.withColumn("sample_id", association.normal_sample(F.col("sample_id"))).join(labels, "sample_id", "left_semi")
    gates = columns.passing(columns.near_constant(columns.numeric_gates(mine, n)), s.min_nonmissing_prefilter, s.min_maf_prefilter)
    return cells.join(gates, "variant_id", "left_semi")


def discover(genotypes: Genotypes, cells: DataFrame, labels: DataFrame, out: str, s: Settings) -> dict[str, Any]:
    """Prefilter, tree, hierarchy, confidence and interactions."""
    n = labels.count()
    wanted = kept(association.prefilter(filled(genotypes, cells, labels, s), labels, n, s.max_prefiltered_features, s.prefilter_alpha), out, "prefiltered")
    used = kept(cells.join(wanted, "variant_id", "left_semi"), out, "prefiltered_cells")
    grown = tree.grow(used, labels, s.max_depth, s.min_samples_split, s.min_samples_leaf)
    roots, branches = grown.roots_and_branches()
    spark = cells.sparkSession
    chosen = spark.createDataFrame([(f,) for f in [*roots, *branches]], "variant_id string")
    picked = used.join(chosen, "variant_id", "left_semi")
    stable = resample.bootstrap_validation(used, labels, s.bootstrap_outer_iters, s.random_state, s.max_depth or 5).select("variant_id", F.col("mean").alias("stability"))
    parts = association.statistics(association.contingency(picked, labels)).select("variant_id", "mi", "v").join(stable, "variant_id")
    confident = parts.withColumn("confidence", association.confidence(F.col("mi"), F.col("stability"), F.col("v"))).orderBy(F.desc("confidence"), "variant_id")
    pairs = tree.interactions(grown, used, labels, s.epistasis_strength_threshold, s.max_epistatic_interactions) if grown.pairs() else None
    right = tree.accuracy(tree.predict(grown, used, labels), labels).first().accuracy
    sinks.write_text(spark, grown.rules(), f"{out}/decision_tree_rules.txt")
    sinks.write_json(confident, f"{out}/feature_confidence.json")
    if pairs is not None:
        pairs = kept(pairs, out, "interactions")
        sinks.write_json(pairs, f"{out}/epistatic_interactions.json")
        sinks.write_json(network(pairs), f"{out}/interaction_edges.json")
    return {"features_tested": wanted.count(), "root_features": roots, "branch_features": branches, "tree_accuracy": right, "tree_depth": max(x.depth for x in grown.nodes.values()), "interactions": pairs}


def network(pairs: DataFrame) -> DataFrame:
    """Interactions as edges of a graph: (source, target, weight, paths)."""
    return pairs.groupBy(F.col("f1").alias("source"), F.col("f2").alias("target")).agg(F.max("strength").alias("weight"), F.count("*").alias("paths"))


def summary(found: dict[str, Any], spark: SparkSession) -> str:
    """What a reader sees first: counts, and the first root features with long names shortened."""
    names = spark.createDataFrame([(f,) for f in found["root_features"][:3]], "f string").select(elided(F.col("f")).alias("f"))
    top = ", ".join(r.f for r in names.collect())
    return f"{len(found['root_features'])} root and {len(found['branch_features'])} branch features, tree accuracy {found['tree_accuracy']:.3f}; first: {top}"


def learn(cells: DataFrame, labels: DataFrame, out: str, s: Settings) -> dict[str, Any]:
    """Choose, train, store and evaluate a classifier on symbols of cells: ones of a sparse relation, absent ones being the rest."""
    spark = cells.sparkSession
    symbols = cells.select("sample_id", F.col("variant_id").alias("marker"), F.col("value").cast("int").cast("string").alias("symbol"))
    symbols = kept(columns.drop_empty(symbols, s.ml_remove_empty_field_threshold, s.ml_empty_symbol), out, "symbols")
    sinks.write_table(symbols.join(labels, "sample_id").select(F.col("sample_id").alias("Sample"), "label", "marker", "symbol"), f"{out}/ml_protocol_matrix.csv", sep=",")
    chosen = recommend(symbols, labels) if s.ml_algorithm == "auto" else {"recommendation": s.ml_algorithm}
    name = scoring.resolve_algorithm(chosen["recommendation"], s.ml_algorithm)
    report: dict[str, Any] = {}
    kind = name
    if name == "MBCS":
        kind, report["cross_validation"] = models.best_by_cv(symbols, labels)
    elif name == "DNL":
        kind, report["linearity_gap"] = "RF", models.linearity_gap(symbols, labels)
    model = models.train(kind, symbols, labels, s.random_state)
    model.save(f"{out}/{name}_ml_protocol_model")
    held = models.holdout(kind, symbols, labels, seed=s.random_state)
    held = kept(held, out, "holdout")
    report["holdout_accuracy"] = held.agg(F.avg((F.col("label") == F.col("guess")).cast("int")).alias("a")).first().a
    report["holdout_report"] = [r.asDict() for r in scoring.report(held).orderBy("label").collect()]  # one row a label
    result = {"status": "success", "n_samples": labels.count(), "selected_algorithm": name, "selector": chosen, "training": report, "evaluation": evaluate(model, symbols, labels, out, s)}
    sinks.write_text(spark, json.dumps(result, indent=2, default=str), f"{out}/ml_protocol_results.json")
    return result


def evaluate(model: models.Trained, symbols: DataFrame, labels: DataFrame, out: str, s: Settings) -> dict[str, Any]:
    """Threshold table over the training samples, scored once, and the identifications at the best threshold."""
    spark = symbols.sparkSession
    trained = spark.createDataFrame([(t.split("=", 1)[0],) for t in model.titles], "name string").distinct()
    share = scoring.coverage(trained, symbols.select(F.col("marker").alias("name"))).first().share
    if share < 0.75:
        raise ValueError(f"only {share:.0%} of the trained markers are there")
    p = kept(model.score(symbols, labels), out, "scores")
    grid = scoring.thresholds(s.ml_min_sensitivity, s.ml_max_sensitivity, s.ml_step_sensitivity)
    table = scoring.threshold_table(scoring.identified(p, labels, grid)).orderBy("threshold").persist()
    sinks.write_table(table, f"{out}/ml_protocol_thresholds.tsv")
    best = table.where("is_best").first()
    sinks.write_table(scoring.identifications(p, labels, best.threshold), f"{out}/ml_protocol_sample_predictions.tsv", ["sample_id"])
    result = {"feature_overlap_coverage": share, "used_markers_count": trained.count(), "best_threshold": best.asDict(), "thresholds": [r.asDict() for r in table.collect()]}
    sinks.write_text(spark, json.dumps(result, indent=2), f"{out}/ml_protocol_evaluation.json")
    return result


def recommend(symbols: DataFrame, labels: DataFrame) -> dict[str, Any]:
    """Dataset figures, cluster scores, probe accuracies and the classifier that they speak for; RF if a probe cannot run."""
    labels = columns.drop_singletons(labels)
    symbols = symbols.join(labels, "sample_id", "left_semi")
    coded = columns.codes(symbols, missing=None).withColumn("code", F.when(F.col("code") >= 0, F.col("code")))
    stats = scoring.dataset_stats(coded, labels).first().asDict()
    try:
        titles = models.titles_of(symbols)
        clusters = models.cluster_quality(models.encode(symbols, titles).select("features"), max(2, stats["classes"])).first().asDict()
        probes = models.probe(symbols, labels)
        name = scoring.recommend(probes, stats["n"], stats["p"], stats["missing"], stats["sparsity"])
    except ValueError as e:
        log.warning("no probes: %s", e)
        clusters, probes, name = {}, {}, "RF"
    counts = {r.label: r.n for r in labels.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}
    return {"dataset": stats | {"class_counts": counts}, "clusters": clusters, "probes": probes, "recommendation": name}


def recommendation_text(name: str, result: dict[str, Any]) -> str:
    show = lambda v: f"{v:.4f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    out = ["# Matrix-based classifier recommendation", f"Input: {name}", ""]
    for title in ("dataset", "clusters", "probes"):
        out += [f"{title}:", *[f"  {k}: {show(v)}" for k, v in result[title].items()], ""]
    return "\n".join([*out, f"RECOMMENDATION: {result['recommendation']}"])


def run(spark: SparkSession, genomic: str, meta: str | None, label: str, out: str, s: Settings | None = None, known_markers: str | None = None, reference: str | None = None, validate_statistics: bool = False, validate_interactions: bool = False) -> dict[str, Any]:
    """All stages that the settings ask for; the result is also written as JSON. Labels are needed for all but the matrix."""
    s = s or Settings()
    out = out.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{out}/tables/checkpoints")
    genotypes = load(spark, genomic, out, s, reference, label)
    result: dict[str, Any] = {"mode": s.pipeline_mode, "samples": genotypes.samples.count(), "features": genotypes.cells.select("variant_id").distinct().count()}
    if known_markers:
        known = readers.markers(spark, known_markers)
        result["known_markers"] = known.count()
        result["known_markers_found"] = known.join(genotypes.cells.select(F.col("variant_id").alias("marker")).distinct(), "marker", "left_semi").count()
    if s.pipeline_mode != "matrix_only":
        if not meta:
            raise ValueError("metadata is needed beyond the matrix")
        rows = readers.metadata(spark, meta)
        sinks.write_table(rows.withColumnRenamed("sample_id", "Sample"), f"{out}/metadata.normalized.csv", sep=",")
        cells, labels = supervised(genotypes, rows, label, out)
        result["labelled_samples"] = labels.count()
        if validate_statistics:
            result["validation"] = validate(cells, labels, f"{out}/statistical_validation", s)
        if s.trees:
            found = discover(genotypes, cells, labels, f"{out}/decision_tree", s)
            log.info(summary(found, spark))
            pairs = found.pop("interactions")
            result["discovery"] = found | {"interactions": pairs.count() if pairs is not None else 0}
            if validate_interactions and pairs is not None and s.n_permutation_tests:
                tested = resample.permutation_test(cells, labels, pairs.select("f1", "f2").distinct(), s.n_permutation_tests, s.random_state, s.significance_level)
                sinks.write_json(tested, f"{out}/decision_tree/interaction_permutation_results.json")
        if s.learns:
            result["ml"] = learn(cells, labels, f"{out}/ml_protocol", s)
    sinks.write_text(spark, json.dumps(result, indent=2, default=str), f"{out}/results_{datetime.now():%Y%m%d_%H%M%S}.json")
    return result


def quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality counts of every call file's sample; those without records have zeros and no mean."""
    readers.require_call_files(spark, folder)
    report = calls.qc_report(calls.parse_records(readers.call_lines(spark, folder)))
    return readers.call_samples(spark, folder).join(report, "sample_id", "left").fillna(0, [c for c in report.columns if c not in ("sample_id", "mean_dp")])


def subset(spark: SparkSession, folder: str, meta: str, n: int, out: str, stratify: str | None = None, seed: int = 42, delimiter: str = "_", copy: bool = False) -> DataFrame:
    """(sample_id, path, target) of ``n`` samples that have metadata and a call file, equal quotas of each stratum; written as a manifest."""
    found = readers.metadata(spark, meta).join(readers.call_files(spark, folder, delimiter), "sample_id")
    plain = stratify is None or stratify.lower() == "none"
    picked = resample.simple_sample(found, n, seed) if plain else resample.quota_sample(found, stratify, n, seed)
    suffix = F.when(F.col("path").endswith(".gz"), ".vcf.gz").otherwise(".vcf")
    manifest = picked.select("sample_id", "path", F.concat("sample_id", suffix).alias("target")).persist()
    sinks.write_table(manifest, f"{out.rstrip('/')}/manifest.tsv", ["sample_id"])
    if copy:
        sinks.copy_files(manifest, f"{out.rstrip('/')}/files")
    return manifest
