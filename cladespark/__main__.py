"""Command line: ``python -m cladespark run|subset|recommend|quality``."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession

from . import workflow
from .operators import columns
from .settings import CHOICES, Settings
from .sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladespark")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="from call files or a matrix to features, trees and classifiers")
    for name in ("genomic", "label", "output_dir"):
        run.add_argument(f"--{name}", required=True)
    for name in ("meta", "known_markers", "ref_fasta", "config", "ml_empty_symbol"):
        run.add_argument(f"--{name}")
    for name in ("validate_statistics", "validate_interactions", "run_ml_protocol"):
        run.add_argument(f"--{name}", action="store_true")
    for name in ("pipeline_mode", "ml_algorithm"):
        run.add_argument(f"--{name}", choices=CHOICES[name])
    for name in ("ml_min_sensitivity", "ml_max_sensitivity", "ml_step_sensitivity", "ml_remove_empty_field_threshold"):
        run.add_argument(f"--{name}", type=float)
    run.add_argument("--n_jobs", type=int, help="shuffle partitions; the cluster's setting by default")
    some = sub.add_parser("subset", help="a manifest of a (stratified) sample of call files")
    for name in ("vcf_dir", "metadata", "output_dir"):
        some.add_argument(f"--{name}", required=True)
    some.add_argument("--n", type=int, required=True)
    some.add_argument("--stratify-by")
    some.add_argument("--random-seed", type=int, default=42)
    some.add_argument("--delimiter", default="_")
    some.add_argument("--copy", action="store_true")
    best = sub.add_parser("recommend", help="a classifier for a labelled matrix")
    best.add_argument("--in_file", required=True)
    best.add_argument("--out", required=True)
    best.add_argument("--empty_threshold", type=float, default=1.0)
    best.add_argument("--empty_symbol", default="")
    quality = sub.add_parser("quality", help="counts of what a quality check of call files looks for, by sample")
    quality.add_argument("--vcf_dir", required=True)
    quality.add_argument("--out", required=True)
    return top


def settings(a: argparse.Namespace) -> Settings:
    """Defaults, then the file, then the flags; a stated mode beats the shortcut for the learning branch."""
    s = Settings().overlaid(a.config) if a.config else Settings()
    names = ("pipeline_mode", "ml_algorithm", "ml_min_sensitivity", "ml_max_sensitivity", "ml_step_sensitivity", "ml_empty_symbol", "ml_remove_empty_field_threshold")
    shortcut = True if a.run_ml_protocol and a.pipeline_mode is None else None
    return s.but(run_ml_protocol=shortcut, **{n: getattr(a, n) for n in names})


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("cladespark").getOrCreate()
    if a.command == "run":
        if a.n_jobs and a.n_jobs > 0:
            spark.conf.set("spark.sql.shuffle.partitions", str(a.n_jobs))
        out = workflow.run(spark, a.genomic, a.meta, a.label, a.output_dir, settings(a), a.known_markers, a.ref_fasta, a.validate_statistics, a.validate_interactions)
        print(json.dumps(out, indent=2, default=str))
    elif a.command == "subset":
        print(workflow.subset(spark, a.vcf_dir, a.metadata, a.n, a.output_dir, a.stratify_by, a.random_seed, a.delimiter, a.copy).count())
    elif a.command == "recommend":
        cells, labels = readers.symbols(spark, a.in_file)
        text = workflow.recommendation_text(a.in_file, workflow.recommend(columns.drop_empty(cells, a.empty_threshold, a.empty_symbol), labels))
        sinks.write_text(spark, text, a.out)
        print(text)
    else:
        sinks.write_table(workflow.quality(spark, a.vcf_dir), a.out, ["sample_id"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
