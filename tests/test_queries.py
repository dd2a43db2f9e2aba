"""Queries against their SQL on the smallest driver tables."""

import os

import duckdb
import numpy as np
import pytest

from cladespark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["association_top_features", "multiple_testing", "fisher_exact_tests", "yates_statistics", "carrier_sites", "call_quality_report", "column_gates", "redundant_patterns", "category_codes", "interval_join", "nearest_region", "root_split_scores", "threshold_sweep", "naive_bayes_scores", "nearest_neighbour_votes", "quota_sample", "bootstrap_draws", "feature_synergy", "circular_context", "binary_sequences", "ordered_site_table", "allele_sequences", "identified_records", "typed_and_forced_columns", "info_fields", "decision_tree_nodes", "decision_tree_accuracy", "root_and_branch_features", "epistatic_interactions", "prefiltered_features", "interaction_permutation_test", "bootstrap_validation", "feature_confidence", "coding_annotation"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(df):
    cols = sorted(df.columns)
    show = lambda v: f"{float(v) + 0:.5f}" if isinstance(v, float | int | np.number) and not isinstance(v, bool) else str(v)
    x = df[cols].astype(object).where(df[cols].notna(), None).map(show)
    return x.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", FAST)
def test_query(spark, con, name):
    got, want = plain(QUERIES[name](spark, SF).toPandas()), plain(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), (got.compare(want).head() if got.shape == want.shape else (got.shape, want.shape))
