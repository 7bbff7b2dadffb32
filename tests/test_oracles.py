"""Every query with SQL against DuckDB on the smallest tables, plain and chunked."""

import check
import pytest

from tempograin import plans

FOLDER = "/root/testdata/sf0.001"
ORACLES = plans.all_oracles()
QUERIES = plans.all_queries()
CHUNKED = ["w03_gap_fill", "w07_cycle_verdict", "w09_dominant_period", "w11_longest_run", "w12_uncovered_runs", "j15_nearest_label",
           "w16_stance_fraction", "w28_lag_scan", "a18_wasserstein", "a11_curve_quantiles", "c06_gaussian_smooth", "e01_group_folds",
           "e06_roc_auc_pooled", "e07_average_precision", "e14_operating_points", "e16_repeat_agreement", "e22_benjamini_hochberg",
           "e23_holm", "e24_wilcoxon", "e26_spearman", "e31_permutation_control", "w22_most_confident", "a30_cross_subject_summary",
           "g12_trunk_lean", "w14_travel_azimuth", "w26_longest_first", "s10_markdown_table"]


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def compare(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    names, got = check.spark_rows(df)
    want_names, want, types = check.duck_rows(con, ORACLES[name])
    assert names == want_names
    assert {f: check.TYPE_NAMES.get(t, t) for f, t in df.dtypes} == {f: types[f] for f in df.columns}
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    compare(spark, con, name)


@pytest.mark.parametrize("name", CHUNKED)
def test_chunked_query_matches_sql(spark, con, chunked, name):
    chunked(120)
    compare(spark, con, name)
