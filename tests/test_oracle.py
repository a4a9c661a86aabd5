"""Catalog queries against their DuckDB twins on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
FAST = ["label_distance_quality", "unit_vectors", "nearest_centroid_dense", "group_stats", "group_pct_rank",
        "dedupe_label_text", "text_purity", "text_word_count", "hist_word_count", "sample_rows",
        "tfidf_items", "top_ngrams_by_group", "nearest_centroid_sparse", "outlier_flags",
        "label_distance_summary", "flag_crosstab_margins", "silhouette_rows", "davies_bouldin",
        "cluster_composition", "crosstab_top_log1p", "crosstab_top5_log1p", "knn_neighbors", "random_baseline",
        "multi_hot", "label_distance_quality_multi", "mismatch_rate_multi", "outlier_flags_multi", "item_vectors",
        "embed_hashing", "pca_norms", "pca_variance", "kmeans_checks"]


def _canon(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_canon(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "nearest_label_dense" in df.columns


def test_every_query_has_sql_or_is_seeded():
    from labelscope.plans.catalog import QUERIES
    rows_only = set(QUERIES) - set(E.oracle_sql())
    assert rows_only <= {"pca_project", "kmeans_assign", "kmeans_sweep", "ovr_logistic_predict", "ovr_crossval"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, srows) == _rows(dcols, rel.fetchall())
