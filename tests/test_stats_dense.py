"""Group statistics (T6, T7), centroid distances and nearest label."""

import math

from pyspark.sql import functions as F

from labelscope.operators import dense, stats


def test_group_stats_ties_and_singletons(spark):
    rows = [(1, "g", 1.0), (2, "g", 2.0), (3, "g", 2.0), (4, "g", 4.0),
            (5, "one", 7.0), (6, "eq", 3.0), (7, "eq", 3.0)]
    df = spark.createDataFrame(rows, "id int, k string, x double")
    out = {r.id: r for r in stats.add_group_stats(df, "k", "x", "p").collect()}
    # average rank: ties at 2.0 share (2 + 3) / 2 = 2.5 of 4
    assert math.isclose(out[2].pct_p, 2.5 / 4) and math.isclose(out[3].pct_p, 2.5 / 4)
    assert math.isclose(out[1].pct_p, 0.25) and math.isclose(out[4].pct_p, 1.0)
    assert math.isclose(out[1].p_mean, 2.25) and math.isclose(out[1].p_med, 2.0)
    sd = math.sqrt(((1 - 2.25) ** 2 + 2 * (2 - 2.25) ** 2 + (4 - 2.25) ** 2) / 3)
    assert math.isclose(out[4].z_p, (4 - 2.25) / sd)
    # single row: std undefined -> 0, z = 0 ; equal values: std 0 -> z = 0
    assert out[5].z_p == 0.0 and out[5].p_std == 0.0 and out[5].pct_p == 1.0
    assert out[6].z_p == 0.0 and out[6].p_std == 0.0 and out[6].pct_p == 0.75


def test_unit_vectors_and_centroids(spark):
    df = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, "a", [0.0, 2.0]), (3, "b", [1.0, 0.0])],
                               "id int, label string, v array<double>")
    u = dense.unit_vectors(df, "v")
    for r in u.collect():
        assert math.isclose(sum(x * x for x in r.v), 1.0)
    c = {r.label: r.centroid for r in dense.dense_centroids(u, "label", "v").collect()}
    m = [(0.6 + 0.0) / 2, (0.8 + 1.0) / 2]
    n = math.sqrt(m[0] ** 2 + m[1] ** 2)
    assert all(math.isclose(a, b / n) for a, b in zip(c["a"], m))


def test_nearest_tie_and_zero_vector(spark):
    cents = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [1.0, 0.0])], "label string, centroid array<double>")
    h = math.sqrt(0.5)
    items = spark.createDataFrame([(1, [h, h]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "id int, v array<double>")
    out = {r.id: (r.nearest_label, r.nearest_dist) for r in
           dense.nearest_centroid(items, cents, "id", "label", "v").collect()}
    assert out[1][0] == "a" and math.isclose(out[1][1], 1 - h)     # tie -> smallest label (T8)
    assert out[2] == ("a", 1.0)                                     # zero vector (T9)
    assert out[3][0] == "b" and abs(out[3][1]) < 1e-12


def test_own_distance_not_below_nearest(spark):
    sf = "/root/testdata/sf0.001"
    from labelscope.sources import fixtures as fx
    u = dense.unit_vectors(fx.labelled_vectors(spark, sf))
    c = dense.dense_centroids(u)
    own = dense.own_distance(u, c, out="d")
    near = dense.nearest_centroid(u, c, "vec_id")
    bad = own.join(near, "vec_id").filter((F.col("d") < F.col("nearest_dist") - 1e-9)
                                          | (F.col("d") < -1e-9) | (F.col("d") > 2 + 1e-9))
    assert bad.count() == 0


def test_crosstab_margins_add_up(spark):
    df = spark.createDataFrame([(True, False), (True, True), (False, False), (False, False)], "a boolean, b boolean")
    cells = {(r.a, r.b): r.n for r in stats.crosstab_margins(df, "a", "b").collect()}
    assert cells[("All", "All")] == 4
    assert cells[("true", "All")] == 2 and cells[("false", "All")] == 2
    assert cells[("All", "false")] == 3 and cells[("false", "false")] == 2


def test_rank_table_split_equals_single_window(spark):
    from labelscope.operators.order_stats import quantiles, rank_table
    import random
    rnd = random.Random(3)
    rows = [("hot", float(rnd.randint(0, 300))) for _ in range(3000)] + \
           [("cold", float(rnd.randint(0, 5))) for _ in range(40)] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    a = {(r.k, r.x): (r.cnt, r.before, r.n) for r in rank_table(df, "k", "x", buckets=1).collect()}
    b = {(r.k, r.x): (r.cnt, r.before, r.n) for r in rank_table(df, "k", "x", buckets=8).collect()}
    assert a == b
    qa = {r.k: r.p for r in quantiles(rank_table(df, "k", "x", buckets=8), "k", "x", {"p": 0.95}).collect()}
    import numpy as np
    for k in ("hot", "cold", "one"):
        xs = np.array([x for kk, x in rows if kk == k])
        assert abs(qa[k] - np.quantile(xs, 0.95)) < 1e-9


def test_nearest_fallbacks_equal_broadcast(spark):
    """Past the broadcast limit the blocked / relational forms give the same answer."""
    from labelscope.operators import sparse
    from labelscope.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    u = dense.unit_vectors(fx.labelled_vectors(spark, sf))
    c = dense.dense_centroids(u)
    docs = fx.labelled_text(spark, sf)
    w, _ = sparse.tfidf_fit_transform(docs, "doc_id", "text", 3, 0.8)
    lab = docs.select("doc_id", "source")
    sc = sparse.sparse_centroids(w, lab, "doc_id", "source")

    def run():
        a = {r.vec_id: (r.nearest_label, round(r.nearest_dist, 9))
             for r in dense.nearest_centroid(u, c, "vec_id").collect()}
        b = {r.doc_id: (r.nearest_label, round(r.nearest_dist, 9))
             for r in sparse.nearest_centroid_sparse(w, lab, sc, "doc_id", "source").collect()}
        return a, b

    wide = run()
    spark.conf.set("labelscope.kernel.broadcastBytes", "64")
    spark.conf.set("labelscope.kernel.blockBytes", "4096")
    try:
        narrow = run()
    finally:
        spark.conf.unset("labelscope.kernel.broadcastBytes")
        spark.conf.unset("labelscope.kernel.blockBytes")
    assert wide == narrow


def test_next_in_group_split_equals_window(spark):
    from labelscope.operators.order_stats import next_in_group
    rows = [("hot", i * 3, f"t{i}") for i in range(400)] + [("cold", 5, "a"), ("cold", 9, "b"), ("one", 1, "z")]
    df = spark.createDataFrame(rows, "g string, o long, v string")
    a = {(r.g, r.o): r.next_v for r in next_in_group(df, "g", "o", ["v"], buckets=1).collect()}
    b = {(r.g, r.o): r.next_v for r in next_in_group(df, "g", "o", ["v"], buckets=7).collect()}
    assert a == b
    assert a[("hot", 0)] == "t1" and a[("hot", 399 * 3)] is None and a[("cold", 5)] == "b"
