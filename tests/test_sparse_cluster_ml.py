"""TF-IDF by hand (T10-T14), clustering metrics on 4 points, multi-label
metrics (T19) and k-NN voting."""

import math

import numpy as np
from pyspark.sql import functions as F

from labelscope.operators import cluster, multilabel as ml, sparse


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "durian")],
                                 "id int, text string")
    w, vocab = sparse.tfidf_fit_transform(docs, "id", "text", min_df=1, max_df=1.0, bigrams=False)
    idf = {r.term: r.idf for r in vocab.collect()}
    assert math.isclose(idf["apple"], math.log(4 / 2) + 1)
    assert math.isclose(idf["banana"], math.log(4 / 3) + 1)
    got = {(r.id, r.term): r.weight for r in w.collect()}
    a = (1 + math.log(2)) * idf["apple"]
    b = 1 * idf["banana"]
    assert math.isclose(got[(1, "apple")], a / math.hypot(a, b))
    assert math.isclose(got[(3, "durian")], 1.0)


def test_df_pruning_bounds(spark):
    docs = spark.createDataFrame([(i, "common rare%d" % (i % 2)) for i in range(10)], "id int, text string")
    _, vocab = sparse.tfidf_fit_transform(docs, "id", "text", min_df=2, max_df=0.9, bigrams=False)
    terms = {r.term for r in vocab.collect()}
    assert terms == {"rare0", "rare1"}          # 'common' has df 10 > 0.9 * 10


def test_top_ngrams_no_padding(spark):
    df = spark.createDataFrame([(1, "g1", "alpha beta"), (2, "g1", "gamma"), (3, "g2", "alpha"),
                                (4, "g3", "beta gamma")], "id int, g string, text string")
    top = sparse.top_ngrams(df, "g", "text", "id", k=10, min_df=1, max_df=1.0)
    per = {}
    for r in top.collect():
        per.setdefault(r.g, []).append((r.rank, r.term, r.score))
    assert all(s > 0 for v in per.values() for _, _, s in v)
    # g1's text is "alpha beta gamma": the border bigram 'beta gamma' crosses two texts
    assert "beta gamma" in [t for _, t, _ in per["g1"]]
    assert len(per["g2"]) == 1                  # fewer than k terms: no zero padding (T14)


def test_nearest_sparse_no_shared_term(spark):
    w = spark.createDataFrame([(1, "x", 1.0), (2, "y", 1.0)], "id int, term string, weight double")
    labs = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a")], "id int, label string")
    c = sparse.sparse_centroids(w, labs, "id", "label")
    near = {r.id: (r.nearest_label, r.nearest_dist) for r in
            sparse.nearest_centroid_sparse(w, labs, c, "id", "label").collect()}
    assert near[3] == ("a", 1.0)                # no terms at all -> smallest label, 1.0 (T9)
    assert near[1][0] == "b" and abs(near[1][1]) < 1e-9


def test_cluster_metrics_four_points(spark):
    pts = [(1, 0, [0.0, 0.0]), (2, 0, [0.0, 2.0]), (3, 1, [10.0, 0.0]), (4, 1, [10.0, 2.0])]
    df = spark.createDataFrame(pts, "id int, c int, v array<double>")
    assert math.isclose(cluster.inertia(df, "c", "v").first()[0], 4.0)
    # between = 4 * 25 = 100, within = 4 -> CH = (100 / 1) / (4 / 2) = 50
    assert math.isclose(cluster.calinski_harabasz(df, "c", "v").first()[0], 50.0)
    # s = 1 for both clusters, centre distance 10 -> DB = 0.2
    assert math.isclose(cluster.davies_bouldin(df, "c", "v").first()[0], 0.2)
    sil = {r.id: r.silhouette for r in cluster.silhouette_rows(df, "id", "c", "v").collect()}
    b = (10 + math.sqrt(104)) / 2
    assert math.isclose(sil[1], (b - 2) / b)


def test_metrics_empty_union_and_unpredicted_label(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    pred = spark.createDataFrame([(1, "a")], "id int, label string")
    items = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    r = ml.multilabel_scores(truth, pred, "id", labels, items=items).first()
    assert math.isclose(r.f1_macro, (1.0 + 0.0 + 0.0) / 3)      # 'c' never seen: F1 0 (T19)
    assert math.isclose(r.f1_micro, 2 * 1 / (2 * 1 + 0 + 1))
    assert math.isclose(r.jaccard_samples, (1.0 + 0.0 + 0.0) / 3)   # item 3: empty union -> 0


def test_knn_vote_zero_distance(spark):
    nb = spark.createDataFrame([(1, 10, 1.0), (1, 11, 0.5), (1, 12, 0.5)], "id int, neighbor int, sim double")
    tl = spark.createDataFrame([(10, "x"), (11, "y"), (12, "y")], "id int, label string")
    pred = {(r.id, r.label) for r in ml.knn_vote(nb, tl, "id").collect()}
    assert pred == {(1, "x")}                    # the zero-distance neighbour takes all the weight


def test_samplers_partition_independent(spark):
    from labelscope.operators import profile
    df = spark.range(500).withColumn("g", F.col("id") % 7)
    a = profile.sample_per_group(df.repartition(1), "g", "id", 5, 6740, ["id"]).orderBy("g").collect()
    b = profile.sample_per_group(df.repartition(8), "g", "id", 5, 6740, ["id"]).orderBy("g").collect()
    assert a == b
    f1 = ml.group_folds(df.repartition(1), "id", 5, 1).orderBy("id").collect()
    f8 = ml.group_folds(df.repartition(8), "id", 5, 1).orderBy("id").collect()
    assert f1 == f8


def test_pca_centred_and_uncorrelated(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(X)], "id int, v array<double>")
    proj, ratio = cluster.pca(df, "v", 3)
    P = np.array([r.pcs for r in proj.orderBy("id").collect()])
    assert np.allclose(P.mean(axis=0), 0, atol=1e-8)
    cov = np.cov(P.T)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-6)
    assert 0 < sum(ratio) <= 1 + 1e-9


def test_stream_scoring_matches_batch(spark, tmp_path):
    from labelscope.operators import dense
    from labelscope.sources import fixtures as fx
    from labelscope.streaming.scoring import score_stream
    sf = "/root/testdata/sf0.001"
    vecs = fx.labelled_vectors(spark, sf)
    cents = dense.dense_centroids(dense.unit_vectors(vecs))
    batch = {r.vec_id: r.dist for r in dense.own_distance(dense.unit_vectors(vecs), cents, out="dist").collect()}
    stream = (spark.readStream.schema(vecs.schema).option("pathGlobFilter", "embeddings.parquet")
              .parquet(sf))
    q = (score_stream(stream, cents).select("vec_id", "dist").writeStream.format("memory")
         .queryName("scored").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.vec_id: r.dist for r in spark.sql("SELECT * FROM scored").collect()}
    assert got.keys() == batch.keys()
    assert all(abs(got[k] - batch[k]) < 1e-9 for k in got)


def test_sparse_dot_block_matches_dense():
    from labelscope.operators.blocks import sparse_dot_block
    rng = np.random.default_rng(1)
    nq, nr, V = 7, 11, 30
    Q = (rng.random((nq, V)) < 0.3) * rng.random((nq, V))
    R = (rng.random((nr, V)) < 0.3) * rng.random((nr, V))
    Q[:, 0] = 1.0
    R[:, 0] = 2.0                      # one term in every row: goes the dense way
    rq, cq = np.nonzero(Q)
    rr, cr = np.nonzero(R)
    for ratio in (1 / 16, 2.0, 0.0):   # mixed, all sparse, all dense
        S = sparse_dot_block(rq, cq, Q[rq, cq], nq, rr, cr, R[rr, cr], nr, budget_bytes=4096,
                             dense_ratio=ratio)
        assert np.allclose(S, Q @ R.T)


def test_random_prevalence_of_many_labels_gives_the_same_rows(spark, monkeypatch):
    from labelscope.operators import multilabel
    rows = [(i, f"l{j}") for i in range(60) for j in range(9) if (i * 7 + j * 3) % (j + 2) == 0] + [(i, None) for i in range(60)]
    truth = spark.createDataFrame(rows, "item long, label string")
    draw = lambda: sorted(tuple(r) for r in multilabel.random_prevalence(
        truth, truth.select("item").union(spark.createDataFrame([(None,)], "item long")), "item", 3).collect() if r.item is not None)
    few = draw()
    monkeypatch.setattr(multilabel, "MAX_LABELS", 4)
    assert few and draw() == few


def test_silhouette_sends_own_and_nearest_clusters_only(spark, monkeypatch):
    from labelscope.operators import blocks
    rng = np.random.default_rng(8)
    x, c = rng.normal(size=(120, 3)).round(3), rng.integers(0, 30, 120)
    c[:40] = 7                                             # a cluster that fills blocks
    x[100], c[100] = x[99], c[99]
    ids = [i if i != 100 else 99 for i in range(120)]      # a repeated row
    ids[98], c[98] = 97, c[97]                             # a repeated id with another vector
    df = spark.createDataFrame([(ids[i], int(c[i]) if i != 60 else None, x[i].tolist()) for i in range(120)], "i long, c int, v array<double>")
    parts, meet = [], blocks.cogroup_blocks

    def counted(*a):
        out = meet(*a)
        parts.append(out.count())
        return out

    monkeypatch.setattr(blocks, "cogroup_blocks", counted)
    D, live = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), [i for i in range(120) if i != 60]
    for size in (64 * 1024 * 1024, 8192):
        monkeypatch.setattr(blocks, "block_bytes", lambda spark: size)
        got = {r.i: r.silhouette for r in cluster.silhouette_rows(df, "i", "c", "v").collect()}
        assert got[60] == 0.0 and len(got) == 118
        for i in set(ids) - {60}:
            mine = [r for r in live if ids[r] == i]
            mean = {}
            for k in {int(c[r]) for r in live}:
                d = [D[r, j] for r in mine for j in live if c[j] == k and ids[j] != i]
                if d:
                    mean[k] = np.mean(d)
            own, b = int(c[mine[0]]), min(v for k, v in mean.items() if k != int(c[mine[0]]))
            assert abs(got[i] - ((b - mean[own]) / max(mean[own], b) if own in mean else 0.0)) < 1e-9
    assert parts[0] <= 120 * 2                     # not a row for each of the clusters


def test_sweep_fits_at_a_time_in_matrix_products(spark, monkeypatch):
    import threading
    solvers, together, fit, kmeans = [], threading.Barrier(2, timeout=60), cluster.kmeans_fit, cluster.KMeans
    monkeypatch.setattr(cluster, "KMeans", lambda **o: solvers.append(o.get("solver")) or kmeans(**o))
    monkeypatch.setattr(cluster, "kmeans_fit", lambda *a, **o: together.wait() is None or fit(*a, **o))
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, (rng.normal(size=3) + 9 * (i % 3)).tolist()) for i in range(60)], "id int, v array<double>")
    rows = cluster.kmeans_sweep(df, "id", "v", [2, 3], seed=1).collect()
    assert [(r.dims, r.k) for r in rows] == [(-1, 2), (-1, 3)] and set(solvers) == {"block"}
    assert rows[1].silhouette > 0.6 > rows[0].inertia / 1e6 and rows[1].inertia < rows[0].inertia
