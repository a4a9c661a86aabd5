"""Stored vectoriser (S6), summaries asked once (X12), fast silhouette (C7), ranges of any number (W2), sorted reports (O2)."""

import math
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from labelscope.operators import compose, vectorizer
from labelscope.operators.prep import ValidationError


def texts(spark):
    rows = [(i, t) for i, t in enumerate(["red apple pie", "green apple tart", "red brick wall", "apple apple red", "", "tall green wall"])]
    return spark.createDataFrame(rows, "id long, text string")


def test_vectorizer_survives_its_session(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    df = texts(spark)
    v = vectorizer.fit(df, "id", "text", 2, 0.9, bigrams=False, sublinear=False)
    want = sorted(map(tuple, v.transform(df, "id", "text").collect()))
    vectorizer.save(v, path)
    other = spark.newSession()
    got = vectorizer.load(other, path)
    assert (got.n_docs, got.min_df, got.max_df, got.sublinear, got.bigrams) == (6, 2, 0.9, False, False)
    new = other.createDataFrame(df.collect(), df.schema)
    assert sorted(map(tuple, got.transform(new, "id", "text").collect())) == want and want
    with pytest.raises(Exception):
        vectorizer.save(v, path)


def test_vectorizer_checks_on_load(spark, tmp_path):
    df = texts(spark)
    with pytest.raises(ValidationError, match="no finished"):
        vectorizer.load(spark, f"file://{tmp_path}/none")
    v = vectorizer.fit(df, "id", "text", 2, 0.9)
    for k, (change, said) in enumerate([
            (lambda t, p: (t.where("term <> 'apple'"), p), "not those that were written"),
            (lambda t, p: (t.withColumn("df", F.col("df") + 1), p), "not those that were written"),
            (lambda t, p: (t.withColumn("idf", F.col("idf") + 0.1), p), "do not fit"),
            (lambda t, p: (t, p.withColumn("n_docs", F.lit(60).cast("long"))), "do not fit"),
            (lambda t, p: (t, p.withColumn("format", F.lit(0))), "format 0")]):
        a, b = f"file://{tmp_path}/a{k}", f"file://{tmp_path}/b{k}"
        vectorizer.save(v, a)
        t, p = change(spark.read.parquet(f"{a}/terms"), spark.read.parquet(f"{a}/parameters"))
        t.write.parquet(f"{b}/terms")
        p.write.parquet(f"{b}/parameters")
        with pytest.raises(ValidationError, match=said):
            vectorizer.load(spark, b)
    with pytest.raises(ValidationError, match="stop words"):
        vectorizer.load(spark, a, ["of"])


def test_summaries_are_asked_once_and_joined_back(spark, tmp_path):
    log = str(tmp_path / "calls")

    def summarizer(prompts):
        with open(log, "a") as f:
            f.write("".join(p.replace("\n", " ") + "\n" for p in prompts))
        return [f"about {p.split()[-1]}\n" for p in prompts]
    calls = lambda: len(open(log).read().splitlines()) if os.path.exists(log) else 0
    rows = [(f"g{i}", f"tell of {i % 5}") for i in range(20)] + [("none", None)]
    prompts = spark.createDataFrame(rows, "g string, prompt string").repartition(4)
    store = f"file://{tmp_path}/store"
    out = compose.summarize_groups(prompts, "g", summarizer, store=store, batch_size=2)
    want = {g: None if p is None else f"about {p.split()[-1]}\n" for g, p in rows}
    assert {r.g: r.summary for r in out.collect()} == want
    assert calls() == 5                       # five different prompts
    assert {r.g: r.summary for r in out.collect()} == want and calls() == 5      # another action
    more = prompts.union(spark.createDataFrame([("new", "tell of 77")], prompts.schema))
    back = compose.join_back(spark.createDataFrame([("new", 1), ("g3", 2), ("other", 3)], "g string, x int"),
                             compose.summarize_groups(more, "g", summarizer, store=store), "g", ["summary"])
    assert {(r.g, r.x, r.summary) for r in back.collect()} == {("new", 1, "about 77\n"), ("g3", 2, "about 3\n"), ("other", 3, None)}
    assert calls() == 6
    compose.summarize_groups(prompts, "g", summarizer, store=store, version="2").collect()
    assert calls() == 11                      # another version asks again


def test_a_failing_summarizer_keeps_finished_answers(spark, tmp_path):
    log, bad = str(tmp_path / "calls"), str(tmp_path / "bad")
    open(bad, "w").close()

    def summarizer(prompts):
        with open(log, "a") as f:
            f.write("".join(p + "\n" for p in prompts))
        if os.path.exists(bad) and "p7" in prompts:
            raise RuntimeError("the service is away")
        return prompts
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "g int, prompt string").coalesce(1)
    run = lambda: compose.summarize_groups(prompts, "g", summarizer, store=f"file://{tmp_path}/store", batch_size=1).collect()
    with pytest.raises(Exception, match="the service is away"):
        run()
    os.remove(bad)
    assert {r.g: r.summary for r in run()} == {i: f"p{i}" for i in range(10)}
    asked = open(log).read().split()
    assert all(asked.count(f"p{i}") == 1 for i in range(10) if i != 7)


def test_group_prompts_with_a_users_summarizer(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"text {i}") for i in range(8)], "id int, g string, text string")
    prompts = compose.group_prompts(df, "g", "text", 3, 1, ["id"], template="Sum up:\n{examples}")
    out = compose.summarize_groups(prompts, "g", lambda ps: [str(p.count("- ")) for p in ps], store=f"file://{tmp_path}/s")
    assert {r.g: r.summary for r in out.collect()} == {"a": "3", "b": "3"}
    with pytest.raises(ValueError):
        compose.summarize_groups(prompts, "g")


def test_fast_silhouette_against_all_pairs(spark, monkeypatch):
    from labelscope.operators import cluster
    rnd = random.Random(5)
    rows = [(i, f"c{rnd.randrange(5)}", [1e6 + rnd.gauss(0, 1), rnd.gauss(0, 1)]) for i in range(60)] + [(60, "one", [1e6, 9.0])]
    rows += [(61, "same", [1e6, 5.0]), (62, "same", [1e6, 5.0])]
    monkeypatch.setattr(cluster, "CLUSTER_BLOCK", 2)
    got = {r.i: r.silhouette for r in cluster.silhouette_fast(spark.createDataFrame(rows, "i int, c string, v array<double>"), "i", "c", "v").collect()}
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for i, c, v in rows:
        to = {}
        for j, d, u in rows:
            if i != j:
                to.setdefault(d, []).append(far(v, u))
        a, b = to.pop(c, None), None
        b = min(map(statistics.mean, to.values()))
        want = 0.0 if a is None else (b - statistics.mean(a)) / max(b, statistics.mean(a))
        assert math.isclose(got[i], want, abs_tol=1e-6), (i, c)
    alone = spark.createDataFrame([(1, "a", [0.0]), (2, "a", [1.0])], "i int, c string, v array<double>")
    assert {r.silhouette for r in cluster.silhouette_fast(alone, "i", "c", "v").collect()} == {0.0}


def test_a_hot_group_spreads_over_all_ranges(spark):
    from labelscope.operators.order_stats import numbered, ranged
    df = spark.range(20_000).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % 20_000).alias("x")).union(
        spark.createDataFrame([("cold", 1)], "k string, x long"))
    sizes = [r["count"] for r in ranged(df, ["k", "x"], "test", 100).groupBy("_bk").count().collect()]
    assert len(sizes) > 90 and max(sizes) < 1000
    got = numbered(df, ["k"], ["x"], "n")
    assert got.where("k = 'hot' and n <> x").count() == 0 and got.count() == 20_001


def test_sorted_reports_are_in_order(spark):
    from labelscope.plans.catalog import QUERIES
    rows = QUERIES["label_distance_summary"](spark, "/root/testdata/sf0.001").collect()
    key = [(-r.rate_either, r.label) for r in rows]
    assert len(key) > 1 and key == sorted(key)


def test_counts_need_no_shuffle_of_terms_and_add_up_over_rows(spark):
    from labelscope.operators import sparse
    rows = [(1, "red fox red fox"), (2, "blue sky"), (2, "blue sea"), (None, "red fox"), (None, "red"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["term"], r["tf"]) for r in sparse.term_counts(df, "doc_id", "text").collect()))
    assert got == [(0, "fox", 1), (0, "red", 2), (0, "red fox", 1), (1, "fox", 2), (1, "fox red", 1), (1, "red", 2),
                   (1, "red fox", 2), (2, "blue", 2), (2, "blue sea", 1), (2, "blue sky", 1), (2, "sea", 1), (2, "sky", 1)]
    once = sparse.term_counts(df.where("doc_id in (1, 3, 4)"), "doc_id", "text")
    assert "Aggregate" not in once._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_in_bounded_tasks(spark, monkeypatch):
    from labelscope.operators import sparse
    df = spark.createDataFrame([(i, "word " * 200) for i in range(64)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(sparse, "DEAL_BYTES", 4096)
    assert sparse.dealt(df, "doc_id", "text").rdd.getNumPartitions() == 16
    monkeypatch.setattr(sparse, "DEAL_BYTES", 1 << 20)
    assert sparse.dealt(df, "doc_id", "text").rdd.getNumPartitions() == 1


def test_weights_count_and_meet_their_terms_in_one_shuffle(spark):
    from labelscope.operators import sparse
    df = spark.createDataFrame([(i, f"word{i % 5} word{i % 3} same") for i in range(40)], "doc_id long, text string")
    w, vocab = sparse.tfidf_fit_transform(df, "doc_id", "text", 2, 0.9)
    w.collect()
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "Reused" in plan
    assert {r["term"] for r in w.collect()} == {r["term"] for r in vocab.collect()}


def test_best_columns_takes_the_leftmost_of_equal_ones():
    import numpy as np
    from labelscope.operators.blocks import best_columns
    S = np.array([[1.0, 1.0, 1.0, 2.0], [-np.inf, 0.0, -np.inf, -np.inf]])
    q, r, v = best_columns(S, 3)
    assert sorted(zip(q.tolist(), r.tolist(), v.tolist())) == [(0, 0, 1.0), (0, 1, 1.0), (0, 3, 2.0), (1, 1, 0.0)]


def test_large_blocks_copy_rows_few_times(spark):
    from labelscope.operators import blocks
    left, right = blocks.tiled_counts(240_000, 240_000, 64, spark, per_row=10)
    assert left <= 10 and right <= 10      # copies of a row; block_counts asks for 83
    left, right = blocks.tiled_counts(5_000, 240_000, 64, spark)
    assert left == 1
    assert all((t.stop - t.start) * 32768 * 8 <= blocks.DEFAULT_BLOCK_BYTES // 4 for t in blocks.tiles(32768, 32768))


def test_silhouette_in_blocks_and_tiles(spark, monkeypatch):
    import numpy as np
    from labelscope.operators import blocks, cluster
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4)).round(3)
    x[10:20] = x[0]
    c = [f"c{int(i)}" for i in rng.integers(0, 4, 90)]
    df = spark.createDataFrame([(i, c[i], x[i].tolist()) for i in range(90)], "i long, c string, v array<double>")
    monkeypatch.setattr(blocks, "block_bytes", lambda spark: 8192)
    got = {r.i: r.silhouette for r in cluster.silhouette_rows(df, "i", "c", "v").collect()}
    D = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(90):
        mean = {k: np.mean([D[i, j] for j in range(90) if c[j] == k and j != i]) for k in set(c)}
        a, b = mean[c[i]], min(v for k, v in mean.items() if k != c[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-6


def test_folds_share_stored_items_and_find_the_same_neighbours(spark, monkeypatch):
    from pyspark.sql import functions as F
    from labelscope.operators import blocks, multilabel, sparse
    import random
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, i % 3, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12)))) for i in range(60)]
    rows += [(100 + i, i % 3, rows[i][2]) for i in range(20)]       # copies: ties
    items = spark.createDataFrame(rows, "id long, fold int, text string")
    sizes = {r["fold"]: r["count"] for r in items.groupBy("fold").count().collect()}
    tf = sparse.term_counts(items, "id", "text", unique=True, keep=("fold",))
    train, test = sparse.tfidf_folds(tf, "id", "fold", sizes, 2, 0.9)
    others = items.select("id", F.explode(F.array_remove(F.array(*[F.lit(f) for f in range(3)]), F.col("fold"))).alias("_f"))
    want = multilabel.knn_sparse(test, train, "id", 3, items.select(F.col("fold").alias("_f"), "id"), others, by="_f")
    want = {(r.id, r.neighbor): round(r.sim, 9) for r in want.collect()}
    monkeypatch.setattr(blocks, "block_bytes", lambda spark: 4096)
    got = multilabel.knn_tfidf_folds(tf, items.select("id", "fold"), "id", "fold", sizes, 3, 2, 0.9)
    assert {(r.id, r.neighbor): round(r.sim, 9) for r in got.collect()} == want
    some = multilabel.knn_tfidf_folds(tf, items.select("id", "fold"), "id", "fold", sizes, 3, 2, 0.9, F.col("id") % 10 == 0)
    assert {(r.id, r.neighbor): round(r.sim, 9) for r in some.collect()} == {k: v for k, v in want.items() if k[0] % 10 == 0}


def test_dense_neighbours_in_blocks_with_ties(spark, monkeypatch):
    import numpy as np
    from labelscope.operators import blocks, multilabel
    rng = np.random.default_rng(8)
    x = rng.normal(size=(70, 3)).round(2)
    x[20:50] = x[3]
    df = spark.createDataFrame([(i, i % 4, x[i].tolist()) for i in range(70)], "id long, fold int, v array<double>")
    monkeypatch.setattr(blocks, "block_bytes", lambda spark: 8192)
    got = {}
    for r in multilabel.knn_dense(df.where("id % 5 = 0"), df, "id", "v", 3, fold="fold").collect():
        got.setdefault(r.id, set()).add(r.neighbor)
    n = np.linalg.norm(x, axis=1)
    S = np.round(x @ x.T / (n[:, None] * n), 12)
    for i in range(0, 70, 5):
        order = sorted((j for j in range(70) if j % 4 != i % 4), key=lambda j: (-S[i, j], j))
        assert got[i] == set(order[:3])
    assert set(got) == set(range(0, 70, 5))


def test_dense_features_are_read_from_a_store(spark):
    from labelscope.plans import catalog
    feats, _ = catalog._dense_features(spark, "/root/testdata/sf0.001")
    plan = feats._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "regexp" not in plan
    assert feats.count() == catalog.ml_dataset(spark, "/root/testdata/sf0.001")[0].count()


def test_both_sparse_distances_from_one_pass(spark, monkeypatch):
    from labelscope.operators import sparse
    from labelscope.plans import label_quality
    import random
    rnd = random.Random(4)
    w = spark.createDataFrame([(i, f"t{t}", rnd.random()) for i in range(40) for t in rnd.sample(range(12), 4)], "id int, term string, weight double")
    labs = spark.createDataFrame([(i, lab) for i in range(43) for lab in rnd.sample("abcdefg", 1 + i % 2)], "id int, label string")
    c = sparse.sparse_centroids(w, labs, "id", "label")
    both = sparse.centroid_matches(w, labs, c, "id", "label", 2)
    for operator in (sparse.own_distance_sparse, sparse.nearest_centroid_sparse):
        rows = [sorted((r[0], r[1], round(r[2], 9)) for r in operator(w, labs, c, "id", "label", **o).collect()) for o in ({}, {"matches": both})]
        assert rows[0] == rows[1] and len(rows[0]) >= 43
    got, fit = [], sparse.tfidf_fit_transform

    def seen(df, *a, **o):
        got.append(df._jdf.queryExecution().executedPlan().toString())
        return fit(df, *a, **o)

    monkeypatch.setattr(sparse, "tfidf_fit_transform", seen)
    df = spark.createDataFrame([(i, f"l{i % 2}", f"title{i % 2}", f"word{i % 3} word{i % 2}", [1.0, float(i)]) for i in range(12)],
                               "vec_id long, label string, label_title string, text string, embedding array<double>")
    assert label_quality.both_measures_quality(df, min_df=1, max_df=1.0).count() == 12
    assert "Aggregate" not in got[0] and "Exchange" not in got[0]     # the texts are stored once


def test_fold_weights_are_weighed_in_their_rows(spark):
    import math
    from labelscope.operators import sparse
    items = spark.createDataFrame([(i, i % 3, f"w{i % 4} w{i % 5} w{i % 2}") for i in range(30)], "id long, fold int, text string")
    tf = sparse.term_counts(items, "id", "text", unique=True, keep=("fold",))
    counts = {}
    for r in tf.collect():
        counts.setdefault((r.id, r.fold), {})[r.term] = r.tf
    for w, test in zip(sparse.tfidf_folds(tf, "id", "fold", {0: 10, 1: 10, 2: 10}, 2, 0.9), (False, True)):
        plan = w._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
        got = {(r._f, r.id, r.term): r.weight for r in w.collect()}
        want = {}
        for f in range(3):
            df = {}
            for (_, fold), terms in counts.items():
                for t in terms:
                    df[t] = df.get(t, 0) + (fold != f)
            idf = {t: math.log(21 / (1 + n)) + 1 for t, n in df.items() if 2 <= n <= 18}
            for (i, fold), terms in counts.items():
                if (fold == f) == test:
                    x = {t: (1 + math.log(n)) * idf[t] for t, n in terms.items() if t in idf}
                    norm = math.sqrt(sum(v * v for v in x.values()))
                    want |= {(f, i, t): v / norm for t, v in x.items()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_neighbour_queries_ask_for_every_row(spark, tmp_path):
    import random
    from labelscope.plans.catalog import QUERIES
    rnd = random.Random(5)
    words = {lang: [f"{lang}{i}" for i in range(9)] for lang in ("aa", "bb")}
    langs = ["aa", "bb"]
    docs = [(i, " ".join(rnd.choice(words[langs[i % 2]]) for _ in range(12)), langs[i % 2]) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, i % 2, [rnd.random() for _ in range(4)]) for i in range(60)],
                          "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = QUERIES["knn_neighbors"](spark, str(tmp_path)).collect()
    assert sorted(r.vec_id for r in near) == sorted(3 * list(range(60)))
    for name in ("knn_predict", "knn_predict_dense"):
        assert {(r.doc_id, r.label) for r in QUERIES[name](spark, str(tmp_path)).collect()} == {(i, f"lang_{lang}") for i, _, lang in docs}
    for name in ("knn_crossval", "knn_crossval_dense"):
        assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] == [(1.0, 1.0, 1.0)]


def test_sweep_over_several_blocks(spark, monkeypatch):
    import numpy as np
    from labelscope.operators import blocks, cluster
    x = np.random.default_rng(6).normal(size=(90, 4)).round(3)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(90)], "i long, v array<double>")
    want = [tuple(r) for r in cluster.kmeans_sweep(df, "i", "v", [3, 5], [2], seed=1).collect()]
    monkeypatch.setattr(blocks, "block_bytes", lambda spark: 8192)
    got = [tuple(r) for r in cluster.kmeans_sweep(df, "i", "v", [3, 5], [2], seed=1).collect()]
    assert np.allclose(got, want, atol=1e-9)


def test_weights_are_made_beside_their_part_of_the_texts(spark, monkeypatch):
    import math
    import random
    from collections import Counter
    from labelscope.operators import sparse
    monkeypatch.setattr(sparse, "DEAL_BYTES", 256)
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randrange(0, 15))) or None, rnd.choice(["x", None])) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, text string, s string")
    w, _ = sparse.tfidf_fit_transform(df, "i", "text", 2, 0.9, keep=("s",))
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan     # neither counts nor weights are dealt by term or item
    toks = {i: (t or "").split() for i, t, _ in rows}
    tf = {i: Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])]) for i, t in toks.items()}
    df_ = Counter(x for c in tf.values() for x in c)
    raw = {i: {t: (1 + math.log(n)) * (math.log(81 / (1 + df_[t])) + 1) for t, n in c.items() if 2 <= df_[t] <= 72} for i, c in tf.items()}
    want = {(i, s, t): round(x / math.sqrt(sum(y * y for y in raw[i].values())), 9) for i, _, s in rows for t, x in raw[i].items()}
    assert {(r.i, r.s, r.term): round(r.weight, 9) for r in w.collect()} == want


def test_group_terms_are_dealt_by_term_once(spark, monkeypatch):
    import re
    from collections import Counter
    from labelscope.operators import sparse
    monkeypatch.setattr(sparse, "DEAL_BYTES", 256)
    rows = [(i, f"g{i % 3}" if i % 7 else None, " ".join(f"w{(i * j) % 5}w" for j in range(i % 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, g string, text string")
    tf = sparse.group_term_counts(df, "g", "text", "i")
    keys = re.findall(r"hashpartitioning\(([^)]*), \d+\)", tf._jdf.queryExecution().executedPlan().toString())
    assert [re.sub(r"#\d+", "", k) for k in keys if "term" in k] == ["term"]
    want = Counter()
    for g in ("g0", "g1", "g2", None):
        texts = [t.split() for _, x, t in rows if x == g]
        for t in ([sum(texts, [])] if g else texts):      # rows without a group are not joined to one text
            want.update((g, x) for x in t + [f"{a} {b}" for a, b in zip(t, t[1:])])
    assert {(r.g, r.term): r.tf for r in tf.collect()} == dict(want)


def test_products_are_summed_in_a_task_a_core(spark):
    from labelscope.operators import sparse
    docs = spark.createDataFrame([(i, f"red fish{i % 4} blue fish{i % 3}", f"g{i % 2}") for i in range(40)], "i long, text string, s string")
    w, _ = sparse.tfidf_fit_transform(docs, "i", "text", keep=("s",))
    c = sparse.sparse_centroids(w, docs, "i", "s")
    for df in (sparse.own_distance_sparse(w, docs, c, "i", "s"), sparse.nearest_centroid_sparse(w, docs, c, "i", "s")):
        assert f"Coalesce {spark.sparkContext.defaultParallelism}" in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 40
