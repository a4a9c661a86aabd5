"""Label index, folds by rows, baseline blocks, the named pipelines and their logistic models (M2, M4, M5, M7, M8), J3 guards."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelscope.operators import multilabel as ml


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_label_index_of_many_labels(spark):
    n = 100_000
    kept = spark.range(n).select(F.format_string("l%06d", (F.col("id") * 7) % n).alias("label"))
    index = ml.label_index(kept)
    assert index.count() == n
    assert index.where("cast(substr(label, 2) as int) <> ix").count() == 0
    items = spark.createDataFrame([(1, ["l000003", "l099999", "l000003"]), (2, []), (3, ["l000000", "none"]), (4, None)], "id int, labels array<string>")
    rows = ml.label_indices(items, index, "id")
    assert {r.id: r.y for r in rows.collect()} == {1: [3, 99999], 2: [], 3: [0], 4: []}
    assert "l000003" not in plan_of(rows)


def test_multi_hot_is_dense_over_the_index(spark):
    index = ml.label_index(spark.createDataFrame([("b",), ("a",), ("c",)], "label string"))
    items = spark.createDataFrame([(1, ["c", "a"]), (2, [])], "id int, labels array<string>")
    assert {r.id: r.y for r in ml.multi_hot(items, index, "id").collect()} == {1: [1, 0, 1], 2: [0, 0, 0]}
    assert {r.id: r.y for r in ml.multi_hot(items, index.limit(0), "id").collect()} == {1: [], 2: []}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=60), st.integers(1, 6))
def test_dealt_groups_cover_all_and_balance(sizes, n_splits):
    histogram = list(Counter(sizes).items())
    load, seen = [0] * n_splits, Counter()
    for size, first, end, folds in ml.deal_groups(histogram, n_splits):
        assert first == seen[size] and end > first
        seen[size] = end
        for r in range(first, end):
            load[folds[(r - first) % len(folds)]] += size
    assert seen == Counter(dict(histogram))
    assert max(load) - min(load) <= max(sizes)


def test_deals_stay_few_after_a_huge_group():
    deals = ml.deal_groups([(10**9, 1), (1, 10**10)], 5)
    assert len(deals) < 12 and sum(end - first for _, first, end, _ in deals) == 10**10 + 1


def test_folds_balance_rows_of_repeated_groups(spark):
    rnd = random.Random(4)
    rows = [(f"g{g}", i) for g in range(200) for i in range(1 + int(rnd.expovariate(0.3)))] + [("hot", i) for i in range(120)] + [(None, 0)]
    df = spark.createDataFrame(rows, "g string, i int")
    got = ml.group_folds(df, "g", 4, 3).collect()
    assert Counter((r.g, r.i) for r in got) == Counter(rows)
    of = {}
    for r in got:
        assert of.setdefault(r.g, r.fold) == r.fold
    load = Counter(r.fold for r in got)
    assert set(load) == set(range(4)) and max(load.values()) - min(load.values()) <= 120
    again = ml.group_folds(df.repartition(7), "g", 4, 3).select("g", "fold").distinct().collect()
    assert {r.g: r.fold for r in again} == of


def test_baseline_has_no_nested_loop_join(spark, monkeypatch):
    monkeypatch.setattr(ml, "MAX_LABELS", 3)
    monkeypatch.setattr(ml.blocks, "ROWS_PER_SALT", 10)
    rows = [(i, f"l{j}") for i in range(60) for j in range(9) if (i + j) % (j + 2) == 0]
    truth = spark.createDataFrame(rows, "item long, label string")
    pred = ml.random_prevalence(truth, truth.select("item"), "item", 5)
    assert "NestedLoop" not in plan_of(pred) and "Cartesian" not in plan_of(pred)
    items, p = {i for i, _ in rows}, {f"l{j}": sum(lab == f"l{j}" for _, lab in rows) for j in range(9)}
    import hashlib
    want = {(i, lab) for i in items for lab in p if int(hashlib.md5(f"5|{i}|{lab}".encode()).hexdigest()[:8], 16) / 2**32 < p[lab] / len(items)}
    assert {(r.item, r.label) for r in pred.collect()} == want


def corpus(spark, n=48):
    rnd = random.Random(11)
    topics = {"red": ["apple", "cherry", "brick"], "blue": ["sea", "sky", "ink"], "big": ["giant", "tower", "whale"]}
    rows = []
    for i in range(n):
        labels = sorted(lab for lab in topics if rnd.random() < 0.5) or ["red"]
        words = [rnd.choice(topics[lab]) for lab in labels for _ in range(3)] + [rnd.choice(["table", "chair", "lamp", "door"]) for _ in range(4)]
        rnd.shuffle(words)
        rows.append((i, " ".join(words) if i != 5 else "", labels))
    return spark.createDataFrame(rows, "id long, text string, labels array<string>"), rows


def test_sparse_vectors_are_read_back_as_vectors(spark):
    from labelscope.operators.ovr import sparse_vectors
    rows = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "f int, id long")
    w = spark.createDataFrame([(0, 1, 4, 0.5), (0, 1, 1, 0.25), (1, 1, 0, 2.0)], "f int, id long, ix int, weight double")
    got = {(r.f, r.id): r.features for r in sparse_vectors(rows, w, ["f", "id"], 6).collect()}
    assert got[0, 1].size == 6 and got[0, 1].indices.tolist() == [1, 4] and got[0, 1].values.tolist() == [0.25, 0.5]
    assert got[0, 2].indices.tolist() == [] and got[1, 1].toArray().tolist() == [2, 0, 0, 0, 0, 0]


def newton(x, y):
    """Balanced L2 logistic regression (C = 1, free intercept) by Newton's method."""
    n, p = len(y), y.sum()
    w = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    x1 = np.hstack([x, np.ones((n, 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 0
    beta = np.zeros(x1.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x1 @ beta))
        grad = x1.T @ (w * (q - y)) + ridge @ beta
        beta -= np.linalg.solve(x1.T @ (x1 * (w * q * (1 - q))[:, None]) + ridge, grad)
    return beta


def test_logistic_models_against_newtons_method(spark):
    from labelscope.operators import ovr
    from labelscope.plans.multilabel_pipelines import Folded, fit_logistic
    items, rows = corpus(spark)
    d = Folded(items, "id", "text", 2, 1)
    train_w, test_w = d.tfidf(1, 1.0)
    model, train, weights, index = fit_logistic(d, train_w)
    fold = {r.id: r.fold for r in d.items.select("id", "fold").collect()}
    number = {r.term: r.ix for r in index.collect()}
    assert sorted(number.values()) == list(range(len(number)))
    matrix = {}
    for w in (train_w, test_w):
        for r in w.collect():
            matrix.setdefault((r._f, r.id), np.zeros(len(number)))[number[r.term]] = r.weight
    vector = lambda f, i: matrix.get((f, i), np.zeros(len(number)))
    got = {(r._f, r.id, r.block * ovr.LABEL_BLOCK + k): m for r in ovr.margins(model, d.test_items, ovr.indexed(test_w, index), "_f", "id").collect()
           for k, m in enumerate(r.margin)}
    labels = {r.ix: r.label for r in model.labels.collect()}
    has = {i: set(labs) for i, _, labs in rows}
    checked = 0
    for f in (0, 1):
        ids = [i for i in fold if fold[i] != f]
        for ix, label in labels.items():
            beta = newton(np.array([vector(f, i) for i in ids]), np.array([float(label in has[i]) for i in ids]))
            for i in fold:
                if fold[i] == f:
                    assert abs(got[f, i, ix] - (vector(f, i) @ beta[:-1] + beta[-1])) < 1e-3
                    checked += 1
    assert checked == len(rows) * 3 == len(got)
    grads = ovr.gradients(model, train, weights, "_f", "id").collect()
    assert len(grads) == 6 and all(0 <= r.gradient < 1e-5 for r in grads)
    pred = {(r.id, r.label) for r in ovr.predict(model, d.test_items, ovr.indexed(test_w, index), "_f", "id").collect()}
    assert pred == {(i, labels[ix]) for (f, i, ix), m in got.items() if m > 0}


def test_labels_of_all_or_none_are_constant(spark):
    from labelscope.plans.multilabel_pipelines import fold_predictions
    rows = [(i, f"word{i % 3} other", ["all"] + (["odd"] if i == 0 else [])) for i in range(8)]
    items = spark.createDataFrame(rows, "id long, text string, labels array<string>")
    pred, d = fold_predictions(items, "id", "text", "tfidf", "logistic", 2, 1, min_df=1, max_df=1.0)
    fold0 = next(r.fold for r in d.items.collect() if r.id == 0)
    got = {(r.id, r.label) for r in pred.collect()}
    assert {i for i, lab in got if lab == "all"} == set(range(8))
    assert not {i for i, lab in got if lab == "odd" and d.items.where(f"id = {i}").first().fold == fold0}


@pytest.mark.parametrize("encoder", ["tfidf", "dense"])
@pytest.mark.parametrize("classifier", ["logistic", "knn"])
def test_pipelines_by_name(spark, encoder, classifier):
    from labelscope.plans.multilabel_pipelines import crossval
    items, _ = corpus(spark)
    kept = ml.label_support(items, 1)
    r = crossval(items, kept, "id", "text", encoder, classifier, 3, seed=2, min_df=1, max_df=1.0).first()
    assert all(0.0 <= v <= 1.0 and not math.isnan(v) for v in r)
    assert r.f1_micro > 0.6   # the labels' own words are in the texts


def test_unknown_names_raise(spark):
    from labelscope.plans.multilabel_pipelines import crossval
    items, _ = corpus(spark, 6)
    for names in (("bag", "knn"), ("tfidf", "forest")):
        with pytest.raises(ValueError, match="must be one of"):
            crossval(items, items.select(F.explode("labels").alias("label")).distinct(), "id", "text", *names)


def test_a_users_encoder_runs_in_the_pipeline_and_in_embed(spark):
    from labelscope.operators.embed import embed
    from labelscope.plans.multilabel_pipelines import crossval

    def encoder(texts):
        return np.array([[t.count(w) for w in ("apple", "cherry", "brick", "sea", "sky", "ink", "giant", "tower", "whale")] for t in texts], np.float32)
    items, rows = corpus(spark)
    got = {r.id: r.embedding for r in embed(items, "id", "text", encoder, batch_size=5).collect()}
    assert got == {i: [float(t.count(w)) for w in ("apple", "cherry", "brick", "sea", "sky", "ink", "giant", "tower", "whale")] for i, t, _ in rows}
    r = crossval(items, ml.label_support(items, 1), "id", "text", "dense", "knn", 3, seed=2, encode=encoder).first()
    assert r.f1_micro > 0.8


def test_alignment_guards(spark):
    from labelscope.operators.dense import align_vectors
    from labelscope.operators.prep import ValidationError
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, x string")
    whole = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0])], "id int, embedding array<double>")
    assert sorted((r.id, r.x, r.embedding) for r in align_vectors(rows, whole, "id").collect()) == [
        (1, "a", [0.6, 0.8]), (2, "b", [0.0, 1.0]), (2, "c", [0.0, 1.0])]
    with pytest.raises(ValidationError, match="no vector for id = 2"):
        align_vectors(rows, whole.where("id = 1"), "id")
    with pytest.raises(ValidationError, match="not unique"):
        align_vectors(rows, whole.union(whole), "id")
    assert align_vectors(rows, whole.where("id = 1"), "id", normalize=False, validate=False).count() == 1
