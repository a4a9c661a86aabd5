"""Multi-label prediction and metrics.

Labels stay a long ``(item, label)`` table; a multi-hot array is only made
on request (M2).  Metrics are aggregates over a full outer join of truth and
prediction.  k-NN is exact brute force done as a blocked kernel: every
(test block, train block) pair meets in one cogroup that keeps only each
test row's k best candidates, so no pair table is ever shuffled.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscope.functions.vector import as_double_array
from labelscope.operators import blocks
from labelscope.operators.order_stats import numbered
from labelscope.session import cut_lineage


# ------------------------------------------------------------- dataset (M1)

def item_label_sets(df: DataFrame, item: str, text: str, label: str, order_by: str | None = None) -> DataFrame:
    """One row per item: its first text and sorted distinct label set."""
    first = F.min_by(F.col(text), F.col(order_by)) if order_by else F.min(F.col(text))
    return df.groupBy(item).agg(first.alias(text), F.sort_array(F.collect_set(label)).alias("labels"))


def label_support(sets: DataFrame, min_count: int = 1) -> DataFrame:
    """(label, n_items) over the exploded sets, kept when >= ``min_count``."""
    return (sets.select(F.explode("labels").alias("label")).groupBy("label")
                .agg(F.count(F.lit(1)).alias("n_items")).filter(F.col("n_items") >= min_count))


def multilabel_dataset(df: DataFrame, item: str, text: str, label: str, min_per_label: int = 12,
                       order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, kept): items with their text and label set restricted to
    labels supported by >= ``min_per_label`` items; items left with no label
    are dropped (M1).  Relational: a semi join with the kept labels, no
    label list on the driver."""
    sets = item_label_sets(df, item, text, label, order_by)
    kept = label_support(sets, min_per_label)
    pairs = (sets.select(item, F.explode("labels").alias("label"))
                 .join(kept.select("label"), "label", "left_semi"))
    kept_sets = pairs.groupBy(item).agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return sets.select(item, text).join(kept_sets, item, "inner"), kept


def label_index(kept: DataFrame) -> DataFrame:
    """(label, ix): the labels numbered from 0 in their order (M2)."""
    return numbered(kept.select("label").distinct(), [], ["label"], "ix").select("label", F.col("ix").cast("int").alias("ix"))


def label_indices(items: DataFrame, index: DataFrame, item: str, out: str = "y") -> DataFrame:
    """(item, out array<int>): the ascending indices of each item's labels, a
    sparse row of the 0/1 matrix (M2).  The labels are joined, so their number
    shows neither in the plan nor on the driver; labels without an index have
    no column, and an item without labels has an empty row."""
    rows = items.select(item, F.explode_outer("labels").alias("label")).join(index, "label", "left")
    return rows.groupBy(item).agg(F.sort_array(F.collect_set("ix")).alias(out))


def multi_hot(items: DataFrame, index: DataFrame, item: str, out: str = "y") -> DataFrame:
    """(item, out): 0/1 array over all labels of ``index`` (M2)."""
    n = index.agg(F.count(F.lit(1)).cast("int").alias("_n")).withColumn("_k", F.lit(0))
    rows = label_indices(items, index, item, "_ix").withColumn("_k", F.lit(0)).join(n, "_k")   # one row: its number of labels
    hot = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.array_contains("_ix", i).cast("int"))
    return rows.select(item, F.when(F.col("_n") > 0, hot).otherwise(F.array().cast("array<int>")).alias(out))


# ------------------------------------------------------------- metrics (M3)

def multilabel_scores(truth: DataFrame, pred: DataFrame, item: str, labels: DataFrame,
                      items: DataFrame | None = None, by: str | None = None,
                      groups: list | None = None) -> DataFrame:
    """macro-F1 (over every label of ``labels``), micro-F1 and sample-averaged
    Jaccard over ``items`` (default: the truth items); 0 where undefined.

    With ``by`` (e.g. a fold column present in truth, pred and items) the
    three scores are computed for every value in ``groups`` in one plan."""
    g = [by] if by else []
    t = truth.select(*g, item, "label").distinct().withColumn("_t", F.lit(1))
    p = pred.select(*g, item, "label").distinct().withColumn("_p", F.lit(1))
    j = t.join(p, [*g, item, "label"], "full_outer").na.fill(0, ["_t", "_p"])
    j = j.withColumn("tp", (F.col("_t") * F.col("_p")).cast("long")) \
         .withColumn("fp", ((1 - F.col("_t")) * F.col("_p")).cast("long")) \
         .withColumn("fn", (F.col("_t") * (1 - F.col("_p"))).cast("long"))
    per_label = j.groupBy(*g, "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                           F.sum("fn").alias("fn"))
    lab = labels.select("label")
    if by:   # every label in every group: a generator over the (small) group list
        lab = lab.select("label", F.explode(F.array(*[F.lit(v) for v in groups])).alias(by))
    per_label = lab.join(per_label, [*g, "label"], "left").na.fill(0, ["tp", "fp", "fn"])
    f1 = F.when((2 * F.col("tp") + F.col("fp") + F.col("fn")) == 0, F.lit(0.0)).otherwise(
        2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    macro = per_label.groupBy(*g).agg(F.avg(f1).alias("f1_macro"), F.sum("tp").alias("_tp"),
                                      F.sum("fp").alias("_fp"), F.sum("fn").alias("_fn"))
    per_item = j.groupBy(*g, item).agg(F.sum("tp").alias("_i"),
                                       F.sum((F.col("_t") + F.col("_p") > 0).cast("long")).alias("_u"))
    base_items = (items if items is not None else truth).select(*g, item).distinct()
    jac = (base_items.join(per_item, [*g, item], "left").na.fill(0, ["_i", "_u"])
           .groupBy(*g).agg(F.avg(F.when(F.col("_u") == 0, F.lit(0.0)).otherwise(F.col("_i") / F.col("_u")))
                            .alias("jaccard_samples")))
    micro = F.when((2 * F.col("_tp") + F.col("_fp") + F.col("_fn")) == 0, F.lit(0.0)).otherwise(
        2.0 * F.col("_tp") / (2 * F.col("_tp") + F.col("_fp") + F.col("_fn")))
    m = macro.select(*g, "f1_macro", micro.alias("f1_micro"))
    if by:
        return m.join(jac, by)
    # two one-row frames: joined on a constant key (an equi-join of one row each)
    return m.withColumn("_k", F.lit(1)).join(jac.withColumn("_k", F.lit(1)), "_k").drop("_k")


# ------------------------------------------------------------- folds (M4)

MAX_LABELS = 4096   # labels in one block of the baseline's prevalence table


def hash_unit(seed: int, *cols):
    """Uniform [0, 1) from md5(seed | cols...) -- reproducible under any partitioning."""
    return hash_unit_of(seed, *[F.col(c) for c in cols])


def hash_unit_of(seed: int, *values):
    parts = [F.lit(str(seed))] + [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")
    return h / F.lit(4294967296.0)


def deal_groups(histogram: list[tuple[int, int]], n_splits: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, end, folds): groups of ``size`` rows numbered first..end-1
    go to ``folds`` in turn.  Larger groups first; each goes to a fold with the
    fewest rows, give or take one group, so folds differ by at most the largest
    group.  ``histogram``: (size, number of groups of that size)."""
    load, out = [0] * n_splits, []
    for size, n in sorted(histogram, reverse=True):
        at = 0
        while at < n:
            order = sorted(range(n_splits), key=lambda f: (load[f], f))
            near = [f for f in order if load[f] <= load[order[0]] + size]
            take = n - at
            if len(near) < n_splits:   # only until the next fold is reached
                take = min(take, len(near) * max(1, (load[order[len(near)]] - load[near[-1]]) // size))
            out.append((size, at, at + take, near))
            for i, f in enumerate(near):
                load[f] += size * (take // len(near) + (i < take % len(near)))
            at += take
    return out


def group_folds(df: DataFrame, group: str, n_splits: int = 5, seed: int = 0, out: str = "fold") -> DataFrame:
    """Whole groups to folds balanced by rows (M4): all rows of a group go to
    one fold, and folds differ by at most the largest group's rows.  Groups of
    one size are numbered in the order of a hashed uniform (ties by the group)
    and dealt out by :func:`deal_groups` from the histogram of the sizes, which
    has at most sqrt(2 * rows) lines; single-row groups are dealt in turn."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("_u", hash_unit(seed, group))
    ranked = numbered(sizes, ["_n"], ["_u", group], "_r")
    histogram = [(r["_n"], r["count"]) for r in ranked.groupBy("_n").count().collect()]
    deals = df.sparkSession.createDataFrame(deal_groups(histogram, n_splits), "_n long, _from long, _to long, _folds array<int>")
    place = ((F.col("_r") - F.col("_from")) % F.size("_folds") + 1).cast("int")
    folds = ranked.join(F.broadcast(deals), "_n").where("_r >= _from and _r < _to").select(
        F.col(group).alias("_g"), F.element_at("_folds", place).alias(out))
    return df.join(folds, df[group].eqNullSafe(folds["_g"])).drop("_g")


# ------------------------------------------------------------- k-NN

def knn_dense(test: DataFrame, train: DataFrame, item: str, vec: str, k: int = 3,
              fold: str | None = None) -> DataFrame:
    """k nearest training rows by cosine similarity (J10): (item, neighbor,
    sim), ties to the smaller neighbor id.  With ``fold`` a neighbor must lie
    in another fold than the query (cross-validation in one pass)."""
    spark = test.sparkSession
    ttype = test.schema[item].dataType
    cols = [item, as_double_array(vec).alias("_v")] + ([fold] if fold else [])
    lt, rt = test.select(*cols), train.select(*cols)
    n, width = rt.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    n_left, nb = blocks.tiled_counts(lt.count(), n, width or 1, spark)
    budget = blocks.block_bytes(spark)
    schema = T.StructType([T.StructField(item, ttype), T.StructField("neighbor", ttype),
                           T.StructField("sim", T.DoubleType())])

    def kern(lp, rp):
        rp = rp.sort_values(item, kind="stable")          # ties at equal similarity -> smaller id
        X, Y = blocks.pandas_matrix(lp["_v"]), blocks.pandas_matrix(rp["_v"])
        nx, ny = np.linalg.norm(X, axis=1)[:, None], np.linalg.norm(Y, axis=1)[None, :]
        li, ri, got = lp[item].to_numpy(), rp[item].to_numpy(), []
        for t in blocks.tiles(len(X), len(Y), budget):
            with np.errstate(divide="ignore", invalid="ignore"):
                S = np.round(np.where((nx[t] > 0) & (ny > 0), (X[t] @ Y.T) / (nx[t] * ny), 0.0), 12)   # equal ones tie
            S[np.isnan(S)] = -np.inf
            if fold:
                S[lp[fold].to_numpy()[t, None] == rp[fold].to_numpy()[None, :]] = -np.inf
            q, r, v = blocks.best_columns(S, k)
            got.append(pd.DataFrame({item: li[t][q], "neighbor": ri[r], "sim": v}))
        return pd.concat(got, ignore_index=True)

    part = blocks.cogroup_blocks(lt, rt, item, item, n_left, nb, kern, schema)
    w = Window.partitionBy(item).orderBy(F.col("sim").desc(), F.col("neighbor").asc())
    return part.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def knn_sparse(test_w: DataFrame, train_w: DataFrame, item: str, k: int = 3,
               test_items: DataFrame | None = None, train_items: DataFrame | None = None,
               by: str | None = None) -> DataFrame:
    """k nearest training items for sparse unit vectors ``(item, term, weight)``
    (J10): cosine = dot product.  Per block pair the shared-term products are
    summed in pandas and only the k best per test row (plus the k smallest
    non-overlapping ids at similarity 0, so that ties at zero resolve to the
    smallest ids exactly) leave the task."""
    spark = test_w.sparkSession
    ttype = test_w.schema[item].dataType
    g = [by] if by else []
    # terms travel as numbers; one that no training item has adds nothing
    train_w = cut_lineage(train_w.select(*g, item, "term", "weight"), "train-weights")
    index = numbered(train_w.select("term").distinct(), [], ["term"], "_ix").select("term", F.col("_ix").cast("int").alias("_ix"))
    index = cut_lineage(index, "terms")
    lt, rt = (w.join(index, "term").groupBy(*g, item).agg(F.collect_list("_ix").alias("_t"), F.collect_list("weight").alias("_w"))
              for w in (test_w, train_w))
    # rows without any kept term are still queries / candidates (similarity 0)
    empty_t = F.array().cast("array<int>")
    empty_w = F.array().cast("array<double>")
    if test_items is not None:
        lt = (test_items.select(*g, item).distinct().join(lt, [*g, item], "left")
              .select(*g, item, F.coalesce("_t", empty_t).alias("_t"), F.coalesce("_w", empty_w).alias("_w")))
    if train_items is not None:
        rt = (train_items.select(*g, item).distinct().join(rt, [*g, item], "left")
              .select(*g, item, F.coalesce("_t", empty_t).alias("_t"), F.coalesce("_w", empty_w).alias("_w")))
    # the size check below reads both sides once; keep them for the cogroup
    lt, rt = cut_lineage(lt, "queries"), cut_lineage(rt, "candidates")
    # block sizes per key value (e.g. per fold): only rows of one key ever meet
    nnz_col = F.sum(F.size("_t"))
    if by:
        nnz, n_r = rt.groupBy(by).agg(nnz_col.alias("c"), F.count(F.lit(1)).alias("r")).agg(F.max("c"), F.max("r")).first()
        nnz, n_r = nnz or 0, n_r or 0
        n_q = lt.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    else:
        nnz, n_r = rt.agg(nnz_col, F.count(F.lit(1))).first()
        nnz, n_q = nnz or 0, lt.count()
    n_left, nb = blocks.block_counts(n_q, n_r, 1, spark)
    nb = max(nb, int(np.ceil(nnz * 64 / blocks.block_bytes(spark))))
    schema = T.StructType([T.StructField(item, ttype), T.StructField("neighbor", ttype),
                           T.StructField("sim", T.DoubleType())])

    budget = blocks.block_bytes(spark)

    def kern(lp, rp):
        rp = rp.sort_values(item, kind="stable")          # ties at equal similarity -> smaller id
        lq = lp["_t"].map(len).to_numpy()
        lr = rp["_t"].map(len).to_numpy()
        tq, tr, wq, wr = (np.concatenate(p[c].to_list()) for c in ("_t", "_w") for p in (lp, rp))
        nq, nr = len(lp), len(rp)
        if len(tq) and len(tr):
            codes, _ = pd.factorize(np.concatenate([tq, tr]))
            cq, cr = codes[:len(tq)], codes[len(tq):]
            S = blocks.sparse_dot_block(np.repeat(np.arange(nq), lq), cq, wq, nq,
                                        np.repeat(np.arange(nr), lr), cr, wr, nr, budget)
        else:
            S = np.zeros((nq, nr))
        qi, ri, sims = blocks.best_columns(np.round(S, 12), k)
        return pd.DataFrame({item: lp[item].to_numpy()[qi], "neighbor": rp[item].to_numpy()[ri], "sim": sims})

    part = blocks.cogroup_blocks(lt, rt, item, item, n_left, nb, kern, schema, keys=g)
    w = Window.partitionBy(item).orderBy(F.round(F.col("sim"), 12).desc(), F.col("neighbor").asc())
    return part.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def knn_tfidf_folds(tf: DataFrame, items: DataFrame, item: str, fold: str, fold_sizes: dict, k: int = 3, min_df=1, max_df=1.0,
                    queries=None) -> DataFrame:
    """k nearest items of the other folds by TF-IDF cosine, the vocabulary fitted
    on those folds (J10, M6): (item, neighbor, sim) for the items that meet the
    condition ``queries`` (default: all).

    ``tf`` is (item, fold, term, tf), ``items`` (item, fold).  An item's weights
    differ between folds by the idf only, so it is stored once, as its tf' and
    one norm per fold; a query carries tf' x idf^2 / norm of its own fold.  Terms
    that no query has add to the norms alone.  Terms travel as numbers."""
    from labelscope.operators.sparse import fold_idfs

    spark = tf.sparkSession
    asked = F.lit(True) if queries is None else queries
    folds = sorted(fold_sizes)
    ttype = items.schema[item].dataType
    tfw = F.lit(1.0) + F.log(F.col("tf"))
    met = tf.join(fold_idfs(tf, fold, fold_sizes, min_df, max_df), "term").select(item, fold, "term", tfw.alias("_w"), "_idfs")
    met = cut_lineage(met, "term-weights")
    norms = met.groupBy(item).agg(F.array(*[F.sqrt(F.sum(F.coalesce(
        F.pow(F.col("_w") * F.get("_idfs", F.lit(f)), 2.0), F.lit(0.0)))) for f in folds]).alias("_n"))
    items = items.select(item, fold).join(norms, item, "left").withColumn(
        "_n", F.coalesce("_n", F.array_repeat(F.lit(0.0), len(folds))))
    items = cut_lineage(items, "norms")
    own = F.get("_idfs", F.col(fold))
    used = met.where(asked).where(own.isNotNull())
    index = cut_lineage(numbered(used.select("term").distinct(), [], ["term"], "_ix").select("term", F.col("_ix").cast("int").alias("_ix")), "terms")

    def packed(rows, weight, base):
        """A row per item of ``base`` with its terms' numbers and weights, also without any."""
        got = rows.join(index, "term").groupBy(item).agg(F.collect_list(F.struct("_ix", weight.alias("_w"))).alias("_e"))
        return cut_lineage(base.join(got, item, "left").select(
            item, fold, "_n", F.coalesce("_e._ix", F.array().cast("array<int>")).alias("_t"),
            F.coalesce("_e._w", F.array().cast("array<double>")).alias("_w")), "packed")

    rt = packed(met.select(item, "term", "_w"), F.col("_w"), items)
    lt = packed(used.select(item, "term", (F.col("_w") * own * own).alias("_w")), F.col("_w"), items.where(asked))
    nnz, n_r = rt.agg(F.sum(F.size("_t")), F.count(F.lit(1))).first()
    n_left, nb = blocks.block_counts(lt.count(), n_r, 1, spark, least_rows=1 << 30)
    nb = max(nb, -(-(nnz or 0) * 64 // blocks.block_bytes(spark)), min(-(-spark.sparkContext.defaultParallelism // n_left), n_r // 512 + 1))
    budget = blocks.block_bytes(spark)
    schema = T.StructType([T.StructField(item, ttype), T.StructField("neighbor", ttype), T.StructField("sim", T.DoubleType())])

    def kern(lp, rp):
        rp = rp.sort_values(item, kind="stable")          # ties at equal similarity -> smaller id
        lq, lr = lp["_t"].map(len).to_numpy(), rp["_t"].map(len).to_numpy()
        tq, tr, wq, wr = (np.concatenate(p[c].to_list()) for c in ("_t", "_w") for p in (lp, rp))
        nq, nr = len(lp), len(rp)
        S = np.zeros((nq, nr))
        if len(tq) and len(tr):
            codes, _ = pd.factorize(np.concatenate([tq, tr]))
            S = blocks.sparse_dot_block(np.repeat(np.arange(nq), lq), codes[:len(tq)], wq, nq,
                                        np.repeat(np.arange(nr), lr), codes[len(tq):], wr, nr, budget)
        at, norm_q, norm_r = lp[fold].to_numpy(), blocks.pandas_matrix(lp["_n"]), blocks.pandas_matrix(rp["_n"])
        for f in np.unique(at):
            mine = np.flatnonzero(at == f)
            by = norm_q[mine, f][:, None] * norm_r[:, f][None, :]
            S[mine] = np.round(np.divide(S[mine], by, out=np.zeros_like(by), where=by > 0), 12)
            S[np.ix_(mine, np.flatnonzero(rp[fold].to_numpy() == f))] = -np.inf
        qi, ri, sims = blocks.best_columns(S, k)
        return pd.DataFrame({item: lp[item].to_numpy()[qi], "neighbor": rp[item].to_numpy()[ri], "sim": sims})

    part = blocks.cogroup_blocks(lt, rt, item, item, n_left, nb, kern, schema)
    w = Window.partitionBy(item).orderBy(F.col("sim").desc(), F.col("neighbor").asc())
    return part.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def knn_vote(neighbors: DataFrame, train_labels: DataFrame, item: str) -> DataFrame:
    """Distance-weighted vote per label (M6): predict a label when the weight
    of neighbours carrying it beats the weight of those that do not.  Weight
    = 1 / distance; if some neighbours are at distance 0, only they vote,
    each with weight 1.  Returns the predicted long (item, label) table."""
    d = F.round(F.lit(1.0) - F.col("sim"), 12)
    nb = neighbors.withColumn("_d", d)
    nb = nb.withColumn("_zero", F.max((F.col("_d") <= 0).cast("int")).over(Window.partitionBy(item)))
    nb = nb.withColumn("_wt", F.when(F.col("_zero") == 1, F.when(F.col("_d") <= 0, 1.0).otherwise(0.0))
                       .otherwise(F.lit(1.0) / F.col("_d")))
    total = nb.groupBy(item).agg(F.sum("_wt").alias("_tot"))
    tl = train_labels.select(F.col(item).alias("neighbor"), "label")
    pos = nb.join(tl, "neighbor").groupBy(item, "label").agg(F.sum("_wt").alias("_pos"))
    return (pos.join(total, item).filter(F.col("_pos") > F.col("_tot") - F.col("_pos"))
               .select(item, "label"))


# ------------------------------------------------------------- baseline (M8)

def random_prevalence(items_labels: DataFrame, items: DataFrame, item: str, seed: int) -> DataFrame:
    """Predict each (item, label) with probability = label prevalence, from a
    hashed uniform (reproducible): returns predicted long (item, label).
    Labels are held in blocks of ``MAX_LABELS``; an item meets each block in an
    equi-join and draws its labels inside it, so neither the plan nor the
    driver holds labels.  The blocks are repeated for salts of the items, so a
    block's items spread over as many tasks as their number asks for."""
    distinct = items.select(item).distinct()
    n = distinct.count()
    table = items_labels.where("label is not null").groupBy("label").agg((F.count(F.lit(1)) / F.lit(float(n))).alias("p"))
    drawn = F.filter("_labels", lambda x: hash_unit_of(seed, F.col(item), x["label"]) < x["p"])
    return blocks.meet_blocks(distinct, table, item, "label", MAX_LABELS, "_labels").select(
        item, F.explode(drawn).alias("_l")).select(item, F.col("_l.label").alias("label"))


# ------------------------------------------------------------- logistic (M5)

def ovr_logistic(train: DataFrame, test: DataFrame, item: str, features: str, train_labels: DataFrame,
                 classes: list, threads: int = 4, threshold: float = 0.5) -> DataFrame:
    """One balanced binary logistic regression per label (M5); returns the
    predicted long (item, label) table for ``test``.

    Weighted loss with the usual "balanced" weights n / (2 n_class), L2 with
    C = 1 (regParam = 1 / sum(w) = 1 / n), no standardisation.  A label with
    a single class in training predicts that class.  Fits run concurrently
    from a small thread pool over one cached feature table."""
    fitted = [(c, m, float(p > 0)) for c, m, n, p in ovr_fit(train, item, features, train_labels, classes, threads, threshold)]
    outs = []
    for c, model, const in fitted:
        if model is None:
            if const == 1.0:
                outs.append(test.select(item).withColumn("label", F.lit(c)))
            continue
        pr = model.transform(test.select(item, features)).filter(F.col("prediction") == 1.0)
        outs.append(pr.select(item).withColumn("label", F.lit(c)))
    if not outs:
        return test.select(item).withColumn("label", F.lit(None).cast("string")).limit(0)
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def _targets(train: DataFrame, item: str, features: str, train_labels: DataFrame, ycol: dict) -> DataFrame:
    """Features with a 0/1 column per class."""
    sets = train_labels.groupBy(item).agg(F.collect_set("label").alias("_ls"))   # per item: its few labels
    tr = train.select(item, features).join(sets, item, "left")
    return tr.select(item, features, *[F.coalesce(F.array_contains("_ls", F.lit(c)), F.lit(False)).cast("double").alias(y)
                                       for c, y in ycol.items()])


def ovr_fit(train: DataFrame, item: str, features: str, train_labels: DataFrame, classes: list, threads: int = 4,
            threshold: float = 0.5) -> list[tuple]:
    """(class, model or None, rows, positives) of every class; None where a class is all or nothing."""
    from pyspark.ml.classification import LogisticRegression

    ycol = {c: f"_y{i}" for i, c in enumerate(classes)}
    cores = train.sparkSession.sparkContext.defaultParallelism   # every iteration of every fit is a job over these tasks
    tr = _targets(train, item, features, train_labels, ycol).coalesce(cores).persist(StorageLevel.MEMORY_AND_DISK)
    counts = tr.agg(F.count(F.lit(1)), *[F.sum(y) for y in ycol.values()]).first()   # one pass, all classes
    n = counts[0]
    n_pos = {c: int(counts[i + 1] or 0) for i, c in enumerate(classes)}

    def fit_one(c):
        y, p = ycol[c], n_pos[c]
        if p == 0 or p == n:
            return c, None, n, p
        w_pos, w_neg = n / (2.0 * p), n / (2.0 * (n - p))
        data = tr.select(features, F.col(y).alias("y"),
                         F.when(F.col(y) == 1.0, w_pos).otherwise(w_neg).alias("w"))
        lr = LogisticRegression(featuresCol=features, labelCol="y", weightCol="w", regParam=1.0 / n,
                                elasticNetParam=0.0, standardization=False, maxIter=1000,
                                threshold=threshold)
        return c, lr.fit(data), n, p

    with ThreadPoolExecutor(max_workers=threads) as ex:
        fitted = list(ex.map(fit_one, classes))
    tr.unpersist()
    return fitted


def logistic_gradients(train: DataFrame, item: str, features: str, train_labels: DataFrame, classes: list) -> list[tuple]:
    """(class, rows, positives, largest component of the loss's gradient) at each fitted model."""
    from pyspark.ml.functions import vector_to_array
    ycol = {c: f"_y{i}" for i, c in enumerate(classes)}
    tr = _targets(train, item, features, train_labels, ycol).withColumn("_x", vector_to_array(features))
    out = []
    for c, model, n, p in ovr_fit(train, item, features, train_labels, classes):
        if model is None:
            out.append((c, n, p, 0.0))
            continue
        beta, b0 = [float(x) for x in model.coefficients], float(model.intercept)
        z = F.aggregate(F.zip_with("_x", F.array(*[F.lit(x) for x in beta]), lambda x, w: x * w), F.lit(b0), lambda s, x: s + x)
        y = F.col(ycol[c])
        r = F.when(y == 1.0, n / (2.0 * p)).otherwise(n / (2.0 * (n - p))) * (1 / (1 + F.exp(-z)) - y)
        got = tr.withColumn("_r", r).agg(F.avg("_r"), *[F.avg(F.col("_r") * F.get("_x", F.lit(j))) for j in range(len(beta))]).first()
        grad = [got[0]] + [g + w / n for g, w in zip(got[1:], beta)]
        out.append((c, n, p, max(abs(g) for g in grad)))
    return out
