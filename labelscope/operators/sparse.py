"""Sparse text features as long tables (X1-X9, V3, V4/V5 sparse).

A document-term matrix is a DataFrame ``(item, term, weight)``; a fitted
vectoriser is ``(term, df, idf)``.  Term generation is per-row array work
(regexp tokens, stop-word filter, adjacent bigrams) -- no shuffle; the only
shuffles are the (item, term) count, the document frequency per term, the
vocabulary join (broadcast by AQE when small) and the per-item norm.

Weights follow the usual smoothed TF-IDF: ``tf' = 1 + ln(tf)`` (sublinear),
``idf = ln((1 + n) / (1 + df)) + 1``, rows L2-normalised; a term is kept when
``min_df <= df <= max_df`` (fractions are taken of n).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscope.functions.stopwords import STOP_WORDS_EN
from labelscope.functions.text import ngrams, tokens
from labelscope.operators import blocks
from labelscope.operators.order_stats import next_in_group, numbered
from labelscope.session import cut_lineage

LABEL_BLOCK = 64   # labels whose centroid entries of a term share one row


def doc_tokens(df: DataFrame, item: str, text: str, stop_words=STOP_WORDS_EN) -> DataFrame:
    """(item, pos, token) rows (X1, X2); pos counts surviving tokens from 0."""
    return df.select(item, F.posexplode(tokens(text, stop_words)).alias("pos", "token"))


def doc_ngrams(df: DataFrame, item: str, text: str, stop_words=STOP_WORDS_EN,
               bigrams: bool = True) -> DataFrame:
    """(item, term) rows: unigrams and adjacent bigrams formed after stop-word
    removal (X3), one row per occurrence."""
    toks = df.select(item, tokens(text, stop_words).alias("_t"))
    terms = ngrams("_t") if bigrams else F.col("_t")
    return toks.select(item, F.explode(terms).alias("term"))


DEAL_BYTES = 16 * 1024 * 1024   # bytes of text in a task that cuts it into n-grams


def _parts(df: DataFrame, text: str) -> int:
    """How many tasks ``DEAL_BYTES`` of the texts each make."""
    return int((df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) // DEAL_BYTES) + 1


def dealt(df: DataFrame, item: str, text: str, parts: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(item, text and ``keep``) in tasks of bounded text, whatever the files' row groups:
    n-grams take many times the memory of their text.  A scan in small enough
    pieces stays as it is."""
    parts = parts or _parts(df, text)
    rows = df.select(item, text, *keep)
    return rows if rows.rdd.getNumPartitions() * 2 >= parts else rows.repartition(parts, F.col(item))


def _row_counts(df: DataFrame, item: str, text: str, stop_words, bigrams: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """(item, keep, term, tf) of every row by itself: a text's sorted n-grams are cut
    into runs inside the row, so nothing is kept between rows."""
    starts = _run_starts(df, text, stop_words, bigrams, (item, *keep))
    runs = F.transform("_i", lambda at, k: F.struct(F.get("_g", at).alias("term"), _run_length(at, k).cast("long").alias("tf")))
    return starts.select(item, *keep, F.inline(runs))


def _run_starts(df: DataFrame, text: str, stop_words, bigrams: bool, keep: tuple[str, ...]) -> DataFrame:
    """(keep, _g, _i): a text's sorted n-grams, and where each new one begins."""
    toks = df.select(*keep, tokens(text, stop_words).alias("_t"))
    grams = toks.select(*keep, F.sort_array(ngrams("_t") if bigrams else F.col("_t")).alias("_g"))
    return grams.select(*keep, "_g", F.filter(
        F.transform("_g", lambda x, i: F.when((i == 0) | (F.get("_g", i - 1) != x), i)), lambda i: i.isNotNull()).alias("_i"))


def _run_length(at, k):
    return F.coalesce(F.get("_i", k + 1), F.size("_g")) - at


def term_counts(df: DataFrame, item: str, text: str, stop_words=STOP_WORDS_EN,
                bigrams: bool = True, unique: bool = False, parts: int | None = None,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """(item, term, tf) (X4 input).  A text is counted inside its row; only the
    counts of items with several rows are added up in a shuffle.  ``unique``:
    the caller knows that there is none, and may have the columns ``keep`` kept."""
    if unique:
        return _row_counts(dealt(df, item, text, parts, keep), item, text, stop_words, bigrams, keep)
    rows = dealt(df, item, text, parts)
    again = cut_lineage(df.groupBy(F.col(item).alias("_i")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_i"), "repeated-items")
    if again.isEmpty():
        return _row_counts(rows, item, text, stop_words, bigrams)
    same = F.col(item).eqNullSafe(F.col("_i"))
    several = _row_counts(rows.join(again, same, "left_semi"), item, text, stop_words, bigrams).groupBy(item, "term").agg(F.sum("tf").alias("tf"))
    return _row_counts(rows.join(again, same, "left_anti"), item, text, stop_words, bigrams).unionByName(several)


def _bound(v, n):
    return float(v) * n if isinstance(v, float) else float(v)


def fit_vocabulary(tf: DataFrame, n_docs: int, min_df=1, max_df=1.0, present=None) -> DataFrame:
    """(term, df, idf) of the kept terms (X5, X6).  ``df`` is counted with a
    partial aggregate, so a term present in most documents is no hot key.
    ``present``: what is not null in a row that counts (default: every row)."""
    lo, hi = _bound(min_df, n_docs), _bound(max_df, n_docs)
    dfs = tf.groupBy("term").agg(F.count(F.lit(1) if present is None else present).alias("df"))
    return (dfs.filter((F.col("df") >= lo) & (F.col("df") <= hi))
               .withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0))


def weigh(tf: DataFrame, vocab: DataFrame, item: str, sublinear: bool = True,
          norm: bool = True) -> DataFrame:
    """(item, term, weight): tf' x idf over the vocabulary, rows L2-normalised.
    The unnormalised weights are stored, as the norms -- a key-sized aggregate
    joined back, so a group holding most of the terms is summed map-side -- read
    them too.  For items that are single texts: :func:`weigh_items`."""
    w = _raw_weights(tf, vocab, item, sublinear)
    if not norm:
        return w
    w = cut_lineage(w, "raw-weights")
    nrm = key_sized(w.groupBy(item).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_nrm")), "norms")
    return w.join(nrm, item).select(item, "term", (F.col("weight") / F.col("_nrm")).alias("weight"))


def key_sized(df: DataFrame, name: str) -> DataFrame:
    """``df``, a row a group or label, stored; sent to the rows that it is joined
    to, which are many more, as long as it fits ``labelscope.kernel.broadcastBytes``."""
    table = cut_lineage(df, name)
    return F.broadcast(table) if table.count() * 64 <= blocks.broadcast_limit(df.sparkSession) else table


def _raw_weights(tf: DataFrame, vocab: DataFrame, item: str, sublinear: bool) -> DataFrame:
    tfw = F.lit(1.0) + F.log(F.col("tf")) if sublinear else F.col("tf").cast("double")
    return tf.join(vocab.select("term", "idf"), "term", "inner").select(item, "term", (tfw * F.col("idf")).alias("weight"))


def weigh_items(tf: DataFrame, vocab: DataFrame, item: str, sublinear: bool = True) -> DataFrame:
    """:func:`weigh` where an item is one text: its terms meet in one row, which
    is normalised and opened again, so the weights are computed once."""
    rows = _raw_weights(tf, vocab, item, sublinear).groupBy(item).agg(F.collect_list(F.struct("term", "weight")).alias("_t"))
    rows = rows.withColumn("_nrm", F.sqrt(F.aggregate("_t", F.lit(0.0), lambda s, t: s + t["weight"] * t["weight"])))
    return rows.select(item, "_nrm", F.explode("_t").alias("_e")).select(
        item, F.col("_e.term").alias("term"), (F.col("_e.weight") / F.col("_nrm")).alias("weight"))


def tfidf_fit_transform(df: DataFrame, item: str, text: str, min_df=1, max_df=1.0,
                        stop_words=STOP_WORDS_EN, sublinear: bool = True,
                        bigrams: bool = True, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Fit a vocabulary on ``df`` and weight its rows (X7).  Returns
    ``(weights, vocab)``; ``n`` is the number of input rows (documents), one
    per item -- a repeated item raises, as its terms would count twice.
    Callers that read the weights several times cache them.  ``keep``: columns
    of ``df`` that the weights' rows carry along.

    The texts are dealt to parts of ``DEAL_BYTES``.  A part sends each of its
    terms once, with the number of its texts that hold it, and gets the kept ones
    back with their idf; the weights are made beside the part's texts, so that
    neither counts nor weights are shuffled."""
    n_docs, n_items = df.agg(F.count(F.lit(1)), F.count_distinct(item)).first()
    if n_items != n_docs:
        raise ValueError(f"tfidf_fit_transform: {item} is not unique; keep one row per item")
    parts = max(_parts(df, text), df.sparkSession.sparkContext.defaultParallelism if n_docs else 1)
    vocab = fit_vocabulary(term_counts(df, item, text, stop_words, bigrams, unique=True, parts=parts), n_docs, min_df, max_df)

    dealt_texts = df.select(item, text, *keep, F.pmod(F.xxhash64(item), F.lit(parts)).cast("int").alias("_p")).repartition(parts, "_p")
    texts = _run_starts(dealt_texts, text, stop_words, bigrams, ("_p", item, *keep)).select(
        "_p", item, *keep, F.transform("_i", lambda at: F.get("_g", at)).alias("_t"), F.transform("_i", _run_length).alias("_f"))
    lo, hi = _bound(min_df, n_docs), _bound(max_df, n_docs)
    def count(rows: pa.Table) -> pa.Table:
        found = pc.value_counts(pc.list_flatten(rows["_t"].combine_chunks()))
        return pa.table({"_p": pa.array(np.full(len(found), rows["_p"][0].as_py()), pa.int32()), "term": found.field("values"), "_c": found.field("counts")})

    held = texts.groupBy("_p").applyInArrow(count, "_p int, term string, _c long")   # the texts' shuffle is the weights' one
    # a row a part and term: no term is a hot key
    idfs = held.withColumn("_df", F.sum("_c").over(Window.partitionBy("term"))).where((F.col("_df") >= lo) & (F.col("_df") <= hi)).select(
        "_p", "term", (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("_df"))) + 1.0).alias("idf"))
    schema = T.StructType([df.schema[c] for c in (item, *keep)] + [T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    def kern(rows: pa.Table, table: pa.Table) -> pa.Table:
        lists = rows["_t"].combine_chunks()
        lens, terms = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), pc.list_flatten(lists)
        at = pc.index_in(terms, value_set=table["term"].combine_chunks())
        known = at.is_valid()
        idf = table["idf"].to_numpy()[at.drop_null().to_numpy(zero_copy_only=False)]
        tf = pc.list_flatten(rows["_f"].combine_chunks()).filter(known).to_numpy(zero_copy_only=False)
        weight = (1.0 + np.log(tf) if sublinear else tf.astype(float)) * idf
        row = np.repeat(np.arange(len(rows)), lens)[known.to_numpy(zero_copy_only=False)]
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(rows)))
        kept = rows.select([item, *keep]).take(pa.array(row))
        return kept.append_column("term", terms.filter(known)).append_column("weight", pa.array(weight / norm[row]))

    weights = texts.groupBy("_p").cogroup(idfs.groupBy("_p")).applyInArrow(kern, schema)
    return weights, vocab


def tfidf_fit_counts(tf: DataFrame, n_docs: int, item: str, min_df=1, max_df=1.0,
                     sublinear: bool = True) -> tuple[DataFrame, DataFrame]:
    """Fit and weight from precomputed ``(item, term, tf)`` counts (lets
    cross-validation tokenise every document once for all folds)."""
    vocab = fit_vocabulary(tf, n_docs, min_df, max_df)
    return weigh_items(tf, vocab, item, sublinear), vocab


def tfidf_transform(df: DataFrame, vocab: DataFrame, item: str, text: str,
                    stop_words=STOP_WORDS_EN, sublinear: bool = True,
                    bigrams: bool = True) -> DataFrame:
    """Weight new rows with a fitted ``(term, idf)`` table."""
    return weigh_items(term_counts(df, item, text, stop_words, bigrams), vocab, item, sublinear)


def group_term_counts(df: DataFrame, group: str, text: str, order_by: str,
                      stop_words=STOP_WORDS_EN) -> DataFrame:
    """(group, term, tf) for the concatenation of each group's texts in
    ``order_by`` order: per-text n-grams plus the bigram that joins the last
    token of a text to the first token of the next non-empty text.

    A text is counted inside its row.  The counts are dealt by term, which serves
    their sums and all that is worked out per term after them."""
    parts = _parts(df, text)
    texts = dealt(df, order_by, text, parts, keep=(group,))
    toks = texts.select(group, order_by, tokens(text, stop_words).alias("_t"))
    inner = _row_counts(texts, group, text, stop_words, True)
    ends = (toks.filter(F.size("_t") > 0)
                .select(group, order_by, F.element_at("_t", 1).alias("_first"),
                        F.element_at("_t", -1).alias("_last")))
    border = (next_in_group(ends, group, order_by, ["_first"], prefix="_next")
              .filter(F.col("_next_first").isNotNull())
              .select(group, F.concat("_last", F.lit(" "), "_next_first").alias("term"), F.lit(1).cast("long").alias("tf")))
    by_term = inner.unionByName(border).repartition(max(2 * parts, df.sparkSession.sparkContext.defaultParallelism), "term")
    return by_term.groupBy(group, "term").agg(F.sum("tf").alias("tf"))


def top_terms(weights: DataFrame, group: str, k: int, score: str = "weight") -> DataFrame:
    """Top ``k`` positive-score terms per group with rank 1..k (W4); ties by
    term.  ``row_number <= k`` runs as a window group limit (partial top-k
    before the shuffle)."""
    w = Window.partitionBy(group).orderBy(F.round(F.col(score), 9).desc(), F.col("term").asc())
    return (weights.filter(F.col(score) > 0)
                   .withColumn("rank", F.row_number().over(w))
                   .filter(F.col("rank") <= k))


def top_ngrams(df: DataFrame, group: str, text: str, order_by: str, k: int = 7,
               titles: DataFrame | None = None, title: str | None = None,
               min_df=2, max_df=0.9, stop_words=STOP_WORDS_EN) -> DataFrame:
    """Top TF-IDF n-grams of each group's concatenated text (X9):
    (group, term, score, rank[, title]).  Groups whose text has no kept term
    are skipped; scores are never padded with zero-score terms."""
    n_groups = df.select(group).distinct().count()
    tf = group_term_counts(df, group, text, order_by, stop_words)
    # all lies by term; the vocabulary reads the counts and groups too, so that both sides of the join are one shuffle
    present = F.when(F.col("tf") > 0, F.coalesce(F.col(group).cast("string"), F.lit("")))
    vocab = fit_vocabulary(tf, n_groups, min_df, max_df, present)
    w = weigh(tf, vocab, group).withColumnRenamed("weight", "score")
    top = top_terms(w, group, k, "score")
    if titles is not None:
        from labelscope.operators.prep import dedupe_keep
        t = dedupe_keep(titles.select(group, title).filter(F.col(title).isNotNull()), [group], [title])
        top = top.join(t, group, "left")
    return top


# ------------------------------------------------------------ sparse centroids

def sparse_centroids(weights: DataFrame, labels: DataFrame, item: str, label: str,
                     eps: float = 1e-12) -> DataFrame:
    """(label, term, centroid): mean TF-IDF row over *all* items of the label
    (items without terms count in n), renormalised to unit length (V3)."""
    n_lab = key_sized(labels.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "label-sizes")
    sums = (labelled(weights, labels, item, label)
                   .groupBy(label, "term").agg(F.sum("weight").alias("_s")))
    mean = cut_lineage(sums.join(n_lab, label).select(label, "term", (F.col("_s") / F.col("_n")).alias("_m")), "means")   # the norms read it too
    nrm = key_sized(mean.groupBy(label).agg((F.sqrt(F.sum(F.col("_m") * F.col("_m"))) + F.lit(eps)).alias("_nrm")), "label-norms")
    return mean.join(nrm, label).select(label, "term", (F.col("_m") / F.col("_nrm")).alias("centroid"))


def labelled(weights: DataFrame, labels: DataFrame, item: str, label: str) -> DataFrame:
    """``weights`` with the items' labels, as they are where they carry them (one label an item)."""
    return weights if label in weights.columns else weights.join(labels.select(item, label), item, "inner")


def own_distance_sparse(weights: DataFrame, labels: DataFrame, centroids: DataFrame,
                        item: str, label: str, out: str = "dist_tfidf", matches: tuple | None = None) -> DataFrame:
    """1 - cosine similarity of each (item, label) row to its label centroid
    (V4, sparse).  Left joins: an item with no term, or none in common with
    the centroid, has distance 1.0.  ``matches``: :func:`centroid_matches`,
    where the nearest centroids are asked for too."""
    if matches is None:
        lw = labelled(weights, labels, item, label)
        dots = (_gathered(lw.join(centroids, [label, "term"], "inner"))
                  .groupBy(item, label).agg(F.sum(F.col("weight") * F.col("centroid")).alias("_dot")))
    else:
        found, index = matches
        dots = found.select(item, F.inline("own")).join(index, "ix").drop("ix")
    return (labels.select(item, label).join(dots, [item, label], "left")
                  .select(item, label, (F.lit(1.0) - F.coalesce("_dot", F.lit(0.0))).alias(out)))


def label_blocks(centroids: DataFrame, label: str, block: int = LABEL_BLOCK) -> tuple[DataFrame, DataFrame]:
    """((term, block, entries), (label, ix)): every term's centroid entries as one
    array of (ix, centroid) per block of ``block`` successive labels that hold it."""
    index = cut_lineage(numbered(centroids.select(label).distinct(), [], [label], "ix"), "label-index")
    placed = centroids.join(index, label).groupBy("term", F.floor(F.col("ix") / block).cast("int").alias("block")).agg(
        F.collect_list(F.struct(F.col("ix").cast("int").alias("ix"), "centroid")).alias("entries"))
    return cut_lineage(placed, "label-blocks"), index


def _gathered(products: DataFrame) -> DataFrame:
    """The products that a join by term makes, in a task a core.  A task leaves a
    sum for each item that it meets, so with many tasks nearly every product were
    a sum of its own; nothing is shuffled for it."""
    return products.coalesce(products.sparkSession.sparkContext.defaultParallelism)


def _similarities(weights: DataFrame, entries: DataFrame, item: str) -> DataFrame:
    """(item, ix, _s): what each item has in common with the centroids, summed before it is shuffled."""
    products = _gathered(weights.join(entries, "term")).select(item, "weight", F.inline("entries"))
    return products.groupBy(item, "ix").agg(F.sum(F.col("weight") * F.col("centroid")).alias("_s"))


def _best(ix: str, s: str):
    return F.min(F.when(F.round(s, 12) > 0, F.struct((-F.round(s, 12)).alias("s"), ix)))


def centroid_matches(weights: DataFrame, labels: DataFrame, centroids: DataFrame, item: str, label: str,
                     block: int = LABEL_BLOCK) -> tuple[DataFrame, DataFrame]:
    """((item, _b, own), (label, ix)), stored: the best centroid and the similarities
    to an item's own labels, from one pass of the weights over the centroids."""
    entries, index = label_blocks(centroids, label, block)
    own = labels.join(index, label).groupBy(item).agg(F.collect_set(F.col("ix").cast("int")).alias("_own"))
    sums = _similarities(weights, entries, item).join(own, item, "left")
    found = sums.groupBy(item).agg(_best("ix", "_s").alias("_b"), F.collect_list(
        F.when(F.array_contains("_own", F.col("ix")), F.struct("ix", F.col("_s").alias("_dot")))).alias("own"))
    return cut_lineage(found, "matches"), index


def nearest_centroid_sparse(weights: DataFrame, items: DataFrame, centroids: DataFrame,
                            item: str, label: str, out_label: str = "nearest_label",
                            out_dist: str = "nearest_dist", block: int = LABEL_BLOCK,
                            matches: tuple | None = None) -> DataFrame:
    """Most similar label centroid for every item of ``items`` (V5, sparse).

    ``items`` are (item, label) rows: every label of theirs takes part, also
    one whose centroid has no kept term.  Similarities are rounded to 12
    digits; ties and items with no shared term go to the smallest label
    (distance 1.0).

    One way at every size: each term's centroid entries are an array per block of
    labels, an item's terms meet them in a join, and one sum per (item, label) --
    combined before it is shuffled -- gives the similarities, of which only the
    best of an item goes on.  ``matches``: :func:`centroid_matches`, where
    the own distances are asked for too.
    """
    label_type = centroids.schema[label].dataType
    first = items.agg(F.min(label)).first()[0]
    if matches is None:
        entries, index = label_blocks(centroids, label, block)
        best = _similarities(weights, entries, item).groupBy(item).agg(_best("ix", "_s").alias("_b"))
    else:
        best, index = matches
    best = best.where("_b is not null").select(item, F.col("_b.ix").alias("ix"), (F.lit(1.0) + F.col("_b.s")).alias(out_dist))
    best = best.join(index.withColumnRenamed(label, out_label), "ix").drop("ix")
    # items without any weighted term: smallest label, distance 1.0
    return (items.select(item).distinct().join(best, item, "left")
                 .select(item, F.coalesce(F.col(out_label), F.lit(first).cast(label_type)).alias(out_label),
                         F.coalesce(F.col(out_dist), F.lit(1.0)).alias(out_dist)))


def fold_idfs(tf: DataFrame, fold: str, fold_sizes: dict, min_df=1, max_df=1.0) -> DataFrame:
    """(term, _idfs): the idf of every fold's training items as an array by fold,
    null where the term is not in the fold's vocabulary; terms of no vocabulary left out."""
    folds = sorted(fold_sizes)
    if folds != list(range(len(folds))):
        raise ValueError("folds must be numbered 0..k-1")
    n_all = sum(fold_sizes.values())
    fl = F.array(*[F.lit(f) for f in folds])
    n_train = F.array(*[F.lit(float(n_all - fold_sizes[f])) for f in folds])
    counted = tf.groupBy("term").agg(*[F.count_if(F.col(fold) == f).alias(f"_df{f}") for f in folds])   # one shuffle, a row a term
    per_term = counted.select("term", F.array(*[F.col(f"_df{f}") for f in folds]).alias("_d"))
    dfa = F.aggregate("_d", F.lit(0).cast("long"), lambda a, x: a + x)

    def idf_of(f):
        n = F.element_at(n_train, f + 1)
        d = F.col("_dfa") - F.get("_d", f)
        lo = n * float(min_df) if isinstance(min_df, float) else F.lit(float(min_df))
        hi = n * float(max_df) if isinstance(max_df, float) else F.lit(float(max_df))
        return F.when((d > 0) & (d >= lo) & (d <= hi),
                      F.log((F.lit(1.0) + n) / (F.lit(1.0) + d)) + 1.0)

    idfs = per_term.withColumn("_dfa", dfa).select("term", F.transform(fl, idf_of).alias("_idfs"))
    return idfs.where(F.exists("_idfs", lambda x: x.isNotNull()))


def tfidf_folds(tf: DataFrame, item: str, fold: str, fold_sizes: dict, min_df=1, max_df=1.0,
                sublinear: bool = True) -> tuple[DataFrame, DataFrame]:
    """TF-IDF for every cross-validation fold in one plan.

    ``tf`` is ``(item, fold, term, tf)`` with each item in one fold and folds
    numbered 0..k-1.  For fold f the vocabulary is fitted on the items of the
    other folds only: df_train(f, t) = df_all(t) - df_in(f, t), from one
    partial aggregate per (fold, term).  Every term gets one row with the
    array of its k fold idfs (null where the term is not in that fold's
    vocabulary), so each (item, term) row is joined once; an item's terms are
    stored as one row, fanned out to the folds it trains.  Returns
    ``(train_w, test_w)`` as ``(_f, item, ix, term, weight)``, ix the term's number.
    """
    rows, _ = fold_rows(tf, item, fold, fold_sizes, min_df, max_df, sublinear)
    return tuple(opened(packed_weights(rows, item, fold, fold_sizes, test), item) for test in (False, True))


def fold_rows(tf: DataFrame, item: str, fold: str, fold_sizes: dict, min_df=1, max_df=1.0,
              sublinear: bool = True) -> tuple[DataFrame, DataFrame]:
    """((item, fold, _t), (term, ix)), stored: an item's terms met with the folds'
    idfs once, as one row of (ix, term, tf', idfs) in the order of ix."""
    idfs = cut_lineage(fold_idfs(tf, fold, fold_sizes, min_df, max_df), "idfs")   # the ranges of the numbering are sampled from it first
    vocab = cut_lineage(numbered(idfs, [], ["term"], "ix").withColumn("ix", F.col("ix").cast("int")), "terms")
    tfw = F.lit(1.0) + F.log(F.col("tf")) if sublinear else F.col("tf").cast("double")
    rows = tf.join(vocab, "term").select(item, fold, F.struct("ix", "term", tfw.alias("tfw"), "_idfs").alias("_e"))
    return cut_lineage(rows.groupBy(item, fold).agg(F.array_sort(F.collect_list("_e")).alias("_t")), "fold-terms"), vocab.select("term", "ix")


def packed_weights(rows: DataFrame, item: str, fold: str, fold_sizes: dict, test: bool) -> DataFrame:
    """(_f, item, _t): the weights (ix, term, weight) of an item in each fold that it
    trains, or in the one that it tests.  Weighed and normalised inside the row."""
    others = F.array_remove(F.array(*[F.lit(f) for f in sorted(fold_sizes)]), F.col(fold))
    met = rows.select((F.col(fold) if test else F.explode(others)).alias("_f"), item, "_t")
    weight = lambda e: e["tfw"] * F.get(e["_idfs"], F.col("_f"))
    kept = F.filter(F.transform("_t", lambda e: F.struct(e["ix"].alias("ix"), e["term"].alias("term"), weight(e).alias("weight"))),
                    lambda e: e["weight"].isNotNull())
    alone = lambda *c: F.inline(F.array(F.struct(*c)))  # noqa: E731   a row of its own, so that the norm is not taken for each weight again
    met = met.select("_f", item, alone(kept.alias("_t"))).where(F.size("_t") > 0)
    met = met.select("_f", item, alone("_t", F.sqrt(F.aggregate("_t", F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"])).alias("_nrm")))
    return met.select("_f", item, F.transform("_t", lambda e: F.struct(
        e["ix"].alias("ix"), e["term"].alias("term"), (e["weight"] / F.col("_nrm")).alias("weight"))).alias("_t"))


def opened(packed: DataFrame, item: str) -> DataFrame:
    """(_f, item, ix, term, weight) of packed weights."""
    return packed.select("_f", item, F.inline("_t"))
