"""Label quality: how far each item sits from its label's centroid, how
unusual that is within the label, and whether another label is nearer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.operators import dense, stats
from labelscope.session import cut_lineage


def dense_label_quality(df: DataFrame, item: str = "vec_id", label: str = "label",
                        vec: str = "embedding", prefix: str = "dense", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: own-centroid cosine distance, label size, z-score, average-rank
    percentile, label mean/std/median of the distance, nearest centroid,
    its distance and the mismatch flag.

    A row is an (item, label) pair and an item may have several labels; its
    vector is the item's.  The nearest centroid is found once per item, so the
    result has the rows of ``df``.  ``keep`` names columns to carry along.
    """
    unit = dense.unit_vectors(df.select(item, label, vec, *keep), vec)
    cents = dense.dense_centroids(unit, label, vec)
    dcol = f"dist_{prefix}"
    with_d = dense.own_distance(unit, cents, label, vec, dcol).drop(vec)
    # item-sized; the group statistics read it several times (moments, ranks, medians)
    with_d = cut_lineage(stats.group_size(with_d, label, f"n_{label}"), "distances")
    with_s = stats.add_group_stats(with_d, label, dcol, prefix)
    near = dense.nearest_centroid(unit.select(item, vec).dropDuplicates([item]), cents, item, label, vec,
                                  f"nearest_label_{prefix}", f"nearest_dist_{prefix}")
    out = (with_s.join(near, item, "left")
                 .withColumn(f"mismatch_{prefix}", F.col(f"nearest_label_{prefix}") != F.col(label)))
    return out


def both_measures_quality(df: DataFrame, item: str = "vec_id", label: str = "label",
                          title: str = "label_title", text: str = "text", vec: str = "embedding",
                          small_max: int = 7, high_z: float = 1.5, disagree_z: float = 1.5,
                          min_df=3, max_df=0.8) -> DataFrame:
    """The full distance table: for every (item, label) row the dense and the
    TF-IDF own-centroid distances with their label statistics, the nearest
    label under each measure with its title, and the outlier flags."""
    from labelscope.operators import sparse

    base = df.select(item, label, title, text, vec)
    dq = dense_label_quality(base, item, label, vec, "dense", keep=(title,))
    labs = base.select(item, label).distinct()
    # one text per item: the vocabulary counts an item once, whatever its number of labels
    texts = cut_lineage(base.select(item, text).dropDuplicates([item]), "texts")   # counted, and cut into n-grams for one shuffle
    w, _ = sparse.tfidf_fit_transform(texts, item, text, min_df, max_df)
    w = cut_lineage(w, "weights")   # read by the centroids, the distances and the nearest label
    cents = cut_lineage(sparse.sparse_centroids(w, labs, item, label), "centroids")
    matches = sparse.centroid_matches(w, labs, cents, item, label)   # both distances from one pass
    ds = cut_lineage(sparse.own_distance_sparse(w, labs, cents, item, label, "dist_tfidf", matches), "distances")
    ds = stats.add_group_stats(ds, label, "dist_tfidf", "tfidf")
    ns = sparse.nearest_centroid_sparse(w, labs, cents, item, label,
                                        "nearest_label_tfidf", "nearest_dist_tfidf", matches=matches)
    titles = base.select(label, title).filter(F.col(title).isNotNull()).distinct()
    from labelscope.operators.prep import dedupe_keep
    titles = dedupe_keep(titles, [label], [title])
    out = (dq.join(ds, [item, label]).join(ns, item)
             .withColumn("mismatch_tfidf", F.col("nearest_label_tfidf") != F.col(label)))
    for m in ("dense", "tfidf"):
        t = titles.select(F.col(label).alias(f"nearest_label_{m}"), F.col(title).alias(f"nearest_title_{m}"))
        out = out.join(t, f"nearest_label_{m}", "left")
    # every report (summary, flags, cross-tabs) reads this table
    return cut_lineage(stats.add_flags(out, f"n_{label}", small_max, high_z, disagree_z), "quality")
