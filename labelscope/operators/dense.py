"""Dense-vector operators: unit vectors, centroids, cosine distances, the
nearest centroid (V1, V2, V4, V5, V6, J3, J4, J5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelscope.functions.vector import as_double_array, dot, unit_norm
from labelscope.operators import blocks


def unit_vectors(df: DataFrame, vec: str = "embedding", out: str | None = None) -> DataFrame:
    """L2-normalise each row's vector (V1); computed in double precision."""
    return df.withColumn(out or vec, unit_norm(as_double_array(vec)))


def align_vectors(rows: DataFrame, vectors: DataFrame, id_col: str, vec: str = "embedding",
                  normalize: bool = True, validate: bool = True) -> DataFrame:
    """Attach one vector per id to every row (J3).  With ``validate`` a repeated
    vector id or a row without a vector raises; without it, rows that have no
    vector are dropped (``quality.unmatched_vectors`` lists them, Q8)."""
    v = vectors.select(id_col, vec)
    if validate:
        from labelscope.operators.prep import ValidationError, assert_unique
        assert_unique(v, [id_col], "vectors")
        lost = rows.join(v, id_col, "left_anti").limit(1).collect()
        if lost:
            raise ValidationError(f"no vector for {id_col} = {lost[0][id_col]}")
    out = rows.join(v, id_col, "inner")
    return unit_vectors(out, vec) if normalize else out


def dense_centroids(df: DataFrame, label: str = "label", vec: str = "embedding",
                    eps: float = 1e-12) -> DataFrame:
    """Mean vector per label, divided by (its norm + eps) (V2).

    One pass with ``Summarizer.mean`` (partial aggregation, no explode), so a
    label holding a third of the rows is combined map-side like any other.
    """
    means = (df.select(label, array_to_vector(as_double_array(vec)).alias("_v"))
             .groupBy(label)
             .agg(Summarizer.mean(F.col("_v")).alias("_m")))
    return means.select(label, unit_norm(vector_to_array("_m"), eps).alias("centroid"))


def own_distance(df: DataFrame, centroids: DataFrame, label: str = "label",
                 vec: str = "embedding", out: str = "dist") -> DataFrame:
    """Cosine distance ``1 - v.c`` of each row to its own label's centroid.

    The centroid table has one row per label; AQE turns the join into a
    broadcast hash join when its runtime size is under the threshold.
    """
    c = centroids.select(label, F.col("centroid").alias("_c"))
    return (df.join(c, label, "left")
              .withColumn(out, F.lit(1.0) - dot(vec, "_c"))
              .drop("_c"))


def _centroid_matrix(centroids: DataFrame, label: str):
    pdf = centroids.select(label, "centroid").orderBy(label).toPandas()
    labels = pdf[label].to_numpy()
    C = blocks.pandas_matrix(pdf["centroid"]) if len(pdf) else np.zeros((0, 0))
    return labels, C


def nearest_centroid(df: DataFrame, centroids: DataFrame, item: str, label: str = "label",
                     vec: str = "embedding", out_label: str = "nearest_label",
                     out_dist: str = "nearest_dist") -> DataFrame:
    """Best centroid by cosine similarity for every row.

    Returns ``(item, out_label, out_dist)``.  Ties go to the smallest label;
    an all-zero vector gets the smallest label and distance 1.0.
    Only the ``n x 1`` best survives a block: the ``n x L`` similarity
    matrix is never materialised.
    """
    spark = df.sparkSession
    label_type = centroids.schema[label].dataType
    item_type = df.schema[item].dataType
    schema = T.StructType([T.StructField(item, item_type), T.StructField(out_label, label_type),
                           T.StructField(out_dist, T.DoubleType())])
    # size check first (one aggregate), then at most that many rows are collected
    n_lab, width = centroids.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    width = width or 0
    if n_lab * max(width, 1) * 8 <= blocks.broadcast_limit(spark):
        labels, C = _centroid_matrix(centroids, label)
        bc = spark.sparkContext.broadcast((labels, C))

        def kern(batches):
            labs, Cm = bc.value
            for b in batches:
                if b.num_rows == 0:
                    continue
                V = blocks.arrow_matrix(b.column(1))
                S = np.round(V @ Cm.T, 12)
                j = np.argmax(S, axis=1)
                best = S[np.arange(len(j)), j]
                yield blocks.to_batch(pd.DataFrame({
                    item: b.column(0).to_pandas(), out_label: labs[j],
                    out_dist: 1.0 - best}), schema)

        return (df.select(item, as_double_array(vec).alias("_v"))
                  .mapInArrow(kern, schema))
    # blocked form: best label per (item, centroid block), then min over blocks
    n_left, n_right = blocks.block_counts(df.count(), n_lab, width, spark)
    part_schema = T.StructType(schema.fields + [T.StructField("_sim", T.DoubleType())])

    def kern2(lp, rp):
        rp = rp.sort_values(label, kind="stable")
        V = blocks.pandas_matrix(lp["_v"])
        Cm = blocks.pandas_matrix(rp["centroid"])
        S = np.round(V @ Cm.T, 12)
        j = np.argmax(S, axis=1)
        best = S[np.arange(len(j)), j]
        return pd.DataFrame({item: lp[item].values, out_label: rp[label].values[j],
                             out_dist: 1.0 - best, "_sim": best})

    part = blocks.cogroup_blocks(df.select(item, as_double_array(vec).alias("_v")),
                                 centroids.select(label, "centroid"), item, label,
                                 n_left, n_right, kern2, part_schema)
    best = part.groupBy(item).agg(F.min(F.struct((-F.col("_sim")).alias("s"),
                                                 F.col(out_label).alias("l"))).alias("_b"))
    return best.select(item, F.col("_b.l").alias(out_label),
                       (F.lit(1.0) + F.col("_b.s")).alias(out_dist))


def first_vector_per_item(df: DataFrame, item: str, order_by: list[str]) -> DataFrame:
    """Item-level roll-up: the first row per item under an explicit order (V6)."""
    from labelscope.operators.prep import dedupe_keep
    return dedupe_keep(df, [item], order_by)
