"""Data-quality checks (Q1-Q9).  Checks that must stop a run raise; the
others return the offending rows as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.text import word_count
from labelscope.operators.prep import ValidationError


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Raise if any of ``cols`` is missing (schema only, no job) (Q2)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValidationError(f"missing columns {missing}")
    return df


def short_texts(df: DataFrame, text: str, max_words_exclusive: int = 6,
                len_col: str = "n_words") -> DataFrame:
    """Rows whose text has fewer than ``max_words_exclusive`` words (Q1)."""
    return (df.withColumn(len_col, word_count(text))
              .filter(F.col(len_col) < max_words_exclusive))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once with their count and the number of rows
    after the first (Q3)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
              .filter(F.col("n_rows") > 1)
              .withColumn("n_extra", F.col("n_rows") - 1))


def null_profile(df: DataFrame) -> DataFrame:
    """Null count of every column, long form (column, n_null), one pass (Q4)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null"))
                      for c in df.columns])
    return row.select(F.inline(pairs))


def describe(df: DataFrame, col: str) -> DataFrame:
    """count / mean / sample std / min / exact quartiles / max of one column (Q5)."""
    from labelscope.operators.order_stats import quantiles, rank_table
    x = F.col(col).cast("double")
    v = df.select(x.alias("_x"))
    mom = v.agg(F.count("_x").alias("count"), F.avg("_x").alias("mean"),
                F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"),
                F.lit(0).alias("_all"))
    q = quantiles(rank_table(v, None, "_x"), None, "_x", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return mom.join(q, "_all", "left").select("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def one_to_one_violations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of ``a`` with more than one distinct ``b`` and vice versa (Q6):
    (side, key, n_distinct).  Empty means the mapping is one-to-one."""
    pairs = df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    left = (pairs.groupBy(a).agg(F.count(F.lit(1)).alias("n_distinct"))
                 .filter("n_distinct > 1")
                 .select(F.lit(a).alias("side"), F.col(a).cast("string").alias("key"), "n_distinct"))
    right = (pairs.groupBy(b).agg(F.count(F.lit(1)).alias("n_distinct"))
                  .filter("n_distinct > 1")
                  .select(F.lit(b).alias("side"), F.col(b).cast("string").alias("key"), "n_distinct"))
    return left.unionByName(right)


def is_one_to_one(df: DataFrame, a: str, b: str) -> bool:
    return one_to_one_violations(df, a, b).limit(1).count() == 0


def assert_no_null(df: DataFrame, col: str) -> DataFrame:
    """Raise with the count when ``col`` has nulls (Q7)."""
    n = df.filter(F.col(col).isNull()).count()
    if n:
        raise ValidationError(f"column {col} holds {n} nulls")
    return df


def unmatched_vectors(rows: DataFrame, vectors: DataFrame, row_id: str, vec_id: str) -> DataFrame:
    """Row ids that have no vector (Q8, left anti join)."""
    v = vectors.select(F.col(vec_id).alias(row_id))
    return rows.select(row_id).distinct().join(v, row_id, "left_anti")


def assert_aligned(rows: DataFrame, vectors: DataFrame, row_id: str, vec_id: str) -> None:
    """Raise when some row has no vector or an id has several vectors (Q8)."""
    missing = unmatched_vectors(rows, vectors, row_id, vec_id).limit(5).collect()
    if missing:
        raise ValidationError(f"{row_id} without a vector: {[r[0] for r in missing]} (first five)")
    dup = vectors.groupBy(vec_id).count().filter("count > 1").limit(1).collect()
    if dup:
        raise ValidationError(f"several vectors for id {dup[0][0]}")


def top_ambiguous(purity: DataFrame, text: str = "item_text", n: int = 5) -> DataFrame:
    """Texts mapped to more than one label, top ``n`` by label count (Q9)."""
    return (purity.filter(F.col("n_labels") > 1)
                  .orderBy(F.col("n_labels").desc(), F.col(text).asc())
                  .limit(n))
