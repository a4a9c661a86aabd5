"""Profiles, histograms and seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def table_profile(df: DataFrame, item: str, label: str, text: str | None = None) -> DataFrame:
    """Rows, distinct items, distinct labels (and texts) in one pass (A1)."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(item).alias("n_items"),
            F.count_distinct(label).alias("n_labels")]
    if text:
        aggs.append(F.count_distinct(text).alias("n_texts"))
    return df.agg(*aggs)


def distinct_per_group(df: DataFrame, group: str, col: str, out: str) -> DataFrame:
    """Distinct non-null ``col`` per ``group``, most first (A2)."""
    return (df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(col).alias(out))
              .orderBy(F.col(out).desc(), F.col(group).asc()))


def count_histogram(df: DataFrame, group: str, col: str, out: str = "n_groups",
                    value: str = "n") -> DataFrame:
    """Two-level aggregate: distinct ``col`` per group, then groups per value (A3)."""
    per = distinct_per_group(df, group, col, value)
    return per.groupBy(value).agg(F.count(F.lit(1)).alias(out))


def small_group_counts(sizes: DataFrame, size_col: str) -> DataFrame:
    """Groups of size 1, under 5, under 10 (A4)."""
    s = F.col(size_col)
    return sizes.agg(F.count_if(s == 1).alias("n_eq_1"), F.count_if(s < 5).alias("n_lt_5"),
                     F.count_if(s < 10).alias("n_lt_10"))


def text_purity(df: DataFrame, text: str, item: str, label: str) -> DataFrame:
    """Per distinct text: rows, distinct items, distinct labels, the sorted
    label set and whether it is pure (one label) (A6).  Pairs are made
    distinct first, so a text that very many rows share reaches its final
    aggregate as one row per label or item."""
    labels = df.groupBy(text, label).agg(F.count(F.lit(1)).alias("_n")).groupBy(text).agg(
        F.sum("_n").alias("n_rows"), F.count(label).alias("n_labels"), F.sort_array(F.collect_list(label)).alias("labels"))
    items = df.select(text, item).distinct().groupBy(text).agg(F.count(item).alias("n_items")).withColumnRenamed(text, "_t")
    return (labels.join(items, F.col(text).eqNullSafe(F.col("_t")))
              .select(text, "n_rows", "n_items", "n_labels", "labels", (F.col("n_labels") == 1).alias("pure")))


def purity_share(purity: DataFrame) -> DataFrame:
    """Pure / impure counts and the share of pure texts."""
    return purity.agg(F.count_if("pure").alias("n_pure"), F.count_if(~F.col("pure")).alias("n_impure"),
                      F.avg(F.col("pure").cast("double")).alias("share_pure"))


def group_sizes_top_bottom(df: DataFrame, group: str, n: int = 10) -> DataFrame:
    """Largest and smallest ``n`` groups by row count (A8): (group, n_rows, end).
    Ties: larger first, then group key ascending, in both lists; rows without a group are left out."""
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    top = sizes.orderBy(F.col("n_rows").desc(), F.col(group).asc()).limit(n) \
               .withColumn("end", F.lit("largest"))
    bottom = sizes.orderBy(F.col("n_rows").asc(), F.col(group).desc()).limit(n) \
                  .withColumn("end", F.lit("smallest"))
    return top.unionByName(bottom)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed, empty bins kept
    (A15): (bin, lo, hi, n).  A constant column gets the unit range around it."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).select(
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    lo, hi = rng.first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin long, lo double, hi double, n long")
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1))
    counts = df.filter(x.isNotNull()).groupBy(b.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(lo) + F.col("id") * F.lit(hi - lo) / F.lit(bins)).alias("lo"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(hi - lo) / F.lit(bins)).alias("hi"))
    return edges.join(counts, "bin", "left").na.fill(0, ["n"])


def seeded_hash(seed: int, *cols) -> "F.Column":
    """Reproducible pseudo-random key: md5(seed | col | ...) -- the same under
    any partitioning, and available in any SQL engine."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def sample_rows(df: DataFrame, n: int, seed: int, key_cols: list[str]) -> DataFrame:
    """Seeded sample of ``n`` rows (O4): the ``n`` smallest md5 keys (a
    per-partition top-n, then one merge of n rows per partition)."""
    return df.withColumn("_h", seeded_hash(seed, *key_cols)).orderBy("_h").limit(n).drop("_h")


def sample_per_group(df: DataFrame, group: str, value: str, n: int, seed: int,
                     key_cols: list[str], sep: str = "\n") -> DataFrame:
    """Up to ``n`` values per group in md5 order, collected (O5):
    (group, n_sampled, values joined by ``sep``).  ``row_number <= n`` runs
    as a window group limit, so each map task pre-selects n rows per group."""
    w = Window.partitionBy(group).orderBy("_h")
    picked = (df.withColumn("_h", seeded_hash(seed, *key_cols))
                .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n))
    return picked.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_sampled"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("_h", F.col(value).cast("string").alias("_v")))),
            lambda s: s.getField("_v")), sep).alias("sampled"))
