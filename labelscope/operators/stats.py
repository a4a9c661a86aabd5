"""Per-group statistics, flags, cross-tabs and label summaries
(W1-W3, P7, P8, A11, A13, A14, A16, O1, J8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.session import cut_lineage


def group_size(df: DataFrame, key: str, out: str = "n_group") -> DataFrame:
    """Rows per group on every row (W3): groupBy with partial aggregation, joined back."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias(out))
    return df.join(sizes, key, "left")


def add_group_stats(df: DataFrame, key: str, col: str, prefix: str,
                    rank_digits: int | None = 9) -> DataFrame:
    """Group mean / sample std / median of ``col`` on each row, z-score and
    average-rank percentile (W1, W2).

    * mean and std: one partial-aggregating ``groupBy``;
    * median and ranks: the exact rank table of ``order_stats`` (no window
      over a whole group, no buffer of a group's values);
    * z = (x - mean) / std, 0 when std is 0 or undefined (one row); the std
      column is 0 then too;
    * pct = average rank / n (ties share the mean of their positions);
      ranks compare ``col`` rounded to ``rank_digits`` so that values equal
      in exact arithmetic tie whatever the summation order.
    Group-level results are key-sized and joined back (AQE broadcasts them
    when small).
    """
    from labelscope.operators.order_stats import quantiles, rank_table
    x = F.col(col)
    rk = F.round(x, rank_digits) if rank_digits is not None else x
    base = df.withColumn("_rk", rk)
    rt = cut_lineage(rank_table(base, key, "_rk", rep=col), "ranks")
    med = quantiles(rt.withColumn("_rk", F.col("rep")), key, "_rk", {"_med": 0.5})
    mom = df.groupBy(key).agg(F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd"))
    pct = rt.select(key, "_rk", ((F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)) / F.col("n")).alias("_pct"))
    out = (base.join(mom.join(med, key), key, "left")
               .join(pct, [key, "_rk"], "left"))
    sd = F.when(F.col("_sd") != 0, F.col("_sd"))
    out = out.withColumns({f"z_{prefix}": F.coalesce((x - F.col("_mu")) / sd, F.lit(0.0)), f"pct_{prefix}": F.col("_pct"),
                           f"{prefix}_mean": F.col("_mu"), f"{prefix}_std": F.coalesce(sd, F.lit(0.0)),
                           f"{prefix}_med": F.col("_med")}).drop("_mu", "_sd", "_med", "_pct", "_rk")
    return out


def add_flags(df: DataFrame, size_col: str = "n_label", small_max: int = 7,
              high_z: float = 1.5, disagree_z: float = 1.5,
              z_sparse: str = "z_tfidf", z_dense: str = "z_dense",
              mm_sparse: str = "mismatch_tfidf", mm_dense: str = "mismatch_dense") -> DataFrame:
    """Outlier flags (P7): small group, high z per measure, both, either,
    disagreement between measures, mismatch in either measure."""
    sparse_high, dense_high = F.col(z_sparse) >= high_z, F.col(z_dense) >= high_z
    return df.withColumns({
        "small": F.col(size_col) <= small_max, "flag_tfidf": sparse_high, "flag_dense": dense_high,
        "flag_both": sparse_high & dense_high, "flag_either": sparse_high | dense_high,
        "flag_disagree": F.abs(F.col(z_sparse) - F.col(z_dense)) >= disagree_z,
        "mismatch_either": F.col(mm_sparse) | F.col(mm_dense)})


FLAG_COLS = ["small", "flag_tfidf", "flag_dense", "flag_both", "flag_either", "flag_disagree",
             "mismatch_dense", "mismatch_tfidf", "mismatch_either"]


def flag_counts(df: DataFrame, label: str) -> DataFrame:
    """All global counters in one aggregate pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(label).alias("n_labels"),
                  *[F.count_if(F.col(c)).alias(c) for c in FLAG_COLS])


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by two columns plus 'All' margins (A11), long form:
    (a, b, n) with 'All' in the margin cells, via ``cube`` + ``grouping``."""
    g = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"),
                          F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return g.select(F.when(F.col("_ga") == 1, F.lit("All")).otherwise(F.col(a).cast("string")).alias(a),
                    F.when(F.col("_gb") == 1, F.lit("All")).otherwise(F.col(b).cast("string")).alias(b),
                    "n")


def label_summary(df: DataFrame, label: str, title: str, item: str) -> DataFrame:
    """Per-label distance summary (A13 + P8): first title, size, flag sums,
    mean and exact p95 (linear interpolation) of both distances, mismatch
    sums, and every count as a rate of n; highest flag rate first (O2)."""
    s = (df.groupBy(label)
           .agg(F.count(F.lit(1)).alias("n"),
                F.count_if("small").alias("small_flag"),
                F.count_if("flag_tfidf").alias("tfidf_flag"),
                F.count_if("flag_dense").alias("dense_flag"),
                F.count_if("flag_either").alias("either_flag"),
                F.count_if("flag_both").alias("both_flag"),
                F.count_if("flag_disagree").alias("disagree"),
                F.avg("dist_tfidf").alias("mean_dist_tfidf"),
                F.avg("dist_dense").alias("mean_dist_dense"),
                F.count_if("mismatch_tfidf").alias("mismatch_tfidf"),
                F.count_if("mismatch_dense").alias("mismatch_dense"),
                F.count_if("mismatch_either").alias("mismatch_either")))
    from labelscope.operators.prep import dedupe_keep
    s = s.join(dedupe_keep(df.select(label, title, item), [label], [item]).select(label, title), label)
    # exact p95 (linear interpolation) from one rank table of both measures: no group buffered in one task
    from labelscope.operators.order_stats import quantiles, rank_table
    both = df.select(F.explode(F.array(*[F.struct(F.struct(F.col(label).alias("l"), F.lit(m).alias("m")).alias("_k"),
                                                  F.col(f"dist_{m}").cast("double").alias("_x")) for m in ("tfidf", "dense")])).alias("_e"))
    q = quantiles(rank_table(both.select("_e.*").where("_k.l is not null"), "_k", "_x"), "_k", "_x", {"p95": 0.95})
    s = s.join(q.groupBy(F.col("_k.l").alias(label)).agg(
        *[F.max(F.when(F.col("_k.m") == m, F.col("p95"))).alias(f"p95_{m}") for m in ("tfidf", "dense")]), label, "left")
    s = s.withColumns({rate: F.col(num) / F.col("n") for rate, num in [("rate_tfidf", "tfidf_flag"), ("rate_dense", "dense_flag"),
                      ("rate_both", "both_flag"), ("rate_either", "either_flag"),
                      ("rate_disagree", "disagree"), ("rate_mismatch_tfidf", "mismatch_tfidf"),
                      ("rate_mismatch_dense", "mismatch_dense"),
                      ("rate_mismatch_either", "mismatch_either")]})
    return s.orderBy(F.col("rate_either").desc(), F.col(label).asc())


def flagged_label_rows(df: DataFrame, label: str, flag: str = "flag_either") -> DataFrame:
    """All rows of every label that has at least one flagged row (J8, left semi join)."""
    flagged = df.filter(F.col(flag)).select(label).distinct()
    return df.join(flagged, label, "left_semi")


def outlier_report(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Rows of flagged labels, sorted label asc, both/either flags and z desc (O1)."""
    rows = flagged_label_rows(df, label)
    return (rows.select(*cols)
                .orderBy(F.col(label).asc(), F.col("flag_both").desc(), F.col("flag_either").desc(),
                         F.col("z_dense").desc(), F.col("z_tfidf").desc()))


def ranges(df: DataFrame, cols: list[str], flags: list[str]) -> DataFrame:
    """Min / max of measures and mean of flags (A16), one row."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    for f in flags:
        aggs.append(F.avg(F.col(f).cast("double")).alias(f"rate_{f}"))
    return df.agg(*aggs)
