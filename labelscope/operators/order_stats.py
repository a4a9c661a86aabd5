"""Exact per-group order statistics without a hot task.

Average ranks and interpolated percentiles need each group's sorted order.
A window partitioned by the group (or Spark's exact ``percentile``, which
buffers the group's values) puts a group that holds a third of the rows into
one task.  Here the order is assembled from pieces:

1. distinct values per group with their counts (partial aggregate, so a
   value repeated millions of times is one row);
2. these rows are range-partitioned by (group, value): as many partitions as
   the session shuffles to, of about equal size whatever the groups' sizes --
   a hot group spreads over as many as its values fill, small groups share one;
3. a running count inside each (group, partition) window, and the offset of
   each partition from a table of one row per group and partition.

The result is exact: ``before`` is the number of rows of the group with a
smaller value, so the average rank is ``before + (cnt + 1) / 2`` and the
value at 0-based position j is the one with ``before <= j < before + cnt``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.session import cut_lineage


def ranged(df: DataFrame, keys: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``df`` stored in ranges of ``keys``, with ``_bk``: the range a row is in.
    Rows equal in ``keys`` share a range.  ``parts``: number of ranges (default:
    the session's shuffle partitions)."""
    spread = df.repartitionByRange(*([parts] if parts else []), *keys)
    return cut_lineage(spread.withColumn("_bk", F.spark_partition_id()), name)


def numbered(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: a row's number from 0 among those equal in ``by``, in
    the order of ``order`` -- ``row_number`` without one task per group.  Rows
    without a null in ``by``."""
    keys = [*by, *order]
    placed = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_bk", F.shiftright("_at", 33))   # the id's high bits are the partition
    first = placed.groupBy(*by, "_bk").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).drop("_c", "_first")
    return placed.join(first, [*by, "_bk"]).withColumn(out, F.col("_at") + F.col("_off")).drop("_at", "_bk", "_off")


def rank_table(df: DataFrame, key: str | None, value: str, buckets: int | None = None,
               rep: str | None = None) -> DataFrame:
    """(key, value, cnt, before, n[, rep]) per distinct value of each group.
    ``rep`` (optional) carries min(rep) per distinct value (e.g. the raw
    measure behind a rounded ranking value).  ``key=None`` ranks the whole
    column as one group.  ``buckets``: number of ranges, as in :func:`ranged`."""
    k = key or "_all"
    base = df if key else df.withColumn(k, F.lit(0))
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if rep:
        aggs.append(F.min(rep).alias("_rep"))
    g = ranged(base.filter(F.col(value).isNotNull() & F.col(k).isNotNull()).groupBy(k, value).agg(*aggs),
               [k, value], "values", buckets)
    w_in = Window.partitionBy(k, "_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_lb", F.coalesce(F.sum("_cnt").over(w_in), F.lit(0)))
    s = g.groupBy(k, "_bk").agg(F.sum("_cnt").alias("_bc"))
    w_off = Window.partitionBy(k).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("_off", F.coalesce(F.sum("_bc").over(w_off), F.lit(0)))
          .withColumn("_n", F.sum("_bc").over(Window.partitionBy(k))))
    cols = [k, value, F.col("_cnt").alias("cnt"), (F.col("_off") + F.col("_lb")).alias("before"),
            F.col("_n").alias("n")]
    if rep:
        cols.append(F.col("_rep").alias("rep"))
    return g.join(s, [k, "_bk"]).select(*cols)


def quantiles(rt: DataFrame, key: str | None, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group from a rank table:
    (key, name...) for each ``name -> p`` of ``probs``."""
    k = key or "_all"
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at = lambda j: (F.col("before") <= j) & (j < F.col("before") + F.col("cnt"))
        aggs += [F.max(F.when(at(lo), F.col(value))).alias(f"_{name}_lo"),
                 F.max(F.when(at(hi), F.col(value))).alias(f"_{name}_hi"),
                 F.max(pos - lo).alias(f"_{name}_f")]
    q = rt.groupBy(k).agg(*aggs)
    out = [F.col(k)]
    for name in probs:
        lo_v, hi_v, fr = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_f")
        out.append((lo_v + fr * (hi_v - lo_v)).alias(name))
    return q.select(*out)


def next_in_group(df: DataFrame, group: str, order: str, cols: list[str], buckets: int | None = None,
                  prefix: str = "next_") -> DataFrame:
    """Each row with the ``cols`` of the following row of its group in
    ``order`` (null for the last row): ``lead`` without one task per group.
    ``lead`` runs inside each range of (group, order), and a range's last row
    of a group takes the first row of the group's next range from a table of
    one row per group and range.  Rows without a group or an order have no place."""
    d = ranged(df.filter(F.col(group).isNotNull() & F.col(order).isNotNull()), [group, order], "ordered", buckets)
    w = Window.partitionBy(group, "_bk").orderBy(order)
    d = d.withColumn("_end", F.lead(F.lit(1)).over(w).isNull())
    for c in cols:
        d = d.withColumn(prefix + c, F.lead(c).over(w))
    firsts = d.groupBy(group, "_bk").agg(F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols]))
                                         .alias("_f"))
    firsts = firsts.withColumn("_nf", F.lead("_f").over(Window.partitionBy(group).orderBy("_bk")))
    d = d.join(firsts.select(group, "_bk", "_nf"), [group, "_bk"], "left")
    for c in cols:
        d = d.withColumn(prefix + c, F.when(F.col("_end"), F.col("_nf").getField(c)).otherwise(F.col(prefix + c)))
    return d.drop("_bk", "_end", "_nf")
