"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
``share`` of all words.  A target stops at ``max_repeats`` times its source's
size; what is over goes to the other sources by weight, again until nobody is
above.

Of a source of S words and target T every document is taken floor(T / S) times
and a remaining budget of R = T mod S words is fitted by a subset of documents:

1. documents are counted by exact length per source (the histogram);
2. from the longest length down, whole documents are given out in proportion,
   with the rounding carried along, until about ``reserve`` words are left;
3. a bounded-knapsack dynamic programme over the documents not yet given out
   fits what is left as closely as it can from below;
4. the histogram now says how many documents of each length to take; those
   with the smallest seeded hash are taken.

Step 4 never ranks a whole length: documents are counted per length and slice
of the hash range, whole slices below the border are taken, and only the slice
that holds the border is ranked, so copies of one text (one length, one source)
spread over ``slices`` groups.  Texts are not moved.

Defined results: a null text has size 0 and takes 0 words; a null source is a
source of its own, the last; repeated rows are documents of their own, ties
between equal rows are equal; a null ``doc_id`` is treated like any value; an
empty table gives an empty result.  Extra columns pass through
:func:`mix_documents`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from labelscope.llm.scratch import parked, word_array

SLICES = 1024


def targets(sizes: list[int], weights: list[float], total: float, max_repeats: int) -> list[float]:
    """Share ``total`` by weight, no source above ``max_repeats`` times its size."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > max_repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(max_repeats * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length give the largest sum not above ``budget``."""
    take = np.zeros(len(lengths), np.int64)
    reach, mask = 1, (1 << (budget + 1)) - 1  # bit s: the sum s can be had
    steps = []  # (length number, copies, sums that this step added)
    for k in np.argsort(-lengths, kind="stable"):
        left, copies = int(min(counts[k], budget // lengths[k])) if lengths[k] > 0 else 0, 1
        while left > 0 and not reach >> budget & 1:
            copies = min(copies, left)
            new = (reach << (copies * int(lengths[k]))) & mask & ~reach
            if new:
                steps.append((k, copies, new))
                reach |= new
            left, copies = left - copies, copies * 2
        if reach >> budget & 1:
            break
    s = reach.bit_length() - 1
    for k, copies, new in reversed(steps):
        if new >> s & 1:
            take[k] += copies
            s -= copies * int(lengths[k])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int) -> np.ndarray:
    """Documents to take of each length so that their words come to ``budget`` or just below."""
    take = np.zeros(len(lengths), np.int64)
    words = int((lengths * counts).sum())
    if budget <= 0 or words <= 0:
        return take
    share, owed = max(0, budget - reserve) / words, 0.0
    for k in np.argsort(-lengths, kind="stable"):
        if lengths[k] <= 0:
            continue
        owed += share * int(lengths[k]) * int(counts[k])
        take[k] = min(int(counts[k]), int(owed // int(lengths[k])))
        owed -= int(take[k]) * int(lengths[k])
    left = budget - int((take * lengths).sum())
    while left > 4 * reserve:  # carried rounding of few, long documents: give out more, longest first
        k = next((k for k in np.argsort(-lengths, kind="stable") if 0 < lengths[k] <= left and take[k] < counts[k]), None)
        if k is None:
            break
        more = min(int(counts[k] - take[k]), left // int(lengths[k]))
        take[k] += more
        left -= more * int(lengths[k])
    rest = np.flatnonzero((lengths > 0) & (lengths <= left) & (counts > take))
    if left > 0 and len(rest):
        take[rest] += knapsack(lengths[rest], (counts - take)[rest], left)
    return take


def plan(sized: DataFrame, weights=(1, 2, 3), share: float = 1.0, max_repeats: int = 3, reserve: int = 32768) -> DataFrame:
    """(source, size, source_size, target, repeats, extra): how often each
    document of a source and length is taken, and how many once more."""
    hist = parked(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()  # one row a source
    per = sorted(per, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["s"] for r in per], [weights[i % len(weights)] for i in range(len(per))],
                   share * sum(r["s"] for r in per), max_repeats)
    table = sized.sparkSession.createDataFrame(
        [(r["source"], r["s"], g, int(min(max_repeats, g // r["s"])) if r["s"] else 0) for r, g in zip(per, goal)],
        "source string, source_size long, target double, repeats int")
    hist = hist.join(F.broadcast(table), hist["source"].eqNullSafe(table["source"])).select(
        hist["source"], "size", "n", "source_size", "target", "repeats")

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        budget = math.floor(first["target"] - int(first["repeats"]) * int(first["source_size"]) + 1e-6)
        part["extra"] = fit(part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64), budget, reserve)
        return part

    return hist.groupBy("source").applyInPandas(
        fitted, "source string, size long, n long, source_size long, target double, repeats int, extra long")


def mix(docs: DataFrame, seed: int = 13, **params) -> DataFrame:
    """Every row of ``docs`` as (doc, size, source_size, target, copies, taken), ``doc`` a struct of its columns
    without the text."""
    keys = [c for c in docs.columns if c != "text"]
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in keys]).alias("doc"), F.col("source").cast("string").alias("source"),
                        F.size(word_array(F.col("text"))).cast("long").alias("size"),
                        F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    sized = parked(sized.withColumn("slice", F.pmod(F.col("h"), F.lit(SLICES)).cast("int")), "sizes")
    planned = parked(plan(sized.select("source", "size"), **params), "plan")
    wanted = planned.where("extra > 0 and extra < n").select("source", "size", "extra")
    # documents per slice, and how many stand before it in its length
    counted = sized.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("m"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    counted = counted.join(wanted, same(counted, wanted)).select(counted["source"], counted["size"], "slice", "m", "extra")

    before = F.sum("m").over(Window.partitionBy("source", "size").orderBy("slice")) - F.col("m")
    border = counted.withColumn("before", before).where("before < extra and before + m > extra").select(
        "source", "size", F.col("slice").alias("border"), (F.col("extra") - F.col("before")).alias("want"))
    whole = counted.withColumn("before", before).groupBy("source", "size").agg(
        F.max(F.when(F.col("before") + F.col("m") <= F.col("extra"), F.col("slice"))).alias("upto"))
    border = parked(whole.join(border, whole["source"].eqNullSafe(border["source"]) & (whole["size"] == border["size"]), "left")
                    .select(whole["source"], whole["size"], "upto", "border", "want"), "borders")
    rule = planned.join(border, same(planned, border), "left").select(
        planned["source"].alias("r_source"), planned["size"].alias("r_size"), "source_size", "target", "repeats",
        F.when(F.col("extra") >= F.col("n"), F.lit(SLICES)).otherwise(F.coalesce("upto", F.lit(-1))).alias("upto"),
        F.coalesce("border", F.lit(-1)).alias("border"), F.coalesce("want", F.lit(0)).alias("want"))
    ruled = sized.join(rule, sized["source"].eqNullSafe(rule["r_source"]) & (sized["size"] == rule["r_size"])).drop("r_source", "r_size")
    ties = ["doc.__row"] if "__row" in keys else []
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("h", "doc.doc_id", *ties))
    at_border = ruled.where("slice = border").withColumn("once", (rank <= F.col("want")).cast("int"))
    clear = ruled.where("slice <> border").withColumn("once", (F.col("slice") <= F.col("upto")).cast("int"))
    return at_border.unionByName(clear).select(
        "doc", "h", "size", "source_size", "target", (F.col("repeats") + F.col("once")).cast("int").alias("copies"),
        ((F.col("repeats") + F.col("once")) * F.col("size")).cast("long").alias("taken"))


def report(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    return mix(docs, **params).select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns.
    Rows that are equal in every column are one row with the copies of all of
    them; they are reduced before the texts are shuffled, once, to meet their copies."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    seed = params.get("seed", 13)
    hashed = [c.cast("string") if isinstance(f.dataType, MapType) else c for c, f in zip(columns, docs.schema.fields)]
    marked = docs.withColumn("__row", F.xxhash64(*hashed)).select(
        "*", _row_key("doc_id", "source", F.xxhash64(F.lit(seed), "doc_id", "text"), "__row").alias("__k"))
    chosen = mix(marked.select("doc_id", "source", "text", "__row"), **params).groupBy(
        _row_key("doc.doc_id", "doc.source", F.col("h"), "doc.__row").alias("__k")).agg(F.sum("copies").cast("int").alias("__copies"))
    chosen = parked(chosen.where("__copies > 0"), "chosen")
    taken = marked.dropDuplicates(["__k"]).join(chosen, "__k")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*columns)


def _row_key(doc_id: str, source: str, text_hash: Column, row: str) -> Column:
    """A row's id, source, text hash and hash of all columns as one string; nulls are values of their own."""
    said = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return F.concat_ws("|", said(doc_id), text_hash.cast("string"), F.col(row).cast("string"), said(source))
