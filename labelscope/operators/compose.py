"""Cluster / label composition, purity, top-N cross-tab, prompts and
summaries (A9, A10, A12, J6, X10, X12)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def composition(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per value of ``a``: rows, distinct ``b``, the dominant ``b`` (largest
    count, ties to the smallest key), its count and share (A9), largest share
    first (O2).  One ``groupBy(a, b).count()``, then hash aggregates."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).alias("_c"))
    first = Window.partitionBy(a).orderBy(F.col("_c").desc(), F.col(b).asc())
    best = (pairs.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == 1)
            .select(a, F.col(b).alias(f"dominant_{b}"), F.col("_c").alias("dominant_count")))
    return (pairs.groupBy(a).agg(F.sum("_c").alias("n_rows"), F.count(F.lit(1)).alias(f"n_distinct_{b}"))
                 .join(best, a)
                 .withColumn("dominant_share", F.col("dominant_count") / F.col("n_rows"))
                 .orderBy(F.col("dominant_share").desc(), F.col(a).asc()))


def weighted_purity(comp: DataFrame, b: str) -> DataFrame:
    """sum(share * n) / sum(n) and the mean number of distinct values (A10)."""
    return comp.agg((F.sum(F.col("dominant_share") * F.col("n_rows")) / F.sum("n_rows")).alias("weighted_purity"),
                    F.avg(f"n_distinct_{b}").alias(f"mean_distinct_{b}"))


def crosstab_top(df: DataFrame, row: str, col: str, top_n: int = 25) -> DataFrame:
    """Counts of ``row`` x ``col`` for the ``top_n`` most frequent ``col``
    values, plus log1p (A12, P9).  Long form (row, col, n, log1p_n) with a cell
    for every row key of the whole table, zero where it has none of them."""
    top = (df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
             .orderBy(F.col("_n").desc(), F.col(col).asc()).limit(top_n))
    # every row key gets a cell for each of the N columns; the N names are an array in one row per key
    cells = df.filter(F.col(row).isNotNull()).select(row).distinct().withColumn("_k", F.lit(1)).join(
        F.broadcast(top.agg(F.sort_array(F.collect_list(col)).alias("_cols")).withColumn("_k", F.lit(1))), "_k").select(
        row, F.explode("_cols").alias(col))
    n = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    return (cells.join(n, [row, col], "left").na.fill(0, ["n"])
                 .withColumn("log1p_n", F.log1p(F.col("n").cast("double"))))


def join_back(rows: DataFrame, item_level: DataFrame, item: str, cols: list[str]) -> DataFrame:
    """Left join item-level columns (cluster id, description) back to rows."""
    return rows.join(item_level.select(item, *cols), item, "left")


#: {examples} takes the bullet list; pass any other template with that field.
PROMPT = ("The lines below are a sample from one group of texts. Name what they have in common "
          "in a single sentence of at most twenty words.\n\n{examples}\n\nAnswer:")


def group_prompts(df: DataFrame, group: str, text: str, n: int, seed: int, key_cols: list[str],
                  template: str = PROMPT) -> DataFrame:
    """Per group: up to ``n`` sampled texts as a bullet list inside the prompt
    template (X10): (group, n_sampled, prompt).  Sampling is the md5-ordered
    per-group sample (O5), so at most n rows per group are ever gathered."""
    from labelscope.operators.profile import sample_per_group
    head, tail = template.split("{examples}")
    s = sample_per_group(df, group, text, n, seed, key_cols, sep="\n- ")
    return s.select(group, "n_sampled",
                    F.concat(F.lit(head + "- "), F.col("sampled"), F.lit(tail)).alias("prompt"))


def summarize_groups(prompts: DataFrame, group: str, summarizer=None, out: str = "summary", store: str | None = None,
                     version: str = "", batch_size: int = 16) -> DataFrame:
    """One summary per group (X12): (group, out).

    ``summarizer(list[str]) -> list[str]`` runs on the executors (e.g. a call to
    a hosted model).  Every distinct prompt is asked once: its answer is kept
    under the hash of ``version`` and the prompt in the folder ``store``, written
    whole and renamed, and looked up before the function is called.  So a repeated
    task, a lost executor, another action or another run with the same store pays
    for unanswered prompts only; a failing call loses its own batch only.
    ``store`` is a folder that the executors see as files (default: one in the
    shared checkpoint folder).  A null prompt has a null summary."""
    if summarizer is None:
        raise ValueError("pass a summarizer, or use top_terms_summary")
    from labelscope.session import checkpoint_dir, shared_folder
    spark = prompts.sparkSession
    folder = shared_folder(store or f"{checkpoint_dir(spark).rstrip('/')}/labelscope-summaries")
    keyed = prompts.select(group, F.sha2(F.concat(F.lit(version), F.lit("\n"), "prompt"), 256).alias("_key"), "prompt")

    def run(batches):
        for pdf in batches:
            answers = {}
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at:at + batch_size]
                known = {k: _answer(folder, k) for k in part["_key"]}
                asked = part[[known[k] is None for k in part["_key"]]]
                if len(asked):
                    said = list(summarizer(asked["prompt"].tolist()))
                    if len(said) != len(asked):
                        raise ValueError(f"the summarizer gave {len(said)} answers to {len(asked)} prompts")
                    for k, text in zip(asked["_key"], said):
                        _keep_answer(folder, k, text)
                        known[k] = text
                answers.update(known)
            yield pdf[["_key"]].assign(**{out: [answers[k] for k in pdf["_key"]]})

    answered = keyed.where("prompt is not null").select("_key", "prompt").distinct().mapInPandas(run, f"_key string, {out} string")
    return keyed.join(answered, "_key", "left").select(group, out)


def _answer(folder: str, key: str) -> str | None:
    try:
        with open(f"{folder}/{key[:2]}/{key}", encoding="utf-8", newline="") as f:
            return f.read()
    except FileNotFoundError:
        return None


def _keep_answer(folder: str, key: str, text: str) -> None:
    """Written under another name and renamed: a reader sees a whole answer or none."""
    os.makedirs(f"{folder}/{key[:2]}", exist_ok=True)
    part = f"{folder}/{key[:2]}/.{key}-{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(part, f"{folder}/{key[:2]}/{key}")


def top_terms_summary(top_terms: DataFrame, group: str, out: str = "summary") -> DataFrame:
    """Default summariser: the group's ranked top n-grams joined by ', '."""
    return top_terms.groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]),
                     ", ").alias(out))
