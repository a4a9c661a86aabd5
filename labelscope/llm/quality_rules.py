"""Quality rules: base counts plus a hashed n-gram log-likelihood ratio.

Unigrams and bigrams of the words are hashed into ``buckets`` features.  Two
multinomials are counted over them: the trusted target (every document labelled
good and not toxic) and the raw corpus (every document).  A document's score is the mean log ratio of its features,

    score = 1/|f| * sum_f [log p_target(f) - log p_raw(f)],

and it is kept when the score is not below a threshold taken from the trusted
documents' own scores (mean minus ``z`` standard deviations, and never above
``max_threshold``), the same for every document.

Only DataFrame functions run here: the counts are one partial aggregation over
the exploded features (``buckets`` rows cross the shuffle per task), and the
ratio table is one constant array of ``buckets`` doubles.

Defined results: null text counts as empty; a document without words has
``base_failed`` true, score null, kept false; an empty table gives an empty
result; without trusted documents nothing is known about the target, so the
base rules alone decide; repeated rows are judged one by one; a null
``doc_id`` is never trusted but is judged like any other row.  Extra columns
pass through untouched in :func:`filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.scratch import let, parked, word_array

SYMBOLS = "[#*$%&|<>]"


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = F.size(words)
    grams = F.when(n >= 3, F.transform(
        F.arrays_zip(F.slice(words, 1, n - 2).alias("a"), F.slice(words, 2, n - 2).alias("b"),
                     F.slice(words, 3, n - 2).alias("c")),
        lambda x: F.xxhash64(x["a"], x["b"], x["c"]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h):
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(by_hash, lambda s: let(
            F.sort_array(F.transform(
                F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                         | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))),
                lambda x: x["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))),
                F.lit(0).cast("bigint"), lambda acc, x: acc + x)))

    return let(grams, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint"))
               .otherwise(covered(h)))


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.char_length(F.concat_ws("", words)).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
        "n_repeat_words": repeat_words(words),
    }


def features(words: Column, buckets: int) -> Column:
    """Hashed unigrams and bigrams of a word array, as bucket numbers."""
    uni = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    bi = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                    lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")))
    return F.concat(uni, F.filter(bi, lambda x: x.isNotNull()))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids labelled good and not toxic, all of them."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float = 1.0) -> DataFrame:
    """One row per bucket: log p_target - log p_raw, add-``smoothing``."""
    flagged = (docs.select("doc_id", F.col("text")).join(
        trusted.select("doc_id", F.lit(1).alias("__t")), "doc_id", "left"))
    counts = (flagged.select(F.col("__t"), F.explode(features(word_array(F.col("text")), buckets)).alias("b"))
              .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("__t").alias("target")))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(
        F.broadcast(counts), "b", "left").na.fill(0)
    full = parked(full, "counts")
    n_raw, n_target = full.agg(F.sum("raw"), F.sum("target")).first()
    share = lambda c, n: F.log((F.col(c) + smoothing) / (n + smoothing * buckets))
    return full.select("b", ((share("target", n_target) - share("raw", n_raw)) if n_target else F.lit(0.0)).alias("llr"))


def ratio_array(table: DataFrame) -> Column:
    """The ratio table (a row per bucket) as one array constant of the plan."""
    ratios = ",".join(repr(r["llr"]) for r in table.orderBy("b").collect())
    return F.split(F.lit(ratios), ",").cast("array<double>")


def score(words: Column, ratios: Column, buckets: int) -> Column:
    """Mean log ratio of a word array's features; null without words."""
    return let(features(words, buckets), lambda f: F.when(
        F.size(f) > 0, F.aggregate(f, F.lit(0.0), lambda acc, x: acc + F.get(ratios, x)) / F.size(f)))


def threshold_of(scores: DataFrame, z: float, max_threshold: float) -> float | None:
    """The threshold from the trusted documents' ``score``; None without any."""
    got = scores.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
    return None if got["m"] is None else min(round(got["m"] - z * got["s"], 9), max_threshold)


def fit(docs: DataFrame, labels: DataFrame, buckets: int, z: float, max_threshold: float) -> tuple[Column, float | None]:
    """(ratios, threshold) from all documents and the trusted ones; no threshold without trusted documents."""
    trusted = parked(trusted_ids(labels), "trusted")
    ratios = ratio_array(ratio_table(docs, trusted, buckets))
    target = docs.select("doc_id", "text").join(trusted, "doc_id", "left_semi")
    return ratios, threshold_of(target.select(score(word_array(F.col("text")), ratios, buckets).alias("score")), z, max_threshold)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 16384, z: float = 6.0,
          max_threshold: float = -0.05, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, any more) with the base counts,
    ``score``, ``threshold``, ``base_failed`` and ``kept`` added; of the input
    columns ``keep`` (default: all) are kept, under their names, in ``doc`` (a
    struct).  Every text is scored once: the threshold reads the stored scores."""
    trusted = parked(trusted_ids(labels), "trusted")
    ratios = ratio_array(ratio_table(docs, trusted, buckets))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("doc"), F.col("doc_id").alias("__id"),
                     F.col("text").alias("__text"), word_array(F.col("text")).alias("__w"))
    base = base_columns(F.col("__text"), F.col("__w"))
    df = parked(df.select("doc", "__id", score(F.col("__w"), ratios, buckets).alias("score"), *[c.alias(n) for n, c in base.items()]), "scored")
    threshold = threshold_of(df.join(trusted, F.col("__id") == trusted["doc_id"], "left_semi"), z, max_threshold)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.lit(True) if threshold is None else F.coalesce(F.col("score") >= threshold, F.lit(False))
    return (df.drop("__id").withColumn("threshold", F.lit(threshold).cast("double")).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & verdict))


def filter_documents(docs: DataFrame, labels: DataFrame, buckets: int = 16384, z: float = 6.0,
                     max_threshold: float = -0.05) -> DataFrame:
    """The documents that :func:`judge` keeps, with their own columns.  The
    verdict is one expression that splits each text once."""
    ratios, threshold = fit(docs, labels, buckets, z, max_threshold)

    def passes(w):
        base = (F.size(w) >= 50) & (100 * repeat_words(w) <= 50 * F.size(w))
        return base if threshold is None else base & F.coalesce(score(w, ratios, buckets) >= threshold, F.lit(False))
    return docs.where(let(word_array(F.col("text")), passes))
