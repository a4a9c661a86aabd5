"""Views of the driver tables in the shapes the operators work on
(FIXTURES.md section 2).  Every view is a lazy projection / join of the
given Parquet tables, so its work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.sources.tables import read_table, spread

BRIDGE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def bridge(spark: SparkSession, sf: str) -> DataFrame:
    """F-A base: occupation = order, item = part, label = supplier (string ids)."""
    li = read_table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("occ_id"),
                     F.col("l_partkey").cast("string").alias("item_id"),
                     F.col("l_suppkey").cast("string").alias("label_id"),
                     *BRIDGE_ORDER)


def occupations(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("occ_id"),
                    F.col("o_orderstatus").alias("occ_title"),
                    F.col("o_orderpriority").alias("occ_description"))


def label_titles(spark: SparkSession, sf: str) -> DataFrame:
    s = read_table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("label_id"),
                    F.col("s_name").alias("label_title"))


def item_texts(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("item_id"),
                    F.col("p_name").alias("item_text"))


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """F-B: (vec_id, label, embedding)."""
    return read_table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


def labelled_text(spark: SparkSession, sf: str) -> DataFrame:
    """F-C: (doc_id, source, text, lang) with a title per source."""
    d = spread(read_table(spark, sf, "documents"))
    return d.select("doc_id", "source", "text", "lang",
                    F.concat(F.lit("title_"), F.col("source")).alias("source_title"))


def both_measures(spark: SparkSession, sf: str) -> DataFrame:
    """F-D: vectors joined to texts on id; label title = 'label_' || label."""
    e = labelled_vectors(spark, sf)
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return (e.join(d, "vec_id", "inner")
             .withColumn("label_title", F.concat(F.lit("label_"), F.col("label").cast("string"))))


def multilabel_long(spark: SparkSession, sf: str) -> DataFrame:
    """F-E as long (doc_id, text, label) rows: quality / toxic flags and 'lang_' || lang."""
    lab = read_table(spark, sf, "labels")
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    j = lab.join(docs, "doc_id", "inner")
    sets = F.array_compact(F.array(
        F.when(F.col("quality") == 1, F.lit("quality")),
        F.when(F.col("toxic") == 1, F.lit("toxic")),
        F.concat(F.lit("lang_"), F.col("lang"))))
    return j.select("doc_id", "text", F.explode(sets).alias("label"))


def multilabel_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """F-E's labels on F-B's vectors: (vec_id, label, embedding, text, label_title), several labels per item."""
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    rows = multilabel_long(spark, sf).select(F.col("doc_id").alias("vec_id"), "label", "text",
                                             F.concat(F.lit("label_"), "label").alias("label_title"))
    return e.join(rows, "vec_id")
