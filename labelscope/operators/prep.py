"""Preparation: column tidying, keep-first de-duplication, enrichment
(P1-P6, A5, J1, J2)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.text import normalize_text, word_count


def tidy_name(name: str, style: str = "snake") -> str:
    if style == "snake":
        return re.sub(r"[^a-z0-9]+", "_", name.strip().lower())
    if style == "spaces":
        return re.sub(r"\s+", "_", name.strip().lower())
    raise ValueError("style must be 'snake' or 'spaces'")


def tidy_columns(df: DataFrame, style: str = "snake") -> DataFrame:
    """Rename columns (driver-side metadata only, no job)."""
    return df.toDF(*[tidy_name(c, style) for c in df.columns])


def select_present(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def dedupe_keep(df: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    """First row per key under an explicit order (``order_by`` is mandatory;
    rows equal in it are taken in any order).

    ``row_number() == 1`` runs as a window group limit: each input partition
    sorts and keeps its first row per key before the shuffle, so a key that
    holds a third of the rows sends one row per partition.
    """
    if not order_by:
        raise ValueError("dedupe_keep needs an explicit order")
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return (df.withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") == 1).drop("_rn"))


class ValidationError(ValueError):
    pass


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> None:
    """Raise when ``keys`` repeat (one aggregate job; partial aggregation)."""
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValidationError(f"{what}: key {keys} is not unique, e.g. {dup[0].asDict()}")


def enrich(base: DataFrame, dims: list[tuple[DataFrame, str]], validate: bool = True) -> DataFrame:
    """Chained left equi-joins of ``base`` with dimension tables.

    With ``validate`` each dimension must be unique on its key (many-to-one),
    so the join cannot fan out.  No broadcast hint: AQE broadcasts a
    dimension whose runtime size is under the threshold and keeps a
    sort-merge join for one that is not.
    """
    out = base
    for dim, key in dims:
        if validate:
            assert_unique(dim, [key], "dimension")
        out = out.join(dim, key, "left")
    return out


def normalize_and_count(df: DataFrame, text: str, len_col: str) -> DataFrame:
    return (df.withColumn(text, normalize_text(text))
              .withColumn(len_col, word_count(text)))


def build_analysis(bridge: DataFrame, occ: DataFrame, labels: DataFrame, items: DataFrame,
                   bridge_order: list[str]) -> DataFrame:
    """Item-label bridge enriched with occupation, label title and item text;
    one row per (item, label) -- the first in bridge order; text normalised
    and word-counted.  Columns: occ_id, occ_title, item_id, item_text,
    item_len, label_id, label_title (+ the bridge ordering columns)."""
    # dimensions are de-duplicated first (first row per key; ties by the other
    # columns), so the many-to-one joins cannot fan out
    occ_d = dedupe_keep(occ.select("occ_id", "occ_title", "occ_description"),
                        ["occ_id"], ["occ_title", "occ_description"])
    lab_d = dedupe_keep(labels.select("label_id", "label_title"), ["label_id"], ["label_title"])
    itm_d = dedupe_keep(items.select("item_id", "item_text"), ["item_id"], ["item_text"])
    # the joins are many-to-one and the dimensions unique: reduce the bridge before
    # it gets its texts, and normalise each item's text once
    firsts = dedupe_keep(bridge, ["item_id", "label_id"], bridge_order)
    itm_d = normalize_and_count(itm_d, "item_text", "item_len")
    out = enrich(firsts, [(occ_d, "occ_id"), (lab_d, "label_id"), (itm_d, "item_id")], validate=False)
    return out.select("occ_id", "occ_title", "item_id", "item_text", "item_len",
                      "label_id", "label_title", *bridge_order)


def dedupe_label_text(df: DataFrame, label: str = "label_id", text: str = "item_text",
                      item: str = "item_id") -> DataFrame:
    """One text per label: keep the smallest item id (string order) per (label, text)."""
    return dedupe_keep(df, [label, text], [item])
