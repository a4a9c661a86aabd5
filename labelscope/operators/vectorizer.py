"""A fitted TF-IDF vectoriser on disk (S6): terms and parameters, checked on load.

Format ``FORMAT``: a folder with two Parquet tables, ``terms`` (term, df, idf)
and ``parameters`` (one row: the format, the number of documents and of terms,
the parameters of the fit, the stop words' digest, and a checksum of the
terms).  ``parameters`` is written last, so an unfinished folder does not load.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from labelscope.functions.stopwords import STOP_WORDS_EN
from labelscope.operators import sparse
from labelscope.operators.prep import ValidationError

FORMAT = 1
_SCHEMA = ("format int, n_docs long, n_terms long, min_df double, min_df_share boolean, max_df double, max_df_share boolean, "
           "sublinear boolean, bigrams boolean, stop_words string, checksum string")


@dataclass(frozen=True)
class Vectorizer:
    """A fitted vocabulary with the parameters that weighing new texts needs."""
    vocab: DataFrame
    n_docs: int
    min_df: float = 1
    max_df: float = 1.0
    sublinear: bool = True
    bigrams: bool = True
    stop_words: tuple = tuple(STOP_WORDS_EN)

    def transform(self, df: DataFrame, item: str, text: str) -> DataFrame:
        """(item, term, weight) of new texts."""
        return sparse.tfidf_transform(df, self.vocab, item, text, self.stop_words, self.sublinear, self.bigrams)


def fit(df: DataFrame, item: str, text: str, min_df=1, max_df=1.0, stop_words=STOP_WORDS_EN, sublinear: bool = True,
        bigrams: bool = True) -> Vectorizer:
    _, vocab = sparse.tfidf_fit_transform(df, item, text, min_df, max_df, stop_words, sublinear, bigrams)
    return Vectorizer(vocab, df.count(), min_df, max_df, sublinear, bigrams, tuple(stop_words))


def _digest(stop_words) -> str:
    return hashlib.sha256("\n".join(sorted(stop_words)).encode()).hexdigest()


def _checksum(vocab: DataFrame) -> tuple[int, str]:
    """Number of terms and an order-free checksum of (term, df)."""
    h = F.xxhash64("term", F.col("df").cast("long")).cast("decimal(38,0)")
    n, total = vocab.agg(F.count(F.lit(1)), F.sum(h)).first()
    return n, str(total or 0)


def save(v: Vectorizer, path: str) -> None:
    """Write ``v`` into the new folder ``path`` (an existing one raises)."""
    spark = v.vocab.sparkSession
    v.vocab.select("term", F.col("df").cast("long").alias("df"), "idf").write.mode("error").parquet(f"{path}/terms")
    n, checksum = _checksum(spark.read.parquet(f"{path}/terms"))
    row = (FORMAT, v.n_docs, n, float(v.min_df), isinstance(v.min_df, float), float(v.max_df), isinstance(v.max_df, float),
           v.sublinear, v.bigrams, _digest(v.stop_words), checksum)
    spark.createDataFrame([row], _SCHEMA).coalesce(1).write.mode("error").parquet(f"{path}/parameters")


def load(spark: SparkSession, path: str, stop_words=STOP_WORDS_EN) -> Vectorizer:
    """Read a vectoriser; raises when the folder is unfinished or of another
    format, when ``stop_words`` are not those of the fit, or when the terms do
    not agree with the parameters (lost or changed terms, idf not of df and n)."""
    try:
        rows = spark.read.parquet(f"{path}/parameters").collect()   # one row
    except AnalysisException as e:
        raise ValidationError(f"{path}: no finished vectoriser there") from e
    p = rows[0]
    if len(rows) != 1 or p["format"] != FORMAT:
        raise ValidationError(f"{path}: format {p['format']}, this version reads {FORMAT}")
    if p["stop_words"] != _digest(stop_words):
        raise ValidationError(f"{path}: fitted with other stop words")
    vocab = spark.read.schema("term string, df long, idf double").parquet(f"{path}/terms")
    if _checksum(vocab) != (p["n_terms"], p["checksum"]):
        raise ValidationError(f"{path}: the terms are not those that were written")
    idf = F.log((F.lit(1.0) + p["n_docs"]) / (F.lit(1.0) + F.col("df"))) + 1.0
    bound = lambda k: p[k] * p["n_docs"] if p[f"{k}_share"] else p[k]
    bad = vocab.where((F.abs(F.col("idf") - idf) > 1e-12) | (F.col("df") < bound("min_df")) | (F.col("df") > bound("max_df"))).limit(1).collect()
    if bad:
        raise ValidationError(f"{path}: df and idf of {bad[0]['term']!r} do not fit the parameters")
    as_given = lambda k: p[k] if p[f"{k}_share"] else int(p[k])
    return Vectorizer(vocab, p["n_docs"], as_given("min_df"), as_given("max_df"), p["sublinear"], p["bigrams"], tuple(stop_words))
