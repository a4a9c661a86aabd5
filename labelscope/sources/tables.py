"""Readers and writers.

* ``read_tsv``: header, tab separated, every column a string, empty cells kept
  as ``''`` (Spark's CSV reader returns NULL for empty cells, so nulls are
  filled back to ``''``).
* dense matrices live as ``array<float>`` columns on the row they belong to,
  sparse matrices as long ``(item, term, weight)`` tables, a fitted
  vocabulary as a ``(term, df, idf)`` table -- all plain Parquet.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin when a scan yields fewer partitions than the cluster can run
    at once (one small file = one row group = one task); else the scan itself."""
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated file with a header; all strings; '' never becomes null."""
    reader = (spark.read.option("header", True).option("sep", "\t")
              .option("quote", '"').option("escape", '"').option("multiLine", False))
    if columns is not None:
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
        df = reader.schema(schema).csv(path)
    else:
        # header only: every column typed string (no inference pass over data)
        df = reader.option("inferSchema", False).csv(path)
    return df.na.fill("")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reports are small (label/cluster sized); arrays are joined to text."""
    from pyspark.sql import functions as F
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f.name).cast("array<string>"), "|").alias(f.name))
        else:
            cols.append(F.col(f.name))
    df.select(*cols).write.mode(mode).option("header", True).csv(path)
