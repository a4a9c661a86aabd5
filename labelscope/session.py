"""Spark session helpers.

The library never creates its own temporary folders: lineage is cut with
tables written into the shared folder named by ``spark.checkpoint.dir``.  A folder is only set here when the session has
none (local tests); on a cluster the configured shared folder is used.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "labelscope") -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("SPARK_MASTER", "local[8]"))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set one only when the session has none."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = d.get() if d.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # only reached in local tests: no cluster-wide folder configured
        d = tempfile.mkdtemp(prefix="labelscope-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def shared_folder(uri: str) -> str:
    """The path under which the driver and all executors open ``uri`` as plain files."""
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"{uri}: a folder mounted on the driver and the executors is needed here")
    return unquote(u.path) if u.scheme else uri


def cut_lineage(df: DataFrame, name: str = "table", schema: StructType | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: computed once,
    a short plan for what follows, and nothing lost with an executor.
    ``schema`` reads it as other types of the same storage (ML vectors)."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/labelscope-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
