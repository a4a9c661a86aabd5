"""Tables and files that a job parks in the shared folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.session import checkpoint_dir

WS = " \t\n\x0b\x0c\r"
WORD_GAP = "[ \\t-\\r]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/labelscope-{name}-{uuid.uuid4().hex}"


def shared_file_path(uri: str) -> str:
    """The path under which every executor opens ``uri`` as plain files (a mounted shared folder)."""
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared folder mounted on the executors, not {u.scheme}://; "
                         "point spark.checkpoint.dir at one")
    return unquote(u.path) if u.scheme else uri


def save(path: str, array: np.ndarray) -> None:
    """Write an array under a temporary name and rename it: a repeated task leaves one whole file."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        np.save(f, np.ascontiguousarray(array))
    os.replace(temporary, path)


def map_array(path: str) -> np.ndarray:
    """An array file, memory-mapped without keeping the file open (from Python 3.13 on)."""
    with open(path, "rb") as f:
        np.lib.format.read_magic(f)
        shape, _, dtype = np.lib.format.read_array_header_1_0(f)
        start, n = f.tell(), int(np.prod(shape))
        if n == 0:
            return np.zeros(shape, dtype)
        free = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **free), dtype, n, start).reshape(shape)


class Buckets:
    """Memory-mapped arrays ``<files>/<name>-<bucket>.<column>``, mapped when
    they are first used; of more than ``OPEN`` buckets the longest unused go."""

    OPEN = 1024 if sys.version_info >= (3, 13) else 64

    def __init__(self, files: str, name: str, columns: tuple[str, ...]):
        self.base, self.columns = f"{files}/{name}", columns
        self.part = lru_cache(maxsize=self.OPEN)(self._part)

    def _part(self, bucket: int) -> list[np.ndarray] | None:
        """The bucket's arrays; None if it has none."""
        base = f"{self.base}-{bucket:05d}"
        if not os.path.exists(f"{base}.{self.columns[-1]}"):
            return None
        return [map_array(f"{base}.{c}") for c in self.columns]


def parked(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the
    lineage ends there and a lost executor costs nothing."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Parking:
    """Parked tables of one job: ``leave`` deletes one when it is no longer
    read, the end of the ``with`` block the others; and each query's shuffle
    files go when the query ends, as its result is parked."""

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Parking:
        self.before = self.spark.conf.get(self.CLEAN, None)
        self.spark.conf.set(self.CLEAN, "true")
        return self

    def __exit__(self, *error) -> None:
        if self.before is None:
            self.spark.conf.unset(self.CLEAN)
        else:
            self.spark.conf.set(self.CLEAN, self.before)
        for _, path in self.paths:
            self._delete(path)

    def park(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        out = parked(df, name, path)
        self.paths.append((out, path))
        return out

    def leave(self, df: DataFrame) -> None:
        for entry in [e for e in self.paths if e[0] is df]:
            self.paths.remove(entry)
            self._delete(entry[1])

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def word_array(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column (null: none)."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP))


def let(value, body):
    """Bind ``value`` once per row for use inside the lambda ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker (code pickled by
    value gets new module globals with every task)."""
    import sys
    return sys.__dict__.setdefault("_labelscope_store", {})
