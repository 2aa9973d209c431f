"""Written intermediate tables: a cut lineage that survives lost executors.

They live below ``spark.checkpoint.dir``, a folder every executor and the driver can reach, and
go when the driver's process ends.  Nothing here uses machine-local folders on a cluster.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from veilwright.session import importable


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="veilwright-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where that is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


class Tables:
    """Written intermediate tables of one operator call; ``drop`` frees those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = importable(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._end)

    def write(self, df: DataFrame) -> DataFrame:
        """Run ``df``, write it and return the DataFrame that reads it."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._veilwright_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(table._veilwright_path)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            self._delete(self.root)
