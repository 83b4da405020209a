"""Shared folders, tables that cut lineage, and checks of size before a broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of 16 bytes or so up to which a key table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, one of this machine if all of Spark runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        if not own:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="treeline-"))
            own = spark.sparkContext.getCheckpointDir()
        named = own
    return named.rstrip("/")


class Stored:
    """A table written once to the shared folder and read from there: it survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/treeline/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; only for tables that no later result reads."""
        jvm = self.df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def small_side(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """keys (already stored, narrow) with a broadcast hint if their count is within the limit; else as they are, for a shuffled join."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys
