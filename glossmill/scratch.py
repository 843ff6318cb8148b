"""Tables written once to the shared folder, to cut lineage in iterative operators.

What is written stays until the folder is cleared, as Spark's own checkpoints do; rounds of an
iteration take turns in two places (``Rounds``), so that an iteration holds two tables at most.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in local mode (tests), a new one is
    made. On a cluster it must be set: executors have no other folder in common."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: what follows never computes ``df`` again, even when executors go.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of an iteration; each takes the place of the one before its predecessor."""

    def __init__(self, spark: SparkSession, name: str = "round"):
        self.paths = [f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}-{i}" for i in range(2)]

    def written(self, df: DataFrame) -> DataFrame:
        """``df``, which may read the last table but none before it, written and read back."""
        self.paths.reverse()
        df.write.mode("overwrite").parquet(self.paths[0])
        return df.sparkSession.read.schema(df.schema).parquet(self.paths[0])
