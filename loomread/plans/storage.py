"""Tables in the folder that all executors share: where a plan's lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset, a local folder (one machine, as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomread-shared-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/loomread-{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder; frames that read them are void then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a Parquet table in the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
