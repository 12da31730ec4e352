"""Tables that an operator keeps between its jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir. A temporary one is set where
    the session names none and driver and executors are one process; else it fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        base = context._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/quillspark-core-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Kept:
    """Tables of one run of an operator: deleted at its end, also when it fails."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n = spark, new_path(spark, name), 0

    def __enter__(self) -> Kept:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return stored(df, f"{self.path}/{self.n}")


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
