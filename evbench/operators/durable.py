"""Cutting lineage through the folder that driver and executors share, so that lost executors lose nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a local session takes a folder beside its warehouse, and a cluster raises ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that driver and executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders below the shared one."""
    root = shared_folder(spark)
    for path in paths:
        if not path.startswith(f"{root}/"):
            raise ValueError(f"{path} isn't below {root}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Stored:
    """Frames of a loop, each written as Parquet below the shared folder, and deleted as soon as the loop names them or ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame) -> DataFrame:
        path = stored_path(self.spark, "round")
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete what put() wrote for frames that no later job reads."""
        for df in frames:
            discard(self.spark, self.paths.pop(id(df))[0])

    def close(self) -> None:
        self.drop(*[df for _, df in self.paths.values()])
