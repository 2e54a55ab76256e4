"""Cutting the lineage of level and round loops through tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a folder of this machine serves a local session;
    on a cluster, whose executors would each write to their own, it is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        sc = spark.sparkContext
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir("file:///tmp/netloom-checkpoints")
            held = sc._jsc.sc().getCheckpointDir()
        top = held.get()
    return f"{top.rstrip('/')}/netloom-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which survives the loss of executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """Tables of one run in a fresh shared folder, which go as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, shared_folder(spark)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """df as the table `name`: its lineage is cut, and it outlives lost executors."""
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables, through the file system that holds them; what still reads them fails."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
