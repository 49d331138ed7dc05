"""Results that are used more than once, written to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in the session's spark.checkpoint.dir; without one a temporary folder is set if all of Spark runs on this
    machine, and elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='kept-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Kept:
    """Writes tables and reads them again, without their lineage. They are deleted by drop, or when the program ends; nothing may read
    them after."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.written = spark, f"{folder(spark)}/{uuid.uuid4().hex}", 0
        atexit.register(self.drop)

    def __call__(self, rows: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.path}/{self.written}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self) -> None:
        atexit.unregister(self.drop)
        if self.spark.sparkContext._jsc is not None:  # else the session has ended, and nothing can be deleted through it
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
