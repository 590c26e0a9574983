"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one is set in a local session, and an error raised on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        at = tempfile.mkdtemp(prefix="voxelweave-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables written as Parquet, which cut lineage and survive the loss of executors. What isn't dropped goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/voxelweave-{uuid.uuid4().hex}"
        path, files = self._path(self.root)
        files.deleteOnExit(path)

    def _path(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path, files = self._path(f"{self.root}/{name}")
        files.delete(path, True)


def named(column: str) -> Column:
    """A column by its name as it stands, dots and quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a column's texts, by a scan of that column alone; the optimizer's size of a join would be a product."""
    return int(df.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))).first()[0] or 0)
