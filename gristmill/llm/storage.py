"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, the warehouse stands in for it on one machine alone: elsewhere it may be a folder of the driver's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("executors need a folder that all of them share: set spark.checkpoint.dir")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one job in the shared folder, each written and read again.

    That cuts the lineage and survives lost executors. `drop` deletes all of them
    but those to keep, once what was made from them has been written itself.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *only: DataFrame, keep: DataFrame | None = None) -> None:
        for key in [id(x) for x in only] or list(self.paths):
            df, path = self.paths.get(key, (None, None))
            if path and df is not keep:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
                del self.paths[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """One such table that stays."""
    return Scratch(df.sparkSession).written(df, name)
