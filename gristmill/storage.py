"""Steps of loops: kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, the warehouse stands in for it on one machine alone: elsewhere it may be a folder of the driver's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("executors need a folder that all of them share: set spark.checkpoint.dir")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def opened(path: str):
    """pyarrow's file system of a path or URI, and the path on it."""
    from pyarrow import fs

    if re.match(r"(?!file:)\w[\w+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows beyond which a written table is not broadcast: its files may be far smaller than what the driver would hold.
BROADCAST_ROWS = 200_000


class Parts:
    """A table that a loop writes in parts, one Parquet folder each, in the shared folder.

    A part is written once, with the number of its rows counted on the way, and
    outlives the executors that made it; `rows` reads all of them. `drop` deletes
    what the loop no longer needs; parts behind a result stay. Tables of more than
    `BROADCAST_ROWS` rows ask for joins without a broadcast.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.schema, self.n = None, 0

    def add(self, df: DataFrame, counted: Column | None = None) -> tuple[DataFrame, int]:
        """Writes a part; returns it as read again, and its number of rows (those where `counted` holds, if given)."""
        seen, path = Observation(), f"{self.base}/{len(self.paths):06d}"
        df.observe(seen, F.count_if(F.lit(True) if counted is None else counted).alias("n"), F.count("*").alias("all")).write.parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        total = seen.get.get("all") or 0
        self.n += total
        return _joined(self.spark.read.schema(df.schema).parquet(path), total), seen.get.get("n") or 0

    def rows(self) -> DataFrame:
        return _joined(self.spark.read.schema(self.schema).parquet(*self.paths), self.n)

    def drop(self) -> None:
        delete(self.spark, self.base)

    def replace(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Writes the next state of a table that shrinks or changes, and deletes the one before."""
        old, self.paths, self.n = self.paths, [], 0
        self.base = f"{self.base.rsplit('-', 1)[0]}-{uuid.uuid4().hex}"
        out = self.add(df)
        for path in old:
            delete(self.spark, path)
        return out


class Dealt:
    """A table that a loop appends to, kept in `n` buckets by `keys`: joins by these keys read what is there without a shuffle.

    It is known to the session until `forget`; its files stay in the shared folder, behind a result.
    """

    def __init__(self, spark: SparkSession, name: str, keys: tuple[str, ...], n: int):
        self.spark, self.keys, self.n = spark, keys, n
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.base = f"{shared_dir(spark)}/{self.name}"
        self.schema = None

    def add(self, df: DataFrame, apart: tuple[str, ...]) -> None:
        """Appends rows that are dealt by the keys already, in a folder for each value of `apart`."""
        self.schema = df.schema
        df.write.format("parquet").mode("append").bucketBy(self.n, *self.keys).partitionBy(*apart).option("path", self.base).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def files(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.base)

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _joined(df: DataFrame, rows: int) -> DataFrame:
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again: cuts the plan, and outlives the executors that made it."""
    return Parts(df.sparkSession, name).add(df)[0]
