"""A Parquet catalogue by day with a manifest of each file's bounds, for pruned window reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import ParquetTable


class TradeCatalog:
    """Files under ``path``/data, a manifest row a file: file, rows, least and greatest of the axes.

    A build writes days that have no receipt yet, so a stopped one goes on where
    it was; the manifest is made from the written files themselves.
    """

    def __init__(self, spark: SparkSession, path: str, axes: Sequence[str] = ("block", "block_time"), order: Sequence[str] = ("block", "trade_id")):
        self.spark, self.path, self.axes, self.order = spark, path.rstrip("/"), list(axes), list(order)
        self.manifest = ParquetTable(spark, f"{self.path}/manifest", ["day"])

    def build(self, trades: DataFrame, time: str = "block_time") -> int:
        """Write the days that are missing; how many files that made."""
        rows = trades.withColumn("day", F.to_date(time))
        done = self.manifest.read()
        if done is not None:
            rows = rows.join(F.broadcast(done.select("day").distinct()), "day", "left_anti")  # a row a day
        if rows.isEmpty():
            return 0
        name = f"{self.path}/data/build-{0 if done is None else done.select('build').distinct().count()}"
        rows.repartition("day").sortWithinPartitions(*self.order).write.option("compression", "zstd").partitionBy("day").parquet(name)
        bounds = [f(a).alias(f"{n}_{a}") for a in self.axes for n, f in (("min", F.min), ("max", F.max))]
        files = self.spark.read.parquet(name).groupBy(F.col("_metadata.file_path").alias("file"), "day").agg(F.count("*").alias("rows"), *bounds).withColumn("build", F.lit(name))
        self.manifest.append(files)
        return files.count()

    def files(self, axis: str, low, high) -> list[str]:
        """Files whose bounds meet [low, high]."""
        rows = self.manifest.read().where((F.col(f"max_{axis}") >= F.lit(low)) & (F.col(f"min_{axis}") <= F.lit(high)))
        return [r.file for r in rows.select("file").orderBy("file").collect()]

    def window(self, axis: str, low, high) -> DataFrame:
        """Rows of [low, high]; files out of it are not opened."""
        found = self.files(axis, low, high)
        if not found:
            return self.spark.read.parquet(self.manifest.read().first().file).where("false")
        return self.spark.read.parquet(*found).where(F.col(axis).between(low, high))


class DayPartitions:
    """A table by partition: a part that is written again replaces its partitions and no others, and ``finish`` holds it to be whole."""

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path.rstrip("/"), column

    def part(self, rows: DataFrame) -> None:
        rows.repartition(self.column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.column).parquet(f"{self.path}/data")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data")

    def days(self, low: str, high: str) -> DataFrame:
        """Rows of the partitions in [low, high]; others are not opened."""
        return self.read().where(F.col(self.column).between(low, high))

    def finish(self, wanted: Sequence[str]) -> DataFrame:
        """The rows of each wanted partition, written down as the table's manifest; an error if one is missing."""
        counts = self.read().where(F.col(self.column).isin(list(wanted))).groupBy(F.col(self.column).cast("string").alias(self.column)).agg(F.count("*").alias("rows"))
        there = {r[0] for r in counts.select(self.column).collect()}  # a row a partition
        if missing := sorted(set(wanted) - there):
            raise ValueError(f"no rows of {', '.join(missing)}")
        manifest = ParquetTable(self.spark, f"{self.path}/manifest", [self.column])
        manifest.upsert(counts)
        return manifest.read()
