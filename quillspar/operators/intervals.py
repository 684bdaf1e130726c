"""Interval algebra over half-open [start, end) rows with keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: Column | int = 0) -> DataFrame:
    """Intervals of a key merged where one starts within ``gap`` of the furthest end before it."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(before)
    new = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    marked = df.select(*keys, start, end).withColumn("_new", new).withColumn("_island", F.sum("_new").over(so_far))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_island")


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: int, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of overlapping intervals of a key, clipped to what they share.

    Both sides are laid out over buckets of ``bucket`` units and joined on key and
    bucket; a pair is kept in the bucket where its shared part begins, so none is
    met twice and no range join is run. Columns of the right side get ``_r``.
    """
    spread = lambda df: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    a = spread(left.where(F.col(start) < F.col(end)))
    b = spread(right.where(F.col(start) < F.col(end)))
    b = b.select(*keys, "_bucket", *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys])
    low, high = F.greatest(F.col(start), F.col(f"{start}_r")), F.least(F.col(end), F.col(f"{end}_r"))
    return a.join(b, [*keys, "_bucket"]).where((low < high) & (F.floor(low / bucket) == F.col("_bucket"))).drop("_bucket").withColumns({"clip_start": low, "clip_end": high})


def uncovered(gaps: DataFrame, repairs: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Gaps that no single repair of the key covers whole.

    Only the furthest end of the repairs that start at or before a gap can cover
    it, so a running maximum does and no range anti join is needed.
    """
    a = gaps.select(*keys, F.col(start).alias("_at"), F.lit(1).alias("_gap"), F.struct(*gaps.columns).alias("_row"))
    b = repairs.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_gap"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(end).alias("_end"))
    w = Window.partitionBy(*keys).orderBy("_at", "_gap").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("_reach", F.max("_end").over(w)).where("_gap = 1")
    return rows.where(F.col("_reach").isNull() | (F.col("_reach") < F.col(f"_row.{end}"))).select("_row.*")


def per_bucket(df: DataFrame, keys: Sequence[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Each interval cut at bucket borders: the covered units of every key and bucket."""
    cut = df.where(F.col(start) < F.col(end)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    low, high = F.greatest(F.col(start), F.col("bucket") * width), F.least(F.col(end), (F.col("bucket") + 1) * width)
    return cut.select(*keys, "bucket", (high - low).alias("_units")).groupBy(*keys, "bucket").agg(F.sum("_units").alias("units"), F.count("*").alias("pieces"))


def paired(markers: DataFrame, keys: Sequence[str], time: str, opens: Column, closes: Column, window_end: Column) -> DataFrame:
    """Opening markers with the next closing one of the key, or the window's end.

    Rows are read from the end: a frame that grows is carried along, one that
    shrinks would be gone through again for every row.
    """
    ahead = Window.partitionBy(*keys).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, -1)
    close = F.last(F.when(closes, F.col(time)), ignorenulls=True).over(ahead)
    rows = markers.withColumn("_close", close).where(opens)
    return rows.select(*keys, F.col(time).alias("start"), F.coalesce("_close", window_end).alias("end"), F.col("_close").isNotNull().alias("recovered"))
