"""Global orders without a single task: buckets of the order, then offsets of the buckets.

A window without partition keys gathers a table in one task. Here the order is cut
at approximate quantiles (a bounded list on the driver), each bucket is numbered
or summed by itself, and the totals of the buckets before it, a row each, are
added.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of an order at least; as many as the shuffle has partitions, if those are more.
BUCKETS = 64


def _place(x: str, cuts: list[float]) -> Column:
    """How many cuts lie below x: a binary search of a literal array, whose plan doesn't grow with it."""
    if not cuts:
        return F.lit(0)
    middle = "cast((a.low + a.high) div 2 as int)"
    step = f"""if(a.low >= a.high, a, if(cast(`{x}` as double) <= array({', '.join(f'{c!r}D' for c in cuts)})[{middle}],
        named_struct('low', a.low, 'high', {middle}), named_struct('low', {middle} + 1, 'high', a.high)))"""
    return F.expr(f"aggregate(sequence(1, {len(cuts).bit_length()}), named_struct('low', 0, 'high', {len(cuts)}), (a, i) -> {step}, a -> a.low)")


def bucketed(df: DataFrame, by: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``: equal values share one, and buckets are in the order of ``by`` (null first)."""
    buckets = buckets or max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = F.col(by).cast("double")
    got = df.select(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else None
    cuts = sorted({c for c in got or [] if math.isfinite(c)})
    return df.withColumn("_bucket", F.when(F.col(by).isNull(), -1).otherwise(_place(by, cuts)))


def _offsets(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    totals = df.groupBy("_bucket").agg(*[F.sum(m).alias(name) for name, m in measures.items()])
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    return totals.select("_bucket", *[F.coalesce(F.sum(name).over(ahead), F.lit(0)).alias(name) for name in measures])


def row_numbers(df: DataFrame, by: str, ties: Sequence[str], name: str = "row_number", buckets: int | None = None) -> DataFrame:
    """``df`` numbered from 1 in the order of ``by`` and ``ties``."""
    rows = bucketed(df, by, buckets)
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.asc_nulls_first(by), *ties))
    return rows.withColumn("_own", own).join(F.broadcast(_offsets(rows, {"_before": F.lit(1).cast("long")})), "_bucket").withColumn(name, F.col("_own") + F.col("_before")).drop("_bucket", "_own", "_before")


def running_before(df: DataFrame, by: str, value: str, name: str = "before", buckets: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of smaller ``by``."""
    rows = bucketed(df, by, buckets)
    own = F.sum(value).over(Window.partitionBy("_bucket").orderBy(F.asc_nulls_first(by)).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum(value).over(Window.partitionBy("_bucket", by))
    return rows.withColumn("_own", own).join(F.broadcast(_offsets(rows, {"_before": F.col(value)})), "_bucket").withColumn(name, F.col("_own") + F.col("_before")).drop("_bucket", "_own", "_before")


def ntile(df: DataFrame, by: str, ties: Sequence[str], n: int, name: str = "bin") -> DataFrame:
    """Equal-count bins of the order: the first ones hold one row more where rows don't divide."""
    rows = row_numbers(df, by, ties, "_rn").crossJoin(F.broadcast(df.agg(F.count("*").alias("_all"))))  # one row
    size, more = F.floor(F.col("_all") / n), F.col("_all") % n
    at = F.col("_rn") - 1
    wide = more * (size + 1)
    return rows.withColumn(name, (F.when(at < wide, F.floor(at / (size + 1))).otherwise(more + F.floor((at - wide) / F.greatest(size, F.lit(1)))) + 1).cast("int")).drop("_rn", "_all")
