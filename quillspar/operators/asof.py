"""As-of joins without a range join: one shuffle on the key and one sort.

Both sides are stacked, ordered by time in each key (from the end if forward), and
the last right row is carried along: a frame that shrinks instead of growing would
be gone through again for every row. A hot key would be one partition of that window, so its time
may be cut in blocks (``block``): what is carried into a block comes from the
blocks before it, of which there is one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], *, forward: bool = False, strict: bool = False, tie: Sequence[str] = (), max_lag: int | None = None, lag_unit: str = "SECOND", block: Callable[[Column], Column] | None = None) -> DataFrame:
    """``left`` with the latest right ``values`` at or before its time (or the first at or after).

    ``strict`` leaves out rows of the same time. Of right rows at one time the
    highest by ``tie`` counts (the lowest if forward). Rows without a match, or
    with one further off than ``max_lag``, get nulls. The match's time is
    ``{time}_matched``. ``block`` maps a time to its block and does not fall
    as time goes on.
    """
    payload = F.struct(F.col(time).alias("_t"), *values)
    none = F.lit(None)
    a = left.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"), *[none.cast(right.schema[t].dataType).alias(f"_tie_{t}") for t in tie])
    a = a.withColumn("_hit", none.cast(right.select(payload.alias("x")).schema["x"].dataType))
    b = right.select(*keys, F.col(time).alias("_at"), F.lit(0).alias("_left"), none.cast(a.schema["_row"].dataType).alias("_row"), *[F.col(t).alias(f"_tie_{t}") for t in tie], payload.alias("_hit"))
    # at equal times: backward takes right rows first, strict takes them last
    last = (0 if forward else 1) if not strict else (1 if forward else 0)
    place = F.when(F.col("_left") == 1, last).otherwise(1 - last)
    along = F.desc if forward else F.asc
    order = [along("_at"), along(place), *[along(f"_tie_{t}") for t in tie]]
    rows = a.unionByName(b).withColumn("_block", F.lit(0) if block is None else block(F.col("_at")))
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_got", F.last("_hit", ignorenulls=True).over(w)).where("_left = 1")
    if block is not None:
        version = F.struct("_at", *[f"_tie_{t}" for t in tie])
        best = (F.min_by if forward else F.max_by)("_hit", F.when(F.col("_left") == 0, version))
        blocks = rows.groupBy(*keys, "_block").agg(best.alias("_best"))
        ahead = Window.partitionBy(*keys).orderBy(along("_block")).rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.last("_best", ignorenulls=True).over(ahead).alias("_carried"))
        same = F.col("_block") == F.col("_b")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        out = out.join(carried, same, "left").withColumn("_got", F.coalesce("_got", "_carried"))
    got = out.select("_row.*", *[F.col(f"_got.{v}").alias(v) for v in values], F.col("_got._t").alias(f"{time}_matched"))
    if max_lag is None:
        return got
    near = F.abs(F.timestamp_diff(lag_unit, F.col(f"{time}_matched"), F.col(time))) <= max_lag
    return got.select(*left.columns, *[F.when(near, F.col(v)).alias(v) for v in [*values, f"{time}_matched"]])


def locf(series: DataFrame, keys: Sequence[str], x: str, value: str, step: int) -> DataFrame:
    """The last value on a grid of ``step`` from each key's first to last x."""
    span = series.groupBy(*keys).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))).alias(x))
    return asof(grid, series.select(*keys, x, value), keys, x, [value]).drop(f"{x}_matched")
