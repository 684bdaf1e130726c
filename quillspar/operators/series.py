"""Window operators over series: downsampling, gaps, drawdown, rolling figures, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .asof import locf


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each key; Spark prunes to n rows a task before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).withColumnRenamed("_rank", "rank")


def latest_then_ascending(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of the highest key, lowest first."""
    return df.orderBy(F.desc(key)).limit(n).orderBy(key)


def m4(series: DataFrame, keys: Sequence[str], x: str, value: str, max_points: int) -> DataFrame:
    """At most about ``max_points`` rows of each key: first, last, lowest and highest of equal buckets.

    Rows of a series no longer than that are all kept. Ties take the earliest x.
    """
    whole = Window.partitionBy(*keys)
    buckets = max(1, (max_points - 2) // 4)
    n = F.count("*").over(whole)
    rn = F.row_number().over(whole.orderBy(x))
    rows = series.withColumn("_n", n).withColumn("_rn", rn)
    width = F.ceil(F.col("_n") / buckets)
    rows = rows.withColumn("bucket", F.when(F.col("_n") <= max_points, F.col("_rn")).otherwise(F.floor((F.col("_rn") - 1) / width)))
    pick = rows.groupBy(*keys, "bucket").agg(
        F.array_distinct(F.array(F.min(x), F.max(x), F.min_by(x, F.struct(value, x)), F.min_by(x, F.struct(-F.col(value), F.col(x))))).alias("_at")
    )
    return pick.select(*keys, "bucket", F.explode("_at").alias(x)).join(series, [*keys, x])


def steps(series: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Each row with the distance from the row before."""
    return series.withColumn("step", F.col(x) - F.lag(x).over(Window.partitionBy(*keys).orderBy(x)))


def gap_thresholds(series: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Gap and stale limits of each key from exact percentiles of its positive steps."""
    got = steps(series, keys, x).where("step > 0").groupBy(*keys).agg(*[F.expr(f"percentile(step, {q})").alias(f"p{str(q)[2:]}") for q in (0.5, 0.99, 0.999)])
    one = F.lit(1.0)
    return got.select(*keys, F.greatest(one, 30 * F.col("p5"), 8 * F.col("p99"), 4 * F.col("p999")).alias("gap_limit"), F.greatest(one, 4 * F.col("p5"), 2 * F.col("p99")).alias("stale_limit"))


def jumps(series: DataFrame, keys: Sequence[str], x: str, value: str, limit) -> DataFrame:
    """Rows whose value moved by more than ``limit`` from the row before."""
    w = Window.partitionBy(*keys).orderBy(x)
    return series.withColumn("move", F.col(value) - F.lag(value).over(w)).where(F.abs("move") > limit)


def drawdown(series: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Running peak and the fall from it."""
    peak = F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return series.withColumn("peak", peak).withColumn("drawdown", F.col("peak") - F.col(value))


def rolling_sum(series: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int) -> DataFrame:
    """Sums over full windows of ``rows`` rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = series.withColumn("rolling", F.sum(value).over(w.rowsBetween(1 - rows, 0))).withColumn("_rn", F.row_number().over(w))
    return out.where(F.col("_rn") >= rows).drop("_rn")


def ewma(series: DataFrame, keys: Sequence[str], order: str, value: str, alpha: float) -> DataFrame:
    """The last exponentially weighted mean of each key, begun at its first value."""
    got = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("double").alias("v")))).alias("_s"))
    fold = F.aggregate(F.slice("_s", 2, F.size("_s")), F.col("_s")[0]["v"], lambda a, x: F.lit(alpha) * x["v"] + F.lit(1 - alpha) * a)
    return got.select(*keys, fold.alias("ewma"))


def roll_spread(series: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """2 * sqrt(max(0, -cov)) of successive changes of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    moves = series.withColumn("_d", (F.col(value) - F.lag(value).over(w)).cast("double")).withColumn("_e", F.lag("_d").over(w))
    got = moves.where("_d is not null and _e is not null").groupBy(*keys).agg(F.covar_pop("_d", "_e").alias("_c"), F.count("*").alias("n_pairs"))
    return got.select(*keys, "n_pairs", (2 * F.sqrt(F.greatest(F.lit(0.0), -F.col("_c")))).alias("roll_spread"))


def locf_correlation(series: DataFrame, key: str, x: str, value: str, step: int, min_pairs: int) -> DataFrame:
    """Pearson correlation of grid-sampled changes for each pair of keys."""
    grid = locf(series, [key], x, value, step).withColumn(x, F.floor(F.col(x) / step) * step)
    grid = grid.groupBy(key, x).agg(F.max_by(value, x).alias(value))
    moves = grid.withColumn("d", (F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(x))).cast("double")).where("d is not null").select(key, x, "d")
    a, b = moves.select(F.col(key).alias("left_key"), x, F.col("d").alias("a")), moves.select(F.col(key).alias("right_key"), x, F.col("d").alias("b"))
    both = a.join(b, x).where("left_key < right_key").groupBy("left_key", "right_key").agg(F.count("*").alias("n"), F.corr("a", "b").alias("corr"))
    return both.where(F.col("n") >= min_pairs)


def markout(fills: DataFrame, prices: DataFrame, keys: Sequence[str], x: str, price: str, horizon: int) -> DataFrame:
    """Price move in the fill's favour at the first price at or after x + horizon."""
    from .asof import asof

    later = fills.withColumn("_fill_x", F.col(x)).withColumn(x, F.col(x) + horizon)
    got = asof(later, prices.select(*keys, x, F.col(price).alias("later_price")), keys, x, ["later_price"], forward=True)
    move = F.when(F.col("side") == "BUY", F.col("later_price") - F.col(price)).otherwise(F.col(price) - F.col("later_price"))
    return got.withColumn(x, F.col("_fill_x")).withColumn("markout", move).drop("_fill_x", f"{x}_matched")


def sessions(events: DataFrame, keys: Sequence[str], time: str, gap: str) -> DataFrame:
    """Sessions of events no more than ``gap`` apart."""
    return events.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n_events"), F.min(time).alias("first_at"), F.max(time).alias("last_at")).drop("w")
