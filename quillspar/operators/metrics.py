"""Metrics of runs and fills, quality of probabilities, books from a checkpoint on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.classify import first_match

WIDE = "decimal(38,10)"


def run_metrics(trades: DataFrame, keys: Sequence[str], order: Sequence[str], pnl: str) -> DataFrame:
    """What a run's trades came to: counts, sums, ratios, drawdown and the longest streaks.

    ``pnl`` is a decimal. Sums are exact; ratios are one division of them; null
    where there is nothing to divide by. A streak is a stretch of trades on one
    side of zero.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("_v", F.col(pnl).cast("decimal(18,4)")).withColumn("_equity", F.sum("_v").over(run).cast("decimal(28,4)"))
    rows = rows.withColumn("_peak", F.greatest(F.lit(0).cast("decimal(28,4)"), F.max("_equity").over(run))).withColumn("_side", F.signum("_v").cast("int"))
    rows = rows.withColumn("_new", F.coalesce((F.col("_side") != F.lag("_side").over(w)).cast("int"), F.lit(1))).withColumn("_streak", F.sum("_new").over(run))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_streak").orderBy(*order)))
    v, total = F.col("_v"), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,4)")
    got = rows.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(v > 0).alias("wins"), F.count_if(v < 0).alias("losses"), F.count_if(v == 0).alias("flat"), total(v).alias("net"), total(F.when(v > 0, v)).alias("gross_profit"), total(F.when(v < 0, -v)).alias("gross_loss"),
        F.max(v).alias("best"), F.min(v).alias("worst"), F.sum((v * v).cast("decimal(28,8)")).cast("decimal(38,8)").alias("_squares"), F.sum(F.when(v < 0, (v * v).cast("decimal(28,8)"))).cast("decimal(38,8)").alias("_down"),
        F.max(F.col("_peak") - F.col("_equity")).cast("decimal(28,4)").alias("max_drawdown"), F.max("_peak").alias("peak"), F.coalesce(F.max(F.when(v > 0, F.col("_nth"))), F.lit(0)).alias("win_streak"), F.coalesce(F.max(F.when(v < 0, F.col("_nth"))), F.lit(0)).alias("loss_streak"),
        F.count_if(F.col("_peak") > F.col("_equity")).alias("trades_under_water"),
    )
    one = lambda c: F.col(c).cast("double")
    over = lambda a, b: F.when(b != 0, a / b)
    mean = one("net") / one("trades")
    deviation = F.when(F.col("trades") > 1, F.sqrt(F.greatest(F.lit(0.0), (one("_squares") - one("net") * mean) / (one("trades") - 1))))
    downside = F.sqrt(F.coalesce(one("_down"), F.lit(0.0)) / one("trades"))
    return got.withColumns({
        "win_rate": one("wins") / one("trades"), "loss_rate": one("losses") / one("trades"), "mean": mean, "deviation": deviation, "downside": downside, "sharpe": over(mean, deviation), "sortino": over(mean, downside),
        "profit_factor": over(one("gross_profit"), one("gross_loss")), "average_win": over(one("gross_profit"), one("wins")), "average_loss": over(one("gross_loss"), one("losses")), "payoff": over(one("gross_profit") * one("losses"), one("wins") * one("gross_loss")),
        "expectancy": mean, "recovery": over(one("net"), one("max_drawdown")), "under_water": one("trades_under_water") / one("trades"), "range": one("best") - one("worst"),
    }).drop("_squares", "_down")


def fill_quality(results: DataFrame, fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters of each group of orders: how many filled, how much of what was asked, how late and how much better than the limit."""
    gain = F.when(F.col("side") == "BUY", F.col("limit_price") - F.col("exec_price")).otherwise(F.col("exec_price") - F.col("limit_price"))
    per = fills.groupBy("order_index").agg(F.sum((gain * F.col("qty").cast("decimal(26,10)")).cast(WIDE)).cast(WIDE).alias("_gain"), F.min("block").alias("_first"), F.max("block").alias("_last"))
    rows = results.join(per, "order_index", "left")
    asked, got = F.col("size").cast(WIDE), F.col("filled").cast(WIDE)
    nil = lambda c: F.coalesce(c, F.lit(0).cast(WIDE)).cast(WIDE)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("orders"), F.count_if(got >= asked).alias("whole"), F.count_if((got > 0) & (got < asked)).alias("partial"), F.count_if(got <= 0).alias("unfilled"), F.sum(asked).cast(WIDE).alias("requested"), F.sum(got).cast(WIDE).alias("filled"),
        nil(F.sum("_gain")).alias("improvement"), F.coalesce(F.sum(F.col("_first") - F.col("arrival")), F.lit(0).cast("long")).alias("wait_blocks"), F.coalesce(F.max(F.col("_last") - F.col("_first")), F.lit(0).cast("long")).alias("longest_fill"), F.coalesce(F.sum("n_fills"), F.lit(0).cast("long")).alias("fills"),
    )
    rate = F.col("filled").cast("double") / F.col("requested").cast("double")
    return out.withColumn("fill_rate", rate).withColumn("verdict", first_match([(rate >= 0.8, "good"), (rate >= 0.3, "fair")], "poor"))


def probability_quality(rows: DataFrame, keys: Sequence[str], p: str, y: str, *, floor: float = 1e-6) -> DataFrame:
    """Brier score and log-loss of each group against always saying the group's base rate: skill and regret of both."""
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.col(p).cast("double")))
    loss = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    got = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("hits"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg(loss).alias("log_loss"))
    base = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.col("hits") / F.col("n")))
    got = got.withColumn("base_rate", F.col("hits") / F.col("n")).withColumn("base_brier", F.col("base_rate") * (1 - F.col("base_rate"))).withColumn("base_log_loss", -(F.col("base_rate") * F.log(base) + (1 - F.col("base_rate")) * F.log(1 - base)))
    skill = lambda a, b: F.when(F.col(b) > 0, 1 - F.col(a) / F.col(b))
    return got.withColumns({"brier_skill": skill("brier", "base_brier"), "log_skill": skill("log_loss", "base_log_loss"), "brier_regret": F.col("brier") - F.col("base_brier"), "log_regret": F.col("log_loss") - F.col("base_log_loss")})


def checkpoint(events: DataFrame, keys: Sequence[str], at: int) -> DataFrame:
    """The last size of every level up to ``at``, with its seq: what a replay can start from."""
    return events.where(F.col("seq") <= at).groupBy(*keys).agg(F.max_by("size", "seq").alias("size"), F.max("seq").alias("seq"))


def book_from(start: DataFrame, events: DataFrame, keys: Sequence[str], since: int, at: int) -> DataFrame:
    """Levels at ``at`` from a checkpoint of ``since`` and the events after it only; empty levels are gone."""
    new = events.where((F.col("seq") > since) & (F.col("seq") <= at)).select(*keys, "size", "seq")
    return start.select(*keys, "size", "seq").unionByName(new).groupBy(*keys).agg(F.max_by("size", "seq").alias("size")).where("size > 0")


def alignment(fills: DataFrame, books: DataFrame, keys: Sequence[str], x: str, max_lag: int) -> DataFrame:
    """Fills against the book before them, by what it shows: no book, a stale one, inside, at or through the quotes."""
    from .asof import asof

    met = asof(fills, books, list(keys), x, ["bid", "ask"], strict=True)
    kind = first_match(
        [
            (F.col("bid").isNull() | F.col("ask").isNull(), "no_book"), (F.col(x) - F.col(f"{x}_matched") > max_lag, "stale_book"), ((F.col("price") > F.col("ask")) | (F.col("price") < F.col("bid")), "through"),
            ((F.col("price") == F.col("ask")) | (F.col("price") == F.col("bid")), "at_quote"),
        ],
        "inside",
    )
    return met.withColumn("alignment", kind)
