"""Pre-arrival features, labels, fill probability, priors, synthetic arrivals and routing.

All of them are conditional aggregates over one bucketed join of orders with the
tape before (or after) their arrival; nothing after arrival enters a feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import clamp, piecewise, sigmoid

#: Decay of the exponentially weighted mean.
ALPHA = 0.35


def _near(orders: DataFrame, trades: DataFrame, start: Column, end: Column, bucket: int) -> DataFrame:
    laid = orders.withColumn("_from", start).withColumn("_to", end).where("_from <= _to").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_from") / bucket), F.floor(F.col("_to") / bucket))))
    tape = trades.select("market_id", "asset_id", "trade_id", F.col("block").alias("t_block"), F.col("side").alias("t_side"), F.col("price").alias("t_price"), F.col("size").alias("t_size"), F.floor(F.col("block") / bucket).alias("_bucket"))
    return laid.join(tape, ["market_id", "asset_id", "_bucket"]).where("t_block between _from and _to")


def arrival_features(orders: DataFrame, trades: DataFrame, *, lookback: int, bucket: int) -> DataFrame:
    """Counts, volumes, last prices and ages of the tape strictly before each order's arrival."""
    met = _near(orders, trades, F.col("arrival") - lookback, F.col("arrival") - 1, bucket)
    same, at = F.col("t_side") == F.col("side"), F.struct("t_block", "trade_id")
    got = met.groupBy("order_index").agg(
        F.count("*").alias("n_pre"), F.count_if(same).alias("n_same"), F.sum("t_size").cast("decimal(38,10)").alias("volume_pre"), F.sum(F.when(same, F.col("t_size"))).cast("decimal(38,10)").alias("volume_same"),
        F.max_by("t_price", at).alias("last_price"), F.max_by(F.when(F.col("t_side") == "BUY", F.col("t_price")), F.when(F.col("t_side") == "BUY", at)).alias("last_buy"),
        F.max_by(F.when(F.col("t_side") == "SELL", F.col("t_price")), F.when(F.col("t_side") == "SELL", at)).alias("last_sell"), F.max("t_block").alias("_last"), F.max("t_price").alias("high_pre"), F.min("t_price").alias("low_pre"),
    )
    rows = orders.join(got, "order_index", "left")
    return rows.withColumn("n_pre", F.coalesce("n_pre", F.lit(0).cast("long"))).withColumn("n_same", F.coalesce("n_same", F.lit(0).cast("long"))).withColumn("age", F.col("arrival") - F.col("_last")).drop("_last")


def fill_label(orders: DataFrame, trades: DataFrame, *, bucket: int) -> DataFrame:
    """Whether any volume of the order's side follows inside its time, and how much."""
    met = _near(orders, trades, F.col("arrival"), F.col("deadline"), bucket).where("t_side = side")
    got = met.groupBy("order_index").agg(F.sum("t_size").cast("decimal(38,10)").alias("future_volume"))
    return orders.select("order_index").join(got, "order_index", "left").select("order_index", F.coalesce("future_volume", F.lit(0).cast("decimal(38,10)")).alias("future_volume"), F.col("future_volume").isNotNull().cast("int").alias("label"))


def probability(features: DataFrame, weights: dict[str, tuple[float, float, float]], bias: float, knots: Sequence[tuple[float, float]]) -> DataFrame:
    """Logistic score of standardised features (weight, mean, scale), then a piecewise-linear calibration."""
    z = F.lit(bias)
    for name, (w, mean, scale) in weights.items():
        z = z + w * (F.coalesce(F.col(name).cast("double"), F.lit(mean)) - mean) / max(1e-10, scale)
    return features.withColumn("raw_probability", sigmoid(z)).withColumn("probability", piecewise(F.col("raw_probability"), list(knots)))


def blended(rows: DataFrame, local: str, n: str, prior: str, strength: float) -> Column:
    """A local estimate with weight n / (n + strength), the prior for the rest; the prior alone without one."""
    w = F.col(n) / (F.col(n) + strength)
    return F.coalesce(w * F.col(local) + (1 - w) * F.col(prior), F.col(prior))


def hierarchical_prior(rows: DataFrame, levels: Sequence[str], label: str, strength: float) -> DataFrame:
    """Shrunk rates of every cell of nested levels: (hits + strength * parent) / (n + strength).

    One aggregation by grouping sets, then one join with the parent a level; the
    overall rate is the root.
    """
    keys = list(levels)
    every = rows.rollup(*keys).agg((len(keys) - F.bit_count(F.grouping_id())).cast("int").alias("depth"), F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("hits"))
    cells = None
    for i in range(len(keys) + 1):
        got = every.where(F.col("depth") == i).select(*[F.col(k).alias(k) for k in keys], "depth", "n", "hits")
        if i == 0:
            out = got.withColumn("rate", F.col("hits") / F.col("n"))
            cells = out
            continue
        parent = out.select(*[F.col(k).alias(f"_{k}") for k in keys[: i - 1]], F.col("rate").alias("_parent"))
        on = F.lit(True)
        for k in keys[: i - 1]:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        joined = got.crossJoin(F.broadcast(parent)) if i == 1 else got.join(parent, on)  # the root is one row
        out = joined.withColumn("rate", (F.col("hits") + strength * F.col("_parent")) / (F.col("n") + strength)).select(*keys, "depth", "n", "hits", "rate")
        cells = cells.unionByName(out)
    return cells


def synthetic_arrival(features: DataFrame, *, participation: float, tick: float, min_trades: int = 2) -> DataFrame:
    """Expected price and size bands from the tape before arrival; abstains on fewer than ``min_trades``."""
    buy, sell, last = (F.col(c).cast("double") for c in ("last_buy", "last_sell", "last_price"))
    mid = F.coalesce((buy + sell) / 2, last)
    spread = F.coalesce(F.abs(buy - sell), F.lit(tick))
    rate = F.col("volume_same").cast("double") * participation
    share = F.least(F.lit(1.0), F.col("size").cast("double") / F.greatest(F.lit(1e-9), F.col("volume_pre").cast("double")))
    impact = F.greatest(F.lit(1.0), 100 * share * share) * tick
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    price = clamp(mid + sign * (spread / 2 + impact), 0.0, 1.0)
    known = F.col("n_pre") >= min_trades
    return features.select("order_index", F.when(known, price).alias("expected_price"), *[F.when(known, F.least(F.col("size").cast("double"), k * F.coalesce(rate, F.lit(0.0)))).alias(f"q{q}") for q, k in ((10, 0.5), (50, 1.0), (90, 2.0))], F.when(~known, "MODEL_DOMAIN_ABSTAIN").alias("abstained"))


def routed(orders: DataFrame, confirmed: DataFrame, modelled: DataFrame) -> DataFrame:
    """The source-confirmed fill where there is one, else the modelled one, else none, with its bounds.

    Both sides: order_index, filled. The lower bound is what is confirmed, the upper
    the larger of both.
    """
    rows = orders.select("order_index").join(confirmed.select("order_index", F.col("filled").alias("_c")), "order_index", "left").join(modelled.select("order_index", F.col("filled").alias("_m")), "order_index", "left")
    return rows.select("order_index", F.coalesce("_c", "_m", F.lit(0.0)).alias("filled"), F.when(F.col("_c").isNotNull(), "SOURCE").when(F.col("_m").isNotNull(), "MODEL").otherwise("NONE").alias("route"), F.coalesce("_c", F.lit(0.0)).alias("lower"), F.greatest(F.coalesce("_c", F.lit(0.0)), F.coalesce("_m", F.lit(0.0))).alias("upper"))


def strata_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], value: str, min_samples: int) -> DataFrame:
    """The value of the finest stratum with enough samples: all keys, then one less, down to none.

    ``table`` holds n and ``value`` for each full key; coarser strata are sums of it.
    """
    out, found = rows, F.lit(None).cast("double")
    for depth in range(len(keys), -1, -1):
        own = list(keys[:depth])
        level = table.groupBy(*own).agg(F.sum("n").alias(f"_n{depth}"), F.sum(F.col("n") * F.col(value)).alias("_s")).where(F.col(f"_n{depth}") >= min_samples).select(*own, (F.col("_s") / F.col(f"_n{depth}")).alias(f"_v{depth}"))
        out = out.join(level, own, "left") if own else out.join(F.broadcast(level), F.lit(True), "left")
        found = F.coalesce(found, F.col(f"_v{depth}"))
    depths = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), i) for i in range(len(keys), -1, -1)])
    return out.select(*rows.columns, found.alias("estimate"), depths.alias("depth"))


def lob_validity(features: DataFrame, *, trades: float, volume: float, age: float) -> DataFrame:
    """The least of the ratios to what is wanted, and its tier."""
    ratios = [F.least(F.lit(1.0), F.col("n_pre") / trades), F.least(F.lit(1.0), F.coalesce(F.col("volume_pre").cast("double"), F.lit(0.0)) / volume), F.coalesce(F.least(F.lit(1.0), age / F.greatest(F.lit(1.0), F.col("age").cast("double"))), F.lit(0.0))]
    score = F.least(*ratios)
    return features.select("order_index", score.alias("score"), F.when(score >= 0.8, "eligible").when(score >= 0.4, "review").otherwise("ineligible").alias("tier"))


def portfolio_limits(signals: DataFrame, day: str, order: Sequence[str], cost: str, daily: float) -> DataFrame:
    """Signals of a day taken greedily in order while their cost stays within the day's limit."""
    import pandas as pd

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        spent, taken = 0.0, []
        for r in rows.sort_values(list(order)).to_dict("records"):
            ok = spent + r[cost] <= daily
            spent += r[cost] if ok else 0.0
            taken.append({**r, "taken": ok})
        return pd.DataFrame(taken)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signals.schema) + ", taken boolean"
    return signals.groupBy(day).applyInPandas(fold, schema)


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
