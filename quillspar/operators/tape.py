"""Raw fills to an audited tape: canonical fills, ticks, rejects, prints, bars.

Raw fills: tx_hash, log_index, market_id, token_id, maker, taker, side_code,
price, size, block_number, ingested_at. Every grouping key is a plain column, so
each stage is one partial and one final aggregation on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import PRICE, SIZE, ratio

IDENTITY = ("tx_hash", "log_index", "market_id", "token_id", "maker", "taker", "side_code")


def latest(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row a key, that of the highest version; null columns stay null."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"))
    return got.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def conflicts(df: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Keys with more than one distinct payload: rows and payloads of each."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*payload)).alias("n_payloads")).where("n_payloads > 1")


def reject_reason(exchange: Sequence[str] = ()) -> Column:
    """Why a fill is no tick: the first reason that holds, null for none."""
    reason = (
        F.when(F.col("price").isNull() | (F.col("price") <= 0), "price_not_positive")
        .when(F.col("price") > 1, "price_above_one")
        .when(F.col("size") <= 0, "size_not_positive")
        .when(~F.col("side_code").isin(1, 2), "unsupported_side")
        .when(F.coalesce(F.col("maker").cast("string"), F.lit("")) == "", "missing_maker")
        .when(F.coalesce(F.col("token_id").cast("string"), F.lit("")) == "", "missing_token")
        .when(F.col("block_time").isNull(), "missing_block_time")
    )
    return reason.when(F.col("taker").isin(*exchange), "internal_counterparty") if exchange else reason


def judged(fills: DataFrame, exchange: Sequence[str] = ()) -> DataFrame:
    """Fills with their reject reason and, for ticks, both sides named and an id."""
    one = F.col("side_code") == 1
    return fills.withColumn("reject_reason", reject_reason(exchange)).withColumns(
        {
            "aggressor_side": F.when(one, "BUY").when(F.col("side_code") == 2, "SELL"),
            "passive_side": F.when(one, "SELL").when(F.col("side_code") == 2, "BUY"),
            "fill_id": F.sha2(F.concat_ws("|", F.lit("fill"), *[F.col(c).cast("string") for c in IDENTITY]), 256),
        }
    )


def prints(ticks: DataFrame) -> DataFrame:
    """Fills of one transaction, token, direction and price as one print."""
    keys = ["tx_hash", "market_id", "token_id", "aggressor_side", "passive_side", "price", "block_number"]
    return (
        ticks.groupBy(*keys)
        .agg(
            F.sum("size").cast("decimal(38,10)").alias("size_shares"), F.count("*").alias("source_fill_count"), F.array_sort(F.collect_list("log_index")).alias("source_log_indexes"),
            F.array_sort(F.collect_set("maker")).alias("makers"), F.min("block_time").alias("block_time"),
        )
        .withColumn("trade_id", F.sha2(F.concat_ws("|", F.lit("trade"), *[F.col(k).cast("string") for k in keys if k != "price"], F.col("price").cast(PRICE).cast("string")), 256))
    )


def bars(trades: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """Open, high, low, close, volumes and vwap of each key, by a total order of its trades.

    Sparse: a key without trades has no row. Decimal sums are exact, so the
    result does not depend on how rows are spread.
    """
    at = F.struct(*order)
    buy = F.col("side") == "BUY"
    nothing = F.lit(0).cast(SIZE)
    return (
        trades.groupBy(*keys)
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
            F.sum("size").cast("decimal(38,10)").alias("volume"), F.sum(F.when(buy, F.col("size")).otherwise(nothing)).cast("decimal(38,10)").alias("buy_volume"),
            F.sum(F.when(buy, nothing).otherwise(F.col("size"))).cast("decimal(38,10)").alias("sell_volume"), F.count("*").alias("trades"),
            F.sum(F.col("price") * F.col("size")).alias("_turnover"),
        )
        .withColumn("vwap", ratio(F.col("_turnover"), F.col("volume")))
        .drop("_turnover")
    )


def time_bars(trades: DataFrame, interval: str, keys: Sequence[str] = ("asset_id",), order: Sequence[str] = ("block_time", "trade_id")) -> DataFrame:
    """Tumbling bars; ``bar_start`` is the interval's beginning."""
    return bars(trades.withColumn("bar_start", F.window("block_time", interval).start), [*keys, "bar_start"], order)


def extrapolated(blocks: DataFrame, clock: DataFrame, anchor_block: int, anchor_time: str, seconds: int) -> DataFrame:
    """``blocks`` with block_time, extrapolated from an anchor where the clock has none."""
    guess = F.timestamp_add("SECOND", (F.col("block_number") - anchor_block) * seconds, F.lit(anchor_time).cast("timestamp_ntz"))
    return blocks.join(clock.select("block_number", F.col("block_time").alias("_known")), "block_number", "left").select(
        *blocks.columns, F.coalesce("_known", guess).alias("block_time"), F.col("_known").isNull().alias("extrapolated")
    )


def conservation(raw: DataFrame) -> DataFrame:
    """Judged fills in one row of counts, with whether ticks and rejects make up the whole."""
    tick = F.col("reject_reason").isNull()
    return raw.agg(
        F.count("*").alias("raw_rows"), F.count_if(tick).alias("tick_rows"), F.count_if(~tick).alias("quarantine_rows"),
        F.sum(F.when(tick, F.col("size"))).cast("decimal(38,10)").alias("tick_size"), F.count_distinct("fill_id").alias("fill_ids"),
    ).withColumn("conserved", F.col("tick_rows") + F.col("quarantine_rows") == F.col("raw_rows"))
