"""Tape building: scans, canonical fills, rejects, prints, bars, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tape as T
from ..operators.prefix import row_numbers
from .adapters import FILLS, TAPE, plan, raw_fills, table, tape

_BAR = """min_by(price, (block_time, trade_id)) as open, max(price) as high, min(price) as low, max_by(price, (block_time, trade_id)) as close,
    cast(sum(size) as decimal(38,10)) as volume, cast(sum(case when side = 'BUY' then size else 0 end) as decimal(38,10)) as buy_volume,
    cast(sum(case when side = 'BUY' then 0 else size end) as decimal(38,10)) as sell_volume, count(*) as trades,
    cast(sum(price * size) as double) / cast(cast(sum(size) as decimal(38,10)) as double) as vwap"""


def _canon(spark, d):
    return T.latest(raw_fills(spark, d), T.IDENTITY, ("ingested_at", "size"))


def _judged(spark, d):
    return T.judged(_canon(spark, d))


def _bars(interval):
    return lambda spark, d: T.time_bars(tape(spark, d), interval)


def _bars_sql(bucket):
    return f"with {TAPE} select asset_id, {bucket} as bar_start, {_BAR} from tape group by asset_id, {bucket}"


_REASON = """case when price is null or price <= 0 then 'price_not_positive' when price > 1 then 'price_above_one' when size <= 0 then 'size_not_positive'
    when side_code not in (1, 2) then 'unsupported_side' when coalesce(cast(maker as varchar), '') = '' then 'missing_maker' when coalesce(cast(token_id as varchar), '') = '' then 'missing_token'
    when block_time is null then 'missing_block_time' end"""
_JUDGED = f"""{FILLS}, judged as (select *, {_REASON} as reject_reason, case when side_code = 1 then 'BUY' when side_code = 2 then 'SELL' end as aggressor_side,
    case when side_code = 1 then 'SELL' when side_code = 2 then 'BUY' end as passive_side,
    sha256('fill|' || tx_hash || '|' || log_index || '|' || market_id || '|' || token_id || '|' || maker || '|' || taker || '|' || side_code) as fill_id from canon)"""


def _prints(spark, d):
    return T.prints(_judged(spark, d).where("reject_reason is null"))


def _extrapolated(spark, d):
    fills = table(spark, d, "orders").select(F.col("o_orderkey").alias("block_number"))
    clock = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("block_number"), F.col("o_orderdate").alias("block_time"))
    return T.extrapolated(fills, clock, 100, "1995-01-01 00:00:00", 2)


def _block_close(spark, d):
    ticks = _judged(spark, d)
    clean = ticks.where("reject_reason is null")
    stats = ticks.groupBy("token_id", "block_number").agg(F.count("*").alias("raw_fills"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), F.count_if(F.col("side_code") == 3).alias("bad_side"))
    at = F.struct("log_index", "tx_hash", "maker", "price", "size")
    close = clean.groupBy("token_id", "block_number").agg(F.max_by("price", at).alias("close"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("size").cast("decimal(38,10)").alias("volume"))
    return close.join(stats, ["token_id", "block_number"])


PLANS = {
    "time_bars_5m": (_bars("5 minutes"), _bars_sql("time_bucket(interval 5 minutes, block_time)")),
    "time_bars_1h": (_bars("1 hour"), _bars_sql("date_trunc('hour', block_time)")),
    "time_bars_1d": (_bars("1 day"), _bars_sql("cast(date_trunc('day', block_time) as timestamp)")),
    "block_bars": (
        lambda s, d: T.bars(tape(s, d).withColumn("block", F.floor(F.col("block") / 10)), ["asset_id", "block"], ["block_time", "trade_id"]),
        f"with {TAPE} select asset_id, block // 10 as block, {_BAR} from tape group by asset_id, block // 10",
    ),
    "canonical_fills": (_canon, f"with {FILLS} select * from canon"),
    "quarantine": (
        lambda s, d: _judged(s, d).where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"), F.sum("size").cast("decimal(38,10)").alias("size")),
        f"with {_JUDGED} select reject_reason, count(*) as n, cast(sum(size) as decimal(38,10)) as size from judged where reject_reason is not null group by 1",
    ),
    "ticks": (
        lambda s, d: _judged(s, d).where("reject_reason is null").select("fill_id", "tx_hash", "log_index", "token_id", "aggressor_side", "passive_side", "price", "size"),
        f"with {_JUDGED} select fill_id, tx_hash, log_index, token_id, aggressor_side, passive_side, price, size from judged where reject_reason is null",
    ),
    "trade_prints": (
        lambda s, d: _prints(s, d).select("tx_hash", "token_id", "aggressor_side", "price", "size_shares", "source_fill_count", "source_log_indexes", "makers", "trade_id"),
        f"""with {_JUDGED} select tx_hash, token_id, aggressor_side, price, cast(sum(size) as decimal(38,10)) as size_shares, count(*) as source_fill_count, list_sort(list(log_index)) as source_log_indexes,
            list_sort(list_distinct(list(maker))) as makers,
            sha256('trade|' || tx_hash || '|' || market_id || '|' || token_id || '|' || aggressor_side || '|' || passive_side || '|' || block_number || '|' || cast(price as varchar)) as trade_id
            from judged where reject_reason is null group by tx_hash, market_id, token_id, aggressor_side, passive_side, price, block_number""",
    ),
    "layer_conservation": (
        lambda s, d: T.conservation(_judged(s, d)),
        f"""with {_JUDGED} select count(*) as raw_rows, count(*) filter (where reject_reason is null) as tick_rows, count(*) filter (where reject_reason is not null) as quarantine_rows,
            cast(sum(size) filter (where reject_reason is null) as decimal(38,10)) as tick_size, count(distinct fill_id) as fill_ids, true as conserved from judged""",
    ),
    "identity_conflicts": (
        lambda s, d: T.conflicts(raw_fills(s, d), T.IDENTITY, ("price", "size")),
        f"""with {FILLS} select tx_hash, log_index, market_id, token_id, maker, taker, side_code, count(*) as n_rows, count(distinct (price, size)) as n_payloads from fills group by all having count(distinct (price, size)) > 1""",
    ),
    "clock_conflicts": (
        lambda s, d: T.conflicts(raw_fills(s, d).select("block_number", "block_time"), ["block_number"], ["block_time"]),
        f"with {FILLS} select block_number, count(*) as n_rows, count(distinct block_time) as n_payloads from fills group by 1 having count(distinct block_time) > 1",
    ),
    "anchor_extrapolation": (
        _extrapolated,
        """select o_orderkey as block_number, case when o_orderkey % 3 <> 0 then o_orderdate else timestamp '1995-01-01 00:00:00' + to_seconds((o_orderkey - 100) * 2) end as block_time, o_orderkey % 3 = 0 as extrapolated from orders""",
    ),
    "block_close": (
        _block_close,
        f"""with {_JUDGED}, st as (select token_id, block_number, count(*) as raw_fills, count(*) filter (where reject_reason is not null) as rejected, count(*) filter (where side_code = 3) as bad_side from judged group by 1, 2),
            c as (select token_id, block_number, max_by(price, (log_index, tx_hash, maker, price, size)) as close, min_by(price, (log_index, tx_hash, maker, price, size)) as open, max(price) as high, min(price) as low, cast(sum(size) as decimal(38,10)) as volume
                  from judged where reject_reason is null group by 1, 2)
            select c.*, raw_fills, rejected, bad_side from c join st using (token_id, block_number)""",
    ),
    "point_in_time_scan": (
        lambda s, d: T.latest(raw_fills(s, d).where(F.col("ingested_at") < F.lit("1998-01-01").cast("timestamp_ntz")), T.IDENTITY, ("ingested_at", "size")).groupBy("market_id").agg(F.count("*").alias("n"), F.sum("size").cast("decimal(38,10)").alias("size"), F.max("block_number").alias("high_block")),
        f"""with {FILLS}, p as (select * from (select *, row_number() over (partition by tx_hash, log_index, market_id, token_id, maker, taker, side_code order by ingested_at desc, size desc) as rn from fills where ingested_at < timestamp '1998-01-01') where rn = 1)
            select market_id, count(*) as n, cast(sum(size) as decimal(38,10)) as size, max(block_number) as high_block from p group by 1""",
    ),
    "wallet_slice": (
        lambda s, d: raw_fills(s, d).where("maker = 3 or taker = 3").select("tx_hash", "log_index", "token_id", "size", F.when(F.col("maker") == 3, "MAKER").otherwise("TAKER").alias("role")),
        f"with {FILLS} select tx_hash, log_index, token_id, size, case when maker = 3 then 'MAKER' else 'TAKER' end as role from fills where maker = 3 or taker = 3",
    ),
    "print_slice": (
        lambda s, d: tape(s, d).where("block between 100 and 400 and side = 'BUY' and market_id = 1").select("trade_id", "asset_id", "block", "price", "size").orderBy("block", "trade_id"),
        f"with {TAPE} select trade_id, asset_id, block, price, size from tape where block between 100 and 400 and side = 'BUY' and market_id = 1",
    ),
    "missing_clock_anti": (
        lambda s, d: table(s, d, "lineitem").select(F.col("l_orderkey").alias("block_number")).distinct().join(table(s, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("block_number")), "block_number", "left_anti"),
        "select distinct l_orderkey as block_number from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 3 <> 0)",
    ),
    "conditional_latest": (
        lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.max_by(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey"))).alias("last_f"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f")),
        "select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) filter (where o_orderstatus = 'F') as last_f, count(*) filter (where o_orderstatus = 'F') as n_f from orders group by 1",
    ),
    "asset_map_latest": (
        lambda s, d: T.latest(table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]),
        "select l_partkey, l_suppkey, l_shipdate, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc) as rn from lineitem) where rn = 1",
    ),
    "total_order": (
        lambda s, d: _prints(s, d).select("trade_id", "block_number", "tx_hash", F.array_min("source_log_indexes").alias("first_log")).transform(lambda p: row_numbers(p, "block_number", ["tx_hash", "first_log", "trade_id"], "seq")).select("trade_id", "first_log", F.col("seq").cast("long").alias("seq")),
        f"""with {_JUDGED}, p as (select tx_hash, block_number, min(log_index) as first_log,
            sha256('trade|' || tx_hash || '|' || market_id || '|' || token_id || '|' || aggressor_side || '|' || passive_side || '|' || block_number || '|' || cast(price as varchar)) as trade_id
            from judged where reject_reason is null group by tx_hash, market_id, token_id, aggressor_side, passive_side, price, block_number)
            select trade_id, first_log, row_number() over (order by block_number, tx_hash, first_log, trade_id) as seq from p""",
    ),
}

#: Columns that are worked out in decimals.
_EXACT = {
    "time_bars_5m": "open high low close volume buy_volume sell_volume",
    "time_bars_1h": "open high low close volume buy_volume sell_volume",
    "time_bars_1d": "open high low close volume buy_volume sell_volume",
    "block_bars": "open high low close volume buy_volume sell_volume",
    "canonical_fills": "price size",
    "quarantine": "size",
    "ticks": "price size",
    "trade_prints": "price size_shares",
    "layer_conservation": "tick_size",
    "block_close": "close open high low volume",
    "point_in_time_scan": "size",
    "wallet_slice": "size",
    "print_slice": "price size",
}
PLANS = {name: plan(*pair, _EXACT.get(name, "")) for name, pair in PLANS.items()}
