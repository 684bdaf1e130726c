"""Scans, write semantics and streams as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scans as S
from ..sources import sinks as W
from ..sources.shared import fresh
from ..streaming import streams as R
from .adapters import AT, TAPE, over_blocks, plan, raw_fills, table, tape


def _windows(s, d):
    o = over_blocks(s, d, table(s, d, "orders").where("o_custkey % 4 = 0"), "o_orderkey")
    return o.select((F.col("o_custkey") % 15).alias("asset_id"), F.col("at").alias("start"), (F.col("at") + 5 + F.col("o_custkey") % 60).alias("end"))


def _upserted(s, d):
    t = W.ParquetTable(s, fresh(s, "upsert"), ["o_custkey"])
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    t.upsert(o.where("o_orderkey % 3 = 0"), ["o_orderdate", "o_orderkey"])
    t.upsert(o.where("o_orderkey % 3 = 1"), ["o_orderdate", "o_orderkey"])
    t.insert_absent(o.where("o_orderkey % 3 = 2").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.min("o_orderdate").alias("o_orderdate")))
    return t.read()


def _changed(s, d):
    t = W.ParquetTable(s, fresh(s, "changed"), ["p_partkey"])
    p = table(s, d, "part").select("p_partkey", "p_size", "p_brand")
    t.append(p.where("p_partkey % 5 <> 0"))
    return t.changed(p.withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("int")))


def _spool(s, d):
    path = fresh(s, "spool")
    e = table(s, d, "events")
    e.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 9 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("user_id"), "event_type")).alias("value")).write.text(path)
    got = S.json_spool(s, path, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("late", T.LongType())]))
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.count("user_id").alias("users"), F.sum("user_id").alias("total"), F.count("late").alias("late"))


def _stream(s, d):
    rows, path = table(s, d, "events"), fresh(s, "landing")
    rows.repartitionByRange(4, "event_id").write.parquet(path)
    return R.events(s, path, rows.schema)


def _stream_bars(s, d):
    rows = _stream(s, d).select(F.col("user_id").alias("asset_id"), "ts", "event_id", F.col("value").alias("price"), F.lit(1).cast("long").alias("size"))
    got = R.to_end(R.bars(rows, "1 day", "1 day"), "complete", fresh(s, "stream"))
    return got.withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


def _stream_ledger(s, d):
    rows = _stream(s, d).select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.col("value").alias("cash"))
    return R.to_end(R.running_ledger(rows), "append", fresh(s, "stream")).groupBy("account").agg(F.count("*").alias("n"), F.max_by("balance", "entry").cast("decimal(18,4)").alias("balance"))


PLANS = {
    "block_range_scan": plan(lambda s, d: S.block_range(raw_fills(s, d), 100, 900, markets=[1, 2]).groupBy("market_id").agg(F.count("*").alias("n")), "with f as (select l_orderkey, l_partkey % 7 as market_id from lineitem union all select l_orderkey, l_partkey % 7 from lineitem where l_orderkey % 10 = 0) select market_id, count(*) as n from f where l_orderkey between 100 and 900 and market_id in (1, 2) group by 1"),
    "window_scan": plan(
        lambda s, d: S.windows_scan(tape(s, d).withColumn("asset_id", F.col("asset_id") % 15), _windows(s, d), ["asset_id"], "block", 100).select("trade_id", "asset_id", "block"),
        f"with {TAPE}, w as (select o_custkey % 15 as asset_id, {AT} as s, {AT} + 5 + o_custkey % 60 as e from orders where o_custkey % 4 = 0) select trade_id, asset_id % 15 as asset_id, block from tape where exists (select 1 from w where w.asset_id = tape.asset_id % 15 and block >= s and block < e)",
    ),
    "sample_grid": plan(lambda s, d: S.sample_grid(s, 0, 1003, 50), "select unnest(range(0, 1004, 50)) as x union select 1003"),
    "hour_grid": plan(lambda s, d: S.hours(s, "2024-01-01 00:00:00", "2024-01-03 12:00:00"), "select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-03 12:00:00', interval 1 hour)) as hour"),
    "universe_select": plan(lambda s, d: S.universe(table(s, d, "part").withColumn("settled", F.col("p_size") > 10), title="p_name", pattern="^[a-m]", settled=True).select("p_partkey", "p_name"), "select p_partkey, p_name from part where regexp_matches(p_name, '^[a-m]') and p_size > 10"),
    "upsert_sink": plan(
        _upserted,
        """with o as (select o_custkey, o_orderkey, o_orderdate from orders), a as (select * exclude (rn) from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from o where o_orderkey % 3 = 0) where rn = 1),
           b as (select * exclude (rn) from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from o where o_orderkey % 3 = 1) where rn = 1),
           m as (select * from b union all select * from a where o_custkey not in (select o_custkey from b)), c as (select o_custkey, min(o_orderkey) as o_orderkey, min(o_orderdate) as o_orderdate from o where o_orderkey % 3 = 2 group by 1)
           select * from m union all select * from c where o_custkey not in (select o_custkey from m)""",
    ),
    "change_only_upsert": plan(_changed, "select p_partkey, cast(case when p_partkey % 7 = 0 then p_size + 1 else p_size end as integer) as p_size, p_brand from part where p_partkey % 5 = 0 or p_partkey % 7 = 0"),
    "json_spool": plan(_spool, "select event_type, count(*) as n, count(*) filter (where event_id % 9 <> 0) as users, cast(sum(user_id) filter (where event_id % 9 <> 0) as bigint) as total, cast(0 as bigint) as late from events group by 1"),
    "stream_bars": plan(_stream_bars, "select user_id as asset_id, cast(date_trunc('day', ts) as timestamp) as bar_start, min_by(value, (ts, event_id)) as open, max(value) as high, min(value) as low, max_by(value, (ts, event_id)) as close, count(*) as volume, count(*) as trades from events group by 1, 2"),
    "stream_ledger": plan(_stream_ledger, "select user_id as account, count(*) as n, cast(sum(cast(value as decimal(18,4))) as decimal(18,4)) as balance from events group by 1", "balance"),
}
