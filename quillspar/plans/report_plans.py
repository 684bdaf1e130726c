"""Catalogue reads and reports: quality, joint outcomes, sweeps, incidents, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as I
from ..operators import replay as R
from ..operators import tape as T
from ..sources.catalog import TradeCatalog
from ..sources.shared import fresh
from .adapters import ORDERS, TAPE, plan, raw_fills, replay_orders, table, tape
from .replay_plans import _RESULTS, _private


def _catalog(s, d):
    c = TradeCatalog(s, fresh(s, "catalog"))
    t = tape(s, d)
    c.build(t.where("block_time < timestamp_ntz '2024-01-15'"))
    c.build(t)
    return c.window("block", 200, 420).select("trade_id", "asset_id", "block")


def _quality(s, d):
    """Duplicates, steps and jumps of each asset's prints, and the verdict."""
    w = Window.partitionBy("asset_id").orderBy("block")
    t = tape(s, d).withColumn("step", F.col("block") - F.lag("block").over(w)).withColumn("move", F.abs(F.col("price") - F.lag("price").over(w)))
    g = t.groupBy("asset_id").agg(F.count("*").alias("prints"), F.max("step").alias("max_step"), F.count_if(F.col("move") > F.lit("0.18").cast("decimal(4,2)")).alias("jumps"), F.count_if(F.col("price") == 0).alias("zero_prices"), (F.count("*") - F.count_distinct("price", "size", "block_time")).alias("duplicates"))
    return g.withColumn("verdict", F.when(F.col("prints") < 50, "MISSING").when((F.col("jumps") * 4 > F.col("prints")) | (F.col("duplicates") > 0), "REVIEW").otherwise("READY"))


def _joint(s, d):
    """Latest prices of a market's assets at the end of each block range, and their sum's distance from one."""
    t = tape(s, d).withColumn("range", F.floor(F.col("block") / 500)).groupBy("market_id", "range", "asset_id").agg(F.max_by("price", "block").alias("price"), F.sum(F.when(F.col("side") == "BUY", F.col("size")).otherwise(-F.col("size"))).cast("decimal(38,10)").alias("net"))
    return t.groupBy("market_id", "range").agg(F.count("*").alias("outcomes"), F.sum("price").cast("decimal(38,10)").alias("price_sum"), F.sum(F.abs("net")).cast("decimal(38,10)").alias("gross"), F.sum("net").cast("decimal(38,10)").alias("net"))


def _sweep(s, d):
    """Hold specs (entry from, exit after) met with every print in one plan."""
    specs = F.explode(F.array(*[F.struct(F.lit(p).cast("decimal(3,2)").alias("entry_from"), F.lit(h).cast("long").alias("hold")) for p in ("0.10", "0.30", "0.60") for h in (50, 200)]))
    w = Window.partitionBy("asset_id").orderBy("block")
    t = tape(s, d).withColumn("last_price", F.last("price").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("spec", specs)
    met = t.where(F.col("price") >= F.col("spec.entry_from"))
    return met.groupBy(F.col("spec.entry_from").alias("entry_from"), F.col("spec.hold").alias("hold")).agg(F.count("*").alias("entries"), F.sum((F.col("last_price") - F.col("price")).cast("decimal(12,10)")).cast("decimal(38,10)").alias("move"), F.count_if(F.col("block") % F.col("spec.hold") == 0).alias("on_grid"))


def _incidents(s, d):
    e = table(s, d, "events").where("event_type = 'error'").select(F.lit(1).alias("k"), F.col("event_id").alias("start"), (F.col("event_id") + 3).alias("end"))
    runs = replay_orders(s, d).select(F.lit(1).alias("k"), F.col("order_index").alias("run"), F.col("arrival").alias("start"), F.col("deadline").alias("end"))
    met = I.overlap(runs, e, ["k"], 50)
    return met.groupBy("run").agg(F.count("*").alias("incidents"), F.sum(F.col("clip_end") - F.col("clip_start")).alias("blocks"))


def _lifecycle(s, d):
    """Timeline of an order: submitted, each fill, and its end, in order."""
    o, f = replay_orders(s, d), _private(s, d)
    submitted = o.select("order_index", F.col("arrival").alias("x"), F.lit(0).alias("rank"), F.lit("SUBMITTED").alias("event"))
    filled = f.select("order_index", F.col("block").alias("x"), F.lit(1).alias("rank"), F.lit("FILL").alias("event"))
    ended = R.results(o, f).select("order_index", F.col("deadline").alias("x"), F.lit(2).alias("rank"), F.col("status").alias("event"))
    return submitted.unionByName(filled).unionByName(ended).groupBy("order_index").agg(F.count("*").alias("events"), F.count_if(F.col("event") == "FILL").alias("fills"), F.max_by("event", F.struct("rank", "x")).alias("last_event"))


def _degradation(s, d):
    """Fill rates by time in force against the best of them."""
    g = R.results(replay_orders(s, d), _private(s, d)).groupBy("tif").agg(F.count("*").alias("orders"), F.count_if(F.col("filled") > 0).alias("hit"))
    best = g.agg(F.max(F.col("hit") / F.col("orders")).alias("best"))
    return g.crossJoin(F.broadcast(best)).select("tif", "orders", "hit", (F.col("hit") / F.col("orders")).alias("rate"), ((F.col("best") - F.col("hit") / F.col("orders")) <= 0).alias("is_best"))  # one row


def _tick_report(s, d):
    f = raw_fills(s, d)
    dup = f.groupBy(*T.IDENTITY).agg(F.count("*").alias("n"))
    return dup.groupBy("market_id").agg(F.sum("n").alias("fills"), F.count_if(F.col("n") > 1).alias("duplicated"), F.count_if(F.col("maker") == F.col("taker")).alias("self_trades"), F.max("n").alias("most"))


PLANS = {
    "catalog_window": plan(_catalog, f"with {TAPE} select trade_id, asset_id, block from tape where block between 200 and 420"),
    "data_quality_report": plan(
        _quality,
        f"""with {TAPE}, l as (select *, block - lag(block) over w as step, abs(price - lag(price) over w) as move from tape window w as (partition by asset_id order by block)),
            g as (select asset_id, count(*) as prints, max(step) as max_step, count(*) filter (where move > 0.18) as jumps, count(*) filter (where price = 0) as zero_prices, count(*) - count(distinct (price, size, block_time)) as duplicates from l group by 1)
            select *, case when prints < 50 then 'MISSING' when jumps * 4 > prints or duplicates > 0 then 'REVIEW' else 'READY' end as verdict from g""",
    ),
    "joint_outcomes": plan(
        _joint,
        f"""with {TAPE}, p as (select market_id, block // 500 as range, asset_id, max_by(price, block) as price, cast(sum(case when side = 'BUY' then size else -size end) as decimal(38,10)) as net from tape group by 1, 2, 3)
            select market_id, range, count(*) as outcomes, cast(sum(price) as decimal(38,10)) as price_sum, cast(sum(abs(net)) as decimal(38,10)) as gross, cast(sum(net) as decimal(38,10)) as net from p group by 1, 2""",
        "price_sum gross net",
    ),
    "hold_sweep": plan(
        _sweep,
        f"""with {TAPE}, t as (select *, last_value(price) over (partition by asset_id order by block rows between unbounded preceding and unbounded following) as last_price from tape), sp as (select * from (select unnest([0.10, 0.30, 0.60])::decimal(3,2) as entry_from), (select unnest([50, 200])::bigint as hold))
            select entry_from, hold, count(*) as entries, cast(sum(cast(last_price - price as decimal(12,10))) as decimal(38,10)) as move, count(*) filter (where block % hold = 0) as on_grid from t join sp on price >= entry_from group by 1, 2""",
        "entry_from move",
    ),
    "incident_overlap": plan(
        _incidents,
        f"with {ORDERS}, e as (select event_id as s, event_id + 3 as t from events where event_type = 'error') select order_index as run, count(*) as incidents, cast(sum(least(deadline, t) - greatest(arrival, s)) as bigint) as blocks from ords join e on arrival < t and s < deadline group by 1",
    ),
    "order_lifecycle": plan(
        _lifecycle,
        f"with {_RESULTS} select st.order_index, n_fills + 2 as events, n_fills as fills, status as last_event from st",
    ),
    "execution_comparison": plan(
        _degradation,
        f"with {_RESULTS}, byt as (select tif, count(*) as orders, count(*) filter (where filled > 0) as hit from st group by 1) select tif, orders, hit, hit / orders as rate, (select max(hit / orders) from byt) - hit / orders <= 0 as is_best from byt",
    ),
    "tick_report": plan(
        _tick_report,
        "with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from lineitem union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from lineitem where l_orderkey % 10 = 0), d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag = 'A' then 1 when l_returnflag = 'R' then 2 else 3 end as sc, count(*) as n from f group by 1, 2, 3, 4, 5) select l_partkey % 7 as market_id, cast(sum(n) as bigint) as fills, count(*) filter (where n > 1) as duplicated, cast(0 as bigint) as self_trades, max(n) as most from d group by 1",
    ),
}
