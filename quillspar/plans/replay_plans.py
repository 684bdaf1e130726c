"""Order execution plans over the adapter tape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import PRICE, SIZE
from ..operators import replay as R
from ..operators.intervals import islands
from .adapters import ORDERS, TAPE, near, plan, replay_orders, table, tape

BUCKET = 100
BUFFER = "0.0050"
RATE = "0.2500"


def _trades(s, d) -> DataFrame:
    return tape(s, d).withColumn("asset_id", F.col("asset_id") % 15).withColumn("market_id", F.col("asset_id") % 4)


def _private(s, d):
    return R.private_fills(replay_orders(s, d), _trades(s, d), rate=RATE, bucket=BUCKET, buffer=BUFFER)


_MET = f"""{TAPE}, {ORDERS}, tr as (select trade_id, block, side as trade_side, price as trade_price, size as trade_size, (asset_id % 15) % 4 as market_id, asset_id % 15 as asset_id from tape)"""
_EXEC = "cast(greatest(0, least(1, case when side = 'BUY' then trade_price + cast(0.005 as decimal(11,10)) else trade_price - cast(0.005 as decimal(11,10)) end)) as decimal(11,10))"


def _within(price):
    return f"(case when side = 'BUY' then {price} <= limit_price else {price} >= limit_price end)"


_TAKER = f"""{_MET}, met0 as (select o.*, trade_id, block, trade_price, trade_size, {_EXEC} as exec_price from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival and deadline and trade_side = side),
    met as (select *, cast(trade_size * cast(0.25 as decimal(6,4)) as decimal(38,10)) as cap from met0 where {_within('trade_price')} and {_within('exec_price')}),
    cum as (select *, coalesce(sum(cap) over (partition by order_index order by block, trade_id rows between unbounded preceding and 1 preceding), 0) as before from met),
    f0 as (select *, cast(greatest(0, least(cap, size - before)) as decimal(38,10)) as qty from cum),
    fills as (select * from (select *, sum(qty) over (partition by order_index) as tot from f0 where qty > 0) where tif <> 'FOK' or tot >= size)"""
_RESULTS = f"""{_TAKER}, g as (select order_index, sum(qty) as filled, count(*) as n_fills from fills group by 1),
    res as (select o.order_index, o.size, o.tif, cast(coalesce(g.filled, 0) as decimal(38,10)) as filled, coalesce(n_fills, 0) as n_fills from ords o left join g on g.order_index = o.order_index),
    st as (select *, case when filled >= size then 'FILLED' when filled > 0 then case when tif in ('IOC', 'FOK', 'FAK') then 'PARTIAL_CANCELLED' else 'PARTIAL' end else case when tif in ('IOC', 'FOK', 'FAK') then 'CANCELLED' else 'UNFILLED' end end as status from res)"""
_OPPOSITE = f"""{_MET}, met as (select o.*, trade_id, block, trade_price, trade_size from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival and deadline and trade_side <> side where {_within('trade_price')}),
    fl as (select *, sum(trade_size) over (partition by order_index order by block, trade_id rows unbounded preceding) as flow from met),
    fills as (select *, greatest(0, least(size, flow - queue_ahead)) - greatest(0, least(size, flow - trade_size - queue_ahead)) as qty from fl)"""


def _summary(s, d):
    r = R.results(replay_orders(s, d), _private(s, d))
    return r.groupBy("tif", "status").agg(F.count("*").alias("orders"), F.sum("filled").cast("decimal(38,10)").alias("filled"), F.sum("n_fills").alias("fills"))


def _grid(s, d):
    o = R.variants(replay_orders(s, d), ["0.1000", "0.2500", "1.0000"])
    met = R.candidates(o.withColumn("order_index", F.col("order_index") * 10 + F.col("variant")), _trades(s, d), bucket=BUCKET)
    cap = met.withColumn("cap", (F.col("trade_size") * F.col("rate")).cast("decimal(38,10)")).groupBy("order_index", "variant", "size").agg(F.sum("cap").alias("cap"))
    return cap.groupBy("variant").agg(F.count("*").alias("touched"), F.sum(F.least(F.col("cap"), F.col("size").cast("decimal(38,10)"))).cast("decimal(38,10)").alias("fillable"))


def _levels(s, d):
    line = table(s, d, "lineitem")
    return line.select((F.col("l_partkey") % 50).alias("book_id"), F.when(F.col("l_linenumber") % 2 == 0, "BUY").otherwise("SELL").alias("side"), (F.col("l_partkey") % 89 + 10).cast("decimal(5,0)").alias("c"), F.col("l_quantity").cast(SIZE).alias("size")).select(
        "book_id", "side", (F.col("c") * F.lit("0.01").cast("decimal(3,2)")).cast(PRICE).alias("price"), "size"
    ).groupBy("book_id", "side", "price").agg(F.sum("size").cast(SIZE).alias("size"))


def _takers(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("order_index"), (F.col("o_custkey") % 50).alias("book_id"), F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("0.40")).otherwise(F.lit("0.70")).cast(PRICE).alias("limit_price"), (F.col("o_custkey") % 3000 + 1).cast(SIZE).alias("size"))


_WALK = """lv as (select l_partkey % 50 as book_id, case when l_linenumber % 2 = 0 then 'BUY' else 'SELL' end as side, cast(cast(l_partkey % 89 + 10 as decimal(5,0)) * cast(0.01 as decimal(3,2)) as decimal(11,10)) as price, sum(cast(l_quantity as decimal(26,10))) as size from lineitem group by 1, 2, 3),
    tk as (select o_orderkey as order_index, o_custkey % 50 as book_id, case when o_orderkey % 2 = 0 then 'BUY' else 'SELL' end as side, cast(case when o_orderkey % 2 = 0 then 0.40 else 0.70 end as decimal(11,10)) as limit_price, cast(o_custkey % 3000 + 1 as decimal(26,10)) as size from orders),
    mt as (select tk.*, lv.price as lp, lv.size as ls from tk join lv on lv.book_id = tk.book_id and lv.side = tk.side where case when tk.side = 'BUY' then lv.price <= limit_price else lv.price >= limit_price end),
    cm as (select *, coalesce(sum(ls) over (partition by order_index order by case when side = 'BUY' then lp else -lp end rows between unbounded preceding and 1 preceding), 0) as before from mt),
    fl as (select *, cast(greatest(0, least(ls, size - before)) as decimal(38,10)) as qty from cm),
    ag as (select order_index, sum(qty) as filled, count(*) as n_levels, sum(cast(qty as decimal(26,10)) * lp) as cost from fl where qty > 0 group by 1)"""


def _shared(s, d):
    return R.shared_fills(replay_orders(s, d), _trades(s, d), rate=RATE, buffer=BUFFER)


def _block_volume(s, d):
    rows = table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(F.col("o_custkey").cast("double")).alias("side_volume"), (F.col("o_custkey") * 2).cast("double").alias("block_volume"), (F.col("o_orderkey") % 64 + 1).cast("double").alias("requested"))
    return R.block_volume_fill(rows, 25.0, 0.5, 1.0).select("o_orderkey", "available", "probability", "filled")


PLANS = {
    "order_deadlines": plan(
        lambda s, d: R.with_deadlines(replay_orders(s, d).select("order_index", "tif", F.col("arrival").alias("signal_block"), (F.col("order_index") % 5 - 1).alias("latency_blocks"), (F.col("order_index") % 90).alias("horizon_blocks"))).select("order_index", "arrival", "deadline"),
        f"with {ORDERS} select order_index, arrival + greatest(0, order_index % 5 - 1) as arrival, arrival + greatest(0, order_index % 5 - 1) + case when tif in ('IOC', 'FOK', 'FAK') then least(greatest(order_index % 90, 0), 1) else order_index % 90 end as deadline from ords",
    ),
    "v2_taker_private": plan(lambda s, d: _private(s, d).select("order_index", "trade_id", "block", "exec_price", "qty"), f"with {_TAKER} select order_index, trade_id, block, exec_price, qty from fills", "exec_price qty"),
    "v2_results": plan(lambda s, d: R.results(replay_orders(s, d), _private(s, d)).select("order_index", "filled", "n_fills", "status"), f"with {_RESULTS} select order_index, filled, n_fills, status from st", "filled"),
    "v2_summary": plan(_summary, f"with {_RESULTS} select tif, status, count(*) as orders, cast(sum(filled) as decimal(38,10)) as filled, cast(sum(n_fills) as bigint) as fills from st group by 1, 2", "filled"),
    "v2_reasons": plan(
        lambda s, d: R.unfilled_reason(replay_orders(s, d), _trades(s, d), _private(s, d), bucket=BUCKET, buffer=BUFFER),
        f"""with {_RESULTS}, seen as (select o.order_index, count(*) as n_trades, count(*) filter (where {_within('trade_price')}) as n_limit, count(*) filter (where {_within(_EXEC)}) as n_buffer
              from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival and deadline and trade_side = side group by 1)
            select st.order_index, filled, case when filled >= size then null when coalesce(n_trades, 0) = 0 then 'no_trade' when n_limit = 0 then 'limit_not_reached' when n_buffer = 0 then 'price_buffer' when filled > 0 then 'insufficient_volume' else 'capacity' end as reason
            from st left join seen on seen.order_index = st.order_index""",
        "filled",
    ),
    "v2_evidence_gate": plan(
        lambda s, d: R.gate(replay_orders(s, d), _trades(s, d), bucket=BUCKET, lookback=150, min_trades=3, min_volume="100"),
        f"""with {_MET}, g as (select o.order_index, count(*) as n, cast(sum(trade_size) as decimal(38,10)) as v from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival - 150 and arrival - 1 group by 1)
            select o.order_index, coalesce(n, 0) as trailing_trades, coalesce(v, 0) as trailing_volume, case when n is null then 'no_trailing_trades' when n < 3 then 'too_few_trades' when v < 100 then 'too_little_volume' end as gate_reason from ords o left join g on g.order_index = o.order_index""",
        "trailing_volume",
    ),
    "v2_maker_private": plan(lambda s, d: R.maker_fills(replay_orders(s, d), _trades(s, d), bucket=BUCKET).select("order_index", "trade_id", "qty"), f"with {_OPPOSITE} select order_index, trade_id, qty from fills where qty > 0", "qty"),
    "v2_shared_ledger": plan(_shared, None, "exec_price qty"),
    "v2_window_cap": plan(lambda s, d: R.shared_fills(replay_orders(s, d), _trades(s, d), rate="1.0", window_cap="40", window_blocks=50), None, "exec_price qty"),
    "participation_grid": plan(
        _grid,
        f"""with {_MET}, v as (select 0 as variant, cast(0.1 as decimal(6,4)) as rate union all select 1, cast(0.25 as decimal(6,4)) union all select 2, cast(1 as decimal(6,4))),
            met as (select o.order_index, o.size, variant, cast(sum(cast(trade_size * rate as decimal(38,10))) as decimal(38,10)) as cap from ords o cross join v join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival and deadline and trade_side = side where {_within('trade_price')} group by 1, 2, 3)
            select variant, count(*) as touched, cast(sum(least(cap, size)) as decimal(38,10)) as fillable from met group by 1""",
        "fillable",
    ),
    "depth_walk": plan(
        lambda s, d: R.depth_walk(_levels(s, d), _takers(s, d)),
        f"with {_WALK} select tk.order_index, cast(coalesce(filled, 0) as decimal(38,10)) as filled, coalesce(n_levels, 0) as n_levels, cast(tk.size - coalesce(filled, 0) as decimal(38,10)) as residual, cast(cost as double) / cast(filled as double) as avg_price from tk left join ag on ag.order_index = tk.order_index",
        "filled residual",
    ),
    "book_levels": plan(_levels, f"with {_WALK} select book_id, side, price, size from lv", "price size"),
    "block_volume_fill": plan(
        _block_volume,
        """with r as (select o_orderkey, case when o_orderkey % 3 = 0 then 0.0::double else o_custkey::double end as sv, (o_custkey * 2)::double as bv, (o_orderkey % 64 + 1)::double as rq from orders), b as (select *, case when sv > 0 then sv else bv end * 25.0::double / 100 as available from r),
           p as (select *, least(100.0::double, 100 * available / rq) * 0.5::double as probability from b), f as (select *, least(rq, available, rq * probability / 100) as f from p) select o_orderkey, available, probability, case when f >= 1.0 then f else 0.0::double end as filled from f""",
    ),
    "touch_survival": near(
        lambda s, d: R.touch_survival(replay_orders(s, d), _trades(s, d), bucket=BUCKET, lookback=200),
        f"""with {_MET}, m as (select o.order_index, arrival, deadline, side, limit_price, o.size, trade_id, block, trade_price, trade_size from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival - 200 and deadline and trade_side <> side where {_within('trade_price')}),
            g as (select order_index, any_value(deadline) as dl, any_value(size)::double as sz, count(*) filter (where block < arrival) as hits_before, min(block) filter (where block >= arrival) as first_touch, min_by(trade_size, (block, trade_id)) filter (where block >= arrival) as ts,
                count(*) filter (where block >= arrival and case when side = 'BUY' then trade_price < limit_price else trade_price > limit_price end) as crosses from m group by 1),
            h as (select *, greatest(1e-6::double, hits_before / 200.0::double * (0.5::double + exp(-least(20.0::double, sz / ts::double)))) as hz from g)
            select o.order_index, coalesce(hits_before, 0) as hits_before, first_touch, coalesce(crosses, 0) as crosses, case when first_touch is null then 0.0::double else 1 - exp(-hz * (dl - first_touch)) end as probability, case when crosses > 0 then 1.0::double else 0.0::double end as lower, case when first_touch is null then 0.0::double else 1.0::double end as upper
            from ords o left join h on h.order_index = o.order_index""",
        "probability",
    ),
    "poisson_monte_carlo": plan(lambda s, d: R.poisson_paths(replay_orders(s, d).select("order_index", (F.col("order_index") % 13 / 100.0).alias("intensity"), (F.col("deadline") - F.col("arrival")).cast("double").alias("horizon"), F.lit(2.0).alias("clip"), F.col("size").cast("double").alias("size")), 250), None),
    "formula_slippage": plan(
        lambda s, d: replay_orders(s, d).select("order_index", F.greatest(F.lit(0).cast("decimal(12,10)"), F.least(F.lit(1).cast("decimal(12,10)"), F.when(F.col("side") == "BUY", F.col("limit_price") + F.lit("0.0150").cast("decimal(5,4)")).otherwise(F.col("limit_price") - F.lit("0.0150").cast("decimal(5,4)")).cast("decimal(12,10)"))).cast(PRICE).alias("expected_price")),
        f"with {ORDERS} select order_index, cast(greatest(0, least(1, case when side = 'BUY' then limit_price + 0.0150 else limit_price - 0.0150 end)) as decimal(11,10)) as expected_price from ords", "expected_price",
    ),
    "required_windows": plan(
        lambda s, d: islands(replay_orders(s, d).select("market_id", "asset_id", (F.col("arrival") - 50).alias("start"), F.col("deadline").alias("end")), ["market_id", "asset_id"], "start", "end", 10),
        f"""with {ORDERS}, w as (select market_id, asset_id, arrival - 50 as s, deadline as e from ords), a as (select *, case when max(e) over x is null or s > max(e) over x + 10 then 1 else 0 end as new from w window x as (partition by market_id, asset_id order by s, e rows between unbounded preceding and 1 preceding)),
            b as (select *, sum(new) over (partition by market_id, asset_id order by s, e rows unbounded preceding) as isl from a) select market_id, asset_id, min(s) as start, max(e) as "end", count(*) as n_merged from b group by market_id, asset_id, isl""",
    ),
}
