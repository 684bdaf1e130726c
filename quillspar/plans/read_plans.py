"""Read model: as-of, top-n, downsampling, gaps, searches, rollups, existence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C
from ..operators import asof as A
from ..operators import series as S
from .adapters import TAPE, near, plan, table, tape


def _points(s, d):
    """A series per asset on the block axis, with doubles that are exact in both engines."""
    return table(s, d, "events").select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("x"), F.col("value"))


_POINTS = "points as (select user_id as asset_id, event_id as x, value from events)"


def _asof(s, d):
    e = table(s, d, "events")
    left = e.where("event_type = 'error'").select(F.col("user_id").alias("asset_id"), "event_id", "ts")
    right = e.where("event_type = 'purchase'").select(F.col("user_id").alias("asset_id"), "ts", F.col("event_id").alias("price_event"), F.col("value").alias("price"))
    return left, right


def _asof_sql(kind, extra=""):
    return f"""with l as (select user_id as asset_id, event_id, ts from events where event_type = 'error'), r as (select user_id as asset_id, ts, event_id as price_event, value as price from events where event_type = 'purchase')
        select l.asset_id, l.event_id, l.ts, r.price_event, r.price, r.ts as ts_matched from l asof left join r on l.asset_id = r.asset_id and {kind} {extra}"""


def _m4_sql(points):
    return f"""with {_POINTS}, n as (select *, count(*) over (partition by asset_id) as n, row_number() over (partition by asset_id order by x) as rn from points),
        b as (select asset_id, x, value, case when n <= {points} then rn else cast(floor((rn - 1) / ceil(n / {max(1, (points - 2) // 4)})) as bigint) end as bucket from n),
        k as (select asset_id, bucket, min(x) as a, max(x) as z, min_by(x, (value, x)) as lo, min_by(x, (-value, x)) as hi from b group by 1, 2),
        p as (select distinct asset_id, bucket, unnest([a, z, lo, hi]) as x from k)
        select p.asset_id, p.bucket, p.x, points.value from p join points on points.asset_id = p.asset_id and points.x = p.x"""


def _locf(s, d):
    return A.locf(_points(s, d), ["asset_id"], "x", "value", 500)


def _search(s, d):
    parts, lines = table(s, d, "part"), table(s, d, "lineitem")
    busy = lines.where("l_quantity >= 50").select("l_partkey").distinct().withColumn("hit", F.lit(True))
    found = parts.join(busy, parts.p_partkey == busy.l_partkey, "left").where(F.lower("p_name").contains("green") | F.coalesce("hit", F.lit(False)))
    rank = F.when(F.col("p_brand") == "Brand#11", 0).when(F.col("p_size") > 40, 1).otherwise(2)
    return found.select("p_partkey", "p_name", rank.alias("relevance"), F.coalesce("hit", F.lit(False)).alias("busy"))


def _token_summary(s, d):
    t = tape(s, d)
    g = t.groupBy("asset_id").agg(
        F.count("*").alias("trades"), F.sum("size").alias("volume"), F.min("price").alias("low"), F.max("price").alias("high"),
        F.sum(F.when(F.col("side") == "BUY", F.col("size")).otherwise(0)).alias("buy"), F.sum(F.when(F.col("side") == "SELL", F.col("size")).otherwise(0)).alias("sell"),
    )
    return g.select("asset_id", "trades", "volume", "low", "high", C.liquidity(F.col("trades"), F.col("volume").cast("double")).alias("liquidity"), C.dominant_side(F.col("buy"), F.col("sell")).alias("dominant"))


_LIQ = "case when trades >= 1000 and cast(volume as double) >= 100000 then 'very_deep' when trades >= 100 and cast(volume as double) >= 10000 then 'deep' when trades >= 10 and cast(volume as double) >= 1000 then 'medium' else 'thin' end"
_DOM = "case when buy + sell <= 0 then 'none' when cast(buy as double) >= 0.6 * cast(buy + sell as double) then 'buy' when cast(sell as double) >= 0.6 * cast(buy + sell as double) then 'sell' else 'balanced' end"
_TOKEN = f"""{TAPE}, g as (select market_id, asset_id, count(*) as trades, sum(size) as volume, min(price) as low, max(price) as high, sum(case when side = 'BUY' then size else 0 end) as buy, sum(case when side = 'SELL' then size else 0 end) as sell from tape group by 1, 2),
    tok as (select market_id, asset_id, trades, volume, low, high, {_LIQ} as liquidity, {_DOM} as dominant from g)"""


def _market_summary(s, d):
    t = _token_summary(s, d).withColumn("market_id", F.col("asset_id") % 4)
    by = t.groupBy("market_id", "liquidity").agg(F.count("*").alias("n"), F.sum("trades").alias("trades"), F.sum("volume").alias("volume"))
    return by.groupBy("market_id").agg(F.sum("n").alias("tokens"), F.sum("trades").alias("trades"), F.sum("volume").alias("volume"), F.max_by("liquidity", F.struct("n", "liquidity")).alias("common_liquidity"))


def _eligibility(s, d):
    p = table(s, d, "part")
    w = Window.partitionBy("p_brand", "p_type").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return p.withColumn("dup_rank", F.row_number().over(w)).select("p_partkey", "p_brand", "dup_rank", F.when(F.col("dup_rank") > 1, "duplicate").when(F.col("p_size") < 5, "too_small").otherwise("eligible").alias("state"))


PLANS = {
    "asof_backward": plan(lambda s, d: A.asof(*_asof(s, d), ["asset_id"], "ts", ["price_event", "price"], block=lambda t: F.date_trunc("day", t)), _asof_sql("l.ts >= r.ts")),
    "asof_forward": plan(lambda s, d: A.asof(*_asof(s, d), ["asset_id"], "ts", ["price_event", "price"], forward=True), _asof_sql("l.ts <= r.ts")),
    "asof_max_lag": plan(
        lambda s, d: A.asof(*_asof(s, d), ["asset_id"], "ts", ["price_event", "price"], max_lag=86400),
        _asof_sql("l.ts >= r.ts").replace("r.price_event, r.price, r.ts as ts_matched", "case when date_diff('microsecond', r.ts, l.ts) < 86401000000 then r.price_event end as price_event, case when date_diff('microsecond', r.ts, l.ts) < 86401000000 then r.price end as price, case when date_diff('microsecond', r.ts, l.ts) < 86401000000 then r.ts end as ts_matched"),
    ),
    "locf_grid": plan(_locf, f"with {_POINTS}, g as (select asset_id, unnest(range(min(x), max(x) + 1, 500)) as x from points group by 1) select g.asset_id, g.x, p.value from g asof join points p on g.asset_id = p.asset_id and g.x >= p.x"),
    "latest_per_key": plan(lambda s, d: _points(s, d).groupBy("asset_id").agg(F.max_by("value", "x").alias("value"), F.max("x").alias("x")), f"with {_POINTS} select asset_id, max_by(value, x) as value, max(x) as x from points group by 1"),
    "m4_downsample": plan(lambda s, d: S.m4(_points(s, d), ["asset_id"], "x", "value", 30), _m4_sql(30)),
    "gap_thresholds": plan(
        lambda s, d: S.gap_thresholds(_points(s, d), ["asset_id"], "x").select("asset_id", F.col("gap_limit").cast("decimal(20,6)").alias("gap_limit"), F.col("stale_limit").cast("decimal(20,6)").alias("stale_limit")),
        f"""with {_POINTS}, st as (select asset_id, x - lag(x) over (partition by asset_id order by x) as step from points), q as (select asset_id, quantile_cont(step, 0.5) as a, quantile_cont(step, 0.99) as b, quantile_cont(step, 0.999) as c from st where step > 0 group by 1)
            select asset_id, cast(greatest(1.0::double, 30 * a, 8 * b, 4 * c) as decimal(20,6)) as gap_limit, cast(greatest(1.0::double, 4 * a, 2 * b) as decimal(20,6)) as stale_limit from q""",
        "gap_limit stale_limit",
    ),
    "price_jumps": plan(
        lambda s, d: S.jumps(_points(s, d), ["asset_id"], "x", "value", 200.0),
        f"with {_POINTS}, m as (select *, value - lag(value) over (partition by asset_id order by x) as move from points) select * from m where abs(move) > 200",
    ),
    "top_n_per_key": plan(
        lambda s, d: S.top_per_key(_points(s, d), ["asset_id"], [F.desc("value"), F.asc("x")], 3),
        f"with {_POINTS} select asset_id, x, value, rank from (select *, cast(row_number() over (partition by asset_id order by value desc, x) as integer) as rank from points) where rank <= 3",
    ),
    "latest_n_ascending": plan(lambda s, d: S.latest_then_ascending(_points(s, d), "x", 100), f"with {_POINTS} select * from points order by x desc limit 100"),
    "search_existence": plan(
        _search,
        """select p_partkey, p_name, case when p_brand = 'Brand#11' then 0 when p_size > 40 then 1 else 2 end as relevance, exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 50) as busy
           from part where contains(lower(p_name), 'green') or exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 50)""",
    ),
    "execution_summary_token": plan(_token_summary, f"with {_TOKEN} select asset_id, trades, volume, low, high, liquidity, dominant from tok", "volume low high"),
    "execution_summary_market": plan(
        _market_summary,
        f"""with {_TOKEN}, b as (select market_id, liquidity, count(*) as n, sum(trades) as trades, sum(volume) as volume from tok group by 1, 2)
            select market_id, cast(sum(n) as bigint) as tokens, cast(sum(trades) as bigint) as trades, sum(volume) as volume, max_by(liquidity, (n, liquidity)) as common_liquidity from b group by 1""",
        "volume",
    ),
    "duplicate_eligibility": plan(
        _eligibility,
        "select p_partkey, p_brand, dup_rank, case when dup_rank > 1 then 'duplicate' when p_size < 5 then 'too_small' else 'eligible' end as state from (select *, cast(row_number() over (partition by p_brand, p_type order by p_retailprice desc, p_partkey) as integer) as dup_rank from part)",
    ),
    "event_catalogue_rollup": plan(
        lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment").agg(
            F.count_if(F.col("o_orderstatus") == "F").alias("settled"), F.count("*").alias("markets"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), F.bool_and(F.col("o_orderstatus") == "F").alias("all_settled")
        ),
        "select c_nationkey, c_mktsegment, count(*) filter (where o_orderstatus = 'F') as settled, count(*) as markets, min(o_orderdate) as first_at, max(o_orderdate) as last_at, bool_or(o_orderstatus = 'P') as any_pending, bool_and(o_orderstatus = 'F') as all_settled from orders join customer on o_custkey = c_custkey group by 1, 2",
    ),
    "membership_levels": plan(
        lambda s, d: table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(table(s, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").rollup("r_name", "n_name").agg(F.count("s_suppkey").alias("members"), F.grouping_id().alias("level")),
        "select r_name, n_name, count(s_suppkey) as members, cast(grouping(r_name, n_name) as bigint) as level from nation join region on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey group by rollup (r_name, n_name)",
    ),
    "universe_diff": plan(
        lambda s, d: table(s, d, "orders").where("o_orderdate < timestamp_ntz '1998-01-01'").select("o_custkey").distinct().withColumn("old", F.lit(1)).join(table(s, d, "orders").where("o_orderdate >= timestamp_ntz '1998-01-01'").select("o_custkey").distinct().withColumn("new", F.lit(1)), "o_custkey", "full_outer").where("old is null or new is null").select("o_custkey", F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change")),
        "with a as (select distinct o_custkey from orders where o_orderdate < timestamp '1998-01-01'), b as (select distinct o_custkey from orders where o_orderdate >= timestamp '1998-01-01') select o_custkey, 'added' as change from (select * from b except select * from a) union all select o_custkey, 'removed' from (select * from a except select * from b)",
    ),
    "sessions": plan(
        lambda s, d: S.sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "6 hours").select("user_id", "n_events", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at")),
        """with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hours or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
            i as (select *, sum(new) over (partition by user_id order by ts) as sid from g) select user_id, count(*) as n_events, min(ts) as first_at, max(ts) as last_at from i group by user_id, sid""",
    ),
    "price_tile": plan(
        lambda s, d: tape(s, d).withColumn("tile", F.floor(F.col("block") / 250)).groupBy("market_id", "tile").agg(F.count("*").alias("points"), F.max_by("price", "block").alias("close"), F.min("block").alias("from_block"), F.max("block").alias("to_block")),
        f"with {TAPE} select market_id, block // 250 as tile, count(*) as points, max_by(price, block) as close, min(block) as from_block, max(block) as to_block from tape group by 1, 2", "close",
    ),
    "yes_probability": plan(
        lambda s, d: tape(s, d).select("trade_id", C.tree(F.col("price"), F.when(F.col("side") == "BUY", "YES").otherwise("NO")).cast("decimal(12,10)").alias("yes_price"), C.price_bucket(F.col("price")).alias("bucket")),
        f"with {TAPE} select trade_id, cast(case when side = 'BUY' then price else 1 - price end as decimal(12,10)) as yes_price, cast(floor(cast(price as double) / 0.05) as integer) as bucket from tape", "yes_price",
    ),
    "shard_assignment": plan(
        lambda s, d: table(s, d, "part").select("p_partkey", C.shard(F.col("p_partkey"), 8).alias("shard")),
        "select p_partkey, cast(('0x' || substr(sha256(cast(p_partkey as varchar)), 1, 12))::bigint % 8 as bigint) as shard from part",
    ),
    "canonical_key": plan(
        lambda s, d: table(s, d, "nation").select("n_nationkey", C.fill_key(F.col("n_name"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")), F.lit(""), F.col("n_nationkey")).alias("fill_key")),
        "select n_nationkey, concat_ws('|', n_name, case when n_regionkey > 1 then cast(n_regionkey as varchar) end, cast(n_nationkey as varchar)) as fill_key from nation",
    ),
    "json_levels": plan(
        lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("k").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.col("event_id") % 5)).alias("classes")),
        "select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n, list_sort(list_distinct(list(event_id % 5))) as classes from events group by 1",
    ),
    "roll_spread": near(
        lambda s, d: S.roll_spread(table(s, d, "events").select("user_id", "event_id", F.floor("value").alias("value")), ["user_id"], "event_id", "value"),
        """with m as (select user_id, event_id, floor(value) - lag(floor(value)) over w as a from events window w as (partition by user_id order by event_id)), n as (select *, lag(a) over (partition by user_id order by event_id) as b from m)
           select user_id, count(*) as n_pairs, 2 * sqrt(greatest(0.0::double, -covar_pop(a, b))) as roll_spread from n where a is not null and b is not null group by 1""", "roll_spread", 5),
    "locf_correlation": near(
        lambda s, d: S.locf_correlation(table(s, d, "events").select(F.col("event_type").alias("outcome"), F.col("event_id").alias("x"), "value"), "outcome", "x", "value", 50, 10),
        """with s as (select event_type as k, event_id as x, value from events), b as (select k, min(x) as a, max(x) as z from s group by 1), g as (select k, unnest(range(a, z + 1, 50)) as x from b),
           v as (select g.k, g.x, s.value from g asof join s on g.k = s.k and s.x <= g.x), c as (select k, cast(floor(x / 50.0) * 50 as bigint) as y, max_by(value, x) as value from v group by 1, 2),
           m as (select k, y, value - lag(value) over (partition by k order by y) as d from c), p as (select a.k as left_key, b.k as right_key, a.d as a, b.d as b from m a join m b on a.y = b.y and a.k < b.k where a.d is not null and b.d is not null)
           select left_key, right_key, count(*) as n, corr(a, b) as corr from p group by 1, 2 having count(*) >= 10""", "corr"),
    "ewma": near(lambda s, d: S.ewma(_points(s, d), ["asset_id"], "x", "value", 0.35), f"with {_POINTS} select asset_id, list_reduce(list(value order by x), lambda a, v: 0.35::double * v + 0.65::double * a) as ewma from points group by 1", "ewma"),
    "rolling_three": plan(
        lambda s, d: S.rolling_sum(_points(s, d).withColumn("value", F.col("value").cast("decimal(10,2)")), ["asset_id"], ["x"], "value", 3),
        f"with {_POINTS} select * exclude (rn) from (select asset_id, x, cast(value as decimal(10,2)) as value, sum(cast(value as decimal(10,2))) over (partition by asset_id order by x rows 2 preceding) as rolling, row_number() over (partition by asset_id order by x) as rn from points) where rn >= 3", "value rolling",
    ),
    "drawdown": plan(
        lambda s, d: S.drawdown(_points(s, d), ["asset_id"], ["x"], "value"),
        f"with {_POINTS} select *, max(value) over w as peak, max(value) over w - value as drawdown from points window w as (partition by asset_id order by x rows unbounded preceding)",
    ),
    "markout": plan(
        lambda s, d: S.markout(tape(s, d).select("trade_id", "asset_id", "side", F.col("block").alias("x"), "price"), tape(s, d).select("asset_id", F.col("block").alias("x"), "price"), ["asset_id"], "x", "price", 100).select("trade_id", "later_price", F.col("markout").cast("decimal(12,10)").alias("markout")),
        f"""with {TAPE}, l as (select *, block + 100 as t from tape) select l.trade_id, r.price as later_price, cast(case when l.side = 'BUY' then r.price - l.price else l.price - r.price end as decimal(12,10)) as markout
            from l asof left join tape r on l.asset_id = r.asset_id and l.t <= r.block""", "later_price markout",
    ),
    "gap_flags": plan(
        lambda s, d: S.steps(_points(s, d), ["asset_id"], "x").join(S.gap_thresholds(_points(s, d), ["asset_id"], "x"), "asset_id").select("asset_id", "x", (F.col("step") > F.col("gap_limit")).alias("gap"), (F.col("step") > F.col("stale_limit")).alias("stale")).where("gap or stale"),
        f"""with {_POINTS}, st as (select asset_id, x, x - lag(x) over (partition by asset_id order by x) as step from points), q as (select asset_id, quantile_cont(step, 0.5) as a, quantile_cont(step, 0.99) as b, quantile_cont(step, 0.999) as c from st where step > 0 group by 1)
            select st.asset_id, x, step > greatest(1.0::double, 30 * a, 8 * b, 4 * c) as gap, step > greatest(1.0::double, 4 * a, 2 * b) as stale from st join q on q.asset_id = st.asset_id where step > greatest(1.0::double, 30 * a, 8 * b, 4 * c) or step > greatest(1.0::double, 4 * a, 2 * b)""",
    ),
    "block_context": plan(
        lambda s, d: (lambda t, w: t.withColumn("blk", F.floor(F.col("block") / 20)).select("trade_id", F.sum("size").over(w).cast("decimal(38,10)").alias("block_volume"), F.count("*").over(w).alias("block_trades"), F.max("price").over(w).alias("block_high"), F.sum(F.when(F.col("side") == "BUY", F.col("size")).otherwise(0)).over(w).cast("decimal(38,10)").alias("block_buys")))(tape(s, d), Window.partitionBy("market_id", "blk")),
        f"with {TAPE} select trade_id, cast(sum(size) over w as decimal(38,10)) as block_volume, count(*) over w as block_trades, max(price) over w as block_high, cast(sum(case when side = 'BUY' then size else 0 end) over w as decimal(38,10)) as block_buys from tape window w as (partition by market_id, block // 20)", "block_volume block_high block_buys",
    ),
}
