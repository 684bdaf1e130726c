"""Scores, robustness, classifications, profiles and further execution models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C
from ..operators import book as B
from ..operators import features as X
from ..operators import replay as R
from ..operators import session as E
from .adapters import TAPE, plan, replay_orders, table, tape
from .replay_plans import _MET, BUCKET, _trades, _within


def _performance(s, d):
    """Daily returns of each asset: exact sums, then mean, deviation, downside and the sharpe-like figures from them."""
    e = table(s, d, "events").select((F.col("user_id") % 20).alias("run"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), (F.col("value") - 50).cast("decimal(12,2)").alias("r"))
    daily = e.groupBy("run", "day").agg(F.sum("r").cast("decimal(18,2)").alias("r"))
    g = daily.groupBy("run").agg(F.count("*").alias("n"), F.sum("r").cast("decimal(28,2)").alias("total"), F.sum((F.col("r") * F.col("r")).cast("decimal(34,4)")).cast("decimal(38,4)").alias("squares"), F.sum(F.when(F.col("r") < 0, (F.col("r") * F.col("r")).cast("decimal(34,4)"))).cast("decimal(38,4)").alias("down"), F.count_if(F.col("r") > 0).alias("wins"), F.max("r").alias("best"), F.min("r").alias("worst"))
    return g


def _robust(s, d):
    o = table(s, d, "orders").select((F.col("o_custkey") % 60).alias("parameter"), F.col("o_totalprice").cast("decimal(14,2)").alias("score"))
    per = o.groupBy("parameter").agg(F.sum("score").cast("decimal(30,2)").alias("score"))
    ranked = per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "parameter"))).withColumn("decile", F.ntile(10).over(Window.orderBy(F.desc("score"), "parameter")))
    return ranked.groupBy("decile").agg(F.count("*").alias("n"), F.sum("score").cast("decimal(38,2)").alias("score"), F.min("place").alias("first"))


def _through(s, d):
    """Passive fills counted only where the tape trades strictly through the limit; immediate orders can't be seen."""
    o = replay_orders(s, d)
    met = R.candidates(o, _trades(s, d), bucket=BUCKET, opposite=True)
    cross = F.when(F.col("side") == "BUY", F.col("trade_price") < F.col("limit_price")).otherwise(F.col("trade_price") > F.col("limit_price"))
    got = met.where(cross).groupBy("order_index").agg(F.sum("trade_size").cast("decimal(38,10)").alias("flow"), F.min("block").alias("first_block"))
    rows = o.join(got, "order_index", "left")
    return rows.select("order_index", F.when(F.col("tif").isin(*R.IMMEDIATE), "UNOBSERVABLE").when(F.col("flow").isNull(), "UNFILLED").otherwise("FILLED").alias("outcome"), "first_block", F.when(~F.col("tif").isin(*R.IMMEDIATE), F.least(F.coalesce("flow", F.lit(0).cast("decimal(38,10)")), F.col("size").cast("decimal(38,10)"))).alias("filled"))


def _session_events(s, d):
    o = replay_orders(s, d)
    submit = o.select(F.col("asset_id").alias("condition_id"), F.col("arrival").alias("ts"), F.col("order_index").alias("seq"), F.lit("submit").alias("kind"), F.col("order_index").alias("order_id"), "side", F.col("limit_price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), (F.col("deadline") - F.col("arrival")).alias("ttl"))
    cancel = submit.where("order_id % 10 = 0").withColumns({"ts": F.col("ts") + 15, "kind": F.lit("cancel")})
    trade = _trades(s, d).select(F.col("asset_id").alias("condition_id"), F.col("block").alias("ts"), F.col("trade_id").alias("seq"), F.lit("trade").alias("kind"), F.lit(-1).cast("long").alias("order_id"), "side", F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), F.lit(0).cast("long").alias("ttl"))
    return submit.unionByName(cancel).unionByName(trade)


def _residual(s, d):
    e = table(s, d, "events")
    price = (F.floor(F.col("value") % 40) + 5) / 100
    book = e.select((F.col("user_id") % 12).alias("condition_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 53 == 0, "book").otherwise("delta").alias("kind"), F.when(F.col("event_id") % 3 == 0, "NO").otherwise("YES").alias("outcome"), F.when(F.col("event_id") % 2 == 0, "BID").otherwise("ASK").alias("side"), F.when(F.col("event_id") % 2 == 0, price).otherwise(price + 0.5).alias("price"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("size"), F.lit(-1).cast("long").alias("order_id"))
    take = replay_orders(s, d).select((F.col("asset_id") % 12).alias("condition_id"), F.col("arrival").alias("seq"), F.lit("take").alias("kind"), F.lit("YES").alias("outcome"), "side", F.when(F.col("side") == "BUY", 0.8).otherwise(0.2).alias("price"), F.col("size").cast("double").alias("size"), F.col("order_index").alias("order_id"))
    return B.residual_fills(book.unionByName(take), 0.5)


PLANS = {
    "performance_score": plan(
        lambda s, d: _performance(s, d),
        """with e as (select user_id % 20 as run, date_trunc('day', ts) as day, cast(value - 50 as decimal(12,2)) as r from events), g as (select run, day, cast(sum(r) as decimal(18,2)) as r from e group by 1, 2)
           select run, count(*) as n, cast(sum(r) as decimal(28,2)) as total, cast(sum(cast(r * r as decimal(34,4))) as decimal(38,4)) as squares, cast(sum(cast(r * r as decimal(34,4))) filter (where r < 0) as decimal(38,4)) as down, count(*) filter (where r > 0) as wins, max(r) as best, min(r) as worst from g group by 1""",
        "total squares down best worst",
    ),
    "sharpe_sortino": plan(
        lambda s, d: (lambda g, mean, dev: g.select("run", mean.alias("mean"), (mean / dev).cast("decimal(18,6)").alias("sharpe"), (mean / F.sqrt(F.col("down").cast("double") / F.col("n"))).cast("decimal(18,6)").alias("sortino"), (mean / dev - (F.sqrt("n") - 1) / F.sqrt("n")).cast("decimal(18,6)").alias("deflated")))(
            _performance(s, d), F.col("total").cast("double") / F.col("n"), F.sqrt((F.col("squares").cast("double") - F.col("total").cast("double") * F.col("total").cast("double") / F.col("n")) / (F.col("n") - 1))
        ),
        """with e as (select user_id % 20 as run, date_trunc('day', ts) as day, cast(value - 50 as decimal(12,2)) as r from events), g as (select run, day, cast(sum(r) as decimal(18,2)) as r from e group by 1, 2),
           p as (select run, count(*) as n, cast(cast(sum(r) as decimal(28,2)) as double) as t, cast(cast(sum(cast(r * r as decimal(34,4))) as decimal(38,4)) as double) as q, cast(cast(sum(cast(r * r as decimal(34,4))) filter (where r < 0) as decimal(38,4)) as double) as w from g group by 1),
           f as (select *, t / n as m, sqrt((q - t * t / n) / (n - 1)) as v from p) select run, m as mean, cast(m / v as decimal(18,6)) as sharpe, cast(m / sqrt(w / n) as decimal(18,6)) as sortino, cast(m / v - (sqrt(n) - 1) / sqrt(n) as decimal(18,6)) as deflated from f""",
        "sharpe sortino deflated",
    ),
    "parameter_robustness": plan(
        _robust,
        """with p as (select o_custkey % 60 as parameter, cast(sum(cast(o_totalprice as decimal(14,2))) as decimal(30,2)) as score from orders group by 1), r as (select *, cast(row_number() over (order by score desc, parameter) as integer) as place, cast(ntile(10) over (order by score desc, parameter) as integer) as decile from p)
           select decile, count(*) as n, cast(sum(score) as decimal(38,2)) as score, min(place) as first from r group by 1""",
        "score",
    ),
    "trade_through": plan(
        _through,
        f"""with {_MET}, g as (select o.order_index, cast(sum(trade_size) as decimal(38,10)) as flow, min(block) as first_block from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival and deadline and trade_side <> side where {_within('trade_price').replace('<=', '<').replace('>=', '>')} group by 1)
            select o.order_index, case when tif in ('IOC', 'FOK', 'FAK') then 'UNOBSERVABLE' when flow is null then 'UNFILLED' else 'FILLED' end as outcome, first_block, case when tif not in ('IOC', 'FOK', 'FAK') then cast(least(coalesce(flow, 0), size) as decimal(38,10)) end as filled from ords o left join g on g.order_index = o.order_index""",
        "filled",
    ),
    "wallet_fill_orders": plan(
        lambda s, d: tape(s, d).where("asset_id = 3").select(F.col("trade_id").alias("order_index"), "side", F.col("price").alias("limit_price"), "size", (F.col("block") - 1).alias("signal_block"), F.lit("observed").alias("source")),
        f"with {TAPE} select trade_id as order_index, side, price as limit_price, size, block - 1 as signal_block, 'observed' as source from tape where asset_id = 3", "limit_price size",
    ),
    "limit_replay": plan(lambda s, d: E.limit_replay(replay_orders(s, d), _trades(s, d)), None),
    "session_replay": plan(lambda s, d: E.sessions(_session_events(s, d), latency=2), None),
    "residual_book": plan(_residual, None),
    "combined_fill": plan(
        lambda s, d: B.combined_fill(table(s, d, "orders").select(F.col("o_orderkey").alias("order_index"), (F.col("o_custkey") % 30).cast("double").alias("filled"), F.lit(0.5).alias("price"), F.lit(1.0).alias("rebate")), table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_index")).agg(F.max("l_quantity").alias("filled"))),
        """with a as (select o_orderkey as order_index, (o_custkey % 30)::double as f from orders), b as (select l_orderkey, max(l_quantity) as g from lineitem group by 1), c as (select order_index, f, least(f, coalesce(g, 0.0)) as size from a left join b on l_orderkey = order_index)
           select order_index, size as filled, case when size > 0 then 0.5::double end as price, case when f > 0 then 1.0::double * size / f else 0.0::double end as rebate from c""",
    ),
    "portfolio_limits": plan(lambda s, d: X.portfolio_limits(table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("day"), F.col("o_orderkey").alias("signal"), F.col("o_totalprice").alias("cost")), "day", ["signal"], "cost", 2e6), None),
    "top_candidates_daily": plan(
        lambda s, d: X.ranked(table(s, d, "orders").select(F.col("o_orderdate").alias("day"), "o_orderkey", "o_totalprice"), ["day"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).where("place <= 2"),
        "select o_orderdate as day, o_orderkey, o_totalprice, place from (select *, cast(row_number() over (partition by o_orderdate order by o_totalprice desc, o_orderkey) as integer) as place from orders) where place <= 2",
    ),
    "market_taxonomy": plan(
        lambda s, d: table(s, d, "part").select("p_partkey", C.domain(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 4 == 0, "Lakers vs Heat").when(F.col("p_partkey") % 4 == 1, "BTC above 100k").when(F.col("p_partkey") % 4 == 2, "Senate election"))).alias("domain"), C.sides(F.when(F.col("p_partkey") % 4 == 0, "Lakers vs. Heat").otherwise(F.col("p_name"))).alias("s")).select("p_partkey", "domain", F.col("s.left").alias("home"), F.col("s.right").alias("away")),
        "select p_partkey, case when p_partkey % 4 = 0 then 'sports' when p_partkey % 4 = 1 then 'crypto' when p_partkey % 4 = 2 then 'politics' else 'other' end as domain, case when p_partkey % 4 = 0 then 'Lakers' end as home, case when p_partkey % 4 = 0 then 'Heat' end as away from part",
    ),
    "slug_timestamps": plan(
        lambda s, d: table(s, d, "orders").select("o_orderkey", F.concat(F.lit("btc-updown-15m-"), F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("slug")).select("o_orderkey", F.timestamp_seconds(F.regexp_extract("slug", r"-(\d{9,11})$", 1).cast("long")).cast("timestamp_ntz").alias("at"), F.col("slug").rlike(r"-(5|15)m-\d+$").alias("short")),
        "select o_orderkey, o_orderdate as at, true as short from orders",
    ),
    "envelope_order": plan(
        lambda s, d: table(s, d, "events").withColumn("priority", F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)).select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.date_trunc("day", F.col("ts").cast("timestamp")), "priority", "event_id")).alias("place")),
        "select event_id, cast(row_number() over (partition by user_id order by date_trunc('day', ts), case event_type when 'purchase' then 0 when 'error' then 1 else 2 end, event_id) as integer) as place from events",
    ),
    "order_state_attach": plan(
        lambda s, d: (lambda o, e: o.join(e, o.o_custkey == e.user_id, "left").groupBy("o_orderkey").agg(F.max_by("event_type", "event_id").alias("last_state"), F.count("event_id").alias("n_events"), F.max_by(F.when(F.col("value") > 100, F.col("value")), F.when(F.col("value") > 100, F.col("event_id"))).alias("last_large")))(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "events")),
        "select o_orderkey, max_by(event_type, event_id) as last_state, count(event_id) as n_events, max_by(value, event_id) filter (where value > 100) as last_large from orders left join events on o_custkey = user_id group by 1",
    ),
}
