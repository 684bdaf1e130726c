"""Coverage and order-book plans: interval algebra, heartbeats, ladders, dedupe, validators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as I
from ..operators import series as S
from .adapters import plan, table


def _feed(s, d, kind):
    """Covered seconds of an asset by one feed: an event covers from its time on, for a length its value gives."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(s, d, "events").where(F.col("event_type") == kind).select((F.col("user_id") % 10).alias("asset_id"), start.alias("start"), (start + 600 + F.floor("value").cast("long") * 60).alias("end"))


def _feed_sql(name, kind):
    return f"{name} as (select user_id % 10 as asset_id, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000000 + 600 + cast(floor(value) as bigint) * 60 as e from events where event_type = '{kind}')"


def _islands_sql(name, source, gap=0):
    return f"""{name}0 as (select *, case when max(e) over w is null or s > max(e) over w + {gap} then 1 else 0 end as new from {source} window w as (partition by asset_id order by s, e rows between unbounded preceding and 1 preceding)),
    {name}1 as (select *, sum(new) over (partition by asset_id order by s, e rows unbounded preceding) as isl from {name}0),
    {name} as (select asset_id, min(s) as s, max(e) as e, count(*) as n_merged from {name}1 group by asset_id, isl)"""


def _clicks(s, d):
    return I.islands(_feed(s, d, "click"), ["asset_id"], "start", "end", 300)


def _views(s, d):
    return I.islands(_feed(s, d, "view"), ["asset_id"], "start", "end")


def _heartbeat(s, d):
    e = table(s, d, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp"))).withColumn("shard", F.col("user_id") % 5)
    w = Window.partitionBy("shard", "hour").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return e.withColumn("gap", gap).groupBy("shard", "hour").agg(F.count("*").alias("beats"), F.max("gap").alias("max_gap"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.bool_or(F.col("event_type") == "error").alias("broken"), F.bool_and(F.col("value") > 1).alias("fresh")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def _ladder(s, d):
    """Hours of the calendar for each asset with a readiness verdict, the first rule that holds."""
    e = table(s, d, "events").withColumn("asset_id", F.col("user_id") % 10).withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    hours = e.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour"))
    assets = e.select("asset_id").distinct()
    seen = e.groupBy("asset_id", "hour").agg(F.count_if(F.col("event_type") == "view").alias("books"), F.count_if(F.col("event_type") == "purchase").alias("deltas"), F.count_if(F.col("event_type") == "error").alias("gaps"), F.count_if(F.col("event_type") == "signup").alias("recoveries"))
    grid = assets.crossJoin(F.broadcast(hours)).join(seen, ["asset_id", "hour"], "left").na.fill(0)  # the calendar: one row an hour
    state = F.when(F.col("books") == 0, "no_book").when((F.col("gaps") > 0) & (F.col("recoveries") == 0), "unseeded_gap").when(F.col("gaps") > 0, "recovered_gap").when(F.col("deltas") == 0, "seed_without_delta").otherwise("ready")
    return grid.select("asset_id", "hour", state.alias("readiness"))


def _paired(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 10).alias("asset_id"), F.col("ts"), "event_type").where("event_type in ('error', 'signup')")
    return I.paired(e, ["asset_id"], "ts", F.col("event_type") == "error", F.col("event_type") == "signup", F.lit("2024-02-01").cast("timestamp_ntz"))


def _fleet(s, d):
    e = table(s, d, "events")
    both = e.select("event_id", "ts", F.lit(1).alias("priority")).unionByName(e.where("event_id % 3 = 0").select("event_id", (F.col("ts") - F.expr("interval 5 seconds")).alias("ts"), F.lit(2).alias("priority")))
    return S.top_per_key(both, ["event_id"], [F.asc("ts"), F.asc("priority")], 1).drop("rank")


def _tick_grid(s, d):
    """Prices off the active tick, the last one set before them."""
    e = table(s, d, "events").select((F.col("user_id") % 10).alias("asset_id"), "event_id", F.col("value").cast("decimal(10,2)").alias("price"), F.when(F.col("event_type") == "signup", F.lit("0.05").cast("decimal(4,2)")).when(F.col("event_type") == "error", F.lit("0.01").cast("decimal(4,2)")).alias("tick"))
    active = F.last("tick", ignorenulls=True).over(Window.partitionBy("asset_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("active", active).where(F.col("active").isNotNull() & (F.col("price") % F.col("active") != 0)).groupBy("asset_id").agg(F.count("*").alias("violations"), F.min("event_id").alias("first_event"))


def _frames(s, d):
    """Lines of complete frames only: a frame has exactly one closing line; keys may be null."""
    line = table(s, d, "lineitem").select(F.when(F.col("l_orderkey") % 11 != 0, F.col("l_orderkey")).alias("frame"), "l_linenumber", "l_partkey", (F.col("l_linenumber") == 1).alias("closing"))
    whole = line.groupBy("frame").agg(F.count_if("closing").alias("n")).where("n = 1").select(F.col("frame").alias("f"))
    return line.join(whole, F.col("frame").eqNullSafe(F.col("f")), "left_semi").groupBy("frame").agg(F.count("*").alias("lines"), F.sum("l_partkey").alias("parts"))


PLANS = {
    "interval_islands": plan(_clicks, f"with {_feed_sql('c', 'click')}, {_islands_sql('i', 'c', 300)} select asset_id, s as start, e as \"end\", n_merged from i"),
    "interval_overlap": plan(
        lambda s, d: I.overlap(_clicks(s, d).drop("n_merged"), _views(s, d).drop("n_merged"), ["asset_id"], 86400).select("asset_id", F.col("clip_start"), F.col("clip_end")),
        f"with {_feed_sql('c', 'click')}, {_islands_sql('i', 'c', 300)}, {_feed_sql('v', 'view')}, {_islands_sql('j', 'v')} select i.asset_id, greatest(i.s, j.s) as clip_start, least(i.e, j.e) as clip_end from i join j on i.asset_id = j.asset_id and i.s < j.e and j.s < i.e",
    ),
    "gap_hours": plan(
        lambda s, d: I.per_bucket(_clicks(s, d), ["asset_id"], 3600),
        f"with {_feed_sql('c', 'click')}, {_islands_sql('i', 'c', 300)}, h as (select asset_id, s, e, unnest(range(s // 3600, (e - 1) // 3600 + 1)) as bucket from i) select asset_id, bucket, cast(sum(least(e, (bucket + 1) * 3600) - greatest(s, bucket * 3600)) as bigint) as units, count(*) as pieces from h group by 1, 2",
    ),
    "gap_uncovered": plan(
        lambda s, d: I.uncovered(_feed(s, d, "error"), _views(s, d).drop("n_merged"), ["asset_id"]),
        f"with {_feed_sql('g', 'error')}, {_feed_sql('v', 'view')}, {_islands_sql('j', 'v')} select asset_id, s as start, e as \"end\" from g where not exists (select 1 from j where j.asset_id = g.asset_id and j.s <= g.s and j.e >= g.e)",
    ),
    "gap_pairing": plan(
        _paired,
        """with m as (select user_id % 10 as asset_id, ts, event_type from events where event_type in ('error', 'signup')), n as (select *, min(case when event_type = 'signup' then ts end) over (partition by asset_id order by ts rows between 1 following and unbounded following) as nxt from m)
           select asset_id, ts as start, coalesce(nxt, timestamp '2024-02-01') as "end", nxt is not null as recovered from n where event_type = 'error'""",
    ),
    "heartbeat_hours": plan(
        _heartbeat,
        """with e as (select *, user_id % 5 as shard, date_trunc('hour', ts) as hour from events), g as (select *, date_diff('microsecond', lag(ts) over (partition by shard, hour order by ts, event_id), ts) as gap from e)
           select shard, hour, count(*) as beats, max(gap) as max_gap, min(ts) as first_at, max(ts) as last_at, bool_or(event_type = 'error') as broken, bool_and(value > 1) as fresh from g group by 1, 2""",
    ),
    "readiness_ladder": plan(
        _ladder,
        """with e as (select *, user_id % 10 as asset_id, date_trunc('hour', ts) as hour from events), h as (select unnest(generate_series((select min(hour) from e), (select max(hour) from e), interval 1 hour)) as hour), a as (select distinct asset_id from e),
           k as (select asset_id, hour, count(*) filter (where event_type = 'view') as books, count(*) filter (where event_type = 'purchase') as deltas, count(*) filter (where event_type = 'error') as gaps, count(*) filter (where event_type = 'signup') as recoveries from e group by 1, 2),
           g as (select a.asset_id, h.hour, coalesce(books, 0) as books, coalesce(deltas, 0) as deltas, coalesce(gaps, 0) as gaps, coalesce(recoveries, 0) as recoveries from a cross join h left join k on k.asset_id = a.asset_id and k.hour = h.hour)
           select asset_id, hour, case when books = 0 then 'no_book' when gaps > 0 and recoveries = 0 then 'unseeded_gap' when gaps > 0 then 'recovered_gap' when deltas = 0 then 'seed_without_delta' else 'ready' end as readiness from g""",
    ),
    "lag_percentiles": plan(
        lambda s, d: table(s, d, "events").groupBy("event_type").agg(*[F.expr(f"percentile(event_id, {q})").cast("decimal(20,4)").alias(n) for q, n in ((0.5, "p50"), (0.99, "p99"))], F.max("event_id").alias("top")),
        "select event_type, cast(quantile_cont(event_id, 0.5) as decimal(20,4)) as p50, cast(quantile_cont(event_id, 0.99) as decimal(20,4)) as p99, max(event_id) as top from events group by 1", "p50 p99",
    ),
    "fleet_dedupe": plan(_fleet, "select event_id, ts, priority from (select *, row_number() over (partition by event_id order by ts, priority) as rn from (select event_id, ts, 1 as priority from events union all select event_id, ts - interval 5 seconds, 2 from events where event_id % 3 = 0)) where rn = 1"),
    "tick_grid": plan(
        _tick_grid,
        """with e as (select user_id % 10 as asset_id, event_id, cast(value as decimal(10,2)) as price, case when event_type = 'signup' then cast(0.05 as decimal(4,2)) when event_type = 'error' then cast(0.01 as decimal(4,2)) end as tick from events),
           a as (select *, last_value(tick ignore nulls) over (partition by asset_id order by event_id rows unbounded preceding) as active from e) select asset_id, count(*) as violations, min(event_id) as first_event from a where active is not null and price % active <> 0 group by 1""",
    ),
    "frame_atomicity": plan(
        _frames,
        """with l as (select case when l_orderkey % 11 <> 0 then l_orderkey end as frame, l_linenumber, l_partkey, l_linenumber = 1 as closing from lineitem), w as (select frame as f from l group by 1 having count(*) filter (where closing) = 1)
           select frame, count(*) as lines, cast(sum(l_partkey) as bigint) as parts from l where exists (select 1 from w where w.f is not distinct from l.frame) group by 1""",
    ),
    "struct_max_position": plan(
        lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("m"), F.max(F.when(F.col("l_returnflag") == "R", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))).alias("r")).select("l_suppkey", F.col("m.l_orderkey").alias("last_order"), F.col("r.l_orderkey").alias("last_returned"), F.col("m").eqNullSafe(F.col("r")).alias("same")),
        "with g as (select l_suppkey, max(row(l_shipdate, l_orderkey, l_linenumber)) as m, max(row(l_shipdate, l_orderkey, l_linenumber)) filter (where l_returnflag = 'R') as r from lineitem group by 1) select l_suppkey, m[2] as last_order, r[2] as last_returned, m is not distinct from r as same from g",
    ),
    "rule_counters": plan(
        lambda s, d: table(s, d, "lineitem").agg(F.count_if(F.col("l_quantity") <= 0).alias("no_quantity"), F.count_if(F.col("l_discount") > 0.08).alias("deep"), F.count_if(F.col("l_tax") == 0).alias("untaxed"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("open_returns"), F.count("*").alias("rows")),
        "select count(*) filter (where l_quantity <= 0) as no_quantity, count(*) filter (where l_discount > 0.08) as deep, count(*) filter (where l_tax = 0) as untaxed, count(*) filter (where l_returnflag = 'R' and l_linestatus = 'O') as open_returns, count(*) as rows from lineitem",
    ),
    "provenance_mask": plan(
        lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.bit_or(F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(4)).alias("mask")).where(F.col("mask").bitwiseAND(1) == 0),
        "select l_orderkey, bit_or(case when l_returnflag = 'A' then 1 when l_returnflag = 'R' then 2 else 4 end) as mask from lineitem group by 1 having bit_or(case when l_returnflag = 'A' then 1 when l_returnflag = 'R' then 2 else 4 end) & 1 = 0",
    ),
    "coverage_precedence": plan(
        lambda s, d: _clicks(s, d).groupBy("asset_id").agg(F.count("*").alias("a"), F.max("end").alias("a_end")).join(_views(s, d).where("asset_id > 2").groupBy("asset_id").agg(F.count("*").alias("b"), F.max("end").alias("b_end")), "asset_id", "full_outer").select("asset_id", F.coalesce("b_end", "a_end").alias("until"), F.when(F.col("b").isNull(), "first").when(F.col("a").isNull(), "second").otherwise("both").alias("feeds")),
        f"with {_feed_sql('c', 'click')}, {_islands_sql('i', 'c', 300)}, {_feed_sql('v', 'view')}, {_islands_sql('j', 'v')}, x as (select asset_id, max(e) as a_end from i group by 1), y as (select asset_id, max(e) as b_end from j where asset_id > 2 group by 1) select coalesce(x.asset_id, y.asset_id) as asset_id, coalesce(b_end, a_end) as until, case when b_end is null then 'first' when a_end is null then 'second' else 'both' end as feeds from x full join y on x.asset_id = y.asset_id",
    ),
    "fallback_tiers": plan(
        lambda s, d: (lambda c, seen, near: seen.unionByName(near.join(seen, "c_custkey", "left_anti")).unionByName(c.join(seen, "c_custkey", "left_anti").join(near, "c_custkey", "left_anti").select("c_custkey", F.lit("affinity").alias("tier"))))(
            table(s, d, "customer"), table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit("observed").alias("tier")).distinct(), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("sibling").alias("tier")).distinct()
        ),
        "select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') then 'observed' when exists (select 1 from orders where o_custkey = c_custkey) then 'sibling' else 'affinity' end as tier from customer",
    ),
    "hour_calendar": plan(
        lambda s, d: table(s, d, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.expr("sequence(cast(date_trunc('hour', a) as timestamp_ntz), cast(date_trunc('hour', b) as timestamp_ntz), interval 1 hour)")).alias("hour")),
        "select unnest(generate_series((select date_trunc('hour', min(ts)) from events), (select date_trunc('hour', max(ts)) from events), interval 1 hour)) as hour",
    ),
}
