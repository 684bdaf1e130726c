"""Audits, calibrations, coverage and gates over the test tables, and scans and sinks of their own kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import PRICE
from ..operators import replay as R
from ..operators import reports as P
from ..sources import scans as S
from ..sources import sinks as W
from ..sources.catalog import DayPartitions
from ..sources.shared import fresh
from ..streaming import streams as Q
from .adapters import FILLS, TAPE, plan, raw_fills, replay_orders, table, tape
from .replay_plans import _RESULTS, _private


def _costs(s, d):
    line = table(s, d, "lineitem")
    kind = lambda c: F.when(c % 3 == 0, "fee").when(c % 3 == 1, "rebate").otherwise("gas")
    ledger = line.where("l_linenumber <= 4").select(kind(F.col("l_orderkey")).alias("event_type"), F.col("l_orderkey").alias("order_id"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("trade_id"), F.col("l_tax").cast("decimal(10,2)").alias("amount"))
    events = line.where("l_linenumber >= 3").select(kind(F.col("l_orderkey")).alias("event_type"), F.col("l_orderkey").alias("order_id"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("trade_id"), F.when(F.col("l_returnflag") == "A", F.col("l_discount")).otherwise(F.col("l_tax")).cast("decimal(10,2)").alias("amount"))
    return P.cost_samples(ledger, events)


COST_SQL = """l as (select case l_orderkey % 3 when 0 then 'fee' when 1 then 'rebate' else 'gas' end as event_type, l_orderkey as order_id, case when l_suppkey % 2 = 0 then l_suppkey end as trade_id, * from lineitem),
    a as (select event_type, order_id, trade_id, cast(sum(cast(l_tax as decimal(10,2))) as decimal(38,10)) as amount, count(*) as n from l where l_linenumber <= 4 group by 1, 2, 3),
    b as (select event_type, order_id, trade_id, cast(sum(cast(case when l_returnflag = 'A' then l_discount else l_tax end as decimal(10,2))) as decimal(38,10)) as amount, count(*) as n from l where l_linenumber >= 3 group by 1, 2, 3),
    sm as (select coalesce(a.event_type, b.event_type) as event_type, coalesce(a.order_id, b.order_id) as order_id, coalesce(a.trade_id, b.trade_id) as trade_id, coalesce(a.amount, 0) as simulated_amount, coalesce(b.amount, 0) as live_amount, coalesce(a.n, 0) as simulated_count, coalesce(b.n, 0) as live_count
        from a full join b on a.event_type = b.event_type and a.order_id = b.order_id and a.trade_id is not distinct from b.trade_id),
    sv as (select *, cast(abs(simulated_amount - live_amount) as decimal(38,10)) as amount_error, case when simulated_count = 0 then 'missing_simulated' when live_count = 0 then 'missing_live' when simulated_amount = live_amount then 'matched' else 'amount_mismatch' end as verdict from sm),
    cr as (select event_type, count(*) as samples, cast(sum(simulated_amount) as decimal(38,10)) as simulated_amount, cast(sum(live_amount) as decimal(38,10)) as live_amount, cast(sum(amount_error) as decimal(38,10)) as amount_error, count(*) filter (where verdict = 'matched') as matched,
        count(*) filter (where verdict = 'amount_mismatch') as amount_mismatch, count(*) filter (where verdict = 'missing_live') as missing_live, count(*) filter (where verdict = 'missing_simulated') as missing_simulated from sv group by 1),
    crr as (select *, amount_error > 0 or missing_live > 0 or missing_simulated > 0 as requires_recalibration from cr)"""


def _coverage(s, d):
    members = table(s, d, "part").select((F.col("p_partkey") % 40).alias("event_id"), F.col("p_partkey").alias("outcome_id"))
    prices = table(s, d, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("outcome_id"), F.when(F.col("l_returnflag") == "A", "YES").when(F.col("l_returnflag") == "R", "NO").otherwise("NONE").alias("side"), F.col("l_discount").alias("price"))
    return P.outcome_coverage(members, prices)


def _readiness(s, d):
    o = table(s, d, "orders").select(F.when(F.col("o_orderkey") % 4 != 0, F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "P", "PARTIAL_FILLED").otherwise("OPEN")).alias("live_status"))
    e = table(s, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 100000).alias("external_order_id"), F.col("user_id").alias("order_id"))
    return P.label_readiness(o, e)


def _missed(s, d):
    o = R.results(replay_orders(s, d), _private(s, d)).select("order_index", "asset_id", "side", "limit_price", "size", "status", F.col("arrival").alias("block"))
    points = tape(s, d).groupBy((F.col("asset_id") % 15).alias("asset_id"), "block").agg(F.max("price").alias("price"))
    return P.missed_opportunity(o, points, ["asset_id"], "block")


_MISSED = f"""{_RESULTS}, pt as (select asset_id % 15 as asset_id, block, max(price) as price from tape group by 1, 2),
    op as (select o.order_index, o.asset_id, o.side, o.limit_price, o.size, o.arrival from ords o join st on st.order_index = o.order_index where st.status = 'UNFILLED'),
    mm as (select op.order_index, any_value(side) as side, any_value(limit_price) as limit_price, any_value(op.size) as size, max_by(price, (price, -block)) as hp, -max((price, -block))[2] as hx, min(price) as lp, min((price, block))[2] as lx from op join pt on pt.asset_id = op.asset_id and pt.block > op.arrival group by 1),
    mv as (select *, cast(greatest(0, case when side = 'BUY' then hp - limit_price else limit_price - lp end) as decimal(12,10)) as missed_move from mm)
    select order_index, case when side = 'BUY' then 'buy_no_fill_then_price_rose' else 'sell_no_fill_then_price_fell' end as direction, case when side = 'BUY' then hp else lp end as reference_price, case when side = 'BUY' then hx else lx end as reference_x, missed_move, cast(missed_move * cast(size as decimal(26,10)) as decimal(38,10)) as missed_notional from mv"""


def _samples(s, d):
    o = table(s, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") + 1000000).alias("external_order_id"), F.when(F.col("o_orderkey") % 3 == 0, "maker").otherwise("taker").alias("role"),
        F.when(F.col("o_orderstatus") == "F", "FILLED").otherwise("UNFILLED").alias("simulated_status"), F.lit("0.5").cast("decimal(11,10)").alias("simulated_price"), F.lit(10).cast("decimal(26,10)").alias("simulated_size"),
    )
    value = F.col("value").cast("decimal(20,10)")
    e = table(s, d, "events").select(
        F.col("event_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id")).alias("order_id"), F.when(F.col("event_id") % 5 == 0, F.col("user_id") + 1000000).alias("external_order_id"),
        F.when(F.col("event_type") == "purchase", "filled").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "click", "partial_filled").otherwise("open").alias("status"), F.col("ts").alias("event_time"),
        F.when(F.col("event_id") % 4 == 0, value).alias("fill_price"), value.alias("price"), F.when(F.col("event_id") % 3 == 0, value).alias("filled_size"), value.alias("matched_size"),
    )
    return P.calibration_samples(o, e)


SAMPLES_SQL = """co as (select o_orderkey as order_id, case when o_orderkey % 2 = 0 then o_custkey + 1000000 end as ext, case when o_orderkey % 3 = 0 then 'maker' else 'taker' end as role, case when o_orderstatus = 'F' then 'FILLED' else 'UNFILLED' end as simulated_status from orders),
    ce as (select event_id, case when event_id % 2 = 0 then event_id else -event_id end as oid, case when event_id % 5 = 0 then user_id + 1000000 end as ext, case event_type when 'purchase' then 'FILLED' when 'error' then 'REJECTED' when 'click' then 'PARTIAL_FILLED' else 'OPEN' end as live_status, ts, cast(value as decimal(20,10)) as v from events),
    cs as (select distinct order_id, event_id, role, simulated_status, cast(0.5 as decimal(11,10)) as simulated_price, cast(10 as decimal(26,10)) as simulated_size, live_status, v as live_price, v as live_size, ts as event_time
        from co join ce on ce.oid = co.order_id or ce.oid = co.ext or ce.ext = co.order_id or ce.ext = co.ext where live_status <> 'OPEN')"""
SHADOW_SQL = """sh as (select role, count(*) as samples, count(*) filter (where (simulated_status in ('FILLED', 'PARTIAL_FILLED')) <> (live_status in ('FILLED', 'PARTIAL_FILLED'))) as status_errors, cast(sum(abs(simulated_price - live_price)) as decimal(38,10)) as price_error, cast(sum(abs(simulated_size - live_size)) as decimal(38,10)) as size_error from cs group by 1)"""

ALIASES = {"signal_id": ("signal_id", "event_id"), "observed_at": ("observed_at", "ts"), "source": ("source", "feed", "event_type"), "latency_seconds": ("latency_seconds", "lag"), "value": ("value",)}


def _signals(s, d):
    e = table(s, d, "events").select("event_id", "ts", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("feed"), F.when(F.col("user_id") % 6 != 0, F.col("user_id")).alias("lag"))
    got = P.signals_import(e, {k: v for k, v in ALIASES.items() if k != "value"})
    return got.groupBy("source", "missing").agg(F.count("*").alias("events"), F.count_distinct("payload_hash").alias("payloads"))


def _drift(s, d):
    g = table(s, d, "lineitem").groupBy((F.col("l_partkey") % 60).alias("bucket")).agg(F.count("*").alias("samples"), F.count_if(F.col("l_returnflag") == "A").alias("bad"))
    one = lambda c: F.col(c).cast("double")
    return g.select("bucket", "samples", (F.when(F.col("bucket") % 4 == 0, 0.0).otherwise(one("bad") * 100.0 / one("samples"))).alias("status_error_pct"), (one("bucket") / 1000).alias("price_error"), (one("bucket") / 2000).alias("slippage_error"), (F.when(F.col("bucket") % 4 == 0, 0.0).otherwise(one("bucket") / 10)).alias("latency_error"))


def _result_coverage(s, d):
    return P.result_coverage(table(s, d, "customer").select(F.col("c_custkey").alias("run")), table(s, d, "orders").select((F.col("o_custkey") * 2 - 40).alias("run")), "run")


def _contract(s, d):
    e = table(s, d, "events").select(F.lit("all").alias("stream"), F.lit("block").alias("x_axis"), F.col("event_id").alias("place"), F.col("event_id").alias("x"), "event_type", "user_id")
    e = e.withColumn("stream", F.concat(F.lit("s"), F.col("user_id") % 20)).withColumn("x", F.when(F.col("x") % 500 == 0, F.col("x") - 400).otherwise(F.col("x")))
    return P.stream_contract(e, {"purchase": F.lit(True), "SETTLEMENT": F.max("user_id") > 5, "LEDGER": F.max("user_id") < 0}, ["x"])


def _joint(s, d):
    legs = tape(s, d).groupBy("asset_id").agg(F.min("block").alias("first_x"), F.max("block").alias("last_x"), F.count("*").alias("n")).select((F.col("asset_id") % 12).alias("event_id"), "first_x", "last_x", (F.col("n") >= 60).alias("ready"))
    return P.joint_plan(legs)


def _gate(s, d):
    o = table(s, d, "orders")
    state = lambda n: F.when(F.col("o_orderkey") % n == 0, None).when(F.col("o_custkey") % n == 1, "review").otherwise("ready")
    return P.promotion_gate(
        o.select(
            F.col("o_orderkey").alias("run"), state(31).alias("credibility"), state(37).alias("quality"), state(41).alias("reproducible"), state(43).alias("cache"), state(47).alias("settlement"), state(11).alias("triangulation"), state(7).alias("regime"), state(5).alias("prediction"),
            (F.col("o_custkey") % 13 == 0).alias("suspect"), F.when(F.col("o_custkey") % 9 == 0, "regime_specific").otherwise("general").alias("scope"), F.when(F.col("o_custkey") % 6 == 0, 99.0).otherwise(100.0).alias("coverage_pct"), (F.col("o_custkey") % 8).alias("missing_evidence"),
        )
    )


def _state(n):
    return f"(case when o_orderkey % {n} = 0 then null when o_custkey % {n} = 1 then 'review' else 'ready' end)"


_NEED = {"credibility": 31, "quality": 37, "reproducible": 41, "cache": 43, "settlement": 47}
GATE_SQL = f"""with a as (select o_orderkey as run, concat_ws(',', {', '.join(f"case when {_state(n)} is null then 'missing {c}' end" for c, n in {**_NEED, 'triangulation': 11, 'regime': 7}.items())}) as missing,
    concat_ws(',', {', '.join(f"case when {_state(n)} <> 'ready' then '{c}=' || {_state(n)} end" for c, n in {**_NEED, 'triangulation': 11}.items())}, case when o_custkey % 13 = 0 then 'fill_model_suspect' end, case when o_custkey % 6 = 0 then 'coverage' end, case when o_custkey % 8 > 0 then 'missing_evidence' end) as blocked,
    concat_ws(',', case when {_state(7)} <> 'ready' then 'regime=' || {_state(7)} end, case when o_custkey % 9 = 0 then 'regime_specific' end, case when {_state(5)} <> 'ready' then 'prediction=' || {_state(5)} end) as review from orders)
    select run, case when missing <> '' then 'missing' when blocked <> '' then 'blocked' when review <> '' then 'review' else 'ready' end as verdict, missing = '' and blocked = '' as paper, missing = '' and blocked = '' and review = '' as live, missing, blocked, review from a"""


def _gap_counters(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 30).alias("asset_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour_start"), "event_type", "event_id")
    of = lambda t: e.where(F.col("event_type") == t).select("asset_id", "hour_start", F.lit(1).cast("long").alias("gaps"), (F.col("event_id") % 3).alias("recovered"))
    return P.summed_counters([of("error"), of("click"), of("signup")], ["asset_id", "hour_start"], ["gaps", "recovered"])


def _api_trades(s, d):
    e = table(s, d, "events")
    rows = e.select(F.col("event_id").alias("trade_key"), (F.col("user_id") % 7).alias("market_id"), F.col("user_id").alias("token_id"), (F.col("value") / 100).alias("price"), (F.col("value") - 1).alias("size"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("trade_timestamp"), F.col("ts").alias("trade_time"))
    return S.api_trades(rows, 1704100000, 1706000000, markets=[1, 2, 3])


def _signal_days(s, d):
    """Orders in batches by the month of their signal."""
    days = DayPartitions(s, fresh(s, "signal-days"), "batch")
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", F.trunc("o_orderdate", "month").alias("batch"))
    days.part(o.where("batch < date '1998-01-01'"))
    days.part(o.where("batch >= date '1998-01-01'"))
    days.part(o.where("batch = date '1998-03-01'"))  # a part that comes again replaces its batch
    return days.days("1997-06-01", "1998-03-31").select("o_orderkey", "o_totalprice", "batch")


def _settled_catalog(s, d):
    """Settlements by month: every part is written, then the catalogue is finished with a row a part."""
    days = DayPartitions(s, fresh(s, "settlements"), "month")
    days.part(table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")))
    return days.finish([f"{y}-{m:02d}" for y in (1996, 1997) for m in range(1, 13)])


def _raw_books(s, d):
    e = table(s, d, "events")
    one = e.where("event_id % 2 = 0").select(F.when(F.col("event_type") == "purchase", "book").otherwise("price_change").alias("event_type"), F.col("user_id").cast("string").alias("asset_id"), F.col("value").alias("price"), F.col("event_id").alias("size"))
    two = e.where("event_id % 2 = 1").select(F.when(F.col("event_type") == "purchase", "snapshot").otherwise("trade").alias("update_type"), F.col("user_id").cast("string").alias("token_id"), F.col("value").alias("px"), F.col("event_id").alias("qty"))
    return S.raw_books([one, two], ["book", "snapshot", "trade"]).groupBy("asset_id", "kind").agg(F.count("*").alias("n"), F.max("size").alias("last"))


def _messages(s, d):
    """Messages of three kinds from the events, and what the normaliser makes of them."""
    e = table(s, d, "events")
    t, side = F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL")
    level = lambda p, q: F.struct(p.cast("string").alias("price"), q.cast("string").alias("size"))
    price = (F.col("event_id") % 97 + 1) / 100
    book = F.to_json(F.struct(F.lit("book").alias("event_type"), t.alias("asset_id"), F.col("event_id").cast("string").alias("timestamp"), F.array(level(price, F.col("event_id")), level(price + 0.01, F.lit(2))).alias("bids"), F.array(level(price + 0.02, F.lit(3))).alias("asks")))
    change = F.to_json(F.struct(F.lit("price_change").alias("event_type"), F.col("event_id").cast("string").alias("timestamp"), F.array(F.struct(t.alias("asset_id"), side.alias("side"), price.cast("string").alias("price"), F.lit("5").alias("size")), F.struct(t.alias("asset_id"), F.lit("?").alias("side"), price.cast("string").alias("price"), F.lit("5").alias("size"))).alias("price_changes")))
    trade = F.to_json(F.struct(F.lit("last_trade_price").alias("event_type"), t.alias("asset_id"), F.col("event_id").cast("string").alias("timestamp"), side.alias("side"), price.cast("string").alias("price"), F.lit("1.5").alias("size")))
    raw = e.select("event_id", F.when(F.col("event_id") % 3 == 0, book).when(F.col("event_id") % 3 == 1, change).when(F.col("event_id") % 7 == 0, "{broken").otherwise(trade).alias("raw"))
    return S.book_messages(raw, "raw").select("event_id", "kind", "token_id", "side", "price", "size", "place", "event_ms")


MESSAGES_SQL = """with e as (select event_id, cast(user_id as varchar) as t, case when event_id % 2 = 0 then 'BID' else 'ASK' end as sd, cast(cast((event_id % 97 + 1) as decimal(5,0)) * cast(0.01 as decimal(3,2)) as decimal(11,10)) as p from events),
    r as (select event_id, 'snapshot' as kind, t, 'BID' as side, p, cast(event_id as decimal(26,10)) as size, 0 as place from e where event_id % 3 = 0 union all select event_id, 'snapshot', t, 'BID', p + 0.01, 2, 1 from e where event_id % 3 = 0 union all select event_id, 'snapshot', t, 'ASK', p + 0.02, 3, 0 from e where event_id % 3 = 0
        union all select event_id, 'delta', t, sd, p, 5, 0 from e where event_id % 3 = 1 union all select event_id, 'trade', t, sd, p, 1.5, 0 from e where event_id % 3 = 2 and event_id % 7 <> 0)
    select event_id, kind, t as token_id, side, cast(p as double) as price, cast(size as double) as size, cast(place as integer) as place, event_id as event_ms from r"""


def _parts(s, d):
    got = W.bounded_parts(table(s, d, "orders").repartition(3, "o_orderkey"), fresh(s, "parts"), 400)
    return got.agg(F.sum("rows").alias("rows"), (F.max("rows") <= 400).alias("bounded"), (F.count_distinct("sha256") == F.count("*")).alias("distinct_files"), F.min(F.length("sha256")).alias("digits"))


def _chunks(s, d):
    """Lines of an order stay in one chunk, in order."""
    rows = S.boundary_chunks(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], 7).withColumn("chunk", F.spark_partition_id())
    return rows.groupBy("l_orderkey").agg(F.count_distinct("chunk").alias("chunks"), F.count("*").alias("n"))


def _files(s, d):
    """Files of differing columns as one table."""
    path, o = fresh(s, "files"), table(s, d, "orders")
    o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey").write.parquet(f"{path}/one")
    o.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus").write.parquet(f"{path}/two")
    got = S.parquet_files(s, f"{path}/one", f"{path}/two")
    return got.select("o_orderkey", "o_custkey", "o_orderstatus", F.regexp_extract("source_file", "/(one|two)/", 1).alias("folder"))


def _sorted(s, d):
    path = fresh(s, "sorted")
    W.sorted_zstd(table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").repartition(4, "l_returnflag"), path, ["l_orderkey"], ["l_returnflag"])
    return s.read.parquet(path).where("l_orderkey between 100 and 300").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def _receipts(s, d):
    """A build by chunks of blocks; the third overlaps the second and takes its place."""
    fills = raw_fills(s, d).select("tx_hash", "log_index", "block_number")
    build = W.Receipts(W.ParquetTable(s, fresh(s, "build"), ["tx_hash", "log_index"]))
    for name, low, high in (("a", 0, 200), ("b", 200, 400), ("c", 300, 500), ("a", 0, 200)):
        build.run(name, low, high, lambda low=low, high=high: fills.where((F.col("block_number") >= low) & (F.col("block_number") < high)), lambda rows, low=low: rows.where(F.col("block_number") < low).isEmpty())
    return build.table.read().groupBy("block_number").agg(F.count("*").alias("n"))


def _events(s, d):
    rows, path = table(s, d, "events"), fresh(s, "landing")
    rows = rows.unionByName(rows.where("event_id % 10 = 0"))  # some come twice
    rows.repartitionByRange(4, "event_id").write.parquet(path)
    return Q.events(s, path, rows.schema)


def _stream_deduped(s, d):
    got = Q.to_end(Q.deduped(_events(s, d).select("event_id", "user_id", "ts"), ["event_id"], "3650 days"), "append", fresh(s, "stream"))
    return got.groupBy("user_id").agg(F.count("*").alias("n"))


def _stream_sliding(s, d):
    rows = _events(s, d).select(F.col("user_id").alias("asset_id"), "ts", "event_id", F.col("value").alias("price"), F.lit(1).cast("long").alias("size"))
    got = Q.to_end(Q.bars(rows, "2 days", "3650 days", "1 day"), "complete", fresh(s, "stream"))
    return got.select("asset_id", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "high", "low", "trades")


def _stream_sessions(s, d):
    got = Q.to_end(Q.sessions(_events(s, d), ["user_id"], "6 hours", "3650 days"), "complete", fresh(s, "stream"))
    return got.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), "n_events")


def _favourites(s, d):
    """The favourite of each market at its snapshot: both outcomes' last prices before it, close in time and in sum, and enough trades."""
    t = tape(s, d).select((F.col("asset_id") % 30).alias("market_id"), F.when(F.col("trade_id") % 2 == 0, 1).otherwise(2).alias("outcome"), "block", "trade_id", F.when(F.col("trade_id") % 2 == 0, F.col("price")).otherwise((1 - F.col("price")).cast(PRICE)).alias("price"), "size")
    snapshot = F.col("market_id") * 37 + 700
    prior = t.where((F.col("block") <= snapshot) & (F.col("block") >= snapshot - 600))
    at = F.struct("block", "trade_id")
    sides = prior.groupBy("market_id", "outcome").agg(F.max_by("price", at).alias("price"), F.max("block").alias("block"), F.count("*").alias("n"), F.sum("size").cast("decimal(38,10)").alias("volume"))
    pair = sides.groupBy("market_id").agg(F.count("*").alias("sides"), F.max(F.struct("price", "outcome", "block", "n", "volume")).alias("f"), F.min("block").alias("older"), F.max("block").alias("newer"))
    ok = pair.where((F.col("sides") == 2) & (F.col("newer") - F.col("older") <= 200) & (F.col("f.n") >= 3))
    return ok.select("market_id", F.col("f.outcome").alias("favourite"), F.col("f.price").alias("price"), F.col("f.n").alias("trades"), F.col("f.volume").alias("volume"), (F.col("newer") - F.col("older")).alias("skew"))


def _probes(s, d):
    e = table(s, d, "events").select("event_id", (F.col("user_id") % 25).alias("market_id"), F.col("event_id").alias("x"), F.col("value"))
    got = P.probe_pairs(e.where("value > 120").drop("value"), e.where("value <= 20").select("market_id", "x", F.col("value").alias("score")), ["market_id"], "x", 60)
    return got.select("event_id", "market_id", "score")


def _candidates(s, d):
    """Build candidates of four ways of making prices, the best few of each."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("token_id"), "p_size", "p_retailprice")
    n = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("token_id")).agg(F.count("*").alias("trades"), F.max("l_shipdate").alias("last_at"))
    rows = p.join(n, "token_id", "left").withColumn("trades", F.coalesce("trades", F.lit(0).cast("long")))
    way = F.array(F.when(F.col("trades") > 0, "block_close"), F.when((F.col("trades") >= 25) & (F.col("p_size") < 40), "frontend"), F.when(F.col("p_size") % 3 == 0, "api_trades"), F.when(F.col("last_at") < F.lit("2002-01-01").cast("timestamp_ntz"), "chronological"))
    from ..operators import features as X

    rows = rows.select(F.explode(F.array_compact(way)).alias("way"), "token_id", "trades", "last_at")
    return X.ranked(rows, ["way"], [F.desc("trades"), F.asc_nulls_last("last_at"), F.asc("token_id")]).where("place <= 30").select("way", "token_id", "trades", "place")


PLANS = {
    "cost_samples": plan(_costs, f"with {COST_SQL} select * from sv", "simulated_amount live_amount amount_error"),
    "cost_calibration": plan(lambda s, d: P.cost_report(_costs(s, d)), f"with {COST_SQL} select * from crr", "simulated_amount live_amount amount_error"),
    "outcome_coverage": plan(
        _coverage,
        """with m as (select p_partkey % 40 as event_id, p_partkey as o from part), x as (select l_partkey as o, max(l_discount) filter (where l_returnflag = 'A') as y, max(l_discount) filter (where l_returnflag = 'R') as n from lineitem where l_quantity > 25 group by 1)
           select event_id, count(*) as outcomes, count(y) as priced_yes, count(n) as priced_no, count(*) filter (where y is not null and n is not null) as priced_pairs, count(y) * 100.0::double / count(*) as coverage_pct from m left join x using (o) group by 1""",
    ),
    "label_readiness": plan(
        _readiness,
        """with l as (select case when o_orderkey % 4 <> 0 then case o_orderstatus when 'F' then 'FILLED' when 'P' then 'PARTIAL_FILLED' else 'OPEN' end end as st from orders), c as (select count(*) as total, count(st) as labeled, count(*) filter (where st in ('FILLED', 'PARTIAL_FILLED')) as positive, count(*) filter (where st = 'OPEN') as negative from l),
           e as (select count(*) as event_rows, count(distinct case when event_id % 3 = 0 then user_id + 100000 else user_id end) as event_orders from events) select *, case when labeled >= 200 and positive >= 20 and negative >= 20 then 'READY' else 'BLOCKED_INSUFFICIENT_REAL_LABELS' end as status from c, e""",
    ),
    "missed_opportunity": plan(_missed, f"with {_MISSED}", "reference_price missed_move missed_notional"),
    "relevance_order": plan(
        lambda s, d: P.relevance(table(s, d, "part"), "Red Widget", slug="p_type", title="p_name", weight=[F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))], ties=["p_partkey"]).limit(40).select("p_partkey", "relevance"),
        "select p_partkey, relevance from (select *, cast(case when lower(p_type) = 'red widget' then 0 when lower(p_name) = 'red widget' then 1 when contains(lower(p_type), 'red widget') then 2 when contains(lower(p_name), 'red widget') then 3 else 9 end as integer) as relevance, case when p_partkey % 3 <> 0 then p_size end as w from part) order by relevance, w desc nulls last, p_name, p_partkey limit 40",
    ),
    "calibration_samples": plan(_samples, f"with {SAMPLES_SQL} select * from cs", "simulated_price simulated_size live_price live_size"),
    "shadow_calibration": plan(lambda s, d: P.shadow_report(_samples(s, d)), f"with {SAMPLES_SQL}, {SHADOW_SQL} select *, status_errors * 100.0::double / samples as status_error_pct from sh", "price_error size_error"),
    "triangulation": plan(
        lambda s, d: P.triangulation(P.shadow_report(_samples(s, d)), P.cost_report(_costs(s, d))),
        f"""with {SAMPLES_SQL}, {SHADOW_SQL}, {COST_SQL}, f as (select coalesce(sum(samples), 0) as fs, coalesce(sum(status_errors), 0) as se, coalesce(sum(price_error), 0) as pe from sh), c as (select coalesce(sum(samples), 0) as cs, coalesce(bool_or(requires_recalibration), false) as rc from crr),
            t as (select cast(fs as bigint) as fill_samples, cast(cs as bigint) as cost_samples, concat_ws('; ', case when fs = 0 then 'no fill calibration samples' end, case when cs = 0 then 'no cost calibration samples' end, case when se > 0 then 'status errors' end, case when pe > 0.01 * fs then 'price error' end, case when rc then 'cost calibration requires recalibration' end) as reason from f, c)
            select *, reason <> '' as suspect, case when reason <> '' then 'review' else 'ready' end as verdict from t""",
    ),
    "external_signals": plan(
        _signals,
        """with e as (select case when event_type = 'error' then 'manual' else event_type end as source, user_id % 6 = 0 as nolag from events)
           select source, case when nolag then 'latency_seconds' else '' end as missing, count(*) as events, count(*) as payloads from e group by 1, 2""",
    ),
    "profile_suggestions": plan(
        lambda s, d: P.profile_suggestions(_drift(s, d)),
        """with g as (select l_partkey % 60 as bucket, count(*) as samples, count(*) filter (where l_returnflag = 'A') as bad from lineitem group by 1), r as (select bucket, samples, case when bucket % 4 = 0 then 0.0::double else bad::double * 100.0::double / samples::double end as e, bucket::double / 1000 as p, bucket::double / 2000 as sl, case when bucket % 4 = 0 then 0.0::double else bucket::double / 10 end as l from g)
           select bucket, samples, case when e >= 20 or p >= 0.03::double or sl >= 0.03::double or l >= 5 then 'stress' else 'conservative' end as profile, greatest(0.0::double, l) as latency_floor, case when greatest(p, sl) <= 0.01::double then 0.0::double else greatest(0.0025::double, p, sl) end as slippage_floor, least(80.0::double, e * 1.5::double) as haircut_pct
           from r where samples >= 3 and (e > 0 or greatest(p, sl) > 0.01::double or l > 0)""",
    ),
    "result_coverage": plan(
        _result_coverage,
        """with p as (select distinct c_custkey as run from customer), r as (select o_custkey * 2 - 40 as run, count(*) as n from orders group by 1), m as (select p.run as a, r.run as b, n from p full join r on p.run = r.run),
           g as (select count(a) as planned, count(*) filter (where a is not null and b is not null) as covered, count(*) filter (where b is null) as missing, cast(coalesce(sum(n) filter (where a is null), 0) as bigint) as unplanned, cast(coalesce(sum(n - 1), 0) as bigint) as duplicates from m),
           c as (select *, case when planned > 0 then covered * 100.0::double / planned else 0.0::double end as coverage_pct from g) select *, case when planned = 0 or covered = 0 then 'missing' when coverage_pct >= 100 then 'ready' else 'review' end as status from c""",
    ),
    "stream_contract": plan(
        _contract,
        """with e as (select event_id, event_type, user_id, user_id % 20 as s, case when event_id % 500 = 0 then event_id - 400 else event_id end as x from events), l as (select *, coalesce(x < lag(x) over (partition by s order by event_id), false) as bad from e),
           g as (select count(*) as events, 'block' as axes, count(*) filter (where bad) as out_of_order, concat_ws(',', case when count(*) filter (where event_type = 'purchase') = 0 then 'purchase' end, case when max(user_id) > 5 then 'SETTLEMENT' end) as missing from l)
           select *, case when events = 0 then 'missing' when out_of_order = 0 and missing = '' then 'ready' else 'review' end as status from g""",
    ),
    "joint_replay_plan": plan(
        _joint,
        f"""with {TAPE}, l as (select asset_id, min(block) as a, max(block) as b, count(*) >= 60 as ready from tape group by 1), g as (select asset_id % 12 as event_id, count(*) as legs, count(*) filter (where ready) as ready_legs, max(a) as start, min(b) as "end" from l group by 1)
            select *, case when ready_legs < 2 then 'single_leg' when start > "end" then 'no_common_window' when ready_legs < legs then 'partial' else 'ready' end as status from g""",
    ),
    "promotion_gate": plan(_gate, GATE_SQL),
    "data_contract_audit": plan(
        lambda s, d: P.contract_audit(raw_fills(s, d), raw_fills(s, d).select("tx_hash", "log_index", "maker").distinct()),
        f"""with {FILLS}, r as (select count(*) as rows, count(*) filter (where price <= 0 or price >= 1 or price is null) as invalid_price, count(*) filter (where size <= 0 or size is null) as invalid_size, count(*) filter (where token_id is null or market_id is null) as missing_key, count(*) filter (where block_time is null) as missing_time from fills),
            t as (select cast(coalesce(sum(n - 1) filter (where n > 1), 0) as bigint) as repeated, count(*) as derived from (select tx_hash, log_index, maker, count(*) as n from fills group by 1, 2, 3))
            select *, case when rows = 0 and derived > 0 then 'derived_without_source' when rows = 0 then 'empty' when invalid_price > 0 or invalid_size > 0 or missing_key > 0 or missing_time > 0 then 'invalid' when derived + repeated < rows then 'lost_rows' else 'ready' end as verdict from r, t""",
    ),
    "gap_counters": plan(_gap_counters, "select user_id % 30 as asset_id, cast(date_trunc('hour', ts) as timestamp) as hour_start, count(*) as gaps, cast(sum(event_id % 3) as bigint) as recovered from events where event_type in ('error', 'click', 'signup') group by 1, 2"),
    "api_trades": plan(
        _api_trades,
        """with r as (select event_id as trade_key, user_id % 7 as market_id, user_id as token_id, value / 100 as price, value - 1 as size, cast(floor(epoch(ts)) as bigint) as trade_timestamp, ts as trade_time from events)
           select * from r where price between 0 and 1 and size > 0 and trade_timestamp between 1704100000 and 1706000000 and trade_time between timestamp '2024-01-01 09:06:40' and timestamp '2024-01-23 08:53:20' and market_id in (1, 2, 3)""",
    ),
    "signal_day_scan": plan(_signal_days, "select o_orderkey, o_totalprice, cast(date_trunc('month', o_orderdate) as date) as batch from orders where o_orderdate >= timestamp '1997-06-01' and o_orderdate < timestamp '1998-04-01'"),
    "settlement_catalog": plan(_settled_catalog, "with m as (select strftime(o_orderdate, '%Y-%m') as month, count(*) as rows from orders group by 1) select month, rows from m where month between '1996-01' and '1997-12'"),
    "raw_book_batches": plan(
        _raw_books,
        """with r as (select cast(user_id as varchar) as asset_id, case when event_id % 2 = 0 then case when event_type = 'purchase' then 'book' else 'price_change' end else case when event_type = 'purchase' then 'snapshot' else 'trade' end end as kind, event_id from events)
           select asset_id, kind, count(*) as n, max(event_id) as last from r where kind in ('book', 'snapshot', 'trade') group by 1, 2""",
    ),
    "book_messages": plan(_messages, MESSAGES_SQL, "price size"),
    "bounded_parts": plan(_parts, "select count(*) as rows, true as bounded, true as distinct_files, cast(64 as integer) as digits from orders"),
    "boundary_chunks": plan(_chunks, "select l_orderkey, cast(1 as bigint) as chunks, count(*) as n from lineitem group by 1"),
    "union_by_name": plan(_files, "select o_orderkey, case when o_orderkey % 2 = 0 then o_custkey end as o_custkey, case when o_orderkey % 2 = 1 then o_orderstatus end as o_orderstatus, case when o_orderkey % 2 = 0 then 'one' else 'two' end as folder from orders"),
    "sorted_zstd": plan(_sorted, "select l_returnflag, count(*) as n, cast(sum(l_partkey) as bigint) as parts from lineitem where l_orderkey between 100 and 300 group by 1"),
    "chunk_receipts": plan(_receipts, f"with {FILLS} select block_number, count(*) as n from fills where block_number < 200 or block_number between 300 and 499 group by 1"),
    "stream_deduped": plan(_stream_deduped, "select user_id, count(*) as n from events group by 1"),
    "stream_sliding": plan(
        _stream_sliding,
        """with e as (select * from events union all select * from events where event_id % 10 = 0), w as (select user_id, value, unnest([cast(date_trunc('day', ts) as timestamp), cast(date_trunc('day', ts) - interval 1 day as timestamp)]) as day from e)
           select user_id as asset_id, day as bar_start, max(value) as high, min(value) as low, count(*) as trades from w group by 1, 2""",
    ),
    "stream_sessions": plan(
        _stream_sessions,
        """with e as (select user_id, ts from events union all select user_id, ts from events where event_id % 10 = 0), m as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hour then 1 else 0 end as new from e window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from m)
           select user_id, min(ts) as first_at, count(*) as n_events from s group by user_id, k""",
    ),
    "favourite_candidates": plan(
        _favourites,
        f"""with {TAPE}, t as (select asset_id % 30 as market_id, case when trade_id % 2 = 0 then 1 else 2 end as outcome, block, trade_id, case when trade_id % 2 = 0 then price else 1 - price end as price, size from tape), p as (select * from t where block between market_id * 37 + 100 and market_id * 37 + 700),
            s as (select market_id, outcome, max_by(price, (block, trade_id)) as price, max(block) as block, count(*) as n, cast(sum(size) as decimal(38,10)) as volume from p group by 1, 2), r as (select *, row_number() over (partition by market_id order by price desc, outcome desc) as k, count(*) over (partition by market_id) as sides, max(block) over (partition by market_id) - min(block) over (partition by market_id) as skew from s)
            select market_id, outcome as favourite, price, n as trades, volume, skew from r where k = 1 and sides = 2 and skew <= 200 and n >= 3""",
        "price volume",
    ),
    "probe_pairs": plan(
        _probes,
        """with e as (select event_id, user_id % 25 as market_id, value from events), p as (select event_id, market_id from e where value > 120), q as (select market_id, event_id as x, value from e where value <= 20)
           select p.event_id, p.market_id, max_by(value, x) as score from p left join q on q.market_id = p.market_id and q.x <= p.event_id and not exists (select 1 from q z where z.market_id = p.market_id and z.x <= p.event_id and z.x > q.x) and p.event_id - q.x <= 60 group by 1, 2""",
    ),
    "build_candidates": plan(
        _candidates,
        """with n as (select l_partkey as token_id, count(*) as trades, max(l_shipdate) as last_at from lineitem group by 1), r as (select p_partkey as token_id, coalesce(trades, 0) as trades, last_at, p_size from part left join n on token_id = p_partkey),
           w as (select 'block_close' as way, * from r where trades > 0 union all select 'frontend', * from r where trades >= 25 and p_size < 40 union all select 'api_trades', * from r where p_size % 3 = 0 union all select 'chronological', * from r where last_at < timestamp '2002-01-01')
           select way, token_id, trades, place from (select *, cast(row_number() over (partition by way order by trades desc, last_at asc nulls last, token_id) as integer) as place from w) where place <= 30""",
    ),
}
