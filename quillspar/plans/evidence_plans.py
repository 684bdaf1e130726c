"""Evidence gate, profiles, reasons, source-confirmed and expected fills, token states and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators import evidence as V
from ..operators import features as X
from .adapters import plan, replay_orders, table
from .replay_plans import _MET, BUCKET, BUFFER, RATE, _trades, _within


def _orders(s, d):
    """Orders read from a print of the tape: its trade id, and a log that prints of the same thousand share."""
    o = replay_orders(s, d)
    return o.select("order_index", "market_id", "asset_id", "side", "limit_price", "size", F.col("arrival").alias("signal_block"), (F.col("arrival") + F.col("order_index") % 5).alias("source_trade_id"), F.array((F.col("arrival") % 1000), F.lit(-1).cast("long")).alias("source_logs"))


def _tape(s, d):
    return _trades(s, d).withColumn("logs", F.array(F.col("trade_id") % 1000))


def _evidence(s, d):
    got = V.profile_evidence(_orders(s, d), _tape(s, d), bucket=BUCKET)
    return got.groupBy("profile", F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("orders"), F.sum("filled").cast("decimal(38,10)").alias("filled"))


def _blocks(seconds):
    return -(-seconds // 2)


def _profile_rows():
    rows = []
    for p in V.PROFILES:
        ttl = "null" if p.quote_ttl_seconds is None else str(_blocks(p.quote_ttl_seconds))
        rows.append(f"('{p.name}', cast({p.rate} as decimal(6,4)), {_blocks(p.latency_seconds)}, {_blocks(p.horizon_seconds)}, cast({p.buffer} as decimal(11,10)), {p.exclude_source}, {p.need_quote}, {ttl}, {p.min_trailing}, cast({p.trailing_multiple} as decimal(2,1)), {p.min_future}, {p.any_side})")
    return ", ".join(rows)


_BACK = max(_blocks(p.quote_ttl_seconds or 0) for p in V.PROFILES)
_AHEAD = max(_blocks(p.latency_seconds) + _blocks(p.horizon_seconds) for p in V.PROFILES)
_EXEC = "greatest(0, least(1, case when side = 'BUY' then trade_price + buf else trade_price - buf end))"
EVIDENCE_SQL = f"""{_MET}, pf as (select * from (values {_profile_rows()}) t(profile, rate, lat, hor, buf, excl, need, ttl, mint, mult, minf, anyside)),
    m as (select profile, rate, lat, hor, buf, ttl, o.order_index, side, limit_price, trade_id, block, trade_price, trade_size, arrival from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between greatest(0, arrival - {_BACK}) and arrival + {_AHEAD}
          cross join pf where (anyside or trade_side = side) and not (excl and (trade_id = arrival + o.order_index % 5 or trade_id % 1000 = arrival % 1000))),
    b as (select *, {_within('trade_price')} as ok, block < arrival + lat and (ttl is null or block >= arrival + lat - ttl) as before, block between arrival + lat and arrival + lat + hor as after, {_EXEC} as ex from m),
    c as (select *, after and ok and {_within('ex')} as eligible from b),
    g as (select profile, order_index, max_by(trade_price, (block, trade_id)) filter (where before) as quote, count(*) filter (where before and ok) as bn, sum(trade_size) filter (where before and ok) as bv,
          count(*) filter (where eligible) as fn, sum(trade_size) filter (where eligible) as fv, sum(cast(trade_size * rate as decimal(38,10))) filter (where eligible) as cap from c group by 1, 2),
    j as (select pf.profile, o.order_index, o.size, coalesce(cap, 0) as cap, case when need and quote is null then 'missing_pre_arrival_trade_quote_proxy' when need and not {_within('quote')} then 'pre_arrival_trade_quote_outside_limit'
          when coalesce(bn, 0) < mint then 'insufficient_trailing_same_side_trade_count' when coalesce(bv, 0) < o.size * mult then 'insufficient_trailing_same_side_volume' when coalesce(fn, 0) < minf then 'insufficient_future_eligible_trade_count' end as reason
          from ords o cross join pf left join g on g.order_index = o.order_index and g.profile = pf.profile)
    select profile, coalesce(reason, 'passed') as reason, count(*) as orders, cast(sum(case when reason is null then least(size, cap) else 0 end) as decimal(38,10)) as filled from j group by 1, 2"""


def _priors(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 3).alias("k1"), (F.col("user_id") % 9).alias("k2"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return X.hierarchical_prior(e, ["k1", "k2"], "y", 8.0)


def _expected(s, d):
    o = replay_orders(s, d).withColumns({"k1": F.col("order_index") % 3, "k2": F.col("order_index") % 9, "intent": F.when(F.col("order_index") % 6 == 0, "PASSIVE").otherwise("TAKER")})
    return V.expected_fill(o, _priors(s, d), ["k1", "k2"], strength=8.0).select("order_index", F.round("probability", 9).alias("probability"), F.round(F.col("expected").cast("double"), 6).alias("expected"), "status")


EXPECTED_SQL = """with e as (select user_id % 3 as k1, user_id % 9 as k2, case when event_type = 'purchase' then 1 else 0 end as y from events), r0 as (select count(*) as n, cast(sum(y) as double) / count(*) as rate from e),
    r1 as (select k1, count(*) as n, (sum(y) + 8.0 * (select rate from r0)) / (count(*) + 8.0) as rate from e group by 1), r2 as (select e.k1, k2, count(*) as n, (sum(y) + 8.0 * max(r1.rate)) / (count(*) + 8.0) as rate from e join r1 on r1.k1 = e.k1 group by 1, 2),
    o as (select o_orderkey as order_index, o_orderkey % 3 as k1, o_orderkey % 9 as k2, cast(o_custkey % 40 + 1 as double) as size, o_orderkey % 6 <> 0 and not (o_orderpriority like '1%' or o_orderpriority like '2%') as ok from orders),
    p1 as (select o.*, (coalesce(r1.n, 0) * coalesce(r1.rate, 0.0) + 8.0 * r0.rate) / (coalesce(r1.n, 0) + 8.0) as p from o cross join r0 left join r1 on r1.k1 = o.k1),
    p2 as (select p1.* exclude (p), (coalesce(r2.n, 0) * coalesce(r2.rate, 0.0) + 8.0 * p) / (coalesce(r2.n, 0) + 8.0) as p from p1 left join r2 on r2.k1 = p1.k1 and r2.k2 = p1.k2)
    select order_index, case when ok then round(p, 9) end as probability, case when ok then round(round(size * p, 10), 6) else 0.0 end as expected, case when not ok then 'UNSUPPORTED' when size * p < 0.0001 then 'NO_FILL' else 'EXPECTED' end as status from p2"""


def _source_confirmed(s, d):
    o = replay_orders(s, d).withColumns({"intent": F.when(F.col("order_index") % 4 == 0, "PASSIVE").otherwise("TAKER"), "source_trade_id": F.col("arrival") + F.col("order_index") % 5})
    return V.source_confirmed(o, _trades(s, d), rate=RATE, buffer=BUFFER)


def _token():
    return {
        "asset_id": F.when(F.col("p_partkey") % 17 != 0, F.col("p_partkey")), "market_id": F.when(F.col("p_partkey") % 19 != 0, F.col("p_partkey") % 50), "condition_id": F.when(F.col("p_partkey") % 19 != 0, F.col("p_partkey") % 50), "placeholder": F.col("p_partkey") % 23 == 0,
        "tokens": F.when(F.col("p_partkey") % 29 == 0, 1).otherwise(2), "active": F.col("p_partkey") % 7 != 0, "closed": F.col("p_partkey") % 11 == 0, "resolved": F.col("p_partkey") % 13 == 0, "archived": F.col("p_partkey") % 31 == 0,
    }


_STATUSES = ["ready", "live", "one_sided", "empty", "stale", "gap", "disconnected", "no_clob_book", "probe_error", "odd", ""]


def _lifecycle(s, d):
    p = table(s, d, "part")
    status = F.element_at(F.array(*map(F.lit, _STATUSES)), (F.col("p_partkey") % 11 + 1).cast("int"))
    bid = F.when(F.col("p_size") % 5 != 0, F.lit(0.4))
    rows = p.withColumn("blockers", I.metadata_blockers(_token())).withColumn("blocker", I.book_blocker(status, F.when(F.col("p_size") % 8 != 0, F.col("p_size").cast("long") * 30000), bid, bid))
    return rows.select("p_partkey", "blockers", F.when(F.col("blockers") == "", F.col("blocker")).alias("blocker"), I.lifecycle(F.col("blockers"), F.col("blocker")).alias("state"))


LIFECYCLE_SQL = f"""with p as (select p_partkey, p_size, [{', '.join(repr(x) for x in _STATUSES)}][p_partkey % 11 + 1] as status, case when p_size % 8 <> 0 then p_size * 30000 end as age, case when p_size % 5 <> 0 then 0.4 end as bid from part),
    b as (select *, concat_ws(',', case when p_partkey % 17 = 0 then 'missing_asset_id' end, case when p_partkey % 19 = 0 then 'missing_market_id' end, case when p_partkey % 19 = 0 then 'missing_condition_id' end, case when p_partkey % 23 = 0 then 'placeholder_market' end,
          case when p_partkey % 29 = 0 then 'insufficient_token_mapping' end, case when p_partkey % 7 = 0 then 'inactive_token' end, case when p_partkey % 11 = 0 then 'closed_market' end, case when p_partkey % 13 = 0 then 'resolved_market' end, case when p_partkey % 31 = 0 then 'archived_market' end) as blockers,
          case when status = 'no_clob_book' then 'no_clob_book' when status = 'probe_error' then 'book_probe_error' when age is null then 'no_book_snapshot' when status in ('stale', 'gap') then status when status = 'disconnected' then 'book_disconnected' when age > 900000 then 'stale_book'
               when status = 'one_sided' then 'missing_two_sided_quotes' when status = 'empty' then 'empty_book' when status = 'odd' then 'bad_book_status' when bid is null then 'missing_two_sided_quotes' end as blocker from p)
    select p_partkey, blockers, case when blockers = '' then blocker end as blocker, case when p_partkey % 13 = 0 then 'RESOLVED' when p_partkey % 11 = 0 or p_partkey % 7 = 0 then 'CLOSING' when p_partkey % 31 = 0 then 'ARCHIVED' when blockers <> '' then 'DISCOVERED'
        when blocker is null then 'LIVE' when blocker in ('stale', 'gap', 'book_disconnected', 'stale_book') then 'STALE' else 'TRADABLE_PENDING_BOOK' end as state from b"""


def _scored(s, d):
    c = table(s, d, "customer")
    t = {
        "closed": F.col("c_custkey") % 9 == 0, "focused": F.col("c_custkey") % 14 == 0, "strategy": F.col("c_custkey") % 21 == 1, "watched": F.col("c_custkey") % 5 == 0, "category": F.when(F.col("c_custkey") % 3 == 0, "Crypto ").otherwise(F.col("c_mktsegment")),
        "volume": F.col("c_acctbal") * 30, "trades": (F.col("c_custkey") % 300).cast("int"), "ends_in": F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") * 37 - 2000), "recent": (F.col("c_nationkey") * 2), "stale": F.col("c_custkey") % 6 == 0,
    }
    rows = c.withColumn("score", I.subscription_score(t))
    return rows.select("c_custkey", (F.col("c_custkey") % 700).alias("token_id"), (F.col("c_custkey") % 4).alias("shard"), "score", I.subscription_tier(t["closed"], t["focused"], t["strategy"], F.col("score")).alias("tier"))


def _top_subscriptions(s, d):
    """A token once, by its best score; then the 20 best of each shard."""
    once = _scored(s, d).where("score > 0").groupBy("token_id").agg(F.max(F.struct("score", -F.col("c_custkey"), "shard", "tier")).alias("b")).select("token_id", "b.shard", "b.score", "b.tier")
    return X.ranked(once, ["shard"], [F.desc("score"), F.asc("token_id")]).where("place <= 20")


SCORED_SQL = """sc as (select c_custkey, c_custkey % 700 as token_id, c_custkey % 4 as shard, case when c_custkey % 9 = 0 then -10000 else case when c_custkey % 14 = 0 then 1000 else 0 end + case when c_custkey % 21 = 1 then 700 else 0 end + case when c_custkey % 5 = 0 then 400 else 0 end
        + case when c_custkey % 3 = 0 then 250 else 0 end + least(250, cast(floor(greatest(c_acctbal * 30, 0) / 1000) as integer)) + least(200, c_custkey % 300)
        + case when c_custkey % 4 <> 0 and c_custkey * 37 - 2000 between 0 and 3600 then 100 when c_custkey % 4 <> 0 and c_custkey * 37 - 2000 between 0 and 86400 then 50 else 0 end + least(150, c_nationkey * 2 * 5) - case when c_custkey % 6 = 0 then 200 else 0 end end as score from customer),
    st as (select c_custkey, token_id, shard, cast(score as integer) as score, case when c_custkey % 9 = 0 then 'P4' when c_custkey % 14 = 0 or c_custkey % 21 = 1 then 'P0' when score >= 650 then 'P1' when score > 0 then 'P2' else 'P3' end as tier from sc)"""


def _tiers(s, d):
    o = table(s, d, "orders")
    ends = F.when(F.col("o_custkey") % 5 != 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    tier = I.frontend_tier(target=F.col("o_orderkey") % 40 == 0, trades=(F.col("o_custkey") % 60).cast("int"), active=F.col("o_orderstatus") == "O", closed=F.col("o_orderkey") % 3 == 0, ends=ends, short_crypto=F.col("o_orderkey") % 17 == 0, now=1000000000, recent_days=200, worth_trades=30, defer=False)
    return o.select("o_orderkey", tier.alias("tier"))


PLANS = {
    "execution_profiles": plan(_evidence, f"with {EVIDENCE_SQL}", "filled"),
    "reason_aliases": plan(
        lambda s, d: table(s, d, "orders").withColumn("reason", F.element_at(F.array(*[F.lit(r) for r in [*V.REASON_ALIASES, "price_buffer_exceeds_limit"]]), (F.col("o_orderkey") % (len(V.REASON_ALIASES) + 1) + 1).cast("int"))).groupBy(V.standard_reason(F.col("reason")).alias("reason")).agg(F.count("*").alias("orders")),
        f"with r as (select [{', '.join(repr(r) for r in [*V.REASON_ALIASES.values(), 'price_buffer_exceeds_limit'])}][o_orderkey % {len(V.REASON_ALIASES) + 1} + 1] as reason from orders) select reason, count(*) as orders from r group by 1",
    ),
    "source_confirmed": plan(_source_confirmed, None, "filled"),
    "expected_fill": plan(_expected, EXPECTED_SQL),
    "token_hex": plan(
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 7, F.concat(F.lit("0x"), F.sha2(F.col("l_orderkey").cast("string"), 256))).when(F.col("l_linenumber") == 6, F.lit("x1")).otherwise(F.concat((F.col("l_orderkey") + 1).cast("string"), F.lpad(F.col("l_partkey").cast("string"), 12, "3"), F.lpad(F.col("l_suppkey").cast("string"), 12, "7"))).alias("token")).select("l_orderkey", "l_linenumber", I.token_hex(F.col("token")).alias("token_hex")).distinct(),
        "select distinct l_orderkey, l_linenumber, case when l_linenumber = 7 then sha256(cast(l_orderkey as varchar)) when l_linenumber <> 6 then lpad(lower(to_hex(cast(cast(l_orderkey + 1 as varchar) || lpad(cast(l_partkey as varchar), 12, '3') || lpad(cast(l_suppkey as varchar), 12, '7') as hugeint))), 64, '0') end as token_hex from lineitem",
    ),
    "token_lifecycle": plan(_lifecycle, LIFECYCLE_SQL),
    "frontend_tiers": plan(
        _tiers,
        """with o as (select *, o_orderstatus = 'O' and o_orderkey % 3 <> 0 as act, o_custkey % 60 as n, case when o_custkey % 5 <> 0 then epoch(o_orderdate) end as ends from orders)
           select o_orderkey, case when o_orderkey % 40 = 0 then 'target_full' when n <= 0 and (not act or ends < 1000000000) then 'skipped_no_orderfilled' when n <= 0 then 'waiting_no_orderfilled' when o_orderkey % 17 = 0 then 'crypto_short_full' when act then 'active_full'
               when ends >= 1000000000 - 200 * 86400 then 'recent_full' when n >= 30 then 'backtest_value_full' when ends is not null then 'longtail_event_window' else 'backtest_value_full' end as tier from o""",
    ),
    "subscription_scores": plan(lambda s, d: _scored(s, d), f"with {SCORED_SQL} select * from st"),
    "subscription_top": plan(
        _top_subscriptions,
        f"with {SCORED_SQL}, one as (select * from (select *, row_number() over (partition by token_id order by score desc, c_custkey) as rn from st where score > 0) where rn = 1) select token_id, shard, score, tier, place from (select *, cast(row_number() over (partition by shard order by score desc, token_id) as integer) as place from one) where place <= 20",
    ),
}
