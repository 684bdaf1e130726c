"""Ledgers, settlement, fees, scores, calibration, features and strategy folds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C
from ..functions import numeric as N
from ..operators import book as B
from ..operators import features as X
from ..operators import ledger as L
from .adapters import TAPE, near, plan, replay_orders, table, tape
from .replay_plans import _MET, BUCKET, _trades


def _entries(s, d):
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "view", "BUY").when(F.col("event_type") == "click", "SELL").when(F.col("event_type") == "signup", "REBATE").when(F.col("event_type") == "purchase", "REDEEM").otherwise("SPLIT")
    return e.select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("value").cast("decimal(18,2)").alias("amount"))


_KIND = "case event_type when 'view' then 'BUY' when 'click' then 'SELL' when 'signup' then 'REBATE' when 'purchase' then 'REDEEM' else 'SPLIT' end"
_ENT = f"ent as (select user_id as account, event_id as seq, {_KIND} as kind, cast(value as decimal(18,2)) as amount from events), cf as (select *, cast(case when kind in ('SELL', 'REDEEM', 'MERGE', 'REBATE') then amount when kind in ('BUY', 'SPLIT') then -amount else 0 end as decimal(38,10)) as cash from ent)"


def _cash(s, d):
    return _entries(s, d).withColumn("cash", L.cashflow(F.col("kind"), F.col("amount")).cast("decimal(38,10)"))


def _settled(s, d):
    o = table(s, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "RESOLVED").when(F.col("o_orderstatus") == "P", "CANCELLED").when(F.col("o_orderkey") % 11 == 0, None).otherwise("OPEN")
    winner = F.when(F.col("o_custkey") % 3 == 0, "YES").when(F.col("o_custkey") % 3 == 1, "NO")
    kind = L.settlement_class(status, winner, F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate")), F.lit("2000-01-01").cast("timestamp_ntz"))
    return o.select("o_orderkey", "o_custkey", kind.alias("kind"))


_SETTLED = """st as (select o_orderkey, o_custkey, case when o_orderstatus = 'F' then 'RESOLVED' when o_orderstatus = 'P' then 'CANCELLED' when o_orderkey % 11 = 0 then null else 'OPEN' end as status, case o_custkey % 3 when 0 then 'YES' when 1 then 'NO' end as winner,
    case when o_orderkey % 17 <> 0 then o_orderdate end as done_at from orders),
    se as (select o_orderkey, o_custkey, case when status is null then 'technical_missing' when status = 'RESOLVED' and done_at is null then 'technical_missing' when status = 'RESOLVED' and done_at > timestamp '2000-01-01' then 'post_cutoff'
    when status = 'RESOLVED' and winner = 'YES' then 'settled_yes' when status = 'RESOLVED' and winner = 'NO' then 'settled_no' when status = 'RESOLVED' then 'identity_conflict' when status = 'CANCELLED' then 'cancelled_half_refund' else 'unresolved' end as kind from st)"""


def _positions(s, d):
    se = _settled(s, d)
    low, high = L.payout(F.col("kind"))
    held = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("shares"))
    rows = held.join(se, held.l_orderkey == se.o_orderkey, "left").withColumns({"low": F.col("shares") * low, "high": F.col("shares") * high})
    return rows.groupBy("kind").agg(F.count("*").alias("positions"), F.sum("shares").alias("shares"), F.sum("low").alias("low"), F.sum("high").alias("high"))


def _scored(s, d):
    doc = table(s, d, "documents").select("doc_id", (F.least(F.col("n_chars"), F.lit(9999)).cast("decimal(8,4)") / F.lit(10000)).cast("decimal(18,8)").alias("score"))
    return table(s, d, "labels").join(doc, "doc_id").select("doc_id", "quality", "toxic", "score")


_SCORED = "sc as (select l.doc_id, l.quality, l.toxic, cast(cast(least(n_chars, 9999) as decimal(18,8)) * cast(0.0001 as decimal(5,4)) as decimal(18,8)) as score from labels l join documents d on d.doc_id = l.doc_id)"


def _fees(s, d):
    t = tape(s, d)
    return t.select("trade_id", N.fee(F.col("size"), F.col("price").cast("decimal(6,4)"), F.lit("0.0200").cast("decimal(5,4)"), F.lit(True), F.col("trade_id") % 5 == 0).alias("fee"))


def _book_events(s, d):
    e = table(s, d, "events")
    price = F.floor(F.col("value") % 50).cast("double") / 100
    return e.select((F.col("user_id") % 8).alias("asset_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 97 < 8, "book").when(F.col("event_id") % 401 == 0, "gap").otherwise("delta").alias("kind"), F.when(F.col("event_id") % 2 == 0, "BID").otherwise("ASK").alias("side"),
        F.when(F.col("event_id") % 2 == 0, price).otherwise(price + 0.5).alias("price"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("size"), F.lit(None).cast("double").alias("best_bid"), F.lit(None).cast("double").alias("best_ask"))


_BOOK = "bk as (select user_id % 8 as asset_id, event_id as seq, case when event_id % 2 = 0 then 'BID' else 'ASK' end as side, case when event_id % 2 = 0 then floor(value % 50) / 100 else floor(value % 50) / 100 + 0.5 end as price, case when event_type = 'error' then 0.0::double else value end as size from events)"


def _features(s, d):
    return X.arrival_features(replay_orders(s, d), _trades(s, d), lookback=150, bucket=BUCKET)


def _regimes(s, d):
    o = table(s, d, "orders")
    rows = o.select(C.ladder(F.col("o_totalprice"), [(100000.0, "small"), (250000.0, "medium")], "large").alias("size"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "yyyy").alias("year"))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("bucket")) for c in rows.columns])).alias("r")).select("r.*")
    return long.groupBy("dimension", "bucket").agg(F.count("*").alias("n")).withColumn("ready", F.col("n") >= 2000)


#: The features of each order in SQL, as doubles.
FEATURES_SQL = f"""{_MET}, fg as (select o.order_index, count(*) as n_pre, count(*) filter (where trade_side = side) as n_same, cast(sum(trade_size) as double) as volume_pre, cast(sum(trade_size) filter (where trade_side = side) as double) as volume_same, cast(max_by(trade_price, (block, trade_id)) as double) as last_price,
    cast(max_by(trade_price, (block, trade_id)) filter (where trade_side = 'BUY') as double) as last_buy, cast(max_by(trade_price, (block, trade_id)) filter (where trade_side = 'SELL') as double) as last_sell, max(block) as lb from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival - 150 and arrival - 1 group by 1),
    ft as (select o.order_index, o.side, cast(o.size as double) as size, coalesce(n_pre, 0) as n_pre, coalesce(n_same, 0) as n_same, volume_pre, volume_same, last_price, last_buy, last_sell, arrival - lb as age from ords o left join fg on fg.order_index = o.order_index)"""
SYNTHETIC_SQL = """sy as (select *, coalesce((last_buy + last_sell) / 2, last_price) as mid, coalesce(abs(last_buy - last_sell), 0.01::double) as spread, volume_same * 0.025::double as rate, least(1.0::double, size / greatest(1e-9::double, volume_pre)) as share from ft),
    sa as (select order_index, case when n_pre >= 2 then greatest(0.0::double, least(1.0::double, mid + case when side = 'BUY' then 1 else -1 end * (spread / 2 + greatest(1.0::double, 100 * share * share) * 0.01::double))) end as expected_price,
        case when n_pre >= 2 then least(size, 0.5::double * coalesce(rate, 0.0::double)) end as q10, case when n_pre >= 2 then least(size, 1.0::double * coalesce(rate, 0.0::double)) end as q50, case when n_pre >= 2 then least(size, 2.0::double * coalesce(rate, 0.0::double)) end as q90, case when n_pre < 2 then 'MODEL_DOMAIN_ABSTAIN' end as abstained from sy)"""

PLANS = {
    "ledger_running": plan(lambda s, d: L.running(_cash(s, d), ["account"], ["seq"], ["cash"]).select("account", "seq", "cash", "cash_balance"), f"with {_ENT} select account, seq, cash, cast(sum(cash) over (partition by account order by seq rows unbounded preceding) as decimal(38,10)) as cash_balance from cf", "cash cash_balance"),
    "cashflow_summary": plan(lambda s, d: _cash(s, d).groupBy("account").pivot("kind", ["BUY", "SELL", "REDEEM", "REBATE", "SPLIT"]).agg(F.sum("cash").cast("decimal(38,10)")), f"with {_ENT} select account, " + ", ".join(f"cast(sum(cash) filter (where kind = '{k}') as decimal(38,10)) as \"{k}\"" for k in ("BUY", "SELL", "REDEEM", "REBATE", "SPLIT")) + " from cf group by 1", "BUY SELL REDEEM REBATE SPLIT"),
    "settlement_classes": plan(lambda s, d: _settled(s, d), f"with {_SETTLED} select * from se"),
    "position_finalisation": plan(
        _positions,
        f"""with {_SETTLED}, h as (select l_orderkey, sum(l_quantity) as shares from lineitem group by 1), p as (select kind, shares, shares * case kind when 'settled_yes' then 1.0::double when 'cancelled_half_refund' then 0.5::double else 0.0::double end as low,
            shares * case kind when 'settled_yes' then 1.0::double when 'cancelled_half_refund' then 0.5::double when 'settled_no' then 0.0::double when null then 0.0::double else 1.0::double end as high from h left join se on l_orderkey = o_orderkey)
            select kind, count(*) as positions, sum(shares) as shares, sum(low) as low, sum(high) as high from p group by 1""",
    ),
    "max_concurrent": plan(
        lambda s, d: L.concurrent(replay_orders(s, d).select("asset_id", "arrival", "deadline", F.lit(1).cast("long").alias("one")), ["asset_id"], "arrival", "deadline", "one").select("asset_id", "max_open"),
        f"with {_MET.split(', tr as')[0]}, e as (select asset_id, arrival as x, 1 as k, 1 as v from ords union all select asset_id, deadline, 0, -1 from ords), n as (select asset_id, x, k, sum(v) as v from e group by 1, 2, 3), c as (select asset_id, sum(v) over (partition by asset_id order by x, k rows unbounded preceding) as o from n) select asset_id, cast(max(o) as bigint) as max_open from c group by 1",
    ),
    "trade_fees": plan(
        _fees,
        f"with {TAPE} select trade_id, case when trade_id % 5 = 0 then cast(0 as decimal(18,5)) else cast(floor(cast(cast(size as decimal(16,2)) * cast(0.02 as decimal(5,4)) as double) * cast(cast(cast(price as decimal(6,4)) as decimal(11,10)) * cast(1 - cast(cast(price as decimal(6,4)) as decimal(11,10)) as decimal(11,10)) as double) * 100000 + 1e-7) * 0.00001 as decimal(18,5)) end as fee from tape", "fee",
    ),
    "threshold_strategy": plan(lambda s, d: L.threshold_strategy(tape(s, d).select("asset_id", F.col("block").alias("seq"), "price"), ["asset_id"], entry=0.2, exit_=0.05, stop=0.15, target=0.2, max_bars=20), None),
    "reliability_bins": plan(lambda s, d: L.reliability(_scored(s, d), "score", "quality", 10, ["doc_id"]), f"with {_SCORED}, b as (select *, cast(ntile(10) over (order by score, doc_id) as integer) as bin from sc) select bin, count(*) as n, cast(sum(quality) as bigint) as hits, cast(sum(score) as decimal(38,8)) as score_sum from b group by 1", "score_sum"),
    "confusion_wilson": plan(
        lambda s, d: L.confusion(_scored(s, d), F.col("score") > 0.1, F.col("quality") == 1).select("tp", "fp", "fn", "tn", *[F.col(c).cast("decimal(12,9)").alias(c) for c in ("precision", "precision_low", "precision_high", "recall", "recall_low", "recall_high")]),
        f"""with {_SCORED}, c as (select count(*) filter (where score > 0.1 and quality = 1) as tp, count(*) filter (where score > 0.1 and quality = 0) as fp, count(*) filter (where score <= 0.1 and quality = 1) as fn, count(*) filter (where score <= 0.1 and quality = 0) as tn from sc),
            k as (select *, 1.959963984540054::double as z, tp::double / (tp + fp) as p, (tp + fp)::double as m, tp::double / (tp + fn) as r, (tp + fn)::double as n from c)
            select tp, fp, fn, tn, cast(p as decimal(12,9)) as precision, cast((p + z*z/(2*m)) / (1 + z*z/m) - z * sqrt(p*(1-p)/m + z*z/(4*m*m)) / (1 + z*z/m) as decimal(12,9)) as precision_low, cast((p + z*z/(2*m)) / (1 + z*z/m) + z * sqrt(p*(1-p)/m + z*z/(4*m*m)) / (1 + z*z/m) as decimal(12,9)) as precision_high,
            cast(r as decimal(12,9)) as recall, cast((r + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(r*(1-r)/n + z*z/(4*n*n)) / (1 + z*z/n) as decimal(12,9)) as recall_low, cast((r + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(r*(1-r)/n + z*z/(4*n*n)) / (1 + z*z/n) as decimal(12,9)) as recall_high from k""",
        "precision precision_low precision_high recall recall_low recall_high",
    ),
    "auc_rank": plan(
        lambda s, d: L.auc(_scored(s, d), "score", "quality"),
        f"with {_SCORED}, r as (select quality, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as rk from sc), g as (select count(*) filter (where quality = 1) as p, count(*) filter (where quality = 0) as n, sum(rk) filter (where quality = 1) as s from r) select p as positives, n as negatives, (s - p * (p + 1) / 2.0::double) / (p * n) as auc from g",
    ),
    "brier": plan(
        lambda s, d: _scored(s, d).agg(F.count("*").alias("n"), F.sum(((F.col("score") - F.col("quality")) * (F.col("score") - F.col("quality"))).cast("decimal(20,16)")).cast("decimal(38,16)").alias("brier_sum"), F.sum(F.col("quality").cast("long")).alias("hits")),
        f"with {_SCORED} select count(*) as n, cast(sum(cast((cast(score as decimal(12,8)) - quality) * (cast(score as decimal(12,8)) - quality) as decimal(20,16))) as decimal(38,16)) as brier_sum, cast(sum(quality) as bigint) as hits from sc", "brier_sum",
    ),
    "probability_buckets": plan(lambda s, d: _scored(s, d).groupBy(F.floor(F.col("score") * 20).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.sum("quality").alias("hits")), f"with {_SCORED} select cast(floor(score * 20) as integer) as bucket, count(*) as n, cast(sum(quality) as bigint) as hits from sc group by 1"),
    "full_outer_calibration": plan(
        lambda s, d: (lambda p, a: p.join(a, p.o_orderkey == a.l_orderkey, "full_outer").select(F.coalesce("o_orderkey", "l_orderkey").alias("order_id"), F.coalesce("predicted", F.lit(0).cast("long")).alias("predicted"), F.coalesce("actual", F.lit(0.0)).alias("actual"), F.when(F.col("l_orderkey").isNull(), "missed").when(F.col("o_orderkey").isNull(), "unexpected").otherwise("matched").alias("verdict")))(
            table(s, d, "orders").where("o_orderkey % 4 <> 0").select("o_orderkey", (F.col("o_custkey") % 50).alias("predicted")), table(s, d, "lineitem").where("l_orderkey % 3 <> 0").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("actual"))
        ),
        "with p as (select o_orderkey, o_custkey % 50 as predicted from orders where o_orderkey % 4 <> 0), a as (select l_orderkey, sum(l_quantity) as actual from lineitem where l_orderkey % 3 <> 0 group by 1) select coalesce(o_orderkey, l_orderkey) as order_id, coalesce(predicted, 0) as predicted, coalesce(actual, 0.0) as actual, case when l_orderkey is null then 'missed' when o_orderkey is null then 'unexpected' else 'matched' end as verdict from p full join a on o_orderkey = l_orderkey",
    ),
    "regime_coverage": plan(
        _regimes,
        "with r as (select case when o_totalprice < 100000 then 'small' when o_totalprice < 250000 then 'medium' else 'large' end as size, o_orderpriority as priority, strftime(o_orderdate, '%Y') as year from orders), l as (select 'size' as dimension, size as bucket from r union all select 'priority', priority from r union all select 'year', year from r) select dimension, bucket, count(*) as n, count(*) >= 2000 as ready from l group by 1, 2",
    ),
    "walk_forward": near(
        lambda s, d: L.walk_forward(table(s, d, "events").select((F.col("user_id") % 6).alias("cell"), "event_id", F.col("event_id").alias("signal"), (F.col("event_id") + 40).alias("available"), (F.col("event_type") == "purchase").cast("int").alias("won"), F.lit(0.2).alias("price")), ["cell"], "signal", "available", "won", "price", 20.0, 1.0, 0.005).select("event_id", "n_known", "net_edge"),
        """with r as (select user_id % 6 as cell, event_id as signal, event_id + 40 as available, case when event_type = 'purchase' then 1.0::double else 0.0::double end - 0.2::double as edge from events),
           u as (select cell, available as known_at, 1 as learned, edge, null as id from r union all select cell, signal, 0, null, signal from r), w as (select *, count(edge) over x as n_known, coalesce(sum(edge) over x, 0.0::double) as e from u window x as (partition by cell order by known_at, learned rows unbounded preceding)),
           p as (select id as event_id, n_known, 0.2::double + e / (n_known + 20.0::double) as q from w where learned = 0) select event_id, n_known, q - 1.0::double * sqrt(q * (1 - q) / (n_known + 20.0::double + 1)) - 0.2::double - 0.005::double as net_edge from p""", "net_edge"),
    "arrival_features": plan(
        lambda s, d: _features(s, d).select("order_index", "n_pre", "n_same", "volume_pre", "last_price", "last_buy", "last_sell", "high_pre", "low_pre", "age"),
        f"""with {_MET}, g as (select o.order_index, count(*) as n_pre, count(*) filter (where trade_side = side) as n_same, cast(sum(trade_size) as decimal(38,10)) as volume_pre, max_by(trade_price, (block, trade_id)) as last_price, max_by(trade_price, (block, trade_id)) filter (where trade_side = 'BUY') as last_buy,
            max_by(trade_price, (block, trade_id)) filter (where trade_side = 'SELL') as last_sell, max(trade_price) as high_pre, min(trade_price) as low_pre, max(block) as lb from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival - 150 and arrival - 1 group by 1)
            select o.order_index, coalesce(n_pre, 0) as n_pre, coalesce(n_same, 0) as n_same, volume_pre, last_price, last_buy, last_sell, high_pre, low_pre, arrival - lb as age from ords o left join g on g.order_index = o.order_index""",
        "volume_pre last_price last_buy last_sell high_pre low_pre",
    ),
    "fill_labels": plan(
        lambda s, d: X.fill_label(replay_orders(s, d), _trades(s, d), bucket=BUCKET),
        f"with {_MET}, g as (select o.order_index, cast(sum(trade_size) as decimal(38,10)) as v from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival and deadline and trade_side = side group by 1) select o.order_index, coalesce(v, 0) as future_volume, case when v is null then 0 else 1 end as label from ords o left join g on g.order_index = o.order_index",
        "future_volume",
    ),
    "fill_probability": near(
        lambda s, d: X.probability(_features(s, d), {"n_pre": (0.8, 5.0, 4.0), "n_same": (0.4, 2.0, 2.0), "age": (-0.3, 40.0, 40.0)}, -0.2, [(0.0, 0.05), (0.3, 0.2), (0.7, 0.8), (1.0, 0.95)]).select("order_index", "raw_probability", "probability"),
        f"""with {FEATURES_SQL}, z as (select order_index, 1 / (1 + exp(-(-0.2::double + 0.8::double * (n_pre - 5.0::double) / 4.0::double + 0.4::double * (n_same - 2.0::double) / 2.0::double - 0.3::double * (coalesce(age, 40)::double - 40.0::double) / 40.0::double))) as raw_probability from ft)
            select order_index, raw_probability, case when raw_probability >= 0.7 then 0.8::double + (raw_probability - 0.7::double) * 0.5::double when raw_probability >= 0.3 then 0.2::double + (raw_probability - 0.3::double) * 1.5::double else 0.05::double + raw_probability * 0.5::double end as probability from z""",
        "raw_probability probability"),
    "hierarchical_prior": near(
        lambda s, d: X.hierarchical_prior(table(s, d, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 7).alias("cell"), (F.col("o_orderstatus") == "F").cast("int").alias("hit")), ["category", "cell"], "hit", 25.0),
        """with o as (select o_orderpriority as category, o_custkey % 7 as cell, case when o_orderstatus = 'F' then 1 else 0 end as hit from orders), r0 as (select count(*) as n, cast(sum(hit) as bigint) as hits, sum(hit)::double / count(*) as rate from o),
           r1 as (select category, count(*) as n, cast(sum(hit) as bigint) as hits, (sum(hit) + 25.0::double * (select rate from r0)) / (count(*) + 25.0::double) as rate from o group by 1),
           r2 as (select o.category, cell, count(*) as n, cast(sum(hit) as bigint) as hits, (sum(hit) + 25.0::double * max(r1.rate)) / (count(*) + 25.0::double) as rate from o join r1 on r1.category = o.category group by 1, 2)
           select null as category, null as cell, 0 as depth, n, hits, rate from r0 union all select category, null, 1, n, hits, rate from r1 union all select category, cell, 2, n, hits, rate from r2""", "rate"),
    "synthetic_arrival": near(lambda s, d: X.synthetic_arrival(_features(s, d), participation=0.025, tick=0.01), f"with {FEATURES_SQL}, {SYNTHETIC_SQL} select * from sa", "expected_price q10 q50 q90"),
    "lob_validity": near(
        lambda s, d: X.lob_validity(_features(s, d), trades=5.0, volume=200.0, age=30.0),
        f"""with {FEATURES_SQL}, v as (select order_index, least(1.0::double, n_pre / 5.0::double, coalesce(volume_pre, 0.0::double) / 200.0::double, coalesce(least(1.0::double, 30.0::double / greatest(1.0::double, age::double)), 0.0::double)) as score from ft)
            select order_index, score, case when score >= 0.8::double then 'eligible' when score >= 0.4::double then 'review' else 'ineligible' end as tier from v""", "score"),
    "strata_lookup": near(
        lambda s, d: X.strata_lookup(table(s, d, "part").select("p_partkey", "p_brand", "p_type"), table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.avg(F.col("p_size").cast("double")).alias("value")), ["p_brand", "p_type"], "value", 12),
        """with t as (select p_brand, p_type, count(*) as n, avg(p_size::double) as v from part group by 1, 2), l1 as (select p_brand, sum(n) as n, sum(n * v) / sum(n) as v from t group by 1 having sum(n) >= 12), l0 as (select sum(n * v) / sum(n) as v from t having sum(n) >= 12)
           select p.p_partkey, p.p_brand, p.p_type, coalesce(t.v, l1.v, l0.v) as estimate, case when t.v is not null then 2 when l1.v is not null then 1 when l0.v is not null then 0 end as depth
           from part p left join (select * from t where n >= 12) t on t.p_brand = p.p_brand and t.p_type = p.p_type left join l1 on l1.p_brand = p.p_brand left join l0 on true""", "estimate"),
    "execution_router": near(
        lambda s, d: X.routed(replay_orders(s, d), X.fill_label(replay_orders(s, d), _trades(s, d), bucket=BUCKET).where("label = 1").select("order_index", F.col("future_volume").cast("double").alias("filled")), X.synthetic_arrival(_features(s, d), participation=0.025, tick=0.01).where("abstained is null").select("order_index", F.col("q50").alias("filled"))),
        f"""with {FEATURES_SQL}, {SYNTHETIC_SQL}, c as (select o.order_index, cast(sum(trade_size) as double) as c from ords o join tr on tr.market_id = o.market_id and tr.asset_id = o.asset_id and block between arrival and deadline and trade_side = side group by 1)
            select o.order_index, coalesce(c, q50, 0.0::double) as filled, case when c is not null then 'SOURCE' when q50 is not null then 'MODEL' else 'NONE' end as route, coalesce(c, 0.0::double) as lower, greatest(coalesce(c, 0.0::double), coalesce(q50, 0.0::double)) as upper
            from ords o left join c on c.order_index = o.order_index left join sa on sa.order_index = o.order_index""", "filled lower upper"),
    "book_reconstruction": plan(lambda s, d: B.reconstruct(_book_events(s, d)), None),
    "book_latest_levels": plan(lambda s, d: B.latest_levels(_book_events(s, d)), f"with {_BOOK}, k as (select asset_id, side, price, max_by(size, seq) as size from bk group by 1, 2, 3) select * from k where size > 0"),
    "book_fused": plan(
        lambda s, d: B.fused_levels(table(s, d, "lineitem").select((F.col("l_partkey") % 20).alias("condition_id"), F.when(F.col("l_linenumber") % 2 == 0, "YES").otherwise("NO").alias("outcome"), F.when(F.col("l_returnflag") == "A", "BID").otherwise("ASK").alias("side"), ((F.col("l_partkey") % 99 + 1).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(N.PRICE).alias("price"), F.col("l_quantity").alias("size"))),
        """with l as (select l_partkey % 20 as condition_id, case when l_linenumber % 2 = 0 then 'YES' else 'NO' end as outcome, case when l_returnflag = 'A' then 'BID' else 'ASK' end as side, cast(cast(l_partkey % 99 + 1 as decimal(5,0)) * cast(0.01 as decimal(3,2)) as decimal(11,10)) as price, l_quantity as size from lineitem),
           m as (select condition_id, case when outcome = 'YES' then side when side = 'BID' then 'ASK' else 'BID' end as side, cast(case when outcome = 'YES' then price else 1 - price end as decimal(11,10)) as price, outcome, size from l), p as (select condition_id, side, price, outcome, sum(size) as size from m group by 1, 2, 3, 4)
           select condition_id, side, price, max(size) as size, count(*) as sources from p group by 1, 2, 3""",
        "price",
    ),
    "maker_fifo": plan(lambda s, d: B.maker_queue(replay_orders(s, d).select("order_index", "asset_id", "side", F.lit(1).alias("price"), "arrival", "deadline", F.col("queue_ahead").cast("double"), F.col("size").cast("double")), _trades(s, d).select("asset_id", F.when(F.col("side") == "BUY", "SELL").otherwise("BUY").alias("side"), F.lit(1).alias("price"), F.col("block").alias("x"), F.col("trade_id").alias("flow_id"), F.col("size").cast("double"), F.lit(0.5).alias("cancel"))), None),
    "capital_lock": plan(
        lambda s, d: table(s, d, "events").withColumn("next_at", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next_at is not null").groupBy("event_type").agg(F.sum(F.unix_micros(F.col("next_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("locked_micros"), F.count("*").alias("phases")),
        "with n as (select *, lead(ts) over (partition by user_id order by ts, event_id) as nx from events) select event_type, cast(sum(date_diff('microsecond', ts, nx)) as bigint) as locked_micros, count(*) as phases from n where nx is not null group by 1",
    ),
    "bootstrap_interval": plan(lambda s, d: L.cluster_bootstrap(table(s, d, "events").select((F.col("user_id") % 40).alias("c"), F.col("value")), "c", "value", 200, 7), None),
    "reward_decomposition": plan(
        lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("decimal(38,2)").alias("gross"), F.sum((F.col("l_extendedprice").cast("decimal(14,2)") * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(20,4)")).cast("decimal(38,4)").alias("rebate"), F.count("*").alias("rows")),
        "select l_returnflag, l_linestatus, cast(sum(cast(l_extendedprice as decimal(14,2))) as decimal(38,2)) as gross, cast(sum(cast(cast(l_extendedprice as decimal(14,2)) * cast(l_discount as decimal(4,2)) as decimal(20,4))) as decimal(38,4)) as rebate, count(*) as rows from lineitem group by 1, 2", "gross rebate",
    ),
    "profile_matrix": plan(
        lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).count(),
        "select o_orderstatus, nullif(count(*) filter (where o_orderpriority = '1-URGENT'), 0) as \"1-URGENT\", nullif(count(*) filter (where o_orderpriority = '2-HIGH'), 0) as \"2-HIGH\", nullif(count(*) filter (where o_orderpriority = '3-MEDIUM'), 0) as \"3-MEDIUM\" from orders group by 1",
    ),
    "verdict_report": plan(
        lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count_if(F.col("o_totalprice") > 400000).alias("large")).select("o_orderpriority", "n", F.when((F.col("filled") * 3 < F.col("n")), "REVIEW").otherwise("READY").alias("verdict"), F.concat_ws("; ", F.when(F.col("filled") * 3 < F.col("n"), "few filled"), F.when(F.col("large") > 100, "large orders")).alias("reasons")),
        "with g as (select o_orderpriority, count(*) as n, count(*) filter (where o_orderstatus = 'F') as filled, count(*) filter (where o_totalprice > 400000) as large from orders group by 1) select o_orderpriority, n, case when filled * 3 < n then 'REVIEW' else 'READY' end as verdict, concat_ws('; ', case when filled * 3 < n then 'few filled' end, case when large > 100 then 'large orders' end) as reasons from g",
    ),
    "parameter_plan": plan(
        lambda s, d: table(s, d, "region").select("r_regionkey", F.explode(F.array(F.lit("chain"), F.lit("l2"))).alias("evidence")).select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step")).withColumn("plan_id", F.sha2(F.concat_ws("|", "r_regionkey", "evidence", "step"), 256)),
        "select r_regionkey, evidence, cast(step as integer) as step, sha256(r_regionkey || '|' || evidence || '|' || step) as plan_id from region cross join (select unnest(['chain', 'l2']) as evidence) cross join (select unnest(range(1, 5)) as step)",
    ),
}
