"""Run metrics, fill quality, probability quality, checkpoints, alignment and artefact reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import metrics as M
from ..operators import replay as R
from .adapters import near, plan, replay_orders, table
from .replay_plans import _RESULTS, _private


def _runs(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 25).alias("run"), "event_id", (F.col("value") - 40).cast("decimal(12,2)").alias("pnl"))
    return M.run_metrics(e, ["run"], ["event_id"], "pnl")


RUNS_SQL = """with e as (select user_id % 25 as run, event_id, cast(cast(value - 40 as decimal(12,2)) as decimal(18,4)) as v from events), q as (select *, cast(sum(v) over w as decimal(28,4)) as eq, cast(sign(v) as integer) as sd from e window w as (partition by run order by event_id rows unbounded preceding)),
    p as (select *, greatest(0, max(eq) over (partition by run order by event_id rows unbounded preceding)) as pk, case when sd = lag(sd) over (partition by run order by event_id) then 0 else 1 end as nw from q), t as (select *, sum(nw) over (partition by run order by event_id rows unbounded preceding) as st from p),
    r as (select *, row_number() over (partition by run, st order by event_id) as nth from t),
    g as (select run, count(*) as trades, count(*) filter (where v > 0) as wins, count(*) filter (where v < 0) as losses, count(*) filter (where v = 0) as flat, sum(v)::double as net, coalesce(sum(v) filter (where v > 0), 0)::double as gross_profit, coalesce(-sum(v) filter (where v < 0), 0)::double as gross_loss, max(v)::double as best, min(v)::double as worst,
        sum(cast(v * v as decimal(28,8)))::double as sq, coalesce(sum(cast(v * v as decimal(28,8))) filter (where v < 0), 0)::double as dn, max(pk - eq)::double as max_drawdown, max(pk)::double as peak, cast(coalesce(max(nth) filter (where v > 0), 0) as integer) as win_streak, cast(coalesce(max(nth) filter (where v < 0), 0) as integer) as loss_streak,
        count(*) filter (where pk > eq) as trades_under_water from r group by 1),
    m as (select *, net / trades as mean, case when trades > 1 then sqrt(greatest(0.0::double, (sq - net * (net / trades)) / (trades - 1))) end as deviation, sqrt(dn / trades) as downside from g)
    select * exclude (sq, dn), wins::double / trades as win_rate, losses::double / trades as loss_rate, case when deviation <> 0 then mean / deviation end as sharpe, case when downside <> 0 then mean / downside end as sortino, case when gross_loss <> 0 then gross_profit / gross_loss end as profit_factor, case when wins <> 0 then gross_profit / wins end as average_win,
        case when losses <> 0 then gross_loss / losses end as average_loss, case when wins * gross_loss <> 0 then gross_profit * losses / (wins * gross_loss) end as payoff, mean as expectancy, case when max_drawdown <> 0 then net / max_drawdown end as recovery, trades_under_water::double / trades as under_water, best - worst as range from m"""
RUN_DOUBLES = "win_rate loss_rate mean deviation downside sharpe sortino profit_factor average_win average_loss payoff expectancy recovery under_water range"
EXACT = ["net", "gross_profit", "gross_loss", "best", "worst", "max_drawdown", "peak"]


def _fill_quality(s, d):
    return M.fill_quality(R.results(replay_orders(s, d), _private(s, d)), _private(s, d), ["tif", "side"])


FILL_SQL = f"""with {_RESULTS}, pf as (select order_index, cast(sum(cast(case when side = 'BUY' then limit_price - exec_price else exec_price - limit_price end * cast(qty as decimal(26,10)) as decimal(38,10))) as decimal(38,10)) as gain, min(block) as fb, max(block) as lb from fills group by 1),
    j as (select st.*, o.side, o.arrival, gain, fb, lb from st join ords o on o.order_index = st.order_index left join pf on pf.order_index = st.order_index),
    fq as (select tif, side, count(*) as orders, count(*) filter (where filled >= size) as whole, count(*) filter (where filled > 0 and filled < size) as partial, count(*) filter (where filled <= 0) as unfilled, cast(sum(size) as double) as requested, cast(sum(filled) as double) as filled, cast(coalesce(sum(gain), 0) as double) as improvement,
        cast(coalesce(sum(fb - arrival), 0) as bigint) as wait_blocks, cast(coalesce(max(lb - fb), 0) as bigint) as longest_fill, cast(coalesce(sum(n_fills), 0) as bigint) as fills from j group by 1, 2)
    select *, filled / requested as fill_rate, case when filled / requested >= 0.8 then 'good' when filled / requested >= 0.3 then 'fair' else 'poor' end as verdict from fq"""


def _doubles(names):
    return lambda df: df.withColumns({n: F.col(n).cast("double") for n in names})


def _quality(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 12).alias("regime"), (F.col("value") / (F.col("value") + 30)).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return M.probability_quality(e, ["regime"], "p", "y")


QUALITY_SQL = """with e as (select user_id % 12 as regime, value / (value + 30) as p, case when event_type = 'purchase' then 1 else 0 end as y from events), q as (select *, greatest(1e-6::double, least(1 - 1e-6::double, p)) as c from e),
    g as (select regime, count(*) as n, cast(sum(y) as bigint) as hits, avg((p - y) * (p - y)) as brier, avg(-(y * ln(c) + (1 - y) * ln(1 - c))) as log_loss from q group by 1), b as (select *, hits::double / n as base_rate from g),
    f as (select *, base_rate * (1 - base_rate) as base_brier, -(base_rate * ln(greatest(1e-6::double, least(1 - 1e-6::double, base_rate))) + (1 - base_rate) * ln(1 - greatest(1e-6::double, least(1 - 1e-6::double, base_rate)))) as base_log_loss from b)
    select *, case when base_brier > 0 then 1 - brier / base_brier end as brier_skill, case when base_log_loss > 0 then 1 - log_loss / base_log_loss end as log_skill, brier - base_brier as brier_regret, log_loss - base_log_loss as log_regret from f"""


def _levels(s, d):
    return table(s, d, "events").select((F.col("user_id") % 20).alias("asset_id"), F.when(F.col("event_id") % 2 == 0, "BID").otherwise("ASK").alias("side"), (F.floor("value") % 40).cast("int").alias("tick"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("size"))


def _checkpointed(s, d):
    keys, e = ["asset_id", "side", "tick"], _levels(s, d)
    return M.book_from(M.checkpoint(e, keys, 600), e, keys, 600, 950)


def _aligned(s, d):
    e = table(s, d, "events").select("event_id", (F.col("user_id") % 30).alias("asset_id"), F.col("event_id").alias("x"), (F.floor("value") % 50).cast("int").alias("price"), "event_type")
    books = e.where("event_type <> 'purchase'").select("asset_id", "x", F.col("price").alias("bid"), (F.col("price") + 8).alias("ask"))
    got = M.alignment(e.where("event_type = 'purchase'").select("event_id", "asset_id", "x", "price"), books, ["asset_id"], "x", 25)
    return got.select("event_id", "alignment")


def _artefacts(s, d):
    """The newest artefact of each run and kind, the newest five runs of each market."""
    o = table(s, d, "orders").select((F.col("o_custkey") % 30).alias("market"), (F.col("o_custkey") % 900).alias("run"), F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("body"))
    newest = o.groupBy("market", "run", "kind").agg(F.max(F.struct("version", "body")).alias("a")).select("market", "run", "kind", "a.version", "a.body")
    runs = X.ranked(newest.groupBy("market", "run").agg(F.max("version").alias("last")), ["market"], [F.desc("last")]).where("place <= 5").select("market", "run", "place")
    return newest.join(runs, ["market", "run"])


PLANS = {
    "run_metrics": near(lambda s, d: _doubles(EXACT)(_runs(s, d)), RUNS_SQL, RUN_DOUBLES),
    "fill_quality": near(lambda s, d: _doubles(["requested", "filled", "improvement"])(_fill_quality(s, d)), FILL_SQL, "fill_rate"),
    "probability_quality": near(_quality, QUALITY_SQL, "brier log_loss base_rate base_brier base_log_loss brier_skill log_skill brier_regret log_regret"),
    "book_checkpoint": plan(
        _checkpointed,
        "with l as (select user_id % 20 as asset_id, case when event_id % 2 = 0 then 'BID' else 'ASK' end as side, cast(floor(value) % 40 as integer) as tick, event_id, case when event_type = 'error' then 0.0::double else value end as size from events where event_id <= 950), g as (select asset_id, side, tick, max_by(size, event_id) as size from l group by 1, 2, 3) select * from g where size > 0",
    ),
    "raw_alignment": plan(
        _aligned,
        """with e as (select event_id, user_id % 30 as a, cast(floor(value) % 50 as integer) as p, event_type from events), b as (select a, event_id as x, p from e where event_type <> 'purchase'), f as (select event_id, a, p from e where event_type = 'purchase'), m as (select f.*, b.x, b.p as bid from f asof left join b on f.a = b.a and f.event_id > b.x)
           select event_id, case when bid is null then 'no_book' when event_id - x > 25 then 'stale_book' when p > bid + 8 or p < bid then 'through' when p = bid or p = bid + 8 then 'at_quote' else 'inside' end as alignment from m""",
    ),
    "artefact_reads": plan(
        _artefacts,
        """with n as (select o_custkey % 30 as market, o_custkey % 900 as run, o_orderpriority as kind, max(o_orderkey) as version, max_by(o_totalprice, o_orderkey) as body from orders group by 1, 2, 3), r as (select market, run, cast(row_number() over (partition by market order by max(version) desc) as integer) as place from n group by 1, 2)
           select n.market, n.run, kind, version, body, place from n join r on r.market = n.market and r.run = n.run where place <= 5""",
    ),
}
