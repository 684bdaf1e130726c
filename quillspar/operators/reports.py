"""Audits, calibrations and gates: reports over orders, costs, evidence and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.classify import first_match

WIDE = "decimal(38,10)"
CALIBRATED = ("FILLED", "PARTIAL_FILLED")


class TooManyRows(ValueError):
    """A result would not be whole."""


def whole(df: DataFrame, limit: int) -> DataFrame:
    """``df`` if it has at most ``limit`` rows, else an error: never a part of it. One row beyond the limit settles it."""
    if df.limit(limit + 1).count() > limit:
        raise TooManyRows(f"more than {limit} rows")
    return df


def nought() -> Column:
    return F.lit(0).cast(WIDE)


def cost_samples(ledger: DataFrame, events: DataFrame, keys: Sequence[str] = ("event_type", "order_id", "trade_id")) -> DataFrame:
    """Simulated against real costs of each key, with a verdict: both sides are summed, then met by a full join in which nulls are equal."""
    total = lambda df, name: df.groupBy(*keys).agg(F.sum("amount").cast(WIDE).alias(f"{name}_amount"), F.count("*").alias(f"{name}_count"))
    left, right = total(ledger, "simulated").alias("l"), total(events, "live").alias("r")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    none = F.lit(0).cast("long")
    rows = left.join(right, on, "full").select(
        *[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys], F.coalesce("simulated_amount", nought()).alias("simulated_amount"), F.coalesce("live_amount", nought()).alias("live_amount"),
        F.coalesce("simulated_count", none).alias("simulated_count"), F.coalesce("live_count", none).alias("live_count"),
    )
    error = F.abs(F.col("simulated_amount") - F.col("live_amount")).cast(WIDE)
    verdict = first_match([(F.col("simulated_count") == 0, "missing_simulated"), (F.col("live_count") == 0, "missing_live"), (error == 0, "matched")], "amount_mismatch")
    return rows.withColumn("amount_error", error).withColumn("verdict", verdict)


def cost_report(samples: DataFrame) -> DataFrame:
    """Totals, errors and verdicts of each event type."""
    of = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return samples.groupBy("event_type").agg(
        F.count("*").alias("samples"), *[F.sum(c).cast(WIDE).alias(c) for c in ("simulated_amount", "live_amount", "amount_error")], *[of(v) for v in ("matched", "amount_mismatch", "missing_live", "missing_simulated")]
    ).withColumn("requires_recalibration", (F.col("amount_error") > 0) | (F.col("missing_live") > 0) | (F.col("missing_simulated") > 0))


def outcome_coverage(members: DataFrame, prices: DataFrame) -> DataFrame:
    """Of each event: outcomes, those with a YES, a NO and both prices, and the share with a YES price in percent."""
    sides = prices.groupBy("outcome_id").agg(F.max(F.when(F.col("side") == "YES", F.col("price"))).alias("yes"), F.max(F.when(F.col("side") == "NO", F.col("price"))).alias("no"))
    rows = members.join(sides, "outcome_id", "left")
    return rows.groupBy("event_id").agg(
        F.count("*").alias("outcomes"), F.count("yes").alias("priced_yes"), F.count("no").alias("priced_no"), F.count_if(F.col("yes").isNotNull() & F.col("no").isNotNull()).alias("priced_pairs"), (F.count("yes") * 100.0 / F.count("*")).alias("coverage_pct")
    )


def label_readiness(labels: DataFrame, events: DataFrame, *, min_labels: int = 200, min_positive: int = 20, min_negative: int = 20) -> DataFrame:
    """One row: labelled, filled and unfilled orders, the events there are of them, and whether that is enough to train on."""
    state = F.upper(F.coalesce("live_status", F.lit("")))
    counts = labels.agg(F.count("*").alias("total"), F.count("live_status").alias("labeled"), F.count_if(state.isin(*CALIBRATED)).alias("positive"), F.count_if(F.col("live_status").isNotNull() & ~state.isin(*CALIBRATED)).alias("negative"))
    seen = events.agg(F.count("*").alias("event_rows"), F.count_distinct(F.coalesce("external_order_id", "order_id")).alias("event_orders"))
    ready = (F.col("labeled") >= min_labels) & (F.col("positive") >= min_positive) & (F.col("negative") >= min_negative)
    return counts.crossJoin(seen).withColumn("status", F.when(ready, "READY").otherwise("BLOCKED_INSUFFICIENT_REAL_LABELS"))  # one row each


def missed_opportunity(orders: DataFrame, points: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """How far the price went on without an order that had no fill: the best price after it, and where.

    Points get the best price that is still to come by a window from the end; an
    order then meets only the first point after its own place, by an as-of join.
    """
    from .asof import asof

    after = Window.partitionBy(*keys).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, 0)
    seen = points.withColumns({"_high": F.max(F.struct(F.col("price"), -F.col(x))).over(after), "_low": F.min(F.struct(F.col("price"), F.col(x))).over(after)})
    seen = seen.select(*keys, x, F.col("_high.price").alias("_high_price"), (-F.col("_high.col2")).alias("_high_x"), F.col("_low.price").alias("_low_price"), F.col(f"_low.{x}").alias("_low_x"))
    open_ = orders.where(F.upper("status").isin("NO_FILL", "REJECTED", "EXPIRED", "UNFILLED") & (F.col("size") > 0))
    met = asof(open_, seen, list(keys), x, ["_high_price", "_high_x", "_low_price", "_low_x"], forward=True, strict=True)
    buy = F.col("side") == "BUY"
    best, move = F.when(buy, F.col("_high_price")).otherwise(F.col("_low_price")), F.when(buy, F.col("_high_price") - F.col("limit_price")).otherwise(F.col("limit_price") - F.col("_low_price"))
    move = F.greatest(F.lit(0).cast("decimal(12,10)"), move.cast("decimal(12,10)"))
    rows = met.where("_high_price is not null").withColumn("missed_move", move)
    return rows.select(
        "order_index", F.when(buy, "buy_no_fill_then_price_rose").otherwise("sell_no_fill_then_price_fell").alias("direction"), best.alias("reference_price"), F.when(buy, F.col("_high_x")).otherwise(F.col("_low_x")).alias("reference_x"),
        "missed_move", (F.col("missed_move") * F.col("size")).cast(WIDE).alias("missed_notional"),
    )


def relevance(rows: DataFrame, query: str, *, slug: str, title: str, weight: Sequence[Column], ties: Sequence[str]) -> DataFrame:
    """Rows with ``relevance``, ordered: the same slug, the same title, a slug or a title that has the text, the rest; heavier first, nulls last.

    Rows of one title and weight come in the order of ``ties``, a key of the rows.
    """
    text = query.strip().lower()
    s, t = F.lower(slug), F.lower(title)
    place = F.when(s == text, 0).when(t == text, 1).when(F.contains(s, F.lit(text)), 2).when(F.contains(t, F.lit(text)), 3).otherwise(9)
    return rows.withColumn("relevance", place).orderBy("relevance", *[w.desc_nulls_last() for w in weight], F.col(title).asc_nulls_last(), *[F.asc_nulls_last(c) for c in ties])


def calibration_samples(orders: DataFrame, events: DataFrame, *, include_open: bool = False) -> DataFrame:
    """Orders with the real states that came of them, by own or external id, each pair once; aliased fields are coalesced."""
    own = events.select(F.col("order_id").alias("_id"), "event_id", "status", "event_time", "fill_price", "price", "filled_size", "matched_size")
    other = events.where("external_order_id is not null").select(F.col("external_order_id").alias("_id"), "event_id", "status", "event_time", "fill_price", "price", "filled_size", "matched_size")
    ids = orders.select("order_id", F.explode(F.array_distinct(F.array_compact(F.array("order_id", "external_order_id")))).alias("_id"))
    pairs = ids.join(own.unionByName(other), "_id").drop("_id").dropDuplicates(["order_id", "event_id"])
    if not include_open:
        pairs = pairs.where(F.upper("status").isin("FILLED", "PARTIAL_FILLED", "CANCELLED", "REJECTED", "EXPIRED"))
    return pairs.join(orders.drop("external_order_id"), "order_id").select(
        "order_id", "event_id", "role", "simulated_status", "simulated_price", "simulated_size", F.upper("status").alias("live_status"), F.coalesce("fill_price", "price").alias("live_price"), F.coalesce("filled_size", "matched_size").alias("live_size"), "event_time"
    )


def shadow_report(samples: DataFrame) -> DataFrame:
    """Status errors and mean errors of price and size of each role."""
    filled = lambda c: F.col(c).isin(*CALIBRATED)
    wrong = filled("simulated_status") != filled("live_status")
    return samples.groupBy("role").agg(
        F.count("*").alias("samples"), F.count_if(wrong).alias("status_errors"), (F.count_if(wrong) * 100.0 / F.count("*")).alias("status_error_pct"),
        F.sum(F.abs(F.col("simulated_price") - F.col("live_price"))).cast(WIDE).alias("price_error"), F.sum(F.abs(F.col("simulated_size") - F.col("live_size"))).cast(WIDE).alias("size_error"),
    )


def triangulation(fill: DataFrame, cost: DataFrame, *, price_limit: str = "0.01") -> DataFrame:
    """One row: whether the fill model is suspect, and why, from the fill and the cost report."""
    f = fill.agg(F.coalesce(F.sum("samples"), F.lit(0).cast("long")).alias("fill_samples"), F.coalesce(F.sum("status_errors"), F.lit(0).cast("long")).alias("status_errors"), F.coalesce(F.sum("price_error"), nought()).alias("price_error"))
    c = cost.agg(F.coalesce(F.sum("samples"), F.lit(0).cast("long")).alias("cost_samples"), F.coalesce(F.max("requires_recalibration"), F.lit(False)).alias("recalibrate"))
    row = f.crossJoin(c)  # one row each
    # error sum over samples, compared without a division
    far = F.col("price_error") > F.lit(price_limit).cast("decimal(3,2)") * F.col("fill_samples").cast("decimal(18,0)")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("fill_samples") == 0, "no fill calibration samples"), F.when(F.col("cost_samples") == 0, "no cost calibration samples"), F.when(F.col("status_errors") > 0, "status errors"), F.when(far, "price error"),
            F.when(F.col("recalibrate"), "cost calibration requires recalibration"),
        )
    )
    return row.select("fill_samples", "cost_samples", F.array_join(reasons, "; ").alias("reason"), (F.size(reasons) > 0).alias("suspect"), F.when(F.size(reasons) > 0, "review").otherwise("ready").alias("verdict"))


def signals_import(rows: DataFrame, aliases: dict[str, Sequence[str]], required: Sequence[str] = ("observed_at", "source", "latency_seconds")) -> DataFrame:
    """External signals of any spelling in one, with the hash of what came, and the required fields that are missing."""
    there = set(rows.columns)
    picked = [F.coalesce(*[F.nullif(F.col(a).cast("string"), F.lit("")) for a in names if a in there], F.lit(None).cast("string")).alias(field) for field, names in aliases.items()]
    out = rows.select(*picked, F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])), 256).alias("payload_hash"))
    out = out.withColumn("source", F.coalesce("source", F.lit("manual")))
    return out.withColumn("missing", F.array_join(F.array_compact(F.array(*[F.when(F.col(r).isNull(), r) for r in required])), ","))


def profile_suggestions(drift: DataFrame, *, min_samples: int = 3) -> DataFrame:
    """Floors for the execution parameters of each bucket whose errors ask for them: scope, bucket, samples, status_error_pct, price_error, slippage_error, latency_error."""
    worst = F.greatest("price_error", "slippage_error")
    stress = (F.col("status_error_pct") >= 20) | (F.col("price_error") >= 0.03) | (F.col("slippage_error") >= 0.03) | (F.col("latency_error") >= 5)
    rows = drift.where((F.col("samples") >= min_samples) & ((F.col("status_error_pct") > 0) | (worst > 0.01) | (F.col("latency_error") > 0)))
    return rows.select(
        "bucket", "samples", F.when(stress, "stress").otherwise("conservative").alias("profile"), F.greatest(F.lit(0.0), F.col("latency_error")).alias("latency_floor"),
        F.when(worst <= 0.01, 0.0).otherwise(F.greatest(F.lit(0.0025), worst)).alias("slippage_floor"), F.least(F.lit(80.0), F.col("status_error_pct") * 1.5).alias("haircut_pct"),
    )


def result_coverage(plan: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row: planned, covered and missing runs, results beyond the plan, repeated results and the share covered in percent."""
    got = results.groupBy(key).agg(F.count("*").alias("_n"))
    met = plan.select(key).distinct().withColumn("_planned", F.lit(True)).join(got, key, "full")
    planned, there = F.col("_planned").isNotNull(), F.col("_n").isNotNull()
    row = met.agg(
        F.count_if(planned).alias("planned"), F.count_if(planned & there).alias("covered"), F.count_if(planned & ~there).alias("missing"), F.coalesce(F.sum(F.when(~planned, F.col("_n"))), F.lit(0).cast("long")).alias("unplanned"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0).cast("long")).alias("duplicates"),
    )
    pct = F.when(F.col("planned") > 0, F.col("covered") * 100.0 / F.col("planned")).otherwise(0.0)
    return row.withColumn("coverage_pct", pct).withColumn("status", first_match([(F.col("planned") == 0, "missing"), (F.col("covered") == 0, "missing"), (pct >= 100, "ready")], "review"))


def stream_contract(events: DataFrame, wants: dict[str, Column], order: Sequence[str]) -> DataFrame:
    """One row: events, their axes, whether they are in order by ``place``, the classes that should be there and aren't, and a verdict.

    ``wants``: event type and whether it must occur, an aggregate over the events.
    """
    key = F.struct(*order)
    w = Window.partitionBy("stream").orderBy("place")
    rows = events.withColumn("_bad", F.coalesce(key < F.lag(key).over(w), F.lit(False)))
    absent = F.array_compact(F.array(*[F.when(must & (F.count_if(F.col("event_type") == kind) == 0), kind) for kind, must in wants.items()]))
    row = rows.agg(F.count("*").alias("events"), F.array_join(F.array_sort(F.collect_set("x_axis")), ",").alias("axes"), F.count_if(F.col("_bad")).alias("out_of_order"), F.array_join(absent, ",").alias("missing"))
    return row.withColumn("status", first_match([(F.col("events") == 0, "missing"), ((F.col("out_of_order") == 0) & (F.col("missing") == ""), "ready")], "review"))


def joint_plan(legs: DataFrame) -> DataFrame:
    """Of each event: legs, those that can be replayed, their common window and whether a joint replay can run."""
    out = legs.groupBy("event_id").agg(F.count("*").alias("legs"), F.count_if("ready").alias("ready_legs"), F.max("first_x").alias("start"), F.min("last_x").alias("end"))
    status = first_match([(F.col("ready_legs") < 2, "single_leg"), (F.col("start") > F.col("end"), "no_common_window"), (F.col("ready_legs") < F.col("legs"), "partial")], "ready")
    return out.withColumn("status", status)


def promotion_gate(runs: DataFrame) -> DataFrame:
    """Where a run may go, from its reports: verdict, paper and live, and the reasons that block it, need a review or are missing.

    Columns: credibility, quality, reproducible, cache, settlement, triangulation,
    regime, prediction (ready, review, ... or null), suspect, scope, coverage_pct,
    missing_evidence.
    """
    need = ("credibility", "quality", "reproducible", "cache", "settlement")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in (*need, "triangulation", "regime", "coverage_pct", "missing_evidence")]))
    blocked = F.array_compact(
        F.array(
            *[F.when(F.col(c) != "ready", F.concat(F.lit(f"{c}="), F.col(c))) for c in (*need, "triangulation")], F.when(F.col("suspect"), "fill_model_suspect"), F.when(F.col("coverage_pct") != 100, "coverage"),
            F.when(F.col("missing_evidence") > 0, "missing_evidence"),
        )
    )
    review = F.array_compact(F.array(F.when(F.col("regime") != "ready", F.concat(F.lit("regime="), F.col("regime"))), F.when(F.col("scope") == "regime_specific", "regime_specific"), F.when(F.col("prediction") != "ready", F.concat(F.lit("prediction="), F.col("prediction")))))
    paper = (F.size(missing) == 0) & (F.size(blocked) == 0)
    verdict = first_match([(F.size(missing) > 0, "missing"), (F.size(blocked) > 0, "blocked"), (F.size(review) > 0, "review")], "ready")
    return runs.select("run", verdict.alias("verdict"), paper.alias("paper"), (paper & (F.size(review) == 0)).alias("live"), *[F.array_join(a, ",").alias(n) for n, a in (("missing", missing), ("blocked", blocked), ("review", review))])


def contract_audit(fills: DataFrame, derived: DataFrame) -> DataFrame:
    """One row of counters over raw fills and what was derived from them, and a verdict: nothing invalid, nothing lost, nothing from nowhere."""
    raw = fills.agg(
        F.count("*").alias("rows"), F.count_if((F.col("price") <= 0) | (F.col("price") >= 1) | F.col("price").isNull()).alias("invalid_price"), F.count_if((F.col("size") <= 0) | F.col("size").isNull()).alias("invalid_size"),
        F.count_if(F.col("token_id").isNull() | F.col("market_id").isNull()).alias("missing_key"), F.count_if(F.col("block_time").isNull()).alias("missing_time"),
    )
    twice = fills.groupBy("tx_hash", "log_index", "maker").count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0).cast("long")).alias("repeated"))
    out = derived.agg(F.count("*").alias("derived"))
    row = raw.crossJoin(twice).crossJoin(out)  # one row each
    bad = [F.col(c) > 0 for c in ("invalid_price", "invalid_size", "missing_key", "missing_time")]
    verdict = first_match([((F.col("rows") == 0) & (F.col("derived") > 0), "derived_without_source"), (F.col("rows") == 0, "empty"), (bad[0] | bad[1] | bad[2] | bad[3], "invalid"), (F.col("derived") + F.col("repeated") < F.col("rows"), "lost_rows")], "ready")
    return row.withColumn("verdict", verdict)


def summed_counters(parts: Sequence[DataFrame], keys: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Counters of several sources as one: each is summed where it is, then all of them."""
    one = [p.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters]) for p in parts]
    out = one[0]
    for p in one[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def probe_pairs(probes: DataFrame, scores: DataFrame, keys: Sequence[str], x: str, within: int) -> DataFrame:
    """Live probes with the model's score as it was at the time: the latest at or before, no older than ``within``."""
    from .asof import asof

    met = asof(probes, scores.withColumn("_scored", F.col(x)), list(keys), x, ["score", "_scored"])
    return met.withColumn("score", F.when(F.col(x) - F.col("_scored") <= within, F.col("score"))).drop("_scored")
