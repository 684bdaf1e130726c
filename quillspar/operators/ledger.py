"""Ledgers, settlement, lots, scores and calibration figures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import wilson
from .prefix import ntile, running_before

MONEY = "decimal(38,10)"


def running(entries: DataFrame, keys: Sequence[str], order: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """Running sums of amounts in ledger order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.select("*", *[F.sum(a).over(w).cast(MONEY).alias(f"{a}_balance") for a in amounts])


def cashflow(kind: Column, amount: Column) -> Column:
    """Signed cash: money in for sells, redemptions, merges and rebates, out for buys and splits."""
    return F.when(kind.isin("SELL", "REDEEM", "MERGE", "REBATE"), amount).when(kind.isin("BUY", "SPLIT"), -amount).otherwise(F.lit(0).cast(MONEY))


def settlement_class(status: Column, winner: Column, resolved_at: Column, cutoff: Column) -> Column:
    """How a position ends; what is missing is never a loss."""
    return (
        F.when(status.isNull(), "technical_missing").when((status == "RESOLVED") & resolved_at.isNull(), "technical_missing").when((status == "RESOLVED") & (resolved_at > cutoff), "post_cutoff")
        .when((status == "RESOLVED") & (winner == "YES"), "settled_yes").when((status == "RESOLVED") & (winner == "NO"), "settled_no").when(status == "RESOLVED", "identity_conflict")
        .when(status == "CANCELLED", "cancelled_half_refund").otherwise("unresolved")
    )


def payout(kind: Column) -> tuple[Column, Column]:
    """Lower and upper payout of a YES share."""
    low = F.when(kind == "settled_yes", 1.0).when(kind == "cancelled_half_refund", 0.5).otherwise(0.0)
    return low, F.when(kind.isin("unresolved", "post_cutoff", "technical_missing", "identity_conflict"), 1.0).otherwise(low)


def concurrent(intervals: DataFrame, keys: Sequence[str], start: str, end: str, amount: str) -> DataFrame:
    """Open amount after each event and its running maximum; ends come before starts of one time."""
    opened = intervals.select(*keys, F.col(start).alias("at"), F.lit(1).alias("_kind"), F.col(amount).alias("_delta"))
    closed = intervals.select(*keys, F.col(end).alias("at"), F.lit(0).alias("_kind"), (-F.col(amount)).alias("_delta"))
    net = opened.unionByName(closed).groupBy(*keys, "at", "_kind").agg(F.sum("_delta").alias("_delta"))
    w = Window.partitionBy(*keys).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumn("open", F.sum("_delta").over(w)).groupBy(*keys).agg(F.max("open").alias("max_open"), F.count("*").alias("n_events"))


def threshold_strategy(bars: DataFrame, keys: Sequence[str], *, entry: float, exit_: float, stop: float, target: float, max_bars: int) -> DataFrame:
    """Trades of the entry/exit state machine over each key's bars (seq, price)."""

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        out, held = [], None
        for r in rows.sort_values("seq").itertuples():
            if held is None:
                held = (r.seq, r.price, 0) if r.price >= entry else None
                continue
            held = (held[0], held[1], held[2] + 1)
            move = r.price - held[1]
            reason = "stop" if move <= -stop else "target" if move >= target else "exit" if r.price <= exit_ else "max_hold" if held[2] >= max_bars else None
            if reason:
                out.append((*key, held[0], r.seq, held[1], r.price, move, reason))
                held = None
        if held is not None:
            last = rows.sort_values("seq").iloc[-1]
            out.append((*key, held[0], int(last.seq), held[1], float(last.price), float(last.price) - held[1], "open"))
        return pd.DataFrame(out, columns=[*keys, "entry_seq", "exit_seq", "entry_price", "exit_price", "pnl", "reason"])

    schema = ", ".join(f"{k} long" for k in keys) + ", entry_seq long, exit_seq long, entry_price double, exit_price double, pnl double, reason string"
    return bars.select(*keys, "seq", F.col("price").cast("double")).groupBy(*keys).applyInPandas(fold, schema)


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Counts, precision and recall with Wilson ends, in one row."""
    n = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    out = n
    for name, top, bottom in (("precision", F.col("tp"), F.col("tp") + F.col("fp")), ("recall", F.col("tp"), F.col("tp") + F.col("fn"))):
        out = out.withColumn(name, F.when(bottom > 0, top / bottom)).withColumn(f"{name}_low", wilson(top, bottom, False)).withColumn(f"{name}_high", wilson(top, bottom, True))
    return out


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Rank-sum area under the curve with ties at their mean rank, from one row a distinct score."""
    per = rows.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    per = running_before(per, score, "_n", "_below")
    got = per.agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), F.sum(2 * F.col("_p") * F.col("_below") + F.col("_p") * F.col("_n")).alias("_twice"))
    return got.select("positives", "negatives", (F.col("_twice") / (2 * F.col("positives") * F.col("negatives"))).alias("auc"))


def reliability(rows: DataFrame, score: str, label: str, bins: int, order: Sequence[str]) -> DataFrame:
    """Equal-count bins by score: size, hits and mean score as exact decimals."""
    binned = ntile(rows, score, order, bins)
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("hits"), F.sum(F.col(score).cast("decimal(18,8)")).cast("decimal(38,8)").alias("score_sum"))


def walk_forward(rows: DataFrame, keys: Sequence[str], signal: str, available: str, won: str, price: str, shrink: float, z: float, buffer: float) -> DataFrame:
    """Each row with the edge learned from rows whose label was known strictly before its signal."""
    learned = rows.select(*keys, F.col(available).alias("_at"), F.lit(1).alias("_label"), (F.col(won).cast("double") - F.col(price).cast("double")).alias("_edge"), F.lit(None).cast(rows.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    asked = rows.select(*keys, F.col(signal).alias("_at"), F.lit(0).alias("_label"), F.lit(None).cast("double").alias("_edge"), F.struct("*").alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_label").rowsBetween(Window.unboundedPreceding, 0)
    got = learned.unionByName(asked).withColumn("n_known", F.count("_edge").over(w)).withColumn("_sum", F.coalesce(F.sum("_edge").over(w), F.lit(0.0))).where("_label = 0")
    p = F.col("_row")[price].cast("double")
    posterior = p + F.col("_sum") / (F.col("n_known") + shrink)
    lower = posterior - z * F.sqrt(posterior * (1 - posterior) / (F.col("n_known") + shrink + 1))
    return got.select("_row.*", "n_known", (lower - p - buffer).alias("net_edge"))


def logistic(rows: DataFrame, x: str, y: str, rounds: int = 25) -> tuple[float, float]:
    """Intercept and slope by Newton steps; each step is one aggregation to six numbers."""
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col(x))))
        w = p * (1 - p)
        g = rows.agg(F.sum(F.col(y) - p), F.sum((F.col(y) - p) * F.col(x)), F.sum(w), F.sum(w * F.col(x)), F.sum(w * F.col(x) * F.col(x))).first()
        det = g[2] * g[4] - g[3] * g[3]
        if not det:
            break
        da, db = (g[4] * g[0] - g[3] * g[1]) / det, (g[2] * g[1] - g[3] * g[0]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, draws: int, seed: int) -> DataFrame:
    """Percentile interval of a mean under resampling of whole clusters.

    Each cluster's total meets each draw with a Poisson weight hashed from both, so
    no cluster is gathered and the result is the same for every layout.
    """
    totals = rows.groupBy(cluster).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    spread = totals.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = (F.pmod(F.xxhash64(F.col(cluster), F.col("draw"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight, edge, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        edge += term
        weight = weight + F.when(u > edge, 1).otherwise(0)
        term /= k + 1
    got = spread.withColumn("_w", weight).groupBy("draw").agg((F.sum(F.col("_w") * F.col("_s")) / F.sum(F.col("_w") * F.col("_n"))).alias("mean"))
    return got.agg(F.expr("percentile(mean, 0.025)").alias("low"), F.expr("percentile(mean, 0.975)").alias("high"), F.count("*").alias("draws"))


def book_fold(events: Iterator[dict]) -> dict:
    """Levels of a book after snapshots and deltas; a best-price hint deletes what lies beyond it."""
    levels: dict[str, dict] = {"bid": {}, "ask": {}}
    for e in events:
        if e["kind"] == "book":
            levels = {side: dict(e[side]) for side in ("bid", "ask")}
        else:
            side = levels[e["side"]]
            if e["size"] == 0:
                side.pop(e["price"], None)
            else:
                side[e["price"]] = e["size"]
            if e.get("best_bid") is not None:
                levels["bid"] = {p: s for p, s in levels["bid"].items() if p <= e["best_bid"]}
            if e.get("best_ask") is not None:
                levels["ask"] = {p: s for p, s in levels["ask"].items() if p >= e["best_ask"]}
    return levels
