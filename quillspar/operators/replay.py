"""Order execution against the tape.

Orders: order_index, market_id, asset_id, side, limit_price, size, arrival,
deadline, tif. Trades: trade_id, market_id, asset_id, side, price, size, block.
Orders meet trades of their own market and asset in [arrival, deadline] only, so
both are laid out over buckets of the block axis and equi-joined: no range join.
Where every order has the tape to itself its fills are a running sum; where orders
share it the fold runs in order of order_index over each run of linked windows of a
market, asset and side.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import q10

IMMEDIATE = ("IOC", "FOK", "FAK")


def with_deadlines(orders: DataFrame, signal: str = "signal_block", latency: str = "latency_blocks", horizon: str = "horizon_blocks") -> DataFrame:
    """Arrival after the latency; deadline after the horizon, one block at most for immediate orders."""
    arrival = F.col(signal) + F.greatest(F.lit(0), F.col(latency))
    length = F.when(F.col("tif").isin(*IMMEDIATE), F.least(F.greatest(F.coalesce(F.col(horizon), F.lit(1)), F.lit(0)), F.lit(1))).otherwise(F.col(horizon))
    return orders.withColumn("arrival", arrival).withColumn("deadline", F.col("arrival") + length)


def within_limit(side: Column, price: Column, limit: Column) -> Column:
    return F.when(side == "BUY", price <= limit).otherwise(price >= limit)


def execution_price(side: Column, price: Column, buffer: str) -> Column:
    """The print's price worsened by the buffer, inside [0, 1]."""
    b = F.lit(buffer).cast("decimal(11,10)")
    one, nought = F.lit(1).cast("decimal(11,10)"), F.lit(0).cast("decimal(11,10)")
    moved = F.when(side == "BUY", (price + b).cast("decimal(12,10)")).otherwise((price - b).cast("decimal(12,10)"))
    return F.greatest(nought, F.least(one, moved)).cast("decimal(11,10)")


def candidates(orders: DataFrame, trades: DataFrame, *, bucket: int, buffer: str = "0", any_side: bool = False, opposite: bool = False) -> DataFrame:
    """Trades each order may meet, with the price it would get."""
    laid = orders.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("arrival") / bucket), F.floor(F.col("deadline") / bucket))))
    tape = trades.select("market_id", "asset_id", F.col("side").alias("trade_side"), "trade_id", "block", F.col("price").alias("trade_price"), F.col("size").alias("trade_size")).withColumn("_bucket", F.floor(F.col("block") / bucket))
    met = laid.join(tape, ["market_id", "asset_id", "_bucket"]).where("block between arrival and deadline").drop("_bucket")
    if not any_side:
        met = met.where((F.col("trade_side") != F.col("side")) if opposite else (F.col("trade_side") == F.col("side")))
    met = met.where(within_limit(F.col("side"), F.col("trade_price"), F.col("limit_price"))).withColumn("exec_price", execution_price(F.col("side"), F.col("trade_price"), buffer))
    return met.where(within_limit(F.col("side"), F.col("exec_price"), F.col("limit_price")))


def private_fills(orders: DataFrame, trades: DataFrame, *, rate: str, bucket: int, buffer: str = "0") -> DataFrame:
    """Fills of each order with the tape to itself, in trade order, no more than a share of each print.

    FOK orders, and orders that take no part fill, fill whole or not at all.
    """
    met = candidates(orders, trades, bucket=bucket, buffer=buffer).withColumn("cap", q10(F.col("trade_size") * F.lit(rate).cast("decimal(6,4)")))
    w = Window.partitionBy("order_index").orderBy("block", "trade_id")
    before = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,10)"))
    left = (F.col("size").cast("decimal(38,10)") - before).cast("decimal(38,10)")
    nought = F.lit(0).cast("decimal(38,10)")
    fills = met.withColumn("qty", F.greatest(nought, F.least(F.col("cap"), left)).cast("decimal(38,10)")).where("qty > 0")
    total = F.sum("qty").over(Window.partitionBy("order_index"))
    return fills.withColumn("_total", total).where((F.col("tif") != "FOK") | (F.col("_total") >= F.col("size"))).drop("_total")


def maker_fills(orders: DataFrame, trades: DataFrame, *, bucket: int, queue: str = "queue_ahead") -> DataFrame:
    """Passive fills at the limit: opposite flow first eats the queue ahead, then fills."""
    met = candidates(orders, trades, bucket=bucket, opposite=True)
    w = Window.partitionBy("order_index").orderBy("block", "trade_id")
    flow = F.sum("trade_size").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(38,10)")
    nought = F.lit(0).cast("decimal(38,10)")
    done = lambda x: F.greatest(nought, F.least(F.col("size").cast("decimal(38,10)"), (x - F.col(queue).cast("decimal(38,10)")).cast("decimal(38,10)")))
    got = met.withColumn("_flow", flow).withColumn("qty", (done(F.col("_flow")) - done((F.col("_flow") - F.col("trade_size")).cast("decimal(38,10)"))).cast("decimal(38,10)"))
    return got.where("qty > 0").drop("_flow")


def results(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """One row an order: filled size, fills, status and the size-weighted delay in blocks."""
    got = fills.groupBy("order_index").agg(
        F.sum("qty").cast("decimal(38,10)").alias("filled"), F.count("*").alias("n_fills"), F.sum(F.col("qty").cast("decimal(26,10)") * (F.col("block") - F.col("arrival")).cast("decimal(10,0)")).alias("_delay")
    )
    filled = F.coalesce("filled", F.lit(0).cast("decimal(38,10)"))
    rows = orders.join(got, "order_index", "left").withColumn("filled", filled).withColumn("n_fills", F.coalesce("n_fills", F.lit(0).cast("long")))
    status = F.when(F.col("filled") >= F.col("size"), "FILLED").when(F.col("filled") > 0, F.when(F.col("tif").isin(*IMMEDIATE), "PARTIAL_CANCELLED").otherwise("PARTIAL")).otherwise(F.when(F.col("tif").isin(*IMMEDIATE), "CANCELLED").otherwise("UNFILLED"))
    return rows.withColumn("status", status).withColumn("delay_blocks", F.when(F.col("filled") > 0, F.col("_delay").cast("double") / F.col("filled").cast("double"))).drop("_delay")


def unfilled_reason(orders: DataFrame, trades: DataFrame, fills: DataFrame, *, bucket: int, buffer: str) -> DataFrame:
    """Why an order is not whole: no trade, limit, buffer, capacity; null if it is."""
    wide = candidates(orders.withColumn("_limit", F.col("limit_price")).withColumn("limit_price", F.when(F.col("side") == "BUY", F.lit(1)).otherwise(F.lit(0)).cast("decimal(11,10)")), trades, bucket=bucket)
    seen = wide.groupBy("order_index").agg(
        F.count("*").alias("n_trades"), F.count_if(within_limit(F.col("side"), F.col("trade_price"), F.col("_limit"))).alias("n_limit"),
        F.count_if(within_limit(F.col("side"), execution_price(F.col("side"), F.col("trade_price"), buffer), F.col("_limit"))).alias("n_buffer"),
    )
    rows = results(orders, fills).join(seen, "order_index", "left")
    reason = F.when(F.col("filled") >= F.col("size"), None).when(F.coalesce("n_trades", F.lit(0)) == 0, "no_trade").when(F.col("n_limit") == 0, "limit_not_reached").when(F.col("n_buffer") == 0, "price_buffer").when(F.col("filled") > 0, "insufficient_volume").otherwise("capacity")
    return rows.select("order_index", "filled", reason.alias("reason"))


def gate(orders: DataFrame, trades: DataFrame, *, bucket: int, lookback: int, min_trades: int, min_volume: str) -> DataFrame:
    """Evidence before arrival: trailing trades and volume strictly before it, and whether that is enough."""
    before = orders.select("order_index", "market_id", "asset_id", (F.col("arrival") - lookback).alias("arrival"), (F.col("arrival") - 1).alias("deadline"))
    laid = before.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("arrival") / bucket), F.floor(F.col("deadline") / bucket))))
    tape = trades.select("market_id", "asset_id", "block", F.col("size").alias("trade_size"), F.floor(F.col("block") / bucket).alias("_bucket"))
    got = laid.join(tape, ["market_id", "asset_id", "_bucket"]).where("block between arrival and deadline").groupBy("order_index").agg(F.count("*").alias("trailing_trades"), F.sum("trade_size").cast("decimal(38,10)").alias("trailing_volume"))
    rows = orders.select("order_index").join(got, "order_index", "left").select(
        "order_index", F.coalesce("trailing_trades", F.lit(0).cast("long")).alias("trailing_trades"), F.coalesce("trailing_volume", F.lit(0).cast("decimal(38,10)")).alias("trailing_volume")
    )
    reason = F.when(F.col("trailing_trades") == 0, "no_trailing_trades").when(F.col("trailing_trades") < min_trades, "too_few_trades").when(F.col("trailing_volume") < F.lit(min_volume).cast("decimal(38,10)"), "too_little_volume")
    return rows.withColumn("gate_reason", reason)


_TENTH = Decimal("1e-10")


def _q(x: Decimal) -> Decimal:
    return x.quantize(_TENTH, ROUND_HALF_UP)


def shared_fold(orders: list[dict], trades: list[dict], rate: Decimal, buffer: Decimal, window_cap: Decimal | None = None, window_blocks: int = 1) -> Iterator[dict]:
    """Fills of orders that share the tape, in order of order_index.

    A print's share is used up by earlier orders, and so is a window's cap. The
    print that an order's signal was read from, its source_trade_id, is not for it.
    An order that must fill whole uses up nothing unless it does.
    """
    used: dict = {}
    window: dict = {}
    trades = sorted(trades, key=lambda t: (t["block"], t["trade_id"]))
    blocks = [t["block"] for t in trades]
    for order in sorted(orders, key=lambda o: o["order_index"]):
        buy, left, taken = order["side"] == "BUY", order["size"], []
        for t in trades[bisect_left(blocks, order["arrival"]) : bisect_right(blocks, order["deadline"])]:
            if left <= 0:
                break
            if t["side"] != order["side"] or t["trade_id"] == order.get("source_trade_id"):
                continue
            price = min(Decimal(1), max(Decimal(0), t["price"] + (buffer if buy else -buffer)))
            if any((p > order["limit_price"]) if buy else (p < order["limit_price"]) for p in (t["price"], price)):
                continue
            cap = _q(t["size"] * rate) - used.get(t["trade_id"], Decimal(0))
            key = (t["side"], t["block"] // window_blocks)
            if window_cap is not None:
                cap = min(cap, window_cap - window.get(key, Decimal(0)) - sum((x[2] for x in taken if x[3] == key), Decimal(0)))
            qty = _q(min(left, cap))
            if qty > 0:
                taken.append((t["trade_id"], price, qty, key, t["block"]))
                left -= qty
        if left > 0 and order["tif"] == "FOK":
            continue
        for trade_id, price, qty, key, block in taken:
            used[trade_id] = used.get(trade_id, Decimal(0)) + qty
            window[key] = window.get(key, Decimal(0)) + qty
            yield {"order_index": order["order_index"], "trade_id": trade_id, "exec_price": price, "qty": qty, "block": block}


#: Blocks of a bucket in which runs of orders meet the tape.
RUN_BUCKET = 1000


def runs(orders: DataFrame, keys: Sequence[str], unit: int = 1) -> DataFrame:
    """Orders with ``run``: those of a key whose windows are linked by shared units of ``unit`` blocks have one number."""
    low, high = F.floor(F.col("arrival") / unit) * unit, F.floor(F.col("deadline") / unit) * unit + unit - 1
    w = Window.partitionBy(*keys).orderBy("_low", "_high", "order_index")
    reach = F.max("_high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = orders.withColumns({"_low": low, "_high": high}).withColumn("_new", F.when(reach.isNull() | (F.col("_low") > reach), 1).otherwise(0))
    return marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def shared_fills(orders: DataFrame, trades: DataFrame, *, rate: str, buffer: str = "0", window_cap: str | None = None, window_blocks: int = 1) -> DataFrame:
    """``shared_fold`` for each run of orders that can meet the same prints or caps.

    An order meets prints of its own market, asset and side inside its window
    only, so orders whose windows aren't linked (by whole cap windows, if there is
    a cap) never share anything: they are folded apart, and a hot market is many
    tasks wherever its orders leave a pause. Prints outside all windows never move.
    """
    limits = (Decimal(rate), Decimal(buffer), None if window_cap is None else Decimal(window_cap), window_blocks)
    keys = ["market_id", "asset_id", "side"]
    source = ["source_trade_id"] if "source_trade_id" in orders.columns else []
    a = runs(orders.select("order_index", *keys, "limit_price", "size", "arrival", "deadline", "tif", *source), keys, 1 if window_cap is None else window_blocks)
    spans = a.groupBy(*[F.col(k).alias(k) for k in (*keys, "run")]).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / RUN_BUCKET), F.floor(F.col("_high") / RUN_BUCKET))))
    b = trades.select("trade_id", *keys, "price", "size", "block").withColumn("_bucket", F.floor(F.col("block") / RUN_BUCKET))
    b = b.join(spans, [*keys, "_bucket"]).where("block between _low and _high").select("trade_id", "price", "size", "block", *[F.col(k).alias(k) for k in (*keys, "run")])

    def fold(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = list(shared_fold(a.to_dict("records"), b.to_dict("records"), *limits))
        return pd.DataFrame(rows, columns=["order_index", "trade_id", "exec_price", "qty", "block"])

    group = [*keys, "run"]
    return a.drop("_low", "_high").groupBy(*group).cogroup(b.groupBy(*group)).applyInPandas(fold, "order_index long, trade_id long, exec_price decimal(11,10), qty decimal(38,10), block long")


def variants(orders: DataFrame, rates: list[str]) -> DataFrame:
    """Each order once for each participation rate, as an extra key: one plan, no driver loop."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(r).cast("decimal(6,4)").alias("rate")) for i, r in enumerate(rates)]))
    return orders.withColumn("_v", grid).select("*", "_v.variant", "_v.rate").drop("_v")


def depth_walk(levels: DataFrame, orders: DataFrame) -> DataFrame:
    """Fills of an order against book levels, best first, within its limit.

    Levels: book_id, side, price, size (the side a taker of ``side`` meets).
    Orders: order_index, book_id, side, limit_price, size.
    """
    best = F.when(F.col("side") == "BUY", F.col("price")).otherwise(-F.col("price"))
    w = Window.partitionBy("book_id", "side").orderBy(best, "size").rowsBetween(Window.unboundedPreceding, -1)
    # what lies before a level is the same for every order: the limit only cuts the walk short
    walk = levels.select("book_id", "side", F.col("price").alias("level_price"), F.col("size").alias("level_size"), F.coalesce(F.sum("size").over(w), F.lit(0).cast("decimal(38,10)")).cast("decimal(38,10)").alias("_before"))
    met = orders.join(walk, ["book_id", "side"]).where((F.col("_before") < F.col("size")) & within_limit(F.col("side"), F.col("level_price"), F.col("limit_price")))
    left = (F.col("size").cast("decimal(38,10)") - F.col("_before")).cast("decimal(38,10)")
    fills = met.withColumn("qty", F.least(F.col("level_size").cast("decimal(38,10)"), left))
    got = fills.groupBy("order_index").agg(F.sum("qty").cast("decimal(38,10)").alias("filled"), F.count("*").alias("n_levels"), F.sum(F.col("qty").cast("decimal(26,10)") * F.col("level_price")).alias("_cost"))
    return orders.select("order_index", "size").join(got, "order_index", "left").select(
        "order_index", F.coalesce("filled", F.lit(0).cast("decimal(38,10)")).alias("filled"), F.coalesce("n_levels", F.lit(0).cast("long")).alias("n_levels"),
        (F.col("size") - F.coalesce("filled", F.lit(0).cast("decimal(38,10)"))).cast("decimal(38,10)").alias("residual"), (F.col("_cost").cast("double") / F.col("filled").cast("double")).alias("avg_price"),
    )


def block_volume_fill(rows: DataFrame, cap_percent: float, haircut: float, min_fill: float) -> DataFrame:
    """Expected fill from a block's volume: side volume if there is any, else the block's."""
    basis = F.when(F.col("side_volume") > 0, F.col("side_volume")).otherwise(F.col("block_volume"))
    available = basis * cap_percent / 100
    raw = F.least(F.lit(100.0), 100 * available / F.col("requested"))
    p = raw * haircut
    filled = F.least(F.col("requested"), available, F.col("requested") * p / 100)
    return rows.withColumn("available", available).withColumn("probability", p).withColumn("filled", F.when(filled >= min_fill, filled).otherwise(0.0))


def xorshift64(state: int) -> int:
    """The next state of the 64-bit xorshift generator (13, 7, 17)."""
    mask = (1 << 64) - 1
    state ^= state << 13 & mask
    state ^= state >> 7
    return state ^ (state << 17 & mask)


def poisson_paths(orders: DataFrame, paths: int) -> DataFrame:
    """Quantiles of filled size over seeded Poisson arrivals: order_index, intensity, horizon, clip, size.

    Every order draws from its own generator, seeded by its index, so results do
    not depend on how orders are spread.
    """
    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            state = rows["order_index"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            state[state == 0] = 1
            limit = np.exp(-np.minimum(700.0, rows["intensity"] * rows["horizon"])).to_numpy()
            filled = np.zeros((paths, len(rows)))
            for path in range(paths):
                product, hits = np.ones(len(rows)), np.full(len(rows), -1)
                open_ = np.flatnonzero(product > limit)
                while len(open_):
                    # the three shifts of xorshift64, on all open orders at once
                    x = state[open_]
                    x ^= x << np.uint64(13)
                    x ^= x >> np.uint64(7)
                    x ^= x << np.uint64(17)
                    state[open_] = x
                    product[open_] *= (x >> np.uint64(11)) / float(1 << 53)
                    hits[open_] += 1
                    open_ = open_[product[open_] > limit[open_]]
                filled[path] = np.minimum(rows["size"], np.maximum(hits, 0) * rows["clip"])
            filled.sort(axis=0)
            at = [min(paths - 1, int(q * (paths - 1) + 0.5)) for q in (0.1, 0.5, 0.9)]
            yield pd.DataFrame({"order_index": rows["order_index"], "q10": filled[at[0]], "q50": filled[at[1]], "q90": filled[at[2]]})

    return orders.select("order_index", "intensity", "horizon", "clip", "size").mapInPandas(simulate, "order_index long, q10 double, q50 double, q90 double")


def touch_survival(orders: DataFrame, trades: DataFrame, *, bucket: int, lookback: int) -> DataFrame:
    """Bounds and a hazard estimate of a passive fill after its price is first touched.

    A first touch of no size counts as one that the order outweighs by far.
    """
    before = orders.select("order_index", "market_id", "asset_id", "side", "limit_price", "size", "tif", F.col("arrival").alias("_arrival"), F.col("deadline").alias("_deadline"), (F.col("arrival") - lookback).alias("arrival"), "deadline")
    met = candidates(before, trades, bucket=bucket, opposite=True)
    past, now = F.col("block") < F.col("_arrival"), F.col("block") >= F.col("_arrival")
    cross = F.when(F.col("side") == "BUY", F.col("trade_price") < F.col("limit_price")).otherwise(F.col("trade_price") > F.col("limit_price"))
    got = met.groupBy("order_index", "_deadline", "size").agg(
        F.count_if(past).alias("hits_before"), F.min(F.when(now, F.col("block"))).alias("first_touch"), F.min_by(F.when(now, F.col("trade_size")), F.when(now, F.struct("block", "trade_id"))).alias("_touch_size"), F.count_if(now & cross).alias("crosses")
    )
    rate = F.col("hits_before") / F.lit(float(lookback))
    hazard = F.greatest(F.lit(1e-6), rate * (0.5 + F.exp(-F.least(F.lit(20.0), F.try_divide(F.col("size").cast("double"), F.col("_touch_size").cast("double"))))))
    p = F.when(F.col("first_touch").isNull(), 0.0).otherwise(1 - F.exp(-hazard * (F.col("_deadline") - F.col("first_touch"))))
    rows = got.select("order_index", "hits_before", "first_touch", "crosses", p.alias("probability"), F.when(F.col("crosses") > 0, 1.0).otherwise(0.0).alias("lower"), F.when(F.col("first_touch").isNull(), 0.0).otherwise(1.0).alias("upper"))
    return orders.select("order_index").join(rows, "order_index", "left").na.fill({"hits_before": 0, "crosses": 0, "probability": 0.0, "lower": 0.0, "upper": 0.0})
