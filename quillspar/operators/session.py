"""Event-loop folds: limit replay with execution factors, and dual-clock sessions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .replay import IMMEDIATE, candidates

#: Order of events of one time: market data, then own cancels, then own submissions, then timers.
PRIORITY = {"trade": 0, "cancel": 1, "submit": 2, "expire": 3}


def limit_fold(order: dict, trades: Iterable[dict], *, rate: float, decay: float, queue_factor: float) -> Iterator[dict]:
    """Fills of one order under the older limit model.

    Only prints after the submission count, each once. What a print gives is its
    size times the rate, a decay with the blocks waited, a queue factor and a share
    that falls as the order fills; FOK and FAK orders look at the first block only.
    """
    left, seen, first = order["size"], set(), None
    for t in sorted(trades, key=lambda t: (t["block"], t["trade_id"])):
        if left <= 1e-9 or t["block"] > order["deadline"]:
            break
        buy = order["side"] == "BUY"
        if t["block"] < order["arrival"] or t["trade_id"] in seen or t["side"] != order["side"] or ((t["price"] > order["limit_price"]) if buy else (t["price"] < order["limit_price"])):
            continue
        seen.add(t["trade_id"])
        first = t["block"] if first is None else first
        if order["tif"] in ("FOK", "FAK", "IOC") and t["block"] != first:
            break
        waited = t["block"] - order["arrival"]
        share = 0.5 + 0.5 * left / order["size"]
        qty = min(left, t["size"] * rate * decay**waited * queue_factor * share)
        if qty > 1e-9:
            left -= qty
            yield {"order_index": order["order_index"], "trade_id": t["trade_id"], "qty": qty}


def limit_replay(orders: DataFrame, trades: DataFrame, *, rate: float = 0.25, decay: float = 0.98, queue_factor: float = 0.9, bucket: int = 100) -> DataFrame:
    """What ``limit_fold`` gives for every order; whole-or-nothing orders drop partial fills.

    Orders are independent: each meets its prints by market, asset and bucket of
    blocks, and the fold runs over an order's own prints inside the JVM.
    """
    met = candidates(orders, trades, bucket=bucket).repartition("order_index")
    once = met.groupBy("order_index", "tif", "size", "arrival", "trade_id").agg(F.min(F.struct("block", "trade_size")).alias("t"))
    gain = F.col("t.trade_size").cast("double") * rate * F.pow(F.lit(decay), F.col("t.block") - F.col("arrival")) * queue_factor
    prints = F.array_sort(F.collect_list(F.struct(F.col("t.block").alias("block"), "trade_id", gain.alias("gain"))))
    own = once.groupBy("order_index", "tif", F.col("size").cast("double").alias("size")).agg(prints.alias("prints"))
    first = ", ".join(f"'{t}'" for t in IMMEDIATE)
    own = own.withColumn("prints", F.expr(f"if(tif in ({first}), filter(prints, t -> t.block = prints[0].block), prints)"))
    got = F.expr("""aggregate(prints, named_struct('left', size, 'fills', cast(array() as array<struct<trade_id:bigint,qty:double>>)),
        (a, t) -> if(a.left <= 1e-9D or least(a.left, t.gain * (0.5D + 0.5D * a.left / size)) <= 1e-9D, a,
            named_struct('left', a.left - least(a.left, t.gain * (0.5D + 0.5D * a.left / size)),
                'fills', array_append(a.fills, named_struct('trade_id', t.trade_id, 'qty', least(a.left, t.gain * (0.5D + 0.5D * a.left / size)))))))""")
    done = own.withColumn("got", got).where("tif <> 'FOK' or aggregate(got.fills, 0D, (n, f) -> n + f.qty) >= size - 1e-9D")
    return done.select("order_index", F.explode("got.fills").alias("f")).select("order_index", "f.trade_id", "f.qty")


def session_fold(events: Iterable[dict], latency: int) -> Iterator[dict]:
    """Orders against trades on the exchange's clock, from events on both clocks.

    Own submissions and cancels reach the exchange ``latency`` after they are sent;
    trades fill live opposite orders at or within their limit, best price first,
    then by arrival. Yields one row an order: filled, and how it ended.
    """
    queue = sorted(((e["ts"] + (latency if e["kind"] in ("submit", "cancel") else 0), PRIORITY[e["kind"]], e["seq"]), e) for e in events)
    live: dict[int, dict] = {}
    ends: list[tuple[int, int]] = []
    done: list[dict] = []
    for (ts, _, _), e in queue:
        while ends and ts > ends[0][0]:
            _, order_id = heappop(ends)
            if order_id in live:
                done.append(dict(live.pop(order_id), status="EXPIRED"))
        if e["kind"] == "submit":
            live[e["order_id"]] = {"order_id": e["order_id"], "side": e["side"], "price": e["price"], "size": e["size"], "filled": 0.0, "arrival": ts}
            heappush(ends, (ts + e["ttl"], e["order_id"]))
        elif e["kind"] == "cancel" and e["order_id"] in live:
            done.append(dict(live.pop(e["order_id"]), status="CANCELLED"))
        elif e["kind"] == "trade":
            buy = e["side"] == "SELL"  # a selling aggressor meets resting buys
            resting = [o for o in live.values() if (o["side"] == "BUY") == buy and ((o["price"] >= e["price"]) if buy else (o["price"] <= e["price"]))]
            left = e["size"]
            for o in sorted(resting, key=lambda o: (-o["price"] if buy else o["price"], o["arrival"], o["order_id"])):
                got = min(left, o["size"] - o["filled"])
                o["filled"] += got
                left -= got
                if o["filled"] >= o["size"] - 1e-9:
                    done.append(dict(live.pop(o["order_id"]), status="FILLED"))
    for o in live.values():
        done.append(dict(o, status="OPEN"))
    for o in done:
        yield {"order_id": o["order_id"], "filled": o["filled"], "status": o["status"]}


def sessions(events: DataFrame, *, latency: int) -> DataFrame:
    """``session_fold`` for each condition: condition_id, ts, seq, kind, order_id, side, price, size, ttl."""

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"condition_id": key[0], **r} for r in session_fold(rows.to_dict("records"), latency)], columns=["condition_id", "order_id", "filled", "status"])

    return events.groupBy("condition_id").applyInPandas(fold, "condition_id long, order_id long, filled double, status string")


def shard_plan(weights: dict[str, float], shards: int, current: dict[str, int] | None = None, moves: int | None = None) -> dict[str, int]:
    """Heaviest first to the lightest shard; at most ``moves`` keys leave the shard they are on.

    A driver-side plan over keys of a subscription universe, not over data.
    """
    current = current or {}
    load, plan, moved = [0.0] * shards, {}, 0
    for key in sorted(weights, key=lambda k: (-weights[k], k)):
        best = min(range(shards), key=lambda s: (load[s], s))
        home = current.get(key)
        if home is not None and home != best:
            if moves is not None and moved >= moves:
                best = home
            else:
                moved += 1
        plan[key] = best
        load[best] += weights[key]
    return plan
