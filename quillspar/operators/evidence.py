"""What a tape proves about an order: named profiles, the evidence gate, reasons and source-confirmed fills."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import first_match
from .replay import IMMEDIATE, shared_fills


@dataclass(frozen=True)
class Profile:
    name: str
    rate: str
    latency_seconds: int
    horizon_seconds: int
    buffer: str
    maker_mode: str = "strict_no_fill"
    exclude_source: bool = True
    need_quote: bool = False
    quote_ttl_seconds: int | None = None
    min_trailing: int = 0
    trailing_multiple: str = "0"
    min_future: int = 1
    any_side: bool = False
    maker_rate: str | None = None
    phantom_queue: str = "0"
    variant: str | None = None


# The twelve named bundles of execution parameters.
PROFILES = (
    Profile("strict_audit", "0.0050", 5, 30, "0.0100", need_quote=True, quote_ttl_seconds=300, min_trailing=1, trailing_multiple="1.0", min_future=2),
    Profile("conservative_trade_tape", "0.0250", 1, 300, "0.0050", "phantom_queue", need_quote=True, quote_ttl_seconds=1800, min_trailing=1, trailing_multiple="0.5", maker_rate="0.0250", phantom_queue="1000"),
    Profile("lob_holdout_calibrated_fill_only", "0.0100", 1, 30, "0.0050", need_quote=True, quote_ttl_seconds=300, min_trailing=1, trailing_multiple="1.0"),
    Profile("probabilistic_trade_tape", "0.0250", 1, 300, "0.0050", variant="expected"),
    Profile("probabilistic_conservative", "0.0250", 1, 300, "0.0050", variant="conservative"),
    Profile("probabilistic_source_confirmed", "0.0250", 1, 300, "0.0050", variant="source_confirmed"),
    Profile("probabilistic_taker_5s", "0.0250", 1, 5, "0.0050", variant="expected"),
    Profile("probabilistic_taker_30s", "0.0250", 1, 30, "0.0050", variant="expected"),
    Profile("probabilistic_taker_120s", "0.0250", 1, 120, "0.0050", variant="expected"),
    Profile("probabilistic_taker_30s_any_order_side", "0.0100", 1, 30, "0.0050", any_side=True, variant="expected"),
    Profile("probabilistic_taker_120s_any_order_side", "0.0100", 1, 120, "0.0050", any_side=True, variant="expected"),
    Profile("optimistic_sensitivity", "0.0500", 0, 900, "0.0000", "phantom_queue", exclude_source=False, min_future=0, maker_rate="0.0500", phantom_queue="100"),
)

# Reasons of the models and the names they are reported by.
REASON_ALIASES = {
    "no_post_arrival_same_side_limit_trade": "no_post_arrival_same_side_trade",
    "no_post_arrival_economic_limit_trade": "no_post_arrival_economic_trade",
    "trade_print_capacity_already_consumed": "insufficient_trade_capacity",
    "insufficient_post_arrival_same_side_orderfilled_capacity": "insufficient_trade_capacity",
    "insufficient_post_arrival_economic_orderfilled_capacity": "insufficient_trade_capacity",
    "fok_insufficient_orderfilled_capacity": "insufficient_trade_capacity",
    "full_fill_required_insufficient_orderfilled_capacity": "insufficient_trade_capacity",
    "insufficient_future_eligible_trade_count": "future_trade_count_too_low",
    "insufficient_trailing_same_side_volume": "insufficient_trailing_volume",
    "insufficient_trailing_same_side_trade_count": "insufficient_trailing_trade_count",
    "lob_holdout_calibrated_missing_quote_proxy": "missing_pre_arrival_quote_proxy",
    "lob_holdout_calibrated_horizon_too_long": "unsupported_long_horizon",
    "lob_holdout_calibrated_low_validity_probability": "low_p_depth_valid",
    "fill_evidence_order_capacity_zero": "insufficient_trade_capacity",
    "maker_strict_no_fill": "unsupported_maker_order",
}


def standard_reason(reason: Column) -> Column:
    """The reported name of a model's reason; others as they are."""
    table = F.create_map(*[F.lit(x) for pair in REASON_ALIASES.items() for x in pair])
    return F.coalesce(table[reason], reason)


def _blocks(seconds: int, block_seconds: int) -> int:
    return -(-seconds // block_seconds)


def profile_evidence(orders: DataFrame, trades: DataFrame, *, bucket: int, block_seconds: int = 2, max_fill: str | None = None, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
    """The evidence gate of every order under every profile: profile, order_index, reason, filled.

    Orders: order_index, market_id, asset_id, side, limit_price, size, signal_block,
    source_trade_id, source_logs. Trades: trade_id, market_id, asset_id, side, price,
    size, block, logs. Seven reasons, the first that holds: no quote before arrival,
    that quote outside the limit, too few or too little trailing, too few or too
    little to come, no capacity; null if the order passes. What is filled is the
    share of each eligible print to come, up to the order's size. Prints of the
    order's own signal don't count where the profile says.

    Orders are dealt by stretches of blocks and go to Python with the prints of the
    stretch and its margins; there each profile looks at the prints of its own
    windows only, in whole units of 1e-10. ``bucket`` is the least length of a stretch.
    """
    back = max([_blocks(p.quote_ttl_seconds or 0, block_seconds) for p in profiles])
    ahead = max(_blocks(p.latency_seconds, block_seconds) + _blocks(p.horizon_seconds, block_seconds) for p in profiles)
    wide = max(bucket, STRETCH * (back + ahead))
    cell = F.pmod(F.xxhash64("market_id", "asset_id"), F.lit(CELLS)).alias("_cell")
    a = orders.select(cell, F.floor(F.col("signal_block") / wide).alias("_at"), F.col("order_index").cast("long").alias("order_index"), "market_id", "asset_id", "side", F.col("limit_price").cast(PLACES), F.col("size").cast(PLACES), F.col("signal_block").cast("long"), F.col("source_trade_id").cast("long"), "source_logs")
    reach = F.explode(F.sequence(F.floor((F.col("block") - ahead) / wide), F.floor((F.col("block") + back) / wide))).alias("_at")
    b = trades.where("block >= 0").select(cell, reach, F.col("trade_id").cast("long").alias("trade_id"), "market_id", "asset_id", "side", F.col("price").cast(PLACES), F.col("size").cast(PLACES), F.col("block").cast("long"), "logs")
    most = None if max_fill is None else int(Decimal(max_fill).scaleb(10).to_integral_value(ROUND_HALF_UP))

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        return _judged(left, right, profiles, back, block_seconds, most)

    got = a.groupBy("_cell", "_at").cogroup(b.groupBy("_cell", "_at")).applyInArrow(fold, f"order_index long, profile int, reason int, filled {PLACES}")
    name = lambda texts, at: F.element_at(F.array(*map(F.lit, texts)), F.col(at) + 1)
    return got.select(name([p.name for p in profiles], "profile").alias("profile"), "order_index", F.when(F.col("reason") >= 0, name(REASONS, "reason")).alias("reason"), "filled")


PLACES = "decimal(38,10)"
#: A stretch of blocks is so many times what an order looks at; parts of the keys that are judged apart.
STRETCH, CELLS = 10, 4
REASONS = (
    "missing_pre_arrival_trade_quote_proxy", "pre_arrival_trade_quote_outside_limit", "insufficient_trailing_same_side_trade_count", "insufficient_trailing_same_side_volume",
    "insufficient_future_eligible_trade_count", "insufficient_future_eligible_volume", "fill_evidence_order_capacity_zero", "",
)


def _units(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Decimals in units of 1e-10, as 64-bit numbers where their sums stay well inside them and as Python's otherwise; and which are no nulls."""
    valid = column.is_valid().to_numpy()
    column = column.fill_null(Decimal(0)).combine_chunks()
    low, high = np.frombuffer(column.buffers()[1], np.int64).reshape(-1, 2)[column.offset : column.offset + len(column)].T if len(column) else (np.zeros(0, np.int64),) * 2
    if (high == low >> 63).all() and (np.abs(low) < min(1 << 48, (1 << 59) // max(1, len(low)))).all():
        return low.copy(), valid
    return np.array([int(x.scaleb(10)) for x in column.to_pylist()], object), valid


def _matches(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values."""
    order = np.argsort(right, kind="stable")
    low, high = np.searchsorted(right[order], left, "left"), np.searchsorted(right[order], left, "right")
    own = np.repeat(np.arange(len(left)), high - low)
    return own, order[_within(low, high)]


def _within(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All places from low to high, range after range."""
    count = high - low
    return np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())


def _listed(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both sides whose lists share a value."""
    (x, p), (y, q) = ((np.asarray(pc.list_parent_indices(c)), pc.list_flatten(c)) for c in (left.combine_chunks(), right.combine_chunks()))
    u, v = _coded(p, q)
    own, at = _matches(u[u >= 0], v[v >= 0])
    return x[u >= 0][own], y[v >= 0][at]


def _coded(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of both sides as numbers, the same for equal ones; null is -1."""
    whole = pa.chunked_array([*(x for c in (left, right) for x in (c.cast(left.type).chunks if isinstance(c, pa.ChunkedArray) else [c.cast(left.type)]))], left.type)
    codes = whole.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[: len(left)], codes[len(left) :]


def _judged(a: pa.Table, b: pa.Table, profiles: tuple[Profile, ...], back: int, block_seconds: int, most: int | None) -> pa.Table:
    """``profile_evidence`` of the orders of one stretch: order_index, profile, reason (-1: passed), filled."""
    n = a.num_rows
    number = lambda t, c: t[c].fill_null(0).to_numpy()
    # market and asset as one number; null meets nothing
    codes = [_coded(a[c], b[c]) for c in ("market_id", "asset_id")]
    key, run = (np.where((m < 0) | (x < 0), -1, m * (max(y.max(initial=0) for y in codes[1]) + 1) + x) for m, x in zip(*codes, strict=True))
    key[~a["signal_block"].is_valid().to_numpy()] = -1
    order = np.lexsort((number(b, "trade_id"), b["trade_id"].is_valid().to_numpy(), number(b, "block"), run))
    order = order[run[order] >= 0]
    b, run = b.take(pa.array(order)), run[order]
    named = b["trade_id"].is_valid().to_numpy()
    block, signal = number(b, "block"), number(a, "signal_block")
    base, span = (int(block.min()), int(block.max() - block.min()) + 2) if len(block) else (0, 2)
    line = run * span + (block - base)

    def until(x: np.ndarray) -> np.ndarray:
        """Place of the first print of an order's key from a block on."""
        return np.where(key < 0, 0, np.searchsorted(line, key * span + np.clip(x - base, 0, span - 1)))

    own_side, side = _coded(a["side"], b["side"])
    buy = a["side"].combine_chunks().fill_null("").to_numpy(zero_copy_only=False) == "BUY"
    (limit, limited), (size, sized), (price, priced), (volume, _) = _units(a["limit_price"]), _units(a["size"]), _units(b["price"]), _units(b["size"])
    positive = bool((volume >= 0).all())
    # prints of an order's own signal
    source_id, has_id = number(a, "source_trade_id"), a["source_trade_id"].is_valid().to_numpy()
    x, y = _matches(source_id[has_id], number(b, "trade_id")[named])
    u, v = _listed(a["source_logs"], b["logs"])
    source = np.unique(np.stack([np.concatenate([np.flatnonzero(has_id)[x], u]), np.concatenate([np.flatnonzero(named)[y], v])], 1), axis=0) if len(x) + len(u) else np.zeros((0, 2), np.int64)
    one = 10**10

    def inside(which: np.ndarray, prices: np.ndarray, good: np.ndarray) -> np.ndarray:
        return good & limited[which] & np.where(buy[which], prices <= limit[which], prices >= limit[which])

    def pairs(low: np.ndarray, high: np.ndarray, p: Profile) -> tuple[np.ndarray, np.ndarray]:
        """Orders and prints of a window: those that the profile lets count."""
        high = np.maximum(low, high)
        count = high - low
        own, at = np.repeat(np.arange(n), count), _within(low, high)
        keep = np.ones(len(at), bool) if p.any_side else (side[at] == own_side[own]) & (side[at] >= 0)
        if p.exclude_source and len(source):
            o, t = source.T
            hit = (t >= low[o]) & (t < high[o])
            keep[(np.cumsum(count) - count)[o[hit]] + t[hit] - low[o[hit]]] = False
        return own[keep], at[keep]

    def total(own: np.ndarray, values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([values[:0], [0], np.cumsum(values)]) if len(values) else np.zeros(1, np.int64)
        ends = np.searchsorted(own, np.arange(n + 1))
        return upto[ends[1:]] - upto[ends[:-1]]

    out = []
    for i, p in enumerate(profiles):
        arrival = signal + _blocks(p.latency_seconds, block_seconds)
        since = np.maximum(0, signal - back) if p.quote_ttl_seconds is None else np.maximum(np.maximum(0, signal - back), arrival - _blocks(p.quote_ttl_seconds, block_seconds))
        reason = np.full(n, -1)
        found = []
        multiple = int(Decimal(p.trailing_multiple) * 10)
        if p.need_quote or p.min_trailing > 0 or multiple != 0 or not positive:
            own, at = pairs(until(since), until(np.maximum(0, arrival)), p)
            if p.need_quote:
                last = np.full(n, -1)
                last[own[named[at]]] = at[named[at]]  # in order: the last one stays
                none = (last < 0) | ~np.concatenate([priced, [False]])[last]
                found += [none, ~none & limited & ~inside(np.arange(n), np.concatenate([price, [0]])[last], limited)]
            ok = inside(own, price[at], priced[at])
            own, at = own[ok], at[ok]
            trailing = total(own, volume[at])
            if not p.need_quote:
                found += [~limited, np.zeros(n, bool)]
            found += [np.bincount(own, minlength=n) < p.min_trailing, sized & (trailing * 10 < size * multiple)]
        else:
            found += [~limited, np.zeros(n, bool), np.zeros(n, bool), sized & (size * multiple > 0)]
        own, at = pairs(until(np.maximum(0, arrival)), until(arrival + _blocks(p.horizon_seconds, block_seconds) + 1), p)
        ok = inside(own, price[at], priced[at])
        own, at = own[ok], at[ok]
        buffer = int(Decimal(p.buffer).scaleb(10))
        ok = inside(own, np.clip(np.where(buy[own], price[at] + buffer, price[at] - buffer), 0, one), priced[at])
        own, at = own[ok], at[ok]
        found.append(np.bincount(own, minlength=n) < p.min_future)
        found.append(np.zeros(n, bool) if positive else total(own, volume[at]) < 0)
        may = size if most is None else np.minimum(size, most)
        found.append(sized & (may <= 0))
        for j in reversed(range(len(found))):
            reason[found[j]] = j
        rate = int(Decimal(p.rate).scaleb(4))
        share = np.where(volume >= 0, (volume * rate + 5000) // 10000, -((-volume * rate + 5000) // 10000))
        cap = total(own, share[at])
        may = np.where(sized, np.minimum(may, cap), cap if most is None else np.minimum(cap, most))
        out.append((reason, np.where(reason < 0, may, 0)))
    filled = np.concatenate([f for _, f in out])
    if filled.dtype == object:
        filled = pa.array([Decimal(int(x)).scaleb(-10) for x in filled], pa.decimal128(38, 10))
    else:
        filled = pa.Array.from_buffers(pa.decimal128(38, 10), len(filled), [None, pa.py_buffer(np.stack([filled, filled >> 63], 1).astype(np.int64).tobytes())])
    return pa.table({"order_index": pa.array(np.tile(number(a, "order_index"), len(profiles))), "profile": pa.array(np.repeat(np.arange(len(profiles)), n), pa.int32()), "reason": pa.array(np.concatenate([r for r, _ in out]), pa.int32()), "filled": filled})


def source_confirmed(orders: DataFrame, trades: DataFrame, *, rate: str, buffer: str) -> DataFrame:
    """Takers filled by later prints other than their own signal's: order_index, filled, status, trigger.

    Orders share the tape. Passive orders can't be confirmed. Orders have
    ``intent`` and ``source_trade_id`` besides the columns of ``shared_fills``.
    """
    takers = orders.where("intent = 'TAKER'")
    got = shared_fills(takers, trades, rate=rate, buffer=buffer).groupBy("order_index").agg(F.sum("qty").cast("decimal(38,10)").alias("filled"), F.min("block").alias("first_block"))
    rows = orders.join(got, "order_index", "left")
    filled = F.coalesce("filled", F.lit(0).cast("decimal(38,10)"))
    status = first_match([(F.col("intent") != "TAKER", "UNSUPPORTED"), (filled >= F.col("size"), "FILLED"), (filled > 0, "PARTIAL")], "NO_FILL")
    trigger = F.when(filled > 0, F.when(F.col("tif").isin(*IMMEDIATE), "ONE_SECOND_TAPE_PROXY").otherwise("FUTURE_SOURCE_TRADE"))
    return rows.select("order_index", filled.alias("filled"), status.alias("status"), trigger.alias("trigger"), "first_block")


def expected_fill(orders: DataFrame, priors: DataFrame, keys: list[str], *, strength: float, floor: str = "0.0001") -> DataFrame:
    """Expected fill of resting takers from a table of shrunk rates by nested keys: probability and size.

    The rate of the deepest level with enough rows is blended with its parent's by
    ``strength`` pseudo-counts; only GTC and GTD takers are supported. Priors: the
    keys (null above their level), n, rate.
    """
    rows = orders
    for depth in range(len(keys) + 1):
        own = priors.where(" and ".join([f"{k} is not null" for k in keys[:depth]] + [f"{k} is null" for k in keys[depth:]]) or "true")
        own = own.select(*[F.col(k).alias(f"_{k}{depth}") for k in keys[:depth]], F.col("n").alias(f"_n{depth}"), F.col("rate").alias(f"_rate{depth}"))
        rows = rows.join(own, [F.col(k) == F.col(f"_{k}{depth}") for k in keys[:depth]], "left") if depth else rows.crossJoin(F.broadcast(own))  # one row
    p = F.col("_rate0")
    for depth in range(1, len(keys) + 1):
        n = F.coalesce(F.col(f"_n{depth}"), F.lit(0))
        p = (n * F.coalesce(F.col(f"_rate{depth}"), F.lit(0.0)) + strength * p) / (n + strength)
    supported = (F.col("intent") == "TAKER") & F.col("tif").isin("GTC", "GTD")
    expected = F.when(supported, (F.col("size").cast("double") * p).cast("decimal(38,10)")).otherwise(F.lit(0).cast("decimal(38,10)"))
    status = F.when(~supported, "UNSUPPORTED").when(expected < F.lit(floor).cast("decimal(38,10)"), "NO_FILL").otherwise("EXPECTED")
    return rows.select("order_index", F.when(supported, p).alias("probability"), expected.alias("expected"), status.alias("status"))

