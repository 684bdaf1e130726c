"""Token ids, and the state, tier and score of a market or token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import first_match

# States of a book and the domains that come first.
READY_BOOK = ["ok", "ready", "ready_high", "ready_medium", "live"]
KNOWN_BOOK = [*READY_BOOK, "one_sided", "empty", "stale", "gap", "disconnected"]
NO_BOOK = ["no_clob_book", "not_found", "404"]
PRIORITY_DOMAINS = ["crypto", "btc", "eth", "sol", "sports", "nba", "fifa", "macro"]


def token_hex(token: Column) -> Column:
    """A token id as 64 hex digits: hex ids as they are, decimal ones converted; null for anything else.

    Ids have 256 bits. The decimal digits are taken nine at a time into eight
    32-bit limbs (and a ninth that must stay empty), all inside the JVM.
    """
    text = F.regexp_replace(F.lower(F.trim(token.cast("string"))), "^0x", "")
    grouped = F.regexp_extract_all(F.lpad(text, (F.ceil(F.length(text) / 9) * 9).cast("int"), "0"), F.lit("[0-9]{9}"), F.lit(0))

    def shift(limbs: Column, group: Column) -> Column:
        start = F.struct(group.cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        total = lambda s, x: x * 1000000000 + s["carry"]
        return F.aggregate(limbs, start, lambda s, x: F.struct(F.shiftright(total(s, x), 32).alias("carry"), F.array_append(s["out"], total(s, x).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("out")), lambda s: s["out"])

    limbs = F.aggregate(grouped, F.array_repeat(F.lit(0).cast("long"), 9), shift)
    digits = F.array_join(F.reverse(F.transform(F.slice(limbs, 1, 8), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))), "")
    fits = F.element_at(limbs, 9) == 0
    return F.when(text.rlike("^[0-9a-f]{64}$"), text).when(text.rlike("^[0-9]{1,78}$"), F.when(fits, digits))


def frontend_tier(*, target: Column, trades: Column, active: Column, closed: Column, ends: Column, short_crypto: Column, now: int, recent_days: int, worth_trades: int, defer: bool) -> Column:
    """How much of a token's price history to build; ``ends`` and ``now`` in seconds, ``ends`` null if open."""
    open_ = F.coalesce(active, F.lit(False)) & ~F.coalesce(closed, F.lit(False))
    count = F.coalesce(trades, F.lit(0))
    return first_match(
        [
            (target, "target_full"), ((count <= 0) & (~open_ | (ends < now)), "skipped_no_orderfilled"), (count <= 0, "waiting_no_orderfilled"), (short_crypto, "crypto_short_full"), (open_, "active_full"),
            (ends >= now - recent_days * 86400, "recent_full"), (count >= worth_trades, "backtest_value_full"), (F.lit(defer), "deferred_low_value"), (ends.isNotNull(), "longtail_event_window"),
        ],
        "backtest_value_full",
    )


def metadata_blockers(t: dict[str, Column], *, min_tokens: int = 2) -> Column:
    """Why a token can't be subscribed to, in order, joined by commas; empty if it can."""
    rules = [
        (t["asset_id"].isNull(), "missing_asset_id"), (t["market_id"].isNull() & t["condition_id"].isNull(), "missing_market_id"), (t["condition_id"].isNull(), "missing_condition_id"), (t["placeholder"], "placeholder_market"),
        (t["tokens"] < min_tokens, "insufficient_token_mapping"), (~t["active"], "inactive_token"), (t["closed"], "closed_market"), (t["resolved"], "resolved_market"), (t["archived"], "archived_market"),
    ]
    return F.concat_ws(",", *[F.when(rule, label) for rule, label in rules])


def book_blocker(status: Column, age_ms: Column, bid: Column, ask: Column, *, ttl_seconds: int = 900) -> Column:
    """Why a book can't be traded on; null if it can."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return first_match(
        [
            (s.isin(NO_BOOK), "no_clob_book"), (s == "probe_error", "book_probe_error"), (age_ms.isNull(), "no_book_snapshot"), (s.isin("stale", "gap"), s), (s == "disconnected", "book_disconnected"), (age_ms > ttl_seconds * 1000, "stale_book"),
            ((s == "one_sided"), "missing_two_sided_quotes"), (s.isin(KNOWN_BOOK) & ~s.isin(READY_BOOK), "empty_book"), ((s != "") & ~s.isin(READY_BOOK), "bad_book_status"), (bid.isNull() | ask.isNull(), "missing_two_sided_quotes"),
        ]
    )


def lifecycle(blockers: Column, blocker: Column) -> Column:
    """The state of a token from what blocks its metadata and its book."""
    has = lambda *names: F.arrays_overlap(F.split(blockers, ","), F.array(*map(F.lit, names)))
    return first_match(
        [
            (has("resolved_market"), "RESOLVED"), (has("closed_market", "inactive_token"), "CLOSING"), (has("archived_market"), "ARCHIVED"), (blockers != "", "DISCOVERED"), (blocker.isNull(), "LIVE"),
            (blocker.isin("stale", "gap", "book_disconnected", "stale_book"), "STALE"),
        ],
        "TRADABLE_PENDING_BOOK",
    )


def subscription_score(t: dict[str, Column]) -> Column:
    """Points of a token for live book maintenance; closed ones have -10000."""
    points = lambda rule, n: F.when(rule, n).otherwise(0)
    volume = F.least(F.lit(250), F.floor(F.greatest(t["volume"], F.lit(0)) / 1000).cast("int"))
    near = F.when(t["ends_in"].between(0, 3600), 100).when(t["ends_in"].between(0, 86400), 50).otherwise(0)
    total = (
        points(t["focused"], 1000) + points(t["strategy"], 700) + points(t["watched"], 400) + points(F.lower(F.trim(t["category"])).isin(PRIORITY_DOMAINS), 250) + F.coalesce(volume, F.lit(0))
        + F.least(F.lit(200), F.greatest(F.lit(0), F.coalesce(t["trades"], F.lit(0)))) + near + F.least(F.lit(150), F.greatest(F.lit(0), F.coalesce(t["recent"], F.lit(0))) * 5) - points(t["stale"], 200)
    )
    return F.when(t["closed"], F.lit(-10000)).otherwise(total).cast("int")


def subscription_tier(closed: Column, focused: Column, strategy: Column, score: Column) -> Column:
    return first_match([(closed, "P4"), (focused | strategy, "P0"), (score >= 650, "P1"), (score > 0, "P2")], "P3")
