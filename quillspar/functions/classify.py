"""Buckets, ordered classifications, stable shards and text identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(x: Column, cuts: Sequence[tuple[float, str]], last: str) -> Column:
    """The label of the first cut that x is below."""
    out: Column | None = None
    for cut, label in cuts:
        out = F.when(x < cut, label) if out is None else out.when(x < cut, label)
    return F.when(x.isNull(), None).otherwise(out.otherwise(last))


def first_match(rules: Sequence[tuple[Column, str]], last: str | None = None) -> Column:
    """The label of the first rule that holds; rules that are null don't."""
    out = F.when(rules[0][0], rules[0][1])
    for rule, label in rules[1:]:
        out = out.when(rule, label)
    return out.otherwise(F.lit(last))


def price_bucket(p: Column, width: float = 0.05) -> Column:
    return F.floor(p.cast("double") / width).cast("int")


def liquidity(trades: Column, volume: Column) -> Column:
    """thin, medium, deep or very_deep by trades and volume together."""
    return first_match([((trades >= 1000) & (volume >= 100000), "very_deep"), ((trades >= 100) & (volume >= 10000), "deep"), ((trades >= 10) & (volume >= 1000), "medium")], "thin")


def dominant_side(buy: Column, sell: Column, share: float = 0.6) -> Column:
    """buy, sell or balanced by the share of volume; none without volume."""
    total = buy + sell
    return F.when(total <= 0, "none").when(buy.cast("double") >= share * total.cast("double"), "buy").when(sell.cast("double") >= share * total.cast("double"), "sell").otherwise("balanced")


def shard(key: Column, n: int) -> Column:
    """The first twelve hex digits of the key's sha256, modulo n: the same everywhere."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 12), 16, 10).cast("long"), F.lit(n))


def domain(text: Column) -> Column:
    """A market's domain from its title, by the first pattern that fits."""
    lowered = F.lower(text)
    return first_match(
        [
            (lowered.rlike(r"\b(btc|eth|bitcoin|ethereum|crypto|solana)\b"), "crypto"),
            (lowered.rlike(r"\b(nba|nfl|mlb|nhl|ufc|match|game|vs)\b"), "sports"),
            (lowered.rlike(r"\b(election|president|senate|vote|party)\b"), "politics"),
            (lowered.rlike(r"\b(fed|rate|rates|inflation|cpi|gdp)\b"), "economy"),
        ],
        "other",
    )


def sides(title: Column) -> Column:
    """(left, right) of a title of the form "X vs Y"; nulls otherwise."""
    return F.struct(F.nullif(F.regexp_extract(title, r"^(.*?)\s+vs\.?\s+(.*)$", 1), F.lit("")).alias("left"), F.nullif(F.regexp_extract(title, r"^(.*?)\s+vs\.?\s+(.*)$", 2), F.lit("")).alias("right"))


def fill_key(*parts: Column) -> Column:
    """Non-empty parts joined by pipes."""
    return F.concat_ws("|", *[F.when(p.cast("string") != "", p.cast("string")) for p in parts])


def tree(asset_price: Column, outcome: Column) -> Column:
    """The YES-side probability of either outcome's price."""
    return F.when(outcome == "NO", 1 - asset_price).otherwise(asset_price)
