"""Exact numerics: decimal quanta, truncating fees, closed-form statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A price lies in [0, 1]; with these two types price * size is exact in decimal(38,20).
PRICE = "decimal(11,10)"
SIZE = "decimal(26,10)"
WIDE = "decimal(38,10)"
#: The two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def q10(x: Column) -> Column:
    """Rounded half up to ten places."""
    return x.cast(WIDE)


def ratio(top: Column, bottom: Column) -> Column:
    """A double from one division; null where the bottom is 0 or null."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def fee(shares: Column, price: Column, rate: Column, taker_only: Column | None = None, maker: Column | None = None) -> Column:
    """shares * rate * price * (1 - price), cut after five places; makers are free where only takers pay.

    Worked out in decimals that keep every digit of a price and a rate of four
    places, so cutting never sees a rounded product.
    """
    one = F.lit(1).cast("decimal(11,10)")
    spread = (price.cast(PRICE) * (one - price.cast(PRICE)).cast(PRICE)).cast("decimal(21,20)")
    raw = (shares.cast("decimal(16,2)") * rate.cast("decimal(5,4)")).cast("decimal(20,6)").cast("double") * spread.cast("double")
    cut = F.floor(raw * 100000 + F.lit(1e-7)).cast("decimal(18,0)")
    out = (cut * F.lit("0.00001").cast("decimal(6,5)")).cast("decimal(18,5)")
    if taker_only is None or maker is None:
        return out
    return F.when(taker_only & maker, F.lit(0).cast("decimal(18,5)")).otherwise(out)


def wilson(successes: Column, n: Column, upper: bool) -> Column:
    """An end of the Wilson interval; null without trials."""
    p = successes.cast("double") / n
    z2 = Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    radius = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, centre + radius if upper else centre - radius)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -40.0, 40.0)))


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots (x ascending), flat beyond both ends."""
    out = F.lit(float(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = F.when(x >= x0, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x >= knots[-1][0], F.lit(float(knots[-1][1]))).otherwise(out)


def index_percentile(sorted_values: Column, q: float) -> Column:
    """The element at the half-up rounded index q * (n - 1); null of an empty array."""
    at = F.floor(F.lit(q) * (F.size(sorted_values) - 1) + 0.5).cast("int")
    return F.when(F.size(sorted_values) > 0, F.element_at(sorted_values, at + 1))


def upper_median(sorted_values: Column) -> Column:
    return F.when(F.size(sorted_values) > 0, F.element_at(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int") + 1))
