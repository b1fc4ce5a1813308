"""Numeric guards, buckets, decays and prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bounded value; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def finite_or(x: Column, default: float | None, above: float | None = None, below: float | None = None) -> Column:
    """NaN and null to ``default``, infinities to their own bounds (or the default)."""
    fallback = F.lit(default)
    high = fallback if above is None else F.lit(above)
    low = fallback if below is None else F.lit(below)
    return (
        F.when(x.isNull() | F.isnan(x), fallback)
        .when(x == float("inf"), high)
        .when(x == float("-inf"), low)
        .otherwise(x)
    )


def safe_ratio(num: Column, den: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def decayed(x: Column, frac_left: Column, power: float | Column) -> Column:
    """A pregame quantity scaled by the remaining share of the game to a power."""
    return x * F.pow(frac_left, F.lit(power) if isinstance(power, (int, float)) else power)


def season_weight(season: Column, newest: Column, decay: float) -> Column:
    return F.pow(F.lit(decay), (newest - season).cast("double"))


def floored_rate(total: Column, base: Column, share: Column, floor: float = 0.02) -> Column:
    """total / (base * share), only once more than ``floor`` of the share has passed."""
    return F.when(share > floor, F.try_divide(total.cast("double"), base * share))


def per_root_second(x: Column, seconds: Column) -> Column:
    """x over the square root of the seconds left (at least one); x itself when none are left."""
    return F.when(seconds > 0, x / F.sqrt(F.greatest(seconds, F.lit(1.0)))).otherwise(x.cast("double"))


def bucket_left(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of [edge i, edge i+1); null outside."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        test = (x >= lo) & (x < hi)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def bucket_right(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of (edge i, edge i+1]; null outside."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        test = (x > lo) & (x <= hi)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """Index of the left-closed bin holding x; null outside the edges."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        test = (x >= lo) & (x < hi)
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return out


def clipped_bin_index(x: Column, edges: Sequence[float]) -> Column:
    """Index of the left-closed bin, values outside snapped to the first or last bin."""
    last = len(edges) - 2
    out = F.lit(0)
    for i in range(1, last + 1):
        out = F.when(x >= edges[i], F.lit(i)).otherwise(out)
    return F.when(x.isNotNull(), out)


def american_probability(odds: Column) -> Column:
    """Implied probability of American odds."""
    return F.when(odds < 0, -odds / (-odds + 100.0)).otherwise(100.0 / (odds + 100.0))


def devigged(home: Column, away: Column) -> tuple[Column, Column]:
    """(home probability scaled to sum to one, overround)."""
    total = home + away
    return F.when(total > 0, home / total), total - 1.0


def dollars_to_cents(text: Column) -> Column:
    return text.try_cast("double") * 100.0


def home_price(yes_cents: Column, is_home_yes: Column) -> Column:
    """The YES price restated for the home side."""
    return F.when(is_home_yes == 1, yes_cents).otherwise(100.0 - yes_cents)


def taker_fee(contracts: Column, price: Column) -> Column:
    """Order-level exchange fee, rounded up to the cent; price in dollars."""
    return F.ceil(F.lit(0.07) * contracts * price * (1.0 - price) * 100.0) / 100.0
