"""Scores, tiers and keys as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shrink(ratio: Column | str, n: Column | str, k: float) -> Column:
    """A likelihood ratio drawn towards 1, the more the fewer rows it rests on."""
    return 1 + (_col(ratio) - 1) * _col(n) / (_col(n) + F.lit(float(k)))


def posterior(prior: float, ratios: Column, floor: float = 0.01, low: float = 0.02, high: float = 0.98) -> Column:
    """Probability after folding an array of likelihood ratios into a prior."""
    start = F.ln(F.lit(prior / (1 - prior)))
    odds = F.aggregate(ratios, start, lambda acc, x: acc + F.ln(F.greatest(x, F.lit(floor))))
    return F.least(F.greatest(1 / (1 + F.exp(-odds)), F.lit(low)), F.lit(high))


def complement(ratio: Column, share: Column, floor: float = 0.5) -> Column:
    """The ratio where a flag is off, by total probability, given the share of rows where it is on."""
    return F.greatest(F.try_divide(1 - ratio * share, 1 - share), F.lit(floor))


def tier(score: Column | str, least: Mapping[str, float], other: str) -> Column:
    """The first name whose bound the score reaches."""
    out = None
    for name, bound in least.items():
        hit = _col(score) >= bound
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def scale(x: Column | str, low: float, high: float, reverse: bool = False) -> Column:
    """Linear scale from 0 at ``low`` to 100 at ``high``, clipped."""
    out = F.least(F.greatest((_col(x) - low) / (high - low) * 100, F.lit(0.0)), F.lit(100.0))
    return 100 - out if reverse else out


def band(score: Column) -> Column:
    """Sentiment band of a 0-100 score; the upper edges 25, 45 and 55 belong to the band below."""
    return (
        F.when(score <= 25, "extreme fear").when(score <= 45, "fear").when(score <= 55, "neutral").when(score < 75, "greed").otherwise("extreme greed")
    )


def row_mean(*subs: Column, least: int = 2) -> Column:
    """Mean of the non-null sub-scores, null with fewer than ``least``."""
    known = F.array_compact(F.array(*subs))
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(known) >= least, total / F.size(known))


def stable_id(family: str, key: str) -> Column:
    """Three letters of the family and ten hex digits of a hash of family and key."""
    return F.concat(F.substring(family, 1, 3), F.lit("_"), F.substring(F.sha1(F.concat(F.col(family), F.lit("|"), F.col(key).cast("string"))), 1, 10))


def company_name(name: str) -> Column:
    """Upper case without punctuation and without legal suffixes at the end."""
    plain = F.regexp_replace(F.upper(F.col(name)), "[^A-Z0-9 ]", " ")
    return F.trim(F.regexp_replace(plain, r"( (INC|CORP|LTD|CO|PLC))+\s*$", ""))


def polarity(text: str, up: str, down: str) -> Column:
    ups, downs = F.regexp_count(F.col(text), F.lit(up)), F.regexp_count(F.col(text), F.lit(down))
    return F.when(ups > downs, "positive").when(downs > ups, "negative").otherwise("neutral")


def inverse_weights(volatility: str, power: float, floor: float) -> Column:
    """Shares of the inverse volatility to a power, over all rows."""
    w = F.pow(1 / F.greatest(F.col(volatility), F.lit(floor)), F.lit(power))
    return w / F.sum(w).over(Window.partitionBy())


def after_tax_gain(gain: Column, months_held: Column, rate: float, levy: float = 0.02, discount: float = 0.5) -> Column:
    """Gain after tax; held for a year or more, only the discounted part is taxed."""
    taxed = F.when(months_held >= 12, gain * (1 - discount)).otherwise(gain)
    return gain - F.greatest(taxed, F.lit(0.0)) * (rate + levy)


def currency_return(exit_price: Column, entry_price: Column, exit_rate: Column, entry_rate: Column) -> Column:
    """Return in home currency of a position priced abroad; rates are foreign units per home unit."""
    return F.try_divide(exit_price, entry_price) * F.try_divide(entry_rate, exit_rate) - 1


def weighted_mean(values: list[Column], weights: list[float]) -> Column:
    """Mean of the non-null values by their weights."""
    total = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in zip(values, weights)), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(values, weights)), F.lit(0.0))
    return F.try_divide(total, weight)


def stance(score: str) -> Column:
    """Five stances; both 0.13 edges are neutral."""
    x = F.col(score)
    return F.when(x > 0.4, "strong").when(x > 0.13, "positive").when(x >= -0.13, "neutral").when(x >= -0.4, "cautious").otherwise("defensive")


def interpolate(x: str, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the points, level beyond the first and last."""
    v = F.col(x)
    out = F.when(v <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(v <= x1, y0 + (v - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(F.lit(float(points[-1][1])))
