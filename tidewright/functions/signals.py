"""Calendar ratios, scores and verdicts of the daily signal, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import calendar as c

# Likelihood ratios by weekday (0 is Monday) and by week of the month.
WEEKDAY_RATIO = {0: 0.940, 1: 0.981, 2: 1.038, 3: 1.004, 4: 1.038}
MONTH_WEEK_RATIO = {1: 1.112, 2: 0.996, 3: 1.015, 4: 0.950, 5: 0.992}
# Tax days, tax-loss selling, days before Christmas, first days of a quarter.
TAX_DAY, BEFORE_TAX_DAY, TAX_LOSS, BEFORE_CHRISTMAS, QUARTER_START = 1.242, 1.068, 0.889, 1.147, 1.117
# Thanksgiving's eve and morrow, turn of the year, before and after a holiday.
EVE, MORROW, YEAR_TURN, BEFORE_HOLIDAY, AFTER_HOLIDAY = 1.457, 1.357, 1.105, 1.126, 1.111
# Ratios of the technical flags, on and off or above and below.
TREND, MOMENTUM, VOLATILITY, STRENGTH = (1.15, 0.85), (1.12, 0.90), (0.85, 1.10), (0.85, 1.10)
# Bounds of the flags and of the five tiers.
MOMENTUM_BOUND, VOLATILITY_BOUNDS, STRENGTH_BOUNDS = 0.05, (0.25, 0.15), (75, 35)
TIERS = {5: 0.80, 4: 0.60, 3: 0.40, 2: 0.20}


def by_key(key: Column, values: dict[int, float], other: float = 1.0) -> Column:
    out = F.lit(None).cast("double")
    for k, v in reversed(values.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return F.coalesce(out, F.lit(other))


def calendar_ratio(day: str) -> Column:
    """Ratio of tax days, year-end selling and quarter starts; the first that fits counts."""
    m, d = F.month(day), F.dayofmonth(day)
    return (
        F.when((m == 4) & (d == 15), TAX_DAY)
        .when((m == 4) & (d <= 14), BEFORE_TAX_DAY)
        .when(m == 4, 1.0)
        .when((m == 12) & d.between(11, 15), TAX_LOSS)
        .when((m == 12) & d.between(21, 25), BEFORE_CHRISTMAS)
        .when(m.isin(1, 7, 10) & (d <= 5), QUARTER_START)
        .otherwise(1.0)
    )


def near_holiday(day: str, first: int, last: int) -> Column:
    """Whether a holiday lies ``first`` to ``last`` days after the day (before it, if negative)."""
    year = F.year(day)
    around = F.concat(c.us_holidays(year - 1), c.us_holidays(year), c.us_holidays(year + 1))
    return F.exists(around, lambda h: F.datediff(h, F.col(day)).between(first, last))


def holiday_ratio(day: str) -> Column:
    """Ratio of days around holidays; the first case that fits counts."""
    thanks = c.nth_weekday(F.year(day), 11, 3, 4)
    m, d = F.month(day), F.dayofmonth(day)
    return (
        F.when(F.col(day) == F.date_sub(thanks, 1), EVE)
        .when(F.col(day) == F.date_add(thanks, 1), MORROW)
        .when(((m == 12) & (d >= 26)) | ((m == 1) & (d <= 3)), YEAR_TURN)
        .when(near_holiday(day, 1, 3), BEFORE_HOLIDAY)
        .when(near_holiday(day, -3, -1), AFTER_HOLIDAY)
        .otherwise(1.0)
    )


def calendar_ratios(day: str) -> list[Column]:
    """Weekday, week of month, holiday and calendar ratios of a day."""
    return [by_key(F.weekday(day), WEEKDAY_RATIO), by_key(c.week_of_month(day), MONTH_WEEK_RATIO), holiday_ratio(day), calendar_ratio(day)]


def above_below(x: str, above: float, below: float, ratios: tuple[float, float]) -> Column:
    """A ratio above one bound, another below the other, 1 between them or without a value."""
    return F.when(F.col(x) > above, ratios[0]).when(F.col(x) < below, ratios[1]).otherwise(1.0)


def probability(prior: Column, ratios: list[Column]) -> Column:
    """A clipped prior and ratios combined as log odds, clipped."""
    prior = F.least(F.greatest(prior, F.lit(0.02)), F.lit(0.98))
    odds = F.ln(prior / (1 - prior))
    for x in ratios:
        odds = odds + F.ln(F.greatest(x, F.lit(0.01)))
    return F.least(F.greatest(1 / (1 + F.exp(-odds)), F.lit(0.02)), F.lit(0.98))


def tier(p: Column) -> Column:
    out = F.lit(1)
    for t, bound in reversed(TIERS.items()):
        out = F.when(p >= bound, t).otherwise(out)
    return out


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


# Monthly priors and weekday bonuses of the buy score.
BUY_PRIOR = {1: 0.62, 2: 0.54, 3: 0.62, 4: 0.80, 5: 0.58, 6: 0.40, 7: 0.80, 8: 0.54, 9: 0.45, 10: 0.62, 11: 0.80, 12: 0.74}
BUY_WEEKDAY = {0: -0.02, 1: 0.01, 2: 0.01, 3: 0.02, 4: 0.01}


def buy_score(day: str) -> Column:
    """0 to 100 from month, weekday and the ends of the month."""
    dom = F.dayofmonth(day)
    bonus = F.when(dom <= 3, 0.03).when(dom >= 28, 0.02).otherwise(0.0)
    return clipped(by_key(F.month(day), BUY_PRIOR, 0.60) + by_key(F.weekday(day), BUY_WEEKDAY, 0.0) + bonus, 0.05, 0.95) * 100


def sell_score(day: str, strength: Column, mom20: Column, mom60: Column, death_cross: Column, volatility_rank: Column) -> Column:
    """0 to 100: strength, falling momentum, crossed means, volatility and weak months."""
    month = by_key(F.month(day), {6: 5.0, 8: 2.0, 9: 5.0}, 0.0)
    parts = [clipped((strength - 50) / 50 * 25, 0, 25), clipped(-mom20 * 100, 0, 20), clipped(-mom60 * 50, 0, 15)]
    total = parts[0] + parts[1] + parts[2] + F.when(death_cross, 20.0).otherwise(0.0) + clipped(volatility_rank * 15, 0, 15) + month
    return clipped(total, 0, 100)


def sell_tier(score: Column) -> Column:
    return F.when(score >= 70, "sell").when(score >= 55, "reduce").when(score >= 40, "caution").when(score >= 25, "watch").otherwise("hold")


def offering_tier(curated: Column, home_value: Column, blank_check: Column, amount: Column, parsed: Column, foreign: Column) -> Column:
    """Tier of an offering; an amount counts only if it was parsed."""
    known = F.when(parsed, amount)
    return (
        F.when(curated | F.coalesce(home_value >= 20, F.lit(False)), "major")
        .when(blank_check, "rest")
        .when(known >= 1000, "major")
        .when(known >= 300, "notable")
        .when(foreign & known.isNull(), "notable")
        .otherwise("rest")
    )


def form_stage(form: Column) -> Column:
    """Stage of a filing by its form, null for forms that mark none."""
    f = F.upper(F.coalesce(form, F.lit("")))
    return F.when(f.rlike("^[SF]-1(/|$)"), "filed").when(f.startswith("424B"), "priced").when(f.startswith("8-A12B"), "listed")


def stage_rank(stage: Column) -> Column:
    return F.when(stage == "filed", 1).when(stage == "priced", 2).when(stage == "listed", 3)


def auc_verdict(model: Column, base: Column) -> Column:
    return F.when(model.isNull() | base.isNull(), "missing").when(model < base - 0.015, "loses").when(model > base + 0.015, "beats").otherwise("ties")


def gain_verdict(gain: Column) -> Column:
    return F.when(gain.isNull(), "missing").when(gain < -0.02, "loses").when(gain > 0.02, "beats").otherwise("ties")


def difference_verdict(diff: Column, p: Column) -> Column:
    sure = F.coalesce(p < 0.10, F.lit(False))
    return F.when(diff.isNull(), "missing").when(diff < 0, "loses").when((diff > 0) & sure, "beats").otherwise("ties")


def forward_verdict(enough: Column, delta: Column) -> Column:
    """Too few rows are never a loss."""
    return F.when(~enough, "insufficient").when(delta.isNull(), "missing").when(delta > 0, "beats").when(delta < 0, "loses").otherwise("ties")


def out_of_sample(full_sign: Column, sign: Column, p: Column, confirm: float = 0.10, overturn: float = 0.20) -> Column:
    """State after an anchor: confirmed, overturned, neutral between the two bounds, pending without a p-value.

    Without a direction (null ``full_sign``) only the p-value counts; else the
    other direction overturns whatever the p-value.
    """
    by_p = F.when(p < confirm, "confirmed").when(p > overturn, "overturned").otherwise("neutral")
    turned = full_sign.isNotNull() & ~sign.eqNullSafe(full_sign)
    return F.when(p.isNull(), "pending").when(turned, "overturned").otherwise(by_p)


def promotion(member: Column, verdict: Column, state: Column) -> Column:
    """``promote``, ``demote`` or null for a candidate."""
    return F.when(~member & (verdict == "survives") & (state == "confirmed"), "promote").when(member & (state == "overturned"), "demote")
