"""Analytic functions over keyed, ordered series, as Column builders.

A ``Series`` names the partition keys and the order; every method returns a
Column for use in ``select`` or ``withColumn``.  A rolling value is null until
its frame holds the full number of non-null values.  Order keys must be unique
within a partition, else results depend on the order of ties.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


class Series:
    def __init__(self, keys: Sequence[str] = ("asset",), time: str = "date"):
        self.keys, self.time = list(keys), time

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.time)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.ordered.rowsBetween(start, end)

    def last(self, n: int) -> WindowSpec:
        """The current row and the n - 1 before it."""
        return self.rows(1 - n, 0)

    def ahead(self, h: int) -> WindowSpec:
        """The h rows after the current one."""
        return self.rows(1, h)

    @property
    def so_far(self) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, 0)

    def guarded(self, agg: Callable[[Column], Column], x: Column | str, frame: WindowSpec, n: int) -> Column:
        x = _col(x)
        return F.when(F.count(x).over(frame) >= n, agg(x).over(frame))

    # Changes

    def lagged(self, x: Column | str, k: int = 1) -> Column:
        return F.lag(_col(x), k).over(self.ordered)

    def change(self, x: Column | str, k: int = 1) -> Column:
        return F.try_divide(_col(x), self.lagged(x, k)) - 1

    def log_change(self, x: Column | str, k: int = 1) -> Column:
        return F.ln(_col(x)) - F.ln(self.lagged(x, k))

    def forward_change(self, x: Column | str, h: int) -> Column:
        return F.try_divide(F.lead(_col(x), h).over(self.ordered), _col(x)) - 1

    def forward_compound(self, r: Column | str, h: int) -> Column:
        """Compounded return of the next h rows, null where a row lacks."""
        return F.exp(self.guarded(F.sum, F.log1p(_col(r)), self.ahead(h), h)) - 1

    def skip_momentum(self, x: Column | str, skip: int, back: int) -> Column:
        return F.try_divide(self.lagged(x, skip), self.lagged(x, back)) - 1

    # Rolling statistics

    def mean(self, x: Column | str, n: int, least: int | None = None) -> Column:
        return self.guarded(F.avg, x, self.last(n), least or n)

    def total(self, x: Column | str, n: int) -> Column:
        return self.guarded(F.sum, x, self.last(n), n)

    def deviation(self, x: Column | str, n: int, least: int | None = None) -> Column:
        return self.guarded(F.stddev_samp, x, self.last(n), least or n)

    def volatility(self, r: Column | str, n: int, per_year: int = 252) -> Column:
        return self.deviation(r, n) * F.sqrt(F.lit(float(per_year)))

    def forward_volatility(self, r: Column | str, h: int, per_year: int = 252) -> Column:
        return self.guarded(F.stddev_samp, r, self.ahead(h), h) * F.sqrt(F.lit(float(per_year)))

    def z_score(self, x: Column | str, n: int) -> Column:
        """Distance from the rolling mean in population deviations."""
        spread = self.guarded(F.stddev_pop, x, self.last(n), n)
        return F.try_divide(_col(x) - self.mean(x, n), F.nullif(spread, F.lit(0.0)))

    def strength_index(self, step: Column | str, n: int = 14) -> Column:
        """RSI of a column of steps, from simple means of gains and losses."""
        step = _col(step)
        gain = self.mean(F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), n)
        loss = self.mean(F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))), n)
        return 100 - 100 / (1 + gain / (loss + 1e-10))

    def highest(self, x: Column | str, n: int) -> Column:
        return self.guarded(F.max, x, self.last(n), n)

    def lowest(self, x: Column | str, n: int) -> Column:
        return self.guarded(F.min, x, self.last(n), n)

    def correlation(self, x: Column | str, y: Column | str, n: int) -> Column:
        x, y = _col(x), _col(y)
        both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(self.last(n))
        return F.when(both >= n, F.corr(x, y).over(self.last(n)))

    # From the beginning

    def growth(self, r: Column | str) -> Column:
        """Value of one unit held from the first row."""
        return F.exp(F.sum(F.log1p(F.coalesce(_col(r), F.lit(0.0)))).over(self.so_far))

    def peak(self, x: Column | str) -> Column:
        return F.max(_col(x)).over(self.so_far)

    def drawdown(self, x: Column | str) -> Column:
        return F.try_divide(_col(x), self.peak(x)) - 1

    def filled(self, x: Column | str, limit: int | None = None) -> Column:
        """The last non-null value, at most ``limit`` rows old."""
        frame = self.so_far if limit is None else self.rows(-limit, 0)
        return F.last(_col(x), ignorenulls=True).over(frame)

    def position(self) -> Column:
        return F.row_number().over(self.ordered)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
