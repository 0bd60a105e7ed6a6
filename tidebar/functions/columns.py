"""Null-safe numeric column helpers and rolling-window builders.

Spark runs with ANSI arithmetic: dividing by zero raises, ``ln`` of a non-positive number is NULL and
``greatest``/``least`` skip NULL. The helpers below keep NULL as NULL and follow IEEE rules where a
feature formula can meet a zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-9
CLIP = 10.0


def clip(x: Column, lo, hi) -> Column:
    """Bound x to [lo, hi]; NULL stays NULL and NaN stays NaN."""
    return F.when(x > F.lit(hi), F.when(F.isnan(x), x).otherwise(F.lit(hi))).when(x < F.lit(lo), F.lit(lo)).otherwise(x)


def bound(x: Column, lo, hi) -> Column:
    """Bound x to [lo, hi]; NULL stays NULL and NaN, above all numbers, becomes hi."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def floor_at(x: Column, lo=EPS) -> Column:
    """Raise x to at least lo; NULL stays NULL."""
    return F.when(x < F.lit(lo), F.lit(lo)).otherwise(x)


def clean(x: Column, fill: float = 0.0, lo: float = -CLIP, hi: float = CLIP) -> Column:
    """NaN and NULL become `fill`, then the value is bounded."""
    return F.least(F.greatest(F.coalesce(F.nanvl(x, F.lit(fill)), F.lit(fill)), F.lit(lo)), F.lit(hi))


def ln(x: Column) -> Column:
    """Natural log with IEEE results at and below zero."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def div(a: Column, b: Column) -> Column:
    """a / b with IEEE results for a zero divisor."""
    zero = (F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
            .when(a == 0, F.lit(float("nan"))))
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, zero)


def local_ts(ts: Column, tz: str) -> Column:
    """Wall-clock time in `tz` of a UTC timestamp (the session time zone must be UTC)."""
    return F.from_utc_timestamp(ts, tz)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def iso_weekday(ts: Column) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(ts) + 1


def hhmm(text: Column) -> Column:
    """'HH:MM' to minute of day."""
    return F.split(text, ":")[0].cast("int") * 60 + F.split(text, ":")[1].cast("int")


def money(text: Column) -> Column:
    """'$1,234.50' to a finite double, NULL for anything else."""
    value = F.regexp_replace(F.trim(text.cast("string")), "[$,]", "").try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def off_tick(price: Column, tick: Column, tol: float = 1e-7) -> Column:
    scaled = price / tick
    return F.abs(scaled - F.rint(scaled)) > tol


def expit(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def half_away(x: Column) -> Column:
    """The nearest whole number, halves away from zero, zero without a sign: the values of `round`, which goes through decimal text.

    `rint` takes halves to the even side; those that went towards zero get one more.
    """
    whole = F.rint(x)
    return whole + F.when(F.abs(x) - F.abs(whole) == 0.5, F.signum(x)).otherwise(F.lit(0.0))


def is_finite(x: Column) -> Column:
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def count_if(pred: Column) -> Column:
    """Rows where pred is true, as a bigint that is 0 (not NULL) on empty input."""
    return F.count(F.when(pred, F.lit(1)))


class Rolling:
    """Trailing ROWS frames over one ordered window.

    ``lagged=True`` moves the frame one row back, so it covers the `w` rows before the current one; that
    equals shifting the column first and saves a window pass.
    """

    def __init__(self, window: WindowSpec):
        self.window = window

    def frame(self, w: int, lagged: bool = False) -> WindowSpec:
        return self.window.rowsBetween(-w, -1) if lagged else self.window.rowsBetween(-(w - 1), 0)

    def agg(self, fn, x: Column, w: int, mp: int | None = None, lagged: bool = False) -> Column:
        over = self.frame(w, lagged)
        return F.when(F.count(x).over(over) >= (w if mp is None else mp), fn(x).over(over))

    def mean(self, x, w, mp=None, lagged=False):
        return self.agg(F.avg, x, w, mp, lagged)

    def sum(self, x, w, mp=None, lagged=False):
        return self.agg(F.sum, x, w, mp, lagged)

    def std(self, x, w, mp=None, lagged=False):
        return self.agg(F.stddev_samp, x, w, mp, lagged)

    def max(self, x, w, mp=None, lagged=False):
        return self.agg(F.max, x, w, mp, lagged)

    def min(self, x, w, mp=None, lagged=False):
        return self.agg(F.min, x, w, mp, lagged)

    def median(self, x, w, mp=None, lagged=False):
        return self.agg(lambda c: F.percentile(c, F.lit(0.5)), x, w, mp, lagged)

    def values(self, x, w, lagged=False) -> Column:
        """The frame's non-null values as an array; sort once, then pick several quantiles."""
        return F.collect_list(x).over(self.frame(w, lagged))

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.window)

    def lead(self, x: Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.window)


def nearest_quantile(sorted_values: Column, q: float, mp: int) -> Column:
    """Nearest-rank quantile of a sorted array (half positions go up), NULL below `mp` values."""
    n = F.size(sorted_values)
    at = F.floor((n - 1) * F.lit(q) + F.lit(0.5)).cast("int") + 1
    return F.when(n >= mp, F.try_element_at(sorted_values, at))


def cols(names) -> list[Column]:
    """Column references by exact name; feature names may hold dots."""
    return [F.col(f"`{c}`") for c in names]


def symbol_window(*keys: str, ts: str = "ts_event") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)
