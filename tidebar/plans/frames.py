"""Rolling aggregates and exponential means with work per row that does not grow with the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

DIRECT_ROWS = 10
MAX_PARTS = 8


def chain(w: int) -> list[int]:
    """Widths to build a w-row frame from: a narrow first frame, then multiples of the width before."""
    if w > DIRECT_ROWS:
        for parts in range(2, MAX_PARTS + 1):
            if w % parts == 0 and w // parts > 1:
                return [*chain(w // parts), w]
    return [w]


class FrameAggs:
    """Collects rolling aggregates of one ordered window and adds them together.

    Spark recomputes a sliding frame from its rows at every row, so a 60-row frame costs 60 updates. Here only
    narrow frames are evaluated that way. A 15-row sum is the 5-row sum here, five and ten rows earlier; a
    60-row one is two 30-row ones. Deviations merge (count, mean, squared deviations) of the parts, extremes
    take the extreme of the parts; nothing is subtracted, so no precision is lost. All steps share one
    partitioning and sort. Frames that end before the current row are the trailing frame one row earlier.
    """

    def __init__(self, window: WindowSpec):
        self.window = window
        self.scratch: dict[str, Column] = {}
        self.wanted: dict[tuple[str, str, int, bool], None] = {}

    def get(self, agg: str, column: str, w: int, mp: int | None = None, lagged: bool = False) -> Column:
        """The aggregate, NULL while the frame holds fewer than `mp` (default: w) non-null values."""
        if agg == "median":
            over = self.window.rowsBetween(-w, -1) if lagged else self.window.rowsBetween(-(w - 1), 0)
            self.scratch[_name("median", column, w, lagged)] = F.percentile(F.col(column), F.lit(0.5)).over(over)
        else:
            self.wanted[(agg, column, w, lagged)] = None
        self.wanted[("count", column, w, lagged)] = None
        return F.when(F.col(_name("count", column, w, lagged)) >= (w if mp is None else mp), F.col(_name(agg, column, w, lagged)))

    def apply(self, df: DataFrame) -> DataFrame:
        stats = {"count": ("n",), "sum": ("s",), "mean": ("s", "n"), "std": ("n", "m", "q"), "max": ("max",), "min": ("min",)}
        parts = dict.fromkeys((stat, column, w) for agg, column, w, _ in self.wanted for stat in stats[agg])
        steps: list[dict[int, dict[tuple[str, str], None]]] = []
        for stat, column, w in parts:
            for depth, width in enumerate(chain(w)):
                while len(steps) <= depth:
                    steps.append({})
                steps[depth].setdefault(width, {})[(stat, column)] = None

        first = dict(self.scratch)
        for width, items in steps[0].items() if steps else ():
            over = self.window.rowsBetween(-(width - 1), 0)
            for stat, column in items:
                first[f"_{stat}_{column}_{width}"] = _first(stat, F.col(column), over)
        df = df.withColumns(first) if first else df

        for depth in range(1, len(steps)):
            lags, merged, spread = {}, {}, {}
            for width, items in steps[depth].items():
                before = chain(width)[-2]
                for stat, column in items:
                    base = f"_{stat}_{column}_{before}"
                    for i in range(1, width // before):
                        lags[f"{base}_at{i}"] = F.lag(base, i * before).over(self.window)
                    into = spread if stat == "q" else merged
                    into[f"_{stat}_{column}_{width}"] = _merge(stat, column, before, width // before, width)
            df = df.withColumns(lags).withColumns(merged)
            df = df.withColumns(spread) if spread else df

        final = {}
        for agg, column, w, _ in self.wanted:
            if agg == "mean":
                final[_name(agg, column, w)] = F.try_divide(F.col(f"_s_{column}_{w}"), F.col(f"_n_{column}_{w}"))
            elif agg == "std":
                n, q = F.col(f"_n_{column}_{w}"), F.col(f"_q_{column}_{w}")
                final[_name(agg, column, w)] = F.when(n > 1, F.sqrt(q / F.greatest(n - 1, F.lit(1))))
            else:
                stat = {"count": "n", "sum": "s"}.get(agg, agg)
                final[_name(agg, column, w)] = F.col(f"_{stat}_{column}_{w}")
        df = df.withColumns(final)
        moved = {_name(agg, column, w, True): F.lag(_name(agg, column, w)).over(self.window)
                 for agg, column, w, lagged in self.wanted if lagged}
        return df.withColumns(moved) if moved else df


def _name(agg: str, column: str, w: int, lagged: bool = False) -> str:
    return f"_{agg}_of_{column}_{w}{'_lag' if lagged else ''}"


def _first(stat: str, x: Column, over: WindowSpec) -> Column:
    if stat == "n":
        return F.count(x).over(over)
    if stat == "s":
        return F.sum(x.cast("double")).over(over)
    if stat == "m":
        return F.avg(x).over(over)
    if stat == "q":
        return F.var_pop(x).over(over) * F.count(x).over(over)
    return (F.max if stat == "max" else F.min)(x).over(over)


def _merge(stat: str, column: str, before: int, parts: int, width: int) -> Column:
    """One statistic of a frame from the statistics of its equal parts. Written as SQL text: wide plans hold
    hundreds of these, and one parsed string is far cheaper to send than a tree of column calls."""

    def every(name):
        base = f"_{name}_{column}_{before}"
        return [f"`{base}`", *[f"`{base}_at{i}`" for i in range(1, parts)]]

    def total(values):
        return "(" + " + ".join(f"coalesce({v}, 0)" for v in values) + ")"

    if stat in ("max", "min"):
        return F.expr(f"{'greatest' if stat == 'max' else 'least'}({', '.join(every(stat))})")
    if stat in ("n", "s"):
        return F.expr(total(every(stat)))
    counts, means = every("n"), every("m")
    if stat == "m":
        return F.expr(f"try_divide({total(f'{n} * {m}' for n, m in zip(counts, means))}, {total(counts)})")
    gap = [f"{n} * ({m} - `_m_{column}_{width}`) * ({m} - `_m_{column}_{width}`)" for n, m in zip(counts, means)]
    return F.expr(f"{total(every('q'))} + {total(gap)}")


EMA_TAIL = 1e-18


def ema_levels(span: int) -> int:
    """Doubling steps after which the remaining weight is below double precision."""
    decay, levels = 1.0 - 2.0 / (span + 1), 0
    while decay ** (2 ** levels) > EMA_TAIL:
        levels += 1
    return levels


def ema_lookback(span: int) -> int:
    return 2 ** ema_levels(span)


def add_ema(df: DataFrame, window: WindowSpec, specs: dict[str, tuple[Column, int]]) -> DataFrame:
    """Exponential means (adjust=False) by doubling: {name: (column, span)}.

    e(t) is the sum of decay^i * y(t-i) with y = alpha * x, and y = x on the first row. A sum over 2n terms is
    the sum over n terms plus decay^n times the same sum n rows earlier, so log2(n) lags replace a row-by-row
    recursion. All lags share one partitioning and sort.
    """
    first = F.row_number().over(window) == 1
    df = df.withColumns({name: F.when(first, x).otherwise(x * F.lit(2.0 / (span + 1)))
                         for name, (x, span) in specs.items()})
    for level in range(max(ema_levels(span) for _, span in specs.values())):
        step = {}
        for name, (_, span) in specs.items():
            weight = (1.0 - 2.0 / (span + 1)) ** (2 ** level)
            if weight > EMA_TAIL:
                earlier = F.coalesce(F.lag(name, 2 ** level).over(window), F.lit(0.0))
                step[name] = F.col(name) + F.lit(weight) * earlier
        df = df.withColumns(step)
    return df
