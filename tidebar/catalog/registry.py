"""Query registry and the small SQL vocabulary the comparison queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.columns import half_away

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6
#: Bytecodes of a method above which HotSpot leaves it uncompiled; Spark then projects wide rows by smaller methods.
HUGE_METHOD = 8000


def query(name: str, sql: str | None = None):
    """Register a Spark query and, when it can be written as SQL, its counterpart."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(HUGE_METHOD))
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r(x: Column | str, digits: int = DIGITS) -> Column:
    """Rounded as SQL does it: the scaled double to a whole number, halves away from zero, and scaled back."""
    x, scale = (F.col(x) if isinstance(x, str) else x).cast("double"), F.lit(10.0 ** digits)
    return half_away(x * scale) / scale


def stamp(c: str = "ts_event") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("ts" if c == "ts_event" else c)


def show(df: DataFrame, *columns: str, keys=("symbol",), digits: int = DIGITS) -> DataFrame:
    """Keys, the timestamp as text and rounded value columns."""
    return df.select(*keys, stamp(), *[r(f"`{c}`", digits).alias(c) for c in columns])


# ---- SQL side -------------------------------------------------------------------------------------------------

def rs(x: str, digits: int = DIGITS) -> str:
    """Rounded; adding 0.0 turns negative zero into zero."""
    return f"(round(({x})::DOUBLE, {digits}) + 0.0)"


STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def fl(x: str) -> str:
    return f"(CASE WHEN ({x}) < 1e-9 THEN 1e-9 ELSE ({x}) END)"


def cl(x: str, lo: float = -10, hi: float = 10) -> str:
    """NULL and NaN to 0, then bounded."""
    return f"least(greatest(CASE WHEN ({x}) IS NULL OR isnan(({x})::DOUBLE) THEN 0 ELSE ({x}) END, {lo}), {hi})"


def bound(x: str, lo, hi) -> str:
    """Bounded, NULL stays NULL."""
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(({x}), {lo}), {hi}) END)"


def lnq(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) END)"


def over(frame: str = "", part: str = "symbol") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY ts {frame})"


def roll(agg: str, x: str, w: int, mp: int | None = None, lagged: bool = False, part: str = "symbol") -> str:
    a, b = (f"{w} PRECEDING", "1 PRECEDING") if lagged else (f"{w - 1} PRECEDING", "CURRENT ROW")
    frame = over(f"ROWS BETWEEN {a} AND {b}", part)
    fn = {"mean": "avg", "std": "stddev_samp", "sum": "sum", "max": "max", "min": "min", "median": "median"}[agg]
    return f"(CASE WHEN count({x}) {frame} >= {w if mp is None else mp} THEN {fn}({x}) {frame} END)"


def lag(x: str, n: int = 1, part: str = "symbol") -> str:
    return f"lag({x}, {n}) {over(part=part)}"


def lead(x: str, n: int = 1, part: str = "symbol") -> str:
    return f"lead({x}, {n}) {over(part=part)}"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def out(source: str, columns: dict[str, str], keys: str = "symbol") -> str:
    body = ",\n  ".join(f"{rs(*x) if isinstance(x, tuple) else rs(x)} AS {name}" for name, x in columns.items())
    return f"SELECT {keys}, {STAMP},\n  {body}\nFROM {source}"
