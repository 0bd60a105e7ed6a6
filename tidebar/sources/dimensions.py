"""Market, session and roll dimension tables.

The values are fixed facts about the traded contracts and their calendars; every table is a few dozen rows,
so joins against them are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Symbol, contract multiplier, tick size, max leverage, max position size.
MARKETS = (
    ("CL", 1000.0, 0.01, 2.0, 30.0),
    ("ES", 50.0, 0.25, 3.0, 50.0),
    ("GC", 100.0, 0.1, 2.5, 40.0),
    ("HG", 25000.0, 0.0005, 2.5, 35.0),
    ("MES", 5.0, 0.25, 1.0, 10.0),
    ("NG", 10000.0, 0.001, 1.5, 20.0),
    ("NQ", 20.0, 0.25, 2.5, 30.0),
    ("RTY", 50.0, 0.1, 2.0, 30.0),
    ("SI", 5000.0, 0.005, 2.0, 25.0),
    ("YM", 5.0, 1.0, 3.0, 50.0),
    ("ZB", 1000.0, 0.03125, 2.5, 20.0),
    ("ZN", 1000.0, 0.015625, 4.0, 60.0),
    ("ZT", 2000.0, 0.0078125, 5.0, 80.0),
)

# Tick sizes the raw-data audit checks prices against.
AUDIT_TICKS = {
    "CL": 0.01, "ES": 0.25, "GC": 0.10, "HG": 0.0005, "NG": 0.001, "NQ": 0.25, "RTY": 0.10, "SI": 0.005,
    "YM": 1.0, "ZB": 1.0 / 32.0, "ZC": 0.25, "ZN": 1.0 / 64.0,
}

# Plausible mean close per symbol (low, high).
PRICE_BANDS = {
    "CL": (0.1, 200.0), "ES": (500.0, 10000.0), "MES": (500.0, 10000.0), "NQ": (1000.0, 30000.0),
    "GC": (500.0, 5000.0), "SI": (5.0, 60.0), "HG": (1.0, 10.0), "ZB": (50.0, 250.0), "ZN": (50.0, 250.0),
    "ZC": (50.0, 20.0), "NG": (0.5, 30.0),
}

# Exchange session rules. Days count from Monday = 0, times are local minutes of day.
_GLOBEX = dict(timezone="America/Chicago", week_start_day=6, week_start=17 * 60, week_end_day=4,
               week_end=16 * 60, break_start=16 * 60, break_end=17 * 60, holidays=True,
               early_close=12 * 60 + 15, approximate=False, approximate_reason="")
_ENERGY = dict(_GLOBEX, early_close=13 * 60 + 30)
_CORN = dict(_GLOBEX, approximate=True, approximate_reason=(
    "CBOT corn has product-specific agricultural hours; cme_globex_23h is not exact."))
SESSIONS = {
    "CL": _ENERGY, "NG": _ENERGY, "ES": _GLOBEX, "NQ": _GLOBEX, "RTY": _GLOBEX, "YM": _GLOBEX, "GC": _GLOBEX,
    "SI": _GLOBEX, "HG": _GLOBEX, "ZB": _GLOBEX, "ZN": _GLOBEX, "ZC": _CORN,
}
# Early closes that replace the generated ones (symbol, date, minute of day).
EARLY_CLOSES = (
    ("CL", "2024-11-29", 13 * 60 + 45), ("CL", "2025-11-28", 13 * 60 + 45),
    ("NG", "2024-11-29", 13 * 60 + 45), ("NG", "2025-11-28", 13 * 60 + 45),
)

# Roll rule per symbol (months, days before the third Friday).
ROLL_RULES = {
    **{s: ((3, 6, 9, 12), 1, 3) for s in ("ES", "MES", "NQ", "YM", "RTY")},
    **{s: (tuple(range(1, 13)), 7, 1) for s in ("CL", "NG")},
    **{s: ((3, 6, 9, 12), 7, 3) for s in ("ZB", "ZN", "ZT", "ZF")},
}
# Delivery month letters, January to December.
MONTH_CODES = "FGHJKMNQUVXZ"


def market_dim(spark: SparkSession, overrides: dict[str, dict] | None = None) -> DataFrame:
    """One row per symbol; `overrides` replaces limits, for example {"ES": {"max_position": 20.0}}."""
    names = ("symbol", "multiplier", "tick", "max_leverage", "max_position")
    rows = []
    for row in MARKETS:
        record = dict(zip(names, row))
        record.update((overrides or {}).get(record["symbol"], {}))
        rows.append(tuple(record[n] for n in names))
    return spark.createDataFrame(rows, "symbol string, multiplier double, tick double, max_leverage double, max_position double")


def tick_dim(spark: SparkSession, ticks: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((ticks or AUDIT_TICKS).items()), "symbol string, tick double")


def price_band_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, lo, hi) for s, (lo, hi) in PRICE_BANDS.items()],
                                 "symbol string, band_low double, band_high double")


SESSION_SCHEMA = ("symbol string, timezone string, week_start_day int, week_start int, week_end_day int, week_end int, "
                  "break_start int, break_end int, holidays boolean, early_close int, approximate boolean, "
                  "approximate_reason string, min_coverage_pct double")


def session_dim(spark: SparkSession, sessions: dict[str, dict] | None = None) -> DataFrame:
    names = [f.split()[0] for f in SESSION_SCHEMA.split(", ")][1:]
    rows = [(symbol, *[cfg.get(n, 99.0 if n == "min_coverage_pct" else None) for n in names])
            for symbol, cfg in (sessions or SESSIONS).items()]
    return spark.createDataFrame(rows, SESSION_SCHEMA)


def early_close_dim(spark: SparkSession, rows=EARLY_CLOSES) -> DataFrame:
    return spark.createDataFrame([*rows] or [], "symbol string, local_date string, close_minute int")


def roll_rule_dim(spark: SparkSession, rules: dict[str, tuple] | None = None) -> DataFrame:
    """One row per (symbol, month) that rolls: month, days before the third Friday, months to the next contract."""
    rows = [(s, m, days, step) for s, (months, days, step) in (rules or ROLL_RULES).items() for m in months]
    return spark.createDataFrame(rows, "symbol string, month int, days_before int, step int")


def with_multiplier(df: DataFrame, markets: DataFrame) -> DataFrame:
    """Attach the contract multiplier; unknown symbols and bad multipliers raise when the row is read."""
    good = F.col("multiplier").isNotNull() & (F.col("multiplier") > 0) & (F.col("multiplier") < float("inf"))
    checked = F.when(good, F.col("multiplier")).otherwise(
        F.raise_error(F.concat(F.lit("no valid contract multiplier for "), F.col("symbol"))).cast("double"))
    return (df.join(F.broadcast(markets.select("symbol", "multiplier")), "symbol", "left")
            .withColumn("contract_multiplier", checked).drop("multiplier"))


def unknown_symbols(df: DataFrame, markets: DataFrame) -> DataFrame:
    """Symbols in the data without a market row."""
    return df.select("symbol").distinct().join(F.broadcast(markets.select("symbol")), "symbol", "left_anti")
