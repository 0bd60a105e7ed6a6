"""Risk gates as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import count_if, is_finite


def risk_summary(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Totals, extremes and the worst UTC day; days are summed first, then reduced."""
    required = ("ts_event", "pnl", "position", "equity_curve", "drawdown_pct")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    bad = ~is_finite(F.col("pnl")) | ~is_finite(F.col("position")) | ~is_finite(F.col("equity_curve")) | ~is_finite(F.col("drawdown_pct"))
    daily = df.groupBy(*keys, F.to_date("ts_event").alias("_day")).agg(
        F.sum("pnl").alias("_pnl"), F.count(F.lit(1)).alias("_rows"), F.max(F.abs("position")).alias("_pos"),
        F.min("equity_curve").alias("_equity"), F.min("drawdown_pct").alias("_dd"), count_if(bad).alias("_bad"))
    return daily.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"), F.sum("_pnl").alias("total_pnl"), F.min("_equity").alias("min_equity"),
        F.min("_dd").alias("max_drawdown_pct"), F.min("_pnl").alias("min_daily_pnl"), F.max("_pos").alias("max_abs_position"),
        F.sum("_bad").alias("non_finite"))


def risk_gates(df: DataFrame, keys: Sequence[str] = ("symbol",), max_position: float | None = None,
               daily_loss_limit: float | None = None, max_drawdown: float | None = None) -> DataFrame:
    """One row per key and gate with value, limit and PASS/FAIL; a gate without a limit passes."""
    s = risk_summary(df, keys)
    loss = None if daily_loss_limit is None else -abs(daily_loss_limit)
    drawdown = None if max_drawdown is None else -abs(max_drawdown)

    def gate(name, value, limit, ok):
        return F.struct(F.lit(name).alias("gate"), F.round(value, 8).alias("value"), F.lit(limit).cast("double").alias("limit"),
                        F.when(ok, "PASS").otherwise("FAIL").alias("status"))

    v = F.col
    free = F.lit(True)
    gates = F.array(
        gate("equity_positive", v("min_equity"), 0.0, v("min_equity") > 0),
        gate("max_position_size", v("max_abs_position"), max_position,
             free if max_position is None else v("max_abs_position") <= max_position + 1e-9),
        gate("daily_loss_limit", v("min_daily_pnl"), loss, free if loss is None else v("min_daily_pnl") >= loss - 1e-9),
        gate("max_drawdown_pct", v("max_drawdown_pct"), drawdown,
             free if drawdown is None else v("max_drawdown_pct") >= drawdown - 1e-12),
        gate("finite_values", v("non_finite").cast("double"), 0.0, v("non_finite") == 0))
    return s.select(*keys, F.inline(gates))


def enforce_risk(gates: DataFrame) -> DataFrame:
    """Raise when a gate failed, or when there is none; otherwise return the gate rows."""
    if gates.isEmpty():
        raise ValueError("risk gate failed: no gates were evaluated")
    failed = gates.filter(F.col("status") == "FAIL").limit(10).collect()
    if failed:
        raise ValueError("risk gate failed: " + "; ".join(f"{r['gate']} value={r['value']} limit={r['limit']}" for r in failed))
    return gates


def check_backtest(df: DataFrame, markets: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Backtests are non-empty and, for multipliers above 1, their PnL varies."""
    if "pnl" not in df.columns:
        raise ValueError("missing columns ['pnl']")
    out = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.stddev_pop("pnl").alias("pnl_std"))
           .join(F.broadcast(markets.select("symbol", "multiplier")), "symbol", "left"))
    flat = (F.col("multiplier") > 1) & (F.col("pnl_std") <= 1e-12)
    return out.withColumn("passed", (F.col("rows") > 0) & ~F.coalesce(flat, F.lit(False)))
