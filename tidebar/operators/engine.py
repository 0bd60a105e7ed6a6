"""The full feature and target matrix, and its contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import count_if
from tidebar.operators.baseline import BASELINE_FEATURES, FAMILIES, baseline_columns, baseline_lookback
from tidebar.operators.expansion import EXPANSION_LOOKBACK, add_cross_timeframe_interactions, expansion_columns
from tidebar.operators.htf import SLOPE_BARS, VOL_BARS, add_session_context, trend_columns, trend_lookback
from tidebar.operators.sessions import TZ, fill_intraday_gaps
from tidebar.operators.targets import add_target_daily_regime, drop_incomplete_target, target_columns
from tidebar.operators.volume_profile import profile_lookback, volume_profile_columns
from tidebar.plans.blocks import Blocks, block_window, halo, measure, trim

MATRIX_PREFIXES = ("ratio_", "pair_", "zscore", "cross_", "htf_")
METADATA = ("continuous_price", "adjustment_factor", "cumulative_factor", "contract_multiplier")
METADATA_PREFIXES = ("continuous_", "roll_", "front_contract", "back_contract")
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def generate_features(df: DataFrame, horizon: int = 15, expansion: bool = False, fill_gaps: bool = True, tz: str = TZ,
                      pairwise: int | None = 0, cross: int | None = 0, slope_bars: int = SLOPE_BARS, vol_bars: int = VOL_BARS,
                      daily_window: int = 260, tx_cost: float = 0.0, commission: float = 0.0,
                      blocks: Blocks | None = None) -> DataFrame:
    """Gap fill, context, targets, baseline and expansion features in one blocked frame: a single sort feeds
    every bounded window, and the session-scoped columns are added in a second shuffle. `pairwise` and `cross` limit the
    products of features: None builds all, 0 none."""
    if fill_gaps:
        df = fill_intraday_gaps(df)
    plan = blocks or measure(df)
    lookback = baseline_lookback(FAMILIES)
    if expansion:
        lookback += trend_lookback(slope_bars, vol_bars) + profile_lookback(daily_window, 5) + EXPANSION_LOOKBACK
    window = block_window()
    framed = halo(df, plan, lookback=lookback, lookahead=horizon + 1)
    if expansion:
        framed = trend_columns(framed, window, slope_bars, vol_bars)
    framed = target_columns(framed, window, horizon, tx_cost, commission)
    framed = baseline_columns(framed, window)
    if expansion:
        framed = volume_profile_columns(framed, window, daily_window)
        framed = expansion_columns(framed, window, BASELINE_FEATURES, tz, pairwise)
    out = trim(framed)
    if expansion:
        out = add_session_context(out)
    out = add_target_daily_regime(out)
    if expansion and cross != 0:
        high = [c for c in out.columns if c.startswith("htf_")]
        low = [c for c in out.columns if c.startswith(("feature_", "ratio_", "pair_", "zscore"))]
        out = add_cross_timeframe_interactions(out, low, high, cross)
    return out.filter(F.col("target_15m_ret").isNotNull() & F.col("target_15m_dir").isNotNull())


def is_metadata(name: str) -> bool:
    return name in METADATA or name.startswith(METADATA_PREFIXES)


def model_feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither raw bars, ids, targets nor contract metadata."""
    skip = {"symbol", "split_id", "ts_event", "open", "high", "low", "close", "volume", "session_id", "regime", "date",
            "benchmark_pnl"}
    return [c for c, t in df.dtypes
            if t in NUMERIC and c not in skip and not c.startswith("target_") and not is_metadata(c)]


def matrix_feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in BASELINE_FEATURES or c.startswith(MATRIX_PREFIXES)]


def as_float(df: DataFrame, columns) -> DataFrame:
    """Narrow to float at a sink."""
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def observed(df: DataFrame, stage: str) -> DataFrame:
    """Attach row and null-timestamp counts of a stage as observed metrics; they ride on the next action."""
    return df.observe(stage, F.count(F.lit(1)).alias("rows"), count_if(F.col("ts_event").isNull()).alias("null_ts"))


def _check(df: DataFrame, required, keys, extra: dict) -> DataFrame:
    """One row per key group with a count per violated rule and the overall verdict."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    rules = {f"null_{c}": count_if(F.col(c).isNull()) for c in required} | extra
    per_ts = df.groupBy(*keys, "ts_event").agg(F.count(F.lit(1)).alias("_n"), *[x.alias(c) for c, x in rules.items()])
    names = [*rules, "duplicate_ts"]
    out = per_ts.groupBy(*keys).agg(F.sum("_n").alias("rows"), *[F.sum(c).alias(c) for c in rules],
                                    F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(F.lit(0))).alias("duplicate_ts"))
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return out.withColumn("passed", (total == 0) & (F.col("rows") > 0))


def check_canonical(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """Canonical bars: nothing null, timestamps unique, prices inside [low, high]."""
    return _check(df, ("ts_event", "open", "high", "low", "close", "volume", "session_id"), keys, {
        "high_lt_low": count_if(F.col("high") < F.col("low")),
        "open_outside": count_if((F.col("open") < F.col("low")) | (F.col("open") > F.col("high"))),
        "close_outside": count_if((F.col("close") < F.col("low")) | (F.col("close") > F.col("high")))})


def check_aligned(df: DataFrame, keys=("symbol",), tolerance: float = 1e-3) -> DataFrame:
    """Canonical rules plus positive continuous prices that equal close times the factor."""
    required = ("ts_event", "open", "high", "low", "close", "volume", "session_id", "continuous_price",
                "contract_multiplier", "continuous_open", "continuous_high", "continuous_low")
    extra = {f"nonpositive_{c}": count_if(F.col(c) <= 0) for c in required[7:]}
    extra |= {"high_lt_low": count_if(F.col("high") < F.col("low"))}
    if "cumulative_factor" in df.columns:
        extra["factor_mismatch"] = count_if(
            F.abs(F.col("continuous_price") - F.col("close") * F.col("cumulative_factor")) > tolerance)
    return _check(df, required, keys, extra)


def check_matrix(df: DataFrame, target: str = "target_15m_ret", keys=("symbol",)) -> DataFrame:
    if not matrix_feature_columns(df):
        raise ValueError("no feature columns generated")
    return _check(df, ("ts_event", target), keys, {})


def check_target(df: DataFrame, target: str, keys=("symbol",)) -> DataFrame:
    """Rows and null targets per key; passes when there are rows and none is null."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), count_if(F.col(target).isNull()).alias("null_target"))
            .withColumn("passed", (F.col("rows") > 0) & (F.col("null_target") == 0)))


def require_passed(checks: DataFrame) -> None:
    """Raise when a check row failed, or when nothing was checked; only up to ten failing rows reach the driver."""
    if checks.isEmpty():
        raise ValueError("contract check failed: no rows were checked")
    failed = checks.filter(~F.col("passed")).limit(10).collect()
    if failed:
        raise ValueError("contract check failed: " + "; ".join(str(r.asDict()) for r in failed))
