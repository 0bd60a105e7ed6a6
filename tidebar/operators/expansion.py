"""Optional feature expansion: regime, z-scores, interactions, quantiles, moments, VWAP deviation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, islice, product

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.columns import EPS, clean, clip, cols, floor_at, iso_weekday, local_ts, minute_of_day, nearest_quantile
from tidebar.operators.sessions import TZ
from tidebar.plans.blocks import Blocks, block_window, halo, measure, trim
from tidebar.plans.frames import FrameAggs

FEATURE_PREFIXES = ("feature_", "ratio_", "pair_", "zscore", "cross_", "htf_")
RAW_COLUMNS = {"symbol", "ts_event", "open", "high", "low", "close", "volume", "session_id", "regime"}
#: Fixed values.
REGIME_INTERACTIONS = ("feature_ret_1", "feature_ret_5", "feature_ewma_vol_20", "feature_volume_z_20")
#: Fixed values.
REGIME_NAME_PARTS = ("vol", "ret_1", "momentum", "spread")
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
# 1 (lag) + 1 (lagged return) + 20 (deviation) + 20 (median) + 5 (mean)
EXPANSION_LOOKBACK = 50


def _with_return(df: DataFrame, window: WindowSpec, name: str = "_r") -> DataFrame:
    before = F.lag("close").over(window)
    return df.withColumn(name, F.ln(F.try_divide(F.col("close"), before)))


def regime_columns(df: DataFrame, window: WindowSpec, median_window: int = 20, smooth_window: int = 5,
                   high: float = 0.6, low: float = 0.4) -> DataFrame:
    """1.0 / 0.5 / 0.0 from the smoothed median of lagged volatility; 0.5 while it is unknown."""
    kept = df.columns
    df = _with_return(df, window)
    for name, agg, source, w, lagged in (("_vol", "std", "_r", 20, True), ("_med", "median", "_vol", median_window, False),
                                         ("_smooth", "mean", "_med", smooth_window, False)):
        aggs = FrameAggs(window)
        value = aggs.get(agg, source, w, 5, lagged)
        df = aggs.apply(df).withColumn(name, value)
    regime = F.when(F.col("_smooth") >= high, 1.0).when(F.col("_smooth") <= low, 0.0).otherwise(F.lit(0.5))
    return df.select(*cols(c for c in kept if c != "regime"), regime.alias("regime"))


def zscore_columns(df: DataFrame, window: WindowSpec, features: Sequence[str], limit: int | None = None) -> DataFrame:
    """`{col}_zscore` of the features (with a `limit`, of the first ones) against their previous 30 rows, bounded to 3.5."""
    kept, chosen = df.columns, [c for c in features[:limit] if c in df.columns]
    aggs = FrameAggs(window)
    out = [clip((F.col(c) - aggs.get("mean", c, 30, 30, True)) / floor_at(aggs.get("std", c, 30, 30, True)), -3.5, 3.5)
           .alias(f"{c}_zscore") for c in chosen]
    return aggs.apply(df).select(*cols(kept), *out)


def add_regime_conditioned(df: DataFrame, names: Sequence[str] = REGIME_INTERACTIONS) -> DataFrame:
    return df.withColumns({f"{c}_regime": clip(F.col(c) * F.col("regime"), -10.0, 10.0) for c in names if c in df.columns})


def add_regime_interactions(df: DataFrame, features: Sequence[str], parts: Sequence[str] = REGIME_NAME_PARTS) -> DataFrame:
    chosen = [c for c in features if c in df.columns and any(p in c for p in parts)]
    return df.withColumns({f"{c}_regime": F.col(c) * F.col("regime") for c in chosen})


def _products(df: DataFrame, prefix: str, pairs) -> DataFrame:
    return df.select("*", *[clip(F.col(f"`{a}`") * F.col(f"`{b}`"), -10.0, 10.0).alias(f"{prefix}_{a}_x_{b}")
                            for a, b in pairs])


def add_pairwise_interactions(df: DataFrame, features: Sequence[str], limit: int | None = None) -> DataFrame:
    """Products of all sorted feature pairs; with a `limit`, of the first ones."""
    return _products(df, "pair", islice(combinations(sorted(features), 2), limit))


def add_cross_timeframe_interactions(df: DataFrame, low: Sequence[str], high: Sequence[str], limit: int | None = None) -> DataFrame:
    """Products of base-timeframe and higher-timeframe numeric features; with a `limit`, the first ones."""
    types = dict(df.dtypes)
    usable = [[c for c in sorted(side) if types.get(c) in NUMERIC] for side in (low, high)]
    return _products(df, "cross", islice(product(*usable), limit))


def quantile_columns(df: DataFrame, window: WindowSpec, w: int = 20) -> DataFrame:
    """Nearest-rank 0.2 / 0.5 / 0.8 quantiles of the previous `w` returns."""
    kept = df.columns
    df = _with_return(df, window).withColumn(
        "_sorted", F.array_sort(F.collect_list("_r").over(window.rowsBetween(-w, -1))))
    return df.select(*cols(kept), *[clip(nearest_quantile(F.col("_sorted"), q, w), -10.0, 10.0)
                              .alias(f"feature_ret_quantile_{q}_{w}") for q in (0.2, 0.5, 0.8)])


def add_fourier_features(df: DataFrame, tz: str = TZ) -> DataFrame:
    local = local_ts(F.col("ts_event"), tz)
    angle = F.lit(2 * math.pi) * minute_of_day(local) / F.lit(24 * 60)
    return df.withColumns({"feature_sin_time": F.sin(angle), "feature_cos_time": F.cos(angle),
                           "feature_dow": iso_weekday(local).cast("double")})


def moment_columns(df: DataFrame, window: WindowSpec, w: int = 20, eps: float = EPS) -> DataFrame:
    """Skew and kurtosis of the previous `w` returns from their power sums."""
    kept = df.columns
    df = _with_return(df, window)
    df = df.withColumns({f"_r{p}": F.pow("_r", F.lit(p)) for p in (2, 3, 4)})
    aggs = FrameAggs(window)
    s1, s2, s3, s4 = (aggs.get("sum", c, w, w, True) for c in ("_r", "_r2", "_r3", "_r4"))
    df = aggs.apply(df).withColumns({"_s1": s1, "_s2": s2, "_s3": s3, "_s4": s4})
    df = df.withColumn("_m", F.col("_s1") / w).withColumn(
        "_var", (F.col("_s2") - w * F.col("_m") * F.col("_m")) / (w - 1))
    m, var = F.col("_m"), F.col("_var")
    df = df.withColumn("_sd", F.when(var >= 0, F.sqrt(var)))
    third = F.col("_s3") - 3 * m * F.col("_s2") + 2 * w * m * m * m
    fourth = F.col("_s4") - 4 * m * F.col("_s3") + 6 * m * m * F.col("_s2") - 3 * w * m * m * m * m
    skew = F.when(F.lit(w > 2) & (F.col("_sd") > eps),
                  third / (w - 1) / (F.pow("_sd", F.lit(3)) + eps) * (w / (w - 2) if w > 2 else 0.0)).otherwise(F.lit(0.0))
    kurt = F.when(F.lit(w > 3) & (F.abs(var) > eps), fourth / (w * (var * var + eps)) - 3.0).otherwise(F.lit(0.0))
    return df.select(*cols(kept), clean(skew).alias(f"feature_ret_skew_{w}"), clean(kurt).alias(f"feature_ret_kurt_{w}"))


def acceleration_columns(df: DataFrame, window: WindowSpec) -> DataFrame:
    kept = df.columns
    df = _with_return(df, window)
    change = F.col("_r") - F.lag("_r").over(window)
    return df.withColumn("_a", change).select(*cols(kept), clean(F.col("_a")).alias("feature_ret_acceleration"))


def vwap_columns(df: DataFrame, window: WindowSpec, w: int = 20) -> DataFrame:
    """Close against the volume-weighted typical price of the previous `w` rows."""
    kept = df.columns
    df = df.withColumn("_pv", (F.col("high") + F.col("low") + F.col("close")) / 3.0 * F.col("volume"))
    aggs = FrameAggs(window)
    vwap = aggs.get("sum", "_pv", w, w, True) / floor_at(aggs.get("sum", "volume", w, w, True).cast("double"))
    df = aggs.apply(df).withColumn("_vwap", vwap)
    return df.select(*cols(kept), clean((F.col("close") - F.col("_vwap")) / floor_at(F.col("_vwap"))).alias("feature_vwap_deviation"))


def expansion_columns(df: DataFrame, window: WindowSpec, features: Sequence[str], tz: str = TZ,
                      pairwise: int | None = 0) -> DataFrame:
    """All expansion families on a blocked frame, then one cleanup of the numeric feature columns. `pairwise` is the number of
    products of feature pairs: None for all, 0 for none."""
    inputs = set(df.columns)
    df = regime_columns(df, window)
    df = add_regime_conditioned(zscore_columns(df, window, features))
    df = moment_columns(add_fourier_features(quantile_columns(df, window), tz), window)
    df = vwap_columns(acceleration_columns(df, window), window)
    df = add_regime_interactions(df, features)
    if pairwise != 0:
        df = add_pairwise_interactions(df, [c for c in df.columns if c.startswith(FEATURE_PREFIXES)], pairwise)
    skip = RAW_COLUMNS | {c for c in inputs if c.startswith("_")}
    cleaned = [clean(F.col(f"`{c}`")).alias(c)
               if t in NUMERIC and c not in skip and not c.startswith(("htf_", "daily_", "1h_")) else F.col(f"`{c}`")
               for c, t in df.dtypes]
    return df.select(*cleaned)


_FAMILIES = {"regime": regime_columns, "quantiles": quantile_columns, "moments": moment_columns,
             "acceleration": acceleration_columns, "vwap": vwap_columns}


def add_expansion(df: DataFrame, family: str, blocks: Blocks | None = None, **options) -> DataFrame:
    """One window-based family on its own: regime, quantiles, moments, acceleration or vwap."""
    framed = halo(df, blocks or measure(df), lookback=max(EXPANSION_LOOKBACK, options.get("w", 0) + 2))
    return trim(_FAMILIES[family](framed, block_window(), **options))


def add_zscores(df: DataFrame, features: Sequence[str], blocks: Blocks | None = None) -> DataFrame:
    return trim(zscore_columns(halo(df, blocks or measure(df), lookback=31), block_window(), features))


def expand_features(df: DataFrame, features: Sequence[str], tz: str = TZ, pairwise: int | None = 0,
                    blocks: Blocks | None = None) -> DataFrame:
    framed = halo(df, blocks or measure(df), lookback=EXPANSION_LOOKBACK)
    return trim(expansion_columns(framed, block_window(), features, tz, pairwise))
