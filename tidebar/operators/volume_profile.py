"""Rolling volume profile and volume/spread analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.columns import EPS, clean, clip, cols, floor_at, nearest_quantile
from tidebar.plans.blocks import Blocks, block_window, halo, measure, trim
from tidebar.plans.frames import FrameAggs


def _profile(df: DataFrame, window: WindowSpec, w: int, mp: int) -> DataFrame:
    """Scratch columns _poc, _val, _vah, _total over the previous `w` rows."""
    df = df.withColumns({"_cv": F.col("close") * F.col("volume"), "_vol": F.col("volume").cast("double")})
    aggs = FrameAggs(window)
    total, weighted = aggs.get("sum", "_vol", w, mp, True), aggs.get("sum", "_cv", w, mp, True)
    aggs.scratch["_sorted"] = F.array_sort(F.collect_list("close").over(window.rowsBetween(-w, -1)))
    return (aggs.apply(df)
            .withColumns({"_total": total, "_poc": weighted / floor_at(total),
                          "_val": nearest_quantile(F.col("_sorted"), 0.15, mp),
                          "_vah": nearest_quantile(F.col("_sorted"), 0.85, mp)})
            .drop("_sorted", "_cv"))


def _inside(price: Column) -> Column:
    return ((price >= F.col("_val")) & (price <= F.col("_vah"))).cast("double")


def profile_columns(df: DataFrame, window: WindowSpec, w: int = 260, poc_roll: int = 5, clip_levels: bool = True) -> DataFrame:
    """Long profile: POC is the volume-weighted close, VAL/VAH the 15% / 85% closes of the previous `w` rows.

    ``clip_levels=False`` keeps price levels unclipped; the default bounds them to +/-10 like other features.
    """
    kept, mp = df.columns, min(10, w // 2)
    df = _profile(df, window, w, mp)
    before = F.lag("close").over(window)
    df = df.withColumn("_c1", before).withColumn("_v1", F.lag("_vol").over(window))
    df = df.withColumn("_in_va", _inside(F.col("_c1")) * F.col("_v1"))
    aggs = FrameAggs(window)
    steady, in_va = aggs.get("std", "_poc", poc_roll, 2), aggs.get("sum", "_in_va", w, mp)
    df = aggs.apply(df)
    level = (lambda c: clean(c)) if clip_levels else (lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)))
    return df.select(*cols(kept), level(F.col("_poc")).alias("feature_volume_poc"), level(F.col("_val")).alias("feature_volume_val"),
                     level(F.col("_vah")).alias("feature_volume_vah"),
                     clean((F.col("close") - F.col("_poc")) / floor_at(F.col("_poc"))).alias("feature_distance_to_poc"),
                     clean(_inside(F.col("close"))).alias("feature_inside_value_area"),
                     clean(steady).alias("feature_poc_stability"),
                     clean(in_va / floor_at(F.col("_total")), lo=0.0, hi=1.0).alias("feature_volume_conc_in_va"))


def short_profile_columns(df: DataFrame, window: WindowSpec, w: int = 48, clip_levels: bool = True) -> DataFrame:
    kept = df.columns
    df = _profile(df, window, w, 5)
    level = (lambda c: clean(c)) if clip_levels else (lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)))
    return df.select(*cols(kept), level(F.col("_poc")).alias("feature_volume_poc_4h"), level(F.col("_val")).alias("feature_volume_val_4h"),
                     level(F.col("_vah")).alias("feature_volume_vah_4h"),
                     clean((F.col("close") - F.col("_poc")) / floor_at(F.col("_poc"))).alias("feature_distance_to_poc_4h"),
                     clean(_inside(F.col("close"))).alias("feature_inside_va_4h"))


def spread_columns(df: DataFrame, window: WindowSpec, w: int = 20) -> DataFrame:
    """Effort against result: volume and spread relative to their lagged rolling medians."""
    kept = df.columns
    df = df.withColumns({"_spread": (F.col("high") - F.col("low")) / floor_at(F.col("close")),
                         "_vol": F.col("volume").cast("double")})
    aggs = FrameAggs(window)
    med_vol, med_spread = aggs.get("median", "_vol", w, 5, True), aggs.get("median", "_spread", w, 5, True)
    df = aggs.apply(df).withColumns({"_mv": med_vol, "_ms": med_spread})
    df = df.withColumns({"_vr": F.col("_vol") / floor_at(F.col("_mv")), "_sr": F.col("_spread") / floor_at(F.col("_ms")),
                         "_spike": (F.col("_vol") > 2.0 * F.col("_mv")).cast("double"),
                         "_tight": (F.col("_spread") < 0.5 * F.col("_ms")).cast("double"),
                         "_wide": (F.col("_spread") > 2.0 * F.col("_ms")).cast("double"),
                         "_br": F.abs(F.col("close") - F.col("open")) / floor_at(F.col("high") - F.col("low") + EPS)})
    return df.select(*cols(kept), clean(F.col("_sr") / floor_at(F.col("_vr"))).alias("feature_vol_to_spread_eff"),
                     clean(F.col("_vr")).alias("feature_vol_ratio_vs_med"), clean(F.col("_sr")).alias("feature_spread_ratio_vs_med"),
                     clean(F.col("_spike")).alias("feature_vol_spike"),
                     clean((F.col("_vol") < 0.5 * F.col("_mv")).cast("double")).alias("feature_vol_drought"),
                     clean(F.col("_tight")).alias("feature_spread_compression"), clean(F.col("_wide")).alias("feature_spread_expansion"),
                     clean(F.col("_spike") * F.col("_wide")).alias("feature_vol_climax"),
                     clean(F.col("_spike") * F.col("_tight")).alias("feature_absorption"),
                     clean(F.col("_br"), lo=0.0, hi=1.0).alias("feature_body_ratio"),
                     clean(F.col("_br") * F.col("_vr")).alias("feature_effort_vs_result"))


def profile_lookback(daily_window: int, poc_roll: int) -> int:
    return 2 * daily_window + poc_roll + 2


def volume_profile_columns(df: DataFrame, window: WindowSpec, daily_window: int = 260, short_window: int = 48,
                           spread_window: int = 20, poc_roll: int = 5, clip_levels: bool = True) -> DataFrame:
    df = profile_columns(df, window, daily_window, poc_roll, clip_levels)
    return spread_columns(short_profile_columns(df, window, short_window, clip_levels), window, spread_window)


def add_volume_profile_features(df: DataFrame, daily_window: int = 260, short_window: int = 48, spread_window: int = 20,
                                poc_roll: int = 5, clip_levels: bool = True, blocks: Blocks | None = None) -> DataFrame:
    lookback = max(profile_lookback(daily_window, poc_roll), short_window + 1, spread_window + 1)
    framed = halo(df, blocks or measure(df), lookback=lookback)
    return trim(volume_profile_columns(framed, block_window(), daily_window, short_window, spread_window, poc_roll, clip_levels))


def add_spread_features(df: DataFrame, w: int = 20, blocks: Blocks | None = None) -> DataFrame:
    return trim(spread_columns(halo(df, blocks or measure(df), lookback=w + 1), block_window(), w))
