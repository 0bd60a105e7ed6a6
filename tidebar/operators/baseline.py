"""The 91 baseline features of a bar series.

Bars are canonical: prices are positive and nothing is NULL, so plain `ln` is enough here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.columns import clean, cols, floor_at
from tidebar.plans.blocks import Blocks, block_window, halo, measure, trim
from tidebar.plans.frames import FrameAggs, add_ema, ema_lookback

RETURN_LAGS = (1, 2, 3, 5, 10, 15, 30, 60)
MOMENTUM_LAGS = (3, 5, 10, 15, 30, 60)
EMA_SPANS = (5, 15, 30)

FAMILIES = {
    "returns": [f"ret_{k}" for k in RETURN_LAGS],
    "return_stats": [f"ret_mean_{w}" for w in (5, 15, 30)] + [f"ret_std_{w}" for w in (5, 15, 30, 60)],
    "return_zscore": [f"ret_zscore_{w}" for w in (15, 30)],
    "momentum": [f"mom_{k}" for k in MOMENTUM_LAGS],
    "sma": [f"close_vs_sma_{w}" for w in (5, 15, 30, 60)],
    "ema": [f"close_vs_ema_{s}" for s in EMA_SPANS],
    "volatility": [f"volatility_{w}" for w in (5, 15, 30, 60)] + ["realized_vol_15", "realized_vol_30", "vol_ratio_15_60"],
    "bar_shape": ["bar_range", "body_size", "upper_wick", "lower_wick", "body_to_range", "close_position",
                  "wick_imbalance", "range_mean_15", "range_std_15", "body_mean_15"],
    "breakout": [f"{p}_{w}" for p in ("dist_to_high", "dist_to_low", "price_position") for w in (15, 30, 60)]
                + ["breakout_high_15", "breakout_low_15", "breakout_high_30", "breakout_low_30"],
    "volume": ["volume_log", "volume_change_1"] + [f"volume_ratio_{w}" for w in (5, 15, 30, 60)]
              + [f"volume_zscore_{w}" for w in (15, 30, 60)],
    "signed_volume": [f"signed_volume_ratio_{w}" for w in (5, 15, 30)]
                     + ["volume_weighted_ret", "volume_imbalance_15", "volume_imbalance_30"],
    "price_volume_corr": ["price_volume_corr_30"],
    "efficiency": [f"trend_efficiency_{w}" for w in (15, 30, 60)]
                  + [f"{s}_ret_ratio_{w}" for s in ("positive", "negative") for w in (15, 30)],
    "rsi": [f"rsi_{w}" for w in (7, 14, 30)],
    "macd": ["macd_norm", "macd_hist_norm"],
    "bollinger": ["bb_position_20", "bb_width_20"],
    "atr": ["atr_14_norm"],
}
BASELINE_FEATURES = [name for names in FAMILIES.values() for name in names]
WINDOW_LOOKBACK = 61
EMA_LOOKBACK = ema_lookback(30) + ema_lookback(9)


def baseline_lookback(families) -> int:
    return WINDOW_LOOKBACK + (EMA_LOOKBACK if {"ema", "macd"} & set(families) else 0)


def _m(floor: int, w: int) -> int:
    return max(floor, w // 3)


def baseline_columns(df: DataFrame, window: WindowSpec, families=tuple(FAMILIES)) -> DataFrame:
    """Add the chosen families on a blocked frame; scratch columns are dropped."""
    families = set(families)
    kept = df.columns
    c, o, h, lo, v = (F.col(x).cast("double") for x in ("close", "open", "high", "low", "volume"))
    if families & {"ema", "macd"}:
        spans = ([*EMA_SPANS] if "ema" in families else []) + ([12, 26] if "macd" in families else [])
        df = add_ema(df, window, {f"_ema{s}": (c, s) for s in spans})
        if "macd" in families:
            df = df.withColumn("_macd", F.col("_ema12") - F.col("_ema26"))
            df = add_ema(df, window, {"_signal": (F.col("_macd"), 9)})

    lags = sorted({1} | (set(RETURN_LAGS) if "returns" in families else set())
                  | (set(MOMENTUM_LAGS) if "momentum" in families else set())
                  | ({15, 30, 60} if "efficiency" in families else set()))
    df = df.withColumns({**{f"_c{k}": F.lag(c, k).over(window) for k in lags},
                         "_v1": F.lag(v, 1).over(window)})
    ret = F.ln(c / floor_at(F.col("_c1")))
    rng, body = floor_at(h - lo), F.abs(c - o)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    delta = c - F.col("_c1")
    df = df.withColumns({"_ret": ret, "_c": c, "_h": h, "_l": lo, "_v": v})
    r = F.col("_ret")
    safe_c = floor_at(c)
    df = df.withColumns({
        "_ret2": r * r, "_absret": F.abs(r),
        "_sv": F.when(r > 0, v).when(r < 0, -v).otherwise(F.lit(0.0)),
        "_dlv": F.log1p(v) - F.log1p(F.col("_v1")),
        "_xy": r * (F.log1p(v) - F.log1p(F.col("_v1"))),
        "_pos": F.when(r > 0, 1.0).otherwise(F.lit(0.0)), "_neg": F.when(r < 0, 1.0).otherwise(F.lit(0.0)),
        "_gain": F.when(delta > 0, delta).otherwise(F.lit(0.0)),
        "_loss": F.when(delta < 0, -delta).otherwise(F.lit(0.0)),
        "_range": rng / safe_c, "_body": body / safe_c,
        "_tr": F.greatest(h - lo, F.abs(h - F.col("_c1")), F.abs(lo - F.col("_c1"))),
    })
    aggs = FrameAggs(window)
    out = {}
    for family in FAMILIES:
        if family in families:
            out.update(_FAMILY[family](aggs, c, o, h, lo, v, rng, body, upper, lower, safe_c))
    return aggs.apply(df).select(*cols(kept), *[clean(x).alias(name) for name, x in out.items()])


def _returns(a, c, *_):
    return {f"ret_{k}": F.ln(c / floor_at(F.col(f"_c{k}"))) for k in RETURN_LAGS}


def _return_stats(a, *_):
    return {**{f"ret_mean_{w}": a.get("mean", "_ret", w, _m(2, w)) for w in (5, 15, 30)},
            **{f"ret_std_{w}": a.get("std", "_ret", w, _m(2, w)) for w in (5, 15, 30, 60)}}


def _return_zscore(a, *_):
    return {f"ret_zscore_{w}": (F.col("_ret") - a.get("mean", "_ret", w, _m(3, w), True))
            / floor_at(a.get("std", "_ret", w, _m(3, w), True)) for w in (15, 30)}


def _momentum(a, c, *_):
    return {f"mom_{k}": c / floor_at(F.col(f"_c{k}")) - 1.0 for k in MOMENTUM_LAGS}


def _sma(a, c, o, h, lo, v, rng, body, upper, lower, safe_c):
    return {f"close_vs_sma_{w}": (c - a.get("mean", "_c", w, _m(2, w), True)) / safe_c for w in (5, 15, 30, 60)}


def _ema(a, c, o, h, lo, v, rng, body, upper, lower, safe_c):
    return {f"close_vs_ema_{s}": (c - F.col(f"_ema{s}")) / safe_c for s in EMA_SPANS}


def _volatility(a, *_):
    return {**{f"volatility_{w}": a.get("std", "_ret", w, _m(2, w)) for w in (5, 15, 30, 60)},
            **{f"realized_vol_{w}": F.sqrt(a.get("sum", "_ret2", w, _m(5, w))) for w in (15, 30)},
            "vol_ratio_15_60": a.get("std", "_ret", 15, 5) / floor_at(a.get("std", "_ret", 60, 20))}


def _bar_shape(a, c, o, h, lo, v, rng, body, upper, lower, safe_c):
    return {"bar_range": F.col("_range"), "body_size": F.col("_body"), "upper_wick": upper / safe_c,
            "lower_wick": lower / safe_c, "body_to_range": body / rng, "close_position": (c - lo) / rng,
            "wick_imbalance": (upper - lower) / rng, "range_mean_15": a.get("mean", "_range", 15, 5),
            "range_std_15": a.get("std", "_range", 15, 5), "body_mean_15": a.get("mean", "_body", 15, 5)}


def _breakout(a, c, o, h, lo, v, rng, body, upper, lower, safe_c):
    out = {}
    for w in (15, 30, 60):
        top, bottom = a.get("max", "_h", w, _m(5, w), True), a.get("min", "_l", w, _m(5, w), True)
        out[f"dist_to_high_{w}"] = (c - top) / safe_c
        out[f"dist_to_low_{w}"] = (c - bottom) / safe_c
        out[f"price_position_{w}"] = (c - bottom) / floor_at(top - bottom)
        if w < 60:
            out[f"breakout_high_{w}"] = (c > top).cast("double")
            out[f"breakout_low_{w}"] = (c < bottom).cast("double")
    return {name: out[name] for name in FAMILIES["breakout"]}


def _volume(a, c, o, h, lo, v, *_):
    out = {"volume_log": F.log1p(v), "volume_change_1": v / floor_at(F.col("_v1")) - 1.0}
    for w in (5, 15, 30, 60):
        out[f"volume_ratio_{w}"] = v / floor_at(a.get("mean", "_v", w, _m(2, w), True))
    for w in (15, 30, 60):
        out[f"volume_zscore_{w}"] = ((v - a.get("mean", "_v", w, _m(5, w), True))
                                     / floor_at(a.get("std", "_v", w, _m(5, w), True)))
    return out


def _signed_volume(a, c, o, h, lo, v, *_):
    def ratio(w, mp):
        return a.get("sum", "_sv", w, mp) / floor_at(a.get("sum", "_v", w, mp))

    return {**{f"signed_volume_ratio_{w}": ratio(w, _m(2, w)) for w in (5, 15, 30)},
            "volume_weighted_ret": F.col("_ret") * (v / floor_at(a.get("mean", "_v", 15, 5, True))),
            **{f"volume_imbalance_{w}": ratio(w, _m(5, w)) for w in (15, 30)}}


def _price_volume_corr(a, *_):
    """Mean-product covariance (divisor n) over sample deviations (divisor n-1), as the features define it."""
    cov = a.get("mean", "_xy", 30, 10) - a.get("mean", "_ret", 30, 10) * a.get("mean", "_dlv", 30, 10)
    return {"price_volume_corr_30": cov / floor_at(a.get("std", "_ret", 30, 10) * a.get("std", "_dlv", 30, 10))}


def _efficiency(a, c, *_):
    out = {}
    for w in (15, 30, 60):
        moved = F.abs(c - F.col(f"_c{w}")) / floor_at(F.col(f"_c{w}"))
        out[f"trend_efficiency_{w}"] = moved / floor_at(a.get("sum", "_absret", w, _m(5, w)))
    for side, col in (("positive", "_pos"), ("negative", "_neg")):
        for w in (15, 30):
            out[f"{side}_ret_ratio_{w}"] = a.get("mean", col, w, _m(5, w))
    return out


def _rsi(a, *_):
    return {f"rsi_{w}": (100.0 - 100.0 / (1.0 + a.get("mean", "_gain", w, _m(3, w))
                                         / floor_at(a.get("mean", "_loss", w, _m(3, w))))) / 100.0 for w in (7, 14, 30)}


def _macd(a, c, o, h, lo, v, rng, body, upper, lower, safe_c):
    return {"macd_norm": F.col("_macd") / safe_c, "macd_hist_norm": (F.col("_macd") - F.col("_signal")) / safe_c}


def _bollinger(a, c, o, h, lo, v, rng, body, upper, lower, safe_c):
    mean, std = a.get("mean", "_c", 20, 10), a.get("std", "_c", 20, 10)
    top, bottom = mean + 2.0 * std, mean - 2.0 * std
    return {"bb_position_20": (c - bottom) / floor_at(top - bottom), "bb_width_20": (top - bottom) / safe_c}


def _atr(a, c, o, h, lo, v, rng, body, upper, lower, safe_c):
    return {"atr_14_norm": a.get("mean", "_tr", 14, 5) / safe_c}


_FAMILY = {
    "returns": _returns, "return_stats": _return_stats, "return_zscore": _return_zscore, "momentum": _momentum,
    "sma": _sma, "ema": _ema, "volatility": _volatility, "bar_shape": _bar_shape, "breakout": _breakout,
    "volume": _volume, "signed_volume": _signed_volume, "price_volume_corr": _price_volume_corr,
    "efficiency": _efficiency, "rsi": _rsi, "macd": _macd, "bollinger": _bollinger, "atr": _atr,
}


def add_baseline_features(df: DataFrame, families=tuple(FAMILIES), blocks: Blocks | None = None) -> DataFrame:
    framed = halo(df, blocks or measure(df), lookback=baseline_lookback(families))
    return trim(baseline_columns(framed, block_window(), families))
