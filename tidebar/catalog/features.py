"""Baseline, expansion, context and volume features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.registry import STAMP, bound, cl, fl, lag, lnq, out, over, query, r, roll, rs, show, stamp, with_
from tidebar.catalog.views import HOURLY, MINUTELY, NY, SESSION, WEEKLY, hourly, minutely, planned_weekly, weekly
from tidebar.operators import align, baseline, engine, expansion, htf, sessions, volume_profile
from tidebar.plans.blocks import measure

# Shared first steps of the feature SQL: previous values, one-bar return, bar geometry.
BASE = f"""p AS (SELECT *, {lag('close')} AS c1, {lag('volume')} AS v1 FROM b),
q AS (SELECT *, ln(close / {fl('c1')}) AS ret, close - c1 AS delta, {fl('high - low')} AS rng, abs(close - open) AS body,
  high - greatest(open, close) AS up, least(open, close) - low AS dn, ln(1 + volume) - ln(1 + v1) AS dlv FROM p),
r AS (SELECT *, ret * ret AS ret2, abs(ret) AS aret, CASE WHEN ret > 0 THEN volume WHEN ret < 0 THEN -volume ELSE 0 END AS sv, ret * dlv AS xy,
  CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS pos, CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS neg,
  CASE WHEN delta > 0 THEN delta ELSE 0 END AS gain, CASE WHEN delta < 0 THEN -delta ELSE 0 END AS loss,
  rng / {fl('close')} AS rp, body / {fl('close')} AS bp, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr FROM q)"""


def m(k: int, w: int) -> int:
    return max(k, w // 3)


def _family_sql() -> dict[str, dict[str, str]]:
    c = fl("close")
    f: dict[str, dict[str, str]] = {}
    f["returns"] = {f"ret_{k}": lnq(f"close / {fl(lag('close', k))}") for k in baseline.RETURN_LAGS}
    f["return_stats"] = {**{f"ret_mean_{w}": roll("mean", "ret", w, m(2, w)) for w in (5, 15, 30)},
                         **{f"ret_std_{w}": roll("std", "ret", w, m(2, w)) for w in (5, 15, 30, 60)}}
    f["return_zscore"] = {f"ret_zscore_{w}": f"(ret - {roll('mean', 'ret', w, m(3, w), True)}) / {fl(roll('std', 'ret', w, m(3, w), True))}" for w in (15, 30)}
    f["momentum"] = {f"mom_{k}": f"close / {fl(lag('close', k))} - 1" for k in baseline.MOMENTUM_LAGS}
    f["sma"] = {f"close_vs_sma_{w}": f"(close - {roll('mean', 'close', w, m(2, w), True)}) / {c}" for w in (5, 15, 30, 60)}
    f["volatility"] = {**{f"volatility_{w}": roll("std", "ret", w, m(2, w)) for w in (5, 15, 30, 60)},
                       **{f"realized_vol_{w}": f"sqrt({roll('sum', 'ret2', w, m(5, w))})" for w in (15, 30)},
                       "vol_ratio_15_60": f"{roll('std', 'ret', 15, 5)} / {fl(roll('std', 'ret', 60, 20))}"}
    f["bar_shape"] = {"bar_range": "rp", "body_size": "bp", "upper_wick": f"up / {c}", "lower_wick": f"dn / {c}", "body_to_range": "body / rng",
                      "close_position": "(close - low) / rng", "wick_imbalance": "(up - dn) / rng", "range_mean_15": roll("mean", "rp", 15, 5),
                      "range_std_15": roll("std", "rp", 15, 5), "body_mean_15": roll("mean", "bp", 15, 5)}
    br: dict[str, str] = {}
    for w in (15, 30, 60):
        top, low = roll("max", "high", w, m(5, w), True), roll("min", "low", w, m(5, w), True)
        br |= {f"dist_to_high_{w}": f"(close - {top}) / {c}", f"dist_to_low_{w}": f"(close - {low}) / {c}",
               f"price_position_{w}": f"(close - {low}) / {fl(f'{top} - {low}')}"}
        if w < 60:
            br |= {f"breakout_high_{w}": f"(close > {top})::INT", f"breakout_low_{w}": f"(close < {low})::INT"}
    f["breakout"] = br
    f["volume"] = {"volume_log": "ln(1 + volume)", "volume_change_1": f"volume / {fl('v1')} - 1",
                   **{f"volume_ratio_{w}": f"volume / {fl(roll('mean', 'volume', w, m(2, w), True))}" for w in (5, 15, 30, 60)},
                   **{f"volume_zscore_{w}": f"(volume - {roll('mean', 'volume', w, m(5, w), True)}) / {fl(roll('std', 'volume', w, m(5, w), True))}" for w in (15, 30, 60)}}
    sv = lambda w, mp: f"{roll('sum', 'sv', w, mp)} / {fl(roll('sum', 'volume', w, mp))}"
    f["signed_volume"] = {**{f"signed_volume_ratio_{w}": sv(w, m(2, w)) for w in (5, 15, 30)},
                          "volume_weighted_ret": f"ret * volume / {fl(roll('mean', 'volume', 15, 5, True))}",
                          **{f"volume_imbalance_{w}": sv(w, m(5, w)) for w in (15, 30)}}
    g = lambda a, x: roll(a, x, 30, 10)
    f["price_volume_corr"] = {"price_volume_corr_30": f"({g('mean', 'xy')} - {g('mean', 'ret')} * {g('mean', 'dlv')}) / {fl(g('std', 'ret') + ' * ' + g('std', 'dlv'))}"}
    f["efficiency"] = {**{f"trend_efficiency_{w}": f"abs(close - {lag('close', w)}) / {fl(lag('close', w))} / {fl(roll('sum', 'aret', w, m(5, w)))}" for w in (15, 30, 60)},
                       **{f"{s}_ret_ratio_{w}": roll("mean", x, w, m(5, w)) for s, x in (("positive", "pos"), ("negative", "neg")) for w in (15, 30)}}
    f["rsi"] = {f"rsi_{w}": f"(100 - 100 / (1 + {roll('mean', 'gain', w, m(3, w))} / {fl(roll('mean', 'loss', w, m(3, w)))})) / 100" for w in (7, 14, 30)}
    mean, sd = roll("mean", "close", 20, 10), roll("std", "close", 20, 10)
    f["bollinger"] = {"bb_position_20": f"(close - {mean} + 2 * {sd}) / {fl(f'4 * {sd}')}", "bb_width_20": f"4 * {sd} / {c}"}
    f["atr"] = {"atr_14_norm": f"{roll('mean', 'tr', 14, 5)} / {c}"}
    return f


# EMA as the recursion itself: step k of every series depends on step k - 1.
EMA_SQL = """n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM b),
e AS (SELECT symbol, k, ts, close, close AS e5, close AS e12, close AS e15, close AS e26, close AS e30, 0.0::DOUBLE AS sig FROM n WHERE k = 1
  UNION ALL SELECT n.symbol, n.k, n.ts, n.close, e.e5 + (n.close - e.e5) * (2.0::DOUBLE / 6), e.e12 + (n.close - e.e12) * (2.0::DOUBLE / 13),
    e.e15 + (n.close - e.e15) * (2.0::DOUBLE / 16), e.e26 + (n.close - e.e26) * (2.0::DOUBLE / 27), e.e30 + (n.close - e.e30) * (2.0::DOUBLE / 31),
    e.sig + ((e.e12 + (n.close - e.e12) * (2.0::DOUBLE / 13)) - (e.e26 + (n.close - e.e26) * (2.0::DOUBLE / 27)) - e.sig) * 0.2::DOUBLE
  FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1)"""


def _register_families():
    sql = {f: with_(WEEKLY, BASE) + out("r", {n: cl(x) for n, x in cols.items()}) for f, cols in _family_sql().items()}
    c = fl("close")
    recursive = "WITH RECURSIVE " + WEEKLY + ", " + EMA_SQL + "\n"
    sql["ema"] = recursive + out("e", {f"close_vs_ema_{s}": cl(f"(close - e{s}) / {c}") for s in (5, 15, 30)})
    sql["macd"] = recursive + out("e", {"macd_norm": cl(f"(e12 - e26) / {c}"), "macd_hist_norm": cl(f"(e12 - e26 - sig) / {c}")})
    for family, names in baseline.FAMILIES.items():
        def run(spark, sf, family=family, names=names):
            return show(baseline.add_baseline_features(weekly(spark, sf), (family,)), *names)
        query(f"features_{family}", sql[family])(run)


_register_families()


@query("baseline_features", None)
def baseline_features(spark, sf):
    """All 91 features in one pass; each family has its own SQL-checked query above."""
    bars, plan = planned_weekly(spark, sf, measure)
    return show(baseline.add_baseline_features(bars, blocks=plan), *baseline.BASELINE_FEATURES)


RET = f"p AS (SELECT *, ln(close / {lag('close')}) AS ret FROM b)"


@query("regime3", with_(HOURLY, RET, f"v AS (SELECT *, {roll('std', 'ret', 20, 5, True)} AS vol FROM p)", f"k AS (SELECT *, {roll('median', 'vol', 20, 5)} AS med FROM v)",
                        f"s AS (SELECT *, {roll('mean', 'med', 5, 5)} AS sm FROM k)") + out("s", {"regime": "CASE WHEN sm >= 1.6 THEN 1 WHEN sm <= 1.4 THEN 0 ELSE 0.5 END"}))
def regime3(spark, sf):
    return show(expansion.add_expansion(hourly(spark, sf), "regime", high=1.6, low=1.4), "regime")


Z_INPUTS = ("close", "volume", "high")


@query("zscores", with_(WEEKLY) + out("b", {f"{x}_zscore": bound(f"({x} - {roll('mean', x, 30, 30, True)}) / {fl(roll('std', x, 30, 30, True))}", -3.5, 3.5) for x in Z_INPUTS}))
def zscores(spark, sf):
    return show(expansion.add_zscores(weekly(spark, sf), Z_INPUTS), *[f"{x}_zscore" for x in Z_INPUTS])


def nearest(values: str, n: str, q: float, mp: int) -> str:
    return f"(CASE WHEN {n} >= {mp} THEN list_extract(list_sort({values}), (floor(({n} - 1) * {q}::DOUBLE + 0.5::DOUBLE))::INT + 1) END)"


@query("rolling_quantile", with_(WEEKLY, RET, f"l AS (SELECT *, list(ret) FILTER (ret IS NOT NULL) {over('ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING')} AS vals FROM p)")
       + out("l", {f"feature_ret_quantile_{q}_20".replace(".", "_"): bound(nearest("vals", "len(vals)", q, 20), -10, 10) for q in (0.2, 0.5, 0.8)}))
def rolling_quantile(spark, sf):
    df = expansion.add_expansion(weekly(spark, sf), "quantiles")
    return df.select("symbol", stamp(), *[r(f"`feature_ret_quantile_{q}_20`").alias(f"feature_ret_quantile_{q}_20".replace(".", "_")) for q in (0.2, 0.5, 0.8)])


@query("fourier", with_(MINUTELY, f"l AS (SELECT *, 2 * pi() * (hour({NY}) * 60 + minute({NY})) / 1440 AS a, isodow({NY}) AS d FROM b)")
       + out("l", {"feature_sin_time": "sin(a)", "feature_cos_time": "cos(a)", "feature_dow": "d"}))
def fourier(spark, sf):
    return show(expansion.add_fourier_features(minutely(spark, sf)), "feature_sin_time", "feature_cos_time", "feature_dow")


MOMENTS = [f"s AS (SELECT symbol, ts, {', '.join(f'{roll('sum', f'pow(ret, {p})', 20, 20, True)} AS s{p}' for p in (1, 2, 3, 4))} FROM p)",
           "t AS (SELECT *, s1 / 20 AS m, (s2 - 20 * (s1 / 20) * (s1 / 20)) / 19 AS v FROM s)",
           "u AS (SELECT *, CASE WHEN v >= 0 THEN sqrt(v) END AS sd, s3 - 3 * m * s2 + 40 * m * m * m AS m3, s4 - 4 * m * s3 + 6 * m * m * s2 - 60 * m * m * m * m AS m4 FROM t)"]


@query("moments", with_(WEEKLY, RET, *MOMENTS) + out("u", {
    "feature_ret_skew_20": cl("CASE WHEN sd > 1e-9 THEN m3 / 19 / (pow(sd, 3) + 1e-9) * (20.0::DOUBLE / 18) ELSE 0 END"),
    "feature_ret_kurt_20": cl("CASE WHEN abs(v) > 1e-9 THEN m4 / (20 * (v * v + 1e-9)) - 3 ELSE 0 END")}))
def moments(spark, sf):
    return show(expansion.add_expansion(weekly(spark, sf), "moments"), "feature_ret_skew_20", "feature_ret_kurt_20")


@query("acceleration", with_(WEEKLY, RET) + out("p", {"feature_ret_acceleration": cl(f"ret - {lag('ret')}")}))
def acceleration(spark, sf):
    return show(expansion.add_expansion(weekly(spark, sf), "acceleration"), "feature_ret_acceleration")


@query("vwap_deviation", with_(WEEKLY, "t AS (SELECT *, (high + low + close) / 3 * volume AS pv FROM b)",
                               f"w AS (SELECT *, {roll('sum', 'pv', 20, 20, True)} / {fl(roll('sum', 'volume', 20, 20, True))} AS vwap FROM t)")
       + out("w", {"feature_vwap_deviation": cl(f"(close - vwap) / {fl('vwap')}")}))
def vwap_deviation(spark, sf):
    return show(expansion.add_expansion(weekly(spark, sf), "vwap"), "feature_vwap_deviation")


@query("interactions", with_(WEEKLY, f"p AS (SELECT *, ln(close / {lag('close')}) AS ret_1, (high - low) / close AS spread FROM b)",
                             "g AS (SELECT *, CASE WHEN volume > 30 THEN 1.0 WHEN volume < 10 THEN 0.0 ELSE 0.5 END AS regime FROM p)")
       + out("g", {"pair_ret_1_x_spread": bound("ret_1 * spread", -10, 10), "cross_ret_1_x_volume": bound("ret_1 * volume", -10, 10),
                   "cross_spread_x_volume": bound("spread * volume", -10, 10), "ret_1_regime": "ret_1 * regime", "spread_regime": "spread * regime"}))
def interactions(spark, sf):
    bars = weekly(spark, sf)
    from tidebar.plans.blocks import block_window, halo, measure, trim
    df = trim(halo(bars, measure(bars), lookback=1).withColumns({
        "ret_1": F.ln(F.col("close") / F.lag("close").over(block_window())), "spread": (F.col("high") - F.col("low")) / F.col("close")}))
    df = df.withColumn("regime", F.when(F.col("volume") > 30, 1.0).when(F.col("volume") < 10, 0.0).otherwise(0.5))
    df = expansion.add_pairwise_interactions(df, ["spread", "ret_1"])
    df = expansion.add_cross_timeframe_interactions(df, ["ret_1", "spread"], ["volume"])
    df = expansion.add_regime_interactions(df, ["ret_1", "spread"])
    return show(df, "pair_ret_1_x_spread", "cross_ret_1_x_volume", "cross_spread_x_volume", "ret_1_regime", "spread_regime")


SESSIONED = f"s AS (SELECT *, {SESSION} AS session_id FROM b)"
PRIOR = ("c AS (SELECT symbol, session_id, min(ts) AS t0, arg_max(close, ts) AS cl FROM s GROUP BY ALL), "
         "pc AS (SELECT symbol, session_id, lag(cl, 1) OVER (PARTITION BY symbol ORDER BY t0) AS p1, lag(cl, 2) OVER (PARTITION BY symbol ORDER BY t0) AS p2 FROM c), "
         "j AS (SELECT s.*, p1, p2, max(high) OVER w AS top, min(low) OVER w AS bot FROM s JOIN pc USING (symbol, session_id) "
         "WINDOW w AS (PARTITION BY symbol, session_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")


@query("session_context", with_(MINUTELY, SESSIONED, PRIOR) + out("j", {
    "htf_distance_to_daily_high": bound(f"(top - close) / {fl('top')}", -10, 10), "htf_distance_to_daily_low": bound(f"(close - bot) / {fl('bot')}", -10, 10),
    "htf_daily_return_1": bound(f"ln(p1 / {fl('p2')})", -10, 10)}))
def session_context(spark, sf):
    return show(htf.add_session_context(sessions.add_session_id(minutely(spark, sf))), "htf_distance_to_daily_high", "htf_distance_to_daily_low", "htf_daily_return_1")


HTF_SQL = (HOURLY.replace("b AS", "hb AS"), MINUTELY, "h AS (SELECT symbol, ts + INTERVAL 1 HOUR AS hts, close AS hc FROM hb)",
           "a AS (SELECT b.*, h.hc FROM b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.hts)",
           f"p AS (SELECT *, {lag('close')} AS c1, {lag('close', 121)} AS cn, ln(close / {lag('close')}) AS ret, ln(hc / {lag('hc')}) AS hr FROM a)",
           f"t AS (SELECT *, (c1 - cn) / (120 * {fl('cn')}) AS slope, {fl(roll('std', 'ret', 60, 60, True))} AS vol, {roll('std', 'hr', 4, 4, True)} AS hv, {lag('hr')} AS hr1 FROM p)")


@query("htf_trend", with_(*HTF_SQL) + out("t", {
    "htf_daily_trend_slope_10": bound("slope", -10, 10), "htf_daily_vol_5": bound("vol", -10, 10),
    "htf_hourly_trend_alignment": bound("hr1 * sign(slope)", -10, 10), "htf_volatility_ratio": bound(f"hv / {fl('vol')}", -10, 10)}))
def htf_trend(spark, sf):
    base = sessions.add_session_id(minutely(spark, sf))
    df = align.align_htf(base, hourly(spark, sf), None)
    return show(htf.add_htf_context(df, slope_bars=120, vol_bars=60), "htf_daily_trend_slope_10", "htf_daily_vol_5",
                "htf_hourly_trend_alignment", "htf_volatility_ratio")


def _profile_sql(w: int, mp: int, name: str, source: str = "b") -> str:
    frame = over(f"ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING")
    return (f"{name}0 AS (SELECT *, {roll('sum', 'volume', w, mp, True)} AS tot, {roll('sum', 'close * volume', w, mp, True)} AS cv, list(close) {frame} AS vals FROM {source}), "
            f"{name} AS (SELECT *, cv / {fl('tot')} AS poc, {nearest('vals', 'len(vals)', 0.15, mp)} AS val, {nearest('vals', 'len(vals)', 0.85, mp)} AS vah FROM {name}0)")


INSIDE = "(close >= val AND close <= vah)::INT"


@query("volume_profile", with_(WEEKLY, _profile_sql(120, 10, "v"), f"w AS (SELECT *, ({lag('close')} >= val AND {lag('close')} <= vah)::INT * {lag('volume')} AS inva FROM v)")
       + out("w", {"feature_volume_poc": "coalesce(ln(poc), 0)", "feature_volume_val": "coalesce(val, 0)", "feature_volume_vah": "coalesce(vah, 0)",
                   "feature_distance_to_poc": cl(f"(close - poc) / {fl('poc')}"), "feature_inside_value_area": cl(INSIDE),
                   "feature_poc_stability": cl(roll("std", "poc", 5, 2)), "feature_volume_conc_in_va": cl(f"{roll('sum', 'inva', 120, 10)} / {fl('tot')}", 0, 1)}))
def volume_profile_long(spark, sf):
    from tidebar.plans.blocks import block_window, halo, measure, trim
    bars = weekly(spark, sf)
    framed = halo(bars, measure(bars), lookback=volume_profile.profile_lookback(120, 5))
    df = trim(volume_profile.profile_columns(framed, block_window(), 120, clip_levels=False))
    rounded = df.withColumn("feature_volume_poc", F.when(F.col("feature_volume_poc") > 0, F.ln("feature_volume_poc")).otherwise(F.lit(0.0)))
    return show(rounded, *[c for c in df.columns if c.startswith("feature_")])


@query("volume_profile_short", with_(WEEKLY, _profile_sql(48, 5, "v")) + out("v", {
    "feature_volume_poc_4h": cl("poc"), "feature_volume_val_4h": cl("val"), "feature_volume_vah_4h": cl("vah"),
    "feature_distance_to_poc_4h": cl(f"(close - poc) / {fl('poc')}"), "feature_inside_va_4h": cl(INSIDE)}))
def volume_profile_short(spark, sf):
    from tidebar.plans.blocks import block_window, halo, measure, trim
    bars = weekly(spark, sf)
    df = trim(volume_profile.short_profile_columns(halo(bars, measure(bars), lookback=49), block_window()))
    return show(df, *[c for c in df.columns if c.startswith("feature_")])


@query("spread_analysis", with_(WEEKLY, f"s AS (SELECT *, (high - low) / {fl('close')} AS spread FROM b)",
                                f"m AS (SELECT *, {roll('median', 'volume', 20, 5, True)} AS mv, {roll('median', 'spread', 20, 5, True)} AS ms FROM s)",
                                f"k AS (SELECT *, volume / {fl('mv')} AS vr, spread / {fl('ms')} AS sr, (volume > 2 * mv)::INT AS spike, (spread < 0.5 * ms)::INT AS tight, "
                                f"(spread > 2 * ms)::INT AS wide, abs(close - open) / {fl('high - low + 1e-9::DOUBLE')} AS br FROM m)")
       + out("k", {"feature_vol_to_spread_eff": cl(f"sr / {fl('vr')}"), "feature_vol_ratio_vs_med": cl("vr"), "feature_spread_ratio_vs_med": cl("sr"),
                   "feature_vol_spike": cl("spike"), "feature_vol_drought": cl("(volume < 0.5 * mv)::INT"), "feature_spread_compression": cl("tight"),
                   "feature_spread_expansion": cl("wide"), "feature_vol_climax": cl("spike * wide"), "feature_absorption": cl("spike * tight"),
                   "feature_body_ratio": cl("br", 0, 1), "feature_effort_vs_result": cl("br * vr")}))
def spread_analysis(spark, sf):
    df = volume_profile.add_spread_features(weekly(spark, sf))
    return show(df, *[c for c in df.columns if c.startswith("feature_")])


@query("expanded_features", None)
def expanded_features(spark, sf):
    """Z-scores, regime, quantiles, moments, VWAP and interactions over return features in one pass."""
    bars, plan = planned_weekly(spark, sf, measure)
    df = baseline.add_baseline_features(bars, ("returns", "momentum"), plan)
    out_df = expansion.expand_features(df, [*baseline.FAMILIES["returns"], *baseline.FAMILIES["momentum"]], pairwise=None, blocks=plan)
    return out_df.select("symbol", stamp(), *[r(f"`{c}`").alias(c.replace(".", "_")) for c in out_df.columns if c not in ("symbol", "ts_event")])


@query("feature_matrix", None)
def feature_matrix(spark, sf):
    """The whole matrix with expansion over session-stamped hourly bars."""
    df = engine.generate_features(sessions.add_session_id(hourly(spark, sf)), expansion=True, fill_gaps=True, slope_bars=120, vol_bars=60, daily_window=60, cross=10)
    return df.select("symbol", stamp(), *[r(f"`{c}`").alias(c.replace(".", "_")) for c in df.columns if c.startswith(("target_", "htf_", "ret_", "feature_", "cross_"))])
