"""Queries of operators that others are composed of: bridges, scalar functions, gates, contract checks, stored bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.bars import S_BARS, _session_bars
from tidebar.catalog.registry import STAMP, lag, lead, out, over, query, r, roll, rs, show, stamp, with_
from tidebar.catalog.trading import BACKTEST, MARKETS_SQL, PNL, PROB_SQL, SETTINGS, SIGNALS, backtest, markets, predicted
from tidebar.catalog.views import HOURLY, MINUTELY, WEEKLY, hourly, minutely, weekly
from tidebar.functions.columns import expit, hhmm, money
from tidebar.operators import align, discovery, engine, execution, metrics, splits, targets
from tidebar.plans.checkpoints import scratch_path
from tidebar.sources.bars import write_validated

# ---- bridges --------------------------------------------------------------------------------------------------

SHARES = {f"hmm_regime_{i}": f"((round(close * 100)::BIGINT + {i} * volume) % 97) / 96.0::DOUBLE" for i in range(4)}
PROBS = "pr AS (SELECT symbol, ts, " + ", ".join(f"{x} AS {n}" for n, x in SHARES.items()) + " FROM hb)"
HOUR_BARS = HOURLY.replace("b AS", "hb AS", 1)


def _shares(spark, sf):
    value = lambda i: ((F.round(F.col("close") * 100).cast("long") + i * F.col("volume")) % 97) / F.lit(96.0)
    return hourly(spark, sf).select("symbol", "ts_event", *[value(i).alias(f"hmm_regime_{i}") for i in range(4)])


@query("regime_attached", with_(HOUR_BARS, MINUTELY, PROBS, "sh AS (SELECT * REPLACE (ts + INTERVAL 1 HOUR AS ts) FROM pr)",
                                "j AS (SELECT b.symbol, b.ts, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in SHARES) + " FROM b ASOF LEFT JOIN sh ON b.symbol = sh.symbol AND b.ts >= sh.ts)")
       + out("j", {c: c for c in SHARES}))
def regime_attached(spark, sf):
    return show(align.attach_regime(minutely(spark, sf), _shares(spark, sf)), *SHARES)


@query("regime_by_position", with_(HOUR_BARS, MINUTELY, PROBS, "pk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, count(*) OVER (PARTITION BY symbol) AS rows FROM pr WHERE hour(ts) % 3 > 0)",
                                   "hk AS (SELECT symbol, h, row_number() OVER (PARTITION BY symbol ORDER BY h) AS k, count(*) OVER (PARTITION BY symbol) AS hours FROM (SELECT DISTINCT symbol, date_trunc('hour', ts) AS h FROM b))",
                                   "lk AS (SELECT hk.symbol, h, " + ", ".join(SHARES) + " FROM hk JOIN pk ON hk.symbol = pk.symbol AND n = CASE WHEN hours <= rows THEN rows - hours + k ELSE least(k, rows) END)",
                                   "j AS (SELECT b.symbol, b.ts, " + ", ".join(SHARES) + " FROM b LEFT JOIN lk ON lk.symbol = b.symbol AND lk.h = date_trunc('hour', b.ts))")
       + out("j", {c: c for c in SHARES}))
def regime_by_position(spark, sf):
    """A third of the hours has no probabilities, so the surplus hours at the end take the last ones."""
    probs = _shares(spark, sf).filter(F.hour("ts_event") % 3 > 0)
    return show(align.attach_regime_by_position(minutely(spark, sf), probs), *SHARES)


@query("resample_regime_hours", with_(MINUTELY, S_BARS, "x AS (SELECT symbol, session_id, date_trunc('hour', ts) AS h, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, "
                                      "sum(volume) AS volume, count(*) AS n FROM s GROUP BY ALL)", "y AS (SELECT * EXCLUDE (h, n), h AS ts FROM x WHERE n >= 10)")
       + out("y", {c: c for c in ("open", "high", "low", "close", "volume")}, "symbol, session_id"))
def resample_regime_hours(spark, sf):
    from tidebar.operators import sessions
    return show(sessions.resample_hourly_for_regime(_session_bars(spark, sf).drop("session_id")), "open", "high", "low", "close", "volume", keys=("symbol", "session_id"))


# ---- scalar functions -----------------------------------------------------------------------------------------

MONEY_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN '$' || format('{:,.2f}', o_totalprice) WHEN 1 THEN ' ' || o_totalprice::VARCHAR || ' ' WHEN 2 THEN 'n/a ' || o_orderkey ELSE 'inf' END"


@query("scalar_functions", f"SELECT o_orderkey, {rs('CASE WHEN o_orderkey % 4 < 2 THEN round(o_totalprice, 2) END', 2)} AS amount, (hour(t) * 60 + minute(t))::INT AS minute_of_day, "
       f"{rs('least(greatest(1 / (1 + exp(-(o_totalprice - 150000) / 40000)), 0.05), 0.95)')} AS share "
       "FROM (SELECT *, o_orderdate + to_minutes((o_orderkey * 7) % 1440) AS t FROM orders)")
def scalar_functions(spark, sf):
    """Money strings with signs, blanks and texts that are none; clock strings; the clipped logistic function."""
    from tidebar.functions.columns import clip
    o = spark.read.parquet(f"{sf}/orders.parquet")
    price, kind = F.col("o_totalprice"), F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("$"), F.format_number(price, 2))).when(kind == 1, F.concat(F.lit(" "), price.cast("string"), F.lit(" "))).when(
        kind == 2, F.concat(F.lit("n/a "), F.col("o_orderkey").cast("string"))).otherwise(F.lit("inf"))
    minutes = (F.col("o_orderkey") * 7) % 1440
    clock = F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))
    return o.select("o_orderkey", r(money(text), 2).alias("amount"), hhmm(clock).alias("minute_of_day"),
                    r(clip(expit((price - 150000) / 40000), 0.05, 0.95)).alias("share"))


# ---- execution and metrics ------------------------------------------------------------------------------------

SCALED = SIGNALS.replace("t0 * coalesce(", "t0 * least(greatest(1 / (greatest(0.001::DOUBLE * volume, 1e-9) * 100), -3), 3) * coalesce(")


@query("volatility_scaled", with_(MINUTELY, MARKETS_SQL, SCALED) + out("k", {"target_exec": "sized"}))
def volatility_scaled(spark, sf):
    from dataclasses import replace

    from tidebar.plans.blocks import block_window, halo, measure, trim
    df = predicted(spark, sf).withColumn("htf_daily_vol_5", 0.001 * F.col("volume")).join(F.broadcast(markets(spark)), "symbol")
    settings = replace(SETTINGS, vol_scaling_window=100)
    return show(trim(execution.with_target_columns(halo(df, measure(df), lookback=execution.EXECUTION_LOOKBACK), block_window(), settings)), "target_exec")


GATED_PNL = PNL.replace("round_even(sized, 0)", "round_even(CASE WHEN volume % 3 = 0 THEN 0 ELSE tgt0 END, 0)").replace("FROM k)", "FROM k1)", 1)
GATED = (MINUTELY, MARKETS_SQL, SIGNALS, "k1 AS (SELECT *, round_even(sized, 0) AS tgt0 FROM k)", GATED_PNL)


def _gated(spark, sf):
    bt = backtest(spark, sf)
    return execution.recompute_pnl(bt.withColumn("target_exec", F.when(F.col("volume") % 3 == 0, 0.0).otherwise(F.col("target_exec"))), SETTINGS)


@query("gated_pnl", with_(*GATED) + out("f", {"target_exec": "tgt", "position": "pos", "pnl_x_pi": ("(pnl) * pi()", 4), "equity_x_pi": ("(equity) * pi()", 4)}))
def gated_pnl(spark, sf):
    import math
    return _gated(spark, sf).select("symbol", stamp(), r("target_exec").alias("target_exec"), r("position").alias("position"),
                                    r(F.col("pnl") * math.pi, 4).alias("pnl_x_pi"), r(F.col("equity_curve") * math.pi, 4).alias("equity_x_pi"))


@query("gate_delta", "WITH " + "base AS (WITH " + ",\n".join(BACKTEST) + " SELECT symbol, sum(pnl) AS total FROM f GROUP BY symbol), gated AS (WITH " + ",\n".join(GATED)
       + f" SELECT symbol, sum(pnl) AS total FROM f GROUP BY symbol) SELECT symbol, {rs('base.total', 3)} AS base_total_pnl, {rs('gated.total', 3)} AS gated_total_pnl, "
       f"{rs('gated.total - base.total', 3)} AS delta_total_pnl FROM base JOIN gated USING (symbol)")
def gate_delta(spark, sf):
    total = lambda df: df.groupBy("symbol").agg(F.sum("pnl").alias("total_pnl"))
    d = metrics.metric_delta(total(backtest(spark, sf)), total(_gated(spark, sf)), keys=("symbol",))
    return d.select("symbol", *[r(c, 3).alias(c) for c in ("base_total_pnl", "gated_total_pnl", "delta_total_pnl")])


@query("prediction_correlation", with_(MINUTELY, f"p AS (SELECT symbol, {PROB_SQL} AS p, ln({lead('open', 16)} / {lead('open', 1)}) AS y FROM b)")
       + f"SELECT symbol, {rs('CASE WHEN count(*) >= 5 THEN corr(p, y) END')} AS pearson_ic FROM p WHERE y IS NOT NULL GROUP BY symbol")
def prediction_correlation(spark, sf):
    df = targets.add_target_15m(predicted(spark, sf))
    return metrics.prediction_correlation(df, "target_15m_ret").select("symbol", r("pearson_ic").alias("pearson_ic"))


# ---- contracts ------------------------------------------------------------------------------------------------

@query("target_check", with_(WEEKLY, f"t AS (SELECT symbol, ln({lead('open', 16)} / {lead('open', 1)}) AS y FROM b)")
       + "SELECT symbol, count(*) AS rows, count(*) FILTER (y IS NULL) AS null_target, count(*) FILTER (y IS NULL) = 0 AS passed FROM t GROUP BY symbol")
def target_check(spark, sf):
    return engine.check_target(targets.add_target_15m(weekly(spark, sf)), "target_15m_ret")


@query("aligned_check", with_(MINUTELY, "t AS (SELECT *, CASE WHEN volume % 5 = 0 THEN NULL ELSE volume END AS v, close * 1.5::DOUBLE + CASE WHEN volume = 2 THEN 0.01 ELSE 0 END AS cp FROM b)")
       + "SELECT symbol, count(*) AS rows, count(*) FILTER (v IS NULL) AS null_volume, count(*) FILTER (cp <= 0) AS nonpositive_continuous_price, 0::BIGINT AS high_lt_low, count(*) FILTER (abs(cp - close * 1.5) > 1e-3) AS factor_mismatch, "
       "0::BIGINT AS duplicate_ts, count(*) FILTER (v IS NULL OR cp <= 0 OR abs(cp - close * 1.5) > 1e-3) = 0 AS passed FROM t GROUP BY symbol")
def aligned_check(spark, sf):
    bars = minutely(spark, sf)
    df = bars.withColumns({"session_id": F.lit("s"), "cumulative_factor": F.lit(1.5), "contract_multiplier": F.lit(50.0),
                           "continuous_price": F.col("close") * 1.5 + F.when(F.col("volume") == 2, 0.01).otherwise(0.0),
                           **{f"continuous_{c}": F.col(c) * 1.5 for c in ("open", "high", "low")}})
    df = df.withColumn("volume", F.when(F.col("volume") % 5 != 0, F.col("volume")))
    return engine.check_aligned(df).select("symbol", "rows", "null_volume", "nonpositive_continuous_price", "high_lt_low", "factor_mismatch", "duplicate_ts", "passed")


@query("prediction_frame_check", with_(MINUTELY, f"t AS (SELECT symbol, ts, CASE WHEN volume = 3 THEN NULL ELSE {PROB_SQL} + CASE WHEN volume = 2 THEN 1 ELSE 0 END END AS p FROM b)")
       + "SELECT symbol, count(*) AS rows, count(*) FILTER (p IS NULL OR p > 1) AS bad_prob, 0::BIGINT AS bad_signal, count(*) FILTER (ts < TIMESTAMP '2024-01-03') AS outside_window, 0::BIGINT AS duplicate_ts, "
       "count(*) FILTER (p IS NULL OR p > 1 OR ts < TIMESTAMP '2024-01-03') = 0 AS passed FROM t GROUP BY symbol")
def prediction_frame_check(spark, sf):
    df = predicted(spark, sf)
    p = F.col("prediction_prob")
    bad = df.withColumn("prediction_prob", F.when(F.col("volume") == 3, None).when(F.col("volume") == 2, p + 1).otherwise(p))
    frame = splits.prediction_frame(bad.withColumn("raw_signal", execution.raw_signal(p)))
    return splits.check_predictions(frame, df.filter(F.col("ts_event") >= F.lit("2024-01-03").cast("timestamp")), ("symbol",))


@query("frozen_columns", "SELECT unnest(['symbol', 'ts_event', 'open', 'high', 'low', 'close', 'volume', 'target_15m_ret', 'ret_5', 'mom_10']) AS \"column\", (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, date_trunc('week', l_shipdate) FROM lineitem)) AS rows")
def frozen_columns(spark, sf):
    """The manifest keeps essentials, the target and the selected features, and every row."""
    from tidebar.operators import baseline
    df = targets.add_target_15m(baseline.add_baseline_features(weekly(spark, sf), ("returns", "momentum"))).drop("target_15m_dir", "target_15m_trade_class")
    kept = discovery.apply_manifest(df, ["ret_5", "mom_10"], "target_15m_ret")
    return kept.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(F.array(*[F.lit(c) for c in kept.columns])).alias("column"), "rows")


TOUCH = ("u AS (SELECT *, ln(close) - " + lag("ln(close)") + " AS ret FROM b), v AS (SELECT *, coalesce(" + roll("std", "ret", 260, 20) + ", 0.0005) AS bv FROM u), "
         f"w AS (SELECT *, greatest(bv, 0.0001) * sqrt(64) AS wid, list(high) {over('ROWS BETWEEN 1 FOLLOWING AND 64 FOLLOWING')} AS hs, "
         f"list(low) {over('ROWS BETWEEN 1 FOLLOWING AND 64 FOLLOWING')} AS ls, {lead('close', 64)} AS last FROM v), "
         "x AS (SELECT *, coalesce(list_position(list_transform(hs, lambda h: h >= close * exp(wid)), true), 65) AS u, "
         "coalesce(list_position(list_transform(ls, lambda l: l <= close * exp(-wid)), true), 65) AS d FROM w)")


@query("triple_barrier_64", with_(MINUTELY, TOUCH) + out("x", {
    "target_tb": "CASE WHEN last IS NOT NULL THEN CASE WHEN u <= 64 AND u <= d THEN 1 WHEN d <= 64 AND d < u THEN -1 ELSE 0 END END"}))
def triple_barrier_64(spark, sf):
    """The default horizon, without cuts at price bands."""
    return show(targets.triple_barrier(minutely(spark, sf), price_bands=False), "target_tb")


# ---- stored bars ----------------------------------------------------------------------------------------------

@query("validated_round_trip", with_(MINUTELY) + f"SELECT symbol, year(ts)::INT AS file_year, {STAMP}, " + ", ".join(f"{rs(c)} AS {c}" for c in ("open", "high", "low", "close", "volume")) + " FROM b")
def validated_round_trip(spark, sf):
    path = scratch_path(spark, "validated")
    write_validated(minutely(spark, sf).withColumn("file_year", F.year("ts_event")), path, file_rows=1000)
    return show(spark.read.parquet(path), "open", "high", "low", "close", "volume", keys=("symbol", "file_year"))
