"""Execution, metrics, trades, risk."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidebar.catalog.registry import STAMP, bound, fl, lag, lead, out, over, query, r, roll, rs, show, stamp, with_
from tidebar.catalog.views import HOURLY, MINUTELY, NY, daily, hourly, minutely
from tidebar.operators import execution, metrics, regime, risk
from tidebar.plans.blocks import measure
from tidebar.sources.dimensions import EARLY_CLOSES, market_dim

def prob():
    """A deterministic stand-in for model output, spread over (0.05, 0.95)."""
    return F.lit(0.05) + F.lit(0.9) * ((F.round(F.col("close") * 100).cast("long") * 7 + F.col("volume")) % 101) / F.lit(100.0)


PROB_SQL = "0.05::DOUBLE + 0.9::DOUBLE * ((round(close * 100)::BIGINT * 7 + volume) % 101) / 100.0::DOUBLE"
# Contract sizes scaled to the small prices of the tick data.
MARKET_ROWS = {"ES": (50.0, 50.0), "CL": (1000.0, 30.0), "NQ": (20.0, 30.0), "GC": (100.0, 40.0), "ZC": (50.0, 25.0)}
MARKETS_SQL = "mk AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {m}::DOUBLE, {p}::DOUBLE)" for s, (m, p) in MARKET_ROWS.items()) + ") t(symbol, mult, maxpos))"
SETTINGS = execution.ExecutionSettings(equity=100_000.0, max_leverage=3.0, risk_per_trade=0.05, commission=1.5, transaction_bps=0.75,
                                       slippage_bps=10.0, stop_pct=0.5, target_pct=0.8, gap_slippage_pct=0.002)


def markets(spark):
    return spark.createDataFrame([(s, m, p) for s, (m, p) in MARKET_ROWS.items()], "symbol string, multiplier double, max_position double")


def predicted(spark, sf):
    return minutely(spark, sf).withColumn("prediction_prob", prob())


def planned_backtest(spark, sf, settings=SETTINGS):
    """The backtest and the block plan of its bars, which are measured once."""
    bars = predicted(spark, sf)
    plan = measure(bars)
    return execution.add_benchmark(execution.simulate_execution(bars, markets(spark), settings, blocks=plan), blocks=plan), plan


def backtest(spark, sf, settings=SETTINGS):
    return planned_backtest(spark, sf, settings)[0]


LOD = f"(hour({NY}) * 60 + minute({NY}))"
SIGNALS = ("g AS (SELECT b.*, mult, maxpos, " + PROB_SQL + " AS prob FROM b JOIN mk USING (symbol)), "
           f"h AS (SELECT *, CASE WHEN prob > 0.55 THEN 1.0 WHEN prob < 0.45 THEN -1.0 ELSE 0.0 END AS sig, {fl('(high - low) / greatest(close, 1e-9)')} AS rp, "
           f"ln(close / {lag('close')}) AS ret FROM g), "
           f"i AS (SELECT *, {fl(roll('mean', 'rp', 14, 5, True))} AS atr, coalesce({fl(roll('std', 'ret', 20, 20, True))}, 1e-6) AS vol, "
           f"CASE WHEN ({LOD} >= 1020 AND {LOD} < 1080) OR ({LOD} >= 955 AND {LOD} < 1080) THEN 0.0 ELSE sig END AS t0 FROM h), "
           f"j AS (SELECT *, t0 * coalesce({bound('0.05 / atr', 0.1, 3.0)}, 1.0) AS t1, least(maxpos, 300000.0 / (greatest(open, 1e-9) * mult)) AS lim FROM i), "
           "k AS (SELECT *, least(greatest(t1, -lim), lim) AS sized, (high - low) / greatest(close, 1e-9) AS spr FROM j)")


@query("signals", with_(MINUTELY, MARKETS_SQL, SIGNALS) + out("k", {"raw_signal": "sig", "target_exec": "sized", "vol": "vol", "spread": "least(greatest(spr, 0), 0.05)", "unit_cost": "0.001075"}))
def signals(spark, sf):
    from tidebar.plans.blocks import block_window, halo, trim
    df = predicted(spark, sf)
    priced = df.join(F.broadcast(markets(spark)), "symbol")
    framed = execution.with_target_columns(halo(priced, measure(df), lookback=execution.EXECUTION_LOOKBACK), block_window(), SETTINGS)
    framed = framed.withColumn("unit_cost", F.lit((SETTINGS.transaction_bps + SETTINGS.slippage_bps) / 10_000.0))
    return show(trim(framed), "raw_signal", "target_exec", "vol", "spread", "unit_cost")


@query("bias_and_trend_gates", with_(MINUTELY, "g AS (SELECT *, CASE WHEN close > 20 THEN 1.0 WHEN close < 8 THEN -1.0 ELSE 0.0 END AS t, (volume - 1.5) AS al, (open - 15) / 100 AS sl FROM b)",
                                     "h AS (SELECT *, CASE WHEN (t > 0 AND al <= 0) OR (t < 0 AND al >= 0) THEN 0 ELSE t END AS biased, CASE WHEN (t > 0 AND sl < -0.05) OR (t < 0 AND sl > 0.05) THEN 0 ELSE t END AS trended FROM g)")
       + out("h", {"biased": "biased", "trended": "trended"}))
def bias_and_trend_gates(spark, sf):
    t = F.when(F.col("close") > 20, 1.0).when(F.col("close") < 8, -1.0).otherwise(F.lit(0.0))
    df = minutely(spark, sf).withColumns({"biased": execution.bias_gate(t, F.col("volume") - 1.5), "trended": execution.trend_gate(t, (F.col("open") - 15) / 100, 0.05)})
    return show(df, "biased", "trended")


FILL = ("CASE WHEN abs(pos) < 1e-9 OR open < 1e-9 THEN NULL WHEN pos > 0 THEN CASE WHEN open <= st THEN open * 0.998 WHEN high >= tg AND (low > st OR tg - open <= open - st) THEN tg WHEN low <= st THEN st END "
        "ELSE CASE WHEN open >= st THEN open * 1.002 WHEN low <= tg AND (high < st OR open - tg <= st - open) THEN tg WHEN high >= st THEN st END END")
LEVELS = "CASE WHEN {p} > 0 THEN open * (1 - {s}::DOUBLE) ELSE open * (1 + {s}::DOUBLE) END AS st, CASE WHEN {p} > 0 THEN open * (1 + {t}::DOUBLE) ELSE open * (1 - {t}::DOUBLE) END AS tg"


@query("intrabar", with_(HOURLY, "g AS (SELECT *, volume % 3 - 1 AS pos FROM b)", f"h AS (SELECT *, {LEVELS.format(p='pos', s=0.3, t=0.4)} FROM g)", f"i AS (SELECT *, {FILL} AS fill FROM h)")
       + out("i", {"fill": "fill", "intrabar_pnl": "CASE WHEN fill IS NULL THEN 0 ELSE (fill - open) * pos END"}))
def intrabar(spark, sf):
    pos = (F.col("volume") % 3 - 1).cast("double")
    fill = execution.intrabar_fill(F.col("open"), F.col("high"), F.col("low"), pos, 0.3, 0.4, 0.002)
    df = hourly(spark, sf).withColumn("fill", fill).withColumn("intrabar_pnl", F.coalesce((F.col("fill") - F.col("open")) * pos, F.lit(0.0)))
    return show(df, "fill", "intrabar_pnl")


PNL = (f"l AS (SELECT *, round_even(sized, 0) AS tgt, least(greatest((close - open) / greatest(open, 1e-9), -0.02), 0.02) AS rx FROM k), "
       f"m AS (SELECT *, coalesce({lag('tgt')}, 0) AS pos FROM l), "
       f"n AS (SELECT *, {LEVELS.format(p='pos', s=0.5, t=0.8)} FROM m), o AS (SELECT *, {FILL} AS fill FROM n), "
       "p AS (SELECT * REPLACE (CASE WHEN fill IS NULL THEN pos ELSE 0 END AS pos), CASE WHEN fill IS NULL THEN 0 ELSE (fill - open) * pos END AS ib FROM o), "
       f"q AS (SELECT *, coalesce(abs(pos - {lag('pos')}), 0) AS chg, 0.05 * open * mult AS cap FROM p), "
       "r AS (SELECT *, least(greatest(pos * rx * open * mult + ib * mult, -cap), cap) AS gross, chg * 1.5 + chg * open * mult * 0.001075::DOUBLE AS cost FROM q), "
       "s AS (SELECT *, least(greatest(gross - cost, -cap), cap) AS pnl FROM r), "
       f"eq AS (SELECT *, 100000 + sum(pnl) {over('ROWS UNBOUNDED PRECEDING')} AS equity FROM s), "
       f"bt AS (SELECT *, equity / max(equity) {over('ROWS UNBOUNDED PRECEDING')} - 1 AS dd FROM eq), "
       f"bl AS (SELECT *, {lag('close')} AS c1 FROM bt), bs AS (SELECT *, CASE WHEN c1 > {roll('mean', 'c1', 20, 20)} THEN 1.0 ELSE 0.0 END AS bsig FROM bl), "
       f"f AS (SELECT *, coalesce({lag('bsig')}, 0) * (close - open) / greatest(open, 1e-9) AS bench FROM bs)")
BACKTEST = (MINUTELY, MARKETS_SQL, SIGNALS, PNL)


# Money columns have few decimals, so rounding them meets exact ties that two engines may break differently;
# they are compared after scaling by pi.
MONEY = {"gross_pnl": "gross", "execution_cost": "cost", "pnl": "pnl", "equity_curve": "equity"}
PLAIN = {"target_exec": "tgt", "position": "pos", "pos_change": "chg", "ret_exec": "rx", "drawdown_pct": "dd", "benchmark_pnl": "bench"}


@query("backtest", with_(*BACKTEST) + out("f", {**PLAIN, **{f"{n}_x_pi": (f"({x}) * pi()", 4) for n, x in MONEY.items()}}))
def backtest_query(spark, sf):
    df = backtest(spark, sf)
    return df.select("symbol", stamp(), *[r(c).alias(c) for c in PLAIN], *[r(F.col(c) * math.pi, 4).alias(f"{c}_x_pi") for c in MONEY])


@query("execution_check", with_(*BACKTEST) + "SELECT symbol, count(*) AS rows, count(*) FILTER (abs(pnl - (gross - cost)) > 1e-3 + 1e-5 * abs(gross - cost)) AS net_mismatch, "
       "0::BIGINT AS duplicate_ts, 0::BIGINT AS non_finite FROM f GROUP BY symbol")
def execution_check(spark, sf):
    return execution.check_execution(backtest(spark, sf)).select("symbol", "rows", "net_mismatch", "duplicate_ts", "non_finite")


PATHS = (f"pa AS (SELECT *, {lag('pos')} AS prev, CASE WHEN abs(pos) > 1e-12 THEN sign(pos) ELSE 0 END AS side, sum(pnl) {over('ROWS UNBOUNDED PRECEDING')} AS cum, "
         f"sum(bench) {over('ROWS UNBOUNDED PRECEDING')} AS bcum, row_number() {over()} AS rn FROM f), "
         f"pb AS (SELECT *, max(cum) {over('ROWS UNBOUNDED PRECEDING')} AS peak, max(bcum) {over('ROWS UNBOUNDED PRECEDING')} AS bpeak, coalesce({lag('side')}, 0) AS pside, {lead('cum')} AS ncum FROM pa), "
         f"pc AS (SELECT *, sum((side <> pside)::INT) {over('ROWS UNBOUNDED PRECEDING')} AS srun, sum((pos <> coalesce(prev, 0))::INT) {over('ROWS UNBOUNDED PRECEDING')} AS vrun FROM pb)")
ANN = "sqrt(69552::DOUBLE)"
CORE = {
    "total_pnl": ("sum(pnl)", 3), "sharpe_annualized": f"CASE WHEN stddev_pop(pnl) > 1e-12 THEN avg(pnl) / stddev_pop(pnl) * {ANN} ELSE 0 END",
    "sortino_annualized": (f"avg(pnl) / (stddev_pop(pnl) FILTER (pnl < 0) + 1e-12) * {ANN}", 4), "max_drawdown": ("min(cum - peak)", 3),
    "max_drawdown_pct": "min((100000 + cum) / greatest(100000 + peak, 1e-12) - 1)", "calmar_ratio": ("avg(pnl) * 69552 / (abs(min(cum - peak)) + 1e-12)", 3),
    "position_turnover": "sum(abs(pos - coalesce(prev, pos)))", "position_change_events": "count(*) FILTER (abs(pos - coalesce(prev, pos)) > 1e-9)",
    "bar_hit_rate_all_bars": "count(*) FILTER (side <> 0 AND side = sign(rx)) / count(*)",
    "bar_hit_rate_active_bars": "count(*) FILTER (side <> 0 AND side = sign(rx)) / greatest(count(*) FILTER (side <> 0), 1)",
    "avg_holding_bars": "(max(rn) FILTER (pos <> coalesce(prev, 0)) - min(rn) FILTER (pos <> coalesce(prev, 0))) / (count(*) FILTER (pos <> coalesce(prev, 0)) - 1)",
    "benchmark_sharpe": f"avg(bench) / stddev_pop(bench) * {ANN}", "benchmark_max_drawdown": "min(bcum - bpeak)", "correlation_with_benchmark": "corr(pnl, bench)"}


def _agg(source: str, columns: dict, keys: str) -> str:
    body = ", ".join(f"{rs(*x) if isinstance(x, tuple) else rs(x)} AS {n}" for n, x in columns.items())
    return f"SELECT {keys}, {body} FROM {source} GROUP BY {keys}"


@query("core_metrics", with_(*BACKTEST, PATHS) + _agg("pc", CORE, "symbol"))
def core_metrics(spark, sf):
    df, plan = planned_backtest(spark, sf)
    m = metrics.core_metrics(metrics.with_path_columns(df, ("symbol",), plan), ("symbol",))
    return m.select("symbol", *[r(c, CORE[c][1] if isinstance(CORE[c], tuple) else 6).alias(c) for c in CORE])


TRADES = ("st AS (SELECT symbol, srun, sum(pnl) AS tp FROM pc WHERE side <> 0 GROUP BY ALL), sa AS (SELECT symbol, count(*) FILTER (tp > 0) / count(*) AS hit, count(*) AS hn FROM st GROUP BY symbol), "
          "vt AS (SELECT symbol, vrun, arg_max(coalesce(ncum, cum), ts) - arg_min(cum, ts) AS tp FROM pc WHERE pos <> 0 GROUP BY ALL), "
          "va AS (SELECT symbol, count(*) FILTER (tp > 0) / count(*) AS win, avg(tp) FILTER (tp > 0) AS aw, avg(tp) FILTER (tp < 0) AS al, sum(tp) FILTER (tp > 0) / abs(sum(tp) FILTER (tp < 0)) AS pf FROM vt GROUP BY symbol)")


@query("trades", with_(*BACKTEST, PATHS, TRADES) + f"SELECT symbol, {rs('hit')} AS trade_hit_rate, hn AS trade_hit_rate_n, {rs('win')} AS win_rate, {rs('aw', 3)} AS avg_win, {rs('al', 3)} AS avg_loss, "
       f"{rs('pf', 4)} AS profit_factor FROM sa JOIN va USING (symbol)")
def trades(spark, sf):
    df, plan = planned_backtest(spark, sf)
    t = metrics.trade_metrics(metrics.with_path_columns(df, ("symbol",), plan), ("symbol",), plan)
    return t.select("symbol", r("trade_hit_rate").alias("trade_hit_rate"), "trade_hit_rate_n", r("win_rate").alias("win_rate"),
                    r("avg_win", 3).alias("avg_win"), r("avg_loss", 3).alias("avg_loss"), r("profit_factor", 4).alias("profit_factor"))


SPEARMAN = (f"sl AS (SELECT symbol, ts, {lag('prob')} AS x, rx AS y FROM f), sk AS (SELECT * FROM sl WHERE x IS NOT NULL), "
            "rk AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2.0::DOUBLE AS ax, "
            "rank() OVER (PARTITION BY symbol ORDER BY y) + (count(*) OVER (PARTITION BY symbol, y) - 1) / 2.0::DOUBLE AS ay FROM sk)")


@query("spearman", with_(*BACKTEST, SPEARMAN) + f"SELECT symbol, count(*) AS spearman_n, {rs('corr(ax, ay)')} AS spearman_ic FROM rk GROUP BY symbol")
def spearman(spark, sf):
    df, plan = planned_backtest(spark, sf)
    ic = metrics.information_coefficient(df, blocks=plan, pvalue=False)
    return ic.select("symbol", "spearman_n", r("spearman_ic").alias("spearman_ic"))


# Simpson's rule on the density in u, t = sqrt(df) tan(u), in 20,000 steps from atan(t / sqrt(df)) to where it is below exp(-60) of its height
SIMPSON = ("list_sum(list_transform(range(0, 20001), lambda k: (CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * "
           "exp((n - 3) * ln(cos(u + least(acos(-1) / 2 - 1e-9 - u, sqrt(120 / greatest(n - 3, 1))) * k / 20000)))))"
           " * least(acos(-1) / 2 - 1e-9 - u, sqrt(120 / greatest(n - 3, 1))) / 60000")


@query("spearman_pvalue", with_(*BACKTEST, SPEARMAN, "si AS (SELECT symbol, count(*) AS n, corr(ax, ay) AS rho FROM rk GROUP BY symbol)",
                                "su AS (SELECT *, atan(abs(rho) / sqrt(1 - rho * rho)) AS u FROM si)")
       + f"SELECT symbol, n AS spearman_n, {rs('rho')} AS spearman_ic, {rs(f'2 / sqrt(acos(-1)) * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) * {SIMPSON}')} AS spearman_ic_pvalue FROM su")
def spearman_pvalue(spark, sf):
    """Checked against the density integrated by Simpson's rule, its height from the gamma function."""
    df, plan = planned_backtest(spark, sf)
    ic = metrics.information_coefficient(df, blocks=plan)
    return ic.select("symbol", "spearman_n", r("spearman_ic").alias("spearman_ic"), r("spearman_ic_pvalue").alias("spearman_ic_pvalue"))


@query("metrics_report", with_(*BACKTEST, PATHS) + f"SELECT symbol, {rs('sum(gross)', 3)} AS gross_total_pnl, {rs('sum(gross) - sum(pnl)', 3)} AS cost_drag, {rs('min(prob)')} AS pred_min, {rs('avg(prob)')} AS pred_mean, "
       f"{rs('stddev_pop(prob)')} AS pred_std, {rs('avg((prob > 0.55)::INT)')} AS pred_gt_0_55_frac, {rs('avg((prob < 0.45)::INT)')} AS pred_lt_0_45_frac, count(*) FILTER (pos > 1e-12) AS long_bars, "
       f"count(*) FILTER (pos < -1e-12) AS short_bars, {rs('max(abs(pos))')} AS max_abs_position FROM pc GROUP BY symbol")
def metrics_report(spark, sf):
    df, plan = planned_backtest(spark, sf)
    m = metrics.metrics_report(df, blocks=plan)
    return m.select("symbol", r("gross_total_pnl", 3).alias("gross_total_pnl"), r("cost_drag", 3).alias("cost_drag"), r("pred_min").alias("pred_min"), r("pred_mean").alias("pred_mean"),
                    r("pred_std").alias("pred_std"), r("pred_gt_0_55_frac").alias("pred_gt_0_55_frac"), r("pred_lt_0_45_frac").alias("pred_lt_0_45_frac"), "long_bars", "short_bars",
                    r("max_abs_position").alias("max_abs_position"))


RISK = ("dy AS (SELECT symbol, ts::DATE AS d, sum(pnl) AS dp, max(abs(pos)) AS mp, min(equity) AS me, min(dd) AS md FROM f GROUP BY ALL), "
        "rs AS (SELECT symbol, min(dp) AS dp, max(mp) AS mp, min(me) AS me, min(md) AS md FROM dy GROUP BY symbol)")


@query("risk_gates", with_(*BACKTEST, RISK) + " UNION ALL ".join(
    f"SELECT symbol, '{g}' AS gate, {rs(v, 3)} AS value, CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END AS status FROM rs" for g, v, ok in (
        ("equity_positive", "me", "me > 0"), ("max_position_size", "mp", "mp <= 40 + 1e-9"), ("daily_loss_limit", "dp", "dp >= -5000 - 1e-9"),
        ("max_drawdown_pct", "md", "md >= -0.2 - 1e-12"), ("finite_values", "0", "true"))))
def risk_gates(spark, sf):
    g = risk.risk_gates(backtest(spark, sf), max_position=40.0, daily_loss_limit=5000.0, max_drawdown=0.2)
    return g.select("symbol", "gate", r("value", 3).alias("value"), "status")


@query("year_rollup", with_(*BACKTEST) + f"SELECT symbol, month(ts)::INT AS year, count(*) AS rows, {rs('sum(pnl)', 3)} AS total_pnl, "
       f"{rs('CASE WHEN stddev_pop(pnl) > 1e-12 THEN avg(pnl) / stddev_pop(pnl) ELSE 0 END')} AS sharpe_per_bar FROM f GROUP BY ALL")
def year_rollup(spark, sf):
    m = metrics.year_breakdown(backtest(spark, sf).withColumn("year", F.month("ts_event")))
    return m.select("symbol", "year", "rows", r("total_pnl", 3).alias("total_pnl"), r("sharpe_per_bar").alias("sharpe_per_bar"))


@query("combined_pnl", with_(*BACKTEST) + f"SELECT {STAMP}, {rs('sum(pnl) * pi()', 4)} AS total_pnl_x_pi FROM f GROUP BY ts")
def combined_pnl(spark, sf):
    return metrics.combined_pnl(backtest(spark, sf)).select(stamp(), r(F.col("total_pnl") * math.pi, 4).alias("total_pnl_x_pi"))


@query("all_market_metrics", with_(*BACKTEST, "cm AS (SELECT 'ALL' AS symbol, ts, sum(pnl) AS pnl FROM f GROUP BY ts)", f"cc AS (SELECT *, sum(pnl) {over('ROWS UNBOUNDED PRECEDING')} AS cum FROM cm)",
                                   f"cp AS (SELECT *, max(cum) {over('ROWS UNBOUNDED PRECEDING')} AS peak FROM cc)")
       + f"SELECT symbol, count(*) AS rows, {rs('sum(pnl)', 3)} AS total_pnl, {rs('avg(pnl) / stddev_pop(pnl)')} AS sharpe_per_bar, {rs('min(cum - peak)', 3)} AS max_drawdown FROM cp GROUP BY symbol")
def all_market_metrics(spark, sf):
    m = metrics.all_market_metrics(backtest(spark, sf))
    return m.select("symbol", "rows", r("total_pnl", 3).alias("total_pnl"), r("sharpe_per_bar").alias("sharpe_per_bar"), r("max_drawdown", 3).alias("max_drawdown"))


DIAG = ("dg AS (SELECT symbol, prob AS p, (rx > 0)::INT AS y, rx, CASE WHEN 1 - prob > 0.55 THEN 1 WHEN 1 - prob < 0.45 THEN -1 ELSE 0 END AS inv FROM f), "
        "dr AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0::DOUBLE AS rk FROM dg)")


@query("prediction_diagnostics", with_(*BACKTEST, DIAG) + f"SELECT symbol, {rs('(sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))')} AS auc, {rs('avg((y - p) * (y - p))')} AS brier, "
       f"{rs('corr(p, rx)')} AS ic, {rs('sum(inv * rx)')} AS inverted_pnl FROM dr GROUP BY symbol")
def prediction_diagnostics(spark, sf):
    d = metrics.prediction_diagnostics(backtest(spark, sf), "ret_exec")
    return d.select("symbol", *[r(c).alias(c) for c in ("auc", "brier", "ic", "inverted_pnl")])


@query("split_diagnostics", with_(*BACKTEST) + f"SELECT symbol, 0 AS split_id, count(*) AS rows, count(*) FILTER (abs(tgt) > 1e-12) AS active, {rs('sum(pnl)', 3)} AS pnl_sum, {rs('sum(cost)', 3)} AS cost_sum, "
       "count(*) FILTER (prob < 1.0::DOUBLE / 3) AS prob_low, count(*) FILTER (prob >= 2.0::DOUBLE / 3) AS prob_high, count(*) FILTER (sig < 0) AS short_signals, count(*) FILTER (sig = 0) AS flat_signals FROM f GROUP BY symbol")
def split_diagnostics(spark, sf):
    d = metrics.split_diagnostics(backtest(spark, sf).withColumn("split_id", F.lit(0)))
    return d.select("symbol", "split_id", "rows", "active", r("pnl_sum", 3).alias("pnl_sum"), r("cost_sum", 3).alias("cost_sum"), "prob_low", "prob_high", "short_signals", "flat_signals")


@query("duplicate_outputs", None)
def duplicate_outputs(spark, sf):
    """Two splits with the same PnL share one checksum."""
    df = backtest(spark, sf)
    both = df.withColumn("split_id", F.explode(F.array(F.lit(0), F.lit(1))))
    return metrics.duplicate_outputs(metrics.column_checksum(both, ["pnl"]), "pnl_checksum")


@query("duplicate_members", with_(HOURLY, "o AS (SELECT symbol, k AS split_id, ts, CASE WHEN k = 4 AND volume % 2 = 0 THEN close + 1 ELSE close END AS close FROM b, range(0, 5) t(k), range(0, 2) d(c) WHERE c = 0 OR k IN (2, 3))",
                                  "h AS (SELECT symbol, split_id, md5(string_agg(ts::VARCHAR || '=' || close::VARCHAR, ',' ORDER BY ts, close)) AS m FROM o GROUP BY ALL)",
                                  "g AS (SELECT m, count(*) AS outputs, min(symbol || '/' || split_id) AS first_output FROM h GROUP BY m HAVING count(*) > 1)")
       + "SELECT symbol, split_id::INT AS split_id, outputs, first_output FROM h JOIN g USING (m)")
def duplicate_members(spark, sf):
    """Splits 0 and 1 hold the bars, 2 and 3 every bar twice, 4 other closes."""
    rows = hourly(spark, sf).withColumn("split_id", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2, 2, 3, 3, 4)])))
    rows = rows.withColumn("close", F.when((F.col("split_id") == 4) & (F.col("volume") % 2 == 0), F.col("close") + 1).otherwise(F.col("close")))
    return metrics.duplicate_members(metrics.column_checksum(rows, ["close"]), "close_checksum").select("symbol", "split_id", "outputs", "first_output")


@query("probabilistic_sharpe", with_(*BACKTEST, "ps_m AS (SELECT symbol, count(pnl) AS n, avg(pnl) AS mu, stddev_pop(pnl) AS s FROM f GROUP BY symbol)",
                                     "ps_g AS (SELECT symbol, any_value(n) AS n, any_value(mu / s) AS sr, avg(pow((pnl - mu) / s, 3)) AS g3, avg(pow((pnl - mu) / s, 4)) AS g4 FROM f JOIN ps_m USING (symbol) GROUP BY symbol)",
                                     "ps_z AS (SELECT *, sr * sqrt(n - 1) / sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-12)) AS z FROM ps_g)")
       + f"SELECT symbol, n, {rs('sr')} AS sharpe_per_bar, {rs('0.5 + z / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * k / 2000, 2) / 2)))')} AS psr FROM ps_z")
def probabilistic_sharpe(spark, sf):
    """Checked against the normal density integrated by Simpson's rule."""
    p = metrics.probabilistic_sharpe(backtest(spark, sf))
    return p.select("symbol", "n", r("sharpe_per_bar").alias("sharpe_per_bar"), r("psr").alias("psr"))


REGIME_P = {f"hmm_regime_{i}": e for i, e in enumerate(("volume % 7", "round(close * 100)::BIGINT % 7", "round(open * 100)::BIGINT % 7", "(volume + round(close * 100)::BIGINT) % 7"))}


@query("regime_gate", with_(HOURLY, "p AS (SELECT *, " + ", ".join(f"({e}) AS p{i}" for i, e in enumerate(REGIME_P.values())) + " FROM b)",
                            "q AS (SELECT *, CASE WHEN p0 >= greatest(p1, p2, p3) THEN 0 WHEN p1 >= greatest(p2, p3) THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS top FROM p)")
       + f"SELECT symbol, {STAMP}, top AS dominant, top IN (0, 3) AS hmm_trade_gate, {rs('CASE WHEN top IN (0, 3) THEN close ELSE 0 END')} AS target_exec FROM q")
def regime_gate(spark, sf):
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    values = (F.col("volume") % 7, cents("close") % 7, cents("open") % 7, (F.col("volume") + cents("close")) % 7)
    df = hourly(spark, sf).withColumns({f"hmm_regime_{i}": v.cast("double") for i, v in enumerate(values)}).withColumn("target_exec", F.col("close"))
    df = regime.apply_regime_gate(regime.add_trade_gate(df)).withColumn("dominant", regime.dominant_regime())
    return df.select("symbol", stamp(), "dominant", "hmm_trade_gate", r("target_exec").alias("target_exec"))
