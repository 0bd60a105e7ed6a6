"""Targets, splits, folds and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.registry import STAMP, lag, lead, lnq, out, over, query, r, roll, rs, show, stamp, with_
from tidebar.catalog.views import DAILY, HOURLY, MINUTELY, NY, WEEKLY, daily, hourly, minutely, weekly
from tidebar.operators import discovery, modelling, sessions, splits, targets

COST = "(0.001::DOUBLE + 2 * 1.5::DOUBLE / greatest(ent, 1e-9))"


@query("target_15m", with_(WEEKLY, f"t AS (SELECT *, {lead('open', 1)} AS ent, ln({lead('open', 16)} / {lead('open', 1)}) AS fwd FROM b)")
       + out("t", {"target_15m_ret": "fwd", "target_15m_dir": "(fwd > 0)::INT",
                   "target_15m_trade_class": f"CASE WHEN fwd > {COST} THEN 1 WHEN fwd < -{COST} THEN -1 ELSE 0 END"}))
def target_15m(spark, sf):
    df = targets.add_target_15m(weekly(spark, sf), tx_cost=0.001, commission=1.5)
    return show(df, "target_15m_ret", "target_15m_dir", "target_15m_trade_class")


@query("complete_targets", with_(WEEKLY, f"t AS (SELECT *, ln({lead('open', 16)} / {lead('open', 1)}) AS fwd FROM b)") + out("t", {"target_15m_ret": "fwd"}) + " WHERE fwd IS NOT NULL")
def complete_targets(spark, sf):
    return show(targets.drop_incomplete_target(targets.add_target_15m(weekly(spark, sf))), "target_15m_ret")


TB = ("t AS (SELECT *, floor(log10(close) / 0.5::DOUBLE) AS band FROM b), "
      f"u AS (SELECT *, (CASE WHEN band <> {lag('band')} THEN 1 ELSE 0 END) AS chg, ln(close) - {lag('ln(close)')} AS ret FROM t), "
      f"v AS (SELECT *, sum(chg) {over()} AS seg, coalesce({roll('std', 'ret', 260, 20)}, 0.0005) AS bv FROM u), "
      f"w AS (SELECT *, greatest(bv, 0.0001) * sqrt(8) AS wid, list(high) {over('ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING')} AS hs, "
      f"list(low) {over('ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING')} AS ls, {lead('seg', 8)} AS eseg FROM v), "
      "x AS (SELECT *, coalesce(list_position(list_transform(hs, lambda h: h >= close * exp(wid)), true), 9) AS u, "
      "coalesce(list_position(list_transform(ls, lambda l: l <= close * exp(-wid)), true), 9) AS d FROM w)")


@query("triple_barrier", with_(WEEKLY, TB) + out("x", {
    "target_tb": "CASE WHEN eseg = seg THEN CASE WHEN u <= 8 AND u <= d THEN 1 WHEN d <= 8 AND d < u THEN -1 ELSE 0 END END"}))
def triple_barrier(spark, sf):
    return show(targets.triple_barrier(weekly(spark, sf), horizon=8), "target_tb")


@query("meta_label", with_(WEEKLY, f"t AS (SELECT *, CASE WHEN volume > 30 THEN 1 WHEN volume < 10 THEN -1 ELSE 0 END AS pred, CASE WHEN close > {lag('close')} THEN 1 ELSE -1 END AS act FROM b)")
       + out("t", {"target_meta": "CASE WHEN pred = 0 THEN -1 WHEN pred = act THEN 1 ELSE 0 END"}))
def meta_label(spark, sf):
    from tidebar.plans.blocks import block_window, halo, measure, trim
    bars = weekly(spark, sf)
    df = trim(halo(bars, measure(bars), lookback=1).withColumns({
        "primary_prediction": F.when(F.col("volume") > 30, 1).when(F.col("volume") < 10, -1).otherwise(0),
        "target_tb": F.when(F.col("close") > F.lag("close").over(block_window()), 1).otherwise(-1)}))
    return show(targets.add_meta_label(df), "target_meta")


@query("daily_regime", with_(DAILY, f"t AS (SELECT *, ({lag('close')} - {lag('close', 11)}) / (10 * greatest({lag('close', 11)}, 1e-9)) AS slope FROM b)")
       + out("t", {"target_daily_regime": "CASE WHEN slope > 0 THEN 1 WHEN slope < 0 THEN -1 ELSE 0 END"}))
def daily_regime(spark, sf):
    from tidebar.operators import htf
    df = htf.add_htf_context(daily(spark, sf).withColumn("session_id", F.date_format("ts_event", "yyyy-MM")), slope_bars=10, vol_bars=5)
    return show(targets.add_target_daily_regime(df), "target_daily_regime")


SPAN = "sp AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS z, (max(ts)::DATE - min(ts)::DATE) + 1 AS days FROM b)"
SPLITS = (SPAN + ", yb AS (SELECT year(ts) AS y, min(ts)::DATE AS f, max(ts)::DATE AS l FROM b GROUP BY 1), "
          "sl AS (SELECT (k // 90)::INT AS split_id, (a + k::INT) AS train_start, (a + k::INT + 360) AS train_end, (a + k::INT + 450) AS test_end FROM sp, range(0, days - 450 + 1, 90) t(k))")


@query("day_splits", with_(DAILY, SPLITS) + "SELECT split_id, train_start::VARCHAR AS train_start, train_end::VARCHAR AS train_end, train_end::VARCHAR AS test_start, test_end::VARCHAR AS test_end, "
       "(SELECT string_agg(y::VARCHAR, ',' ORDER BY y) FROM yb WHERE l >= train_start AND f < train_end) AS train_years, "
       "(SELECT string_agg(y::VARCHAR, ',' ORDER BY y) FROM yb WHERE l >= train_end AND f < test_end) AS test_years FROM sl")
def day_splits(spark, sf):
    return _splits(daily(spark, sf)).select(
        "split_id", *[F.col(c).cast("string").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")],
        F.concat_ws(",", F.transform("train_years", lambda y: y.cast("string"))).alias("train_years"),
        F.concat_ws(",", F.transform("test_years", lambda y: y.cast("string"))).alias("test_years"))


def _splits(bars):
    return splits.day_splits(splits.year_bounds(bars), 360, 90, 90)


ASSIGNED = ("m AS (SELECT b.symbol, b.ts, b.close, split_id, CASE WHEN b.ts < train_end THEN 'train' ELSE 'test' END AS role, train_end FROM b JOIN sl "
            "ON b.ts >= train_start AND b.ts < test_end)")


@query("split_assignment", with_(DAILY, SPLITS, ASSIGNED) + f"SELECT symbol, split_id, role, count(*) AS rows, {rs('sum(close)', 2)} AS total FROM m GROUP BY ALL")
def split_assignment(spark, sf):
    bars = daily(spark, sf)
    out_df = splits.assign_splits(bars, _splits(bars))
    return out_df.groupBy("symbol", "split_id", "role").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("close"), 2).alias("total"))


@query("purged_train", with_(DAILY, SPLITS, ASSIGNED) + f"SELECT symbol, split_id, role, {STAMP} FROM m WHERE role = 'test' OR ts < train_end - INTERVAL 4320 MINUTE")
def purged_train(spark, sf):
    bars = daily(spark, sf)
    parts = _splits(bars)
    return splits.purge_train_tail(splits.assign_splits(bars, parts), parts, minutes=4320).select("symbol", "split_id", "role", stamp())


@query("slice_window", with_(MINUTELY) + f"SELECT symbol, {STAMP}, {rs('close')} AS close FROM b WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 75 MINUTE")
def slice_window(spark, sf):
    return show(splits.slice_window(minutely(spark, sf), "2024-01-05", "2024-01-20", "test", "target_15m_ret"), "close")


@query("recent_days", with_(MINUTELY, f"c AS (SELECT symbol, (date_trunc('day', max({NY})) - INTERVAL 7 DAY)::TIMESTAMP AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS cut FROM b GROUP BY symbol)")
       + f"SELECT symbol, {STAMP}, {rs('close')} AS close FROM b JOIN c USING (symbol) WHERE ts >= cut")
def recent_days(spark, sf):
    return show(splits.recent_days(minutely(spark, sf), 7), "close")


@query("exclude_warmup", with_(WEEKLY, "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS c FROM b)")
       + f"SELECT symbol, {STAMP}, {rs('close')} AS close FROM n WHERE c <= 290 OR k > 291")
def exclude_warmup(spark, sf):
    return show(splits.exclude_warmup(weekly(spark, sf), 290), "close")


FOLDS = ("n AS (SELECT symbol, count(*) AS rows FROM b GROUP BY symbol), s AS (SELECT *, greatest(100, floor(rows * 0.6::DOUBLE))::BIGINT AS tr, greatest(20, floor(rows * 0.2::DOUBLE))::BIGINT AS te FROM n), "
         "c AS (SELECT *, CASE WHEN rows - tr - te < 0 THEN 0 ELSE (rows - tr - te) // te + 1 END AS folds FROM s), "
         "f AS (SELECT symbol, rows, folds, k AS fold, k * te AS train_from, k * te + tr AS train_to, k * te + tr + te AS test_to FROM c, range(0, folds) t(k) WHERE folds >= 2)")


@query("bar_folds", with_(WEEKLY, FOLDS) + "SELECT symbol, rows, folds::BIGINT AS folds, fold::BIGINT AS fold, train_from, train_to, train_to AS test_from, test_to FROM f")
def bar_folds(spark, sf):
    f = splits.bar_folds(weekly(spark, sf), 100, 20).filter("fold is not null")
    return f.select("symbol", *[F.col(c).cast("long").alias(c) for c in f.columns if c != "symbol"])


@query("fold_assignment", with_(WEEKLY, FOLDS, "i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos0 FROM b)")
       + f"SELECT i.symbol, fold::INT AS split_id, CASE WHEN pos0 < train_to THEN 'train' ELSE 'test' END AS role, count(*) AS rows, {rs('sum(close)', 2)} AS total "
       "FROM i JOIN f ON i.symbol = f.symbol AND pos0 >= train_from AND pos0 < test_to GROUP BY ALL")
def fold_assignment(spark, sf):
    bars = weekly(spark, sf)
    df = splits.assign_folds(bars, splits.bar_folds(bars, 100, 20))
    return df.groupBy("symbol", F.col("split_id").cast("int").alias("split_id"), "role").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("close"), 2).alias("total"))


@query("stratified_sample", with_(WEEKLY, "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos0, count(*) OVER (PARTITION BY symbol) AS n FROM b)",
                                  "s AS (SELECT *, n // 3 AS seg, greatest(1, (n // 3) // least(n // 3, 30)) AS step FROM n)",
                                  "p AS (SELECT *, least(pos0 // seg, 2) AS part, pos0 - least(pos0 // seg, 2) * seg AS off FROM s)",
                                  "q AS (SELECT *, ceil(seg / step)::BIGINT AS per FROM p)",
                                  "z AS (SELECT *, CASE WHEN 3 * per > 90 THEN greatest(1, (3 * per) // 90) ELSE 1 END AS again, part * per + off // step AS num FROM q)")
       + f"SELECT symbol, {STAMP}, {rs('close')} AS close FROM z WHERE n <= 90 OR (pos0 < 3 * seg AND off % step = 0 AND num % again = 0 AND num // again < 90)")
def stratified_sample(spark, sf):
    return show(discovery.stratified_sample(weekly(spark, sf), 90), "close")


@query("smoothed_probabilities", "WITH RECURSIVE " + MINUTELY + f", n AS (SELECT symbol, strftime({NY} + INTERVAL 6 HOUR, '%Y-%m-%d') AS sid, ts, 0.05::DOUBLE + 0.9::DOUBLE * "
       "((round(close * 100)::BIGINT * 7 + volume) % 101) / 100.0::DOUBLE AS p, row_number() OVER (PARTITION BY symbol, "
       f"strftime({NY} + INTERVAL 6 HOUR, '%Y-%m-%d') ORDER BY ts) AS k FROM b), "
       "e AS (SELECT symbol, sid, ts, k, 0.3::DOUBLE * least(greatest(p, 0.1), 0.9) + 0.7::DOUBLE * 0.5::DOUBLE AS s FROM n WHERE k = 1 UNION ALL "
       "SELECT n.symbol, n.sid, n.ts, n.k, 0.3::DOUBLE * least(greatest(n.p, 0.1), 0.9) + 0.7::DOUBLE * e.s FROM e JOIN n ON n.symbol = e.symbol AND n.sid = e.sid AND n.k = e.k + 1) "
       + f"SELECT symbol, {STAMP}, {rs('ln(s)')} AS log_prob FROM e")
def smoothed_probabilities(spark, sf):
    from tidebar.catalog.trading import prob
    df = sessions.add_session_id(minutely(spark, sf)).withColumn("prediction_prob", prob())
    out_df = modelling.smooth_probabilities(df, 0.3)
    return out_df.select("symbol", stamp(), r(F.ln("prediction_prob")).alias("log_prob"))
