"""Feature filters, scaling, ridge, regimes, walk-forward."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.registry import STAMP, lag, lead, out, over, query, r, roll, rs, show, stamp, with_
from tidebar.catalog.trading import SETTINGS, backtest, markets
from tidebar.catalog.views import HOURLY, MINUTELY, WEEKLY, hourly, minutely, planned_weekly, weekly
from tidebar.operators import baseline, discovery, modelling, regime, sessions, splits, targets
from tidebar.plans.blocks import measure
from tidebar.plans.checkpoints import checkpointed

COLS = ("open", "high", "low", "close", "volume")


@query("variance_filter", with_(WEEKLY) + " UNION ALL ".join(f"SELECT '{c}' AS feature FROM b HAVING var_pop({x}) > 1e-9" for c, x in (*[(c, c) for c in COLS], ("flat", "1.0"))))
def variance_filter(spark, sf):
    df = weekly(spark, sf).withColumn("flat", F.lit(1.0))
    return spark.createDataFrame([(c,) for c in modelling.variance_filter(df, [*COLS, "flat"])], "feature string")


@query("correlation_matrix", with_(WEEKLY) + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rs(f'corr({a}, {b})')} AS corr FROM b" for i, a in enumerate(COLS) for b in COLS[i + 1:]))
def correlation_matrix(spark, sf):
    m = modelling.correlation_matrix(weekly(spark, sf), COLS)
    rows = [(COLS[i], COLS[j], float(m[i, j])) for i in range(5) for j in range(i + 1, 5)]
    return spark.createDataFrame(rows, "a string, b string, corr double").withColumn("corr", r("corr"))


@query("correlation_prune", with_(WEEKLY, "c AS (SELECT abs(corr(open, high)) AS oh, abs(corr(open, low)) AS ol, abs(corr(high, low)) AS hl, abs(corr(open, close)) AS oc, abs(corr(high, close)) AS hc, abs(corr(low, close)) AS lc FROM b)")
       + "SELECT 'open' AS feature FROM c UNION ALL SELECT 'high' FROM c WHERE oh <= 0.8 UNION ALL SELECT 'low' FROM c WHERE ol <= 0.8 AND (oh > 0.8 OR hl <= 0.8) UNION ALL "
       "SELECT 'close' FROM c WHERE oc <= 0.8 AND (oh > 0.8 OR hc <= 0.8) AND ((ol > 0.8 OR (oh <= 0.8 AND hl > 0.8)) OR lc <= 0.8)")
def correlation_prune(spark, sf):
    kept = modelling.correlation_prune(weekly(spark, sf), ("open", "high", "low", "close"), 0.8)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("robust_scale", with_("b AS (SELECT event_type AS symbol, value / 20 AS a, ln(value) AS l FROM events)",
                             "x AS (SELECT symbol, least(greatest(a, -8), 8) AS a, least(greatest(l, -8), 8) AS l FROM b)")
       + f"SELECT symbol, {rs('median(a)')} AS median_a, {rs('1 / greatest(quantile_cont(a, 0.75) - quantile_cont(a, 0.25), 0.01)')} AS scale_a, {rs('median(l)')} AS median_l, "
       f"{rs('1 / greatest(quantile_cont(l, 0.75) - quantile_cont(l, 0.25), 0.01)')} AS scale_l FROM x GROUP BY symbol")
def robust_scale(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), (F.col("value") / 20).alias("a"), F.ln("value").alias("l"))
    s = modelling.robust_stats(e, ["a", "l"], ["symbol"])
    return s.select("symbol", *[r(F.col(f)[i]).alias(f"{n}_{c}") for i, c in enumerate(("a", "l")) for f, n in (("medians", "median"), ("scales", "scale"))])


def _pair_sql() -> str:
    """Ridge on one feature has a closed form: beta = Sxy / (Sxx + alpha)."""
    return (with_(WEEKLY, "t AS (SELECT symbol, ln(close) AS x, ln(open) AS y FROM b)", "s AS (SELECT symbol, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx, avg(x) AS mx, avg(y) AS my FROM t GROUP BY symbol)")
            + f"SELECT symbol, {rs('sxy / (sxx + 1)')} AS beta, {rs('my - sxy / (sxx + 1) * mx')} AS intercept FROM s")


@query("ridge", _pair_sql())
def ridge(spark, sf):
    df = weekly(spark, sf).withColumns({"x": F.ln("close"), "y": F.ln("open")})
    m = modelling.ridge_fit(df, ["x"], "y", ["symbol"], alpha=1.0)
    return m.select("symbol", r(F.col("coefficients")[0]).alias("beta"), r("intercept").alias("intercept"))


@query("ridge_offset", _pair_sql().replace("ln(close) AS x, ln(open) AS y", "close + 100000000 AS x, open + 100000000 AS y")
       .replace(rs("my - sxy / (sxx + 1) * mx"), rs("my - sxy / (sxx + 1) * mx", 0)))
def ridge_offset(spark, sf):
    """Means far above the spread: sums of squares about zero would lose the slope."""
    df = weekly(spark, sf).withColumns({"x": F.col("close") + 1e8, "y": F.col("open") + 1e8})
    m = modelling.ridge_fit(df, ["x"], "y", ["symbol"], alpha=1.0)
    return m.select("symbol", r(F.col("coefficients")[0]).alias("beta"), r("intercept", 0).alias("intercept"))


LOGIT = "ln(avg(y) FILTER (a = {0} AND b = {1}) / (1 - avg(y) FILTER (a = {0} AND b = {1})))"


@query("logistic", "WITH t AS (SELECT l_linenumber::VARCHAR AS symbol, (l_quantity > 25)::INT AS a, (l_extendedprice > 30000)::INT AS b, (l_discount > 0.05::DOUBLE)::INT::DOUBLE AS y FROM lineitem), "
       f"s AS (SELECT symbol, {LOGIT.format(0, 0)} AS l00, {LOGIT.format(1, 0)} AS l10, {LOGIT.format(0, 1)} AS l01, {LOGIT.format(1, 1)} AS l11 FROM t GROUP BY symbol) "
       f"SELECT symbol, {rs('l00')} AS intercept, {rs('l10 - l00')} AS beta_a, {rs('l01 - l00')} AS beta_b, {rs('l11 - l10 - l01 + l00')} AS beta_ab FROM s")
def logistic(spark, sf):
    """Two flags and their product: the model without a penalty has the log odds of the four cells as its closed form."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    df = li.select(F.col("l_linenumber").cast("string").alias("symbol"), (F.col("l_quantity") > 25).cast("double").alias("a"), (F.col("l_extendedprice") > 30000).cast("double").alias("b"),
                   (F.col("l_discount") > 0.05).cast("double").alias("y")).withColumn("ab", F.col("a") * F.col("b"))
    m = modelling.logistic_fit(df, ["a", "b", "ab"], "y", ["symbol"], alpha=0.0)
    return m.select("symbol", r("intercept").alias("intercept"), *[r(F.col("coefficients")[i]).alias(f"beta_{c}") for i, c in enumerate(("a", "b", "ab"))])


def _featured(spark, sf):
    """Weekly bars with a few features and the forward label, and their block plan.

    Stored once, without unused columns: folds are counted, numbered and cut from them in several passes.
    """
    bars, plan = planned_weekly(spark, sf, measure)
    df = baseline.add_baseline_features(bars, ("returns", "momentum", "volume"), plan)
    df = targets.drop_incomplete_target(targets.add_target_15m(df, blocks=plan))
    return checkpointed(df.select(*bars.columns, *FEATURES, "target_15m_ret")), plan


def _labelled(spark, sf):
    """`_featured` rows split in two bar folds per supplier."""
    df, plan = _featured(spark, sf)
    folds = splits.assign_folds(df, splits.bar_folds(df, 100, 40), plan)
    # Several jobs read the folds (statistics, fit, test), so their lineage is cut once.
    return checkpointed(folds.select("symbol", "split_id", "role", "ts_event", *FEATURES, "target_15m_ret"))


FEATURES = ("ret_1", "ret_5", "mom_10", "volume_ratio_15", "volume_log")


@query("ridge_predictions", None)
def ridge_predictions(spark, sf):
    a = _labelled(spark, sf)
    p = modelling.ridge_probabilities(a.filter("role = 'train'"), a.filter("role = 'test'"), FEATURES, "target_15m_ret")
    return p.select("symbol", "split_id", stamp(), r("prediction_prob").alias("prediction_prob"))


@query("logistic_predictions", None)
def logistic_predictions(spark, sf):
    a = _labelled(spark, sf)
    p = modelling.logistic_probabilities(a.filter("role = 'train'"), a.filter("role = 'test'"), FEATURES, "target_15m_ret")
    return p.select("symbol", "split_id", stamp(), r("prediction_prob").alias("prediction_prob"))


@query("train_test_check", None)
def train_test_check(spark, sf):
    return splits.check_train_test(_labelled(spark, sf), FEATURES, "target_15m_ret").select("symbol", "split_id", "train_rows", "test_rows", "duplicate_ts", "null_target", "passed")


@query("walk_forward", None)
def walk_forward(spark, sf):
    """Purge-free bar folds: prune, scale, fit, predict, simulate, cut warm-up for every supplier."""
    df, _ = _featured(spark, sf)
    df = df.withColumn("session_id", F.date_format("ts_event", "yyyy"))
    dims = df.select("symbol").distinct().select("symbol", F.lit(1.0).alias("multiplier"), F.lit(50.0).alias("max_position"))
    res = modelling.walk_forward(df, FEATURES, "target_15m_ret", dims, SETTINGS, burn_in=5, fold_options={"min_train": 100, "min_test": 40}, smoothing=0.3)
    return res.select("symbol", "split_id", stamp(), r("prediction_prob").alias("prediction_prob"), r("pnl", 4).alias("pnl"))


@query("feature_selection", with_("f AS (SELECT p_brand AS feature, p_size % 3 AS fold, avg(p_retailprice) / 1000 AS importance, CASE WHEN (count(*) % 2) = 0 THEN 1.0 ELSE -1.0 END AS sign FROM part GROUP BY ALL)",
                                  "g AS (SELECT feature, avg((importance > 0)::INT) AS freq, avg(importance) AS imp, avg((sign > 0)::INT) AS pos, avg((sign < 0)::INT) AS neg FROM f GROUP BY feature)",
                                  "h AS (SELECT *, CASE WHEN pos > 0.5 THEN pos ELSE neg END AS cons FROM g)", "i AS (SELECT *, freq >= 0.5 AND cons >= 0.6 AS stable FROM h)",
                                  "j AS (SELECT *, row_number() OVER (PARTITION BY stable ORDER BY imp DESC, feature) AS k, sum(imp) OVER (PARTITION BY stable ORDER BY imp DESC, feature ROWS UNBOUNDED PRECEDING) / sum(imp) OVER (PARTITION BY stable) AS cum, imp / sum(imp) OVER (PARTITION BY stable) AS own FROM i)",
                                  "l AS (SELECT *, stable AND (k = 1 OR cum - own < 0.8) AS kept FROM j)", "m AS (SELECT *, row_number() OVER (ORDER BY kept DESC, stable DESC, imp DESC, feature) AS rk, sum(kept::INT) OVER () AS n FROM l)")
       + f"SELECT feature, {rs('imp')} AS mean_importance, {rs('cons')} AS sign_consistency, rk AS rank, rk <= greatest(n, 5) AS selected FROM m")
def feature_selection(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    imp = part.groupBy(F.col("p_brand").alias("feature"), (F.col("p_size") % 3).alias("fold")).agg(
        (F.avg("p_retailprice") / 1000).alias("importance"), F.when(F.count(F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    s = discovery.select_features(imp, 0.5, 0.6, 0.8, 5)
    return s.select("feature", r("mean_importance").alias("mean_importance"), r("sign_consistency").alias("sign_consistency"), F.col("rank").cast("long").alias("rank"), "selected")


@query("discovery", None)
def discover(spark, sf):
    """All baseline features at the operator's defaults, the window being the whole date range."""
    bars = minutely(spark, sf)
    start, end = bars.agg(F.min(F.to_date("ts_event")).cast("string"), F.date_add(F.max(F.to_date("ts_event")), 1).cast("string")).first()
    df = targets.add_target_15m(baseline.add_baseline_features(bars))
    return discovery.discover(df, start, end).select("feature_names", "selected_k", "frozen", "manifest_type")


VZ = f"(volume - {roll('mean', 'volume', 20, 5, True)}) / ({roll('std', 'volume', 20, 5, True)} + 1e-9)"
Z3 = f"pow((lr - {roll('mean', 'lr', 5, 3)}) / ({roll('std', 'lr', 5, 3)} + 1e-9), 3)"
RAWF = ("log_return", "volume_z", "range_pct", "skew_5", "momentum_10")
PAST = over("ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING")
REGIME_SQL = (f"p AS (SELECT *, ln(close) - {lag('ln(close)')} AS lr, ln(close) - {lag('ln(close)', 10)} AS mo FROM b), q AS (SELECT *, {VZ} AS vz, {Z3} AS z3 FROM p), "
              f"f AS (SELECT *, least(greatest(coalesce(lr, 0), -50), 50) AS log_return, least(greatest(coalesce(vz, 0), -50), 50) AS volume_z, least(greatest((high - low) / (close + 1e-9), -50), 50) AS range_pct, "
              f"least(greatest(coalesce({roll('mean', 'z3', 5, 3)}, 0), -50), 50) AS skew_5, least(greatest(coalesce(mo, 0), -50), 50) AS momentum_10 FROM q)")


@query("regime_features", with_(HOURLY, REGIME_SQL) + out("f", {c: f"CASE WHEN count(*) {PAST} >= 30 THEN ({c} - avg({c}) {PAST}) / (CASE WHEN stddev_pop({c}) {PAST} < 1e-9 THEN 1 ELSE stddev_pop({c}) {PAST} END) ELSE 0 END" for c in RAWF}))
def regime_features(spark, sf):
    return show(regime.add_regime_features(hourly(spark, sf)), *RAWF)


def _hours(spark, sf):
    """Train and test hours of rolling splits (15 days, then 5, every 5 days) over the whole date range, and the splits."""
    bars = hourly(spark, sf)
    rolling = splits.day_splits(splits.year_bounds(bars), train_days=15, test_days=5, step_days=5).select("split_id", "train_start", "train_end", "test_start", "test_end")
    rows = splits.assign_splits(bars, rolling)
    return rows.filter("role = 'train'").drop("role"), rows.filter("role = 'test'").drop("role"), rolling


@query("regime_probabilities", None)
def regime_probabilities(spark, sf):
    train, test, _ = _hours(spark, sf)
    keys = ("symbol", "split_id")
    models = regime.fit_regimes(regime.add_regime_features(train, keys), keys)
    p = regime.filter_regimes(regime.add_regime_features(test, keys), models, keys)
    return p.select(*keys, stamp(), *[r(c).alias(c) for c in regime.REGIME_COLUMNS])


@query("regime_path", None)
def regime_path(spark, sf):
    train, _, _ = _hours(spark, sf)
    keys = ("symbol", "split_id")
    f = regime.add_regime_features(train, keys)
    return regime.decode_regimes(f, regime.fit_regimes(f, keys), keys).select(*keys, stamp(), "state")


@query("regime_gated_backtest", None)
def regime_gated_backtest(spark, sf):
    train, test, rolling = _hours(spark, sf)
    bt = backtest(spark, sf).join(F.broadcast(markets(spark).select("symbol")), "symbol")
    bt = splits.assign_splits(bt, rolling).filter("role = 'test'").drop("role")
    res = regime.gate_backtest(bt, train, test, SETTINGS)
    return res.select("symbol", "split_id", stamp(), "hmm_trade_gate", r("target_exec").alias("target_exec"), r("pnl", 4).alias("pnl"))
