"""Many keys in the sums of models, zero prices in returns, sums and rounding of money."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import BAR_SCHEMA, make_bars, utc
from tidebar.catalog import QUERIES, audits, features, models
from tidebar.catalog.registry import HUGE_METHOD, r
from tidebar.operators import audit, baseline, expansion, modelling, splits, targets
from tidebar.plans import blocks
from tidebar.plans.checkpoints import checkpointed


def _many_keys(spark, keys, rows, offset=0.0):
    n = F.col("id")
    return spark.range(keys * rows).select(
        F.concat(F.lit("S"), n % keys).alias("symbol"), (F.sin(n * 0.7) + offset).alias("x"), (F.cos(n * 0.3) + offset).alias("y"))


def _closed_form(df):
    s = df.groupBy("symbol").agg((F.covar_pop("x", "y") * F.count("x") / (F.var_pop("x") * F.count("x") + 1)).alias("beta"))
    return {r["symbol"]: r["beta"] for r in s.collect()}


def test_few_columns_are_summed_without_python(spark):
    """One batch holds a few rows of every key, so a loop over its keys made more rows than it read."""
    sums = modelling.gram(_many_keys(spark, 3000, 7), ["x", "y"], ["symbol"])
    assert "InPandas" not in sums._jdf.queryExecution().executedPlan().toString()
    assert sums.count() == 3000


@pytest.mark.parametrize("offset, digits", [(0.0, 9), (1e8, 5)])
def test_ridge_of_many_keys(spark, offset, digits):
    df = _many_keys(spark, 500, 9, offset)
    want = _closed_form(df)
    got = {r["symbol"]: r["coefficients"][0] for r in modelling.ridge_fit(df, ["x"], "y", ["symbol"], 1.0).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 10.0 ** -digits


def test_few_and_many_columns_agree(spark, monkeypatch):
    df = _many_keys(spark, 5, 40, 100.0).withColumn("z", F.col("x") * F.col("y"))
    columns = ["x", "y", "z"]
    few = {r["symbol"]: r for r in modelling.gram(df, columns, ["symbol"]).collect()}
    monkeypatch.setattr(modelling, "AGGREGATE_COLUMNS", 0)
    for r in modelling.gram(df, columns, ["symbol"]).collect():
        np.testing.assert_allclose(few[r["symbol"]]["gram"], r["gram"], rtol=1e-8, atol=1e-8)
        np.testing.assert_allclose(few[r["symbol"]]["centre"], r["centre"], rtol=1e-12)


@pytest.fixture
def with_zero(spark):
    """300 bars; the prices of bar 150 are all zero."""
    rows = [(*r[:2], *((0.0,) * 4 if i == 150 else r[2:6]), r[6]) for i, r in enumerate(make_bars(300))]
    return spark.createDataFrame(rows, BAR_SCHEMA)


def _in_order(df, column):
    return [r[0] for r in df.orderBy("ts_event").select(column).collect()]


def test_a_zero_price_makes_the_trend_volatility_unbounded(with_zero):
    """Before, its returns were NULL, so frames with it had no volatility at all."""
    from tidebar.operators import htf, sessions
    out = htf.add_htf_context(sessions.add_session_id(with_zero), slope_bars=10, vol_bars=20)
    vol = _in_order(out, "htf_daily_vol_5")
    assert vol[151:171] == [10.0] * 20 and 0 < vol[150] < 1 and 0 < vol[172] < 1


def test_a_zero_price_makes_the_execution_volatility_nan(with_zero, spark):
    from tidebar.operators import execution
    markets = spark.createDataFrame([("ES", 50.0, 10.0)], "symbol string, multiplier double, max_position double")
    vol = _in_order(execution.simulate_execution(with_zero.withColumn("prediction_prob", F.lit(0.6)), markets), "vol")
    assert all(math.isnan(v) for v in vol[151:171]) and 0 < vol[150] < 1 and 0 < vol[172] < 1


def test_a_zero_price_leaves_no_correlation(with_zero):
    from tidebar.operators import metrics, targets
    df = targets.add_target_15m(with_zero.withColumn("prediction_prob", F.col("volume") / 50.0))
    target = _in_order(df, "target_15m_ret")
    assert target[150 - 16] == float("-inf") and target[-16:] == [None] * 16
    assert math.isnan(metrics.prediction_correlation(df, "target_15m_ret").first()["pearson_ic"])
    assert not math.isnan(metrics.prediction_correlation(df.filter(F.abs("target_15m_ret") < 1), "target_15m_ret").first()["pearson_ic"])


def test_a_zero_close_is_labelled_without_bands(with_zero):
    from tidebar.operators import targets
    plain = _in_order(targets.triple_barrier(with_zero, horizon=8, price_bands=False), "target_tb")
    assert None not in plain[:-8] and plain[-8:] == [None] * 8 and plain[150] == -1.0
    assert _in_order(targets.triple_barrier(with_zero, horizon=8), "target_tb")[150] is None


def _money(spark, n=4000):
    rows = [("ES", r[1], *r[2:6], 1) for r in make_bars(n)]
    return spark.createDataFrame(rows, BAR_SCHEMA).withColumn("pnl", F.round(F.sin(F.unix_seconds("ts_event") / 300) * 1e5, 3) / 7).cache()


@pytest.mark.parametrize("block_rows", [100_000, 300])
def test_running_money_has_one_rounding(spark, block_rows):
    from tidebar.plans.blocks import carry, measure
    df = _money(spark)
    rows = carry(df, measure(df, block_rows=block_rows), {"total": ("exact", F.col("pnl"))}).orderBy("ts_event").collect()
    assert [r["total"] for r in rows[::97]] == [math.fsum(r["pnl"] for r in rows[:i + 1]) for i in range(0, len(rows), 97)]


def test_totals_of_money_do_not_depend_on_the_order(spark):
    from tidebar.plans.blocks import exact_sum
    df = _money(spark)
    want = math.fsum(r["pnl"] for r in df.collect())
    assert {df.repartition(n).agg(exact_sum(F.col("pnl"))).first()[0] for n in (1, 3, 7)} == {want}


def test_rounding_is_that_of_sql(spark):
    import duckdb
    from tidebar.catalog.registry import r
    values = [0.0000005, -0.5631895, -0.5631894999999999, 1.0000015, 2.5e-7, -2.5, 1e15 + 0.3, 12345.6789015, math.inf, 0.0, None]
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(r("v")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def _labelled_rows(spark):
    n = F.col("id")
    x = spark.range(900).select(F.concat(F.lit("S"), n % 6).alias("symbol"), F.sin(n * 0.7).alias("a"), F.cos(n * 1.3).alias("b"), n)
    return x.withColumn("y", ((F.col("a") + F.sin(n * 2.1) > 0.2) & (F.col("symbol") != "S5")).cast("double"))


@pytest.mark.parametrize("local_rows", [0, 149, 10_000])
def test_logistic_of_short_and_long_keys(spark, local_rows):
    """Short keys take all steps in one task; before, every step of every key was part of a job."""
    df = _labelled_rows(spark).filter((F.col("symbol") != "S4") | (F.col("id") < 300))
    want = {r["symbol"]: [*r["coefficients"], r["intercept"]] for r in modelling.logistic_fit(df, ["a", "b"], "y", ["symbol"], local_rows=10_000).collect()}
    got = {r["symbol"]: [*r["coefficients"], r["intercept"]] for r in modelling.logistic_fit(df, ["a", "b"], "y", ["symbol"], local_rows=local_rows).collect()}
    assert got.keys() == {f"S{i}" for i in range(6)} and got["S5"] == [0.0, 0.0, math.log(0.05 / 0.95)]
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-8)


def test_short_keys_take_no_job_a_step(spark):
    plan = modelling.logistic_fit(_labelled_rows(spark), ["a", "b"], "y", ["symbol"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInPandas" not in plan


def test_robust_statistics_of_small_and_large_keys(spark):
    df = _labelled_rows(spark).withColumns({"flat": F.lit(1.0), "far": F.when(F.col("id") % 7 > 0, F.col("a") * 40)})
    columns = ["a", "flat", "far"]
    small, large = ({r["symbol"]: r for r in modelling.robust_stats(df, columns, ["symbol"], group_rows=n).collect()} for n in (1_000_000, 50))
    assert small.keys() == large.keys()
    for k in small:
        assert small[k]["scales"][1] == 0.0
        assert small[k]["medians"] == pytest.approx(large[k]["medians"]) and small[k]["scales"] == pytest.approx(large[k]["scales"])


def test_half_away_equals_round(spark):
    """the values of `round`, without its way through decimal text."""
    values = [None, 0.0, -0.0, 0.5, -0.5, 1.5, -1.5, 2.5, -2.5, 0.49999999999999994, -0.49999999999999994, 4503599627370495.5, -4503599627370495.5, 9e15, 1e300, -1e300, 5e-324,
              float("nan"), float("inf"), float("-inf"), *[i / 8 - 40 for i in range(640)]]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 3, 6):
        got = df.select((F.round(F.col("x") * 10.0 ** digits, 0) / 10.0 ** digits).cast("string").alias("a"), r("x", digits).cast("string").alias("b")).collect()
        assert [g["a"] for g in got] == [g["b"] for g in got]
    assert "round(" not in df.select(r("x"))._jdf.queryExecution().optimizedPlan().toString()


def test_measure_counts_cells_only_for_long_keys(spark, bars, monkeypatch):
    """while every key is short no time cell is counted, so no row per cell is shuffled."""
    assert blocks.measure(bars, block_rows=300).cells.select("symbol").distinct().collect() == [("ES",)]

    def fail(*_):
        raise AssertionError("cells counted")

    monkeypatch.setattr(blocks, "_cell", fail)
    assert blocks.measure(bars).cells is None and blocks.measure(bars.limit(0)).cells is None


def test_expanded_features_measures_once_and_splits_wide_methods(spark, monkeypatch):
    """one block plan for the whole chain; methods too long for the JVM's compiler are not generated."""
    calls = []
    for module in (baseline, expansion, features):
        monkeypatch.setattr(module, "measure", lambda df, *a, **k: calls.append(1) or blocks.measure(df, *a, **k))
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    QUERIES["expanded_features"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_folds_are_cut_from_stored_bars(spark, monkeypatch):
    """the bars are read and measured once for features, labels and folds; only the columns used are stored."""
    calls = []
    for module in (baseline, targets, splits, models):
        monkeypatch.setattr(module, "measure", lambda df, *a, **k: calls.append(1) or blocks.measure(df, *a, **k))
    rows = models._labelled(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and rows.count() > 0
    stored, _ = models._featured(spark, "/root/testdata/sf0.001")
    assert len(stored.columns) == 7 + len(models.FEATURES) + 1
    assert "FileScan" not in stored._jdf.queryExecution().executedPlan().toString()


def _longest_method(df):
    """Bytecodes of the longest method that Spark generates for `df`."""
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    return max((stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())), default=0)


def test_audit_steps_are_short_enough_to_be_compiled(spark, monkeypatch):
    """the reads for timeline and samples had all rules in the method of the scan (9,652 bytecodes), too long for HotSpot's compiler."""
    frames, adaptive = [], spark.conf.get("spark.sql.adaptive.enabled")
    monkeypatch.setattr(audit, "checkpointed", lambda df: frames.append(df) or checkpointed(df))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frames.append(audit.core_issues(audits.spoiled_rows(spark, "/root/testdata/sf0.001"), stale_limit=1))
        assert len(frames) > 3 and max(_longest_method(df) for df in frames) <= HUGE_METHOD
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_audit_samples_by_day_and_by_shuffle(spark, monkeypatch):
    """rows of the days that samples need are stored before their rules are computed again; with many files they are not, for the same rows."""
    rows = audits.spoiled_rows(spark, "/root/testdata/sf0.001").dropDuplicates(["symbol", "file_year", "ts_event"]).cache()
    stored = []
    monkeypatch.setattr(audit, "of_days", lambda *a, f=audit.of_days: stored.append(f(*a)) or stored[-1])

    def issues():
        by = ["symbol", "file_year", "severity", "check"]
        return [(*(r[c] for c in (*by, "n")), len(json.loads(r["sample"] or "[]"))) for r in audit.core_issues(rows, stale_limit=1).orderBy(*by).collect()]

    by_day = issues()
    assert len(stored) == 1 and 0 < stored[0].count() < rows.count()
    monkeypatch.setattr(audit, "BROADCAST_ROWS", 0)
    assert issues() == by_day and len(stored) == 1
    assert all(size == min(n, audit.SAMPLE) for *_, check, n, size in by_day if check not in ("stale_close_run", "no_valid_numeric_rows"))
