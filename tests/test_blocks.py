"""Splitting a symbol in small blocks must not change any operator's result."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import make_bars, records
from tidebar.operators import align, audit, baseline, contracts, execution, expansion, htf, metrics, regime, sessions, splits, targets, volume_profile
from tidebar.operators.sessions import add_session_id
from tidebar.plans import blocks as B
from tidebar.plans.order_stats import average_ranks, exact_quantiles

SMALL = dict(block_rows=40, cell_seconds=3600)


def same(split, plain, keys=("symbol", "ts_event")):
    a, b = records(split, *keys), records(plain, *keys)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for k in y:
            if isinstance(y[k], float):
                assert x[k] == pytest.approx(y[k], rel=1e-9, abs=1e-9), (k, x, y)
            else:
                assert x[k] == y[k], (k, x, y)


def test_measure_splits_only_long_keys(bars):
    assert B.measure(bars).cells is None
    plan = B.measure(bars, block_rows=200, cell_seconds=3600)
    assert plan.cells is not None
    assert {r["symbol"] for r in plan.cells.select("symbol").distinct().collect()} == {"ES"}


def test_halo_repeats_only_what_windows_need(bars):
    plan = B.measure(bars, block_rows=100, cell_seconds=3600)
    framed = B.halo(bars, plan, lookback=10)
    assert framed.filter("_own").count() == bars.count()
    es = framed.filter("symbol = 'ES'")
    assert es.select("_block").distinct().count() > 2
    per_block = es.groupBy("_block").agg(F.count(F.when(F.col("_own"), 1)).alias("own"), F.count(F.when(~F.col("_own"), 1)).alias("copies"))
    # A cell holds 12 rows; whole cells are copied and a block may start up to one cell late.
    rows = [r for r in per_block.collect() if r["own"] > 0 and r["_block"] > 0]
    assert rows and all(10 <= r["copies"] <= 10 + 2 * 12 for r in rows)


def test_broadcast_is_bounded(bars, monkeypatch):
    plan = B.measure(bars, **SMALL)
    monkeypatch.setattr(B, "BROADCAST_ROWS", 0)
    same(B.trim(B.halo(bars, plan, lookback=5)), bars)


CASES = {
    "baseline": lambda d, p: baseline.add_baseline_features(d, blocks=p),
    "moments": lambda d, p: expansion.add_expansion(d, "moments", blocks=p),
    "quantiles": lambda d, p: expansion.add_expansion(d, "quantiles", blocks=p).select("symbol", "ts_event", "`feature_ret_quantile_0.2_20`"),
    "regime3": lambda d, p: expansion.add_expansion(d, "regime", blocks=p),
    "htf": lambda d, p: htf.add_htf_context(add_session_id(d), slope_bars=30, vol_bars=20, blocks=p),
    "profile": lambda d, p: volume_profile.add_volume_profile_features(d, daily_window=24, short_window=12, blocks=p),
    "target": lambda d, p: targets.add_target_15m(d, blocks=p),
    "barrier": lambda d, p: targets.triple_barrier(d, horizon=8, blocks=p),
    "gaps": lambda d, p: sessions.filter_gaps(d, blocks=p),
    "fill": lambda d, p: sessions.fill_intraday_gaps(d, blocks=p),
    "regime_features": lambda d, p: regime.add_regime_features(d, blocks=p),
    "warmup": lambda d, p: splits.exclude_warmup(d, 25, blocks=p),
    "benchmark": lambda d, p: execution.add_benchmark(d, blocks=p),
}


@pytest.mark.parametrize("name", list(CASES))
def test_blocks_do_not_change_features(bars, name):
    run = CASES[name]
    same(run(bars, B.measure(bars, **SMALL)), run(bars, B.whole()))


def test_carry_matches_one_window(bars):
    specs = {"s": ("sum", F.col("volume")), "m": ("max", F.col("close")), "n": ("min", F.col("low")),
             "l": ("last", F.when(F.col("volume") > 45, F.col("close")))}
    same(B.carry(bars, B.measure(bars, **SMALL), specs), B.carry(bars, B.whole(), specs))


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_with_blocks(bars, direction):
    right = bars.filter("volume % 7 = 0").select("symbol", "ts_event", F.col("close").alias("c"))
    both = bars.select("symbol", "ts_event").union(right.select("symbol", "ts_event"))
    if direction == "forward":
        both = both.withColumn("ts_event", F.timestamp_micros(-F.unix_micros("ts_event")))
    plan = B.measure(both, **SMALL)
    assert plan.cells is not None
    same(align.asof_join(bars, right, ["c"], blocks=plan, direction=direction),
         align.asof_join(bars, right, ["c"], blocks=B.whole(), direction=direction))


def test_asof_against_brute_force(bars):
    right = bars.filter("volume % 7 = 0").select("symbol", "ts_event", F.col("close").alias("c"))
    rows = [(r["symbol"], r["ts_event"], r["c"]) for r in right.collect()]
    for r in align.asof_join(bars, right, ["c"]).collect():
        past = [(t, c) for s, t, c in rows if s == r["symbol"] and t <= r["ts_event"]]
        assert r["c"] == (max(past)[1] if past else None)


def _backtest(bars, plan, **options):
    markets = bars.sparkSession.createDataFrame([("ES", 50.0, 50.0), ("CL", 1000.0, 30.0)], "symbol string, multiplier double, max_position double")
    settings = execution.ExecutionSettings(max_leverage=3.0, commission=1.5, stop_pct=0.0002, target_pct=0.0004, **options)
    prob = 0.05 + 0.9 * (F.col("volume") % 10) / 10
    return execution.simulate_execution(bars.withColumn("prediction_prob", prob), markets, settings, blocks=plan)


def test_execution_and_metrics_with_blocks(bars):
    split, plain = B.measure(bars, **SMALL), B.whole()
    a, b = _backtest(bars, split), _backtest(bars, plain)
    same(a, b)
    assert execution.check_execution(b).filter("not passed").count() == 0
    done = execution.add_benchmark(b, blocks=plain).cache()
    keys = ["symbol"]
    pa, pb = metrics.with_path_columns(done, keys, split), metrics.with_path_columns(done, keys, plain)
    same(metrics.core_metrics(pa, keys), metrics.core_metrics(pb, keys), keys)
    same(metrics.trade_metrics(pa, keys, split), metrics.trade_metrics(pb, keys, plain), keys)


def test_continuous_with_small_blocks(spark, monkeypatch):
    rows = make_bars(900, start="2023-01-02T00:00:00", minutes=1440)
    daily = spark.createDataFrame(rows, "symbol string, ts_event timestamp, open double, high double, low double, close double, volume long")
    plain = contracts.continuous_series(daily)
    real = B.measure
    for module in (align, contracts):
        monkeypatch.setattr(module, "measure", lambda df, keys=("symbol",), ts="ts_event": real(df, keys, ts, 60, 86_400 * 5))
    same(contracts.continuous_series(daily), plain)


def test_longest_run_with_blocks(bars):
    flag = F.col("close") >= F.col("open")
    a = audit.longest_run(bars, flag, ("symbol",), blocks=B.measure(bars, **SMALL))
    b = audit.longest_run(bars, flag, ("symbol",), blocks=B.whole())
    same(a, b, ("symbol",))


def test_quantiles_and_ranks_of_split_groups(bars):
    skewed = bars.unionAll(bars.filter("symbol = 'ES'").withColumn("volume", F.lit(7).cast("long")))
    qs = (0.0, 0.15, 0.5, 0.85, 1.0)
    exact = exact_quantiles(skewed, ["symbol"], "volume", qs)
    split = exact_quantiles(skewed, ["symbol"], "volume", qs, group_rows=10, buckets=8)
    for a, b in zip(records(split, "symbol"), records(exact, "symbol")):
        assert a["quantiles"] == pytest.approx(b["quantiles"])
    a = average_ranks(skewed, ["symbol"], "volume", "rk", group_rows=10, buckets=8)
    b = average_ranks(skewed, ["symbol"], "volume", "rk")
    assert records(a, "symbol", "ts_event", "volume") == records(b.select(*a.columns), "symbol", "ts_event", "volume")


def test_nulls_rank_alike_at_every_group_size(spark):
    rows = [(k, v, i) for i, (k, v) in enumerate([("a", 1.0), ("a", None), ("a", 3.0), ("a", None), ("a", 1.0), (None, 2.0), (None, None),
                                                  (None, 5.0), ("b", None), ("b", None)] * 3)]
    df = spark.createDataFrame(rows, "symbol string, v double, i int")
    small, large = (average_ranks(df, ["symbol"], "v", "rk", group_rows=n, buckets=4) for n in (1000, 5))
    assert records(small.select("i", "rk"), "i") == records(large.select("i", "rk"), "i") and large.count() == len(rows)
    small, large = (exact_quantiles(df, ["symbol"], "v", (0.0, 0.5, 1.0), group_rows=n, buckets=4) for n in (1000, 5))
    assert {r["symbol"]: r["quantiles"] for r in small.collect()} == {r["symbol"]: r["quantiles"] for r in large.collect()}


def test_correlation_and_ridge_far_from_zero(spark):
    from tidebar.operators import modelling

    rows = [("ES" if i % 2 else "NQ", float(i % 7), float((i * 5 + i // 7) % 7), i) for i in range(600)]
    near = spark.createDataFrame(rows, "symbol string, x double, y double, ts_event int").withColumn("z", F.col("x") + 0.05 * F.col("y"))
    far = near.withColumns({c: F.col(c) + 1e8 for c in "xyz"})
    a, b = (modelling.correlation_matrix(d, ["x", "y", "z"]) for d in (near, far))
    assert b.ravel() == pytest.approx(a.ravel(), abs=1e-6)
    kept = {r["symbol"]: r["kept"] for r in modelling.correlation_kept(far, ["x", "y", "z"], ["symbol"]).collect()}
    assert kept == {"ES": ["x", "y"], "NQ": ["x", "y"]}
    fits = [{r["symbol"]: r["coefficients"] for r in modelling.ridge_fit(d, ["x", "y"], "z", ["symbol"]).collect()} for d in (near, far)]
    assert all(fits[1][k] == pytest.approx(fits[0][k], abs=1e-6) for k in ("ES", "NQ"))
