import math
import random
from datetime import timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import BAR_SCHEMA, make_bars, records, utc
from tidebar.operators import (audit, calendars, contracts, discovery, engine, execution, extra_trees, metrics, modelling, prepare, regime, risk, sessions,
                               splits, targets)
from tidebar.sources import bars as io
from tidebar.sources.dimensions import market_dim, session_dim, unknown_symbols, with_multiplier


def rising(spark, n=20):
    rows = [("ES", utc("2024-01-02T15:00:00") + timedelta(minutes=i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 10) for i in range(n)]
    return spark.createDataFrame(rows, BAR_SCHEMA)


def test_target_is_next_open_to_open_after_horizon(spark):
    out = targets.add_target_15m(rising(spark)).orderBy("ts_event").collect()
    assert out[0]["target_15m_ret"] == pytest.approx(math.log(116 / 101))
    assert sum(r["target_15m_ret"] is None for r in out) == 16
    assert [r["target_15m_trade_class"] for r in out[-3:]] == [0, 0, 0]
    assert targets.drop_incomplete_target(targets.add_target_15m(rising(spark))).count() == 4


def test_daily_regime_is_the_slope_sign(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (0.2,), (None,)], "htf_daily_trend_slope_10 double")
    assert [r[0] for r in targets.add_target_daily_regime(df).select("target_daily_regime").collect()] == [-1, 0, 1, 0]


def test_triple_barrier_against_brute_force(bars):
    horizon = 8
    got = {(r["symbol"], r["ts_event"]): r["target_tb"] for r in targets.triple_barrier(bars, horizon, price_bands=False).collect()}
    for symbol in ("ES", "CL"):
        rows = sorted((r for r in bars.collect() if r["symbol"] == symbol), key=lambda r: r["ts_event"])
        rets = [None] + [math.log(b["close"]) - math.log(a["close"]) for a, b in zip(rows, rows[1:])]
        for t, row in enumerate(rows):
            past = [x for x in rets[max(0, t - 259):t + 1] if x is not None]
            vol = 0.0005
            if len(past) >= 20:
                mean = sum(past) / len(past)
                vol = math.sqrt(sum((x - mean) ** 2 for x in past) / (len(past) - 1))
            width = max(vol, 1e-4) * math.sqrt(horizon)
            want = None
            if t + horizon < len(rows):
                ahead = rows[t + 1:t + 1 + horizon]
                up = next((i for i, x in enumerate(ahead) if x["high"] >= row["close"] * math.exp(width)), horizon)
                down = next((i for i, x in enumerate(ahead) if x["low"] <= row["close"] * math.exp(-width)), horizon)
                want = 1.0 if up < horizon and up <= down else -1.0 if down < horizon else 0.0
            assert got[(symbol, row["ts_event"])] == want


def test_integer_contracts_and_accounting(spark):
    rows = [("ES", utc("2024-01-02T15:00:00") + timedelta(minutes=5 * i), 100.0, 101.0, 99.0, 100.5, t, 0.5, 0.0, 50.0)
            for i, t in enumerate((0.34, 0.51, -0.51))]
    df = spark.createDataFrame(rows, "symbol string, ts_event timestamp, open double, high double, low double, close double, "
                                     "target_exec double, prediction_prob double, raw_signal double, multiplier double")
    out = execution.recompute_pnl(df, execution.ExecutionSettings(commission=2.0)).orderBy("ts_event").collect()
    assert [r["target_exec"] for r in out] == [0.0, 1.0, -1.0]
    assert [r["position"] for r in out] == [0.0, 0.0, 1.0]
    assert out[2]["gross_pnl"] == pytest.approx(0.005 * 100 * 50)
    assert out[2]["pnl"] == pytest.approx(out[2]["gross_pnl"] - 2.0)


@pytest.mark.parametrize("pos,o,h,l,want", [
    (1.0, 100.0, 100.4, 99.0, 99.5), (1.0, 100.0, 101.5, 99.9, 101.0), (1.0, 100.0, 102.0, 99.0, 99.5), (-1.0, 100.0, 101.0, 99.9, 100.5),
    (-2.0, 100.0, 100.1, 98.0, 99.0), (1.0, 100.0, 100.2, 99.8, None), (0.0, 100.0, 110.0, 90.0, None)])
def test_intrabar_fill(spark, pos, o, h, l, want):
    df = spark.createDataFrame([(o, h, l, pos)], "o double, h double, l double, p double")
    fill = execution.intrabar_fill(F.col("o"), F.col("h"), F.col("l"), F.col("p"), 0.005, 0.01, 0.002)
    got = df.select(fill.alias("f")).first()["f"]
    assert got == want or got == pytest.approx(want)


def test_cost_settings():
    assert execution.cost_bps(roundturn=0.00015) == pytest.approx(0.75)
    assert execution.cost_bps(transaction_cost_bps=2.0, tx_cost_bps=1.0) == 2.0
    assert execution.slippage_bps(slippage_rate=0.001) == pytest.approx(10.0)


def test_close_flattening_stops_at_the_session_end(spark):
    df = spark.createDataFrame([(utc(t), 1.0) for t in ("2024-01-02T20:50:00", "2024-01-02T20:56:00", "2024-01-02T22:30:00", "2024-01-03T00:00:00")],
                               "ts_event timestamp, t double")
    for evening, want in ((False, [1.0, 0.0, 0.0, 1.0]), (True, [1.0, 0.0, 0.0, 0.0])):
        s = execution.ExecutionSettings(flatten_evening=evening)
        got = df.withColumn("g", execution.clock_gate(F.col("t"), F.col("ts_event"), s)).orderBy("ts_event").collect()
        assert [r["g"] for r in got] == want


def test_risk_gates(spark):
    rows = [("ES", utc("2024-01-02T15:00:00"), -600.0, 2.0, 99400.0, -0.006), ("ES", utc("2024-01-03T15:00:00"), 100.0, 1.0, 99500.0, -0.005)]
    df = spark.createDataFrame(rows, "symbol string, ts_event timestamp, pnl double, position double, equity_curve double, drawdown_pct double")
    assert {r["status"] for r in risk.enforce_risk(risk.risk_gates(df)).collect()} == {"PASS"}
    status = {r["gate"]: r["status"] for r in risk.risk_gates(df, max_position=1.0, daily_loss_limit=500.0).collect()}
    assert status["daily_loss_limit"] == "FAIL" and status["max_position_size"] == "FAIL" and status["equity_positive"] == "PASS"
    with pytest.raises(ValueError, match="daily_loss_limit"):
        risk.enforce_risk(risk.risk_gates(df, daily_loss_limit=500.0))
    with pytest.raises(ValueError, match="missing"):
        risk.risk_gates(df.drop("pnl"))


def test_two_kinds_of_trades(spark):
    positions, pnl = [0.0, 1.0, 1.0, 2.0, -1.0, 0.0], [0.0, 5.0, -2.0, 4.0, 3.0, 0.0]
    rows = [("ES", utc("2024-01-02T15:00:00") + timedelta(minutes=i), p, x) for i, (p, x) in enumerate(zip(positions, pnl))]
    df = spark.createDataFrame(rows, "symbol string, ts_event timestamp, position double, pnl double")
    from tidebar.plans.blocks import whole
    paths = metrics.with_path_columns(df, ["symbol"], whole())
    assert sorted(r["trade_pnl"] for r in metrics.side_trades(paths, ["symbol"]).collect()) == [3.0, 7.0]
    # Value trades run from the entry bar's cumulative PnL to that of the bar after the run.
    assert sorted(r["trade_pnl"] for r in metrics.value_trades(paths, ["symbol"], whole()).collect()) == [0.0, 2.0, 3.0]
    m = metrics.core_metrics(paths, ["symbol"]).first()
    assert m["position_change_events"] == 4 and m["avg_holding_bars"] == pytest.approx(4 / 3)


def test_t_distribution_and_spearman(spark):
    cases = [(2.228138851964939, 10.0, 0.05), (0.0, 5.0, 1.0), (1.0, 1.0, 0.5), (-1.0, 1.0, 0.5), (2.0, 2.0, 1 - 2 / math.sqrt(6)), (math.sqrt(2), 2.0, 1 - 1 / math.sqrt(2)),
             (30.0, 2.0, 1 - 30 / math.sqrt(902)), (3.0, 3.0, 1 - 2 / math.pi * (math.atan(math.sqrt(3)) + math.sqrt(3) / 4)), (1e150, 4.0, 0.0),
             (1.959963984540054, 1e12, 0.05), (6.0, 1e12, math.erfc(6 / math.sqrt(2))), (0.5, 1e7, math.erfc(0.5 / math.sqrt(2)))]
    got = [r["p"] for r in spark.createDataFrame(cases, "t double, df double, want double").select(metrics.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()]
    assert got == [pytest.approx(want, rel=1e-6, abs=1e-14) for _, _, want in cases]
    assert spark.sql("select double('nan') t, 5D df union all select null, 5D union all select 1D, null").select(metrics.t_two_sided(F.col("t"), F.col("df")).alias("p")).distinct().collect() == [(None,)]
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in ((1, 2), (2, 1), (3, 4), (4, 3), (5, 5))], "symbol string, x double, y double")
    row = metrics.spearman(df, "x", "y").first()
    assert row["spearman_ic"] == pytest.approx(0.8) and row["spearman_ic_pvalue"] == pytest.approx(0.104088, abs=1e-6)


def test_metrics_report_needs_columns(bars):
    with pytest.raises(ValueError, match="missing"):
        metrics.metrics_report(bars)


def test_session_ids_and_hours(spark):
    df = spark.createDataFrame([("ES", utc(t)) for t in ("2024-01-02T14:30:00", "2024-01-02T23:00:00", "2024-01-02T22:30:00", "2024-07-02T21:30:00")],
                               "symbol string, ts_event timestamp")
    ids = [r["session_id"] for r in sessions.add_session_id(df).collect()]
    assert ids == ["2024-01-02", "2024-01-03", "2024-01-02", "2024-07-02"]
    assert sessions.filter_session_hours(df).count() == 2


def test_holidays_of_2024(spark):
    years = spark.createDataFrame([(2024,)], "year int")
    got = {r["holiday"]: str(r["local_date"]) for r in calendars.us_futures_holidays(years).collect()}
    assert got["good_friday"] == "2024-03-29" and got["memorial"] == "2024-05-27" and got["thanksgiving_friday"] == "2024-11-29"
    assert got["juneteenth"] == "2024-06-19" and got["labor"] == "2024-09-02"
    old = spark.createDataFrame([(2021,)], "year int")
    assert "juneteenth" not in {r["holiday"] for r in calendars.us_futures_holidays(old).collect()}


def test_session_config_problems():
    assert calendars.session_config_issues() == []
    bad = calendars.session_config_issues({"XX": {"timezone": "UTC"}})
    assert bad[0]["check"] == "invalid_market_config"
    cfg = {k: 1 for k in calendars.REQUIRED_SESSION_KEYS}
    assert calendars.session_config_issues({"XX": cfg})[0]["check"] == "incomplete_session_calendar"
    assert calendars.session_config_issues({"XX": {**cfg, "allow_empty_holiday_calendar": True}}) == []


def test_roll_dates_of_es(spark):
    spans = spark.createDataFrame([("ES", utc("2024-01-01T00:00:00"), utc("2024-12-31T00:00:00")), ("ZZ", utc("2024-01-01T00:00:00"), utc("2024-12-31T00:00:00"))],
                                  "symbol string, start timestamp, end timestamp")
    rows = contracts.roll_dates(spans).orderBy("roll_date").collect()
    assert [(str(r["roll_date"])[:10], r["front_contract"], r["back_contract"]) for r in rows] == [
        ("2024-03-14", "ESH24", "ESM24"), ("2024-06-20", "ESM24", "ESU24"), ("2024-09-19", "ESU24", "ESZ24"), ("2024-12-19", "ESZ24", "ESH25")]


def test_market_dimension(spark, bars):
    assert with_multiplier(bars, market_dim(spark)).filter("symbol = 'ES'").first()["contract_multiplier"] == 50.0
    es = market_dim(spark, {"ES": {"max_position": 20.0}}).filter("symbol = 'ES'").first()
    assert es["max_position"] == 20.0 and es["max_leverage"] == 3.0
    odd = bars.limit(1).withColumn("symbol", F.lit("??"))
    assert unknown_symbols(odd, market_dim(spark)).count() == 1
    with pytest.raises(Exception, match="no valid contract multiplier"):
        with_multiplier(odd, market_dim(spark)).collect()


@pytest.fixture(scope="module")
def raw_root(spark, tmp_path_factory):
    """Two yearly files of one-minute bars in the market/year layout."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = tmp_path_factory.mktemp("raw")
    for symbol, year, seed in (("ES", 2023, 1), ("ES", 2024, 2)):
        rows = make_bars(600, start=f"{year}-01-03T15:00:00", minutes=1, symbol=symbol, seed=seed)
        (root / symbol).mkdir(exist_ok=True)
        names = ["ts_event", "open", "high", "low", "close", "volume"]
        columns = list(zip(*[r[1:] for r in rows]))
        pq.write_table(pa.table({n: pa.array(c, pa.timestamp("us", "UTC")) if n == "ts_event" else list(c) for n, c in zip(names, columns)}),
                       root / symbol / f"{year}.parquet")
    return root


def test_day_splits_without_holes_in_their_ids(spark):
    bounds = spark.sql("SELECT * FROM VALUES (2015, DATE'2015-01-01', DATE'2015-12-31'), (2020, DATE'2020-01-01', DATE'2020-12-31') t(file_year, first_date, last_date)")
    got = splits.day_splits(bounds, 180, 30, 30).orderBy("split_id").collect()
    assert [r["split_id"] for r in got] == list(range(len(got))) and all(r["train_years"] and r["test_years"] for r in got)
    assert {r["train_start"].year for r in got} == {2015, 2020} or {r["train_start"].year for r in got} == {2015, 2019, 2020}
    assert got[-1]["test_end"].year == 2020


def test_long_files_are_hashed_in_ranges(spark, raw_root):
    import hashlib

    want = {f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in raw_root.glob("*/[0-9][0-9][0-9][0-9].parquet")}
    sizes = sorted(f.stat().st_size for f in raw_root.glob("*/[0-9][0-9][0-9][0-9].parquet"))
    for whole, step in ((0, 1000), (sizes[0], 777), (1 << 30, 1 << 20)):
        got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in io.file_hashes(spark, str(raw_root), whole, step).collect()}
        assert got == want
    plain, ranged = io.build_manifest(spark, str(raw_root)), io.build_manifest(spark, str(raw_root), whole_bytes=0)
    assert io.dataset_gate(ranged.withColumn("audit_status", F.lit("PASS")), plain.withColumn("audit_status", F.lit("PASS"))).count() == 0


def test_read_bars_and_gate(spark, raw_root):
    bars = io.read_bars(spark, str(raw_root))
    assert {(r[0], r[1]) for r in bars.select("symbol", "file_year").distinct().collect()} == {("ES", 2023), ("ES", 2024)}
    assert io.read_bars(spark, str(raw_root), years=[2024]).count() == 600
    assert audit.file_order_issues(io.read_bars(spark, str(raw_root), row_index=True), slice_rows=50).count() == 0
    report = spark.createDataFrame([("ES", 2023, "PASS"), ("ES", 2024, "WARN")], "symbol string, file_year int, severity string")
    manifest = io.build_manifest(spark, str(raw_root), report).cache()
    assert {r["audit_status"] for r in manifest.collect()} == {"PASS"} and manifest.first()["rows"] == 600
    assert io.dataset_gate(manifest, manifest).count() == 0
    changed = manifest.withColumn("sha256", F.lit("0"))
    assert [r["reasons"] for r in io.dataset_gate(changed, manifest).collect()] == [["hash_changed"]] * 2
    missing = io.dataset_gate(manifest, manifest.filter("file_year = 2023")).collect()
    assert [(r["file_year"], r["reasons"]) for r in missing] == [(2024, ["missing_manifest_record"])]
    failed = manifest.withColumn("audit_status", F.lit("FAIL"))
    assert {tuple(r["reasons"]) for r in io.dataset_gate(manifest, failed).collect()} == {("audit_not_pass",)}


def test_unsorted_file_is_reported(spark, raw_root):
    rows = io.read_bars(spark, str(raw_root), row_index=True).withColumn("row_index", 599 - F.col("row_index"))
    assert audit.file_order_issues(rows, slice_rows=50).agg(F.sum("n")).first()[0] == 2 * 599


def test_raw_audit_end_to_end(spark, raw_root):
    bars = io.read_bars(spark, str(raw_root))
    issues = audit.core_issues(bars)
    assert {r["severity"] for r in issues.collect()} <= {"WARN"}
    broken = bars.withColumn("high", F.when(F.minute("ts_event") == 5, F.col("low") - 1).otherwise(F.col("high")))
    rows = {(r["file_year"], r["check"]): r for r in audit.core_issues(broken).collect()}
    assert rows[(2024, "high_lt_low")]["n"] == 10 and rows[(2024, "high_lt_low")]["sample"].count("ts_event") == 5
    cleaned = audit.clean_rows(broken)
    assert audit.validated_manifest(broken, cleaned).filter("removed_rows = 10").count() == 2
    tables = calendars.session_audit(bars)
    assert {r["severity"] for r in tables["summary"].collect()} == {"FAIL"}  # bars run into the daily break
    totals = {r["severity"]: r["n"] for r in calendars.audit_totals([tables["summary"], issues]).collect()}
    assert totals["FAIL"] == 2


def test_unreadable_files_are_reported(spark, raw_root, tmp_path):
    """Corrupt, empty, cut, rowless and column-short files become FAIL rows; sound ones give none, and nothing fails."""
    import shutil

    import pyarrow.parquet as pq

    assert io.file_issues(spark, str(raw_root)).count() == 0
    root = tmp_path / "raw"
    (root / "NQ").mkdir(parents=True)
    shutil.copytree(raw_root / "ES", root / "ES")
    sound = pq.read_table(raw_root / "ES" / "2023.parquet")
    (root / "NQ" / "2019.parquet").write_bytes(b"not a parquet file")
    (root / "NQ" / "2020.parquet").write_bytes(b"")
    (root / "NQ" / "2021.parquet").write_bytes((raw_root / "ES" / "2023.parquet").read_bytes()[:-200])
    pq.write_table(sound.slice(0, 0), root / "NQ" / "2022.parquet")
    pq.write_table(sound.drop_columns(["volume"]), root / "NQ" / "2023.parquet")
    pq.write_table(sound, root / "NQ" / "2024.parquet")
    got = {(r["symbol"], r["file_year"]): (r["severity"], r["check"]) for r in io.file_issues(spark, str(root)).collect()}
    assert got == {("NQ", 2019): ("FAIL", "read_parquet"), ("NQ", 2020): ("FAIL", "read_parquet"), ("NQ", 2021): ("FAIL", "read_parquet"),
                   ("NQ", 2022): ("FAIL", "empty_file"), ("NQ", 2023): ("FAIL", "schema_missing_cols")}
    bad = tmp_path / "bad"
    (bad / "ES").mkdir(parents=True)
    (bad / "ES" / "2023.parquet").write_bytes(b"not a parquet file")
    assert [r["check"] for r in io.file_issues(spark, str(bad)).collect()] == ["read_parquet"]


def test_validated_write_is_gated_and_split(spark, raw_root, tmp_path):
    """FAIL rows stop the write; a hot symbol-year goes to several files, each in time order, with the same rows."""
    bars = io.read_bars(spark, str(raw_root))
    path = str(tmp_path / "validated")
    with pytest.raises(ValueError, match="refused"):
        io.write_validated(bars, path, spark.createDataFrame([("ES", 2023, "FAIL")], "symbol string, file_year int, severity string"))
    assert not (tmp_path / "validated").exists()
    io.write_validated(bars, path, spark.createDataFrame([("ES", 2023, "WARN")], "symbol string, file_year int, severity string"), file_rows=100)
    back = spark.read.parquet(path).select("symbol", "file_year", "ts_event", "close", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    rows = back.collect()
    assert sorted(r[:4] for r in rows) == sorted(tuple(r) for r in bars.select("symbol", "file_year", "ts_event", "close").collect())
    files = {}
    for r in sorted(rows, key=lambda r: (r["f"], r["i"])):
        files.setdefault((r["file_year"], r["f"]), []).append(r["ts_event"])
    assert len([k for k in files if k[0] == 2023]) >= 6 and all(v == sorted(v) and len(v) <= 100 for v in files.values())


def test_cache_is_built_once(spark, tmp_path, bars):
    calls = []

    def build():
        calls.append(1)
        return bars

    key = io.fingerprint({"horizon": 15, "model": "Ridge"})
    assert key == io.fingerprint({"model": "Ridge", "horizon": 15}) and key != io.fingerprint({"horizon": 16, "model": "Ridge"})
    check = lambda df: engine.require_passed(engine.check_target(df, "close"))
    for _ in range(2):
        assert io.read_or_build(spark, str(tmp_path), key, build, check).count() == bars.count()
    assert len(calls) == 1


def test_sinks_and_backtest_reader(spark, tmp_path, bars):
    io.write_canonical(bars, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).columns == sorted(bars.columns)
    out = tmp_path / "out" / "ES" / "2024_split_3"
    bars.filter("symbol = 'ES'").select("ts_event", F.col("close").alias("pnl"), F.lit(1.0).alias("position")).coalesce(1).write.parquet(str(out / "backtest_results.parquet"))
    got = io.read_backtests(spark, str(tmp_path / "out")).select("symbol", "year", "split_id").distinct().collect()
    assert [tuple(r) for r in got] == [("ES", 2024, 3)]
    io.write_validated(bars.withColumn("file_year", F.year("ts_event")), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == bars.count()
    io.write_reports({"summary": bars.limit(2).select("symbol", "close")}, str(tmp_path / "r"))
    io.write_results({"oos": bars, "risk_report": bars.limit(1)}, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "w" / "risk_report")).count() == 1


def test_aligned_continuous_passes_its_checks(spark):
    rows = [r for r in make_bars(3 * 1440, start="2024-03-12T22:00:00", minutes=1)]
    out = prepare.aligned_continuous(spark.createDataFrame(rows, BAR_SCHEMA)).cache()
    engine.require_passed(engine.check_aligned(out))
    assert {"1h_close", "daily_close", "continuous_price"} <= set(out.columns)
    assert out.select("contract_month").distinct().count() >= 1
    first_visible = out.filter(F.col("`1h_close`").isNotNull()).agg(F.min("ts_event")).first()[0]
    assert str(first_visible) == "2024-03-12 23:00:00"  # the 18:00 New York hour, complete


def test_matrix_contract(spark):
    df = spark.createDataFrame([("ES", utc("2024-01-02T15:00:00"), 0.1, None), ("ES", utc("2024-01-02T15:05:00"), 0.2, 1.0)],
                               "symbol string, ts_event timestamp, ret_1 double, target_15m_ret double")
    with pytest.raises(ValueError, match="contract check failed"):
        engine.require_passed(engine.check_matrix(df))
    engine.require_passed(engine.check_matrix(df.filter("target_15m_ret is not null")))


def test_manifest_projection(spark):
    df = spark.createDataFrame([("ES", utc("2024-01-02T15:00:00"), 1.0, 1.0, 0.1, 0.2, 0.3, 5.0)],
                               "symbol string, ts_event timestamp, close double, target_15m_ret double, ret_1 double, ret_2 double, ratio_x double, continuous_price double")
    strict = discovery.apply_manifest(df, ["ret_1"], "target_15m_ret").columns
    assert "ret_2" not in strict and "continuous_price" not in strict and {"ret_1", "target_15m_ret"} <= set(strict)
    assert "ret_2" in discovery.apply_manifest(df, ["ret_1"], "target_15m_ret", strict=False).columns
    for bad in (["target_15m_ret"], ["ret_1", "ret_1"], ["continuous_price"], ["nope"]):
        with pytest.raises(ValueError):
            discovery.apply_manifest(df, bad, "target_15m_ret")
    assert engine.model_feature_columns(df) == ["ret_1", "ret_2", "ratio_x"]


def test_train_window_bounds(spark):
    df = spark.createDataFrame([("ES", utc(f"2024-01-0{d}T00:00:00")) for d in range(1, 6)], "symbol string, ts_event timestamp")
    assert splits.train_window(df, "2024-01-02", "2024-01-04").count() == 2
    for start, end in (("2024-01-02", None), ("2024-01-04", "2024-01-02"), ("2025-01-01", "2025-01-02")):
        with pytest.raises(ValueError):
            splits.train_window(df, start, end)
    with pytest.raises(ValueError):
        discovery.discover(df, None, None)


def test_year_splits():
    assert splits.year_splits([2020, 2021, 2022, 2023], 2, 1) == [([2020, 2021], [2022]), ([2021, 2022], [2023])]
    assert splits.year_splits([2020, 2021], 2, 1) == []
    assert splits.year_splits([2020, 2021], 1, 2) == [([2020], [2021])]


def learnable(spark, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        x = rng.gauss(0, 1)
        rows.append(("ES", 0, "train" if i < n * 0.7 else "test", utc("2024-01-02T00:00:00") + timedelta(minutes=5 * i), x, rng.gauss(0, 1),
                     1.0, 0.3 * x + rng.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "symbol string, split_id int, role string, ts_event timestamp, a double, b double, flat double, y double")


def test_ridge_against_numpy(spark):
    import numpy as np

    df = learnable(spark)
    m = modelling.ridge_fit(df, ["a", "b"], "y", ["symbol"], 2.0).first()
    p = df.toPandas()
    x, y = p[["a", "b"]].to_numpy(), p["y"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2 * np.eye(2), xc.T @ yc)
    assert m["coefficients"] == pytest.approx(list(want), rel=1e-9)
    assert m["intercept"] == pytest.approx(y.mean() - x.mean(0) @ want, rel=1e-9)


def test_gram_joins_nothing_and_keeps_squares_of_far_values(spark):
    import numpy as np

    df = learnable(spark).withColumns({"a": F.col("a") + 1e8, "b": F.col("b") - 1e8}).repartition(7)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sums = modelling.gram(df, ["a", "b", "y"], ["symbol"])
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "CartesianProduct" not in plan
        row = sums.first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    x = df.select("a", "b", "y").toPandas().to_numpy()
    centred = x - x.mean(0)
    got = modelling._square_of(row["gram"], 4)
    assert row["centre"] == pytest.approx(list(x.mean(0)), rel=1e-12) and got[0].tolist() == [len(x), 0, 0, 0]
    assert got[1:, 1:] == pytest.approx(centred.T @ centred, rel=1e-6, abs=1e-4)
    assert np.abs(modelling.correlation_matrix(df, ["a", "b", "y"]) - np.corrcoef(x.T)).max() < 1e-6


def test_logistic_against_newton_and_one_class(spark):
    import numpy as np

    df = learnable(spark).withColumn("label", (F.col("y") > 0).cast("double"))
    one = df.withColumns({"symbol": F.lit("CL"), "label": F.lit(1.0)})
    models = {r["symbol"]: r for r in modelling.logistic_fit(df.unionByName(one).repartition(5), ["a", "b"], "label", ["symbol"]).collect()}
    p = df.toPandas()
    x, y, beta = np.column_stack([p[["a", "b"]].to_numpy(), np.ones(len(p))]), p["label"].to_numpy(), np.zeros(3)
    for _ in range(40):
        prob = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (prob * (1 - prob))[:, None]).T @ x + np.diag([1, 1, 0]), x.T @ (prob - y) + beta * [1, 1, 0])
    assert [*models["ES"]["coefficients"], models["ES"]["intercept"]] == pytest.approx(list(beta), rel=1e-6, abs=1e-8)
    assert models["CL"]["coefficients"] == [0.0, 0.0] and 1 / (1 + math.exp(-models["CL"]["intercept"])) == pytest.approx(0.95)
    library = modelling.mllib_probabilities(df, df, ["a", "b"], "y").select("ts_event", F.col("prediction_prob").alias("want"))
    ours = modelling.logistic_probabilities(df, df, ["a", "b"], "y").join(library, "ts_event")
    assert ours.select(F.max(F.abs(F.col("prediction_prob") - F.col("want")))).first()[0] < 1e-3


def test_checked_evaluation(spark):
    df = learnable(spark, 600).withColumns({"role": F.when(F.col("ts_event") < F.lit(utc("2024-01-03T11:00:00")), "train").otherwise("test"),
                                            "open": F.lit(100.0), "high": F.lit(101.0), "low": F.lit(99.0), "close": 100 + F.col("y"), "volume": F.lit(5)})
    markets = spark.createDataFrame([("ES", 1.0, 50.0)], "symbol string, multiplier double, max_position double")
    for model in ("ridge", "logistic"):
        out = modelling.checked_evaluation(df, ["a", "b"], "y", markets, model=model, burn_in=5)
        assert out.count() == df.filter("role = 'test'").count() - 6
    with pytest.raises(ValueError, match="contract check failed"):
        modelling.checked_evaluation(df.unionByName(df.filter("role = 'test'")), ["a", "b"], "y", markets)
    with pytest.raises(ValueError, match="unknown model"):
        modelling.outer_evaluation(df, ["a", "b"], "y", markets, model="none")


@pytest.mark.parametrize("model", ["ridge", "LogisticRegression", "RandomForestClassifier"])
def test_models_learn_the_direction(spark, model):
    df = learnable(spark)
    train, test = df.filter("role = 'train'"), df.filter("role = 'test'")
    if model == "ridge":
        out = modelling.ridge_probabilities(train, test, ["a", "b", "flat"], "y", scale=10.0)
    else:
        out = modelling.mllib_probabilities(train, test, ["a", "b", "flat"], "y", model)
    rows = out.collect()
    assert len(rows) == test.count() and all(0.05 <= r["prediction_prob"] <= 0.95 for r in rows)
    assert {"a", "b", "y"} <= set(out.columns)
    corr = out.select(F.corr("prediction_prob", "a")).first()[0]
    assert corr > 0.6


def test_meta_gate(spark):
    df = learnable(spark, 1200)
    train, test = df.filter("role = 'train'"), df.filter("role = 'test'").withColumn("target_exec", F.lit(1.0))
    result = modelling.ridge_probabilities(train, test, ["a", "b"], "y", scale=10.0)
    scored = modelling.meta_probabilities(train, result, ["a", "b"], "y")
    gated = modelling.apply_meta_gate(scored, 0.5)
    assert gated.filter("meta_prob < 0.5 AND target_exec <> 0").count() == 0 and gated.filter("target_exec = 1").count() > 0
    few = modelling.apply_meta_gate(modelling.meta_probabilities(train.limit(100), result, ["a", "b"], "y"), 0.5)
    assert few.filter("target_exec = 1").count() == result.count()


def test_train_test_checks(spark):
    df = learnable(spark)
    assert splits.check_train_test(df, ["a"], "y").first()["passed"]
    overlap = df.withColumn("role", F.when(F.col("a") > 0, "train").otherwise("test"))
    assert not splits.check_train_test(overlap, ["a"], "y").first()["passed"]
    with pytest.raises(ValueError, match="missing features"):
        splits.check_train_test(df, ["zzz"], "y")
    test = df.filter("role = 'test'").withColumn("prediction_prob", F.lit(0.4))
    assert splits.check_predictions(test, test).first()["passed"]
    assert not splits.check_predictions(test.withColumn("prediction_prob", F.lit(1.4)), test).first()["passed"]
    assert splits.prediction_frame(test, "y").columns == ["symbol", "split_id", "ts_event", "prediction_prob", "y"]
    assert modelling.row_retention(test.limit(60), test).first()["passed"] is False


def test_discovery_finds_the_driver(spark):
    df = learnable(spark, 600).withColumnsRenamed({"a": "feature_a", "b": "feature_b", "y": "target_15m_ret"})
    out = discovery.discover(df, "2024-01-02", "2024-02-01", folds=2, trees=5, selection={"min_count": 1}).first()
    assert out["feature_names"][0] == "feature_a" and out["features_hash"].startswith("sha256:")


def grown_by_hand(x, y, w, seed, fold, trees, depth, share):
    """Importances of one fold by recursion over whole arrays."""
    n = x.shape[1]
    most, out, grown = max(1, int(share * n)), np.zeros(n), 0

    def grow(own, tree, node, level, gains):
        if level == depth or not len(own):
            return
        order, u = extra_trees.node_draws(seed, fold, tree, node, n)
        best = None
        for f, draw in [(f, d) for f, d in zip(order, u) if x[w > 0, f].min() < x[w > 0, f].max()][:most]:
            lo, hi = x[own, f].min(), x[own, f].max()
            if lo == hi:
                continue
            cut = lo + draw * (hi - lo)
            cut = lo if cut >= hi else cut
            sides = [own[x[own, f] <= cut], own[x[own, f] > cut]]

            def error(rows_):
                return float((w[rows_] * (y[rows_] - np.average(y[rows_], weights=w[rows_])) ** 2).sum())

            gain = error(own) - error(sides[0]) - error(sides[1])
            if best is None or gain > best[0] + 1e-12:
                best = gain, f, sides
        if best is not None:
            gains[best[1]] += best[0]
            gains[n] = 1
            for k, side in enumerate(best[2]):
                grow(side, tree, 2 * node + 1 + k, level + 1, gains)

    for tree in range(trees):
        gains = np.zeros(n + 1)
        grow(np.flatnonzero(w > 0), tree, 0, 0, gains)
        grown += gains[n]
        out += gains[:n] / max(gains[:n].sum(), 1e-300)
    out /= max(grown, 1)
    return out / max(out.sum(), 1e-300)


def test_extra_trees_against_recursion(spark):
    """Ties, a constant feature, unused rows; the same trees whatever the partitions."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 3, 500), np.full(500, 7.0), rng.normal(size=500) ** 3, 1e6 + rng.random(500)])
    y = 2 * x[:, 0] + (x[:, 1] == 1) + rng.normal(size=500) * 0.1
    w = rng.poisson(1.0, (500, 2)).astype(float)
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([y, x, w])], ", ".join(f"{c} double" for c in ["_y", *names, "w0", "w1"]))
    for parts in (1, 7):
        got, sign = extra_trees.importances(df.repartition(parts), names, ["w0", "w1"], trees=6, depth=4, feature_share=0.6, seed=9)
        want = np.array([grown_by_hand(x, y, w[:, f], 9, f, 6, 4, 0.6) for f in range(2)])
        assert got == pytest.approx(want, abs=1e-9) and got[:, 0].min() > 0.5 and (got[:, 2] == 0).all()
        cov = [[0.0 if i == 2 else np.sign(np.cov(x[:, i], y, aweights=w[:, f])[0, 1]) for i in range(5)] for f in range(2)]
        assert sign.tolist() == cov


def test_extra_trees_on_little(spark):
    """No rows, one row, a target that never changes, a weight of zero for all rows: zeros, or shares that are finite."""
    cols = "_y double, x0 double, x1 double, w0 double"
    for rows_ in ([], [(1.0, 2.0, 3.0, 1.0)], [(1.0, 2.0, 3.0, 0.0), (2.0, 5.0, 3.0, 0.0)], [(1.0, float(i), 0.0, 1.0) for i in range(9)]):
        got, sign = extra_trees.importances(spark.createDataFrame(rows_, cols), ["x0", "x1"], ["w0"], trees=3, depth=3)
        assert (got == 0).all() and (sign == 0).all()


def test_bootstrap_weights_are_poisson(spark):
    w = spark.range(20000).select(discovery.bootstrap_weight(42, 0, F.col("id")).alias("w"))
    mean, var = w.select(F.avg("w"), F.variance("w")).first()
    assert mean == pytest.approx(1.0, abs=0.03) and var == pytest.approx(1.0, abs=0.05)


def regime_sequence(spark, n=500):
    rng = random.Random(5)
    price, rows = 100.0, []
    for i in range(n):
        sd, drift = ((0.001, 0.0005), (0.02, -0.004))[(i // 60) % 2]
        new = price * math.exp(rng.gauss(drift, sd))
        rows.append(("ES", 0, utc("2024-01-02T00:00:00") + timedelta(hours=i), price, max(price, new) * 1.0005, min(price, new) * 0.9995, new, rng.randint(50, 60)))
        price = new
    return spark.createDataFrame(rows, "symbol string, split_id int, ts_event timestamp, open double, high double, low double, close double, volume long")


def test_regimes_are_causal_and_normalised(spark):
    hours = regime_sequence(spark)
    keys = ("symbol", "split_id")
    features = regime.add_regime_features(hours, keys)
    models = regime.fit_regimes(features, keys, iterations=20).cache()
    assert not models.first()["fallback"] and sorted(set(models.first()["labels"])) == [0, 1, 2, 3]
    full = records(regime.filter_regimes(features, models, keys), "ts_event")
    part = records(regime.filter_regimes(features.filter("ts_event < '2024-01-10'"), models, keys), "ts_event")
    assert part == full[:len(part)]
    assert all(sum(r[c] for c in regime.REGIME_COLUMNS) == pytest.approx(1.0) for r in full)
    path = regime.decode_regimes(features, models, keys)
    assert path.count() == 500 and path.select("state").distinct().count() > 1
    short = regime.fit_regimes(features.limit(100), keys)
    assert short.first()["fallback"]
    flat = regime.filter_regimes(features, short, keys).first()
    assert [flat[c] for c in regime.REGIME_COLUMNS] == [0.25] * 4


def test_state_labels():
    assert regime.label_states([0.01, 0.0, -0.02, 0.015], [1e-6, 2e-6, 1e-3, 2e-3]) == [0, 1, 2, 3]


def test_regime_bridge_by_position(spark, bars):
    from tidebar.operators.align import attach_regime_by_position
    base = bars.filter("symbol = 'CL'")
    hours = base.select("symbol", F.date_trunc("hour", "ts_event").alias("ts_event")).distinct()
    probs = hours.withColumns({c: F.hour("ts_event").cast("double") for c in regime.REGIME_COLUMNS})
    out = attach_regime_by_position(base, probs)
    assert out.filter(F.col("hmm_regime_0") != F.hour("ts_event")).count() == 0 and out.count() == base.count()


def test_verification_helpers(spark, bars):
    df = bars.withColumns({"pnl": F.col("close"), "split_id": F.lit(0)})
    again = df.unionByName(df.withColumn("split_id", F.lit(1)))
    sums = metrics.column_checksum(again, ["pnl"])
    assert metrics.duplicate_outputs(sums, "pnl_checksum").filter("outputs = 2").count() == 2
    assert risk.check_backtest(df, market_dim(spark)).filter("passed").count() == 2
    flat = df.withColumn("pnl", F.lit(0.0))
    assert risk.check_backtest(flat, market_dim(spark)).filter("passed").count() == 0
    delta = metrics.metric_delta(df.groupBy("symbol", "split_id").agg(F.sum("pnl").alias("total_pnl")), flat.groupBy("symbol", "split_id").agg(F.sum("pnl").alias("total_pnl")))
    assert delta.count() == 2
    assert metrics.prediction_correlation(df.withColumn("prediction_prob", F.col("close")), "close").filter("pearson_ic > 0.999").count() == 2


def test_range_shorter_than_a_window_is_one_whole_split(bars):
    found = splits.day_splits(splits.year_bounds(bars))
    rows = splits.assign_splits(bars, found)
    assert found.count() == 1 and rows.count() == 2 * bars.count()
    assert splits.purge_train_tail(rows, found).count() == 2 * bars.count()


def test_regime_splits_cover_the_whole_range(spark):
    """Every hour after the first training window is tested, and none is trained on in a split that tests it."""
    from tidebar.catalog import models
    from tidebar.catalog.views import hourly

    sf = "/root/testdata/sf0.001"
    train, test, *_ = models._hours(spark, sf)
    late = hourly(spark, sf).filter("ts_event >= '2024-01-16'").select("symbol", "ts_event")
    assert late.exceptAll(test.select("symbol", "ts_event")).count() == 0
    assert train.join(test, ["symbol", "split_id", "ts_event"]).count() == 0


def test_gaps_and_runs_over_block_borders(spark):
    """Counts of gaps, the longest run of unchanged closes and the first gaps are those of the whole file, however it is cut."""
    from tidebar.plans.blocks import measure

    rng, rows = random.Random(5), []
    for year in (2023, 2024):
        at, close = utc(f"{year}-03-01T00:00:00"), 1.0
        for i in range(900):
            at += timedelta(minutes=rng.choice([1, 1, 1, 7, 600]))
            close = close if 200 < i < 700 or rng.random() < 0.6 else rng.random()
            rows.append(("ES", year, at, close))
    df = spark.createDataFrame(rows, "symbol string, file_year int, ts_event timestamp, close double")
    expected = {}
    for year in (2023, 2024):
        own = [r for r in rows if r[1] == year]
        gaps = [(a[2], b[2]) for a, b in zip(own, own[1:]) if b[2] - a[2] > timedelta(minutes=1)]
        best = run = 0
        for a, b in zip(own, own[1:]):
            run = run + 1 if a[3] == b[3] else 0
            best = max(best, run)
        expected[year] = (len(gaps), best, [b for _, b in gaps[:audit.SAMPLE]])
    for block_rows in (10_000, 100, 30):
        plan = measure(df, audit.FILE_KEYS, block_rows=block_rows, cell_seconds=3600)
        stats, first = audit.gaps_and_runs(df, blocks=plan)
        heads = first.collect()
        got = {r["file_year"]: (r["gap_count_gt_1min"], r["stale_close_run_max"],
                                sorted(h["ts_event"].replace(tzinfo=timezone.utc) for h in heads if h["file_year"] == r["file_year"])[:audit.SAMPLE]) for r in stats.collect()}
        assert got == expected


@pytest.mark.parametrize("step,change", [(1, {}), (5, {}), (1, {"week_start": 30, "week_end": 1430, "break_start": 90, "break_end": 150}), (15, {"week_start_day": 0, "week_end_day": 4})])
def test_expected_counts_equal_listed_minutes(spark, step, change):
    """Days counted in closed form against every minute listed: holidays, offset changes, spans that begin and end within a day."""
    sessions_ = session_dim(spark).withColumns({k: F.lit(v) for k, v in change.items()})
    spans = spark.createDataFrame([("ES", 1, utc("2023-10-30T05:17:00"), utc("2024-01-20T18:59:00")), ("CL", 1, utc("2024-03-06T23:58:00"), utc("2024-03-14T00:01:00")),
                                   ("ZC", 2, utc("2024-07-03T12:00:00"), utc("2024-07-03T12:00:00")), ("GC", 1, utc("2024-02-02T00:00:00"), utc("2024-02-01T00:00:00"))],
                                  "symbol string, part int, first_ts timestamp, last_ts timestamp")
    holidays = calendars.holiday_calendar(calendars._year_spans(spans), sessions_).cache()
    listed = calendars.expected_minutes(spans.filter("first_ts <= last_ts"), sessions_, holidays, ["symbol", "part"], step)
    expected = {(r["symbol"], r["part"], r["d"]): r["n"] for r in listed.groupBy("symbol", "part", F.date_trunc("day", "ts_event").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {(r["symbol"], r["part"], r["_day"]): r["n"] for r in calendars.expected_counts(spans, sessions_, holidays, ["symbol", "part"], step).collect() if r["n"]}
    assert got == expected and len(got) > 60


def test_session_audit_plans_no_minute_grid_for_the_summary(spark, bars):
    tables = calendars.session_audit(bars, ("symbol",))
    assert "1439" not in tables["summary"]._jdf.queryExecution().optimizedPlan().toString()
    assert {r["symbol"]: r["missing_expected_minutes"] for r in tables["summary"].collect()} == {
        r["symbol"]: r["count"] for r in tables["missing"].groupBy("symbol").count().collect()}


def test_checksums_count_repeated_rows(spark):
    """A row that occurs twice is not the same as none; order does not matter; nulls and NaN alone give no checksum."""
    at = utc("2024-01-02T15:00:00")
    rows = [("a", 0, at, 1.0), ("a", 0, at, 2.0), ("a", 1, at, 2.0), ("a", 1, at, 1.0), ("a", 2, at, 1.0), ("a", 2, at, 1.0), ("a", 2, at, 2.0), ("a", 2, at, 2.0),
            ("a", 3, at, 3.0), ("a", 3, at, 3.0), ("a", 4, at, 4.0), ("a", 4, at, 4.0), ("a", 5, at, None), ("a", 6, at, float("nan")), ("a", 7, at, 0.0), ("a", 8, at, -0.0)]
    sums = metrics.column_checksum(spark.createDataFrame(rows, "symbol string, split_id int, ts_event timestamp, pnl double"), ["pnl"])
    got = {r["split_id"]: r["first_output"] for r in metrics.duplicate_members(sums, "pnl_checksum").collect()}
    assert got == {0: "a/0", 1: "a/0", 7: "a/7", 8: "a/7"}


def test_gates_fail_on_nothing(spark):
    with pytest.raises(ValueError, match="no rows"):
        engine.require_passed(spark.createDataFrame([], "passed boolean"))
    with pytest.raises(ValueError, match="no gates"):
        risk.enforce_risk(spark.createDataFrame([], "gate string, status string, value double, limit double"))


def test_normal_cdf_to_double_precision(spark):
    values = [-40.0, -8.1, -7.9, -5.0, -1.96, -0.1, 0.0, 1e-9, 0.5, 1.96, 3.3, 7.9, 9.0, None]
    got = spark.createDataFrame([(v,) for v in values], "z double").select("z", metrics.normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        assert (r["p"] is None) if r["z"] is None else r["p"] == pytest.approx(0.5 * math.erfc(-r["z"] / math.sqrt(2)), abs=2e-15)
