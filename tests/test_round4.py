"""Running money added in the order of the SQL, ticks of weekly bars shuffled once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import BAR_SCHEMA, make_bars
from tidebar.catalog import QUERIES, features, views
from tidebar.operators import execution, metrics
from tidebar.plans import blocks as B


@pytest.fixture(scope="module")
def money(spark):
    """9,000 and 700 bars, their PnL in parts of a cent; two of them cancel."""
    rows = make_bars(9000) + make_bars(700, symbol="CL", seed=2, base=70.0)
    t = F.unix_seconds("ts_event") / 300
    df = spark.createDataFrame(rows, BAR_SCHEMA).withColumn("pnl", F.round(F.sin(t) * 1e5, 3) / 7)
    return df.withColumns({"gross_pnl": -F.col("pnl"), "benchmark_pnl": F.cos(t) / 3, "position": F.lit(1.0)}).cache()


@pytest.mark.parametrize("block_rows", [100_000, 3000])
def test_running_money_is_that_of_sql(money, block_rows):
    """before, sums with one rounding, whose last bits decided halves and the sign of trades without gain otherwise than the SQL's."""
    plan = B.measure(money, block_rows=block_rows)
    equity = execution.add_equity(money, plan, execution.ExecutionSettings()).orderBy("symbol", "ts_event").toPandas()
    paths = metrics.with_path_columns(money, ["symbol"], plan).orderBy("symbol", "ts_event").toPandas()
    bars = money.select("symbol", "ts_event", "pnl", "gross_pnl", "benchmark_pnl").toPandas()
    con = duckdb.connect()
    con.register("bars", bars)
    want = con.execute("SELECT 100000 + sum(pnl) OVER w AS equity_curve, 100000 + sum(gross_pnl) OVER w AS gross_equity_curve, sum(pnl) OVER w AS _cum, "
                       "sum(benchmark_pnl) OVER w AS _bench_cum FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_event ROWS UNBOUNDED PRECEDING) ORDER BY symbol, ts_event").df()
    assert len(equity) == len(paths) == 9700
    for got, c in ((equity, "equity_curve"), (equity, "gross_equity_curve"), (paths, "_cum"), (paths, "_bench_cum")):
        assert got[c].tolist() == want[c].tolist(), c


def test_a_sum_of_groups_keeps_rows_without_money(spark):
    """NULL adds nothing, NaN stays; keys may be shorter than a group."""
    rows = [("A", i, None if i % 3 else 1.5) for i in range(40)] + [("B", 0, 2.5), ("C", 0, None), ("C", 1, float("nan")), ("C", 2, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, i int, x double").withColumn("ts_event", F.timestamp_seconds(F.col("i") * 3600))
    for plan in (B.whole(), B.measure(df, block_rows=5, cell_seconds=3600)):
        out = {(r["symbol"], r["i"]): r["x_run"] for r in B.carry(df, plan, {"x_run": ("grouped", F.col("x")), "n": ("sum", F.lit(1))}).collect()}
        assert len(out) == 44 and out["A", 39] == 1.5 * 14 and out["A", 1] == 1.5 and out["B", 0] == 2.5
        assert out["C", 0] == 0.0 and out["C", 1] != out["C", 1] and out["C", 2] != out["C", 2]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["baseline_features", "expanded_features"])
def test_weekly_features_shuffle_ticks_once(spark, monkeypatch, name):
    """before, partial bars were shuffled by week and then bars by series, and bars were built once more to be measured."""
    monkeypatch.setattr(features, "measure", lambda df, *a, **k: B.measure(df.select("symbol", "ts_event"), *a, **k))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("block_rows, few", [(100_000, True), (500, False)])
def test_bars_of_few_and_many_ticks(spark, block_rows, few):
    """Series of many ticks are measured as bars and not dealt to one task each."""
    sf = "/root/testdata/sf0.001"
    bars, plan = views.planned_weekly(spark, sf, lambda df: B.measure(df, block_rows=block_rows))
    assert (plan.cells is None) and ("REPARTITION" in bars._jdf.queryExecution().executedPlan().toString().upper()) == few
    want = views.weekly(spark, sf)
    assert bars.columns == want.columns and bars.exceptAll(want).count() == want.exceptAll(bars).count() == 0 < bars.count()
