"""Sessions, resampling, alignment, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.registry import STAMP, lag, lead, over, query, r, roll, rs, show, stamp, with_
from tidebar.catalog.views import DAILY, HOURLY, MINUTELY, NY, SESSION, daily, hourly, minutely, table, ticks
from tidebar.operators import align, contracts, sessions

OHLCV = ("open", "high", "low", "close", "volume")
OHLCV_SQL = ", ".join(f"{rs(c)} AS {c}" for c in OHLCV)


def bars_sql(source: str = "b", keys: str = "symbol") -> str:
    return f"SELECT {keys}, {STAMP}, {OHLCV_SQL} FROM {source}"


@query("ohlcv_bars", with_(HOURLY) + bars_sql())
def ohlcv_bars(spark, sf):
    return show(hourly(spark, sf), *OHLCV)


@query("session_ids", with_(MINUTELY) + f"SELECT symbol, {STAMP}, {SESSION} AS session_id, {OHLCV_SQL} FROM b")
def session_ids(spark, sf):
    return show(sessions.add_session_id(minutely(spark, sf)), *OHLCV, keys=("symbol", "session_id"))


MOD = f"(hour({NY}) * 60 + minute({NY}))"
IN_SESSION = f"({MOD} >= 1080 OR {MOD} < 960) AND NOT ({MOD} >= 1020 AND {MOD} < 1080)"


@query("session_filter", with_(MINUTELY) + bars_sql() + f" WHERE {IN_SESSION}")
def session_filter(spark, sf):
    return show(sessions.filter_session_hours(minutely(spark, sf)), *OHLCV)


def _session_bars(spark, sf):
    return sessions.add_session_id(sessions.filter_session_hours(minutely(spark, sf)))


S_BARS = f"s AS (SELECT symbol, {SESSION} AS session_id, ts, open, high, low, close, volume FROM b WHERE {IN_SESSION})"


def _resampled(bucket: str, least: int, name: str = "x") -> str:
    return (f"{name} AS (SELECT symbol, session_id, {bucket} AS bts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, "
            f"arg_max(close, ts) AS close, sum(volume)::BIGINT AS volume FROM s GROUP BY ALL HAVING count(*) >= {least})")


DAY_BUCKET = f"(date_trunc('day', {NY})::TIMESTAMP AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')"
RENAMED = "y AS (SELECT * EXCLUDE (bts), bts AS ts FROM x)"


@query("resample_5m", with_(MINUTELY, S_BARS, _resampled("time_bucket(INTERVAL 5 MINUTE, ts)", 1), RENAMED) + bars_sql("y", "symbol, session_id"))
def resample_5m(spark, sf):
    out = sessions.resample(_session_bars(spark, sf), "5m", drop_incomplete=False)
    return show(out, *OHLCV, keys=("symbol", "session_id"))


@query("resample_hourly", with_(MINUTELY, S_BARS, _resampled("date_trunc('hour', ts)", 2), RENAMED) + bars_sql("y", "symbol, session_id"))
def resample_hourly(spark, sf):
    return show(sessions.resample(_session_bars(spark, sf), "1h", min_ticks=2), *OHLCV, keys=("symbol", "session_id"))


DAILY_VOL = ("z AS (SELECT *, ln(close) - lag(ln(close)) OVER o AS ret FROM y WINDOW o AS (PARTITION BY symbol ORDER BY session_id, ts)), "
             "v AS (SELECT *, CASE WHEN count(ret) OVER f >= 2 THEN stddev_samp(ret) OVER f END AS vol0 FROM z "
             "WINDOW f AS (PARTITION BY symbol ORDER BY session_id, ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), "
             "w AS (SELECT *, coalesce(last_value(vol0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session_id, ts ROWS UNBOUNDED PRECEDING), "
             "first_value(vol0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY session_id, ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS vol FROM v) ")


@query("resample_daily", with_(MINUTELY, S_BARS, _resampled(DAY_BUCKET, 2), RENAMED, DAILY_VOL)
       + f"SELECT symbol, session_id, {STAMP}, {OHLCV_SQL}, {rs('ret')} AS daily_log_return, {rs('vol')} AS daily_vol_5 FROM w")
def resample_daily(spark, sf):
    out = sessions.add_daily_volatility(sessions.resample(_session_bars(spark, sf), "1d", min_ticks=2))
    return show(out, *OHLCV, "daily_log_return", "daily_vol_5", keys=("symbol", "session_id"))


@query("resample_session_day", with_(MINUTELY, S_BARS, _resampled("'day'", 1))
       + f"SELECT symbol, session_id, {OHLCV_SQL} FROM x")
def resample_session_day(spark, sf):
    out = sessions.resample(_session_bars(spark, sf), "1d", daily="session", min_ticks=1)
    return out.select("symbol", "session_id", *[r(c).alias(c) for c in OHLCV])


@query("gap_filter", with_(MINUTELY, f"g AS (SELECT *, {lag('ts')} AS p FROM b)") + bars_sql("g") + " WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) <= 1800000000")
def gap_filter(spark, sf):
    return show(sessions.filter_gaps(minutely(spark, sf), 30), *OHLCV)


@query("gap_fill", with_(HOURLY, f"g AS (SELECT *, {lead('ts')} AS n FROM b)",
                         "f AS (SELECT symbol, ts + to_hours(k::BIGINT) AS ts, open, high, low, close, volume FROM g, "
                         "range(0, CASE WHEN n - ts > INTERVAL 60 MINUTE AND n - ts <= INTERVAL 480 MINUTE "
                         "THEN (epoch_us(n) - epoch_us(ts)) // 3600000000 ELSE 1 END) AS t(k))") + bars_sql("f"))
def gap_fill(spark, sf):
    return show(sessions.fill_intraday_gaps(hourly(spark, sf), bar_seconds=3600), *OHLCV)


@query("target_feasibility", with_(MINUTELY, f"g AS (SELECT *, (epoch_us(ts) - epoch_us({lag('ts')})) / 6e7 AS m FROM b)")
       + "SELECT symbol, count(*) AS rows, count(*) FILTER (m > 60 AND m <= 240) AS intraday_gaps, "
       + rs("max(m) FILTER (m > 60 AND m <= 240)") + " AS max_gap_minutes, count(*) >= 25 AS passed FROM g GROUP BY symbol")
def target_feasibility(spark, sf):
    out = sessions.check_target_feasibility(minutely(spark, sf))
    return out.select("symbol", "rows", "intraday_gaps", r("max_gap_minutes").alias("max_gap_minutes"), "passed")


HOUR_SHIFTED = "h AS (SELECT symbol, bts + INTERVAL 1 HOUR AS hts, open AS ho, close AS hc, volume AS hv FROM x)"


@query("asof_hourly", with_(MINUTELY, S_BARS, _resampled("date_trunc('hour', ts)", 2), HOUR_SHIFTED)
       + f"SELECT s.symbol, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS ts, {rs('s.close')} AS close, {rs('ho')} AS \"1h_open\", "
       f"{rs('hc')} AS \"1h_close\", {rs('hv')} AS \"1h_volume\" FROM s ASOF LEFT JOIN h ON s.symbol = h.symbol AND s.ts >= h.hts")
def asof_hourly(spark, sf):
    base = _session_bars(spark, sf)
    out = align.align_htf(base, sessions.resample(base, "1h", min_ticks=2), None)
    return show(out, "close", "1h_open", "1h_close", "1h_volume")


@query("asof_daily_ffill", with_(MINUTELY, S_BARS, _resampled(DAY_BUCKET, 2),
                                 "d AS (SELECT symbol, bts + INTERVAL 24 HOUR AS dts, arg_max(close, session_id) AS dc, arg_max(high, session_id) AS dh FROM x GROUP BY ALL)",
                                 "j AS (SELECT s.*, d.dc, d.dh FROM s ASOF LEFT JOIN d ON s.symbol = d.symbol AND s.ts >= d.dts)")
       + f"SELECT symbol, session_id, {STAMP}, {rs('close')} AS close, "
       + ", ".join(f"{rs(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol, session_id ORDER BY ts ROWS UNBOUNDED PRECEDING)')} AS {n}"
                   for c, n in (("dc", "daily_close"), ("dh", "daily_high"))) + " FROM j")
def asof_daily_ffill(spark, sf):
    base = _session_bars(spark, sf)
    out = align.align_htf(base, None, sessions.resample(base, "1d", min_ticks=2))
    return show(out, "close", "daily_close", "daily_high", keys=("symbol", "session_id"))


@query("asof_forward", with_(MINUTELY, "k AS (SELECT symbol, date_trunc('hour', ts) AS ts FROM b GROUP BY ALL)")
       + f"SELECT k.symbol, strftime(k.ts, '%Y-%m-%d %H:%M:%S') AS ts, {rs('b.close')} AS close FROM k ASOF LEFT JOIN b ON k.symbol = b.symbol AND k.ts < b.ts")
def asof_forward(spark, sf):
    bars = minutely(spark, sf)
    hours = bars.select("symbol", F.date_trunc("hour", "ts_event").alias("ts_event")).distinct()
    return show(align.asof_join(hours, bars.select("symbol", "ts_event", "close"), ["close"], direction="forward"), "close")


@query("cross_asset", with_(HOURLY, f"c AS (SELECT *, {SESSION} AS session_id, ln(close / {lag('close')}) AS ret FROM b)",
                            "p AS (SELECT ts, first(ret) FILTER (symbol = 'ES') AS es, first(ret) FILTER (symbol = 'CL') AS cl FROM c WHERE symbol IN ('ES', 'CL') GROUP BY ts)",
                            "j AS (SELECT c.symbol, c.session_id, c.ts, c.close, es, cl FROM c LEFT JOIN p USING (ts))")
       + f"SELECT symbol, {STAMP}, {rs('close')} AS close, "
       + ", ".join(f"{rs(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol, session_id ORDER BY ts ROWS UNBOUNDED PRECEDING)')} AS {n}"
                   for c, n in (("es", "ES_ret_1"), ("cl", "CL_ret_1"))) + " FROM j")
def cross_asset(spark, sf):
    bars = sessions.add_session_id(hourly(spark, sf))
    return show(align.join_cross_asset(bars, bars, ["ES", "CL"]), "close", "ES_ret_1", "CL_ret_1")


# Roll rule and month letters as SQL values.
RULES_SQL = ("rules AS (SELECT s.symbol, m.month::INT AS month, s.days, s.step FROM (VALUES ('ES', 1, 3), ('NQ', 1, 3), ('ZB', 7, 3), ('CL', 7, 1)) s(symbol, days, step), "
             "range(1, 13) m(month) WHERE s.step = 1 OR m.month % 3 = 0)")
ROLLS_SQL = (RULES_SQL + ", spans AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM b GROUP BY symbol), "
             "ym AS (SELECT r.symbol, y.y::INT AS y, r.month, r.days, r.step, make_date(y.y, r.month, 1) AS d, s.a, s.z FROM rules r JOIN spans s USING (symbol), "
             "range(1990, 2030) y(y) WHERE y.y BETWEEN year(s.a) AND year(s.z)), "
             "rolls AS (SELECT symbol, (d + ((5 - isodow(d) + 7) % 7)::INT + 14 - days)::TIMESTAMP AS roll_date, y, month, "
             "CASE WHEN month + step > 12 THEN month + step - 12 ELSE month + step END AS back_month, CASE WHEN month + step > 12 THEN y + 1 ELSE y END AS back_y, a, z FROM ym), "
             "rd AS (SELECT symbol, roll_date, symbol || substr('FGHJKMNQUVXZ', month, 1) || lpad((y % 100)::VARCHAR, 2, '0') AS front_contract, "
             "symbol || substr('FGHJKMNQUVXZ', back_month, 1) || lpad((back_y % 100)::VARCHAR, 2, '0') AS back_contract, month AS front_month, back_month "
             "FROM rolls WHERE roll_date BETWEEN a AND z)")


@query("roll_dates", with_(DAILY, ROLLS_SQL) + "SELECT symbol, strftime(roll_date, '%Y-%m-%d') AS roll_date, front_contract, back_contract, front_month, back_month::INT AS back_month FROM rd")
def roll_dates(spark, sf):
    bars = daily(spark, sf)
    spans = bars.groupBy("symbol").agg(F.min("ts_event").alias("start"), F.max("ts_event").alias("end"))
    return contracts.roll_dates(spans).withColumn("roll_date", F.date_format("roll_date", "yyyy-MM-dd"))


FACTORS_SQL = ("fr AS (SELECT rd.*, b.close AS fc FROM rd ASOF LEFT JOIN b ON rd.symbol = b.symbol AND rd.roll_date >= b.ts), "
               "bk AS (SELECT fr.*, b.close AS bc FROM fr ASOF LEFT JOIN b ON fr.symbol = b.symbol AND fr.roll_date < b.ts), "
               "fa AS (SELECT *, coalesce(fc / greatest(bc, 1e-12), 1.0) AS ratio FROM bk), "
               "cf AS (SELECT *, exp(sum(ln(ratio)) OVER (PARTITION BY symbol ORDER BY roll_date)) AS cum FROM fa)")


@query("roll_factors", with_(DAILY, ROLLS_SQL, FACTORS_SQL)
       + f"SELECT symbol, strftime(roll_date, '%Y-%m-%d') AS roll_date, front_contract, back_contract, {rs('ratio')} AS adjustment_factor, {rs('ln(cum)')} AS log_factor FROM cf")
def roll_factors(spark, sf):
    bars = daily(spark, sf)
    spans = bars.groupBy("symbol").agg(F.min("ts_event").alias("start"), F.max("ts_event").alias("end"))
    out = contracts.roll_factors(bars, contracts.roll_dates(spans))
    return out.select("symbol", F.date_format("roll_date", "yyyy-MM-dd").alias("roll_date"), "front_contract", "back_contract",
                      r("adjustment_factor").alias("adjustment_factor"), r(F.ln("cumulative_factor")).alias("log_factor"))


CONTINUOUS = ("j AS (SELECT b.*, cf.cum, cf.back_contract FROM b {join}), "
              "k AS (SELECT *, coalesce({cum}, 1.0) AS factor, coalesce({con}, (SELECT arg_min(front_contract, roll_date) FROM cf WHERE cf.symbol = j.symbol), symbol) AS contract_month FROM j)")
CONTINUOUS_OUT = (f"SELECT symbol, {STAMP}, contract_month, {rs('ln(factor)')} AS log_factor, {rs('ln(close * factor)')} AS log_price, "
                  f"{rs('ln(factor / coalesce(' + lag('factor') + ', 1.0))')} AS log_step FROM k")
FILL = "last_value({} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _continuous(spark, sf, match):
    out = contracts.continuous_series(daily(spark, sf), match=match)
    return out.select("symbol", stamp(), "contract_month", r(F.ln("cumulative_factor")).alias("log_factor"),
                      r(F.ln("continuous_price")).alias("log_price"), r(F.ln("adjustment_factor")).alias("log_step"))


@query("continuous", with_(DAILY, ROLLS_SQL, FACTORS_SQL, CONTINUOUS.format(
    join="ASOF LEFT JOIN cf ON b.symbol = cf.symbol AND b.ts >= cf.roll_date", cum="cum", con="back_contract")) + CONTINUOUS_OUT)
def continuous(spark, sf):
    return _continuous(spark, sf, "asof")


@query("continuous_exact", with_(DAILY, ROLLS_SQL, FACTORS_SQL, CONTINUOUS.format(
    join="LEFT JOIN cf ON b.symbol = cf.symbol AND b.ts = cf.roll_date", cum=FILL.format("cum"), con=FILL.format("back_contract"))) + CONTINUOUS_OUT)
def continuous_exact(spark, sf):
    return _continuous(spark, sf, "exact")


@query("ratio_adjusted", with_(DAILY, "f AS (SELECT * FROM b WHERE volume >= 1)", "k AS (SELECT * REPLACE (close * 1.25 AS close, open * 1.25 AS open) FROM b)",
                               "e AS (SELECT symbol, coalesce(max(fc) / greatest(max(bc), 1e-12), 1.0) AS ratio FROM (SELECT f.symbol, "
                               "arg_max(f.close, f.ts) AS fc, NULL::DOUBLE AS bc FROM f WHERE ts <= TIMESTAMP '1998-03-15' GROUP BY f.symbol UNION ALL "
                               "SELECT k.symbol, NULL, arg_max(k.close, k.ts) FROM k WHERE ts <= TIMESTAMP '1998-03-15' GROUP BY k.symbol) GROUP BY symbol)")
       + f"SELECT f.symbol, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS ts, {rs('ratio')} AS adjustment_factor, {rs('close * ratio', 4)} AS continuous_price "
       "FROM f JOIN e USING (symbol) WHERE ts <= TIMESTAMP '1998-03-15' UNION ALL "
       f"SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 1.0::DOUBLE, {rs('close', 4)} FROM k WHERE ts > TIMESTAMP '1998-03-15'")
def ratio_adjusted(spark, sf):
    front = daily(spark, sf)
    back = front.withColumns({"close": F.col("close") * 1.25, "open": F.col("open") * 1.25})
    out = contracts.ratio_adjusted(front, back, "1998-03-15")
    return out.select("symbol", stamp(), r("adjustment_factor").alias("adjustment_factor"), r("continuous_price", 4).alias("continuous_price"))


@query("apply_splice", with_(DAILY, "a AS (SELECT symbol, ts, 1.0 + volume / 100.0::DOUBLE AS f FROM b WHERE volume % 3 = 0)",
                             "j AS (SELECT b.*, a.f FROM b LEFT JOIN a USING (symbol, ts))", f"k AS (SELECT *, coalesce({FILL.format('f')}, 1.0) AS cum FROM j)")
       + f"SELECT symbol, {STAMP}, {rs('cum')} AS cumulative_factor, {rs('close * cum', 4)} AS continuous_price FROM k")
def apply_splice(spark, sf):
    bars = daily(spark, sf)
    steps = bars.filter("volume % 3 = 0").select("symbol", "ts_event", (1.0 + F.col("volume") / 100.0).alias("cumulative_factor"))
    out = contracts.apply_splice(bars, steps)
    return out.select("symbol", stamp(), r("cumulative_factor").alias("cumulative_factor"), r("continuous_price", 4).alias("continuous_price"))
