"""Raw-bar audits, holidays, session calendars, gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.registry import STAMP, lag, lead, over, query, r, roll, rs, show, stamp, with_
from tidebar.catalog.views import DAILY, HOURLY, MINUTELY, RAW, daily, minutely, raw_rows, ticks
from tidebar.operators import audit, calendars, engine, sessions
from tidebar.plans.order_stats import average_ranks, exact_quantiles
from tidebar.sources.bars import audit_status
from tidebar.sources.dimensions import AUDIT_TICKS, price_band_dim

KEY = "symbol, file_year"
TICKS_SQL = "tk AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {t}::DOUBLE)" for s, t in AUDIT_TICKS.items()) + ") t(symbol, tick))"


def _off(c: str) -> str:
    return f"coalesce(abs({c} / tick - round_even({c} / tick, 0)) > 1e-7, false)"


OFF = " OR ".join(_off(c) for c in ("open", "high", "low", "close"))
ROW_RULES = [("FAIL", "high_lt_low", "high < low"), ("FAIL", "high_lt_open", "high < open"), ("FAIL", "high_lt_close", "high < close"),
             ("FAIL", "low_gt_open", "low > open"), ("FAIL", "low_gt_close", "low > close"), ("FAIL", "negative_volume", "volume < 0"),
             ("WARN", "price_off_tick_grid", OFF), ("WARN", "zero_volume", "volume = 0"), ("WARN", "zero_range", "high = low"),
             ("FAIL", "timestamp_not_minute_aligned", "date_trunc('minute', ts) <> ts"), ("WARN", "non_integer_volume", "volume % 1 <> 0")]
UNIQUE = "u AS (SELECT symbol, file_year, ts, first(close) AS close FROM raw GROUP BY 1, 2, 3 HAVING count(*) = 1)"
GAPS = (f"g AS (SELECT *, lag(ts) OVER (PARTITION BY {KEY} ORDER BY ts) AS prev_ts, lag(close) OVER (PARTITION BY {KEY} ORDER BY ts) AS pc FROM u), "
        "gp AS (SELECT *, (epoch_us(ts) - epoch_us(prev_ts)) / 6e7 AS gap FROM g WHERE epoch_us(ts) - epoch_us(prev_ts) > 60000000)")
STALE = (f"sm AS (SELECT *, coalesce(close = pc, false) AS same FROM g), sc AS (SELECT *, CASE WHEN same <> coalesce(lag(same) OVER (PARTITION BY {KEY} ORDER BY ts), false) THEN 1 ELSE 0 END AS chg FROM sm), "
         f"si AS (SELECT *, sum(chg) OVER (PARTITION BY {KEY} ORDER BY ts) AS isl FROM sc), "
         f"sr AS (SELECT {KEY}, max(n) AS stale FROM (SELECT {KEY}, isl, count(*) FILTER (same) AS n FROM si GROUP BY ALL) GROUP BY ALL)")
DUPES = f"du AS (SELECT {KEY}, ts, count(*) AS n FROM raw GROUP BY ALL HAVING count(*) > 1)"


@query("core_audit", with_(RAW, TICKS_SQL, UNIQUE, GAPS, DUPES, "rt AS (SELECT raw.*, tick FROM raw LEFT JOIN tk USING (symbol))")
       + " UNION ALL ".join(f"SELECT {KEY}, '{s}' AS severity, '{n}' AS \"check\", count(*) AS n FROM rt WHERE {t} GROUP BY {KEY}" for s, n, t in ROW_RULES)
       + f" UNION ALL SELECT {KEY}, 'FAIL', 'duplicate_ts', sum(n)::BIGINT FROM du GROUP BY {KEY} UNION ALL SELECT {KEY}, 'WARN', 'timestamp_gaps_gt_1min', count(*) FROM gp GROUP BY {KEY}")
def core_audit(spark, sf):
    return audit.core_issues(raw_rows(spark, sf)).select("symbol", "file_year", "severity", "check", "n")


#: Rows of `raw` spoiled by a number made of minute and volume, so that every rule is broken: what is put in place of which column.
SPOILED = {"ts": {3: None, 89: "shift"}, "file_year": {5: 1900, 71: 1901}, "open": {71: None, 7: None, 11: "nan", 13: -1.0}, "high": {17: "inf", 19: 0.5, 73: None, 79: -1.0}, "low": {23: "-inf", 29: 0.0, 31: 1e9, 83: None},
           "close": {37: None, 41: -2.0, 43: 1e9}, "volume": {47: None, 53: -3.0, 59: 1.5, 61: 0.0, 67: "nan"}}
SPOILED_SQL = ("spoiled AS (SELECT symbol, " + ", ".join(
    f"CASE part % 211 {' '.join(f'WHEN {k} THEN ' + ('NULL' if v is None else 'ts + INTERVAL 30 SECOND' if v == 'shift' else repr(v) + ('::INT' if c == 'file_year' else '::DOUBLE')) for k, v in by.items())} ELSE {c} END AS {c}"
    for c, by in SPOILED.items()) + " FROM (SELECT raw.*, epoch_us(ts) // 60000000 + 17 * volume::BIGINT AS part FROM raw))")
NUMERIC = ("open", "high", "low", "close", "volume")
FINITE = " AND ".join(f"coalesce(isfinite({c}), false)" for c in NUMERIC)
ALL_RULES = [("FAIL", "bad_ts_parse", "ts IS NULL"), ("FAIL", "timestamp_not_minute_aligned", "date_trunc('minute', ts) <> ts"),
             *[("FAIL", f"bad_numeric_{c}", f"{c} IS NULL OR isnan({c})") for c in NUMERIC], ("FAIL", "non_finite_numeric", "NOT ok"),
             *[(s, n, f"use AND ({t})") for s, n, t in (
                 *[x for x in ROW_RULES if x[1] != "timestamp_not_minute_aligned"], ("FAIL", "timestamp_outside_file_year", "year(ts) <> file_year"),
                 *[("FAIL", f"nonpositive_{c}", f"{c} <= 0") for c in NUMERIC[:4]])]]


def spoiled_rows(spark, sf):
    """The raw bars with rows that break every rule."""
    numbered = raw_rows(spark, sf)
    minutes = F.floor(F.unix_micros("ts_event") / F.lit(60_000_000)).cast("long")
    rows = numbered.withColumn("part", (minutes + 17 * F.col("volume").cast("long")) % 211)
    for c, by in SPOILED.items():
        name = "ts_event" if c == "ts" else c
        value = F.col(name)
        for k, v in by.items():
            kind = dict(numbered.dtypes)[name]
            put = F.col(name) + F.expr("INTERVAL 30 SECONDS") if v == "shift" else F.lit(v).cast(kind)
            value = F.when(F.col("part") == k, put).otherwise(value)
        rows = rows.withColumn(name, value)
    return rows.drop("part")


@query("core_audit_rules", with_(RAW, TICKS_SQL, SPOILED_SQL, f"sp AS (SELECT spoiled.*, tick, {FINITE} AS ok, ts IS NOT NULL AND ({FINITE}) AS use FROM spoiled LEFT JOIN tk USING (symbol))",
                                 f"dp AS (SELECT {KEY}, ts, count(*) AS n, first(close) AS close FROM sp WHERE use GROUP BY ALL)",
                                 f"li AS (SELECT *, lag(ts) OVER w AS prev_ts, coalesce(close = lag(close) OVER w, false) AS same FROM dp WHERE n = 1 WINDOW w AS (PARTITION BY {KEY} ORDER BY ts))",
                                 f"li2 AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY {KEY} ORDER BY ts) AS run FROM li)",
                                 f"rn AS (SELECT {KEY}, max(n) AS n FROM (SELECT {KEY}, run, count(*) FILTER (same) AS n FROM li2 GROUP BY ALL) GROUP BY ALL)")
       + " UNION ALL ".join(f"SELECT {KEY}, '{s}' AS severity, '{n}' AS \"check\", count(*) AS n FROM sp WHERE {t} GROUP BY {KEY}" for s, n, t in ALL_RULES)
       + f" UNION ALL SELECT {KEY}, 'FAIL', 'duplicate_ts', sum(n)::BIGINT FROM dp WHERE n > 1 GROUP BY {KEY}"
       f" UNION ALL SELECT {KEY}, 'WARN', 'timestamp_gaps_gt_1min', count(*) FROM li WHERE epoch_us(ts) - epoch_us(prev_ts) > 60000000 GROUP BY {KEY}"
       f" UNION ALL SELECT {KEY}, 'WARN', 'stale_close_run', n FROM rn WHERE n >= 1"
       f" UNION ALL SELECT {KEY}, 'FAIL', 'no_valid_numeric_rows', count(*) FROM sp GROUP BY {KEY} HAVING count(*) FILTER (use) = 0")
def core_audit_rules(spark, sf):
    """Every rule, each broken by some rows."""
    return audit.core_issues(spoiled_rows(spark, sf), stale_limit=1).select("symbol", "file_year", "severity", "check", "n")


@query("core_summary", with_(RAW, UNIQUE, GAPS, STALE, DUPES, f"dd AS (SELECT {KEY}, sum(n)::BIGINT AS dup FROM du GROUP BY ALL), gg AS (SELECT {KEY}, count(*) AS gaps FROM gp GROUP BY ALL)")
       + f"SELECT {KEY}, count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, any_value(coalesce(dup, 0)) AS duplicate_ts, "
       f"any_value(coalesce(gaps, 0)) AS gap_count_gt_1min, any_value(coalesce(stale, 0)) AS stale_close_run_max, count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (high = low) AS zero_range, "
       f"{rs('max(close)', 3)} AS close_max, {rs('sum(volume)', 3)} AS volume_sum FROM raw LEFT JOIN dd USING ({KEY}) LEFT JOIN gg USING ({KEY}) LEFT JOIN sr USING ({KEY}) GROUP BY {KEY}")
def core_summary(spark, sf):
    s = audit.core_summary(raw_rows(spark, sf))
    return s.select("symbol", "file_year", "rows", stamp("first_ts"), stamp("last_ts"), "duplicate_ts", "gap_count_gt_1min", "stale_close_run_max", "zero_volume", "zero_range",
                    r("close_max", 3).alias("close_max"), r("volume_sum", 3).alias("volume_sum"))


@query("gap_rows", with_(RAW, UNIQUE, GAPS) + f"SELECT {KEY}, strftime(prev_ts, '%Y-%m-%d %H:%M:%S') AS prev_ts, {STAMP}, {rs('gap')} AS gap_minutes FROM gp")
def gap_rows(spark, sf):
    return audit.gap_rows(raw_rows(spark, sf)).select("symbol", "file_year", stamp("prev_ts"), stamp(), r("gap_minutes").alias("gap_minutes"))


@query("gap_summary", with_(RAW, UNIQUE, GAPS) + f"SELECT {KEY}, count(*) AS gap_rows, {rs('min(gap)')} AS min_gap_minutes, {rs('median(gap)')} AS median_gap_minutes, {rs('max(gap)')} AS max_gap_minutes FROM gp GROUP BY {KEY}")
def gap_summary(spark, sf):
    s = audit.gap_summary(audit.gap_rows(raw_rows(spark, sf)))
    return s.select("symbol", "file_year", "gap_rows", *[r(c).alias(c) for c in ("min_gap_minutes", "median_gap_minutes", "max_gap_minutes")])


def _mad(x: str, n: str, source: str) -> str:
    return (f"{n}1 AS (SELECT {KEY}, median({x}) AS med FROM {source} GROUP BY ALL), {n}2 AS (SELECT s.*, abs({x} - med) AS dev, med FROM {source} s JOIN {n}1 USING ({KEY})), "
            f"{n}3 AS (SELECT {KEY}, median(dev) AS mad FROM {n}2 GROUP BY ALL), {n} AS (SELECT q.* EXCLUDE (dev, med), CASE WHEN mad > 0 THEN 0.6745::DOUBLE * ({x} - med) / mad ELSE 0 END AS {n}z FROM {n}2 q JOIN {n}3 USING ({KEY}))")


DAILY_FILE = DAILY.replace("b AS", "b0 AS") + ", b AS (SELECT *, year(ts) AS file_year, close * volume AS dollar FROM b0)"
OUTLIERS = (f"o AS (SELECT *, close / lag(close) OVER (PARTITION BY {KEY} ORDER BY ts) - 1 AS ret, (high - low) / close AS hl FROM b), " + _mad("volume", "v", "o") + ", " + _mad("dollar", "d", "v"))
OUTLIER_ROWS = [("abs_close_return_gt_2pct", "ret", "abs(ret) > 0.02"), ("hl_range_gt_2pct", "hl", "hl > 0.02"), ("volume_mad_z_gt_25", "vz", "abs(vz) > 2"), ("dollar_volume_mad_z_gt_25", "dz", "abs(dz) > 2")]


@query("outliers_mad", with_(DAILY_FILE, OUTLIERS) + " UNION ALL ".join(f"SELECT {KEY}, {STAMP}, '{n}' AS \"check\", {rs(x)} AS value FROM d WHERE {t}" for n, x, t in OUTLIER_ROWS))
def outliers_mad(spark, sf):
    df = daily(spark, sf).withColumn("file_year", F.year("ts_event"))
    return audit.outliers(df, z_limit=2.0).select("symbol", "file_year", stamp(), "check", r("value").alias("value"))


@query("cross_year", with_(RAW, f"s AS (SELECT {KEY}, min(ts) AS f, max(ts) AS l FROM raw GROUP BY ALL)",
                           "p AS (SELECT symbol, file_year AS year_a, lead(file_year) OVER w AS year_b, f, l, lead(f) OVER w AS fb FROM s WINDOW w AS (PARTITION BY symbol ORDER BY file_year))")
       + f"SELECT symbol, year_a, year_b, CASE WHEN fb <= l THEN 'FAIL' ELSE 'INFO' END AS severity, {rs('(epoch_us(fb) - epoch_us(l)) / 6e7')} AS gap_minutes FROM p WHERE year_b IS NOT NULL")
def cross_year(spark, sf):
    bounds = raw_rows(spark, sf).groupBy("symbol", "file_year").agg(F.min("ts_event").alias("first_ts"), F.max("ts_event").alias("last_ts"))
    return audit.cross_year(bounds).select("symbol", "year_a", "year_b", "severity", r("gap_minutes").alias("gap_minutes"))


@query("missing_years", with_(RAW, "k AS (SELECT * FROM raw WHERE file_year NOT IN (1997, 1999))", "c AS (SELECT DISTINCT symbol, file_year AS y FROM k)",
                              "s AS (SELECT symbol, min(y) AS a, max(y) AS z FROM c GROUP BY symbol)")
       + "SELECT s.symbol, y::INT AS year FROM s, range(1990, 2010) t(y) WHERE y BETWEEN a AND z AND NOT EXISTS (SELECT 1 FROM c WHERE c.symbol = s.symbol AND c.y = t.y)")
def missing_years(spark, sf):
    return audit.missing_years(raw_rows(spark, sf).filter(~F.col("file_year").isin(1997, 1999))).select("symbol", "year")


@query("clean_rows", with_(RAW, TICKS_SQL, f"n AS (SELECT *, count(*) OVER (PARTITION BY {KEY}, ts) AS c FROM raw)", "t AS (SELECT n.*, tick * 1e-3 AS tick FROM n LEFT JOIN tk USING (symbol))")
       + f"SELECT {KEY}, {STAMP}, {rs('ln(close)')} AS log_close FROM t WHERE c = 1 AND high >= low AND high >= open AND high >= close AND low <= open AND low <= close AND low > 0 AND volume >= 0 AND NOT ({OFF})")
def clean_rows(spark, sf):
    ticks_ = spark.createDataFrame([(s, t * 1e-3) for s, t in AUDIT_TICKS.items()], "symbol string, tick double")
    return audit.clean_rows(raw_rows(spark, sf), ticks_).select("symbol", "file_year", stamp(), r(F.ln("close")).alias("log_close"))


@query("symbol_sanity", with_(MINUTELY) + f"SELECT symbol, count(*) AS rows, {rs('avg(close)')} AS close_mean, count(*) >= 1000 AND avg(close) BETWEEN "
       "(CASE symbol WHEN 'CL' THEN 0.1 WHEN 'ES' THEN 500 WHEN 'NQ' THEN 1000 WHEN 'GC' THEN 500 WHEN 'ZC' THEN 50 END) AND (CASE symbol WHEN 'CL' THEN 200 WHEN 'ES' THEN 10000 WHEN 'NQ' THEN 30000 WHEN 'GC' THEN 5000 WHEN 'ZC' THEN 20 END) AS passed FROM b GROUP BY symbol")
def symbol_sanity(spark, sf):
    return audit.symbol_sanity(minutely(spark, sf), price_band_dim(spark)).select("symbol", "rows", r("close_mean").alias("close_mean"), "passed")


@query("canonical_check", with_(RAW) + ", k AS (SELECT *, count(*) OVER (PARTITION BY symbol, ts) AS c FROM raw) SELECT symbol, count(*) AS rows, count(*) FILTER (high < low) AS high_lt_low, "
       "count(*) FILTER (open < low OR open > high) AS open_outside, count(*) FILTER (close < low OR close > high) AS close_outside, count(*) FILTER (c > 1) AS duplicate_ts FROM k GROUP BY symbol")
def canonical_check(spark, sf):
    df = raw_rows(spark, sf).withColumn("session_id", F.date_format("ts_event", "yyyy-MM-dd"))
    return engine.check_canonical(df).select("symbol", "rows", "high_lt_low", "open_outside", "close_outside", "duplicate_ts")


@query("longest_run", with_(DAILY, f"f AS (SELECT *, close > open AS up FROM b), c AS (SELECT *, CASE WHEN up <> coalesce({lag('up')}, false) THEN 1 ELSE 0 END AS chg FROM f), i AS (SELECT *, sum(chg) {over()} AS isl FROM c)")
       + "SELECT symbol, max(n) AS longest_run FROM (SELECT symbol, isl, count(*) FILTER (up) AS n FROM i GROUP BY ALL) GROUP BY symbol")
def longest_run(spark, sf):
    return audit.longest_run(daily(spark, sf), F.col("close") > F.col("open"), ("symbol",))


@query("audit_status", with_(RAW) + f"SELECT {KEY}, CASE WHEN bool_or(high < close) THEN 'FAIL' ELSE 'PASS' END AS audit_status FROM raw GROUP BY {KEY}")
def audit_status_query(spark, sf):
    rows = raw_rows(spark, sf).select("symbol", "file_year", F.when(F.col("high") < F.col("close"), "FAIL").otherwise("WARN").alias("severity"))
    return audit_status(rows)


@query("exact_quantiles", "SELECT event_type AS symbol, " + ", ".join(f"{rs(f'quantile_cont(value, {q})')} AS q{int(q * 100)}" for q in (0.25, 0.5, 0.85)) + " FROM events GROUP BY event_type")
def exact_quantile_query(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("event_type", "symbol")
    q = exact_quantiles(e, ["symbol"], "value", (0.25, 0.5, 0.85), group_rows=1000)
    return q.select("symbol", *[r(F.col("quantiles")[i]).alias(n) for i, n in enumerate(("q25", "q50", "q85"))])


@query("average_ranks", f"SELECT event_id, {rs('rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0')} AS rank FROM events")
def average_rank_query(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return average_ranks(e, ["event_type"], "value", "rank", group_rows=1000).select("event_id", r("rank").alias("rank"))


# ---- calendars ------------------------------------------------------------------------------------------------

def _nth(month: int, isodow: int, n: int) -> str:
    return f"(make_date(y, {month}, 1) + (({isodow} - isodow(make_date(y, {month}, 1)) + 7) % 7)::INT + {7 * (n - 1)})"


def _observed(month: int, day: int) -> str:
    d = f"make_date(y, {month}, {day})"
    return f"(CASE isodow({d}) WHEN 6 THEN {d} - 1 WHEN 7 THEN {d} + 1 ELSE {d} END)"


EASTER = ("ea AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM ys), eb AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM ea), "
          "ec AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM eb), ed AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM ec), "
          "ef AS (SELECT y, make_date(y, ((h + l - 7 * m + 114) // 31)::INT, ((h + l - 7 * m + 114) % 31 + 1)::INT) AS e FROM ed)")
HOLIDAYS = (EASTER + ", hd AS (SELECT y AS year, 'good_friday' AS holiday, e - 2 AS d, true AS closed, false AS early, false AS late FROM ef UNION ALL "
            + " UNION ALL ".join(f"SELECT y, '{n}', {d}, false, {e}, {o} FROM ys" for n, d, e, o in (
                ("new_year", _observed(1, 1), "false", "true"), ("christmas", _observed(12, 25), "false", "true"), ("mlk", _nth(1, 1, 3), "true", "true"),
                ("presidents", _nth(2, 1, 3), "true", "true"), ("memorial", "(make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INT)", "true", "true"),
                ("independence", _observed(7, 4), "true", "true"), ("labor", _nth(9, 1, 1), "true", "true"), ("thanksgiving", _nth(11, 4, 4), "true", "true"),
                ("thanksgiving_friday", f"({_nth(11, 4, 4)} + 1)", "true", "true"), ("christmas_eve", "make_date(y, 12, 24)", "true", "false")))
            + f" UNION ALL SELECT y, 'juneteenth', {_observed(6, 19)}, false, true, true FROM ys WHERE y >= 2022), ho AS (SELECT * FROM hd WHERE NOT early OR isodow(d) < 6)")
YEARS = "ys AS (SELECT DISTINCT y::INT AS y FROM (SELECT year(o_orderdate) AS y FROM orders UNION SELECT year(ts) FROM events UNION SELECT year(ts) + 1 FROM events))"


@query("holidays", with_(YEARS, HOLIDAYS) + "SELECT year, holiday, d::VARCHAR AS local_date, closed, early AS early_close, late AS late_open FROM ho")
def holidays(spark, sf):
    years = (daily(spark, sf).select(F.year("ts_event").alias("year"))
             .union(ticks(spark, sf).select(F.explode(F.array(F.year("ts_event"), F.year("ts_event") + 1)))).distinct())
    h = calendars.us_futures_holidays(years)
    return h.withColumn("local_date", F.col("local_date").cast("string"))


CALENDAR = ("ys AS (SELECT y::INT AS y FROM range(2023, 2026) t(y)), " + HOLIDAYS + ", hc AS (SELECT d::VARCHAR AS ld, bool_or(closed) AS closed, bool_or(early) AS early, bool_or(late) AS late FROM ho GROUP BY 1), "
            "mkts AS (SELECT * FROM (VALUES ('ES', 735), ('NQ', 735), ('GC', 735), ('ZC', 735), ('CL', 810)) t(symbol, ec))")


def _active(source: str, name: str) -> str:
    """Rows of `source` (symbol, ts) with the active flag."""
    return (f"{name}0 AS (SELECT s.*, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago' AS lt FROM {source} s), "
            f"{name}1 AS (SELECT s.*, isodow(lt) AS wd, hour(lt) * 60 + minute(lt) AS mi, strftime(lt, '%Y-%m-%d') AS ld, ec FROM {name}0 s JOIN mkts USING (symbol)), "
            f"{name} AS (SELECT s.* EXCLUDE (ld), ((wd = 7 AND mi >= 1020) OR wd < 5 OR (wd = 5 AND mi < 960)) AND NOT (mi >= 960 AND mi < 1020) AND NOT coalesce(closed, false) "
            "AND NOT coalesce(early AND NOT closed AND mi >= CASE WHEN s.symbol = 'CL' AND s.ld IN ('2024-11-29', '2025-11-28') THEN 825 ELSE ec END AND mi < CASE WHEN late THEN 1020 ELSE 1440 END, false) "
            f"AND NOT coalesce(NOT early AND late AND mi < 1020, false) AS active FROM {name}1 s LEFT JOIN hc ON hc.ld = s.ld)")


@query("active_minutes", with_(MINUTELY, CALENDAR, _active("b", "m")) + f"SELECT symbol, {STAMP}, active FROM m")
def active_minutes(spark, sf):
    from tidebar.sources.dimensions import session_dim
    bars = minutely(spark, sf)
    spans = bars.groupBy("symbol").agg(F.min("ts_event").alias("first_ts"), F.max("ts_event").alias("last_ts"))
    sessions_ = session_dim(spark)
    marked = calendars.mark_active(bars, sessions_, calendars.holiday_calendar(calendars._year_spans(spans), sessions_))
    return marked.select("symbol", stamp(), "active")


SPAN_AUDIT = ("sp AS (SELECT symbol, date_trunc('minute', min(ts)) AS f, date_trunc('minute', max(ts)) AS l FROM b GROUP BY symbol)",
              "ex AS (SELECT symbol, f + to_minutes(k) AS ts FROM sp, range(0, ((epoch_us(l) - epoch_us(f)) // 60000000) + 1) t(k))")


@query("session_span_audit", with_(MINUTELY, CALENDAR, *SPAN_AUDIT, _active("ex", "xa"), _active("b", "oa"),
                                   "e AS (SELECT symbol, count(*) AS n FROM xa WHERE active GROUP BY symbol)", "a AS (SELECT symbol, count(*) AS n, count(*) FILTER (NOT active) AS outs, count(*) FILTER (active) AS ins FROM oa GROUP BY symbol)")
       + f"SELECT symbol, a.n AS actual_unique_timestamps, e.n AS expected_session_minutes, e.n - a.ins AS missing_expected_minutes, outs AS outside_session_rows, {rs('100 * (1 - (e.n - a.ins) / e.n)')} AS coverage_pct, "
       "CASE WHEN outs > 0 AND symbol <> 'ZC' THEN 'FAIL' ELSE 'WARN' END AS severity FROM a JOIN e USING (symbol)")
def session_span_audit(spark, sf):
    s = calendars.session_audit(minutely(spark, sf), ("symbol",))["summary"]
    return s.select("symbol", "actual_unique_timestamps", "expected_session_minutes", "missing_expected_minutes", "outside_session_rows", r("coverage_pct").alias("coverage_pct"), "severity")


@query("missing_minutes", with_(MINUTELY, CALENDAR, *SPAN_AUDIT, _active("ex", "xa")) + f"SELECT symbol, {STAMP.replace('(ts,', '(xa.ts,')} FROM xa WHERE active AND NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = xa.symbol AND b.ts = xa.ts)")
def missing_minutes(spark, sf):
    m = calendars.session_audit(minutely(spark, sf), ("symbol",))["missing"]
    return m.select("symbol", stamp("missing_ts_event").alias("ts"))


@query("session_file_audit", with_(MINUTELY, CALENDAR, "ex AS (SELECT symbol, y AS file_year, make_timestamp(y, 1, 1, 0, 0, 0) + to_minutes(k) AS ts FROM (SELECT DISTINCT symbol, year(ts) AS y FROM b), range(0, 366 * 1440) t(k) WHERE year(make_timestamp(y, 1, 1, 0, 0, 0) + to_minutes(k)) = y)", _active("ex", "xa"),
                                   "sp AS (SELECT symbol, year(ts) AS file_year, min(ts) AS f, max(ts) AS l FROM b GROUP BY ALL)",
                                   "e AS (SELECT symbol, file_year, count(*) AS n, count(*) FILTER (ts BETWEEN f AND l) AS inr, min(ts) AS ef, max(ts) AS el, any_value(f) AS f, any_value(l) AS l FROM xa JOIN sp USING (symbol, file_year) WHERE active GROUP BY ALL)")
       + "SELECT symbol, file_year::INT AS file_year, n AS full_expected_minutes, inr AS expected_session_minutes, f > ef AS partial_start, l < el AS partial_end FROM e")
def session_file_audit(spark, sf):
    df = minutely(spark, sf).withColumn("file_year", F.year("ts_event"))
    s = calendars.session_audit(df)["summary"]
    return s.select("symbol", "file_year", "full_expected_minutes", "expected_session_minutes", "partial_start", "partial_end")
