"""Session filter and ids, resampling, gap filter and gap fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import Rolling, local_ts, minute_of_day
from tidebar.plans.blocks import Blocks, block_window, halo, measure, trim

TZ = "America/New_York"
SESSION_START = 18 * 60
SESSION_END = 16 * 60
BREAK = (17 * 60, 18 * 60)
BAR_COLUMNS = ("ts_event", "open", "high", "low", "close", "volume")
FREQ_SECONDS = {"1m": 60, "5m": 300, "1h": 3600}
# Fewest source bars a resampled bar needs.
MIN_TICKS = {"5m": 5, "1h": 45, "1d": 360}


def session_id(ts: Column, tz: str = TZ, start: int = SESSION_START) -> Column:
    """Trade date as text: the local clock is moved so that the session start becomes midnight."""
    shift = (24 * 60 - start) % (24 * 60)
    return F.date_format(local_ts(ts, tz) + F.make_dt_interval(mins=F.lit(shift)), "yyyy-MM-dd")


def add_session_id(df: DataFrame, tz: str = TZ, start: int = SESSION_START) -> DataFrame:
    return df.withColumn("session_id", session_id(F.col("ts_event"), tz, start))


def in_session(ts: Column, tz: str = TZ, start: int = SESSION_START, end: int = SESSION_END,
               pause: tuple[int, int] = BREAK) -> Column:
    minute = minute_of_day(local_ts(ts, tz))
    return ((minute >= start) | (minute < end)) & ~((minute >= pause[0]) & (minute < pause[1]))


def filter_session_hours(df: DataFrame, tz: str = TZ, start: int = SESSION_START, end: int = SESSION_END,
                         pause: tuple[int, int] = BREAK) -> DataFrame:
    return df.filter(in_session(F.col("ts_event"), tz, start, end, pause))


def time_bucket(ts: Column, freq: str, tz: str = TZ) -> Column:
    """Start of the bar: epoch arithmetic below a day (zones with whole-hour offsets), local midnight for 1d."""
    if freq == "1d":
        return F.to_utc_timestamp(F.date_trunc("day", local_ts(ts, tz)), tz)
    seconds = FREQ_SECONDS[freq]
    return F.timestamp_micros((F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * (seconds * 1_000_000)).cast("long"))


def resample(df: DataFrame, freq: str, tz: str = TZ, daily: str = "calendar", min_ticks: int | None = None,
             drop_incomplete: bool = True) -> DataFrame:
    """OHLCV bars per (symbol, session_id, bucket).

    ``daily="calendar"`` splits a session at local midnight, so 1d yields an evening and a daytime bar;
    ``daily="session"`` yields one bar per session. Bars with too few source rows are dropped.
    """
    ts = F.col("ts_event")
    bucket = (F.lit(None).cast("timestamp") if freq == "1d" and daily == "session" else time_bucket(ts, freq, tz))
    bars = (df.groupBy("symbol", "session_id", bucket.alias("_bucket"))
            .agg(F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"),
                 F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_first")))
    if daily == "session" and freq == "1d":
        bars = bars.withColumn("_bucket", time_bucket(F.col("_first"), freq, tz))
    least = min_ticks if min_ticks is not None else MIN_TICKS.get(freq)
    if least is not None and not (freq == "5m" and not drop_incomplete and min_ticks is None):
        bars = bars.filter(F.col("_n") == least if freq == "5m" else F.col("_n") >= least)
    return (bars.withColumnRenamed("_bucket", "ts_event")
            .select("symbol", "session_id", "ts_event", "open", "high", "low", "close", "volume"))


def add_daily_volatility(daily: DataFrame, backfill: bool = True) -> DataFrame:
    """Daily log return and its 5-row deviation, gaps filled forward, then backward, then with 0.

    Backward fill shows later data to the first rows; switch it off for causal use. Daily tables are short
    (some 250 rows per symbol and year), so plain symbol windows are enough.
    """
    order = Window.partitionBy("symbol").orderBy("session_id", "ts_event")
    roll = Rolling(order)
    out = daily.withColumn("daily_log_return", F.ln("close") - roll.lag(F.ln("close")))
    out = out.withColumn("daily_vol_5", roll.std(F.col("daily_log_return"), 5, 2))
    filled = F.last("daily_vol_5", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first("daily_vol_5", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return out.withColumn("daily_vol_5", F.coalesce(filled, later, F.lit(0.0)) if backfill
                          else F.coalesce(filled, F.lit(0.0)))


def resample_hourly_for_regime(df: DataFrame, tz: str = TZ) -> DataFrame:
    """Hourly bars from 5-minute bars; hours with fewer than 10 rows are dropped."""
    return resample(add_session_id(df, tz), "1h", tz, min_ticks=10)


def build_streams(raw: DataFrame, freqs=("1m", "1h", "1d"), tz: str = TZ, daily: str = "calendar",
                  max_gap_minutes: float = 30, blocks: Blocks | None = None) -> dict[str, DataFrame]:
    """Session-filtered bars per frequency; the base frequency is also gap-filtered."""
    bars = add_session_id(filter_session_hours(raw, tz), tz)
    streams = {f: resample(bars, f, tz, daily) for f in freqs}
    if "1d" in streams:
        streams["1d"] = add_daily_volatility(streams["1d"])
    base = primary_freq(streams)
    streams[base] = filter_gaps(streams[base], max_gap_minutes, blocks)
    return streams


def primary_freq(streams) -> str:
    for freq in ("1m", "5m"):
        if freq in streams:
            return freq
    raise ValueError(f"no executable bar stream: need 1m or 5m, have {sorted(streams)}")


def filter_gaps(df: DataFrame, max_gap_minutes: float = 30, blocks: Blocks | None = None) -> DataFrame:
    """Drop each bar that follows a gap longer than the limit; the first bar of a symbol stays."""
    framed = halo(df, blocks or measure(df), lookback=1)
    before = F.lag("ts_event").over(block_window())
    gap = (F.unix_micros("ts_event") - F.unix_micros(before)) / F.lit(60_000_000)
    framed = framed.withColumn("_gap", gap)
    return trim(framed.filter(F.col("_gap").isNull() | (F.col("_gap") <= max_gap_minutes))).drop("_gap")


def fill_intraday_gaps(df: DataFrame, bar_seconds: int = 300, max_gap_minutes: float = 60,
                       max_fill_minutes: float = 480, blocks: Blocks | None = None) -> DataFrame:
    """Repeat the previous bar at `bar_seconds` steps inside gaps of (max_gap, max_fill] minutes."""
    framed = halo(df, blocks or measure(df), lookahead=1)
    following = F.lead("ts_event").over(block_window())
    gap = (F.unix_micros(following) - F.unix_micros("ts_event")) / F.lit(1_000_000)
    missing = F.when((gap > max_gap_minutes * 60) & (gap <= max_fill_minutes * 60),
                     F.greatest(F.floor(gap / bar_seconds).cast("int") - 1, F.lit(0))).otherwise(F.lit(0))
    rows = trim(framed.withColumn("_missing", missing))
    step = F.explode(F.sequence(F.lit(0), F.col("_missing")))
    moved = F.timestamp_micros(F.unix_micros("ts_event") + F.col("_step").cast("long") * (bar_seconds * 1_000_000))
    return rows.withColumn("_step", step).withColumn("ts_event", moved).select(*df.columns)


def check_target_feasibility(df: DataFrame, horizon: int = 15, max_gap_minutes: float = 60,
                             closure_minutes: float = 240, blocks: Blocks | None = None) -> DataFrame:
    """Per symbol: enough rows, no null timestamps, and how many intraday gaps need filling."""
    framed = halo(df, blocks or measure(df.filter(F.col("ts_event").isNotNull())), lookback=1)
    before = F.lag("ts_event").over(block_window())
    minutes = (F.unix_micros("ts_event") - F.unix_micros(before)) / F.lit(60_000_000)
    gap = (F.col("_minutes") > max_gap_minutes) & (F.col("_minutes") <= closure_minutes)
    return (framed.withColumn("_minutes", minutes).filter("_own").groupBy("symbol")
            .agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("ts_event").isNull(), 1)).alias("null_ts"),
                 F.count(F.when(gap, 1)).alias("intraday_gaps"),
                 F.max(F.when(gap, F.col("_minutes"))).alias("max_gap_minutes"))
            .withColumn("passed", (F.col("rows") >= horizon + 10) & (F.col("null_ts") == 0)))
