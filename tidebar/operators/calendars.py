"""Exchange holidays, active minutes and session audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import count_if
from tidebar.plans.blocks import counted
from tidebar.plans.checkpoints import checkpointed
from tidebar.sources.dimensions import SESSIONS, early_close_dim, session_dim

LATE_OPEN = 17 * 60
JUNETEENTH_FROM = 2022
REQUIRED_SESSION_KEYS = ("timezone", "week_start_day", "week_start", "week_end_day", "week_end", "break_start", "break_end")


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday (anonymous algorithm), from the golden number and century terms."""
    golden, century, rest = year % 19, F.floor(year / 100), year % 100
    drift = F.floor((century - F.floor((century + 8) / 25) + 1) / 3)
    epact = (19 * golden + century - F.floor(century / 4) - drift + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * F.floor(rest / 4) - epact - rest % 4) % 7
    shift = F.floor((golden + 11 * epact + 22 * weekday) / 451)
    days = epact + weekday - 7 * shift + 114
    return F.make_date(year, F.floor(days / 31).cast("int"), (days % 31 + 1).cast("int"))


def nth_weekday(year: Column, month: int, day: str, n: int) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), day), 7 * (n - 1))


def last_weekday(year: Column, month: int, day: str) -> Column:
    return F.next_day(F.date_sub(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), 7), day)


def observed(year: Column, month: int, day: int) -> Column:
    """Saturday holidays are observed on Friday, Sunday ones on Monday."""
    d = F.make_date(year, F.lit(month), F.lit(day))
    return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)


def us_futures_holidays(years: DataFrame) -> DataFrame:
    """(year, holiday, local_date, closed, early_close, late_open) for a frame with a `year` column.

    `early_close` marks early-closing days; the minute comes from the market. A date both late opening and
    early closing reopens at the late open.
    """
    y = F.col("year")
    thanksgiving = nth_weekday(y, 11, "TH", 4)
    # Holiday name, date, closed, early close, late open.
    rules = [
        ("good_friday", F.date_sub(easter(y), 2), True, False, False),
        ("new_year", observed(y, 1, 1), False, False, True),
        ("christmas", observed(y, 12, 25), False, False, True),
        ("mlk", nth_weekday(y, 1, "MO", 3), False, True, True),
        ("presidents", nth_weekday(y, 2, "MO", 3), False, True, True),
        ("memorial", last_weekday(y, 5, "MO"), False, True, True),
        ("independence", observed(y, 7, 4), False, True, True),
        ("labor", nth_weekday(y, 9, "MO", 1), False, True, True),
        ("thanksgiving", thanksgiving, False, True, True),
        ("thanksgiving_friday", F.date_add(thanksgiving, 1), False, True, True),
        ("christmas_eve", F.make_date(y, F.lit(12), F.lit(24)), False, True, False),
        ("juneteenth", F.when(y >= JUNETEENTH_FROM, observed(y, 6, 19)), False, True, True),
    ]
    table = F.array(*[F.struct(F.lit(n).alias("holiday"), d.alias("local_date"), F.lit(c).alias("closed"), F.lit(e).alias("early_close"),
                               F.lit(o).alias("late_open")) for n, d, c, e, o in rules])
    return (years.select("year", F.inline(table)).filter(F.col("local_date").isNotNull())
            .filter(~F.col("early_close") | (F.weekday("local_date") < 5)))


def holiday_calendar(spans: DataFrame, sessions: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(symbol, local_date, closed, close_minute, reopen_minute) over each symbol's years.

    `spans` has symbol, first_year, last_year. Configured early closes in `overrides` replace generated ones.
    One row per date: a Christmas Eve that is also the observed Christmas keeps both rules.
    """
    spark = spans.sparkSession
    sessions = sessions if sessions is not None else session_dim(spark)
    overrides = overrides if overrides is not None else early_close_dim(spark)
    markets = spans.join(F.broadcast(sessions), "symbol")
    years = markets.filter("holidays").select("symbol", "early_close", F.explode(F.sequence("first_year", "last_year")).alias("year"))
    distinct_years = years.select("year").distinct()
    days = us_futures_holidays(distinct_years).groupBy("year", "local_date").agg(
        F.max("closed").alias("closed"), F.max("early_close").alias("_early"), F.max("late_open").alias("_late"))
    generated = years.join(F.broadcast(days), "year").select(
        "symbol", "local_date", "closed",
        F.when(F.col("_early") & ~F.col("closed"), F.col("early_close")).alias("_generated"),
        F.when(F.col("_late"), F.lit(LATE_OPEN)).alias("reopen_minute"))
    configured = (overrides.withColumn("local_date", F.to_date("local_date"))
                  .join(F.broadcast(spans.select("symbol")), "symbol", "left_semi"))
    return (generated.join(F.broadcast(configured), ["symbol", "local_date"], "full")
            .select("symbol", "local_date", F.coalesce("closed", F.lit(False)).alias("closed"),
                    F.coalesce("close_minute", "_generated").alias("close_minute"), "reopen_minute"))


def _local(sessions: DataFrame, ts: Column) -> Column:
    """The market's wall clock. Spark resolves a literal zone once but a zone column on every row, so zones become literals."""
    zones = [row[0] for row in sessions.select("timezone").distinct().collect()]  # zones of the configuration
    return F.coalesce(*[F.when(F.col("timezone") == z, F.from_utc_timestamp(ts, z)) for z in zones], F.from_utc_timestamp(ts, F.col("timezone")))


def _minute_of(ts: str) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def with_local_clock(df: DataFrame, sessions: DataFrame, ts: str = "ts_event") -> DataFrame:
    """Attach the market's session row plus ts_local, local_date, _minute and _weekday."""
    df = df.join(counted(sessions), "symbol").withColumn("ts_local", _local(sessions, F.col(ts)))
    return df.withColumns({"local_date": F.to_date("ts_local"), "_weekday": F.weekday("ts_local"), "_minute": _minute_of("ts_local")})


CLOCK_COLUMNS = ("_weekday", "_minute", "closed", "close_minute", "reopen_minute", "local_date", "timezone", "week_start_day",
                 "week_start", "week_end_day", "week_end", "break_start", "break_end", "holidays", "early_close", "approximate",
                 "approximate_reason", "min_coverage_pct")


def mark_active(df: DataFrame, sessions: DataFrame, holidays: DataFrame, ts: str = "ts_event") -> DataFrame:
    """Add `active`: the minute is inside the weekly session, outside the daily break and holiday closures.

    Holidays are a dozen rows per symbol and year; that table is joined by (symbol, local date).
    """
    df = with_local_clock(df, sessions, ts).join(holidays, ["symbol", "local_date"], "left")
    day, minute = F.col("_weekday"), F.col("_minute")
    wraps = F.col("week_start_day") > F.col("week_end_day")
    inner = F.when(wraps, (day > F.col("week_start_day")) | (day < F.col("week_end_day"))).otherwise(
        (day > F.col("week_start_day")) & (day < F.col("week_end_day")))
    week = (((day == F.col("week_start_day")) & (minute >= F.col("week_start"))) | inner
            | ((day == F.col("week_end_day")) & (minute < F.col("week_end"))))
    pause = (minute >= F.col("break_start")) & (minute < F.col("break_end"))
    early = F.col("close_minute").isNotNull()
    shut = F.coalesce(F.col("closed"), F.lit(False)) | (
        early & (minute >= F.col("close_minute")) & (minute < F.coalesce("reopen_minute", F.lit(24 * 60)))) | (
        ~early & F.col("reopen_minute").isNotNull() & (minute < F.col("reopen_minute")))
    return df.withColumn("active", week & ~pause & ~F.coalesce(shut, F.lit(False)))


def session_config_issues(sessions: dict[str, dict] | None = None) -> list[dict]:
    """Configuration problems per market; the configuration is a dozen small records, checked on the driver."""
    out = []
    for market, cfg in (SESSIONS if sessions is None else sessions).items():
        missing = sorted(k for k in REQUIRED_SESSION_KEYS if cfg.get(k) is None)
        if missing:
            out.append({"severity": "FAIL", "market": market, "check": "invalid_market_config", "detail": ",".join(missing)})
        elif not (cfg.get("holidays") or cfg.get("closed_dates") or cfg.get("early_closes") or cfg.get("allow_empty_holiday_calendar")):
            out.append({"severity": "FAIL", "market": market, "check": "incomplete_session_calendar", "detail": "no holiday rules"})
    return out


def _year_spans(spans: DataFrame) -> DataFrame:
    """Symbol years padded by one: a UTC year touches the neighbouring local years."""
    return spans.groupBy("symbol").agg((F.year(F.min("first_ts")) - 1).alias("first_year"), (F.year(F.max("last_ts")) + 1).alias("last_year"))


def expected_minutes(spans: DataFrame, sessions: DataFrame, holidays: DataFrame, keys: Sequence[str], step_minutes: int = 1) -> DataFrame:
    """Active minutes between `first_ts` and `last_ts` per key: first the days, then the minutes of each day,
    so a long span is spread over tasks before it grows."""
    day = F.explode(F.sequence(F.date_trunc("day", "first_ts"), F.date_trunc("day", "last_ts"), F.expr("INTERVAL 1 DAY"))).alias("_day")
    # The few days look tiny to adaptive coalescing, but each grows to 1,440 rows: keep the partition count.
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    days = spans.select(*keys, "first_ts", "last_ts", day).repartition(tasks, *keys, "_day")
    minute = F.explode(F.sequence(F.lit(0), F.lit(24 * 60 - step_minutes), F.lit(step_minutes)))
    minutes = days.withColumn("_m", minute).withColumn(
        "ts_event", F.timestamp_micros(F.unix_micros("_day") + F.col("_m").cast("long") * 60_000_000))
    inside = minutes.filter((F.col("ts_event") >= F.col("first_ts")) & (F.col("ts_event") <= F.col("last_ts"))).drop("_day", "_m")
    return mark_active(inside, sessions, holidays).filter("active").select(*keys, "ts_event", "ts_local")


#: Zones change their offset at multiples of this many UTC minutes.
OFFSET_MINUTES = 15


def expected_counts(spans: DataFrame, sessions: DataFrame, holidays: DataFrame, keys: Sequence[str], step_minutes: int = 1) -> DataFrame:
    """(keys, _day, n): active minutes of each UTC day between `first_ts` and `last_ts`, without listing minutes.

    A UTC day is one stretch of local time, or short stretches where the zone's offset changes that day. A stretch lies on one
    or two local dates. There the week's session is one interval or two, the daily break and the holiday closure one each,
    so the active minutes follow from lengths of their intersections.
    """
    per = list(dict.fromkeys([*keys, "symbol"]))
    minutes = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), n)
    day = F.explode(F.sequence(F.date_trunc("day", "first_ts"), F.date_trunc("day", "last_ts"), F.expr("INTERVAL 1 DAY"))).alias("_day")
    days = spans.filter("first_ts <= last_ts").select(*per, "first_ts", "last_ts", day).join(counted(sessions), "symbol")
    even = (F.unix_micros(_local(sessions, F.col("_day") + F.expr("INTERVAL 1439 MINUTES"))) - F.unix_micros(_local(sessions, F.col("_day")))) == 1439 * 60_000_000
    short = F.transform(F.sequence(F.lit(0), F.lit(1440 - OFFSET_MINUTES), F.lit(OFFSET_MINUTES)), lambda i: F.struct(i.alias("at"), F.lit(OFFSET_MINUTES).alias("size")))
    stretches = days.withColumn("_s", F.explode(F.when(even, F.array(F.struct(F.lit(0).alias("at"), F.lit(1440).alias("size")))).otherwise(short)))
    stretches = stretches.withColumn("_start", F.col("_day") + minutes(F.col("_s.at"))).withColumn("_local", _local(sessions, F.col("_start")))
    since = lambda ts: ((F.unix_micros(ts) - F.unix_micros("_start")) / 60_000_000).cast("long")
    at = _minute_of("_local").cast("long")
    low = at + F.greatest(F.lit(0), since("first_ts"))
    high = at + F.least(F.col("_s.size").cast("long"), since("last_ts") + 1)
    part = lambda d, u, v, origin: F.struct(d.alias("local_date"), u.alias("u"), v.alias("v"), origin.alias("origin"))
    date, first = F.to_date("_local"), at - F.col("_s.at")
    dated = stretches.select(*[F.col(c) for c in dict.fromkeys([*per, *sessions.columns])], "_day", F.inline(F.array(
        part(date, low, F.least(high, F.lit(1440)), first), part(F.date_add(date, 1), F.greatest(low - 1440, F.lit(0)), high - 1440, first - 1440))))
    dated = dated.filter("u < v").join(holidays, ["symbol", "local_date"], "left").withColumn("_weekday", F.weekday("local_date"))

    whole = (F.lit(0), F.lit(1440))
    wd, start, end = F.col("_weekday"), F.col("week_start_day"), F.col("week_end_day")
    inner = F.when(start > end, (wd > start) | (wd < end)).otherwise((wd > start) & (wd < end))
    nothing = F.lit(1440)
    opened = (F.when(inner, 0).when(wd == start, F.col("week_start")).otherwise(nothing), F.lit(1440))
    closing = (F.lit(0), F.when(wd == end, F.col("week_end")).otherwise(0))
    pause = (F.col("break_start"), F.col("break_end"))
    reopen = F.col("reopen_minute")
    shut = (F.when(F.coalesce("closed", F.lit(False)), 0).when(F.col("close_minute").isNotNull(), F.col("close_minute")).when(reopen.isNotNull(), 0).otherwise(nothing),
            F.when(F.coalesce("closed", F.lit(False)), 1440).when(F.col("close_minute").isNotNull(), F.coalesce(reopen, F.lit(1440))).otherwise(F.coalesce(reopen, F.lit(0))))

    def size(*sets: tuple[Column, Column]) -> Column:
        """Grid minutes in the intersection with the stretch."""
        u, v = F.greatest(F.col("u"), *[s[0] for s in sets]), F.least(F.col("v"), *[s[1] for s in sets])
        places = lambda x: F.floor((x - 1 - F.col("origin")) / step_minutes)
        return F.when(u < v, places(v) - places(u)).otherwise(F.lit(0))

    def active(*week: tuple[Column, Column]) -> Column:
        return size(*week) - size(*week, pause) - size(*week, shut) + size(*week, pause, shut)

    total = active(whole, opened) + active(whole, closing) - active(opened, closing)
    return dated.groupBy(*per, "_day").agg(F.sum(total).cast("long").alias("n"))


def session_audit(df: DataFrame, keys: Sequence[str] = ("symbol", "file_year"), sessions: DataFrame | None = None,
                  overrides: DataFrame | None = None, step_minutes: int = 1) -> dict[str, DataFrame]:
    """Tables `summary`, `missing` and `outside` of observed against expected session minutes.

    With file_year among the keys each yearly file is judged on its own (and for partial bounds against the
    whole UTC year); with the symbol alone, over its whole span. Expected minutes are counted per day; only days that lack
    some are listed minute by minute.
    """
    spark, keys = df.sparkSession, list(keys)
    sessions = sessions if sessions is not None else session_dim(spark)
    per_file = "file_year" in keys
    seen = df.filter(F.col("ts_event").isNotNull()).groupBy(*keys, "ts_event").agg(F.count(F.lit(1)).alias("_n"))
    floor = lambda c: F.date_trunc("minute", c)
    spans = seen.groupBy(*keys).agg(floor(F.min("ts_event")).alias("first_ts"), floor(F.max("ts_event")).alias("last_ts"))
    spans = checkpointed(spans)  # a row per key
    holidays = checkpointed(holiday_calendar(_year_spans(spans), sessions, overrides))  # a dozen rows per symbol and year
    marked = mark_active(seen, sessions, holidays)
    outside = marked.filter(~F.col("active")).select(*keys, "ts_event", "ts_local")
    on_grid = F.col("active") & (F.unix_micros("ts_event") % (step_minutes * 60_000_000) == 0)
    n = F.col("_n")
    observed = checkpointed(marked.groupBy(*keys, F.date_trunc("day", "ts_event").alias("_day")).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("unique"), F.sum(F.when(n > 1, n).otherwise(F.lit(0))).alias("copies"),
        count_if(on_grid).alias("hits"), count_if(~F.col("active")).alias("outs")))

    minute = F.expr("INTERVAL 1 MINUTE")
    bound = lambda add: F.to_timestamp(F.make_date(F.col("file_year") + add, F.lit(1), F.lit(1)))
    parts = [("within", F.col("first_ts"), F.col("last_ts"))]
    if per_file:
        parts += [("ahead", bound(0), F.col("first_ts") - minute), ("after", F.col("last_ts") + minute, bound(1) - minute)]
    cut = spans.select(*keys, F.inline(F.array(*[F.struct(F.lit(p).alias("_part"), a.alias("first_ts"), b.alias("last_ts")) for p, a, b in parts])))
    expected = checkpointed(expected_counts(cut, sessions, holidays, [*keys, "_part"], step_minutes))
    days = expected.filter("_part = 'within'").drop("_part").join(observed, [*keys, "_day"], "left").filter(F.col("n") > F.coalesce("hits", F.lit(0)))
    lacking = (days.select(*keys, "_day").join(spans, keys)
               .select(*keys, F.greatest("first_ts", "_day").alias("first_ts"), F.least(F.col("last_ts"), F.col("_day") + F.expr("INTERVAL 1439 MINUTES")).alias("last_ts")))
    missing = (expected_minutes(lacking, sessions, holidays, keys, step_minutes).join(seen, [*keys, "ts_event"], "left_anti")
               .select(*keys, F.col("ts_event").alias("missing_ts_event")))

    have = observed.groupBy(*keys).agg(F.sum("rows").alias("actual_rows"), F.sum("unique").alias("actual_unique_timestamps"), F.sum("copies").alias("duplicate_ts"),
                                       F.sum("hits").alias("_hits"), F.sum("outs").alias("outside_session_rows"))
    of = lambda p: F.coalesce(F.sum(F.when(F.col("_part") == p, F.col("n"))), F.lit(0))
    want = expected.groupBy(*keys).agg(F.sum("n").alias("full_expected_minutes"), of("within").alias("expected_session_minutes"),
                                       of("ahead").alias("_ahead"), of("after").alias("_after"))
    market = sessions.select("symbol", "approximate", "approximate_reason", "min_coverage_pct")
    out = have.join(want, keys, "left").join(spans, keys).join(counted(market), "symbol")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("full_expected_minutes", "expected_session_minutes", "_ahead", "_after")})
    planned = F.col("expected_session_minutes")
    out = out.withColumn("missing_expected_minutes", planned - F.col("_hits")).withColumns({
        "coverage_pct": F.when(planned > 0, 100.0 * (1.0 - F.col("missing_expected_minutes") / F.greatest(planned, F.lit(1)))).otherwise(F.lit(0.0)),
        "partial_start": (F.col("_ahead") > 0) & F.lit(per_file), "partial_end": (F.col("_after") > 0) & F.lit(per_file)})
    fail = (F.col("outside_session_rows") > 0) | (F.col("duplicate_ts") > 0)
    warn = F.col("missing_expected_minutes") > 0
    if per_file:
        warn = warn | (F.col("coverage_pct") < F.col("min_coverage_pct")) | F.col("partial_start") | F.col("partial_end")
    hard = fail if per_file else fail & ~F.col("approximate")
    severity = F.when(hard, "FAIL").when(fail | warn, "WARN").otherwise("PASS")
    summary = out.withColumn("severity", severity).drop("_hits", "_ahead", "_after", "min_coverage_pct")
    return {"summary": summary, "missing": missing, "outside": outside}


def audit_totals(tables: Sequence[DataFrame]) -> DataFrame:
    """FAIL and WARN counts over tables with a severity column; approximate markets never fail."""
    parts = [t.select(F.when((F.col("severity") == "FAIL") & (F.coalesce(F.col("approximate"), F.lit(False)) if "approximate" in t.columns
                                                             else F.lit(False)), "WARN").otherwise(F.col("severity")).alias("severity")) for t in tables]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
