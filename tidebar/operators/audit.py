"""Raw bar audit: invariants, gaps, outliers, coverage. Input has symbol, file_year and the six bar columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import count_if, is_finite, off_tick
from tidebar.plans.blocks import BROADCAST_ROWS, Blocks, block_window, counted, halo, islands, measure, trim
from tidebar.plans.checkpoints import checkpointed
from tidebar.plans.order_stats import exact_quantiles
from tidebar.sources.dimensions import tick_dim

FILE_KEYS = ("symbol", "file_year")
PRICES = ("open", "high", "low", "close")
NUMBERS = (*PRICES, "volume")
STALE_RUN = 240
SAMPLE = 5
GAP_SAMPLE = 1000


def coerce_bars(df: DataFrame) -> DataFrame:
    """Timestamps and doubles, NULL where a value cannot be read."""
    types = dict(df.dtypes)
    ts = F.col("ts_event") if types["ts_event"] == "timestamp" else F.try_to_timestamp(F.col("ts_event").cast("string"))
    return df.withColumns({"ts_event": ts, **{c: F.col(c).try_cast("double") for c in NUMBERS}})


def valid_numbers() -> Column:
    out = is_finite(F.col(NUMBERS[0]))
    for c in NUMBERS[1:]:
        out = out & is_finite(F.col(c))
    return out


def with_ticks(df: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    ticks = ticks if ticks is not None else tick_dim(df.sparkSession)
    return df.join(counted(ticks), "symbol", "left")


def _any_off_tick() -> Column:
    out = off_tick(F.col(PRICES[0]), F.col("tick"))
    for c in PRICES[1:]:
        out = out | off_tick(F.col(c), F.col("tick"))
    return F.coalesce(out, F.lit(False))


def gap_rows(df: DataFrame, minutes: float = 1.0, blocks: Blocks | None = None) -> DataFrame:
    """Gaps above `minutes` between neighbouring timestamps that occur once."""
    keys = list(FILE_KEYS)
    single = df.groupBy(*keys, "ts_event").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    framed = halo(single, blocks or measure(single, keys), lookback=1)
    rows = trim(framed.withColumn("prev_ts", F.lag("ts_event").over(block_window(keys))))
    gap = (F.unix_micros("ts_event") - F.unix_micros("prev_ts")) / F.lit(60_000_000)
    return rows.withColumn("gap_minutes", gap).filter(F.col("gap_minutes") > minutes).select(*keys, "prev_ts", "ts_event", "gap_minutes")


def gap_sample(gaps: DataFrame, rows: int = GAP_SAMPLE) -> DataFrame:
    """The first `rows` gaps per file, a report limit."""
    first = Window.partitionBy(*FILE_KEYS).orderBy("ts_event")
    return gaps.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= rows).drop("_r")


def gap_summary(gaps: DataFrame, **limits) -> DataFrame:
    keys = list(FILE_KEYS)
    g = F.col("gap_minutes")
    counts = gaps.groupBy(*keys).agg(F.count(g).alias("gap_rows"), F.min(g).alias("min_gap_minutes"), F.max(g).alias("max_gap_minutes"))
    median = exact_quantiles(gaps, keys, "gap_minutes", (0.5,), **limits).select(*keys, F.col("quantiles")[0].alias("median_gap_minutes"))
    return counts.join(median, keys)


def mad_z(df: DataFrame, value: str, keys: Sequence[str] = FILE_KEYS, name: str = "mad_z", **limits) -> DataFrame:
    """0.6745 (x - median) / MAD per key; 0 where the MAD is 0."""
    keys = list(keys)
    center = exact_quantiles(df, keys, value, (0.5,), **limits).select(*keys, F.col("quantiles")[0].alias("_median"))
    dev = df.join(center, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_median")))
    mad = exact_quantiles(dev, keys, "_dev", (0.5,), **limits).select(*keys, F.col("quantiles")[0].alias("_mad"))
    z = F.when(F.col("_mad") > 0, 0.6745 * (F.col(value) - F.col("_median")) / F.greatest(F.col("_mad"), F.lit(1e-300))).otherwise(F.lit(0.0))
    return dev.join(mad, keys).withColumn(name, z).drop("_median", "_dev", "_mad")


def outliers(df: DataFrame, ret_limit: float = 0.02, range_limit: float = 0.02, z_limit: float = 25.0, blocks: Blocks | None = None, **limits) -> DataFrame:
    """One row per bar and outlier check: close return, high-low range, volume and price*volume MAD z."""
    keys = list(FILE_KEYS)
    framed = halo(df, blocks or measure(df, keys), lookback=1)
    before = F.lag("close").over(block_window(keys))
    rows = trim(framed.withColumn("_ret", F.try_divide(F.col("close"), before) - 1.0))
    rows = rows.withColumn("_dollar", F.col("close") * F.col("volume"))
    rows = mad_z(mad_z(rows, "volume", keys, "_vz", **limits), "_dollar", keys, "_dz", **limits)
    spread = F.try_divide(F.col("high") - F.col("low"), F.col("close"))
    tests = (("abs_close_return_gt_2pct", F.col("_ret"), ret_limit), ("hl_range_gt_2pct", spread, range_limit),
             ("volume_mad_z_gt_25", F.col("_vz"), z_limit), ("dollar_volume_mad_z_gt_25", F.col("_dz"), z_limit))
    found = F.array(*[F.struct(F.lit(n).alias("check"), x.alias("value"), (F.abs(x) > limit).alias("hit")) for n, x, limit in tests])
    return rows.select(*keys, "ts_event", *NUMBERS, F.explode(F.filter(found, lambda x: x["hit"])).alias("_o")).select(
        *keys, "ts_event", *NUMBERS, F.col("_o.check").alias("check"), F.col("_o.value").alias("value"))


def longest_run(df: DataFrame, flag: Column, keys: Sequence[str] = FILE_KEYS, name: str = "longest_run", blocks: Blocks | None = None) -> DataFrame:
    """Longest stretch of consecutive rows where `flag` is true, per key."""
    keys = list(keys)
    plan = blocks or measure(df, keys)
    framed = halo(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), plan, lookback=1)
    marked = trim(framed.withColumn("_start", F.col("_flag") != F.coalesce(F.lag("_flag").over(block_window(keys)), F.lit(False))))
    runs = islands(marked, plan, F.col("_start"), "_island").groupBy(*keys, "_island").agg(count_if(F.col("_flag")).alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias(name))


def stale_runs(df: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Longest run of unchanged closes per file, over timestamps that occur once."""
    keys = list(FILE_KEYS)
    copies = df.groupBy(*keys, "ts_event").agg(F.count(F.lit(1)).alias("_n"), F.first("close").alias("close")).filter("_n = 1")
    plan = blocks or measure(copies, keys)
    framed = halo(copies, plan, lookback=1)
    same = trim(framed.withColumn("_same", F.col("close") == F.lag("close").over(block_window(keys))))
    return longest_run(same, F.col("_same"), keys, "stale_close_run_max", plan)


def row_tests() -> list[tuple[str, str, Column]]:
    """(severity, check, violated) of every rule on a coerced row; those from USABLE_FROM on hold for usable rows only."""
    o, h, lo, c, v = (F.col(x) for x in NUMBERS)
    minute = F.unix_micros("ts_event") % 60_000_000
    return [("FAIL", "bad_ts_parse", F.col("ts_event").isNull()), ("FAIL", "non_finite_numeric", ~F.col("_numbers")),
            ("FAIL", "timestamp_not_minute_aligned", minute != 0), *[("FAIL", f"bad_numeric_{x}", F.col(x).isNull() | F.isnan(x)) for x in NUMBERS],
            ("WARN", "non_integer_volume", v % 1 != 0), ("FAIL", "timestamp_outside_file_year", F.year("ts_event") != F.col("file_year")),
            ("FAIL", "high_lt_low", h < lo), ("FAIL", "high_lt_open", h < o), ("FAIL", "high_lt_close", h < c), ("FAIL", "low_gt_open", lo > o),
            ("FAIL", "low_gt_close", lo > c), ("FAIL", "nonpositive_open", o <= 0), ("FAIL", "nonpositive_high", h <= 0), ("FAIL", "nonpositive_low", lo <= 0),
            ("FAIL", "nonpositive_close", c <= 0), ("FAIL", "negative_volume", v < 0), ("WARN", "price_off_tick_grid", _any_off_tick()),
            ("WARN", "zero_volume", v == 0), ("WARN", "zero_range", h == lo)]


#: Bits of the two rules that make a row unusable, and the first rule for usable rows.
UNUSABLE, USABLE_FROM = 0b11, 8
#: The day of rows without a timestamp, before all others.
NO_DAY = -1_000_000


def coerced_rows(df: DataFrame) -> DataFrame:
    """Coerced rows with `_day` and `_numbers`, whether all numbers are finite."""
    day = F.coalesce(F.floor(F.unix_micros("ts_event") / F.lit(86_400_000_000)).cast("int"), F.lit(NO_DAY))
    return coerce_bars(df).select(*FILE_KEYS, "ts_event", *NUMBERS, day.alias("_day"), valid_numbers().alias("_numbers"))


def _usable() -> Column:
    return F.col("ts_event").isNotNull() & F.col("_numbers")


def marked_rows(coerced: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Rows of `coerced_rows` with `_bits`, one bit per violated rule of `row_tests`."""
    rows = with_ticks(coerced, ticks)

    def bits(first: int, last: int) -> Column:
        out = F.lit(0).cast("long")
        for i, (_, _, violated) in list(enumerate(row_tests()))[first:last]:
            out = out + F.when(violated, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        return out

    marks = bits(0, USABLE_FROM) + F.when(_usable(), bits(USABLE_FROM, None)).otherwise(F.lit(0))
    return rows.select(*FILE_KEYS, "ts_event", *NUMBERS, "_day", marks.alias("_bits"))


def daily_counts(rows: DataFrame) -> DataFrame:
    """Rows and ranges of values per file, day and set of violated rules.

    One aggregate that tasks combine before the shuffle; the stored result has a few rows per file and day.
    """
    counts = rows.groupBy(*FILE_KEYS, "_day", "_bits").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("ts_event").alias("first_ts"), F.max("ts_event").alias("last_ts"),
        F.min("close").alias("close_min"), F.max("close").alias("close_max"), F.sum("volume").alias("volume_sum"))
    return checkpointed(counts.withColumn("_usable", F.col("_bits").bitwiseAND(F.lit(UNUSABLE)) == 0))


def _broken(bits: str = "_bits") -> Column:
    """Numbers of the rules whose bits are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(len(row_tests()) - 1)), lambda i: F.bit_get(F.col(bits), i) == 1)


def timeline(coerced: DataFrame) -> DataFrame:
    """One stored row per file and timestamp of usable rows: copies `_n`, a close, and a bar where there are several.

    Unusable rows become one group without a timestamp, dropped after the aggregate: a filter before it would be pushed
    down to the scan with every expression it stands on written out, in a method too long to be compiled.
    """
    stamped = coerced.withColumn("ts_event", F.when(_usable(), F.col("ts_event")))
    per_ts = stamped.groupBy(*FILE_KEYS, "ts_event").agg(F.count("ts_event").alias("_n"), *[F.first(c).alias(c) for c in NUMBERS]).filter("_n > 0")
    bar = F.when(F.col("_n") > 1, F.struct("ts_event", *NUMBERS)).alias("_bar")
    return checkpointed(per_ts.select(*FILE_KEYS, "ts_event", "_n", "close", bar))


def gaps_and_runs(single: DataFrame, minutes: float = 1.0, blocks: Blocks | None = None) -> tuple[DataFrame, DataFrame]:
    """Per file the number of gaps above `minutes` and the longest run of unchanged closes; and the first gaps of each block.

    One shuffle and sort by block serve both. A block hands on how many unchanged closes it ends with, so a run may
    pass through any number of blocks; a file's first SAMPLE gaps are among the first SAMPLE of its blocks.
    """
    keys = list(FILE_KEYS)
    order = block_window(keys)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    framed = halo(single.select(*keys, "ts_event", "close"), blocks or measure(single, keys), lookback=1)
    gap = (F.unix_micros("ts_event") - F.unix_micros("prev_ts")) / F.lit(60_000_000)
    own = (framed.withColumns({"prev_ts": F.lag("ts_event").over(order), "_same": F.coalesce(F.col("close") == F.lag("close").over(order), F.lit(False))})
           .filter("_own").withColumns({"gap_minutes": gap, "_place": F.row_number().over(order)}))
    own = own.withColumns({"_broken": F.max(F.when(~F.col("_same"), F.col("_place"))).over(so_far),
                           "_gaps": F.count(F.when(F.col("gap_minutes") > minutes, F.lit(1))).over(so_far)})
    head = F.when((F.col("gap_minutes") > minutes) & (F.col("_gaps") <= SAMPLE), F.struct("prev_ts", "ts_event", "gap_minutes"))
    broken = F.when(~F.col("_same"), F.col("_place"))
    per_block = checkpointed(own.groupBy(*keys, "_block").agg(
        F.max("_place").alias("_n"), F.min(broken).alias("_first"), F.max(broken).alias("_last"), F.max(F.col("_place") - F.col("_broken")).alias("_inside"),
        F.max("_gaps").alias("_gaps"), F.collect_list(head).alias("_heads")))  # SAMPLE at most
    first = per_block.select(*keys, F.inline("_heads"))
    upto = Window.partitionBy(*keys).orderBy("_block")
    ends = per_block.withColumn("_end", F.sum("_n").over(upto))
    ends = ends.withColumn("_held", F.col("_end") - F.coalesce(F.max(F.col("_end") - F.col("_n") + F.col("_last")).over(upto), F.lit(0)))
    led = F.coalesce(F.lag("_held").over(upto), F.lit(0)) + F.coalesce(F.col("_first") - 1, F.col("_n"))
    stats = (ends.withColumn("_run", F.greatest(F.coalesce("_inside", F.lit(0)), led)).groupBy(*keys)
             .agg(F.sum("_gaps").alias("gap_count_gt_1min"), F.max("_run").cast("long").alias("stale_close_run_max")))
    return stats, first


def _sampled(frame: DataFrame, by: list[str]) -> DataFrame:
    """The first SAMPLE bars per group as JSON."""
    first = Window.partitionBy(*by).orderBy(F.col("_bar.ts_event").asc_nulls_first())
    return (frame.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= SAMPLE).groupBy(*by)
            .agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_bar"))), lambda x: x["_bar"])).alias("sample")))


def of_days(coerced: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the files and days of `wanted`, which is small.

    Equality that knows NULL has no filter on keys inferred, which would be pushed down to the scan.
    """
    names = [*FILE_KEYS, "_day"]
    days = wanted.select(*[F.col(c).alias(f"_w{c}") for c in names])
    same = [F.col(c).eqNullSafe(F.col(f"_w{c}")) for c in names]
    return coerced.join(F.broadcast(days), same, "left_semi")


def _first_hits(coerced: DataFrame, daily: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """(keys, rule, bar) of rows that can be among a file's first SAMPLE of a rule: those up to the day that reaches SAMPLE.

    Before that day there are fewer, so a rule that most rows break contributes few rows more than one day's. Rows are found by
    their day and stored, so that rules are computed again for few, and then by day and set of rules; both are hash joins.
    """
    keys = list(FILE_KEYS)
    earlier = Window.partitionBy(*keys, "_rule").orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    open_ = (daily.select(*keys, "_day", "_bits", "_rows", F.explode(_broken()).alias("_rule"))
             .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).filter(F.col("_before") < SAMPLE))
    wanted = checkpointed(open_.groupBy(*keys, "_day", "_bits").agg(F.collect_list("_rule").alias("_rules")))  # at most all rules
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
        coerced = checkpointed(of_days(coerced, wanted))
    return marked_rows(coerced, ticks).join(wanted, [*keys, "_day", "_bits"]).select(*keys, F.explode("_rules").alias("_rule"), F.struct("ts_event", *NUMBERS).alias("_bar"))


def core_issues(df: DataFrame, ticks: DataFrame | None = None, stale_limit: int = STALE_RUN, blocks: Blocks | None = None) -> DataFrame:
    """Issue rows (symbol, file_year, severity, check, n, sample) of every violated rule.

    The input is read three times: for counts per file, day and set of violated rules, for the timeline of each file, and, up
    to the days that those counts name, for the samples. The sample holds the first five rows of a check.
    """
    keys, by = list(FILE_KEYS), [*FILE_KEYS, "severity", "check"]
    rows = coerced_rows(df)
    daily, times = daily_counts(marked_rows(rows, ticks)), timeline(rows)
    rules = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(n).alias("check")) for s, n, _ in row_tests()])
    totals = daily.select(*keys, "_rows", F.explode(_broken()).alias("_rule")).groupBy(*keys, "_rule").agg(F.sum("_rows").alias("n"))
    samples = _sampled(_first_hits(rows, daily, ticks), [*keys, "_rule"])
    row_issues = (totals.join(samples, [*keys, "_rule"]).withColumn("_named", F.get(rules, F.col("_rule")))
                  .select(*keys, "_named.severity", "_named.check", "n", "sample"))
    dup = times.filter("_n > 1").withColumns({"severity": F.lit("FAIL"), "check": F.lit("duplicate_ts")})
    dup_issues = dup.groupBy(*by).agg(F.sum("_n").alias("n")).join(_sampled(dup, by), by)
    stats, gaps = gaps_and_runs(times.filter("_n = 1"), blocks=blocks)
    gaps = gaps.withColumns({"severity": F.lit("WARN"), "check": F.lit("timestamp_gaps_gt_1min"), "_bar": F.struct("ts_event", "prev_ts", "gap_minutes")})
    counts = F.array(F.struct(F.lit("timestamp_gaps_gt_1min").alias("check"), F.col("gap_count_gt_1min").alias("n"), F.lit(1).alias("_least")),
                     F.struct(F.lit("stale_close_run").alias("check"), F.col("stale_close_run_max").alias("n"), F.lit(stale_limit).alias("_least")))
    line_issues = (stats.select(*keys, F.lit("WARN").alias("severity"), F.inline(counts)).filter(F.col("n") >= F.col("_least")).drop("_least")
                   .join(_sampled(gaps, by), by, "left").withColumn("sample", F.coalesce("sample", F.lit(""))))
    files = daily.groupBy(*keys).agg(F.sum("_rows").alias("n"), F.max("_usable").alias("_some"))
    empty = files.filter(~F.col("_some")).select(*keys, F.lit("FAIL").alias("severity"), F.lit("no_valid_numeric_rows").alias("check"), "n", F.lit("").alias("sample"))
    return row_issues.unionByName(dup_issues).unionByName(line_issues).unionByName(empty)


def file_order_issues(df: DataFrame, slice_rows: int = 100_000) -> DataFrame:
    """Files whose rows are not in time order; needs `row_index`, the row's position in its file.

    Positions are cut in slices: rows are compared inside a slice, then each slice's first row with the last row
    of the slice before it.
    """
    keys = list(FILE_KEYS)
    placed = df.filter(F.col("ts_event").isNotNull()).select(
        *keys, "ts_event", "row_index", F.floor(F.col("row_index") / slice_rows).alias("_slice"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("row_index")
    local = placed.withColumn("_back", F.col("ts_event") < F.lag("ts_event").over(inside))
    slices = local.groupBy(*keys, "_slice").agg(count_if(F.col("_back")).alias("_n"), F.min_by("ts_event", "row_index").alias("_first"),
                                                F.max_by("ts_event", "row_index").alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    edges = slices.withColumn("_edge", F.col("_first") < F.lag("_last").over(across))
    return (edges.groupBy(*keys).agg((F.sum("_n") + count_if(F.col("_edge"))).alias("n")).filter("n > 0")
            .select(*keys, F.lit("FAIL").alias("severity"), F.lit("not_sorted").alias("check"), "n"))


def schema_issues(columns: Sequence[str]) -> list[tuple[str, str, str]]:
    """(severity, check, detail) for missing and extra columns of a file schema."""
    required = ("ts_event", *NUMBERS)
    missing, extra = [c for c in required if c not in columns], [c for c in columns if c not in (*required, *FILE_KEYS)]
    return [*([("FAIL", "schema_missing_cols", ",".join(missing))] if missing else []),
            *([("WARN", "schema_extra_cols", ",".join(extra))] if extra else [])]


def core_summary(df: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """One row per file: rows, bounds, duplicates, gaps, zero volume and range, stale run, price and volume range."""
    keys, at = list(FILE_KEYS), {n: i for i, (_, n, _) in enumerate(row_tests())}
    rows = coerced_rows(df)
    daily, times = daily_counts(marked_rows(rows)), timeline(rows)
    good = lambda c: F.when(F.col("_usable"), F.col(c))
    broken = lambda rule: F.sum(F.when(F.bit_get("_bits", F.lit(at[rule])) == 1, F.col("_rows")).otherwise(F.lit(0))).alias(rule)
    total = daily.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"), F.min(good("first_ts")).alias("first_ts"), F.max(good("last_ts")).alias("last_ts"), broken("zero_volume"),
        broken("zero_range"), F.min(good("close_min")).alias("close_min"), F.max(good("close_max")).alias("close_max"),
        F.sum(good("volume_sum")).alias("volume_sum")).filter("first_ts IS NOT NULL")
    copies = times.groupBy(*keys).agg(F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(F.lit(0))).alias("duplicate_ts"))
    stats, _ = gaps_and_runs(times.filter("_n = 1"), blocks=blocks)
    return (total.join(copies, keys).join(stats, keys, "left")
            .withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gap_count_gt_1min", "stale_close_run_max")}))


def cross_year(summary: DataFrame) -> DataFrame:
    """Overlap or gap between consecutive yearly files; a symbol has one row per year."""
    order = Window.partitionBy("symbol").orderBy("file_year")
    pairs = summary.select("symbol", F.col("file_year").alias("year_a"), F.lead("file_year").over(order).alias("year_b"),
                           F.col("first_ts").alias("first_ts_a"), F.col("last_ts").alias("last_ts_a"),
                           F.lead("first_ts").over(order).alias("first_ts_b"), F.lead("last_ts").over(order).alias("last_ts_b"))
    overlap = F.col("first_ts_b") <= F.col("last_ts_a")
    gap = (F.unix_micros("first_ts_b") - F.unix_micros("last_ts_a")) / F.lit(60_000_000)
    return pairs.filter(F.col("year_b").isNotNull()).withColumns({
        "severity": F.when(overlap, "FAIL").otherwise("INFO"), "check": F.when(overlap, "cross_year_overlap").otherwise("cross_year_gap"),
        "gap_minutes": gap})


def missing_years(df: DataFrame) -> DataFrame:
    """Years without data between a symbol's first and last year.

    A file covers every year between its own first and last timestamp.
    """
    per_file = df.groupBy(*FILE_KEYS).agg(F.year(F.min("ts_event")).alias("a"), F.year(F.max("ts_event")).alias("b")).filter("a is not null")
    covered = per_file.select("symbol", F.explode(F.sequence("a", "b")).alias("year")).distinct()
    span = covered.groupBy("symbol").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return (span.select("symbol", F.explode(F.sequence("a", "b")).alias("year")).join(covered, ["symbol", "year"], "left_anti")
            .select("symbol", "year", F.lit("FAIL").alias("severity"), F.lit("missing_observed_data_year").alias("check")))


def clean_rows(df: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Rows that pass every hard rule; all copies of a repeated timestamp are dropped.

    Copies are counted by (symbol, file_year, timestamp), a group no larger than its copies; one bar column
    set per timestamp survives, so no join is needed.
    """
    keys = list(FILE_KEYS)
    rows = coerce_bars(df).filter(F.col("ts_event").isNotNull() & valid_numbers())
    one = (rows.groupBy(*keys, "ts_event").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in NUMBERS]).filter("_n = 1").drop("_n"))
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    sane = (h >= lo) & (h >= o) & (h >= c) & (lo <= o) & (lo <= c) & (o > 0) & (h > 0) & (lo > 0) & (c > 0) & (v >= 0)
    return with_ticks(one.filter(sane), ticks).filter(~_any_off_tick()).drop("tick")


def validated_manifest(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows before and after cleaning per file."""
    keys = list(FILE_KEYS)
    before = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_rows"))
    after = cleaned.groupBy(*keys).agg(F.count(F.lit(1)).alias("validated_rows"), F.min("ts_event").alias("first_ts"), F.max("ts_event").alias("last_ts"))
    return (before.join(after, keys, "left").withColumn("validated_rows", F.coalesce("validated_rows", F.lit(0).cast("long")))
            .withColumn("removed_rows", F.col("raw_rows") - F.col("validated_rows")))


def symbol_sanity(df: DataFrame, bands: DataFrame, min_rows: int = 1000, window_days: int = 210) -> DataFrame:
    """Enough rows, no null timestamps, a plausible mean close and a long enough span, per symbol."""
    s = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("ts_event").isNull()).alias("null_ts"),
                                 F.avg("close").alias("close_mean"), F.min("ts_event").alias("ts_min"), F.max("ts_event").alias("ts_max"))
    s = s.join(counted(bands), "symbol", "left").withColumns({
        "_lo": F.coalesce("band_low", F.lit(0.0)), "_hi": F.coalesce("band_high", F.lit(1e9))})
    ok = (F.col("rows") >= min_rows) & (F.col("null_ts") == 0) & F.col("close_mean").between(F.col("_lo"), F.col("_hi")) & F.col("ts_min").isNotNull()
    days = F.floor((F.unix_micros("ts_max") - F.unix_micros("ts_min")) / F.lit(86_400_000_000))
    return s.withColumns({"passed": F.coalesce(ok, F.lit(False)), "short_span": days < 2 * window_days}).drop("_lo", "_hi", "band_low", "band_high")
