"""Walk-forward splits, folds, windows and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.columns import count_if
from tidebar.plans.blocks import BROADCAST_ROWS, Blocks, measure, positions

BAR_MINUTES = 5
HORIZON_BARS = 15
LABELS = ("target_15m_ret", "target_15m_dir", "target_15m_trade_class")


def label_minutes(horizon: int = HORIZON_BARS, bar_minutes: int = BAR_MINUTES) -> int:
    return horizon * bar_minutes


def year_bounds(df: DataFrame) -> DataFrame:
    """First and last date per (symbol, file_year)."""
    year = F.col("file_year") if "file_year" in df.columns else F.year("ts_event").alias("file_year")
    return df.groupBy("symbol", year).agg(F.min(F.to_date("ts_event")).alias("first_date"),
                                          F.max(F.to_date("ts_event")).alias("last_date"))


def day_splits(bounds: DataFrame, train_days: int = 180, test_days: int = 30, step_days: int = 30) -> DataFrame:
    """Rolling train/test windows over the whole date range of `bounds` (file_year, first_date, last_date).

    Windows without a year's bars in train or test are left out before splits are numbered, so ids have no holes. When the range
    is shorter than one window there is a single split with open dates over all years.
    """
    window = train_days + test_days
    # One row per calendar year is left before the array is collected, so it stays tiny.
    per_year = bounds.groupBy("file_year").agg(F.min("first_date").alias("f"), F.max("last_date").alias("l"))
    span = per_year.agg(F.min("f").alias("_start"), F.max("l").alias("_end"),
                        F.array_sort(F.collect_list(F.struct("file_year", "f", "l"))).alias("_years"))
    span = span.withColumn("_days", F.datediff("_end", "_start") + 1)
    offsets = F.when(F.col("_days") >= window, F.sequence(F.lit(0), F.col("_days") - window, F.lit(step_days))).otherwise(
        F.array(F.lit(None).cast("int")))

    def busy(offset, start, end):
        return F.exists("_years", lambda y: (y["l"] >= F.date_add("_start", offset + start)) & (y["f"] < F.date_add("_start", offset + end)))

    offsets = F.filter(offsets, lambda o: o.isNull() | (busy(o, 0, train_days) & busy(o, train_days, window)))
    splits = (span.select("_start", "_years", F.posexplode(offsets).alias("split_id", "_offset"))
              .select("split_id", "_years", F.date_add("_start", F.col("_offset")).alias("train_start"),
                      F.date_add("_start", F.col("_offset") + train_days).alias("train_end"),
                      F.date_add("_start", F.col("_offset") + train_days).alias("test_start"),
                      F.date_add("_start", F.col("_offset") + window).alias("test_end")))

    def touching(start, end):
        hit = F.filter("_years", lambda y: (y["l"] >= F.col(start)) & (y["f"] < F.col(end)))
        return F.when(F.col(start).isNull(), F.col("_years.file_year")).otherwise(F.transform(hit, lambda y: y["file_year"]))

    return (splits.withColumns({"train_years": touching("train_start", "train_end"), "test_years": touching("test_start", "test_end")})
            .filter((F.size("train_years") > 0) & (F.size("test_years") > 0)).drop("_years"))


def year_splits(years: Sequence[int], train_years: int, test_years: int) -> list[tuple[list[int], list[int]]]:
    """Consecutive (train, test) year lists; with too few years one reduced split, or none."""
    years = sorted(set(years))
    size = train_years + test_years
    out = [(years[i:i + train_years], years[i + train_years:i + size]) for i in range(len(years) - size + 1)]
    if out or not years:
        return out
    if len(years) >= train_years:
        reduced = (years[:train_years], years[train_years:])
    else:
        reduced = (years[:-1], [])
    return [reduced] if reduced[0] and reduced[1] else []


def assign_splits(df: DataFrame, splits: DataFrame, max_lookup_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows repeated for every split they fall in, with `split_id` and `role` (train/test).

    Split borders are dates, so splits expand to a (date, split, role) lookup and the range join becomes an
    equi join; the lookup is broadcast only below a counted size.
    """
    whole = splits.filter(F.col("train_start").isNull()).select("split_id").first()
    if whole is not None:  # a range shorter than one window: the only split has open dates and all rows are in both roles
        return df.withColumn("split_id", F.lit(whole["split_id"])).withColumn("role", F.explode(F.array(F.lit("train"), F.lit("test"))))
    days = []
    for role in ("train", "test"):
        day = F.explode(F.sequence(F.col(f"{role}_start"), F.date_sub(f"{role}_end", 1)))
        days.append(splits.filter(F.col(f"{role}_start").isNotNull()).select("split_id", F.lit(role).alias("role"), day.alias("_day")))
    lookup = days[0].unionByName(days[1])
    if lookup.count() <= max_lookup_rows:
        lookup = F.broadcast(lookup)
    return df.withColumn("_day", F.to_date("ts_event")).join(lookup, "_day").drop("_day")


def purge_train_tail(df: DataFrame, splits: DataFrame, minutes: int = label_minutes()) -> DataFrame:
    """Train rows must end before test start minus the label horizon; test rows stay. One row per split joins."""
    starts = splits.select("split_id", F.col("test_start").cast("timestamp").alias("_test_start"))
    limit = F.timestamp_micros(F.unix_micros("_test_start") - F.lit(minutes * 60_000_000))
    return (df.join(starts, "split_id").filter((F.col("role") == "test") | F.col("_test_start").isNull() | (F.col("ts_event") < limit)).drop("_test_start"))


def slice_window(df: DataFrame, start: str, end: str, label: str = "", target: str | None = None,
                 minutes: int = label_minutes()) -> DataFrame:
    """Rows in [start, end); for the test window of a label target the end moves in by the label horizon.

    The predicate stays on the raw timestamp, so it reaches the scan.
    """
    if not start or not end:
        raise ValueError("both window boundaries are required")
    upper = F.lit(end).cast("timestamp")
    if label == "test" and target in LABELS:
        upper = F.timestamp_micros(F.unix_micros(upper) - F.lit(minutes * 60_000_000))
    return df.filter((F.col("ts_event") >= F.lit(start).cast("timestamp")) & (F.col("ts_event") < upper))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def train_window(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Discovery window: both bounds or none, and at least one row inside."""
    if bool(start) != bool(end):
        raise ValueError("discovery start and end must be given together")
    if not start:
        return df
    if start >= end:
        raise ValueError(f"discovery start {start} is not before end {end}")
    return require_rows(slice_window(df, start, end), f"train window [{start}, {end})")


def recent_days(df: DataFrame, days: int = 30, tz: str = "America/New_York") -> DataFrame:
    """Rows of the last local day and the `days` local days before it, per symbol."""
    local_midnight = F.date_sub(F.to_date(F.from_utc_timestamp(F.max("ts_event"), tz)), days).cast("timestamp")
    cutoff = df.groupBy("symbol").agg(F.to_utc_timestamp(local_midnight, tz).alias("_cutoff"))
    return df.join(cutoff, "symbol").filter(F.col("ts_event") >= F.col("_cutoff")).drop("_cutoff")


def exclude_warmup(df: DataFrame, burn_in: int, keys: Sequence[str] = ("symbol",), blocks: Blocks | None = None) -> DataFrame:
    """Drop the first burn_in + 1 rows of each key that has more than burn_in rows."""
    if burn_in <= 0:
        return df
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    numbered = positions(df, blocks or measure(df, keys)).join(sizes, keys)
    return numbered.filter((F.col("_rows") <= burn_in) | (F.col("_rn") > burn_in + 1)).drop("_rn", "_rows")


def bar_folds(df: DataFrame, min_train: int = 1000, min_test: int = 200, train_fraction: float = 0.6,
              test_fraction: float = 0.2) -> DataFrame:
    """Fold index ranges per symbol from its row count (0-based, end exclusive); symbols with fewer than two
    folds are returned with fold NULL."""
    n = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    train = F.greatest(F.lit(min_train), F.floor(F.col("rows") * train_fraction).cast("int"))
    test = F.greatest(F.lit(min_test), F.floor(F.col("rows") * test_fraction).cast("int"))
    n = n.withColumns({"_train": train, "_test": test})
    room = F.col("rows") - F.col("_train") - F.col("_test")
    count = F.when(room < 0, 0).otherwise(F.floor(room / F.col("_test")) + 1).cast("int")
    n = n.withColumn("folds", count)
    fold = F.explode_outer(F.when(F.col("folds") >= 2, F.sequence(F.lit(0), F.col("folds") - 1)))
    n = n.withColumn("fold", fold).withColumn("train_from", F.col("fold") * F.col("_test"))
    return n.select("symbol", "rows", "folds", "fold", "train_from", (F.col("train_from") + F.col("_train")).alias("train_to"),
                    (F.col("train_from") + F.col("_train")).alias("test_from"),
                    (F.col("train_from") + F.col("_train") + F.col("_test")).alias("test_to"))


def assign_folds(df: DataFrame, folds: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Rows repeated per fold with `split_id` and `role`. A symbol has at most a handful of folds."""
    rows = positions(df, blocks or measure(df)).withColumn("_at", F.col("_rn") - 1).drop("_rn")
    parts = folds.filter(F.col("fold").isNotNull()).select("symbol", F.col("fold").alias("split_id"), "train_from", "train_to", "test_to")
    return (rows.join(parts, "symbol").filter((F.col("_at") >= F.col("train_from")) & (F.col("_at") < F.col("test_to")))
            .withColumn("role", F.when(F.col("_at") < F.col("train_to"), "train").otherwise("test"))
            .drop("_at", "train_from", "train_to", "test_to"))


def check_train_test(df: DataFrame, features: Sequence[str], target: str, minutes: int = label_minutes(),
                     keys: Sequence[str] = ("symbol", "split_id")) -> DataFrame:
    """Per key: rows, overlap, duplicates, nulls and purge survivors of a frame with `role` train/test."""
    missing = [c for c in [*features, target] if c not in df.columns]
    if missing:
        raise ValueError(f"missing features {missing[:10]}")
    types = dict(df.dtypes)
    text = [c for c in features if types[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if text:
        raise ValueError(f"non-numeric features {text[:10]}")
    if not features:
        raise ValueError("no feature columns")
    keys = list(keys)
    test_start = df.filter(F.col("role") == "test").groupBy(*keys).agg(F.min("ts_event").alias("test_ts_min"), F.max("ts_event").alias("test_ts_max"))
    train, test = F.col("role") == "train", F.col("role") == "test"
    cutoff = F.timestamp_micros(F.unix_micros("test_ts_min") - F.lit(minutes * 60_000_000))
    per_ts = (df.join(test_start, keys, "left").groupBy(*keys, "role", "ts_event")
              .agg(F.count(F.lit(1)).alias("_n"), count_if(F.col(target).isNull()).alias("_null"), F.first("test_ts_min").alias("test_ts_min"),
                   F.first("test_ts_max").alias("test_ts_max")))
    rows = lambda pred: F.coalesce(F.sum(F.when(pred, F.col("_n"))), F.lit(0))
    out = per_ts.groupBy(*keys).agg(
        rows(train).alias("train_rows"), rows(test).alias("test_rows"), rows(F.col("_n") > 1).alias("duplicate_ts"),
        F.sum("_null").alias("null_target"), F.max(F.when(train, F.col("ts_event"))).alias("train_ts_max"),
        F.first("test_ts_min", ignorenulls=True).alias("test_ts_min"), F.first("test_ts_max", ignorenulls=True).alias("test_ts_max"),
        rows(train & (F.col("ts_event") <= cutoff)).alias("purged_train_rows"))
    ok = ((F.col("train_rows") > 0) & (F.col("test_rows") > 0) & (F.col("duplicate_ts") == 0) & (F.col("null_target") == 0)
          & (F.col("train_ts_max") < F.col("test_ts_min")) & (F.col("purged_train_rows") > 0))
    return out.withColumn("passed", F.coalesce(ok, F.lit(False)))


def check_predictions(result: DataFrame, test: DataFrame, keys: Sequence[str] = ("symbol", "split_id")) -> DataFrame:
    """Per key: null, non-finite or out-of-range probabilities, bad signals, duplicates, rows outside the test window."""
    keys = list(keys)
    p = F.col("prediction_prob")
    window = test.groupBy(*keys).agg(F.min("ts_event").alias("_lo"), F.max("ts_event").alias("_hi"))
    bad = p.isNull() | F.isnan(p.cast("double")) | ~p.between(0.0, 1.0)
    signal = ~F.col("raw_signal").isin(-1.0, 0.0, 1.0) if "raw_signal" in result.columns else F.lit(False)
    per_ts = (result.join(window, keys, "left").groupBy(*keys, "ts_event")
              .agg(F.count(F.lit(1)).alias("_n"), count_if(bad).alias("_bad"), count_if(signal).alias("_sig"),
                   count_if((F.col("ts_event") < F.col("_lo")) | (F.col("ts_event") > F.col("_hi"))).alias("_out")))
    out = per_ts.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.sum("_bad").alias("bad_prob"), F.sum("_sig").alias("bad_signal"),
                                    F.sum("_out").alias("outside_window"),
                                    F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(F.lit(0))).alias("duplicate_ts"))
    return out.withColumn("passed", F.col("bad_prob") + F.col("bad_signal") + F.col("outside_window") + F.col("duplicate_ts") == 0)


def prediction_frame(result: DataFrame, target: str | None = None) -> DataFrame:
    """Out-of-sample projection: ids, probability and whichever of signal, target and order columns exist."""
    for c in ("ts_event", "prediction_prob"):
        if c not in result.columns:
            raise ValueError(f"missing column {c}")
    wanted = ["symbol", "split_id", "ts_event", "prediction_prob", "raw_signal", target, "target_exec"]
    return result.select(*[c for c in dict.fromkeys(wanted) if c and c in result.columns])
