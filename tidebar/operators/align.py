"""As-of joins, higher-timeframe alignment, cross-asset returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import div, ln
from tidebar.plans.blocks import Blocks, block_window, carry, halo, measure, trim

ALIGNED = ("open", "high", "low", "close", "volume", "session_id")


def asof_join(left: DataFrame, right: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",),
              ts: str = "ts_event", blocks: Blocks | None = None, direction: str = "backward", tie: str | None = None) -> DataFrame:
    """Each left row gets `columns` of the nearest right row at or before it (``forward``: strictly after).

    Both sides are stacked and the last right row is carried forward, so neither side is replicated and a
    long key is split in blocks. A forward join runs the same scan on negated time. Of right rows with equal
    times the one with the largest `tie` column wins.
    """
    keys, columns = list(keys), list(columns)
    payload = F.struct(*columns)
    shape = right.select(payload.alias("p")).schema["p"].dataType
    # At equal times a backward match must be scanned before the left row, a forward match after it.
    right_side = 0 if direction == "backward" else 2
    both = (left.select(*keys, ts, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"),
                        F.lit(None).cast("string").alias("_tie"), F.lit(None).cast(shape).alias("_right"))
            .unionByName(right.select(*keys, ts, F.lit(right_side).alias("_side"),
                                      (F.col(tie).cast("string") if tie else F.lit(None).cast("string")).alias("_tie"), payload.alias("_right")),
                         allowMissingColumns=True))
    if direction == "forward":
        both = both.withColumn(ts, F.timestamp_micros(-F.unix_micros(ts)))
    scanned = carry(both, blocks or measure(both, keys, ts), {"_found": ("last", F.col("_right"))},
                    order=(ts, "_side", "_tie"), ts=ts)
    return (scanned.filter(F.col("_side") == 1)
            .select(*[F.col("_left")[c].alias(c) for c in left.columns],
                    *[F.col("_found")[c].alias(c) for c in columns]))


def align_htf(base: DataFrame, hourly: DataFrame | None, daily: DataFrame | None) -> DataFrame:
    """Attach the last completed 1h bar (visible one hour after its start) and daily bar (one day after).

    Daily columns are then filled forward inside a session only.
    """
    out = base
    if hourly is not None:
        names = [c for c in hourly.columns if c in ALIGNED]
        shifted = hourly.select("symbol", (F.col("ts_event") + F.expr("INTERVAL 1 HOUR")).alias("ts_event"),
                                *[F.col(c).alias(f"1h_{c}") for c in names])
        out = asof_join(out, shifted, [f"1h_{c}" for c in names])
    if daily is not None:
        names = [c for c in daily.columns if c not in ("symbol", "ts_event")]
        renamed = [f"daily_{c}" if c in ALIGNED else c for c in names]
        shifted = daily.select("symbol", (F.col("ts_event") + F.expr("INTERVAL 24 HOURS")).alias("ts_event"),
                               *[F.col(c).alias(r) for c, r in zip(names, renamed)])
        # The evening bar of the next session starts at the same local midnight: the later session wins.
        out = asof_join(out, shifted, renamed, tie="daily_session_id" if "daily_session_id" in renamed else None)
        within = (Window.partitionBy("symbol", "session_id").orderBy("ts_event")
                  .rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumns({c: F.last(c, ignorenulls=True).over(within) for c in renamed if c.startswith("daily_")})
    return out


def attach_regime(base: DataFrame, probs: DataFrame, states: int = 4) -> DataFrame:
    """Hourly state probabilities on base bars, visible one hour after the bar starts; 0 before the first."""
    names = [f"hmm_regime_{i}" for i in range(states)]
    shifted = probs.select("symbol", (F.col("ts_event") + F.expr("INTERVAL 1 HOUR")).alias("ts_event"), *names)
    return asof_join(base, shifted, names).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names})


def attach_regime_by_position(base: DataFrame, probs: DataFrame, states: int = 4) -> DataFrame:
    """Match the k-th distinct hour of the base bars to the k-th probability row, aligned at the end.

    With fewer probability rows than hours the surplus hours take the last row.
    """
    names = [f"hmm_regime_{i}" for i in range(states)]
    hour = F.date_trunc("hour", "ts_event")
    per_symbol = Window.partitionBy("symbol")
    hours = (base.select("symbol", hour.alias("_hour")).distinct()
             .withColumn("_k", F.row_number().over(per_symbol.orderBy("_hour")))
             .withColumn("_hours", F.count(F.lit(1)).over(per_symbol)))
    rows = (probs.select("symbol", "ts_event", *names)
            .withColumn("_row", F.row_number().over(per_symbol.orderBy("ts_event")))
            .withColumn("_rows", F.count(F.lit(1)).over(per_symbol)).drop("ts_event"))
    sizes = rows.select("symbol", "_rows").distinct()
    lookup = (hours.join(sizes, "symbol")
              .withColumn("_row", F.when(F.col("_hours") <= F.col("_rows"), F.col("_rows") - F.col("_hours") + F.col("_k"))
                          .otherwise(F.least("_k", "_rows")))
              .join(rows.drop("_rows"), ["symbol", "_row"]).select("symbol", "_hour", *names))
    return base.withColumn("_hour", hour).join(lookup, ["symbol", "_hour"], "left").drop("_hour")


def cross_asset_returns(bars: DataFrame, symbols: Sequence[str], blocks: Blocks | None = None) -> DataFrame:
    """One row per timestamp with `{SYM}_ret_1` per secondary symbol (full outer over their timestamps)."""
    others = bars.filter(F.col("symbol").isin(list(symbols)))
    framed = halo(others, blocks or measure(others), lookback=1)
    ret = ln(div(F.col("close"), F.lag("close").over(block_window())))
    rows = trim(framed.withColumn("_ret", ret))
    return (rows.groupBy("ts_event").pivot("symbol", list(symbols)).agg(F.first("_ret"))
            .select("ts_event", *[F.col(s).alias(f"{s}_ret_1") for s in symbols]))


def join_cross_asset(df: DataFrame, bars: DataFrame, symbols: Sequence[str], blocks: Blocks | None = None) -> DataFrame:
    """Attach secondary returns by timestamp, then fill forward inside the session (or the symbol)."""
    names = [f"{s}_ret_1" for s in symbols]
    joined = df.join(cross_asset_returns(bars, symbols), "ts_event", "left")
    if "session_id" in df.columns:
        within = (Window.partitionBy("symbol", "session_id").orderBy("ts_event")
                  .rowsBetween(Window.unboundedPreceding, 0))
        return joined.withColumns({c: F.last(c, ignorenulls=True).over(within) for c in names})
    return carry(joined, blocks or measure(df), {c: ("last", F.col(c)) for c in names})
