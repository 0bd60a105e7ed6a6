"""Roll calendar and ratio-adjusted continuous prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.align import asof_join
from tidebar.plans.blocks import Blocks, block_window, carry, halo, measure, trim
from tidebar.sources.dimensions import MONTH_CODES, roll_rule_dim

PRICES = ("open", "high", "low", "close")


def third_friday(year: Column, month: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), "FR"), 14)


def contract_name(symbol: Column, year: Column, month: Column) -> Column:
    letter = F.substring(F.lit(MONTH_CODES), month, F.lit(1))
    return F.concat(symbol, letter, F.lpad((year % 100).cast("string"), 2, "0"))


def roll_dates(spans: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Rolls inside each symbol's (start, end) timestamps; symbols without a rule have none."""
    rules = rules if rules is not None else roll_rule_dim(spans.sparkSession)
    years = spans.withColumn("_year", F.explode(F.sequence(F.year("start"), F.year("end"))))
    ahead = F.col("month") + F.col("step")
    back_month = F.when(ahead > 12, ahead - 12).otherwise(ahead)
    back_year = F.when(ahead > 12, F.col("_year") + 1).otherwise(F.col("_year"))
    roll = F.date_sub(third_friday(F.col("_year"), F.col("month")), F.col("days_before")).cast("timestamp")
    return (years.join(F.broadcast(rules), "symbol").withColumn("roll_date", roll)
            .filter((F.col("roll_date") >= F.col("start")) & (F.col("roll_date") <= F.col("end")))
            .select("symbol", "roll_date",
                    contract_name(F.col("symbol"), F.col("_year"), F.col("month")).alias("front_contract"),
                    contract_name(F.col("symbol"), back_year, back_month).alias("back_contract"),
                    F.col("month").alias("front_month"), back_month.alias("back_month")))


def roll_factors(bars: DataFrame, rolls: DataFrame) -> DataFrame:
    """Per roll: close of the last bar at or before it over close of the first bar after it, and the running
    product. Rolls number at most twelve per symbol and year, so the product is a plain symbol window."""
    closes = bars.select("symbol", "ts_event", "close")
    at = rolls.withColumnRenamed("roll_date", "ts_event")
    front = asof_join(at, closes.withColumnRenamed("close", "_front"), ["_front"])
    both = asof_join(front, closes.withColumnRenamed("close", "_back"), ["_back"], direction="forward")
    ratio = F.when(F.col("_front").isNotNull() & F.col("_back").isNotNull(),
                   F.col("_front") / F.greatest(F.col("_back"), F.lit(1e-12))).otherwise(F.lit(1.0))
    order = Window.partitionBy("symbol").orderBy("ts_event")
    running = F.exp(F.sum(F.ln("adjustment_factor")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    good = (F.col("adjustment_factor") > 0) & (F.col("adjustment_factor") < float("inf"))
    checked = both.withColumn("adjustment_factor", ratio).withColumn("adjustment_factor", F.when(
        good, F.col("adjustment_factor")).otherwise(
            F.raise_error(F.concat(F.lit("invalid roll ratio for "), F.col("symbol"))).cast("double")))
    return (checked.withColumn("cumulative_factor", running)
            .withColumn("outside_safe_range", ~F.col("cumulative_factor").between(0.01, 50.0))
            .select("symbol", F.col("ts_event").alias("roll_date"), "front_contract", "back_contract",
                    "adjustment_factor", "cumulative_factor", "outside_safe_range"))


def continuous_series(bars: DataFrame, multiplier: Column | float = 1.0, rolls: DataFrame | None = None,
                      match: str = "asof", blocks: Blocks | None = None) -> DataFrame:
    """Scale prices from each roll onward by the running roll factor.

    ``match="asof"`` applies a roll from the first bar at or after it; ``match="exact"`` needs a bar at the
    roll timestamp itself and otherwise waits for the next roll that has one.
    """
    if rolls is None:
        spans = bars.groupBy("symbol").agg(F.min("ts_event").alias("start"), F.max("ts_event").alias("end"))
        rolls = roll_dates(spans)
    plan = blocks or measure(bars)
    factors = roll_factors(bars, rolls)
    steps = factors.select("symbol", F.col("roll_date").alias("ts_event"), "cumulative_factor",
                           F.col("back_contract").alias("contract_month"))
    if match == "exact":
        joined = bars.join(steps, ["symbol", "ts_event"], "left")
        filled = carry(joined, plan, {"cumulative_factor": ("last", F.col("cumulative_factor")),
                                      "contract_month": ("last", F.col("contract_month"))})
    else:
        filled = asof_join(bars, steps, ["cumulative_factor", "contract_month"])
    first = factors.groupBy("symbol").agg(F.min_by("front_contract", "roll_date").alias("_first_contract"))
    out = (filled.join(first, "symbol", "left")
           .withColumns({"cumulative_factor": F.coalesce("cumulative_factor", F.lit(1.0)),
                         "contract_month": F.coalesce("contract_month", "_first_contract", "symbol"),
                         "contract_multiplier": multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))})
           .drop("_first_contract"))
    out = _previous_factor(out, plan)
    scaled = {f"continuous_{c}": F.col(c) * F.col("cumulative_factor") for c in PRICES}
    return out.withColumns({**scaled, "continuous_price": F.col("close") * F.col("cumulative_factor")})


def _previous_factor(df: DataFrame, plan: Blocks) -> DataFrame:
    before = F.lag("cumulative_factor").over(block_window())
    ratio = F.col("cumulative_factor") / F.coalesce(before, F.lit(1.0))
    return trim(halo(df, plan, lookback=1).withColumn("adjustment_factor", ratio))


def apply_splice(bars: DataFrame, adjustments: DataFrame, blocks: Blocks | None = None) -> DataFrame:
    """Exact-time join of cumulative factors, filled forward, times close."""
    joined = bars.join(adjustments.select("symbol", "ts_event", "cumulative_factor"), ["symbol", "ts_event"], "left")
    filled = carry(joined, blocks or measure(bars), {"cumulative_factor": ("last", F.col("cumulative_factor"))})
    filled = filled.withColumn("cumulative_factor", F.coalesce("cumulative_factor", F.lit(1.0)))
    return filled.withColumn("continuous_price", F.col("close") * F.col("cumulative_factor"))


def ratio_adjusted(front: DataFrame, back: DataFrame, roll_date) -> DataFrame:
    """One roll: front bars up to it times the ratio, then back bars unchanged.

    The ratio uses both closes at the roll; without both, each side's last bar before it; else 1.
    """
    roll = F.lit(roll_date).cast("timestamp")

    def closes(df, side):
        here = F.col("ts_event") == roll
        until = F.col("ts_event") <= roll
        return df.filter(until).groupBy("symbol").agg(
            F.max(F.when(here, F.col("close"))).alias(f"_{side}_at"),
            F.max_by("close", "ts_event").alias(f"_{side}_last"))

    ends = closes(front, "front").join(closes(back, "back"), "symbol", "full")
    exact = F.col("_front_at").isNotNull() & F.col("_back_at").isNotNull()
    top = F.when(exact, F.col("_front_at")).otherwise(F.col("_front_last"))
    bottom = F.when(exact, F.col("_back_at")).otherwise(F.col("_back_last"))
    ratio = ends.select("symbol", F.coalesce(top / F.greatest(bottom, F.lit(1e-12)), F.lit(1.0)).alias("adjustment_factor"))
    before = front.filter(F.col("ts_event") <= roll).join(ratio, "symbol", "left")
    after = back.filter(F.col("ts_event") > roll).withColumn("adjustment_factor", F.lit(1.0))
    both = before.unionByName(after, allowMissingColumns=True)
    scaled = {f"continuous_{c}": F.col(c) * F.col("adjustment_factor") for c in PRICES if c != "close"}
    return both.withColumns({**scaled, "continuous_price": F.col("close") * F.col("adjustment_factor")})
