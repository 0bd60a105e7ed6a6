"""Bar views over the given tables, in Spark and in SQL.

events are ticks (one price per event); lineitem rows are ticks of one series per supplier, so the number of
series grows with the data; orders give several years of daily bars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.columns import half_away
from tidebar.plans.blocks import Blocks

# Which market a group of source rows stands for.
EVENT_MARKETS = {"click": "ES", "error": "CL", "purchase": "ZC", "signup": "NQ", "view": "GC"}
ORDER_MARKETS = {"1": "ES", "2": "CL", "3": "ZB", "4": "NQ", "5": "GC"}
FLAG_MARKETS = {"A": "ES", "N": "CL", "R": "ZC"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _market(c: Column, names: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for key, market in names.items():
        out = out.when(c == key, market)
    return out


def _market_sql(c: str, names: dict[str, str]) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in names.items()) + " END)"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: symbol, ts_event, price."""
    e = table(spark, sf_dir, "events")
    return e.select(_market(F.col("event_type"), EVENT_MARKETS).alias("symbol"), F.col("ts").cast("timestamp").alias("ts_event"),
                    F.col("value").alias("price"))


def _ohlcv(rows: DataFrame, bucket: Column, order: str, volume: Column) -> DataFrame:
    return (rows.groupBy("symbol", bucket.alias("ts"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", order).alias("close"), volume.alias("volume")).withColumnRenamed("ts", "ts_event"))


def event_bars(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    return _ohlcv(ticks(spark, sf_dir), F.date_trunc(unit, "ts_event"), "ts_event", F.count(F.lit(1)))


def hourly(spark, sf_dir):
    return event_bars(spark, sf_dir, "hour")


def minutely(spark, sf_dir):
    return event_bars(spark, sf_dir, "minute")


def _day_order(day: Column, price: Column) -> Column:
    """Day, then price in cents, packed in one integer; a plain integer order keeps hash aggregation."""
    return F.unix_date(day) * F.lit(2 ** 32).cast("long") + half_away(price * 100).cast("long")


def weekly_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One narrow row per lineitem: symbol, day, price, l_quantity."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("price"), "l_quantity")


def _weekly_bars(ticks: DataFrame) -> DataFrame:
    ticks = ticks.withColumn("o", _day_order(F.col("day"), F.col("price")))
    return _ohlcv(ticks, F.date_trunc("week", F.col("day").cast("timestamp")), "o", F.sum("l_quantity"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per supplier; inside a day ticks are ordered by price."""
    return _weekly_bars(weekly_ticks(spark, sf_dir))


def planned_weekly(spark: SparkSession, sf_dir: str, measure: Callable[..., Blocks]) -> tuple[DataFrame, Blocks]:
    """Weekly bars and their block plan.

    A series has no more bars than ticks, so while all have few ticks nothing else is measured, and the ticks are dealt by series:
    that one shuffle of narrow rows serves the bars and all windows over them.
    """
    ticks = weekly_ticks(spark, sf_dir)
    plan = measure(ticks.select("symbol", F.col("day").cast("timestamp").alias("ts_event")))
    if plan.cells is None:
        return _weekly_bars(ticks.repartition("symbol")), plan
    bars = _weekly_bars(ticks)
    return bars, measure(bars)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars over several years, one series per order priority."""
    o = table(spark, sf_dir, "orders").select(
        _market(F.substring("o_orderpriority", 1, 1), ORDER_MARKETS).alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("t"),
        F.col("o_totalprice").alias("price"), "o_orderkey")
    return _ohlcv(o, F.date_trunc("day", "t"), "o_orderkey", F.count(F.lit(1)))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchecked bars with repeated timestamps, crossed prices and off-tick values: one per lineitem row."""
    li = table(spark, sf_dir, "lineitem")
    p, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    ts = F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp"))
                            + (F.col("l_partkey") % 1440) * F.lit(60_000_000).cast("long"))
    return li.select(_market(F.col("l_returnflag"), FLAG_MARKETS).alias("symbol"), F.year(ts).alias("file_year"), ts.alias("ts_event"),
                     p.alias("open"), (p * (1.0 + d)).alias("high"), (p * (1.0 - t)).alias("low"), (p * (1.0 + d - t)).alias("close"),
                     (F.col("l_quantity") - 1.0).alias("volume"))


def _tick_sql(unit: str) -> str:
    return (f"SELECT {_market_sql('event_type', EVENT_MARKETS)} AS symbol, date_trunc('{unit}', ts) AS ts, arg_min(value, ts) AS open, "
            "max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::BIGINT AS volume FROM events GROUP BY 1, 2")


HOURLY = f"b AS (SELECT symbol, ts::TIMESTAMP AS ts, open, high, low, close, volume FROM ({_tick_sql('hour')}))"
MINUTELY = f"b AS (SELECT symbol, ts::TIMESTAMP AS ts, open, high, low, close, volume FROM ({_tick_sql('minute')}))"
WEEKLY = ("b AS (SELECT 'S' || l_suppkey AS symbol, date_trunc('week', l_shipdate)::TIMESTAMP AS ts, "
          "arg_min(l_extendedprice, (l_shipdate, l_extendedprice)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, "
          "arg_max(l_extendedprice, (l_shipdate, l_extendedprice)) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)")
DAILY = (f"b AS (SELECT {_market_sql('o_orderpriority[1]', ORDER_MARKETS)} AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, "
         "arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, "
         "arg_max(o_totalprice, o_orderkey) AS close, count(*)::BIGINT AS volume FROM orders GROUP BY 1, 2)")
RAW = (f"raw AS (SELECT symbol, year(ts) AS file_year, ts, p AS open, p * (1.0::DOUBLE + d) AS high, p * (1.0::DOUBLE - t) AS low, "
       f"p * (1.0::DOUBLE + d - t) AS close, q - 1.0::DOUBLE AS volume FROM (SELECT {_market_sql('l_returnflag', FLAG_MARKETS)} AS symbol, "
       "l_shipdate + to_minutes((l_partkey % 1440)::BIGINT) AS ts, l_extendedprice AS p, l_discount AS d, l_tax AS t, l_quantity AS q FROM lineitem))")
NY = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
SESSION = f"strftime({NY} + INTERVAL 6 HOUR, '%Y-%m-%d')"
