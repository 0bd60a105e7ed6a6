"""Exact quantiles and average ranks for groups of any size.

Spark's exact ``percentile`` and a rank window both hold one group in one task. That is used only while a
counted group is at most `group_rows`; larger groups are cut by value into buckets: equal values collapse
into one counted row, approximate quantiles give bucket edges, counts per bucket are prefix-summed, and only
rows inside a bucket are sorted together. The edges only balance the load; results are exact. Null keys are a
group of their own at every size; null values have no quantiles and rank first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.plans.blocks import largest_group
from tidebar.plans.checkpoints import checkpointed

GROUP_ROWS = 1_000_000


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which nulls are equal; the columns of `on` come from the left."""
    named = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_on_{c}`")) for c in on]
    return left.join(named, same, how).drop(*[f"_on_{c}" for c in on])


def _bucket_count(largest: int, group_rows: int, least: int) -> int:
    return max(least, 2 * -(-largest // group_rows))


def _bucketed(df: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """(keys, value, _n, _bucket): one row per distinct value; bucket order follows value order."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = checkpointed(counted.groupBy(*keys).agg(F.percentile_approx(value, cuts, max(1000, 4 * buckets)).alias("_edges")))
    return (_join(counted, edges, keys)
            .withColumn("_bucket", F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(0)))
            .withColumn("_bucket", F.greatest("_bucket", F.lit(0))).drop("_edges"))


def _bucket_offsets(bucketed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _bucket, _offset, _size, _total) with _offset rows in the buckets before."""
    order = Window.partitionBy(*keys).orderBy("_bucket")
    return (bucketed.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
            .withColumn("_offset", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
            .withColumn("_total", F.sum("_size").over(Window.partitionBy(*keys))))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                    name: str = "quantiles", group_rows: int = GROUP_ROWS, buckets: int = 256) -> DataFrame:
    """Linear-interpolated quantiles of the non-null values: (keys, `name` array<double> in the order of qs)."""
    keys = list(keys)
    df = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    largest = largest_group(df, keys)
    if largest <= group_rows:
        return df.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(q) for q in qs])).alias(name))

    bucketed = _bucketed(df, keys, "_v", _bucket_count(largest, group_rows, buckets))
    offsets = _bucket_offsets(bucketed, keys)
    wanted = (offsets
              .withColumn("_q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"))
                                                    for i, q in enumerate(qs)])))
              .withColumn("_at", (F.col("_total") - 1) * F.col("_q.q"))
              .withColumn("_rank", F.explode(F.array_distinct(F.array(
                  F.floor("_at").cast("long"), F.ceil("_at").cast("long")))))
              .filter((F.col("_rank") >= F.col("_offset")) & (F.col("_rank") < F.col("_offset") + F.col("_size")))
              .select(*keys, "_bucket", "_offset", "_rank", F.col("_q.i").alias("_i"), "_at"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (_join(bucketed, wanted.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi")
              .withColumn("_to", F.sum("_n").over(inside)))
    picked = (_join(ranked, wanted, [*keys, "_bucket"])
              .filter((F.col("_rank") - F.col("_offset") < F.col("_to"))
                      & (F.col("_rank") - F.col("_offset") >= F.col("_to") - F.col("_n"))))
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    return (picked.groupBy(*keys, "_i").agg((low + (high - low) * (F.first("_at") - F.floor(F.first("_at"))))
                                            .alias("_value"))
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_value"))).alias("_all"))
            .select(*keys, F.col("_all._value").alias(name)))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str,
                  group_rows: int = GROUP_ROWS, buckets: int = 256) -> DataFrame:
    """Add the 1-based rank of `value` inside each key; ties share their mean rank."""
    keys = list(keys)
    largest = largest_group(df, keys)
    if largest <= group_rows:
        ties = Window.partitionBy(*keys, value)
        return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(value))
                             + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))
    bucketed = _bucketed(df, keys, value, _bucket_count(largest, group_rows, buckets))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = (_join(bucketed, _bucket_offsets(bucketed, keys), [*keys, "_bucket"])
             .withColumn(name, F.col("_offset") + F.sum("_n").over(inside) - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0))
             .select(*keys, value, name))
    return _join(df, ranks, [*keys, value])
