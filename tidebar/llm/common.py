"""Shared folder, written tables, streamed groups, block pairs and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; only a local session without it gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder, which cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """The table, to be broadcast where it counts no more than `rows` (narrow) rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Rows of each key in turn, from batches sorted by `keys`. Holds one batch and one group at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].to_numpy() for k in keys]
        change = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1), table.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(start, end - start))
            last = key
    if held:
        yield pa.concat_tables(held)


def block_pairs(members: DataFrame, key: str, node: str, counts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Deal every group over tasks (key, _lo, _hi) so that any two members meet in exactly one task.

    A group of n rows is cut by hash in ceil(n / block_rows) blocks and each pair of blocks is a task, so no task
    holds more than about two blocks however large the group is. `_block` is the row's own block. Members of one
    block meet where _lo = _hi. `counts` has (key, _n).
    """
    blocks = F.ceil(F.col("_n") / F.lit(block_rows)).cast("int")
    return (members.join(counts.filter(F.col("_n") > block_rows).select(key, blocks.alias("_blocks")), key, "left")
            .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
            .withColumn("_block", F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumns({"_lo": F.least("_block", "_other"), "_hi": F.greatest("_block", "_other")})
            .drop("_other", "_blocks")
            .repartition(key, "_lo", "_hi").sortWithinPartitions(key, "_lo", "_hi"))


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of n items reaches over the links left-right: hook to the least neighbour and jump."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: hang neighbours on the least neighbour of their node. Sums and joins, no gathered lists."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(
            least.select("a", F.col("_m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, label): the least node that each node of the links (a, b) reaches.

    Alternates large-star and small-star steps, which need a number of rounds logarithmic in the longest chain. Each round
    is a written table. A node with very many links is split by Spark's skew join, as nothing is gathered per node.
    """
    state = written(edges.filter(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long")), name)
    before = None
    for _ in range(max_rounds):
        state = written(_star(_star(state, True), False), name)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = tuple(now)
    raise RuntimeError("components did not settle")


def unlike(column: str, taken: Sequence[str]) -> str:
    """A name that the table does not have yet."""
    while column in taken:
        column = f"_{column}"
    return column


def keep_rows(df: DataFrame, decide: Callable[[DataFrame], DataFrame], verdict: str) -> DataFrame:
    """Rows for which `decide`, given columns `row` (all of df) and `text`, adds a true `verdict`; columns as in df."""
    names = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    return decide(packed).filter(F.col(verdict)).select("row.*")
