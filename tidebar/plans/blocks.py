"""Splitting long series over tasks.

``Window.partitionBy("symbol")`` puts a whole symbol in one task, and one symbol may hold a third of all
rows. Here a symbol longer than ``block_rows`` is cut into consecutive blocks:

* ``halo`` copies to each block the rows its bounded windows look back (or ahead) to, so every window over
  ``(symbol, _block)`` sees what it would see over the whole symbol;
* ``carry`` computes running sums, maxima and last values inside each block and adds what the earlier
  blocks hand over, which takes one summary row per block. Running money is added in fixed nested groups of rows
  (``grouped``), so its last bits do not depend on the blocks.

``measure`` counts the rows per symbol first (one column-pruned aggregate), and per time cell only if a symbol
is long. While every symbol is short it returns an empty plan: no join, no copies, one shuffle. Halo copies amount to lookback / block_rows of a long symbol.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.plans.checkpoints import checkpointed

KEYS = ("symbol",)
TS = "ts_event"
BLOCK_ROWS = 100_000
CELL_SECONDS = 86_400
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Blocks:
    """Block plan of one table; `cells` is None when every key fits in one block."""

    keys: tuple[str, ...]
    block_rows: int
    cell_seconds: int
    cells: DataFrame | None = None
    n_cells: int = 0
    max_cell: int = 0


def whole(keys: Sequence[str] = KEYS) -> Blocks:
    """Plan for keys known to be short, such as daily rows: one block each, nothing measured."""
    return Blocks(tuple(keys), BLOCK_ROWS, CELL_SECONDS)


def _cell(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the longest key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def measure(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS,
            block_rows: int = BLOCK_ROWS, cell_seconds: int = CELL_SECONDS) -> Blocks:
    """Count rows per key; plan blocks for the keys above `block_rows` from their rows per time cell.

    Tasks combine the counts per key before the shuffle; cells are counted only where a key is long, as short keys may have
    as many cells as rows.
    """
    keys = tuple(keys)
    if largest_group(df, keys) <= block_rows:
        return Blocks(keys, block_rows, cell_seconds)
    per_cell = df.groupBy(*keys, _cell(ts, cell_seconds).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    long_keys = (per_cell.groupBy(*keys)
                 .agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_cells"), F.max("_n").alias("_max"))
                 .filter(F.col("_rows") > block_rows))
    found = long_keys.agg(F.sum("_cells").alias("cells"), F.max("_max").alias("largest")).first()
    before = Window.partitionBy(*keys).orderBy("_cell")
    cells = per_cell.join(long_keys.select(*keys), list(keys), "left_semi").withColumn(
        "_before", F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    return Blocks(keys, block_rows, cell_seconds, cells, int(found["cells"]), int(found["largest"]))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only below a counted size; above it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def counted(dim: DataFrame) -> DataFrame:
    """A dimension to join with: broadcast where it counts few rows, which keeps Spark from sending the other side."""
    return _small(dim, dim.count())


def halo(df: DataFrame, blocks: Blocks, lookback: int = 0, lookahead: int = 0, ts: str = TS) -> DataFrame:
    """Add `_block` and `_own`; rows that a later (earlier) block looks back (ahead) to are repeated there."""
    if blocks.cells is None:
        return df.withColumns({"_block": F.lit(0).cast("long"), "_own": F.lit(True)})
    size, before, n = F.lit(blocks.block_rows), F.col("_before"), F.col("_n")
    own = F.floor(before / size).cast("long")
    last = F.floor((before + n + F.lit(lookback - 1)) / size).cast("long") if lookback else own
    first = (F.greatest(F.lit(0), F.floor((before - F.lit(lookahead + blocks.max_cell)) / size)).cast("long")
             if lookahead else own)
    plan = blocks.cells.select(*blocks.keys, "_cell", own.alias("_own_block"), first.alias("_first"),
                               F.greatest(last, own).alias("_last"))
    return (df.withColumn("_cell", _cell(ts, blocks.cell_seconds))
            .join(_small(plan, blocks.n_cells), [*blocks.keys, "_cell"], "left")
            .withColumn("_own_block", F.coalesce("_own_block", F.lit(0).cast("long")))
            .withColumn("_block", F.explode(F.sequence(F.coalesce("_first", "_own_block"),
                                                       F.coalesce("_last", "_own_block"))))
            .withColumn("_own", F.col("_block") == F.col("_own_block"))
            .drop("_cell", "_own_block", "_first", "_last"))


def block_window(keys: Sequence[str] = KEYS, *order: str, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(*keys, "_block").orderBy(*(order or (ts,)))


def trim(df: DataFrame) -> DataFrame:
    """Drop halo copies and the block columns."""
    return df.filter("_own").drop("_block", "_own")


def coarse(x: Column) -> Column:
    """The part of a double that is a multiple of 2^-20. Sums of such parts below 2^33 have no rounding, those of the rest next to none."""
    return F.rint(x * F.lit(2.0 ** 20)) / F.lit(2.0 ** 20)


def exact_sum(x: Column) -> Column:
    """The sum of doubles with one rounding, in any order of rows."""
    return F.sum(coarse(x)) + F.sum(x - coarse(x))


FAN, CHUNK_LEVELS, KEY_LEVELS = 16, 3, 4


def _nested(levels: int) -> list[Column]:
    """Numbers of the groups of FAN ** levels, ..., FAN rows that the row at `_at` lies in."""
    return [F.floor(F.col("_at") / F.lit(FAN ** k)).alias(f"_g{k}") for k in range(levels, 0, -1)]


def _ends(k: int) -> Column:
    """True on the last row of a group of FAN ** k rows."""
    return F.col("_at") % FAN ** k == FAN ** k - 1


def _within(part: Sequence[str], levels: int, k: int) -> WindowSpec:
    """From the start of a group of FAN ** k rows to the row; k above `levels`: of the whole part. All levels share one sort."""
    groups = [f"_g{i}" for i in range(levels, 0, -1)]
    inside = groups[:max(levels - k + 1, 0)]
    return Window.partitionBy(*part, *inside).orderBy(*groups[len(inside):], "_at").rowsBetween(Window.unboundedPreceding, 0)


def _group_sums(df: DataFrame, part: Sequence[str], names: Sequence[str], levels: int) -> DataFrame:
    """`_s{k}{name}`: the sum of the group of FAN ** k rows so far, complete on its last row; each adds up to FAN sums of the level below."""
    df = df.select("*", *_nested(levels)).withColumns({f"_s0{n}": F.col(n) for n in names})
    for k in range(1, levels + 1):
        df = df.withColumns({f"_s{k}{n}": F.sum(F.when(_ends(k - 1), F.col(f"_s{k - 1}{n}"))).over(_within(part, levels, k)) for n in names})
    return df


def _from_groups(df: DataFrame, part: Sequence[str], names: Sequence[str], levels: int) -> DataFrame:
    """Replaces `names` by their running sums: `_open{name}`, the complete groups of FAN ** levels rows, then ever smaller ones, then rows."""
    for k in range(levels - 1, -1, -1):
        whole_group, first = _ends(k + 1), F.col("_at") % FAN ** (k + 1) == FAN ** k - 1
        step = {}
        for n in names:
            s, opened = F.col(f"_s{k}{n}"), F.col(f"_open{n}")
            run = F.sum(F.when(_ends(k), F.when(first, opened + F.coalesce(s, F.lit(0.0))).otherwise(s))).over(_within(part, levels, k + 1))
            step[f"_open{n}"] = F.when(whole_group, opened).otherwise(F.coalesce(run, opened))
        df = df.withColumns(step)
    scratch = [f"_s{k}{n}" for k in range(levels + 1) for n in names]
    return df.withColumns({n: F.col(f"_open{n}") for n in names}).drop(*scratch, *[f"_open{n}" for n in names], *[f"_g{k}" for k in range(1, levels + 1)])


def _from_start(df: DataFrame, keys: Sequence[str], names: Sequence[str], levels: int) -> DataFrame:
    """Running sums of `names` along `_at`, all rows of a key in one partition."""
    df, top = _group_sums(df, keys, names, levels), _within(keys, levels, levels + 1)
    total = {f"_open{n}": F.coalesce(F.sum(F.when(_ends(levels), F.col(f"_s{levels}{n}"))).over(top), F.lit(0.0)) for n in names}
    return _from_groups(df.withColumns(total), keys, names, levels)


def _grouped(df: DataFrame, blocks: Blocks, names: Sequence[str]) -> DataFrame:
    """Running sums of `names` along `_at`, a key's row number from 0, added in nested groups of FAN rows, whatever the blocks.

    Of long keys, chunks of FAN ** CHUNK_LEVELS rows are dealt over the tasks and one row of each, its sum, goes on to the levels above.
    """
    keys = list(blocks.keys)
    if blocks.cells is None:
        return _from_start(df, keys, names, KEY_LEVELS)
    part = [*keys, "_chunk"]
    chunked = _group_sums(df.withColumn("_chunk", F.floor(F.col("_at") / F.lit(FAN ** CHUNK_LEVELS))), part, names, CHUNK_LEVELS)
    sums = chunked.filter(_ends(CHUNK_LEVELS)).select(*keys, F.col("_chunk").alias("_at"), *[F.col(f"_s{CHUNK_LEVELS}{n}").alias(n) for n in names])
    # stored, a few thousandths of the rows, so that the plan holds the steps before only once
    sums = checkpointed(_from_start(sums, keys, names, KEY_LEVELS))
    # the sum up to a chunk's end is that of its last row, and opens the next chunk
    handed = (sums.select(*keys, F.col("_at").alias("_chunk"), F.lit(True).alias("_last"), *[F.col(n).alias(f"_open{n}") for n in names])
              .union(sums.select(*keys, F.col("_at") + 1, F.lit(False), *names)))
    chunked = chunked.withColumn("_last", _ends(CHUNK_LEVELS)).join(handed, [*part, "_last"], "left").drop("_last")
    chunked = chunked.withColumns({f"_open{n}": F.coalesce(f"_open{n}", F.lit(0.0)) for n in names})
    return _from_groups(chunked, part, names, CHUNK_LEVELS).drop("_chunk")


_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}


def _merge(how: str, earlier: Column, local: Column) -> Column:
    if how == "sum":
        return F.when(local.isNotNull() | earlier.isNotNull(),
                      F.coalesce(earlier, F.lit(0)) + F.coalesce(local, F.lit(0)))
    if how == "last":
        return F.coalesce(local, earlier)
    return (F.greatest if how == "max" else F.least)(local, earlier)


def carry(df: DataFrame, blocks: Blocks, specs: dict[str, tuple[str, Column]], order: Sequence[str] = (),
          ts: str = TS) -> DataFrame:
    """Running aggregates from the start of each key.

    `specs` maps an output name to (how, expression); how is ``sum``, ``exact`` (the sum of doubles with one
    rounding, whatever the blocks), ``grouped`` (the sum of doubles added in fixed groups of rows, whatever the blocks),
    ``max``, ``min`` or ``last`` (last non-null value, i.e. forward fill).
    """
    grouped = {name: x for name, (how, x) in specs.items() if how == "grouped"}
    if grouped:
        rest = {name: spec for name, spec in specs.items() if name not in grouped}
        rows = df.withColumns(grouped)
        if "_at" in df.columns:
            return _grouped(carry(rows, blocks, rest, order, ts) if rest else rows, blocks, list(grouped))
        rows = carry(rows, blocks, rest | {"_at": ("sum", F.lit(1).cast("long"))}, order, ts)
        return _grouped(rows.withColumn("_at", F.col("_at") - 1), blocks, list(grouped)).drop("_at")
    exact = {name: x for name, (how, x) in specs.items() if how == "exact"}
    if exact:
        parts = {name: spec for name, spec in specs.items() if name not in exact}
        for name, x in exact.items():
            parts |= {name: ("sum", coarse(x)), f"_fine{name}": ("sum", x - coarse(x))}
        return (carry(df, blocks, parts, order, ts).withColumns({name: F.col(name) + F.col(f"_fine{name}") for name in exact})
                .drop(*[f"_fine{name}" for name in exact]))
    order = tuple(order) or (ts,)
    if blocks.cells is None:
        running = (Window.partitionBy(*blocks.keys).orderBy(*order)
                   .rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumns({name: _LOCAL[how](x).over(running) for name, (how, x) in specs.items()})

    keys = list(blocks.keys)
    inputs = {f"_in_{name}": x for name, (how, x) in specs.items()}
    framed = halo(df, blocks, ts=ts).drop("_own").withColumns(inputs)
    local = block_window(keys, *order).rowsBetween(Window.unboundedPreceding, 0)

    totals = []
    for name, (how, _) in specs.items():
        x = F.col(f"_in_{name}")
        if how == "last":
            at = F.when(x.isNotNull(), F.struct(*[F.col(c) for c in order]))
            totals.append(F.max_by(x, at).alias(f"_tot_{name}"))
        else:
            totals.append(_LOCAL[how](x).alias(f"_tot_{name}"))
    earlier = (Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    handed = (framed.groupBy(*keys, "_block").agg(*totals)
              .select(*keys, "_block", *[_LOCAL[how](F.col(f"_tot_{name}")).over(earlier).alias(f"_pre_{name}")
                                         for name, (how, _) in specs.items()]))
    running = {f"_loc_{name}": _LOCAL[how](F.col(f"_in_{name}")).over(local) for name, (how, _) in specs.items()}
    merged = {name: _merge(how, F.col(f"_pre_{name}"), F.col(f"_loc_{name}")) for name, (how, _) in specs.items()}
    scratch = [f"{p}{name}" for name in specs for p in ("_in_", "_loc_", "_pre_")]
    return (framed.withColumns(running).join(handed, [*keys, "_block"], "left")
            .withColumns(merged).drop("_block", *scratch))


def islands(df: DataFrame, blocks: Blocks, changed: Column, name: str, ts: str = TS) -> DataFrame:
    """Number the runs between rows where `changed` is true (a running count of changes)."""
    return carry(df, blocks, {name: ("sum", F.when(changed, 1).otherwise(0).cast("long"))}, ts=ts)


def placed(df: DataFrame, blocks: Blocks) -> DataFrame:
    """With `_at`, a key's row number from 0, which ``grouped`` sums go by: cheaper on the first rows than after many steps."""
    return positions(df, blocks, "_at").withColumn("_at", F.col("_at") - 1)


def positions(df: DataFrame, blocks: Blocks, name: str = "_rn", ts: str = TS) -> DataFrame:
    """1-based row number inside each key."""
    return carry(df, blocks, {name: ("sum", F.lit(1).cast("long"))}, ts=ts)
