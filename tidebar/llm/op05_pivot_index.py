"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest reference points in order. Inverted lists are kept per pair of those pivots, so two
vectors meet in as many lists as they share pairs: sharing at least two pivots is the condition to be compared. Candidates are
verified by cosine in double precision, in the list of the two least pivots they share and nowhere else, so each pair counts
once. Long lists are cut in blocks and every pair of blocks is compared; no list is capped.

Pivots are drawn from a bounded sample of vectors; their number grows with the square root of the table, so lists hold about
the same share of rows at every size. Missed pairs are those whose pivots differ too much; see `recall` in the tests.

Equal vectors are one class from the start. Defined results: vectors that are null, empty, all zero, or hold null or
non-finite parts link with nothing, as do those of another length; repeated rows link with each other; a null vec_id is kept
and never names a component unless no other id is in it; other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import block_pairs, components, roots, runs, written

COSINE = 0.95
NEAREST = 6
SHARED = 2
MIN_PIVOTS, MAX_PIVOTS = 64, 1 << 15
LIST_ROWS = 2048


def _classes(vectors: DataFrame) -> DataFrame:
    """(node, v, size, rep): the distinct usable vectors; `v` as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # adding zero makes -0.0 and 0.0 equal
    usable = vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + 0.0).alias("v"))
    grouped = usable.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("rep"))
    return written(grouped.withColumn("node", F.monotonically_increasing_id()), "pivot-classes")


def pick_pivots(classes: DataFrame, n: int, seed: int = 11) -> dict[int, np.ndarray]:
    """Per vector length, at most about `n` unit vectors, drawn by hash from the distinct ones."""
    total = classes.count()
    share = int(min(1.0, n / max(total, 1)) * (1 << 30)) + 1
    rows = classes.filter(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) < share).select("v").limit(2 * n).toPandas()["v"]
    by_size: dict[int, list[np.ndarray]] = {}
    for x in rows:
        x = np.asarray(x, np.float64)
        by_size.setdefault(len(x), []).append(x / np.linalg.norm(x))
    return {d: np.array(x) for d, x in by_size.items()}


def described(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """(node, size, v, pivots): pivots in order of nearness. A length without drawn pivots shares one stand-in list."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                rows = [np.asarray(x, np.float64) for x in part["v"].to_pylist()]
                order: list[list[int]] = [[0, 1]] * len(rows)
                for d in {len(x) for x in rows} & set(pivots):
                    own = [i for i, x in enumerate(rows) if len(x) == d]
                    x = np.array([rows[i] for i in own])
                    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots[d].T
                    best = np.argsort(-near, axis=1, kind="stable")[:, :nearest]
                    for i, b in zip(own, best):
                        order[i] = b.tolist() if len(b) >= SHARED else [0, 1]
                yield pa.RecordBatch.from_arrays([part["node"], part["size"], part["v"], pa.array(order, pa.list_(pa.int32()))],
                                                 ["node", "size", "v", "pivots"])

    return classes.select("node", "size", "v").mapInArrow(task, "node long, size long, v array<double>, pivots array<int>")


def _least_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of the two least pivots that each row of a shares with the same row of b (sorted, -1 fills)."""
    same = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=2)
    shared = np.sort(np.where(same, a, np.iinfo(np.int32).max), axis=1).astype(np.int64)
    return shared[:, 0] * MAX_PIVOTS * 2 + shared[:, 1]


def links(index: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, list_rows: int = LIST_ROWS) -> DataFrame:
    """(node, root, n): per list task a spanning set of links and the number of vectors linked to each."""
    p = F.array_sort("pivots")
    keys = F.filter(F.array(*[F.when(F.size(p) > j, F.get(p, F.lit(i)).cast("long") * (MAX_PIVOTS * 2) + F.get(p, F.lit(j)))
                              for i, j in combinations(range(nearest), SHARED)]), lambda k: k.isNotNull())
    lists = index.select("node", "size", "v", p.alias("pivots"), F.explode(F.array_distinct(keys)).alias("list"))
    counts = written(lists.groupBy("list").agg(F.count(F.lit(1)).alias("_n")), "pivot-lists")
    alone = counts.filter(F.col("_n") > 1).select("list")
    members = lists.join(alone, "list", "left_semi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["list", "_lo", "_hi"]):
            node, size, block = (group[c].to_numpy() for c in ("node", "size", "_block"))
            key, lo, hi = (group[c][0].as_py() for c in ("list", "_lo", "_hi"))
            v = group["v"].to_pylist()
            at = np.arange(len(node))
            pivots = np.full((len(node), nearest), -1, np.int32)
            for i, x in enumerate(group["pivots"].to_pylist()):
                pivots[i, :len(x)] = x
            left, right = [], []
            for d in {len(x) for x in v}:
                own = at[[len(x) == d for x in v]]
                a, b = (own, own) if lo == hi else (own[block[own] == lo], own[block[own] == hi])
                if not len(a) or not len(b):
                    continue
                x = np.array([v[i] for i in own], np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                where = np.zeros(len(node), np.int64)
                where[own] = np.arange(len(own))
                for start in range(0, len(a), 512):
                    rows = a[start:start + 512]
                    i, j = np.nonzero(x[where[rows]] @ x[where[b]].T >= cosine)
                    i, j = rows[i], b[j]
                    keep = i < j if lo == hi else np.ones(len(i), bool)
                    i, j = i[keep], j[keep]
                    keep = _least_shared(pivots[i], pivots[j]) == key
                    left.append(i[keep])
                    right.append(j[keep])
            left, right = (np.concatenate(z or [at[:0]]) for z in (left, right))
            if not len(left):
                continue
            n = np.bincount(left, size[right], len(node)) + np.bincount(right, size[left], len(node))
            root = roots(len(node), left, right)
            got = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(node[root[got]]), pa.array(n[got].astype(np.int64))],
                                             ["node", "root", "n"])

    return block_pairs(members, "list", "node", counts, list_rows).select("list", "_lo", "_hi", "_block", "node", "size", "v", "pivots").mapInArrow(
        compare, "node long, root long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, nearest: int = NEAREST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    classes = _classes(vectors)
    n = classes.count()
    pivots = pick_pivots(classes, int(np.clip(np.ceil(np.sqrt(n)), MIN_PIVOTS, MAX_PIVOTS)))
    found = written(links(written(described(classes, pivots, nearest), "pivot-index"), cosine, nearest), "pivot-links")
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "pivot-components")
    partners = found.groupBy("node").agg(F.sum("n").alias("others"))
    named = (classes.join(partners, "node", "left").join(labels, "node", "left")
             .select("v", "size", "rep", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("label", "node").alias("label")))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    classed = named.join(least, "label").select("v", (F.col("others") + F.col("size") - 1).alias("n_links"), "component_id")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    component = F.coalesce("component_id", "vec_id")
    return rows.join(classed, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
