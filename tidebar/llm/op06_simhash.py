"""SimHash near-duplicates through vantage-point trees.

Fingerprints are taken from whole texts. Two trees of vantage points, one for each half of the bits, built on a bounded
sample, cut Hamming space in shards; every distinct fingerprint lives in the shard it falls in and visits those shards
beyond a boundary that the triangle inequality cannot rule out. A pair within the radius is within half of it on one half
of the bits, and meets in exactly one shard of that half's tree, where it is compared exactly. The sample only shapes the
trees: any trees give the same links.

Defined results: a null or empty text has fingerprint zero and links like any other; equal fingerprints link; very long
texts are hashed whole, in pieces; repeated rows keep one row each; a null doc_id is kept and never names a component
unless no other id is in it; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import BLOCK_ROWS, components, keep_rows, roots, runs, text_of, written

SEED, SHINGLE_WORDS, RADIUS = 42, 3, 3
PIECE_SHINGLES = 1 << 15
SAMPLE = 1 << 14
LEAF_ROWS = 2048
GUEST_ROWS = 1 << 16
LINKS = 1 << 21
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """64 majority bits over the hashes of all shingles, as an unsigned number."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII space count
    if not w:
        return 0
    n = max(len(w) - words + 1, 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else iter([b" ".join(w)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    sums = np.zeros(64, np.int64)
    for _ in range(0, n, PIECE_SHINGLES):
        sums += _bit_sums(np.fromiter(islice(hashes, PIECE_SHINGLES), np.uint64))
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, also: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, fp, k0, k1 ...): the fingerprint as a signed 64-bit number, and the long columns `also`."""
    keys = [f"k{i}" for i in range(len(also))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps), *[batch[k] for k in keys]], ["doc_id", "fp", *keys])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), *[c.alias(k) for c, k in zip(also, keys)])
    return rows.mapInArrow(task, ", ".join(f"{c} long" for c in ["doc_id", "fp", *keys]))


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(x, y)).astype(np.int64)


class VantageTree:
    """Arrays of a binary tree: node k is a leaf where `inner[k]` < 0, else distances up to `radius[k]` go inside."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.point, self.radius, self.inner, self.outer = [], [], [], []
        self._build(np.unique(sample), depth, np.random.default_rng(seed))
        self.point = np.array(self.point, np.uint64)
        self.radius, self.inner, self.outer = (np.array(x, np.int64) for x in (self.radius, self.inner, self.outer))

    def _build(self, own: np.ndarray, depth: int, rng) -> int:
        k = len(self.inner)
        for x in (self.point, self.radius, self.inner, self.outer):
            x.append(-1 if x is not self.point else 0)
        if depth == 0 or len(own) < 4:
            return k
        tried = rng.choice(own, min(8, len(own)), replace=False)
        spans = [distance(own, v) for v in tried]
        best = int(np.argmax([s.std() for s in spans]))
        far = spans[best]
        cut = int(np.median(far))
        inside = far <= cut
        if inside.all():
            cut -= 1
            inside = far <= cut
        if not inside.any():
            return k
        self.point[k], self.radius[k] = tried[best], cut
        self.inner[k] = self._build(own[inside], depth - 1, rng)
        self.outer[k] = self._build(own[~inside], depth - 1, rng)
        return k

    def visits(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, guest): the leaf each fingerprint lives in, and those it visits.

        Of a pair parted by a boundary the inner one visits the outer one's side, so the pair meets once. A guest goes
        on to every side that can hold a fingerprint within reach.
        """
        row, node, guest = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), bool)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(row):
            leaf = self.inner[node] < 0
            done.append((row[leaf], node[leaf], guest[leaf]))
            row, node, guest = row[~leaf], node[~leaf], guest[~leaf]
            far, cut = distance(fps[row], self.point[node]), self.radius[node]
            inside = far <= cut
            into = np.where(guest, far - reach <= cut, inside)
            out = np.where(guest, far + reach > cut, ~inside)
            cross = ~guest & inside & (far + reach > cut)
            row, node, guest = (np.concatenate([row[into], row[out], row[cross]]),
                                np.concatenate([self.inner[node[into]], self.outer[node[out]], self.outer[node[cross]]]),
                                np.concatenate([guest[into], guest[out], np.ones(int(cross.sum()), bool)]))
        return tuple(np.concatenate(x) for x in zip(*done))


def _spanning(fps: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], reach: int) -> np.ndarray:
    """Least index that each row reaches over links within reach between `pairs` of index sets (first x second). Rows are
    compared in bounded blocks, and links found so far shrink to one per row before they grow beyond LINKS."""
    at = np.arange(len(fps))
    root = at
    left, right, size = [], [], 0

    def merged() -> np.ndarray:
        return roots(len(fps), np.concatenate([at, *left]), np.concatenate([root, *right]))

    for first, second in pairs:
        for start in range(0, len(first), 512):
            part = first[start:start + 512]
            a, b = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[second][None, :]) <= reach)
            left.append(part[a])
            right.append(second[b])
            size += len(a)
            if size > LINKS:
                root, left, right, size = merged(), [], [], 0
    return merged()


def _dealt(visits: DataFrame, home_rows: int, guest_rows: int) -> DataFrame:
    """Rows of every shard dealt over tasks (shard, _lo, _hi) in which each home meets all homes and all guests once.

    Homes and guests of a shard are cut by hash in blocks of about `home_rows` and `guest_rows`. Task (x, y) holds home
    blocks x and y; the first block of guests visits the tasks (x, x), any further one has tasks of its own with each home
    block. Guests never meet guests, so a shard with one home block holds every guest once.
    """
    blocks = lambda n, rows: F.greatest(F.ceil(n / F.lit(rows)), F.lit(1)).cast("int")
    counts = visits.groupBy("shard").agg(F.count_if(~F.col("guest")).alias("_homes"), F.count_if("guest").alias("_guests"))
    big = (counts.filter((F.col("_homes") > home_rows) | (F.col("_guests") > guest_rows))
           .select("shard", blocks(F.col("_homes"), home_rows).alias("_hb"), blocks(F.col("_guests"), guest_rows).alias("_gb")))
    guest, block, other, homes = F.col("guest"), F.col("_block"), F.col("_other"), F.col("_hb")
    return (visits.join(big, "shard", "left").fillna(1, ["_hb", "_gb"])
            .withColumn("_block", F.pmod(F.xxhash64("fp"), F.when(guest, F.col("_gb")).otherwise(homes)).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), homes - 1 + F.when(guest, 0).otherwise(F.col("_gb") - 1))))
            .withColumns({"_lo": F.when(guest, other).otherwise(F.least(block, other)),
                          "_hi": F.when(guest, F.when(block == 0, other).otherwise(homes + block - 1)).otherwise(F.greatest(block, other))})
            .select("shard", "_lo", "_hi", "_block", "fp", "guest")
            .repartition("shard", "_lo", "_hi").sortWithinPartitions("shard", "_lo", "_hi"))


def near_links(fps: DataFrame, reach: int = RADIUS, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, home_rows: int = BLOCK_ROWS,
               guest_rows: int = GUEST_ROWS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of column `fp` within `reach` bits: per shard task a spanning
    set, not every pair, so a group of n near copies yields about n rows.

    Two fingerprints within `reach` bits are within half of it on one half of the bits, so there is a tree for each half,
    searched with half the reach: far fewer branches stay open than with all bits. Shards compare all 64 bits.
    """
    spark = fps.sparkSession
    n = fps.count()
    share = min(1.0, sample / max(n, 1))
    drawn = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * sample).toPandas()["fp"]
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf_rows))))
    seen = drawn.to_numpy(np.int64).view(np.uint64)
    trees = [VantageTree(seen & half, depth) for half in HALVES]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), 2048):
                own = frame["fp"].to_numpy()[start:start + 2048]
                for k, (half, tree) in enumerate(zip(HALVES, trees)):
                    row, leaf, guest = tree.visits(own.view(np.uint64) & half, reach // 2)
                    yield pd.DataFrame({"shard": 2 * leaf + k, "fp": own[row], "guest": guest})

    visits = written(fps.select("fp").mapInPandas(route, "shard long, fp long, guest boolean"), "simhash-visits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard", "_lo", "_hi"]):
            own, guest, block = (group[c].to_numpy() for c in ("fp", "guest", "_block"))
            at, lo, hi = np.arange(len(own)), group["_lo"][0].as_py(), group["_hi"][0].as_py()
            first, visitors = at[~guest & (block == lo)], at[guest]
            root = _spanning(own.view(np.uint64), [(first, first if lo == hi else at[~guest & (block == hi)]), (visitors, first)], reach)
            kept = root != at
            yield pa.RecordBatch.from_arrays([pa.array(own[kept]), pa.array(own[root[kept]])], ["a", "b"])

    return _dealt(visits, home_rows, guest_rows).mapInArrow(compare, "a long, b long").filter(F.col("a") != F.col("b")).distinct()


def _labelled(fps: DataFrame, reach: int) -> DataFrame:
    """(fp, rep, label): each distinct fingerprint, its least doc_id and the component it is in."""
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    labels = components(near_links(classes, reach), "simhash-components")
    return classes.join(labels, classes.fp == labels.node, "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, reach: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the least doc_id reachable by links."""
    fps = written(with_fingerprints(docs, words), "simhash-fingerprints")
    named = _labelled(fps, reach)
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    return (fps.join(named.join(least, "label").select("fp", "component_id"), "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def one_of_each(docs: DataFrame, reach: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group of near-duplicates, in the columns of `docs`: that with the least doc_id, a null one last.

    Rows are told apart by doc_id and two 64-bit hashes of the whole text, so where a doc_id repeats with different texts
    each text is judged by its own group. Of rows alike in both, the first by JSON stays.
    """
    hashes = [F.xxhash64(F.lit(k), text_of()) for k in range(2)]
    fps = written(with_fingerprints(docs, words, hashes), "simhash-rows")
    best = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "k0", "k1")).alias("best"))
    chosen = best.join(_labelled(fps, reach), "fp").groupBy("label").agg(F.min("best").alias("best")).select("best.*")
    key = F.col("doc_id").cast("long")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.isNull().alias("none"),
                         F.coalesce(key, F.lit(0)).alias("id"), *[h.alias(f"k{k}") for k, h in enumerate(hashes)])
    same = ["none", "id", "k0", "k1"]
    return (packed.join(chosen, same, "left_semi")
            .withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(F.to_json("row"))))
            .filter(F.col("_n") == 1).select("row.*"))
