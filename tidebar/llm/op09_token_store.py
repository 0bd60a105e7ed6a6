"""Token ids in binary files with a minimal perfect hash from document key to place.

A store is a folder of shard files over ascending keys and a manifest. A shard holds a header, the raw ids, and an index: a
minimal perfect hash (levels of bit arrays; a key owns the first bit that it alone hits, its slot is the rank of that bit)
with, per slot, the key's fingerprint, its offset, its number of rows and ids. A lookup touches one slot, the fingerprint
tells foreign keys. Rows lie in the order of their keys, and a list of keys and lengths serves whole reads. Files are written and read by Spark, so any store that Spark reaches will do.

Defined results: a null text is empty and has the end id only; a null doc_id is a key of its own, before all others; rows with
the same key lie together, in the order of their texts' hashes, and the index gives the first and their number; other columns are
ignored, whatever their names; an empty table gives an empty store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.llm.common import new_path, text_of
from tidebar.llm.tokens import WordEncoder, slices, with_end

END_ID = 1
SHARD_BYTES = 16 << 20
MAGIC = b"TIDETOK1"
NULL_KEY = -(1 << 63)
GAMMA, MAX_LEVELS = 2.0, 64


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of integer keys (the splitmix64 finaliser), one per level."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, MAX_LEVELS + 1) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Distinct integer keys to 0 .. n - 1. Some five bits a key; about one and a half probes a lookup."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.flags = np.unpackbits(bits, count=int(self.starts[-1])).astype(bool)
        self.ranks = np.cumsum(self.flags) - 1

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, flags, left, level = [], [], keys, 0
        while len(left):
            if level >= MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = max(int(GAMMA * len(left)), 8)
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            flags.append(hits == 1)
            sizes.append(size)
            left, level = left[hits[at] != 1], level + 1
        joined = np.concatenate(flags) if flags else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(joined))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some foreign keys, any slot for others."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            place = self.starts[level] + (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.flags[place]
            out[open_[hit]] = self.ranks[place[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class Shard:
    """One file: header of eight numbers, then ids, the rows' lengths and keys (for whole reads) and the index."""

    def __init__(self, number: int, width: int, ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray, table: dict[str, np.ndarray], index: PerfectHash):
        self.number, self.width, self.ids, self.lengths, self.keys, self.table, self.index = number, width, ids, lengths, keys, table, index

    @staticmethod
    def pack(number: int, ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> bytes:
        """`keys` ascending, one per row."""
        distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        index = PerfectHash.build(distinct)
        order = np.argsort(index.slots(distinct))
        spans = ends[first + rows] - ends[first]
        parts = [ids, lengths.astype("<u4"), keys.astype("<i8"), fingerprints(distinct)[order], ends[first][order].astype("<i8"), rows[order].astype("<u4"),
                 spans[order].astype("<u8"), index.sizes.astype("<i8"), index.bits]
        head = np.array([number, ids.dtype.itemsize, len(ids), len(lengths), len(distinct), len(index.sizes), len(index.bits), 0], "<i8")
        return MAGIC + head.tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    @classmethod
    def read(cls, raw: memoryview) -> "Shard":
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token shard")
        number, width, n_ids, n_rows, n_keys, n_levels, n_bits, _ = np.frombuffer(raw, "<i8", 8, 8).tolist()
        at = 72

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, dtype, n, at)
            at += got.nbytes
            return got

        ids, lengths, keys = take(f"<u{width}", n_ids), take("<u4", n_rows), take("<i8", n_rows)
        table = {"print": take("<u4", n_keys), "offset": take("<i8", n_keys), "rows": take("<u4", n_keys), "span": take("<u8", n_keys)}
        return cls(number, width, ids, lengths, keys, table, PerfectHash(take("<i8", n_levels), take("u1", n_bits)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the fingerprint says that it is not here."""
        slot = self.index.slots(keys)
        known = slot >= 0
        known[known] = self.table["print"][slot[known]] == fingerprints(keys[known])
        return np.where(known, slot, -1)


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the store: `shards` (binary files) and `manifest` (sizes and key range of each)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), text_of().alias("text"))
    # the hash spreads the rows of one key over tasks
    ordered = rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, serial = WordEncoder.get(path, False), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, lengths, keys = (np.concatenate(x) for x in zip(*held))
            number = part << 32 | serial
            blob = Shard.pack(number, ids, lengths, keys)
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

        for whole in batches:
            for batch in slices(whole):
                ids, n = with_end(*encoder.encode(batch["text"]), end_id)
                held.append((ids, n, batch["key"].to_numpy()))
                size += ids.nbytes
                if size >= shard_bytes:
                    yield flush()
                    held, size, serial = [], 0, serial + 1
        if held:
            yield flush()

    # a shard is one value of a text file: its bytes as they are, and a line end that the header's counts leave out
    ordered.mapInArrow(task, "blob binary").select(F.col("blob").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{folder}/shards")
    _files(spark, folder).mapInArrow(_summary, SUMMARY).write.parquet(f"{folder}/manifest")


SUMMARY = "shard long, n_rows long, n_ids long, low long, high long"
ROW = "shard long, key long, start long, n_tokens long, ids binary"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/shards").select("content")


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shards = [Shard.read(memoryview(c.as_buffer())) for c in batch["content"]]
        rows = [(s.number, len(s.lengths), len(s.ids), int(s.keys[0]), int(s.keys[-1])) for s in shards if len(s.keys)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in SUMMARY.split(", ")])


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in ROW.split(", ")])


def _found(shard: Shard, keys: np.ndarray) -> Iterator[tuple]:
    """Rows of the distinct keys through the index; a repeated key's rows are told apart by their lengths."""
    ends = np.concatenate([[0], np.cumsum(shard.lengths, dtype=np.int64)])
    for key, slot in zip(keys.tolist(), shard.find(keys).tolist()):
        if slot < 0:
            continue
        at, span = int(shard.table["offset"][slot]), int(shard.table["span"][slot])
        lengths = [span]
        if shard.table["rows"][slot] > 1:
            row = int(np.searchsorted(ends, at))
            lengths = shard.lengths[row:row + int(shard.table["rows"][slot])].tolist()
        for n in lengths:
            yield shard.number, key, at, n, shard.ids[at:at + n].astype("<u4").tobytes()
            at += n


def _in_batches(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size > most:
            yield _row_batch(held)
            held, size = [], 0
    if held:
        yield _row_batch(held)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every row, by a lookup of every key in its shard's index. `start` counts the ids of
    all rows before it in the store."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                shard = Shard.read(memoryview(content.as_buffer()))
                yield from _in_batches(_found(shard, np.unique(shard.keys)))

    return _placed(spark, folder, _files(spark, folder).mapInArrow(task, ROW))


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """The same for the keys in `keys` (doc_id) only: each goes to the shards whose range holds it, grouped by shard, and
    one probe finds it there. A foreign key passes a fingerprint with a chance of 2^-32."""
    bounds = spark.read.parquet(f"{folder}/manifest").select("shard", "low", "high")
    wanted = keys.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    real = F.when(F.col("low") != NULL_KEY, F.col("low"))
    least, most, n = bounds.agg(F.min(real), F.max("high"), F.count(F.lit(1))).first()
    if least is None:
        least = most = 0
    width = (most - least) // max(n, 1) + 1

    # the key range is cut in as many cells as there are shards, so all shards together cover at most twice as many
    def cell(key):
        return F.when(key == NULL_KEY, F.lit(-1)).otherwise(F.floor((key - F.lit(least)) / F.lit(width))).cast("long")

    covered = F.concat(F.when(F.col("low") == NULL_KEY, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>")),
                       F.when(F.col("high") != NULL_KEY, F.sequence(cell(F.greatest("low", F.lit(least))), cell(F.col("high"))))
                       .otherwise(F.array().cast("array<long>")))
    near = (wanted.withColumn("cell", cell(F.col("key"))).join(bounds.withColumn("cell", F.explode(covered)), "cell")
            .filter((F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high"))).select("shard", "key"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [int(np.frombuffer(c.as_buffer(), "<i8", 1, 8)[0]) for c in batch["content"]]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch["content"]], ["shard", "content"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, own in zip(batch["content"], batch["keys"]):
                shard = Shard.read(memoryview(content.as_buffer()))
                yield from _in_batches(_found(shard, np.array(own.as_py(), np.int64)))

    files = _files(spark, folder).mapInArrow(numbered, "shard long, content binary")
    grouped = near.groupBy("shard").agg(F.collect_list("key").alias("keys"))  # no more keys than the shard's range has rows, bar misses
    return _placed(spark, folder, files.join(grouped, "shard").select("content", "keys").mapInArrow(task, ROW))


def _placed(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Add the ids of all shards before, summed by task of the writer first."""
    manifest = spark.read.parquet(f"{folder}/manifest").withColumn("part", F.shiftright("shard", 32))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "part_base", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)))
    within = F.coalesce(F.sum("n_ids").over(earlier.partitionBy("part").orderBy("shard")), F.lit(0))
    bases = manifest.withColumn("within", within).join(parts, "part").select("shard", (F.col("part_base") + F.col("within")).alias("base"))
    key = F.when(F.col("key") != NULL_KEY, F.col("key"))
    return rows.join(bases, "shard").select(key.alias("doc_id"), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def stored_digest(docs: DataFrame, path: str) -> DataFrame:
    """Write a new store in the shared folder, read it back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = new_path(docs.sparkSession, "token-store")
    write(docs, folder, path)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
