"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens. A window is a fixed number of sequences; in every window each source is
served its share of the window's tokens, and the unserved fraction (its deficit) is carried to the next one. As documents
can be cut at any token, the served total of a source after w windows is the whole part of its credit, so the place of any
token follows from its position in its queue: documents are placed where they lie, without moving their ids. Queue positions
come from one small sum per source and partition, which carries credit across partitions.

When a source runs dry before the others (targets that differ from the corpus), the shares of the rest are scaled up: a new
phase. Every id is placed once, only the last sequence is padded.

Defined results: a null text is empty and consists of the end id; a null source is a queue of its own; repeated rows and
repeated ids are packed one by one; texts of any length are cut over as many sequences as they need; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import small, text_of, written
from tidebar.llm.tokens import WordEncoder, binary_array, slices, with_end

LENGTH = 1024
WINDOW_SEQUENCES = 64
END_ID = 0


def with_tokens(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(part, source, doc_id, start, n_tokens, ids): `start` counts the source's tokens before it in the task's part."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, served = WordEncoder.get(path, True), TaskContext.get().partitionId(), {}
        for whole in batches:
            for batch in slices(whole):
                ids, n = with_end(*encoder.encode(batch["text"]), end_id)
                coded = batch["source"].dictionary_encode()
                at, start = coded.indices.to_numpy(zero_copy_only=False), np.zeros(len(n), np.int64)
                for k, source in enumerate(coded.dictionary.to_pylist()):
                    own = at == k
                    ends = np.cumsum(n[own]) + served.get(source, 0)
                    start[own] = ends - n[own]
                    served[source] = int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part)), batch["source"], batch["doc_id"], pa.array(start), pa.array(n), binary_array(ids, n)],
                    ["part", "source", "doc_id", "start", "n_tokens", "ids"])

    # a null source is told apart from every name by its first letter
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return (docs.select(source.alias("source"), F.col("doc_id").cast("long"), text_of().alias("text"))
            .mapInArrow(task, "part long, source string, doc_id long, start long, n_tokens long, ids binary"))


@dataclass(frozen=True)
class Phase:
    """A stretch of the output in which the same sources are served. Bounds run over the sources in order: `below` and
    `above` are the cumulative weights, `before` what the queue had given before, `at` the place in the output."""

    at: int
    tokens: int
    total: int
    below: dict[str, int]
    above: dict[str, int]
    before: dict[str, int]

    def place_of(self, window: int, size: int, edge: int) -> int:
        """Tokens that the sources up to a cumulative weight were served before a window of this phase."""
        return min(window * size, self.tokens) * edge // self.total


def schedule(tokens: dict[str, int], weights: dict[str, float] | None) -> list[Phase]:
    """Phases of the round-robin. Without weights each source gets its share of the corpus and all run dry together."""
    left = {s: n for s, n in sorted(tokens.items()) if n}
    given = dict.fromkeys(left, 0)
    if weights is not None:
        scale = {s: max(int(weights.get(s, 0.0) * 1_000_000), 0) for s in left}
        scale = {s: w or 1 for s, w in scale.items()}
    phases, at = [], 0

    def serve(size: int, shares: dict[str, int]) -> None:
        nonlocal at
        below, above, edge, total = {}, {}, 0, sum(shares.values())
        for s, w in shares.items():
            below[s], edge = edge, edge + w
            above[s] = edge
        phases.append(Phase(at, size, total, below, above, dict(given)))
        for s in shares:
            got = size * above[s] // total - size * below[s] // total
            given[s], left[s] = given[s] + got, left[s] - got
        at += size

    if weights is None and left:
        serve(sum(left.values()), dict(left))
        return phases
    while left:
        shares = {s: scale[s] for s in left}
        total = sum(shares.values())
        first = min(left, key=lambda s: left[s] * total // shares[s])
        size = left[first] * total // shares[first]
        if size:
            serve(size, shares)
        if left[first]:  # less than a token's credit short of dry
            serve(left[first], {first: 1})
        left = {s: n for s, n in left.items() if n > 0}
    return phases


def pieces_of(phases: list[Phase], source: str, start: int, n: int, window: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(offset in the document, place in the output, tokens) of the stretches of queue positions start .. start + n."""
    done = 0
    for p in phases:
        if source not in p.below or done == n:
            continue
        low, high = p.below[source], p.above[source]
        first, last = p.before[source], p.before[source] + p.tokens * high // p.total - p.tokens * low // p.total
        while done < n and first <= start + done < last:
            q = start + done - first
            w = q * p.total // ((high - low) * window)
            while p.place_of(w, window, high) - p.place_of(w, window, low) > q:
                w -= 1
            while p.place_of(w + 1, window, high) - p.place_of(w + 1, window, low) <= q:
                w += 1
            served = p.place_of(w, window, high) - p.place_of(w, window, low)
            ahead = p.place_of(w + 1, window, low) - p.place_of(w, window, low)
            end = p.place_of(w + 1, window, high) - p.place_of(w + 1, window, low)
            place = p.at + min(w * window, p.tokens) + ahead + q - served
            take = min(end - q, n - done)
            while take:
                step = min(take, length - place % length)
                yield done, place, step
                done, place, take = done + step, place + step, take - step


def pack(docs: DataFrame, path: str, weights: dict[str, float] | None = None, length: int = LENGTH,
         window_sequences: int = WINDOW_SEQUENCES, end_id: int = END_ID) -> DataFrame:
    """(doc_id, source, start, length, ids, doc_tokens, sequence_id, offset, padded_length), one row per piece.

    `weights` are target token proportions by source (default: those of the corpus). The driver holds one number per
    source, as a mixture names its sources.
    """
    table = written(with_tokens(docs, path, end_id), "packing-tokens")
    by_part = table.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    totals = {r["source"]: r["n"] for r in by_part.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    named = None if weights is None else {f"={s}" if s is not None else "-": w for s, w in weights.items()}
    phases, window, total = schedule(totals, named), window_sequences * length, sum(totals.values())
    rest = total % length
    padded = length if rest & (rest - 1) else rest  # a power of two needs no padding
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_part.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    dtype = "<u2"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for source, doc_id, start, ids in zip(*(batch[c] for c in ("source", "doc_id", "start", "ids"))):
                wide = np.frombuffer(ids.as_buffer(), dtype).astype("<u4")
                for done, place, step in pieces_of(phases, source.as_py(), start.as_py(), len(wide), window, length):
                    own = wide[done:done + step].tobytes()
                    seq = place // length
                    rows.append((doc_id.as_py(), source.as_py(), done, step, own, len(wide), seq, place % length,
                                 padded if rest and seq == total // length else length))
                    size += len(own)
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    placed = table.join(small(ahead), ["source", "part"]).select("source", "doc_id", (F.col("start") + F.col("ahead")).alias("start"), "ids")
    return (placed.mapInArrow(task, PIECES)
            .withColumn("source", F.when(F.col("source").startswith("="), F.col("source").substr(F.lit(2), F.length("source")))))


PIECES = "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in PIECES.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def sequences(pieces: DataFrame, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, doc_ids, doc_starts): padded training rows; a group is one sequence and so of bounded size."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length", "padded_length")))
    return (pieces.groupBy("sequence_id").agg(ordered.alias("p"))
            .select("sequence_id", "p", F.get("p", F.lit(0))["padded_length"].alias("padded"),
                    F.aggregate("p", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"])).alias("ids"))
            .select("sequence_id", F.rpad("ids", F.col("padded") * 4, F.lit(int(pad_id).to_bytes(4, "little"))).alias("ids"),
                    F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("doc_starts")))


def packed_digest(docs: DataFrame, path: str) -> DataFrame:
    """The pieces with the CRC of their ids instead of the ids."""
    return pack(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                                   "offset", "source", "padded_length")
