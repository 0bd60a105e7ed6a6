"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a longest stretch of words in which words `period` apart are equal, at least MIN_EXPONENT periods and MIN_LENGTH
words long, with no smaller period. At scale B, for periods from B to 2B - 1, the words are cut in blocks of B. The squared
differences between a block and the words at every distance d of the scale,

    S(d) = sum of (x[i] - x[i + d]) ** 2 = sum of x[i] ** 2 + sum of x[i + d] ** 2 - 2 * sum of x[i] * x[i + d],

come from one correlation by a number-theoretic transform of length 2B. Words have small integer codes, so S(d) is less than
the modulus and is zero exactly where all codes agree. A run holds at least two whole neighbouring blocks that match at its
period, so chains of matching blocks at one distance are the seeds. These are compared word by word and extended; two words
with one code cost a comparison and nothing else. Matches inside a run already found, at a multiple of its period, belong to
that run. A stretch that has the bounds of a run with a smaller period is that run.

The transform multiplies with matrices of powers of a root of unity, in steps of up to RADIX points (Cooley-Tukey above).
All numbers are integers below 2 ** 53 in double precision, so the products of the matrix library are exact. All texts of a
batch form one sequence, longest first, each closed by a word of its own, so a scale takes the beginning that holds the texts
long enough for it.

Defined results: a null text and one without words have no runs and an empty collapsed text; texts of any length are taken
whole, blocks above MAX_BLOCK words being matched by parts; repeated rows are searched row by row; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import text_of
from tidebar.llm.tokens import slices

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: 7 * 2 ** 20 + 1, a prime whose units hold a cyclic group of 2 ** 20 elements; 3 generates all units.
PRIME, GENERATOR = 7 * (1 << 20) + 1, 3
RADIX = 128
MAX_BLOCK = 1 << 19
#: Numbers per transformed chunk, which stay in a core's cache, and words compared at a time.
CHUNK, COMPARED = 1 << 16, 1 << 21


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME in place, as the remainder nearest to zero."""
    q = np.rint(x * (1.0 / PRIME))
    q *= PRIME
    x -= q
    return x


@functools.cache
def _powers(n: int, rows: int, columns: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order n to the products of row and column numbers."""
    root = pow(GENERATOR, (PRIME - 1) // n * (n - 1 if inverse else 1), PRIME)
    table = np.ones(n, np.int64)
    for k in range(n.bit_length() - 1):  # by doubling
        table[1 << k:2 << k] = table[:1 << k] * pow(root, 1 << k, PRIME) % PRIME
    return reduced(table[np.outer(np.arange(rows), np.arange(columns)) % n].astype(float))


def _factors(n: int) -> tuple[int, int]:
    n1 = min(1 << ((n.bit_length() - 1) + 1) // 2, RADIX)
    return n1, n // n1


def forward(x: np.ndarray, n: int) -> np.ndarray:
    """Transforms of length n of the rows of x, which are followed by zeros; the numbers come in the order of `places`."""
    rows, given = x.shape
    if n <= RADIX:
        return reduced(x @ _powers(n, given, n, False))
    n1, n2 = _factors(n)
    a = reduced(np.matmul(_powers(n1, given // n2, n1, False).T, x.reshape(rows, given // n2, n2)))
    a *= _powers(n, n1, n2, False)
    return forward(reduced(a).reshape(rows * n1, n2), n2).reshape(rows, n)


def backward(x: np.ndarray, n: int, wanted: int) -> np.ndarray:
    """The first `wanted` numbers, times n, of the rows whose transforms are x."""
    rows = len(x)
    if n <= RADIX:
        return reduced(x @ _powers(n, n, wanted, True))
    n1, n2 = _factors(n)
    a = backward(x.reshape(rows * n1, n2), n2, n2).reshape(rows, n1, n2)
    a *= _powers(n, n1, n2, True)
    return reduced(np.matmul(_powers(n1, n1, wanted // n2, True).T, reduced(a))).reshape(rows, wanted)


@functools.cache
def places(n: int) -> np.ndarray:
    """The frequency at each place of a transform."""
    if n <= RADIX:
        return np.arange(n)
    n1, n2 = _factors(n)
    return (np.arange(n1)[:, None] + n1 * places(n2)[None, :]).reshape(n)


@functools.cache
def _mirror(n: int) -> np.ndarray:
    """Where the transform has the negative of each place's frequency."""
    order = places(n)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    return at[-order % n]


def zero_distances(codes: np.ndarray, block: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block numbers, distances) at which blocks of `block` codes occur again, for distances from scale to 2 * scale - 1.

    `block` divides `scale`. The codes must be less than sqrt(PRIME / block). Beyond the end they count as zeros.
    """
    ahead, n = scale // block, 2 * block
    blocks = -(-len(codes) // block)
    x = np.zeros((blocks + 2 * ahead + 2, block))
    x.reshape(-1)[:len(codes)] = codes
    before = np.concatenate([[0.0], np.cumsum(np.square(x.reshape(-1)))[:-1]]).reshape(x.shape)
    own = np.diff(before[:, 0])
    sign, mirror, scaled = np.where(places(n) % 2, -1.0, 1.0), _mirror(n), float(pow(n, -1, PRIME))
    step = max(CHUNK // n, 1)
    for j in range(0, blocks, step):
        k = min(j + step, blocks)
        for part in range(ahead):
            off = ahead + part
            if ahead == 1:
                both = forward(x[j:k + 2], n)
                mine, next_, far = both[:-2], both[1:-1], both[2:]
            else:
                mine, both = forward(x[j:k], n), forward(x[j + off:k + off + 1], n)
                next_, far = both[:-1], both[1:]
            product = far * sign
            product += next_
            product *= mine[:, mirror]
            shared = reduced(backward(reduced(product), n, block) * scaled)
            shared *= -2.0
            shared += before[j + off + 1:k + off + 1]
            shared -= before[j + off:k + off]
            shared += own[j:k, None]
            at, lag = np.nonzero(reduced(shared) == 0)
            if len(at):
                yield at + j, lag + off * block


class Runs:
    """Runs of one sequence of word numbers; texts are closed by numbers that occur once."""

    def __init__(self, words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, max_block: int = MAX_BLOCK):
        if min_exponent < 3:
            raise ValueError("blocks find runs of three periods or more")
        self.words, self.min_length, self.min_exponent, self.max_block = words, min_length, min_exponent, max_block
        self.end, self.period = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)  # of a run over each word
        self.found: dict[tuple[int, int], int] = {}

    def _least(self, d: np.ndarray) -> np.ndarray:
        return np.maximum(self.min_exponent * d, self.min_length)

    def search(self, scale: int, limit: int) -> None:
        """Add the runs with periods from scale to 2 * scale - 1 of the first `limit` words, smaller periods being done."""
        block = min(scale, self.max_block)
        codes = self.words[:limit] % int(np.sqrt((PRIME - 1) / block))
        starts, distances = [], []
        for at, d in zero_distances(codes, block, scale):
            x = at * block
            q = self.period[x]
            known = (q > 0) & (x + d + block <= self.end[x]) & (d % np.maximum(q, 1) == 0)
            keep = ~known & (x + d + block <= limit)
            starts.append(at[keep])
            distances.append(d[keep])
        at, d = np.concatenate([*starts, np.empty(0, np.int64)]), np.concatenate([*distances, np.empty(0, np.int64)])
        if not len(at):
            return
        order = np.lexsort((at, d))
        at, d = at[order], d[order]
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) != 1) | (np.diff(d) != 0)
        head = np.flatnonzero(first)
        tail = np.append(head[1:], len(at)) - 1
        d, lo, hi = d[head], at[head] * block, (at[tail] + 1) * block
        long = (hi - lo) // block >= (self._least(d) - d - block + 1) // block
        d, lo, hi = d[long], np.maximum(lo[long] - block, 0), np.minimum(hi[long] + block, limit - d[long])
        cells = np.cumsum(hi - lo)
        done = 0
        while done < len(d):
            upto = max(int(np.searchsorted(cells, (cells[done - 1] if done else 0) + COMPARED, side="right")), done + 1)
            self._compare(lo[done:upto], hi[done:upto], d[done:upto], limit)
            done = upto

    def _compare(self, lo: np.ndarray, hi: np.ndarray, d: np.ndarray, limit: int) -> None:
        """Keep the longest stretches of equal words between lo and hi that make runs."""
        words, sizes = self.words, hi - lo
        ends = np.cumsum(sizes)
        chain = np.repeat(np.arange(len(lo)), sizes)
        i = np.arange(ends[-1]) + np.repeat(lo - (ends - sizes), sizes)
        equal = words[i] == words[i + d[chain]]
        edge = np.zeros(len(i) + 1, bool)
        edge[0] = True
        edge[ends] = True
        opens = np.flatnonzero(equal & (edge[:-1] | ~np.concatenate([[False], equal[:-1]])))
        closes = np.flatnonzero(equal & (edge[1:] | ~np.concatenate([equal[1:], [False]])))
        a, b, q = i[opens], i[closes] + 1, d[chain[opens]]
        long = b - a + q >= self._least(q)
        for start, stop, period in zip(a[long].tolist(), b[long].tolist(), q[long].tolist()):
            # a stretch that goes on lies in a run with a smaller period
            if start and words[start - 1] == words[start - 1 + period] or stop + period < limit and words[stop] == words[stop + period]:
                continue
            bounds = (start, stop + period)
            if bounds not in self.found:
                self.found[bounds] = period
                self.end[start:bounds[1]] = bounds[1]
                self.period[start:bounds[1]] = period


def runs_of(sizes: np.ndarray, words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
            max_block: int = MAX_BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; `words` holds the texts' word numbers in a row."""
    order = np.argsort(-sizes, kind="stable")
    long = sizes[order]
    closed = np.cumsum(long + 1)  # the end of each text with its closing word
    begins = closed - long - 1
    joined = np.empty(int(closed[-1]) if len(closed) else 0, np.int64)
    inside = np.ones(len(joined), bool)
    inside[closed - 1] = False
    starts = np.cumsum(sizes) - sizes
    joined[inside] = words[np.repeat(starts[order] - (np.cumsum(long) - long), long) + np.arange(len(words))]
    joined[~inside] = int(words.max(initial=0)) + 1 + np.arange(len(sizes))
    runs, scale = Runs(joined, min_length, min_exponent, max_block), 1
    while len(long) and long[0] >= max(min_exponent * scale, min_length):
        fit = int(np.searchsorted(-long, -max(min_exponent * scale, min_length), side="right"))
        runs.search(scale, int(closed[fit - 1]))
        scale *= 2
    table = np.array([(s, e, q) for (s, e), q in runs.found.items()], np.int64).reshape(-1, 3)
    rank = np.searchsorted(closed, table[:, 0], side="right")
    text, start = order[rank], table[:, 0] - begins[rank]
    length, period = table[:, 1] - table[:, 0], table[:, 2]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, cut at ASCII white space, and all words."""
    cut = pc.ascii_split_whitespace(texts)
    sizes, words = pc.list_value_length(cut).to_numpy(zero_copy_only=False), cut.flatten()
    full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    return np.diff(kept[np.concatenate([[0], np.cumsum(sizes)])]), words.filter(pa.array(full))


def _listed(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def collapsed(docs: DataFrame, rewrite: Callable[[list, np.ndarray], np.ndarray] | None = None, min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT, max_block: int = MAX_BLOCK) -> DataFrame:
    """(doc_id, runs, text): runs as (start, length, period) in words, by start and period; the text's words joined by single
    spaces without those that a run holds after its first period. `rewrite`, given doc ids and numbers of words, tells which
    word of the batch to take at each place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, words = words_of(part["text"])
                if rewrite is not None:
                    words = words.take(pa.array(rewrite(part["doc_id"].to_pylist(), sizes)))
                numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                text, start, length, period = runs_of(sizes, numbers, min_length, min_exponent, max_block)
                shift = (np.cumsum(sizes) - sizes)[text] + start
                cover = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(cover, shift + period, 1)
                np.add.at(cover, shift + length, -1)
                kept = np.cumsum(cover[:-1]) == 0
                sums = np.concatenate([[0], np.cumsum(kept)])
                left = np.diff(sums[np.concatenate([[0], np.cumsum(sizes)])])
                texts = pc.binary_join(_listed(left, words.filter(pa.array(kept))), " ")
                values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
                runs = _listed(np.bincount(text, minlength=part.num_rows), values)
                yield pa.RecordBatch.from_arrays([part["doc_id"], runs, texts], ["doc_id", "runs", "text"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(task, "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string")


def planted(doc_ids: list, sizes: np.ndarray) -> np.ndarray:
    """Word numbers that make a document periodic where 10 divides its CRC-32; one without an id stays as it is."""
    at = np.arange(int(sizes.sum()))
    for doc, n, start in zip(doc_ids, sizes.tolist(), (np.cumsum(sizes) - sizes).tolist()):
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[start + a:start + n] = start + a + np.arange(n - a) % p
    return at


def runs_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the run of the greatest exponent."""
    rows = collapsed(docs, planted)
    best = F.reduce("runs", F.get("runs", F.lit(0)),
                    lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), ""), 256).alias("runs_sha256"),
                       F.sha2("text", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
