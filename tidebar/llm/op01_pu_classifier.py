"""Quality classifier from positive and unlabelled text: minimises the non-negative unbiased risk.

Trusted positives are labelled good; every text counts as unlabelled, whatever its label, so no negative label is read.
With class prior p the risk of a score g is  p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])  (l: logistic loss). The prior
is estimated from score histograms of all positives and all unlabelled rows: the ratios of their upper tails. Each
Newton step sums gradients and curvatures in the tasks; the driver only sees numbers of the size of the feature vector.

Features are byte and word statistics of whole texts. Defined results: a null text counts as empty; an empty text is
scored like any other; texts of any length are read whole; a repeated doc_id in the labels counts once, as good if any row
says so; rows with a null doc_id are scored but not learned from; without positives the score is the prior guess; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import keep_rows, text_of, written

#: Rows drawn per fit, at most about this many; the prior and all statistics use every row.
FIT_ROWS = 1_000_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
BINS = 200
MARKS = [ord(c) for c in string.punctuation]
GROUPS = {"upper": string.ascii_uppercase, "lower": string.ascii_lowercase, "digit": string.digits, "space": " \t\r\x0b\x0c", "line": "\n"}
SIZE = len(MARKS) + len(GROUPS) + 1 + 9


def features(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    x = np.zeros(SIZE)
    if not raw:
        return x
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, lengths = max(len(words), 1), np.fromiter(map(len, words), np.int64, len(words))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [v for v in raw.split(b"\n") if v.strip()]
    k = len(MARKS)
    x[:k] = np.log1p(20 * counts[MARKS] / n)
    for name in GROUPS:
        x[k] = counts[[ord(c) for c in GROUPS[name]]].sum() / len(raw)
        k += 1
    x[k] = counts[128:].sum() / len(raw)
    x[k + 1:] = (np.log(len(words) + 1), distinct / n, pairs / n, same / n, (lengths.mean() if len(words) else 0) / 10,
                 (lengths.std() if len(words) else 0) / 10, len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)),
                 np.log1p(lengths.max() if len(words) else 0))
    return x


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x)"""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch["text"].to_pylist()]
            flat = np.concatenate(rows).astype(np.float32) if rows else np.zeros(0, np.float32)
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SIZE), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], x], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(task, "doc_id long, x array<float>")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


@dataclass
class Model:
    weights: np.ndarray  # on standardised features, intercept last
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_padded(x, self.mean, self.scale) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _padded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, SIZE)


def _summed(rows: DataFrame, size: int, sums) -> np.ndarray:
    """Sum of the vectors that `sums` makes of every batch; parts are added by Spark, a vector reaches the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += sums(_matrix(batch), batch["good"].to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    parts = rows.mapInArrow(task, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[parts["i"]] = parts["v"]
    return out


def _standard(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    got = _summed(rows, 2 * SIZE + 2, lambda x, good: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), good.sum()]]))
    n, positives = got[-2:]
    mean = got[:SIZE] / max(n, 1)
    spread = np.sqrt(np.maximum(got[SIZE:2 * SIZE] / max(n, 1) - mean ** 2, 0))
    return mean, np.where(spread > 1e-6, spread, 1.0), n, positives


def _fit(rows: DataFrame, mean, scale, prior: float, steps: int, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps on the non-negative risk, the best of several step lengths each; one job a step."""
    d = SIZE + 1

    def passes(candidates: np.ndarray):
        def sums(x: np.ndarray, good: np.ndarray) -> np.ndarray:
            z = _padded(x, mean, scale)
            out = []
            for w in candidates:
                g = z @ w
                s, p = _sigmoid(g), z[good]
                out += [[len(z), good.sum(), np.logaddexp(0, g).sum(), np.logaddexp(0, g[good]).sum(), np.logaddexp(0, -g[good]).sum()],
                        s @ z, s[good] @ p, p.sum(0), ((z * (s * (1 - s))[:, None]).T @ z).ravel(), ((p * (s * (1 - s))[good][:, None]).T @ p).ravel()]
            return np.concatenate(out)
        return sums

    size = 5 + 3 * d + 2 * d * d
    candidates, best, chosen = np.zeros((1, d)), None, np.zeros(d)
    for _ in range(steps):
        got = _summed(rows, size * len(candidates), passes(candidates)).reshape(len(candidates), size)
        trial = None
        for w, v in zip(candidates, got):
            n_u, n_p = np.maximum(v[:2], 1)
            negative = v[2] / n_u - prior * v[3] / n_p
            risk = prior * v[4] / n_p + max(0.0, negative) + ridge * w @ w / 2
            if np.isfinite(risk) and (trial is None or risk < trial[0]):
                trial = (risk, w, v, negative)
        if trial is None or best is not None and trial[0] > best - 1e-7:
            break
        best, w, v, negative = trial
        n_u, n_p = np.maximum(v[:2], 1)
        su, sp, xp = v[5:5 + d] / n_u, v[5 + d:5 + 2 * d] / n_p, v[5 + 2 * d:5 + 3 * d] / n_p
        hu, hp = (v[5 + 3 * d + k * d * d:5 + 3 * d + (k + 1) * d * d].reshape(d, d) / n for k, n in ((0, n_u), (1, n_p)))
        if negative >= 0:
            slope, curve = su - prior * xp, hu
        else:  # the clamped part no longer pulls: only the positives' loss is left
            slope, curve = prior * (sp - xp), prior * hp
        step = np.linalg.solve(curve + (ridge + 1e-6) * np.eye(d), slope + ridge * w)
        candidates = np.array([w - a * step for a in (1.0, 0.5, 0.2, 0.05)])
        chosen = w
    return chosen


def class_prior(rows: DataFrame, model: Model, doubt: float = 2.0) -> float:
    """Share of positives among all rows, from the upper tails of unlabelled and positive scores over every row.

    Above any score the unlabelled tail is at least prior times the positives' tail, so every ratio of the two bounds the prior
    and shows a share of negatives. One standard error is added to it, as a prior that is too high makes bad texts look good, and
    it is weighed by how many errors it is away from none (a half at `doubt` errors). The largest weighed share counts. The rule
    has no threshold: few rows weaken a share bit by bit, and many leave it whole.
    """

    def sums(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        at = np.minimum((model.scores(x) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[good], minlength=BINS)]).astype(float)

    got = _summed(rows, 2 * BINS, sums)
    every, good = (np.cumsum(h[::-1]) for h in (got[:BINS], got[BINS:]))
    n, n_p = max(every[-1], 1), max(good[-1], 1)
    enough = good >= max(0.1 * n_p, 1)
    if not enough.any():
        return 0.5
    u, p = (every / n)[enough], (good / n_p)[enough]
    ratio = u / p
    error = (np.sqrt(u * (1 - u) / n) + ratio * np.sqrt(p * (1 - p) / n_p)) / p
    negatives = np.maximum(1 - ratio, 0)
    weight = (negatives / np.maximum(error, 1e-9)) ** 4
    shares = (negatives + error) * weight / (weight + doubt ** 4)
    return float(np.clip(1 - shares.max(), 0.05, 0.999))


def fit(features_of: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, steps: int = 16) -> Model:
    """Learn from the rows that are not held out. `features_of`: (doc_id, x); `labels`: (doc_id, quality)."""
    known = (labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
             .withColumn("good", F.lit(True)))
    rows = written(features_of.filter(F.col("doc_id").isNotNull() & ~held_out()).join(known, "doc_id", "left")
                   .select("doc_id", "x", F.coalesce("good", F.lit(False)).alias("good")), "pu-rows")
    mean, scale, n, positives = _standard(rows)
    if not positives:
        return Model(np.zeros(SIZE + 1), mean, scale, 0.5)
    share = int(min(1.0, fit_rows / n) * (1 << 30))
    drawn = rows if share == 1 << 30 else rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # the prior is read off rows that its scores were not fitted on
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    first = Model(_fit(drawn.filter(half), mean, scale, 0.5, steps), mean, scale, 0.5)
    prior = class_prior(rows.filter(~half), first)
    return Model(_fit(drawn, mean, scale, prior, steps), mean, scale, prior)


def score(features_of: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.scores(_matrix(batch)))], ["doc_id", "score"])

    return features_of.mapInArrow(task, "doc_id long, score double")


def scored_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; texts are read once."""
    table = written(with_features(docs.select("doc_id", "text")), "pu-features")
    model = fit(table, labels, fit_rows)
    return score(table, model).select("doc_id", held_out().alias("held_out"), "score",
                                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that the classifier, fitted on them, accepts; columns as in `docs`. Texts are scored where they lie."""
    model = fit(with_features(docs.select("doc_id", "text")), labels)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts]).reshape(-1, SIZE)))

    return keep_rows(docs, lambda d: d.withColumn("good", scored(text_of()) >= threshold), "good")
