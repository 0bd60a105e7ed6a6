"""Hidden-state market regimes on hourly bars.

One sequence is one (symbol, split) of hourly bars. Its length is bounded by the training window (some 4,000
hours for 180 days), so a sequence fits a task; Spark spreads the many sequences.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions.columns import clip, cols
from tidebar.operators.align import attach_regime
from tidebar.operators.execution import ExecutionSettings, recompute_pnl
from tidebar.plans.blocks import Blocks, block_window, halo, measure, trim
from tidebar.plans.frames import FrameAggs

FEATURES = ("log_return", "volume_z", "range_pct", "skew_5", "momentum_10")
STATES = 4
LABELS = {0: "LowVol_Bullish", 1: "LowVol_Range", 2: "HighVol_Correction", 3: "HighVol_Expansion"}
MIN_TRAIN_HOURS = 240
RETRAIN_HOURS = 120
REGIME_COLUMNS = tuple(f"hmm_regime_{i}" for i in range(STATES))
LOOKBACK = 75
_EPS = 1e-9


def regime_feature_columns(df: DataFrame, window: WindowSpec, z_window: int = 60, min_samples: int = 30) -> DataFrame:
    """Five hourly features, bounded to +/-50, then z-scored against the rows before (population deviation)."""
    kept = df.columns
    df = df.withColumns({"_lc": F.ln("close"), "_v": F.col("volume").cast("double")})
    df = df.withColumns({"_lr": F.col("_lc") - F.lag("_lc").over(window), "_mo": F.col("_lc") - F.lag("_lc", 10).over(window)})
    aggs = FrameAggs(window)
    vz = (F.col("_v") - aggs.get("mean", "_v", 20, 5, True)) / (aggs.get("std", "_v", 20, 5, True) + _EPS)
    z = (F.col("_lr") - aggs.get("mean", "_lr", 5, 3)) / (aggs.get("std", "_lr", 5, 3) + _EPS)
    df = aggs.apply(df).withColumns({"_vz": vz, "_z3": z * z * z})
    cubed = FrameAggs(window)
    skew = cubed.get("mean", "_z3", 5, 3)
    df = cubed.apply(df)
    raw = {"log_return": F.col("_lr"), "volume_z": F.col("_vz"),
           "range_pct": (F.col("high") - F.col("low")) / (F.col("close") + _EPS), "skew_5": skew, "momentum_10": F.col("_mo")}
    df = df.withColumns({f"_f_{n}": clip(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), -50.0, 50.0) for n, x in raw.items()})
    past = window.rowsBetween(-(z_window - 1), -1)
    df = df.withColumn("_k", F.count(F.lit(1)).over(past))
    df = df.withColumns({**{f"_m_{n}": F.avg(f"_f_{n}").over(past) for n in FEATURES},
                         **{f"_s_{n}": F.stddev_pop(f"_f_{n}").over(past) for n in FEATURES}})
    scaled = []
    for n in FEATURES:
        sd = F.when(F.col(f"_s_{n}") < _EPS, F.lit(1.0)).otherwise(F.col(f"_s_{n}"))
        value = (F.col(f"_f_{n}") - F.col(f"_m_{n}")) / sd
        scaled.append(F.when(F.col("_k") >= min_samples, value).otherwise(F.lit(0.0)).alias(n))
    return df.select(*cols(kept), *scaled)


def add_regime_features(hourly: DataFrame, keys: Sequence[str] = ("symbol",), blocks: Blocks | None = None) -> DataFrame:
    return trim(regime_feature_columns(halo(hourly, blocks or measure(hourly, keys), lookback=LOOKBACK), block_window(keys)))


def _log_emission(x, means, variances):
    var = variances + 1e-10
    return -0.5 * (np.log(2 * np.pi * var).sum(1) + ((x[:, None, :] - means) ** 2 / var).sum(2))


def _em(x: np.ndarray, seed: int, states: int, tol: float, iterations: int):
    """Baum-Welch with scaled forward-backward; returns start, transition, means, variances."""
    rng = np.random.default_rng(seed)
    start = np.full(states, 1.0 / states)
    trans = np.full((states, states), 0.3 / (states - 1))
    np.fill_diagonal(trans, 0.7)
    means = np.quantile(x, np.linspace(0.1, 0.9, states), axis=0)
    means = means + rng.normal(0, 0.01, means.shape) * x.std(axis=0)
    variances = np.tile(x.var(axis=0) + 1e-6, (states, 1))
    n, last = len(x), -np.inf
    for _ in range(iterations):
        log_b = _log_emission(x, means, variances)
        top = log_b.max(axis=1, keepdims=True)
        b = np.exp(log_b - top)
        alpha, beta, scale = np.empty((n, states)), np.ones((n, states)), np.empty(n)
        for t in range(n):
            row = (start if t == 0 else alpha[t - 1] @ trans) * b[t]
            scale[t] = max(row.sum(), 1e-300)
            alpha[t] = row / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = trans @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        likelihood = float(np.log(scale).sum() + top.sum())
        if abs(likelihood - last) < tol:
            break
        last = likelihood
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        pair = trans * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
        start = gamma[0]
        trans = np.clip(pair / pair.sum(axis=1, keepdims=True), 1e-10, 1.0)
        trans /= trans.sum(axis=1, keepdims=True)
        weight = gamma.sum(axis=0)[:, None]
        means = gamma.T @ x / weight
        variances = np.stack([(gamma[:, [k]] * (x - means[k]) ** 2).sum(0) / weight[k] for k in range(states)])
        variances = np.clip(variances, 1e-8, None)
    return start, trans, means, variances


def label_states(means: Sequence[float], variances: Sequence[float]) -> list[int]:
    """Canonical regime of each latent state from its return mean and variance."""
    mean, var = np.asarray(means), np.asarray(variances)
    scale, mid = max(np.abs(mean).max(), 1e-6), np.median(var)
    quiet, wild = var < mid, var > mid
    rules = [(0, quiet & (mean > 0.3 * scale), mean), (1, quiet & (np.abs(mean) < 0.2 * scale), -np.abs(mean)),
             (2, wild & (mean < -0.1 * scale), -mean), (3, wild & (mean > 0.1 * scale), mean)]
    fallback = {0: mean - var, 1: -np.abs(mean), 2: -mean, 3: mean + var}
    label: dict[int, int] = {}

    def assign(regime, candidates, score):
        free = [i for i in candidates if i not in label]
        if free:
            label[max(free, key=lambda i: score[i])] = regime

    for regime, mask, score in rules:
        assign(regime, np.flatnonzero(mask), score)
    for regime in [r for r in range(len(mean)) if r not in label.values()]:
        assign(regime, range(len(mean)), fallback[regime])
    return [label.get(i, 1) for i in range(len(mean))]


MODEL_FIELDS = ("start array<double>, transition array<double>, means array<double>, variances array<double>, "
                "labels array<int>, train_hours int, fallback boolean")


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keys)


def fit_regimes(features: DataFrame, keys: Sequence[str] = ("symbol", "split_id"), min_hours: int = MIN_TRAIN_HOURS,
                seed: int = 42, retries: int = 3, tol: float = 1e-4, iterations: int = 100) -> DataFrame:
    """One model row per sequence; too few hours or failed fits give a row with `fallback` true."""
    keys = list(keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts_event")[list(FEATURES)].to_numpy(dtype=np.float64)
        key = [pdf[c].iloc[0] for c in keys]
        model = None
        for attempt in range(retries if len(x) >= max(min_hours, 3 * STATES) else 0):
            found = _em(x, seed + 100 * attempt, STATES, tol, iterations)
            if all(np.isfinite(p).all() for p in found):
                model = found
                break
        parts = [None] * 5 if model is None else [*[p.ravel() for p in model], label_states(model[2][:, 0], model[3][:, 0])]
        return pd.DataFrame([[*key, *parts, len(x), model is None]],
                            columns=[*keys, "start", "transition", "means", "variances", "labels", "train_hours", "fallback"])

    return (features.select(*keys, "ts_event", *FEATURES).groupBy(*keys)
            .applyInPandas(fit, f"{_key_schema(features, keys)}, {MODEL_FIELDS}"))


def _per_sequence(features: DataFrame, models: DataFrame, keys: list[str], fields: str, step) -> DataFrame:
    """Run `step(x, model) -> columns` on each sequence next to its model row."""
    schema = f"{_key_schema(features, keys)}, ts_event timestamp, {fields}"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts_event")
        if rows.empty:
            return pd.DataFrame(columns=[*keys, "ts_event", *names])
        x = rows[list(FEATURES)].to_numpy(dtype=np.float64)
        usable = len(model) and not model["fallback"].iloc[0]
        out = rows[[*keys, "ts_event"]].reset_index(drop=True)
        values = step(x, model.iloc[0] if usable else None)
        return pd.concat([out, pd.DataFrame(values, columns=names)], axis=1)

    left = features.select(*keys, "ts_event", *FEATURES).groupBy(*keys)
    return left.cogroup(models.groupBy(*keys)).applyInPandas(run, schema)


def _parameters(model):
    k, d = STATES, len(FEATURES)
    return (np.asarray(model["start"]), np.asarray(model["transition"]).reshape(k, k),
            np.asarray(model["means"]).reshape(k, d), np.asarray(model["variances"]).reshape(k, d))


def filter_regimes(features: DataFrame, models: DataFrame, keys: Sequence[str] = ("symbol", "split_id")) -> DataFrame:
    """Causal state probabilities in canonical order; a transition precedes the first observation. Sequences
    without a usable model get equal probabilities."""

    def step(x, model):
        if model is None:
            return np.full((len(x), STATES), 1.0 / STATES)
        start, trans, means, variances = _parameters(model)
        log_b = _log_emission(x, means, variances)
        b = np.exp(log_b - log_b.max(axis=1, keepdims=True))
        out, p = np.zeros((len(x), STATES)), start
        for t in range(len(x)):
            p = (p @ trans) * b[t]
            p = p / max(p.sum(), 1e-300)
            for latent, regime in enumerate(model["labels"]):
                out[t, regime] = p[latent]
        return out

    return _per_sequence(features, models, list(keys), ", ".join(f"{c} double" for c in REGIME_COLUMNS), step)


def decode_regimes(features: DataFrame, models: DataFrame, keys: Sequence[str] = ("symbol", "split_id")) -> DataFrame:
    """Most likely latent state path of each sequence (NULL without a model)."""

    def step(x, model):
        if model is None:
            return np.full((len(x), 1), None, dtype=object)
        start, trans, means, variances = _parameters(model)
        log_b, log_t = _log_emission(x, means, variances), np.log(trans + 1e-300)
        delta, back = np.log(start + 1e-300) + log_b[0], np.zeros((len(x), STATES), dtype=int)
        for t in range(1, len(x)):
            scores = delta[:, None] + log_t
            back[t] = scores.argmax(axis=0)
            delta = scores.max(axis=0) + log_b[t]
        path = np.empty((len(x), 1), dtype=int)
        path[-1] = delta.argmax()
        for t in range(len(x) - 2, -1, -1):
            path[t] = back[t + 1, path[t + 1, 0]]
        return path

    return _per_sequence(features, models, list(keys), "state int", step)


def dominant_regime() -> Column:
    """Index of the largest regime probability; the first one wins a tie."""
    probs = [F.col(c) for c in REGIME_COLUMNS]
    return (F.array_position(F.array(*probs), F.greatest(*probs)) - 1).cast("int")


def add_trade_gate(df: DataFrame, allowed: Sequence[int] = (0, 3), prohibited: Sequence[int] = (2,), name: str = "hmm_trade_gate") -> DataFrame:
    """True where the dominant regime is allowed and not prohibited; all true without regime columns."""
    if not set(REGIME_COLUMNS) <= set(df.columns):
        return df.withColumn(name, F.lit(True))
    top = dominant_regime()
    ok = ~top.isin(list(prohibited)) if prohibited else F.lit(True)
    if allowed:
        ok = ok & top.isin(list(allowed))
    return df.withColumn(name, ok)


def apply_regime_gate(df: DataFrame, gate: str = "hmm_trade_gate") -> DataFrame:
    if gate not in df.columns:
        return df
    return df.withColumn("target_exec", F.when(F.col(gate), F.col("target_exec")).otherwise(F.lit(0.0)))


def model_fold(splits: DataFrame, every: int = 1) -> Column:
    """Fold whose model a fold uses when models are retrained every `every` folds."""
    return (F.floor(F.col("split_id") / every) * every).cast("int")


def due_for_retrain(hours_per_fold: Column, limit: int = RETRAIN_HOURS, keys: Sequence[str] = ("symbol",)) -> Column:
    """True once the hours seen since the first fold pass another multiple of `limit`. Folds are few per symbol."""
    order = Window.partitionBy(*keys).orderBy("split_id")
    seen = F.sum(hours_per_fold).over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(hours_per_fold).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.floor(seen / limit) > F.floor(before / limit)


def gate_backtest(result: DataFrame, train_hours: DataFrame, test_hours: DataFrame, settings: ExecutionSettings = ExecutionSettings(),
                  keys: Sequence[str] = ("symbol", "split_id"), retrain_every: int = 1, blocks: Blocks | None = None, **fit) -> DataFrame:
    """Fit regimes on train hours, filter the test hours, bridge to base bars, gate orders and redo the PnL."""
    keys = list(keys)
    models = fit_regimes(add_regime_features(train_hours, keys).filter(F.col("split_id") == model_fold(train_hours, retrain_every)), keys, **fit)
    if retrain_every > 1:
        folds = test_hours.select(*keys).distinct().withColumn("_fold", model_fold(test_hours, retrain_every))
        models = folds.join(models.withColumnRenamed("split_id", "_fold"), ["symbol", "_fold"], "left").drop("_fold").withColumn(
            "fallback", F.coalesce("fallback", F.lit(True)))
    probs = filter_regimes(add_regime_features(test_hours, keys), models, keys)
    sides = [d.withColumn("symbol", F.concat_ws("\u0001", "symbol", F.col("split_id").cast("string"))) for d in (result, probs)]
    bridged = attach_regime(sides[0], sides[1]).withColumn("symbol", F.split("symbol", "\u0001")[0])
    return recompute_pnl(apply_regime_gate(add_trade_gate(bridged)), settings, keys, blocks)
