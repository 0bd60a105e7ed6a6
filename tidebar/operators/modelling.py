"""Feature filters, robust scaling, ridge and MLlib models, smoothing, meta gate, walk-forward evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions.columns import clip, expit
from tidebar.operators.engine import require_passed
from tidebar.operators.execution import ExecutionSettings, add_benchmark, recompute_pnl, simulate_execution
from tidebar.operators.splits import assign_folds, bar_folds, check_predictions, check_train_test, exclude_warmup, label_minutes
from tidebar.operators.targets import add_meta_label
from tidebar.plans.blocks import Blocks, _small, measure, positions
from tidebar.plans.checkpoints import checkpointed
from tidebar.plans.order_stats import GROUP_ROWS, exact_quantiles, largest_group


def variance_filter(df: DataFrame, features: Sequence[str], threshold: float = 1e-9) -> list[str]:
    """Features whose population variance exceeds the threshold; all of them if none does or rows <= 1."""
    features = list(features)
    if not features:
        return []
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in features]).first()
    kept = [c for c in features if row["n"] > 1 and row[c] is not None and row[c] > threshold]
    return kept or features


#: Up to this many columns the pairs of columns are aggregates of one plan.
AGGREGATE_COLUMNS = 8


def _filled(df: DataFrame, columns: Sequence[str], keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows with all keys; the columns as doubles under `names`, null as 0."""
    return df.filter(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))).select(
        *keys, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(n) for c, n in zip(columns, names)])


def _narrow_gram(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`gram` by covariance aggregates."""
    names = [f"_v{i}" for i in range(len(columns))]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = _filled(df, columns, keys, names).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), *[F.avg(c).alias(f"_mean{c}") for c in names],
        *[(F.var_pop(a) if a == b else F.covar_pop(a, b)).alias(f"_c{a}{b}") for a, b in pairs])
    n = F.col("_n")
    return sums.select(*keys, F.array(n, *[F.lit(0.0) for _ in names], *[F.col(f"_c{a}{b}") * n for a, b in pairs]).alias("gram"),
                       F.array(*[F.col(f"_mean{c}") for c in names]).alias("centre"))


def gram(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per key the upper triangle of [1, x - c]'[1, x - c] as one array, and the means c as another.

    Few columns are Spark's own covariance aggregates: one hash aggregate for any number of keys, combined in the tasks before
    the shuffle, so a key with most of the rows is split like its input. For many columns tasks reduce their rows as they lie to
    (count, means, co-moments about those means), one set per key, and cells of the triangle are merged by Spark, each about its
    own mean. Either way the input is read once, nothing is joined and sums of squares stay exact for values far from zero. The
    result is k*k numbers per key; rows with a null key belong to no model.
    """
    keys, columns = list(keys), list(columns)
    if len(columns) <= AGGREGATE_COLUMNS:
        return _narrow_gram(df, columns, keys)
    k = len(columns) + 1
    rows, cols = np.triu_indices(k)
    schema = T.StructType([df.schema[c] for c in keys] + [T.StructField("_pos", T.IntegerType())]
                          + [T.StructField(c, T.DoubleType()) for c in ("_n", "_left", "_right", "_c")])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: dict[tuple, tuple[float, np.ndarray, np.ndarray]] = {}

        def flush():
            for key, (n, mean, comoment) in parts.items():
                with_one = np.concatenate([[1.0], mean])
                cells = pd.DataFrame({"_pos": np.arange(len(rows), dtype=np.int32), "_n": n, "_left": with_one[rows], "_right": with_one[cols],
                                      "_c": np.pad(comoment, ((1, 0), (1, 0)))[rows, cols]})
                for i, name in enumerate(keys):
                    cells.insert(i, name, [key[i]] * len(rows))
                yield cells
            parts.clear()

        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                x = group[names].to_numpy(dtype=np.float64)
                n, mean = float(len(x)), x.mean(axis=0)
                x = x - mean
                comoment = x.T @ x
                if key in parts:
                    n0, mean0, comoment0 = parts[key]
                    step = mean - mean0
                    comoment = comoment0 + comoment + np.outer(step, step) * (n0 * n / (n0 + n))
                    mean, n = mean0 + step * (n / (n0 + n)), n0 + n
                parts[key] = (n, mean, comoment)
            if len(parts) > 256:
                yield from flush()
        yield from flush()

    names = [f"_v{i}" for i in range(len(columns))]
    values = _filled(df, columns, keys, names)
    cell = Window.partitionBy(*keys, "_pos")
    near = {f"_near{c}": F.min(c).over(cell) for c in ("_left", "_right")}  # means of parts, taken from a point among them
    left, right = F.col("_left") - F.col("_near_left"), F.col("_right") - F.col("_near_right")
    n, l, r = F.sum("_n"), F.sum(F.col("_n") * left), F.sum(F.col("_n") * right)
    merged = (values.mapInPandas(partial, schema).withColumns(near).groupBy(*keys, "_pos").agg(
        n.alias("_n"), (F.sum("_c") + F.sum(F.col("_n") * left * right) - l * r / n).alias("_c"),
        (F.first("_near_right") + r / n).alias("_mean")))
    value = F.when(F.col("_pos") == 0, F.col("_n")).when(F.col("_pos") < k, F.lit(0.0)).otherwise(F.col("_c"))
    cells = F.array_sort(F.collect_list(F.struct("_pos", value.alias("_value"), "_mean")))
    return (merged.groupBy(*keys).agg(cells.alias("_cells"))
            .select(*keys, F.col("_cells._value").alias("gram"), F.slice(F.col("_cells._mean"), 2, k - 1).alias("centre")))


def _square_of(cells, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = np.asarray(cells, dtype=np.float64)
    return m + np.triu(m, 1).T


def _correlations(cells, centre) -> np.ndarray:
    """NaN for a column whose spread is within rounding of its mean."""
    m = _square_of(cells, len(centre) + 1)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    sd[sd <= 1e-14 * np.abs(np.asarray(centre, dtype=np.float64))] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(sd, sd)


def _kept_in_order(corr: np.ndarray, threshold: float) -> list[int]:
    kept: list[int] = []
    for i in range(len(corr)):
        if not any(abs(corr[j, i]) > threshold for j in kept):
            kept.append(i)
    return kept


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """k x k Pearson matrix; only k*k sums reach the driver."""
    one = gram(df.withColumn("_all", F.lit(1)), features, ["_all"]).first()
    return _correlations(one["gram"], one["centre"])


def correlation_kept(df: DataFrame, features: Sequence[str], keys: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """(keys, kept): per key the features that the greedy pruning keeps, as in `correlation_prune`."""
    features = list(features)

    @F.pandas_udf("array<string>")
    def chosen(grams: pd.Series, centres: pd.Series) -> pd.Series:
        return pd.Series([[features[i] for i in _kept_in_order(_correlations(*x), threshold)] for x in zip(grams, centres)])

    return gram(df, features, keys).select(*keys, chosen("gram", "centre").alias("kept"))


def correlation_prune(df: DataFrame, features: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Keep features in order; each kept one drops later features correlated beyond the threshold."""
    features = list(features)
    if not features:
        return []
    return [features[i] for i in _kept_in_order(correlation_matrix(df, features), threshold)]


def robust_stats(train: DataFrame, features: Sequence[str], keys: Sequence[str], min_variance: float = 1e-8, **limits) -> DataFrame:
    """Per key arrays of feature medians and inverse interquartile ranges (floored at 0.01).

    While the largest key holds few values, counted first, one aggregate per key gives all features. Above that, features are
    unpivoted so each (key, feature) is its own group for the exact quantile. A feature with (almost) no variance in a key gets
    scale 0, which takes it out of that key's model, unless none varies.
    """
    keys, features = list(keys), list(features)
    if largest_group(train, keys) * len(features) <= limits.get("group_rows", GROUP_ROWS):
        quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        sums = train.filter(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))).groupBy(*keys).agg(
            *[F.percentile(bounded_input(F.col(f"`{c}`")), quarters).alias(f"_q{i}") for i, c in enumerate(features)],
            *[F.var_pop(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))).alias(f"_v{i}") for i, c in enumerate(features)])
        parts = [F.struct(F.col(f"_q{i}")[1].alias("m"), _scale(F.col(f"_q{i}")).alias("s"), F.col(f"_v{i}").alias("v")) for i in range(len(features))]
        return _kept_scales(sums.select(*keys, F.array(*parts).alias("_f")), keys, min_variance)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias("raw"),
                                         bounded_input(F.col(f"`{c}`")).alias("v")) for i, c in enumerate(features)]))
    long = train.select(*keys, cells.alias("_c")).select(*keys, F.col("_c.i").alias("_feature"), F.col("_c.v").alias("_x"), F.col("_c.raw").alias("_raw"))
    by = [*keys, "_feature"]
    q = exact_quantiles(long, by, "_x", (0.25, 0.5, 0.75), **limits)
    spread = long.groupBy(*by).agg(F.var_pop("_raw").alias("_var"))
    arrays = (q.join(spread, by).select(*keys, "_feature", F.col("quantiles")[1].alias("m"), _scale(F.col("quantiles")).alias("s"), F.col("_var").alias("v"))
              .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_feature", "m", "s", "v"))).alias("_f")))
    return _kept_scales(arrays, keys, min_variance)


def _scale(quarters: Column) -> Column:
    return 1.0 / F.greatest(quarters[2] - quarters[0], F.lit(0.01))


def _kept_scales(arrays: DataFrame, keys: Sequence[str], min_variance: float) -> DataFrame:
    none_varies = ~F.exists("_f.v", lambda v: v > min_variance)
    kept = F.transform("_f", lambda f: F.when(none_varies | (f["v"] > min_variance), f["s"]).otherwise(F.lit(0.0)))
    return arrays.select(*keys, F.col("_f.m").alias("medians"), kept.alias("scales"))


def bounded_input(x: Column) -> Column:
    """Null or NaN to 0, then bounded to +/-8."""
    x = F.coalesce(x.cast("double"), F.lit(0.0))
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(clip(x, -8.0, 8.0))


def robust_scale(df: DataFrame, stats: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(x - median) / iqr, bounded to +/-10 and then +/-4."""
    scaled = {c: clip((bounded_input(F.col(f"`{c}`")) - F.col("medians")[i]) * F.col("scales")[i], -4.0, 4.0)
              for i, c in enumerate(features)}
    return df.join(stats, list(keys)).withColumns(scaled).drop("medians", "scales")


def stable_target(y: Column) -> Column:
    y = y.cast("double")
    finite = y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    return F.when(finite, clip(y, -1.0, 1.0)).otherwise(F.lit(0.0))


def ridge_fit(train: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """Per key ridge coefficients with an unpenalised intercept, solved from the k*k sums of that key."""
    k = len(features) + 2

    @F.pandas_udf("coefficients array<double>, intercept double")
    def solve(grams: pd.Series, centres: pd.Series) -> pd.DataFrame:
        rows = []
        for cells, centre in zip(grams, centres):
            m = _square_of(cells, k)
            mean = m[0, 1:] / m[0, 0]
            at = mean + centre
            centred = m[1:, 1:] - m[0, 0] * np.outer(mean, mean)
            a = centred[:-1, :-1] + alpha * np.eye(k - 2)
            beta = np.linalg.solve(a, centred[:-1, -1])
            rows.append((beta, at[-1] - at[:-1] @ beta))
        return pd.DataFrame(rows, columns=["coefficients", "intercept"])

    sums = gram(train, [*features, target], keys)
    return sums.withColumn("_fit", solve("gram", "centre")).select(*keys, "_fit.coefficients", "_fit.intercept")


def linear_predict(df: DataFrame, model: DataFrame, features: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])
    dot = F.aggregate(F.zip_with(x, F.col("coefficients"), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return df.join(model, list(keys)).withColumn(name, dot + F.col("intercept")).drop("coefficients", "intercept")


def probability(raw: Column, scale: float = 100.0) -> Column:
    return clip(expit(clip(raw * scale, -2.0, 2.0)), 0.05, 0.95)


def ridge_probabilities(train: DataFrame, test: DataFrame, features: Sequence[str], target: str,
                        keys: Sequence[str] = ("symbol", "split_id"), alpha: float = 1.0, scale: float = 100.0) -> DataFrame:
    """Scale on train statistics, fit one ridge per key, add `prediction_prob` to test; all keys in one job."""
    stats = robust_stats(train, features, keys)
    fitted = ridge_fit(robust_scale(train, stats, features, keys).withColumn("_y", stable_target(F.col(target))), features, "_y", keys, alpha)
    inputs = test.withColumns({f"_x{i}": F.col(f"`{c}`") for i, c in enumerate(features)})
    names = [f"_x{i}" for i in range(len(features))]
    scaled = robust_scale(inputs, stats, names, keys)
    predicted = linear_predict(scaled, fitted, names, keys, "_raw")
    return predicted.withColumn("prediction_prob", probability(F.col("_raw"), scale)).drop("_raw", *names)


#: Keys of up to this many rows are fitted in one task each.
LOCAL_ROWS = 100_000
#: Intercepts that stand for keys with one class, 0 or 1.
ONE_CLASS = (math.log(0.05 / 0.95), math.log(0.95 / 0.05))


def _logistic_sums(x: np.ndarray, y: np.ndarray, trial: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper triangle of the curvature at a trial point; the last column of x is one."""
    z = x @ trial
    p = np.exp(-np.logaddexp(0.0, -z))
    return np.concatenate([[np.sum(np.logaddexp(0.0, z) - y * z)], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x)[np.triu_indices(x.shape[1])]])


def _newton_step(sums, trial, best, way, scale: float, before: float, penalty: np.ndarray, tolerance: float) -> tuple:
    """The next (trial, best, way, scale, loss, done): half the step if the trial raised the loss, else a step from there."""
    k = len(penalty)
    now = sums[0] + 0.5 * penalty @ (trial * trial)
    if now > before + 1e-12 * abs(before):
        return best + 0.5 * scale * way, best, way, 0.5 * scale, before, 0.5 * scale < 1e-9
    curvature = _square_of(sums[1 + k:], k) + np.diag(penalty)
    way = -np.linalg.lstsq(curvature, sums[1:1 + k] + penalty * trial, rcond=None)[0]
    return trial + way, trial, way, 1.0, now, bool(np.max(np.abs(way)) <= tolerance * (1.0 + np.max(np.abs(trial))))


def _logistic_local(rows: DataFrame, keys: list[str], names: list[str], penalty: np.ndarray, max_steps: int, tolerance: float) -> DataFrame:
    """`logistic_fit` of keys whose rows fit in one task."""
    k = len(penalty)
    weights = [f"_w{i}" for i in range(k)]

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        y = table["_y"].to_numpy()
        best = np.zeros(k)
        if y.mean() <= 0 or y.mean() >= 1:
            best[-1] = ONE_CLASS[int(y.mean() >= 1)]
        else:
            x = np.column_stack([*[table[c].to_numpy() for c in names], np.ones(len(y))])
            trial, way, scale, loss, done, steps = best, best, 1.0, math.inf, False, 0
            while not done and steps < max_steps:
                trial, best, way, scale, loss, done = _newton_step(_logistic_sums(x, y, trial), trial, best, way, scale, loss, penalty, tolerance)
                steps += 1
        return pa.table({**{c: pa.array([v.as_py()], v.type) for c, v in zip(keys, key)}, **{c: pa.array([v]) for c, v in zip(weights, best)}})

    schema = T.StructType([rows.schema[c] for c in keys] + [T.StructField(c, T.DoubleType()) for c in weights])
    fitted = rows.groupBy(*keys).applyInArrow(fit, schema)
    return fitted.select(*keys, F.array(*weights[:-1]).alias("coefficients"), F.col(weights[-1]).alias("intercept"))


def logistic_fit(train: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], alpha: float = 1.0,
                 max_steps: int = 50, tolerance: float = 1e-9, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Per key logistic coefficients (penalty alpha / 2 on squared coefficients, intercept free) by Newton steps.

    Keys of up to `local_rows` rows, counted first, take all their steps in one task each. The other keys step together, one job
    a step: tasks sum loss, gradient and curvature of their rows at each key's trial point, Spark adds the parts, and
    every key takes its next step or halves a step that raised its loss. Keys that have converged leave the later steps. The label
    is 0 or 1; null features and labels count as 0. A key with one class has no coefficients, its intercept stands for a
    probability of 0.05 or 0.95. Without a penalty separable classes have no optimum; the best point of the last step is returned.
    """
    keys, k = list(keys), len(features) + 1
    names = [f"_v{i}" for i in range(k - 1)]
    penalty = np.append(np.full(k - 1, float(alpha)), 0.0)
    rows = checkpointed(train.filter(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in keys))).select(
        *keys, F.coalesce(F.col(f"`{label}`").cast("double"), F.lit(0.0)).alias("_y"),
        *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(n) for c, n in zip(features, names)]))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > local_rows).select(*keys)
    n_long = sizes.count()
    if not n_long:
        return _logistic_local(rows, keys, names, penalty, max_steps, tolerance)
    long_keys = _small(sizes, n_long)
    local = _logistic_local(rows.join(long_keys, keys, "left_anti"), keys, names, penalty, max_steps, tolerance)
    rows = rows.join(long_keys, keys, "left_semi")
    schema = T.StructType([rows.schema[c] for c in keys] + [T.StructField("_pos", T.IntegerType()), T.StructField("_value", T.DoubleType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def flush():
            for key, cells in sums.items():
                yield pd.DataFrame({**{c: [v] * len(cells) for c, v in zip(keys, key)}, "_pos": np.arange(len(cells), dtype=np.int32), "_value": cells})
            sums.clear()

        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                x = np.column_stack([group[names].to_numpy(dtype=np.float64), np.ones(len(group))])
                part = _logistic_sums(x, group["_y"].to_numpy(dtype=np.float64), np.asarray(group["_trial"].iloc[0], dtype=np.float64))
                sums[key] = sums[key] + part if key in sums else part
            if len(sums) > 256:
                yield from flush()
        yield from flush()

    vector = "array<double>"

    @F.pandas_udf(f"_trial {vector}, _best {vector}, _way {vector}, _scale double, _loss double, _done boolean")
    def step(cells: pd.Series, trial: pd.Series, best: pd.Series, way: pd.Series, scale: pd.Series, loss: pd.Series) -> pd.DataFrame:
        out = [_newton_step(*(np.asarray(v, dtype=np.float64) for v in (c, t, b, w)), s, before, penalty, tolerance)
               for c, t, b, w, s, before in zip(cells, trial, best, way, scale, loss)]
        return pd.DataFrame(out, columns=["_trial", "_best", "_way", "_scale", "_loss", "_done"])

    fields = ("_trial", "_best", "_way", "_scale", "_loss")
    zero = F.array(*[F.lit(0.0)] * k)
    share = F.avg("_y")
    one_class = F.when(share <= 0, ONE_CLASS[0]).when(share >= 1, ONE_CLASS[1])
    state = checkpointed(rows.groupBy(*keys).agg(one_class.alias("_fixed")).select(
        *keys, zero.alias("_trial"), F.concat(F.array(*[F.lit(0.0)] * (k - 1)).cast(vector), F.array(F.coalesce("_fixed", F.lit(0.0)))).alias("_best"), zero.alias("_way"),
        F.lit(1.0).alias("_scale"), F.lit(float("inf")).alias("_loss"), F.col("_fixed").isNotNull().alias("_done")))
    for _ in range(max_steps):
        active = state.filter(~F.col("_done"))
        n = active.count()
        if not n:
            break
        sums = (rows.join(_small(active.select(*keys, "_trial"), n), keys).mapInPandas(partial, schema)
                .groupBy(*keys, "_pos").agg(F.sum("_value").alias("_value"))
                .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_value"))).alias("_cells"))
                .select(*keys, F.col("_cells._value").alias("_sums")))
        moved = active.drop("_done").join(_small(sums, n), keys).withColumn("_step", step("_sums", *fields)).select(*keys, "_step.*")
        state = checkpointed(state.filter("_done").unionByName(moved))
    return local.unionByName(state.select(*keys, F.slice("_best", 1, k - 1).alias("coefficients"), F.element_at("_best", k).alias("intercept")))


def logistic_probabilities(train: DataFrame, test: DataFrame, features: Sequence[str], target: str,
                           keys: Sequence[str] = ("symbol", "split_id"), alpha: float = 1.0) -> DataFrame:
    """Scale on train statistics, fit one logistic model of y > 0 per key, add `prediction_prob` to test."""
    stats = robust_stats(train, features, keys)
    labelled = robust_scale(train, stats, features, keys).withColumn("_y", (stable_target(F.col(target)) > 0).cast("double"))
    names = [f"_x{i}" for i in range(len(features))]
    inputs = test.withColumns({n: F.col(f"`{c}`") for n, c in zip(names, features)})
    predicted = linear_predict(robust_scale(inputs, stats, names, keys), logistic_fit(labelled, features, "_y", keys, alpha), names, keys, "_raw")
    return predicted.withColumn("prediction_prob", clip(expit(F.col("_raw")), 0.05, 0.95)).drop("_raw", *names)


def mllib_probabilities(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, model: str = "LogisticRegression",
                        seed: int = 42) -> DataFrame:
    """One split with a logistic or random-forest classifier of y > 0; a single-class train set gives its prior.

    Both fits are distributed by MLlib; call it per split.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    features = list(features)
    one = ["_one"]
    train, test = train.withColumn("_one", F.lit(1)), test.withColumn("_one", F.lit(1))
    stats = robust_stats(train, features, one)
    label = (stable_target(F.col(target)) > 0).cast("double")
    scaled = robust_scale(train, stats, features, one).withColumn("_label", label)
    counts = {r["_label"]: r["n"] for r in scaled.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        prior = next(iter(counts), 0.5)
        return test.withColumn("prediction_prob", F.lit(min(max(prior, 0.05), 0.95))).drop("_one")
    total = sum(counts.values())
    assembler = VectorAssembler(inputCols=features, outputCol="_vector")
    if model == "LogisticRegression":
        estimator = LogisticRegression(featuresCol="_vector", labelCol="_label", regParam=1.0 / total, standardization=False, maxIter=1000)
    elif model == "RandomForestClassifier":
        weight = F.when(F.col("_label") > 0, total / (2.0 * counts[1.0])).otherwise(total / (2.0 * counts[0.0]))
        scaled = scaled.withColumn("_weight", weight)
        estimator = RandomForestClassifier(featuresCol="_vector", labelCol="_label", weightCol="_weight", numTrees=200, maxDepth=3,
                                           minInstancesPerNode=100, featureSubsetStrategy="0.2", seed=seed)
    else:
        raise ValueError(f"unknown model {model!r}")
    fitted = estimator.fit(assembler.transform(scaled))
    kept = test.columns
    inputs = robust_scale(test.withColumns({f"_raw_{c}": F.col(f"`{c}`") for c in features}), stats, features, one)
    out = fitted.transform(assembler.transform(inputs))
    back = {c: F.col(f"`_raw_{c}`") for c in features}
    return (out.withColumn("prediction_prob", clip(vector_to_array("probability")[1], 0.05, 0.95)).withColumns(back)
            .select(*kept, "prediction_prob").drop("_one"))


def smooth_probabilities(df: DataFrame, alpha: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Exponential smoothing that restarts at 0.5 in each session; alpha is bounded to [0.2, 0.5], <= 0 is off.

    Within one session s(t) = d^t * 0.5 + sum alpha d^(t-i) p(i): a session is at most a day of bars, and
    terms older than 256 rows weigh less than 1e-24, so a bounded frame of weighted values is exact.
    """
    if alpha <= 0:
        return df
    alpha = min(max(alpha, 0.2), 0.5)
    decay, reach = 1.0 - alpha, 256
    window = Window.partitionBy(*keys, "session_id").orderBy("ts_event")
    p = clip(F.col("prediction_prob"), 0.1, 0.9)
    df = df.withColumns({"_s": p * alpha, "_n": F.row_number().over(window)})
    step = 1
    while step < reach:
        earlier = F.coalesce(F.lag("_s", step).over(window), F.lit(0.0))
        df = df.withColumn("_s", F.col("_s") + F.lit(decay ** step) * earlier)
        step *= 2
    return df.withColumn("prediction_prob", F.col("_s") + 0.5 * F.pow(F.lit(decay), F.col("_n"))).drop("_s", "_n")


def direction(prob: Column) -> Column:
    return F.when(prob > 0.55, 1).when(prob < 0.45, -1).otherwise(F.lit(0))


def meta_probabilities(train: DataFrame, result: DataFrame, features: Sequence[str], target: str,
                       keys: Sequence[str] = ("symbol", "split_id"), min_primary: int = 200, min_labels: int = 20) -> DataFrame:
    """Second-stage probability that the primary direction is right.

    The first third of train fits a primary model; the rest gives meta labels for a ridge on features plus
    direction. Keys without enough rows get NULL and are left ungated.
    """
    keys = list(keys)
    sizes = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    numbered = positions(train, measure(train, keys)).join(sizes, keys).withColumn(
        "_cut", F.greatest(F.floor(F.col("_rows") / 3), F.lit(20)))
    usable = numbered.filter((F.col("_rows") >= 40) & (F.col("_cut") >= min_primary))
    first, rest = usable.filter(F.col("_rn") <= F.col("_cut")), usable.filter(F.col("_rn") > F.col("_cut"))
    primary = ridge_probabilities(first, rest, features, target, keys)
    labelled = add_meta_label(primary.withColumns({
        "primary_prediction": direction(F.col("prediction_prob")),
        "target_tb": F.when(F.col(target) > 0, 1).otherwise(F.lit(-1))})).filter(F.col("target_meta") >= 0)
    enough = labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") >= min_labels).select(*keys)
    model = ridge_fit(labelled.join(enough, keys, "left_semi"), [*features, "primary_prediction"], "target_meta", keys)
    scored = result.join(model, keys, "left")
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features],
                direction(F.col("prediction_prob")).cast("double"))
    dot = F.aggregate(F.zip_with(x, F.col("coefficients"), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return scored.withColumn("meta_prob", clip(dot + F.col("intercept"), 0.05, 0.95)).drop("coefficients", "intercept")


def apply_meta_gate(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Zero the order where the meta probability is below the threshold; without a meta model it passes."""
    return df.withColumns({"target_exec": F.when(F.col("meta_prob") < threshold, F.lit(0.0)).otherwise(F.col("target_exec")),
                           "meta_prob": F.coalesce("meta_prob", F.lit(0.0))})


#: Models that fit every key of a frame in the same jobs.
MODELS = {"ridge": ridge_probabilities, "logistic": logistic_probabilities}


def outer_evaluation(assigned: DataFrame, features: Sequence[str], target: str, markets: DataFrame,
                     settings: ExecutionSettings = ExecutionSettings(), keys: Sequence[str] = ("symbol", "split_id"),
                     smoothing: float = 0.0, burn_in: int = 50, meta_threshold: float | None = None, alpha: float = 1.0,
                     purge: bool = True, blocks: Blocks | None = None, model: str = "ridge") -> DataFrame:
    """Purge, fit (`model` is ridge or logistic), predict, simulate and cut the warm-up for every (symbol, split) of a frame with `role`.

    The block plan is measured once, on the test rows before any model, and every later step reuses it.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    keys = list(keys)
    train, test = assigned.filter(F.col("role") == "train"), assigned.filter(F.col("role") == "test").drop("role")
    blocks = blocks or measure(test, keys)
    starts = test.groupBy(*keys).agg(F.min("ts_event").alias("_start"))
    cutoff = F.timestamp_micros(F.unix_micros("_start") - F.lit(label_minutes() * 60_000_000))
    purged = train.join(starts, keys).filter((F.col("ts_event") < cutoff) | F.lit(not purge)).drop("_start", "role")
    result = smooth_probabilities(MODELS[model](purged, test, features, target, keys, alpha=alpha), smoothing, keys)
    result = simulate_execution(add_benchmark(result, keys, blocks), markets, settings, keys, blocks)
    if meta_threshold is not None:
        gated = apply_meta_gate(meta_probabilities(purged, result, features, target, keys), meta_threshold)
        result = recompute_pnl(gated, settings, keys, blocks)
    return exclude_warmup(result, burn_in, keys, blocks)


def checked_evaluation(assigned: DataFrame, features: Sequence[str], target: str, markets: DataFrame,
                       settings: ExecutionSettings = ExecutionSettings(), keys: Sequence[str] = ("symbol", "split_id"),
                       least: float = 0.9, **options) -> DataFrame:
    """Train and test checks, the outer evaluation, and the checks of its predictions and row retention as one call.

    Raises where a key fails one of them. `options` go to `outer_evaluation`; rows cut as warm-up count as retained.
    """
    burn_in = options.pop("burn_in", 50)
    require_passed(check_train_test(assigned, features, target, keys=keys))
    result = checkpointed(outer_evaluation(assigned, features, target, markets, settings, keys, burn_in=0, **options))
    test = assigned.filter(F.col("role") == "test")
    require_passed(check_predictions(result, test, keys))
    require_passed(row_retention(result, test, keys, least))
    return exclude_warmup(result, burn_in, keys)


def row_retention(result: DataFrame, test: DataFrame, keys: Sequence[str] = ("symbol", "split_id"), least: float = 0.9) -> DataFrame:
    """Share of test rows that reached the result; passes at `least` or more."""
    keys = list(keys)
    return (test.groupBy(*keys).agg(F.count(F.lit(1)).alias("test_rows"))
            .join(result.groupBy(*keys).agg(F.count(F.lit(1)).alias("result_rows")), keys, "left")
            .withColumn("fraction", F.coalesce("result_rows", F.lit(0)) / F.col("test_rows"))
            .withColumn("passed", F.col("fraction") >= least))


def walk_forward(df: DataFrame, features: Sequence[str], target: str, markets: DataFrame,
                 settings: ExecutionSettings = ExecutionSettings(), burn_in: int = 500, correlation: float = 0.9,
                 fold_options: dict | None = None, **options) -> DataFrame:
    """Bar folds: prune features on each symbol's first train window, then fit and evaluate all folds together.

    A feature that a symbol does without is zero in all its rows, which leaves ridge without a weight for it.
    """
    # Several jobs read the folds (pruning, statistics, fit, test), so their lineage is cut once.
    assigned = checkpointed(assign_folds(df, bar_folds(df, **(fold_options or {}))))
    first = assigned.filter((F.col("split_id") == 0) & (F.col("role") == "train"))
    kept = correlation_kept(first, features, ["symbol"], correlation)
    pruned = assigned.join(kept, "symbol").withColumns(
        {c: F.when(F.array_contains("kept", c), F.col(c)).otherwise(F.lit(0.0)) for c in features}).drop("kept")
    result = outer_evaluation(pruned, list(features), target, markets, settings, burn_in=burn_in, purge=False, **options)
    plan = measure(assigned.filter(F.col("role") == "test"), ("symbol",))
    return exclude_warmup(result, burn_in, ("symbol",), plan)
