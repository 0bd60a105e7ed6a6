"""Train-only feature discovery: fold importances, stability selection, frozen manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.columns import is_finite
from tidebar.operators import extra_trees
from tidebar.operators.baseline import BASELINE_FEATURES
from tidebar.operators.engine import NUMERIC, is_metadata
from tidebar.operators.splits import recent_days, train_window
from tidebar.plans.blocks import Blocks, measure, positions
from tidebar.plans.checkpoints import scratch_path

FROZEN_PREFIXES = ("feature_", "ratio_", "pair_", "zscore", "cross_", "htf_", "1h_", "daily_")
ESSENTIAL = ("symbol", "ts_event", "open", "high", "low", "close", "volume", "session_id", "regime")


def selectable_features(df: DataFrame) -> list[str]:
    """Numeric feature columns by name: known prefixes or baseline names, never targets or contract metadata."""
    return [c for c, t in df.dtypes
            if t in NUMERIC and not c.startswith("_") and not is_metadata(c) and not c.startswith("target_")
            and (c.startswith(FROZEN_PREFIXES) or c in BASELINE_FEATURES)]


def stratified_sample(df: DataFrame, max_rows: int = 200_000, keys: Sequence[str] = ("symbol",), blocks: Blocks | None = None) -> DataFrame:
    """Every step-th row of three equal time segments when a key has more than `max_rows` rows.

    Segments hold rows // 3 rows, so up to two trailing rows belong to none; this only applies while sampling.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = positions(df, blocks or measure(df, keys)).join(sizes, keys)
    segment = F.floor(F.col("_n") / 3)
    step = F.greatest(F.lit(1), F.floor(segment / F.least(segment, F.lit(max_rows // 3))))
    at = F.col("_rn") - 1
    inside = F.least(F.floor(at / segment), F.lit(2))
    offset = at - inside * segment
    # Picks are counted per segment, so a second thinning (when the picks still exceed the cap) is arithmetic.
    per_segment = F.ceil(segment / step)
    picks = 3 * per_segment
    again = F.when(picks > max_rows, F.greatest(F.lit(1), F.floor(picks / max_rows))).otherwise(F.lit(1))
    number = inside * per_segment + F.floor(offset / step)
    chosen = (at < 3 * segment) & (offset % step == 0) & (number % again == 0) & (F.floor(number / again) < max_rows)
    return rows.filter((F.col("_n") <= max_rows) | chosen).drop("_rn", "_n")


def bootstrap_weight(seed: int, fold: int, *row_key) -> Column:
    """Poisson(1) count from a row hash: a bootstrap with replacement that needs no shuffle and repeats exactly."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(fold), *row_key), F.lit(2 ** 40)).cast("double") + 0.5) / float(2 ** 40)
    cumulative, term, weight = 0.0, 0.36787944117144233, F.lit(0)
    for count in range(12):
        cumulative += term
        weight = weight + F.when(u >= cumulative, 1).otherwise(F.lit(0))
        term /= count + 1
    return weight.cast("double")


def fold_importances(df: DataFrame, features: Sequence[str], target: str = "target_15m_ret", folds: int = 3, trees: int = 50,
                     depth: int = 4, feature_share: float = 0.3, seed: int = 42) -> DataFrame:
    """(feature, fold, importance, sign): extra-trees of all folds grown together over bootstrap weights.

    Rows with a finite target count; other values that are not finite are 0. The rows are written once and read 2 * depth + 2 times.
    """
    features = list(features)
    spark = df.sparkSession
    names = [f"x{i}" for i in range(len(features))]
    weights = [f"w{i}" for i in range(folds)]
    clean = df.filter(is_finite(F.col(target))).select(
        F.col(target).cast("double").alias("_y"), *[F.when(is_finite(F.col(f"`{c}`")), F.col(f"`{c}`").cast("double")).otherwise(0.0).alias(x) for c, x in zip(features, names)],
        *[bootstrap_weight(seed, i, "symbol", "ts_event").alias(w) for i, w in enumerate(weights)])
    path = scratch_path(spark, "discovery-rows")
    clean.write.parquet(path)
    importance, sign = extra_trees.importances(spark.read.parquet(path), names, weights, trees, depth, feature_share, seed)
    rows = [(c, fold, float(importance[fold, i]), float(sign[fold, i])) for fold in range(folds) for i, c in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, fold int, importance double, sign double")


def select_features(importances: DataFrame, min_freq: float = 0.5, min_sign: float = 0.5, cumulative: float = 0.95,
                    min_count: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Stability selection over (feature, fold, importance, sign) rows; adds freq, sign share, rank, `selected`.

    Stable features are kept down the ranking until their share reaches `cumulative`. Below `min_count` the
    next stable ones, then the next of all, fill up. The frame has one row per feature, so its windows are tiny.
    """
    keys = list(keys)
    per = importances.groupBy(*keys, "feature").agg(
        F.avg((F.col("importance") > 0).cast("double")).alias("freq"), F.avg("importance").alias("mean_importance"),
        F.avg((F.col("sign") > 0).cast("double")).alias("_pos"), F.avg((F.col("sign") < 0).cast("double")).alias("_neg"))
    majority = F.col("_pos") > 0.5
    per = per.withColumns({"majority_sign": F.when(majority, 1).otherwise(F.lit(-1)),
                           "sign_consistency": F.when(majority, F.col("_pos")).otherwise(F.col("_neg"))}).drop("_pos", "_neg")
    per = per.withColumn("stable", (F.col("freq") >= min_freq) & (F.col("sign_consistency") >= min_sign))
    group = Window.partitionBy(*keys)
    order = Window.partitionBy(*keys, "stable").orderBy(F.desc("mean_importance"), "feature")
    share = F.sum("mean_importance").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("mean_importance").over(
        Window.partitionBy(*keys, "stable"))
    own = F.col("mean_importance") / F.sum("mean_importance").over(Window.partitionBy(*keys, "stable"))
    per = per.withColumns({"_before": share - own, "_place": F.row_number().over(order)})
    per = per.withColumn("_kept", F.col("stable") & ((F.col("_place") == 1) | (F.col("_before") < cumulative)))
    fill = Window.partitionBy(*keys).orderBy(F.desc("_kept"), F.desc("stable"), F.desc("mean_importance"), "feature")
    per = per.withColumns({"rank": F.row_number().over(fill), "_n": F.sum(F.col("_kept").cast("int")).over(group)})
    return per.withColumn("selected", F.col("rank") <= F.greatest("_n", F.lit(min_count))).drop("_before", "_place", "_kept", "_n")


def manifest(selection: DataFrame, seed: int = 42, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row: selected names in rank order, their count and the SHA-256 of the sorted JSON list."""
    chosen = F.array_sort(F.collect_list(F.when(F.col("selected"), F.struct("rank", "feature"))))
    return (selection.agg(chosen.alias("_c")).select(F.col("_c.feature").alias("feature_names"))
            .select("feature_names", F.size("feature_names").alias("selected_k"),
                    F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array_sort("feature_names")), 256)).alias("features_hash"),
                    F.lit(True).alias("frozen"), F.lit("frozen_feature_manifest").alias("manifest_type"),
                    F.lit(seed).alias("selection_seed"), F.lit(start).cast("string").alias("window_start"),
                    F.lit(end).cast("string").alias("window_end")))


def discover(df: DataFrame, start: str | None, end: str | None, target: str = "target_15m_ret", window_days: int | None = None,
             max_rows: int | None = None, folds: int = 3, selection: dict | None = None, **forest) -> DataFrame:
    """Discovery on the train window only: fold importances, selection, manifest row.

    All rows of the window count unless `window_days` (recent days) or `max_rows` (a time-stratified sample) is given.
    """
    if not start or not end:
        raise ValueError("train-only discovery needs both window bounds")
    if target not in df.columns:
        raise ValueError(f"missing target {target}")
    features = selectable_features(df)
    if not features:
        raise ValueError("no selectable feature columns")
    rows = train_window(df, start, end)
    if window_days is not None:
        rows = recent_days(rows, window_days)
    if max_rows is not None:
        rows = stratified_sample(rows, max_rows)
    importances = fold_importances(rows, features, target, folds, **forest)
    return manifest(select_features(importances, **(selection or {})), start=start, end=end)


def check_manifest(names: Sequence[str]) -> list[str]:
    names = list(names)
    if len(names) != len(set(names)):
        raise ValueError("duplicate feature names in manifest")
    bad = [c for c in names if not isinstance(c, str) or c.startswith("target_") or c in ESSENTIAL[:-1] or is_metadata(c)]
    if bad:
        raise ValueError(f"invalid selected features {bad[:10]}")
    return names


def apply_manifest(df: DataFrame, names: Sequence[str], target: str, strict: bool = True) -> DataFrame:
    """Essentials, non-feature columns and the selected features.

    ``strict`` also drops unselected baseline features; without it only prefixed names count as features.
    """
    names = check_manifest(names)
    missing = [c for c in [*names, target] if c not in df.columns]
    if missing:
        raise ValueError(f"selected features or target missing from matrix {missing[:10]}")

    def feature(c):
        return c.startswith(FROZEN_PREFIXES) or (strict and c in BASELINE_FEATURES)

    other = [c for c in df.columns if c not in ESSENTIAL and not feature(c) and not is_metadata(c)]
    keep = dict.fromkeys([*[c for c in ESSENTIAL if c in df.columns], *other, *names])
    return df.select(*[F.col(f"`{c}`") for c in keep])
