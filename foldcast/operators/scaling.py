"""Scalers fitted on the training rows of each fold, without copying training sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foldcast.operators.joins import attach
from foldcast.operators.folds import FoldSpec, every_segment
from foldcast.operators.series import running_totals


def _segments_by_feature(rows: DataFrame, folds: FoldSpec, features: list[str], keys: list[str], kinds: dict[str, Callable]) -> DataFrame:
    """Aggregates of each feature per segment between fold edges, one row per segment and feature.

    The rows are reduced in wide form, in one aggregate with a map-side combine;
    only the few segment rows are turned to long form, which keeps the plan of
    the accumulation small whatever the number of features.
    """
    seg = rows.withColumn("fold_id", folds.segment(F.col("rn"))).groupBy(*keys, "fold_id").agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).cast("double").alias("_k"),
        *[make(F.col(f)).alias(f"_{kind}_{f}") for f in features for kind, make in kinds.items()],
    )
    seg = every_segment(seg, folds, keys)
    each = F.array(*[F.struct(*[F.col(f"_{kind}_{f}").cast("double").alias(kind) for kind in kinds]) for f in features])
    return seg.select(*keys, "fold_id", "_k", F.posexplode(each).alias("_i", "_v")).select(*keys, "fold_id", "_k", "_i", "_v.*")


def _wide(stats: DataFrame, features: list[str], keys: list[str], names: tuple[str, str]) -> DataFrame:
    """One row per fold from one row per fold and feature."""
    first, second = names
    rows = stats.groupBy(*keys, "fold_id").agg(F.sort_array(F.collect_list(F.struct("_i", first, second))).alias("_all"))
    picked = [F.col("_all")[i][name].alias(f"{name}_{f}") for name in names for i, f in enumerate(features)]
    return rows.select(*keys, "fold_id", *picked)


def standard_stats(rows: DataFrame, folds: FoldSpec, features: list[str], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Mean and population deviation of each feature per fold: ``mean_<f>``, ``std_<f>`` (1 for a constant feature).

    Segments are accumulated around the first segment's mean so that no digits are lost.
    """
    keys = list(keys)
    seg = _segments_by_feature(rows, folds, features, keys, {"m": F.avg, "v": lambda x: F.var_pop(x) * F.count(x), "c": F.count, "lo": F.min, "hi": F.max})
    first = seg.groupBy(*keys, "_i").agg(F.min_by("m", F.when(F.col("m").isNotNull(), F.col("fold_id"))).alias("_c"))
    seg = seg.join(first, [*keys, "_i"])
    off = F.col("m") - F.col("_c")
    run = running_totals(
        seg, [*keys, "_i"], "fold_id",
        {
            "_rows": ("sum", F.col("c")), "_s1": ("sum", F.col("c") * off), "_s2": ("sum", F.col("v") + F.col("c") * off * off),
            "_lo": ("min", F.col("lo")), "_hi": ("max", F.col("hi")),
        },
    )
    mean_off = F.try_divide(F.col("_s1"), F.col("_rows"))
    var = F.greatest(F.try_divide(F.col("_s2"), F.col("_rows")) - mean_off * mean_off, F.lit(0.0))
    # A constant feature is told by its extremes, which are exact; its mean is that constant.
    varies = (F.col("_lo") < F.col("_hi")) & (var > 0)
    stats = run.withColumns({
        "mean": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_c") + mean_off),
        "std": F.when(varies, F.sqrt(var)).otherwise(F.lit(1.0)),
    })
    return _wide(stats, features, keys, ("mean", "std"))


def minmax_stats(rows: DataFrame, folds: FoldSpec, features: list[str], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Minimum and range of each feature per fold: ``min_<f>``, ``range_<f>`` (1 for a constant feature)."""
    keys = list(keys)
    seg = _segments_by_feature(rows, folds, features, keys, {"lo": F.min, "hi": F.max})
    run = running_totals(seg, [*keys, "_i"], "fold_id", {"min": ("min", F.col("lo")), "max": ("max", F.col("hi"))})
    width = F.col("max") - F.col("min")
    stats = run.withColumn("range", F.when(width > 0, width).otherwise(F.lit(1.0)))
    return _wide(stats, features, keys, ("min", "range"))


def standardise(f: str) -> Column:
    return (F.col(f) - F.col(f"mean_{f}")) / F.col(f"std_{f}")


def to_unit(f: str) -> Column:
    """Min-max scaling with a fold's training range; later rows may leave [0, 1]."""
    return (F.col(f) - F.col(f"min_{f}")) / F.col(f"range_{f}")


def from_unit(scaled: Column, f: str = "close") -> Column:
    """Back from the scale of ``to_unit``."""
    return scaled * F.col(f"range_{f}") + F.col(f"min_{f}")


def scale_rows(rows: DataFrame, stats: DataFrame, features: list[str], how: str, on: list[str], keep: list[str]) -> DataFrame:
    """Join fold statistics and scale ``features``; the statistics stay for the back-transform of ``keep``."""
    scaler = standardise if how == "standard" else to_unit
    prefixes = ("mean_", "std_") if how == "standard" else ("min_", "range_")
    joined = attach(rows, stats, on)
    kept_stats = [p + f for f in keep for p in prefixes]
    others = [c for c in rows.columns if c not in features]
    return joined.select(*others, *[scaler(f).alias(f) for f in features], *kept_stats)
