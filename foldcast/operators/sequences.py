"""Look-back windows for sequence learners."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldcast.operators.series import SeriesSpec, drop_halo, halo_window, with_halo


def seq_windows(numbered: DataFrame, spec: SeriesSpec, features: list[str], time_step: int = 90, dtype: str = "float") -> DataFrame:
    """One row per target: ``window`` holds the ``time_step`` rows before it, oldest first, each an array of features.

    The first ``time_step`` rows of a series have no full window and drop out.
    """
    blocked = with_halo(numbered, spec, before=time_step)
    row = F.array(*[F.col(f).cast(dtype) for f in features])
    frame = halo_window(spec).rowsBetween(-time_step, -1)
    return drop_halo(blocked.withColumn("window", F.collect_list(row).over(frame)).where(F.col("rn") >= time_step))


def split_sequences(windows: DataFrame) -> DataFrame:
    """Role of each sequence in its fold, by where its target lies."""
    return windows.withColumn(
        "role",
        F.when(F.col("rn") < F.col("train_end"), "train").when(F.col("rn") < F.col("test_end"), "test"),
    ).where(F.col("role").isNotNull())


def sequence_counts(numbered: DataFrame, fold_table: DataFrame, time_step: int = 90) -> DataFrame:
    """Train and test sequence counts of each fold; folds with either side empty are left out."""
    counts = fold_table.select(
        "symbol", "fold_id",
        F.greatest(F.lit(0), F.col("train_end") - time_step).alias("train_sequences"),
        (F.col("test_end") - F.greatest(F.col("train_end"), F.lit(time_step))).alias("test_sequences"),
    )
    return counts.where((F.col("train_sequences") > 0) & (F.col("test_sequences") > 0))
