"""Expanding walk-forward folds and chronological splits.

Fold k trains on rows [0, min_train + k*step) and tests on the next ``test``
rows. Training sets are never materialised: they are a position below an edge,
or running totals over the segments between edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldcast.operators.series import running_totals


class NoFoldsError(ValueError):
    """No series was long enough for one fold."""


@dataclass(frozen=True)
class FoldSpec:
    min_train: int = 504
    test: int = 63
    step: int = 63

    def __post_init__(self):
        if min(self.min_train, self.test, self.step) < 1:
            raise ValueError("fold sizes must be positive")

    def count(self, n: Column) -> Column:
        """Number of folds of a series of n rows; one shorter fold where only the minimum is exceeded."""
        full = F.floor((n - F.lit(self.min_train + self.test)) / F.lit(self.step)) + 1
        return (
            F.when(n >= self.min_train + self.test, full)
            .when(n > self.min_train, F.lit(1))
            .otherwise(F.lit(0))
            .cast("int")
        )

    def train_end(self, fold: Column) -> Column:
        return (F.lit(self.min_train) + fold * self.step).cast("long")

    def test_end(self, fold: Column, n: Column) -> Column:
        return F.least(self.train_end(fold) + self.test, n)

    def segment(self, rn: Column) -> Column:
        """Index of the first fold that trains on a row: fold k trains on segments 0..k."""
        return F.when(rn < self.min_train, F.lit(0)).otherwise(F.floor((rn - self.min_train) / self.step) + 1).cast("int")


def series_lengths(numbered: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return numbered.groupBy(*keys).agg(F.max("n").alias("n"))


def fold_split(lengths: DataFrame, folds: FoldSpec) -> DataFrame:
    """One row per fold: ``fold_id, train_end, test_end`` (row positions, ends exclusive)."""
    n, fold = F.col("n"), F.col("fold_id")
    counted = lengths.withColumn("_folds", folds.count(n)).where("_folds > 0")
    each = counted.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.col("_folds") - 1))).drop("_folds")
    return each.withColumns({"train_end": folds.train_end(fold), "test_end": folds.test_end(fold, n)})


def assign_test_folds(numbered: DataFrame, folds: FoldSpec) -> DataFrame:
    """Every row once for each fold that tests it, found by arithmetic on ``rn`` and ``n`` instead of a range join."""
    rn, n = F.col("rn"), F.col("n")
    last = folds.count(n) - 1
    low = F.greatest(F.lit(0), F.ceil((rn - (folds.min_train + folds.test - 1)) / F.lit(folds.step)).cast("int"))
    high = F.least(last, F.floor((rn - folds.min_train) / F.lit(folds.step)).cast("int"))
    rows = numbered.withColumns({"_low": low, "_high": high}).where((F.col("_high") >= 0) & (F.col("_low") <= F.col("_high")))
    rows = rows.withColumn("fold_id", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    return rows.withColumns({"train_end": folds.train_end(F.col("fold_id")), "test_end": folds.test_end(F.col("fold_id"), n)})


def fold_membership(numbered: DataFrame, fold_table: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Train and test row counts and date ranges of each fold, from a table of explicit folds.

    Train ranges overlap, so rows are not multiplied by folds: each fold edge is
    looked up by position.
    """
    keys = list(keys)
    dates = numbered.select(*keys, F.col("rn").alias("_rn"), "date")
    edges = {"train_first": F.lit(0), "train_last": F.col("train_end") - 1, "test_first": F.col("train_end"), "test_last": F.col("test_end") - 1}
    points = fold_table.select(
        *keys, "fold_id", "train_end", "test_end",
        F.explode(F.array(*[F.struct(F.lit(name).alias("edge"), at.cast("long").alias("_rn")) for name, at in edges.items()])).alias("_point"),
    ).select(*keys, "fold_id", "train_end", "test_end", F.col("_point.edge").alias("edge"), F.col("_point._rn").alias("_rn"))
    found = points.join(dates, [*keys, "_rn"])
    return found.groupBy(*keys, "fold_id").agg(
        *[F.max(F.when(F.col("edge") == name, F.col("date"))).alias(name) for name in edges],
        F.max("train_end").alias("train_rows"),
        F.max(F.col("test_end") - F.col("train_end")).alias("test_rows"),
    )


def fold_summary(numbered: DataFrame, folds: FoldSpec, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return fold_membership(numbered, fold_split(series_lengths(numbered, keys), folds), keys)


def require_folds(fold_table: DataFrame) -> DataFrame:
    if fold_table.isEmpty():
        raise NoFoldsError("no series has enough rows for a fold; reduce min_train or use more history")
    return fold_table


def holdout_flag(size: int) -> Column:
    """True for the last ``size`` rows of a numbered series."""
    return F.col("rn") >= F.col("n") - size


def head_flag(share: float = 0.8, rn: str = "rn", n: str = "n") -> Column:
    """True for the first ``share`` of a numbered series, rounded down: the training part of a chronological split."""
    return F.col(rn) < F.floor(F.col(n) * share)


def drop_no_target(numbered: DataFrame) -> DataFrame:
    """Rows with a next-day target; fold positions past the last of them drop out with it."""
    return numbered.where(F.col("Target_Close").isNotNull())


def every_segment(parts: DataFrame, folds: FoldSpec, keys: list[str]) -> DataFrame:
    """A row for each fold from a series' first segment on: with positions on a shared calendar a series may skip segments."""
    span = parts.groupBy(*keys).agg(F.min("fold_id").alias("_first"), F.max("n").alias("n"))
    span = span.withColumn("_last", folds.count(F.col("n")) - 1).where("_first <= _last")
    grid = span.withColumn("fold_id", F.explode(F.sequence("_first", "_last"))).select(*keys, "fold_id", "n")
    return grid.join(parts.drop("n"), [*keys, "fold_id"], "left")


def train_totals(
    rows: DataFrame,
    folds: FoldSpec,
    columns: dict[str, tuple[str, Column]],
    keys: tuple[str, ...] = ("symbol",),
) -> DataFrame:
    """``sum``/``min``/``max`` over the training rows of every fold in one pass.

    Rows are aggregated by segment (map-side combine first), then segments are
    accumulated; fold k's totals are those up to segment k.
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    keys = list(keys)
    parts = rows.withColumn("fold_id", folds.segment(F.col("rn"))).groupBy(*keys, "fold_id").agg(
        F.max("n").alias("n"), *[kinds[k](x).alias(name) for name, (k, x) in columns.items()]
    )
    parts = every_segment(parts, folds, keys)
    total = running_totals(
        parts.withColumnsRenamed({name: f"_p_{name}" for name in columns}),
        keys, "fold_id", {name: (k, F.col(f"_p_{name}")) for name, (k, _) in columns.items()},
    )
    return total.select(*keys, "fold_id", *columns)
