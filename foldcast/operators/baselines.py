"""Naive and autoregressive baselines, all folds of all symbols in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foldcast.operators.folds import FoldSpec, assign_test_folds, fold_split, series_lengths, train_totals
from foldcast.operators.series import SeriesSpec
from foldcast.operators.windows import shift
from foldcast.schema import PREDICTION_COLUMNS

# Labels of the baselines.
NAIVE = "Naive (Zero-Change)"
ARIMA = "ARIMA (5,1,0)"


def naive_baseline(numbered: DataFrame, folds: FoldSpec, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Predict the close of the row before."""
    moved = shift(numbered.select("symbol", "date", "close", "rn", "n"), spec, {"_before": ("close", 1), "_day": ("date", 1)})
    rows = assign_test_folds(moved, folds)
    return rows.select(
        "symbol",
        F.lit(NAIVE).alias("model"),
        "fold_id",
        F.coalesce("_day", "date").alias("origin_date"),
        "date",
        F.col("close").alias("y_true"),
        F.coalesce("_before", "close").alias("y_pred"),
    )


def _differences(numbered: DataFrame, spec: SeriesSpec, p: int) -> DataFrame:
    """Close and its last p + 1 first differences d0 (newest) to dp; differences before the series are NULL."""
    lags = {f"_c{k}": ("close", k) for k in range(1, p + 2)}
    moved = shift(numbered.select("symbol", "close", "rn", "n"), spec, lags)
    closes = [F.col("close")] + [F.col(f"_c{k}") for k in range(1, p + 2)]
    return moved.select("symbol", "close", "rn", "n", *[(closes[k] - closes[k + 1]).alias(f"d{k}") for k in range(p + 1)])


def _gram(p: int) -> list[tuple[str, str, str]]:
    """Names of the sums of products that the normal equations need: (sum, one difference, other difference)."""
    return [(f"g{i}_{j}", f"d{i}", f"d{j}") for i in range(p + 1) for j in range(max(i, 1), p + 1)]


def arima_sums(numbered: DataFrame, folds: FoldSpec, spec: SeriesSpec = SeriesSpec(), p: int = 5) -> DataFrame:
    """``m`` rows and sums g<i>_<j> of products of price differences i and j rows back, over each fold's training rows with p lags.

    A least-squares AR(p) fit depends on nothing else; expanding folds share the sums, in one pass over the rows.
    """
    rows = _differences(numbered, spec, p)
    whole = F.col(f"d{p}").isNotNull() & F.col("d0").isNotNull()
    sums = {name: ("sum", F.when(whole, F.col(a) * F.col(b)).otherwise(F.lit(0.0))) for name, a, b in _gram(p)}
    return train_totals(rows, folds, {"m": ("sum", F.when(whole, F.lit(1)).otherwise(F.lit(0))), **sums})


def solved(augmented: Column, k: int, least: Column) -> Column:
    """Solution of k equations given as rows of k + 1 numbers, by elimination; NULLs where a pivot is not above ``least``."""

    def clear(m: Column, p: Column) -> Column:
        own = F.get(m, p)
        lead = F.transform(own, lambda x: F.when(F.get(own, p) > least, x / F.get(own, p)))
        return F.transform(m, lambda row, i: F.when(i == p, lead).otherwise(F.zip_with(row, lead, lambda x, y: x - F.get(row, p) * y)))

    done = F.aggregate(F.array(*[F.lit(i) for i in range(k)]), augmented, clear)
    return F.transform(done, lambda row: F.get(row, F.lit(k)))


def ar_coefficients(p: int = 5) -> Column:
    """Least-squares coefficients from the columns of ``arima_sums``, without a constant; NULLs for short or constant samples."""
    at = [[F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(1, p + 1)] + [F.col(f"g0_{i}")] for i in range(1, p + 1)]
    size = sum((at[i][i] for i in range(p)), F.lit(0.0))
    least = F.when(F.col("m") > 2 * p, size * 1e-12)  # NULL for a short sample: no pivot is above it
    return solved(F.array(*[F.array(*row) for row in at]), p, least)


def ar_path(phi: Column, recent: Column, price: Column, steps: Column) -> Column:
    """Prices 1..steps rows ahead; the last price repeated where there are no coefficients. ``recent``: last differences, newest first."""
    start = F.struct(F.array().cast("array<double>").alias("path"), recent.alias("recent"), price.alias("price"))

    def ahead(s: Column, _: Column) -> Column:
        move = F.coalesce(F.aggregate(F.zip_with(phi, s["recent"], lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x), F.lit(0.0))
        then = s["price"] + move
        kept = F.slice(F.concat(F.array(move), s["recent"]), 1, F.size(s["recent"]))
        return F.struct(F.concat(s["path"], F.array(then)).alias("path"), kept.alias("recent"), then.alias("price"))

    return F.aggregate(F.sequence(F.lit(1), steps), start, ahead)["path"]


def arima_fits(numbered: DataFrame, folds: FoldSpec, spec: SeriesSpec = SeriesSpec(), p: int = 5) -> DataFrame:
    """One row per symbol and fold: coefficients ``phi`` and the forecast path of the test rows, as column expressions on that row."""
    sums = arima_sums(numbered, folds, spec, p)
    rows = _differences(numbered, spec, p)
    edges = fold_split(series_lengths(numbered), folds).select("symbol", "fold_id", "train_end", "test_end", (F.col("train_end") - 1).alias("rn"))
    ends = edges.join(rows.drop("n"), ["symbol", "rn"])
    ready = sums.join(ends, ["symbol", "fold_id"]).withColumn("phi", ar_coefficients(p))
    recent = F.array(*[F.coalesce(F.col(f"d{k}"), F.lit(0.0)) for k in range(p)])
    path = ar_path(F.col("phi"), recent, F.col("close"), (F.col("test_end") - F.col("train_end")).cast("int"))
    return ready.select("symbol", "fold_id", "train_end", "phi", path.alias("path"))


def arima_baseline(numbered: DataFrame, folds: FoldSpec, spec: SeriesSpec = SeriesSpec(), p: int = 5) -> DataFrame:
    """AR(p) on first differences by least squares, fitted on each fold's training rows, forecast over the whole test range.

    Unlike the one-step baselines its horizon grows along the fold: ``origin_date``
    is the last training date of all its rows.
    """
    fits = arima_fits(numbered, folds, spec, p)
    path = fits.select("symbol", "fold_id", "train_end", F.posexplode("path").alias("_step", "y_pred"))
    tests = assign_test_folds(numbered.select("symbol", "date", "close", "rn", "n"), folds)
    tests = tests.withColumn("_step", (F.col("rn") - F.col("train_end")).cast("int"))
    origin = numbered.select("symbol", (F.col("rn") + 1).alias("train_end"), F.col("date").alias("origin_date"))
    joined = tests.join(path.drop("train_end"), ["symbol", "fold_id", "_step"]).join(origin, ["symbol", "train_end"])
    return joined.withColumn("model", F.lit(ARIMA)).withColumn("y_true", F.col("close")).select(*PREDICTION_COLUMNS)


def run_baselines(numbered: DataFrame, folds: FoldSpec, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Both baselines over all folds as one prediction table."""
    return naive_baseline(numbered, folds, spec).unionByName(arima_baseline(numbered, folds, spec))
