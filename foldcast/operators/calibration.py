"""Prediction intervals from residual quantiles, scaled by volatility, and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldcast.functions import columns as C
from foldcast.operators.joins import attach
from foldcast.session import materialise

DEFAULT_VIX = 20.0
SLICE_ROWS = 200_000  # rows of a group that one task ranks at most
CUTS = 16  # parts that a too large slice is cut into


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _above(cuts: list[float]) -> Column:
    """How many of the proposed cut points a value lies above."""
    return sum((F.when(F.col("_v") > F.col("_cuts")[i], 1).otherwise(0) for i in range(len(cuts))), F.lit(0)).cast("long")


def _holding(sliced: DataFrame, keys: list[str], ranks: list[Column]) -> tuple[DataFrame, DataFrame, int]:
    """Rows of the slices that hold a wanted rank, those slices, and the size of the largest that has more than one value.

    ``sliced``: keys, n, _old and _start (a slice of the round before and the rank it starts at), _slice and _v.
    """
    sizes = sliced.groupBy(*keys, "n", "_old", "_start", "_slice").agg(F.count(F.lit(1)).alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = Window.partitionBy(*keys, "_old").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_from", F.col("_start") + F.coalesce(F.sum("_size").over(before), F.lit(0)))
    needed = materialise(sizes.where(_any([(r >= F.col("_from")) & (r < F.col("_from") + F.col("_size")) for r in ranks])))
    largest = needed.where("_lo < _hi").agg(F.max("_size")).first()[0] or 0
    places = needed.select(*keys, "_old", "_slice", "_from")
    inside = attach(sliced, places, [*keys, "_old", "_slice"]).select(*keys, "n", F.col("_slice").alias("_old"), F.col("_from").alias("_start"), "_v")
    return inside, needed, largest


def rank_slices(df: DataFrame, keys: list[str], value: str, ranks: list[Column], cuts: list[float], limit: int) -> tuple[DataFrame, DataFrame]:
    """Values around the wanted ranks of every group, in slices of at most ``limit`` rows or of one value, and those slices.

    An approximate digest proposes cut points; counting between them tells which slices hold the ranks. Slices that are still
    too large are cut again, round by round.
    """
    data = materialise(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    digest = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", cuts, 10000).alias("_cuts"))
    start = F.lit(0).cast("long")
    sliced = attach(data, digest, keys).select(*keys, "n", start.alias("_old"), start.alias("_start"), "_v", _above(cuts).alias("_slice"))
    inside, needed, largest = _holding(sliced, keys, ranks)
    finer = [(i + 1) / CUTS for i in range(CUTS - 1)]
    while largest > limit:
        inside = materialise(inside)
        digest = inside.groupBy(*keys, "_old").agg(F.percentile_approx("_v", finer, 10000).alias("_cuts"))
        place = F.col("_old") * CUTS + _above(finer)
        sliced = attach(inside, digest, [*keys, "_old"]).select(*keys, "n", "_old", "_start", "_v", place.alias("_slice"))
        inside, needed, smaller = _holding(sliced, keys, ranks)
        if smaller >= largest:  # a digest that no longer cuts: what is left is ranked by distinct value all the same
            break
        largest = smaller
    return inside, needed


def exact_quantiles(df: DataFrame, keys: tuple[str, ...], value: str, probs: tuple[float, ...], margin: float = 0.005, limit: int = SLICE_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation: ``keys, n, q0, q1, ...``.

    No group is gathered or sorted whole: only slices of at most ``limit`` rows around the wanted ranks are ranked, by distinct
    value. A poor digest costs rounds, it never makes the result wrong.
    """
    keys = list(keys)
    cuts = sorted({min(1.0, max(0.0, p + s * margin)) for p in probs for s in (-1, 1)})
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = [r for h in at for r in (F.floor(h), F.ceil(h))]
    inside, _ = rank_slices(df, keys, value, ranks, cuts, limit)
    inside = inside.groupBy(*keys, "n", "_old", "_start", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys, "_old").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_end", F.col("_start") + F.sum("_c").over(upto))
    hit = [F.max(F.when((r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")), F.col("_v"))).alias(f"_r{i}") for i, r in enumerate(ranks)]
    found = inside.groupBy(*keys, "n").agg(*hit)
    out = []
    for i, h in enumerate(at):
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        out.append((low + (high - low) * (h - F.floor(h))).alias(f"q{i}"))
    return found.select(*keys, "n", *out)


def quantile_offsets(residuals: DataFrame, keys: tuple[str, ...] = ("symbol", "model"), level: float = 0.95, value: str = "residual") -> DataFrame:
    """Lower and upper residual quantiles of a central interval."""
    probs = ((1 - level) / 2, (1 + level) / 2)
    q = exact_quantiles(residuals, keys, value, probs)
    return q.select(*keys, F.col("n").alias("n_residuals"), F.col("q0").alias("lower_offset"), F.col("q1").alias("upper_offset"))


def vix_stats(features: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Last and mean volatility index of each series; a fixed level where there is none."""
    if "VIX" not in features.columns:
        level = F.lit(DEFAULT_VIX)
        return features.select(*keys).distinct().select(*keys, level.alias("vix_current"), level.alias("vix_mean"))
    return features.groupBy(*keys).agg(F.max_by("VIX", "date").alias("vix_current"), F.avg("VIX").alias("vix_mean"))


def interval_bounds(pred: Column) -> dict[str, Column]:
    """Bounds around a prediction from offset and volatility columns."""
    width = C.volatility_multiplier(F.col("vix_current"), F.col("vix_mean"))
    return {"lower": pred + F.col("lower_offset") * width, "upper": pred + F.col("upper_offset") * width}


def with_interval(preds: DataFrame, offsets: DataFrame, vix: DataFrame, pred: str = "y_pred") -> DataFrame:
    """Attach offsets (by symbol and, where both have it, model) and volatility; add ``lower`` and ``upper``."""
    on = [k for k in ("symbol", "model") if k in preds.columns and k in offsets.columns]
    joined = attach(preds, offsets.join(vix, "symbol"), on)
    return joined.withColumns(interval_bounds(F.col(pred))).drop("lower_offset", "upper_offset", "vix_current", "vix_mean")


def coverage_flag(coverage: Column) -> Column:
    # Bounds and labels.
    return (
        F.when(coverage < 0.90, "[!] UNDER-COVERED")
        .when(coverage > 0.97, "[!] OVER-COVERED")
        .otherwise("[OK] WELL-CALIBRATED")
    )


def coverage_report(
    bounded: DataFrame, keys: tuple[str, ...] = ("symbol", "model"), level: float = 0.95, n_residuals: str | None = None, y: str = "y_true"
) -> DataFrame:
    """Share of rows inside their bounds (inclusive), per group; ``n_residuals`` is N/A where no column holds it."""
    inside = (F.col(y) >= F.col("lower")) & (F.col(y) <= F.col("upper"))
    used = F.max(n_residuals).cast("string") if n_residuals else F.lit("N/A")
    sums = bounded.groupBy(*keys).agg(
        F.count_if(inside).alias("n_inside"), F.count(F.lit(1)).alias("n_total"), used.alias("n_residuals")
    )
    share = C.or_default(C.ratio(F.col("n_inside").cast("double"), F.col("n_total").cast("double")), 0.0)
    return sums.select(
        *keys,
        F.bround(share, 4).alias("empirical_coverage"),
        F.lit(level).alias("nominal_level"),
        "n_inside", "n_total", "n_residuals",
        share.between(0.90, 0.97).alias("is_well_calibrated"),
        coverage_flag(share).alias("flag"),
    )


def coverage_gap(report: DataFrame) -> DataFrame:
    """Report lines: signed gap to the nominal level in percentage points and what it says about the width."""
    gap = F.bround((F.col("empirical_coverage") - F.col("nominal_level")) * 100, 1)
    return report.withColumns({
        "gap_pp": gap,
        "reading": F.when(F.col("is_well_calibrated"), F.lit(None)).when(gap > 0, "may be too wide").otherwise("may be too narrow"),
    })
