"""Column expressions used by several operators. Missing values are NULL throughout, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec

DIRECTION_THRESHOLD = 0.001


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero or missing divisor."""
    return F.try_divide(a, b)


def or_default(value: Column, default: float) -> Column:
    """Missing or undefined values become ``default``."""
    return F.coalesce(value, F.lit(default))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def pct_change(x: Column, before: Column) -> Column:
    return ratio(x, before) - F.lit(1.0)


def rolling(agg, x: Column, w: WindowSpec, k: int) -> Column:
    """``agg(x)`` over the last k rows, NULL until k values are in the frame."""
    frame = w.rowsBetween(-(k - 1), 0)
    return F.when(F.count(x).over(frame) == k, agg(x).over(frame))


def rolling_corr(x: Column, y: Column, w: WindowSpec, k: int) -> Column:
    """Pearson correlation over the last k rows; NULL when it is undefined (warm-up or a constant frame)."""
    frame = w.rowsBetween(-(k - 1), 0)
    both = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    value = ratio(
        F.covar_samp(*both).over(frame),
        F.stddev_samp(both[0]).over(frame) * F.stddev_samp(both[1]).over(frame),
    )
    return F.when(F.count(both[0]).over(frame) == k, value)


def true_range(high: Column, low: Column, prev_close: Column) -> Column:
    return F.greatest(high - low, F.abs(high - prev_close), F.abs(low - prev_close))


def rsi_from_means(gain: Column, loss: Column) -> Column:
    """Relative strength index from the mean gain and mean loss of a window (NULL means an incomplete window)."""
    return (
        F.when(gain.isNull() | ((gain == 0) & (loss == 0)), F.lit(50.0))
        .when(loss == 0, F.lit(100.0))
        .otherwise(F.lit(100.0) - ratio(F.lit(100.0), F.lit(1.0) + ratio(gain, loss)))
    )


def log_return(x: Column, before: Column) -> Column:
    return or_default(F.ln(ratio(x, before)), 0.0)


def direction_label(price: Column, before: Column, threshold: float = DIRECTION_THRESHOLD) -> Column:
    """1 for a rise beyond the threshold, 0 for a fall beyond it, -1 between; NULL without a previous price."""
    change = ratio(price - before, before)
    return (
        F.when(before.isNull() | price.isNull(), F.lit(None))
        .when(change > threshold, F.lit(1))
        .when(change < -threshold, F.lit(0))
        .otherwise(F.lit(-1))
    )


def volatility_multiplier(current: Column, mean: Column) -> Column:
    """Width factor of an interval: current over mean volatility, kept within [0.5, 2]."""
    return clip(ratio(current, mean), 0.5, 2.0)


def strip_zone(ts: Column, zone: str | None = None) -> Column:
    """Calendar day of a timestamp: the wall clock as it stands, or that of ``zone`` for a UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts, zone) if zone else ts)


def file_label(name: Column) -> Column:
    """Model name as used in output file names."""
    return F.regexp_replace(F.lower(name), " ", "_")
