"""Technical indicators over bars, many symbols at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldcast.functions import columns as C
from foldcast.operators.series import SeriesSpec, halo_window, drop_halo, number_rows, with_halo
from foldcast.operators.windows import ewm_halo, ewm_in_blocks, has_gaps
from foldcast.schema import BAR_COLUMNS, ENGINEERED, MACRO_COLUMNS


def engineer_features(
    bars: DataFrame,
    spec: SeriesSpec = SeriesSpec(),
    keep_block: bool = False,
    fill: tuple[str, ...] = (),
    back_fill: bool = True,
    gaps: bool | None = None,
) -> DataFrame:
    """Add the engineered columns to bars (with or without volume and macro columns).

    ``fill`` names macro columns whose gaps are filled along the series first. A missing close holds the exponential means;
    whether one is missing is looked up unless ``gaps`` says it.

    Two shuffles whatever the number of columns: one into blocks of time, which
    numbers the rows and carries the volume balance along, and one into row
    blocks with 512 rows of history, where every bounded frame is computed
    under a single sort.
    """
    has_volume = "volume" in bars.columns
    has_index = "SP500" in bars.columns
    has_vix = "VIX" in bars.columns
    flow = ("close", "volume", "OBV") if has_volume else None
    numbered = number_rows(bars, spec, fills=fill, back_fill=back_fill, flow=flow)

    w = halo_window(spec)
    close = F.col("close")
    gaps = has_gaps(bars, ["close"]) if gaps is None else gaps
    blocked = with_halo(numbered, spec, before=ewm_halo(26, gaps))

    mean20, std20 = C.rolling(F.avg, close, w, 20), C.rolling(F.stddev_samp, close, w, 20)
    step = [
        mean20.alias("SMA_20"),
        C.rolling(F.avg, close, w, 50).alias("SMA_50"),
        std20.alias("_std20"),
        F.lag("close", 1).over(w).alias("Close_Lag_1"),
        F.lag("close", 3).over(w).alias("Close_Lag_3"),
        F.lag("close", 5).over(w).alias("Close_Lag_5"),
    ]
    if has_volume:
        step.append(C.ratio(F.col("volume"), C.rolling(F.avg, F.col("volume"), w, 20)).alias("Volume_Ratio"))
    if has_index:
        step.append(C.or_default(C.rolling_corr(close, F.col("SP500"), w, 20), 0.0).alias("Corr_SP500_20"))
        step.append(C.or_default(C.pct_change(F.col("SP500"), F.lag("SP500", 1).over(w)), 0.0).alias("SP500_Return_1d"))
    if has_vix:
        step.append((F.col("VIX") - F.lag("VIX", 1).over(w)).alias("VIX_Change"))
    blocked = blocked.select("*", *step)

    change = close - F.col("Close_Lag_1")
    blocked = blocked.select(
        "*",
        F.when(change > 0, change).otherwise(F.lit(0.0)).alias("_gain"),
        F.when(change < 0, -change).otherwise(F.lit(0.0)).alias("_loss"),
        C.true_range(F.col("high"), F.col("low"), F.col("Close_Lag_1")).alias("_range"),
        C.log_return(close, F.col("Close_Lag_1")).alias("Log_Return"),
    )
    blocked = blocked.select(
        "*",
        C.rsi_from_means(C.rolling(F.avg, F.col("_gain"), w, 14), C.rolling(F.avg, F.col("_loss"), w, 14)).alias("RSI_14"),
        C.rolling(F.avg, F.col("_range"), w, 14).alias("ATR_14"),
        C.or_default(C.rolling(F.stddev_samp, F.col("Log_Return"), w, 20), 0.0).alias("Volatility_20"),
    )

    blocked = ewm_in_blocks(blocked, spec, {"EMA_12": ("close", 12), "EMA_26": ("close", 26)}, gaps)
    blocked = blocked.withColumn("MACD", F.col("EMA_12") - F.col("EMA_26"))
    blocked = ewm_in_blocks(blocked, spec, {"MACD_Signal": ("MACD", 9)}, gaps)

    upper = F.col("SMA_20") + 2 * F.col("_std20")
    lower = F.col("SMA_20") - 2 * F.col("_std20")
    blocked = blocked.select(
        "*",
        (F.col("MACD") - F.col("MACD_Signal")).alias("MACD_Hist"),
        upper.alias("BB_Upper"),
        lower.alias("BB_Lower"),
        C.ratio(upper - lower, F.col("SMA_20")).alias("BB_Width"),
        C.pct_change(close, F.col("Close_Lag_1")).alias("Return_1d"),
        C.pct_change(close, F.col("Close_Lag_5")).alias("Return_5d"),
        F.weekday(spec.time).alias("DayOfWeek"),
    )
    if not has_volume:
        blocked = blocked.withColumn("OBV", F.lit(0.0)).withColumn("Volume_Ratio", F.lit(1.0))

    core = drop_halo(blocked, keep_block=True)
    kept = [c for c in bars.columns if c not in ENGINEERED and c not in ("rn", "n", "blk")]
    made = [c for c in ENGINEERED if c in core.columns]
    return core.select(*kept, *made, "rn", "n", *(["blk"] if keep_block else []))


def drop_warmup(features: DataFrame, spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Drop rows with any missing input or indicator and number the rest again.

    With the ``blk`` column of ``engineer_features(keep_block=True)`` the new
    numbering reuses the row blocks the data already sits in.
    """
    checked = [c for c in features.columns if c in set(BAR_COLUMNS + MACRO_COLUMNS + ENGINEERED)]
    kept = features.na.drop("any", subset=checked)
    if "blk" in features.columns:
        return number_rows(kept, spec, block="blk").drop("blk")
    return number_rows(kept, spec)
