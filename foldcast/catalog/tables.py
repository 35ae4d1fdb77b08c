"""Bars, macros and forecasts derived from the given tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldcast.functions import columns as C
from foldcast.operators.baselines import naive_baseline
from foldcast.operators.folds import FoldSpec, assign_test_folds
from foldcast.operators.forecast import future_calendar
from foldcast.operators.indicators import engineer_features
from foldcast.operators.series import SeriesSpec, number_rows
from foldcast.operators.stacking import align_predictions, direction_features, join_context, join_current_close
from foldcast.operators.windows import shift
from foldcast.session import materialise
from foldcast.sources.bars import bars_from_ticks, join_macro, prepare

DAILY = SeriesSpec()
HOURLY = SeriesSpec(unit="hour")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ticks: unit price by ship date, one symbol per return flag, in order of order key and line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        C.ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(daily_ticks(spark, sf_dir), "day")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: value by hour, one symbol per event type, volume counts the events, in order of time and event."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(19,0)")
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("value").alias("price"),
        F.lit(1.0).alias("volume"),
        # Both keys in one fixed-width number: the time, then 16 digits of the event.
        (micros * F.lit(10**16).cast("decimal(17,0)") + F.col("event_id").cast("decimal(16,0)")).alias("seq"),
    )
    return bars_from_ticks(ticks, "hour")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day as three context series: mean price, its relative spread, share of finished orders.

    The mean adds whole cents, which is exact in any order of summation.
    """
    orders = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.sum(F.round(price * 100).cast("long")) / (F.count(price) * 100.0)).alias("SP500"),
        F.round(C.ratio(100 * F.stddev_samp(price), F.avg(price)), 6).alias("VIX"),
        F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 6).alias("TNX_Yield"),
    )


def numbered_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with positions; the bars are written once, as rows and block totals both come from them."""
    return number_rows(materialise(daily_bars(spark, sf_dir)), DAILY)


def hourly_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(materialise(hourly_bars(spark, sf_dir)), HOURLY)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(daily_bars(spark, sf_dir), macro(spark, sf_dir), DAILY, check=False)


def raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all rows, warm-up included."""
    joined = join_macro(daily_bars(spark, sf_dir), macro(spark, sf_dir))
    return engineer_features(materialise(joined), DAILY, fill=("SP500", "VIX", "TNX_Yield"))


# Forecasts that need no fit, as stand-ins where an operator takes any set of base forecasts.
PLAIN = {"last_pred": "last", "mean20_pred": "mean20", "mean50_pred": "mean50"}


def plain_forecasts(feats: DataFrame, folds: FoldSpec = FoldSpec()) -> DataFrame:
    """Last close, 20-day mean and 50-day mean of the day before as forecasts of each test day, in long form."""
    lags = {"last_pred": ("close", 1), "mean20_pred": ("SMA_20", 1), "mean50_pred": ("SMA_50", 1), "origin_date": ("date", 1)}
    moved = shift(feats.select("symbol", "date", "close", "SMA_20", "SMA_50", "rn", "n"), DAILY, lags)
    rows = assign_test_folds(moved, folds).withColumn("y_true", F.col("close"))
    base = rows.select("symbol", "fold_id", "origin_date", "date", "y_true", *PLAIN).withColumnsRenamed(PLAIN)
    return base.unpivot(["symbol", "fold_id", "origin_date", "date", "y_true"], list(PLAIN.values()), "model", "y_pred")


def plain_aligned(feats: DataFrame) -> DataFrame:
    return align_predictions(plain_forecasts(feats), PLAIN)


def naive_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_baseline(numbered_bars(spark, sf_dir), FoldSpec(), DAILY)


def naive_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_baseline(hourly_numbered(spark, sf_dir), FoldSpec(200, 20, 20), HOURLY)


# Forecasts whose direction is not that of the last close itself.
MOVING = ["mean20_pred", "mean50_pred", "trend_pred"]


def direction_rows(feats: DataFrame) -> DataFrame:
    """Aligned test days with the two means and the last close carried on by a fifth of its five-day move, as directions with VIX."""
    step = (F.col("close") - F.col("Close_Lag_5")) / 5
    trend = feats.select("symbol", F.col("date").alias("origin_date"), (F.col("close") + step).alias("trend_pred"))
    rows = plain_aligned(feats).drop("last_pred").join(trend, ["symbol", "origin_date"], "left")
    rows = direction_features(join_current_close(rows, feats), MOVING)
    return join_context(rows, feats)


def future_plain(feats: DataFrame, count: int = 30) -> DataFrame:
    """The next business days with the plain forecasts of the last bar: last close, 20-day and 50-day mean, held."""
    last = feats.where(F.col("rn") == F.col("n") - 1).select("symbol", F.col("close").alias("last_pred"), F.col("SMA_20").alias("mean20_pred"), F.col("SMA_50").alias("mean50_pred"))
    return future_calendar(feats, count).join(last, "symbol")


def long_future(wide: DataFrame) -> DataFrame:
    """The same in long form, named like the forecasts of test days."""
    return wide.withColumnsRenamed(PLAIN).unpivot(["symbol", "step", "date"], list(PLAIN.values()), "model", "y_pred")
