"""Bars and macro series: reading, building from ticks, joining."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldcast.functions import columns as C
from foldcast.operators.indicators import drop_warmup, engineer_features
from foldcast.operators.series import SeriesSpec, number_rows
from foldcast.schema import BAR_SCHEMA, MACRO_COLUMNS, MACRO_SYMBOLS
from foldcast.session import materialise


class EmptySourceError(ValueError):
    """A source had no rows for the symbols and dates asked for."""


def read_bars(
    spark: SparkSession,
    path: str,
    start: str | date | None = None,
    end: str | date | None = None,
    symbols: list[str] | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Stored bars of [start, end); the end defaults to today. Filters reach the scan."""
    reader = spark.read.schema(BAR_SCHEMA)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    df = df.where(F.col("date") < (F.current_date() if end is None else F.lit(end).cast("date")))
    return df.where(F.col("symbol").isin([s.upper() for s in symbols])) if symbols else df


def bars_from_ticks(ticks: DataFrame, unit: str = "day") -> DataFrame:
    """Open, high, low, close and volume per symbol and time unit.

    ``ticks`` has symbol, ts, price, volume and ``seq``, an integer or decimal
    that orders the ticks of a unit and differs between them. A tick without a
    price or without ``seq`` is neither the first nor the last; NULL symbols and
    dates make bars of their own.

    One scan and one hash aggregate with a map-side combine: all of its state
    has a fixed width, so a bar costs each task one row, however many ticks it has.
    """
    when = F.to_date("ts") if unit == "day" else F.date_trunc(unit, F.col("ts"))
    keyed = ticks.select("symbol", when.alias("date"), "price", "volume", F.when(F.col("price").isNotNull(), F.col("seq")).alias("seq"))
    return keyed.groupBy("symbol", "date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume"),
    ).select(*BAR_SCHEMA.names)


def macro_wide(index_bars: DataFrame, names: dict[str, str] = MACRO_SYMBOLS) -> DataFrame:
    """One row per date with the close of each index symbol under its own name."""
    wanted = index_bars.where(F.col("symbol").isin(list(names)))
    wide = wanted.groupBy("date").pivot("symbol", list(names)).agg(F.max("close"))
    return wide.withColumnsRenamed(names)


def join_macro(bars: DataFrame, macro: DataFrame | None) -> DataFrame:
    """Left join on the date. Left to Spark to broadcast: it checks the size, and falls back to a shuffle on date."""
    return bars if macro is None else bars.join(macro, "date", "left")


def fill_macro(bars: DataFrame, spec: SeriesSpec = SeriesSpec(), back_fill: bool = True) -> DataFrame:
    """Fill the gaps of the macro columns along each series.

    Back filling the head uses later values; pass ``back_fill=False`` to leave it missing.
    """
    present = tuple(c for c in MACRO_COLUMNS if c in bars.columns)
    return number_rows(bars, spec, fills=present, back_fill=back_fill) if present else number_rows(bars, spec)


def present_macro(macro: DataFrame | None) -> DataFrame | None:
    """The macro columns that exist; a missing or empty macro source is skipped, not an error.

    Written once, a row per date: it is tested and joined, and may come from a scan of all orders.
    """
    names = [c for c in MACRO_COLUMNS if macro is not None and c in macro.columns]
    if not names:
        return None
    rows = materialise(macro.select("date", *names))
    return None if rows.isEmpty() else rows


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise EmptySourceError(f"no rows in {what}")
    return df


def prepare(
    bars: DataFrame,
    macro: DataFrame | None = None,
    spec: SeriesSpec = SeriesSpec(),
    back_fill: bool = True,
    check: bool = True,
) -> DataFrame:
    """Bars and macros to the feature table: join, fill, indicators, warm-up dropped, rows numbered.

    The joined bars and the features are each written once: both feed two
    branches (rows and block totals), and the bars may come from a scan of all ticks.
    """
    bars = bars.drop("Dividends", "Stock Splits")
    joined = materialise(join_macro(bars, present_macro(macro)))
    if check:
        require_rows(joined, "bars")
    present = tuple(c for c in MACRO_COLUMNS if c in joined.columns)
    features = materialise(engineer_features(joined, spec, keep_block=True, fill=present, back_fill=back_fill))
    return drop_warmup(features, spec)


def source_report(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of each source and whether it is empty."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows", (F.col("rows") == 0).alias("empty")) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, counts)
