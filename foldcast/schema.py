"""Column names and schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

# Index symbols and the column each one becomes.
MACRO_SYMBOLS = {"^GSPC": "SP500", "^VIX": "VIX", "^TNX": "TNX_Yield"}

BAR_COLUMNS = ["open", "high", "low", "close", "volume"]
MACRO_COLUMNS = ["SP500", "VIX", "TNX_Yield"]

# Engineered columns in the order they are created.
ENGINEERED = [
    "SMA_20", "SMA_50", "EMA_12", "EMA_26", "MACD", "MACD_Signal", "MACD_Hist", "RSI_14",
    "BB_Upper", "BB_Lower", "BB_Width", "ATR_14", "Log_Return", "Volatility_20", "OBV", "Volume_Ratio",
    "Close_Lag_1", "Close_Lag_3", "Close_Lag_5", "Return_1d", "Return_5d",
    "Corr_SP500_20", "SP500_Return_1d", "VIX_Change", "DayOfWeek",
]

PREDICTION_COLUMNS = ["symbol", "model", "fold_id", "origin_date", "date", "y_true", "y_pred"]


def feature_columns(columns, close_first: bool = False) -> list[str]:
    """Model inputs among ``columns``: bars, macros and engineered columns, close first for sequence models."""
    known = BAR_COLUMNS + MACRO_COLUMNS + ENGINEERED
    present = [c for c in known if c in set(columns)]
    if close_first:
        present = ["close"] + [c for c in present if c != "close"]
    return present
