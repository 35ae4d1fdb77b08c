"""Joins, window primitives and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldcast.catalog import tables as T
from foldcast.catalog.registry import query, rounded
from foldcast.catalog.source_queries import FEATURE_DIGITS, FEATURE_SQL
from foldcast.catalog.sql import W, ewm, ewm_gaps, roll, with_
from foldcast.functions import columns as C
from foldcast.operators import stacking, windows
from foldcast.operators.calibration import vix_stats
from foldcast.operators.folds import FoldSpec, assign_test_folds, fold_membership, fold_split, series_lengths
from foldcast.operators.indicators import engineer_features
from foldcast.operators.joins import attach
from foldcast.sources.bars import fill_macro, join_macro
from foldcast.session import materialise


@query("join_macro", with_("SELECT symbol, date, close, SP500, VIX, TNX_Yield FROM joined", "joined"))
def join_macro_query(spark, sf):
    return join_macro(T.daily_bars(spark, sf), T.macro(spark, sf)).select("symbol", "date", "close", "SP500", "VIX", "TNX_Yield")


@query("fill_macro", with_("SELECT symbol, date, SP500, VIX, TNX_Yield, rn, n FROM filled", "filled"))
def fill_macro_query(spark, sf):
    return fill_macro(materialise(join_macro(T.daily_bars(spark, sf), T.macro(spark, sf)))).select("symbol", "date", "SP500", "VIX", "TNX_Yield", "rn", "n")


@query(
    "align_predictions",
    with_("SELECT symbol, fold_id, date, origin_date, y_true, last_pred, round(mean20_pred, 4) AS mean20_pred, round(mean50_pred, 4) AS mean50_pred FROM wide WHERE last_pred IS NOT NULL", "wide"),
)
def align_predictions(spark, sf):
    return rounded(T.plain_aligned(T.features(spark, sf)), 4, "mean20_pred", "mean50_pred")


@query(
    "align_predictions_mixed_dates",
    with_(
        """SELECT a.symbol, a.fold_id, a.date, a.origin_date, a.y_true, a.last_pred, round(b.mean20_pred, 4) AS mean20_pred,
        round(b.mean50_pred, 4) AS mean50_pred FROM (SELECT * REPLACE (origin_date AS date) FROM wide) a JOIN wide b USING (symbol, fold_id, date)""",
        "wide",
    ),
)
def align_predictions_mixed_dates(spark, sf):
    plain = T.plain_forecasts(T.features(spark, sf))
    return rounded(stacking.align_predictions(plain, T.PLAIN, "origin_of_first"), 4, "mean20_pred", "mean50_pred")


@query("join_context", with_("SELECT symbol, fold_id, date, round(VIX, 6) AS VIX FROM matrix", "matrix"))
def join_context(spark, sf):
    feats = T.features(spark, sf)
    out = stacking.join_context(T.plain_aligned(feats), feats)
    return rounded(out.select("symbol", "fold_id", "date", "VIX"), 6, "VIX")


@query("join_current_close", with_("SELECT symbol, fold_id, date, last_pred AS current_close FROM wide", "wide"))
def join_current_close(spark, sf):
    feats = T.features(spark, sf)
    return stacking.join_current_close(T.plain_aligned(feats), feats).select("symbol", "fold_id", "date", "current_close")


@query(
    "join_folds",
    with_(
        """SELECT symbol, CAST(fold_id AS INTEGER) AS fold_id, min(date) FILTER (rn < train_end) AS train_first, max(date) FILTER (rn < train_end) AS train_last,
        min(date) FILTER (rn >= train_end) AS test_first, max(date) FILTER (rn >= train_end) AS test_last,
        count(*) FILTER (rn < train_end) AS train_rows, count(*) FILTER (rn >= train_end) AS test_rows
        FROM nbars JOIN f USING (symbol) WHERE rn < test_end GROUP BY symbol, fold_id""",
        "nbars",
        f="""SELECT symbol, k AS fold_id, 300 + k * 100 AS train_end, 500 + k * 100 AS test_end
             FROM (SELECT symbol, max(n) AS n FROM nbars GROUP BY symbol), LATERAL (SELECT unnest(range(0, (n - 500) // 100 + 1)) AS k)""",
    ),
)
def join_folds(spark, sf):
    rows = T.numbered_bars(spark, sf)
    return fold_membership(rows, fold_split(series_lengths(rows), FoldSpec(300, 200, 100)))


@query(
    "join_scalars",
    with_("SELECT symbol, date, close, vix_current, round(vix_mean, 6) AS vix_mean FROM feat JOIN (SELECT symbol, arg_max(VIX, date) AS vix_current, avg(VIX) AS vix_mean FROM feat GROUP BY symbol) USING (symbol)", "feat"),
)
def join_scalars(spark, sf):
    feats = T.features(spark, sf)
    out = attach(feats.select("symbol", "date", "close"), vix_stats(feats), ["symbol"])
    return rounded(out, 6, "vix_mean")


@query("win_lag", with_(f"SELECT symbol, date, lag(close, 1) OVER ({W}) AS lag_1, lag(close, 3) OVER ({W}) AS lag_3, lag(close, 5) OVER ({W}) AS lag_5 FROM hnbars", "hnbars"))
def win_lag(spark, sf):
    out = windows.shift(T.hourly_numbered(spark, sf), T.HOURLY, {f"lag_{k}": ("close", k) for k in (1, 3, 5)})
    return out.select("symbol", "date", "lag_1", "lag_3", "lag_5")


@query("win_lead", with_(f"SELECT symbol, date, lead(close) OVER ({W}) AS Target_Close FROM nbars", "nbars"))
def win_lead(spark, sf):
    return windows.shift(T.numbered_bars(spark, sf), T.DAILY, {"Target_Close": ("close", -1)}).select("symbol", "date", "Target_Close")


@query("win_diff", with_(f"SELECT symbol, date, close - lag(close) OVER ({W}) AS diff FROM hnbars", "hnbars"))
def win_diff(spark, sf):
    return windows.difference(T.hourly_numbered(spark, sf), T.HOURLY, "close", "diff").select("symbol", "date", "diff")


@query("win_pct_change", with_(f"SELECT symbol, date, round(close / nullif(lag(close, 1) OVER ({W}), 0) - 1, 8) AS change_1, round(close / nullif(lag(close, 5) OVER ({W}), 0) - 1, 8) AS change_5 FROM hnbars", "hnbars"))
def win_pct_change(spark, sf):
    out = windows.percent_change(T.hourly_numbered(spark, sf), T.HOURLY, "close", {"change_1": 1, "change_5": 5})
    return rounded(out.select("symbol", "date", "change_1", "change_5"), 8, "change_1", "change_5")


@query(
    "win_rolling_mean",
    with_(f"SELECT symbol, date, round({roll('avg(close)', 'close', 14)}, 6) AS mean_14, round({roll('avg(close)', 'close', 20)}, 6) AS mean_20, round({roll('avg(close)', 'close', 50)}, 6) AS mean_50 FROM hnbars", "hnbars"),
)
def win_rolling_mean(spark, sf):
    out = windows.rolling(T.hourly_numbered(spark, sf), T.HOURLY, {f"mean_{k}": ("mean", "close", k) for k in (14, 20, 50)})
    return rounded(out.select("symbol", "date", "mean_14", "mean_20", "mean_50"), 6, "mean_14", "mean_20", "mean_50")


@query("win_rolling_std", with_(f"SELECT symbol, date, round({roll('stddev_samp(close)', 'close', 20)}, 6) AS std_20 FROM hnbars", "hnbars"))
def win_rolling_std(spark, sf):
    out = windows.rolling(T.hourly_numbered(spark, sf), T.HOURLY, {"std_20": ("std", "close", 20)})
    return rounded(out.select("symbol", "date", "std_20"), 6, "std_20")


@query(
    "win_rolling_corr",
    with_(f"SELECT symbol, date, round(coalesce({roll('covar_samp(close, volume)', 'close', 20)} / nullif({roll('stddev_samp(close)', 'close', 20)} * {roll('stddev_samp(volume)', 'volume', 20)}, 0), 0), 6) AS corr_20 FROM hnbars", "hnbars"),
)
def win_rolling_corr(spark, sf):
    out = windows.rolling_corr(T.hourly_numbered(spark, sf), T.HOURLY, "close", "volume", 20, "corr_20")
    return rounded(out.select("symbol", "date", "corr_20"), 6, "corr_20")


@query("win_ewm", with_(f"SELECT symbol, date, round({ewm('close', 12)}, 6) AS ewm_12, round({ewm('close', 26)}, 6) AS ewm_26, round({ewm('close', 9)}, 6) AS ewm_9, round({ewm('close', 50)}, 6) AS ewm_50 FROM hnbars", "hnbars"))
def win_ewm(spark, sf):
    out = windows.ewm(T.hourly_numbered(spark, sf), T.HOURLY, {f"ewm_{k}": ("close", k) for k in (12, 26, 9, 50)})
    return rounded(out.select("symbol", "date", "ewm_12", "ewm_26", "ewm_9", "ewm_50"), 6, "ewm_12", "ewm_26", "ewm_9", "ewm_50")


@query(
    "win_ewm_gaps",
    with_(
        "SELECT symbol, date, x, round(m12, 6) AS ewm_12, round(m26, 6) AS ewm_26 FROM b", "nbars",
        g="SELECT symbol, date, rn, CASE WHEN rn % 11 NOT IN (0, 4, 5, 6) THEN close END AS x FROM nbars", a=ewm_gaps("x", 12, "g"), b=ewm_gaps("x", 26, "a"),
    ),
)
def win_ewm_gaps(spark, sf):
    """Exponential means of closes of which the first and three in a row are missing, again and again."""
    rows = T.numbered_bars(spark, sf).withColumn("x", F.when(~(F.col("rn") % 11).isin(0, 4, 5, 6), F.col("close")))
    out = windows.ewm(rows, T.DAILY, {"ewm_12": ("x", 12), "ewm_26": ("x", 26)})
    return rounded(out.select("symbol", "date", "x", "ewm_12", "ewm_26"), 6, "ewm_12", "ewm_26")


@query("win_cumsum", with_(f"SELECT symbol, date, sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING) AS total FROM nbars", "nbars"))
def win_cumsum(spark, sf):
    return windows.running_sum(T.numbered_bars(spark, sf), T.DAILY, "volume", "total").select("symbol", "date", "total")


@query("win_fill", with_("SELECT symbol, date, VIX FROM filled", "filled"))
def win_fill(spark, sf):
    joined = materialise(join_macro(T.daily_bars(spark, sf), T.macro(spark, sf)).select("symbol", "date", "VIX"))
    return windows.fill_gaps(joined, T.DAILY, ("VIX",)).select("symbol", "date", "VIX")


@query("win_row_number", with_("SELECT symbol, date, rn, n FROM hnbars", "hnbars"))
def win_row_number(spark, sf):
    return T.hourly_numbered(spark, sf).select("symbol", "date", "rn", "n")


@query("win_consec_return", with_(f"SELECT symbol, date, round((close - c1) / nullif(c1, 0), 8) AS ret FROM (SELECT *, lag(close) OVER ({W}) AS c1 FROM nbars) WHERE c1 IS NOT NULL", "nbars"))
def win_consec_return(spark, sf):
    rows = windows.shift(T.numbered_bars(spark, sf), T.DAILY, {"_before": ("close", 1)}).where(F.col("_before").isNotNull())
    return rounded(rows.select("symbol", "date", C.ratio(F.col("close") - F.col("_before"), F.col("_before")).alias("ret")), 8, "ret")


def _indicator(name: str, outputs: list[str], digits: int, needs: str = "f3", exact: tuple[str, ...] = ()) -> None:
    """Register the columns of one indicator. Catalyst prunes the windows of all the others from the plan."""
    shown = ", ".join(c if c in exact else f"round({c}, {digits}) AS {c}" for c in outputs)

    @query(name, with_(f"SELECT symbol, date, {shown} FROM {needs}", needs))
    def run(spark, sf):
        return rounded(T.raw_features(spark, sf).select("symbol", "date", *outputs), digits, *[c for c in outputs if c not in exact])


_indicator("ind_sma", ["SMA_20", "SMA_50"], 4)
_indicator("ind_ema", ["EMA_12", "EMA_26"], 4, "f4")
_indicator("ind_macd", ["MACD", "MACD_Signal", "MACD_Hist"], 4, "f4")
_indicator("ind_rsi", ["RSI_14"], 6)
_indicator("ind_bollinger", ["BB_Upper", "BB_Lower", "BB_Width"], 4)
_indicator("ind_atr", ["ATR_14"], 4)
_indicator("ind_log_return", ["Log_Return"], 8)
_indicator("ind_volatility", ["Volatility_20"], 8)
_indicator("ind_obv", ["OBV"], 4, exact=("OBV",))
_indicator("ind_volume_ratio", ["Volume_Ratio"], 6)
_indicator("ind_lags", ["Close_Lag_1", "Close_Lag_3", "Close_Lag_5"], 4, exact=("Close_Lag_1", "Close_Lag_3", "Close_Lag_5"))
_indicator("ind_returns", ["Return_1d", "Return_5d"], 8)
_indicator("ind_corr", ["Corr_SP500_20"], 6)
_indicator("ind_index_return", ["SP500_Return_1d"], 8)
_indicator("ind_vix_change", ["VIX_Change"], 6)
_indicator("ind_dayofweek", ["DayOfWeek"], 0, exact=("DayOfWeek",))


@query("ind_true_range", with_("SELECT symbol, date, true_range FROM f2", "f2"))
def ind_true_range(spark, sf):
    rows = windows.shift(T.numbered_bars(spark, sf), T.DAILY, {"_before": ("close", 1)})
    return rows.select("symbol", "date", C.true_range(F.col("high"), F.col("low"), F.col("_before")).alias("true_range"))


@query("engineer_features", with_(f"SELECT symbol, date, {FEATURE_SQL}, rn, n FROM f4", "f4"))
def engineer_features_query(spark, sf):
    out = T.raw_features(spark, sf).drop("open", "high", "low", "close", "volume", "SP500", "VIX", "TNX_Yield")
    return rounded(out, 4, *FEATURE_DIGITS)
