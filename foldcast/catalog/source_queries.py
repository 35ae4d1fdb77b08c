"""Sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldcast.catalog import tables as T
from foldcast.catalog.registry import query, rounded
from foldcast.catalog.sql import W, ewm, label, metrics_sql, roll, with_
from foldcast.functions import columns as C
from foldcast.operators import metrics as M, windows
from foldcast.operators.folds import FoldSpec, assign_test_folds, drop_no_target
from foldcast.operators.indicators import drop_warmup, engineer_features
from foldcast.schema import BAR_SCHEMA, ENGINEERED, MACRO_COLUMNS, feature_columns
from foldcast.session import materialise, scratch_path
from foldcast.sources import bars as B, sinks

OHLCV = "symbol, date, open, high, low, close, volume"
FEATURE_DIGITS = [c for c in ENGINEERED if c not in ("DayOfWeek", "OBV", "Close_Lag_1", "Close_Lag_3", "Close_Lag_5")]
FEATURE_SQL = ", ".join(f"round({c}, 4) AS {c}" if c in FEATURE_DIGITS else c for c in ENGINEERED)


@query("src_bars", with_(f"SELECT {OHLCV} FROM bars", "bars"))
def src_bars(spark, sf):
    return T.daily_bars(spark, sf)


@query("src_bars_hourly", with_(f"SELECT {OHLCV} FROM hbars", "hbars"))
def src_bars_hourly(spark, sf):
    return T.hourly_bars(spark, sf)


@query(
    "src_bars_stored",
    with_(f"SELECT {OHLCV} FROM bars WHERE symbol IN ('A', 'N') AND date >= DATE '1996-01-01' AND date < DATE '2001-01-01'", "bars"),
)
def src_bars_stored(spark, sf):
    path = scratch_path(spark, "bars")
    T.daily_bars(spark, sf).repartition("symbol", F.year("date")).write.partitionBy("symbol").parquet(path)
    return B.read_bars(spark, path, "1996-01-01", "2001-01-01", ["a", "n"])


@query("src_macro", with_("SELECT date, SP500, VIX, TNX_Yield FROM macro", "macro"))
def src_macro(spark, sf):
    wide = T.macro(spark, sf)
    long = wide.select("date", F.explode(F.array(*[
        F.struct(F.lit(s).alias("symbol"), F.col(c).alias("close")) for s, c in B.MACRO_SYMBOLS.items()
    ])).alias("_b")).select("date", "_b.symbol", "_b.close")
    return B.macro_wide(long)


@query(
    "src_empty_guard",
    with_("SELECT 'bars' AS source, count(*) AS rows, count(*) = 0 AS empty FROM bars UNION ALL SELECT 'macro', count(*), count(*) = 0 FROM macro", "bars", "macro"),
)
def src_empty_guard(spark, sf):
    return B.source_report({"bars": B.require_rows(T.daily_bars(spark, sf), "bars"), "macro": T.macro(spark, sf)})


@query("src_prepare", with_(f"SELECT symbol, date, open, high, low, close, volume, SP500, VIX, TNX_Yield, {FEATURE_SQL}, rn, n FROM feat_all", "feat_all"))
def src_prepare(spark, sf):
    return rounded(T.features(spark, sf), 4, *FEATURE_DIGITS)


@query(
    "sink_features",
    with_("SELECT symbol, date, close, OBV, round(SMA_50, 4) AS SMA_50, round(RSI_14, 4) AS RSI_14, round(ATR_14, 4) AS ATR_14, DayOfWeek FROM feat", "feat"),
)
def sink_features(spark, sf):
    feats = T.features(spark, sf).drop("rn", "n")
    path = sinks.write_features(feats, scratch_path(spark, "features"))
    back = sinks.read_features(spark, path, feats.schema)
    return rounded(back.select("symbol", "date", "close", "OBV", "SMA_50", "RSI_14", "ATR_14", "DayOfWeek"), 4, "SMA_50", "RSI_14", "ATR_14")


COMPARE_SQL = "SELECT symbol, model, directional_accuracy, f1, \"precision\", recall, rmse, mae, mape, r2, max_error FROM m"


@query("sink_metrics", with_(COMPARE_SQL, "long", m=metrics_sql("long", False)))
def sink_metrics(spark, sf):
    table = M.compare_models(M.pooled_metrics(T.plain_forecasts(T.features(spark, sf))))
    path = sinks.write_table(table, scratch_path(spark, "model_comparison"))
    return spark.read.schema(table.schema).option("header", True).csv(path)


@query("norm_date", "SELECT event_id, event_type, CAST(ts AS DATE) AS date FROM events")
def norm_date(spark, sf):
    return T.table(spark, sf, "events").select("event_id", "event_type", C.strip_zone(F.col("ts")).alias("date"))


@query("drop_cols", with_(f"SELECT {OHLCV} FROM bars", "bars"))
def drop_cols(spark, sf):
    raw = T.daily_bars(spark, sf).withColumns({"Dividends": F.lit(0.0), "Stock Splits": F.lit(0.0)})
    return raw.drop("Dividends", "Stock Splits")


@query("rename_col", with_("SELECT symbol, date, close AS Current_Close FROM bars", "bars"))
def rename_col(spark, sf):
    return T.daily_bars(spark, sf).select("symbol", "date", "close").withColumnRenamed("close", "Current_Close")


@query("drop_warmup", with_("SELECT symbol, date, close, rn, n FROM feat", "feat"))
def drop_warmup_query(spark, sf):
    return drop_warmup(T.raw_features(spark, sf)).select("symbol", "date", "close", "rn", "n")


@query(
    "drop_no_target",
    with_(f"SELECT * FROM (SELECT symbol, date, close, lead(close) OVER ({W}) AS Target_Close, rn FROM nbars) WHERE Target_Close IS NOT NULL", "nbars"),
)
def drop_no_target_query(spark, sf):
    rows = windows.shift(T.numbered_bars(spark, sf), T.DAILY, {"Target_Close": ("close", -1)})
    return drop_no_target(rows).select("symbol", "date", "close", "Target_Close", "rn")


@query("select_features", with_(f"SELECT symbol, date, close, open, high, low, volume, SP500, VIX, TNX_Yield, {FEATURE_SQL} FROM feat_all", "feat_all"))
def select_features(spark, sf):
    feats = T.features(spark, sf)
    names = feature_columns(feats.columns, close_first=True)
    return rounded(feats.select("symbol", "date", *names), 4, *FEATURE_DIGITS)


@query(
    "clean_nonfinite",
    with_(
        f"""SELECT symbol, date, round(CASE WHEN close / nullif(c1, 0) > 0 THEN ln(close / nullif(c1, 0)) ELSE 0 END, 8) AS log_return,
        round(coalesce(close / nullif(c1, 0) - 1, 0), 8) AS change FROM (SELECT *, lag(close) OVER ({W}) AS c1 FROM hnbars)""",
        "hnbars",
    ),
)
def clean_nonfinite(spark, sf):
    rows = windows.shift(T.hourly_numbered(spark, sf), T.HOURLY, {"_before": ("close", 1)})
    change = C.or_default(C.pct_change(F.col("close"), F.col("_before")), 0.0)
    out = rows.select("symbol", "date", C.log_return(F.col("close"), F.col("_before")).alias("log_return"), change.alias("change"))
    return rounded(out, 8, "log_return", "change")


@query(
    "default_cols",
    with_(
        f"""SELECT symbol, date, round({roll('avg(close)', 'close', 20)}, 4) AS SMA_20, round({ewm('close', 12)}, 4) AS EMA_12,
        0.0::DOUBLE AS OBV, 1.0::DOUBLE AS Volume_Ratio FROM nbars""",
        "nbars",
    ),
)
def default_cols(spark, sf):
    out = engineer_features(materialise(T.daily_bars(spark, sf).drop("volume")), T.DAILY)
    assert not {"VIX_Change", "Corr_SP500_20"} & set(out.columns)
    return rounded(out.select("symbol", "date", "SMA_20", "EMA_12", "OBV", "Volume_Ratio"), 4, "SMA_20", "EMA_12")


@query(
    "clip_index",
    with_(
        """SELECT symbol, CAST(fold_id AS INTEGER) AS fold_id, count(*) AS test_rows, max(rn) AS last_rn FROM nbars
        JOIN bfolds f USING (symbol) WHERE rn >= train_end AND rn < test_end AND rn < nbars.n - 1 GROUP BY symbol, fold_id""",
        "nbars", "bfolds",
    ),
)
def clip_index(spark, sf):
    rows = windows.shift(T.numbered_bars(spark, sf), T.DAILY, {"Target_Close": ("close", -1)})
    tests = assign_test_folds(drop_no_target(rows), FoldSpec())
    return tests.groupBy("symbol", "fold_id").agg(F.count(F.lit(1)).alias("test_rows"), F.max("rn").alias("last_rn"))


@query(
    "mask_threshold",
    with_(f"SELECT symbol, date, label FROM (SELECT symbol, date, {label('close', 'c1')} AS label FROM (SELECT *, lag(close) OVER ({W}) AS c1 FROM hnbars)) WHERE label <> -1", "hnbars"),
)
def mask_threshold(spark, sf):
    rows = windows.shift(T.hourly_numbered(spark, sf), T.HOURLY, {"_before": ("close", 1)})
    labelled = rows.withColumn("label", C.direction_label(F.col("close"), F.col("_before")))
    return labelled.where(F.col("label") != -1).select("symbol", "date", "label")


@query(
    "mask_zero",
    with_("SELECT symbol, count(*) FILTER (y_true <> 0) AS used, round(100 * avg(abs((y_true - y_pred) / nullif(y_true, 0))), 4) AS mape FROM hnaive GROUP BY symbol", "hnaive"),
)
def mask_zero(spark, sf):
    y, p = F.col("y_true"), F.col("y_pred")
    out = T.naive_hourly(spark, sf).groupBy("symbol").agg(
        F.count_if(y != 0).alias("used"), (100 * F.avg(F.abs(C.ratio(y - p, y)))).alias("mape")
    )
    return rounded(out, 4, "mape")
