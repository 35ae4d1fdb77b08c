"""Writing features, forecasts, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldcast.functions import columns as C


def write_features(features: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Overwrite the feature table: parquet by symbol, or CSV with a header.

    Rows are spread by symbol and year before the write, so that one hot
    symbol is written by many tasks and no task writes many small files.
    """
    rows = features.drop("rn", "n", "blk")
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.repartition("symbol", F.year("date")).write.mode("overwrite").partitionBy("symbol").parquet(path)
    return path


def read_features(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def write_forecast(forecast: DataFrame, path: str, model: str) -> str:
    """One model's forecast as ``symbol, date, Predicted Close <model>`` in CSV."""
    rows = forecast.where(F.col("model") == model).select("symbol", "date", F.col("y_pred").alias(f"Predicted Close {model}"))
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path


def combined_forecast(forecast: DataFrame, models: dict[str, str]) -> DataFrame:
    """Wide forecast: one ``Predicted Close <label>`` column per model and the bounds of the rows that have them.

    ``models`` maps a label to a model name. One shuffle on symbol and date.
    """
    bounds = [(c, label) for c, label in (("lower", "Conf Lower"), ("upper", "Conf Upper")) if c in forecast.columns]
    return forecast.groupBy("symbol", "date").agg(
        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(f"Predicted Close {label}") for label, m in models.items()],
        *[F.max(c).alias(label) for c, label in bounds],
    )


def write_table(df: DataFrame, path: str) -> str:
    """CSV with a header, overwriting: comparison and combined forecast tables."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def forecast_path(base: str, model: str) -> str:
    return f"{base.rstrip('/')}/future_predictions_{model.lower().replace(' ', '_')}"


def model_labels(preds: DataFrame) -> DataFrame:
    """Models with the label used in file names."""
    return preds.select("model").distinct().withColumn("label", C.file_label(F.col("model")))
