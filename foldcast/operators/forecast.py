"""Business-day calendar, recursive multi-day forecasts and their intervals.

A forecast step needs only a bounded tail of each series, so the whole state of
a symbol is one row: its current features, short arrays of recent values and
the running values of the recursive indicators. All steps of a batch of symbols
run in one task, one after another, on arrays over the symbols.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldcast.functions import columns as C
from foldcast.operators.calibration import interval_bounds
from foldcast.operators.joins import attach
from foldcast.operators.learners import LearnerRun
from foldcast.operators.sequence_fit import window_guess
from foldcast.schema import ENGINEERED
from foldcast.session import scratch_path

# Executors need not have this package installed: the step over arrays travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOGETHER = 500  # symbols moved on together


def business_days(last: Column, count: int) -> Column:
    """Array of the next ``count`` weekdays after ``last`` (Monday to Friday, no holidays)."""
    span = F.sequence(F.date_add(last, 1), F.date_add(last, count // 5 * 7 + 9))
    return F.slice(F.filter(span, lambda d: F.weekday(d) < 5), 1, count)


def future_calendar(features: DataFrame, count: int) -> DataFrame:
    """``symbol, step, date`` for the next ``count`` business days of each symbol."""
    last = features.groupBy("symbol").agg(F.max("date").alias("last_date"))
    return last.select("symbol", F.posexplode(business_days(F.to_date("last_date"), count)).alias("step", "date"))


# How many recent values each indicator family needs.
TAILS = {"_c": ("close", 50), "_tr": ("_range", 14), "_lr": ("Log_Return", 20), "_v": ("volume", 20), "_sp": ("SP500", 20)}


def forecast_state(features: DataFrame, names: list[str], time_step: int = 0) -> DataFrame:
    """One row per symbol: the last bar with its features, recent values, and (for sequence models) the last windows rows."""
    keep = max(time_step, 50)
    tail = features.where(F.col("rn") >= F.col("n") - keep)
    tail = tail.withColumn("_range", C.true_range(F.col("high"), F.col("low"), F.col("Close_Lag_1")))
    present = {a: (c, k) for a, (c, k) in TAILS.items() if c in tail.columns}
    recent = F.sort_array(F.collect_list(F.struct("rn", *[F.col(c) for c, _ in present.values()], F.array(*names).alias("_row"))))
    last = [F.max_by(c, "rn").alias(c) for c in dict.fromkeys(["date", "open", "high", "low", "close", *names])]
    # At most ``keep`` rows per symbol reach this aggregate.
    state = tail.groupBy("symbol").agg(recent.alias("_recent"), *last)
    arrays = [F.slice(F.col("_recent")[c], -k, k).alias(a) for a, (c, k) in present.items()]
    window = [F.slice(F.col("_recent")["_row"], -time_step, time_step).alias("_win")] if time_step else []
    return state.select("symbol", *[c for c in state.columns if c not in ("symbol", "_recent")], *arrays, *window)


class TreeArrays:
    """The trees of an ensemble as flat arrays; a split goes left up to its threshold."""

    def __init__(self, root: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, weight: np.ndarray) -> None:
        self.root, self.feature, self.threshold, self.left, self.right, self.value, self.weight = root, feature, threshold, left, right, value, weight

    @classmethod
    def of(cls, model) -> TreeArrays:
        """From a fitted model's own table of nodes: it is written below the shared folder and read back once."""
        spark = SparkSession.active()
        path = scratch_path(spark, "trees")
        model.write().save(path)
        data = spark.read.parquet(f"{path}/data")
        if "nodeData" in data.columns:
            data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
        split = F.col("split")
        rows = data.select(
            "tree", "id", "prediction", "leftChild", "rightChild", split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], 0).alias("threshold")
        ).toPandas().sort_values(["tree", "id"], ignore_index=True)
        first = np.searchsorted(rows.tree.to_numpy(), np.arange(model.getNumTrees))
        base = first[rows.tree.to_numpy()]
        leaf = rows.leftChild.to_numpy() < 0
        own = np.arange(len(rows))
        return cls(
            first, np.where(leaf, 0, rows.feature.to_numpy()), np.where(leaf, np.inf, rows.threshold.fillna(0).to_numpy()),
            np.where(leaf, own, base + rows.leftChild.to_numpy()), np.where(leaf, own, base + rows.rightChild.to_numpy()),
            rows.prediction.to_numpy(), np.array(model.treeWeights) / (1.0 if isinstance(model, GBTRegressionModel) else len(first)),
        )

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.root, (len(x), len(self.root)))
        row = np.arange(len(x))[:, None]
        while True:
            below = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            if (below == at).all():
                return self.value[at] @ self.weight
            at = below


def _deviations(a: np.ndarray) -> np.ndarray:
    return a - a.mean(axis=1, keepdims=True)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN over zero."""
    return np.where(b == 0, np.nan, a / np.where(b == 0, 1.0, b))


def _decayed(old: np.ndarray, span: int, x: np.ndarray) -> np.ndarray:
    a = 2.0 / (span + 1)
    return old * (1.0 - a) + x * a


class Paths:
    """Last bars of many symbols, moved on together: ``now`` holds a value per symbol, ``tail`` its recent values by column."""

    def __init__(self, now: dict[str, np.ndarray], tail: dict[str, np.ndarray], window: np.ndarray | None, names: list[str]) -> None:
        self.now, self.tail, self.window, self.names = now, tail, window, names

    def matrix(self) -> np.ndarray:
        return np.column_stack([self.now[c] for c in self.names])

    def advance(self, price: np.ndarray, weekday: np.ndarray) -> None:
        """Append a bar with close = high = low = ``price``; all other inputs stay, every feature is recomputed."""
        now, before = self.now, self.now["close"]
        more = {"_c": price, "_tr": np.abs(price - before), "_lr": np.log(np.where(_ratio(price, before) > 0, _ratio(price, before), 1.0))}
        more |= {"_v": now["volume"]} if "_v" in self.tail else {}
        more |= {"_sp": now["SP500"]} if "_sp" in self.tail else {}
        tail = {a: np.column_stack([self.tail[a][:, 1:], v]) for a, v in more.items()}
        c, c20 = tail["_c"], tail["_c"][:, -20:]
        moves = np.diff(c[:, -15:], axis=1)
        gain, loss = np.maximum(moves, 0).mean(axis=1), np.maximum(-moves, 0).mean(axis=1)
        mean20, std20 = c20.mean(axis=1), c20.std(axis=1, ddof=1)
        upper, lower = mean20 + 2 * std20, mean20 - 2 * std20
        fast, slow = _decayed(now["EMA_12"], 12, price), _decayed(now["EMA_26"], 26, price)
        signal = _decayed(now["MACD_Signal"], 9, fast - slow)
        made = {
            "SMA_20": mean20, "SMA_50": c.mean(axis=1), "EMA_12": fast, "EMA_26": slow, "MACD": fast - slow, "MACD_Signal": signal, "MACD_Hist": fast - slow - signal,
            "RSI_14": np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), 100.0 - 100.0 / (1.0 + gain / np.where(loss == 0, 1.0, loss))),
            "BB_Upper": upper, "BB_Lower": lower, "BB_Width": _ratio(upper - lower, mean20), "ATR_14": tail["_tr"].mean(axis=1),
            "Log_Return": more["_lr"], "Volatility_20": tail["_lr"].std(axis=1, ddof=1), "Close_Lag_1": before, "Close_Lag_3": c[:, -4], "Close_Lag_5": c[:, -6],
            "Return_1d": _ratio(price - before, before), "Return_5d": _ratio(price - c[:, -6], c[:, -6]), "DayOfWeek": weekday.astype(float),
        }
        if "_v" in tail:
            made["OBV"] = now["OBV"] + np.sign(price - before) * now["volume"]
            made["Volume_Ratio"] = _ratio(now["volume"], tail["_v"].mean(axis=1))
        if "_sp" in tail:
            a, b = _deviations(c20), _deviations(tail["_sp"])
            made["Corr_SP500_20"] = np.nan_to_num(_ratio((a * b).sum(axis=1), np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))))
            made["SP500_Return_1d"] = np.zeros(len(price))
        if "VIX" in now:
            made["VIX_Change"] = np.zeros(len(price))
        self.tail = tail
        self.now = {**now, **{k: v for k, v in made.items() if k in now}, "close": price, "high": price, "low": price}
        if self.window is not None:
            self.window = np.concatenate([self.window[:, 1:], self.matrix()[:, None, :]], axis=1)


def forecast_recursive(features: DataFrame, run: LearnerRun, count: int = 30) -> DataFrame:
    """``symbol, model, step, date, y_pred`` for the next ``count`` business days, all steps in one pass over one row per symbol.

    The model travels to the tasks as flat arrays; each batch of symbols is scored and moved on ``count`` times. Exponential
    means and the volume balance continue from their values on the last bar.

    A sequence model has no leaves that bound it: a gain above one would multiply a forecast day by day. So the features of bars
    that are forecasts themselves enter its window within what is known of each: the training range of the last fold, widened by
    the bars of the last window. Stored bars enter as they are, so the first day is the plain one-step forecast.

    A symbol with fewer rows than a step looks back on (50, or the window of a
    sequence model), or without a scaler because the last fold did not train on
    it, keeps its last close on every day.
    """
    names, t = run.features, run.time_step
    prefixes = ("min_", "range_") if t else ("mean_", "std_")
    arrays = [F.array(*[p + f for f in names]).alias(a) for p, a in zip(prefixes, ("_shift", "_width"))]
    state = attach(forecast_state(features, names, t), run.last_stats.select("symbol", *arrays), ["symbol"], "left")
    full = (F.size("_c") == TAILS["_c"][1]) & F.col("_shift").isNotNull()
    full = full & (F.size("_win") == t) if t else full
    days = business_days(F.to_date("date"), count)
    state = state.withColumns({"_full": full, "_days": days, "_weekdays": F.transform(days, lambda d: F.weekday(d))})
    kept = state.where(~F.col("_full")).select("symbol", "_days", F.array_repeat(F.col("close").cast("double"), count).alias("_path"))
    spark, close = features.sparkSession, names.index("close")
    sent = spark.sparkContext.broadcast(run.params if t else [TreeArrays.of(m) for m in run.last_model.stages])
    numbers = [c for c in dict.fromkeys(["open", "high", "low", "close", *names, *ENGINEERED]) if c in state.columns]
    tails = [a for a in TAILS if a in state.columns]

    def run_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(first, TOGETHER)
                size = part.num_rows

                def table(c: str) -> np.ndarray:
                    return part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(size, -1)

                window = part.column("_win").flatten().flatten().to_numpy(zero_copy_only=False).reshape(size, t, len(names)) if t else None
                now = {c: part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in numbers}
                paths = Paths(now, {a: table(a) for a in tails}, window, names)
                shift, width, weekdays = table("_shift"), table("_width"), table("_weekdays")
                if t:
                    known = (window - shift[:, None, :]) / width[:, None, :]
                    low, high = np.minimum(known.min(axis=1, keepdims=True), 0.0), np.maximum(known.max(axis=1, keepdims=True), 1.0)
                out = np.empty((size, count))
                for i in range(count):
                    if t:
                        x = (paths.window - shift[:, None, :]) / width[:, None, :]
                        guess = window_guess(np.clip(x, low, high), sent.value)
                    else:
                        x = (paths.matrix() - shift) / width
                        guess = sum(half.predict(x) for half in sent.value) / len(sent.value)
                    out[:, i] = guess * width[:, close] + shift[:, close]
                    paths.advance(out[:, i], weekdays[:, i])
                edges = pa.array(np.arange(size + 1) * count, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("symbol"), part.column("_days"), pa.ListArray.from_arrays(edges, pa.array(out.ravel()))], names=["symbol", "_days", "_path"])

    done = state.where("_full").select("symbol", *numbers, *tails, *(["_win"] if t else []), "_shift", "_width", "_weekdays", "_days")
    done = done.mapInArrow(run_paths, "symbol string, _days array<date>, _path array<double>").unionByName(kept)
    steps = F.posexplode(F.arrays_zip("_days", "_path")).alias("step", "_at")
    return done.select("symbol", F.lit(run.model_name).alias("model"), steps).select(
        "symbol", "model", "step", F.col("_at._days").alias("date"), F.col("_at._path").alias("y_pred")
    )


def future_interval(wide: DataFrame, fit: DataFrame, offsets: DataFrame, vix: DataFrame, inputs: list[str], use_vix: bool = True) -> DataFrame:
    """Blend the base forecasts (VIX held at its last value) and bound the blend."""
    joined = attach(wide, vix.join(fit.select("symbol", "intercept", "coef"), "symbol").join(offsets, "symbol"), ["symbol"])
    values = [F.col(c) for c in inputs] + ([F.col("vix_current")] if use_vix else [])
    hybrid = sum((F.col("coef")[i] * v for i, v in enumerate(values)), F.col("intercept"))
    return joined.withColumn("hybrid", hybrid).withColumns(interval_bounds(F.col("hybrid"))).drop(
        "intercept", "coef", "lower_offset", "upper_offset", "n_residuals", "vix_current", "vix_mean"
    )
