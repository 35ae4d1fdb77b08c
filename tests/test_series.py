import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldcast.operators import windows
from foldcast.operators.indicators import drop_warmup, engineer_features
from foldcast.operators.joins import attach
from foldcast.operators.series import SeriesSpec, number_rows, running_totals
from foldcast.sources.bars import fill_macro
from tests.helpers import bars, collect

SMALL = SeriesSpec(time_block=37, row_block=256)


def expected(d):
    """Indicators of one symbol in pandas."""
    d = d.reset_index(drop=True).copy()
    c = d.close
    delta = c.diff()
    gain, loss = delta.clip(lower=0).fillna(0).rolling(14).mean(), (-delta.clip(upper=0)).fillna(0).rolling(14).mean()
    rsi = (100 - 100 / (1 + gain / loss)).replace([np.inf, -np.inf], 100.0).fillna(50.0)
    mid, std = c.rolling(20).mean(), c.rolling(20).std()
    tr = pd.concat([d.high - d.low, (d.high - c.shift()).abs(), (d.low - c.shift()).abs()], axis=1).max(axis=1)
    ema12, ema26 = c.ewm(span=12, adjust=False).mean(), c.ewm(span=26, adjust=False).mean()
    macd = ema12 - ema26
    signal = macd.ewm(span=9, adjust=False).mean()
    lr = np.log(c / c.shift()).fillna(0)
    out = {
        "SMA_20": mid, "SMA_50": c.rolling(50).mean(), "EMA_12": ema12, "EMA_26": ema26, "MACD": macd, "MACD_Signal": signal,
        "MACD_Hist": macd - signal, "RSI_14": rsi, "BB_Upper": mid + 2 * std, "BB_Lower": mid - 2 * std, "BB_Width": 4 * std / mid,
        "ATR_14": tr.rolling(14).mean(), "Log_Return": lr, "Volatility_20": lr.rolling(20).std().fillna(0),
        "OBV": (np.sign(delta) * d.volume).fillna(0).cumsum(), "Volume_Ratio": d.volume / d.volume.rolling(20).mean(),
        "Close_Lag_1": c.shift(1), "Close_Lag_3": c.shift(3), "Close_Lag_5": c.shift(5), "Return_1d": c.pct_change(1), "Return_5d": c.pct_change(5),
        "DayOfWeek": pd.to_datetime(d.date).dt.dayofweek,
    }
    if "SP500" in d:
        out["Corr_SP500_20"] = c.rolling(20).corr(d.SP500).fillna(0)
        out["SP500_Return_1d"] = d.SP500.pct_change().fillna(0)
        out["VIX_Change"] = d.VIX.diff()
    return pd.DataFrame(out)


@pytest.mark.parametrize("spec", [SeriesSpec(), SMALL])
@pytest.mark.parametrize("n,macro", [(200, False), (1300, True)])
def test_indicators_match_pandas(spark, spec, n, macro):
    frames = [bars(n, 42, "X", macro=macro), bars(n - 51, 7, "Y", start="2021-03-01", macro=macro)]
    got = collect(engineer_features(spark.createDataFrame(pd.concat(frames)), spec), "symbol", "date")
    for f in frames:
        mine, want = got[got.symbol == f.symbol[0]].reset_index(drop=True), expected(f)
        assert list(mine.rn) == list(range(len(f))) and set(mine.n) == {len(f)}
        for c in want:
            np.testing.assert_allclose(mine[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-8, err_msg=c)


def test_flat_prices(spark):
    d = bars(120)
    d[["open", "high", "low", "close"]] = 5.0
    got = collect(engineer_features(spark.createDataFrame(d), SMALL), "date")
    assert (got.RSI_14 == 50).all() and (got.OBV == 0).all() and (got.Log_Return == 0).all() and (got.ATR_14[13:] == 0).all()


def test_zero_price_gives_missing_not_infinite(spark):
    d = bars(80)
    d.loc[30, "close"] = 0.0
    got = collect(engineer_features(spark.createDataFrame(d), SMALL), "date")
    assert pd.isna(got.Return_1d[31]) and got.Log_Return[31] == 0 and got.Log_Return[30] == 0
    assert not np.isinf(got.drop(columns=["symbol", "date"]).astype(float)).any().any()


def test_warmup_is_49_rows(spark):
    d = bars(300, macro=True)
    for keep in (True, False):
        feats = collect(drop_warmup(engineer_features(spark.createDataFrame(d), SMALL, keep_block=keep), SMALL), "rn")
        assert len(feats) == 251 and list(feats.rn) == list(range(251)) and feats.date[0] == d.date[49] and set(feats.n) == {251}


def test_missing_inputs_use_defaults(spark):
    got = engineer_features(spark.createDataFrame(bars(60).drop(columns="volume")), SMALL)
    row = got.orderBy("date").tail(1)[0]
    assert row.OBV == 0 and row.Volume_Ratio == 1 and "VIX_Change" not in got.columns


def test_macro_fill(spark):
    d = bars(400, macro=True)
    gaps = np.random.default_rng(1).random(400) < 0.6
    d.loc[gaps, "VIX"] = np.nan
    d.loc[:150, "SP500"] = np.nan
    d.loc[395:, "TNX_Yield"] = np.nan
    df = spark.createDataFrame(d.astype(object).where(d.notna(), None), "symbol string, date date, open double, high double, low double, close double, volume double, SP500 double, VIX double, TNX_Yield double")
    got = collect(fill_macro(df, SeriesSpec(time_block=20)), "date")
    for c in ("VIX", "SP500", "TNX_Yield"):
        np.testing.assert_array_equal(got[c], d[c].ffill().bfill())
    ahead_only = collect(fill_macro(df, SeriesSpec(time_block=20), back_fill=False), "date")
    assert ahead_only.SP500[:151].isna().all() and ahead_only.SP500[151:].notna().all()


def test_window_primitives_across_blocks(spark):
    d = bars(900)
    rows = number_rows(spark.createDataFrame(d), SMALL)
    c = d.close
    moved = collect(windows.shift(rows, SMALL, {"back": ("close", 5), "ahead": ("close", -3)}), "date")
    np.testing.assert_allclose(moved.back.astype(float), c.shift(5))
    np.testing.assert_allclose(moved.ahead.astype(float), c.shift(-3))
    np.testing.assert_allclose(collect(windows.running_sum(rows, SMALL, "volume", "t"), "date").t, d.volume.cumsum())
    np.testing.assert_allclose(collect(windows.ewm(rows, SMALL, {"e": ("close", 26)}), "date").e, c.ewm(span=26, adjust=False).mean(), rtol=1e-12)
    got = collect(windows.rolling(rows, SMALL, {"lo": ("min", "close", 30), "hi": ("max", "close", 14)}), "date")
    np.testing.assert_allclose(got.lo.astype(float), c.rolling(30).min())
    np.testing.assert_allclose(got.hi.astype(float), c.rolling(14).max())
    for span in (9, 50, 200):
        got = collect(windows.ewm(rows, SMALL, {"e": ("close", span)}), "date").e
        np.testing.assert_allclose(got, c.ewm(span=span, adjust=False).mean(), rtol=1e-12)


def test_hourly_blocks(spark):
    n = 500
    d = pd.DataFrame({"symbol": "H", "date": pd.date_range("2024-01-01", periods=n, freq="3h"), "v": np.arange(n, dtype=float)})
    spec = SeriesSpec(unit="hour", time_block=100, row_block=256)
    got = collect(number_rows(spark.createDataFrame(d), spec), "date")
    assert list(got.rn) == list(range(n))


def test_running_totals_in_blocks(spark):
    d = pd.DataFrame({"k": ["a"] * 500 + ["b"] * 300, "i": list(range(500)) + list(range(300)), "x": np.random.default_rng(3).normal(size=800)})
    got = collect(running_totals(spark.createDataFrame(d), ["k"], "i", {"s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))}, block=64), "k", "i")
    g = d.groupby("k").x
    np.testing.assert_allclose(got.s, g.cumsum(), atol=1e-9)
    np.testing.assert_allclose(got.lo, g.cummin())
    np.testing.assert_allclose(got.hi, g.cummax())


def test_attach_gives_the_same_rows_broadcast_or_salted(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    small = rows.select("k").distinct().where("k <> 'k7'").withColumn("v", F.length("k"))
    for how in ("inner", "left"):
        a = collect(attach(rows, small, ["k"], how), "id")
        b = collect(attach(rows, small, ["k"], how, limit=1), "id")[list(a.columns)]
        pd.testing.assert_frame_equal(a, b)


def with_gaps(spark, gaps, n=900):
    d = bars(n)
    d.loc[list(gaps), "close"] = np.nan
    d = d[["symbol", "date", "open", "high", "low", "close", "volume"]]
    df = spark.createDataFrame(d.astype(object).where(d.notna(), None), "symbol string, date date, open double, high double, low double, close double, volume double")
    return d, df


GAPS = {
    "start": range(5), "middle": [100], "three in a row": [300, 301, 302], "across a sub-block": range(250, 262),
    "every third": range(0, 900, 3), "one in fifteen left": [i for i in range(900) if i % 15], "a whole sub-block": range(200, 520), "end": range(890, 900),
}


@pytest.mark.parametrize("where", GAPS)
def test_exponential_means_over_gaps(spark, where):
    d, df = with_gaps(spark, GAPS[where])
    rows = number_rows(df, SMALL)
    got = collect(windows.ewm(rows, SMALL, {f"e{k}": ("close", k) for k in (3, 12, 26)}), "date")
    for k in (3, 12, 26):
        np.testing.assert_allclose(got[f"e{k}"].astype(float), d.close.ewm(span=k, adjust=False).mean(), rtol=1e-10)


def test_both_forms_of_exponential_means_agree(spark):
    d, df = with_gaps(spark, [])
    rows = number_rows(df, SMALL)
    a, b = (collect(windows.ewm(rows, SMALL, {"e": ("close", 26)}, gaps), "date").e for gaps in (True, False))
    np.testing.assert_allclose(a, b, rtol=1e-12)


def test_indicators_over_missing_closes(spark):
    d, df = with_gaps(spark, [0, 70, 71, 72, 255, 256])
    got = collect(engineer_features(df, SMALL), "date")
    fast, slow = (d.close.ewm(span=k, adjust=False).mean() for k in (12, 26))
    np.testing.assert_allclose(got.MACD.astype(float), fast - slow, rtol=1e-8, atol=1e-9)
    np.testing.assert_allclose(got.MACD_Signal.astype(float), (fast - slow).ewm(span=9, adjust=False).mean(), rtol=1e-8, atol=1e-9)


def test_rows_without_a_series_or_a_time_are_an_error(spark):
    """They are never dropped in silence."""
    df = spark.createDataFrame(bars(20))
    for column in ("symbol", "date"):
        broken = df.withColumn(column, F.when(F.col("close") < df.agg(F.avg("close")).first()[0], F.col(column)))
        with pytest.raises(Exception, match=f"a row has no {column}"):
            number_rows(broken, SMALL).count()
        with pytest.raises(Exception, match=f"a row has no {column}"):
            engineer_features(broken, SMALL).collect()
