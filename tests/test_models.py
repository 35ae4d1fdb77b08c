from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldcast.operators import baselines as B, calibration as K, forecast as FC, learners as L, stacking as S
from foldcast.operators.folds import FoldSpec, assign_test_folds
from foldcast.operators.indicators import drop_warmup, engineer_features
from foldcast.operators.scaling import minmax_stats, standard_stats
from foldcast.operators.sequences import seq_windows, sequence_counts
from foldcast.operators.folds import fold_split, series_lengths
from foldcast.operators.series import SeriesSpec, number_rows
from tests.helpers import bars, collect

SMALL = SeriesSpec(time_block=50, row_block=256)
FOLDS = FoldSpec(150, 40, 40)


@pytest.fixture(scope="module")
def feats(spark):
    d = pd.concat([bars(330, 42, "X", macro=True), bars(330, 9, "Y", macro=True, level=3000.0)])
    return drop_warmup(engineer_features(spark.createDataFrame(d), SMALL), SMALL).checkpoint()


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    from foldcast.session import shared_dir

    shared_dir(spark)


# ---- baselines


def closes(spark, values, symbol="X"):
    d = pd.DataFrame({"symbol": symbol, "date": pd.bdate_range("2020-01-01", periods=len(values)).date, "close": np.asarray(values, float)})
    return number_rows(spark.createDataFrame(d), SMALL)


def test_naive(spark):
    got = collect(B.naive_baseline(closes(spark, [100, 102, 101, 103, 105]), FoldSpec(3, 2, 2), SMALL), "date")
    assert list(got.y_pred) == [101, 103] and list(got.y_true) == [103, 105]


def least_squares(z, p=5):
    x = np.column_stack([z[p - k : len(z) - k] for k in range(1, p + 1)])
    return np.linalg.lstsq(x, z[p:], rcond=None)[0]


def test_arima_forecast(spark):
    walk = np.random.default_rng(42).normal(0, 1, 200).cumsum() + 100
    folds = FoldSpec(150, 25, 25)
    got = collect(B.arima_baseline(closes(spark, walk), folds, SMALL), "fold_id", "date")
    assert len(got) == 50 and got.y_pred.notna().all()
    fits = collect(B.arima_fits(closes(spark, walk), folds, SMALL), "fold_id")
    for k, end in enumerate((150, 175)):
        z = np.diff(walk[:end])
        phi = least_squares(z)
        np.testing.assert_allclose(fits.phi[k], phi, atol=1e-9)
        recent, price, path = list(z[:-6:-1]), walk[end - 1], []
        for _ in range(25):
            move = float(np.dot(phi, recent))
            price += move
            recent = [move, *recent[:-1]]
            path.append(price)
        np.testing.assert_allclose(got.y_pred[25 * k : 25 * k + 25], path, atol=1e-8)


def test_arima_falls_back_to_last_price(spark):
    got = collect(B.arima_baseline(closes(spark, [1.0] * 20 + [2.0] * 10), FoldSpec(20, 10, 10), SMALL), "date")
    assert list(got.y_pred) == [1.0] * 10
    short = collect(B.arima_baseline(closes(spark, np.arange(20.0) ** 2), FoldSpec(12, 4, 4), SMALL), "fold_id", "date")
    assert list(short.y_pred[:4]) == [121.0] * 4  # six rows with five lags are too few


# ---- calibration


def residual_table(spark, values, model="m"):
    return spark.createDataFrame([("X", model, float(v)) for v in values], "symbol string, model string, residual double")


def test_offsets_and_multiplier(spark):
    r = K.quantile_offsets(residual_table(spark, [1, 2, 4, 9])).collect()[0]
    assert abs(r.lower_offset - 1.075) < 1e-12 and abs(r.upper_offset - 8.625) < 1e-12 and r.n_residuals == 4
    from foldcast.functions.columns import volatility_multiplier

    for now, want in ((40, 2), (10, 0.5), (100, 2), (1, 0.5), (25, 1.25)):
        assert spark.range(1).select(volatility_multiplier(F.lit(float(now)), F.lit(20.0))).first()[0] == want


@pytest.mark.parametrize("kind", ["normal", "ties", "skew", "tiny"])
def test_exact_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(8)
    values = {
        "normal": rng.normal(size=20000),
        "ties": np.r_[np.zeros(7000), rng.normal(size=13000)],
        "skew": np.exp(rng.normal(0, 4, 20000)),
        "tiny": np.array([3.0]),
    }[kind]
    probs = (0.0, 0.025, 0.5, 0.975, 1.0)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "X", "v": values})).repartition(7)
    for margin in (0.005, 0.0):
        row = K.exact_quantiles(df, ("symbol",), "v", probs, margin).collect()[0]
        np.testing.assert_allclose([row[f"q{i}"] for i in range(5)], np.percentile(values, [100 * p for p in probs]), rtol=1e-12)


def test_large_groups_are_cut_until_slices_are_small(spark):
    """One group of a million values next to a small one: no ranked slice has more rows than the bound, and the quantiles are exact."""
    n, limit = 1_000_000, 700
    wide = spark.range(n).select(F.lit("X").alias("symbol"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 7.0).alias("v"))
    heavy = spark.range(30_000).select(F.lit("Z").alias("symbol"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(-1.0).alias("v"))
    df = wide.unionByName(heavy).unionByName(spark.createDataFrame([("Y", 1.0), ("Y", 4.0)], "symbol string, v double"))
    at = [(F.col("n") - 1) * p for p in (0.025, 0.5, 0.975)]
    ranks = [r for h in at for r in (F.floor(h), F.ceil(h))]
    inside, needed = K.rank_slices(df, ["symbol"], "v", ranks, [0.02, 0.03, 0.97, 0.98], limit)
    assert needed.where(F.col("_lo") < F.col("_hi")).agg(F.max("_size")).first()[0] <= limit
    assert inside.where("symbol = 'X'").count() <= 6 * limit
    got = {r.symbol: r for r in K.exact_quantiles(df, ("symbol",), "v", (0.025, 0.5, 0.975), limit=limit).collect()}
    values = {"X": np.arange(n) / 7.0, "Y": [1.0, 4.0], "Z": np.where(np.arange(30_000) % 3 == 0, np.arange(30_000.0), -1.0)}
    for s, v in values.items():
        np.testing.assert_allclose([got[s].q0, got[s].q1, got[s].q2], np.percentile(v, [2.5, 50, 97.5]), rtol=1e-12)


def test_coverage(spark):
    def report(y, lo, hi):
        rows = [("X", "m", float(a), float(b), float(c)) for a, b, c in zip(y, lo, hi)]
        return K.coverage_report(spark.createDataFrame(rows, "symbol string, model string, y_true double, lower double, upper double")).collect()[0]

    r = report([1, 2, 3], [0, 1, 2], [2, 3, 4])
    assert r.empirical_coverage == 1 and r.n_inside == 3 and "OVER" in r.flag and not r.is_well_calibrated and r.n_residuals == "N/A"
    assert "UNDER" in report([9, 9, 9], [0, 0, 0], [1, 1, 1]).flag
    r = report(list(range(100)), [0] * 100, [94] * 100)
    assert r.empirical_coverage == 0.95 and r.is_well_calibrated
    assert report([5], [5], [5]).n_inside == 1


def test_wider_with_higher_volatility(spark):
    preds = spark.createDataFrame([("X", "m", 100.0)], "symbol string, model string, y_pred double")
    offsets = K.quantile_offsets(residual_table(spark, [-2, -1, 1, 2]))

    def width(now):
        vix = spark.createDataFrame([("X", float(now), 20.0)], "symbol string, vix_current double, vix_mean double")
        r = K.with_interval(preds, offsets, vix).collect()[0]
        return r.upper - r.lower

    assert width(30) > width(20) > width(12)


def test_vix_default(spark):
    r = K.vix_stats(spark.createDataFrame([("X", 1.0)], "symbol string, close double")).collect()[0]
    assert (r.vix_current, r.vix_mean) == (20.0, 20.0)


# ---- scaling and sequences


def test_scalers_use_training_rows_only(spark, feats):
    names = ["close", "volume", "RSI_14"]
    got_s, got_m = collect(standard_stats(feats, FOLDS, names), "symbol", "fold_id"), collect(minmax_stats(feats, FOLDS, names), "symbol", "fold_id")
    all_rows = collect(feats, "symbol", "rn")
    for (_, s), (_, m) in zip(got_s.iterrows(), got_m.iterrows()):
        train = all_rows[(all_rows.symbol == s.symbol) & (all_rows.rn < 150 + 40 * s.fold_id)]
        for f in names:
            np.testing.assert_allclose([s[f"mean_{f}"], s[f"std_{f}"]], [train[f].mean(), train[f].std(ddof=0)], rtol=1e-10)
            np.testing.assert_allclose([m[f"min_{f}"], m[f"range_{f}"]], [train[f].min(), train[f].max() - train[f].min()], rtol=1e-12)


def test_constant_feature_scales_by_one(spark, feats):
    flat = feats.withColumns({"flat": F.lit(3.0), "tenth": F.lit(0.1), "price": F.lit(1234.56), "odd": F.lit(4.37)})
    for r in standard_stats(flat, FOLDS, ["flat", "tenth", "price", "odd"]).collect():
        assert (r.std_flat, r.std_tenth, r.std_price, r.std_odd) == (1.0, 1.0, 1.0, 1.0)
        assert (r.mean_tenth, r.mean_price) == (0.1, 1234.56)
    assert {r.range_flat for r in minmax_stats(flat, FOLDS, ["flat"]).collect()} == {1.0}


def test_sequence_windows(spark, feats):
    got = collect(seq_windows(feats, SMALL, ["close", "volume"], 90, "double"), "symbol", "rn")
    rows = collect(feats, "symbol", "rn")
    x = rows[rows.symbol == "Y"].reset_index(drop=True)
    mine = got[got.symbol == "Y"].reset_index(drop=True)
    assert len(mine) == len(x) - 90
    for i in (0, 77, len(mine) - 1):
        np.testing.assert_allclose(np.array([list(r) for r in mine.window[i]]), x[["close", "volume"]].iloc[i : i + 90])
        assert mine.close[i] == x.close[i + 90]
    counts = collect(sequence_counts(feats, fold_split(series_lengths(feats), FOLDS)), "symbol", "fold_id")
    assert list(counts[counts.symbol == "X"].train_sequences) == [60, 100, 140] and set(counts.test_sequences) == {40}


# ---- stacking


def test_ridge_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    n = 60
    x = rng.normal(100, 10, (n, 3))
    y = x @ [0.5, 0.3, 0.1] + rng.normal(0, 2, n)
    d = pd.DataFrame({"symbol": "X", "fold_id": 0, "date": pd.date_range("2020-01-01", periods=n).date, "y_true": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]})
    matrix = S.number_aligned(spark.createDataFrame(d))
    fit = S.ridge_fit(matrix, ["a", "b", "c"]).collect()[0]
    k = int(n * 0.8)
    xt, yt = x[:k], y[:k]

    def solve(xs, ys, alpha):
        xc, yc = xs - xs.mean(0), ys - ys.mean()
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        return w, ys.mean() - xs.mean(0) @ w

    errors = {}
    for alpha in S.ALPHAS:
        out = []
        for i in range(k):
            w, b = solve(np.delete(xt, i, 0), np.delete(yt, i), alpha)
            out.append((yt[i] - xt[i] @ w - b) ** 2)
        errors[alpha] = np.mean(out)
    best = min(errors, key=errors.get)
    w, b = solve(xt, yt, best)
    assert fit.alpha == best and abs(fit.loo_mse - errors[best]) < 1e-9
    np.testing.assert_allclose(fit.coef, w, rtol=1e-9)
    scored = collect(S.ridge_predict(matrix, S.ridge_fit(matrix, ["a", "b", "c"]), ["a", "b", "c"]), "date")
    np.testing.assert_allclose(scored.y_pred, x @ w + b, rtol=1e-9)
    assert scored.residual[:k].isna().all()
    np.testing.assert_allclose(scored.residual[k:].astype(float), (y - x @ w - b)[k:], atol=1e-9)


def test_alignment_by_target_or_by_origin(spark):
    rows = [
        ("X", "t", 0, "2020-01-01", "2020-01-02", 2.0, 20.0), ("X", "t", 0, "2020-01-02", "2020-01-03", 3.0, 30.0),
        ("X", "s", 0, "2020-01-01", "2020-01-02", 2.0, 21.0), ("X", "s", 0, "2020-01-02", "2020-01-03", 3.0, 31.0),
    ]
    df = spark.createDataFrame(rows, "symbol string, model string, fold_id int, origin_date string, date string, y_true double, y_pred double")
    df = df.withColumns({"origin_date": F.to_date("origin_date"), "date": F.to_date("date")})
    target = collect(S.align_predictions(df, {"a": "t", "b": "s"}), "date")
    assert list(zip(target.a, target.b)) == [(20, 21), (30, 31)]
    mixed = collect(S.align_predictions(df, {"a": "t", "b": "s"}, "origin_of_first"), "date")
    assert list(zip(mixed.a, mixed.b, mixed.y_true)) == [(30, 21, 3)]


def test_overlapping_folds_do_not_multiply(spark, feats):
    rows = assign_test_folds(feats, FoldSpec(150, 60, 20))
    long = rows.select("symbol", F.lit("t").alias("model"), "fold_id", F.col("date").alias("origin_date"), "date", F.col("close").alias("y_true"), F.col("close").alias("y_pred"))
    both = long.unionByName(long.withColumn("model", F.lit("s")))
    assert S.align_predictions(both, {"a": "t", "b": "s"}).count() == long.count()


# ---- learners and forecasts

TREE = L.TreeConfig(boost_rounds=5, boost_depth=3, forest_trees=5, forest_depth=4)
SEQ = L.SequenceConfig(time_step=5, max_iter=60, step=0.01)


@pytest.fixture(scope="module")
def runs(feats):
    return {"tree": L.learn_tree(feats, FOLDS, TREE, SMALL), "huber": L.learn_sequence(feats, FOLDS, L.HUBER, SEQ, SMALL), "fm": L.learn_sequence(feats, FOLDS, L.FM, SEQ, SMALL)}


@pytest.mark.parametrize("name", ["tree", "huber", "fm"])
def test_learner_contract(runs, feats, name):
    got = collect(runs[name].predictions, "symbol", "fold_id", "date")
    assert set(got.fold_id) == {0, 1, 2} and np.isfinite(got.y_pred).all()
    assert (got.origin_date < got.date).all() and not got.duplicated(["symbol", "fold_id", "date"]).any()
    close = collect(feats, "symbol", "date").set_index(["symbol", "date"]).close
    assert (got.y_true.values == close.loc[list(zip(got.symbol, got.date))].values).all()
    if name != "fm":
        for s, g in got.groupby("symbol"):
            history = close[s].iloc[:150].mean()
            assert (g.y_true - g.y_pred).abs().mean() < (g.y_true - history).abs().mean(), s


@pytest.mark.parametrize("kind", ["tree", "huber"])
def test_no_leakage(spark, feats, runs, kind):
    """Changing every bar after a fold's test range leaves that fold's predictions as they are."""
    names = [c for c in feats.columns if c not in ("symbol", "date", "rn", "n", "DayOfWeek")]
    end = 150 + 40 + 1
    changed = feats.withColumns({c: F.when(F.col("rn") >= end, F.col(c) * 3 + 7).otherwise(F.col(c)) for c in names}).checkpoint()
    redo = L.learn_tree(changed, FOLDS, TREE, SMALL) if kind == "tree" else L.learn_sequence(changed, FOLDS, L.HUBER, SEQ, SMALL)
    a = collect(runs[kind].predictions.where("fold_id = 0"), "symbol", "date")
    b = collect(redo.predictions.where("fold_id = 0"), "symbol", "date")
    np.testing.assert_allclose(a.y_pred, b.y_pred, rtol=1e-9)


def test_business_days(spark):
    df = spark.createDataFrame([("X", "2024-01-05"), ("Y", "2024-01-07"), ("Z", "2024-02-28")], "symbol string, d string").select("symbol", F.to_date("d").alias("date"))
    got = collect(FC.future_calendar(df, 30), "symbol", "step")
    for s, d in (("X", "2024-01-05"), ("Y", "2024-01-07"), ("Z", "2024-02-28")):
        want = pd.date_range(pd.Timestamp(d) + pd.Timedelta(days=1), periods=30, freq="B")
        assert list(pd.to_datetime(got[got.symbol == s].date)) == list(want)


def paths_of(state, names, t):
    rows = state.orderBy("symbol").toPandas()
    numbers = [c for c in dict.fromkeys(["open", "high", "low", "close", *names])]
    tails = {a: np.array(rows[a].tolist(), float) for a in FC.TAILS if a in rows}
    return FC.Paths({c: rows[c].to_numpy(float) for c in numbers}, tails, np.array([[list(x) for x in w] for w in rows["_win"]]) if t else None, names)


def test_step_features_equal_engineered_features(spark):
    """A bar appended by the forecast has the features the full history would give it."""
    d = pd.concat([bars(330, 42, "X", macro=True), bars(330, 9, "Y", macro=True, level=3000.0)])
    full = drop_warmup(engineer_features(spark.createDataFrame(d), SMALL), SMALL)
    names = L.feature_columns(full.columns, close_first=True)
    paths = paths_of(FC.forecast_state(full, names, 10), names, 10)
    extra = []
    for s, g in d.groupby("symbol"):
        last = g.iloc[-1].copy()
        for day, price in (("2030-01-01", last.close * 1.02), ("2030-01-02", last.close * 0.97)):
            last = last.copy()
            last["date"], last["close"], last["high"], last["low"] = pd.Timestamp(day).date(), price, price, price
            extra.append(last)
    last_close = d.groupby("symbol").close.last().to_numpy()
    for k, (day, factor) in enumerate((("2030-01-01", 1.02), ("2030-01-02", 0.97))):
        paths.advance(last_close * factor, np.full(2, pd.Timestamp(day).weekday()))
        seen = pd.concat([d, pd.DataFrame(extra).groupby("symbol").head(k + 1)])
        want = collect(engineer_features(spark.createDataFrame(seen), SMALL).where(F.col("rn") == F.col("n") - 1), "symbol")
        for c in names:
            np.testing.assert_allclose(paths.now[c], want[c].astype(float), rtol=1e-8, atol=1e-9, err_msg=c)
        np.testing.assert_allclose(paths.window[:, -1], paths.matrix())


def test_flat_trees_equal_the_model(runs, feats):
    """The arrays of both halves give what the fitted model gives, on rows it has not seen too."""
    run = runs["tree"]
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, (200, len(run.features)))
    from pyspark.ml.linalg import Vectors

    table = feats.sparkSession.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], ["i", "x"])
    for model, column in zip(run.last_model.stages, ("boosted", "bagged")):
        want = [r[column] for r in model.transform(table).orderBy("i").collect()]
        np.testing.assert_allclose(FC.TreeArrays.of(model).predict(x), want, rtol=1e-12)


def test_forecast_steps_follow_the_model(feats, runs):
    """Three days of the tree forecast, one by one: score the last row with Spark, append it, engineer everything again."""
    got = collect(FC.forecast_recursive(feats, runs["tree"], 3), "symbol", "step")
    names = runs["tree"].features
    paths = paths_of(FC.forecast_state(feats, names, 0), names, 0)
    stats = runs["tree"].last_stats.orderBy("symbol").toPandas()
    days = collect(FC.future_calendar(feats, 3), "symbol", "step")
    for step in range(3):
        rows = pd.DataFrame({**{c: paths.now[c] for c in names}, "symbol": ["X", "Y"]})
        rows["date"] = days[days.step == step].date.tolist()
        scored = L.score_rows(runs["tree"], feats.sparkSession.createDataFrame(rows)).orderBy("symbol").toPandas()
        np.testing.assert_allclose(got[got.step == step].y_pred, scored.y_pred, rtol=1e-9)
        paths.advance(scored.y_pred.to_numpy(), np.array([d.weekday() for d in rows["date"]]))
    assert len(stats) == 2


@pytest.mark.parametrize("name", ["tree", "huber", "fm"])
def test_forecast(feats, runs, name):
    got = collect(FC.forecast_recursive(feats, runs[name], 5), "symbol", "step")
    assert len(got) == 10 and list(got.step[:5]) == [0, 1, 2, 3, 4] and np.isfinite(got.y_pred).all()
    last = feats.groupBy("symbol").agg(F.max("date")).collect()
    assert all((got[got.symbol == s].date > d).all() for s, d in last)


@pytest.mark.parametrize("name", ["huber", "fm"])
def test_forecast_does_not_run_away(feats, runs, name):
    """A model whose gain is above one: the first day is its plain forecast, and later ones stay within what its known inputs allow."""
    from foldcast.operators import sequence_fit as SF

    run = runs[name]
    t, d = run.time_step, len(run.features)
    steep = np.zeros_like(run.params)
    weights = steep[: t * d] if name == "huber" else steep[1 : 1 + t * d]
    weights[(t - 1) * d] = 4.0  # the newest close
    if name == "fm":
        steep[1 + t * d + (t - 1) * d] = 2.0
        steep[1 + t * d + (t - 1) * d + 1] = 2.0
    steep[-1 if name == "huber" else 0] = 0.5
    got = collect(FC.forecast_recursive(feats, replace(run, params=steep), 40), "symbol", "step")
    state = collect(FC.forecast_state(feats, run.features, t), "symbol")
    stats = collect(run.last_stats, "symbol")
    for i, (_, path) in enumerate(got.groupby("symbol")):
        low, width = (stats.loc[i, [p + c for c in run.features]].to_numpy(float) for p in ("min_", "range_"))
        known = (np.stack([np.asarray(r, float) for r in state.loc[i, "_win"]]) - low) / width
        most = max(1.0, known[:, 0].max()), max(1.0, known[:, 1].max())
        bound = 0.5 + 4.0 * most[0] + (4.0 * most[0] * most[1] if name == "fm" else 0.0)
        scaled = (path.y_pred.to_numpy() - low[0]) / width[0]
        assert scaled[0] == pytest.approx(SF.window_guess(known[None], steep)[0], rel=1e-9)
        assert np.isfinite(scaled).all() and (scaled <= bound + 1e-9).all()


@pytest.mark.parametrize("name", ["tree", "huber"])
def test_forecast_of_short_and_unseen_symbols(feats, runs, name):
    """With as many rows as a step needs the forecast is that of the long series; with fewer, or unseen, the last close stays."""
    x, stats = feats.where("symbol = 'X'"), runs[name].last_stats.where("symbol = 'X'")
    for symbol, rows in (("W", 60), ("Z", 20), ("V", 60)):
        tail = x.where(F.col("rn") >= F.col("n") - rows).withColumns({"symbol": F.lit(symbol), "rn": F.col("rn") - F.col("n") + rows, "n": F.lit(rows)})
        feats = feats.unionByName(tail)
    known = stats.unionByName(stats.withColumn("symbol", F.lit("W"))).unionByName(stats.withColumn("symbol", F.lit("Z")))
    got = collect(FC.forecast_recursive(feats, replace(runs[name], last_stats=known), 3), "symbol", "step")
    path = {s: list(g.y_pred) for s, g in got.groupby("symbol")}
    last = x.orderBy(F.desc("rn")).first().close
    assert set(path) == {"V", "W", "X", "Y", "Z"} and list(got.step) == [0, 1, 2] * 5
    np.testing.assert_allclose(path["W"], path["X"], rtol=1e-9)
    assert path["Z"] == path["V"] == [last] * 3 and path["X"] != path["Z"] and len(set(path["Y"])) == 1


def test_importance_tuning_and_early_stop(feats, runs):
    imp = collect(L.feature_importance(runs["tree"]), "feature")
    assert len(imp) == 33 and abs(imp.importance.sum() - 1) < 1e-6
    alone = collect(L.last_importance(feats, FOLDS, TREE, SMALL), "feature")
    np.testing.assert_allclose(alone.importance, imp.importance, atol=1e-12)
    grid = {"factor_size": [2, 4], "step": [0.01, 0.001]}
    best, trials = L.tune_sequence(feats, FOLDS, SEQ, grid, trials=3, spec=SMALL)
    trials = collect(trials, "trial")
    assert len(trials) == 3 and trials.best.sum() == 1 and trials.loss[trials.best].iloc[0] == trials.loss.min()
    for t in trials.itertuples():  # a trial fitted alone has the same loss
        own = L.tune_sequence(feats, FOLDS, SEQ, {k: [int(v) if k == "factor_size" else v] for k, v in t.params.items()}, trials=1, spec=SMALL)[1].first()
        assert own.loss == pytest.approx(t.loss, rel=1e-9)
    assert best.factor_size == trials.params[trials.best].iloc[0]["factor_size"]
    stop = L.early_stop_rounds(feats, FoldSpec(150, 40, 400), TREE, SMALL).collect()[0]
    assert 1 <= stop.kept_rounds <= stop.max_rounds


def test_sequence_fit_stops_and_restores(feats):
    """A step that is too long makes the judged loss rise: the fit ends ``patience`` steps after its best state, and keeps that."""
    cfg = L.SequenceConfig(time_step=5, max_iter=60, step=0.1, patience=4)
    stops = collect(L.sequence_stops(feats, FOLDS, cfg, SMALL), "fold_id")
    assert (stops.rounds <= 60).all() and (stops.rounds < 60).any()
    ended = stops[stops.rounds < 60]
    assert (ended.rounds - ended.best_round <= 4).all()
    assert np.isfinite(stops.best_loss).all()


def test_all_folds_at_once_equal_single_folds(feats, runs):
    """Fitting one fold alone gives the forecasts it gets among all folds."""
    for kind, name in ((L.HUBER, "huber"), (L.FM, "fm")):
        alone = collect(L.learn_sequence(feats, FOLDS, kind, SEQ, SMALL, last_only=True).predictions, "symbol", "date")
        among = collect(runs[name].predictions.where("fold_id = 2"), "symbol", "date")
        np.testing.assert_allclose(alone.y_pred, among.y_pred, rtol=1e-9)


def test_huber_passes_reach_the_fit_of_one_table(spark, feats):
    """The sliding passes and a fit on windows that are written out end at the same model."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    folds, t = FoldSpec(200, 81, 81), 3
    d = feats.where("symbol = 'X'").select("symbol", "date", "close", "volume", "RSI_14", "rn", "n")
    cfg = L.SequenceConfig(time_step=t, max_iter=400, reg=0.1, tol=1e-13)
    run = L.learn_sequence(d, folds, L.HUBER, cfg, SMALL, last_only=True)
    low, width = (run.last_stats.first().asDict() for _ in range(2))
    names = run.features
    scaled = d.select("symbol", "date", "rn", "n", *[((F.col(c) - low[f"min_{c}"]) / width[f"range_{c}"]).alias(c) for c in names])
    w = seq_windows(scaled, SMALL, names, t, "double").withColumn("x", array_to_vector(F.flatten("window")))
    model = LinearRegression(featuresCol="x", labelCol="close", loss="huber", epsilon=1.35, regParam=0.1, maxIter=1000, tol=1e-12).fit(w.where("rn < 200"))
    np.testing.assert_allclose(run.params[:-1], model.coefficients.toArray(), atol=2e-4)
    want = collect(model.transform(w.where("rn >= 200")), "date")
    got = collect(run.predictions, "date")
    np.testing.assert_allclose(got.y_pred, want.prediction * width["range_close"] + low["min_close"], rtol=1e-4)


@pytest.mark.parametrize("which", ["huber", "fm"])
def test_kernel_gradients(which):
    """Gradients of a pass against differences of its loss."""
    from foldcast.operators import sequence_fit as SF

    rng = np.random.default_rng(2)
    t, d, m = 4, 3, 30
    x, target = rng.normal(size=(m, d)), rng.normal(size=m)
    learns, judged, p = np.arange(t, 22), np.arange(22, m), SF.Problem(0, 22, m, m)
    if which == "huber":
        point, kernel = rng.normal(size=t * d + 2) * 0.3, SF.huber_kernel(1.35)
        loss, grad = (lambda q: kernel(q, x, target, learns, judged, t, p)[1]), kernel(point, x, target, learns, judged, t, p)[2:]
    else:
        point = rng.normal(size=1 + t * d * 3) * 0.3
        loss, grad = (lambda q: SF.fm_kernel(q, x, target, learns, judged, t, p)[1]), SF.fm_kernel(point, x, target, learns, judged, t, p)[5:]
        windows = np.array([x[i - t : i] for i in range(t, m)])
        np.testing.assert_allclose(SF.window_guess(windows, point), SF.fm_guess(point, x, t)[0][: m - t], rtol=1e-12)
    for i in range(len(point)):
        e = np.zeros(len(point))
        e[i] = 1e-6
        assert (loss(point + e) - loss(point - e)) / 2e-6 == pytest.approx(grad[i], rel=1e-4, abs=1e-5)


def test_folds_go_on_from_the_store(spark, feats, monkeypatch):
    """A run that breaks in one fold leaves the others done; the next run fits only what is missing."""
    from foldcast.session import scratch_path

    store, fitted, real = L.FoldStore(spark, scratch_path(spark, "resume")), [], L.fit_tree_fold

    def broken(task, fold, cfg, into):
        if fold == 1:
            raise RuntimeError("lost")
        real(task, fold, cfg, into)

    monkeypatch.setattr(L, "fit_tree_fold", broken)
    with pytest.raises(RuntimeError):
        L.learn_tree(feats, FOLDS, TREE, SMALL, store)
    assert store.done(L.TREE) == {0, 2}
    monkeypatch.setattr(L, "fit_tree_fold", lambda task, fold, cfg, into: (fitted.append(fold), real(task, fold, cfg, into)))
    run = L.learn_tree(feats, FOLDS, TREE, SMALL, store)
    assert fitted == [1] and store.done(L.TREE) == {0, 1, 2}
    assert {r.fold_id for r in run.predictions.select("fold_id").distinct().collect()} == {0, 1, 2}
    assert store.seconds(L.TREE).count() == 3


@pytest.mark.parametrize("name", ["tree", "huber"])
def test_model_round_trip(spark, feats, runs, name):
    from foldcast.session import scratch_path

    run = L.load_run(spark, L.save_run(runs[name], scratch_path(spark, "model")))
    assert run.features == runs[name].features and run.last_stats.count() == 2
    a, b = (collect(FC.forecast_recursive(feats, r, 2), "symbol", "step").y_pred for r in (run, runs[name]))
    assert list(a) == list(b)
    if name == "tree":
        assert L.score_rows(run, feats).count() == feats.count()


def test_classifier_and_fallback(spark, feats):
    rows = assign_test_folds(feats, FOLDS).select("symbol", "fold_id", F.col("date").alias("origin_date"), "date", F.col("close").alias("y_true"), F.col("SMA_20").alias("a"), F.col("SMA_50").alias("b"), "VIX")
    ready = S.direction_features(S.join_current_close(rows, feats), ["a", "b"])
    _, scored = S.direction_classifier(ready, ["a", "b"], max_iter=3)
    assert set(r.prediction for r in scored.select("prediction").distinct().collect()) <= {0, 1}
    avg = S.simple_average(spark.createDataFrame([(1.0, 2.0, 6.0)], "a double, b double, c double"), ["a", "b", "c"])
    assert avg.first().hybrid == 3.0
    weighted, _ = S.direction_classifier(ready.unionByName(ready), ["a", "b"], max_iter=3)
    assert weighted.getNumTrees == 3
    few = spark.createDataFrame([("X",)] * 10 + [("Y",)] * 11, "symbol string")
    assert [r.symbol for r in S.enough_aligned(few).collect()] == ["Y"]


def test_fallback_query_keeps_every_aligned_row(spark):
    """The query averages all aligned rows of all symbols, not ten of one."""
    from foldcast.catalog import model_queries, tables as T

    sf = "/root/testdata/sf0.001"
    wide = T.plain_aligned(T.features(spark, sf)).groupBy("symbol").count().collect()
    got = model_queries.meta_fallback(spark, sf).groupBy("symbol").count().collect()
    assert sorted(got) == sorted(wide) and len(got) == 3 and all(r["count"] > 10 for r in got)


def test_base_models_share_their_blocks(feats, runs, monkeypatch):
    """Both sequence models read one set of blocks and forecast what they do alone."""
    made, of = [], L.SequenceFolds.of

    def counted(*args):
        made.append(args)
        return of(*args)

    monkeypatch.setattr(L.SequenceFolds, "of", counted)
    got = L.train_base_models(feats, FOLDS, TREE, SEQ, spec=SMALL)
    assert len(made) == 1 and list(got) == [L.TREE, L.HUBER, L.FM]
    for name, model in (("huber", L.HUBER), ("fm", L.FM)):
        a, b = (collect(r.predictions, "symbol", "fold_id", "date") for r in (got[model], runs[name]))
        assert got[model].model_name == model and list(a.date) == list(b.date)
        np.testing.assert_allclose(a.y_pred, b.y_pred, rtol=1e-9)


def fitted_sizes(spark, monkeypatch, name):
    """The sizes that a registered query asks of each learner: by fold for the trees; nothing is fitted."""
    from foldcast.catalog import model_queries

    trees, sequences = {}, {}

    def tree_fold(task, fold, cfg, store):
        trees[fold] = cfg
        raise InterruptedError

    def sequence(features, folds, kind, cfg, *_, **__):
        sequences[kind] = folds, cfg
        raise InterruptedError

    monkeypatch.setattr(L, "fit_tree_fold", tree_fold)
    monkeypatch.setattr(L, "learn_sequence", sequence)
    with pytest.raises(InterruptedError):
        getattr(model_queries, name)(spark, "/root/testdata/sf0.001")
    return trees, sequences


def assert_whole(trees, sequences):
    whole = L.TreeConfig()
    assert (whole.boost_rounds, whole.boost_depth, whole.forest_trees, whole.forest_depth) == (500, 6, 300, 12)
    assert len(trees) > 20 and sorted(trees) == list(range(len(trees))) and all(cfg == whole for cfg in trees.values())
    assert sequences == {kind: (FoldSpec(), L.SequenceConfig()) for kind in (L.HUBER, L.FM)}


def test_train_base_models_query_fits_whole_sizes(spark, monkeypatch):
    """so has the query of the three learners."""
    assert_whole(*fitted_sizes(spark, monkeypatch, "train_base_models"))


def test_pipeline_run_query_fits_whole_sizes(spark, monkeypatch):
    """every fold of the flow has 500 boosting rounds and 300 trees, and the sequence models their defaults."""
    assert_whole(*fitted_sizes(spark, monkeypatch, "pipeline_run"))
