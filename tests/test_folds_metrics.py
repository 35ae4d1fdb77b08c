import numpy as np
import pandas as pd
import pytest

from foldcast.operators import metrics as M
from foldcast.operators.folds import FoldSpec, NoFoldsError, assign_test_folds, fold_split, fold_summary, holdout_flag, require_folds
from foldcast.operators.learners import calendar_folds
from tests.helpers import collect, predictions


def positions(spark, n, symbol="X"):
    d = pd.DataFrame({"symbol": symbol, "date": pd.date_range("2020-01-01", periods=n).date, "rn": range(n), "n": n})
    return spark.createDataFrame(d)


def loop(n, lo, test, step):
    """Folds by a plain loop."""
    out, end = [], lo
    while end + test <= n:
        out.append((end, end + test))
        end += step
    if not out and n > lo:
        out.append((lo, n))
    return out


# First training size, test size, step, rows: whole folds, a cut last one, overlaps, gaps, one row more than needed, one fewer.
CASES = [(61, 17, 17, 163), (61, 17, 17, 150), (25, 30, 12, 139), (25, 8, 21, 170), (44, 11, 11, 55), (44, 11, 11, 54), (44, 11, 11, 45), (9, 1, 1, 33), (13, 64, 5, 90), (1, 2, 7, 58)]


@pytest.mark.parametrize("lo,test,step,n", CASES)
def test_folds_match_loop(spark, lo, test, step, n):
    folds, rows = FoldSpec(lo, test, step), positions(spark, n)
    want = loop(n, lo, test, step)
    got = collect(fold_split(rows.groupBy("symbol").agg({"n": "max"}).withColumnRenamed("max(n)", "n"), folds), "fold_id")
    assert list(zip(got.train_end, got.test_end)) == want
    tests = collect(assign_test_folds(rows, folds), "fold_id", "rn")
    assert list(zip(tests.fold_id, tests.rn)) == [(k, i) for k, (a, b) in enumerate(want) for i in range(a, b)]
    cal = [(a, b) for _, a, b in calendar_folds(rows, folds)] if want else []
    assert cal == want


def test_no_folds_is_an_error(spark):
    rows = positions(spark, 20)
    with pytest.raises(NoFoldsError):
        require_folds(fold_split(rows.select("symbol", "n").distinct(), FoldSpec(100, 20, 20)))
    with pytest.raises(NoFoldsError):
        calendar_folds(rows, FoldSpec(100, 20, 20))


def test_holdout_and_summary(spark):
    rows = positions(spark, 100)
    held = rows.where(holdout_flag(15)).toPandas().rn
    assert (held.min(), held.max(), len(held)) == (85, 99, 15)
    s = collect(fold_summary(rows, FoldSpec(50, 10, 10)), "fold_id")
    assert list(s.train_rows) == [50, 60, 70, 80, 90] and set(s.test_rows) == {10}
    assert (s.train_last < s.test_first).all() and str(s.test_first[0]) == "2020-02-20"


def one(spark, y, p, **kw):
    return M.pooled_metrics(spark.createDataFrame(predictions(y, p, **kw))).collect()[0]


def plain_labels(prices):
    """1 and 0 for moves of more than a thousandth up and down, -1 between."""
    out = []
    for before, now in zip(prices, prices[1:]):
        move = (now - before) / before
        out.append(1 if move > 0.001 else 0 if move < -0.001 else -1)
    return out


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(77)
    walk = 40 * np.exp(np.cumsum(rng.choice([-0.01, -0.0004, 0.0, 0.0004, 0.012], 90)))
    return walk, walk * (1 + rng.normal(0, 0.015, 90))


def test_direction_labels(spark, prices):
    from pyspark.sql import Window, functions as F

    from foldcast.functions.columns import direction_label

    def labels(values):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, p double")
        out = df.select("i", direction_label(F.col("p"), F.lag("p").over(Window.orderBy("i"))).alias("l")).orderBy("i").collect()
        return [r.l for r in out][1:]

    assert labels(prices[0]) == plain_labels(prices[0]) and set(plain_labels(prices[0])) == {-1, 0, 1}
    assert labels([7.25]) == []


def test_metrics_against_a_plain_loop(spark, prices):
    y, p = prices
    cells = {(a, g): 0 for a in (0, 1) for g in (0, 1)}
    for a, g in zip(plain_labels(y), plain_labels(p)):
        if a >= 0:
            cells[a, int(g == 1)] += 1
    r = one(spark, y, p)
    assert (r.tn, r.fp, r.fn, r.tp) == (cells[0, 0], cells[0, 1], cells[1, 0], cells[1, 1]) and min(cells.values()) > 0
    share = [[cells[k, k] / (cells[0, k] + cells[1, k]), cells[k, k] / (cells[k, 0] + cells[k, 1])] for k in (0, 1)]
    f1 = np.mean([2 * a * b / (a + b) for a, b in share])
    assert r.directional_accuracy == pytest.approx(100 * (cells[0, 0] + cells[1, 1]) / sum(cells.values()), abs=0.006)
    assert (r.precision, r.recall, r.f1) == pytest.approx((*np.mean(share, axis=0), f1), abs=6e-5)
    e = y - p
    assert (r.mae, r.rmse, r.max_error) == pytest.approx((np.abs(e).mean(), np.sqrt((e**2).mean()), np.abs(e).max()), abs=6e-5)
    assert r.mape == pytest.approx(100 * np.abs(e / y).mean(), abs=0.006) and r.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), abs=6e-5)
    same = one(spark, y, y)
    assert (same.directional_accuracy, same.rmse, same.r2) == (100, 0, 1)
    assert one(spark, y, 80 - y).directional_accuracy < 10


def test_degenerate_metrics(spark):
    r = one(spark, [100], [101])
    assert r.directional_accuracy is None and r.r2 is None and r.mae == 1
    r = one(spark, [5, 5, 5], [5, 5, 5])
    assert r.directional_accuracy is None and r.f1 is None and r.r2 == 1
    assert one(spark, [5, 5, 5], [5, 5, 6]).r2 == 0
    assert one(spark, [0, 0], [1, 1]).mape is None


def test_pooled_is_the_concatenated_series(spark):
    rng = np.random.default_rng(5)
    y, p = rng.normal(100, 5, 60), rng.normal(100, 5, 60)
    folds = np.repeat([0, 1, 2, 3], 15)
    split, whole = one(spark, y, p, fold=folds), one(spark, y, p)
    assert split == whole
    per = collect(M.fold_and_pooled_metrics(spark.createDataFrame(predictions(y, p, fold=folds))), "fold_id")
    assert len(per) == 5 and per.n.max() == 60
    want_r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(split.r2 - want_r2) < 1e-4
