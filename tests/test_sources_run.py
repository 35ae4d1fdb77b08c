import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import foldcast.sources.bars as SB
from foldcast.operators import learners as L
from foldcast.operators.folds import FoldSpec, NoFoldsError
from foldcast.plans.run import RunConfig, run_all
from foldcast.session import scratch_path
from foldcast.sources import sinks
from tests.helpers import bars, collect


def ticks(spark):
    rng = np.random.default_rng(2)
    n = 3000
    d = pd.DataFrame({
        "symbol": rng.choice(["A", "B"], n, p=[0.8, 0.2]), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20 * 86400, n), unit="s"),
        "price": rng.integers(1, 50, n).astype(float), "volume": 1.0, "seq": rng.permutation(n),
    })
    return d, spark.createDataFrame(d)


def test_bars_from_ticks(spark):
    d, df = ticks(spark)
    got = collect(SB.bars_from_ticks(df), "symbol", "date")
    d = d.assign(date=d.ts.dt.date).sort_values(["symbol", "date", "seq"])
    want = d.groupby(["symbol", "date"]).agg(open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"), volume=("volume", "sum")).reset_index()
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("order", ["bigint", "decimal(38,0)"])
def test_bars_are_one_hash_aggregate(spark, order):
    path = scratch_path(spark, "ticks")
    ticks(spark)[1].write.parquet(path)
    df = SB.bars_from_ticks(spark.read.parquet(path).withColumn("seq", F.col("seq").cast(order)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("HashAggregate") == 2 and "SortAggregate" not in plan and "Join" not in plan


def test_bars_with_nulls(spark):
    import duckdb

    rows = [
        ("A", 5.0, 1), ("A", None, 0), ("A", 7.0, None), ("A", 6.0, 3), ("A", None, 4),
        (None, 2.0, 4), (None, 3.0, 2), ("B", 9.0, None), ("C", None, 1), ("C", 8.0, 2), ("D", None, 1),
    ]
    t = pd.DataFrame(rows, columns=["symbol", "price", "seq"]).astype({"seq": "Int64"})  # noqa: F841
    want = duckdb.sql("SELECT symbol, arg_min(price, seq), max(price), min(price), arg_max(price, seq), count(*)::DOUBLE FROM t GROUP BY symbol").fetchall()
    df = spark.createDataFrame(rows, "symbol string, price double, seq long").selectExpr("symbol", "timestamp'2024-01-01 10:00:00' AS ts", "price", "1.0D AS volume", "seq")
    got = {r.symbol: (r.open, r.high, r.low, r.close, r.volume) for r in SB.bars_from_ticks(df).collect()}
    assert got == {r[0]: r[1:] for r in want}
    assert got["A"] == (5.0, 7.0, 5.0, 6.0, 5.0) and got["B"][0] is None and got["C"][0] == 8.0


def test_stored_bars_push_filters(spark):
    path = scratch_path(spark, "bars")
    spark.createDataFrame(bars(50)).write.parquet(path)
    df = SB.read_bars(spark, path, "2023-01-10", "2023-02-01", ["x"])
    assert df.count() == 16
    plan = df.select("close")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(date" in plan and "volume" not in plan.split("ReadSchema")[1]


def test_empty_source(spark):
    none = spark.createDataFrame(bars(5)).where("symbol = 'none'")
    with pytest.raises(SB.EmptySourceError):
        SB.prepare(none)


def test_missing_macro_is_skipped(spark):
    one = SB.prepare(spark.createDataFrame(bars(80)), None)
    assert "VIX" not in one.columns and one.count() == 31
    m = spark.createDataFrame(bars(80, macro=True)).select("date", "VIX")
    assert {"VIX", "VIX_Change"} <= set(SB.prepare(spark.createDataFrame(bars(80)), m).columns)
    assert "VIX" not in SB.prepare(spark.createDataFrame(bars(80)), m.where("VIX < 0")).columns


def test_csv_round_trip(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("2024-01-01", 150.0, 1000000), ("2024-01-02", 152.5, 1200000)], "date string, close double, volume int")
    sinks.write_features(df, path, "csv")
    pd.testing.assert_frame_equal(collect(sinks.read_features(spark, path, df.schema, "csv"), "date"), collect(df, "date"))


TINY = RunConfig(
    future_days=3, folds=FoldSpec(150, 40, 40), clf_rounds=3,
    tree=L.TreeConfig(boost_rounds=3, boost_depth=3, forest_trees=3, forest_depth=3), sequence=L.SequenceConfig(time_step=5, max_iter=10),
)


def test_whole_flow(spark):
    d = pd.concat([bars(300, 1, "X"), bars(300, 2, "Y", level=900.0)])
    m = bars(300, 3, macro=True)[["date", "SP500", "VIX", "TNX_Yield"]]
    out = run_all(spark.createDataFrame(d), spark.createDataFrame(m), TINY)
    models = {r.model for r in out.comparison.select("model").distinct().collect()}
    assert len(models) == 7
    assert out.comparison.count() == 14
    f = collect(out.forecast, "symbol", "model", "step")
    assert len(f) == 2 * 4 * 3
    hybrid = f[f.model == "Hybrid Meta (Regressor)"]
    assert (hybrid.lower < hybrid.upper).all()
    report = collect(out.calibration, "symbol")
    assert set(report.flag.str[:1]) == {"["} and (report.n_inside <= report.n_total).all()
    assert out.calibration_held_out.count() == 2


def test_flow_goes_on_from_its_folder(spark, monkeypatch):
    """A second call with the same folder fits nothing and gives the same tables; one that broke late keeps what was done."""
    from foldcast.plans import run as P

    path = scratch_path(spark, "flow")
    d = pd.concat([bars(260, 1, "X"), bars(260, 2, "Y", level=900.0)])
    m = bars(260, 3, macro=True)[["date", "SP500", "VIX", "TNX_Yield"]]
    frames = spark.createDataFrame(d), spark.createDataFrame(m)
    with monkeypatch.context() as broken:
        broken.setattr(P.metrics, "compare_models", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            P.run_all(*frames, TINY, path)
    done = P.RunFolder(spark, path).finished()
    assert "fold_metrics" in done and "comparison" not in done
    for name in ("train_base_models", "learn_tree", "learn_sequence"):
        monkeypatch.setattr(L, name, lambda *_: pytest.fail("fitted again"))
    out = P.run_all(*frames, TINY, path)
    contents = collect(P.run_contents(spark, path), "stage")
    assert (contents.rows == contents.written).all() and (contents.rows > 0).all() and set(contents.stage) > done
    assert out.comparison.count() == 14 and out.path == path
    csv = spark.read.option("header", True).csv(f"{path}/csv/combined_predictions")
    assert {"Predicted Close Tree Ensemble", "Conf Lower", "Conf Upper"} <= set(csv.columns) and csv.count() == 6
    ahead = spark.read.option("header", True).csv(f"{path}/csv/future_predictions_tree_ensemble")
    assert ahead.count() == 6 and str(ahead.agg({"date": "min"}).first()[0]) > str(d.date.max())


def test_flow_needs_folds(spark):
    with pytest.raises(NoFoldsError):
        run_all(spark.createDataFrame(bars(120)), None, TINY)


def test_registered_queries(spark):
    import __spark_entry__ as entry
    from check import normal

    assert entry.entry(spark).count() == 3
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 100
    import duckdb

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("src_bars", "fill_macro", "ind_rsi", "win_ewm_gaps", "agg_metrics_by_fold", "base_arima", "ci_future", "meta_direction_clf"):
        got = qs[name](spark, sf)
        columns = sorted(got.columns)
        rel = con.sql(sql[name])
        assert columns == sorted(rel.columns), name
        quoted = ", ".join(f'"{c}"' for c in columns)
        want = [tuple(map(normal, r)) for r in con.sql(f"SELECT {quoted} FROM ({sql[name]})").fetchall()]
        have = [tuple(map(normal, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
        have, want = (sorted(rows, key=lambda r: repr([v for v in r if not isinstance(v, float)])) for rows in (have, want))
        assert len(have) == len(want) > 0, name
        # Ties of the last rounded digit may fall either way.
        assert all(v == pytest.approx(w, rel=1e-8, abs=1e-12) if isinstance(w, float) else v == w for a, b in zip(have, want) for v, w in zip(a, b)), name
