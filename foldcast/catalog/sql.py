"""Shared table expressions of the check SQL. ``with_`` puts those a statement needs in front of it."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY date"


def roll(agg: str, x: str, k: int, count: str | None = None, w: str = W) -> str:
    """Full-window aggregate over the last k rows."""
    frame = f"OVER ({w} ROWS {k - 1} PRECEDING)"
    return f"CASE WHEN count({count or x}) {frame} = {k} THEN {agg} {frame} END"


def ewm(x: str, span: int, w: str = W) -> str:
    """Exponential mean as a fold over the whole prefix of the series."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"list_reduce(list({x}) OVER ({w} ROWS UNBOUNDED PRECEDING), lambda acc, v: acc * (1 - {a}) + v * {a})"


def ewm_gaps(x: str, span: int, source: str, w: str = W) -> str:
    """Exponential mean of a table with gaps: a missing value holds it, and a value k rows after the last weighs a against b**k."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"""SELECT * EXCLUDE (seen, e), CASE WHEN seen IS NOT NULL THEN list_reduce(e, lambda s, v: struct_pack(y := v.c * s.y + (1 - v.c) * v.y, c := 0.0::DOUBLE)).y END AS m{span}
        FROM (SELECT *, last_value({x} IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING) AS seen,
              list(struct_pack(y := {x}, c := pow(1 - {a}, k) / (pow(1 - {a}, k) + {a}))) FILTER ({x} IS NOT NULL) OVER ({w} ROWS UNBOUNDED PRECEDING) AS e
              FROM (SELECT *, CAST(rn - lag(CASE WHEN {x} IS NOT NULL THEN rn END IGNORE NULLS) OVER ({w}) AS DOUBLE) AS k FROM {source}))"""


def _fill(c: str) -> str:
    return (
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {c}"
    )


def label(x: str, before: str) -> str:
    return (
        f"CASE WHEN {before} IS NULL THEN NULL WHEN ({x} - {before}) / nullif({before}, 0) > 0.001 THEN 1 "
        f"WHEN ({x} - {before}) / nullif({before}, 0) < -0.001 THEN 0 ELSE -1 END"
    )


CTES: dict[str, tuple[list[str], str]] = {
    "bars": (
        [],
        """SELECT symbol, date, first(price ORDER BY seq, price) AS open, max(price) AS high, min(price) AS low,
           last(price ORDER BY seq, price) AS close, sum(volume) AS volume
           FROM (SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
                 l_quantity AS volume, l_orderkey * 8 + l_linenumber AS seq FROM lineitem) GROUP BY symbol, date""",
    ),
    "hbars": (
        [],
        """SELECT symbol, date, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
           last(price ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
           FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS date, value AS price, ts, event_id FROM events)
           GROUP BY symbol, date""",
    ),
    "macro": (
        [],
        """SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(o_totalprice) * 100.0::DOUBLE) AS SP500,
           round(100 * stddev_samp(o_totalprice) / nullif(avg(o_totalprice), 0), 6) AS VIX,
           round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS TNX_Yield
           FROM orders GROUP BY 1""",
    ),
    "nbars": (
        ["bars"],
        f"""SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars""",
    ),
    "hnbars": (
        ["hbars"],
        f"""SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM hbars""",
    ),
    "joined": (["bars", "macro"], "SELECT bars.*, SP500, VIX, TNX_Yield FROM bars LEFT JOIN macro USING (date)"),
    "filled": (
        ["joined"],
        f"""SELECT symbol, date, open, high, low, close, volume, {_fill('SP500')}, {_fill('VIX')}, {_fill('TNX_Yield')},
           row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM joined""",
    ),
    "f1": (
        ["filled"],
        f"""SELECT *, {roll('avg(close)', 'close', 20)} AS SMA_20, {roll('avg(close)', 'close', 50)} AS SMA_50,
           {roll('stddev_samp(close)', 'close', 20)} AS std20,
           lag(close, 1) OVER ({W}) AS Close_Lag_1, lag(close, 3) OVER ({W}) AS Close_Lag_3, lag(close, 5) OVER ({W}) AS Close_Lag_5,
           volume / nullif({roll('avg(volume)', 'volume', 20)}, 0) AS Volume_Ratio,
           coalesce({roll('covar_samp(close, SP500)', 'close', 20)} / nullif({roll('stddev_samp(close)', 'close', 20)}
             * {roll('stddev_samp(SP500)', 'SP500', 20)}, 0), 0) AS Corr_SP500_20,
           coalesce(SP500 / nullif(lag(SP500) OVER ({W}), 0) - 1, 0) AS SP500_Return_1d,
           VIX - lag(VIX) OVER ({W}) AS VIX_Change,
           CAST((extract('isodow' FROM date) - 1) AS INTEGER) AS DayOfWeek
           FROM filled""",
    ),
    "f2": (
        ["f1"],
        f"""SELECT *, CASE WHEN close > Close_Lag_1 THEN close - Close_Lag_1 ELSE 0 END AS gain,
           CASE WHEN close < Close_Lag_1 THEN Close_Lag_1 - close ELSE 0 END AS loss,
           greatest(high - low, abs(high - Close_Lag_1), abs(low - Close_Lag_1)) AS true_range,
           CASE WHEN close / nullif(Close_Lag_1, 0) > 0 THEN ln(close / nullif(Close_Lag_1, 0)) ELSE 0 END AS Log_Return,
           coalesce(sign(close - Close_Lag_1) * volume, 0) AS flow,
           close / nullif(Close_Lag_1, 0) - 1 AS Return_1d, close / nullif(Close_Lag_5, 0) - 1 AS Return_5d,
           SMA_20 + 2 * std20 AS BB_Upper, SMA_20 - 2 * std20 AS BB_Lower,
           ((SMA_20 + 2 * std20) - (SMA_20 - 2 * std20)) / nullif(SMA_20, 0) AS BB_Width FROM f1""",
    ),
    "f3": (
        ["f2"],
        f"""SELECT * EXCLUDE (g, l), CASE WHEN g IS NULL OR (g = 0 AND l = 0) THEN 50.0 WHEN l = 0 THEN 100.0
           ELSE 100.0 - 100.0 / (1 + g / l) END AS RSI_14
           FROM (SELECT *, {roll('avg(gain)', 'gain', 14)} AS g, {roll('avg(loss)', 'loss', 14)} AS l,
                 {roll('avg(true_range)', 'true_range', 14)} AS ATR_14,
                 coalesce({roll('stddev_samp(Log_Return)', 'Log_Return', 20)}, 0) AS Volatility_20,
                 sum(flow) OVER ({W} ROWS UNBOUNDED PRECEDING) AS OBV FROM f2)""",
    ),
    "f4": (
        ["f3"],
        f"""SELECT *, MACD - MACD_Signal AS MACD_Hist FROM (SELECT *, {ewm('MACD', 9)} AS MACD_Signal
           FROM (SELECT *, EMA_12 - EMA_26 AS MACD FROM (SELECT *, {ewm('close', 12)} AS EMA_12, {ewm('close', 26)} AS EMA_26 FROM f3)))""",
    ),
    # Features after the warm-up, without the exponential means (which are never missing).
    "feat": (
        ["f3"],
        f"""SELECT * REPLACE (row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n) FROM f3
           WHERE SMA_50 IS NOT NULL AND std20 IS NOT NULL AND ATR_14 IS NOT NULL AND Volume_Ratio IS NOT NULL AND Close_Lag_5 IS NOT NULL
           AND Return_1d IS NOT NULL AND Return_5d IS NOT NULL AND BB_Width IS NOT NULL AND VIX_Change IS NOT NULL AND SP500 IS NOT NULL
           AND TNX_Yield IS NOT NULL""",
    ),
    "feat_all": (
        ["f4"],
        f"""SELECT * REPLACE (row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n) FROM f4
           WHERE SMA_50 IS NOT NULL AND std20 IS NOT NULL AND ATR_14 IS NOT NULL AND Volume_Ratio IS NOT NULL AND Close_Lag_5 IS NOT NULL
           AND Return_1d IS NOT NULL AND Return_5d IS NOT NULL AND BB_Width IS NOT NULL AND VIX_Change IS NOT NULL AND SP500 IS NOT NULL
           AND TNX_Yield IS NOT NULL""",
    ),
}


def folds_cte(source: str, min_train: int = 504, test: int = 63, step: int = 63) -> str:
    return f"""SELECT symbol, n, k AS fold_id, {min_train} + k * {step} AS train_end, least({min_train} + k * {step} + {test}, n) AS test_end
        FROM (SELECT symbol, max(n) AS n FROM {source} GROUP BY symbol), LATERAL (SELECT unnest(range(0,
        CASE WHEN n >= {min_train + test} THEN (n - {min_train + test}) // {step} + 1 WHEN n > {min_train} THEN 1 ELSE 0 END)) AS k)"""


CTES["folds"] = (["feat"], folds_cte("feat"))
CTES["hfolds"] = (["hnbars"], folds_cte("hnbars", 200, 20, 20))
CTES["bfolds"] = (["nbars"], folds_cte("nbars"))
CTES["tests"] = (["feat", "folds"], "SELECT feat.*, fold_id, train_end, test_end FROM feat JOIN folds USING (symbol) WHERE rn >= train_end AND rn < test_end")
CTES["naive"] = (
    ["nbars", "bfolds"],
    f"""SELECT symbol, 'Naive (Zero-Change)' AS model, CAST(fold_id AS INTEGER) AS fold_id, origin_date, date, close AS y_true, y_pred
       FROM (SELECT symbol, rn, date, close, coalesce(lag(close) OVER ({W}), close) AS y_pred,
             coalesce(lag(date) OVER ({W}), date) AS origin_date FROM nbars) b
       JOIN bfolds f USING (symbol) WHERE rn >= train_end AND rn < test_end""",
)
CTES["hnaive"] = (
    ["hnbars", "hfolds"],
    f"""SELECT symbol, 'Naive (Zero-Change)' AS model, CAST(fold_id AS INTEGER) AS fold_id, date, close AS y_true, y_pred
       FROM (SELECT symbol, rn, date, close, coalesce(lag(close) OVER ({W}), close) AS y_pred FROM hnbars) b
       JOIN hfolds f USING (symbol) WHERE rn >= train_end AND rn < test_end""",
)
# Three plain forecasts of each test day from the day before: last close, 20-day mean, 50-day mean.
CTES["wide"] = (
    ["feat", "folds"],
    f"""SELECT symbol, CAST(fold_id AS INTEGER) AS fold_id, date, origin_date, close AS y_true, last_pred, mean20_pred, mean50_pred
       FROM (SELECT symbol, rn, date, close, lag(date) OVER ({W}) AS origin_date, lag(close) OVER ({W}) AS last_pred,
             lag(SMA_20) OVER ({W}) AS mean20_pred, lag(SMA_50) OVER ({W}) AS mean50_pred FROM feat) b
       JOIN folds USING (symbol) WHERE rn >= train_end AND rn < test_end""",
)
CTES["long"] = (
    ["wide"],
    """SELECT symbol, 'last' AS model, fold_id, origin_date, date, y_true, last_pred AS y_pred FROM wide
       UNION ALL SELECT symbol, 'mean20', fold_id, origin_date, date, y_true, mean20_pred FROM wide
       UNION ALL SELECT symbol, 'mean50', fold_id, origin_date, date, y_true, mean50_pred FROM wide""",
)
CTES["matrix"] = (
    ["wide", "feat"],
    """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fold_id, date) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n
       FROM (SELECT wide.*, coalesce(VIX, median(VIX) OVER (PARTITION BY wide.symbol)) AS VIX
             FROM wide LEFT JOIN (SELECT symbol, date, VIX FROM feat) v USING (symbol, date))""",
)


# The next 30 weekdays of each symbol with the plain forecasts of its last bar.
CTES["calendar"] = (
    ["bars"],
    """SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS INTEGER) AS step, d AS date
       FROM (SELECT symbol, CAST(unnest(range(last_date + 1, last_date + 60, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol))
       WHERE extract('isodow' FROM d) < 6 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d) <= 30""",
)
CTES["future"] = (
    ["calendar", "feat"],
    "SELECT calendar.*, last_pred, mean20_pred, mean50_pred FROM calendar JOIN (SELECT symbol, close AS last_pred, SMA_20 AS mean20_pred, SMA_50 AS mean50_pred FROM feat WHERE rn = n - 1) USING (symbol)",
)
# The direction of three forecasts of each test day against the close before it.
CTES["directions"] = (
    ["matrix", "feat"],
    """SELECT symbol, fold_id, date, CASE WHEN mean20_pred > last_pred THEN 1 ELSE 0 END AS mean20_pred_dir, CASE WHEN mean50_pred > last_pred THEN 1 ELSE 0 END AS mean50_pred_dir,
       CASE WHEN trend_pred > last_pred THEN 1 ELSE 0 END AS trend_pred_dir, CASE WHEN y_true > last_pred THEN 1 ELSE 0 END AS label, VIX, rn, n
       FROM matrix JOIN (SELECT symbol, date AS origin_date, close + (close - Close_Lag_5) / 5 AS trend_pred FROM feat) USING (symbol, origin_date)""",
)


# Folds over the calendar of all dates, which pooled learners share, and the test rows of each.
CTES["cal"] = (["feat"], "SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM feat)")
CTES["cfolds"] = (
    ["cal"],
    """SELECT CAST(k AS INTEGER) AS fold_id, 504 + k * 63 AS train_end, least(504 + k * 63 + 63, n) AS test_end
       FROM (SELECT count(*) AS n FROM cal), LATERAL (SELECT unnest(range(0, CASE WHEN n >= 567 THEN (n - 567) // 63 + 1 WHEN n > 504 THEN 1 ELSE 0 END)) AS k)""",
)
CTES["tree_rows"] = (
    ["cfolds", "feat"],
    f"""SELECT symbol, 'Tree Ensemble' AS model, fold_id, date AS origin_date, next_date AS date, next_close AS y_true
       FROM (SELECT symbol, date, lead(date) OVER ({W}) AS next_date, lead(close) OVER ({W}) AS next_close FROM feat) JOIN cal USING (date)
       JOIN cfolds ON pos >= train_end AND pos < test_end WHERE next_date IS NOT NULL""",
)
CTES["sequence_rows"] = (
    ["cfolds", "feat"],
    f"""SELECT symbol, fold_id, origin_date, date, close AS y_true
       FROM (SELECT symbol, rn, date, close, lag(date) OVER ({W}) AS origin_date FROM feat) JOIN cal USING (date)
       JOIN cfolds ON pos >= train_end AND pos < test_end WHERE rn >= 90""",
)


def eliminated(k: int, source: str, keep: str) -> dict[str, str]:
    """Elimination of k equations m<i>_<j> with their right side in column k, one table expression per pivot."""
    tables = {}
    for p in range(k):
        cols = []
        for i in range(k):
            for j in range(k + 1):
                lead = f"CASE WHEN m{p}_{p} > least_pivot THEN m{p}_{j} / m{p}_{p} END"
                cols.append(f"{lead} AS m{i}_{j}" if i == p else f"m{i}_{j} - m{i}_{p} * ({lead}) AS m{i}_{j}")
        tables[f"{source}{p}"] = f"SELECT {keep}, {', '.join(cols)} FROM {source if p == 0 else f'{source}{p - 1}'}"
    return tables


def ar_tables(p: int = 5) -> dict[str, str]:
    """Least-squares AR(p) of price differences per fold, and its path over the test rows (table ``arima``)."""
    lags = ", ".join(f"lag(d0, {k}) OVER (PARTITION BY symbol ORDER BY rn) AS d{k}" for k in range(1, p + 1))
    sums = ", ".join(f"coalesce(sum(d{i} * d{j}) FILTER (d{p} IS NOT NULL), 0) AS g{i}_{j}" for i in range(p + 1) for j in range(max(i, 1), p + 1))
    grid = ", ".join(f"g{min(i, j)}_{max(i, j)} AS m{i - 1}_{j - 1}" for i in range(1, p + 1) for j in range(1, p + 1))
    right = ", ".join(f"g0_{i} AS m{i - 1}_{p}" for i in range(1, p + 1))
    trace = " + ".join(f"g{i}_{i}" for i in range(1, p + 1))
    move = "coalesce(" + " + ".join(f"phi{i} * r{i}" for i in range(p)) + ", 0)"
    keep = "symbol, fold_id, least_pivot"
    return {
        "d": f"SELECT *, {lags} FROM (SELECT symbol, date, rn, close, close - lag(close) OVER ({W}) AS d0 FROM nbars)",
        "sums": f"SELECT symbol, CAST(fold_id AS INTEGER) AS fold_id, count(d{p}) AS m, {sums} FROM d JOIN bfolds USING (symbol) WHERE rn < train_end GROUP BY symbol, fold_id",
        "e": f"SELECT symbol, fold_id, CASE WHEN m > {2 * p} THEN ({trace}) * 1e-12 END AS least_pivot, {grid}, {right} FROM sums",
        **eliminated(p, "e", keep),
        "phi": f"SELECT symbol, fold_id, {', '.join(f'm{i}_{p} AS phi{i}' for i in range(p))} FROM e{p - 1}",
        "path": f"""SELECT symbol, bfolds.fold_id, train_end, test_end, {', '.join(f'phi{i}' for i in range(p))}, date AS origin_date, CAST(train_end - 1 AS BIGINT) AS place, close AS price, {', '.join(f'coalesce(d{i}, 0) AS r{i}' for i in range(p))}
            FROM bfolds JOIN phi USING (symbol, fold_id) JOIN d USING (symbol) WHERE rn = train_end - 1
            UNION ALL SELECT symbol, fold_id, train_end, test_end, {', '.join(f'phi{i}' for i in range(p))}, origin_date, place + 1, price + {move}, {move}, {', '.join(f'r{i}' for i in range(p - 1))} FROM path WHERE place + 1 < test_end""",
        "arima": """SELECT path.symbol, 'ARIMA (5,1,0)' AS model, CAST(fold_id AS INTEGER) AS fold_id, origin_date, nbars.date, close AS y_true, price AS y_pred
            FROM path JOIN nbars ON path.symbol = nbars.symbol AND place = rn WHERE place >= train_end""",
    }


def metrics_sql(source: str, by_fold: bool, extra: str = "") -> str:
    """Direction and error metrics of a prediction table, per fold or pooled."""
    keys = "symbol, model, fold_id" if by_fold else "symbol, model"
    order = "date" if by_fold else "fold_id, date"
    w = f"PARTITION BY {keys} ORDER BY {order}"
    return f"""
    SELECT {keys}, n, tn, fp, fn, tp,
      round_even(100.0 * (tn + tp) / nullif(tn + fp + fn + tp, 0), 2) AS directional_accuracy,
      round_even(CASE WHEN tot > 0 THEN (coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0) + coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) / cls END, 4) AS f1,
      round_even(CASE WHEN tot > 0 THEN (coalesce(1.0 * tn / nullif(tn + fn, 0), 0) + coalesce(1.0 * tp / nullif(tp + fp, 0), 0)) / cls END, 4) AS "precision",
      round_even(CASE WHEN tot > 0 THEN (coalesce(1.0 * tn / nullif(tn + fp, 0), 0) + coalesce(1.0 * tp / nullif(tp + fn, 0), 0)) / cls END, 4) AS recall,
      round_even(mse, 4) AS mse, round_even(sqrt(mse), 4) AS rmse, round_even(mae, 4) AS mae, round_even(mape, 2) AS mape,
      round_even(CASE WHEN n < 2 THEN NULL WHEN vp > 0 THEN 1 - mse / vp WHEN mse = 0 THEN 1.0 ELSE 0.0 END, 4) AS r2,
      round_even(max_error, 4) AS max_error
    FROM (SELECT *, tn + fp + fn + tp AS tot, (CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END) AS cls
      FROM (SELECT {keys}, count(*) AS n,
        count(*) FILTER (a = 0 AND p <> 1) AS tn, count(*) FILTER (a = 0 AND p = 1) AS fp,
        count(*) FILTER (a = 1 AND p <> 1) AS fn, count(*) FILTER (a = 1 AND p = 1) AS tp,
        avg((y_true - y_pred) * (y_true - y_pred)) AS mse, avg(abs(y_true - y_pred)) AS mae,
        100 * avg(abs((y_true - y_pred) / nullif(y_true, 0))) AS mape, var_pop(y_true) AS vp, max(abs(y_true - y_pred)) AS max_error
        FROM (SELECT *, {label('y_true', 'y0')} AS a, {label('y_pred', 'p0')} AS p
              FROM (SELECT *, lag(y_true) OVER ({w}) AS y0, lag(y_pred) OVER ({w}) AS p0 FROM {source}))
        GROUP BY {keys})) {extra}"""


def with_(select: str, *needs: str, **own: str) -> str:
    """``WITH`` clause of the named tables (and what they need), then ``own`` ones, then the statement."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{name} AS ({CTES[name][1]})" for name in order] + [f"{name} AS ({body})" for name, body in own.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select
