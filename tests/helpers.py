"""Seeded frames and small builders used by the tests."""

import numpy as np
import pandas as pd


def bars(n=200, seed=42, symbol="X", start="2023-01-02", macro=False, level=80.0):
    """A trend with a slow wave and noise on business days; each day opens where the one before closed."""
    rng = np.random.default_rng(seed)
    day = np.arange(n)
    close = level * np.exp(0.0012 * day + 0.04 * np.sin(day / 17) + rng.normal(0, 0.006, n))
    opened = np.append(level, close)[:n]
    out = pd.DataFrame({"symbol": symbol, "date": pd.bdate_range(start, periods=n).date, "open": opened, "close": close})
    out["high"] = np.maximum(opened, close) * (1 + rng.exponential(0.004, n))
    out["low"] = np.minimum(opened, close) * (1 - rng.exponential(0.004, n))
    out["volume"] = 100 + 10 * np.floor(rng.gamma(4, 2500, n))
    if macro:
        out["SP500"] = 2500 + 8 * day + rng.normal(0, 20, n)
        out["VIX"] = 14 + 6 * np.abs(np.sin(day / 11)) + rng.exponential(2, n)
        out["TNX_Yield"] = 2 + 0.5 * np.cos(day / 40)
    return out


def predictions(y, p, fold=None, symbol="X", model="m"):
    n = len(y)
    return pd.DataFrame({
        "symbol": symbol,
        "model": model,
        "fold_id": [0] * n if fold is None else fold,
        "date": pd.date_range("2024-01-01", periods=n).date,
        "y_true": [float(v) for v in y],
        "y_pred": [float(v) for v in p],
    })


def collect(df, *order):
    out = df.toPandas()
    return out.sort_values(list(order)).reset_index(drop=True) if order else out
