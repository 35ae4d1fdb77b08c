"""Sequence models of all folds fitted together, one pass over halo blocks per step, no window ever written out.

A block holds consecutive rows of one symbol and the look-back rows before them (``sequence_blocks``). A linear map over a window
of T rows is T products of the block's rows, added along a diagonal; its gradient is one product of the rows with the shifted
residuals. So a pass reads every row once for all problems (a fold, or a trial on a fold), scales it with the problem's training
extremes, and gives one row of sums per problem. Parameters travel to the tasks as one broadcast a pass, which is dropped after
it; the sums are added up by problem in as many tasks as there are problems.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided, sliding_window_view
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from foldcast.operators.joins import attach
from foldcast.operators.series import SeriesSpec, with_halo

# Executors need not have this package installed: its small kernels travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Problem:
    """One model to fit: whose training extremes scale it, which calendar positions it trains on, is judged on and forecasts."""

    fold_id: int
    train_end: int
    judged_end: int
    test_end: int
    factors: int = 0
    step: float = 0.01
    decay: float = 0.0


def sequence_blocks(rows: DataFrame, stats: DataFrame, names: list[str], time_step: int, spec: SeriesSpec) -> DataFrame:
    """One row per block of a symbol: its rows in order with the ``time_step`` before them, and the extremes of every fold.

    ``rows`` has rn, n, cal, prev_date and the features; a block holds ``spec.row_block`` rows and the halo at most.
    """
    blocked = with_halo(rows, spec, before=time_step)
    one = F.struct("rn", "cal", "core", F.col(spec.time).alias("day"), "prev_date", "close", F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    blocks = blocked.groupBy("symbol", "blk").agg(F.array_sort(F.collect_list(one)).alias("r"))
    each = F.struct("fold_id", F.array(*[f"min_{c}" for c in names]).alias("low"), F.array(*[f"range_{c}" for c in names]).alias("width"))
    scales = stats.groupBy("symbol").agg(F.collect_list(each).alias("s"))  # a row per fold of the symbol
    flat = blocks.select(
        "symbol", "blk", F.col("r.cal").alias("cal"), F.col("r.core").alias("core"), F.col("r.day").alias("day"), F.col("r.prev_date").alias("prev_date"),
        F.col("r.close").alias("close"), F.flatten("r.x").alias("x"),
    )
    wide = scales.select("symbol", F.col("s.fold_id").alias("fold_id"), F.flatten("s.low").alias("low"), F.flatten("s.width").alias("width"))
    return attach(flat, wide, ["symbol"])


def along_diagonals(products: np.ndarray, t: int) -> np.ndarray:
    """For every window start k the sum of products[k + i, i], i below t."""
    m, item = len(products), products.itemsize
    products = np.ascontiguousarray(products)
    return as_strided(products, (m - t + 1, t), (t * item, (t + 1) * item)).sum(axis=1)


def window_sums(x: np.ndarray, weight: np.ndarray, t: int) -> np.ndarray:
    """[i, j]: the sum over windows k of weight[k] * x[k + i, j]."""
    padded = np.concatenate([np.zeros(t - 1), weight, np.zeros(t - 1)])
    shifted = sliding_window_view(padded, t)[: len(x), ::-1]
    return np.ascontiguousarray(shifted).T @ x


class Block:
    """The arrays of one block row."""

    def __init__(self, batch: pa.RecordBatch, i: int, d: int, t: int) -> None:
        def values(c: str) -> np.ndarray:
            return batch.column(c)[i].values.to_numpy(zero_copy_only=False)

        self.symbol = batch.column("symbol")[i].as_py()
        self.cal, self.core, self.close = values("cal").astype(np.int64), values("core").astype(bool), values("close")
        self.day, self.prev_date = batch.column("day")[i].values, batch.column("prev_date")[i].values
        self.x = values("x").reshape(-1, d)
        self.folds = {int(f): k for k, f in enumerate(values("fold_id"))}
        self.low, self.width = values("low").reshape(-1, d), values("width").reshape(-1, d)
        self.t = t

    def scaled(self, fold: int, upto: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Scaled rows before calendar position ``upto``, and which rows have a full window and are this block's own; None without any."""
        k = self.folds.get(fold)
        end = int(np.searchsorted(self.cal, upto))
        if k is None or end <= self.t:
            return None
        own = np.flatnonzero(self.core[:end] & (np.arange(end) >= self.t))
        return ((self.x[:end] - self.low[k]) / self.width[k], own) if len(own) else None


def per_block(blocks: DataFrame, d: int, t: int, work: Callable, schema: str) -> DataFrame:
    """``work`` yields record batches from each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from work(Block(batch, i, d, t))

    return blocks.mapInArrow(run, schema)


def one_pass(blocks: DataFrame, problems: list[Problem], params: np.ndarray, d: int, t: int, kernel: Callable, active: np.ndarray) -> np.ndarray:
    """Sums of ``kernel`` over all windows of the active problems: [problem, sums].

    Each task adds up its own blocks; the tasks' sums meet by problem.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(params)
    wanted = [(i, p) for i, p in enumerate(problems) if active[i]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = sent.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block(batch, k, d, t)
                for i, p in wanted:
                    ready = block.scaled(p.fold_id, p.judged_end)
                    if ready is not None:
                        x, own = ready
                        target = (block.close[: len(x)] - block.low[block.folds[p.fold_id], 0]) / block.width[block.folds[p.fold_id], 0]
                        learns = own[block.cal[own] < p.train_end]
                        part = kernel(values[i], x, target, learns, own[block.cal[own] >= p.train_end], t, p)
                        total[i] = total[i] + part if i in total else part
        yield _sums(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("problem").to_pylist(), batch.column("sums")):
                part = part.values.to_numpy()
                total[i] = total[i] + part if i in total else part
        yield _sums(total)

    try:
        schema = "problem int, sums array<double>"
        parts = blocks.mapInArrow(run, schema).repartition(min(len(wanted), 32), "problem").mapInArrow(add, schema)
        found = {r["problem"]: np.array(r["sums"]) for r in parts.collect()}
    finally:
        sent.destroy()
    size = len(next(iter(found.values()))) if found else 0
    return np.array([found.get(i, np.zeros(size)) for i in range(len(problems))])


def _sums(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    edges = np.cumsum([0, *map(len, total.values())]).astype(np.int32)
    values = np.concatenate(list(total.values())) if total else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.ListArray.from_arrays(pa.array(edges), pa.array(values))], names=["problem", "sums"])


# ---- robust linear model


def moments_kernel(_: np.ndarray, x, target, learns, judged, t: int, p: Problem) -> np.ndarray:
    """Count, and sums of every window input and of its square."""
    weight = np.zeros(max(0, len(x) - t + 1))
    weight[learns - t] = 1.0
    return np.concatenate([[len(learns)], window_sums(x, weight, t).ravel(), window_sums(x * x, weight, t).ravel()])


def huber_kernel(epsilon: float) -> Callable:
    """Loss with a scale that is fitted along, and its gradient by inputs, intercept and log scale."""

    def kernel(params: np.ndarray, x, target, learns, judged, t: int, p: Problem) -> np.ndarray:
        w, b, sigma = params[:-2].reshape(t, -1), params[-2], np.exp(params[-1])
        z = np.zeros(0)
        weight = np.zeros(max(0, len(x) - t + 1))
        loss = slope = turn = 0.0
        if len(learns):
            z = (along_diagonals(x @ w.T, t)[learns - t] + b - target[learns]) / sigma
            small = np.abs(z) < epsilon
            loss = float((sigma + np.where(small, z * z, 2 * epsilon * np.abs(z) - epsilon * epsilon) * sigma).sum()) / 2
            pull = np.where(small, z, epsilon * np.sign(z))
            weight[learns - t] = pull
            slope = float(pull.sum())
            turn = float((1 - np.where(small, z * z, epsilon * epsilon)).sum()) / 2 * sigma
        return np.concatenate([[len(learns), loss], window_sums(x, weight, t).ravel(), [slope, turn]])

    return kernel


def minimise(value: Callable, start: np.ndarray, iterations: int, tol: float, memory: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Limited-memory quasi-Newton steps for many problems side by side; returns the points and the steps each took.

    ``value(points, active)`` gives losses and gradients. A problem stops when a step gains less than ``tol`` of its loss.
    """
    x = start.copy()
    active = np.ones(len(x), dtype=bool)
    f, g = value(x, active)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    taken = np.zeros(len(x), dtype=int)
    for k in range(iterations):
        d, alphas = g.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * (s * d).sum(1)
            alphas.append(a)
            d -= a[:, None] * y
        if pairs:
            s, y, rho = pairs[-1]
            scale = np.where(rho > 0, (s * y).sum(1) / np.maximum((y * y).sum(1), 1e-300), 1.0)
            d *= scale[:, None]
        for (s, y, rho), a in zip(pairs, reversed(alphas)):
            d += (a - rho * (y * d).sum(1))[:, None] * s
        d = -d
        slope = (g * d).sum(1)
        bad = slope >= 0
        d[bad], slope[bad] = -g[bad], -(g[bad] ** 2).sum(1)
        step = np.ones(len(x)) if pairs else 1 / np.maximum(1.0, np.sqrt((g * g).sum(1)))
        waiting, new_x, new_f, new_g = active.copy(), x.copy(), f.copy(), g.copy()
        for _ in range(25):
            trial = np.where(waiting[:, None], x + step[:, None] * d, new_x)
            ft, gt = value(trial, waiting)
            good = waiting & np.isfinite(ft) & (ft <= f + 1e-4 * step * slope)
            new_x[good], new_f[good], new_g[good] = trial[good], ft[good], gt[good]
            waiting &= ~good
            if not waiting.any():
                break
            step[waiting] /= 2
        moved = active & ~waiting
        s, y = np.where(moved[:, None], new_x - x, 0.0), np.where(moved[:, None], new_g - g, 0.0)
        curve = (s * y).sum(1)
        pairs.append((s, y, np.where(curve > 1e-300, 1 / np.maximum(curve, 1e-300), 0.0)))
        pairs = pairs[-memory:]
        gain = f - new_f
        taken += moved
        active = moved & (gain > tol * np.maximum(np.abs(f), 1e-12))
        x, f, g = new_x, new_f, new_g
        if not active.any():
            break
    return x, taken


def fit_huber(blocks: DataFrame, problems: list[Problem], d: int, t: int, epsilon: float, reg: float, iterations: int, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights [problem, t * d + 1] (the last one the intercept), and steps taken. The penalty is on standardised inputs."""
    size = t * d
    whole = np.ones(len(problems), dtype=bool)
    sums = one_pass(blocks, problems, np.zeros((len(problems), 1)), d, t, moments_kernel, whole)
    n = np.maximum(sums[:, :1], 1)
    mean = sums[:, 1 : size + 1] / n
    spread = np.sqrt(np.maximum(sums[:, size + 1 :] / n - mean * mean, 0.0) * n / np.maximum(n - 1, 1))
    inverse = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)  # constant inputs have no weight

    def raw(z: np.ndarray) -> np.ndarray:
        w = z[:, :size] * inverse
        return np.concatenate([w, z[:, size : size + 1] - (w * mean).sum(1, keepdims=True), z[:, size + 1 :]], axis=1)

    def value(z: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = one_pass(blocks, problems, raw(z), d, t, huber_kernel(epsilon), active)
        count = np.maximum(got[:, 0], 1)
        slope = got[:, size + 2]
        grad = np.concatenate([(got[:, 2 : size + 2] - slope[:, None] * mean) * inverse, slope[:, None], got[:, size + 3 :]], axis=1) / count[:, None]
        grad[:, :size] += reg * z[:, :size]
        return got[:, 1] / count + reg / 2 * (z[:, :size] ** 2).sum(1), grad

    z, taken = minimise(value, np.zeros((len(problems), size + 2)), iterations, tol)
    return raw(z)[:, : size + 1], taken


# ---- factorisation model


def fm_parts(params: np.ndarray, t: int, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, linear weights [t, d] and factors [k, t, d]."""
    return params[0], params[1 : 1 + t * d].reshape(t, d), params[1 + t * d :].reshape(-1, t, d)


def fm_guess(params: np.ndarray, x: np.ndarray, t: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Guess of every window and its factor sums: pairwise terms are half of squared sums less sums of squares."""
    b, w, v = fm_parts(params, t, x.shape[1])
    sums = [along_diagonals(x @ f.T, t) for f in v]
    squares = along_diagonals((x * x) @ (v * v).sum(axis=0).T, t) if len(v) else 0.0
    return b + along_diagonals(x @ w.T, t) + (sum(s * s for s in sums) - squares) / 2, sums


def window_guess(windows: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Guess for whole windows [n, t, d]: linear when there are no factors (the intercept then stands last)."""
    n, t, d = windows.shape
    x = windows.reshape(n, t * d)
    if len(params) == t * d + 1:
        return x @ params[:-1] + params[-1]
    b, w, v = fm_parts(params, t, d)
    sums = x @ v.reshape(len(v), -1).T
    return b + x @ w.ravel() + ((sums * sums).sum(axis=1) - (x * x) @ (v * v).sum(axis=0).ravel()) / 2


def fm_kernel(params: np.ndarray, x, target, learns, judged, t: int, p: Problem) -> np.ndarray:
    """Squared loss and its gradient over training windows; count, squared and Huber loss over judged ones."""
    guess, sums = fm_guess(params, x, t)
    _, _, v = fm_parts(params, t, x.shape[1])
    off = guess[learns - t] - target[learns]
    weight = np.zeros(len(guess))
    weight[learns - t] = 2 * off
    held = np.abs(guess[judged - t] - target[judged])
    robust = np.where(held <= 1.0, 0.5 * held * held, held - 0.5)
    square = window_sums(x * x, weight, t)
    factors = [(window_sums(x, weight * s, t) - f * square).ravel() for s, f in zip(sums, v)]
    head = [len(learns), float((off * off).sum()), len(judged), float((held * held).sum()), float(robust.sum())]
    return np.concatenate([head, [weight.sum()], window_sums(x, weight, t).ravel(), *factors])


def fit_fm(blocks: DataFrame, problems: list[Problem], d: int, t: int, iterations: int, seed: int, patience: int = 0) -> tuple[np.ndarray, list[dict]]:
    """Parameters [problem, 1 + t * d * (1 + factors)] by decoupled-decay adaptive steps over all training windows, and each problem's course.

    With ``patience`` a problem leaves the passes when its judged loss has not fallen for so many steps, and its best state is
    restored. Problems with fewer factors than the most have factors of zero, which stay zero.
    """
    size, most = t * d, max(p.factors for p in problems)
    rng = np.random.default_rng(seed)
    draw = rng.normal(0, 0.01, (most, size))
    x = np.zeros((len(problems), 1 + size * (1 + most)))
    for i, p in enumerate(problems):
        x[i, 1 + size :].reshape(most, size)[: p.factors] = draw[: p.factors]
    m, v = np.zeros_like(x), np.zeros_like(x)
    rate = np.array([p.step for p in problems])[:, None]
    decay = np.array([p.decay for p in problems])[:, None]
    active = np.ones(len(problems), dtype=bool)
    best, best_x, best_at = np.full(len(problems), np.inf), x.copy(), np.zeros(len(problems), dtype=int)
    rounds, robust = np.zeros(len(problems), dtype=int), np.full(len(problems), np.nan)
    for k in range(1, iterations + 2):  # the last pass only judges
        got = one_pass(blocks, problems, x, d, t, fm_kernel, active)
        judged = got[:, 3] / np.maximum(got[:, 2], 1)
        robust = np.where(active, got[:, 4] / np.maximum(got[:, 2], 1), robust)
        better = active & (judged < best)
        best[better], best_x[better], best_at[better] = judged[better], x[better], k - 1
        if patience:
            active = active & (k - 1 - best_at < patience)
        if k > iterations or not active.any():
            break
        grad = got[:, 5:] / np.maximum(got[:, :1], 1)
        on = active[:, None]
        m, v = np.where(on, 0.9 * m + 0.1 * grad, m), np.where(on, 0.999 * v + 0.001 * grad * grad, v)
        move = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        x = np.where(on, x * (1 - rate * decay) - move, x)
        rounds += active
    course = [{"rounds": int(r), "best_round": int(b), "best_loss": float(f), "judged": float(h)} for r, b, f, h in zip(rounds, best_at, best, robust)]
    return (best_x if patience else x), course


# ---- forecasts of test rows


def predict_tests(blocks: DataFrame, problems: list[Problem], params: np.ndarray, d: int, t: int, linear: bool) -> DataFrame:
    """A row per test window of every problem, back at price level."""
    sent = blocks.sparkSession.sparkContext.broadcast(params)
    when = blocks.schema["day"].dataType.elementType.simpleString()

    def work(block: Block) -> Iterator[pa.RecordBatch]:
        for i, p in enumerate(problems):
            ready = block.scaled(p.fold_id, p.test_end)
            if ready is None:
                continue
            x, own = ready
            tests = own[block.cal[own] >= p.judged_end]
            if len(tests) == 0:
                continue
            values = sent.value[i]
            guess = along_diagonals(x @ values[:-1].reshape(t, d).T, t) + values[-1] if linear else fm_guess(values, x, t)[0]
            k = block.folds[p.fold_id]
            price = guess[tests - t] * block.width[k, 0] + block.low[k, 0]
            at = pa.array(tests)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.symbol] * len(tests), pa.string()), pa.array(np.full(len(tests), i), pa.int32()), block.prev_date.take(at), block.day.take(at), pa.array(block.close[tests]), pa.array(price)],
                names=["symbol", "problem", "origin_date", "date", "y_true", "y_pred"],
            )

    return per_block(blocks, d, t, work, f"symbol string, problem int, origin_date {when}, date {when}, y_true double, y_pred double")
