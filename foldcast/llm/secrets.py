"""Secret scans: three rules, and a character convolutional network over every candidate with the text around it.

A candidate is a long run of token characters. Findings of the rules label the runs they hold as secrets; runs of letters only or
digits only outside findings are labelled as plain. Mixed runs outside findings have no label: the network decides on them. It is
trained on every distinct labelled window of all documents, but for a quarter by hash: on those its scores are calibrated, and the
threshold is the highest that still recalls ``RECALL`` of their findings. Windows are placed by hash in parts of about ``PART``; in
each of ``ROUNDS`` rounds every part takes its steps from the same state, and the parts' states are averaged by their windows, so that
only sums pass through the driver.

Defined results: NULL and empty texts have no spans; with no findings of both classes the rules stand alone; repeated rows
repeat; spans count code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foldcast.llm.resample import least_reaching
from foldcast.llm.shared import need_columns, stored
from foldcast.llm.spans import Span, joined, overlaps, sha256_hex

# The rules and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "cnn")

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
RECALL, BEFORE, WIDTH = 0.98, 24, 72
PART, ROUNDS = 4096, 6
CLASSES = 70  # codes of characters


def base_spans(text: str) -> list[Span]:
    """What the rules find, leftmost and without overlap per kind; matches that are too short go without a second try."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


_CODE = np.full(256, 1, dtype=np.uint8)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_"):
    _CODE[_c] = 4 + _i
for _c in b"=:\"'`":
    _CODE[_c] = 2
_CODE[ord(" ")] = 3
_CODE[ord("-")] = 69
_CODE[0] = 0


def window(text: str, start: int, end: int) -> bytes:
    """The run in its surroundings, one code per character; a longer run is seen whole in several windows by ``windows``."""
    left = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    raw = (left + text[start : start + WIDTH - BEFORE]).ljust(WIDTH, "\0")
    return _CODE[np.frombuffer(raw.encode("latin-1", "replace"), dtype=np.uint8)].tobytes()


def windows(text: str, start: int, end: int) -> list[bytes]:
    """Windows over a whole run, at most half a window apart."""
    step = (WIDTH - BEFORE) // 2
    return [window(text, s, end) for s in range(start, max(start + 1, end - step), step)]


def run_label(text: str, start: int, end: int, base: list[Span]) -> int | None:
    """1: holds a finding; 0: plain letters or digits; None: no label."""
    if overlaps(start, end, base):
        return 1
    run = text[start:end]
    return 0 if run.isalpha() or run.isdigit() else None


@dataclass
class AdamState:
    """Running means of the gradients and of their squares, and the steps taken (a mean over parts, so not whole)."""

    first: list[np.ndarray]
    second: list[np.ndarray]
    steps: float

    @classmethod
    def fresh(cls, params: list[np.ndarray]) -> AdamState:
        return cls([np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0.0)


@dataclass
class CharNet:
    """Character embedding, one layer of filters, the maximum over the window, a dense layer, a probability."""

    emb: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    slope: float = 1.0
    threshold: float = 0.5

    SIZE = 6

    @classmethod
    def fresh(cls, seed: int = 3, depth: int = 8, n: int = 24) -> CharNet:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.3, (CLASSES, depth)).astype(np.float32),
            rng.normal(0, 0.15, (cls.SIZE * depth, n)).astype(np.float32),
            np.zeros(n, dtype=np.float32),
            np.zeros(2 * n + 1, dtype=np.float32),
        )

    def forward(self, codes: np.ndarray):
        e = self.emb[codes]
        n, width, depth = e.shape
        steps = width - self.SIZE + 1
        view = np.lib.stride_tricks.sliding_window_view(e, self.SIZE, axis=1).transpose(0, 1, 3, 2).reshape(n, steps, self.SIZE * depth)
        act = np.maximum(view @ self.filters + self.bias, 0)
        inside = act[:, BEFORE - self.SIZE // 2 :]
        top, best = act.max(axis=1), act.argmax(axis=1)
        mean = inside.mean(axis=1)
        hidden = np.concatenate([top, mean, np.ones((n, 1), dtype=np.float32)], axis=1)
        return hidden @ self.out, hidden, view, act, best

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.filters, self.bias, self.out]

    def learn(self, codes: np.ndarray, y: np.ndarray, share: float, state: AdamState, rng: np.random.Generator, batch: int = 128, rate: float = 0.01) -> AdamState:
        """One round of Adam on the log loss, both classes weighing the same at a ``share`` of secrets; in half of the windows the
        surroundings are blanked, and letters change case in some."""
        params = self.params()
        first, second, t = state.first, state.second, state.steps
        swap = np.arange(CLASSES)
        swap[4:30], swap[30:56] = np.arange(30, 56), np.arange(4, 30)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = codes[pick].copy()
            x[rng.random(len(x)) < 0.5, :BEFORE] = 0
            flip = rng.random(len(x)) < 0.3
            x[flip] = swap[x[flip]]
            z, hidden, view, act, best = self.forward(x)
            g = (1 / (1 + np.exp(-z)) - y[pick]) * weight[pick] / len(pick)
            g_hidden = np.outer(g, self.out)
            n_filters = self.filters.shape[1]
            g_act = np.zeros_like(act)
            np.put_along_axis(g_act, best[:, None, :], g_hidden[:, None, :n_filters], axis=1)
            inner = BEFORE - self.SIZE // 2
            g_act[:, inner:] += g_hidden[:, None, n_filters : 2 * n_filters] / (act.shape[1] - inner)
            g_act *= act > 0
            g_view = (g_act @ self.filters.T).reshape(*view.shape[:2], self.SIZE, -1)
            g_emb = np.zeros_like(self.emb)
            for k in range(self.SIZE):
                np.add.at(g_emb, x[:, k : k + view.shape[1]], g_view[:, :, k])
            flat = view.reshape(-1, view.shape[2])
            grads = [g_emb, flat.T @ g_act.reshape(-1, n_filters), g_act.sum(axis=(0, 1)), hidden.T @ g]
            t += 1
            for p, d, m, v in zip(params, grads, first, second):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
        return AdamState(first, second, t)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)]) if len(codes) else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.chance(self.logits(codes).astype(float))

    def chance(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def labelled_windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``label, codes``: every distinct window of a labelled run, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, bytes]] = set()
            for value in batch.column(text).to_pylist():
                if not value:
                    continue
                base = None
                for m in RUN.finditer(value):
                    base = base_spans(value) if base is None else base
                    label = run_label(value, m.start(), m.end(), base)
                    if label is not None:
                        found.add((label, window(value, m.start(), m.end())))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.binary())], names=["label", "codes"])

    return docs.select(text).mapInArrow(run, "label int, codes binary").distinct()


def _codes(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, WIDTH)


def fit_net(rows: DataFrame, count: int, share: float, part: int = PART, rounds: int = ROUNDS, seed: int = 5) -> CharNet:
    """The network after all rounds over ``rows`` (``count`` of them, a ``share`` of them secrets); the same on any cluster."""
    net = CharNet.fresh()
    state = AdamState.fresh(net.params())
    shapes = [p.shape for p in net.params()]
    cuts = np.cumsum([p.size for p in net.params()] * 3)
    parts = max(1, -(-count // part))
    placed = rows.select("label", "codes").repartition(parts, "codes").sortWithinPartitions("codes", "label").persist()

    def pull(flat: np.ndarray) -> tuple[list[np.ndarray], AdamState]:
        pieces = [p.astype(np.float32).reshape(shape) for p, shape in zip(np.split(flat[:-1], cuts[:-1]), shapes * 3)]
        n = len(shapes)
        return pieces[:n], AdamState(pieces[n : 2 * n], pieces[2 * n :], float(flat[-1]))

    def one_round(k: int, flat: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column("label").to_pylist(), b.column("codes").to_pylist()) for b in batches if b.num_rows]  # a part: about PART windows
            if not got:
                return
            windows, y = [w for _, ws in got for w in ws], np.array([v for ys, _ in got for v in ys], dtype=np.float32)
            params, begun = pull(flat)
            own = CharNet(*params)
            after = own.learn(_codes(windows), y, share, begun, np.random.default_rng([seed, k, zlib.crc32(windows[0])]))
            values = np.concatenate([*(a.ravel() for a in [*own.params(), *after.first, *after.second]), [after.steps]]).astype(float)
            yield _total(len(y), values * len(y))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, 0.0
            for batch in batches:
                for m, values in zip(batch.column("n").to_pylist(), batch.column("total")):
                    n, total = n + m, total + values.values.to_numpy()
            if n:
                yield _total(n, total)

        schema = "n long, total array<double>"
        sums = placed.mapInArrow(run, schema).repartition(min(parts, 32), "n").sortWithinPartitions("n", "total").mapInArrow(add, schema)
        found = sorted(sums.collect())
        return np.sum([r["total"] for r in found], axis=0) / sum(r["n"] for r in found)

    try:
        flat = np.concatenate([*(a.ravel() for a in [*net.params(), *state.first, *state.second]), [0.0]])
        for k in range(rounds):
            flat = one_round(k, flat)
    finally:
        placed.unpersist()
    return CharNet(*pull(flat)[0])


def _total(n: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([values.tolist()], pa.list_(pa.float64()))], names=["n", "total"])


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Bits of floats as integers in the floats' order, and back."""
    return np.where(bits < 0, bits ^ np.int32(0x7FFFFFFF), bits)


def calibrate(net: CharNet, rows: DataFrame, positives: int, negatives: int, recall: float = RECALL) -> CharNet:
    """Slope and shift by Newton steps over all ``rows``, then the highest threshold, 0.5 at least, that keeps the recall."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = net.logits(_codes(batch.column("codes").to_pylist())).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(z.astype(float)), pa.array(_flipped(z.view(np.int32)).astype(np.int64))], names=["label", "z", "place"])

    scored = stored(rows.select("label", "codes").mapInArrow(run, "label int, z double, place long"), "secret-scores")
    z = F.col("z")
    soft = F.when(F.col("label") == 1, F.lit((positives + 1) / (positives + 2))).otherwise(F.lit(1 / (negatives + 2)))
    a, b = 1.0, 0.0
    for _ in range(30):
        raw = F.lit(a) * z + F.lit(b)
        p = 1 / (1 + F.exp(-F.greatest(F.least(raw, F.lit(30.0)), F.lit(-30.0))))
        w = p * (1 - p) + 1e-9
        zz, z1, one, gz, g1 = scored.agg(F.sum(w * z * z), F.sum(w * z), F.sum(w), F.sum((p - soft) * z), F.sum(p - soft)).first()
        step = np.linalg.solve(np.array([[zz + 1e-3, z1], [z1, one + 1e-3]]), [gz, g1])
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    net.slope, net.shift = max(a, 1e-3), b
    least = least_reaching(scored.where(F.col("label") == 1), F.col("place"), int((1 - recall) * positives) + 1)
    last = _flipped(np.array([least], dtype=np.int32)).view(np.float32).astype(float)
    net.threshold = max(0.5, float(net.chance(last)[0]))
    return net


def train_secret_net(docs: DataFrame, text: str = "text", recall: float = RECALL) -> CharNet | None:
    """Fitted and calibrated on all labelled windows; a quarter of them judges, unless either class would then be missing."""
    need_columns(docs, text)
    rows = stored(labelled_windows(docs, text), "secret-windows").withColumn("held", F.pmod(F.xxhash64("codes"), F.lit(4)) == 3)
    counts = {(r["label"], r["held"]): r["count"] for r in rows.groupBy("label", "held").count().collect()}
    of = {(y, h): counts.get((y, h), 0) for y in (0, 1) for h in (False, True)}
    if not of[0, False] + of[0, True] or not of[1, False] + of[1, True]:
        return None
    if of[0, False] and of[1, False] and of[1, True]:
        learnt, judged = rows.where(~F.col("held")), rows.where("held")
    else:
        learnt = judged = rows
        of = {(y, h): of[y, False] + of[y, True] for y in (0, 1) for h in (False, True)}
    count = of[0, False] + of[1, False]
    return calibrate(fit_net(learnt, count, of[1, False] / count), judged, of[1, True], of[0, True], recall)


_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def scan_secrets(docs: DataFrame, net: CharNet | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of each rule, digest of their spans, and all spans with those the network adds."""
    need_columns(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, runs, codes, owner = [], [], [], []
            added: dict[int, list[Span]] = {}

            def settle() -> None:
                if not codes:
                    return
                p = net.probability(np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(-1, WIDTH))
                for hit in np.flatnonzero(p >= net.threshold):
                    row, s, e = runs[owner[hit]]
                    if (s, e, "cnn") not in added.setdefault(row, []):
                        added[row].append((s, e, "cnn"))
                runs.clear(), codes.clear(), owner.clear()

            for row, value in enumerate(batch.column(text).to_pylist()):
                value = value or ""
                base.append(base_spans(value))
                if net is not None:
                    for m in RUN.finditer(value):
                        if not overlaps(m.start(), m.end(), base[-1]):
                            runs.append((row, m.start(), m.end()))
                            seen = windows(value, m.start(), m.end())
                            codes += seen
                            owner += [len(runs) - 1] * len(seen)
                    if len(codes) >= 8192:
                        settle()
            settle()
            cols = [[sum(k == kind for _, _, k in b) for b in base] for kind in KINDS[:3]]
            cols += [[sha256_hex(joined(b, KINDS)) for b in base], [joined(b + added.get(i, []), KINDS) for i, b in enumerate(base)], [len(added.get(i, [])) for i in range(len(base))]]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, *(x.split(" ")[0] for x in _SCHEMA.split(", "))])

    fields = [T.StructField(n, T.LongType() if k == "long" else T.StringType()) for n, k in (x.split(" ") for x in _SCHEMA.split(", "))]
    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], *fields]))
