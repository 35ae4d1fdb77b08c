"""Quality classifier: a byte-level convolutional network over overlapping chunks that cover the whole document.

Bytes are embedded; learned filters slide over each chunk; the maximum of each filter over a chunk describes it; the mean and the
maximum over all chunks of a document go through a small dense layer to one probability. The network is trained in numpy on all
chunks of a sample of labelled documents: of each class those of lowest key hash, at most ``SAMPLE`` of them and ``BUDGET`` chunks in
all, and a document enters whole or not at all. Every document is scored over all its chunks.

Defined results: NULL and empty texts are scored as one blank chunk; with labels of one class or none the score is that share (0.5
for none); repeated rows are scored alike. Labels, language, source and key are never inputs of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foldcast.llm.shared import hashed_fold, keyed, measured, need_columns, stored
from foldcast.llm.words import release_memory, row_blocks, text_buffer

CHUNK, STEP = 512, 448
SAMPLE, BUDGET, THRESHOLD, FOLDS = 1500, 16_000, 0.3, 5
STRIDE, TAPS = 2, 4  # a filter sees TAPS pairs of bytes
DEPTH, FILTERS, DENSE = 6, 24, 12


def chunk_starts(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk, and its row; the last chunk of a row ends at or beyond the row's end, so no byte is left out."""
    sizes = np.diff(edges)
    n = 1 + np.maximum(0, -(-(sizes - CHUNK) // STEP))
    row = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return edges[row] + k * STEP, row


def chunk_bytes(data: np.ndarray, edges: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Chunks as rows of bytes; blank (0) beyond the end of the document."""
    if not len(data):
        return np.zeros((len(start), CHUNK), dtype=np.uint8)
    at = start[:, None] + np.arange(CHUNK)
    out = data[np.minimum(at, len(data) - 1)]
    out[at >= edges[row + 1][:, None]] = 0
    return out


@dataclass
class ByteNet:
    emb: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0

    @classmethod
    def fresh(cls, seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        f = np.float32
        return cls(
            rng.normal(0, 0.4, (256, DEPTH)).astype(f), rng.normal(0, 0.15, (TAPS * STRIDE * DEPTH, FILTERS)).astype(f), np.zeros(FILTERS, f),
            rng.normal(0, 0.2, (2 * FILTERS, DENSE)).astype(f), np.zeros(DENSE, f), np.zeros(DENSE + 1, f),
        )

    def tables(self) -> list[np.ndarray]:
        """What each pair of bytes adds to every filter, by its place in the filter: the products of embedding and filters."""
        pair = np.concatenate([np.repeat(self.emb, 256, axis=0), np.tile(self.emb, (256, 1))], axis=1)
        width = STRIDE * DEPTH
        return [pair @ self.filters[t * width : (t + 1) * width] for t in range(TAPS)]

    def pooled(self, chunks: np.ndarray, tables: list[np.ndarray], track: bool = False):
        """The maximum of each filter over each chunk; with ``track`` also the position where it was reached."""
        tops, where = [], []
        n = CHUNK // STRIDE - TAPS + 1
        for i in range(0, len(chunks), 64):
            pairs = chunks[i : i + 64, ::2].astype(np.intp) * 256 + chunks[i : i + 64, 1::2]
            act = np.take(tables[0], pairs[:, :n], axis=0)
            for t in range(1, TAPS):
                act += np.take(tables[t], pairs[:, t : t + n], axis=0)
            tops.append(act.max(axis=1))
            if track:
                where.append(act.argmax(axis=1))
        top = np.maximum(np.concatenate(tops) + self.bias, 0)
        return (top, np.concatenate(where)) if track else top

    def combine(self, top: np.ndarray, row: np.ndarray, n_rows: int):
        """Logits of documents from their chunks, which stand in order of ``row``; every row has one at least."""
        first = np.searchsorted(row, np.arange(n_rows))
        count = np.diff(np.append(first, len(row)))[:, None].astype(np.float32)
        both = np.concatenate([np.add.reduceat(top, first) / count, np.maximum.reduceat(top, first)], axis=1)
        hidden = both @ self.dense + self.dense_bias
        hidden = np.maximum(hidden, 0.1 * hidden)
        return hidden @ self.out[:-1] + self.out[-1], both, hidden, count

    def fit(self, chunks: np.ndarray, row: np.ndarray, y: np.ndarray, rounds: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 9) -> ByteNet:
        """Adam on the class-weighted log loss; the gradient of a maximum goes to the window that reached it."""
        rng = np.random.default_rng(seed)
        params = [self.emb, self.filters, self.bias, self.dense, self.dense_bias, self.out]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        begin = np.searchsorted(row, np.arange(len(y) + 1))
        size = TAPS * STRIDE
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                docs = order[at : at + batch]
                pick = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
                own = np.repeat(np.arange(len(docs)), begin[docs + 1] - begin[docs])
                x = chunks[pick]
                top, where = self.pooled(x, self.tables(), track=True)
                z, both, hidden, count = self.combine(top, own, len(docs))
                g = ((1 / (1 + np.exp(-z)) - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
                g_hidden = np.outer(g, self.out[:-1]) * np.where(hidden > 0, 1, 0.1)
                g_both = g_hidden @ self.dense.T
                g_top = (g_both[:, :FILTERS] / count)[own]
                g_top += np.where(top == both[own, FILTERS:], g_both[own, FILTERS:], 0)
                g_top *= top > 0
                spots = x[np.arange(len(x))[:, None, None], where[:, :, None] * STRIDE + np.arange(size)]
                seen = self.emb[spots].reshape(len(x), FILTERS, size * DEPTH)
                g_filters = (g_top[:, :, None] * seen).sum(axis=0).T
                back = (g_top[:, :, None] * self.filters.T).reshape(-1, DEPTH)
                g_emb = np.column_stack([np.bincount(spots.ravel(), back[:, k], 256) for k in range(DEPTH)])
                grads = [g_emb, g_filters, g_top.sum(axis=0), both.T @ g_hidden, g_hidden.sum(axis=0), np.append(hidden.T @ g, g.sum())]
                t += 1
                for p, d, m, v in zip(params, grads, first, second):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
        return self

    def score_texts(self, column: pa.Array) -> np.ndarray:
        data, edges = text_buffer(column)
        out, tables = np.zeros(len(edges) - 1), self.tables()
        for first, last in row_blocks(edges, 1 << 18):
            part = edges[first : last + 1]
            start, row = chunk_starts(part)
            tops = [self.pooled(chunk_bytes(data, part, start[i : i + 1024], row[i : i + 1024]), tables) for i in range(0, len(row), 1024)]
            out[first:last] = self.combine(np.concatenate(tops), row, last - first)[0]
        release_memory()
        return 1 / (1 + np.exp(-np.clip(out + self.shift, -40, 40)))


def _chunk_count(text: str) -> Column:
    """How many chunks a text has."""
    return F.greatest(F.lit(1), 1 + F.ceil((F.coalesce(F.octet_length(text), F.lit(0)) - CHUNK) / STEP)).cast("long")


def _training_chunks(docs: DataFrame, text: str) -> DataFrame:
    """All chunks of each text, one after the other in one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = text_buffer(batch.column(text))
            packed = []
            for i in range(len(edges) - 1):
                start, row = chunk_starts(edges[i : i + 2])
                packed.append(chunk_bytes(data, edges[i : i + 2], start, row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_y"), pa.array(packed, pa.binary())], names=["_key", "_y", "chunks"])

    schema = T.StructType([docs.schema["_key"], docs.schema["_y"], T.StructField("chunks", T.BinaryType())])
    return docs.select("_key", "_y", text).mapInArrow(run, schema)


def sample_rows(sizes: list, budget: int) -> list:
    """Rows (class, chunks, id, ...) in their order, as long as the chunks of their class fit the budget; too long ones are passed over."""
    used, kept = {0: 0, 1: 0}, []
    for r in sizes:
        if used[r[0]] + r[1] <= budget:
            used[r[0]] += r[1]
            kept.append(r[2])
    return kept


def train_quality_net(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, budget: int = BUDGET) -> ByteNet | float:
    """The network, or the share of label 1 where there is only one class. ``may_learn`` is a condition on ``key``."""
    need_columns(docs, key, text)
    known = labels.where(may_learn & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_y"))
    shares = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return float(next(iter(shares), 0.5))
    one = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_key"), "_key").limit(sample) for y in (0, 1)]
    picked, seen = measured(one[0].unionByName(one[1]), "quality-sample")
    rows = keyed(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), picked, "_key", "inner", rows=seen["rows"])
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_n", _chunk_count("_text")), "quality-texts")
    by_hash = [rows.where(F.col("_y") == y).orderBy(F.xxhash64("_key"), "_key", F.xxhash64("_text"), "_id").limit(sample) for y in (0, 1)]
    ids = sample_rows([r for part in by_hash for r in part.select("_y", "_n", "_id").collect()], budget)
    got = sorted(_training_chunks(rows.where(F.col("_id").isin(ids)), "_text").collect(), key=lambda r: (r["_key"], r["chunks"]))
    if len({r["_y"] for r in got}) < 2:
        return float(next((r["_y"] for r in got), 0.5))
    packed = [np.frombuffer(r["chunks"], dtype=np.uint8).reshape(-1, CHUNK) for r in got]
    y = np.array([r["_y"] for r in got], dtype=np.float32)
    row = np.repeat(np.arange(len(packed)), [len(p) for p in packed])
    chunks = np.concatenate(packed)
    del got, packed  # the driver keeps one copy of the chunks, and none after the fit
    net = ByteNet.fresh().fit(chunks, row, y)
    del chunks, row
    release_memory()
    net.shift = float(np.log(shares[1] / shares[0]))  # classes were weighted alike
    return net


def score_quality(docs: DataFrame, net: ByteNet | float, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; a column of that name is replaced."""
    need_columns(docs, text)
    if isinstance(net, float):
        return docs.withColumn(name, F.lit(net))
    kept = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(net.score_texts(batch.column(text)))], names=[*kept, name])

    return docs.select(*kept).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())]))


def learnable(key: str = "doc_id") -> Column:
    return hashed_fold(F.col(key), FOLDS) != 0
