"""Quality rules: statistics of a text, two hard rules, and an isolation forest on the statistics.

Trees are grown on a sample of ``SAMPLE`` rows (a parameter of the method: small samples isolate best); the threshold comes from
labelled rows, all of them counted. Each document is scored by its mean path length.

Defined results: NULL and empty texts have no words and fail the first rule; without labelled good rows only the hard rules
apply; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foldcast.llm.shared import need_columns, stored
from foldcast.llm.words import batch_words, text_buffer

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50  # fixed values of the two hard rules
SAMPLE, TREES, SUBSAMPLE, KEEP_GOOD = 4096, 100, 64, 0.99
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_digits", "n_marks", "n_distinct"]
_STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS + EXTRA])


def _repeated_words(words, n_rows: int) -> np.ndarray:
    """Words of each row inside a window of three that the row holds twice or more."""
    h, at, row = words.windows(3)
    out = np.zeros(n_rows, dtype=np.int64)
    if len(h):
        order = np.lexsort((h, row))
        h, at, row = h[order], at[order], row[order]
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        twice = np.zeros(len(h), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(words.hash), dtype=bool)
        for k in range(3):
            covered[at[twice] + k] = True
        np.add.at(out, words.row[covered], 1)
    return out


def _repeated_lines(text: bytes) -> tuple[int, int]:
    lines = text.split(b"\n")
    worded = [x for x in lines if x.split(None, 1)] if len(lines) > 1 else []
    return len(worded) - len(set(worded)), len(lines)


def statistics_of(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of an Arrow column."""
    data, edges = text_buffer(column)
    n = len(edges) - 1
    out = {c: np.zeros(n, dtype=np.int64) for c in COUNTS + EXTRA}
    for first, last, words in batch_words(column, lower=False):
        part, edge, rows = words.data, edges[first : last + 1] - edges[first], last - first

        def per_row(flags: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return sums[edge[1:]] - sums[edge[:-1]]

        out["n_words"][first:last] = np.diff(words.first)
        space = np.zeros(256, dtype=bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        out["word_chars"][first:last] = per_row(((part & 0xC0) != 0x80) & ~space[part])
        out["n_symbols"][first:last] = per_row(_SYMBOL[part])
        out["n_upper"][first:last] = per_row((part >= 65) & (part <= 90))
        out["n_digits"][first:last] = per_row((part >= 48) & (part <= 57))
        out["n_marks"][first:last] = per_row((part == 33) | (part == 63) | (part == 46) | (part == 44))
        out["n_repeat_words"][first:last] = _repeated_words(words, rows)
        key = np.lexsort((words.hash, words.row))
        h, r = words.hash[key], words.row[key]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        out["n_distinct"][first:last] = np.bincount(r[new], minlength=rows)
        for i in range(rows):
            out["n_dup_lines"][first + i], out["n_lines"][first + i] = _repeated_lines(part[edge[i] : edge[i + 1]].tobytes())
    return out


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with the counts of each whole text as columns."""
    need_columns(docs, text)
    kept = [c for c in docs.columns if c != text and c not in _STATS.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = statistics_of(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(got[c]) for c in _STATS.names)], names=kept + _STATS.names)

    return docs.select(*kept, text).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *_STATS.fields]))


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics as shares of the text, one row per document."""
    words = np.maximum(stats["n_words"], 1).astype(float)
    chars = np.maximum(stats["word_chars"], 1).astype(float)
    return np.column_stack([
        np.log1p(stats["n_words"]), chars / words, np.sqrt(stats["n_symbols"] / words), np.sqrt(stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1)),
        np.sqrt(stats["n_repeat_words"] / words), np.sqrt(stats["n_upper"] / chars), np.sqrt(stats["n_digits"] / chars),
        np.sqrt(stats["n_marks"] / words), np.log(np.maximum(stats["n_distinct"], 1) / words) / np.log(words + 1.0),
    ])


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows, by which depths are scaled."""
    n = np.maximum(np.asarray(n, dtype=float), 2.0)
    return np.where(n <= 2.0, 1.0, 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n)


@dataclass
class IsolationForest:
    """Trees as arrays: the split column (-1 at a leaf), its cut, the left child, and the depth a leaf stands for."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    height: int
    scale: float

    @classmethod
    def grow(cls, rows: np.ndarray, trees: int, subsample: int = SUBSAMPLE, seed: int = 11) -> IsolationForest:
        rng = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        height = max(1, int(np.ceil(np.log2(max(size, 2)))) + 4)
        grown = []
        for _ in range(trees):
            nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
            todo = [(0, rows[rng.choice(len(rows), size, replace=False)], 0)]
            while todo:
                at, part, depth = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                open_columns = np.flatnonzero(high > low)
                if len(part) <= 1 or depth >= height or not len(open_columns):
                    nodes[at] = [-1, 0.0, 0, depth + (float(mean_path(len(part))) if len(part) > 1 else 0.0)]
                    continue
                c = int(rng.choice(open_columns))
                cut = float(rng.uniform(low[c], high[c]))
                nodes[at] = [c, cut, len(nodes), 0.0]
                goes = part[:, c] < cut
                todo += [(len(nodes), part[goes], depth + 1), (len(nodes) + 1, part[~goes], depth + 1)] if goes.any() and (~goes).any() else []
                nodes += [[-1, 0.0, 0, depth + 1.0 + float(mean_path(len(part)))], [-1, 0.0, 0, depth + 1.0 + float(mean_path(len(part)))]]
            grown.append(np.array(nodes))
        most = max(len(t) for t in grown)
        block = np.stack([np.pad(t, ((0, most - len(t)), (0, 0))) for t in grown])
        return cls(block[..., 0].astype(np.int16), block[..., 1], block[..., 2].astype(np.int32), block[..., 3], height, float(mean_path(size)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1: short paths score high."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for t in range(len(self.column)):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.height + 1):
                c = self.column[t][node]
                inner = c >= 0
                if not inner.any():
                    break
                right = rows[at_row, np.maximum(c, 0)] >= self.cut[t][node]
                node = np.where(inner, self.left[t][node] + right, node)
            total += self.depth[t][node]
        return 2.0 ** (-total / (len(self.column) * self.scale))


def anomaly(forest: IsolationForest, stats: DataFrame) -> DataFrame:
    """``stats`` with an ``anomaly`` column."""
    names = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in _STATS.names})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(rows))], names=[*names, "anomaly"])

    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("anomaly", T.DoubleType())]))


def hard_fail() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def apply_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", trees: int = TREES, sample: int = SAMPLE, keep_good: float = KEEP_GOOD) -> DataFrame:
    """Counts of each document with base_failed, anomaly and kept.

    The forest is grown on the ``sample`` rows of lowest key hash that pass the hard rules; the threshold is the quantile
    ``keep_good`` of the anomaly of all labelled good rows that pass them.
    """
    need_columns(docs, key, text)
    stats = stored(text_statistics(docs.select(key, text), text).withColumn("base_failed", hard_fail()), "rule-statistics")
    passing = stats.where(~F.col("base_failed"))
    grown_on = passing.orderBy(F.xxhash64(F.col(key)), *COUNTS).limit(sample).select(*_STATS.names).toArrow()
    if grown_on.num_rows == 0:
        return stats.withColumn("anomaly", F.lit(0.0)).withColumn("kept", ~F.col("base_failed"))
    forest = IsolationForest.grow(features({c: grown_on.column(c).to_numpy() for c in _STATS.names}), trees)
    scored = anomaly(forest, stats)
    good = labels.where(F.col("quality") == 1).select(key).distinct()
    threshold = scored.where(~F.col("base_failed")).join(good, key, "left_semi").agg(F.percentile_approx("anomaly", keep_good, 10_000)).first()[0]
    verdict = F.lit(True) if threshold is None else F.col("anomaly") <= threshold
    return scored.withColumn("kept", ~F.col("base_failed") & verdict)
