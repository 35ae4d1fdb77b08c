"""Importance resampling towards a target text: hashed n-gram weights, a threshold found by bisection, ranks from ranges.

Every document's weight is the sum of its features' gains, read from one array of BUCKETS numbers; a random term that only its
key decides turns the weight into a score, and the highest scores are drawn. The cutoff is found by rounds of exact count jobs
over the stored scores (then over the keys that tie with it, then over the rows of one key), so nothing is sorted but the drawn
rows, which are range-partitioned for their ranks.

Defined results: NULL, empty and wordless texts have no features, weight 0 and a score; documents below ``min_words`` are scored
and never drawn; NULL keys hash as the empty text and come last among ties; repeated rows are rows of their own; an empty table
gives an empty one, and an empty target the same gains as a target without features. ``weigh`` and ``draw`` return their own
columns only; ``resample`` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from foldcast.llm.shared import free_name, keyed, need_columns, stored
from foldcast.llm.words import release_memory, row_blocks, text_buffer

BUCKETS = 10_000
LONGEST = 3  # words in a feature
TABLED = 64  # bytes up to which a word's checksum comes from tables
PROBES = 15  # counts in one bisection job
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_steps() -> np.ndarray:
    """What one zero byte makes of a CRC-32 register's low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)  # fixed value: the reflected polynomial
    return c


def _zero_steps(longest: int) -> np.ndarray:
    """[length, byte, value]: what ``length`` zero bytes make of a register that holds ``value`` in ``byte``."""
    out = np.empty((longest + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(longest):
        out[k + 1] = _STEP[out[k] & 0xFF] ^ (out[k] >> 8)
    return out


_STEP = _byte_steps()
_ZEROS = _zero_steps(TABLED + 1)
_BLANK = np.uint32(zlib.crc32(b" "))


def _after_zeros(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    z = _ZEROS.reshape(len(_ZEROS), -1)
    return z[length, crc & 0xFF] ^ z[length, 256 + ((crc >> 8) & 0xFF)] ^ z[length, 512 + ((crc >> 16) & 0xFF)] ^ z[length, 768 + (crc >> 24)]


class Features:
    """CRC-32 of every run of one to three words of some rows, with its row."""

    def __init__(self, data: np.ndarray, edges: np.ndarray) -> None:
        data = _LOWER[data]
        inside = _WORD[data]
        starts, ends = inside.copy(), inside.copy()
        if len(data):
            cut = np.zeros(len(data) + 1, dtype=bool)
            cut[edges] = True
            starts[1:] &= ~inside[:-1] | cut[1:-1]
            ends[:-1] &= ~inside[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(edges, self.start, "right") - 1
        self.data, self.size = data, self.end - self.start
        self.long = np.flatnonzero(self.size > TABLED)
        crc = self._words()
        short = np.minimum(self.size, TABLED)
        self.spaced = _after_zeros(np.full(len(crc), _BLANK), short) ^ crc
        found, rows = [crc], [self.row]
        for k in range(1, LONGEST):
            crc = self._longer(crc, k)
            same = self.row[: len(crc)] == self.row[k:] if len(crc) else np.zeros(0, dtype=bool)
            found.append(crc[same])
            rows.append(self.row[: len(crc)][same])
        self.crc, self.of_row = np.concatenate(found), np.concatenate(rows)

    def _words(self) -> np.ndarray:
        """Byte by byte over all words at once, longest first; the few very long ones one by one."""
        crc = np.full(len(self.start), np.uint32(0xFFFFFFFF))
        size = np.where(self.size > TABLED, 0, self.size)
        order = np.argsort(-size, kind="stable")
        at, reg = self.start[order], crc[order]
        upto = len(order) - np.searchsorted(np.sort(size), np.arange(TABLED), "right")
        for k in range(int(size.max(initial=0))):
            m = upto[k]
            reg[:m] = _STEP[(reg[:m] ^ self.data[at[:m] + k]) & 0xFF] ^ (reg[:m] >> 8)
        crc[order] = reg
        crc ^= np.uint32(0xFFFFFFFF)
        for i in self.long:
            crc[i] = zlib.crc32(self.data[self.start[i] : self.end[i]])
        return crc

    def _longer(self, crc: np.ndarray, k: int) -> np.ndarray:
        """Checksums of runs that end k words further on, from those that end one word before."""
        crc = crc[: max(0, len(self.start) - k)]
        short = np.minimum(self.size[k:], TABLED)
        out = _after_zeros(crc, short + 1) ^ self.spaced[k:]
        for i in self.long[self.long >= k]:
            out[i - k] = zlib.crc32(self.data[self.start[i] : self.end[i]], zlib.crc32(b" ", int(crc[i - k])))
        return out

    def buckets(self) -> np.ndarray:
        return (self.crc % np.uint32(BUCKETS)).astype(np.int64)


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, Features]]:
    data, edges = text_buffer(column)
    for first, last in row_blocks(edges):
        yield first, last, Features(data[edges[first] : edges[last]], edges[first : last + 1] - edges[first])


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all rows in each bucket: counted in every task, added up by bucket; BUCKETS numbers reach the driver."""
    need_columns(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, found in _blocks(batch.column(0)):
                total += np.bincount(found.buckets(), minlength=BUCKETS)
        release_memory()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and source shares, rounded down."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def luck(key: object, seed: int) -> int:
    """Thousandths of a Gumbel draw that the key decides, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, row: str | None = None) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every row, by the gains of ``target`` over ``docs`` themselves.

    ``row`` names a column of whole numbers that tells the rows apart; it is passed on.
    """
    need_columns(docs, key, text)
    kind = docs.schema[key].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError("keys must be whole numbers")
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, text))
    names = ["key", "n_words", "n_features", "weight", "score", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            words, features, weight = (np.zeros(size, dtype=np.int64) for _ in range(3))
            for first, last, found in _blocks(batch.column(1)):
                words[first:last] = np.bincount(found.row, minlength=last - first)
                features[first:last] = np.bincount(found.of_row, minlength=last - first)
                # Whole numbers below 2**53 add up exactly as doubles.
                weight[first:last] = np.bincount(found.of_row, gains[found.buckets()], last - first).astype(np.int64)
            score = weight + np.array([luck(k, seed) for k in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight, score)), batch.column(2)], names=names)
        release_memory()

    number = F.col(row).cast("long") if row else F.lit(None).cast("long")
    out = docs.select(key, text, number).mapInArrow(run, f"key {kind.simpleString()}, n_words long, n_features long, weight long, score long, row long")
    return out.select(F.col("key").alias(key), *names[1:5], *([F.col("row").alias(row)] if row else []))


def least_reaching(rows: DataFrame, value: Column, need: int) -> int:
    """The least x with at least ``need`` rows of ``value`` <= x, which must exist; each round is one exact count job."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        points = sorted({low + (high - low) * (i + 1) // (PROBES + 1) for i in range(PROBES)})
        counts = rows.agg(*[F.count(F.when(value <= p, 1)) for p in points]).first()
        enough = [p for p, c in zip(points, counts) if c >= need]
        few = [p for p, c in zip(points, counts) if c < need]
        low, high = max(few) + 1 if few else low, min(enough) if enough else high
    return low


@dataclass(frozen=True)
class Cutoff:
    """The last drawn place in the order: score downwards, then key, then row."""

    score: int
    key: int
    row: int

    def reached(self) -> Column:
        last = (F.col("_order") < self.key) | ((F.col("_order") == self.key) & (F.col("_row") <= self.row))
        return (F.col("score") > self.score) | ((F.col("score") == self.score) & last)


def find_cutoff(rows: DataFrame, draws: int) -> Cutoff | None:
    """Where the ``draws``-th row stands, by bisection on scores, on keys that tie with the score, on rows of that key."""
    if draws < 1:
        return None
    score = -least_reaching(rows, -F.col("score"), draws)
    need = draws - rows.where(F.col("score") > score).count()
    ties = rows.where(F.col("score") == score)
    key = least_reaching(ties, F.col("_order"), need)
    need -= ties.where(F.col("_order") < key).count()
    return Cutoff(score, key, least_reaching(ties.where(F.col("_order") == key), F.col("_row"), need))


def draw(weighed: DataFrame, percent: int = 5, min_words: int = 20, key: str = "doc_id", row: str | None = None) -> DataFrame:
    """The rows of ``weigh`` with their ``rank`` from 1: the highest scores, ``percent`` of the rows with enough words; else NULL."""
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie between 0 and 100")
    order = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).alias("_order")
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = stored(weighed.select(F.col(key).alias("_key"), "n_words", "n_features", "weight", "score", order, number.alias("_row")), "weighed")
    able = rows.where(F.col("n_words") >= min_words)
    end = find_cutoff(able, percent * able.count() // 100)
    result = [F.col("_key").alias(key), "n_words", "n_features", "weight", "score", *([F.col("_row").alias(row)] if row else [])]
    none = F.lit(None).cast("long").alias("rank")
    if end is None:
        return rows.select(*result, none)
    taken = (F.col("n_words") >= min_words) & end.reached()
    # A row's number inside its range, after the sort, is what the identifier's low 33 bits count.
    places = [F.desc("score"), F.asc("_order"), F.asc("_row")]
    ranged = stored(rows.where(taken).repartitionByRange(*places).sortWithinPartitions(*places).withColumn("_at", F.monotonically_increasing_id()), "drawn")
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    first = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranks = ranged.join(F.broadcast(first), "_range").select(*result, (F.col("_first") + F.col("_at").bitwiseAND(2**33 - 1) + 1).alias("rank"))
    return rows.where(~taken).select(*result, none).unionByName(ranks)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, key: str = "doc_id", text: str = "text", seed: int = 42) -> DataFrame:
    """The drawn rows of ``docs``, all columns as they were."""
    need_columns(docs, key, text)
    at = free_name("_rid", docs.columns)
    rows = stored(docs.withColumn(at, F.monotonically_increasing_id()), "resample-rows")
    ranks = draw(weigh(rows, target, key, text, seed, at), percent, min_words, key, at)
    return keyed(rows, stored(ranks.where(F.col("rank").isNotNull()).select(at), "resample-drawn"), at).select(*docs.columns)
