"""Periodic runs of words, found online by dyadic square catching, and texts with each run cut to one period.

A run is a longest stretch of consecutive words that repeats with a period (its smallest), at least MIN_TIMES times over and
MIN_LENGTH words long. Words arrive in order, some at a time. Each completed block of 2**k words becomes a catcher for periods
from 2**(k+1) - 1 to 2**(k+2) - 2: it waits for its own words to come again at such a distance, which they do in every square of
that period that holds the block in its first half. What it catches is compared backwards from the block, and forwards with
every word that is appended, as long as the words a period apart agree; squares of one stretch merge into one run.

Defined results: NULL, empty and blank texts have no runs and collapse to the empty text; words are cut at ASCII white space and
compared byte by byte, with no length too long; equal texts have equal runs; repeated rows and NULL keys are rows like others; an
empty table gives an empty one. ``find_runs`` returns its own columns only, whatever other columns the input has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldcast.llm.shared import need_columns
from foldcast.llm.words import mix, release_memory

MIN_LENGTH = 24
MIN_TIMES = 3
PORTION = 1 << 15  # words appended together
MATCHES = 1 << 18  # block and distance pairs compared together
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class SquareCatcher:
    """Runs of a sequence of word numbers that is fed with ``append``."""

    def __init__(self, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> None:
        if min_length < 1 or min_times < 2:
            raise ValueError("a run repeats at least twice")
        self.min_length, self.min_times = min_length, min_times
        self.words = np.zeros(0, dtype=np.int64)
        self.names: list[np.ndarray] = []  # by level: a name of the block that starts at each word
        self.watched: list[int] = []  # by level: blocks whose catchers are done
        self.ends: dict[tuple[int, int], int] = {}  # (start, period) of stretches: where each ends

    def append(self, words: np.ndarray) -> None:
        """Stretches that reached the last word go on with the new ones; then catchers that have seen all they wait for act."""
        before = len(self.words)
        self.words = np.concatenate([self.words, words])
        for (start, period), end in list(self.ends.items()):
            if end == before:
                self._keep(start, period, self._forward(end, period), False)
        self._name(before)
        for level in range(len(self.names)):
            self._catch(level, False)

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start and period."""
        for level in range(len(self.names)):
            self._catch(level, True)
        least: dict[tuple[int, int], int] = {}
        for (start, period), end in self.ends.items():
            if self._long_enough(end - start, period):
                least[start, end] = min(period, least.get((start, end), period))
        return sorted((s, e - s, p) for (s, e), p in least.items())

    def _long_enough(self, length: int, period: int) -> bool:
        return length >= max(self.min_length, self.min_times * period)

    def _name(self, before: int) -> None:
        """Names of the blocks that the new words complete, each from its halves."""
        n = len(self.words)
        level = 0
        while 2 ** (level + 1) - 1 <= n // self.min_times:
            size = 1 << level
            if level == len(self.names):
                self.names.append(np.zeros(0, dtype=np.uint64))
                self.watched.append(0)
            known = self.names[level]
            if level == 0:
                new = mix(self.words[len(known) :].astype(np.uint64) + np.uint64(1))
            else:
                half, a, b = self.names[level - 1], len(known), n - size + 1
                new = mix(half[a:b] * _PAIR + half[a + size // 2 : b + size // 2])
            self.names[level] = np.concatenate([known, new])
            level += 1

    def _catch(self, level: int, last: bool) -> None:
        """Blocks that come again at a distance in the level's range, as do the blocks next to them that a run would hold too."""
        size, low, high, n = 1 << level, 2 ** (level + 1) - 1, 2 ** (level + 2) - 2, len(self.words)
        agree = max(self.min_length - high, (self.min_times - 1) * low)
        blocks = max(1, (agree - size + 1) // size)
        names, a = self.names[level], self.watched[level]
        room = n - blocks * size - (low if last else high)
        b = max(a, room // size + 1 if room >= 0 else 0)
        distance = np.arange(low, high + 1)
        step = max(1, MATCHES // len(distance))
        for first in range(a, b, step):
            start = np.arange(first, min(b, first + step)) * size
            again = start[:, None] + distance[None, :]
            inside = again + blocks * size <= n
            row, column = np.nonzero((names[np.minimum(again, len(names) - 1)] == names[start][:, None]) & inside)
            at, period = start[row], distance[column]
            for k in range(1, blocks):
                same = names[at + k * size] == names[at + period + k * size]
                at, period = at[same], period[same]
            self._settle(at, period, blocks * size, last)
        self.watched[level] = b

    def _settle(self, at: np.ndarray, period: np.ndarray, width: int, last: bool) -> None:
        """Turn catches into stretches. A catch inside a stretch whose period divides its own adds nothing to it."""
        for (start, p), end in self.ends.items():
            if len(at) == 0:
                return
            new = (at < start) | (at + period + width > end) | (period % p != 0)
            at, period = at[new], period[new]
        while len(at):
            x, q = int(at[0]), int(period[0])
            start, end = self._backward(x, q), self._forward(x + q, q)
            kept = self._keep(start, q, end, last)
            new = (at < start) | (at + period + width > end) | ((period % q != 0) if kept else (period != q))
            new[0] = False
            at, period = at[new], period[new]

    def _keep(self, start: int, period: int, end: int, last: bool) -> bool:
        """Note a stretch that is long enough, or may become so."""
        keep = self._long_enough(end - start, period) or (end == len(self.words) and not last)
        if keep:
            self.ends[start, period] = end
        else:
            self.ends.pop((start, period), None)
        return keep

    def _forward(self, at: int, period: int) -> int:
        """The first word from ``at`` on that differs from the one a period before."""
        w, n, step = self.words, len(self.words), 64
        while at < n:
            upto = min(n, at + step)
            differ = np.flatnonzero(w[at:upto] != w[at - period : upto - period])
            if len(differ):
                return at + int(differ[0])
            at, step = upto, 2 * step
        return n

    def _backward(self, at: int, period: int) -> int:
        """The least word from which on all words up to ``at`` equal those a period further."""
        w, step = self.words, 64
        while at > 0:
            low = max(0, at - step)
            differ = np.flatnonzero(w[low:at] != w[low + period : at + period])
            if len(differ):
                return low + int(differ[-1]) + 1
            at, step = low, 2 * step
        return 0


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words."""
    if len(words) < min_length:
        return []
    numbers: dict[bytes, int] = {}
    catcher = SquareCatcher(min_length, min_times)
    for first in range(0, len(words), PORTION):
        part = words[first : first + PORTION]
        catcher.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in part), np.int64, len(part)))
    return catcher.finish()


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep.tolist()))


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> DataFrame:
    """(key, runs, collapsed): every row's runs by start and period, and its text with each run cut to its first period.

    Rows are worked on where they are; nothing is shuffled.
    """
    need_columns(docs, key, text)
    kind = docs.schema[key].dataType
    of_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found, kept = [], []
            for value in texts:
                words = (value.as_py() or b"").split()
                runs = runs_of(words, min_length, min_times)
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                kept.append(collapse(words, runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(of_run)), pa.array(kept, pa.binary()).cast(pa.string())], names=["key", "runs", "collapsed"]
            )
        release_memory()

    schema = f"key {kind.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run of the greatest length per period, compared exactly; then the first, then the one of the smallest period."""

    def order(a: Column, b: Column) -> Column:
        more = b["length"] * a["period"] - a["length"] * b["period"]
        gap = F.when(more != 0, more).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(gap).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def repeat_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with the tails of a tenth of all texts, by their keys' checksums, turned into repeats of a few words.

    NULL keys leave their texts as they are.
    """
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select(key, text, F.crc32(F.col(key).cast("string").cast("binary")).alias("_h"))
    tens = F.floor(F.col("_h") / 10)
    w, n = words, F.size(words)
    a = F.pmod(tens, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(tens, F.lit(8))))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), times)), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")
    return rows.select(key, F.when((F.col("_h") % 10 == 0) & (n > 0), changed).otherwise(F.col(text)).alias(text))
