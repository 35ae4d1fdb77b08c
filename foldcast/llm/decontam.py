"""Benchmark decontamination: every passage of the training texts queries a BM25 index of the test items.

The index holds postings of items in blocks with the largest impact of each term in each block. A passage (a window twice as long
as the longest item, moved by half) skips every block whose summed maxima stay below the block's least threshold; in the others a
weak-and search with pivots scores items. An item's threshold is what is left of its own score when the heaviest words of all
shingles it may lack are gone, so no passage that would pass the overlap check is lost. Hits are verified by the share of the
item's and of its answer's five-word shingles that the passage holds; the answer is the item's
last sentence, and at least the last five of the shingles.

Defined results: NULL and empty texts and items match nothing; items under five words count as one shingle; equal items are all
reported; repeated rows are all reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foldcast.llm.shared import need_columns
from foldcast.llm.words import Words, mix, release_memory, row_blocks, text_buffer

OVERLAP, ANSWER_OVERLAP, SHINGLE = 0.75, 0.5, 5
K1, B = 1.2, 0.75
SEGMENT_WORDS = 65_536  # the bound of one broadcast index; a larger benchmark is searched segment by segment
BLOCK_ITEMS, PARTS, MOST_BLOCKS = 16, 8, 64
_WEIGHTS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 2**64) for k in range(SHINGLE)], dtype=np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words, in order; a shorter text is one run."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return mix((words * _WEIGHTS[: len(words)]).sum(keepdims=True) + np.uint64(len(words))) if len(words) else words
    return mix(sum(words[k : k + n] * _WEIGHTS[k] for k in range(SHINGLE)))


def short_runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, as ``shingles`` hashes a text of that size."""
    n = len(words) - size + 1
    return mix(sum(words[k : k + n] * _WEIGHTS[k] for k in range(size)) + np.uint64(size)) if n > 0 else words[:0]


@dataclass
class BenchmarkIndex:
    item: list[int]
    terms: np.ndarray  # sorted word hashes
    postings: list[tuple[np.ndarray, np.ndarray]]  # of each term: items in order, impacts
    block_of: np.ndarray
    block_max: np.ndarray  # terms x blocks
    threshold: np.ndarray
    block_floor: np.ndarray
    small_max: np.ndarray  # terms x parts of blocks
    small_floor: np.ndarray
    shingles: list[np.ndarray] = field(repr=False)
    answers: list[np.ndarray] = field(repr=False)
    words: list[int]
    longest: int

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> BenchmarkIndex | None:
        data, edges = text_buffer(pa.array([t for _, t in items], pa.string()))
        words = Words(data, edges, lower=True)
        own = [words.hash[words.first[i] : words.first[i + 1]] for i in range(len(items))]
        filled = [i for i in range(len(items)) if len(own[i])]
        if not filled:
            return None
        own = [own[i] for i in filled]
        terms, inverse = np.unique(np.concatenate(own), return_inverse=True)
        doc = np.repeat(np.arange(len(own)), [len(w) for w in own])
        pair, tf = np.unique(inverse * len(own) + doc, return_counts=True)
        term, doc = pair // len(own), pair % len(own)
        df = np.bincount(term, minlength=len(terms))
        idf = np.log1p((len(own) - df + 0.5) / (df + 0.5))
        length = np.array([len(w) for w in own], dtype=float)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / length.mean()))
        size = max(BLOCK_ITEMS // PARTS, -(-len(own) // (MOST_BLOCKS * PARTS)))
        block_of = np.arange(len(own)) // size  # postings are cut into parts of blocks
        small_max = np.zeros((len(terms), (block_of[-1] // PARTS + 1) * PARTS), dtype=np.float32)
        np.maximum.at(small_max, (term, block_of[doc]), impact.astype(np.float32) * np.float32(1.00001))
        block_max = small_max.reshape(len(terms), -1, PARTS).max(axis=2)
        edge = np.searchsorted(term, np.arange(len(terms) + 1))
        grams = [np.unique(shingles(w)) for w in own]
        threshold = np.zeros(len(own))
        by_doc = np.argsort(doc, kind="stable")
        at = np.searchsorted(doc[by_doc], np.arange(len(own) + 1))
        answers = []
        for i in range(len(own)):
            weights = np.sort(impact[by_doc[at[i] : at[i + 1]]])[::-1]
            n_runs = max(1, len(own[i]) - SHINGLE + 1)
            lacking = n_runs - int(np.ceil(OVERLAP * len(grams[i])))  # runs, repeated ones too, that may be missing
            threshold[i] = 0.999 * (weights.sum() - weights[:lacking].sum())
            last = len(re.split(rb"(?<=[.!?])[\x20\x09-\x0D]+", items[filled[i]][1].strip().encode())[-1].split())
            first_run = max(0, n_runs - max(last, SHINGLE))
            answers.append(np.unique(shingles(own[i])[first_run:]))
        floor = np.full(small_max.shape[1], np.inf)
        np.minimum.at(floor, block_of, threshold)
        floor = floor.astype(np.float32)
        return cls(
            [items[i][0] for i in filled], terms, [(doc[edge[k] : edge[k + 1]], impact[edge[k] : edge[k + 1]]) for k in range(len(terms))],
            block_of, block_max, threshold, floor.reshape(-1, PARTS).min(axis=1), small_max, floor, grams, answers, [len(w) for w in own], int(length.max()),
        )

    def search(self, query: np.ndarray, block: int) -> list[tuple[int, float]]:
        """All items of a block that score at least their threshold for the query terms: weak-and with pivots."""
        lists = []
        for t in query:
            docs, impacts = self.postings[t]
            a, b = np.searchsorted(self.block_of[docs], [block, block + 1])
            if a < b:
                lists.append([docs[a:b].tolist(), impacts[a:b].tolist(), 0, float(self.small_max[t, block])])
        floor, hits = float(self.small_floor[block]), []
        while lists:
            lists.sort(key=lambda x: x[0][x[2]])
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += x[3]
                if bound >= floor:
                    pivot = x[0][x[2]]
                    break
            if pivot is None:
                break
            if lists[0][0][lists[0][2]] == pivot:
                score = 0.0
                for x in lists:
                    if x[0][x[2]] == pivot:
                        score += x[1][x[2]]
                        x[2] += 1
                if score >= self.threshold[pivot]:
                    hits.append((pivot, score))
            else:
                for x in lists[: k + 1]:
                    while x[2] < len(x[0]) and x[0][x[2]] < pivot:
                        x[2] += 1
            lists = [x for x in lists if x[2] < len(x[0])]
        return hits

    def _narrowed(self, term: np.ndarray, start: np.ndarray, ends: np.ndarray, a: int, at: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
        """Of the blocks that pass, the smaller ones inside that pass as well, by the same bound."""
        if not len(at):
            return []
        at = at + a
        sizes = ends[at] - start[at]
        rows = np.repeat(start[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        small = block[:, None] * PARTS + np.arange(PARTS)
        bound = np.add.reduceat(self.small_max[term[rows][:, None], np.repeat(small, sizes, axis=0)], np.cumsum(sizes) - sizes)
        w, part = np.nonzero(bound >= self.small_floor[small])
        return list(zip(at[w].tolist(), small[w, part].tolist()))

    def passages(self, column: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, bm25, overlap, answer overlap) of verified hits; the best passage of each row and item."""
        data, edges = text_buffer(column)
        step, n_terms = self.longest, len(self.terms)
        for first, last in row_blocks(edges):
            words = Words(data[edges[first] : edges[last]], edges[first : last + 1] - edges[first], lower=True)
            slot = np.minimum(np.searchsorted(self.terms, words.hash), n_terms - 1)
            known = np.flatnonzero(self.terms[slot] == words.hash)
            if not len(known):
                continue
            sizes = np.diff(words.first)
            n_windows = np.maximum(1, -(-sizes // step))
            base = np.concatenate([[0], np.cumsum(n_windows)])
            row = words.row[known]
            k = (known - words.first[row]) // step
            here = (base[row] + k) * n_terms + slot[known]
            pairs = np.unique(np.concatenate([here, here[k > 0] - n_terms]))
            window, term = pairs // n_terms, pairs % n_terms
            start = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
            ends = np.append(start[1:], len(window))
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for a in range(0, len(start), 4096):
                b = min(a + 4096, len(start))
                bound = np.add.reduceat(self.block_max[term[start[a] : ends[b - 1]]], start[a:b] - start[a])
                for at, block in self._narrowed(term, start, ends, a, *np.nonzero(bound >= self.block_floor)):
                    for item, score in self.search(term[start[at] : ends[at]], block):
                        r = int(np.searchsorted(base, window[start[at]], "right")) - 1
                        begin = words.first[r] + (window[start[at]] - base[r]) * step
                        stop = min(begin + 2 * step, words.first[r + 1])
                        held = shingles(words.hash[begin:stop])
                        if self.words[item] < SHINGLE:  # the item is one run of its own length
                            held = short_runs(words.hash[begin:stop], self.words[item])
                        share, answer = (float(np.isin(x, held).mean()) for x in (self.shingles[item], self.answers[item]))
                        if share >= OVERLAP and answer >= ANSWER_OVERLAP:
                            best[r, item] = max(best.get((r, item), (0.0, 0.0, 0.0)), (share, answer, score))
            for (r, item), (share, answer, score) in sorted(best.items()):
                yield first + r, self.item[item], score, share, answer
        release_memory()


def index_segments(benchmark: DataFrame, item: str = "item_id", text: str = "text", words: int = SEGMENT_WORDS) -> Iterator[BenchmarkIndex]:
    """Indexes of bounded size that together hold every item."""
    need_columns(benchmark, item, text)
    rows = benchmark.where(F.col(text).isNotNull()).select(item, text)
    total = rows.agg(F.sum(F.size(F.split(text, r"[\x20\x09-\x0D]+")))).first()[0] or 0
    n = max(1, -(-total // words))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == k) if n > 1 else rows
        index = BenchmarkIndex.build(sorted((r[0], r[1]) for r in part.collect()))
        if index is not None:
            yield index


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, bm25, overlap, answer_overlap) for every document and item whose overlap is verified."""
    need_columns(docs, key, text)
    schema = T.StructType([
        docs.schema[key], T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("bm25", T.DoubleType()),
        T.StructField("overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()),
    ])

    def searcher(index: BenchmarkIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(index.passages(batch.column(text)))
                cols = [batch.column(key).take(pa.array([h[0] for h in hits], pa.int64())), *(pa.array([h[i] for h in hits], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64())))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        return run

    found = None
    for index in index_segments(benchmark):
        part = docs.select(key, text).mapInArrow(searcher(index), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those that leak an item; every column stays. Texts go through the search beside their row, no join."""
    need_columns(docs, text)
    names, kept = docs.columns, docs

    def sieve(index: BenchmarkIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaks = {h[0] for h in index.passages(batch.column(names.index(text)))}
                yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in leaks], pa.int64())) if leaks else batch

        return run

    for index in index_segments(benchmark):
        kept = kept.mapInArrow(sieve(index), docs.schema)
    return kept
