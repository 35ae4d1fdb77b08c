"""SimHash near-duplicates by BK-trees: nodes keyed by whole Hamming distance to their parent, one tree per shard.

Two fingerprints that differ in at most RADIUS of 64 bits agree in at least ``blocks - RADIUS`` of ``blocks`` bit blocks. Each
choice of that many blocks, with the bits found there, names a shard; a fingerprint is in one shard per choice, so linked ones
meet in at least one shard. A shard's fingerprints make a BK-tree, a large shard's several of bounded size. The trees are sent to
the query blocks of their shard (broadcast to all executors when their counted nodes are few enough), and a query follows only
edges whose distance is within the radius of its own. Equal fingerprints are one node. From each search only links that join
something new are passed on, so a group of copies costs as many links as it has members, never their pairs.

``blocks`` grows with the number of distinct fingerprints, so that shards of unrelated ones stay small; it decides the work
alone, not the rows.

Defined results: NULL, empty and blank texts have fingerprint zero and are linked like any other; texts with fewer words than a
shingle are one shingle; repeated rows and equal texts fall together; the component of a row is the least key of its component
(NULL keys are passed over, and NULL where no row of it has a key); an empty table gives an empty one. The result has its own
columns only, whatever other columns the input has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from foldcast.llm.components import components
from foldcast.llm.shared import keyed, need_columns, stored
from foldcast.llm.words import release_memory

SHINGLE, SEED, RADIUS = 4, 42, 4
NODES = 2048  # nodes of one tree
SHARD_FILL = 64  # unrelated fingerprints expected in a shard
BROADCAST_NODES = 1_000_000  # nodes of broadcast trees: 13 bytes each
FRONTIER = 1 << 17  # query and node pairs that a search holds at a time


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each set where it is set in more than half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.append(0, end[:-1] + 1)
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp) of every row, the 64 bits as a signed number."""
    need_columns(docs, key, text)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["key", "fp"])
        release_memory()

    return docs.select(key, text).mapInArrow(run, f"key {kind.simpleString()}, fp long").withColumnRenamed("key", key)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class BKTree:
    """Nodes in the order they were placed; ``parent`` and ``edge`` (the distance to it) say where each hangs."""

    def __init__(self, node: np.ndarray, parent: np.ndarray, edge: np.ndarray) -> None:
        self.node, self.parent, self.edge = node, parent, edge
        self.child = np.full((len(node), 65), -1, dtype=np.int32)
        self.child[parent[1:], edge[1:]] = np.arange(1, len(node))

    @classmethod
    def build(cls, values: np.ndarray) -> BKTree:
        """All values go down together, a level at a time: of those at one parent and distance the first becomes the child."""
        left = np.unique(values)[::-1]
        nodes, parents, edges = [left[:1]], [np.array([-1])], [np.array([0])]
        left, above, count = left[1:], np.zeros(max(0, len(left) - 1), dtype=np.int64), 1
        top = nodes[0]
        first = 0
        while len(left):
            d = distance(left, top[above - first])
            _, at, group = np.unique(above * 65 + d, return_index=True, return_inverse=True)
            nodes.append(left[at]), parents.append(above[at]), edges.append(d[at])
            rest = np.ones(len(left), dtype=bool)
            rest[at] = False
            top, first = left[at], count
            count += len(at)
            left, above = left[rest], first + group[rest]
        return cls(np.concatenate(nodes), np.concatenate(parents), np.concatenate(edges))

    def search(self, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, node numbers) within the radius. From a node at distance d only edges d - radius to d + radius are followed."""
        waiting = [(np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64))]
        span = np.arange(-radius, radius + 1)
        while waiting:
            query, node = waiting.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                waiting += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = distance(queries[query], self.node[node])
            near = d <= radius
            if near.any():
                yield query[near], node[near]
            edge = d[:, None] + span[None, :]
            below = np.where((edge >= 0) & (edge <= 64), self.child[node[:, None], np.clip(edge, 0, 64)], -1)
            row, column = np.nonzero(below >= 0)
            if len(row):
                waiting.append((query[row], below[row, column].astype(np.int64)))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least number that each of 0..n-1 reaches over the pairs, by rounds of least labels and label jumps."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            for x in (a, b):
                np.minimum.at(label, label[x], low)
                np.minimum.at(label, x, low)
            while (label != label[label]).any():
                label = label[label]
    while (label != label[label]).any():
        label = label[label]
    return label


def blocks_for(n: int, radius: int = RADIUS, fill: int = SHARD_FILL) -> int:
    """The fewest bit blocks with which a shard is expected to hold at most ``fill`` of n unrelated fingerprints."""
    blocks = radius + 1
    while blocks < 2 * radius and n >> (64 * (blocks - radius) // blocks) > fill:
        blocks += 1
    return blocks


def shard_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bits of each choice of blocks that must agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    of_block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(of_block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _trees(shards: DataFrame) -> DataFrame:
    """(shard, part, node, parent, edge) of each part of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [BKTree.build(x.values.to_numpy().view(np.uint64)) for x in batch.column("fps")]
            columns = [pa.array([getattr(t, c) for t in trees], pa.list_(kind)) for c, kind in (("parent", pa.int32()), ("edge", pa.int8()))]
            nodes = pa.array([t.node.view(np.int64) for t in trees], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("part"), nodes, *columns], names=["shard", "part", "node", "parent", "edge"])

    return shards.mapInArrow(run, "shard long, part long, node array<long>, parent array<int>, edge array<byte>")


def _searches(pairs: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that span what each pair of tree and query block holds together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for node, parent, edge, fps in zip(*(batch.column(c) for c in ("node", "parent", "edge", "fps"))):
                tree = BKTree(node.values.to_numpy().view(np.uint64), parent.values.to_numpy(), edge.values.to_numpy())
                queries = fps.values.to_numpy().view(np.uint64)
                every = np.concatenate([tree.node, queries]).view(np.int64)
                label = spanning(len(every), ((n, q + len(tree.node)) for q, n in tree.search(queries, radius)))
                joined = every != every[label]
                left.append(every[joined])
                right.append(every[label][joined])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (left, right)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def fingerprint_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: as many of their links as connect all that are linked."""
    blocks = blocks_for(classes.count(), radius)
    masks = [(i, _signed(m)) for i, m in enumerate(shard_masks(blocks, radius))]
    shard = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in masks])
    members = classes.select("fp", F.explode(shard).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sizes = stored(sizes.select("shard", F.ceil(F.col("m") / (NODES // 2)).alias("parts")), "simhash-shards")
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    # A part holds about half of NODES at most, as its fingerprints are distinct and dealt out by their hash.
    shards = stored(keyed(members, sizes, "shard", "inner").groupBy("shard", part.alias("part")).agg(F.collect_list("fp").alias("fps")), "simhash-members")
    trees = stored(_trees(shards), "simhash-trees")
    nodes = trees.agg(F.sum(F.size("node"))).first()[0] or 0
    trees = F.broadcast(trees) if nodes <= BROADCAST_NODES else trees.hint("merge")
    asked = shards.withColumnRenamed("part", "asks")
    return _searches(trees.join(asked, "shard").where("part <= asks").select("node", "parent", "edge", "fps"), radius)


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id): one row per row of ``docs``."""
    rows = stored(fingerprints(docs, key, text), "simhash-rows")
    classes = stored(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    labels = components(stored(fingerprint_links(classes.select("fp"), radius), "simhash-links"))
    of_class = classes.join(labels, F.col("fp") == F.col("v"), "left").select("fp", "least", "n", "label")
    lowest = of_class.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("lowest"))
    # Only rows that share their fingerprint or are linked take a component from elsewhere.
    shared = stored(of_class.join(lowest, "label", "left").where("n > 1 OR label IS NOT NULL").select("fp", F.coalesce("lowest", "least").alias("component")), "simhash-components")
    return keyed(rows, shared, "fp", "left").select(key, hex_digits(F.col("fp")).alias("fingerprint"), F.coalesce("component", key).alias("component_id"))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
