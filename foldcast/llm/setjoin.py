"""N-gram Jaccard join over a token-group matrix.

Texts with equal shingle sets are one class. Each class has a prefix: its shingles in one order for all, rare ones first (by a
count sketch of fixed size), as long as needed for two linked classes to share at least one. Classes that share any prefix token
are partitioned into groups of similar texts (minhash bands), large groups into blocks. A block is joined within one task. Across
blocks the matrix of prefix tokens and blocks bounds how much of a query class a block can hold; only blocks whose bound allows a
link are opened, and only for classes that are not yet connected to them. All links are exact; the order, groups and blocks only
decide how much work is done.

Defined results: NULL, empty and blank texts have no shingles and stand alone; repeated rows and equal texts fall together; the
component of a row is the least key of its component (NULL keys are passed over).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldcast.llm.components import components
from foldcast.llm.shared import BROADCAST_KEYS, free_name, keyed, measured, need_columns, stored
from foldcast.llm.words import as_long, batch_words, mix

SHINGLE = 5
CELL_BITS, CELL_BLOCK = 22, 1 << 18  # the count sketch: 4 M cells in 16 blocks, whatever the corpus
BANDS, BLOCK, PREFIX_ROWS, REPRESENTATIVES = 6, 1024, 500_000, 8
BLOCK_TOKENS = 400_000  # shingles of all classes of a block together, so that a block of long texts is no larger than one of short ones
_SALT = mix(np.arange(1, 2 * BANDS + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row that has words."""
    for first, _, words in batch_words(column):
        h, _, row = words.windows(SHINGLE)
        edge = np.searchsorted(row, np.arange(len(words.first)))
        for i in range(len(words.first) - 1):
            own = words.hash[words.first[i] : words.first[i + 1]]
            if len(own) >= SHINGLE:
                yield first + i, np.unique(h[edge[i] : edge[i + 1]])
            elif len(own):
                whole = (own * _SALT[: len(own)]).sum(keepdims=True) + np.uint64(len(own))
                yield first + i, mix(whole)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    return int(as_long(np.array([mix(tokens ^ _SALT[-1]).sum()], dtype=np.uint64))[0]), int(as_long(np.array([mix(tokens ^ _SALT[-2]).sum()], dtype=np.uint64))[0])


def _band_keys(tokens: np.ndarray) -> list[int]:
    low = np.array([mix(tokens ^ s).min() for s in _SALT[: 2 * BANDS]], dtype=np.uint64)
    return as_long(mix(mix(low[0::2] + np.arange(BANDS, dtype=np.uint64)) + low[1::2])).tolist()


def _sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per document with its set's size and fingerprint, and rows of each task's share of the count sketch."""
    kind = docs.schema[key].dataType
    names = ["key", "n", "f1", "f2", "bands", "cell_block", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, any_row = np.zeros(1 << CELL_BITS, dtype=np.uint32), False
        for batch in batches:
            size = batch.num_rows
            n, f1, f2 = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
            held, pending, bands = [], 0, [None] * size
            for row, tokens in shingle_sets(batch.column(text)):
                n[row] = len(tokens)
                bands[row] = _band_keys(tokens)
                f1[row], f2[row] = fingerprint(tokens)
                held.append(tokens)
                pending += len(tokens)
                if pending > 200_000:
                    np.add.at(cells, (np.concatenate(held) >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.uint32(1))
                    held, pending = [], 0
            if held:
                np.add.at(cells, (np.concatenate(held) >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.uint32(1))
            any_row = any_row or size > 0
            key_column = batch.column(key)
            yield pa.RecordBatch.from_arrays([key_column, pa.array(n), pa.array(f1), pa.array(f2), pa.array(bands, pa.list_(pa.int64())), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=names)
        if any_row:
            low = np.minimum(cells, 255).astype(np.uint8).reshape(-1, CELL_BLOCK)
            k = len(low)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, key_column.type), *(pa.nulls(k, pa.int64()) for _ in range(3)), pa.nulls(k, pa.list_(pa.int64())), pa.array(range(k), pa.int32()), pa.array([x.tobytes() for x in low], pa.binary())], names=names)

    return docs.select(key, text).mapInArrow(run, f"key {kind.simpleString()}, n long, f1 long, f2 long, bands array<long>, cell_block int, cells binary")


def _frequency_classes(sketches: DataFrame) -> np.ndarray:
    """One byte per cell of the summed sketch, by which prefix tokens are ordered; 4 MB in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column("cell_block").to_pylist(), batch.column("cells")):
                sums.setdefault(block, np.zeros(CELL_BLOCK, dtype=np.int64))
                sums[block] += np.frombuffer(cells.as_buffer(), dtype=np.uint8)
        classes = [np.minimum(255, 8 * np.log2(1.0 + s)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary())], names=["cell_block", "cells"])

    parts = sketches.where("cell_block IS NOT NULL").select("cell_block", "cells").repartition("cell_block").mapInArrow(run, "cell_block int, cells binary")
    out = np.zeros((1 << CELL_BITS) // CELL_BLOCK * CELL_BLOCK, dtype=np.uint8).reshape(-1, CELL_BLOCK)
    for r in parts.collect():
        out[r["cell_block"]] = np.frombuffer(r["cells"], dtype=np.uint8)
    return out.ravel()


def _texts_of(docs: DataFrame, wanted: DataFrame, n_wanted: int, key: str, text: str) -> DataFrame:
    """Texts with the columns of ``wanted`` (key, f1, cid, ...): broadcast when its rows are few enough, else shuffled by key."""
    small = n_wanted <= BROADCAST_KEYS
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.join(F.broadcast(wanted) if small else wanted.hint("merge"), F.col("_key").eqNullSafe(F.col("key"))).select("_text", *(c for c in wanted.columns if c != "key"))


def prefix_size(n: int | np.ndarray):
    return n - (3 * n + 3) // 4 + 1


def _prefixes(rows: DataFrame, classes) -> DataFrame:
    """(token, cid, n) of every class's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = classes.value
        for batch in batches:
            f1, cid = batch.column("f1").to_numpy(), batch.column("cid").to_numpy()
            out, owner, sizes = [], [], []
            for row, tokens in shingle_sets(batch.column("_text")):
                if fingerprint(tokens)[0] != f1[row]:
                    continue
                size = prefix_size(len(tokens))
                sizes.append(np.full(size, len(tokens), dtype=np.int32))
                rank = weight[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                own = tokens[np.lexsort((tokens, rank))[:size]]
                out.append(as_long(own))
                owner.append(np.full(size, cid[row]))
            if out:
                columns = [np.concatenate(x) for x in (out, owner, sizes)]
                for i in range(0, len(columns[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=["token", "cid", "n"])

    return rows.mapInArrow(run, "token long, cid long, n int")


def _shared_tokens(prefixes: DataFrame, partitions: int) -> DataFrame:
    """(token, cid, n, low, high) of prefix tokens that another class of a size that may link also has in its prefix.

    ``low`` and ``high`` are the least and greatest such sizes. Most tokens stop here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(b.column(c).to_numpy() for c in ("token", "cid", "n")) for b in batches]
        if not held:
            return
        token, cid, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        held.clear()
        order = np.lexsort((cid, n, token))
        token, cid, n = token[order], cid[order], n[order].astype(np.int64)
        new = np.append(True, (token[1:] != token[:-1]) | (cid[1:] != cid[:-1]))
        token, cid, n = token[new], cid[new], n[new]
        many = np.append(token[1:] == token[:-1], False)
        many[1:] |= many[:-1].copy()
        token, cid, n = token[many], cid[many], n[many]
        # Rows stand by token and size, so partners of a size that may link are a range around each row.
        where = np.cumsum(np.append(0, token[1:] != token[:-1])) if len(token) else token
        wide = 1 << 32
        line = where * wide + n
        first = np.searchsorted(line, where * wide + -(-3 * n // 4), "left")
        last = np.searchsorted(line, where * wide + 4 * n // 3, "right") - 1
        at = np.arange(len(n))
        low, high = n[np.minimum(first + (first == at), max(len(n) - 1, 0))], n[last - (last == at)] if len(n) else n
        met = last > first
        columns = [x[met] for x in (token, cid, n, low, high)]
        for i in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=["token", "cid", "n", "low", "high"])

    return prefixes.repartition(partitions, "token").mapInArrow(run, "token long, cid long, n long, low long, high long")


def _sets(rows: DataFrame) -> DataFrame:
    """(cid, block, alone, tokens) of the wanted classes; rows repeat where documents do, which no later step minds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f1 = batch.column("f1").to_numpy()
            rows_kept, sets = [], []
            for row, tokens in shingle_sets(batch.column("_text")):
                if fingerprint(tokens)[0] == f1[row]:
                    rows_kept.append(row), sets.append(as_long(tokens))
            kept = pa.array(rows_kept, pa.int64())
            edges = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(kept) for c in ("cid", "block", "alone")), pa.ListArray.from_arrays(pa.array(edges), pa.array(values))], names=["cid", "block", "alone", "tokens"]
            )

    return rows.mapInArrow(run, "cid long, block long, alone boolean, tokens array<long>")


def overlaps(sets: list[np.ndarray], n_left: int) -> np.ndarray:
    """Shared tokens of each of the first ``n_left`` sets with each of the rest (or of all with all, for 0)."""
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(column)[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1] if often.any() else column[often]
    left = slice(0, n_left) if n_left else slice(None)
    right = slice(n_left, None)
    total = np.zeros((len(range(len(sets))[left]), len(range(len(sets))[right])), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [a, a + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[row[i:j], column[i:j] - a] = 1
        total += block[left] @ block[right].T
    return total


def linked(shared: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Jaccard similarity of three quarters or more, in whole numbers."""
    shared = shared.astype(np.int64)
    return (100 * shared >= 75 * (n_left[:, None] + n_right[None, :] - shared)) & (shared > 0)


def _token_lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _join_block(table: pa.Table) -> pa.Table:
    """Edges from each class of a block to the least class of its local component."""
    cid = table.column("cid").to_numpy()
    sets = _token_lists(table.column("tokens"))
    n = np.array([len(s) for s in sets])
    link = linked(overlaps(sets, 0), n, n)
    label = np.full(len(cid), -1)
    for seed in np.argsort(cid):
        if label[seed] < 0:
            front = np.zeros(len(cid), dtype=bool)
            front[seed] = True
            while front.any():
                label[front] = seed
                front = link[front].any(axis=0) & (label < 0)
    return pa.table({"cid": pa.array(cid), "label": pa.array(cid[label])})


def _join_opened(table: pa.Table) -> pa.Table:
    """Links between query classes and the members of one opened block."""
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    order = np.argsort(~asks, kind="stable")
    cid, sets = table.column("cid").to_numpy()[order], _token_lists(table.column("tokens"))
    sets = [sets[i] for i in order]
    k = int(asks.sum())
    if k == 0 or k == len(cid):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    n = np.array([len(s) for s in sets])
    left, right = np.nonzero(linked(overlaps(sets, k), n[:k], n[k:]))
    return pa.table({"a": pa.array(cid[left]), "b": pa.array(cid[k + right])})


def _least_common(nx: Column, ny: Column) -> Column:
    """The least number of prefix tokens that a class of nx tokens shares with a linked one of ny; rounded down with two to spare."""
    return F.ceil(3 * (nx + ny) / 7) - (F.ceil(0.75 * F.greatest(nx, ny)) - 1) - 2


def _need(n: str, low: str, high: str) -> Column:
    """The least count of shared prefix tokens over partner sizes from low to high, cut to sizes that may link; it is least at an end."""
    n, low, high = F.col(n), F.greatest(F.col(low), F.ceil(0.75 * F.col(n))), F.least(F.col(high), F.floor(4 * F.col(n) / 3))
    return F.when(low > high, F.lit(2**31)).otherwise(F.greatest(F.lit(1), F.least(_least_common(n, low), _least_common(n, high))))


def _parts(n: str) -> Column:
    """Into how many parts the classes of a group go, by their number and by all their shingles."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)), F.ceil(F.sum(n) / (2 * BLOCK_TOKENS)))


def _narrow_join(df: DataFrame, narrow: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """Join by cid with a stored table of narrow rows: broadcast when they are few enough, else shuffled."""
    return df.join(F.broadcast(narrow) if rows <= BROADCAST_KEYS else narrow.hint("merge"), "cid", how)


def _grouped(classes: DataFrame) -> DataFrame:
    """(cid, n, block): similar classes in one group, by two rounds of least labels over minhash bands; large groups cut by hash."""
    bands = stored(classes.select("cid", F.explode("bands").alias("band")), "join-bands")
    labelled = bands.withColumn("label", F.col("cid"))
    for _ in range(2):
        low = labelled.groupBy("band").agg(F.min("label").alias("label"))
        labels = bands.join(low, "band").groupBy("cid").agg(F.min("label").alias("label"))
        labelled = bands.join(labels, "cid")
    labels = stored(labels, "join-groups")
    sized = classes.select("cid", "n").join(labels, "cid")
    sizes = sized.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    part = F.pmod(F.xxhash64("cid"), parts)
    return sized.join(sizes, "label").select("cid", "n", F.col("label").alias("grp"), parts.alias("parts"), F.xxhash64("label", part).alias("block"))


def link_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): one row per row of ``docs``."""
    need_columns(docs, key, text)
    spark = docs.sparkSession
    sketches = stored(_sketches(docs, key, text).withColumn("rid", F.monotonically_increasing_id()), "join-sketches")
    rows = sketches.where("cell_block IS NULL").select("key", "n", "f1", "f2", "rid", "bands")
    classes, seen = measured(
        rows.where("n > 0").groupBy("n", "f1", "f2").agg(
            F.min("rid").alias("cid"), F.min_by("key", "rid").alias("rep"), F.min("key").alias("least"), F.min_by("bands", "rid").alias("bands")
        ),
        "join-classes", tokens=F.sum(F.col("n") - F.ceil(0.75 * F.col("n")) + 1),
    )
    weights = spark.sparkContext.broadcast(_frequency_classes(sketches))
    wanted = classes.select(F.col("rep").alias("key"), "f1", "cid")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(seen["tokens"] or 0) // PREFIX_ROWS))
    shared = stored(_shared_tokens(_prefixes(_texts_of(docs, wanted, seen["rows"], key, text), weights), partitions), "join-shared")
    weights.destroy()

    # Classes that share enough prefix tokens with others of a size that may link; the rest have no link.
    reach = shared.groupBy("cid").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    active, seen = measured(reach.where(F.col("c") >= _need("n", "low", "high")).select("cid"), "join-active")
    shared = stored(_narrow_join(shared.select("token", "cid"), active, seen["rows"], "left_semi"), "join-active-tokens")
    placed = stored(_grouped(_narrow_join(classes.select("cid", "n", "bands"), active, seen["rows"], "left_semi")), "join-placed")
    filled = placed.groupBy("block").agg((F.count(F.lit(1)) == 1).alias("alone"))
    chosen, seen = measured(wanted.join(placed.select("cid", "block"), "cid").join(filled, "block").select("key", "f1", "cid", "block", "alone"), "join-chosen")
    sets = stored(_sets(_texts_of(docs, chosen, seen["rows"], key, text)), "join-sets")

    # Inside blocks.
    schema = "cid long, label long"
    local = stored(sets.where("NOT alone").groupBy("block").applyInArrow(lambda t: _join_block(t), schema).distinct(), "join-local")
    # A few of each local component of groups with several blocks meet once more, so that a large group of copies is one.
    info = placed.join(local, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    some = F.slice(F.array_sort(F.collect_set(F.struct("cid", "n"))), 1, REPRESENTATIVES)
    few = info.where(F.col("parts") > 1).groupBy("grp", "block", "label").agg(some.alias("some")).select("grp", "label", F.inline("some"))
    fit = few.groupBy("grp").agg(_parts("n").alias("parts"))
    few, seen = measured(few.join(fit, "grp").select("cid", "label", F.xxhash64("grp", F.pmod(F.xxhash64("label"), F.col("parts"))).alias("block")), "join-few")
    met = stored(_narrow_join(sets.select("cid", "tokens"), few.select("cid", "block"), seen["rows"]).groupBy("block").applyInArrow(lambda t: _join_block(t), schema).distinct(), "join-met")
    merged = few.join(met.withColumnRenamed("label", "met"), "cid").groupBy("label").agg(F.min("met").alias("met"))
    known = info.join(merged, "label", "left").select("cid", "n", "block", F.coalesce("met", "label").alias("comp"))
    heavy = known.groupBy("comp").agg(F.count(F.lit(1)).alias("weight"))
    known, seen = measured(known.join(heavy, "comp").select("cid", "n", "block", F.struct("weight", "comp").alias("comp")), "join-known")

    # Across blocks: the token-group matrix of tokens that unconnected classes share.
    cells = _narrow_join(shared, known, seen["rows"])
    apart = cells.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("block").alias("one"), F.max("block").alias("other"))
    apart = stored(apart.where("low != high AND one != other").select("token"), "join-apart")
    cells = stored(cells.join(apart, "token", "left_semi"), "join-cells")
    matrix = cells.groupBy("token", "block").agg(F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max("comp").alias("heaviest"))
    q, g = cells.alias("q"), matrix.alias("g")
    # Of two unconnected classes the one in the lighter component asks the block of the other.
    asking = (F.col("q.block") != F.col("g.block")) & (F.col("q.comp") < F.col("g.heaviest"))
    sized = (4 * F.col("g.n_high") >= 3 * F.col("q.n")) & (3 * F.col("g.n_low") <= 4 * F.col("q.n"))
    bound = q.join(g, (F.col("q.token") == F.col("g.token")) & asking & sized).groupBy(F.col("q.cid").alias("cid"), F.col("g.block").alias("block")).agg(
        F.count(F.lit(1)).alias("c"), F.first("q.n").alias("n"), F.min("g.n_low").alias("low"), F.max("g.n_high").alias("high")
    )
    opened = stored(bound.where(F.col("c") >= _need("n", "low", "high")).select("cid", "block", "n"), "join-opened")
    load = opened.groupBy("block").agg(_parts("n").alias("parts"))
    asks = opened.join(load, "block").select("cid", "block", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"), F.lit(True).alias("asks"))
    members = known.join(load, "block").select("cid", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"))
    meeting, seen = measured(asks.unionByName(members), "join-meet")
    meet = _narrow_join(sets.select("cid", "tokens"), meeting, seen["rows"])
    crossed = meet.groupBy("block", "part").applyInArrow(lambda t: _join_opened(t), "a long, b long")

    edges = crossed.unionByName(local.select(F.col("cid").alias("a"), F.col("label").alias("b"))).unionByName(met.select(F.col("cid").alias("a"), F.col("label").alias("b")))
    labels = components(edges)
    final = classes.join(labels, F.col("cid") == F.col("v"), "left").select("n", "f1", "f2", "least", F.coalesce("label", "cid").alias("label"))
    lowest = final.groupBy("label").agg(F.min("least").alias("component"))
    of_class = final.join(lowest, "label").select("n", "f1", "f2", "component")
    return rows.drop("bands").join(of_class, ["n", "f1", "f2"], "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` stored with a number of each row, and the name of that column, which is none of theirs."""
    rid = free_name("_rid", docs.columns)
    return stored(docs.withColumn(rid, F.monotonically_increasing_id()), "join-rows"), rid


def with_groups(docs: DataFrame, text: str = "text", group: str = "_group") -> DataFrame:
    """``docs`` with the component of each row in ``group``, which replaces a column of that name; NULL for rows without words."""
    need_columns(docs, text)
    rows, rid = numbered(docs.drop(group))
    label = F.when(F.col("n_shingles") > 0, F.col("component_id")).alias(group)
    groups, seen = measured(link_components(rows, rid, text).select(rid, label), "join-groups-of-rows")
    return keyed(rows, groups, rid, "left", rows=seen["rows"]).drop(rid)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the first of those with the least key, NULL last; rows without words stay."""
    need_columns(docs, key, text)
    rows, rid = numbered(docs)
    joined = stored(link_components(rows, rid, text).select(rid, "component_id"), "join-rows-of")
    least = F.min(F.struct(F.col("k").isNull(), F.col("k").alias("_key"), F.col("r"))).alias("_first")
    kept = rows.select(F.col(rid).alias("r"), F.col(key).alias("k")).join(joined.select(F.col(rid).alias("r"), F.col("component_id").alias("c")), "r").groupBy("c").agg(least).select(F.col("_first.r").alias(rid))
    kept, seen = measured(kept, "join-kept")
    return keyed(rows, kept, rid, rows=seen["rows"]).select(*docs.columns)
