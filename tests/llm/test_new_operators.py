"""Resampling, periodic runs and SimHash copies against plain versions, and on nulls, empties, long texts, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foldcast.llm import queries, resample, runs, simhash

SCHEMA = "doc_id long, text string, _row long, rank long, component_id long, runs string, _rid int"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 5, 6, 7, "r", 8) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


# ---- resampling


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(rows, target):
    found = [features(t) for _, t in rows]
    s, t = collections.Counter(), collections.Counter()
    for _, f in found:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in s}
    out, order = [], []
    for i, ((key, _), (words, f)) in enumerate(zip(rows, found)):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(f), weight, score, None])
        if words >= 20:
            order.append((-score, key is None, key or 0, i))
    for r, (*_, i) in enumerate(sorted(order)[: 5 * len(order) // 100], 1):
        out[i][4] = r
    return sorted(map(tuple, out), key=str)


def prose(rng, n):
    return " ".join(rng.choice(["Ab", "été", "x9", "naïve", "zz", "q" * 70, "lo-mi", "日本", "K\x00L"]) + str(rng.randint(0, 30)) for _ in range(n))


def resampled(docs, target):
    return sorted((tuple(r) for r in resample.draw(resample.weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_equals_a_plain_version(spark):
    rng = random.Random(3)
    texts = [None, "", " .,;! ", "a" * 5000, prose(rng, 20000), *(prose(rng, rng.randint(0, 60)) for _ in range(300))]
    ids = [*range(290), *range(280, 294), None]
    target = [prose(rng, 30) for _ in range(5)] + [None, ""]
    docs, goal = frame(spark, texts, ids).repartition(5), spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    assert resampled(docs, goal) == plain_resample(list(zip(ids, texts)), target)
    drawn = resample.resample(docs, goal)
    assert drawn.columns == docs.columns
    want = sorted(r[0] for r in plain_resample(list(zip(ids, texts)), target) if r[4])
    assert sorted(r.doc_id for r in drawn.collect()) == want and len(want) > 5


def test_resampling_of_ties_repeats_and_empty_tables(spark):
    """Rows that repeat one key and text tie to the end: as many as fit are drawn, with ranks of their own."""
    texts, ids = ["word " * 30] * 60, [4] * 50 + [None] * 10
    docs, goal = frame(spark, texts, ids), frame(spark, ["word other"])
    got = resample.draw(resample.weigh(docs, goal)).collect()
    assert len(got) == 60 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert resample.draw(resample.weigh(docs.limit(0), goal)).count() == 0
    few = resample.draw(resample.weigh(docs.limit(3), goal.limit(0)))
    assert [r["rank"] for r in few.collect()] == [None] * 3
    with pytest.raises(ValueError):
        resample.weigh(docs.withColumn("doc_id", F.lit("k")), goal)


def test_cutoff_by_bisection(spark):
    rng = random.Random(1)
    rows = [(rng.randint(-40, 40), rng.randint(0, 5), i) for i in range(400)]
    table = spark.createDataFrame(rows, "score long, _order long, _row long")
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for n in (1, 2, 7, 200, 399, 400):
        end = resample.find_cutoff(table, n)
        assert (end.score, end.key, end.row) == order[n - 1]
        assert table.where(end.reached()).count() == n
    assert resample.find_cutoff(table, 0) is None


# ---- periodic runs


def plain_runs(w, min_length=24, times=3):
    least = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, times * q):
                least.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in least.items())


def sequences(rng, n):
    out = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.5:
            period = [rng.randint(0, 3) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 30]))]
            out += (period * 40)[: rng.randint(len(period), 5 * len(period) + 30)]
        else:
            out += [rng.randint(0, rng.choice([1, 3, 100])) for _ in range(rng.randint(1, 30))]
    return out[:n]


@pytest.mark.parametrize("portion", [1 << 15, 17, 100])
def test_runs_equal_a_plain_search(monkeypatch, portion):
    monkeypatch.setattr(runs, "PORTION", portion)
    rng = random.Random(portion)
    met = 0
    for k in range(150):
        w = [b"w%d" % x for x in sequences(rng, rng.randint(0, 400))]
        want = plain_runs(w)
        assert runs.runs_of(w) == want
        assert runs.runs_of(w, 6, 2) == plain_runs(w, 6, 2)
        met += len(want)
    assert met > 100
    same = [b"a"] * 3000 + [b"b"] + [b"a", b"c"] * 700
    assert runs.runs_of(same) == plain_runs(same)


def test_long_periods_and_long_texts():
    rng = random.Random(6)
    period = [b"%d" % rng.randint(0, 10**9) for _ in range(40_000)]
    head = [b"h%d" % i for i in range(123)]
    assert runs.runs_of(head + period * 3 + [b"end"]) == [(123, 120_000, 40_000)]
    assert runs.runs_of(head + period * 2 + period[:-1] + [b"end"]) == []
    assert runs.runs_of([b"a"] * 200_000) == [(0, 200_000, 1)]


def tail(words, key):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_run_query_on_a_fixture(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", " \t\n ", "a\x1cb  c", "é" * 9000, *(" ".join(f"w{x}" for x in sequences(rng, rng.randint(0, 300))) for _ in range(120))]
    ids = list(range(len(texts)))
    docs = frame(spark, texts + texts[5:8] + ["a " * 30], [*ids, *ids[5:8], None])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.defaultdict(set)
    for r in queries.op12(spark, str(tmp_path)).collect():
        got[r.doc_id].add(tuple(r)[1:])
    assert len(got[None]) == 1 and len(got) == len(texts) + 1
    changed = 0
    for i, t in enumerate(texts):
        own = (t or "").encode().split()
        w = tail(own, i)
        changed += w != own
        want = plain_runs(w)
        best = max(want, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        gone = {j for s, n, q in want for j in range(s + q, s + n)}
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        kept = hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()
        assert got[i] == {(len(want), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest, kept)}, i
    assert changed > 3
    assert runs.find_runs(docs.limit(0)).count() == 0


# ---- SimHash copies


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def test_fingerprints_and_components_of_texts(spark):
    rng = random.Random(9)
    own = [" ".join(rng.choices([f"Word{i}" for i in range(400)], k=rng.randint(1, 300))) for _ in range(60)]
    near = [t + " tail" for t in own[:30]]
    texts = [None, "", " \n", "one", "ONE", "x" * 9000, " ".join(f"v{i}" for i in range(70_000)), *own, *own[:5], *near]
    prints = [plain_fingerprint(t) for t in texts]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in simhash.near_copies(docs).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(prints)
    assert simhash.near_copies(docs.limit(0)).count() == 0
    again = simhash.near_copies(docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(again) == 2 * len(texts) and all(r.component_id is not None for r in again)
    alone = simhash.near_copies(frame(spark, ["a b c d e f"], [None])).first()
    assert alone.component_id is None


@pytest.mark.parametrize("nodes,broadcast,fill", [(2048, 1_000_000, 64), (8, 0, 0)])
def test_links_of_close_fingerprints(spark, monkeypatch, nodes, broadcast, fill):
    """Chains, dense groups and lone values, with one tree a shard and with many, sent and joined."""
    monkeypatch.setattr(simhash, "NODES", nodes)
    monkeypatch.setattr(simhash, "BROADCAST_NODES", broadcast)
    monkeypatch.setattr(simhash, "blocks_for", lambda n, radius=4: 5 if fill else 7)
    rng = random.Random(nodes)
    prints = [0, 2**64 - 1]
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12, 40])):
            prints.append(base)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                base ^= 1 << b
    prints = list(dict.fromkeys(prints))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    at = {p: i for i, p in enumerate(signed)}
    label = np.arange(len(prints))
    for _ in range(len(prints)):
        before = label.copy()
        for a, b in links:
            low = min(label[at[a]], label[at[b]])
            label[at[a]] = label[at[b]] = low
        if (before == label).all():
            break
    assert label.tolist() == plain_components(prints)


def test_tree_search_equals_all_distances():
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 2**64, 700, dtype=np.uint64) & np.uint64(0xFF00FF0000FF0F0F))
    tree = simhash.BKTree.build(values)
    assert sorted(tree.node.tolist()) == sorted(values.tolist())
    asks = np.concatenate([values[:50], rng.integers(0, 2**64, 50, dtype=np.uint64)])
    got = {(int(q), int(tree.node[n])) for a, b in tree.search(asks) for q, n in zip(a, b)}
    assert got == {(i, int(v)) for i, a in enumerate(asks) for v in values if (int(a) ^ int(v)).bit_count() <= 4}
    up = tree.parent[1:]
    assert (simhash.distance(tree.node[1:], tree.node[up]) == tree.edge[1:]).all()
    assert len(set(zip(up.tolist(), tree.edge[1:].tolist()))) == len(up)


def test_tree_size_and_bits():
    assert [simhash.blocks_for(n) for n in (0, 10**5, 10**6, 10**9)] == [5, 5, 6, 7]
    for blocks in (5, 6, 7, 8):
        masks = simhash.shard_masks(blocks)
        assert len(masks) == math.comb(blocks, blocks - 4)
        for _ in range(50):
            flipped = sum(1 << b for b in random.sample(range(64), 4))
            assert any(not m & flipped for m in masks)
