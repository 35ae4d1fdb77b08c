"""Dealt operators on small tables: against brute force, the tokenizer library, and for nulls, empties, ties and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foldcast.llm import bpe, classlm, decontam, lines, pii, quality, rules, secrets, setjoin, shards, shared
from foldcast.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], None if t is None else len(t), 0.5, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "po", "ru") for b in ("", "sa", "ti", "vu", "wer")]
    own = [" ".join(rng.choices(words, k=rng.randint(60, 90))) for _ in range(40)]
    near = []
    for t in own[:12]:
        w = t.split()
        w[3] = "changed"
        near.append(" ".join(w))
    return [None, "", "  \n ", "one two", "One  TWO", "x" * 3000, *own, *own[:6], *near]


def words_of(text):
    return (text or "").encode().lower().split()


def sets_of(texts):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(texts):
    sets, parent = sets_of(texts), list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_components(spark, texts, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    got = {r.doc_id: r for r in setjoin.link_components(frame(spark, texts)).collect()}
    label, size = brute_components(texts)
    assert [got[i].component_id for i in range(len(texts))] == label
    assert [got[i].n_shingles for i in range(len(texts))] == size


def test_keep_one_of_each_component(spark, texts):
    docs = frame(spark, texts)
    kept = setjoin.keep_one(docs)
    label, _ = brute_components(texts)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert setjoin.keep_one(docs.limit(0)).count() == 0


def test_tables_are_counted_as_they_are_written(spark, texts, monkeypatch):
    docs = frame(spark, texts)
    table, seen = shared.measured(docs.where("doc_id < 0"), "none", least=F.min("doc_id"))
    assert seen == {"rows": 0, "least": None} and table.schema == docs.schema

    def again(self):
        raise AssertionError("a job of its own counts a stored table")

    for name in ("count", "isEmpty", "first"):
        monkeypatch.setattr(type(docs), name, again)
    label, _ = brute_components(texts)
    assert sorted(r.doc_id for r in setjoin.keep_one(docs).collect()) == sorted(set(label))
    paged = {r.doc_id: r["_group"] for r in setjoin.with_groups(docs).collect()}
    assert all((paged[i] == paged[j]) == (label[i] == label[j]) for i in range(5, len(texts)) for j in range(5, i))
    assert len(lines.drop_boilerplate(docs, pages=setjoin.with_groups(docs.select("source", "text"))).collect()) == len(texts)


def test_groups_are_two_rounds_of_least_labels(spark):
    bands = {3: [1, 2], 5: [2, 9], 6: [9, 4], 7: [4, 4], 8: [5], 9: [4, 8], 10: [8]}
    want = {c: c for c in bands}
    for _ in range(2):
        low = {b: min(want[c] for c in bands if b in bands[c]) for own in bands.values() for b in own}
        want = {c: min(low[b] for b in bands[c]) for c in bands}
    got = setjoin._grouped(spark.createDataFrame([(c, 10, b) for c, b in bands.items()], "cid long, n long, bands array<long>")).collect()
    assert {r["cid"]: r["grp"] for r in got} == want and len(set(want.values())) == 4


def test_repeated_rows_join(spark):
    docs = frame(spark, ["a b c d e f", "z"])
    assert {(r.doc_id, r.component_id) for r in setjoin.link_components(docs.unionByName(docs)).collect()} == {(0, 0), (1, 1)}


def test_bpe_equals_library(spark, texts):
    odd = ["Hello, WORLD's 123!!", "é É ΑΣ Σ", "<|endoftext|> a<|startoftext|>b <|", "日本 🙂 \x1c　x", "aaaaaaaaaaaaaaaa", "J̌ ½²", None]
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = bpe.decode_documents(bpe.encode_documents(frame(spark, texts + odd), VOCABULARY), VOCABULARY).orderBy("doc_id").collect()
    for r, t in zip(got, texts + odd):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == own.decode(ids, skip_special_tokens=False)
    row = bpe.digests(frame(spark, ["low lower"]), VOCABULARY).first()
    ids = own.encode("low lower", add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_automaton_on_a_small_merge_list():
    merges = [("a", "a"), ("a", "b"), ("aa", "b</w>"), ("b", "a")]
    labels = {s: i for i, s in enumerate(["a", "b", "a</w>", "b</w>", "aa", "ab", "aab</w>", "ba"])}
    automaton = bpe.TokenAutomaton(labels, merges, {})

    def merged(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b]
                i += 1
        return parts

    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            assert [automaton.labels[i] for i in automaton.encode_piece(word)] == merged(word), word


def test_line_dedup_by_host(spark):
    pages = [f"page {i} body\n foot \n\nend {i}" for i in range(20)]
    texts = [*pages, pages[0], None, "foot", "foot"]
    docs = frame(spark, texts, ["h"] * 22 + ["small", None])
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs, ratio=0.5, counted="gone").collect()}
    assert got[3].text == "page 3 body\n\nend 3" and got[3].gone == 1
    assert got[20].text == got[0].text and got[21].text is None
    assert got[22].text == "foot" and got[23].text == "foot"
    assert lines.drop_boilerplate(docs).columns == docs.columns
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


def slow_jump(key, shards_n):
    b, j = -1, 0
    while j < shards_n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_shards(spark, texts):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 500)
    assert shards.jump(keys, 8).tolist() == [slow_jump(int(k) % 2**64, 8) for k in keys]
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:]).limit(2))
    got = shards.assign_shards(docs, 8).collect()
    assert len(got) == docs.count()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[3].size == 8 and by_id[3].text_crc32 == zlib.crc32(b"one two") and by_id[0].size == 1


def test_rule_statistics(spark):
    texts = [None, "", "a b c a b c d", "x #\nx #\n\ny é<>", "w " * 60, "one two three four", "a b a b a b a"]

    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(inside)

    got = {r.doc_id: r for r in rules.text_statistics(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in rules.COUNTS) == brute(t), t


def test_rules_keep_clean_and_reject_odd(spark):
    rng = random.Random(2)
    clean = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(120)) for _ in range(150)]
    odd = [" ".join("".join(rng.choices("abcdefgh", k=5)) + "&&&###" for _ in range(120)) for _ in range(4)]
    docs = frame(spark, [*clean, *odd, None])
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(150, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.apply_rules(docs, labels).collect()}
    assert sum(got[i].kept for i in range(150)) >= 145
    assert not any(got[i].kept for i in range(150, 155)) and got[154].base_failed
    assert rules.apply_rules(docs.limit(0), labels).count() == 0


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [a + b + c for a in ("ka", "lo", "mi") for b in ("na", "pe", "qui") for c in ("", "st", "rd", "um")]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 40))) + ". Yes it is." for _ in range(60)]
    texts = [None, ""]
    for k in range(80):
        w = rng.choices(vocabulary, k=rng.randint(0, 300))
        if k % 3 == 0:
            own = items[k % 60].upper().split()
            if k % 2:
                own[0] = "other"
            at = rng.randint(0, len(w))
            w = w[:at] + own + w[at:]
        texts.append(" ".join(w))
    benchmark = spark.createDataFrame([*enumerate(items), (60, None), (61, "")], "item_id long, text string")
    docs = frame(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, benchmark).collect()}
    sets, want = sets_of(texts), set()
    for i, item in enumerate(items):
        s = next(iter(sets_of([item])))
        want |= {(d, i) for d in range(len(texts)) if len(s & sets[d]) >= 0.75 * len(s)}
    assert got == want and len(want) >= 25
    kept = decontam.drop_leaks(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontam.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_secret_rules_and_added_spans(spark):
    key = "AKIA" + "Q7" * 10
    mixed = "Zk3" * 9
    texts = [None, "", f"Token: '{'ab12' * 6}' and {key}", "token=abc password=\"s3cret99\"", f"plainwordthatislongenough {mixed} 1234567890123456789", *[f"api_key = {hashlib.md5(str(i).encode()).hexdigest()}x longplainwordnumber{'abcdefgh'[i % 8] * 9} " for i in range(40)]]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in secrets.scan_secrets(docs, secrets.train_secret_net(docs)).collect()}
    assert (got[0].spans, got[0].base_sha256) == ("", hashlib.sha256(b"").hexdigest())
    assert (got[2].n_assign, got[2].n_access, got[2].n_hex) == (1, 1, 1)
    assert got[3].n_assign == 1 and got[3].spans.startswith("assign:10:")
    base = secrets.joined(secrets.base_spans(texts[2]), secrets.KINDS)
    assert got[2].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(got[2].spans.split(","))
    assert secrets.train_secret_net(docs.limit(2)) is None
    assert secrets.scan_secrets(docs, None).count() == len(texts)


def test_secret_net_learns_from_every_window(spark, monkeypatch):
    """More plain windows than any sample held: each is learnt from or judges once, in parts that make no difference to a cluster."""
    texts = [f"token={hashlib.md5(str(i).encode()).hexdigest()} then {''.join('abcdefghij'[(i * p + i // 7) % 10] for p in range(1, 24))}{'klmnopqr'[i % 8]}{chr(97 + i // 208 % 26)}{chr(97 + i // 8 % 26)}" for i in range(2600)]
    docs = frame(spark, [*texts, *texts[:50], None, ""])
    want = {(secrets.run_label(t, m.start(), m.end(), secrets.base_spans(t)), secrets.window(t, m.start(), m.end())) for t in texts for m in secrets.RUN.finditer(t)}
    found = secrets.labelled_windows(docs).collect()
    assert {(r.label, bytes(r.codes)) for r in found} == want and len(found) == len(want) and min(sum(y == k for y, _ in want) for k in (0, 1)) > 2000
    seen = {"learnt": 0, "judged": 0}
    fit, calibrate = secrets.fit_net, secrets.calibrate

    def counted_fit(rows, count, share, **kw):
        seen["learnt"] = rows.count()
        assert count == rows.count() and share == pytest.approx(rows.where("label = 1").count() / count)
        first, second = fit(rows, count, share, part=1000, rounds=2), fit(rows.repartition(5), count, share, part=1000, rounds=2)
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(first.params(), second.params()))
        return first

    def counted_calibrate(net, rows, positives, negatives, recall):
        seen["judged"] = rows.count()
        out = calibrate(net, rows, positives, negatives, recall)
        p = {y: out.probability(secrets._codes([bytes(r.codes) for r in rows.where(f"label = {y}").collect()])) for y in (0, 1)}
        assert (len(p[1]), len(p[0])) == (positives, negatives)
        assert out.threshold == pytest.approx(max(0.5, np.sort(p[1])[int((1 - recall) * positives)]), rel=1e-5)
        assert (p[1] >= out.threshold).mean() > 0.9 and (p[0] < out.threshold).mean() > 0.9
        return out

    monkeypatch.setattr(secrets, "fit_net", counted_fit)
    monkeypatch.setattr(secrets, "calibrate", counted_calibrate)
    secrets.train_secret_net(docs)
    assert seen["learnt"] + seen["judged"] == len(want) and seen["judged"] > len(want) / 5


def test_personal_data_rules():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choices("ab1.@-+ 9(", k=rng.randint(0, 30)))
        assert [(s, e) for s, e, k in pii.base_spans(t) if k == "email"] == [m.span() for m in email.finditer(t)], t
        ips = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        assert [(s, e) for s, e, k in pii.base_spans(t) if k == "ip"] == ips
    assert pii.joined(pii.base_spans("4111 1111 1111 1111 +1 (743) 555-3824"), pii.KINDS) == "card:0:19,phone:20:37"


def test_context_finds_new_identifiers(spark):
    texts = [f"please write to user{i}@mail.example.com soon" for i in range(12)] + ["please write to agent77x9 soon", "in 1234567 there was", None, ""]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert got[0].n_email == 1 and got[12].spans == "context:16:25" and got[12].n_added == 1
    assert got[13].spans == "" and got[14].spans == "" and len(got) == len(texts)


def test_class_model_scores(spark, texts):
    docs = frame(spark, texts)
    model, counts = classlm.train_class_model(docs.where(classlm.trained_on()))
    got = {r.doc_id: r for r in classlm.score_documents(docs, model, counts).collect()}
    seen = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            seen.update([*words_of(t), None])
    n, v = sum(seen.values()), len(seen)
    for i, t in enumerate(texts):
        tokens = [*words_of(t), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(seen[w] > 0 for w in tokens), n)
        assert got[i].base_score == pytest.approx(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert got[i].score < 0


def test_tail_words_join_their_counts(spark, texts):
    """The size of the lookup table changes no count, class or score."""
    docs = frame(spark, texts)

    def scores(size):
        classes, words = classlm.fit_word_classes(docs, head=6, size=size)
        lines = classlm.class_lines(docs, classes, words)
        return {r.doc_id: (r.n_known, r.base_score, r.score) for r in classlm.score_lines(lines, classlm.fit_steps(lines, classes)).collect()}

    want, got = scores(1000), scores(5)
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want) and len(got) == len(want)


def _hash_of(word):
    (_, _, found), = classlm.batch_words(pa.array([word]))
    return int(found.hash.view(np.int64)[0])


def test_class_scores_against_brute_force(spark, texts):
    docs = frame(spark, [*texts, "unseen tokens here 7"])
    train = docs.where((F.col("doc_id") < len(texts)) & classlm.trained_on())
    classes, words = classlm.fit_word_classes(train, head=6, size=8)
    lines = classlm.class_lines(docs, classes, words)
    got = {r.doc_id: r.score for r in classlm.score_lines(lines, classlm.fit_steps(lines.where((F.col("doc_id") < len(texts)) & classlm.trained_on()), classes)).collect()}
    assert got == pytest.approx({r.doc_id: r.score for r in classlm.score_documents(docs, *classlm.train_class_model(train, head=6)).collect()}, rel=1e-9)

    k, table = classlm.CLASSES, classes.lookup
    tokens = {i: words_of(t) for i, t in enumerate([*texts, "unseen tokens here 7"])}
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    seen = collections.Counter(w for i in learned for w in tokens[i])
    hashes = {w: _hash_of(w.decode()) for t in tokens.values() for w in t}
    head = sorted(seen, key=lambda w: (-seen[w], hashes[w]))[:6]
    assert {hashes[w] for w in head} == set(table.word[table.type >= 0].tolist())
    stand_in = {}
    for w in hashes:
        (_, _, found), = classlm.batch_words(pa.array([w.decode()]))
        stand_in[w] = int(classes.own[table.find(found)[0] if w in head else table.head + classlm.endings(found)[0]])
    end = classes.end_class

    # Exchange steps: the class that makes the contexts of a word likeliest, against the table of the stand-ins.
    def bigrams(of):
        out = np.zeros((k, k))
        for i in learned:
            line = [end, *(of[w] for w in tokens[i]), end]
            for x, y in zip(line, line[1:]):
                out[x, y] += 1
        return out

    def steps_of(t):
        share = (t.sum(axis=0) + 1) / (t.sum() + k)
        return np.log10((t + classlm.BACKOFF * share) / (t.sum(axis=1, keepdims=True) + classlm.BACKOFF))

    first = bigrams(stand_in)
    step, size = steps_of(first), first.sum(axis=0)
    own = dict(stand_in)
    of_word = {r.word: (r.n, r["class"]) for r in words.collect()}
    assert set(of_word) == {hashes[w] for w in seen if w not in head}
    for w in seen:
        if w not in head:
            worth = np.zeros(k)
            for i in learned:
                line = [end, *(stand_in[x] for x in tokens[i]), end]
                for at, x in enumerate(tokens[i]):
                    if x == w:
                        worth += step[line[at], :] + step[:, line[at + 2]] - np.log10(size + 1)
            n, chosen = of_word[hashes[w]]
            assert n == seen[w] and worth[chosen] == pytest.approx(worth.max(), rel=1e-9)
            own[w] = chosen
    # Scores: bigrams of the final classes, and one unseen word in each class.
    step = steps_of(bigrams(own))
    n_in, v_in = np.zeros(k), np.zeros(k)
    for w in seen:
        n_in[own[w]] += seen[w]
        v_in[own[w]] += 1
    n_in[end] += len(learned)
    v_in[end] += 1
    for i, t in tokens.items():
        line = [end, *(own[w] for w in t), end]
        n_of = [*(seen[w] for w in t), len(learned)]
        want = sum(step[x, y] + np.log10((n + 1) / (n_in[y] + v_in[y] + 1)) for x, y, n in zip(line, line[1:], n_of))
        assert got[i] == pytest.approx(want, rel=1e-9), i


def test_class_model_edges(spark, texts):
    empty = frame(spark, texts).limit(0)
    model, words = classlm.train_class_model(empty)
    got = classlm.score_documents(frame(spark, ["a b", None, ""]), model, words).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in sorted(got, key=lambda r: r.doc_id)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert classlm.score_documents(empty, model, words).count() == 0
    # Ties at the edge of the head, rows that repeat, columns with the names of the operator's own, a long text.
    odd = frame(spark, ["p q r s", "p q r s", "z " * 200_000]).withColumnsRenamed({"lang": "row", "source": "line", "label": "found", "n_chars": "word"})
    odd = odd.unionByName(odd.limit(1))
    classes, _ = classlm.fit_word_classes(odd, head=2)
    assert classes.lookup.head == 2 and classes.n == 12 + 200_000 + 4
    rows = classlm.score_documents(odd, *classlm.train_class_model(odd, head=2)).collect()
    assert sorted(r.n_tokens for r in rows) == [5, 5, 5, 200_001] and len({round(r.score, 6) for r in rows if r.n_tokens == 5}) == 1


def test_quality_net_learns_and_handles_edges(spark):
    rng = random.Random(8)
    good = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(120)]
    bad = [" ".join("".join(rng.choices("ABCDEFGH", k=5)) + "!!" for _ in range(60)) for _ in range(120)]
    docs = frame(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)], "doc_id long, quality int")
    net = quality.train_quality_net(docs, labels, quality.learnable())
    got = {r.doc_id: r.score for r in quality.score_quality(docs, net).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i < 120) for i in held]) > 0.95
    assert got[240] == got[241] and 0 <= got[240] <= 1
    assert quality.train_quality_net(docs, labels.limit(0), quality.learnable()) == 0.5
    assert quality.score_quality(docs.limit(0), net).count() == 0


def test_quality_sample_takes_whole_texts(spark, monkeypatch):
    sizes = [0, 1, quality.CHUNK, quality.CHUNK + 1, quality.CHUNK + quality.STEP, quality.CHUNK + quality.STEP + 1, 200_000]
    docs = frame(spark, ["x" * n for n in sizes] + ["é" * 400, None])
    got = [r.n for r in docs.orderBy("doc_id").select(quality._chunk_count("text").alias("n")).collect()]
    assert got == [len(quality.chunk_starts(np.array([0, n]))[0]) for n in [*sizes, 800, 0]]
    # Whole texts in order of hash; one that does not fit is passed over, later ones that fit are taken.
    assert quality.sample_rows([(0, 3, "a"), (0, 9, "b"), (0, 2, "c"), (1, 5, "d"), (1, 1, "e")], 5) == ["a", "c", "d"]
    fitted = []
    monkeypatch.setattr(quality.ByteNet, "fit", lambda self, chunks, row, y: fitted.append((chunks, row)) or self)
    texts = ["a" * 3000, "b" * 100, "c" * 100, "d" * 5000]
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    quality.train_quality_net(frame(spark, texts), labels, F.lit(True))
    chunks, row = fitted[0]
    assert np.bincount(row).tolist() == [7, 1, 1, 12] and set(bytes(chunks[row == 3].ravel())) == {0, ord("d")}


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    texts = [" ".join(f"word{(i * 7 + k * k) % 50}x" for k in range(40)) for i in range(30)]
    docs = frame(spark, [*texts, texts[0], None]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, texts[4])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    part = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        part = stage(spark, part, str(tmp_path))
        assert part.columns == docs.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path))
    label, _ = brute_components([*texts, texts[0], None])
    assert {r.doc_id for r in got.collect()} == {i for i in range(32) if label[i] == i} - {4}


def test_near_copies_are_one_page(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)

    def line():
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12))

    body = [line() for _ in range(12)]
    copies = ["\n".join(["footer of the host", f"copy {i}", *body]) for i in range(12)]
    texts = [*copies, *("\n".join(["footer of the host", line(), line(), line()]) for _ in range(100))]
    docs = frame(spark, texts, ["h"] * len(texts)).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, line())], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    part = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        part = stage(spark, part, str(tmp_path))
    got = {r.doc_id: r.text for r in part.collect()}
    assert sorted(got) == [0, *range(12, 112)]
    assert all(got[i] == texts[i].split("\n", 1)[1] for i in got)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == sorted(got)


def test_keep_one_row_of_repeated_and_null_keys(spark):
    a, b = "a b c d e f", "u v w x y z"
    rows = [(0, a), (0, a), (1, a), (1, b), (None, a), (None, b), (None, "k l m n o p"), (None, "k l m n o p"), (None, None), (None, "")]
    kept = setjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(0, a), (1, b), (None, "k l m n o p"), (None, None), (None, "")], key=str)


def test_clashing_columns_come_back_as_they_were(spark):
    body = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(40)]
    texts = [*(f"foot line\n{b}" for b in body), "foot line\n" + body[0], None, ""]
    names = ("_rid", "_host", "_drop", "_salt", "_group", "_key", "_first", "cid")
    docs = frame(spark, texts).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    for out in (lines.drop_boilerplate(docs, ratio=0.5), setjoin.keep_one(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) in (42, 43)
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
    grouped = setjoin.with_groups(docs)
    assert grouped.columns.count("_group") == 1 and grouped.where("doc_id = 40").first()["_group"] == grouped.where("doc_id = 0").first()["_group"]


@pytest.mark.parametrize("tokens", [400_000, 150])
def test_blocks_are_cut_by_shingles(spark, texts, monkeypatch, tokens):
    monkeypatch.setattr(setjoin, "BLOCK_TOKENS", tokens)
    long = " ".join(f"v{i}" for i in range(3000))
    whole = [*texts, long, long + " tail", " ".join(f"v{i}" for i in range(5, 3000))]
    got = {r.doc_id: r.component_id for r in setjoin.link_components(frame(spark, whole)).collect()}
    assert [got[i] for i in range(len(whole))] == brute_components(whole)[0]
    assert setjoin.link_components(frame(spark, texts).limit(0)).count() == 0


def test_encoder_looks_up_repeated_words_and_empty_tables(spark, monkeypatch):
    texts = ["alpha beta alpha gamma delta alpha beta", "", None, "alpha " * 50, "beta beta"] * 2
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    automaton = bpe.load_automaton(VOCABULARY)
    automaton.forget()
    monkeypatch.setattr(automaton, "limit", 3)
    for t in texts:
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert list(automaton.encode(t or "")) == ids and automaton.decode(ids) == own.decode(ids, skip_special_tokens=False)
    assert bpe.digests(frame(spark, texts).limit(0), VOCABULARY).count() == 0
