"""LM scoring with a Brown class-based bigram model.

Every training word has a class. Exchange clustering places the ``HEAD`` most frequent words (ties by hash), the end of a text and
256 stand-ins for all other words (by their last two bytes) by the likelihood of the class bigrams of all training texts. Then each
other training word makes its own exchange step against that table: the classes before and after all its occurrences are counted
over the whole corpus, and it moves to the class that makes them likeliest. Class bigrams are counted again with the final
classes of all words. A word that no training text holds takes the class of its stand-in. A token costs
class transition * word in class, the first smoothed towards class frequencies, the second by one unseen word of each class.

Counts of words, of their contexts and of class pairs are taken over all training texts. Frequent words are looked up in a broadcast
table of about ``LOOKUP`` rows, which is for speed only: all other words meet the table of all words by a shuffle on the word, where
no key is hot.

Words are known by 64-bit hashes. Defined results: NULL and empty texts are one end token; without training texts every token has
count 0 and both scores use N = V = 0; repeated rows repeat; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foldcast.llm.shared import hashed_fold, need_columns, stored
from foldcast.llm.words import as_long, batch_words, mix

HEAD, ENDINGS, CLASSES, LOOKUP, FOLDS, HELD = 1500, 256, 48, 131_072, 7, 2
ROUNDS, BACKOFF = 6, 50.0
END = int(as_long(mix(np.array([0xE0D], dtype=np.uint64)))[0])


def trained_on(key: str = "doc_id") -> Column:
    return hashed_fold(F.col(key), FOLDS) != HELD


def endings(words) -> np.ndarray:
    """Type of each word by its last two bytes."""
    last = words.data[words.end - 1].astype(np.uint64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.uint64)
    return (mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, ending, n) of all tokens; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int64()), ("ending", pa.int32()), ("n", pa.int64())])
        hashes, ends, counts, held, n_docs = [], [], [], 0, 0

        def merged():
            h, where, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            return h, np.concatenate(ends)[where], np.bincount(inverse, np.concatenate(counts), len(h)).astype(np.int64)

        for batch in batches:
            n_docs += batch.num_rows
            for _, _, words in batch_words(batch.column(text)):
                h, where, n = np.unique(words.hash, return_index=True, return_counts=True)
                hashes.append(h), ends.append(endings(words)[where]), counts.append(n)
                held += len(h)
                if held > 2_000_000:
                    h, e, n = merged()
                    hashes, ends, counts, held = [], [], [], 0
                    if len(h) > 1_000_000:  # a task's table stays bounded; sums go on after the shuffle
                        yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(e.astype(np.int32)), pa.array(n)], schema=schema)
                    else:
                        hashes, ends, counts, held = [h], [e], [n], len(h)
        if hashes:
            h, e, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(e.astype(np.int32)), pa.array(n)], schema=schema)
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([-1], pa.int32()), pa.array([n_docs])], schema=schema)

    counted = docs.select(text).mapInArrow(run, "word long, ending int, n long")
    return counted.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def cutoff(counts: DataFrame, most: int) -> int:
    """The least count c such that at most ``most`` words occur c times or more (1 at least), from a histogram by size."""
    steps = F.floor(F.log2("n") * 32).cast("int")
    bins = counts.groupBy(steps.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()
    least, total = None, 0
    for r in bins:
        total += r["k"]
        if total > most:
            break
        least = r["least"]
    return least if least is not None else (bins[0]["least"] + 2**40 if bins else 1)


@dataclass
class Lookup:
    """Frequent words in order of hash: their counts, and the type of those that have their own."""

    word: np.ndarray
    n: np.ndarray
    type: np.ndarray  # -1: the ending decides
    head: int  # words with a type of their own

    @property
    def types(self) -> int:
        return self.head + ENDINGS + 1

    @property
    def end_type(self) -> int:
        return self.head + ENDINGS

    def slots(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Where each word may be listed, and whether it is."""
        h = as_long(words.hash)
        if not len(self.word):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        slot = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return slot, self.word[slot] == h

    def find(self, words) -> np.ndarray:
        """Type of each word."""
        slot, listed = self.slots(words)
        own = np.full(len(slot), -1, dtype=np.int64)
        own[listed] = self.type[slot[listed]]
        return np.where(own >= 0, own, self.head + endings(words))


def lookup_table(counts: DataFrame, size: int = LOOKUP, head: int = HEAD) -> tuple[Lookup, int]:
    """The lookup table, and the count from which all words are listed; the ``head`` most frequent ones are, whatever their count."""
    words = counts.where(F.col("word") != END).select("word", "n")
    first = words.orderBy(F.desc("n"), "word").limit(head).toArrow()
    least = cutoff(words, size)
    rows = words.where(F.col("n") >= least).toArrow()
    word, where = np.unique(np.concatenate([t.column("word").to_numpy() for t in (first, rows)]), return_index=True)
    n = np.concatenate([t.column("n").to_numpy() for t in (first, rows)])[where]
    own = np.full(len(word), -1, dtype=np.int64)
    own[np.searchsorted(word, first.column("word").to_numpy())] = np.arange(first.num_rows)
    return Lookup(word, n, own, first.num_rows), least


def _with_ends(words, values: np.ndarray, rows: int, end: int) -> np.ndarray:
    """Values of the words of some texts in a row, with an end before the first text and after each."""
    out = np.full(len(values) + rows + 1, end, dtype=np.int64)
    out[np.arange(len(values)) + words.row + 1] = values
    return out


def type_pairs(docs: DataFrame, table: Lookup, text: str = "text") -> DataFrame:
    """(before, after, n): how often one type follows another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = table.types
        total = np.zeros(types * types, dtype=np.int64)
        for batch in batches:
            for first, last, words in batch_words(batch.column(text)):
                line = _with_ends(words, table.find(words), last - first, table.end_type)
                pair, n = np.unique(line[:-1] * types + line[1:], return_counts=True)
                total[pair] += n
        pair = np.flatnonzero(total)
        for i in range(0, len(pair), 200_000):
            p = pair[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array((p // types).astype(np.int32)), pa.array((p % types).astype(np.int32)), pa.array(total[p])], names=["before", "after", "n"])

    return docs.select(text).mapInArrow(run, "before int, after int, n long").groupBy("before", "after").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each type: types move, one after the other, to the class that raises the likelihood of the class bigrams most.

    ``pairs`` holds counts of types after types; a bounded table, whatever the corpus.
    """
    n = len(pairs)
    seen = pairs.sum(axis=1) + pairs.sum(axis=0)
    order = np.argsort(-seen, kind="stable")
    own = np.zeros(n, dtype=np.int64)
    own[order] = np.arange(n) % classes
    hot = np.zeros((n, classes))
    hot[np.arange(n), own] = 1
    right, left = pairs @ hot, pairs.T @ hot  # of each type: counts by the class after it, and before it
    table = hot.T @ right
    for _ in range(rounds):
        moved = 0
        for w in order:
            if seen[w] == 0:
                continue
            a, self_pair = own[w], pairs[w, w]
            out, into = right[w].copy(), left[w].copy()
            out[a] -= self_pair
            into[a] -= self_pair
            # The table without w, then the gain of adding w to each class in turn.
            rest = table
            rest[a] -= out
            rest[:, a] -= into
            rest[a, a] -= self_pair
            rows, cols = rest.sum(axis=1), rest.sum(axis=0)
            gain = (_xlogx(rest + out) - _xlogx(rest)).sum(axis=1) + (_xlogx(rest.T + into) - _xlogx(rest.T)).sum(axis=1)
            diagonal = np.diag(rest)
            gain += _xlogx(diagonal + out + into + self_pair) - _xlogx(diagonal + out) - _xlogx(diagonal + into) + _xlogx(diagonal)
            n_out, n_in = out.sum() + self_pair, into.sum() + self_pair
            gain -= _xlogx(rows + n_out) - _xlogx(rows) + _xlogx(cols + n_in) - _xlogx(cols)
            # Flows between w and the other classes also enter rows and columns of those classes, alike for every choice.
            b = int(gain.argmax())
            rest[b] += out
            rest[:, b] += into
            rest[b, b] += self_pair
            if b != a:
                moved += 1
                own[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if moved * 500 < n:
            break
    return own


@dataclass
class WordClasses:
    """What a task needs to find classes: of types, and of listed words."""

    lookup: Lookup
    own: np.ndarray  # class of each type
    listed: np.ndarray  # class of each listed word
    log_size: np.ndarray  # per class: log10 of its tokens + words + 1
    n: int
    v: int
    end: int  # training texts

    @property
    def log_base(self) -> float:
        return -float(np.log10(self.n + self.v + 1))

    @property
    def end_class(self) -> int:
        return int(self.own[self.lookup.end_type])


def log_steps(table: np.ndarray) -> np.ndarray:
    """log10 of class transitions, smoothed towards the shares of the classes."""
    share = (table.sum(axis=0) + 1) / (table.sum() + len(table))
    return np.log10((table + BACKOFF * share) / (table.sum(axis=1, keepdims=True) + BACKOFF))


_WORDS = "word long, n long, class int"


def contexts(docs: DataFrame, table: Lookup, own: np.ndarray, text: str = "text") -> DataFrame:
    """(word, code, n) of words without a type of their own: how often each stands between which two classes.

    ``code`` is class before * CLASSES + class after. Rows of one word may repeat; each task adds up its own, some at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed():
            word, code = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((code, word))
            word, code = word[order], code[order]
            at = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (code[1:] != code[:-1])))
            n = np.diff(np.append(at, len(word)))
            for i in range(0, len(at), 100_000):
                k = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(word[k])), pa.array(code[k].astype(np.int32)), pa.array(n[i : i + 100_000].astype(np.int64))], names=["word", "code", "n"])

        for batch in batches:
            for first, last, words in batch_words(batch.column(text)):
                types = table.find(words)
                line = own[_with_ends(words, types, last - first, table.end_type)]
                rest = np.flatnonzero(types >= table.head)
                at = rest + words.row[rest] + 1
                held.append((words.hash[rest], (line[at - 1] * CLASSES + line[at + 1]).astype(np.int32)))
                size += len(rest)
                if size > 1_000_000:
                    yield from summed()
                    held, size = [], 0
        if size:
            yield from summed()

    return docs.select(text).mapInArrow(run, "word long, code int, n long")


def assign(found: DataFrame, steps: np.ndarray, tokens: np.ndarray) -> DataFrame:
    """(word, n, class): each word in the class under which its contexts are likeliest; ties go to the lower class.

    ``steps`` holds log transitions, ``tokens`` the tokens of each class. A word's rows stand together in one partition, and are added
    up batch by batch, so that a word may have any number of them.
    """
    # Of a word between classes b and a: the steps b to c and c to a, and its share of the tokens of c.
    worth = (steps[:, None, :] + steps.T[None, :, :] - np.log10(tokens + 1)[None, None, :]).reshape(CLASSES * CLASSES, CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(words, counts, scores):
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts), pa.array(scores.argmax(axis=1).astype(np.int32))], names=["word", "n", "class"])

        open_word, open_n, open_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, CLASSES))
        for batch in batches:
            if not batch.num_rows:
                continue
            word, code, n = (batch.column(c).to_numpy() for c in ("word", "code", "n"))
            at = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts, scores, words = np.add.reduceat(n, at), np.add.reduceat(worth[code] * n[:, None], at), word[at]
            if len(open_word) and open_word[0] == words[0]:
                counts[0] += open_n[0]
                scores[0] += open_score[0]
            elif len(open_word):
                yield done(open_word, open_n, open_score)
            open_word, open_n, open_score = words[-1:], counts[-1:], scores[-1:]
            if len(words) > 1:
                yield done(words[:-1], counts[:-1], scores[:-1])
        if len(open_word):
            yield done(open_word, open_n, open_score)

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, _WORDS)


def fit_word_classes(docs: DataFrame, text: str = "text", head: int = HEAD, size: int = LOOKUP) -> tuple[WordClasses, DataFrame]:
    """Classes of all training words, and the stored table (word, n, class) of those that exchange clustering did not see."""
    need_columns(docs, text)
    counts = stored(word_counts(docs, text), "lm-counts")
    n, v = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    table, least = lookup_table(counts, size, head)
    pairs = np.zeros((table.types, table.types))
    got = stored(type_pairs(docs, table, text), "lm-pairs").toArrow()
    pairs[got.column("before").to_numpy(), got.column("after").to_numpy()] = got.column("n").to_numpy()
    own = exchange(pairs)
    of_class = np.zeros((CLASSES, CLASSES))
    np.add.at(of_class, (own[:, None], own[None, :]), pairs)
    words = stored(assign(contexts(docs, table, own, text), log_steps(of_class), of_class.sum(axis=0)), "lm-words")

    listed = np.where(table.type >= 0, own[np.maximum(table.type, 0)], -1)
    often = words.where(F.col("n") >= least).select("word", "class").toArrow()
    listed[np.searchsorted(table.word, often.column("word").to_numpy())] = often.column("class").to_numpy()
    is_head = table.type >= 0
    tokens = np.bincount(own[table.type[is_head]], table.n[is_head], CLASSES)
    members = np.bincount(own[table.type[is_head]], minlength=CLASSES).astype(float)
    ends = int(pairs[:, table.end_type].sum())
    tokens[own[table.end_type]] += ends
    members[own[table.end_type]] += ends > 0
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens[r["class"]] += r["n"]
        members[r["class"]] += r["v"]
    return WordClasses(table, own, listed, np.log10(tokens + members + 1), int(n), int(v), ends), words


_LINES = {"n_tokens": T.LongType(), "n_known": T.LongType(), "base_score": T.DoubleType(), "line": T.BinaryType(), "rest": T.ArrayType(T.LongType()), "places": T.ArrayType(T.IntegerType())}


def _known_lines(docs: DataFrame, classes: WordClasses, key: str, text: str) -> DataFrame:
    """Per document what the lookup table knows: a byte of class per token, and words and places of tokens that it does not list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kept = classes.lookup, (classes.listed, classes.own)
        for batch in batches:
            sums: list[list[np.ndarray]] = [[], [], []]
            lines, rest, places, sizes = [], [], [], []
            for first, last, words in batch_words(batch.column(text)):
                rows = last - first
                slot, listed = table.slots(words)
                of_word = kept[1][table.head + endings(words)]
                n = np.zeros(len(slot), dtype=np.int64)
                of_word[listed], n[listed] = kept[0][slot[listed]], table.n[slot[listed]]
                count = np.bincount(words.row, minlength=rows)
                known = np.bincount(words.row, listed, rows) + (classes.end > 0)
                base = (count + 1) * classes.log_base + np.bincount(words.row, np.log10(n + 1.0), rows) + np.log10(classes.end + 1.0)
                for col, values in zip(sums, (count + 1, known, base)):
                    col.append(values)
                codes = of_word.astype(np.uint8).tobytes()
                lines += [codes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
                away = np.flatnonzero(~listed)
                rest.append(as_long(words.hash[away]))
                places.append((away - words.first[words.row[away]]).astype(np.int32))
                sizes.append(np.bincount(words.row[away], minlength=rows))
            count, known, base = (np.concatenate(c) if c else np.zeros(0) for c in sums)
            edges = pa.array(np.append(0, np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x or [np.zeros(0, kind)]))) for x, kind in ((rest, np.int64), (places, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(count.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(lines, pa.binary()), *lists], names=[key, *_LINES])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], *(T.StructField(c, t) for c, t in _LINES.items())]))


def class_lines(docs: DataFrame, classes: WordClasses, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, line, found), stored: ``found`` holds place * 64 + class of words that ``line`` misses."""
    need_columns(docs, key, text)
    rows = stored(_known_lines(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), classes, "key", "text").withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    away = rows.select("row", F.explode(F.arrays_zip("rest", "places")).alias("z")).select("row", F.col("z.rest").alias("word"), F.col("z.places").alias("place"))
    met = away.join(words, "word").select("row", (F.col("place").cast("long") * 64 + F.col("class")).alias("at"), F.log10(F.col("n") + 1).alias("log_n"))
    more = met.groupBy("row").agg(F.collect_list("at").alias("found"), F.sum("log_n").alias("s"))
    joined = rows.drop("rest", "places").join(more, "row", "left")
    k = F.coalesce(F.size("found"), F.lit(0))
    known = F.when(F.col("found").isNull(), F.col("n_known")).otherwise(F.col("n_known") + k)
    return stored(joined.select(F.col("key").alias(key), "n_tokens", known.alias("n_known"), (F.col("base_score") + F.coalesce("s", F.lit(0.0))).alias("base_score"), "line", "found"), "lm-lines")


def _batch_lines(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts of a batch, with an end before the first and after each, and where the texts end."""
    size = batch.num_rows
    line = batch.column("line").cast(pa.large_binary())
    edges = np.frombuffer(line.buffers()[1], dtype=np.int64)[line.offset : line.offset + size + 1]
    data = line.buffers()[2]
    codes = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data is not None and edges[-1] > edges[0] else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    out = np.full(len(codes) + size + 1, end, dtype=np.int64)
    row = np.repeat(np.arange(size), np.diff(edges))
    out[np.arange(len(codes)) + row + 1] = codes
    found = batch.column("found")
    lengths = np.nan_to_num(found.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    at = found.flatten().to_numpy()
    owner = np.repeat(np.arange(size), lengths)
    out[edges[owner] + (at >> 6) + owner + 1] = at & 63
    return out, edges[1:] + np.arange(1, size + 1)


@dataclass
class ClassModel:
    classes: WordClasses
    log_step: np.ndarray  # classes x classes


def fit_steps(lines: DataFrame, classes: WordClasses) -> ClassModel:
    """Class bigrams of all training texts with the final classes of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                line, _ = _batch_lines(batch, classes.end_class)
                total += np.bincount(line[:-1] * CLASSES + line[1:], minlength=CLASSES * CLASSES)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    table = np.zeros(CLASSES * CLASSES)
    for r in lines.select("line", "found").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r["pair"]] = r["n"]
    return ClassModel(classes, log_steps(table.reshape(CLASSES, CLASSES)))


def score_lines(lines: DataFrame, model: ClassModel, key: str = "doc_id") -> DataFrame:
    """One row per document: n_tokens, n_known, train_tokens, base_score and score."""
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = model.classes
        for batch in batches:
            if not batch.num_rows:
                continue
            line, ends = _batch_lines(batch, classes.end_class)
            cost = np.append(0.0, np.cumsum(model.log_step[line[:-1], line[1:]] - classes.log_size[line[1:]]))
            steps = np.diff(np.append(0.0, cost[ends]))
            n_tokens, base = batch.column("n_tokens").to_numpy(), batch.column("base_score").to_numpy()
            score = base - n_tokens * classes.log_base + steps
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("n_tokens"), batch.column("n_known"), pa.array(np.full(batch.num_rows, classes.n)), pa.array(base), pa.array(score)], names=[key, *names]
            )

    kinds = (T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([lines.schema[key], *(T.StructField(c, t) for c, t in zip(names, kinds))])
    return lines.select(key, "n_tokens", "n_known", "base_score", "line", "found").mapInArrow(run, schema)


def train_class_model(docs: DataFrame, text: str = "text", head: int = HEAD) -> tuple[ClassModel, DataFrame]:
    """The model, and the stored table of words that its lookup table need not list."""
    classes, words = fit_word_classes(docs, text, head)
    numbered = docs.select(F.monotonically_increasing_id().alias("k"), F.col(text).alias("text"))
    return fit_steps(class_lines(numbered, classes, words, "k", "text"), classes), words


def score_documents(docs: DataFrame, model: ClassModel, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_tokens, n_known, train_tokens, base_score and score."""
    return score_lines(class_lines(docs, model.classes, words, key, text), model, key)
