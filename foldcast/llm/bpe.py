"""BPE encoding and decoding with a tokenization automaton compiled from the merge list.

The automaton reads tokens. It starts with one arc per base symbol out of every state; each merge ``(a, b)`` in turn adds a
gadget: the state behind ``a`` loses its arc ``b``, and a new arc ``ab`` leads from every state that still has ``a`` to where
``b`` led. A state is therefore known by the label of the arc into it, and a word has one path of arcs: its encoding.

Defined results: NULL and empty texts have no ids; special tokens in a text are encoded as themselves; repeated rows repeat.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from foldcast.llm.shared import need_columns
from foldcast.llm.words import release_memory

# White space and pieces of a text, as the vocabulary file states them.
WHITE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
ROWS = 200  # texts encoded together
KNOWN_WORDS = 50_000  # words kept with their ids in a task, and as many that were met before those; only speed depends on it


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is visible, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class TokenAutomaton:
    """States and arcs compiled from ranked merges; the arc table is filled as pairs of labels are met."""

    def __init__(self, labels: dict[str, int], merges: list[tuple[str, str]], specials: dict[str, int]) -> None:
        self.labels = {i: s for s, i in {**labels, **specials}.items()}
        self.ids = labels
        self.specials = specials
        self.born = dict.fromkeys(labels.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.closed: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, labels[a], labels[b], labels[a + b])
        self.arcs: dict[tuple[int, int], bool] = {}
        self.reach: dict[str, int] = {}  # by up to three first symbols: the longest label that starts so
        for s in labels:
            size = len(s.removesuffix(WORD_END))
            for k in range(1, min(3, size) + 1):
                self.reach[s[:k]] = max(size, self.reach.get(s[:k], 0))
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.letters = byte_letters()
        self.limit = KNOWN_WORDS
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _gadget(self, rank: int, a: int, b: int, ab: int) -> None:
        self.closed[a, b] = rank
        self.born[ab] = rank
        self.parts[ab] = (a, b)

    def has_arc(self, state: int, label: int) -> bool:
        """Whether ``label`` leaves the state behind ``state`` once every gadget is in place."""
        known = self.arcs.get((state, label))
        if known is None:
            known = self.arcs[state, label] = self._built(state, label)
        return known

    def _built(self, x: int, y: int) -> bool:
        until = len(self.parts) + 1
        while True:
            if self.closed.get((x, y), until) < until:
                return False
            bx, by = self.born[x], self.born[y]
            if bx < 0 and by < 0:
                return True
            if by >= bx:  # the arc y was added where its first part still led on from x
                y, until = self.parts[y][0], by + 1
            else:  # the state behind x is a copy of the one behind its last part
                x, until = self.parts[x][1], bx

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Labels of the one path that reads a piece, longest arcs first.

        A prefix has one path, so a position from which the rest can't be read is not entered again.
        """
        symbols = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        n, reach, ids, arcs = len(symbols), self.reach, self.ids, self.arcs
        whole = ids.get(symbols + WORD_END)
        if whole is not None:
            return (whole,)
        path, ends, dead = [], [0], set()
        upto = min(n - 1, reach.get(symbols[:3]) or 2)
        while True:
            at = ends[-1]
            state = path[-1] if path else None
            while upto > at:
                label = ids.get(symbols[at:upto] if upto < n else symbols[at:] + WORD_END)
                if label is not None and upto not in dead:
                    if state is None:
                        break
                    open_arc = arcs.get((state, label))
                    if open_arc if open_arc is not None else self.has_arc(state, label):
                        break
                upto -= 1
            if upto > at:
                path.append(label)
                if upto == n:
                    return tuple(path)
                ends.append(upto)
                upto = min(n, upto + (reach.get(symbols[upto : upto + 3]) or 2))
            else:
                dead.add(at)
                path.pop()
                upto = ends.pop() - 1

    def _keep(self, word: str, found: tuple[int, ...]) -> tuple[int, ...]:
        if len(self.words) >= self.limit:
            self.older, self.words = self.words, {}
            if len(self.arcs) > 4 * self.limit:
                self.arcs = {}
        self.words[word] = found
        return found

    def forget(self) -> None:
        """Give the memory of met words and arcs back."""
        self.words, self.older, self.arcs = {}, {}, {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        # A piece is also a word on its own: lower case, with nothing to cut.
        found = self.words.get(piece)
        if found is None:
            found = self.older.get(piece)
            found = self._keep(piece, self.encode_piece(piece) if found is None else found)
        return found

    def encode_word(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            if word.isascii():
                lowered = word.lower()
            else:  # letter by letter, as lower-casing here knows no neighbours
                lowered = "".join([c.lower() for c in unicodedata.normalize("NFC", word)])
            if lowered.isalpha():
                found = self._piece(lowered)
            elif lowered[:-1].isalpha() and lowered[-1] in ".,":
                found = self._piece(lowered[:-1]) + self._piece(lowered[-1])
            else:
                found = tuple([i for p in PIECES.findall(lowered) for i in self._piece(p)])
        return self._keep(word, found)

    def encode(self, text: str) -> array:
        out = array("i")
        at = 0
        if self.special_pattern and "<|" in text:
            for m in self.special_pattern.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(self.specials[m.group()])
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def _plain(self, text: str, out: array) -> None:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        words = WHITE.split(text) if odd else text.split()
        # Words met before are looked up all at once; only the others are encoded one by one.
        found = list(map(self.words.get, words))
        if None in found:
            known, encode_word = self.words, self.encode_word
            for i in [i for i, ids in enumerate(found) if ids is None]:
                found[i] = known.get(words[i]) or encode_word(words[i])
                known = self.words
        out.extend(chain.from_iterable(found))

    def decode(self, ids) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=4)
def load_automaton(path: str) -> TokenAutomaton:
    """Compile a vocabulary file; kept by each Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return TokenAutomaton(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})


def _ids(rows: list[array]) -> pa.Array:
    edges = np.cumsum([0, *map(len, rows)])
    values = np.concatenate([np.frombuffer(r, dtype=np.int32) for r in rows if r] or [np.zeros(0, dtype=np.int32)])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))


def _with_columns(df: DataFrame, added: dict[str, T.DataType], vocabulary: str, fn, known_words: int = KNOWN_WORDS) -> DataFrame:
    """``df`` with more columns, computed batch by batch; columns of these names are replaced."""
    kept = df.drop(*added)
    names, schema = kept.columns, T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load_automaton(vocabulary)
        automaton.limit = known_words
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):  # few texts are open as Python values at a time
                part = batch.slice(first, ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *fn(automaton, part)], names=schema.names)
        automaton.forget()
        release_memory()

    return df.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", decoded: bool = False, known_words: int = KNOWN_WORDS) -> DataFrame:
    """``docs`` with ``ids``: the token ids of each whole text, without markers around it; also what they decode to, if asked.

    ``known_words`` bounds the words that a task keeps with their ids, at some 400 bytes each; only speed depends on it.
    """
    need_columns(docs, text)

    def fn(automaton: TokenAutomaton, batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [automaton.encode(t or "") for t in batch.column(text).to_pylist()]
        return [_ids(rows), pa.array([automaton.decode(r) for r in rows], pa.string())] if decoded else [_ids(rows)]

    added: dict[str, T.DataType] = {"ids": T.ArrayType(T.IntegerType())}
    return _with_columns(docs, {**added, "decoded": T.StringType()} if decoded else added, vocabulary, fn, known_words)


def decode_documents(docs: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``: the labels of the arcs along each row of ids, special ones included."""
    need_columns(docs, ids)

    def fn(automaton: TokenAutomaton, batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([automaton.decode(r or ()) for r in batch.column(ids).to_pylist()], pa.string())]

    return _with_columns(docs, {"decoded": T.StringType()}, vocabulary, fn)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, decode, and reduce both to a count and two digests per document; one output row per input row."""
    both = encode_documents(docs.select("doc_id", "text"), vocabulary, decoded=True, known_words=200_000)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
