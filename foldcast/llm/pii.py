"""Personal data: four rules, and contextual extraction bootstrapped from what they find.

Findings of the rules are the seed. Each identifier-like token (it holds digits or an at sign) is an instance, seen under lexical
patterns: the words before it, the words on both sides, and the word before with the token's shape. Instances and patterns form a
graph of counted edges; in each round a pattern scores the share of trusted instances among all it occurs with, and an instance
the chance that not all its patterns err. Confident patterns then mark identifiers that no rule knows.

Defined results: NULL and empty texts have no spans; without seeds nothing is added; repeated rows repeat; spans count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foldcast.llm.shared import need_columns, stored
from foldcast.llm.spans import Span, joined, overlaps, sha256_hex

# The rules and their limits.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "context")

INSTANCE = re.compile(r"[A-Za-z0-9_.%+@-]*[0-9@][A-Za-z0-9_.%+@-]*")
LEAST_INSTANCE = 6  # shorter tokens with digits are numbers in running text
ROUNDS, LEAST_SEEDS, LEAST_SCORE = 3, 3, 0.6


def _emails(text: str) -> list[Span]:
    """Each at sign with the local part that reaches back from it, as a scan from the left would match them."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        start = at
        while m and start > free and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            out.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(free, at + 1))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the rules find, leftmost and without overlap per kind; matches that fail a limit go without a second try."""
    spans = _emails(text)
    if not any(c in text for c in "0123456789"):
        return spans
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        spans += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return spans


def _word(token: str) -> str:
    return "".join("0" if c in "0123456789" else c for c in token.lower().strip(".,;:!?()\"'"))


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", "".join("d" if c in "0123456789" else "a" if c.isalpha() else c for c in token))


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of the token at start:end."""
    before = [_word(w) for w in text[max(0, start - 80) : start].split()[-2:]]
    after = [_word(w) for w in text[end : end + 40].split()[:1]]
    left1, left2, right = (before[-1:] or ["^"])[0], " ".join(before) or "^", (after or ["$"])[0]
    return [f"before {left2}", f"around {left1} _ {right}", f"shape {left1} {_shape(text[start:end])}"]


def instances(text: str, base: list[Span]) -> list[tuple[int, int, bool]]:
    """Identifier-like tokens of a text, and whether a rule found each."""
    out = [(s, e, True) for s, e, _ in base]
    for m in INSTANCE.finditer(text):
        if m.end() - m.start() >= LEAST_INSTANCE and not overlaps(m.start(), m.end(), base):
            out.append((m.start(), m.end(), False))
    return out


_COUNTS = ["n_email", "n_ip", "n_card", "n_phone"]
_FOUND = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("seed", T.BooleanType()),
    T.StructField("instance", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType())),
]))
_FOUND_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, digest and spans of the rules, and ``found``: every instance with its patterns."""
    need_columns(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v or "" for v in batch.column(text).to_pylist()]
            base = [base_spans(v) for v in texts]
            found = [[{"start": s, "end": e, "seed": seed, "instance": v[s:e], "patterns": patterns(v, s, e)} for s, e, seed in instances(v, b)] for v, b in zip(texts, base)]
            cols = [pa.array([sum(k == kind for _, _, k in b) for b in base], pa.int64()) for kind in KINDS[:4]]
            written = [joined(b, KINDS) for b in base]
            cols += [pa.array(list(map(sha256_hex, written)), pa.string()), pa.array(written, pa.string()), pa.array(found, _FOUND_ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *cols], names=[key, *_COUNTS, "base_sha256", "base", "found"])

    fields = [T.StructField(n, T.LongType()) for n in _COUNTS] + [T.StructField("base_sha256", T.StringType()), T.StructField("base", T.StringType()), T.StructField("found", _FOUND)]
    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], *fields]))


def confident_patterns(found: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """(pattern, score) of patterns that hold, scored on the pattern-instance graph.

    Edges are counted with map-side sums, so a pattern or an instance that occurs everywhere is one row per task. A pattern
    needs ``least_seeds`` distinct trusted instances and a score of ``least_score``.
    """
    edges = stored(
        found.select("seed", F.xxhash64("instance").alias("instance"), F.explode("patterns").alias("pattern"))
        .groupBy("instance", "pattern").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")),
        "pii-edges",
    )
    scores = edges.select("instance", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("trust")).groupBy("instance").agg(F.max("trust").alias("trust"))
    for i in range(rounds):
        rated = edges.join(scores, "instance").groupBy("pattern").agg(
            (F.sum(F.col("n") * F.col("trust")) / F.sum("n")).alias("score"), F.sum(F.when(F.col("trust") >= 0.5, 1).otherwise(0)).alias("support")
        )
        held = stored(rated.where((F.col("support") >= least_seeds) & (F.col("score") >= least_score)).select("pattern", "score"), f"pii-patterns-{i}")
        if i + 1 < rounds:
            miss = F.sum(F.log(F.greatest(F.lit(1e-6), 1.0 - F.coalesce("score", F.lit(0.0)))))
            grown = edges.join(held, "pattern", "left").groupBy("instance").agg(F.max("seed").alias("seed"), miss.alias("miss"))
            scores = stored(grown.select("instance", F.when(F.col("seed"), 1.0).otherwise(1.0 - F.exp("miss")).alias("trust")), f"pii-trust-{i}")
    return held


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of each rule, digest of their spans, and all spans with those found by context."""
    scanned = stored(scan(docs, key, text).withColumn("row_id", F.monotonically_increasing_id()), "pii-scan")
    found = scanned.select("row_id", F.explode("found").alias("f")).select("row_id", "f.*")
    held = confident_patterns(found)
    loose = found.where(~F.col("seed")).select("row_id", "start", "end", F.explode("patterns").alias("pattern"))
    hits = loose.join(held, "pattern").select("row_id", F.struct("start", "end", F.lit("context").alias("kind")).alias("span"))
    added = hits.groupBy("row_id").agg(F.collect_set("span").alias("added"))  # at most a document's own instances
    parts = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(
        F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end"), F.split(x, ":")[0].alias("kind")))
    ranked = F.array_sort(F.transform(F.concat(parts, "added"), lambda x: F.struct(
        x["start"].alias("start"), F.array_position(F.lit(list(KINDS)), x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    written = F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scanned.drop("found").join(added, "row_id", "left").select(
        key, *_COUNTS, "base_sha256",
        F.when(F.col("added").isNull(), F.col("base")).otherwise(written).alias("spans"),
        F.when(F.col("added").isNull(), 0).otherwise(F.size("added")).cast("long").alias("n_added"),
    )
