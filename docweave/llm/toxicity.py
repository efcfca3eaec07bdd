"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text and normalised by length.

Folding lower-cases, maps homoglyphs and accents to base letters, and inside words reads digits and signs that stand
for letters. The lexicon is learned from labelled documents: whole words and word beginnings (families of forms of a
stem) that toxic documents hold far more often than others, weighted by their log odds. Exception phrases are pairs
of words, one of them in the lexicon, that mostly clean documents hold; they take the match back. The score is a
logistic function of the weights found, of their density and of their number.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, scratch, session, texts

FOLDS, HELD_OUT = 4, 2
#: Bound of the labelled rows that the lexicon and the scale are fitted on.
SAMPLE = 24_000
#: Toxic documents of the sample with an entry, at least; and the share of toxic ones among those that hold it.
LEAST, PRECISION = 3, 0.9
STEM = range(4, 8)
THRESHOLD = 0.3
#: Greatest score of a text without a match.
NO_MATCH = 0.2

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁɡαεοικνρτυɑ", "aeopcyxijshdgaeoiknptua", strict=True))
DIGITS = dict(zip("01345789@$!|", "oieastbgasii", strict=True))

_MIXED = re.compile(r"[^\W_]*(?:[a-z][01345789@$!|]+(?=[a-z])|(?<![^\W_])[01345789@$]+[a-z]{2})(?:[@$!|]*[a-z0-9])*")
#: Every mixed word has a sign or digit before a letter.
_HINT = re.compile(r"[01345789@$!|][a-z]")
_BREAK = re.compile(r"[\W_]+")


@cache
def _letters() -> dict:
    """Characters up to U+1EFF and full-width forms to their base letters; marks go."""
    table: dict = {ord(a): b for a, b in HOMOGLYPHS.items()}
    for c in [*range(0xC0, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        table[c] = base
    for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD):
        table[c] = None
    return table


def _read_digits(m: re.Match) -> str:
    return "".join(DIGITS.get(c, c) for c in m[0])


def _spell(text: str) -> str:
    """Read digits and signs as letters in those words that mix them; other words are not looked at twice."""
    out, at = [], 0
    for m in _HINT.finditer(text):
        a, b = m.start(), m.end()
        if a < at:
            continue
        while a > at and (text[a - 1].isalnum() or text[a - 1] in "@$!|"):
            a -= 1
        while b < len(text) and (text[b].isalnum() or text[b] in "@$!|"):
            b += 1
        out += [text[at:a], _MIXED.sub(_read_digits, text[a:b])]
        at = b
    return "".join(out) + text[at:] if out else text


def fold(text: str) -> str:
    """Folded words, each with a space before, and one space at the end; no words: one space.

    The sign 1 stands for both i and l, so these two are one letter in folded text.
    """
    text = text.lower()
    if not text.isascii():
        text = text.translate(_letters())
    text = _spell(text)
    return f" {_BREAK.sub(' ', text).strip()} ".replace("  ", " ").replace("l", "i")


def terms(folded: str) -> set[str]:
    """Entries that a folded text could match: words and word beginnings."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEM if len(w) > k}


class Lexicon:
    """Weights of entries (' word ' or ' beginning') and exception phrases (' two words ')."""

    def __init__(self, weights: dict[str, float], phrases: set[str], scale=(0.0, 0.0, 0.0, 0.0)):
        import ahocorasick

        self.weights, self.phrases, self.scale = weights, phrases, scale
        self.tree = ahocorasick.Automaton()
        for entry in {*weights, *phrases}:
            self.tree.add_word(entry, entry)
        if weights or phrases:
            self.tree.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.phrases, self.scale)

    def matches(self, folded: str) -> dict[int, str]:
        """Place of a word to the weightiest entry there; words inside an exception phrase don't count."""
        found: dict[int, str] = {}
        spared = []
        if not (self.weights or self.phrases):
            return found
        for end, entry in self.tree.iter(folded):
            at = end - len(entry) + 1
            if entry in self.phrases:
                spared.append((at, end))
            if entry in self.weights and (at not in found or self.weights[entry] > self.weights[found[at]]):
                found[at] = entry
        for a, b in spared:
            for at in [k for k in found if a <= k < b]:
                del found[at]
        return found

    def features(self, folded: str) -> tuple[float, float, float]:
        """Sum of weights, the sum per square root of the words, and the number of matches, all damped."""
        found = self.matches(folded)
        total = sum(self.weights[x] for x in found.values())
        return log1p(total), log1p(10 * total / (folded.count(" ") + 4) ** 0.5), log1p(len(found))

    def score(self, text: str | None) -> float:
        """0 to 1. A text without a match stays below THRESHOLD, however common toxic documents are in the sample."""
        bias, *by = self.scale
        found = self.features(fold(text or ""))
        x = bias + sum(w * f for w, f in zip(by, found, strict=True))
        chance = 1 / (1 + exp(-max(-30.0, min(30.0, x))))
        return chance if any(found) else min(chance, NO_MATCH)


def fold_of() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most about ``sample`` labelled documents (by a hash of their ids) outside the held-out fold: text, toxic.

    Labels without a doc_id or mark are left out, repeated labels count once (toxic if any says so).
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.withColumnRenamed("id", "doc_id").filter(fold_of() != HELD_OUT)
    n = marked.count()
    if n > sample:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    # at most about ``sample`` rows of two numbers, whatever the tables' size
    return texts(docs).join(F.broadcast(marked), "doc_id").select("text", "toxic")


def _count(pick, toxic_only: bool):
    """Documents of each class per entry; pick: only these entries, a broadcast set."""

    def run(batches):
        wanted = None if pick is None else pick.value
        for batch in batches:
            held: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if mark or not toxic_only:
                    found = terms(fold(text))
                    held[int(bool(mark))].update(found if wanted is None else found & wanted)
            entries = [*held[0].keys() | held[1].keys()]
            yield pa.record_batch([pa.array(entries, pa.string()), *(pa.array([held[k][e] for e in entries], pa.int64()) for k in (1, 0))], names=["entry", "toxic", "clean"])

    return run


def _phrases(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            held: Counter = Counter()
            for text, mark in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded, found = fold(text), set()
                for at in lexicon.matches(folded):
                    end = folded.index(" ", at + 1)
                    before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
                    if before >= 0:
                        found.add(folded[before : end + 1])
                    if after >= 0:
                        found.add(folded[at : after + 1])
                held.update((p, int(bool(mark))) for p in found)
            yield pa.record_batch([pa.array([p for p, _ in held], pa.string()), pa.array([m for _, m in held], pa.int32()), pa.array(held.values(), pa.int64())], names=["phrase", "toxic", "n"])

    return run


def _measure(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            rows = [(*lexicon.features(fold(t)), float(bool(y))) for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * 4, names=["a", "b", "c", "y"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Newton steps for a weighted logistic regression with an intercept in front, which is not penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Learn entries, weights, exception phrases and scale from a bounded sample of the labelled documents.

    Every entry with enough evidence is kept; the sample's bound is the only one. Without a toxic label the lexicon is
    empty and every score the same, near 0. Labels of documents that aren't there, repeated labels, nulls in either table and
    columns of other names change nothing; empty and repeated documents and very long ones are rows of the sample.
    """
    spark = session(docs)
    rows = scratch(training_rows(docs, labels, sample), "labelled")
    sizes = {int(bool(r["toxic"])): r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return Lexicon({}, set(), (-4.0, 0.0, 0.0, 0.0))
    counted = "entry string, toxic long, clean long"
    # candidates from the sample's toxic documents only; then both classes' documents that hold them
    many = scratch(rows.mapInArrow(_count(None, True), counted).groupBy("entry").agg(F.sum("toxic").alias("n")).filter(F.col("n") >= LEAST), "candidates")
    toxic, clean = sizes[1], sizes.get(0, 0)
    # so many more toxic than clean documents that chance makes less than half an entry of all that were tried
    rate = (toxic + 0.5) / (toxic + clean + 1)
    surplus = min(log(2 * max(1, many.count())) / log(1 / rate), toxic / 2)
    pick = spark.sparkContext.broadcast({r["entry"] for r in many.filter(F.col("n") >= surplus).select("entry").collect()})
    held = rows.mapInArrow(_count(pick, False), counted).groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter(F.col("t") >= PRECISION * (F.col("t") + F.col("c"))).collect()
    weights = {r["entry"]: log((r["t"] + 0.5) / (toxic + 1)) - log((r["c"] + 0.5) / (clean + 1)) for r in held if r["t"] - r["c"] >= surplus}
    weights = {k: w for k, w in sorted(weights.items()) if w > 0}
    seen = {r["entry"]: r["t"] for r in held}
    # a beginning stands for a family of forms: it goes if one longer entry covers it, else all longer ones go
    shares: dict[str, int] = {}
    for k in weights:
        for n in STEM:
            if len(k) > n + 1:
                shares[k[: n + 1]] = max(shares.get(k[: n + 1], 0), seen[k])
    weights = {k: w for k, w in weights.items() if k[-1] == " " or shares.get(k, 0) < 0.95 * seen[k]}
    weights = {k: w for k, w in weights.items() if not any(len(k) > n + 1 and k[: n + 1] in weights for n in STEM)}
    lexicon = Lexicon(weights, set())
    found = rows.mapInArrow(_phrases(lexicon), "phrase string, toxic int, n long").groupBy("phrase").agg(
        F.sum(F.expr("if(toxic = 1, n, 0)")).alias("t"), F.sum(F.expr("if(toxic = 1, 0, n)")).alias("c")
    )
    phrases = {r["phrase"] for r in found.filter("c >= 2 and c > 2 * t").collect()}
    lexicon = Lexicon(weights, phrases)
    x = np.array([tuple(r) for r in rows.mapInArrow(_measure(lexicon), "a double, b double, c double, y double").collect()])
    y = x[:, 3]
    scale = fit_logistic(x[:, :3], y, np.ones(len(y)))
    return Lexicon(weights, phrases, tuple(float(w) for w in scale))


def _score(held, name: str):
    def run(batches):
        lexicon = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([lexicon.score(t) for t in batch.column("text").to_pylist()], pa.float64())],
                names=[*batch.schema.names, name],
            )

    return run


def score_documents(docs: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """The documents (all columns) and last the score: 0 to 1, from the text alone. Null and empty texts score like a text
    without matches, very long ones as a whole; every row is scored, repeated rows and null doc_ids too; an empty table gives an
    empty result. Where the documents have a column ``name``, the score's has underscores after it.

    The lexicon is broadcast; it holds no more entries than the bounded sample gave evidence for.
    """
    spark = session(docs)
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    held = spark.sparkContext.broadcast(lexicon)
    return docs.mapInArrow(_score(held, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op3_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    scored = score_documents(texts(docs), learn(docs, labels))
    return scored.select("doc_id", (F.coalesce(fold_of(), F.lit(-1)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, same columns, without those that score THRESHOLD or more.

    Null and empty texts have no match and stay; a very long text is scored whole; repeated rows score and stay or go alike;
    columns of any name are passed on; labels as in learn(); an empty table gives an empty result.
    """
    lexicon = learn(docs, labels)
    clean = score_documents(packed(docs), lexicon).filter(F.col("score") < THRESHOLD)
    return clean.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
