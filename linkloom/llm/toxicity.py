"""Toxicity: a learned weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import each, least_hashes, per_row, share, small_batches, tidy
from linkloom.session import written

#: Labelled documents learned from, of each label at most, and their greatest length
#: in characters. Both bound what one task and the driver get.
LEARN_DOCS, LEARN_CHARS = 6000, 60_000
#: A text is called toxic from this score on.
THRESHOLD = 0.3
#: Entries of the lexicon and exception phrases, each at most.
ENTRIES = 20_000
#: An entry is a word or the start of a word of so many letters,
SHORTEST, LONGEST = 4, 8
#: found in so many toxic documents at least, so many times as often (by words) as in others.
LEAST_DOCS, LEAST_RATIO = 5, 3.0
#: An exception is a phrase around an entry found in so many clean documents, no more often in toxic ones.
EXCEPTION_DOCS = 5

#: Letters of other scripts, digits and signs that stand for Latin letters.
#: ``i``, ``l`` and their stand-ins are one letter, since ``1`` and ``|`` stand for both.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "l": "i",
}
SUBSTITUTES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i",
}


class _Fold(dict):
    """Lower case, stand-ins replaced, accents off; what is no letter or digit is a space."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFKD", char.lower()) if not unicodedata.combining(c))
        folded = "".join(HOMOGLYPHS.get(c, c) for c in bare)
        self[code] = folded = "".join(c if c.isalnum() else " " for c in folded) if folded else ""
        return folded


_FOLD = _Fold({ord(k): v for k, v in SUBSTITUTES.items()})


def folded_words(text: str | None) -> list[str]:
    """Folded words. Signs that end a word are not taken for letters."""
    if not text:
        return []
    return [w for w in " ".join(w.rstrip("!|$@") for w in text.split()).translate(_FOLD).split()]


def _starts(word: str) -> Iterator[str]:
    """The entries that a word may stand for: its starts, and itself as a whole."""
    for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
        yield f" {word[:n]}"
    if len(word) >= 3:
        yield f" {word} "


@dataclass
class Lexicon:
    """Entries with weights, and how weights and length make a score."""

    weights: dict[str, float]
    exceptions: set[str]
    coefficients: np.ndarray

    def __post_init__(self):
        self._automaton = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            self._automaton.add_word(entry, (len(entry), weight))
        if self.weights:
            self._automaton.make_automaton()

    def matches(self, words: list[str]) -> list[tuple[int, float]]:
        """(word, weight) of every word that an entry starts; the longest entry counts.

        A word is passed over when it is an exception, alone or with either neighbour.
        """
        if not self.weights or not words:
            return []
        found: dict[int, tuple[int, float]] = {}
        line = " " + "  ".join(words) + " "
        starts, at = [], 0
        hits = list(self._automaton.iter(line))
        if not hits:
            return []
        for word in words:
            starts.append(at)
            at += len(word) + 2
        places = np.searchsorted(np.array(starts), [end - size + 1 for end, (size, _) in hits], side="right") - 1
        for place, (_, (size, weight)) in zip(places.tolist(), hits):
            if size > found.get(place, (0, 0.0))[0]:
                found[place] = size, weight
        return [(i, w) for i, (_, w) in sorted(found.items()) if not self._excepted(words, i)]

    def _excepted(self, words: list[str], i: int) -> bool:
        return bool(self.exceptions) and any(phrase in self.exceptions for phrase in _phrases(words, i))

    def features(self, text: str | None) -> np.ndarray:
        """What a score is made of: the weights found by word of text, in all, and how many differ."""
        words = folded_words(text)
        found = self.matches(words)
        total = sum(w for _, w in found)
        kinds = len({words[i] for i, _ in found})
        n = max(1, len(words))
        return np.array([1.0, np.log1p(100 * total / n), total / np.sqrt(n), np.log1p(total), np.log1p(kinds), np.log1p(n)])

    def score(self, text: str | None) -> float:
        """Likelihood, from 0 to 1, that a text is toxic."""
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.coefficients, -30, 30))))


def _phrases(words: list[str], i: int) -> Iterator[str]:
    yield words[i]
    if i:
        yield f"{words[i - 1]} {words[i]}"
    if i + 1 < len(words):
        yield f"{words[i]} {words[i + 1]}"


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curvature, gradient)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def entry_counts(texts: Iterable[str], labels: Iterable[int]) -> Counter:
    """``(entry, label) -> documents`` and ``(entry, label + 2) -> words``."""
    counts: Counter = Counter()
    for text, label in zip(texts, labels):
        own = Counter(e for w in folded_words(text) for e in _starts(w))
        counts.update({(e, label): 1 for e in own})
        counts.update({(e, label + 2): n for e, n in own.items()})
    return counts


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """A lexicon from the labelled documents that are not held out.

    Of each label up to ``LEARN_DOCS`` documents of up to ``LEARN_CHARS``
    characters are learned from, those with the smallest hashes of key and text;
    no score comes from other columns. Repeated rows are one document, whose
    weight in the score's fit is how often it occurs. Contradicting labels of one document count
    as toxic; null labels, keys and texts are left out. Without documents of
    both labels the lexicon is empty and every score is the share of toxic labels (0 without any).
    """
    small_batches(spark)
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    marked = marked.agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    usable = docs.where(F.coalesce(~held_out & (F.length(text) <= LEARN_CHARS), F.lit(False)))
    usable = usable.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), F.col(text).alias("text"))
    # Copies meet before the labels do: a row repeated any number of times is one row of the join.
    known = usable.groupBy("_key", "_text").agg(F.count("*").alias("copies")).join(marked, "_key")
    known = written(known.withColumn("u", F.xxhash64("_key", "_text")), "labelled-keys")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.sum("copies").alias("n")).collect()}
    share_toxic = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return Lexicon({}, set(), np.array([30.0 if share_toxic else -30.0, 0, 0, 0, 0, 0]))
    # At most twice LEARN_DOCS keys: small enough to broadcast, so that no text is shuffled to meet them.
    chosen = written(least_hashes(known, "label", LEARN_DOCS, ["_key", "_text"]).select("_key", "_text", "label", "copies"), "chosen")
    sample = usable.join(F.broadcast(chosen), ["_key", "_text"]).groupBy("_key", "_text", "label", "copies").agg(F.first("text").alias("text"))
    sample = written(sample.select("label", "copies", "text").repartition(64), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = entry_counts(batch.column("text").to_pylist(), batch.column("label").to_pylist())
            entries, kinds = zip(*counts) if counts else ((), ())
            yield pa.record_batch(
                [pa.array(entries, pa.string()), pa.array(kinds, pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["entry", "kind", "n"],
            )

    words = {r["label"]: r["n"] for r in sample.groupBy("label").agg((F.sum(F.size(F.split("text", r"\s+")))).alias("n")).collect()}
    kind = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    counted = sample.mapInArrow(tidy(count), "entry string, kind int, n bigint").groupBy("entry").agg(
        kind(1).alias("docs"), ((kind(3) + 0.5) / words[1] / ((kind(2) + 0.5) / words[0])).alias("ratio")
    )
    entries = counted.where((F.col("docs") >= LEAST_DOCS) & (F.col("ratio") >= LEAST_RATIO))
    entries = entries.orderBy(F.col("docs").desc(), F.col("ratio").desc(), "entry").limit(ENTRIES).collect()
    weights = {r["entry"]: float(np.log(r["ratio"])) for r in entries}

    # Phrases around entries that are as usual in clean documents.
    shared = share(spark, weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared(), set(), np.zeros(6))
        for batch in batches:
            counts: Counter = Counter()
            for value, own in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = folded_words(value)
                counts.update({(p, own) for i, _ in lexicon.matches(found) for p in _phrases(found, i)})
            names, kinds = zip(*counts) if counts else ((), ())
            yield pa.record_batch(
                [pa.array(names, pa.string()), pa.array(kinds, pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["entry", "kind", "n"],
            )

    taken_docs = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    around = sample.mapInArrow(tidy(phrases), "entry string, kind int, n bigint").groupBy("entry").agg(kind(0).alias("clean"), kind(1).alias("toxic"))
    rare = F.col("toxic") / taken_docs[1] <= F.col("clean") / taken_docs[0]
    excepted = around.where((F.col("clean") >= EXCEPTION_DOCS) & rare).orderBy(F.col("clean").desc(), "entry").limit(ENTRIES)
    exceptions = {r["entry"] for r in excepted.collect()}

    lexicon = Lexicon(weights, exceptions, np.zeros(6))
    final = share(spark, (weights, exceptions, lexicon.coefficients))

    def start():
        lexicon = Lexicon(*final())
        return lambda texts: pa.array([lexicon.features(t).tolist() for t in each(texts)], pa.list_(pa.float64()))

    rows = sample.select("label", "copies", per_row(start, "array<double>")("text").alias("x")).collect()
    for used in (shared, final):
        used.release()
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    # The sample holds the labels in other proportions than the documents do.
    copies = np.array([r["copies"] for r in rows], float)
    weight = copies * np.where(y == 1, sizes[1] / copies[y == 1].sum(), sizes[0] / copies[y == 0].sum())
    lexicon.coefficients = fit(x, y, weight * len(y) / weight.sum())
    return lexicon


def score(spark: SparkSession, docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in column ``name``.

    Null and empty texts have the score of a text without matches. All rows and
    columns stay; a column of that name is replaced. The lexicon is broadcast; it
    is bounded by ``ENTRIES``. Nothing is shuffled.
    """
    small_batches(spark)
    shared = share(spark, (lexicon.weights, lexicon.exceptions, lexicon.coefficients))

    def start():
        lexicon = Lexicon(*shared())
        return lambda texts: pa.array([lexicon.score(t) for t in each(texts)], pa.float64())

    return docs.withColumn(name, per_row(start, "double")(F.col(text)))
