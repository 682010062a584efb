"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import HashArray, each, least_hashes, per_row, share, small_batches, tidy
from linkloom.session import written

ORDER = 4
#: Documents learned from, of each language at most, and their characters in all (the text
#: that crosses this bound is the last). Both bound what the driver gets.
LEARN_DOCS, LEARN_CHARS = 2000, 8_000_000
#: Others that calibrate rejection: documents, characters in all, and the share of a small language set aside.
CALIBRATE_DOCS, CALIBRATE_CHARS, ASIDE = 300, 2_000_000, 0.2
#: A text is rejected when its cross-entropy exceeds that of so many of its language's own texts.
REJECT_QUANTILE = 0.999
#: The confidence looks at no more than so many characters.
CONFIDENT_AT = 100
#: Positions scored at a time.
CHUNK = 1 << 20

_PAD, _SPACE = 1, 32
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _letters() -> np.ndarray:
    """Which code points are letters."""
    is_letter = np.zeros(0x110000, dtype=bool)
    is_letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return is_letter


def codes(texts: list[str], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts with one space for every other run, and each one's text.

    Each text follows ``ORDER - 1`` pads, so that no context reaches into another text.
    """
    pad = "\x01" * (ORDER - 1)
    lowered = [pad + text.lower().replace("\x01", " ") + " " for text in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, lowered), np.int64, len(texts)))
    letter = is_letter[code]
    code = np.where(letter | (code == _PAD), code, np.uint32(_SPACE))
    kept = letter | (code == _PAD)
    kept[1:] |= letter[:-1]  # the first of a run after a letter
    return code[kept], owner[kept]


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of grams given as columns of code points."""
    h = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        h = h * _MULTIPLIER + column.astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


@dataclass
class Models:
    """All languages' models of orders 1 to ``ORDER``.

    ``grams[n]`` holds the log2 probabilities of every n-gram that any language
    has seen, a column a language; ``contexts[n]`` the log2 weights of backing
    off from order n. What no language has seen is backed off when scoring.
    """

    languages: list[str]
    grams: dict[int, HashArray]
    contexts: dict[int, HashArray]
    uniform: float
    limits: np.ndarray

    def log_probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """Row of log2 probabilities (a column a language) of each position, given its ``ORDER`` code points."""
        return self._scored(columns, ORDER)

    def _scored(self, columns: list[np.ndarray], n: int) -> np.ndarray:
        if n == 0:
            return np.full((len(columns[-1]), len(self.languages)), self.uniform, np.float32)
        place = self.grams[n].find(hashes(columns[-n:]))
        out = self.grams[n].values[place]
        missed = np.flatnonzero(place < 0)
        if len(missed):
            fewer = [column[missed] for column in columns[-n:]]
            context = self.contexts[n].find(hashes(fewer[:-1]) if n > 1 else np.zeros(len(missed), np.uint64))
            weight = np.where(context[:, None] >= 0, self.contexts[n].values[context], np.float32(0))
            out[missed] = weight + self._scored(fewer, n - 1)
        return out

    def cross_entropies(self, texts: list[str], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character by text and language, and the number of characters (0: no letter)."""
        code, owner = codes(texts, is_letter)
        bits = np.zeros((len(texts), len(self.languages)))
        length = np.zeros(len(texts))
        for at in range(ORDER - 1, len(code), CHUNK):
            end = min(len(code), at + CHUNK)
            here = np.arange(at, end)[code[at:end] != _PAD]
            rows = self.log_probabilities([code[here - k] for k in range(ORDER - 1, -1, -1)])
            own = owner[here]
            length += np.bincount(own, minlength=len(texts))
            for i in range(len(self.languages)):
                bits[:, i] -= np.bincount(own, weights=rows[:, i], minlength=len(texts))
        return bits / np.maximum(length, 1)[:, None], length


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``CHUNK`` characters; a longer text is alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > CHUNK:
            yield start, [t or "" for t in texts[start:i]]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, [t or "" for t in texts[start:]]


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from each language's ``ORDER``-grams: rows of code points, and how often each occurs."""
    languages = sorted(counts)
    alphabet = len(np.unique(np.concatenate([rows[:, -1] for rows, _ in counts.values()]))) + 1
    uniform = -float(np.log2(alphabet))
    split = lambda rows: [rows[:, i] for i in range(rows.shape[1])]

    # Per language and order: gram types (as rows) and their counts; below the highest order the
    # counts are of distinct characters that come before.
    types: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for language in languages:
        rows, n_seen = counts[language]
        types[language, ORDER] = rows, n_seen
        for n in range(ORDER - 1, 0, -1):
            rows, n_seen = np.unique(rows[:, 1:], axis=0, return_counts=True)
            types[language, n] = rows, n_seen

    models = Models(languages, {}, {}, uniform, np.full(len(languages), np.inf))
    for n in range(1, ORDER + 1):
        every = np.unique(np.concatenate([types[language, n][0] for language in languages]), axis=0)
        every_key = hashes(split(every))
        context_key = hashes(split(every[:, :-1])) if n > 1 else np.zeros(len(every), np.uint64)
        contexts = np.unique(context_key)
        lower = models._scored(split(every), n - 1)
        scores = np.empty((len(every), len(languages)), np.float32)
        backoff = np.zeros((len(contexts), len(languages)), np.float32)
        for i, language in enumerate(languages):
            rows, n_seen = types[language, n]
            seen = np.zeros(len(every))
            order = np.argsort(every_key)
            seen[order[np.searchsorted(every_key, hashes(split(rows)), sorter=order)]] = n_seen
            once, twice = (n_seen == 1).sum(), (n_seen == 2).sum()
            discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
            place = np.searchsorted(contexts, context_key)
            total = np.bincount(place, weights=seen, minlength=len(contexts))
            kinds = np.bincount(place, weights=seen > 0, minlength=len(contexts))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            direct = np.where(total[place] > 0, np.maximum(seen - discount, 0) / np.maximum(total[place], 1), 0.0)
            scores[:, i] = np.log2(direct + weight[place] * np.exp2(lower[:, i].astype(np.float64)))
            backoff[:, i] = np.log2(weight)
        models.grams[n] = HashArray.of(every_key, scores)
        models.contexts[n] = HashArray.of(contexts, backoff)
    return models


def learn(spark: SparkSession, docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Models | None:
    """Models of the languages of the documents that are not held out.

    Of each non-null language up to ``LEARN_DOCS`` documents with ``LEARN_CHARS``
    characters in all are learned from, one at least, however long; up to
    ``CALIBRATE_DOCS`` others set the language's rejection limit (none: nothing is
    rejected). They are those with the smallest hashes of key and text; repeated
    rows count once. A language all of whose texts are without letters is not learned. None without labelled documents.
    """
    small_batches(spark)
    usable = ~held_out & F.col(lang).isNotNull() & F.col(text).isNotNull()
    labelled = docs.where(F.coalesce(usable, F.lit(False)))
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), F.col(text).alias("text"))
    known = labelled.groupBy("lang", "_key", "_text").agg(F.first(F.length("text")).alias("size"))
    known = written(known.withColumn("u", F.xxhash64("_key", "_text")), "language-keys")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    ranked = least_hashes(known, "lang", LEARN_DOCS + CALIBRATE_DOCS, ["_key", "_text"]).join(sizes, "lang")
    learned = F.least(F.lit(LEARN_DOCS), F.greatest(F.lit(1), F.floor((1 - ASIDE) * F.col("n"))))
    part = F.when(F.col("rank") <= learned, 0).otherwise(1)
    before = F.sum("size").over(Window.partitionBy("lang", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    bound = F.when(F.col("part") == 0, LEARN_CHARS).otherwise(CALIBRATE_CHARS)
    chosen = ranked.withColumn("part", part).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < bound)
    # A bounded number of keys a language: no text is shuffled to meet them.
    chosen = written(chosen.select("lang", "_key", "_text", "part"), "language-chosen")
    same = ["lang", "_key", "_text"]
    sample = labelled.join(F.broadcast(chosen), same).groupBy(*same, "part").agg(F.first("text").alias("text"))
    sample = written(sample.select("lang", "text", "part"), "language-sample")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = _letters()
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = list(each(batch.column("text")))
            for name in sorted(set(langs)):
                for _, group in _groups([t for t, own in zip(texts, langs) if own == name]):
                    code, _ = codes(group, is_letter)
                    here = np.arange(ORDER - 1, len(code))[code[ORDER - 1 :] != _PAD]
                    rows = np.stack([code[here - k] for k in range(ORDER - 1, -1, -1)], axis=1)
                    _, first, n = np.unique(hashes(list(rows.T)), return_index=True, return_counts=True)
                    data = [row.tobytes() for row in rows[first]]
                    yield pa.record_batch([[name] * len(n), pa.array(data, pa.binary()), n.astype(np.int64)], names=["lang", "gram", "n"])

    counted = sample.where("part = 0").select("lang", "text").mapInArrow(tidy(grams), "lang string, gram binary, n bigint")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    rows = np.frombuffer(b"".join(table.column("gram").to_pylist()), np.uint32).reshape(-1, ORDER)
    n_seen = table.column("n").to_numpy()
    counts = {name: (rows[langs == name], n_seen[langs == name]) for name in sorted(set(langs))}
    if not counts:
        return None
    models = kneser_ney(counts)

    aside = sample.where("part = 1").select("lang", "text").toPandas()
    is_letter = _letters()
    for i, name in enumerate(models.languages):
        own = aside.loc[aside["lang"] == name, "text"].tolist()
        if own:
            bits, length = models.cross_entropies(own, is_letter)
            if (length > 0).any():
                models.limits[i] = np.quantile(bits[length > 0, i], REJECT_QUANTILE)
    return models


def identify(spark: SparkSession, docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected`` for each whole text.

    The prediction is the language of the lowest cross-entropy per character
    (ties: the first by name), ``und`` for null texts, texts without a letter and
    without models. ``score`` is the posterior of that language over as many
    characters as count (0 for ``und``). ``rejected`` marks texts that even the
    best language fits worse than nearly all of its own. All rows and columns
    stay; columns of these names are replaced. The models are broadcast; the
    bounded sample bounds their size. Nothing is shuffled.
    """
    small_batches(spark)
    shared = share(spark, models)

    def start():
        models, is_letter = shared(), _letters()
        fields = [("lang", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("rejected", pa.bool_())]

        def predict(array: pa.Array) -> pa.Array:
            texts, rows = array.to_pylist(), []
            for _, group in _groups(texts):
                if models is None:
                    rows += [("und", 0.0, None, True)] * len(group)
                    continue
                bits, length = models.cross_entropies(group, is_letter)
                best = bits.argmin(axis=1)
                gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(length, CONFIDENT_AT)[:, None]
                score = 1 / np.exp2(-gap).sum(axis=1)
                for i, b in enumerate(best):
                    if length[i]:
                        own = float(bits[i, b])
                        rows.append((models.languages[b], float(score[i]), own, bool(own > models.limits[b])))
                    else:
                        rows.append(("und", 0.0, None, True))
            columns = zip(*rows) if rows else [[] for _ in fields]
            return pa.StructArray.from_arrays(
                [pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields]
            )

        return predict

    kind = "lang string, score double, bits double, rejected boolean"
    found = docs.withColumn("_lang", per_row(start, kind)(F.col(text)))
    names = {"lang_pred": "lang", "score": "score", "cross_entropy": "bits", "rejected": "rejected"}
    return found.withColumns({name: F.col(f"_lang.{field}") for name, field in names.items()}).drop("_lang")
