"""Quality by compression: dictionaries of good and of bad text, and which of them makes a text smaller."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Shared, each, least_hashes, per_row, share, small_batches
from linkloom.session import written

#: Labelled documents learned from, of each label at most: every second one calibrates. Characters
#: of text that the driver gets of a label and builds a dictionary from; the text that crosses this bound is the last.
LEARN_DOCS, LEARN_CHARS = 6000, 8_000_000
DICTIONARY_BYTES = 1 << 16
#: Texts are compressed so many bytes at a time, from beginning to end: a dictionary tells most about
#: what stands near it, and a long text would else be its own dictionary.
PIECE = 1024
LEVEL = 3
#: A text is called good from this score on.
THRESHOLD = 0.5
#: Samples that a trained dictionary needs; of fewer the dictionary is the text itself.
LEAST_SAMPLES = 64


def pieces(data: bytes) -> list[bytes]:
    return [data[at : at + PIECE] for at in range(0, len(data), PIECE)]


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of what is common in the pieces of the texts."""
    parts = [piece for text in texts for piece in pieces(text)]
    if len(parts) >= LEAST_SAMPLES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
        except zstandard.ZstdError:
            pass  # too little that repeats
    return b"".join(parts)[-DICTIONARY_BYTES:]


@dataclass
class Quality:
    """Dictionaries by label, and how the difference of compressed sizes makes a score."""

    bad: bytes
    good: bytes
    slope: float
    offset: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        """One for each dictionary, bad and good; frames carry nothing but data."""
        out = []
        for data in (self.bad, self.good):
            prepared = zstandard.ZstdCompressionDict(data)
            prepared.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=prepared, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def score(self, difference: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -30, 30))))


def difference(text: str | None, compressors: list[zstandard.ZstdCompressor]) -> float:
    """By how much the bad dictionary leaves a text larger than the good one does, in bytes a byte of the whole text; 0 without text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return 0.0
    bad, good = (sum(len(c.compress(piece)) for piece in pieces(data)) for c in compressors)
    return (bad - good) / len(data)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a logistic curve through differences ``x`` and labels ``y``, by damped Newton steps."""
    scale = float(np.sqrt(np.average(x * x, weights=weight))) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * beta
        curvature = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        beta += step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> Quality:
    """Dictionaries and calibration from the labelled documents that are not held out.

    Of each label up to ``LEARN_DOCS`` documents are learned from, those with the smallest
    hashes of key and text: every second one, up to ``LEARN_CHARS`` characters
    in all but one text at least, builds the dictionary, the others calibrate (all do, if a label has
    no others). Repeated rows are one document, which calibrates as often as it occurs. Of
    contradicting labels of a document the worse counts; null labels, keys and
    texts, and empty texts, are left out. Without documents of both labels every score is the share
    of good labels (one half without any).
    """
    small_batches(spark)
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    marked = marked.agg(F.min(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    usable = docs.where(F.coalesce(~held_out & (F.length(text) > 0), F.lit(False)))
    usable = usable.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), F.col(text).alias("text"))
    # Copies meet before the labels do: a row repeated any number of times is one row of the join.
    known = usable.groupBy("_key", "_text").agg(F.count("*").alias("copies"), F.first(F.length("text")).alias("size")).join(marked, "_key")
    known = written(known.withColumn("u", F.xxhash64("_key", "_text")), "quality-keys")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.sum("copies").alias("n")).collect()}
    if len(sizes) < 2:
        odds = {(): 0.0, (0,): -30.0, (1,): 30.0}[tuple(sizes)]
        return Quality(b"", b"", 0.0, odds)
    ranked = least_hashes(known, "label", LEARN_DOCS, ["_key", "_text"]).withColumn("part", F.col("rank") % 2)
    before = F.sum("size").over(Window.partitionBy("label", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    within = (F.col("part") == 0) | (F.coalesce(before, F.lit(0)) < LEARN_CHARS)
    # At most twice LEARN_DOCS keys: small enough to broadcast, so that no text is shuffled to meet them.
    chosen = ranked.withColumn("within", within).where("within").select("_key", "_text", "label", "copies", "rank", "part")
    chosen = written(chosen, "quality-chosen")
    same = ["_key", "_text"]
    sample = usable.join(F.broadcast(chosen), same).groupBy(*same, "label", "copies", "rank", "part").agg(F.first("text").alias("text"))
    sample = written(sample.select("label", "copies", "rank", "part", "text").repartition(64), "quality-sample")

    built = [sample.where((F.col("label") == value) & (F.col("part") == 1)).orderBy("rank").select(F.col("text").cast("binary").alias("t")) for value in (0, 1)]
    model = Quality(*(dictionary([bytes(r["t"]) for r in own.collect()]) for own in built), 0.0, 0.0)
    differences = share(spark, (model.bad, model.good))
    calibrating = sample.select("label", "copies", "part", _differences(differences)(F.col("text")).alias("x"))
    rows = calibrating.where("part = 0").collect() if min(_others(sample)) else calibrating.collect()
    differences.release()
    x, y, copies = (np.array([r[c] for r in rows], float) for c in ("x", "label", "copies"))
    # The sample holds the labels in other proportions than the documents do.
    weight = copies * np.where(y == 1, sizes[1] / copies[y == 1].sum(), sizes[0] / copies[y == 0].sum())
    model.slope, model.offset = calibrate(x, y, weight * len(y) / weight.sum())
    return model


def _others(sample: DataFrame) -> list[int]:
    """How many documents of either label are not in a dictionary."""
    return [sample.where((F.col("label") == value) & (F.col("part") == 0)).count() for value in (0, 1)]


def _differences(shared: Shared) -> Callable[..., Column]:
    def start():
        compressors = Quality(*shared(), 0.0, 0.0).compressors()
        return lambda texts: pa.array([difference(text, compressors) for text in each(texts)], pa.float64())

    return per_row(start, "double")


def score(spark: SparkSession, docs: DataFrame, model: Quality, text: str = "text", name: str = "score", of: str = "difference") -> DataFrame:
    """``docs`` with the ``difference`` of compressed sizes, and the calibrated score in column ``name``, of each whole text.

    Null and empty texts have no difference (0) and the score that goes with it. All rows and columns
    stay; columns of the two names are replaced. The dictionaries are broadcast: 128 KB. Nothing is shuffled.
    """
    small_batches(spark)
    if not model.bad and not model.good:
        return docs.withColumns({of: F.lit(0.0), name: F.lit(model.score(0.0))})
    found = docs.withColumn(of, _differences(share(spark, (model.bad, model.good)))(F.col(text)))
    power = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(of) * model.slope + model.offset))
    return found.withColumn(name, 1 / (1 + F.exp(-power)))
