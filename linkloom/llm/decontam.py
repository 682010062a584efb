"""Benchmark decontamination: seeds of two near words that no accepted alignment can lack, then Smith-Waterman alignment of words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Memo, each, if_small, share, small_batches, tidy, utf8
from linkloom.session import written

#: Items of fewer words match as a whole only, word by word.
GRAM = 5
#: A seed is two words so far apart: next to each other, or with one between.
LAGS = (1, 2)
#: A stretch is a candidate when it holds so many of an item's seed places (fewer, if the item's alignments may hold fewer).
PLACES = 3
#: Alignment: a matching word, another word, a missing or added word.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A text is contaminated from this share of an item's greatest score on.
LEAST_SCORE = 0.5
#: Bits of the filter that grams of texts pass first. Its size doesn't depend on the benchmark's.
FILTER_BITS = 27
#: Contaminated texts are broadcast up to so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = 64 - FILTER_BITS

#: ASCII letters in lower case and digits; every other ASCII character separates words.
_PLAIN = bytes(
    code + 32 if 65 <= code <= 90 else code if 97 <= code <= 122 or 48 <= code <= 57 or code >= 128 else 32 for code in range(256)
)
#: Characters of scripts without spaces, in UTF-8: Thai, Lao, Burmese, Khmer, kana and Chinese characters.
_UNSPACED = re.compile(rb"(?:\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]|\xe2[\xba-\xbf]|[\xe3-\xe9][\x80-\xbf]|\xef[\xa4-\xab]|\xf0[\xa0-\xb3][\x80-\xbf])[\x80-\xbf]")


def plain_words(data: bytes | None) -> list[bytes]:
    """Words without ASCII signs and case, so that neither hides a copy; in scripts without spaces each character is one."""
    if not data:
        return []
    plain = data.translate(_PLAIN)
    return (plain if plain.isascii() else _UNSPACED.sub(rb" \g<0> ", plain)).split()


def _memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def word_hashes(data: bytes | None, memo: Memo) -> np.ndarray:
    found = plain_words(data)
    return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


def pair_hashes(words: np.ndarray, lag: int) -> np.ndarray:
    """A hash for each word and the one ``lag`` behind it; with 0 for the word alone."""
    n = max(len(words) - lag, 0)
    out = words[:n] * _MULTIPLIER
    if lag:
        out += words[lag:]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def least_pairs(size: int) -> int:
    """How many neighbouring matches with at most one error between them an accepted alignment has at least.

    With k matches and e errors its score is 2k - e at most, so e <= 2k - LEAST_SCORE * 2 * size.
    At most e / 2 of the k - 1 neighbours can have two errors or more between them.
    Each of the others is two words, next to each other or with one between, in item and text.
    A whole item has all its pairs; that of one word is a place by itself.
    """
    return math.ceil(LEAST_SCORE * size) - 1 if size >= GRAM else max(size - 1, 1)


def least_score(size: int) -> float:
    """The score from which on an alignment with an item of ``size`` words is accepted."""
    return MATCH * size * (LEAST_SCORE if size >= GRAM else 1)


def reach_of(size: int) -> int:
    """The most words of a text that an accepted alignment takes: 3 * matches - ``least_score``."""
    return 3 * size - math.ceil(least_score(size))


def stretches(places: np.ndarray, few: int, reach: int, end: int) -> list[list[int]]:
    """Where alignments of up to ``reach`` words that hold ``few`` of the places can lie, up to ``end``; none overlap."""
    opens, closes = places[: max(len(places) - few + 1, 0)], places[few - 1 :]
    near = closes - opens < reach
    out: list[list[int]] = []
    for low, high in zip((closes[near] - reach + 1).tolist(), (opens[near] + reach).tolist()):
        if out and low <= out[-1][1]:
            out[-1][1] = min(high, end)
        else:
            out.append([max(low, 0), min(high, end)])
    return out


def _lags(size: int) -> tuple[int, ...]:
    return LAGS if size > 1 else (0,)


def _passes(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where the grams are that the filter lets pass: all that it was built from, and few others."""
    ok = np.arange(len(grams))
    for half in (lambda some: some >> np.uint64(_HALF), lambda some: some & np.uint64((1 << FILTER_BITS) - 1)):
        place = half(grams[ok])
        ok = ok[(bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return ok


def best_alignment(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score of two word sequences, and where it starts and ends in ``text``."""
    if not len(item) or not len(text):
        return 0, 0, 0
    n = len(text)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = -GAP * np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(text == word, MATCH, MISMATCH)
        down = row[1:] + GAP
        new, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = diagonal >= down
        value = np.where(take, diagonal, down)
        from_ = np.where(take, start[:-1], start[1:])
        live = value > 0
        new[1:][live], begin[1:][live] = value[live], from_[live]
        # A gap along the row: the best of what stands before, less the way.
        lifted = new + ramp
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(n + 1), 0))
        along = reach - ramp
        better = (along > new) & (along > 0)
        new[better], begin[better] = along[better], begin[source[better]]
        row, start = new, begin
        top = int(row.argmax())
        if row[top] > best[0]:
            best = int(row[top]), int(start[top]), top
    return best


def best_copy(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """``best_alignment`` where it is accepted, else zeros. Only stretches with ``least_pairs`` are aligned."""
    size, none = len(item), (0, 0, 0)
    wanted = np.concatenate([pair_hashes(item, lag) for lag in _lags(size)])
    places = np.unique(np.concatenate([np.flatnonzero(np.isin(pair_hashes(text, lag), wanted)) for lag in _lags(size)]))
    best = none
    for low, high in stretches(places, least_pairs(size), reach_of(size), len(text)):
        score, start, end = best_alignment(item, text[low:high])
        if score > best[0]:
            best = score, low + start, low + end
    return best if best[0] >= least_score(size) else none


def _item_grams(items: DataFrame) -> DataFrame:
    """``(gram, item, at, keep, least, reach, alone)``: pairs by the place where they start, and items of a single word.

    Of an item's places ``keep`` are seeds, so that of the ``least_pairs`` places that an
    accepted alignment holds ``least`` are among them, whichever are chosen.
    """
    kinds = {"gram": pa.int64(), "item": pa.int64(), "at": pa.int32(), "keep": pa.int32(), "least": pa.int32(), "reach": pa.int32(), "alone": pa.bool_()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for item, data in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = word_hashes(data, memo)
                need = least_pairs(len(words))
                least = min(PLACES, need)
                keep = max(len(words) - 1, 1) - need + least
                for lag in _lags(len(words)):
                    rows += [(g, item, i, keep, least, reach_of(len(words)), not lag) for i, g in enumerate(pair_hashes(words, lag).view(np.int64).tolist())]
            columns = zip(*rows) if rows else ((),) * len(kinds)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    return items.mapInArrow(tidy(cut), "gram bigint, item bigint, at int, keep int, least int, reach int, alone boolean")


def _filter(grams: DataFrame) -> np.ndarray:
    """A bit array with two bits a gram: at most ``2 ** FILTER_BITS / 64`` words come to the driver."""
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    places = F.array(F.shiftrightunsigned("gram", _HALF), F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)))
    place = grams.select(F.explode(places).alias("p"))
    one = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
    words = place.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits


def text_id(text: str) -> Column:
    """What stands for a text: two 64-bit hashes and its length."""
    return F.concat_ws(":", F.xxhash64(text), F.xxhash64(F.lit(1), text), F.length(text))


def findings(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(text_id, item, score, start, end)``: contaminated texts, each item that they hold, and where (in words).

    ``score`` is the alignment's share of the item's greatest score, from
    ``LEAST_SCORE`` to 1. Texts are compared whole, equal ones once. Null texts
    and items, and items without words, match nothing; items of fewer than
    ``GRAM`` words must stand whole, word by word. Rows of ``items`` with one id
    count as different items of that id. Item ids are integers; a null id is left out.

    The result is that of aligning every text with every item: an accepted
    alignment holds ``least_pairs`` of an item's pairs, and so many of its places
    are seeds that it can't miss them, however common they are. The rarest
    places are taken; that keeps candidates few. Pairs of texts pass a filter of
    fixed size on their way to the join, so what is shuffled is about what the
    benchmark holds, not the corpus.
    """
    small_batches(spark)
    named = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    named = named.select(F.col(item_id).cast("bigint").alias("item"), utf8(item_text).alias("text")).distinct()
    # An item is told from others of its id by its own number.
    named = written(named.withColumn("id", F.col("item")).withColumn("item", F.xxhash64("item", "text")), "items")
    grams = written(_item_grams(named.select("item", "text")), "item-grams")
    bounds = grams.agg(F.min("least").alias("few"), F.max("reach").alias("reach"), F.max("alone").alias("alone")).first()
    few, reach = bounds.few or 1, bounds.reach or 0
    lags = (0, *LAGS) if bounds.alone else LAGS
    source = docs.where(F.col(text).isNotNull()).select(text_id(text).alias("text_id"), utf8(text).alias("text"))

    def passing_pairs(bits: np.ndarray, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each lag the pairs of a batch of texts that pass, in order, the text's number and where they start in it."""
        words = np.concatenate([*texts, np.zeros(0, np.uint64)])
        ends = np.cumsum([len(found) for found in texts], dtype=np.int64)
        for lag in lags:
            pairs = pair_hashes(words, lag)
            at = _passes(bits, pairs)
            text = np.searchsorted(ends, at, "right")
            inside = at + lag < ends[text]  # no pair goes from one text to the next
            at, text = at[inside], text[inside]
            yield pairs[at].view(np.int64), text, at - np.where(text > 0, ends[text - 1], 0)

    every = share(spark, _filter(grams))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, passing = _memo(), every()
        for batch in batches:
            own = passing_pairs(passing, [word_hashes(data, memo) for data in each(batch.column("text"))])
            found, n = np.unique(np.concatenate([pairs for pairs, _, _ in own]), return_counts=True)
            yield pa.record_batch([pa.array(found), pa.array(n.astype(np.int64))], names=["gram", "n"])

    judged = source.select("text").mapInArrow(tidy(judge), "gram bigint, n bigint")
    counted = written(judged.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    every.release()
    places = grams.join(counted, "gram", "left").groupBy("item", "at", "keep", "least")
    places = places.agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_set("gram").alias("grams"))
    rarest = places.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("n", "at")))
    seeds = rarest.where(F.col("rank") <= F.col("keep")).select(F.explode("grams").alias("gram"), "item", "at", "least")
    seeds = written(seeds, "seeds")
    bits = share(spark, _filter(seeds))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, passing = _memo(), bits()
        for batch in batches:
            rows = []
            texts = [word_hashes(data, memo) for data in each(batch.column("text"))]
            own, text, at = map(np.concatenate, zip(*passing_pairs(passing, texts)))
            order = np.argsort(text, kind="stable")
            own, text, at = own[order], text[order], at[order]
            first = np.flatnonzero(np.diff(text, prepend=-1))
            for low_at, high_at in zip(first.tolist(), [*first[1:].tolist(), len(text)]):
                number = int(text[low_at])
                found, pairs, places = texts[number], own[low_at:high_at], at[low_at:high_at]
                for low, high in stretches(np.unique(places), few, reach, len(found)):
                    rows.append((batch.column("text_id")[number].as_py(), low, found[low:high].view(np.int64), np.unique(pairs[(places >= low) & (places < high)])))
            columns = zip(*rows) if rows else ((),) * 4
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["text_id", "low", "words", "grams"])

    key = ["text_id", "low"]
    held = written(source.mapInArrow(tidy(scan), "text_id string, low bigint, words array<bigint>, grams array<bigint>"), "passages")
    bits.release()
    once = held.select(*key, "grams").dropDuplicates(key)
    hits = written(once.select(*key, F.explode("grams").alias("gram")), "hits")
    pairs = hits.join(seeds, "gram").groupBy(*key, "item").agg(F.size(F.collect_set("at")).alias("n"), F.max("least").alias("least"))
    pairs = written(pairs.where(F.col("n") >= F.col("least")).select(*key, "item"), "candidates")
    passages = held.select(*key, "words").dropDuplicates(key)
    joined = pairs.join(passages, key).join(named, "item")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in batches:
            rows = []
            columns = ("text_id", "low", "item", "id", "text")
            for i, (name, low, item, label, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
                words = batch.column("words")[i].values.to_numpy().view(np.uint64)
                wanted = word_hashes(data, memo)
                score, start, end = best_copy(wanted, words)
                if score:
                    rows.append((name, item, label, score / (MATCH * len(wanted)), low + start, low + end))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else ((),) * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["text_id", "item", "id", "score", "start", "end"])

    aligned = joined.mapInArrow(tidy(align), "text_id string, item bigint, id bigint, score double, start bigint, end bigint")
    best = F.max(F.struct("score", (-F.col("start")).alias("before"), "end", "id")).alias("b")
    found = aligned.groupBy("text_id", "item").agg(best)
    return found.select("text_id", F.col("b.id").alias("item"), "b.score", (-F.col("b.before")).alias("start"), "b.end")


def by_text(found: DataFrame) -> DataFrame:
    """``(text_id, item_ids, score)``: findings by text; the items in order, the best score."""
    return found.groupBy("text_id").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("score").alias("score"))


def remove(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated; null texts stay."""
    texts = written(found.select(F.col("text_id").alias("_text")).distinct(), "contaminated")
    return docs.join(if_small(texts, F.length("_text") + 16, BROADCAST_BYTES), text_id(text) == F.col("_text"), "left_anti")


def mark(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``contaminated``, ``item_ids`` and ``score`` of each text; every row and column stays.

    Columns of these names are replaced. What was found is broadcast up to
    ``BROADCAST_BYTES``, else joined by a shuffle.
    """
    by = written(by_text(found), "contaminated")
    by = by.select(F.col("text_id").alias("_text"), F.col("item_ids").alias("_items"), F.col("score").alias("_score"))
    by = if_small(by, F.length("_text") + 8 * F.size("_items") + 40, BROADCAST_BYTES)
    joined = docs.withColumn("_id", text_id(text)).join(by, F.col("_id") == F.col("_text"), "left")
    marks = {
        "contaminated": F.col("_text").isNotNull(),
        "item_ids": F.coalesce("_items", F.array().cast("array<bigint>")),
        "score": F.coalesce("_score", F.lit(0.0)),
    }
    return joined.withColumns(marks).drop("_id", "_text", "_items", "_score")
