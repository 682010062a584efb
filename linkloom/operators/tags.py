"""Term statistics, TF-IDF in arrival order or on frozen statistics, top tags.

With N the number of documents and cf the number of occurrences of a term,
both counted up to and including the scored document,

    score = tf / length * (ln((1 + N) / (1 + cf)) + 1)

The text is read once: ``term_table`` counts the words of each document inside
its own row and writes the compact result. Running counts are prefix sums over
blocks of consecutive documents, so that no task sees more than one block of a
term, however common the term is. What was counted before a block is only looked
up if there is any: the first block of a corpus needs no second pass.

Where only the best terms are asked for, words are not sorted by term at all:
``block_table`` keeps small blocks of documents with their own words and totals,
and each block meets what was counted before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.text import clean_tokens
from linkloom.operators.ordering import from_slots, numbered
from linkloom.session import shuffle_partitions, written

# Documents per prefix-sum block: one task's share of a term that stands in every document.
BLOCK_DOCS = 1 << 20
# Rows whose words are counted at a time.
COUNTED_ROWS = 1000
# Words of a block that meets what was counted before it; one document's may be more.
BLOCK_WORDS = 1 << 21
BLOCK_ROWS = 1 << 14
# Relative difference below which two scores may be equal but for rounding.
CLOSE = 1e-9


def indexed(docs: DataFrame) -> DataFrame:
    """Documents that count: null and empty texts do not."""
    return docs.where(F.length("text") > 0)


def term_freq(docs: DataFrame) -> DataFrame:
    """``(seq, term, tf, pos)``: count and first position of each kept word."""
    words = indexed(docs).select("seq", F.posexplode_outer(clean_tokens(F.col("text"))).alias("pos", "term"))
    return (
        words.where(F.col("term").isNotNull())
        .groupBy("seq", "term")
        .agg(F.count("*").alias("tf"), F.min("pos").alias("pos"))
    )


def doc_length(docs: DataFrame) -> DataFrame:
    """``(seq, len)``: kept words per document."""
    return indexed(docs).select("seq", F.size(clean_tokens(F.col("text"))).alias("len"))


def term_stats(docs: DataFrame) -> DataFrame:
    """``(term, cf)`` over all documents."""
    words = indexed(docs).select(F.explode_outer(clean_tokens(F.col("text"))).alias("term"))
    return words.where(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("cf"))


def doc_count(docs: DataFrame) -> DataFrame:
    """One row ``(doc_count)``."""
    return indexed(docs).agg(F.count("*").alias("doc_count"))


def counted_words(words: Column) -> Column:
    """For each list of words its distinct ones with first position and count."""

    @F.arrow_udf("array<struct<term: string, pos: int, tf: bigint>>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("term", pa.string()), ("pos", pa.int32()), ("tf", pa.int64())])
        for lists in batches:
            parts = [lists.slice(i, COUNTED_ROWS) for i in range(0, len(lists), COUNTED_ROWS)]
            yield pa.concat_arrays([_count(part, kind) for part in parts] or [pa.array([], pa.list_(kind))])

    return counted(words)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _count(lists: pa.Array, kind: pa.DataType) -> pa.Array:
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = _lengths(lists)
    row = np.repeat(np.arange(len(lists)), lengths)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    _, first, tf = np.unique(row * max(len(coded.dictionary), 1) + codes, return_index=True, return_counts=True)
    columns = [coded.dictionary.take(pa.array(codes[first])).cast(pa.string()), pa.array(pos[first], pa.int32()), pa.array(tf, pa.int64())]
    offsets = np.append(0, np.cumsum(np.bincount(row[first], minlength=len(lists))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))


def in_arrival_order(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out in sorted ranges of their key; what finds the ranges computes the rows, so deal before costly steps."""
    return rows.repartitionByRange(key).sortWithinPartitions(key)


def term_table(docs: DataFrame, arrival: bool = False) -> DataFrame:
    """Written table ``(seq, …, len, terms: array<(term, pos, tf)>)``.

    With ``arrival`` the documents are dealt out in ranges of ``seq`` before their
    words are counted, and the table keeps each row's ``_slot``: it is numbered in
    arrival order from its only write. Ranges are found on the documents, before any word is cut.

    Columns other than the text travel along. Words are counted inside the row, an Arrow batch at a time: no shuffle.
    """
    others = [name for name in docs.columns if name != "text"]
    source = indexed(docs)
    if arrival:
        source = in_arrival_order(source, "seq")
    words = source.select(*others, clean_tokens(F.col("text")).alias("words"))
    counted = words.select(*others, F.size("words").alias("len"), counted_words(F.col("words")).alias("terms"))
    slot = [F.monotonically_increasing_id().alias("_slot")] if arrival else []
    return written(counted.select("*", *slot), "terms")


_WORDS = pa.struct([("_bucket", pa.int32()), ("words", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])
_BLOCK = pa.struct([
    ("block", pa.int64()), ("codes", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())),
    ("words", pa.list_(_WORDS)),
])


def _blocks(words: Column, slot: Column, block_words: int, buckets: int) -> Column:
    """Rows in order, cut into blocks of consecutive rows that are named by their first slot: the columns of ``block_table``."""
    words_kind = "array<struct<_bucket: int, words: array<string>, totals: array<bigint>>>"

    @F.arrow_udf(f"struct<block: bigint, codes: array<int>, positions: array<int>, tfs: array<int>, words: {words_kind}>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, slots in batches:
            parts = [_block(lists.slice(i, n), slots[i], buckets) for i, n in _cuts(lists, block_words)]
            yield pa.concat_arrays(parts or [pa.array([], _BLOCK)])

    return cut(words, slot)


def _cuts(lists: pa.Array, block_words: int) -> Iterator[tuple[int, int]]:
    """``(first row, rows)`` of parts of at most ``block_words`` words and ``BLOCK_ROWS`` rows, or of one row."""
    ends = np.cumsum(_lengths(lists))
    at = 0
    while at < len(lists):
        before = ends[at - 1] if at else 0
        stop = max(min(int(np.searchsorted(ends, before + block_words, "right")), at + BLOCK_ROWS), at + 1)
        yield at, stop - at
        at = stop


def _listed(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _block(lists: pa.Array, slot: pa.Scalar, buckets: int) -> pa.Array:
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.string())
    bucket = np.fromiter((zlib.crc32(word) % buckets for word in words.cast(pa.binary()).to_pylist()), np.int32, len(words))
    # A word's code is its place among the block's words, bucket by bucket.
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    codes = place[coded.indices.to_numpy(zero_copy_only=False)]
    lengths = _lengths(lists)
    row = np.repeat(np.arange(len(lists)), lengths)
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # Row, code and position are sorted as one number, which ``_cuts`` keeps below 63 bits.
    pos_bits, code_bits = int(lengths.max(initial=0)).bit_length(), len(words).bit_length()
    keys = np.sort((row << code_bits | codes) << pos_bits | pos)
    first = np.flatnonzero(np.diff(keys >> pos_bits, prepend=-1))
    tf = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    pos, keys = keys & ((1 << pos_bits) - 1), keys >> pos_bits
    ends = np.append(0, np.cumsum(np.bincount(keys >> code_bits, minlength=len(lists))))
    used, starts = np.unique(bucket[order], return_index=True)
    cuts = np.append(starts, len(words))
    totals = pa.array(np.bincount(codes, minlength=len(words)), pa.int64())
    columns = [pa.array(used, pa.int32()), _listed(words.take(pa.array(order)), cuts), _listed(totals, cuts)]
    # The block's words stand in its first row.
    at_first = np.append(0, np.full(len(lists), len(used)))
    lists_of = [_listed(pa.array(values, pa.int32()), ends) for values in (keys & ((1 << code_bits) - 1), pos, tf)]
    words_of = _listed(pa.StructArray.from_arrays(columns, fields=list(_WORDS)), at_first)
    return pa.StructArray.from_arrays([pa.repeat(slot, len(lists)), *lists_of, words_of], fields=list(_BLOCK))


def block_table(docs: DataFrame, placed: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Written table ``(seq, …, len, _slot, block, codes, positions, tfs, words)`` in arrival order.

    A row lists its distinct words as ``codes``, with first positions and counts: places among the words of
    its block, which stand in the block's first row with their totals, dealt into buckets by a hash.
    Documents that are ``placed`` are ``in_arrival_order`` already.
    """
    others = [name for name in docs.columns if name != "text"]
    source = indexed(docs) if placed else in_arrival_order(indexed(docs), "seq")
    slotted = source.select(*others, clean_tokens(F.col("text")).alias("_words"), F.monotonically_increasing_id().alias("_slot"))
    cut = _blocks(F.col("_words"), F.col("_slot"), block_words, shuffle_partitions(docs.sparkSession))
    return written(slotted.withColumn("_cut", cut).select(*others, F.size("_words").alias("len"), "_slot", "_cut.*"), "blocks")


def _score(tf: Column, length: Column, docs: Column, cf: Column) -> Column:
    return tf / length * (F.log((1 + docs) / (1 + cf)) + 1)


def table_stats(terms: DataFrame) -> DataFrame:
    """``(term, cf)`` of a term table."""
    return terms.select(F.inline("terms")).groupBy("term").agg(F.sum("tf").alias("cf"))


def _counted_before(rows: DataFrame, stored_stats: DataFrame | None) -> DataFrame:
    """``(term, block, prior)``: occurrences before the block, if any."""
    # A term has at most documents / block_docs rows here.
    totals = rows.groupBy("term", "block").agg(F.sum("tf").alias("tf"))
    before = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prior = totals.select("term", "block", F.coalesce(F.sum("tf").over(before), F.lit(0)).alias("prior"))
    if stored_stats is not None:
        total = F.col("prior") + F.coalesce("cf", F.lit(0))
        prior = prior.join(stored_stats, "term", "left").select("term", "block", total.alias("prior"))
    return prior.where(F.col("prior") > 0)


def arrival_counts(
    terms: DataFrame,
    stored_stats: DataFrame | None = None,
    stored_docs: int = 0,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """``(seq, term, pos, tf, len, n, cf)`` with N and cf as of each document.

    ``stored_stats`` and ``stored_docs`` hold what was counted before; narrow
    the former to the terms of the table.
    """
    # The term table itself is sorted and numbered, so no join attaches the numbers.
    columns = ["seq", "len", "terms"]
    in_order = "_slot" in terms.columns
    placed = from_slots(terms.select(*columns, "_slot"), "n") if in_order else numbered(terms.select(*columns), ["seq"], "n")
    block = F.floor((F.col("n") - 1) / block_docs).alias("block")
    rows = placed.select("seq", "len", "n", block, F.inline("terms"))
    in_block = Window.partitionBy("term", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.withColumn("cf", F.sum("tf").over(in_block))
    # Counting the rows of a written table reads its footers only.
    if stored_stats is not None or terms.count() > block_docs:
        prior = _counted_before(rows, stored_stats)
        counts = counts.join(prior, ["term", "block"], "left").withColumn("cf", F.col("cf") + F.coalesce("prior", F.lit(0)))
    return counts.select("seq", "term", "pos", "tf", "len", (F.col("n") + stored_docs).alias("n"), "cf")


def arrival_scores(terms: DataFrame, **stored) -> DataFrame:
    """``(seq, term, pos, score)``, each document scored when it arrives."""
    counts = arrival_counts(terms, **stored)
    return counts.select("seq", "term", "pos", _score(F.col("tf"), F.col("len"), F.col("n"), F.col("cf")).alias("score"))


def _sums_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the words of each block what the blocks before counted; buckets follow one another, their blocks in order."""
    current, places, counts = None, {}, np.zeros(0, np.int64)
    for batch in batches:
        before = []
        for bucket, words, totals in zip(batch["_bucket"].to_pylist(), batch["words"], batch["totals"]):
            if bucket != current:
                current, places, counts = bucket, {}, np.zeros(1024, np.int64)
            at = np.fromiter((places.setdefault(word, len(places)) for word in words.values.to_pylist()), np.int64, len(words))
            if len(places) > len(counts):
                counts = np.append(counts, np.zeros(len(places), np.int64))
            before.append(counts[at])
            counts[at] += totals.values.to_numpy()
        ends = np.append(0, np.cumsum([len(part) for part in before]))
        prior = _listed(pa.array(np.concatenate([np.zeros(0, np.int64), *before]), pa.int64()), ends)
        yield pa.RecordBatch.from_arrays([batch["of"], batch["_bucket"], batch["words"], prior], ["of", "_bucket", "words", "prior"])


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _met(docs: pa.Table, before: pa.Table, count: int) -> pa.Table:
    """The counts of a block's documents, of those terms whose scores may be among the best ``count`` of a document."""
    docs, before = docs.sort_by("n"), before.sort_by("_bucket")
    lengths = _lengths(docs["codes"].combine_chunks())
    row = np.repeat(np.arange(len(lengths)), lengths)
    codes, tf = _flat(docs, "codes"), _flat(docs, "tfs").astype(np.int64)
    # Rows are in order of arrival: a stable sort by word keeps it.
    order = np.sort(codes.astype(np.int64) << 32 | np.arange(len(codes))) & 0xFFFFFFFF
    sums = np.cumsum(tf[order])
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    run = sums - np.repeat(sums[starts] - tf[order][starts], np.diff(np.append(starts, len(order))))
    cf = _flat(before, "prior")[codes]
    cf[order] += run
    n, length = docs["n"].to_numpy()[row], docs["len"].to_numpy()[row]
    kept = _may_be_best(tf / length * (np.log((1 + n) / (1 + cf)) + 1), lengths, count)
    return pa.table({
        "seq": docs["seq"].take(pa.array(row[kept])),
        "term": before["words"].combine_chunks().flatten().take(pa.array(codes[kept])),
        "pos": pa.array(_flat(docs, "positions")[kept], pa.int32()),
        "tf": pa.array(tf[kept], pa.int64()),
        "len": pa.array(length[kept], pa.int32()),
        "n": pa.array(n[kept], pa.int64()),
        "cf": pa.array(cf[kept], pa.int64()),
    })


def _may_be_best(score: np.ndarray, lengths: np.ndarray, count: int) -> np.ndarray:
    """Places of the scores that are not clearly below the ``count``-th best of their row."""
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    left, least, taken = score.copy(), np.full(len(lengths), -np.inf), np.zeros(len(lengths), np.int64)
    for _ in range(count):
        # The highest scores left of each row, all that are equal at once.
        best = np.maximum.reduceat(left, starts)
        least = np.where(taken < count, best, least)
        equal = left == np.repeat(best, lengths)
        taken += np.add.reduceat(equal.astype(np.int64), starts)
        left[equal] = -np.inf
    # A row of fewer scores is down to -inf: all of it stays.
    least = np.where(np.isfinite(least), least - CLOSE * (np.abs(least) + 1e-6), -np.inf)
    return np.flatnonzero(score >= np.repeat(least, lengths))


def best_counts(blocks: DataFrame, count: int) -> DataFrame:
    """``arrival_counts`` of a block table, of the terms that may be among the best ``count`` of their document.

    Rows with close scores stay, so that ``top_terms`` settles the rest as if all were there. What is
    dealt out by term are the totals of blocks alone; a block's documents then meet their sums.
    """
    totals = blocks.select(F.col("block").alias("of"), F.inline("words"))
    dealt = totals.repartition("_bucket").sortWithinPartitions("_bucket", "of")
    before = dealt.mapInArrow(_sums_before, "of bigint, _bucket int, words array<string>, prior array<bigint>")
    numbered_docs = from_slots(blocks.select("seq", "len", "block", "codes", "positions", "tfs", "_slot"), "n")
    rest = "term string, pos int, tf bigint, len int, n bigint, cf bigint"
    schema = T.StructType([blocks.schema["seq"], *T.StructType.fromDDL(rest).fields])

    def met(key: tuple[pa.Scalar, ...], docs: pa.Table, before: pa.Table) -> pa.Table:
        return _met(docs, before, count)

    return numbered_docs.groupBy("block").cogroup(before.groupBy("of")).applyInArrow(met, schema)


def best_scores(blocks: DataFrame, count: int) -> DataFrame:
    """``arrival_scores`` of the terms that may be among the best ``count`` of their document."""
    counts = best_counts(blocks, count)
    return counts.select("seq", "term", "pos", _score(F.col("tf"), F.col("len"), F.col("n"), F.col("cf")).alias("score"))


def corpus_scores(terms: DataFrame) -> DataFrame:
    """``(seq, term, pos, score)`` on the final statistics of the same corpus.

    The totals have one row per term and are written first: both sides of the
    join are then plain shuffles, and adaptive execution splits a common term.
    """
    rows = terms.select("seq", "len", F.inline("terms"))
    n = terms.agg(F.count("*")).scalar()
    return rows.join(written(table_stats(terms), "stats"), "term").select(
        "seq", "term", "pos", _score(F.col("tf"), F.col("len"), n, F.col("cf")).alias("score")
    )


def used_stats(stats: DataFrame, terms: DataFrame) -> DataFrame:
    """The statistics of the terms of a term table; the filter reaches the scan, below any sum."""
    return stats.join(terms.select(F.inline("terms")).select("term"), "term", "left_semi")


def query_scores(queries: DataFrame, stats: DataFrame, docs: Column) -> DataFrame:
    """``(seq, term, pos, score)`` of a term table on frozen statistics, which stay as they are.

    Terms never seen count 0. The statistics are first narrowed to the
    queries' terms and written, so that a common term of the queries can be
    split; which side is broadcast, if any, is left to measured size.
    """
    rows = queries.select("seq", "len", F.inline("terms"))
    used = written(used_stats(stats, queries), "stats")
    return rows.join(used, "term", "left").select(
        "seq", "term", "pos", _score(F.col("tf"), F.col("len"), docs, F.coalesce("cf", F.lit(0))).alias("score")
    )


def top_terms(scores: DataFrame, count: int = 3) -> DataFrame:
    """``(seq, rank, term, score)``: the best terms, ties to the earlier word."""
    best = Window.partitionBy("seq").orderBy(F.desc("score"), "pos")
    ranked = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count)
    return ranked.select("seq", "rank", "term", "score")


def link_tags(docs: DataFrame, top: DataFrame) -> DataFrame:
    """``(seq, link, rank, tag)`` from ``(seq, link, …)``, best a term table, and the top terms."""
    return docs.select("seq", "link").join(top, "seq").select("seq", "link", "rank", F.col("term").alias("tag"))


def tag_lists(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """``(seq, link, tags)``, best tag first; documents without tags get an empty array."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda pair: pair["tag"])
    lists = tags.groupBy("seq").agg(ordered.alias("tags"))
    return docs.select("seq", "link").join(lists, "seq", "left").select(
        "seq", "link", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")
    )
