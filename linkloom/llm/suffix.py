"""Suffix-array dedup: sparse suffixes at minimisers, sorted, compared with their neighbours, extended both ways."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Memo, each, small_batches, tidy, utf8, words
from linkloom.session import written

#: A repeated passage of so many words is certain to be found whole.
PASSAGE = 50
#: A suffix is kept where a run of 4 words has the least hash of so many runs in a row.
WINDOW = 12
#: Leading words that two suffixes must share: what is left of a passage after its first minimiser.
LEADING = PASSAGE - WINDOW + 1
#: Words looked at on either side of a match: its ends lie within one window.
AROUND = WINDOW + 4

_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def _run_hashes(h: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(offset, hashes of runs of a power of two) that together make up runs of ``size`` words."""
    powers = {1: h}
    n = 1
    while 2 * n <= size:
        half = powers[n]
        powers[2 * n] = _mixed(half[: len(half) - n] * _MULTIPLIER + half[n:]) if len(half) > n else half[:0]
        n *= 2
    parts, at = [], 0
    for n in sorted(powers, reverse=True):
        while at + n <= size:
            parts.append((at, powers[n]))
            at += n
    return parts


def suffixes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leading hash, place, further places in a row with the same leading hash) of the kept suffixes of a text."""
    none = np.zeros(0, np.int64)
    if len(h) < PASSAGE:
        return none, none.astype(np.int32), none.astype(np.int32)
    (_, grams), *_ = _run_hashes(h, 4)
    view = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    # The last of equals: what is kept depends on the words of the window alone.
    least = np.arange(len(view)) + WINDOW - 1 - view[:, ::-1].argmin(axis=1)
    place = np.unique(least)
    place = place[place + LEADING <= len(h)]
    out = np.zeros(len(place), np.uint64)
    for at, hashes in _run_hashes(h, LEADING):
        out = out * _MULTIPLIER + hashes[place + at]
    leading = _mixed(out).view(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(leading) != 0) | (np.diff(place) != 1)])) if len(place) else none
    further = np.diff(np.append(first, len(place))) - 1
    return leading[first], place[first].astype(np.int32), further.astype(np.int32)


def _hashes(data: bytes | None, memo: Memo) -> np.ndarray:
    found = words(data)
    return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


_SUFFIX = "leading bigint, doc bigint, place int, further int"
REPEATED, UNDECIDED, WITNESS = 2, 1, 0
_NEIGHBOUR = f"{_SUFFIX}, state int, other bigint, other_place int, many boolean"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over suffixes in order: those whose neighbour in another document starts alike, with that neighbour.

    The first and last group of a partition may go on in the next one: where
    their suffixes are all of one document they stay undecided, and their ends are
    handed on as witnesses for the other partitions' undecided ones.
    """
    names = [c.split()[0] for c in _NEIGHBOUR.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]

    def batch_of(columns: list, state: int, other=None, other_place=None, many=None) -> pa.RecordBatch:
        n = len(columns[0])
        other, other_place = (np.zeros(n, np.int64) if c is None else c for c in (other, other_place))
        full = [*columns, np.full(n, state), other, other_place, np.ones(n, bool) if many is None else many]
        return pa.record_batch([pa.array(np.asarray(c), type=t) for c, t in zip(full, types)], names=names)

    held: list[np.ndarray] | None = None  # the last group so far, while it is of one document
    known = None  # (leading, doc, place, other, other place) at the end of the last group, once it has two
    opening: list[tuple] = []  # the first group's first and last row
    closing: list[tuple] = []  # the last group's

    def witnesses(rows: list[tuple]) -> pa.RecordBatch:
        return batch_of([np.array(c) for c in zip(*rows)], WITNESS)

    for batch in batches:
        fresh = [batch.column(c).to_numpy() for c in names[:4]]
        if not len(fresh[0]):
            continue
        columns = fresh if held is None else [np.concatenate([a, b]) for a, b in zip(held, fresh)]
        held = None
        leading, doc, place, _ = columns
        n = len(leading)
        starts = np.flatnonzero(np.concatenate([[True], leading[1:] != leading[:-1]]))
        ends = np.append(starts[1:], n)
        row = lambda i: tuple(c[i] for c in columns)
        if not opening:
            opening = [row(0), row(0)]
        group = np.repeat(np.arange(len(starts)), ends - starts)
        runs = np.flatnonzero(np.concatenate([[True], (leading[1:] != leading[:-1]) | (doc[1:] != doc[:-1])]))
        run = np.cumsum(np.isin(np.arange(n), runs)) - 1
        run_end = np.append(runs[1:], n)[run]
        run_start = runs[run]
        several = doc[starts] != doc[ends - 1]
        many = np.bincount(group[runs], minlength=len(starts)) > 2
        # The neighbour: the next suffix of another document, or else the one before.
        neighbour = np.where(run_end < ends[group], run_end, run_start - 1)
        other, other_place = doc[neighbour % n], place[neighbour % n]
        if known is not None and known[0] == leading[0]:
            alone = np.flatnonzero((group == 0) & (run_end >= ends[0]) & (run_start == 0))
            differs = doc[alone] != known[1]
            other, other_place = other.copy(), other_place.copy()
            other[alone] = np.where(differs, known[1], known[3])
            other_place[alone] = np.where(differs, known[2], known[4])
            several[0] = many[0] = True
        repeated = several[group]
        if repeated.any():
            yield batch_of([c[repeated] for c in columns], REPEATED, other[repeated], other_place[repeated], many[group][repeated])
        last = len(starts) - 1
        if leading[0] == opening[0][0]:
            opening[1] = row(ends[0] - 1)  # goes on while the group does
            if last > 0 and not several[0]:
                yield batch_of([c[: ends[0]] for c in columns], UNDECIDED)
        if several[last]:
            known = (leading[-1], doc[-1], place[-1], other[-1], other_place[-1])
        else:
            known, held = None, [c[starts[last] :] for c in columns]
        if closing and closing[0][0] == leading[-1] and last == 0:
            closing[1] = row(-1)
        else:
            closing = [row(starts[last]), row(-1)]
    if held is not None:
        yield batch_of(held, UNDECIDED)
    if opening:
        yield witnesses([*opening, *closing])


def _matches(kept: DataFrame) -> DataFrame:
    """``(doc, place, further, other, other_place, many)``: suffixes that another document has too (``many``: perhaps several)."""
    ordered = kept.repartitionByRange("leading", "doc", "place").sortWithinPartitions("leading", "doc", "place")
    found = written(ordered.mapInArrow(tidy(_neighbours), _NEIGHBOUR), "suffix-neighbours")
    sure = found.where(F.col("state") == REPEATED)
    open_ = found.where(F.col("state") == UNDECIDED).select("leading", "doc", "place", "further")
    ends = found.where(F.col("state") == WITNESS).select("leading", F.col("doc").alias("other"), F.col("place").alias("other_place"))
    late = open_.join(ends, "leading").where("doc <> other").groupBy("doc", "place", "further")
    late = late.agg(F.min(F.struct("other", "other_place")).alias("o"))
    late = late.select("doc", "place", "further", "o.other", "o.other_place", F.lit(True).alias("many"))
    return sure.select(*late.columns).unionByName(late)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of words that matches cover, each end with the match that it comes from."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, found in zip(batch.column("doc").to_pylist(), batch.column("found").to_pylist()):
            current = None
            for m in sorted(found, key=lambda m: (m["place"], m["other"])):
                start, end = m["place"], m["place"] + m["further"] + LEADING
                if current is None or start > current[1]:
                    if current:
                        rows.append((doc, *current))
                    current = (start, end, m["other"], m["other_place"], start, m["other"], m["other_place"], m["many"])
                elif end > current[1]:
                    many = current[-1] or m["many"]
                    current = (current[0], end, *current[2:4], start, m["other"], m["other_place"], many)
            if current:
                rows.append((doc, *current))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]
        columns = zip(*rows) if rows else ((),) * len(kinds)
        names = [c.split()[0] for c in _RUN.split(", ")]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_RUN = "doc bigint, start int, end int, l_doc bigint, l_place int, last int, r_doc bigint, r_place int, many boolean"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the words before (side 0) or after (side 1) each place asked for, the nearest first."""
    memo = Memo(xxhash.xxh3_64_intdigest)
    for batch in batches:
        docs, sides, places, near = [], [], [], []
        for doc, data, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "asked"))):
            h = _hashes(data, memo).view(np.int64)
            for request in asked:
                side, at = request["side"], request["at"]
                docs.append(doc)
                sides.append(side)
                places.append(at)
                near.append(h[at : at + AROUND] if side else h[max(0, at - AROUND) : at][::-1])
        yield pa.record_batch(
            [pa.array(docs, pa.int64()), pa.array(sides, pa.int32()), pa.array(places, pa.int32()), pa.array(near, pa.list_(pa.int64()))],
            names=["doc", "side", "at", "near"],
        )


def _common(a: str, b: str) -> Column:
    @F.arrow_udf("int")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:n] != y[:n])
            out.append(int(differ[0]) if len(differ) else n)
        return pa.array(out, pa.int32())

    return common(a, b)


def _merged(spans: str) -> Column:
    """Sorted, disjoint spans of at least ``PASSAGE`` words, or of ``LEADING`` if many documents share them."""

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def merge(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            joined: list[list] = []
            for s in sorted((s["start"], s["end"], s["many"]) for s in row or []):
                if joined and s[0] <= joined[-1][1]:
                    joined[-1] = [joined[-1][0], max(joined[-1][1], s[1]), joined[-1][2] or s[2]]
                else:
                    joined.append(list(s))
            out.append([{"start": a, "end": b} for a, b, many in joined if b - a >= (LEADING if many else PASSAGE)])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return merge(spans)


def repeated_passages(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, spans)`` of the documents with passages that other documents have too.

    ``spans`` are ``(start, end)`` in words (lower-cased A-Z, between ASCII white
    space), end exclusive, sorted and disjoint. Every passage of ``PASSAGE`` words
    or more that two documents share is covered, but for fewer than ``WINDOW``
    words at an end where a third document shares its middle only. Every word
    covered lies in a passage of ``LEADING`` words or more that another document
    has. Spans shorter than ``PASSAGE`` words are left out, except those that
    three or more documents share: they may be the middle of a longer one. Rows with one key are one document: what
    repeats only inside it doesn't count. Null keys, null and shorter texts have no spans. Keys
    are integers.

    Suffixes are kept where a run of words has the least hash of a window, so two
    copies of a passage keep the same ones, about one word in ten. They are
    range-sorted by leading words, document and place: a passage of any number of
    copies is cut at documents, and each suffix meets its neighbours only.
    """
    small_batches(spark)
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc"), utf8(text).alias("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(xxhash.xxh3_64_intdigest)
        for batch in batches:
            found = [suffixes(_hashes(data, memo)) for data in each(batch.column("text"))]
            doc = np.repeat(batch.column("doc").to_numpy(), [len(f[0]) for f in found])
            leading, place, further = (np.concatenate([f[i] for f in found]) if found else [] for i in range(3))
            yield pa.record_batch([pa.array(leading, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.array(further, pa.int32())], names=["leading", "doc", "place", "further"])

    kept = written(source.mapInArrow(tidy(keep), _SUFFIX), "suffixes")
    matches = _matches(kept)
    of_doc = matches.groupBy("doc").agg(F.collect_list(F.struct("place", "further", "other", "other_place", "many")).alias("found"))
    runs = written(of_doc.mapInArrow(tidy(_runs), _RUN), "runs")

    # Each end of a run, and the same place in the document that it was matched with.
    left = runs.select("doc", "start", F.lit(0).alias("side"), F.col("start").alias("at"), F.col("l_doc").alias("other"), F.col("l_place").alias("other_at"))
    right = runs.select("doc", "start", F.lit(1).alias("side"), (F.col("last") + LEADING).alias("at"), F.col("r_doc").alias("other"), (F.col("r_place") + LEADING).alias("other_at"))
    sides = left.unionByName(right)
    asked = sides.select("doc", "side", "at").unionByName(sides.select(F.col("other").alias("doc"), "side", F.col("other_at").alias("at")))
    asked = written(asked.groupBy("doc").agg(F.collect_set(F.struct("side", "at")).alias("asked")), "asked")
    # Dealt out by document at every size. What is asked is hashed, one row a document: texts are not sorted.
    texts = source.join(asked.hint("shuffle_hash"), "doc")
    near = written(texts.mapInArrow(tidy(_contexts), "doc bigint, side int, at int, near array<bigint>").dropDuplicates(["doc", "side", "at"]), "near")
    theirs = near.select(F.col("doc").alias("other"), "side", F.col("at").alias("other_at"), F.col("near").alias("theirs"))
    reach = sides.join(near, ["doc", "side", "at"]).join(theirs, ["other", "side", "other_at"])
    reach = reach.select("doc", "start", "side", "at", _common("near", "theirs").alias("n"))
    wide = reach.groupBy("doc", "start").agg(
        F.coalesce(F.max(F.when(F.col("side") == 0, F.col("n"))), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.when(F.col("side") == 1, F.col("at") + F.col("n"))), F.lit(0)).alias("until"),
    )
    ends = runs.select("doc", "start", "end", "many").join(wide, ["doc", "start"], "left")
    spans = ends.select(
        "doc",
        F.struct(
            (F.col("start") - F.coalesce("before", F.lit(0))).alias("start"), F.greatest("end", F.coalesce("until", F.lit(0))).alias("end"),
            "many",
        ).alias("span"),
    )
    out = spans.groupBy("doc").agg(F.collect_list("span").alias("all")).select("doc", _merged("all").alias("spans"))
    return out.where(F.size("spans") > 0)
