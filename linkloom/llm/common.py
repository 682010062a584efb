"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.sources.tables import table

WORD = r"[^\x20\x09-\x0D]+"

#: A task's memo of words is emptied when it has so many entries; that bounds memory, not results.
MEMO_WORDS = 1 << 18
#: Rows of text that a worker is given at a time, and their bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The given columns of the whole ``documents`` table."""
    return table(spark, folder, "documents").select(*columns)


def utf8(text: str | Column) -> Column:
    """A text as UTF-8 bytes: Python workers then decode only what they need."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space; none without text.

    ``bytes.lower`` and ``bytes.split`` treat exactly A-Z and ``\\x20\\x09-\\x0D``.
    """
    return data.lower().split() if data else []


def remainder(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; null without a key."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % parts


def small_batches(spark: SparkSession) -> None:
    """Have texts go to Python in batches of ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes, whichever is less.

    Spark's defaults (10,000 rows, 64 MB) are meant for narrow rows. A setting of
    the session's own stays. It changes no result, and holds for the session's later queries too.
    """
    for name, ours in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        setting = f"spark.sql.execution.arrow.max{name}PerBatch"  # a number that nobody sets tells that it is unset
        if spark.conf.get(setting, "1234567") == "1234567":
            spark.conf.set(setting, str(ours))


class Shared:
    """A broadcast model of bounded size. Called inside tasks it gives the model: one copy a worker, none a task."""

    def __init__(self, spark: SparkSession, model):
        self._model = spark.sparkContext.broadcast(model)

    def __call__(self):
        return self._model.value

    def release(self) -> None:
        """Free it everywhere. Only when all that used it has been written."""
        self._model.destroy()


def share(spark: SparkSession, model) -> Shared:
    """Broadcast a model of bounded size; what is returned gives it inside tasks. Models must not be changed there."""
    return Shared(spark, model)


#: Rows below which a group is ranked as a whole.
_RANKED = 64


def least_hashes(rows: DataFrame, group: str, most: int, order: list[str]) -> DataFrame:
    """Of each group of distinct rows ``(group, u, …)`` the ``most`` of the least hashes ``u``, with their ``rank``.

    All of a group that has fewer. ``rows`` should be a written table: it is read
    twice. What is ranked is cut by hash first, to about four times ``most``: no
    task gets more of a group. Ties go by ``order``. The driver gets a row a group.
    """
    share_of = F.lit(False)
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).collect()
    for row in sorted(sizes, key=lambda r: str(r[group])):
        low = min(1.0, 4 * max(most, _RANKED) / row["n"]) * (1 << 40)
        share_of = share_of | ((F.col(group) == row[group]) & (F.pmod("u", F.lit(1 << 40)) <= int(low)))
    by_hash = Window.partitionBy(group).orderBy(F.pmod("u", F.lit(1 << 40)), *order)
    return rows.where(share_of).withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= most)


def if_small(df: DataFrame, size: Column, most: int) -> DataFrame:
    """A written table to join with: broadcast if its rows, of ``size`` bytes each, hold no more than ``most`` in all."""
    held = df.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


@dataclass
class HashArray:
    """Sorted hashes with a row of values each; a bucket index by the leading bits shortens the search."""

    keys: np.ndarray
    values: np.ndarray
    first: np.ndarray
    shift: int

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> HashArray:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        bits = max(8, int(len(keys)).bit_length() + 1)
        edges = np.arange((1 << bits) + 1, dtype=np.uint64)
        first = np.searchsorted(keys >> np.uint64(64 - bits), edges).astype(np.int32)
        # One entry that no search runs past.
        return HashArray(np.append(keys, np.uint64(0)), values[order], first, 64 - bits)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted keys; -1 where there is none."""
        bucket = (wanted >> np.uint64(self.shift)).astype(np.int64)
        place, end = self.first[bucket], self.first[bucket + 1]
        hit = (self.keys[place] == wanted) & (place < end)
        found = np.where(hit, place, -1)
        rest = np.flatnonzero(~hit & (place + 1 < end))
        while len(rest):
            at = place[rest] + 1
            place[rest] = at
            hit = self.keys[at] == wanted[rest]
            found[rest[hit]] = at[hit]
            rest = rest[~hit & (at + 1 < end[rest])]
        return found


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over batches that gives freed memory back when it ends: workers outlive their tasks."""

    def run(batches: Iterator) -> Iterator:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


class Memo(dict):
    """``memo[word]`` computes a missing entry once."""

    def __init__(self, compute: Callable, most: int = MEMO_WORDS):
        super().__init__()
        self._compute, self._most = compute, most

    def __missing__(self, word):
        if len(self) >= self._most:
            self.clear()
        self[word] = value = self._compute(word)
        return value


def each(array: pa.Array) -> Iterator:
    """The values of an array one after the other, so that a batch of texts is never held twice."""
    return (scalar.as_py() for scalar in array)


def per_row(compute: Callable[[], Callable[[pa.Array], pa.Array]], kind: str) -> Callable[..., Column]:
    """An Arrow function of one column whose state is set up once a task."""

    @tidy
    def steps(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = compute()
        for array in arrays:
            yield run(array)

    @F.arrow_udf(kind)
    def apply(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return steps(arrays)

    return apply


def ragged(lengths: np.ndarray, values: pa.Array, large: bool = False) -> pa.Array:
    """A list array from row lengths and the concatenated values."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64 if large else np.int32)
    np.cumsum(lengths, out=offsets[1:])
    kind = pa.LargeListArray if large else pa.ListArray
    return kind.from_arrays(pa.array(offsets), values)
