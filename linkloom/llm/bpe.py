"""Byte-level BPE: every distinct word is encoded once for the whole table.

Documents are cut into pre-tokens. A block of documents keeps them as positions
in its own dictionary of distinct words, so that a word crosses the network once
a block, not once an occurrence. The dictionaries meet by word, each distinct
word is encoded, and the ids go back to the blocks, whose positions put each
document's ids together in order.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import per_row, ragged, share, small_batches, tidy
from linkloom.session import bucketed

#: Characters of text in a block, about; a longer text is a block of its own.
BLOCK_CHARS = 1 << 23
#: Rows of ids handed over at a time, and their ids, about.
OUT_ROWS, OUT_IDS = 500, 1 << 20
#: Rows decoded at a time.
DECODE_ROWS = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a vocabulary file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _pack(array: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, their bytes by significance, compressed."""
    planes = np.ascontiguousarray(array.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.dtype("<u4"), len(words))
    head = np.array([len(words)], "<u4").tobytes() + lengths.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4)).tolist()
    body = data[4 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends], ends)]


class _Places(dict):
    """A word's place in order of first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _blocks(docs: DataFrame, key: str, text: str, pattern: str, buckets: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        number = TaskContext.get().partitionId() << 32
        keys, streams, places = [], [], _Places()
        size = 0

        def block() -> pa.RecordBatch:
            words = [word.encode() for word in places]
            bucket = np.fromiter((zlib.crc32(word) % buckets for word in words), np.int64, len(words))
            # The dictionary is ordered by bucket, and the positions refer to that order.
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist()
            parts = [
                {"bucket": int(bucket[order[a]]), "words": _pack_words([words[i] for i in order[a:b].tolist()])}
                for a, b in zip(cuts, cuts[1:])
            ]
            lengths = np.fromiter(map(len, streams), np.uint32, len(streams))
            stream = place[np.concatenate([*streams, np.zeros(0, np.uint32)])]
            part_kind = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))
            return pa.record_batch(
                [
                    pa.array([number]),
                    pa.array([keys], pa.list_(key_kind)),
                    pa.array([_pack(lengths)], pa.binary()),
                    pa.array([_pack(stream)], pa.binary()),
                    pa.array([parts], part_kind),
                ],
                names=["block", "keys", "lengths", "stream", "parts"],
            )

        for batch in batches:
            key_kind = batch.schema.field("key").type
            for own, scalar in zip(batch.column("key").to_pylist(), batch.column("text")):
                value = scalar.as_py()  # one text at a time
                n = len(value) if value else 0
                if size and size + n > BLOCK_CHARS:
                    yield block()
                    keys, streams, places = [], [], _Places()
                    number, size = number + 1, 0
                found = split(value) if value else []
                keys.append(own)
                streams.append(np.fromiter(map(places.__getitem__, found), np.uint32, len(found)))
                size += n
        if keys:
            yield block()

    schema = f"block bigint, keys array<{kind}>, lengths binary, stream binary, parts array<struct<bucket: int, words: binary>>"
    return rows.mapInArrow(tidy(cut), schema)


def encode(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """``(key, ids)``: each whole text's token ids, a row for every row of ``docs``.

    ``pattern`` cuts a text into words, which are encoded separately by ``ranks``;
    there are no special tokens. Null and empty texts have no ids. Keys are only
    carried: they may repeat or be null. An empty table gives an empty result.

    Blocks are written once. Their words are dealt out by hash to ``buckets``
    (four for each shuffle partition by default): a word, however common, is
    there at most once a block, so no bucket is hot. What goes back to a block is
    bounded by its size. The blocks' table is bucketed by block, so the positions,
    the bulk of it, are joined where they lie. The vocabulary is broadcast.
    """
    small_batches(spark)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = share(spark, (ranks, pattern))
    blocks = bucketed(_blocks(docs, key, text, pattern, buckets), "block", buckets, "blocks")
    words = blocks.select("block", F.explode("parts").alias("part")).select("block", "part.bucket", "part.words")

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pattern = shared()
        encoder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        bucket, known = None, {}
        for batch in batches:
            out = []
            for own, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if own != bucket:
                    bucket, known = own, {}
                names = _unpack_words(packed)
                for word in names:
                    if word not in known:
                        known[word] = encoder.encode_ordinary(word.decode())
                ids = [known[word] for word in names]
                lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter((i for row in ids for i in row), np.uint32, int(lengths.sum()))
                out.append((_pack(lengths), _pack(flat)))
            sides = [pa.array([row[i] for row in out], pa.binary()) for i in (0, 1)]
            yield pa.record_batch([batch.column("block"), batch.column("bucket"), *sides], names=["block", "bucket", "lengths", "ids"])

    dealt = words.repartition("bucket").sortWithinPartitions("bucket")
    encoded = dealt.mapInArrow(tidy(encode_words), "block bigint, bucket int, lengths binary, ids binary")
    back = encoded.repartition(buckets, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "lengths", "ids"))).alias("parts"))
    joined = blocks.select("block", "keys", F.col("lengths").alias("rows"), "stream").join(back, "block", "left")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                parts = row.column("parts").to_pylist()[0] or []
                lengths = np.concatenate([_unpack(p["lengths"]) for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
                ids = np.concatenate([_unpack(p["ids"]) for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int32)
                table = ragged(lengths, pa.array(ids))
                stream = _unpack(row.column("stream").to_pylist()[0])
                ends = np.concatenate([[0], np.cumsum(_unpack(row.column("rows").to_pylist()[0]).astype(np.int64))])
                keys = row.column("keys").flatten()
                tokens = np.concatenate([[0], np.cumsum(lengths[stream])])  # before each position
                at = 0
                while at < len(keys):
                    most = np.searchsorted(tokens[ends], tokens[ends[at]] + OUT_IDS, side="right") - 1
                    end = min(len(keys), at + OUT_ROWS, max(at + 1, int(most)))
                    taken = table.take(pa.array(stream[ends[at] : ends[end]])).flatten()
                    sizes = np.diff(tokens[ends[at : end + 1]])
                    yield pa.record_batch([keys.slice(at, end - at), ragged(sizes, taken)], names=["key", "ids"])
                    at = end

    kind = docs.schema[key].dataType.simpleString()
    return joined.mapInArrow(tidy(assemble), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(spark: SparkSession, encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of each row's ids in column ``name``.

    Ids join the token-byte table, which has a row for each token of the
    vocabulary and is broadcast for that; each id finds its row by number. An
    id without a token is an error. Null ids give null, no ids no bytes. All rows
    and columns stay; a column of that name is replaced.
    """
    small_batches(spark)
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = share(spark, table)

    def start():
        tokens = pa.array(shared(), pa.large_binary())

        def join(rows: pa.Array) -> pa.Array:
            parts = [some(rows.slice(at, DECODE_ROWS)) for at in range(0, len(rows), DECODE_ROWS)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

        def some(rows: pa.Array) -> pa.Array:
            lengths = pa.compute.fill_null(pa.compute.list_value_length(rows), 0).to_numpy()
            found = tokens.take(rows.flatten())
            if found.null_count:
                raise ValueError("an id that no token has")
            _, at, data = found.buffers()
            starts = np.frombuffer(at, np.int64, len(found) + 1, found.offset * 8) if len(found) else np.zeros(1, np.int64)
            ends = starts[np.concatenate([[0], np.cumsum(lengths)])]
            offsets = pa.py_buffer(ends.astype(np.int64).tobytes())
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, offsets, data or pa.py_buffer(b"")]).cast(pa.binary())
            return pa.compute.if_else(rows.is_null(), pa.scalar(None, pa.binary()), out) if rows.null_count else out

        return join

    return encoded.withColumn(name, per_row(start, "binary")(F.col(ids)))


def ids_sha256(ids: str | Column) -> Column:
    """SHA-256 of each row's ids as little-endian unsigned 32-bit integers, in lower-case hex."""

    def start():
        def digest(rows: pa.Array) -> pa.Array:
            values = rows.flatten().to_numpy(zero_copy_only=False)
            lengths = pa.compute.fill_null(pa.compute.list_value_length(rows), 0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            return pa.array([hashlib.sha256(values[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())

        return digest

    return per_row(start, "string")(ids if isinstance(ids, Column) else F.col(ids))
