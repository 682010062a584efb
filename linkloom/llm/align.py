"""Alignment of two tokenizers' tokens: pointers of all documents of a batch advance together.

Both tokenizers cut the same bytes. Where a token of each ends at one byte the
text is cut into groups; what shares a group is linked. A state vector holds a
pointer into either token list for every stretch of every document of a batch; a step
moves all of them, hands on the cuts that it finds, and leaves out the stretches that have ended.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import share, small_batches, tidy
from linkloom.session import bucketed, written

#: Characters of text in a block, about; a longer text is a block of its own.
BLOCK_CHARS = 1 << 22
#: Distinct units encoded at a time.
UNITS = 4096
#: Units in a stretch. It bounds the steps that a block takes where texts have spaces.
STRETCH = 256
#: Pairs of a group are counted by distinct ids where there are more than so many.
WIDE = 64
SPACE = "▁"
#: Fixed value: how byte-level vocabularies cut a text before they merge.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space between two visible ASCII characters: both vocabularies begin a token there, whatever stands around it.
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def _encoder(a: str, file: dict, tokens: list[bytes]) -> Callable[[str], list[int]]:
    """Ids of a text by a byte-level vocabulary, special tokens as plain text.

    Where ids follow the order of merges, as in vocabularies without additions, ids are
    the merges' ranks; that is all that the faster library needs.
    """
    vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    special = {t["content"] for t in file["added_tokens"]}
    in_order = all(vocabulary[x] < vocabulary[y] for x, y in zip(joined, joined[1:]))
    in_order = in_order and len(set(joined)) == len(joined) and len(vocabulary.keys() - special) == 256 + len(joined)
    usual = file["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if in_order and usual and not file["normalizer"] and not file["model"].get("ignore_merges"):
        ranks = {tokens[i]: i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(a)
    model.encode_special_tokens = True
    return lambda text: model.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pair:
    """The two tokenizers, set up once a task, and the bytes of their tokens.

    A is a byte-level vocabulary (``tokenizers``), which gets a space and the
    text; B a vocabulary of pieces (``sentencepiece``), which adds the space itself.
    """

    def __init__(self, a: str, b: bytes):
        import sentencepiece

        file = json.loads(a)
        alphabet = byte_alphabet()
        vocabulary = file["model"]["vocab"] | {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes_a: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self._encode_a = _encoder(a, file, self.bytes_a)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        self.lengths = [np.fromiter(map(len, side), np.int64, len(side)) for side in (self.bytes_a, self.bytes_b)]
        # Texts may be cut before a space only if no piece holds one behind another character.
        self.cuts = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of either side; None where the tokens' bytes are not those of the text behind a space."""
        a = self._encode_a(f" {text}")
        b = self.b.encode(text, num_threads=1)
        want = b" " + text.encode("utf-8", "surrogatepass")
        if b"".join([self.bytes_a[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def encode(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Of the units' ids, as ``_ids`` gives them: for either side all of them and how many each unit has, and which units are given back.

        Units that begin and end with a visible ASCII character are encoded as one text, which both sides cut between them.
        """
        inner = [i for i, u in enumerate(units) if self.cuts and u and "!" <= u[0] <= "~" and "!" <= u[-1] <= "~"]
        line = " ".join([units[i] for i in inner])
        together = self._ids(line) if inner else None
        same, at_once = np.ones(len(units), bool), np.zeros(len(units), bool)
        sizes = [np.zeros(len(units), np.int64) for _ in range(2)]
        ids = list(together) if together else [np.zeros(0, np.int64)] * 2
        if together:
            at_once[inner] = True
            # A unit's bytes, with the space before it.
            own = [units[i] for i in inner] if line.isascii() else [units[i].encode("utf-8", "surrogatepass") for i in inner]
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            for side, lengths, size in zip(ids, self.lengths, sizes):
                size[inner] = np.diff(np.searchsorted(np.cumsum(lengths[side]), ends) + 1, prepend=0)
        if not at_once.all():
            alone = [self._ids(units[i]) for i in np.flatnonzero(~at_once).tolist()]
            same[~at_once] = [found is not None for found in alone]
            for k in range(2):
                rest = [found[k] if found else np.zeros(0, np.int64) for found in alone]
                sizes[k][~at_once] = [len(r) for r in rest]
                of_line = np.repeat(at_once, sizes[k])
                every = np.empty(len(of_line), np.int64)
                every[of_line], every[~of_line] = ids[k], np.concatenate(rest)
                ids[k] = every
        return ids, sizes, same

    def units(self, text: str) -> list[str]:
        """A text without spaces at which both sides cut it anyway: each unit is encoded as a text of its own, alike wherever it stands."""
        return _CUT.split(text) if self.cuts else [text]


def merge(ends_a: np.ndarray, ends_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, until_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of all stretches: the tokens (of A, of B) with which each group ends, in order.

    ``ends`` are the byte ends of all tokens of either side, counted on one line;
    ``at`` says where each stretch begins in them, ``until_a`` where A's part ends.
    Both sides of a stretch end at one byte. A step moves, in every stretch that is left, the pointer
    whose token ends first, or both if they end together: that is a cut.
    """
    a, b, until = at_a.copy(), at_b.copy(), until_a
    live = a < until
    a, b, until = a[live], b[live], until[live]
    cut_a, cut_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(a):
        x, y = ends_a[a], ends_b[b]
        cut = x == y
        cut_a.append(a[cut])
        cut_b.append(b[cut])
        a = a + (x <= y)
        b = b + (y <= x)
        live = a < until
        if not live.all():
            a, b, until = a[live], b[live], until[live]
    found_a, found_b = np.concatenate(cut_a), np.concatenate(cut_b)
    order = np.argsort(found_a, kind="stable")
    return found_a[order], found_b[order]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, … for each start, ``sizes`` of them."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _take(starts: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the given rows, one after the other, and how many each has."""
    sizes = starts[rows + 1] - starts[rows]
    return values[_spread(starts[rows], sizes)], sizes


def linked_pairs(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, a, b, times)`` of the links of all groups, which have so many tokens of either side, one after the other.

    A pair may come several times. The links of a wide group are counted by its distinct ids, never written out.
    """
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    wide = size_a * size_b > WIDE
    plain = np.flatnonzero(~wide)
    each_a = _spread(start_a[plain], size_a[plain])  # tokens of A, each as often as its group has tokens of B
    times_b = np.repeat(size_b[plain], size_a[plain])
    parts = [
        (
            np.repeat(doc[plain], size_a[plain] * size_b[plain]),
            np.repeat(a[each_a], times_b),
            b[_spread(np.repeat(start_b[plain], size_a[plain]), times_b)],
            np.ones(int(times_b.sum()), np.int64),
        )
    ]
    for g in np.flatnonzero(wide).tolist():
        ids_a, n_a = np.unique(a[start_a[g] : start_a[g] + size_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
        times = np.multiply.outer(n_a, n_b).ravel()
        parts.append((np.full(len(times), doc[g]), np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a)), times))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def _pack(array: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(array.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


@dataclass
class Aligned:
    """A batch of documents: tokens, groups and links. Groups and tokens of a document stand together, in order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    size_a: np.ndarray
    size_b: np.ndarray
    group_doc: np.ndarray


class Aligner:
    """Aligns batches of texts. Distinct units of a batch are encoded once."""

    def __init__(self, pair: Pair):
        self.pair = pair

    def align(self, texts: list[str | None]) -> Aligned:
        pair, streams = self.pair, []
        places: defaultdict[str, int] = defaultdict()
        places.default_factory = places.__len__  # a new unit gets the next number
        number = places.__getitem__
        for text in texts:
            units = pair.units(text) if text else []
            streams.append(np.fromiter(map(number, units), np.int64, len(units)))
        places.default_factory = None  # else it would hold itself
        names, none = list(places), np.zeros(0, np.int64)
        encoded = [pair.encode(names[at : at + UNITS]) for at in range(0, len(names), UNITS)]
        same = np.concatenate([np.zeros(0, bool), *(given for _, _, given in encoded)])
        starts = [np.concatenate([[0], np.cumsum(np.concatenate([none, *(sizes[side] for _, sizes, _ in encoded)]))]) for side in (0, 1)]
        values = [np.concatenate([none, *(ids[side] for ids, _, _ in encoded)]) for side in (0, 1)]
        # A text that either side doesn't give back has no tokens.
        streams = [s if len(s) and same[s].all() else s[:0] for s in streams]
        n_units = np.fromiter(map(len, streams), np.int64, len(streams))
        stream = np.concatenate([*streams, np.zeros(0, np.int64)])
        del places, number, names, streams, encoded
        (ids_a, of_a), (ids_b, of_b) = (_take(s, v, stream) for s, v in zip(starts, values))
        ends_a, ends_b = (np.cumsum(lengths[ids]) for lengths, ids in zip(pair.lengths, (ids_a, ids_b)))
        # Stretches of up to STRETCH units; all begin and end at a cut.
        first_unit = np.cumsum(n_units) - n_units
        n_stretches = -(-n_units // STRETCH)
        heads = _spread(np.zeros(len(n_units), np.int64), n_stretches) * STRETCH + np.repeat(first_unit, n_stretches)
        before_a, before_b = (np.concatenate([[0], np.cumsum(of)]) for of in (of_a, of_b))
        cut_a, cut_b = merge(ends_a, ends_b, before_a[heads], before_b[heads], np.append(before_a[heads], len(ids_a))[1:])
        size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        unit_doc = np.repeat(np.arange(len(n_units)), n_units)
        doc_a = np.repeat(unit_doc, of_a)
        group_doc = doc_a[cut_a] if len(cut_a) else np.zeros(0, np.int64)
        count = lambda of, w=None: np.bincount(of, weights=w, minlength=len(n_units)).astype(np.int64)
        n_b = count(np.repeat(unit_doc, of_b))
        return Aligned(count(doc_a), n_b, count(group_doc), _sums(size_a * size_b, group_doc, len(n_units)), ids_a, ids_b, size_a, size_b, group_doc)


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of integers by group number; the numbers ascend."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[np.searchsorted(of, np.arange(n), side="right")] - total[np.searchsorted(of, np.arange(n), side="left")]


def written_groups(found: Aligned) -> Iterator[bytes]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``; nothing without tokens."""
    tokens = np.concatenate([found.ids_a, found.ids_b])
    n = len(found.ids_a)
    start_a, start_b = np.cumsum(found.size_a) - found.size_a, np.cumsum(found.size_b) - found.size_b
    # A group's tokens of A stand behind all of B's before it, and B's behind A's of the group.
    place = np.empty(len(tokens), np.int64)
    place[:n] = np.arange(n) + np.repeat(start_b, found.size_a)
    place[n:] = np.arange(len(found.ids_b)) + np.repeat(start_a + found.size_a, found.size_b)
    last = np.zeros(len(tokens), bool)
    last[start_a + found.size_a - 1] = True
    last[n + start_b + found.size_b - 1] = True
    most = int(tokens.max(initial=0)) + 1
    kind = 2 * (np.arange(len(tokens)) >= n) + last
    names = [[f"{i}{sep}".encode() for i in range(most)] for sep in (",", "|", ",", ";")]
    table = np.array([name for side in names for name in side], object)
    code = np.empty(len(tokens), np.int64)
    code[place] = kind * most + tokens
    ends = np.cumsum(found.n_a + found.n_b).tolist()
    for at, end in zip([0, *ends], ends):
        yield b"".join(table[code[at:end]].tolist())[:-1]



def _blocks(docs: DataFrame, key: str, text: str, pair) -> DataFrame:
    """Blocks of documents: what is known of each, its id pairs as places in the block's dictionary, and that dictionary."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Pair(*pair()))
        n_b_ids = len(aligner.pair.bytes_b)
        number = TaskContext.get().partitionId() << 32
        keys, texts, size, key_kind = [], [], 0, None

        def block() -> pa.RecordBatch:
            found = aligner.align(texts)
            doc, a, b, times = linked_pairs(found.ids_a, found.ids_b, found.size_a, found.size_b, found.group_doc)
            pair_id = a * n_b_ids + b
            # Each document's distinct pairs, and how many of its links each stands for.
            order = np.lexsort((pair_id, doc))
            doc, pair_id, times = doc[order], pair_id[order], times[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (pair_id[1:] != pair_id[:-1])
            heads = np.flatnonzero(new)
            times = np.add.reduceat(times, heads) if len(heads) else times
            doc, pair_id = doc[heads], pair_id[heads]
            pairs, place, n_docs = np.unique(pair_id, return_inverse=True, return_counts=True)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in written_groups(found)]
            columns = [
                pa.array([number]),
                pa.array([keys], pa.list_(key_kind)),
                *(pa.array([c], pa.list_(pa.int64())) for c in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                pa.array([digests], pa.list_(pa.string())),
                pa.array([_pack(np.bincount(doc, minlength=len(keys)))], pa.binary()),
                pa.array([_pack(place)], pa.binary()),
                pa.array([times.astype(np.int64).tobytes() if len(times) and times.max() >> 32 else _pack(times)], pa.binary()),
                pa.array([bool(len(times) and times.max() >> 32)]),
                pa.array([pairs], pa.list_(pa.int64())),
                pa.array([n_docs], pa.list_(pa.int64())),
            ]
            return pa.record_batch(columns, names=_BLOCK)

        for batch in batches:
            key_kind = batch.schema.field("key").type
            for own, scalar in zip(batch.column("key").to_pylist(), batch.column("text")):
                value = scalar.as_py()
                n = len(value) if value else 0
                if size and size + n > BLOCK_CHARS:
                    yield block()
                    keys, texts, size = [], [], 0
                    number += 1
                keys.append(own)
                texts.append(value)
                size += n
        if keys:
            yield block()

    longs = ", ".join(f"{c} array<bigint>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    schema = f"block bigint, keys array<{kind}>, {longs}, digests array<string>, held binary, places binary, times binary, wide boolean, pairs array<bigint>, docs array<bigint>"
    return rows.mapInArrow(tidy(cut), schema)


_BLOCK = ["block", "keys", "n_a", "n_b", "n_groups", "n_links", "digests", "held", "places", "times", "wide", "pairs", "docs"]


def load_pair(a_path: str, b_path: str) -> tuple[str, bytes]:
    """The two vocabulary files: of a byte-level BPE (A, json) and of pieces (B, model)."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return a.read(), b.read()


def align(spark: SparkSession, docs: DataFrame, pair: tuple[str, bytes], key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, a row for every row of ``docs``.

    A space and the text are cut by A, the text by B, which adds the space;
    special tokens in a text are plain text. Byte offsets where tokens of both
    end cut them into groups, and a link is an occurrence of a token of A and one
    of B in one group. A pair of ids counts the rows of ``docs`` that hold it
    linked: ``count_sum`` adds that up over a text's links, ``n_best`` are the
    links whose count no pair with the same id of A exceeds. Texts that are null
    or empty, or that either side doesn't give back byte for byte, have no
    tokens: zeros and ``''``. Keys are only carried: they may repeat or be null. An empty table
    gives an empty result.

    A block of documents keeps its links as places in its own dictionary of id
    pairs, so a pair, however common, crosses the network once a block. Counts are
    summed by pair, map-side first, and go back to the blocks, whose table is
    bucketed by block: the places, the bulk of it, stay where they lie. The
    vocabularies are broadcast.
    """
    small_batches(spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * shuffles
    shared = share(spark, pair)
    blocks = bucketed(_blocks(docs, key, text, shared), "block", buckets, "align-blocks")
    n_b_ids = _pieces(pair[1])
    listed = blocks.select("block", F.inline(F.arrays_zip("pairs", "docs"))).toDF("block", "pair", "n")
    counts = listed.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {n_b_ids}"))
    counts = written(counts, "align-counts")
    # An id of A has a row for each id of B at most: the vocabularies bound both tables.
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    judged = counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    entries = listed.select("block", "pair").join(judged, "pair").select("block", F.struct("pair", "n", "best").alias("entry"))
    back = entries.repartition(buckets, "block").groupBy("block").agg(F.collect_list("entry").alias("entries"))
    joined = blocks.drop("pairs", "docs").join(back, "block", "left")

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                entries = row.column("entries").flatten()
                pair_id, n, best = (entries.field(f).to_numpy(zero_copy_only=False) for f in range(3))
                order = np.argsort(pair_id)  # the dictionary's own order
                n, best = n[order], best[order].astype(np.int64)
                one = lambda c: row.column(c).to_pylist()[0]
                place, times = _unpack(one("places")), np.frombuffer(one("times"), np.int64) if one("wide") else _unpack(one("times"))
                held = _unpack(one("held"))
                owner = np.repeat(np.arange(len(held)), held)
                sums = [_sums(times * of[place], owner, len(held)) for of in (best, n)]
                flat = [row.column(c).flatten() for c in ("keys", "n_a", "n_b", "n_groups", "n_links", "digests")]
                yield pa.record_batch([*flat[:5], *map(pa.array, sums), flat[5]], names=_RESULT)

    kind = docs.schema[key].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in _RESULT[1:-1])
    return joined.mapInArrow(tidy(total_up), f"key {kind}, {longs}, groups_sha256 string").withColumnRenamed("key", key)


_RESULT = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _pieces(model: bytes) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()


def token_links(spark: SparkSession, docs: DataFrame, pair: tuple[str, bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, groups)``: each text's groups, ``(a, b, start, end)``: ids of either side and where the group stands in ``space + text`` (bytes).

    A row for every row of ``docs``; texts without tokens have no groups.
    """
    small_batches(spark)
    shared = share(spark, pair)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    group = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Pair(*shared()))
        for batch in batches:
            for at in range(batch.num_rows):
                part = batch.slice(at, 1)
                found = aligner.align(part.column("text").to_pylist())
                lengths = aligner.pair.lengths[0][found.ids_a]
                ends = np.cumsum(lengths)[np.cumsum(found.size_a) - 1] if len(found.ids_a) else np.zeros(0, np.int64)
                sides = [np.split(ids, np.cumsum(size)[:-1]) if len(ids) else [] for ids, size in ((found.ids_a, found.size_a), (found.ids_b, found.size_b))]
                groups = [{"a": a, "b": b, "start": s, "end": e} for a, b, s, e in zip(*sides, [0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.record_batch([part.column("key"), pa.array([groups], group)], names=["key", "groups"])

    schema = f"key {kind}, groups array<struct<a: array<int>, b: array<int>, start: bigint, end: bigint>>"
    return rows.mapInArrow(tidy(cut), schema).withColumnRenamed("key", key)
