"""LM scoring: marginal likelihood of a text over all its segmentations into subword pieces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import HashArray, each, share, small_batches, tidy, words
from linkloom.session import written

START = "▁"
#: Characters of text in a block, about; a longer text is a block of its own.
BLOCK_CHARS = 1 << 25
#: Rounds that fit the vocabulary's weights to the corpus.
ROUNDS = 2
#: Added to a piece's expected count.
SMOOTHING = 0.1
#: Base: added to a token's count.
BASE_SMOOTHING = 0.1
END = "\n"  # stands for the end of a text; no word holds it
#: Characters of words whose edges are held at a time.
WINDOW = 1 << 16
#: Rows of words that are gathered before they are walked.
GATHERED = 1 << 14

_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def load_scores(path: str) -> dict[str, float]:
    """The pieces of a sentencepiece model and their scores; ``<0xNN>`` are the byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in usual}
    return {piece: score for piece, score in scores.items() if START not in piece[1:]}


def first_weights(scores: dict[str, float]) -> dict[str, float]:
    """Natural log probabilities from the vocabulary's scores.

    Its scores order the pieces by how early they were merged, so the better
    a score the likelier a piece, by Zipf's law; the end of a text counts as a piece.
    """
    order = sorted(scores, key=lambda p: (-scores[p], p))
    weights = {piece: -math.log(rank + 10.0) for rank, piece in enumerate([END, *order])}
    total = math.log(sum(map(math.exp, weights.values())))
    return {piece: w - total for piece, w in weights.items()}


class Lattice:
    """Sums over the segmentations of words, of many words at a time and in log space.

    An edge is a piece of the vocabulary, or for one character its UTF-8 bytes
    as byte pieces, so every word has a segmentation. Edges are found by walking
    the pieces' prefixes from all places at once. Those of ``WINDOW`` characters are
    held at a time; of a longer word only two numbers a character stay.
    """

    def __init__(self, weights: dict[str, float]):
        self.pieces = list(weights)
        self._weight = np.fromiter(weights.values(), float, len(weights))
        self._own = {piece: i for i, piece in enumerate(self.pieces)}
        prefixes = {piece[:n]: -1 for piece in self.pieces for n in range(1, len(piece) + 1)} | self._own
        self._longest = max(map(len, prefixes))
        steps = [np.array([_code(p)[n] if n < len(p) else 0 for p in prefixes], np.uint64) for n in range(self._longest)]
        size = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
        state = np.zeros(len(prefixes), np.uint64)
        for n, codes in enumerate(steps):
            state = np.where(n < size, _step(state, codes), state)
        self._nodes = HashArray.of(_mix(state), np.fromiter(prefixes.values(), np.int64, len(prefixes)))
        self._bytes: dict[int, int] = {}  # characters without a piece, and their numbers behind the pieces
        self._byte_weight: list[float] = []

    def _byte_names(self, code: int) -> list[str]:
        return [f"<0x{b:02X}>" for b in chr(code).encode("utf-8", "surrogatepass")]

    def _by_bytes(self, codes: np.ndarray) -> np.ndarray:
        """Edge numbers of characters that are no piece."""
        kinds, place = np.unique(codes, return_inverse=True)
        for code in kinds.tolist():
            if code not in self._bytes:
                self._bytes[code] = len(self._bytes)
                self._byte_weight.append(sum(self._weight[self._own[n]] for n in self._byte_names(code)))
        return np.fromiter((self._bytes[c] for c in kinds.tolist()), np.int64, len(kinds))[place] + len(self.pieces)

    def _edges(self, code: np.ndarray, until: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, length, number)`` of the edges from the places ``low`` to ``high`` on."""
        start, state = np.arange(low, high), np.zeros(high - low, np.uint64)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        for n in range(1, self._longest + 1):
            state = _step(state, code[start + n - 1].astype(np.uint64))
            node = self._nodes.find(_mix(state))
            piece = np.where(node >= 0, self._nodes.values[node], -1)
            hit = piece >= 0
            found.append((start[hit], n, piece[hit]))
            if n == 1:
                found.append((start[~hit], 1, self._by_bytes(code[start[~hit]])))
            live = (node >= 0) & (start + n < until[start])
            start, state = start[live], state[live]
            if not len(start):
                break
        length = np.repeat([n for _, n, _ in found], [len(s) for s, _, _ in found])
        return np.concatenate([s for s, _, _ in found]), length, np.concatenate([p for _, _, p in found])

    def _summed(self, words: list[str], times: np.ndarray | None) -> np.ndarray:
        """Log probabilities of the words, or with ``times`` the expected uses of each edge number in so many copies of them."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(size)
        until = np.repeat(ends, size)
        own = np.repeat(np.arange(len(words)), size)
        # A word has a node before, between and behind its characters.
        first = ends - size + np.arange(len(words))
        forward = np.full(len(code) + len(words), -np.inf)
        forward[first] = 0.0
        inside = np.arange(len(code)) - np.repeat(ends - size, size)
        windows = [(low, min(low + WINDOW, len(code))) for low in range(0, len(code), WINDOW)]

        def edges(low: int, high: int):
            start, length, number = self._edges(code, until, low, high)
            weights = np.concatenate([self._weight, np.array(self._byte_weight)])[number]
            return start + own[start], length, number, weights, inside[start], own[start]

        once = edges(*windows[0]) if len(windows) == 1 else None
        for window in windows:
            left, length, _, weights, place, _ = once or edges(*window)
            for some, at, heads in _steps(place + length, left + length):
                terms = forward[left[some]] + weights[some]
                forward[at] = np.logaddexp(forward[at], _log_sums(terms, heads))
        total = forward[first + size]
        if times is None:
            return total
        backward = np.full(len(forward), -np.inf)
        backward[first + size] = 0.0
        uses = np.zeros(len(self.pieces))
        for window in reversed(windows):
            left, length, number, weights, place, word = once or edges(*window)
            for some, at, heads in _steps(-place, left):
                backward[at] = _log_sums(weights[some] + backward[left[some] + length[some]], heads)
            use = times[word] * np.exp(forward[left] + weights + backward[left + length] - total[word])
            most = max(len(uses), len(self.pieces) + len(self._bytes))
            uses = np.pad(uses, (0, most - len(uses))) + np.bincount(number, weights=use, minlength=most)
        return uses

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logs of the sums over all segmentations, by forward recursion."""
        out = [self._summed(part, None) for part, _ in _packs(words)]
        return np.concatenate([*out, np.zeros(0)])

    def add_expected(self, words: list[str], times: np.ndarray, counts: dict[str, float]) -> None:
        """Add each piece's expected uses in so many copies of each word."""
        names = {number: code for code, number in self._bytes.items()}
        for part, at in _packs(words):
            uses = self._summed(part, times[at : at + len(part)])
            if len(self._bytes) > len(names):
                names = {number: code for code, number in self._bytes.items()}
            for number in np.flatnonzero(uses).tolist():
                behind = number - len(self.pieces)
                for name in [self.pieces[number]] if behind < 0 else self._byte_names(names[behind]):
                    counts[name] = counts.get(name, 0.0) + float(uses[number])


def _code(text: str) -> list[int]:
    return [ord(c) for c in text]


def _step(state: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return state * _MULTIPLIER + codes + np.uint64(1)


def _mix(state: np.ndarray) -> np.ndarray:
    h = (state ^ (state >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _steps(when: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edges by turn: those of one turn, the nodes that they meet in, and where each node's edges begin."""
    order = np.lexsort((node, when))
    turn, met = when[order], node[order]
    cuts = np.flatnonzero(np.diff(turn, prepend=turn[:1] - 1)).tolist() if len(turn) else []
    new = np.ones(len(met), bool)
    new[1:] = met[1:] != met[:-1]
    for low, high in zip(cuts, [*cuts[1:], len(turn)]):
        heads = np.flatnonzero(new[low:high]) if high - low > 1 else np.zeros(1, np.int64)
        if not len(heads) or heads[0]:
            heads = np.concatenate([[0], heads])
        yield order[low:high], met[low:high][heads], heads


def _log_sums(terms: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of the terms from each head to the next."""
    top = np.maximum.reduceat(terms, heads)
    size = np.diff(heads, append=len(terms))
    return top + np.log(np.add.reduceat(np.exp(terms - np.repeat(top, size)), heads))


def _packs(words: list[str]) -> Iterator[tuple[list[str], int]]:
    """Runs of words of about ``WINDOW`` characters, and where each begins; a longer word is alone."""
    at, size = 0, 0
    for i, word in enumerate(words):
        if size and size + len(word) > WINDOW:
            yield words[at:i], at
            at, size = i, 0
        size += len(word)
    if at < len(words):
        yield words[at:], at


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(array.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4").astype(np.int64)


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


def _blocks(docs: DataFrame, key: str, text: str, learned: Column) -> DataFrame:
    """Blocks of documents: each word of each as a place in the block's dictionary, which also has training counts."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, marks, streams, places, size = [], [], [], _Places(), 0

        def block() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, streams), np.uint32, len(streams))
            stream = np.concatenate([*streams, np.zeros(0, np.uint32)]).astype(np.uint32)
            seen = np.bincount(stream, weights=np.repeat(np.array(marks, float), lengths), minlength=len(places))
            dictionary = pa.StructArray.from_arrays(
                [pa.array(list(places), pa.binary()).cast(pa.string()), pa.array(seen.astype(np.int64))], names=["word", "n"]
            )
            columns = [
                pa.array([number]),
                pa.array([keys], pa.list_(key_kind)),
                pa.array([marks], pa.list_(pa.bool_())),
                pa.array([_pack(lengths)], pa.binary()),
                pa.array([_pack(stream)], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(dictionary)], pa.int32()), dictionary),
            ]
            return pa.record_batch(columns, names=["block", "keys", "marks", "lengths", "stream", "words"])

        for batch in batches:
            key_kind = batch.schema.field("key").type
            for own, data, mark in zip(*map(each, (batch.column(c) for c in ("key", "text", "learned")))):
                n = len(data) if data else 0
                if size and size + n > BLOCK_CHARS:
                    yield block()
                    keys, marks, streams, places, size = [], [], [], _Places(), 0
                    number += 1
                found = words(data)
                keys.append(own)
                marks.append(mark)
                streams.append(np.fromiter(map(places.__getitem__, found), np.uint32, len(found)))
                size += n
        if keys:
            yield block()

    schema = f"block bigint, keys array<{kind}>, marks array<boolean>, lengths binary, stream binary, words array<struct<word: string, n: bigint>>"
    return rows.mapInArrow(tidy(cut), schema)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``GATHERED`` narrow rows, or of one large batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED or sum(b.nbytes for b in held) >= 1 << 20:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def fit(spark: SparkSession, counts: DataFrame, n_texts: int, scores: dict[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """The vocabulary's weights fitted to training words ``(word, c)`` by expectation maximisation.

    A round shares every word's count out to the pieces of its segmentations,
    in parallel; the driver gets a row a piece of the vocabulary.
    """
    weights = first_weights(scores)
    learned = counts.where(F.col("c") > 0).select("word", "c")
    for _ in range(rounds):
        shared = share(spark, weights)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, totals = Lattice(shared()), {}
            for batch in gathered(batches):
                lattice.add_expected([START + w for w in batch.column("word").to_pylist()], batch.column("c").to_numpy(), totals)
            yield pa.record_batch([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.float64())], names=["piece", "n"])

        found = learned.mapInArrow(tidy(expect), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        shared.release()
        expected = {row["piece"]: row["n"] for row in found} | {END: float(n_texts)}
        total = math.log(sum(expected.values()) + SMOOTHING * len(weights))
        weights = {piece: math.log(expected.get(piece, 0.0) + SMOOTHING) - total for piece in weights}
    return weights


def score(spark: SparkSession, docs: DataFrame, learned: Column, scores: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Likelihoods of every whole text, a row for every row of ``docs``.

    ``(key, learned, n_tokens, n_known, train_tokens, base_score, score)``. Words
    are lower-cased (A-Z), stand between ASCII white space, and are followed by
    one end; null and empty texts are the end alone. Rows for which ``learned``
    holds are learned from (null: not). ``score`` is the log10 probability of
    the words and the end: each word is ``▁word``, generated by pieces drawn
    independently, and all its segmentations count. ``base_score`` is that of
    single tokens, smoothed. Keys are only carried: they may repeat or be null.
    Without training documents every count is 0.

    The words of a block of documents are looked up as one dictionary, so a
    common word crosses the network once a block. Counts and likelihoods of
    distinct words are computed once, wherever the word is dealt.
    """
    small_batches(spark)
    blocks = written(_blocks(docs, key, text, learned), "lm-blocks")
    listed = blocks.select("block", F.posexplode("words").alias("place", "w")).select("block", "place", "w.word", "w.n")
    counts = written(listed.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_texts = blocks.agg(F.sum(F.size(F.filter("marks", lambda m: m)))).first()[0] or 0
    n_train = (total["n"] or 0) + n_texts
    n_distinct = (total["v"] or 0) + (1 if n_texts else 0)
    weights = fit(spark, counts, n_texts, scores)
    shared = share(spark, weights)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared())
        for batch in gathered(batches):
            found = lattice.log_probabilities([START + w for w in batch.column("word").to_pylist()])
            yield pa.record_batch([batch.column("word"), batch.column("c"), pa.array(found)], names=["word", "c", "p"])

    marked = written(counts.mapInArrow(tidy(mark), "word string, c bigint, p double"), "lm-scored")
    entries = listed.select("block", "place", "word").join(marked, "word").select("block", F.struct("place", "c", "p").alias("entry"))
    back = entries.groupBy("block").agg(F.collect_list("entry").alias("entries"))
    joined = blocks.drop("words").join(back, "block", "left")

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + BASE_SMOOTHING) / (n_train + BASE_SMOOTHING * (n_distinct + 1)))

    log10 = math.log(10)
    end_score, end_base = weights[END] / log10, float(base(np.array(float(n_texts))))
    end_known = 1 if n_texts else 0

    def total_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                entries = row.column("entries").flatten()
                place, c, p = (entries.field(f).to_numpy() for f in range(3))
                known, base_of, p_of = (np.zeros(len(place) + 1) for _ in range(3))  # one more, for no words
                known[place], base_of[place], p_of[place] = c > 0, base(c), p / log10
                lengths, stream = (_unpack(row.column(n).to_pylist()[0]) for n in ("lengths", "stream"))
                owner = np.repeat(np.arange(len(lengths)), lengths)
                sums = [np.bincount(owner, weights=of[stream], minlength=len(lengths)) for of in (known, base_of, p_of)]
                n = len(lengths)
                yield pa.record_batch(
                    [
                        row.column("keys").flatten(),
                        row.column("marks").flatten(),
                        lengths + 1,
                        sums[0].astype(np.int64) + end_known,
                        np.full(n, n_train, np.int64),
                        sums[1] + end_base,
                        sums[2] + end_score,
                    ],
                    names=["key", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema[key].dataType.simpleString()
    out = "learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return joined.mapInArrow(tidy(total_up), f"key {kind}, {out}").withColumnRenamed("key", key)
