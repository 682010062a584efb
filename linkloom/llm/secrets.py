"""Secret scans: base patterns, and format automata inferred from the credentials these find."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import each, per_row, share, small_batches, tidy
from linkloom.session import written

#: The patterns of the base kinds, in order, with the group whose length counts and its least length.
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
KINDS = tuple(BASE)

#: What the method may call a credential: a run of these characters of such a length. Dots stand inside only.
CANDIDATE = r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9+/_=-]"

#: Labelled credentials learned from, of each kind, and plain long words, at most (those with the smallest hashes).
SAMPLE = 4000
LEARN_LENGTH = 512
#: Classes of characters that a candidate is made of, and its end: what a character is worth where nothing is known.
CLASSES = 11
ALPHA = 0.05  # Hoeffding bound of the compatibility test
LEAST_COUNT = 10  # states seen less often are merged without a test
#: Least log10 likelihood per character over that of plain words, and in all, of a credential.
PER_CHARACTER, IN_ALL = 0.25, 8.0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base matches, by start, then kind as listed."""
    if not text:
        return []
    found = []
    for rank, (pattern, group, least) in enumerate(_PATTERNS.values()):
        found += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(start, end, KINDS[rank]) for start, rank, end in sorted(found)]


def _fast(kind: str, pattern: str, least: int) -> str:
    """A run that must have ``least`` characters can be asked for by the pattern: the same matches, found sooner."""
    if kind == "hex":
        return rf"[0-9a-f]{{{least},}}"
    return pattern


#: ASCII letters only in either case: the keywords are not to match letters such as U+017F.
_PATTERNS = {
    kind: (re.compile(_fast(kind, pattern, least), re.ASCII | (re.IGNORECASE if kind == "assign" else 0)), group, least)
    for kind, (pattern, group, least) in BASE.items()
}
_CANDIDATE = re.compile(CANDIDATE)


def symbols(value: str) -> str:
    """Characters as the classes that formats are made of: upper case, lower case a-f and g-z, digits, the rest itself."""
    return value.translate(_CLASSES)


_CLASSES = {
    **{ord(c): "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"},
    **{ord(c): "f" for c in "abcdef"},
    **{ord(c): "z" for c in "ghijklmnopqrstuvwxyz"},
    **{ord(c): "0" for c in "0123456789"},
}
END = "$"


class Grammar:
    """A probabilistic automaton inferred from strings by state merging.

    The prefix tree of the strings is walked breadth-first. A state is merged
    with an earlier one when their end and transition frequencies, and those of
    all that follows, differ by no more than the Hoeffding bound; merging folds
    the subtrees together. Rare subtrees carry too little evidence to be told
    apart and merge with the first state that they don't contradict.
    """

    def __init__(self, strings: Iterable[str], alpha: float = ALPHA, least: int = LEAST_COUNT):
        self._next: list[dict[str, int]] = [{}]
        self._count: list[dict[str, int]] = [{}]
        for string in strings:
            state = 0
            for symbol in [*string, END]:
                self._count[state][symbol] = self._count[state].get(symbol, 0) + 1
                if symbol == END:
                    break
                if symbol not in self._next[state]:
                    self._next[state][symbol] = len(self._next)
                    self._next.append({})
                    self._count.append({})
                state = self._next[state][symbol]
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._least = least
        self._merge()
        self._weigh()

    def _total(self, state: int) -> int:
        return sum(self._count[state].values())

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if min(n, m) < self._least:
                continue
            bound = self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for symbol in self._count[a].keys() | self._count[b].keys():
                if abs(self._count[a].get(symbol, 0) / n - self._count[b].get(symbol, 0) / m) > bound:
                    return False
            todo += [(to, self._next[b][s]) for s, to in self._next[a].items() if s in self._next[b] and to != self._next[b][s]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for symbol, n in self._count[b].items():
                self._count[a][symbol] = self._count[a].get(symbol, 0) + n
            for symbol, to in self._next[b].items():
                if symbol in self._next[a]:
                    if self._next[a][symbol] != to:
                        todo.append((self._next[a][symbol], to))
                else:
                    self._next[a][symbol] = to

    def _merge(self) -> None:
        kept, edge = [0], [(0, s) for s in sorted(self._next[0])]
        while edge:
            edge.sort(key=lambda e: -self._total(self._next[e[0]][e[1]]))
            state, symbol = edge.pop(0)
            blue = self._next[state][symbol]
            if blue in kept:
                continue
            for red in kept:
                if self._compatible(red, blue):
                    self._next[state][symbol] = red
                    self._fold(red, blue)
                    break
            else:
                kept.append(blue)
            edge = [(r, s) for r in kept for s in sorted(self._next[r]) if self._next[r][s] not in kept]
        self._kept = kept

    def _weigh(self) -> None:
        place = {state: i for i, state in enumerate(self._kept)}
        self.moves = []
        for state in self._kept:
            total = self._total(state) + 1.0
            self.moves.append(
                {s: (math.log10(n / total), place[self._next[state][s]] if s != END else -1) for s, n in self._count[state].items()}
            )
            self.moves[-1][""] = (-math.log10(total) - 2, 0)  # a symbol never seen here, out of about a hundred
        del self._next, self._count, self._kept

    def likelihood(self, string: str) -> float:
        """log10 probability."""
        total, state = 0.0, 0
        for symbol in [*string, END]:
            weight, to = self.moves[state].get(symbol, self.moves[state][""])
            total, state = total + weight, max(to, 0)
        return total


class Formats:
    """The grammars of the kinds, and that of plain words to compare with (every word is as likely without any)."""

    def __init__(self, credentials: dict[str, list[str]], plain: list[str]):
        self.kinds = {kind: Grammar(map(symbols, values)) for kind, values in sorted(credentials.items()) if values}
        self.plain = Grammar(map(symbols, plain)) if plain else None

    def _plain(self, shape: str) -> float:
        return self.plain.likelihood(shape) if self.plain else -(len(shape) + 1) * math.log10(CLASSES)

    def _best(self, shape: str) -> float:
        return max(g.likelihood(shape) for g in self.kinds.values())

    def is_credential(self, value: str, known: tuple[int, int] | None = None) -> bool:
        """Whether a run is likelier by a format than as a plain word.

        ``known`` is the part of it that a base pattern found: it may then also be that
        format with any characters before and behind.
        """
        if not self.kinds:
            return False
        shape = symbols(value)
        likely = self._best(shape)
        if known:
            rest = len(value) - (known[1] - known[0])
            likely = max(likely, self._best(shape[known[0] : known[1]]) - rest * math.log10(CLASSES))
        gain = likely - self._plain(shape)
        return gain >= IN_ALL and gain >= PER_CHARACTER * len(value)


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[re.Match, tuple[int, int, str] | None]]:
    """Runs that lie inside no base span, each with the longest base span that it overlaps; one sweep over both."""
    at, live = 0, []
    for match in _CANDIDATE.finditer(text):
        start, end = match.span()
        while at < len(base) and base[at][0] < end:
            live.append(base[at])
            at += 1
        live = [s for s in live if s[1] > start]
        if not any(s[0] <= start and end <= s[1] for s in live):
            yield match, max(live, key=lambda s: (min(s[1], end) - max(s[0], start), -s[0]), default=None)


def _known(text: str, match: re.Match, span: tuple[int, int, str] | None) -> tuple[int, int] | None:
    """Where a base span's credential lies in a run."""
    if span is None:
        return None
    start = _PATTERNS["assign"][0].match(text, span[0]).start(2) if span[2] == "assign" else span[0]
    low, high = max(start, match.start()), min(span[1], match.end())
    return (low - match.start(), high - match.start()) if low < high else None


def spans(text: str | None, formats: Formats) -> tuple[list, list]:
    """The base spans, and those that the formats add: runs that reach beyond base spans, or touch none."""
    base = base_spans(text)
    found = candidates(text or "", base)
    return base, [(*m.span(), "format") for m, span in found if formats.is_credential(m.group(), _known(text, m, span))]


def _labelled(text: str | None) -> Iterator[tuple[str, str]]:
    """Credentials by kind, and the runs that overlap none as kind ``''``."""
    base = base_spans(text)
    yield from ((kind, _value(text[s:e], kind)) for s, e, kind in base)
    yield from (("", m.group()) for m, span in candidates(text or "", base) if span is None)


class _Least(dict):
    """The values with the least hashes, up to ``most`` of a kind: what several such hold together holds all of the least."""

    def __init__(self, most: int):
        super().__init__()
        self._most, self._limit = most, 1 << 64

    def add(self, value: str) -> None:
        u = xxhash.xxh3_64_intdigest(value)
        if u < self._limit and value not in self:
            self[value] = u
            if len(self) >= 4 * self._most + 64:
                kept = sorted(self.items(), key=lambda x: (x[1], x[0]))[: self._most]
                self.clear()
                self.update(kept)
                self._limit = kept[-1][1]


def _value(match: str, kind: str) -> str:
    return _PATTERNS["assign"][0].match(match).group(2) if kind == "assign" else match


def learn(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Formats:
    """Formats of the distinct credentials that the base patterns find in all documents.

    Of each kind up to ``sample`` values with the smallest hashes are learned
    from (values of up to ``LEARN_LENGTH`` characters), and as many plain words:
    other runs of a candidate's form. A task hands on no more than that of each, and so
    does the driver get. The sample depends on the values alone, neither on row
    order nor on partitions. Without plain words every character counts as
    likely as another. Without documents or credentials the formats find nothing.
    """

    small_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {kind: _Least(sample) for kind in (*KINDS, "")}
        for batch in batches:
            for value in each(batch.column("text")):
                for kind, found in _labelled(value):
                    if len(found) <= LEARN_LENGTH:
                        least[kind].add(found)
        for kind, values in least.items():
            kept = sorted(values.items(), key=lambda x: (x[1], x[0]))[:sample]
            columns = [[kind] * len(kept), [v for v, _ in kept], [u - (1 << 63) for _, u in kept]]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["kind", "value", "u"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(tidy(find), "kind string, value string, u bigint")
    values = written(found.distinct(), "credentials")
    credentials: dict[str, list[str]] = {}
    for kind in (*KINDS, ""):
        least = values.where(F.col("kind") == kind).orderBy("u", "value").limit(sample).select("value").collect()
        credentials[kind] = [row.value for row in least]
    plain = credentials.pop("")
    return Formats(credentials, plain)


def find_secrets(spark: SparkSession, docs: DataFrame, formats: Formats, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of ``(start, end, kind)`` in code points, end exclusive.

    All runs of a candidate's form are scored but those inside a base span; an added span may
    hold or overlap base ones. Null and empty texts have no spans. Every row and column stays; columns of
    the two names are replaced. The formats are broadcast; a bounded sample
    bounds their size. Nothing is shuffled.
    """
    small_batches(spark)
    shared = share(spark, formats)

    def start():
        formats = shared()

        def scan(texts: pa.Array) -> pa.Array:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
            both = [spans(value, formats) for value in each(texts)]
            sides = [[[dict(zip(("start", "end", "kind"), s)) for s in pair[i]] for pair in both] for i in (0, 1)]
            return pa.StructArray.from_arrays([pa.array(side, kind) for side in sides], names=["base", "added"])

        return scan

    span = "array<struct<start: int, end: int, kind: string>>"
    scanned = docs.withColumn("_spans", per_row(start, f"base {span}, added {span}")(F.col(text)))
    return scanned.withColumns({"base": F.col("_spans.base"), "added": F.col("_spans.added")}).drop("_spans")


def redact(spark: SparkSession, docs: DataFrame, formats: Formats, text: str = "text") -> DataFrame:
    """``docs`` with ``[kind]`` in place of each secret; texts without one, and nulls, stay as they are.

    Where spans overlap, the whole stretch is replaced under the first one's kind.
    """
    small_batches(spark)
    shared = share(spark, formats)

    def start():
        formats = shared()

        def clean(value: str | None) -> str | None:
            base, added = spans(value, formats)
            if not base and not added:
                return value
            out, at, reach = [], 0, 0
            for begin, end, kind in sorted(base + added):
                if begin >= reach:
                    out += [value[at:begin], f"[{kind}]"]
                reach = at = max(reach, end)
            return "".join([*out, value[at:]])

        return lambda texts: pa.array([clean(value) for value in each(texts)], pa.string())

    return docs.withColumn(text, per_row(start, "string")(F.col(text)))
