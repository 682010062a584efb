"""Token counts: greedy word-piece lengths by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Memo, each, per_row, share, small_batches, utf8

START = "▁"


def load_pieces(path: str) -> list[str]:
    """The normal pieces of a sentencepiece model, without control, byte and white-space pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = (
        i
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    )
    return [piece for piece in map(model.id_to_piece, normal) if START not in piece[1:]]


class Automaton:
    """A vocabulary trie with failure links.

    A node stands for the unfinished longest match. When no child takes the next
    character, ``popped[node]`` pieces are final and ``fail[node]`` holds what
    remains of the match. Both come from the node's parent in one breadth-first
    pass, so that a word is measured in one pass over its characters, without
    stepping back and without building a piece.
    """

    def __init__(self, pieces: list[str]):
        self.child: dict[tuple[int, str], int] = {}
        final, parents = [False], deque([(0, "")])
        for piece in pieces:
            node = 0
            for char in piece:
                nxt = self.child.get((node, char))
                if nxt is None:
                    nxt = self.child[node, char] = len(final)
                    final.append(False)
                node = nxt
            final[node] = True
        below: dict[int, list[tuple[str, int]]] = {}
        for (node, char), nxt in self.child.items():
            below.setdefault(node, []).append((char, nxt))
        self.known = {char for char, node in below.get(0, []) if final[node]}
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        parents = deque([0])
        while parents:
            parent = parents.popleft()
            for char, node in below.get(parent, []):
                parents.append(node)
                if final[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                count, rest = self.popped[parent], self.fail[parent]
                while rest > 0 and (rest, char) not in self.child:
                    count, rest = count + self.popped[rest], self.fail[rest]
                rest = self.child.get((rest, char), -1) if rest >= 0 else -1
                if rest < 0:
                    raise ValueError("a piece holds a character that is no piece itself")
                self.fail[node], self.popped[node] = rest, count

    def pieces_in(self, word: bytes) -> int:
        """Pieces of the word by longest match; an unknown character counts its UTF-8 bytes."""
        child, fail, popped, known = self.child, self.fail, self.popped, self.known
        node = count = 0
        for char in START + word.decode("utf-8", "replace"):
            if char not in known:
                while node:
                    count, node = count + popped[node], fail[node]
                count += len(char.encode())
                continue
            nxt = child.get((node, char))
            while nxt is None:
                count, node = count + popped[node], fail[node]
                nxt = child.get((node, char))
            node = nxt
        while node:
            count, node = count + popped[node], fail[node]
        return count


def token_counts(spark: SparkSession, docs: DataFrame, pieces: list[str], text: str = "text", prefix: str = "n_") -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens`` of each whole text.

    Words stand between ASCII white space and are matched as ``▁word``, longest
    piece first. Null, empty and blank texts have 0 words and 0 tokens. All rows
    and columns stay, repeated ones too; existing columns of the two names are
    replaced (choose another ``prefix`` to keep them). The automaton is broadcast: its size is
    that of the vocabulary, never of the data. Nothing is shuffled.
    """
    small_batches(spark)
    automaton = share(spark, Automaton(pieces))

    def start():
        memo = Memo(automaton().pieces_in)

        def count(texts: pa.Array) -> pa.Array:
            split = [data.split() if data else [] for data in each(texts)]
            n_words = np.fromiter(map(len, split), np.int64, len(split))
            n_tokens = np.fromiter((sum(map(memo.__getitem__, row)) for row in split), np.int64, len(split))
            return pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_tokens)], names=["words", "tokens"])

        return count

    counted = docs.withColumn("_counts", per_row(start, "words bigint, tokens bigint")(utf8(text)))
    return counted.withColumns(
        {f"{prefix}words": F.col("_counts.words"), f"{prefix}tokens": F.col("_counts.tokens")}
    ).drop("_counts")
