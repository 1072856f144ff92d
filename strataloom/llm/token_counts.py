"""Greedy word-piece counts by a longest-match automaton.

The vocabulary becomes a trie whose nodes hold a failure link and the number of pieces popped when that link is
taken (Song et al., "Fast WordPiece Tokenization", 2021). A word is then read once, left to right, and only numbers
of pieces are added up: no piece is built and no character is read twice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words whose count a Python worker remembers before it starts anew. Bounds memory; results do not depend on it.
REMEMBERED_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class LongestMatch:
    """Numbers of pieces by greedy longest match over a vocabulary of byte strings.

    A word that the vocabulary cannot cover counts as one unknown piece; an empty word has none.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node; node 0 is the root
        parent, letter, final = [0], [0], [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                nxt = self.step.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.step[node << 8 | byte] = len(parent)
                    parent.append(node)
                    letter.append(byte)
                    final.append(False)
                node = nxt
            final[node] = node != 0
        depth = [0] * len(parent)
        for node in range(1, len(parent)):
            depth[node] = depth[parent[node]] + 1
        self.fail: list[int] = [-1] * len(parent)  # -1: no piece can be popped
        self.popped = [0] * len(parent)
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            if final[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            above = parent[node]
            at, n = self.fail[above], self.popped[above]
            while at > -1 and (nxt := self.step.get(at << 8 | letter[node])) is None:
                n += self.popped[at]
                at = self.fail[at]
            if at > -1:
                self.fail[node], self.popped[node] = nxt, n

    def count(self, word: bytes) -> int:
        step, fail, popped, node, n = self.step, self.fail, self.popped, 0, 0
        for byte in word:
            while (nxt := step.get(node << 8 | byte)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = nxt
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


class _Counts(dict):
    """Word -> number of pieces, worked out at the first request."""

    def __init__(self, automaton: LongestMatch, prefix: bytes):
        super().__init__()
        self.automaton, self.prefix = automaton, prefix

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(self.prefix + word)
        return n


_built: dict[object, _Counts] = {}


def token_counts(
    df: DataFrame, vocabulary: Iterable[bytes], id_col: str = "doc_id", text_col: str = "text", prefix: bytes = b" "
) -> DataFrame:
    """Per row: the id, n_words and n_pieces (both long) of the whole text.

    Words are the runs of `[^\\x20\\x09-\\x0D]+`. Each is matched with `prefix` before it, so that pieces which start
    a word are those of the vocabulary that start with the prefix, and the others continue one.

    Null, empty and blank texts have 0 words and 0 pieces. Null ids stay null. Repeated rows give one row each.
    Other columns are not read. Rows need no partner: there is no shuffle, and a hot source is no burden.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(sorted(set(vocabulary)))  # the vocabulary file bounds its size
    token = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (token, prefix)
        if key not in _built:
            _built.clear()
            _built[key] = _Counts(LongestMatch(shared.value), prefix)
        get = _built[key].__getitem__
        for batch in batches:
            n_words, n_pieces = [], []
            for text in batch.column(1):
                found = text.as_buffer().to_pybytes().split() if text.is_valid else ()
                n_words.append(len(found))
                n_pieces.append(sum(map(get, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())],
                [id_col, "n_words", "n_pieces"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_pieces long")
