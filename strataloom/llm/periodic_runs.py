"""Periodic runs of words by recompression.

The words of many texts in a row, a separator of its own after each text, are one string of symbols. Rounds of block
compression (a symbol repeated k times becomes one) and of pair compression (a symbol of one half of the alphabet before
one of the other half becomes one with it) turn it into a run-length grammar whose levels are kept as arrays (Jez,
"Recompression", 2016). Equal stretches are parsed alike but for their ends, so the grammar tells how far two places
agree, to the right or to the left, in a few steps a level, without a suffix array.

A run of period q and of 3 q words or more holds three neighbours of any grid of step q, and these are equal. So for each
q the grid's neighbours are compared, n / q of them, and from those that agree two questions to the grammar give the exact
ends of the run. Grid points inside runs that are known already are not asked about again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataloom.llm.shingles import C1, mix

#: Runs are of so many words at least, and of so many times their period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words of short texts that share one grammar.
BATCH_WORDS = 1 << 16
#: Symbols at which no further round is worth its while: questions walk along the top.
TOP = 16


class Grammar:
    """The levels of a string's compression; a symbol of one level names the same words wherever it stands there."""

    def __init__(self, text: np.ndarray):
        self.symbols: list[list[int]] = []
        self.parents: list[list[int]] = []
        self.firsts: list[list[int]] = [[]]
        self.blocks: list[bool] = []
        level, block = np.asarray(text, np.int64), True
        while len(level) > TOP:
            starts = self._runs(level) if block else self._pairs(level)
            if len(starts) < len(level):
                self._keep(level)
                parents = np.zeros(len(level), np.int64)
                parents[starts[1:]] = 1
                self.parents.append(np.cumsum(parents).tolist())
                self.firsts.append([*starts.tolist(), len(level)])
                self.blocks.append(block)
                sizes = np.diff(np.append(starts, len(level)))
                other = sizes if block else np.where(sizes == 2, level[np.minimum(starts + 1, len(level) - 1)] + 1, 0)
                level = np.unique(level[starts] * (int(other.max()) + 1) + other, return_inverse=True)[1]
            block = not block
        self._keep(level)

    def _keep(self, level: np.ndarray) -> None:
        self.symbols.append(level.tolist())

    @staticmethod
    def _runs(level: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate(([True], level[1:] != level[:-1])))

    @staticmethod
    def _pairs(level: np.ndarray) -> np.ndarray:
        """Where symbols of the next level begin, after block compression: neighbours differ."""
        names = np.arange(int(level.max()) + 1, dtype=np.uint64)
        for seed in range(1, 65):
            left = (mix(names ^ mix(np.full(1, seed, np.uint64) * C1)) >> np.uint64(40)) & np.uint64(1) == 1
            x, y = left[level[:-1]], left[level[1:]]
            rising, falling = x & ~y, ~x & y
            joined = rising if rising.sum() >= falling.sum() else falling
            if 8 * joined.sum() >= len(level) - 1:  # a quarter is to be expected
                break
        return np.flatnonzero(np.concatenate(([True], ~joined)))

    def right(self, i: int, j: int) -> int:
        """How many words from i and from j on agree; i < j, and the string's last symbol occurs once."""
        at, a, b = 0, i, j
        top = len(self.parents)
        while self.symbols[at][a] == self.symbols[at][b]:
            if at == top:
                a, b = a + 1, b + 1
                continue
            parents, firsts = self.parents[at], self.firsts[at + 1]
            p, q = parents[a], parents[b]
            if firsts[p] == a and firsts[q] == b:
                at, a, b = at + 1, p, q
            else:
                step = min(firsts[p + 1] - a, firsts[q + 1] - b) if self.blocks[at] else 1
                a, b = a + step, b + step
        while at:
            firsts = self.firsts[at]
            n = min(firsts[a + 1] - firsts[a], firsts[b + 1] - firsts[b])
            a, b, at = firsts[a], firsts[b], at - 1
            symbols = self.symbols[at]
            if symbols[a] == symbols[b]:
                a, b = (a + n, b + n) if self.blocks[at] else (a + 1, b + 1)
        return a - i

    def left(self, i: int, j: int) -> int:
        """How many words before i and before j agree; i < j, and the string's first symbol occurs once."""
        at, a, b = 0, i - 1, j - 1
        if a < 0:
            return 0
        top = len(self.parents)
        while self.symbols[at][a] == self.symbols[at][b]:
            if at == top:
                a, b = a - 1, b - 1
                continue
            parents, firsts = self.parents[at], self.firsts[at + 1]
            p, q = parents[a], parents[b]
            if firsts[p + 1] == a + 1 and firsts[q + 1] == b + 1:
                at, a, b = at + 1, p, q
            else:
                step = min(a + 1 - firsts[p], b + 1 - firsts[q]) if self.blocks[at] else 1
                a, b = a - step, b - step
        while at:
            firsts = self.firsts[at]
            n = min(firsts[a + 1] - firsts[a], firsts[b + 1] - firsts[b])
            a, b, at = firsts[a + 1] - 1, firsts[b + 1] - 1, at - 1
            symbols = self.symbols[at]
            if symbols[a] == symbols[b]:
                a, b = (a - n, b - n) if self.blocks[at] else (a - 1, b - 1)
        return i - 1 - a


def find_runs(text: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a string whose first and last symbols occur once; periods by `longest` at most."""
    grammar: Grammar | None = None
    found: dict[tuple[int, int], int] = {}
    inside: dict[int, list[tuple[int, int]]] = {}  # by period: runs of a period that divides it
    for q in range(1, longest + 1):
        same = text[: len(text) - q : q][: (len(text) - 1) // q] == text[q::q]
        grid = np.flatnonzero(same[:-1] & same[1:]) * q
        known = inside.pop(q, ())
        if not len(grid):
            continue
        keep = np.ones(len(grid), bool)
        for s, e in known:
            keep[np.searchsorted(grid, s) : np.searchsorted(grid, e - q)] = False
        end = -1
        for i in grid[keep].tolist():
            if i + q < end:
                continue
            grammar = grammar or Grammar(text)
            s, e = i - grammar.left(i, i + q), i + q + grammar.right(i, i + q)
            if e - s < LEAST_TIMES * q:
                continue
            end = e
            if e - s < LEAST_WORDS or (s, e) in found:
                continue
            found[s, e] = q
            for m in range(2 * q, min(longest, (e - s) // LEAST_TIMES) + 1, q):
                inside.setdefault(m, []).append((s, e))
    return [(s, e, q) for (s, e), q in found.items()]


def split_words(doc_id: int | None, text: bytes) -> list[bytes]:
    return text.split()


def _batches(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    own, size = [], 0
    for x in texts:
        if own and size + len(x) > BATCH_WORDS:
            yield own
            own, size = [], 0
        own.append(x)
        size += len(x) + 1
    if own:
        yield own


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each text, by start and period: (start, length, period) of its runs, by one grammar over all."""
    names: dict[bytes, int] = {}
    flat, begins = [0], []
    for k, x in enumerate(texts):
        begins.append(len(flat))
        flat += [names.setdefault(w, len(names)) for w in x]
        flat.append(-1 - k)
    text = np.array(flat, np.int64)
    text[0] = -1 - len(texts)
    text += len(texts) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e, q in find_runs(text, max(map(len, texts), default=0) // LEAST_TIMES):
        k = int(np.searchsorted(begins, s, "right")) - 1
        out[k].append((s - begins[k], e - s, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for r in runs:  # by start and period, so the first of equals stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    mark = np.zeros(len(words) + 1, np.int32)
    for s, n, q in runs:
        mark[s + q] += 1
        mark[s + n] -= 1
    return b" ".join(w for w, m in zip(words, np.cumsum(mark).tolist(), strict=False) if not m) if runs else b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of: Callable[[int | None, bytes], list[bytes]] = split_words
) -> DataFrame:
    """(id, n_words, runs, best, collapsed) of each row.

    Words are the runs of `[^\\x20\\x09-\\x0D]+` of the whole text, or what words_of makes of the id and the text's bytes.
    runs: array of (start, length, period), by start and period, of the stretches with the smallest period q and of
    max(24, 3 q) words or more that no neighbouring word extends. best: that of the greatest length / period, of equals
    the first; null without runs. collapsed: the words, without those that a run holds after its first q, joined by spaces.

    Each row is judged by itself, so repeated rows and ties of ids do no harm; other columns are not looked at. Null,
    empty and blank texts have no words and no runs; null ids stay null. A very long text has a grammar of its own, some
    tens of bytes a word. An empty table gives no rows. Nothing is shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            texts = (words_of(i, x.as_buffer().to_pybytes() if x.is_valid else b"") for i, x in zip(ids.to_pylist(), batch.column(1), strict=True))
            for own in _batches(texts):
                runs = runs_of(own)
                to_rows = lambda r: {"start": r[0], "length": r[1], "period": r[2]}
                best = [_best(r) for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(own)), pa.array([len(x) for x in own], pa.int64()), pa.array([[to_rows(r) for r in x] for x in runs], pa.list_(_RUN)),
                        pa.array([r and to_rows(r) for r in best], _RUN), pa.array([_collapsed(x, r) for x, r in zip(own, runs, strict=True)], pa.binary()),
                    ],
                    [id_col, "n_words", "runs", "best", "collapsed"],
                )
                at += len(own)

    run_type = "struct<start: bigint, length: bigint, period: bigint>"
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<{run_type}>, best {run_type}, collapsed binary")
