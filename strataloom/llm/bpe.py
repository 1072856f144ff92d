"""Byte-level BPE encoding and decoding of whole documents.

Encoding pre-tokenises, then merges the bytes of each pre-token by rank. Long texts are cut into overlapping chunks
that are pre-tokenised in parallel. A chunk that starts inside a pre-token is wrong at first, but pre-tokenising only
looks ahead: from the first boundary on which it agrees with the chunk before it, both agree for good. The chunks are
stitched there, and the pieces between the stitches are encoded. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.token_counts import read_ranks

#: Pre-tokens whose ids a Python worker remembers before it starts anew. Bounds memory, not results.
REMEMBERED_PIECES = 250_000
#: Code points of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 32_768, 2_048
#: A boundary this close to a chunk's end may be due to the cut: the pattern looks no further ahead than this.
MARGIN = 4


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: merges the pair of lowest rank, leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) <= 48:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get, none = ranks.get, len(ranks) + (1 << 30)
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            own = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + own, none)
            if i < len(pairs):
                pairs[i] = get(own + parts[i + 1], none)
        return [ranks[p] for p in parts]
    # a heap of pairs over a linked list: a pre-token of any length takes n log n steps
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, j = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != j:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = j
        if j < n:
            before[j] = i
            if (s := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (s, i, end[j]))
        if (p := before[i]) >= 0 and (s := ranks.get(piece[p:j])) is not None:
            heapq.heappush(heap, (s, p, j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Pieces(dict):
    """Pre-token -> its ids, worked out at the first request."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge(piece.encode("utf-8", "surrogatepass"), self.ranks))
        if len(piece) <= 64:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_built: dict[object, tuple[object, _Pieces]] = {}


def _tools(token: object, ranks: dict[bytes, int], pattern: str) -> tuple[object, _Pieces]:
    if token not in _built:
        _built.clear()
        _built[token] = (regex.compile(pattern), _Pieces(ranks))
    return _built[token]


def ends_of(compiled: object, text: str) -> list[int]:
    """The end of each pre-token of text; together they cover it."""
    return list(accumulate(map(len, compiled.findall(text))))


def stitch(compiled: object, chunks: list[tuple[int, str, list[int]]]) -> Iterator[str]:
    """The pre-tokens of a text from its overlapping chunks: (start, text, ends within the chunk), in order.

    The pieces of each chunk hold up to its first boundary, clear of the cut, that the next chunk has too. Where two
    chunks have none in common, as inside a run of letters longer than the overlap, pre-tokenising goes on from the
    last sure boundary until it meets one of the chunk after.
    """
    at = 0  # all before this position of the text is out
    start, text, ends = chunks[0]
    for following, more, theirs in chunks[1:]:
        stop = start + len(text)
        sure = [start + e for e in ends if at < start + e <= stop - MARGIN]
        shared = {following + e for e in theirs} | {following}
        meet = next((e for e in sure if e in shared), None)
        for e in sure:
            yield text[at - start : e - start]
            at = e
            if e == meet:
                break
        if meet is None:
            text = text[at - start :] + more[stop - following :]
            start, ends = at, ends_of(compiled, text)
        else:
            start, text, ends = following, more, theirs
    for e in ends:
        if start + e > at:
            yield text[at - start : e]
            at = start + e


def encode(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Per row: the id and token_ids (array<int>) of the whole text, without special tokens.

    Null and empty texts have no ids. Null ids of rows stay null. Repeated rows give one row each. Other columns are
    not read. Texts of up to `chunk` code points are encoded where they lie; of longer ones, the chunks are dealt out
    to all tasks and come together again by row, so that a task holds one long text at a time.
    """
    if overlap <= MARGIN or chunk <= 0:
        raise ValueError("the overlap must exceed the pattern's look-ahead, and a chunk must not be empty")
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # the file bounds its size
    token = (ranks._jbroadcast.id() if ranks._jbroadcast is not None else id(ranks), pattern)
    kind = df.schema[id_col].dataType.simpleString()

    def ids_column(lists: list[list[int]]) -> pa.Array:
        offsets = np.zeros(len(lists) + 1, np.int32)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        flat = np.fromiter(chain.from_iterable(lists), np.int32, offsets[-1])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, pieces = _tools(token, ranks.value, pattern)
        get, findall = pieces.__getitem__, compiled.findall
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [list(chain.from_iterable(map(get, findall(t)))) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), ids_column(out)], [id_col, "token_ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, _ = _tools(token, ranks.value, pattern)
        for batch in batches:
            ends = [ends_of(compiled, t) for t in batch.column("_piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], [*batch.schema.names, "_ends"])

    def join(group: pa.Table) -> pa.Table:
        compiled, pieces = _tools(token, ranks.value, pattern)
        rows = sorted(group.select(["_at", "_piece", "_ends"]).to_pylist(), key=lambda r: r["_at"])
        copies = sum(r["_at"] == 0 for r in rows)  # of repeated rows, each chunk is there as often
        found = stitch(compiled, [(r["_at"], r["_piece"], r["_ends"]) for r in rows[::copies]])
        ids = list(chain.from_iterable(map(pieces.__getitem__, found)))
        own = group.column(id_col).slice(0, 1).combine_chunks().take(pa.array([0] * copies))
        return pa.Table.from_arrays([own, ids_column([ids] * copies)], [id_col, "token_ids"])

    schema = f"`{id_col}` {kind}, token_ids array<int>"
    rows = df.select(id_col, text_col)
    size = F.coalesce(F.length(text_col), F.lit(0))
    short = rows.where(size <= chunk).mapInArrow(whole, schema)
    chunks = (
        rows.where(size > chunk)
        .select(
            F.col(id_col), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h"), F.length(text_col).alias("_n"),
            F.explode(F.sequence(F.lit(0), ((F.length(text_col) - 1) / chunk).cast("int"))).alias("_c"),
        )
        .select(id_col, "_h", "_n", (F.col("_c") * chunk).alias("_at"), F.substring("_text", F.col("_c") * chunk + 1, F.lit(chunk + overlap)).alias("_piece"))
        .repartition("_h", "_c")
    )
    tokens = chunks.mapInArrow(cut, f"`{id_col}` {kind}, _h long, _n int, _at int, _piece string, _ends array<int>")
    return short.unionByName(tokens.groupBy(id_col, "_h", "_n").applyInArrow(join, schema))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids as a binary column. Null ids give null, no ids give no bytes.

    The bytes of an id are fixed, so this is the exact inverse of encode() on any text. An unknown id is an error.
    """
    table = df.sparkSession.sparkContext.broadcast({i: b for b, i in read_ranks(ranks_path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = part.column(part.schema.get_field_index(ids_col))
                flat, ends = lists.flatten().to_numpy().tolist(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
                spans = zip([0, *ends[:-1]], ends, lists.is_valid().to_pylist())
                out = pa.array([b"".join(map(get, flat[a:b])) if there else None for a, b, there in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out_col}` binary")
