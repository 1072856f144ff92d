"""Exact removal of repeated passages with suffix arrays.

A repeated string of `length` bytes shows the same anchor wherever it occurs: the smallest of its k-byte hashes, the
leftmost if there are several. Anchors cut the corpus into contexts, runs of windows with the same anchor. Equal contexts
need no more than their digest. Where an anchor has different contexts, the first of each are looked at byte by byte:
a window holds the anchor and half of the remaining bytes on one side of it, so each context goes on in two parts, by the
anchor with so many bytes more to the right or to the left, its core. Parts of one core meet in one task, where a suffix
array, with one symbol for each core, brings equal windows together; in each such group all but the earliest are repeats.
Anchors of very many different contexts are split up to single windows, which meet by their digest.

The suffix array is built by linear grouping (Baier, "Linear-time suffix sorting", 2016): suffixes are grouped by
their Lyndon prefixes, in descending order and by previous-smaller pointers, and then each group's order is induced,
without recursion or renaming.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import BitFilter, written
from strataloom.llm.shingles import C1, C2, C3, mix

LENGTH, ANCHOR = 100, 32
#: Bytes that are worked on at a time, and bits that number them.
SLICE, PLACE_BITS = 1 << 17, 18
#: Symbols over which one suffix array is built, or more if one core has more.
BATCH_SYMBOLS = 1 << 15
#: Different contexts from which on an anchor's are split up to single windows.
HOT = 20_000


def suffix_array(text: list[int]) -> list[int]:
    """The order of the suffixes of text, whose last symbol must be its smallest and occur once."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, at, size = [0] * n, [0] * n, [0] * n  # a group is named by its first place, so names are in order
    start = 0
    for place, i in enumerate(order):
        if place and text[i] != text[order[place - 1]]:
            start = place
        group[i], at[i] = start, place
        size[start] += 1
    previous, jump = [-1] * n, list(range(-1, n - 1))
    stop = n
    while stop:
        start = group[order[stop - 1]]
        pointed: dict[int, int] = {}
        for i in order[start:stop]:
            j, path = i - 1, []
            while j >= 0 and group[j] >= start:
                path.append(j)
                j = jump[j]
            for p in path:
                jump[p] = j
            jump[i] = previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, c in pointed.items():
                by_count.setdefault(c, {}).setdefault(group[j], []).append(j)
            for c in sorted(by_count, reverse=True):
                for old, moved in by_count[c].items():
                    end = old + size[old]
                    new = end - len(moved)
                    size[old] -= len(moved)
                    for j in moved:  # to the end of its group
                        end -= 1
                        other = order[end]
                        order[at[j]], at[other] = other, at[j]
                        order[end], at[j] = j, end
                    for j in moved:
                        group[j] = new
                    size[new] = len(moved)
        stop = start
    out, front, placed = [-1] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    front[0] = 1
    for place in range(n):
        j = out[place] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = previous[j]
    return out


def repeats(pieces: list[tuple[bytes, int, bytes]], slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the windows that are equal to one of an earlier piece, in order.

    A piece is what stands to the left of a core, the core's number, and what stands to the right, up to `slack` bytes
    each. A window is the core and `slack` bytes beside it.
    """
    text: list[int] = []
    for left, core, right in pieces:
        text += left
        text.append(256 + core)
        text += right
        text.append(-1)  # no window holds it
    text.append(-2)
    sizes = np.array([len(left) + len(right) + 1 for left, _, right in pieces])
    owner = np.append(np.repeat(np.arange(len(pieces)), sizes + 1), 0)
    offset = np.arange(len(text)) - np.append(np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1), 0)
    order = np.array(suffix_array(text))[1:]
    valid = order[offset[order] + slack < sizes[owner[order]]]
    symbols = np.array([*text, *[-2] * slack], np.int32)
    rows = np.lib.stride_tricks.sliding_window_view(symbols, slack + 1)[valid]
    group = np.cumsum(np.concatenate(([False], (rows[1:] != rows[:-1]).any(axis=1)))) if len(valid) else np.empty(0, int)
    by = np.lexsort((owner[valid], group))
    later = valid[by[1:][group[by][1:] == group[by][:-1]]]
    later.sort()
    return owner[later], offset[later]


class _Hashes:
    """Hashes of any stretch of a slice from sums over its prefixes, modulo 2 ** 64."""

    byte = mix(np.arange(1, 257, dtype=np.uint64) * C3)
    power = np.cumprod(np.full(SLICE + 1, C1 | np.uint64(1)))
    inverse = np.cumprod(np.full(SLICE + 1, pow(int(C1) | 1, -1, 1 << 64), np.uint64))

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte[raw] * self.power[: len(raw)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * C2)

    def each(self, k: int) -> np.ndarray:
        """Of every k bytes in a row."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k])


def anchors(texts: list[bytes], length: int, k: int) -> Iterator[tuple]:
    """(bytes, hashes, key, text, from, to, anchor, shift) by slices: the runs of windows with one anchor, and the anchor's hash.

    from, to and anchor are places in the slice's bytes; with shift added they are places in the text.
    """
    pieces = [(t, a) for t, x in enumerate(texts) for a in range(0, max(0, len(x) - length + 1), SLICE - length + 1)]
    at = 0
    while at < len(pieces):
        own, size = [], 0
        while at < len(pieces):
            t, a = pieces[at]
            part = texts[t][a : a + SLICE]
            if own and size + len(part) > SLICE:
                break
            own.append((t, a, part))
            size += len(part)
            at += 1
        data = b"".join(x for _, _, x in own)
        hashes = _Hashes(np.frombuffer(data, np.uint8))
        h = hashes.each(k)
        low = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        w, part, width, found, done = length - k + 1, low, 1, None, 0
        while w:  # the smallest of each w in a row
            if w & 1:
                found = part if found is None else np.minimum(found[: len(part) - done], part[done : done + len(found)])
                done += width
            w >>= 1
            if w:
                part = np.minimum(part[:-width], part[width:])
                width *= 2
        place = (found & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        begin = np.cumsum([0, *(len(x) for _, _, x in own)])
        inside = np.zeros(len(place) + 1, bool)
        for b, e in zip(begin[:-1], begin[1:], strict=True):
            inside[b : e - length + 1] = True
        starts = np.flatnonzero(inside[:-1])
        first = np.concatenate(([True], (place[starts[1:]] != place[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)))
        lo = starts[first]
        hi = np.append(starts[np.flatnonzero(first)[1:] - 1], starts[-1])
        which = np.searchsorted(begin, lo, "right") - 1
        shift = np.array([a for _, a, _ in own])[which] - begin[which]
        doc = np.array([t for t, _, _ in own])[which]
        yield data, hashes, h[place[lo]].view(np.int64), doc, lo, hi, place[lo], shift


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The columns doc, sub and text, one row for each doc and sub, in their order."""
    doc, sub = batch.column(0).to_numpy(), batch.column(2).to_numpy()
    order = np.lexsort((sub, doc))
    order = order[np.concatenate(([True], (doc[order[1:]] != doc[order[:-1]]) | (sub[order[1:]] != sub[order[:-1]])))[: len(order)]]
    return doc[order], sub[order], _bytes(batch.column(1).take(pa.array(order)))


def _tag(doc: np.ndarray, sub: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """One number for a context by its place."""
    d, s, x = (np.asarray(v, np.int64).view(np.uint64) for v in (doc, sub, lo))
    return mix(mix(d ^ C1) ^ (s * C2) ^ mix(x + C2)).view(np.int64)


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns.values()], list(columns))


_LONG = pa.int64()


def _contexts(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(key, digest, doc, sub, lo, hi): the first of equal contexts of a batch; those after it, joined to runs, without key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, subs, texts = _rows(batch)
            parts = [(key, hashes(lo, hi + length).view(np.int64), doc, lo + shift, hi + shift) for _, hashes, key, doc, lo, hi, _, shift in anchors(texts, length, k)]
            if not parts:
                continue
            key, digest, doc, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key ^ mix(digest.view(np.uint64)).view(np.int64), kind="stable")
            same = np.concatenate(([False], (key[order[1:]] == key[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])))
            first, again = np.sort(order[~same]), np.sort(order[same])
            yield _batch({"key": (key[first], _LONG), "digest": (digest[first], _LONG), "doc": (docs[doc[first]], _LONG), "sub": (subs[doc[first]], _LONG), "lo": (lo[first], _LONG), "hi": (hi[first], _LONG)})
            if len(again):
                new = np.concatenate(([True], (doc[again[1:]] != doc[again[:-1]]) | (lo[again[1:]] != hi[again[:-1]] + 1)))
                a, z = again[new], again[np.append(np.flatnonzero(new)[1:] - 1, len(again) - 1)]
                none = np.ma.masked_all(len(a), np.int64)
                yield _batch({"key": (none, _LONG), "digest": (none, _LONG), "doc": (docs[doc[a]], _LONG), "sub": (subs[doc[a]], _LONG), "lo": (lo[a], _LONG), "hi": (hi[z], _LONG)})

    return rows.mapInArrow(run, "key long, digest long, doc long, sub long, lo long, hi long")


def _told_apart(contexts: DataFrame) -> DataFrame:
    """(key, doc, sub, lo, hi): copies of earlier contexts, without key; of anchors with several contexts, the first of each.

    Contexts come sorted by key, digest and place and stream by; no group is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, several = None, False  # the last first context, and whether its anchor had one before
        for batch in batches:
            if not batch.num_rows:
                continue
            key, digest, *rest = (batch.column(c).to_numpy() for c in range(6))
            if held is not None:
                key, digest, *rest = (np.concatenate(([h], x)) for h, x in zip(held, (key, digest, *rest), strict=True))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])))
            first = np.flatnonzero(new)
            alike = key[first[1:]] == key[first[:-1]]
            again = np.flatnonzero(~new)
            leader = first[np.cumsum(new)[again] - 1]
            again = again[np.any([x[again] != x[leader] for x in rest[:3]], axis=0)]  # repeated rows are one
            of_several = np.concatenate(([several and held is not None], alike)) | np.concatenate((alike, [False]))
            held, several = [x[first[-1]] for x in (key, digest, *rest)], bool(of_several[-1])
            out = first[:-1][of_several[:-1]]
            names = ("doc", "sub", "lo", "hi")
            yield _batch({"key": (key[out], _LONG)} | {n: (x[out], _LONG) for n, x in zip(names, rest, strict=True)})
            yield _batch({"key": (np.ma.masked_all(len(again), np.int64), _LONG)} | {n: (x[again], _LONG) for n, x in zip(names, rest, strict=True)})
        if held is not None and several:
            yield _batch({n: ([x], _LONG) for n, x in zip(("key", "doc", "sub", "lo", "hi"), (held[0], *held[2:]), strict=True)})

    ordered = contexts.repartition("key").sortWithinPartitions("key", "digest", "doc", "sub", "lo")
    return ordered.mapInArrow(run, "key long, doc long, sub long, lo long, hi long")


def _parts(rows: DataFrame, length: int, k: int, told: BitFilter, hot: BitFilter | None) -> DataFrame:
    """(core, slack, doc, sub, place, left, right): the parts of the contexts that the filter lets through.

    place: where the core begins. slack: how many bytes beside the core a window holds; of them, left and right. Contexts
    of hot anchors become single windows without slack.
    """
    slack = length - k
    more = (slack + 1) // 2  # bytes to the right that a window of the first kind holds, at least
    kinds = [(0, k + more, slack - more, 0, slack - more), (slack - more + 1, k + slack - more + 1, more - 1, slack - more + 1, slack)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, subs, texts = _rows(batch)
            for data, hashes, key, doc, lo, hi, anchor, shift in anchors(texts, length, k):
                at = np.flatnonzero(told.holds(_tag(docs[doc], subs[doc], lo + shift)))
                many = hot.holds(key[at]) if hot is not None else np.zeros(len(at), bool)
                for i in at[many].tolist():
                    marks = [hashlib.blake2b(data[s : s + length], digest_size=16).digest() for s in range(lo[i], hi[i] + 1)]
                    n = len(marks)
                    yield _batch({
                        "core": (np.frombuffer(b"".join(m[:8] for m in marks), np.int64), _LONG), "slack": (np.zeros(n, np.int32), pa.int32()),
                        "doc": (np.full(n, docs[doc[i]]), _LONG), "sub": (np.full(n, subs[doc[i]]), _LONG), "place": (np.arange(lo[i], hi[i] + 1) + shift[i], _LONG),
                        "left": ([m[8:] for m in marks], pa.binary()), "right": ([b""] * n, pa.binary()),
                    })
                at = at[~many]
                for before, size, left_over, least, most in kinds:  # windows with least to most bytes left of the anchor
                    begin, end = np.maximum(lo[at], anchor[at] - most), np.minimum(hi[at], anchor[at] - least)
                    some = begin <= end
                    own, begin, end = at[some], begin[some], end[some]
                    core = anchor[own] - before
                    left = [data[a:b] for a, b in zip(begin.tolist(), core.tolist(), strict=True)]
                    right = [data[a:b] for a, b in zip((core + size).tolist(), (end + length).tolist(), strict=True)]
                    yield _batch({
                        "core": (hashes(core, core + size).view(np.int64), _LONG), "slack": (np.full(len(own), left_over, np.int32), pa.int32()),
                        "doc": (docs[doc[own]], _LONG), "sub": (subs[doc[own]], _LONG), "place": (core + shift[own], _LONG), "left": (left, pa.binary()), "right": (right, pa.binary()),
                    })

    return rows.mapInArrow(run, "core long, slack int, doc long, sub long, place long, left binary, right binary")


def _common(a: bytes, b: bytes) -> int:
    """How many leading bytes agree."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _reach(sides: list[bytes]) -> list[int]:
    """For each, how many leading bytes agree with some other of them."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    best = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        n = _common(sides[i], sides[j])
        best[i], best[j] = max(best[i], n), max(best[j], n)
    return best


def _repeats_within(parts: DataFrame) -> DataFrame:
    """(doc, sub, lo, hi): the runs of windows that occur in an earlier part of the same core too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int, int]] = []
        waiting: dict[int, list] = {}  # by slack
        own: list[tuple] = []
        last, sent, symbols, cores = None, None, 0, 0

        def whole(doc: int, sub: int, place: int, left: bytes, right: bytes, slack: int) -> None:
            found.append((doc, sub, place - len(left), place + len(right) - slack))

        def firsts(rows: list[tuple], slack: int) -> list[tuple]:
            """Of equal parts the first; all windows of the others are repeats."""
            seen, out = {}, []
            for r in rows:
                one = seen.setdefault(r[3:], r)
                if one is r:
                    out.append(r)
                elif one[:3] != r[:3]:  # repeated rows are one
                    whole(*r, slack)
            return out

        def end_core() -> None:
            nonlocal own, symbols, cores
            if len(own) > 1:
                slack = last[1]
                rows = firsts(own, slack)
                lefts, rights = _reach([r[3][::-1] for r in rows]), _reach([r[4] for r in rows])
                cut = [(*r[:3], r[3][len(r[3]) - x :], r[4][:y]) for r, x, y in zip(rows, lefts, rights, strict=True) if x + y >= slack]
                cut = firsts(cut, slack)
                if len(cut) > 1:
                    waiting.setdefault(slack, []).extend((*r, cores) for r in cut)
                    cores += 1
                    symbols += sum(len(r[3]) + len(r[4]) + 2 for r in cut)
            own = []

        def solve() -> None:
            nonlocal symbols, cores
            for slack, rows in waiting.items():
                piece, offset = repeats([(r[3], r[5], r[4]) for r in rows], slack)
                head = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)))) if len(piece) else []
                for a, z in zip(head, [*(head[1:] - 1), len(piece) - 1] if len(piece) else [], strict=True):
                    doc, sub, place, left = rows[piece[a]][:4]
                    found.append((doc, sub, place - len(left) + int(offset[a]), place - len(left) + int(offset[z])))
            waiting.clear()
            symbols = cores = 0

        def flush() -> pa.RecordBatch:
            out = _batch({n: ([x[c] for x in found], _LONG) for c, n in enumerate(("doc", "sub", "lo", "hi"))})
            found.clear()
            return out

        for batch in batches:
            for core, slack, *row in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if not slack:  # single windows, sorted: they stream by
                    if sent is None or sent[0] != (core, row[3]):
                        sent = (core, row[3]), row[:3]
                    elif sent[1] != row[:3]:
                        whole(*row[:3], b"", b"", 0)
                    continue
                if (core, slack) != last:
                    end_core()
                    last = (core, slack)
                    if symbols >= BATCH_SYMBOLS:
                        solve()
                own.append(tuple(row))
            if len(found) >= 1000:
                yield flush()
        end_core()
        solve()
        yield flush()

    ordered = parts.repartition("core").sortWithinPartitions("core", "slack", F.when(F.col("slack") == 0, F.col("left")), "doc", "sub", "place")
    return ordered.mapInArrow(run, "doc long, sub long, lo long, hi long")


def repeated_windows(rows: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(doc, sub, lo, hi): runs of starts of windows of `length` bytes that occur earlier, from rows (doc, text, sub)."""
    contexts = written(_contexts(rows, length, k), "contexts")
    met = written(_told_apart(contexts.where("key IS NOT NULL")), "first-contexts")
    copies = contexts.where("key IS NULL").unionByName(met.where("key IS NULL").withColumn("digest", F.lit(None).cast("long")))
    several = met.where("key IS NOT NULL")
    tags = several.select("doc", "sub", "lo").mapInArrow(
        lambda batches: (_batch({"tag": (_tag(*(b.column(c).to_numpy() for c in range(3))), _LONG)}) for b in batches), "tag long"
    )
    hot = written(several.groupBy("key").count().where(F.col("count") >= HOT).select("key"), "hot-anchors")
    told = BitFilter.of(tags, "tag", several.count())
    parts = _parts(rows, length, k, told, None if hot.isEmpty() else BitFilter.of(hot, "key", hot.count()))
    return copies.select("doc", "sub", "lo", "hi").unionByName(_repeats_within(parts))


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of each row, texts being their UTF-8 bytes.

    Removed is each byte covered by a string of `length` bytes that starts earlier too: in a row of smaller id, or in
    the same row before. Strings never cross rows and are judged on the input. Null and empty texts have no bytes.
    Rows with a null id come after all others, by their text's hash; rows of equal id and equal text are one, and
    rows of equal id and different texts are told apart by their text's hash. Very long texts are worked on in slices
    that overlap. An empty table gives no rows.
    """
    ids = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"))
    alone = ids.groupBy("doc").count().where("count > 1").isEmpty()
    sub = F.lit(0).cast("long") if alone else F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = df.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc"), sub.alias("sub"),
    )
    runs = repeated_windows(keyed.select("doc", "text", "sub"), length, k)
    spans = written(runs.groupBy("doc", "sub").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "spans")
    some = BitFilter.of(spans.select("doc"), "doc", spans.count())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, n_spans, kept = [], [], [], []
            for data, own in zip(_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                mark = np.zeros(len(data) + 1, np.int32)
                for r in own or ():
                    mark[r["lo"]] += 1
                    mark[r["hi"] + length] -= 1
                hit = np.cumsum(mark)[:-1] > 0
                sizes.append(len(data))
                gone.append(int(hit.sum()))
                n_spans.append(int((np.diff(hit.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(np.frombuffer(data, np.uint8)[~hit].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, n_spans)), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    touched = some.where(keyed, "doc").join(spans, ["doc", "sub"], "left").select("_id", "text", "runs")
    whole = some.where(keyed, "doc", held=False).select("_id", "text", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("runs"))
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    return touched.mapInArrow(cut, schema).unionByName(whole.mapInArrow(cut, schema))
