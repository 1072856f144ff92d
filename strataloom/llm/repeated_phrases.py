"""Removal of passages of many words that occur again, with Aho-Corasick automata.

A passage of `length` words shows the same anchor wherever it stands: the smallest of the hashes of its k-word grams, the
leftmost if there are several. Anchors cut a text into contexts, runs of windows with one anchor, so that recurring
passages are confirmed from a row a context: a context of which there is an equal one recurs as a whole, and where an
anchor has different contexts, the windows of the first of each are counted one by one.

Documents are dealt out to buckets of some size, and each bucket has automata of its own: its patterns are the confirmed
passages, each read from the first place in the bucket where it stands. Passages overlap, so windows in a row that stand
in the bucket only together are joined to one pattern. All documents of the bucket are streamed through them word by word,
so every occurrence is located on the words themselves. A passage that is found in very many documents is one pattern in
each bucket, no text travels but to its own bucket, and an automaton is as large as its bucket at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress, count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import BitFilter, written
from strataloom.llm.shingles import C1, C2, C3, mix, word_hashes

LENGTH, GRAM = 35, 12
#: Words that are worked on at a time, and bits that number them.
SLICE, PLACE_BITS = 1 << 17, 18
#: Bytes of text in a bucket, about, and words of the patterns of one automaton.
BUCKET, PATTERN_WORDS = 2 << 20, 1 << 18
_LONG = pa.int64()


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


class _Sums:
    """Hashes of any stretch of words from sums over prefixes, modulo 2 ** 64."""

    def __init__(self, words: np.ndarray, factor: np.uint64):
        n = len(words)
        power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, factor))))
        self.inverse = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, _inverse(factor)))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words ^ factor) * power[:n])))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * C2)


def _hashes(text: bytes) -> np.ndarray:
    """Of each word as it stands; very long texts are cut at white space."""
    parts, at = [], 0
    while len(text) - at > SLICE:
        stop = at + SLICE
        while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        parts.append(word_hashes([text[at:stop]], fold=False)[0])
        at = stop
    parts.append(word_hashes([text[at:]], fold=False)[0])
    return np.concatenate(parts)


def _texts(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts in a row, and where each text's begin (one more)."""
    if sum(map(len, texts)) <= SLICE:
        return word_hashes(texts, fold=False)
    each = [_hashes(x) for x in texts]
    return np.concatenate(each), np.cumsum([0, *map(len, each)])


def contexts(texts: list[bytes], length: int, k: int) -> Iterator[tuple]:
    """(sums, key, text, lo, hi, shift) by slices: runs of windows with one anchor, and the anchor's hash.

    lo and hi are the first and last window's places in the slice; with shift added they are places in the text.
    """
    h, bounds = _words(texts)
    sizes = np.diff(bounds)
    pieces = [(t, a) for t in np.flatnonzero(sizes >= length).tolist() for a in range(0, int(sizes[t]) - length + 1, SLICE - length + 1)]
    at = 0
    while at < len(pieces):
        own, size = [], 0
        while at < len(pieces):
            t, a = pieces[at]
            n = min(SLICE, int(sizes[t]) - a)
            if own and size + n > SLICE:
                break
            own.append((t, a, n))
            size += n
            at += 1
        words = np.concatenate([h[bounds[t] + a : bounds[t] + a + n] for t, a, n in own])
        sums = _Sums(words, C1 | np.uint64(1))
        starts = np.arange(size - k + 1)
        grams = sums(starts, starts + k)
        part = (grams & ~np.uint64((1 << PLACE_BITS) - 1)) | starts.astype(np.uint64)
        width, reach, least, left = 1, 0, None, length - k + 1
        while left:  # the smallest of each length - k + 1 in a row
            if left & 1:
                least = part if least is None else np.minimum(least[: len(part) - reach], part[reach : reach + len(least)])
                reach += width
            left >>= 1
            if left:
                part = np.minimum(part[:-width], part[width:])
                width *= 2
        place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        begin = np.cumsum([0, *(n for _, _, n in own)])
        inside = np.zeros(len(place) + 1, bool)
        for b, e in zip(begin[:-1], begin[1:], strict=True):
            inside[b : e - length + 1] = True
        windows = np.flatnonzero(inside[:-1])
        first = np.concatenate(([True], (place[windows[1:]] != place[windows[:-1]]) | (windows[1:] != windows[:-1] + 1)))
        lo = windows[first]
        hi = np.append(windows[np.flatnonzero(first)[1:] - 1], windows[-1])
        which = np.searchsorted(begin, lo, "right") - 1
        shift = np.array([a for _, a, _ in own])[which] - begin[which]
        yield words, sums, grams[place[lo]].view(np.int64), np.array([t for t, _, _ in own])[which], lo, hi, shift


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, _LONG) for x in columns.values()], list(columns))


def _tag(doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """One number for a context by its place."""
    d, x = (np.asarray(v, np.int64).view(np.uint64) for v in (doc, lo))
    return mix(mix(d ^ C1) ^ mix(x + C2)).view(np.int64)


def _all_contexts(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(key, digest, bucket, doc, lo, hi) of rows (doc, bucket, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, buckets = (batch.column(c).to_numpy() for c in (0, 1))
            for _, sums, key, text, lo, hi, shift in contexts(_texts(batch.column(2)), length, k):
                yield _batch({"key": key, "digest": sums(lo, hi + length).view(np.int64), "bucket": buckets[text], "doc": docs[text], "lo": lo + shift, "hi": hi + shift})

    return rows.mapInArrow(run, "key long, digest long, bucket long, doc long, lo long, hi long")


def _windows(rows: DataFrame, told: BitFilter, length: int, k: int) -> DataFrame:
    """(w1, w2, bucket, doc, lo): the windows, by 128 bits, of the contexts that the filter lets through.

    If it lets others through, these are windows that stand where they say, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, buckets = (batch.column(c).to_numpy() for c in (0, 1))
            for words, sums, _, text, lo, hi, shift in contexts(_texts(batch.column(2)), length, k):
                own = np.flatnonzero(told.holds(_tag(docs[text], lo + shift)))
                n = hi[own] - lo[own] + 1
                of = np.repeat(own, n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]
                other = _Sums(words, C3 | np.uint64(1))
                yield _batch({
                    "w1": sums(at, at + length).view(np.int64), "w2": other(at, at + length).view(np.int64),
                    "bucket": buckets[text[of]], "doc": docs[text[of]], "lo": at + shift[of],
                })

    return rows.mapInArrow(run, "w1 long, w2 long, bucket long, doc long, lo long")


def _repeated(df: DataFrame, keys: list[str], hi: str) -> tuple[DataFrame, DataFrame]:
    """For rows (*keys, bucket, doc, lo, hi): all keys with their number of rows and first place; and, of those of two rows or
    more, (bucket, doc, lo, hi) of the first place in each bucket. A key of very many rows is one a bucket before it is gathered.
    """
    each = written(df.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.min(F.struct("doc", "lo", F.col(hi).alias("hi"))).alias("at")), "by-bucket")
    kinds = written(each.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("at").alias("at")), "kinds")
    return kinds, each.join(kinds.where("n > 1").select(*keys), keys, "left_semi").select("bucket", "at.*")


def patterns(rows: DataFrame, length: int = LENGTH, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(bucket, doc, lo, hi): for each confirmed passage its first place in each bucket, from window lo to window hi; and the
    contexts whose anchor recurs, among which all documents with such passages are.
    """
    found = written(_all_contexts(rows, length, k), "contexts")
    several = written(found.groupBy("key").count().where("count > 1").select("key"), "recurring-anchors")
    recurring = written(BitFilter.of(several, "key", several.count()).where(found, "key"), "recurring-contexts")
    kinds, wholes = _repeated(recurring, ["key", "digest"], "hi")
    mixed = kinds.groupBy("key").count().where("count > 1").select("key")
    firsts = written(kinds.join(mixed, "key", "left_semi").select("at.doc", "at.lo"), "first-contexts")
    n = firsts.count()
    if not n:
        return written(wholes, "patterns"), recurring
    tags = firsts.mapInArrow(lambda batches: (_batch({"tag": _tag(*(b.column(c).to_numpy() for c in (0, 1)))}) for b in batches), "tag long")
    apart = BitFilter.of(firsts, "doc", n).where(rows, "doc")
    _, single = _repeated(_windows(apart, BitFilter.of(tags, "tag", n), length, k), ["w1", "w2"], "lo")
    return written(wholes.unionByName(single), "patterns"), recurring


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where entries of x are, and how often each entry stands in x."""
    order = np.argsort(x)
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(np.append(False, x[order[1:]] != x[order[:-1]]))
    return number, np.bincount(number)[number]


def joined(texts: list[tuple[int, ...]], found: list[tuple[int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """The windows of patterns (text, lo, hi), as patterns that are as long as can be.

    Two windows in a row go into one pattern if they are equally frequent in these texts and the first always has the same
    next word: then each stands nowhere without the other, and the pattern stands wherever any of its windows does. A clash
    of hashes joins no others, as windows that differ in their first word alone have different sums.
    """
    sizes = np.array([len(x) for x in texts], np.int64)
    begin = np.cumsum(np.append(0, sizes))
    end = begin[-1]
    told = np.zeros(end + 1, np.int32)
    t, lo, hi = np.array(found, np.int64).T
    np.add.at(told, begin[t] + lo, 1)
    np.add.at(told, begin[t] + hi + 1, -1)
    words = np.fromiter(chain.from_iterable(texts), np.uint64, end)
    left = np.repeat(begin[1:], sizes) - np.arange(end)  # words to the end of the text
    windows = np.flatnonzero(left >= length)
    kind, n = np.zeros(end + 1, np.int64), np.zeros(end + 1, np.int64)
    kind[windows], n[windows] = _numbered(_Sums(words, C1 | np.uint64(1))(windows, windows + length))
    link = (left > length) & (n[:-1] == n[1:])
    several = np.flatnonzero((left > length) & (n[:-1] > 1))
    following = kind[several] * (int(words.max()) + 1) + words[several + length].astype(np.int64)
    link[several] &= _numbered(following)[1] == n[several]
    own = np.flatnonzero(np.cumsum(told)[:-1] > 0)
    cut = np.flatnonzero((own[1:] != own[:-1] + 1) | ~link[own[:-1]])
    lo, hi = own[np.append(0, cut + 1)], own[np.append(cut, len(own) - 1)]
    t = np.searchsorted(begin, lo, "right") - 1
    return list(zip(t.tolist(), (lo - begin[t]).tolist(), (hi - begin[t]).tolist(), strict=True))


def mark(texts: list[tuple[int, ...]], found: list[tuple[int, int, int]], length: int) -> list[np.ndarray]:
    """Of each text the words that some window of a pattern covers; a pattern (text, lo, hi) is what stands there."""
    marks = [np.zeros(len(x) + 1, np.int32) for x in texts]
    found = joined(texts, found, length) if found else []
    at = 0
    while at < len(found):
        automaton, size = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
        while at < len(found) and size < PATTERN_WORDS:
            t, lo, hi = found[at]
            automaton.add_word(texts[t][lo : hi + length], hi + length - lo)
            size += hi + length - lo
            at += 1
        automaton.make_automaton()
        for text, own in zip(texts, marks, strict=True):
            for end, n in automaton.iter(text):
                own[end + 1 - n] += 1
                own[end + 1] -= 1
    return [np.cumsum(x)[:-1] > 0 for x in marks]


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, kept) of each row: the text's words without those in recurring passages, joined by spaces.

    Words are the runs of `[^\\x20\\x09-\\x0D]+`, as they stand. Removed is each word that is covered by `length` words in a
    row of one text which stand in a row at another place too, in any row, the same one included; all such places lose
    them, the first as well. Passages are judged on the input, not on what is left.

    Each row is a document of its own, repeated rows too, whatever its id; null ids stay null. Null, empty and blank
    texts have no words. Very long texts are hashed in overlapping slices and stay in one bucket. An empty table gives no
    rows. Other columns are not looked at.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    size = rows.agg(F.count("*").alias("n"), F.count_distinct("_id").alias("ids"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if whole and size.n == size.ids:
        rows = rows.withColumn("doc", F.col("_id").cast("long"))
    else:
        rows = written(rows.withColumn("doc", F.monotonically_increasing_id()), "numbered")
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.bytes or 0) // BUCKET))
    rows = rows.select("doc", F.pmod(F.xxhash64("doc"), F.lit(n_buckets)).alias("bucket"), "text", "_id")
    places, recurring = patterns(rows.select("doc", "bucket", "text"), length, k)
    touched = BitFilter.of(recurring.select("doc"), "doc", recurring.count())
    names = [id_col, "n_words", "n_removed", "kept"]

    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        words = [x.as_buffer().to_pybytes().split() for x in docs.column("text")]
        numbers, places = {}, count()
        streams = [tuple(map(numbers.setdefault, x, places)) for x in words]  # a word's number is its first place
        row = {d: i for i, d in enumerate(docs.column("doc").to_pylist())}
        own = [(row[d], lo, hi) for d, lo, hi in zip(*(found.column(c).to_pylist() for c in ("doc", "lo", "hi")), strict=True)]
        marks = mark(streams, own, length)
        kept = [b" ".join(compress(w, (~gone).tolist())) for w, gone in zip(words, marks, strict=True)]
        counts = [pa.array(x, _LONG) for x in ([len(x) for x in words], [int(m.sum()) for m in marks])]
        return pa.Table.from_arrays([docs.column("_id"), *counts, pa.array(kept, pa.binary())], names)

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.split() for x in _texts(batch.column(1))]
            counts = [pa.array(x, _LONG) for x in ([len(x) for x in words], [0] * len(words))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([b" ".join(x) for x in words], pa.binary())], names)

    schema = f"`{id_col}` {kind}, n_words long, n_removed long, kept binary"
    with_passages = touched.where(rows, "doc").groupBy("bucket").cogroup(places.groupBy("bucket")).applyInArrow(cut, schema)
    return with_passages.unionByName(touched.where(rows, "doc", held=False).select("_id", "text").mapInArrow(whole_texts, schema))
