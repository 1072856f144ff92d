"""Toxicity by a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

(Wang and Manning, "Baselines and Bigrams", 2012.) N-grams of characters are hashed into a fixed number of buckets.
A text's features are the buckets that occur in it, each scaled by the log of how much likelier toxic training texts
hold it, the whole scaled to length one. A logistic regression over these features is fitted with all weights free.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the n-grams, and bits of the bucket numbers.
ORDERS, BITS = (3, 4), 18
#: Labelled rows that a fit takes of each class at most, those of the smallest hash of their id. A row comes to the driver
#: as a bitmap of 2 ** BITS bits, packed: 32 KB at most, however long its text, so all rows are 100 MB at most.
ROWS_A_CLASS = 1500
#: How much a weight shrinks with each step that uses it.
DECAY = 1e-5
FOLDS = 5


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float


class Features:
    """The distinct buckets of a text's character n-grams, in small letters, with a space at both ends; in no order."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        out, h = [], np.zeros(len(a), np.uint32)
        for k in range(max(ORDERS)):
            if k >= len(a):
                break
            h = (h[: len(a) - k] ^ a[k:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if k + 1 in ORDERS:
                out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
        if not out:
            return np.empty(0, np.uint32)
        found = np.concatenate(out)
        places = np.arange(len(found), dtype=np.int32)
        self.seen[found] = places  # the last of equal ones stays
        return found[self.seen[found] == places]


def held_out(id_col: str) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by FOLDS. A null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_a_class: int = ROWS_A_CLASS, rounds: int = 6) -> Model:
    """Fits on the labelled rows that are not held out, `rows_a_class` of either label at most.

    The bound holds for the fit alone: it caps what comes to the driver, at rows_a_class * 2 bitmaps of 2 ** BITS bits.
    Labelled texts are read whole; repeated rows count as often as they occur. Null labels and labels other than 0 and 1 are left out. Without both labels the model says 0.5
    for every text, or 0 or 1 if there is only that label.
    """
    spark = docs.sparkSession
    usable = labels.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    own = [usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows_a_class).collect() for y in (0, 1)]
    sample = spark.createDataFrame([(r["_id"], r["_y"]) for rows in own for r in rows], "_id long, _y int")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            x = []
            for t in batch.column(1):
                bits = np.zeros(1 << BITS, bool)
                bits[of(t.as_py() or "")] = True
                x.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["y", "x"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample.distinct()), "_id").select("_y", "_text").mapInArrow(features, "y int, x binary").collect()
    y = np.array([r.y for r in rows], np.float64)
    size = 1 << BITS
    if len(set(y)) < 2:
        return Model(np.zeros(size), np.zeros(size), {0: -50.0, 1: 50.0}[int(y[0])] if len(y) else 0.0)
    xs = [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(r.x), np.uint8))).astype(np.int32) for r in rows]
    counts = np.zeros((2, size))
    for x, k in zip(xs, y.astype(int), strict=True):
        counts[k, x] += 1
    held = np.log((counts + 1) / (np.array([[len(y) - y.sum()], [y.sum()]]) + 2))
    ratio = np.where(counts.sum(axis=0) > 1, held[1] - held[0], 0.0)
    values = [ratio[x] / max(1e-9, np.sqrt((ratio[x] ** 2).sum())) for x in xs]
    # stochastic gradient steps with a rate for each weight, on as many rows of either label
    weight, squares, bias, bias_squares = np.zeros(size), np.full(size, 1e-8), 0.0, 1e-8
    rng, by_label = np.random.default_rng(1), [np.flatnonzero(y == k) for k in (0, 1)]
    n = max(map(len, by_label))
    for _ in range(rounds):
        drawn = [np.resize(rng.permutation(own), n) for own in by_label]
        for i in np.stack(drawn, axis=1).reshape(-1):
            x, v = xs[i], values[i]
            error = 1 / (1 + np.exp(-np.clip((weight[x] * v).sum() + bias, -50, 50))) - y[i]
            step = error * v + DECAY * weight[x]
            squares[x] += step * step
            weight[x] -= 0.2 * step / np.sqrt(squares[x])
            bias_squares += error * error
            bias -= 0.15 * error / np.sqrt(bias_squares)
    return Model(ratio, weight, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, held_out, score (0 to 1; from the text alone) and predicted (1 from 0.5 on) of the whole text.

    Null and empty texts have no n-gram but those of the two spaces around them, and a score like any other; very long
    texts are scored whole. Repeated rows score alike; null ids stay null. Columns with other names are not read. An empty table gives no rows. The model is two vectors of fixed length.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio * model.weight, model.ratio**2, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        push, square, bias = shared.value
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for k, text in enumerate(batch.column(2)):
                f = of(text.as_py() or "")
                z[k] += push[f].sum() / max(1e-9, np.sqrt(square[f].sum()))
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
