import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import hard_negatives, queries

SF = "/root/testdata/sf0.001"


def brute(rows, every=100, relabel=7, low=80, k=5):
    """By comparing all with all; of rows that share an id, the first by label and vector counts."""
    firsts = {}
    for i, x, y in rows:
        if i is None or y is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        y = (y + 1) % 10 if i % relabel == 0 else y
        own = y, [math.floor(256 * c) for c in x]
        firsts[i] = min(firsts.get(i, own), own)
    out = set()
    for a, (label, q) in firsts.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, v, strict=False)) for i, (_, v) in firsts.items()}
        order = sorted(firsts, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and firsts[i][0] == label][:k]:
            fit = [i for i in order if firsts[i][0] != label and low * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:k], 1)}
    return out


def rows_of(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    found = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def mined(df):
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.hard_negatives(df, F.expr("vec_id % 100 = 0"), label=label)


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(queries.op13_hard_negatives(spark, SF)) == brute(rows)


@pytest.mark.parametrize(("sample", "block", "size"), [(8192, 1 << 15, 1024), (40, 50, 2)])
def test_clustered_vectors_with_ties_and_copies(spark, monkeypatch, sample, block, size):
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "SLICE", size)
    monkeypatch.setattr(hard_negatives, "ANCHORS_EACH", 3)
    rng = random.Random(3)
    tops = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(900):
        x = [c + rng.gauss(0, 0.15) for c in rng.choice(tops)] if i % 3 else list(tops[0])  # a third are one vector
        rows.append((i, x, rng.choice([0, 0, 0, 1, 2, 3, 9])))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    seen = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert rows_of(mined(df)) == brute(seen)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (100, [0.0, 0.0], 1), (200, [-1.0, -1.0], 2), (300, [5.0], 3), (400, [], 2), (None, [1.0, 2.0], 1), (1, None, 1), (2, [nan, 1.0], 1),
        (3, [inf, 1.0], 1), (4, [None, 1.0], 2), (5, [1.0, 2.0], None), (6, [1.0, 2.0], 2), (6, [1.0, 2.0], 2), (8, [1.0, 1.9], 2), (9, [1.0, 2.0], 2), (10, [0.9, 2.0], 1),
        (10, [9.0, 9.0], 5), (11, [1.0, 2.0], 2), (12, [1.0, 2.0], 3), (13, [1.0, 1.0], 3), (15, [-3.0, 0.001], 2), (700, [2.0, 2.0], 9), (16, [1.0, 1.5], 1), (17, [1.0, 1.5], 1),
        (500, [1000.0, -1000.0], 4), (18, [900.0, -900.0], 4), (19, [870.0, -900.0], 5),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, q int, score string")
    assert rows_of(mined(df)) == brute(rows)
    assert mined(df.limit(0)).count() == 0
    assert mined(df.where("vec_id % 100 <> 0")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    members, vectors = rng.integers(-300, 300, (40, 16)), rng.integers(-300, 300, (300, 16))
    centre = hard_negatives.centroids(members, 1)[0]
    norms = hard_negatives._norms(members)
    within = hard_negatives._angles(members, norms, centre).max()
    reach = hard_negatives._bounds(hard_negatives._norms(vectors), hard_negatives._angles(vectors, hard_negatives._norms(vectors), centre), within)
    assert (members @ vectors.T <= norms[:, None] * reach[None, :] + 0.5).all()
