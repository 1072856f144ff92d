import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_suffix_array_by_sorting(x):
    x = [*x, -1]
    assert suffix_dedup.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute(rows, length):
    """rows in order: (number of bytes, removed, spans, what stays)."""
    seen, out = set(), []
    for data in rows:
        mark = [False] * len(data)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                mark[s : s + length] = [True] * length
            seen.add(w)
        spans = sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark))
        out.append((len(data), sum(mark), spans, bytes(b for b, m in zip(data, mark, strict=True) if not m)))
    return out


def test_repeats_of_pieces():
    rng = random.Random(1)
    for slack in (1, 3, 5):
        some = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, slack)))  # noqa: B023, E731
        pieces = [(some(), rng.randrange(3), some()) for _ in range(40)]
        seen, want = set(), []
        for k, (left, core, right) in enumerate(pieces):
            for i in range(max(0, slack - len(right)), min(slack, len(left)) + 1):
                w = (left[len(left) - i :], core, right[: slack - i])
                if w in seen:
                    want.append((k, len(left) - i))
                seen.add(w)
        got = suffix_dedup.repeats(pieces, slack)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_removal_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "SLICE", 3000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_SYMBOLS", 500)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        own = list(rng.choice(passages))
        if k % 3 == 0:
            own[rng.randrange(len(own))] = "é"
        texts.append(parts[0] + "".join(own) + parts[1] + (rng.choice(passages) if k % 4 == 0 else "") + parts[2])
    texts += ["", "a" * 500, "ab" * 300, texts[3], "a" * 99, "a" * 100, "x" * 20000 + texts[5] + "y" * 5000, texts[5] * 40]
    rows = list(enumerate(texts)) + [(1000, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, lo int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut_repeats(df).collect()}
    assert got == dict(zip([r[0] for r in rows], brute([(t or "").encode() for _, t in rows], 100), strict=True))
    assert suffix_dedup.cut_repeats(df.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(150))
    rows = [(None, text), (3, text), (3, text), (2, "short"), (None, None)]
    out = suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in out)
    assert got == [("2", 5, 0), ("3", 150, 0), ("3", 150, 0), ("None", 0, 0), ("None", 150, 150)]


def test_query(spark):
    docs = sorted((r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = {i: (n, g, s, hashlib.sha256(k).hexdigest()) for (i, _), (n, g, s, k) in zip(docs, brute([t for _, t in docs], 100), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, SF).collect()} == want
