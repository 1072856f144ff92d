import hashlib
import random
import zlib

import numpy as np
import pytest

from strataloom.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute(words):
    """All runs by comparing each word with the one q words on."""
    out = []
    for q in range(1, len(words) // 3 + 1):
        s = 0
        while s + q < len(words):
            e = s
            while e + q < len(words) and words[e] == words[e + q]:
                e += 1
            part = words[s : e + q]
            if e > s and len(part) >= max(24, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((s, len(part), q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    few = rng.choice([1, 2, 2, 3, 20])
    word = lambda: b"%d" % rng.randrange(few)
    out = [word() for _ in range(rng.randint(0, 90))]
    if rng.random() < 0.6:
        unit = [word() for _ in range(rng.randint(1, 15))]
        out += unit * rng.randint(2, 12) + unit[: rng.randrange(len(unit))] + [word() for _ in range(rng.randint(0, 40))]
    return out


def test_runs_by_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        assert periodic_runs.runs_of(texts) == [brute(x) for x in texts]


def test_grammar_questions():
    rng = random.Random(6)
    for _ in range(60):
        text = [999, *(int(w) for w in some_words(rng)), 888]
        grammar = periodic_runs.Grammar(np.array(text))
        for _ in range(40):
            i, j = sorted((rng.randrange(len(text)), rng.randrange(len(text))))
            if i == j:
                continue
            right = next(k for k in range(len(text)) if j + k == len(text) or text[i + k] != text[j + k])
            left = next(k for k in range(len(text)) if i - k == 0 or text[i - 1 - k] != text[j - 1 - k])
            assert (grammar.right(i, j), grammar.left(i, j)) == (right, left)


@pytest.mark.parametrize("size", [1 << 16, 50])
def test_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", size)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "a " * 30), (4, "a " * 30), (None, "x y z " * 12), (5, "a b " * 11),
        (6, " ".join(str(k) for k in range(40)) + " q" * 5), (7, "ab cd ef " * 20_000), (8, "A a " * 12),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, runs string").repartition(3)
    got = sorted(
        ((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), bytes(r.collapsed)) for r in periodic_runs.periodic_runs(df).collect()),
        key=lambda r: r[:2],
    )
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = brute(words) if len(words) < 1000 else [(0, 60_000, 3)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i or 0, len(words), runs, runs[0] if runs else None, b" ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=lambda r: r[:2])
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        words = (r.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if n > 4000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = brute(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        x = got[r.doc_id]
        assert (x.n_runs, x.start, x.length, x.period) == (len(runs), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
