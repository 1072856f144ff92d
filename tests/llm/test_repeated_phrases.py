import hashlib
import random

import pytest

from strataloom.llm import queries, repeated_phrases

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """(number of words, removed, what stays) of each text."""
    words = [(t or "").encode().split() for t in texts]
    count = {}
    for x in words:
        for s in range(len(x) - length + 1):
            w = tuple(x[s : s + length])
            count[w] = count.get(w, 0) + 1
    out = []
    for x in words:
        gone = [False] * len(x)
        for s in range(len(x) - length + 1):
            if count[tuple(x[s : s + length])] > 1:
                gone[s : s + length] = [True] * length
        out.append((len(x), sum(gone), b" ".join(w for w, g in zip(x, gone, strict=True) if not g)))
    return out


def removed(df, **how):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept)) for r in repeated_phrases.cut_repeats(df, **how).collect())


@pytest.mark.parametrize(("length", "k", "small"), [(35, 12, False), (35, 12, True), (6, 3, True)])
def test_removal_by_brute_force(spark, monkeypatch, length, k, small):
    if small:
        monkeypatch.setattr(repeated_phrases, "SLICE", 300)
        monkeypatch.setattr(repeated_phrases, "BUCKET", 2000)
        monkeypatch.setattr(repeated_phrases, "PATTERN_WORDS", 100)
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "B", "b", "é", "cd"]) if small else "w%d" % rng.randrange(40)
    some = lambda n: " ".join(word() for _ in range(n))
    passages = [some(rng.randint(length, 3 * length)) for _ in range(5)]
    texts = []
    for k_ in range(60):
        own = rng.choice(passages).split()
        if k_ % 3 == 0:
            own[rng.randrange(len(own))] = "X"
        if k_ % 4 == 0:
            own = own[rng.randint(0, 9) : len(own) - rng.randint(0, 9)]
        texts.append(" \n".join([some(rng.randint(0, 60)), " ".join(own), some(rng.randint(0, 60))]))
    texts += ["", None, " \t ", texts[5], "a " * (2 * length), "a b " * length, some(length), texts[7] + " " + some(4000) + " " + texts[8]]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, bucket string, doc int").repartition(4)
    want = [(str(i), *x) for i, x in enumerate(brute(texts, length))]
    assert removed(df, length=length, k=k) == sorted(want)
    assert removed(df.limit(0)) == []


def covered(texts, found, length):
    """Of each text the words that stand in an occurrence of a window of some pattern."""
    told = {texts[t][s : s + length] for t, lo, hi in found for s in range(lo, hi + 1)}
    out = []
    for x in texts:
        gone = [False] * len(x)
        for s in range(len(x) - length + 1):
            if x[s : s + length] in told:
                gone[s : s + length] = [True] * length
        out.append(gone)
    return out


def words_of_automata(monkeypatch):
    """The lengths of the patterns that automata get from now on."""
    got, real = [], repeated_phrases.ahocorasick.Automaton

    class Automaton:
        def __init__(self, *how):
            self.own = real(*how)

        def add_word(self, key, value):
            got.append(len(key))
            return self.own.add_word(key, value)

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(repeated_phrases.ahocorasick, "Automaton", Automaton)
    return got


def test_overlapping_passages_are_one_pattern(monkeypatch):
    got, length = words_of_automata(monkeypatch), 35
    passage, other = tuple(range(1000)), tuple(range(2000, 2100))
    texts = [other + passage, passage + other[:50], (7, *passage, 8)]
    found = [(0, s, s) for s in [*range(66), *range(100, 1066)]]
    marks = [x.tolist() for x in repeated_phrases.mark(texts, found, length)]
    assert marks == covered(texts, found, length)
    assert marks[2] == [False, *[True] * 1000, False]
    assert sum(got) < 1300  # 36,120 if each window were a pattern


@pytest.mark.parametrize("seed", range(60))
def test_joined_patterns_cover_what_their_windows_do(seed):
    rng = random.Random(seed)
    length = rng.randint(1, 6)
    some = lambda n: tuple(rng.randrange(1 + seed % 3) for _ in range(n))
    passages = [some(rng.randint(length, 25)) for _ in range(3)]
    texts = [some(rng.randint(0, 9)) + rng.choice(passages)[rng.randint(0, 3) :] + some(rng.randint(0, 9)) for _ in range(6)] + [()]
    found = []
    for _ in range(rng.randint(1, 8)):
        t = rng.choice([t for t, x in enumerate(texts) if len(x) >= length] or [None])
        if t is not None:
            lo = rng.randint(0, len(texts[t]) - length)
            found.append((t, lo, rng.randint(lo, len(texts[t]) - length)))
    assert [x.tolist() for x in repeated_phrases.mark(texts, found, length)] == covered(texts, found, length)


def test_null_ids_and_repeated_rows(spark):
    text, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(50))
    rows = [(None, text), (3, other), (3, other), (None, None), (2, "short")]
    got = removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == [("2", 1, 0, b"short"), ("3", 50, 50, b""), ("3", 50, 50, b""), ("None", 0, 0, b""), ("None", 40, 0, text.encode())]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: (n, g, hashlib.sha256(x).hexdigest()) for r, (n, g, x) in zip(docs, brute([r.text for r in docs], 35), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op11_repeated_phrases(spark, SF).collect()} == want
    assert any(g for _, g, _ in want.values())
