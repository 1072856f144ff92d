import base64
import functools
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import bpe, queries, token_counts

RANKS = token_counts.read_ranks(queries.RANKS)
TRUTH = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [
    (1, "Hello  world, it's 42 degrees\n\n here"),
    (2, ""),
    (3, None),
    (None, "null id"),
    (5, "repeat me"),
    (5, "repeat me"),
    (6, " \t\n\x0b\x0c\r "),
    (7, "naïve 日本語 🙂🙂 <|endoftext|>"),
    (8, "ab'll " * 3000),
]


LONGEST = max(map(len, RANKS))


@functools.cache
def greedy_of_ranks(word):
    return greedy(word, RANKS)


def greedy(word, vocabulary):
    n, at = 0, 0
    while at < len(word):
        stop = next((e for e in range(min(len(word), at + LONGEST), at, -1) if word[at:e] in vocabulary), None)
        if stop is None:
            return 1
        n, at = n + 1, stop
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(x % 3 for x in b)), min_size=1), st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)))
def test_automaton_counts_like_greedy_matching(vocabulary, word):
    assert token_counts.LongestMatch(vocabulary).count(word) == greedy(word, vocabulary)


def test_token_counts_over_rows(spark):
    df = spark.createDataFrame([(*x, "other") for x in TEXTS], "doc_id long, text string, n_words string")
    got = sorted(token_counts.token_counts(df, RANKS).collect(), key=str)
    want = []
    for i, text in TEXTS:
        found = (text or "").encode().split()
        want.append((i, len(found), sum(greedy(b" " + w, RANKS) for w in found)))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: f"Row(doc_id={r[0]}, n_words={r[1]}, n_pieces={r[2]})")
    assert token_counts.token_counts(df.limit(0), RANKS).count() == 0


def test_encoding_equals_the_public_library_and_decodes_back(spark):
    df = spark.createDataFrame([(*x, "other") for x in TEXTS], "doc_id long, text string, token_ids string")
    for chunk, overlap in ((32_768, 2_048), (40, 8), (7, 5)):
        rows = bpe.decode(bpe.encode(df, queries.RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap), queries.RANKS).collect()
        got = sorted((str(r.doc_id), r.token_ids, bytes(r.decoded)) for r in rows)
        assert got == sorted((str(i), TRUTH.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS)
    assert bpe.encode(df.limit(0), queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_stitching_equals_one_pass():
    rng = random.Random(3)
    compiled = bpe.regex.compile(public_tokenizers.PATTERN)
    for _ in range(400):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'ll", "'", "1", "22", "é", ",", ".", "日"]) for _ in range(rng.randint(0, 90)))
        chunk, overlap = rng.randint(3, 20), rng.randint(5, 12)
        chunks = [(at, text[at : at + chunk + overlap], bpe.ends_of(compiled, text[at : at + chunk + overlap])) for at in range(0, max(1, len(text)), chunk)]
        assert list(bpe.stitch(compiled, chunks)) == compiled.findall(text)


def test_merging_long_pieces():
    rng = random.Random(5)
    for n in (1, 3, 60, 500, 3000):
        piece = bytes(rng.choice(b"abcetins") for _ in range(n))
        assert bpe.merge(piece, RANKS) == TRUTH.encode_ordinary(piece.decode())
    assert base64  # the rank file is base64


def test_queries_on_the_given_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    import hashlib

    rows = queries.op9_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = TRUTH.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    for r in queries.op8_token_counts(spark, "/root/testdata/sf0.001").collect():
        assert r.n_pieces == sum(greedy_of_ranks(b" " + w) for w in docs[r.doc_id].encode().split())
