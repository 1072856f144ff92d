import hashlib

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_decontaminate_toxicity import QUESTION
from test_lines_quality_shards import deduped, measured
from test_near_dup import brute

import corpus_pipeline
from strataloom.llm import queries, token_counts
from strataloom.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    kept = written(stage[names[0]](spark, docs, SF), "t")
    assert kept.columns == docs.columns
    judged = {r.doc_id: r.kept for r in queries.op4_quality(spark, SF).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in judged.items() if k}
    assert all(measured(rows[i].text)[0] >= 10 for i, k in judged.items() if k)

    lined = written(stage[names[1]](spark, kept, SF), "t")
    want = {i: t for i, t, _, _ in deduped([(r.doc_id, r.text) for r in kept.collect()], 10)}
    got = lined.collect()
    assert lined.columns == docs.columns and {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)

    apart = written(stage[names[2]](spark, lined, SF), "t")
    groups = brute([(r.doc_id, r.text) for r in got], 5)
    assert apart.columns == docs.columns and {r.doc_id for r in apart.collect()} == {i for i, (_, _, k) in groups.items() if k}

    clean = written(stage[names[3]](spark, apart, SF), "t")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert clean.columns == docs.columns
    assert {r.doc_id for r in apart.collect()} - {r.doc_id for r in clean.collect()} == {r.doc_id for r in apart.collect() if any(b in r.text for b in bench)}

    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=token_counts.read_ranks(queries.RANKS), special_tokens={})
    texts = {r.doc_id: r.text for r in clean.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.token_ids for r in out} == {i: truth.encode_ordinary(t) for i, t in texts.items()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    t, u, z, q = (" ".join(f"{x}{k}" for k in range(40)) for x in "tuzq")
    rows = [(1, t), (3, t), (3, u), (4, z), (4, q), (None, u), (None, "short"), (None, None), (4, z)]
    docs = spark.createDataFrame([(*r, "own", k) for k, r in enumerate(rows)], "doc_id long, text string, key string, `a.b` int")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert left.columns == docs.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    texts = [x for _, x in got]
    assert sorted(map(str, texts)) == sorted(map(str, [t, u, z, q, "short", None])) and len(set(got)) == len(got)
    unique = docs.where("`a.b` IN (1, 0, 4)").withColumn("doc_id", F.col("`a.b`").cast("long"))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, unique, SF).collect()) == [0, 4]


def test_nulls_repeats_clashes_and_no_rows(spark, tmp_path):
    good = " ".join(f"word{k} and then" for k in range(30))
    rows = [(1, good, "en", "s", None, "x"), (1, good, "en", "s", None, "x"), (2, good, None, None, 5, "y"), (None, good + " more", "en", "s", 1, "z"), (4, None, "en", "s", 0, "q"), (5, "", "en", "s", 0, None), (6, "filler text goes here " + QUESTION, "en", "s", 0, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in out] == [1]
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_a_very_long_text_goes_through_all_stages(spark, tmp_path):
    long = " ".join(f"word{k % 977}x{k}" for k in range(120_000))
    leak = " ".join(f"term{k % 977}y{k}" for k in range(120_000)) + f" {QUESTION}"
    rows = [(1, long, 7, "a"), (2, leak, 7, "b"), (3, long + " end", 7, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, kept string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.decoded_sha256) for r in out] == [(1, hashlib.sha256(long.encode()).hexdigest())]
