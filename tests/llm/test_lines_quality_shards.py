import collections
import hashlib
import re
import zlib

import pandas as pd
import pytest

from strataloom.llm import line_dedup, quality, queries, sharding

SF = "/root/testdata/sf0.001"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def deduped(rows, least, keep="none"):
    docs = collections.defaultdict(set)
    first = {}
    for i, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])):
        for p, line in enumerate((text or "").split("\n")):
            if key_of(line):
                docs[key_of(line)].add((i, text))
                first.setdefault(key_of(line), (i, text, p))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for p, x in enumerate(lines) if len(docs[key_of(x)]) < least or (keep == "first" and first[key_of(x)] == (i, text, p))]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


ROWS = [
    (1, "Common\nown one\n\n common \nZ"),
    (2, "COMMON"),
    (3, None),
    (4, ""),
    (None, "common\nnull id"),
    (6, "x\n" * 200 + "common\n" + "y\n" * 100),
    (6, "x\n" * 200 + "common\n" + "y\n" * 100),
    (7, "y"),
    (8, "ÉTÉ\nété\n \t\x0b\x0c\r"),
]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup_by_brute_force(spark, keep):
    df = spark.createDataFrame([(*r, 1, "h") for r in ROWS], "doc_id long, text string, _pos int, _h1 string")
    rows = line_dedup.line_dedup(df, least_docs=2, keep=keep).collect()
    got = sorted(((r._row.doc_id, r._lines.text or "", r._lines.n_lines, r._lines.n_dropped) for r in rows), key=str)
    assert got == deduped(ROWS, 2, keep)
    assert all(r._row._h1 == "h" for r in rows)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def measured(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_measures_by_brute_force(spark):
    texts = [None, "", " \n ", "a b c d e a b c d e", "a a a a a a a a", "one\none\n two\n\n\n two", "x # * $ % & | < > y", "é " * 40, "a b c d e f " * 3 + "z", "w" * 5000, "\x0b\x0ca\rb\x85c"]
    df = spark.createDataFrame([(i, t, "clash", 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, _words int, `_w` int, `a.b` int")
    assert quality.judge(df).columns[:5] == ["doc_id", "text", "_words", "_w", "a.b"]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect()}
    assert got == {i: measured(t) for i, t in enumerate(texts)}
    assert quality.judge(df.limit(0)).count() == 0


def test_order_of_rules_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rules = quality.default_rules()
    verdicts = [{r.doc_id: r.kept for r in quality.judge(docs, rules=x).collect()} for x in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1] and len(set(verdicts[0].values())) == 2


def test_rules_that_reject_more_for_less_come_first(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).cache()
    slow = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda x: F.sha2((x + F.col("id")).cast("string"), 256)), lambda x: x > "f")) >= 0
    same = [quality.Rule("slow", slow & (F.col("id") % 2 == 0)), quality.Rule("fast", F.col("id") % 2 == 0)]
    assert [r.name for r in quality.order_rules(df, same)] == ["fast", "slow"]
    slow_spent = quality.task_seconds(spark, lambda: df.agg(F.count_if(slow)).collect())
    assert slow_spent > 2 * quality.task_seconds(spark, lambda: df.agg(F.count_if(F.col("id") > 3)).collect())
    rules = [quality.Rule("never", F.col("id") < 0), quality.Rule("often", F.col("id") >= 10), quality.Rule("null", F.lit(None).cast("boolean"))]
    assert quality.order_rules(df, rules)[0].name == "often"
    assert [r.name for r in quality.order_rules(df.limit(0), rules)] == ["never", "often", "null"]
    assert df.select(quality.cascade(rules).alias("r")).where("r IS NULL").count() == 10


def test_each_rule_rejects_what_it_is_for(spark):
    good = "\n".join(" ".join(f"word{chr(97 + k % 26)}{chr(97 + (k * j) % 26)}" for k in range(12)) for j in range(1, 9))
    texts = {
        None: good, "symbols": good.replace(" ", " #"), "word length": good.replace("word", "w" * 20), "upper case": good.upper(),
        "few words with letters": good + " 1 2 3 4" * 40 + " " + " ".join(map(str, range(100, 300))), "bullets": "\n".join(f"- {x}" for x in good.split("\n")), "cut lines": good.replace("\n", " ...\n"),
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id long, text string")
    rules = quality.default_rules()
    for own in (rules, rules[::-1]):
        out = {r.doc_id: r for r in quality.judge(df, rules=own).collect()}
        assert out[0].kept and not any(out[k].kept for k in range(1, len(texts)))
    named = {r.name: r for r in rules}
    for k, name in enumerate(texts):
        if name and not out[k].base_failed:
            assert df.where(f"doc_id = {k}").transform(quality.measures).where(named[name].fails).count() == 1, name


def check_shards(rows, out, n):
    assert len(out) == len(rows)
    sizes = {}
    for i, text in rows:
        b = (text or "").encode()
        sizes[(i, zlib.crc32(b))] = len(b) + 16
    assert all(sizes[(None if pd.isna(r.doc_id) else r.doc_id, r.text_crc32)] == r.size and r.grown_shard is None and r.law == "bytes" for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, most = sum(r.size for r in out), max((r.size for r in out), default=0)
    for k in range(n):
        assert abs(sum(r.size for r in by[k]) - total / n) <= most + 0.02 * total / n


def test_shards_are_even_even_with_a_hot_group(spark):
    rows = [(i, "hot copy of a text" * 3 if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(3000)] + [(None, None), (3001, None), (3002, ""), (3003, "é" * 2000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(5)
    check_shards(rows, sharding.shard_by_bytes(df, n_shards=7).collect(), 7)
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


def test_groups_stay_together_where_shards_stay_near_equal(spark):
    rows = [(i, f"group {i // 20} " * 5) for i in range(8000)] + [(3, "other text of an id that comes twice")]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=7).collect()
    shards = collections.defaultdict(set)
    for r in out:
        shards[r.text_crc32].add(r.shard)
    assert len(out) == len(rows) and all(len(x) == 1 for x in shards.values())


def test_repeated_rows_get_a_slot_each(spark):
    df = spark.createDataFrame([(1, "same")] * 50, "doc_id long, text string")
    out = sharding.shard_by_bytes(df, n_shards=3).collect()
    assert len({(r.shard, r.slot) for r in out}) == 50


def test_queries(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in deduped(docs, 10)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op3_line_dedup(spark, SF).collect()} == want
    got = {r.doc_id: r for r in queries.op4_quality(spark, SF).collect()}
    for i, text in docs:
        m = measured(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and not (r.base_failed and r.kept)
    check_shards(docs, queries.op10_sharding(spark, SF).collect(), 40)
