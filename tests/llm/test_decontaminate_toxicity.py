import math
import random
import re
import zlib

from strataloom.llm import decontaminate, queries, toxicity

SF = "/root/testdata/sf0.001"
QUESTION = "A farmer named Boris sold 48 apples in April, and then Boris sold 24 km of rope in May; how many apples did Boris sell in all?"
ALTERED = QUESTION.replace("Boris", "Clara").replace("48", "7").replace("24 km", "1,300 miles")
TORN = QUESTION.replace("named Boris", "named Anna").replace("then Boris", "then Ben").replace("did Boris", "did Carl")


def found(spark, docs, bench):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, item string, hash int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.leaks(d, b).collect()}


def test_copies_and_other_parameters_are_found_and_torn_slots_are_not(spark):
    filler = " ".join(f"word{i % 37}" for i in range(300))
    docs = [
        (1, f"{filler} {QUESTION} {filler}"),
        (2, f"{filler}\n{ALTERED}\n{filler}"),
        (3, f"{filler} {TORN} {filler}"),
        (4, filler),
        (5, None),
        (6, ""),
        (None, QUESTION.lower()),
        (8, "  ".join(QUESTION.split())),
        (9, QUESTION), (9, QUESTION),
        (10, " ".join(QUESTION.split()[:12])),
    ]
    got = found(spark, docs, [(7, QUESTION), (8, None), (9, "too short"), (None, QUESTION), (10, "1 2 3 4 5 6 7 8 9")])
    assert {k for k in got} == {(1, 7), (2, 7), (8, 7), (9, 7), (None, 7)}
    assert got[(1, 7)].n_changed == 0 and got[(2, 7)].n_changed == 4
    assert got[(1, 7)].n_found == got[(1, 7)].n_windows


def test_broadcast_and_shuffled_joins_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {tuple(r) for r in decontaminate.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    for bits in (26, 7):
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        assert {tuple(r) for r in decontaminate.leaks(docs, bench).collect()} == one


def test_empty_tables_and_cleaning(spark):
    docs = spark.createDataFrame([(1, QUESTION, "s"), (2, "other", None), (None, None, None)], "doc_id long, text string, _row string")
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "None"]


def test_query_finds_every_literal_copy_and_no_more(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    flat = lambda t: re.sub(r"\s+", " ", t)
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if flat(b.text) in flat(d.text)}
    assert {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, SF).collect()} == want


def test_features_are_the_distinct_buckets():
    of = toxicity.Features()
    assert sorted(of("abab")) == sorted(set(of("abab"))) and set(of("ABÄB")) == set(of("abäb"))
    assert len(of("")) == 0 and len(of("abcdef" * 50)) <= 2 * (6 + 5)
    assert len(of("äöü")) == len(of("aou")) == 5  # characters, not bytes


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice("stone river cloud lamp green walk quiet paper".split()) for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["vilescum", "vilerat"])
            words[rng.randrange(40)] = rng.choice(["vilescum", "vilerat"])
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1 if i % 4 == 0 else 0))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "vilescum vilerat", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, lab)).collect()}
    assert len(out) == len(rows)
    for i, y in labels:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(out[i].predicted, y) for i, y in labels if out[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert out[1000].score == out[1001].score and out[None].predicted == 1 and not out[None].held_out
    one = toxicity.fit(docs, lab.where("toxic = 0"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, one).collect())
    none = toxicity.fit(docs, lab.limit(0))
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_held_out_rows_of_the_given_labels_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").select("doc_id", "toxic")
    held = queries.op6_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    rank, toxic = held.score.rank(), held.toxic == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    print("held-out rows", len(held), "toxic", toxic.sum(), "AUC", auc, "right", ((held.score >= 0.5) == toxic).mean())
    assert auc > 0.92 and ((held.score >= 0.5) == toxic).mean() > 0.93  # some given labels are wrong


def test_toxicity_of_repeated_and_very_long_rows(spark):
    rows = [(k, ("vile scum " if k % 2 else "kind word ") * 30) for k in range(200)]
    long = "calm sea " * 200_000
    docs = spark.createDataFrame([*rows, *rows[:20], (900, long), (901, long + "vile scum " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 222 and len({(r.doc_id, r.score) for r in out}) == 202
    by = {r.doc_id: r.predicted for r in out}
    assert all(by[k] == k % 2 for k in range(200)) and by[901] == 1


def test_query_scores_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = queries.op6_toxicity(spark, SF).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_copies_in_another_case_are_found(spark):
    name_rich = "Yesterday my friend Anna and her cousin Boris met the baker Carl near Vienna, where Dora sold 24 kg of bread to Emil for 30 euros and then Frieda went home with Gustav."
    texts = [(1, QUESTION), (2, name_rich), (3, "Auf der Straße trafen wir 12 große Hunde, die Anna und Boris dort seit dem Morgen lange gesucht hatten.")]
    docs = [(10 * i + k, f"so it began. {case(t)} and so it ends.") for i, t in texts for k, case in enumerate((str, str.upper, str.lower, str.title))]
    got = found(spark, docs, texts)
    assert set(got) == {(10 * i + k, i) for i, _ in texts for k in range(4)}
    assert all(r.n_changed == 0 for (d, _), r in got.items() if d % 10 == 0)


def test_names_that_open_sentences_may_differ(spark):
    toms = "Tom has 3 apples and 5 pears. Tom buys 4 more apples at the market. How many apples does Tom have now?"
    change = lambda t, pairs: re.sub("|".join(pairs), lambda m: pairs[m.group()], t)
    numbers = {"3": "8", "5": "6", "4": "9"}
    docs = [
        (1, change(toms, {"Tom": "Anna", **numbers})),
        (2, "So it began. " + change(toms, {"Tom": "Anna"}) + " And so it ends."),
        (3, change(toms, numbers).replace("Tom has", "Anna has").replace("Tom buys", "Ben buys").replace("does Tom", "does Carl")),
    ]
    got = found(spark, docs, [(7, toms)])
    assert set(got) == {(1, 7), (2, 7)}
    assert got[(1, 7)].n_changed == 4 and got[(2, 7)].n_changed == 1


def test_short_items_are_templates_and_what_has_no_words_is_literal(spark):
    bench = [
        (1, "What is 3 + 4?"), (2, "2 3 5 7 11 13 17 19 23"), (3, "Anna Boris Clara Dora Emil Frieda Gustav"), (4, "Why"), (5, "Solve 3.5 x 2"), (6, ""), (7, "!?"),
        (8, "What is 17 plus 25?"), (9, "Where was Boris born?"), (10, "Chapter 3"), (11, "So tell us where and how they were made out of sand."),
    ]
    docs = [
        (1, "We asked: what is 3 + 4? Nobody knew."), (2, "We asked: what is 3 + 5? Nobody knew."),
        (3, "The row 2, 3, 5, 7, 11, 13, 17, 19, 23 is known."), (4, "The row 2, 3, 5, 8, 11, 13, 18, 19, 24 is known."),
        (5, "ANNA, BORIS, CLARA, DORA, EMIL, FRIEDA, GUSTAV"), (6, "in 48 why not"), (7, "why"), (8, "solve 3.5 x 2 now"), (9, "Solve 35 x 2 now"),
        (10, "So what is 91 plus 14?"), (11, "What is 17 minus 25"), (12, "Now where was Clara born, and when?"), (13, "where was born"), (14, "chapter 4"), (15, "Chapter 3."),
        (16, "what is 5 plus"), (17, "where was"),
    ]
    got = found(spark, docs, bench)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (5, 3), (6, 4), (7, 4), (8, 5), (9, 5), (10, 8), (12, 9), (15, 10)}
    assert {k: r.n_changed for k, r in got.items() if r.n_changed} == {(2, 1): 1, (9, 5): 1, (10, 8): 2, (12, 9): 1}


def test_items_thick_with_numbers_or_names_are_found_with_others(spark):
    bench = [
        (1, "Anna and Boris and Clara and Dina meet Emil near Fulda."), (2, "Add 3, 4, 5 and 6, then take 7 and 8 away."),
        (3, "Sort the list 3 9 27 4 16 64 5 25 125 6 36 by size, then give the sum of 3 9 27 4 16 64 5 25 125 6 36 as an answer."),
    ]
    docs = [
        (1, "They say: Gina and Hugo and Ines and Jan meet Kurt near Lille. Then"), (2, "gina and hugo and jan and hugo meet kurt near lille"), (3, "This and that and more and less meet here, and all is near there."),
        (4, "Now add 13, 14, 15 and 16, then take 17 and 18 away, please."), (5, "add 3, 4, 5 and 6, then give 7 and 8 away"), (6, "3 4 5 6 7 8"),
        (7, "Sort the list 4 10 28 5 17 65 6 26 126 7 37 by size, then give the sum of 4 10 28 5 17 65 6 26 126 7 37 as an answer."),
        (8, "Sort the list 4 10 28 5 17 65 6 26 126 7 37 by size, then give the sum of 1 2 3 4 5 6 7 8 9 10 11 as an answer."),
    ]
    assert {k: r.n_changed for k, r in found(spark, docs, bench).items()} == {(1, 1): 4, (4, 2): 6, (7, 3): 11}


def test_recall_of_short_items(spark):
    rng = random.Random(9)
    people = ["Ada", "Bert", "Cleo", "Dirk", "Edda", "Finn", "Gina", "Hugo"]
    frames = [
        "What is {x} plus {y}?", "Divide {x} by {y}", "How old is {a} today?", "Name {x} rivers of Asia", "Is {x} km far?", "Where did {a} buy {x} {t}?", "Which {t} cost {x} dollars there?",
        "Did {a} walk {x} km with {b}?", "{a} sold {x} old {t} last week", "Round {x} to the next whole number",
    ]
    fill = lambda f: f.format(a=(p := rng.sample(people, 2))[0], b=p[1], x=rng.randrange(2, 90), y=rng.randrange(100, 900), t="apples")
    bench = [(k, fill(f)) for k, f in enumerate(frames)]
    docs = [(100 * k + j, f"It was said. {fill(f)} Nobody knew.") for k, f in enumerate(frames) for j in range(20)]
    clean = [(5000 + j, " ".join(rng.choice("what is the old to a by with far today there last week cost buy walk".split()) for _ in range(200))) for j in range(40)]
    got = set(found(spark, docs + clean, bench))
    assert len(got & {(d, d // 100) for d, _ in docs}) >= 0.9 * len(docs)
    assert all(d // 100 == i for d, i in got)


BORIS = "Boris has 48 apples. Boris buys 24 more apples at the market, where Boris also meets Dora. How many apples does Boris have now?"
THREE = [(1, QUESTION), (2, BORIS), (3, "On Monday the baker Emil Frey sold 12 kg of bread to Frieda, and on Tuesday Emil Frey sold 30 kg to her sister; how much did Emil Frey sell to Frieda?")]
PEOPLE = {1: {"Boris": "Clara"}, 2: {"Boris": "Clara", "Dora": "Ben"}, 3: {"Emil Frey": "Gustav", "Frieda": "Hanna"}}


def other(item, text, names=True):
    for a, b in PEOPLE[item].items() if names else ():
        text = text.replace(a, b)
    return re.sub("[0-9]+", lambda m: str(3 * int(m.group()) + 1), text)


def test_variants_of_copies_are_found(spark):
    name = {1: "Boris", 2: "Boris", 3: "Emil Frey"}
    variants = [
        lambda i, t: t.lower(),
        lambda i, t: t.upper(),
        lambda i, t: t.replace(f"{name[i]} ", f"{name[i]}, ", 1),
        lambda i, t: t.replace(" ", "     "),
        lambda i, t: t.replace(name[i], "Anna Maria"),
        other,
        lambda i, t: other(i, t).lower(),
        lambda i, t: other(i, t).replace(", ", " , ").upper(),
    ]
    docs = [(100 * i + k, f"They say so. {v(i, t)} And so on.") for i, t in THREE for k, v in enumerate(variants)]
    assert set(found(spark, docs, THREE)) == {(100 * i + k, i) for i, _ in THREE for k in range(len(variants))}


def test_two_names_do_not_become_one_nor_one_two(spark):
    docs = [
        (2, BORIS.replace("Boris", "Clara").replace("Dora", "Clara")),
        (3, THREE[2][1].replace("Emil Frey", "Gustav").replace("Frieda", "Gustav")),
        (4, BORIS.replace("Boris has", "Clara has").replace("Boris buys", "Ben buys").replace("Boris also", "Carl also").replace("does Boris", "does Emil")),
        (5, re.sub("apples", lambda m, n=iter("abcdef"): "fruit" + next(n), BORIS)),
    ]
    assert found(spark, docs, THREE) == {}


def test_reparameterised_questions_are_found_and_other_texts_are_not(spark):
    rng = random.Random(5)
    people = ["Ada", "Bert", "Cleo", "Dirk", "Edda", "Finn", "Gina", "Hugo", "Ines", "Jan Paul", "Kim", "Lars"]
    things = ["apples", "books", "coins", "stamps", "pears", "shells"]
    frames = [
        "{a} has {x} {t} and {y} {u}. Then {a} gives {z} {t} to {b} before the end of the day. How many {t} are left to {a}?",
        "A train leaves the town at {x} km an hour while {a} waits with {y} {t}; after {z} minutes {b} asks how far the train of {a} is from the town?",
        "In the shop of {a} one can buy {x} {t} for {y} dollars, and {b} pays {z} dollars in all. What is the change that {a} gives back to {b}?",
    ]
    fill = lambda f, t, u: f.format(a=(p := rng.sample(people, 2))[0], b=p[1], x=rng.randrange(2, 90), y=rng.randrange(2, 90), z=rng.randrange(2, 90), t=t, u=u)
    kinds = [(f, *rng.sample(things, 2)) for f in frames for _ in range(3)]
    bench = [(k, fill(*x)) for k, x in enumerate(kinds)]
    docs = [(100 * k + j, f"Once there was this. {fill(*kinds[k])} And then it ended.") for k in range(len(kinds)) for j in range(20)]
    vocabulary = sorted({w for _, t in bench for w in t.split()})
    docs += [(10_000 + j, " ".join(rng.choice(vocabulary) for _ in range(300))) for j in range(50)]
    same = {(i, j) for i, x in enumerate(kinds) for j, y in enumerate(kinds) if x == y}
    got = set(found(spark, docs, bench))
    want = {(100 * k + j, i) for k in range(len(kinds)) for j in range(20) for i in range(len(kinds)) if (k, i) in same}
    assert len(got & want) >= 0.9 * len(want) and not {d for d, _ in got if d >= 10_000}
    alike = {(100 * k + j, i) for k in range(len(kinds)) for j in range(20) for i in range(len(kinds)) if kinds[k][0] == kinds[i][0]}
    assert got <= alike


def test_a_very_long_text_is_read_whole(spark):
    filler = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(150_000))
    assert set(found(spark, [(1, f"{filler} {other(1, QUESTION)}"), (2, filler)], THREE)) == {(1, 1)}


def plain_features(text):
    """The buckets of a text's n-grams, one n-gram at a time."""
    out, chars = set(), f" {(text or '').lower()} "
    for n in toxicity.ORDERS:
        for i in range(len(chars) - n + 1):
            h = 0
            for c in chars[i : i + n]:
                h = ((h ^ ord(c)) * 0x9E3779B1) % 2**32
                h ^= h >> 15
            out.add(((h * 0x85EBCA6B) % 2**32) >> (32 - toxicity.BITS))
    return out


def test_scores_and_ratios_by_a_plain_reckoning(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    features = {i: plain_features(t) for i, t in texts.items()}
    learned = [(r.doc_id, r.toxic) for r in labels.collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5]
    held = {y: {} for y in (0, 1)}
    for i, y in learned:
        for f in features[i]:
            held[y][f] = held[y].get(f, 0) + 1
    n = {y: sum(t == y for _, t in learned) for y in (0, 1)}
    for f in list(held[0] | held[1])[:3000]:
        a, b = held[0].get(f, 0), held[1].get(f, 0)
        want = math.log((b + 1) / (n[1] + 2)) - math.log((a + 1) / (n[0] + 2)) if a + b > 1 else 0
        assert abs(model.ratio[f] - want) < 1e-9
    for r in toxicity.score(docs, model).collect():
        own = features[r.doc_id]
        length = max(1e-9, math.sqrt(sum(model.ratio[f] ** 2 for f in own)))
        z = model.bias + sum(model.ratio[f] * model.weight[f] for f in own) / length
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6 and r.predicted == (r.score >= 0.5)
