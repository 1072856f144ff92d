"""Quality rules in DataFrame functions only, as a short-circuit cascade.

Each rule's cost, the CPU time of tasks that evaluate it, and the share of documents it rejects are measured on a sample;
rules run in the order of rejection per cost, each only on documents that those before it let pass, and with it what it
has to work out from the text. The order changes the work, never the verdict.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import LOWER, SPACES, UPPER, strip_spaces, words, written

#: Rows, on average, of the sample on which rules are measured; times that each is evaluated in a run; runs.
SAMPLE_ROWS, TIMES, RUNS = 1500, 4, 3
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count(text: Column, chars: str) -> Column:
    """How many of the text's characters are among chars."""
    return (F.length(text) - F.length(_without(text, chars))).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(grams: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sorts (hash, place), keeps equal neighbours, adds up cover."""

    def neighbours(xs: Column, f) -> Column:
        n = F.size(xs) - 1
        return F.zip_with(F.slice(xs, F.lit(1), n), F.slice(xs, F.lit(2), n), f)

    def cover(at: Column) -> Column:
        overlap = neighbours(at, lambda a, b: F.greatest(F.lit(0), WINDOW - (b - a)))
        return (WINDOW * F.size(at)).cast("long") - F.aggregate(overlap, F.lit(0).cast("long"), lambda s, x: s + x)

    def places(xs: Column) -> Column:
        pairs = neighbours(xs, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = _let(_let(ordered, places), cover)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(found)


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds to df: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long, of the whole text.

    Words are the runs of `[^\\x20\\x09-\\x0D]+`; null and blank texts have none and 0 throughout (n_symbols: 0 too).
    Very long texts are measured whole. df has no columns of these names, nor `_words`, `_lines` or `_grams`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: strip_spaces(x) != "")
    first = df.withColumns({"_words": words(F.col(text_col)), "_lines": lines})
    n = F.size("_words")
    grams = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (WINDOW - 1))), lambda i: F.xxhash64(F.slice(F.col("_words"), i, F.lit(WINDOW))))
    )
    second = first.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(_without(text, SPACES)).cast("long"),
            "n_symbols": _count(text, SYMBOLS),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_grams": grams,
        }
    )
    return second.withColumn("n_repeat_words", _repeated(F.col("_grams"))).drop("_words", "_lines", "_grams")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """fails: true on documents that the rule rejects; null counts as passed."""

    name: str
    fails: Column


def default_rules(text_col: str = "text") -> list[Rule]:
    """Two rules on the base measures and five that work out their own from the text, each within its own condition."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    all_lines = F.filter(F.split(text, "\n", -1), lambda x: strip_spaces(x) != "")
    share = lambda xs, test, percent: _let(xs, lambda ys: 100 * F.size(F.filter(ys, test)) > percent * F.size(ys))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("word length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words"))),
        Rule("duplicate lines", 10 * F.col("n_dup_lines") > 3 * F.size(F.split(text, "\n", -1))),
        Rule("upper case", _count(text, UPPER) > _count(text, LOWER)),
        Rule("few words with letters", share(words(F.col(text_col)), lambda w: ~w.rlike(r"\p{L}"), 50)),
        Rule("bullets", share(all_lines, lambda x: strip_spaces(x).rlike(r"^[-*\u2022]"), 90)),
        Rule("cut lines", share(all_lines, lambda x: strip_spaces(x).rlike(r"(\.\.\.|\u2026)$"), 30)),
    ]


def task_seconds(spark: SparkSession, action) -> float:
    """CPU seconds of the tasks that the action's jobs ran, by Spark's own count: neither launch nor idle time is in it."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
    sc.setJobGroup(group, "quality rule")
    try:
        action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before[0])
        sc.setLocalProperty("spark.job.description", before[1])
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker, total = sc._jsc.sc().statusStore(), sc.statusTracker(), 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            total += store.lastStageAttempt(stage).executorCpuTime()
    return total / 1e9


def order_rules(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """The rules by falling rejection per CPU second on the sample; ties and an empty sample keep the given order.

    A rule is evaluated TIMES on each row, in RUNS runs, of which the median counts; the runs' other work, measured by
    itself, is taken off.
    """
    spark = sample.sparkSession
    often = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))
    seen: dict[int, int] = {}

    def run(k: int, fails: Column) -> float:
        def action() -> None:
            r = often.agg(F.count("*").alias("n"), F.count_if(fails).alias("failed")).first()
            seen[k] = (r.failed or 0) / max(1, r.n)

        return task_seconds(spark, action)

    cost = lambda k, fails: median(run(k, fails) for _ in range(RUNS))
    idle = cost(-1, F.col("_time") < 0)
    rated = [(-seen[k] / c, k) for k, rule in enumerate(rules) for c in [max(1e-4, cost(k, rule.fails) - idle)]]
    return [rules[k] for _, k in sorted(rated)]


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def judge(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Adds to df the measures, base_failed, rejected_by (of the rules after the base; null if none) and kept.

    kept is false where the base fails or a rule rejects. Null and blank texts have no words and so fail the base; very
    long texts are judged whole. Each row is judged by itself: repeated rows and null ids alike. An empty table gives
    none. Columns of df whose names clash with those added are replaced; other names may be any, as rows travel in a
    struct. Nothing is shuffled; the sample (sample_rows on average) only sets the order of the rules. Rules see the
    text, by its name, and the measures.
    """
    rules = default_rules(text_col) if rules is None else list(rules)
    others = [c for c in df.columns if c not in ADDED or c == text_col]
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"), F.col(f"`{text_col}`").alias(text_col))
    rows = own.count()
    if rows and len(rules) > 1:
        drawn = own.select(text_col).sample(fraction=min(1.0, sample_rows / rows), seed=11)
        rules = order_rules(written(measures(drawn, text_col), "quality-sample"), rules)
    judged = measures(own, text_col).withColumn("base_failed", base_failed())
    judged = judged.withColumn("rejected_by", F.when(~F.col("base_failed"), cascade(rules)))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
    # A generator between the verdict and what uses it: a filter on the verdict, pushed below, would be written out with
    # every measure in full wherever it occurs, which the optimizer does not end with in reasonable time.
    flat = judged.select("_row", F.inline(F.array(F.struct(*ADDED))))
    return flat.select(*(F.col("_row").getField(c).alias(c) for c in others), *ADDED)


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept"]

ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM places),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
measured AS (
  SELECT b.doc_id, text, w, l, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         len(string_split(text, chr(10))) AS n_lines
  FROM base b LEFT JOIN cover c ON b.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
           OR word_chars < 2 * n_words OR word_chars > 14 * n_words
           OR length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^a-z]', '', 'g'))
           OR 100 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) > 50 * len(w)
           OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 90 * len(l)
           OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 30 * len(l) AS rejected
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged
"""
