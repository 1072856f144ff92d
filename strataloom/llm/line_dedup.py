"""Line deduplication in DataFrame functions only.

Every line becomes (hash of its key, document, position), once, in a table. The hashes are dealt to ranges; a hash of very
many lines, as a sample shows, has ranges of its own, cut by document. Ranges are sorted by hash, document and position,
so the documents of a line are counted as its first occurrences stream by, and the line's places are marked on the spot.
Only hashes with several ranges need totals over them, a row for each: these are as few as the ranges and are broadcast.
What comes back for a document is no text but a bitmap: 64-bit words with a bit for each dropped line, words without any
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.llm.common import ascii_lower, row_key, strip_spaces, written

RK = ["_rk_id", "_rk_text"]
HASH = ["_h1", "_h2"]
#: Lines of a range, on average, where there are many; ranges for each shuffle partition, at least; lines that are drawn
#: for each range to find the hashes that fill half a range or more.
RANGE_LINES, RANGES, DRAWN = 500_000, 4, 40


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def n_lines(text: Column) -> Column:
    bare = F.coalesce(text, F.lit(""))
    return (F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _lines(df: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(_rk_id, _rk_text, _pos, _h1, _h2): 128 bits of hash stand for the key, so chance agreement can be ruled out."""
    keyed = df.select(*row_key(id_col, text_col), F.posexplode(lines_of(F.col(text_col))).alias("_pos", "_line"))
    keyed = keyed.select(*RK, "_pos", ascii_lower(strip_spaces(F.col("_line"))).alias("_key"))
    keyed = keyed.where(F.length("_key") >= max(1, least_chars))
    return keyed.select(*RK, "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("_h2"))


def _ranges(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines by ranges `_r` of hash and, for hashes of very many lines, document; and the latter's totals.

    Totals (_h1, _h2, _all_docs, _all_first) has a row for each hash that has several ranges: fewer than there are ranges.
    """
    spark = lines.sparkSession
    n = lines.count()
    ranges = max(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_LINES)
    drawn = lines.sample(fraction=min(1.0, DRAWN * ranges / max(1, n)), seed=7)
    share = DRAWN / 2 if n > DRAWN * ranges else max(2.0, n / ranges)  # of the lines drawn, half a range's
    heavy = drawn.groupBy("_h1").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list("_rk_id")).alias("_ids")).where(F.col("_n") >= share)
    heavy = heavy.select("_h1", F.transform(F.sequence(F.lit(share).cast("int"), F.col("_n").cast("int"), F.lit(share).cast("int")), lambda k: F.element_at("_ids", k)).alias("_cuts"))
    found = spark.createDataFrame([(r._h1, r._cuts, ranges * (k + 1)) for k, r in enumerate(heavy.collect())], "_h1 long, _cuts array<long>, _base long")
    even = F.floor((F.col("_h1") / F.lit(2.0**64) + 0.5) * ranges)
    of_heavy = F.col("_base") + F.size(F.filter("_cuts", lambda c: c <= F.col("_rk_id")))
    ranged = lines.join(F.broadcast(found), "_h1", "left").withColumn("_r", F.coalesce(of_heavy, even)).drop("_cuts", "_base")
    several = lines.join(F.broadcast(found.select("_h1")), "_h1", "left_semi")
    firsts = several.groupBy(*HASH, *RK).agg(F.min("_pos").alias("_pos"))
    totals = firsts.groupBy(*HASH).agg(F.count("*").alias("_all_docs"), F.min(F.struct(*RK, "_pos")).alias("_all_first"))
    return ranged.repartitionByRange("_r"), totals


def line_bitmaps(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, least_chars: int = 1, keep: str = "none"
) -> DataFrame:
    """(_rk_id, _rk_text, _bits map<int, long>, n_dropped) of the documents that lose lines.

    A line's key is the line without the white space `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. Keys of at
    least `least_chars` code points (1 at least: blank lines are never dropped) in at least `least_docs` documents lose
    their lines: all of them with keep="none", all but the first by document and position with keep="first". Rows
    that agree in id and text are one document; null ids count as the smallest id.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    lines = written(_lines(df, id_col, text_col, least_chars), "lines")
    ranged, totals = _ranges(lines)
    own = Window.partitionBy("_r", *HASH)
    before = F.lag(F.struct(*RK)).over(own.orderBy(*RK, "_pos"))
    streamed = ranged.withColumn("_new", F.when(before == F.struct(*RK), 0).otherwise(1))
    streamed = streamed.withColumn("_docs", F.sum("_new").over(own))
    if keep == "first":
        streamed = streamed.withColumn("_first", F.min(F.struct(*RK, "_pos")).over(own))
    marks = streamed.join(F.broadcast(totals), HASH, "left").where(F.coalesce("_all_docs", "_docs") >= least_docs)
    if keep == "first":
        marks = marks.where(F.struct(*RK, "_pos") != F.coalesce("_all_first", "_first"))
    by_word = marks.groupBy(*RK, F.shiftright("_pos", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_pos").bitwiseAND(F.lit(63)))).alias("_set"))
    return by_word.groupBy(*RK).agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_set"))).alias("_bits"),
        F.sum(F.bit_count("_set").cast("long")).alias("n_dropped"),
    )


def kept_text(text: Column, bits: Column) -> Column:
    """The lines of the text whose bit is not set, joined by line feeds; the text as it is where bits is null."""
    word = lambda i: F.coalesce(F.try_element_at(bits, F.shiftright(i, 6)), F.lit(0).cast("long"))
    stay = F.filter(lines_of(text), lambda _, i: F.getbit(word(i), i.bitwiseAND(F.lit(63))) == 0)
    return F.when(bits.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(stay, "\n"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The rows of df as they are, with their text in place of the old one, n_lines and n_dropped in struct `_lines`.

    Takes the rules of line_bitmaps(). A null text is one empty line and stays null. Repeated rows lose the same
    lines. An empty table gives none. Other columns, whatever their names, pass through in struct `_row`.
    """
    bitmaps = line_bitmaps(df, id_col, text_col, **rules)
    rows = df.select(*row_key(id_col, text_col), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    joined = rows.join(bitmaps, RK, "left")
    text = F.col("_row").getField(text_col)
    return joined.select(
        "_row",
        F.struct(
            F.when(text.isNotNull(), kept_text(text, F.col("_bits"))).alias("text"),
            n_lines(text).alias("n_lines"),
            F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        ).alias("_lines"),
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT *, key IN (SELECT key FROM frequent) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
