"""Source trees as a table of files, and matches of patterns in them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.text import glob_regex, some


def read_files(spark: SparkSession, root: str, most_bytes: int | None = None) -> DataFrame:
    """(rel_path, content) of all files below root, read once for all scanners; larger files are left out unread.

    Bytes that are no UTF-8 become U+FFFD, by which staged() knows such files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if most_bytes is not None:
        raw = raw.where(F.col("length") <= most_bytes)
    base = root.rstrip("/") + "/"
    rel = F.element_at(F.split(F.col("path"), F.lit(rf"\Q{base.split('://')[-1]}\E"), 2), -1)
    return raw.select(rel.alias("rel_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """(rel_path, line_no, line), numbered from 0."""
    return files.select("rel_path", F.posexplode(F.split("content", "\r?\n", -1)).alias("line_no", "line"))


def in_globs(globs: Sequence[str], with_root: bool = False) -> Column:
    return F.col("rel_path").rlike("|".join(glob_regex(g, with_root) for g in globs))


def holding(words: Sequence[str]) -> Column:
    """Whether the content holds one of the words: a cheap test before any pattern is tried."""
    out = F.lit(False)
    for w in words:
        out = out | F.col("content").contains(w)
    return out


def select_files(files: DataFrame, globs: Sequence[str], words: Sequence[str] = ()) -> DataFrame:
    chosen = files.where(in_globs(globs))
    return chosen.where(holding(words)) if words else chosen


#: By language: texts, which may hold what looks like a comment, and comments.
_LEXIS = {
    "java": (r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'', r"//[^\n]*+|(?s:/\*.*?\*/)"),
    "csharp": (r'@"(?:[^"]|"")*+"|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'', r"//[^\n]*+|(?s:/\*.*?\*/)"),
    "go": (r'`[^`]*+`|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'', r"//[^\n]*+|(?s:/\*.*?\*/)"),
    # a regular expression in slashes goes like a comment: what it holds is neither a text nor code
    "javascript": (
        r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|`(?:[^`\\]|\\(?s:.))*+`',
        r"//[^\n]*+|(?s:/\*.*?\*/)|(?<=[(,=:\[!&|?{};]\s{0,9})/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/",
    ),
    "python": (r'(?s:""".*?"""|\'\'\'.*?\'\'\')|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'', r"#[^\n]*+"),
}


def without_comments(text: Column, language: str) -> Column:
    """A source text without its comments; texts in quotes stay as they are."""
    texts, comments = _LEXIS[language]
    return F.regexp_replace(text, f"({texts})|{comments}", "$1")


def unbalanced(text: Column, language: str) -> Column:
    """Whether a source text has more or fewer closing brackets than opening ones, texts and comments aside."""
    texts, comments = _LEXIS[language]
    bare = F.regexp_replace(text, f"{texts}|{comments}", "")
    count = lambda c: F.length(F.replace(bare, F.lit(c), F.lit("")))
    return (count("(") != count(")")) | (count("[") != count("]")) | (count("{") != count("}"))


def one_pass(words: Sequence[str]) -> str:
    """A pattern whose matches, at any place, are the longest of the words that begin there: a tree of their letters."""

    def tree(rest: Sequence[str]) -> str:
        by: dict[str, list[str]] = {}
        for w in sorted(set(rest)):
            by.setdefault(w[:1], []).append(w[1:])
        ends = "" in by
        parts = [re.escape(c) + tree(own) for c, own in by.items() if c]
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)})" + "?" * ends

    return f"(?=({tree(words)}))"


def code_files(files: DataFrame, globs: Sequence[str], words: Sequence[str] = (), language: str = "java") -> DataFrame:
    """The chosen files, without their comments."""
    return select_files(files, globs, words).withColumn("content", without_comments(F.col("content"), language))


def matches(df: DataFrame, pattern: str, names: Sequence[str], text: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """A row for each match of the pattern in the text column: rel_path, pos, the kept columns and the groups by name.

    A group without a match is null. The text itself does not go along with its matches.
    """
    found = df.select("rel_path", *keep, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "_m"))
    groups = [some(F.regexp_extract("_m", pattern, k + 1)).alias(n) for k, n in enumerate(names)]
    return found.select("rel_path", "pos", *keep, *groups)


def in_order(parts: Sequence[DataFrame]) -> DataFrame:
    """The matches of several patterns together; places go on from pattern to pattern, within each file."""
    each = [df.withColumn("_kind", F.lit(k)) for k, df in enumerate(parts)]
    both = reduce(DataFrame.unionByName, each)
    order = Window.partitionBy("rel_path").orderBy("_kind", "pos")
    return both.withColumn("pos", F.row_number().over(order) - 1).drop("_kind")
