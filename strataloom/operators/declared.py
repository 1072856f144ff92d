"""Columns on the rows of strataloom.sources.syntax: annotations, fields, types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.sources.files import select_files
from strataloom.sources.syntax import declarations

CLASSES = ["class", "interface", "record"]


def types(files: DataFrame, language: str, globs: Sequence[str], words: Sequence[str] = (), kinds: Sequence[str] = CLASSES) -> DataFrame:
    """The types that the chosen files declare, with fqn: the name below its package or namespace."""
    found = declarations(select_files(files, globs, words), language).where(F.col("kind").isin(*kinds))
    return found.withColumn("fqn", F.concat_ws(".", F.nullif("space", F.lit("")), "name"))


def members(found: DataFrame, *keep: str) -> DataFrame:
    """A row for each member: rel_path, part, the kept columns and the member's, of which `notes` and `words` stand for the type's."""
    each = found.select("rel_path", "part", *keep, F.explode("members").alias("_m"))
    return each.select("rel_path", "part", *keep, "_m.*").where("words <> ''")


def note(notes: Column, *names: str) -> Column:
    """The first annotation of one of these names; null without any."""
    return F.try_element_at(F.filter(notes, lambda n: n["name"].isin(*names)), F.lit(1))


def has_note(notes: Column, *names: str) -> Column:
    return F.exists(notes, lambda n: n["name"].isin(*names))


#: Words before a field's or method's type.
MODIFIERS = r"^(?:(?:public|protected|private|internal|static|final|abstract|synchronized|default|native|transient|volatile|virtual|override|async|required|readonly|sealed|new|partial|extern|unsafe)\s+)*+(?:<[^()]*?>\s+)?"


def bare(words: Column) -> Column:
    """Without modifiers and type parameters before the type."""
    return F.regexp_replace(words, MODIFIERS, "")


def type_of(words: Column) -> Column:
    """The type of `int x`, `Map<A, List<B>> x` and `int[] x`: all before the name."""
    return F.regexp_extract(bare(words), r"^(.*?[^\s,])\s+\w+\s*(?:,\s*\w+\s*)*$", 1)


def names_of(words: Column) -> Column:
    """The names in `int a, b`: one or several."""
    return F.split(F.regexp_extract(bare(words), r"(\w+\s*(?:,\s*\w+\s*)*)$", 1), r"\s*,\s*")
