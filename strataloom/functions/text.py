"""Column functions for names, paths and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str, with_root: bool = False) -> str:
    """A regular expression for a glob on relative paths.

    `**/x` asks for at least one folder above x, unless with_root is set; `*` stays within a folder.
    """
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out += "(?:.*/)?" if with_root else ".*/"
            i += 3
        elif glob.startswith("**", i):
            out += ".*"
            i += 2
        elif glob[i] == "*":
            out += "[^/]*"
            i += 1
        elif glob[i] == "?":
            out += "[^/]"
            i += 1
        else:
            out += re.escape(glob[i])
            i += 1
    return f"^{out}$"


def some(col: Column) -> Column:
    """null for the empty string that an unmatched group gives."""
    return F.nullif(col, F.lit(""))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    return some(F.regexp_extract(text, pattern, group))


def text_or_null(col: Column) -> Column:
    """The text `null` for null, as in keys made by joining texts."""
    return F.coalesce(col.cast("string"), F.lit("null"))


def make_id(*parts: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by bars; a null part counts as the text null."""
    joined: list[Column] = []
    for p in parts:
        joined += [F.lit("|"), text_or_null(p if isinstance(p, Column) else F.lit(p))]
    return F.substring(F.sha2(F.concat(*joined[1:]), 256), 1, 16)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def folder_name(path: Column) -> Column:
    """The name of the folder that holds the file; empty at the root."""
    return F.coalesce(first(path, r"([^/]+)/[^/]+$"), F.lit(""))


def snake_case(col: Column) -> Column:
    """OrderItem -> order_item, HTTPServer -> http_server."""
    split = F.regexp_replace(F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2")
    return F.lower(split)


def pascal_case(col: Column) -> Column:
    """order-created -> OrderCreated."""
    parts = F.filter(F.split(col, "[-_]"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def capitalised(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substr(col, F.lit(2)))


def plural(col: Column) -> Column:
    return (
        F.when(col.rlike("[^aeiou]y$"), F.regexp_replace(col, "y$", "ies"))
        .when(col.rlike("(s|x|ch|sh)$"), F.concat(col, F.lit("es")))
        .otherwise(F.concat(col, F.lit("s")))
    )


def join_paths(base: Column, path: Column) -> Column:
    """The two with one slash between them, one at the front and none at the end; "/" if both are empty."""
    whole = F.concat(F.lit("/"), F.coalesce(base, F.lit("")), F.lit("/"), F.coalesce(path, F.lit("")))
    bare = F.regexp_replace(F.regexp_replace(whole, "/+", "/"), "(.)/$", "$1")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def method_path(base: Column, path: Column) -> Column:
    """A method's path below a controller's: the base as it is where the method has none, and nothing put before it."""
    return (
        F.when(F.coalesce(base, F.lit("")) == "", F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), F.coalesce(path, F.lit("")))))
        .when(F.coalesce(path, F.lit("")) == "", base)
        .otherwise(F.concat(F.regexp_replace(base, "/$", ""), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))
    )


def resource_path(base: Column, path: Column) -> Column:
    """As method_path, but "/" where both are empty."""
    return F.when((F.coalesce(base, F.lit("")) == "") & (F.coalesce(path, F.lit("")) == ""), F.lit("/")).otherwise(method_path(base, path))


def group_path(prefix: Column, path: Column) -> Column:
    """A route below the prefix of its group; the route as it is without a prefix."""
    return F.when(F.coalesce(prefix, F.lit("")) == "", path).otherwise(join_paths(prefix, path))


def template_path(base: Column, path: Column) -> Column:
    """An action's template below a controller's; one that begins with a slash or tilde stands for itself."""
    return F.when(path.rlike("^[/~]"), F.regexp_replace(path, "^~", "")).otherwise(join_paths(base, path))


def first_per_line(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match of each line that has one, in order."""
    return F.array_compact(F.transform(F.split(text, "\r?\n", -1), lambda x: first(x, pattern, group)))


def unquoted(col: Column) -> Column:
    """Without blanks and one pair of quotes around it."""
    return F.regexp_replace(F.trim(col), r"^(['\"`])(.*)\1$", "$2")


def is_comment(line: Column) -> Column:
    return F.ltrim(line).rlike(r"^(//|#|--|/\*|\*)")


def part_of(text: Column, start: int, stop: int) -> Column:
    """The characters from start, counted from 0, to before stop; as many as there are."""
    return F.coalesce(F.substring(text, max(0, start) + 1, max(0, stop - max(0, start))), F.lit(""))


def extension(path: Column) -> Column:
    """In small letters, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def xml_attribute(text: Column, name: str) -> Column:
    """The attribute of a tag's text, null without it."""
    return first(text, rf"\b{re.escape(name)}\s*=\s*[\"']([^\"']*)[\"']")


def json_text(text: Column, path: str) -> Column:
    """The value at a path of JSON text; null where the text is no JSON or has no such value."""
    return F.get_json_object(text, path)


def json_list(text: Column) -> Column:
    """A JSON array as its elements' texts, anything else as an array of one, null as none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))


def coverage_text(found: Column, expected: Column, percent: Column) -> Column:
    return F.format_string("%d/%d (%.0f%%)", found.cast("long"), expected.cast("long"), percent.cast("double"))


def base_path(path: Column) -> Column:
    """The path without `{x}` and `:x` segments and without a slash at the end."""
    bare = F.regexp_replace(F.regexp_replace(path, r"/\{[^}]+\}", ""), "/:[^/]+", "")
    bare = F.regexp_replace(bare, "(.)/$", "$1")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def resource_name(base: Column) -> Column:
    """The last segment that is no version and not `api`, without a final s, capitalised; `Resource` if none."""
    segments = F.filter(F.split(base, "/"), lambda s: (F.trim(s) != "") & ~s.rlike(r"^v\d+$") & (s != "api"))
    last = F.trim(F.try_element_at(segments, F.lit(-1)))
    return F.coalesce(capitalised(F.regexp_replace(last, "(.)s$", "$1")), F.lit("Resource"))


def node_id(col: Column) -> Column:
    """A name fit for diagram nodes."""
    return F.regexp_replace(col, "[^a-zA-Z0-9_]", "_")


def markdown_cell(col: Column) -> Column:
    return F.coalesce(F.replace(col, F.lit("|"), F.lit("\\|")), F.lit("-"))


def one_of(col: Column, pairs: list[tuple[str, str]], other: Column) -> Column:
    """The value of the first pair whose key the column contains; the order of the pairs decides."""
    out = other
    for key, value in reversed(pairs):
        out = F.when(col.contains(key), F.lit(value)).otherwise(out)
    return out
