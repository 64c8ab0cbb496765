"""Markdown and frontmatter as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRONTMATTER = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"


def frontmatter_text(raw: Column) -> Column:
    return F.regexp_extract(raw, FRONTMATTER, 1)


def body(raw: Column) -> Column:
    return F.regexp_replace(raw, FRONTMATTER, "")


def flat_frontmatter(raw: Column) -> Column:
    """Map of the frontmatter's top-level keys: scalars without their quotes, lists of scalars (both forms) as `[a, b]`;
    other nested values stay text. The last of repeated keys counts."""
    flow = F.regexp_replace(frontmatter_text(raw), r"\r?\n[ \t]*-[ \t]+([^\r\n]*)", "\u0001$1")  # list items join their key's line
    lines = F.filter(F.split(flow, r"\r?\n"), lambda x: x.rlike(r"^[\p{L}\p{N}_-]+:"))
    key = lambda x: F.regexp_extract(x, r"^([^:]+):", 1)
    value = lambda x: F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1))
    shown = lambda v: F.when(F.contains(v, F.lit("\u0001")), F.concat(F.lit("["), F.array_join(F.slice(F.split(v, "\u0001"), 2, 100_000), ", "), F.lit("]"))).otherwise(F.regexp_replace(v, r"^[\"'](.*)[\"']$", "$1"))
    last = F.transform(lines, lambda x: F.struct(key(x).alias("k"), shown(value(x)).alias("v")))
    once = F.filter(last, lambda e, i: ~F.exists(F.slice(last, i + 2, F.size(last)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(once)


def list_value(scalar: Column) -> Column:
    """`[a, b]` or `a` as an array of texts without their quotes."""
    inner = F.split(F.regexp_replace(scalar, r"^\[|\]$", ""), r"\s*,\s*")
    return F.coalesce(F.filter(F.transform(inner, lambda x: F.regexp_replace(F.trim(x), r"^[\"'](.*)[\"']$", "$1")), lambda x: x != ""), F.array().cast("array<string>"))


def listed_tags(value: Column) -> Column:
    """The tags field's items; a scalar is no list and gives none."""
    return F.when(value.startswith("["), list_value(value)).otherwise(F.array().cast("array<string>"))


def title(text: Column, fallback: Column) -> Column:
    found = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    return F.coalesce(F.when(found != "", found), fallback)


def inline_tags(text: Column) -> Column:
    """#tags after white space or at the start, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(^|\s)#([a-zA-ZäöüÄÖÜß][\w/äöüÄÖÜß-]*)"), F.lit(2)), F.lower))


def wikilinks(text: Column) -> Column:
    """Link targets in order: aliases after a pipe (plain or escaped) go, targets beginning with ! are skipped."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+?)\]\]"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.trim(F.regexp_replace(x, r"(?s)\\?\|.*", ""))), lambda x: (x != "") & ~x.startswith("!"))


TASK = r"^\s*- \[([ xX])\]\s+(.+)"


def todos(text: Column) -> Column:
    """Array of (text, done, line) of the task list lines; lines count from 1."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("raw"), (i + 1).alias("line")))
    found = F.filter(lines, lambda x: F.contains(x["raw"], F.lit("- [")) & x["raw"].rlike(TASK))
    return F.transform(found, lambda x: F.struct(F.trim(F.regexp_extract(x["raw"], TASK, 2)).alias("text"), (F.regexp_extract(x["raw"], TASK, 1) != " ").alias("done"), x["line"].alias("line")))


def without_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`]+`", " ")


def word_count(text: Column) -> Column:
    plain = F.regexp_replace(without_code(text), r"(?m)^#+\s+.+$", " ")
    return F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))


def heading_count(text: Column, level: int) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?m)^({'#' * level}\s+\S)"), F.lit(1)))


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1))


def list_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[-*]\s+") | x.rlike(r"^\s*\d+\.\s+")))


def code_blocks(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?s)(```.*?```)"), F.lit(1)))


def section(text: Column, name: str) -> Column:
    """The text under a heading of any level, up to the next heading."""
    return F.trim(F.regexp_extract(text, rf"(?ms)^#+\s+\Q{name}\E\s*$\n(.*?)(?=^#+\s|\z)", 1))


def basename(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.md$", "")


def folder(path: Column) -> Column:
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", F.lit(".")).otherwise(found)
