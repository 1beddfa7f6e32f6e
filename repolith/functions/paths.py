"""Paths, globs, languages and counts of files as column functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolith.rules import tables


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for whole texts: ``*`` crosses ``/``, ``?`` is one character."""
    out = []
    for part in re.split(r"(\*+|\?|\[[^\]]+\])", glob):
        out.append("(?s:.*)" if part.startswith("*") else "(?s:.)" if part == "?" else part.replace("[!", "[^") if part.startswith("[") else re.escape(part))
    return "^" + "".join(out) + "$"


def matches(c: Column, globs: list[str]) -> Column:
    """Whether one of the globs matches the whole text."""
    return c.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """The last extension in lower case; names without one, and those that only start with a dot, have ''."""
    return F.lower(F.regexp_extract(base_name(name), r"^(?s:.+)\.([^.]*)$", 1))


def module_of(path: Column) -> Column:
    """The first folder, or ``(root)``."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("(root)")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def code_language(ext: Column) -> Column:
    return _lookup(tables.CODE, ext)


def data_kind(ext: Column) -> Column:
    return _lookup(tables.DATA, ext)


def _starts_with_any(names: list[str]):
    return lambda w: reduce(lambda a, b: a | b, [w.startswith(n) for n in names])


def shebang_language(line: Column) -> Column:
    """Language of an interpreter line: the first rule of which a word's last part is, or starts with, a token."""
    words = F.transform(F.split(F.trim(F.regexp_replace(line, "^#!", "")), r"\s+"), lambda w: F.substring_index(w, "/", -1))
    c = F.lit(None).cast("string")
    for lang, names in reversed(tables.SHEBANGS):
        hit = F.exists(words, _starts_with_any(names))
        c = F.when(line.startswith("#!") & hit, lang).otherwise(c)
    return c


def is_test(path: Column) -> Column:
    return path.rlike("^tests?/") | F.contains(path, F.lit("/tests/")) | matches(base_name(path), tables.TEST_FILES)


def is_ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """Whether a path lies in a folder that is left out, or is a file that is."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    ignored = F.exists(folders, lambda f: f.isin(tables.IGNORED_DIRS)) | matches(base_name(path), tables.IGNORED_FILES) | matches(path, tables.IGNORED_FILES)
    for p in patterns or []:
        if p.endswith("/"):
            q = p.rstrip("/")
            ignored = ignored | (path == q) | F.startswith(path, F.lit(q + "/")) | F.array_contains(folders, q)
        else:
            ignored = ignored | matches(path, [p]) | matches(base_name(path), [p]) | F.startswith(path, F.lit(p + "/"))
    return ignored


def count_lines(text: Column) -> Column:
    """Lines of a text; an unterminated last line counts, empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


def max_indent(text: Column, enough: int = tables.DEEP_INDENT) -> Column:
    """The first indentation of at least ``enough``, else the greatest; a tab is four blanks, blank lines have none."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.length(F.trim(F.replace(x, F.lit("\t"), F.lit("")))) > 0)
    lead = F.transform(lines, lambda x: F.regexp_extract(x, "^([ \t]*)", 1))
    width = F.transform(lead, lambda x: F.length(F.replace(x, F.lit("\t"), F.lit("    "))))
    return F.coalesce(F.get(F.filter(width, lambda w: w >= enough), F.lit(0)), F.array_max(width), F.lit(0))


def node_type(name: Column, file: Column) -> Column:
    """Layer of a node by the first rule whose word its name or file holds."""
    text = F.lower(F.concat_ws(" ", name, file))
    c = F.lit("OTHER")
    for kind, words in reversed(tables.NODE_TYPES):
        c = F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), kind).otherwise(c)
    return c


def numeric_version(raw: Column) -> Column:
    """The first run of numbers and dots; null for none, and for addresses."""
    text = F.trim(raw)
    found = F.regexp_extract(text, r"[0-9]+(?:\.[0-9]+)*", 0)
    return F.when(~text.rlike("^(git\\+|github:|file:|http:|https:)") & (found != ""), found)
