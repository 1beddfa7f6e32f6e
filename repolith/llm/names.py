"""Variant spellings of names: parsing, and a join within an edit distance.

``name_pairs`` is the join: names are cut into k + 1 segments, of which two
names within k edits share one at a nearly equal place; substrings at shifted
places look the segments up in an index, and a banded edit distance verifies.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Titles, legal forms, words of organisations' names, mailboxes of roles.
TITLES = {"dr", "mr", "mrs", "ms", "prof", "sir", "madam", "jr", "sr", "ii", "iii", "iv", "phd", "md"}
LEGAL = {"the", "inc", "incorporated", "ltd", "limited", "llc", "gmbh", "ag", "corp", "corporation", "co", "company", "plc", "team"}
ORGANISATION = {
    "systems", "labs", "lab", "foundation", "collective", "works", "software", "technologies", "technology", "solutions", "group", "studio", "studios", "project",
    "university", "institute", "association", "community", "consulting", "networks", "media", "partners", "ventures", "bot",
}
ROLES = {
    "oss", "dev", "hello", "ops", "info", "contact", "admin", "support", "team", "office", "mail", "noreply", "root", "webmaster", "security", "help", "hr", "press",
    "sales", "git",
}
# Common short forms of English given names; others are learned from the rows (``link.learned``).
SHORT_FORMS = {
    "alexander": ["alex", "sasha", "xander", "sandy", "alec"],
    "andrew": ["drew"],
    "anthony": ["tony"],
    "benjamin": ["ben", "benji", "benny"],
    "charles": ["charlie", "chuck"],
    "christopher": ["chris", "topher", "kit"],
    "daniel": ["dan", "danny"],
    "david": ["dave"],
    "edward": ["ed", "eddie", "ned"],
    "elizabeth": ["liz", "beth", "lizzie", "betty", "eliza", "libby"],
    "gregory": ["greg", "gregg"],
    "james": ["jim", "jimmy", "jamie"],
    "jennifer": ["jen", "jenny", "jenn"],
    "john": ["johnny", "jack"],
    "joseph": ["joe", "joey"],
    "joshua": ["josh"],
    "katherine": ["kate", "kathy", "kat", "katie", "kathryn", "kay"],
    "margaret": ["peggy", "maggie", "meg", "marge"],
    "matthew": ["matt", "matty"],
    "michael": ["mike", "mick", "mikey", "mickey"],
    "nicholas": ["nick", "nicky"],
    "patricia": ["pat", "patty", "trish"],
    "rebecca": ["becky", "becca"],
    "richard": ["rick", "dick", "rich"],
    "robert": ["bob", "bobby", "rob", "robbie"],
    "samuel": ["sam", "sammy"],
    "stephen": ["steve"],
    "theodore": ["theo", "ted", "teddy"],
    "thomas": ["tom", "tommy"],
    "timothy": ["tim", "timmy"],
    "victoria": ["vicky", "vicki"],
    "william": ["will", "bill", "billy", "willy"],
}
LONG_FORM = {s: name for name, shorts in SHORT_FORMS.items() for s in shorts}


def fold(text: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def parse_name(name: str | None) -> tuple[str | None, str | None, str | None, str, bool]:
    """(first, last, single, initials, organisation) of a name as typed.

    ``first`` and ``last`` are the outer full words, with short forms made long;
    ``single`` is the only full word where there is one.  Titles, legal forms,
    what stands in brackets and middle names don't count.
    """
    text = re.sub(r"\([^)]*\)", " ", name or "")
    text = re.sub(r"\[[^\]]*\]", lambda m: " bot " if "bot" in m.group(0).lower() else " ", text).strip()
    if " " not in text and "," not in text:
        text = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])", " ", text)
        text = re.sub(r"[._\-]+", " ", text)
    text = fold(text)
    if text.count(",") == 1:
        before, after = text.split(",")
        if not set(re.findall(r"\w+", after)) <= LEGAL | TITLES:
            text = f"{after} {before}"
    words = [w for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", text) if w not in TITLES]
    core = [w for w in words if w not in LEGAL]
    if any(w in ORGANISATION for w in core) and len(core) > 1:
        return "".join(core[:-1]), core[-1], None, "", True
    full = [LONG_FORM.get(w, w) for w in words if len(w) > 1]
    initials = "".join(w for w in words if len(w) == 1)
    if len(full) > 1:
        return full[0], full[-1], None, initials, False
    return None, None, full[0] if full else None, initials, False


def parse_address(email: str | None) -> str | None:
    """What of an address names its owner: the local part without tag, number and separators.

    For a mailbox of a role, numbered or not, it is the first word of the domain, after ``@``.
    """
    if not email or "@" not in email:
        return None
    local, _, domain = fold(email.strip()).rpartition("@")
    local = re.sub(r"^[0-9]+\+", "", local).split("+")[0]
    if re.sub(r"[\W_0-9]+$", "", local) in ROLES:
        return "@" + re.split(r"[.\-]", domain)[0]
    return re.sub(r"[^a-z0-9]+", "", local) or None


PARSED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("first", "last", "single", "initials")]
    + [T.StructField("organisation", T.BooleanType()), T.StructField("handle", T.StringType())]
)


def parsed(df: DataFrame, key: str, name: str, email: str) -> DataFrame:
    """(id, first, last, single, initials, organisation, handle) of every row."""
    read = df.select(F.col(key).alias("id"), F.make_valid_utf8(name).alias("n"), F.make_valid_utf8(email).alias("e"))
    schema = T.StructType([T.StructField("id", read.schema["id"].dataType), *PARSED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*parse_name(n), parse_address(e)) for n, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

    return read.mapInArrow(run, schema)


def edits_allowed(n: int) -> int:
    """Edits within which names of n characters (the shorter one) count as variants."""
    return 2 if n >= 5 else 1 if n >= 4 else 0


def cut(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 segments of a string of n characters, the longer ones last."""
    base, longer = divmod(n, k + 1)
    lengths = [base + (i > k - longer) for i in range(k + 1)]
    return [(sum(lengths[:i]), x) for i, x in enumerate(lengths)]


def index_segments(name: str) -> Iterator[tuple[int, int, str]]:
    """(length, segment, text) under which a name can be found."""
    n = len(name)
    for i, (start, size) in enumerate(cut(n, edits_allowed(n))):
        yield n, i, name[start : start + size]


def probe_segments(name: str) -> Iterator[tuple[int, int, str]]:
    """What a name looks up to find names that are not longer: substrings at places shifted by no more than the edits left."""
    n = len(name)
    for length in range(max(1, n - 2), n + 1):
        k = edits_allowed(length)
        if n - length > k:
            continue
        gap = n - length
        for i, (start, size) in enumerate(cut(length, k)):
            # from the left at most i edits lie before the segment, from the right at most k - i after it
            low = max(0, start - i, start + gap - (k - i))
            high = min(n - size, start + i, start + gap + (k - i))
            for text in {name[p : p + size] for p in range(low, high + 1)}:
                yield length, i, text


def name_pairs(df: DataFrame, block: str, name: str) -> DataFrame:
    """(block, a, b, distance): distinct names a < b of a block within the edits allowed.

    Blocks and names that are null or empty have no pairs.  Only distinct
    (block, name) are joined, so frequent names cost no more than rare ones; a
    segment shared by many names of a block is joined in several tasks by
    adaptive execution, and only pairs within the edits leave these tasks.
    """
    distinct = df.select(F.col(block).alias("block"), F.col(name).alias("name")).filter("block is not null and name != ''").distinct()
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("name", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("text", T.StringType())])

    def emit(segments) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            for b in batches:
                rows = [(k, n, *s) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in segments(n)]
                for i in range(0, len(rows), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 50_000]), kinds)], names=schema.names)

        return distinct.mapInArrow(run, schema)

    longer, shorter = emit(probe_segments).withColumnRenamed("name", "x"), emit(index_segments).withColumnRenamed("name", "y")
    least = F.length("y")
    allowed = F.when(least >= 5, 2).when(least >= 4, 1).otherwise(0)
    return (
        longer.join(shorter, ["block", "length", "segment", "text"])
        .filter("x != y")
        .select("block", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.levenshtein("x", "y", 2).alias("distance"), allowed.alias("k"))
        .filter("distance >= 0 and distance <= k")
        .select("block", "a", "b", "distance")
        .distinct()
    )


def derived(letters: Column, a: Column, b: Column) -> Column:
    """Whether a handle is made of one of the words and a beginning (one letter at least) of the other."""

    def made(whole: Column, part: Column) -> Column:
        rest = F.length(letters) > F.length(whole)
        tail = F.substring(letters, F.length(whole) + 1, F.lit(1 << 20))
        head = F.substring(letters, F.lit(1), F.length(letters) - F.length(whole))
        return rest & ((F.startswith(letters, whole) & F.startswith(part, tail)) | (F.endswith(letters, whole) & F.startswith(part, head)))

    return F.coalesce((F.length(a) > 1) & (F.length(b) > 1) & (made(a, b) | made(b, a)), F.lit(False))


def handles_of(a: Column, b: Column) -> Column:
    """All handles derived from a name."""

    def made(whole: Column, part: Column) -> list[Column]:
        parts = F.transform(F.sequence(F.lit(1), F.length(part)), lambda n: F.substring(part, F.lit(1), n))
        return [F.transform(parts, lambda p: F.concat(whole, p)), F.transform(parts, lambda p: F.concat(p, whole))]

    return F.array_distinct(F.concat(*made(a, b), *made(b, a)))


def any_of(*conditions: Column) -> Column:
    return F.coalesce(reduce(lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)), conditions), F.lit(False))
