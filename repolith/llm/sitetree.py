"""Clean text by a site style tree.

The pages of one host are merged into one tree.  An element of the tree stands
for the same place in the pages: its path of tags, and the order of tags around
it.  Where pages present a place in many ways, or where their words differ, it
is important; where all look and read alike it is boilerplate.  Importance is
one minus the normalised entropy of words over pages for content, and the
entropy of presentation styles for the rest, put together from the leaves up
through all levels of nesting.
Branches of low importance are removed from each page.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from repolith.llm.encode import chunks, text_of
from repolith.llm.markup import Block, flow, parse
from repolith.storage import materialize

#: How much weaker the children's importance counts with each further style of an element.
GAMMA = 0.9
#: Leaves of at most this importance are removed, where at least MIN_PAGES pages show the place.
THRESHOLD = 0.2
MIN_PAGES = 5

WORD = re.compile(r"\w+")
#: Leaves that stand on consecutive lines.
TIGHT = ["li", "text", "td"]


@lru_cache(1 << 16)
def _path(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big", signed=True)


ROOT = _path("doc")


def _runs(tags: list[str]) -> tuple[list[str], list[int]]:
    """A sequence of tags with repeats taken together, and the place of each tag in it."""
    seq, at = [], []
    for t in tags:
        if not seq or seq[-1] != t:
            seq.append(t)
        at.append(len(seq) - 1)
    return seq, at


@dataclass
class _Place:
    """An element of the page that is open: its style, and how far its children are read."""

    style: int
    places: list[int]
    ancestors: list[int]
    next: int = 0


def page_leaves(text: str) -> list[list]:
    """Rows of one page, as ``LEAF`` from ``pos`` on.

    An element is named by its path from the root: by the styles and places of
    all elements around it.  Its style is the order of the tags in it, repeated
    neighbours taken together.  ``leaf`` is the leaf's element, ``around`` the
    style that it stands in, ``ancestors`` the elements around it, the root
    first.  The arrays from ``element`` to ``first`` are the elements with
    children that open before this leaf: the element, the style around it, its
    depth, its own style, and whether it is the first of its kind in the page.
    ``words`` and ``counts`` of a place stand at its first leaf in the page.
    """
    rows, words, firsts, seen = [], {}, {}, set()
    opened: list[tuple] = []
    kinds: set[str] = set()

    def enter(children: list[Block], element: int, around: int, ancestors: list[int]) -> _Place:
        seq, places = _runs([c.tag for c in children])
        style = _path(element, *seq)
        if (element, style) not in seen:
            opened.append((element, around, len(ancestors), style, element not in seen))
            seen.update((element, (element, style)))
        return _Place(style, places, [*ancestors, element])

    def leaf_row(tag: str, clean: str, line: int, leaf: int, around: int, ancestors: list[int]) -> None:
        rows.append([len(rows), tag, clean, line, sorted(kinds), leaf, around, ancestors, *(zip(*opened) if opened else [()] * 5), False, [], []])
        kinds.clear()
        opened.clear()

    blocks = parse(text)
    level = [enter(blocks, ROOT, 0, [])]
    for block, clean, line in flow(blocks):
        if block is None:
            level.pop()
            continue
        top = level[-1]
        place = _path(top.style, top.places[top.next], block.tag)
        top.next += 1
        kinds |= block.kinds
        if clean is None:
            level.append(enter(block.children, place, top.style, top.ancestors))
            continue
        words.setdefault(place, Counter()).update(WORD.findall(clean.lower()))
        firsts.setdefault(place, len(rows))
        leaf_row(block.tag, clean, line, place, top.style, top.ancestors)
    if kinds or opened:  # of elements behind the last leaf
        leaf_row("", "", 0, 0, 0, [])
    for place, i in firsts.items():
        rows[i][-3:] = [True, list(words[place]), list(words[place].values())]
    return rows


def _arrays(**of: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, T.ArrayType(kind)) for n, kind in of.items()]


LONG, STRING = T.LongType(), T.StringType()
OPENED = ["element", "above", "depth", "style", "first"]
LEAF = T.StructType(
    [T.StructField("host", STRING), T.StructField("record", STRING), T.StructField("page", LONG), T.StructField("pos", T.IntegerType())]
    + [T.StructField("tag", STRING), T.StructField("clean", STRING), T.StructField("line", T.IntegerType()), *_arrays(kinds=STRING)]
    + [T.StructField("leaf", LONG), T.StructField("around", LONG), *_arrays(ancestors=LONG, element=LONG, above=LONG, depth=T.IntegerType(), style=LONG, first=T.BooleanType())]
    + [T.StructField("first_leaf", T.BooleanType()), *_arrays(words=STRING, counts=LONG)]
)
#: The row of a page without text.
NOTHING = (0, "", "", 0, [], 0, 0, [], [], [], [], [], [], False, [], [])


def read_pages(df: DataFrame, host: Column, record: Column, text: Column) -> DataFrame:
    """One row for each leaf of each page; equal (record, text) rows are one page, and empty pages have one leaf."""
    pages = df.select(host.cast("string").alias("h"), record.cast("string").alias("r"), text_of(text).alias("t")).filter("r is not null")
    # a fixed number of partitions: parsing costs much more than its bytes, by which adaptive execution would join them
    pages = pages.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h", "r", "t").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = LEAF.names, [f.type for f in to_arrow_schema(LEAF)]
        for whole in batches:
            for b in chunks(whole, 2):
                rows = []
                for h, r, t in zip(*(c.to_pylist() for c in b.columns)):
                    page = _path.__wrapped__(h, r, t)  # once each
                    found = page_leaves(t) if t else []
                    rows += [(h, r, page, *x) for x in found] or [(h, r, page, *NOTHING)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return pages.mapInArrow(run, LEAF)


def leaf_importance(nodes: DataFrame) -> DataFrame:
    """(host, leaf, around, depth, ancestors, m, imp): content importance of the tree's leaves.

    ``around`` is the style that a leaf stands in and ``m`` the number of pages.
    Partial sums come before every shuffle; no host's pages come together in one
    task.
    """
    at = nodes.filter("first_leaf")
    pages = at.groupBy("host", "leaf").agg(F.count("*").alias("m"), F.min("ancestors").alias("ancestors"), F.min("around").alias("around"))
    spread = (
        at.select("host", "leaf", F.explode(F.arrays_zip("words", "counts")).alias("w"))
        .groupBy("host", "leaf", F.col("w.words").alias("word"))
        .agg(F.sum("w.counts").alias("c"), F.sum(F.col("w.counts") * F.log("w.counts")).alias("s"))
        .groupBy("host", "leaf")
        .agg(F.sum(F.log("c") - F.col("s") / F.col("c")).alias("entropy"), F.count("*").alias("l"))
    )
    shared = F.coalesce(F.col("entropy") / F.log(F.col("m").cast("double")) / F.col("l"), F.lit(0.0))
    imp = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - shared)).otherwise(1.0)
    return pages.join(spread, ["host", "leaf"], "left").select("host", "leaf", "around", F.size("ancestors").alias("depth"), "ancestors", "m", imp.alias("imp"))


def inner_importance(nodes: DataFrame, leaf: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, element, depth, m, styles, imp): composite importance of the elements with children, the root at depth 0.

    From the deepest level of the tree up: an element takes the entropy of its
    styles over the pages, and below each style the mean of its children.  The
    entropy counts the less, the more styles there are to average the children
    over.  There is a step for each level of nesting; each works on the tree,
    which is much smaller than the pages.
    """
    seen = (
        nodes.filter(F.size("element") > 0)
        .select("host", F.explode(F.arrays_zip(*OPENED)).alias("o"))
        .groupBy("host", "o.element", "o.style")
        .agg(F.min("o.above").alias("around"), F.min("o.depth").alias("depth"), F.count("*").alias("p"), F.count_if("o.first").alias("n"))
    )
    seen = materialize(seen, "styles")
    deepest = seen.agg(F.max("depth")).first()[0]
    found = None
    above = leaf.select("host", "depth", F.col("around").alias("style"), "imp")
    inner = None  # the elements of the level below, as children
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        children = above.filter(F.col("depth") == depth + 1).select("host", "style", "imp")
        children = children if inner is None else children.unionByName(inner)
        mean = children.groupBy("host", "style").agg(F.avg("imp").alias("child"))
        own = F.when(F.col("p") > 1, (F.log("p") - F.col("s") / F.col("p")) / F.log(F.col("p").cast("double"))).otherwise(1.0)
        weak = F.pow(F.lit(gamma), F.col("styles"))
        made = (
            seen.filter(F.col("depth") == depth)
            .join(mean, ["host", "style"], "left")
            .groupBy("host", "element")
            .agg(
                F.min("around").alias("around"),
                F.sum("n").alias("m"),
                F.count("*").alias("styles"),
                F.sum(F.col("p") * F.log("p")).alias("s"),
                (F.sum(F.col("p") * F.coalesce("child", F.lit(1.0))) / F.sum("p")).alias("below"),
                F.sum("p").alias("p"),
            )
            .select("host", "element", "around", F.lit(depth).alias("depth"), "m", "styles", ((1 - weak) * own + weak * F.col("below")).alias("imp"))
        )
        made = materialize(made, "level")
        inner = made.select("host", F.col("around").alias("style"), "imp")
        found = made if found is None else found.unionByName(made)
    if found is None:
        return seen.select("host", "element", "depth", F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("styles"), F.lit(0.0).alias("imp")).limit(0)
    return found.select("host", "element", "depth", "m", "styles", "imp")


def host_importance(nodes: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """(host, pages, styles, importance): composite importance of each host's tree."""
    leaf = materialize(leaf_importance(nodes), "tree")
    return inner_importance(nodes, leaf, gamma).filter("depth = 0").select("host", F.col("m").alias("pages"), "styles", F.col("imp").alias("importance"))


def noisy_leaves(leaf: DataFrame, inner: DataFrame, threshold: float, min_pages: int) -> DataFrame:
    """(host, leaf): leaves that are of low importance themselves or stand in a branch that is.  The root is no branch."""
    low = (F.col("m") >= min_pages) & (F.col("imp") <= threshold)
    branches = inner.filter(low & (F.col("depth") > 0)).select("host", "element")
    below = leaf.select("host", "leaf", F.explode("ancestors").alias("element")).join(branches, ["host", "element"], "left_semi").select("host", "leaf")
    return leaf.filter(low).select("host", "leaf").unionByName(below).distinct()


def clean(df: DataFrame, host: Column, record: Column, text: Column, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(record, text, structure, leaves, removed) of every distinct page.

    ``text`` is clean: headings as ``#``, lists as ``-`` or numbers, code between
    backquotes, formulas between dollars, all other markup taken off, and
    leaves of low importance removed.  ``structure`` names the kinds of markup
    found in the whole page, before anything was removed.  A place that fewer
    than ``min_pages`` pages of the host show is never removed.  Null, empty and
    blank texts give empty text and no structure; rows without a record are left
    out; rows without a host are one host.

    The text is parsed once; leaves and marks are written to the shared folder.
    """
    nodes = materialize(read_pages(df, F.coalesce(host, F.lit("")), record, text), "leaves")
    leaf = materialize(leaf_importance(nodes), "tree")
    noise = noisy_leaves(leaf, inner_importance(nodes, leaf), threshold, min_pages).withColumn("noise", F.lit(True))
    marked = nodes.select("host", "record", "page", "pos", "tag", "clean", "line", "kinds", "leaf").join(noise, ["host", "leaf"], "left")
    part = F.struct("pos", "tag", "line", "clean")

    def joined(acc: Column, x: Column) -> Column:
        row = (x["line"] > 0) & (acc["line"] == x["line"])
        close = x["tag"].isin(TIGHT) & acc["tag"].isin(TIGHT)
        between = F.when(acc["text"] == "", "").when(row, " | ").when(close, "\n").otherwise("\n\n")
        return F.struct(F.concat(acc["text"], between, x["clean"]).alias("text"), x["tag"].alias("tag"), x["line"].alias("line"))

    return (
        marked.groupBy("record", "page")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("noise").isNull() & (F.col("clean") != ""), part))).alias("parts"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("structure"),
            F.count_if(F.col("tag") != "").alias("leaves"),
            F.count_if("noise").alias("removed"),
        )
        .select(
            "record",
            F.aggregate("parts", F.struct(F.lit("").alias("text"), F.lit("").alias("tag"), F.lit(0).alias("line")), joined)["text"].alias("text"),
            "structure",
            "leaves",
            "removed",
        )
    )
