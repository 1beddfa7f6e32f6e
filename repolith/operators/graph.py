"""Graphs: degrees, layers, cycles, rendering, and calls between symbols."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repolith.functions.paths import node_type
from repolith.operators.fold import fold_sorted
from repolith.rules import tables
from repolith.storage import materialize


def degrees(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, in_degree, out_degree); nodes without edges have 0."""
    ends = edges.select(F.col("source").alias(node), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("target").alias(node), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counted = ends.groupBy(node).agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select(node).distinct().join(counted, node, "left").na.fill(0, ["in_degree", "out_degree"])


def layer_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that skip a layer: (source, target, source_type, target_type, severity)."""
    rule = F.lit(None).cast("string")
    for a, b, severity in tables.LAYER_RULES:
        rule = F.when((F.col("source_type") == a) & (F.col("target_type") == b), severity).otherwise(rule)
    return (
        edges.join(nodes.select(F.col("node").alias("source"), F.col("type").alias("source_type")), "source")
        .join(nodes.select(F.col("node").alias("target"), F.col("type").alias("target_type")), "target")
        .withColumn("severity", rule)
        .filter("severity is not null")
        .select("source", "target", "source_type", "target_type", "severity")
    )


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of more than one node, named by their least node.

    Colouring: nodes that can't be in a cycle are trimmed, the greatest node of
    all that reach a node is spread forward, and within a colour what reaches
    its root backward is one component.  Each step is a join and a minimum or
    maximum by node, so neither paths nor closures are held, and the depth is
    bounded by the longest path and not by the number of nodes.
    """
    rest = materialize(edges.select("source", "target").filter("source != target and source is not null and target is not null").distinct(), "edges")
    found = None
    while True:  # each round finds the components of its colours, until no edge is left
        while True:  # trim
            inner = rest.join(rest.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(
                rest.select(F.col("source").alias("target")).distinct(), "target", "left_semi"
            )
            inner = materialize(inner.select("source", "target"), "edges")
            same = inner.count() == rest.count()
            rest = inner
            if same:
                break
        if rest.isEmpty():
            break
        nodes = rest.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        colour = materialize(nodes.withColumn("c", F.col("node")), "colour")
        while True:
            come = rest.join(colour.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.max("c").alias("m"))
            new = materialize(colour.join(come, "node", "left").select("node", F.greatest("c", "m").alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("moved")), "colour")
            colour, moved = new.select("node", "c"), not new.filter("moved").isEmpty()
            if not moved:
                break
        inside = (
            rest.join(colour.select(F.col("node").alias("source"), F.col("c").alias("cs")), "source")
            .join(colour.select(F.col("node").alias("target"), F.col("c").alias("ct")), "target")
            .filter("cs = ct")
            .select("source", "target")
        )
        inside = materialize(inside, "edges")
        reach = materialize(colour.filter("node = c"), "reach")
        while True:
            back = inside.join(reach.select(F.col("node").alias("target"), "c"), "target").select(F.col("source").alias("node"), "c").distinct()
            fresh = materialize(back.join(reach, ["node", "c"], "left_anti"), "reach")
            if fresh.isEmpty():
                break
            reach = materialize(reach.unionByName(fresh), "reach")
        found = reach if found is None else found.unionByName(reach)
        rest = materialize(rest.join(reach.select(F.col("node").alias("source")), "source", "left_anti").join(reach.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target"), "edges")
        if rest.isEmpty():
            break
    if found is None:
        return rest.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    names = found.groupBy("c").agg(F.min("node").alias("component"), F.count("*").alias("n")).filter("n > 1")
    return found.join(names, "c").select("node", "component")


#: Edges of a graph up to which one task finds its components.
ONE_TASK = 200_000


def strong_components(edges: Iterable[tuple[str, str]]) -> Iterator[list[str]]:
    """Strongly connected components of more than one node of a graph that fits in memory, by one walk in depth."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    number: dict[str, int] = {}  # in the order of the walk
    low: dict[str, int] = {}  # the least number that a node is known to reach among those not yet in a component
    waiting: list[str] = []
    placed: set[str] = set()
    for start in after:
        if start in number:
            continue
        path = [(start, iter(after[start]))]
        number[start] = low[start] = len(number)
        waiting.append(start)
        while path:
            node, rest = path[-1]
            for b in rest:
                if b not in number:
                    number[b] = low[b] = len(number)
                    waiting.append(b)
                    path.append((b, iter(after.get(b, ()))))
                    break
                if b not in placed:
                    low[node] = min(low[node], number[b])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    cut = len(waiting) - 1
                    while waiting[cut] != node:
                        cut -= 1
                    made = waiting[cut:]
                    del waiting[cut:]
                    placed.update(made)
                    if len(made) > 1:
                        yield made


def cycles_of_each(edges: DataFrame, by: str, one_task: int = ONE_TASK) -> DataFrame:
    """(by, node, component): ``cycles`` of many graphs, edges having (by, source, target).

    A graph of up to ``one_task`` edges is walked by one task; larger ones take
    the way of ``cycles`` together, so no task holds more.
    """
    clean = edges.select(by, "source", "target").filter(F.col(by).isNotNull() & F.col("source").isNotNull() & F.col("target").isNotNull()).distinct()
    sizes = clean.groupBy(by).agg(F.count("*").alias("size"))
    sized = materialize(clean.join(sizes, by), "graphs")
    schema = T.StructType([sized.schema[by], T.StructField("node", T.StringType()), T.StructField("component", T.StringType())])

    def walk(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        for made in strong_components(rows):
            yield from ((*key, n, min(made)) for n in made)

    small = fold_sorted(sized.filter(F.col("size") <= one_task).select(by, "source", "target"), [by], ["source", "target"], walk, schema)
    large = sized.filter(F.col("size") > one_task)
    if large.isEmpty():
        return small
    named = lambda c: F.to_json(F.struct(F.col(by).alias("g"), F.col(c).alias("n")))
    found = cycles(large.select(named("source").alias("source"), named("target").alias("target")))
    part = lambda c, f: F.get_json_object(c, f"$.{f}")
    found = found.select(part("node", "g").cast(sized.schema[by].dataType).alias(by), part("node", "n").alias("node"), part("component", "n").alias("component"))
    return small.unionByName(found)


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("source = target").select(F.col("source").alias("node")).distinct()


def mermaid(modules: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(ord, line) of a flowchart: nodes m0, m1, ... by name, then weighted edges between known nodes.

    One module graph at a time; the numbering needs one order over its modules.
    """
    clean = F.replace(F.replace(F.replace(F.col(name), F.lit('"'), F.lit("'")), F.lit("\\"), F.lit("/")), F.lit("|"), F.lit("/"))
    ids = modules.withColumn("n", F.row_number().over(Window.orderBy(name)) - 1)
    box = F.concat(F.lit("  m"), F.col("n").cast("string"), F.lit('["'), clean, F.lit('"]'))
    nodes = ids.select(F.struct(F.lit(1).alias("k"), F.col("n").cast("long").alias("a"), F.lit("").alias("b")).alias("o"), box.alias("line"))
    ends = edges.join(ids.select(F.col(name).alias("source"), F.col("n").alias("s")), "source").join(ids.select(F.col(name).alias("target"), F.col("n").alias("t")), "target")
    arrow = F.concat(F.lit("  m"), F.col("s").cast("string"), F.lit(" -->|"), F.col("weight").cast("string"), F.lit("| m"), F.col("t").cast("string"))
    arrows = ends.select(F.struct(F.lit(2).alias("k"), (-F.col("weight")).alias("a"), F.concat_ws("\t", "source", "target").alias("b")).alias("o"), arrow.alias("line"))
    head = modules.sparkSession.range(1).select(F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("a"), F.lit("").alias("b")).alias("o"), F.lit("flowchart LR").alias("line"))
    return head.unionByName(nodes).unionByName(arrows).withColumn("ord", F.row_number().over(Window.orderBy("o")).cast("int")).select("ord", "line")


# --- symbols and calls -------------------------------------------------------------------------------

_DEFS = {
    "go": [re.compile(r"(?m)^func\s+(?:\(\s*\w+\s+\*?(\w+)[^)]*\)\s*)?(\w+)\s*\(")],
    "javascript": [re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:class\s+(\w+)|function\s*\*?\s*(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)")],
    "java": [re.compile(r"(?m)^[ \t]*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)")],
}
_DEFS["typescript"] = _DEFS["javascript"]
_CALL = re.compile(r"\b([A-Za-z_$][\w$]*)(?:\.[A-Za-z_$][\w$]*)*?(?:\.([A-Za-z_$][\w$]*))?\s*\(")
_FIELD = re.compile(r"\b([A-Z]\w*)(?:<[^>]*>)?\s+(\w+)\s*[;=,)]")
_KEYWORDS = set("if for while switch catch return func function new class def else do try await typeof super this".split())

#: Symbol readers by language: text -> (symbols, calls) as ([(name, line)], [(caller, callee)]).
PARSERS: dict = {}


def parser(*languages: str):
    """Register a symbol reader; a better one for a language may replace ours."""

    def register(f):
        PARSERS.update(dict.fromkeys(languages, f))
        return f

    return register


@parser("python")
def python_symbols(text: str, lang: str) -> tuple[list, list]:
    """Top-level classes and functions, and the names called in them."""
    symbols, calls = [], []
    for node in ast.parse(text).body:
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        symbols.append((node.name, node.lineno))
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                parts, f = [], x.func
                while isinstance(f, ast.Attribute):
                    parts.append(f.attr)
                    f = f.value
                if isinstance(f, ast.Name):
                    parts.append(f.id)
                if parts:
                    calls += [(node.name, parts[-1])] + ([(node.name, parts[0])] if len(parts) > 1 else [])
    return symbols, calls


@parser("go", "javascript", "typescript", "java")
def pattern_symbols(text: str, lang: str) -> tuple[list, list]:
    """Symbols by patterns; a symbol's calls are those up to the next symbol."""
    found = []
    for p in _DEFS[lang]:
        for m in p.finditer(text):
            if name := next((g for g in m.groups() if g), None):
                found.append((m.start(), m.end(), name))
    found.sort()
    symbols, calls = [], []
    for (start, after, name), nxt in zip(found, [*found[1:], (len(text), 0, "")]):
        symbols.append((name, text.count("\n", 0, start) + 1))
        body = text[after : nxt[0]]
        types = {v: t for t, v in _FIELD.findall(body)} if lang == "java" else {}
        for m in _CALL.finditer(body):
            for c in filter(None, m.groups()):
                if c not in _KEYWORDS:
                    calls.append((name, types.get(c, c)))
    return symbols, calls


def symbols(files: DataFrame) -> DataFrame:
    """(repo, path, kind, name, other, line): ``symbol`` rows, and ``call`` rows from name to other.

    A file that can't be read has none.
    """
    schema = "repo string, path string, kind string, name string, other string, line int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32()]
        for b in batches:
            rows = []
            for repo, path, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                if lang not in PARSERS or not text:
                    continue
                try:
                    found, calls = PARSERS[lang](text, lang)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(repo, path, "symbol", n, None, line) for n, line in found]
                rows += [(repo, path, "call", n, c, None) for n, c in dict.fromkeys(calls)]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["repo", "path", "kind", "name", "other", "line"])

    return files.select("repo", "path", "lang", "text").mapInArrow(run, schema)


def call_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo, node, path, line, type) and edges (repo, source, target) from ``symbols``.

    A symbol defined twice counts where its path is least; a call means the
    symbol of the same name without regard to case and underscores, the least
    of several; calls to itself are no edges.
    """
    key = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(""))
    nodes = found.filter("kind = 'symbol'").groupBy("repo", F.col("name").alias("node")).agg(F.min(F.struct("path", "line")).alias("p")).select("repo", "node", "p.*")
    nodes = nodes.withColumn("type", node_type(F.col("node"), F.col("path")))
    target = nodes.groupBy("repo", key(F.col("node")).alias("key")).agg(F.min("node").alias("target"))
    calls = found.filter("kind = 'call'").select("repo", F.col("name").alias("source"), key(F.col("other")).alias("key")).distinct()
    edges = calls.join(target, ["repo", "key"]).filter("source != target").select("repo", "source", "target").distinct()
    return nodes, edges
