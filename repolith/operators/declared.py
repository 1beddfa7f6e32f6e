"""Declared dependencies and what follows from them: risk, frameworks, entry points."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions.paths import base_name, glob_regex, is_test, numeric_version
from repolith.rules import tables

#: Manifests in the order in which the first declaration of a name counts.
ORDER = ["pom.xml", "package.json", "pyproject.toml", "requirements.txt", "go.mod"]
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def requirement(line: str) -> tuple[str, str] | None:
    """Name and version condition of a requirement; extras, markers and comments are taken off."""
    body = line.split(";")[0].split("#")[0].strip()
    m = _NAME.match(body)
    rest = re.sub(r"^\s*\[[^\]]*\]", "", body[m.end() :]).strip() if m else ""
    return (m[0], rest) if m and (not rest or rest[0] in "<>=!~^") else None


def go_requires(text: str) -> Iterator[tuple[str, str]]:
    """(module, version) of every ``require`` of a go.mod, in blocks and in lines of their own, blocks first."""
    single, inside = [], False
    for line in text.splitlines():
        words = line.split("//")[0].split()
        if not words:
            continue
        if inside and words[0] == ")":
            inside = False
        elif words[0].startswith("require") and line.startswith("require") and "(" in line:
            inside = True
        elif words[0] == "require" and len(words) == 3:
            single.append((words[1], words[2]))
        elif inside and len(words) == 2 and words[1][:1] == "v":
            yield words[0], words[1]
    yield from single


def maven_dependencies(project: ElementTree.Element) -> Iterator[tuple[str, str | None, str]]:
    """Direct dependencies of a pom; one without a version has the first version in the file that is not the parent's or a managed one's."""
    tag = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""  # noqa: E731 a comment has no name

    def walk(e: ElementTree.Element) -> Iterator[ElementTree.Element]:
        if tag(e) not in ("dependencyManagement", "parent"):
            yield e
            for inner in e:
                yield from walk(inner)

    kept = list(walk(project))
    inherited = next(((e.text or "").strip() for e in kept if tag(e) == "version"), None)
    for e in kept:
        if tag(e) == "dependency":
            has = {tag(x): (x.text or "").strip() for x in e}
            if has.get("groupId") and has.get("artifactId"):
                yield f"{has['groupId']}:{has['artifactId']}", has.get("version") or inherited, "runtime"


def read_manifest(name: str, text: str) -> list[tuple[str, str | None, str]]:
    """(name, version, kind) of a manifest's dependencies in order; unreadable ones have none."""
    out: list[tuple[str, str | None, str]] = []
    try:
        if name == "package.json":
            doc = json.loads(text)
            for section, kind in (("dependencies", "runtime"), ("devDependencies", "dev")):
                part = doc.get(section) if isinstance(doc, dict) else None
                out += [(str(k), str(v), kind) for k, v in part.items()] if isinstance(part, dict) else []
        elif name == "pyproject.toml":
            listed = tomllib.loads(text).get("project", {}).get("dependencies", [])
            out += [(*m, "runtime") for x in listed if isinstance(x, str) and (m := requirement(x))]
        elif name == "requirements.txt":
            lines = [x for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "-"))]
            out += [(*m, "runtime") for x in lines if (m := requirement(x))]
        elif name == "go.mod":
            out += [(n, v, "runtime") for n, v in go_requires(text)]
        elif name == "pom.xml":
            out += maven_dependencies(ElementTree.fromstring(text))
    except (ValueError, AttributeError, ElementTree.ParseError):
        return []
    return [(n, (v or "").strip() or None, k) for n, v, k in out]


def declared(tree: DataFrame) -> DataFrame:
    """(repo, key, name, version, kind, source): the first declaration of each name in a repository's root manifests."""
    schema = "repo string, source string, ord int, name string, version string, kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 3]
        for b in batches:
            rows = [
                (repo, path, i, *d)
                for repo, path, text in zip(*(c.to_pylist() for c in b.columns))
                for i, d in enumerate(read_manifest(path, text or ""))
            ]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["repo", "source", "ord", "name", "version", "kind"])

    read = tree.filter(F.col("path").isin(ORDER)).select("repo", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")).mapInArrow(run, schema)
    return first_wins(read.withColumn("place", F.array_position(F.array(*map(F.lit, ORDER)), F.col("source"))), ["repo"], "name", ["place", "ord"]).select("repo", "key", "name", "version", "kind", "source")


def first_wins(rows: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """Of the rows with one name, in any case, the first in order; adds ``key``, the name in lower case."""
    rest = [c for c in rows.columns if c not in by]
    keyed = rows.withColumn("key", F.lower(name))
    first = keyed.groupBy(*by, "key").agg(F.min(F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), *rest)).alias("r"))
    return first.select(*by, "key", *(F.col("r")[c].alias(c) for c in rest))


def end_of_life(ecosystem: Column, name: Column, version: Column) -> Column:
    """A struct (risk, reason) by the first rule that fits; null where none does.

    The rules are a dozen, so they are a chain of conditions and no join.
    """
    v = F.lower(numeric_version(version))
    c = F.lit(None).cast("struct<risk:string,reason:string>")
    for eco, rule, prefix, start, risk, reason in reversed(tables.END_OF_LIFE):
        named = F.startswith(name, F.lit(rule)) if prefix else F.lower(name) == rule.lower()
        c = F.when((ecosystem == eco) & named & F.startswith(v, F.lit(start)), F.struct(F.lit(risk).alias("risk"), F.lit(reason).alias("reason"))).otherwise(c)
    return c


def external(deps: DataFrame) -> DataFrame:
    """Declared dependencies with their risk."""
    eco = F.element_at(F.create_map(*(F.lit(x) for kv in tables.ECOSYSTEM_OF.items() for x in kv)), F.col("source"))
    return deps.withColumn("r", end_of_life(eco, F.col("name"), F.col("version"))).select("repo", "name", "version", "kind", F.col("r.risk").alias("risk"), F.col("r.reason").alias("reason"))


def framework_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rule table by kind of signal: dependencies, globs, texts."""
    dep = [(i, n, c, f, j, d) for i, (n, c, f, deps, _, _, _) in enumerate(tables.FRAMEWORKS) for j, d in enumerate(deps)]
    glob = [(i, n, c, f, g[0], glob_regex(g[0]), g[1]) for i, (n, c, f, _, g, _, _) in enumerate(tables.FRAMEWORKS) if g]
    text = [(i, n, c, f, t, lang) for i, (n, c, f, _, _, ts, langs) in enumerate(tables.FRAMEWORKS) for t in ts for lang in langs]
    head = "rule int, name string, category string, confidence double"
    return (
        spark.createDataFrame(dep, f"{head}, j int, key string"),
        spark.createDataFrame(glob, f"{head}, glob string, pattern string, least int"),
        spark.createDataFrame(text, f"{head}, wanted string, lang string"),
    )


def framework_keys(key: Column) -> Column:
    """Names by which a rule may know a dependency: its own, a Go path without host and version, a Maven artifact without its starter."""
    path = F.regexp_replace(F.regexp_replace(key, r"^[^/]*\.[^/]*/", ""), r"/v[0-9]+$", "")
    artifact = F.substring_index(key, ":", -1)
    return F.array_distinct(F.array(key, path, artifact, F.regexp_replace(artifact, r"-(?:spring-boot-)?starter(?:-.*)?$", "")))


def frameworks(files: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo, name, version, category, confidence, evidence): by declaration, else by globs, else by texts.

    Rule tables have a few dozen rows, so they are broadcast; a repository's
    best signal for a rule counts.
    """
    dep, glob, text = framework_rules(files.sparkSession)
    head = ["repo", "rule", "name", "category", "confidence"]
    one = deps.select("repo", F.col("key").alias("declared"), "version", "source", F.explode(framework_keys(F.col("key"))).alias("key")).join(F.broadcast(dep), "key")
    one = one.select(*head, F.lit(0).alias("way"), "j", "version", F.concat(F.lit("declared: "), "source", F.lit(":"), "declared", F.coalesce(F.concat(F.lit("@"), "version"), F.lit(""))).alias("evidence"))
    two = files.filter("lang is not null").join(F.broadcast(glob), F.expr("path rlike pattern")).groupBy(*head, "glob", "least").agg(F.count("*").alias("n")).filter("n >= least")
    two = two.select(*head, F.lit(1).alias("way"), F.lit(0).alias("j"), F.lit(None).cast("string").alias("version"), F.format_string("glob %s x%d", "glob", "n").alias("evidence"))
    three = files.filter(~is_test(F.col("path"))).join(F.broadcast(text), "lang").filter(F.contains("text", F.col("wanted")))
    three = three.select(*head, F.lit(2).alias("way"), F.lit(0).alias("j"), F.lit(None).cast("string").alias("version"), F.concat(F.lit("content: "), "wanted").alias("evidence")).distinct()
    best = one.unionByName(two).unionByName(three).groupBy(*head).agg(F.min(F.struct("way", "j", "evidence", "version")).alias("b"))
    return best.select("repo", "rule", "name", "b.version", "category", "confidence", F.array("b.evidence").alias("evidence"))


def entry_points(files: DataFrame, tree: DataFrame) -> DataFrame:
    """(repo, path, type, confidence, rule, evidence) of places where a program starts; tests are none."""
    code = files.filter(F.col("lang").isNotNull() & ~is_test(F.col("path")))
    made = None
    for i, (_, kind, langs, wanted, name, confidence) in enumerate(tables.ENTRY_POINTS):
        if name:
            hit, why = code.filter(base_name(F.col("path")) == name), f"file name {name}"
        elif wanted:
            hit, why = code.filter(F.col("lang").isin(langs)), "content: " + " & ".join(wanted)
            for w in wanted:
                hit = hit.filter(F.contains("text", F.lit(w)))
        else:
            pack = tree.filter("path = 'package.json'").select("repo", F.get_json_object(F.col("content").cast("string"), "$.bin").alias("bin"))
            some = F.when(F.startswith("bin", F.lit("{")), F.map_values(F.from_json("bin", "map<string,string>"))).otherwise(F.array("bin"))
            targets = pack.filter("bin is not null").select("repo", F.explode(some).alias("target"))
            targets = targets.withColumn("path", F.regexp_replace(F.replace(F.col("target"), F.lit("\\"), F.lit("/")), r"^[./]+", ""))
            found = targets.join(tree.select("repo", "path"), ["repo", "path"], "left_semi")
            part = found.select("repo", "path", F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(i).alias("rule"), F.concat(F.lit("package.json bin -> "), "target").alias("evidence"))
            made = part if made is None else made.unionByName(part)
            continue
        part = hit.select("repo", "path", F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(i).alias("rule"), F.lit(why).alias("evidence"))
        made = part if made is None else made.unionByName(part)
    return made
