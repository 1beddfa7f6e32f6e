"""The whole profile of repositories: every snapshot operator over one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.operators import commands, declared, files, graph, modules
from repolith.rules import tables
from repolith.storage import materialize


def gathered(df: DataFrame, name: str, order: list, fields: list[str]) -> DataFrame:
    """(repo, name): a repository's rows as an ordered array of structs."""
    key = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.struct(*fields).alias("v"))
    return df.groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(key)), lambda s: s["v"]).alias(name))


def config_files(tree: DataFrame) -> DataFrame:
    """(repo, config_files, ecosystems, markers) from files in the root."""
    eco = F.element_at(F.create_map(*(F.lit(x) for kv in tables.MANIFESTS.items() for x in kv)), F.col("path"))
    known = [*tables.MANIFESTS, *tables.MONOREPO, *tables.ROOT_MARKERS]
    return tree.groupBy("repo").agg(
        F.sort_array(F.collect_set(F.when(F.col("path").isin(known), F.col("path")))).alias("config_files"),
        F.sort_array(F.collect_set(F.when(~eco.isin("docker", "make"), eco))).alias("ecosystems"),
        F.sort_array(F.collect_set(F.when(F.col("path").isin(tables.MONOREPO), F.col("path")))).alias("markers"),
        F.count_if(~F.col("error")).alias("total_files"),
        F.count_if("error").alias("read_errors"),
    )


def warnings(row: DataFrame) -> DataFrame:
    """Adds ``warnings``: what a reader of the profile should know, in a fixed order."""

    def item(condition, code: str, detail):
        return F.when(condition, F.struct(F.lit(code).alias("code"), detail.alias("detail")))

    items = F.array(
        item(F.size("ecosystems") >= 2, "MIXED_MONOREPO", F.concat(F.lit("manifests of several ecosystems: "), F.array_join("ecosystems", ", "))),
        item(F.size("markers") > 0, "MONOREPO_MARKERS", F.array_join("markers", ", ")),
        item(F.col("too_big") > 0, "BIG_FILE_SKIPPED", F.format_string("%d code files too big to read", "too_big")),
        item(F.col("read_errors") > 0, "READ_ERRORS", F.format_string("%d files could not be read", "read_errors")),
        item(F.col("total_files") > tables.SOFT_FILE_LIMIT, "FILE_LIMIT_EXCEEDED", F.format_string("%d files", "total_files")),
        item(F.col("total_files") == 0, "EMPTY_REPO", F.lit("no files")),
    )
    return row.withColumn("warnings", F.filter(items, lambda x: x.isNotNull()))


def profile(tree: DataFrame, max_bytes: int = tables.MAX_FILE_BYTES) -> DataFrame:
    """One row for each repository, everything nested; null is "not measured".

    The scan is written once and read by every detector.
    """
    tree = materialize(tree, "tree")
    code = materialize(files.prepared(tree, max_bytes), "files")
    texts = files.within_budget(code.filter(F.col("lang").isin(tables.PARSED) & F.col("text").isNotNull() & ~F.col("too_big")), ["repo"], "path", F.col("walk"), F.get("walk", F.lit(0)), "size")
    texts = materialize(texts.drop("used"), "texts")
    kept = code.filter("lang is not null")
    deps = declared.declared(tree)
    prefixes = tree.filter("path = 'go.mod'").select("repo", F.regexp_extract(F.col("content").cast("string"), r"(?m)^module\s+(\S+)", 1).alias("prefix")).filter("prefix != ''")
    read = kept.drop("text").join(texts.select("repo", "path", "text"), ["repo", "path"], "left")
    mods, edges = modules.module_graph(read, prefixes)
    nodes, calls = graph.call_graph(graph.symbols(texts))
    levels = graph.layer_violations(nodes.select(F.concat_ws("\t", "repo", "node").alias("node"), "type"), calls.select(F.concat_ws("\t", "repo", "source").alias("source"), F.concat_ws("\t", "repo", "target").alias("target")))
    levels = levels.select(F.substring_index("source", "\t", 1).alias("repo"), F.substring_index("source", "\t", -1).alias("source"), F.substring_index("target", "\t", -1).alias("target"), "severity")
    base = config_files(tree)
    sums = code.groupBy("repo").agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"), F.count_if("too_big").alias("too_big"))
    tests = files.test_evidence(code, ["repo"])
    frames = deps.filter(F.col("key").isin(tables.TEST_FRAMEWORKS)).groupBy("repo").agg(F.collect_set("key").alias("test_deps"))
    todos = files.marker_counts(texts, ["repo"], "text", ["TODO", "FIXME"])
    row = warnings(base.join(sums, "repo", "left").na.fill(0, ["total_loc", "too_big"]))
    parts = [
        gathered(files.language_stats(code, ["repo"], "lang", F.col("loc")), "languages", [-F.col("loc"), F.col("name")], ["name", "pct", "files", "loc"]),
        gathered(files.top_dirs(code, ["repo"]), "top_level_dirs", [F.col("dir") == "(root)", -F.col("files"), F.col("dir")], ["dir", "files", "role"]),
        gathered(files.largest(code, ["repo"]), "largest_files", [F.col("place")], ["path", "loc"]),
        gathered(files.hotspots(texts), "complexity_hotspots", [F.col("path"), F.col("n")], ["path", "signal"]),
        gathered(declared.entry_points(read, tree), "entry_points", [-F.col("confidence"), F.col("path"), F.col("rule")], ["path", "type", "confidence", "evidence"]),
        gathered(mods, "modules", [F.col("module")], ["module", "files", "cohesion"]),
        gathered(edges, "internal", [-F.col("weight"), F.col("source"), F.col("target")], ["source", "target", "weight"]),
        gathered(declared.external(deps), "external", [F.col("kind"), F.lower("name")], ["name", "version", "kind", "risk", "reason"]),
        gathered(declared.frameworks(read, deps), "frameworks", [F.coalesce("category", F.lit("zzz")), -F.col("confidence"), F.col("name"), F.col("rule")], ["name", "version", "category", "confidence", "evidence"]),
        commands.build_run(tree).select("repo", F.struct("build_system", "install_cmd", "dev_cmd", "test_cmd", "confidence", "evidence").alias("build_run")),
        gathered(nodes, "call_nodes", [F.col("node")], ["node", "path", "line", "type"]),
        gathered(calls, "call_edges", [F.col("source"), F.col("target")], ["source", "target"]),
        gathered(levels, "layer_violations", [F.col("source"), F.col("target")], ["source", "target", "severity"]),
        tests.join(frames, "repo", "left").select(
            "repo",
            F.struct(
                "test_files",
                "ratio",
                F.sort_array(F.concat(F.coalesce("test_deps", F.array().cast("array<string>")), F.when(F.col("go_tests"), F.array(F.lit("go-test"))).otherwise(F.array().cast("array<string>")))).alias("frameworks"),
            ).alias("test_evidence"),
        ),
        todos.select("repo", F.when((F.col("todo") > 0) | (F.col("fixme") > 0), F.struct("todo", "fixme")).alias("todos")),
    ]
    for p in parts:
        row = row.join(p, "repo", "left")
    return row.withColumns({"schema_version": F.lit("1.0"), "generated_at": F.current_timestamp()})


#: Limits and confidence of the reduced profile.
LITE_FILE_BYTES, LITE_TEXT_BUDGET, LITE_CONFIDENCE = 1 << 20, 4_000_000, 0.6


def lite(tree: DataFrame) -> DataFrame:
    """The reduced profile: languages, folders of code, largest files, entry points and commands.

    Smaller limits; top folders count code files, with those in the root under
    their own names; an entry point is the first that fits, tests included;
    commands have a fixed confidence; the total of lines is at least 1.
    """
    tree = materialize(tree, "tree")
    code = materialize(files.prepared(tree, LITE_FILE_BYTES), "files")
    kept = code.filter("lang is not null")
    texts = files.within_budget(kept.filter(F.col("text").isNotNull() & ~F.col("too_big")), ["repo"], "path", F.col("walk"), F.get("walk", F.lit(0)), "size", LITE_TEXT_BUDGET)
    has = lambda t: F.contains("text", F.lit(t))
    python = F.col("lang") == "python"
    first = (
        F.when(python & has("__main__"), F.struct(F.lit("cli").alias("type"), F.lit(0.8).alias("confidence"), F.lit("content: __main__").alias("evidence")))
        .when(python & has("FastAPI("), F.struct(F.lit("server").alias("type"), F.lit(0.85).alias("confidence"), F.lit("content: FastAPI(").alias("evidence")))
        .when((F.col("lang") == "go") & has("package main") & has("func main("), F.struct(F.lit("cli").alias("type"), F.lit(0.9).alias("confidence"), F.lit("content: package main & func main(").alias("evidence")))
        .when(F.col("lang").isin("typescript", "javascript", "vue") & has("createApp("), F.struct(F.lit("gui").alias("type"), F.lit(0.85).alias("confidence"), F.lit("content: createApp(").alias("evidence")))
    )
    entries = texts.withColumn("e", first).filter("e is not null").select("repo", "path", "e.type", "e.confidence", "e.evidence")
    entries = entries.unionByName(declared.entry_points(kept, tree).filter(F.startswith("evidence", F.lit("package.json"))).select("repo", "path", "type", "confidence", "evidence"))
    dirs = kept.groupBy("repo", F.substring_index("path", "/", 1).alias("dir")).agg(F.count("*").alias("files"))
    runs = commands.build_run(tree).withColumns({"confidence": F.lit(LITE_CONFIDENCE), "build_system": F.sort_array("build_system")})
    sums = code.groupBy("repo").agg(F.greatest(F.coalesce(F.sum("loc"), F.lit(0)), F.lit(1)).alias("total_loc"), F.count_if("too_big").alias("too_big"))
    row = warnings(config_files(tree).join(sums, "repo", "left"))
    row = row.withColumn("warnings", F.concat(F.array(F.struct(F.lit("SCAN_MODE").alias("code"), F.lit("lite").alias("detail"))), "warnings"))
    for part in (
        gathered(files.language_stats(code, ["repo"], "lang", F.col("loc")).filter("loc > 0"), "languages", [-F.col("loc"), F.col("name")], ["name", "pct", "files", "loc"]),
        gathered(dirs, "top_level_dirs", [-F.col("files"), F.col("dir")], ["dir", "files"]),
        gathered(files.largest(code, ["repo"]), "largest_files", [F.col("place")], ["path", "loc"]),
        gathered(entries, "entry_points", [-F.col("confidence"), F.col("path")], ["path", "type", "confidence", "evidence"]),
        runs.select("repo", F.struct("build_system", "install_cmd", "dev_cmd", "test_cmd", "confidence", "evidence").alias("build_run")),
    ):
        row = row.join(part, "repo", "left")
    return row.withColumns({"schema_version": F.lit("1.0"), "generated_at": F.current_timestamp()})


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def to_json(rows: DataFrame) -> DataFrame:
    """(repo, json): profiles as documents with names in camel case, nulls kept."""
    fields = [F.col(c).alias(camel(c)) for c in rows.columns]
    return rows.select("repo", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
