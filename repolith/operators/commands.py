"""How repositories are installed, run and tested: one table of candidates, one reader of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.paths import base_name
from repolith.rules import tables

#: Places of scripts, makefile targets and workflow steps between the fixed commands.
SCRIPT, MAKE, WORKFLOW = 1, 6, 7
CANDIDATE = ["repo", "system", "kind", "place", "sub", "step", "command", "source", "explicit"]


def _text(c: str = "content") -> Column:
    return F.coalesce(F.make_valid_utf8(F.col(c).cast("string")), F.lit(""))


def make_commands(text: Column) -> Column:
    """A map from each target of a makefile to its command: the first of its lines with one, up to ``&&``.

    A target is a name with a colon and nothing behind it but a comment.  Of
    several with one name the first that has a command counts; a target without
    commands has an empty one.
    """
    parts = F.split(F.regexp_replace(text, r"(?m)^([a-zA-Z][\w-]*):[ \t]*(?:#.*)?\r?$", "\x01$1\x02"), "\x01")
    lines = lambda part: F.filter(F.split(F.substring_index(part, "\x02", -1), "\n"), lambda x: x.startswith("\t"))
    first = lambda part: F.get(F.filter(F.transform(lines(part), lambda x: F.trim(F.substring_index(F.regexp_replace(x, r"[\t\r]", " "), "&&", 1))), lambda x: (x != "") & ~x.startswith("#")), F.lit(0))
    found = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("\x02"))), lambda p: F.struct(F.substring_index(p, "\x02", 1).alias("name"), F.coalesce(first(p), F.lit("")).alias("command")))
    names = F.array_distinct(F.transform(found, lambda s: s["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.coalesce(F.get(F.filter(found, lambda s: (s["name"] == n) & (s["command"] != "")), F.lit(0))["command"], F.lit(""))))


def step_commands(text: Column) -> Column:
    """Commands of a workflow's ``- run:`` lines, in order."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))
    dashed = F.transform(F.filter(lines, lambda x: x.startswith("-")), lambda x: F.ltrim(F.substring(x, 2, 1 << 30)))
    runs = F.filter(dashed, lambda x: x.startswith("run:"))
    return F.filter(F.transform(runs, lambda x: F.trim(F.substring(x, 5, 1 << 30))), lambda x: x != "")


def candidates(tree: DataFrame) -> DataFrame:
    """(repo, system, kind, place, sub, step, command, source, explicit): every command that a repository suggests."""
    spark = tree.sparkSession
    locks = F.array(*(F.lit(n) for n, _ in tables.LOCKS))
    managers = F.array(*(F.lit(m) for _, m in tables.LOCKS))
    lock = tree.filter(F.col("path").isin([n for n, _ in tables.LOCKS])).groupBy("repo").agg(F.min(F.array_position(locks, F.col("path"))).alias("at"))
    lock = lock.select("repo", F.element_at(managers, F.col("at").cast("int")).alias("manager"), F.element_at(locks, F.col("at").cast("int")).alias("lock"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    mains = tree.filter(base_name(F.col("path")) == "main.go").groupBy("repo").agg(F.min(F.when(folder == "", ".").otherwise(folder)).alias("main"))

    rules = spark.createDataFrame(tables.COMMANDS, "place int, system string, path string, kind string, command string, source string, explicit boolean")
    fill = F.when(F.col("system") == "node", F.col("manager")).otherwise(F.coalesce("main", F.lit("cmd/app")))
    source = F.when(F.col("system") == "node", F.concat_ws(": ", "source", "lock")).otherwise(F.col("source"))
    fixed = tree.select("repo", "path").join(F.broadcast(rules), "path").join(lock, "repo", "left").join(mains, "repo", "left")
    fixed = fixed.select("repo", "system", "kind", "place", F.lit("").alias("sub"), F.lit(0).alias("step"), F.replace(F.col("command"), F.lit("{0}"), fill).alias("command"), source.alias("source"), "explicit")

    pack = tree.filter("path = 'package.json'").join(lock, "repo").select("repo", "manager", F.from_json(F.get_json_object(_text(), "$.scripts"), "map<string,string>").alias("scripts"))
    named = F.explode(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.lit(k).alias("kind")) for i, (n, k) in enumerate(tables.SCRIPTS))))
    script = pack.select("repo", "manager", "scripts", named.alias("s")).filter(F.map_contains_key("scripts", F.col("s.name")))
    script = script.select(
        "repo", F.lit("node").alias("system"), "s.kind", F.lit(SCRIPT).alias("place"), F.lit("").alias("sub"), "s.step",
        F.concat_ws(" ", "manager", F.lit("run"), "s.name").alias("command"),
        F.concat(F.lit("package.json scripts."), "s.name", F.lit(": "), F.element_at("scripts", F.col("s.name"))).alias("source"), F.lit(True).alias("explicit"),
    )

    made = tree.filter("path = 'Makefile'").select("repo", make_commands(_text()).alias("targets"))
    make = made.filter(F.size("targets") > 0).select("repo", F.explode("targets").alias("name", "command"))
    known = F.col("name").isin(tables.COMMAND_KINDS) & (F.col("command") != "")
    make = make.select(
        "repo", F.lit("make").alias("system"), F.when(known, F.col("name")).alias("kind"), F.lit(MAKE).alias("place"), F.lit("").alias("sub"), F.lit(0).alias("step"),
        "command", F.concat(F.lit("Makefile:"), "name").alias("source"), F.lit(False).alias("explicit"),
    )

    flow = tree.filter(F.col("path").rlike(r"^\.github/workflows/[^/]*\.ya?ml$")).select("repo", F.concat(F.substring_index("path", ".", -1), F.lit(" "), "path").alias("name"), F.posexplode(step_commands(_text())).alias("step", "command"))
    low = F.lower("command")
    kind = F.when(F.contains(low, F.lit("install")), "install").when(F.contains(low, F.lit("test")), "test")
    flow = flow.withColumn("kind", kind).filter("kind is not null").select(
        "repo", F.lit(None).cast("string").alias("system"), "kind", F.lit(WORKFLOW).alias("place"),
        F.concat(F.when(F.startswith("name", F.lit("yml ")), "0").otherwise("1"), "name").alias("sub"), "step", "command", F.lit("workflow run:").alias("source"), F.lit(False).alias("explicit"),
    )
    return fixed.unionByName(script).unionByName(make).unionByName(flow).select(*CANDIDATE)


def build_run(tree: DataFrame) -> DataFrame:
    """(repo, build_system, install_cmd, dev_cmd, test_cmd, confidence, evidence), one row for each repository.

    Commands are in the order of their places, each once; evidence is the first
    six sources by name.  Candidates come from manifests, workflows and names of
    main files only, so what a repository gathers is small whatever its size.
    """
    order = F.struct("place", "sub", "step", "command", "kind")
    made = candidates(tree).groupBy("repo").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), order))).alias("c"),
        F.collect_set("system").alias("systems"),
        F.bool_or("explicit").alias("explicit"),
        F.sort_array(F.collect_set(F.when(F.col("kind").isNotNull(), F.trim(F.substring_index("source", "(", 1))))).alias("why"),
    )

    def of(kind: str) -> Column:
        return F.array_distinct(F.transform(F.filter("c", lambda s: s["kind"] == kind), lambda s: s["command"])).alias(f"{kind}_cmd")

    kinds = [of(k) for k in tables.COMMAND_KINDS]
    made = made.select("repo", F.filter(F.array(*map(F.lit, tables.SYSTEMS)), lambda s: F.array_contains("systems", s)).alias("build_system"), *kinds, F.when(F.col("explicit"), 0.9).otherwise(0.5).alias("confidence"), F.slice("why", 1, 6).alias("evidence"))
    none = F.array().cast("array<string>")
    rest = {c: F.coalesce(c, none) for c in made.columns if c not in ("repo", "confidence")}
    return tree.select("repo").distinct().join(made, "repo", "left").withColumns({**rest, "confidence": F.coalesce("confidence", F.lit(0.5))})
