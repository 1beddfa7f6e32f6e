"""Imports of source files, their resolution to files, and the module graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.paths import module_of

# Extensions tried for a relative JavaScript import, in this order, as a file and then as an index file.
JS_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue"]
JS_TRIED = ["", *JS_EXTENSIONS, *("/index" + e for e in JS_EXTENSIONS)]


def _lines(text: Column, *starts: str) -> Column:
    """Lines that start with one of the words, without the blanks around them."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))
    return F.filter(trimmed, lambda x: reduce(lambda a, b: a | b, [F.startswith(x, F.lit(w)) for w in starts]))


def python_imports(text: Column) -> Column:
    """Array of (name, level): ``from ..a import b`` is ("a", 2), ``import a, b`` two of level 0; ``from`` ones come first.

    Of ``import a as x, b`` only what stands before the first alias is read.
    """
    none = F.array().cast("array<struct<name:string,level:int>>")

    def origin(x: Column) -> Column:
        said = F.trim(F.substring_index(F.substring(x, 5, 1 << 30), "import", 1))
        name = F.ltrim(said, F.lit("."))
        return F.struct(name.alias("name"), (F.length(said) - F.length(name)).cast("int").alias("level"))

    froms = F.transform(F.filter(_lines(text, "from ", "from."), lambda x: F.rlike(F.substring(x, 5, 1 << 30), F.lit(r"(?U)^ *[\w.]*[ .]import\b"))), origin)

    def names(x: Column) -> Column:
        listed = F.transform(F.split(F.substring(x, 8, 1 << 30), ","), lambda n: F.trim(n))
        plain = lambda n: F.rlike(n, F.lit(r"(?U)^[\w.]+$"))
        kept = F.filter(listed, lambda n, i: F.forall(F.slice(listed, F.lit(1), i), plain))
        return F.transform(kept, lambda n: F.struct(F.regexp_extract(n, r"(?U)^[\w.]*", 0).alias("name"), F.lit(0).alias("level")))

    plain = F.flatten(F.transform(_lines(text, "import "), names))
    return F.concat(froms, F.coalesce(F.filter(plain, lambda s: s["name"] != ""), none))


def js_imports(text: Column) -> Column:
    """Specifiers of import/export from, require() and import(), in the order of the text.

    The text is read as pairs of a quoted word and what leads to it.
    """
    pair = r"""([^'"]*)['"]([^'"\n]+)['"]"""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pair), F.lit(1)).alias("lead"), F.regexp_extract_all(text, F.lit(pair), F.lit(2)).alias("word"))

    def leads(x: Column) -> Column:
        lead = F.rtrim(F.regexp_replace(x["lead"], r"\s+", " "))
        statement = F.substring_index(lead, ";", -1)
        return F.rlike(lead, F.lit(r"\b(?:require|import) ?\($")) | (F.rlike(statement, F.lit(r"\bfrom$")) & F.rlike(statement, F.lit(r"\b(?:import|export)\b")))

    return F.transform(F.filter(both, leads), lambda x: x["word"])


def go_imports(text: Column) -> Column:
    """Paths of import blocks (one per line), then of single imports."""
    quoted = lambda x: F.get(F.split(x, '"'), F.lit(1))
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^import *\(([^)]*)\)"), F.lit(1))
    inside = F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), quoted)
    single = F.transform(F.filter(F.split(text, "\n"), lambda x: F.startswith(x, F.lit("import ")) & ~F.contains(x, F.lit("("))), quoted)
    return F.filter(F.concat(inside, single), lambda x: x.isNotNull() & (x != ""))


def normalized(path: Column) -> Column:
    """A relative path without ``.`` and ``..``; null where it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    folded = F.aggregate(
        parts,
        F.struct(start.alias("at"), F.lit(True).alias("ok")),
        lambda acc, p: F.when(
            p == "..",
            F.struct(F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["ok"] & (F.size(acc["at"]) > 0)).alias("ok")),
        ).otherwise(F.struct(F.concat(acc["at"], F.array(p)).alias("at"), acc["ok"].alias("ok"))),
    )
    return F.when(folded["ok"], F.array_join(folded["at"], "/"))


def _python_tried(path: Column, name: Column, level: Column) -> Column:
    """Dotted prefixes of an import as paths, deepest first, below the folder that its level names."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    base = F.when(level == 0, F.array().cast("array<string>")).otherwise(F.slice(folders, 1, F.greatest(F.size(folders) - level + 1, F.lit(0))))
    parts = F.filter(F.split(name, r"\."), lambda p: p != "")
    depth = F.sequence(F.size(parts), F.when(level == 0, F.lit(1)).otherwise(F.lit(0)), F.lit(-1))
    tried = F.transform(depth, lambda n: F.array_join(F.concat(base, F.slice(parts, F.lit(1), n)), "/"))
    return F.filter(F.when((F.size(parts) > 0) | (level > 0), tried).otherwise(F.array().cast("array<string>")), lambda p: p != "")


def imports(files: DataFrame, go_prefixes: DataFrame | None = None) -> DataFrame:
    """(repo, path, rank, target): places that each import may mean, best first.

    ``files`` has (repo, path, lang, text); ``go_prefixes`` (repo, prefix), one row per repository.
    """
    py = files.filter("lang = 'python'").select("repo", "path", F.posexplode(python_imports(F.col("text"))).alias("n", "i"))
    py = py.select("repo", "path", "n", F.posexplode(_python_tried(F.col("path"), F.col("i.name"), F.col("i.level"))).alias("rank", "target"))
    js = files.filter("lang in ('javascript', 'typescript', 'vue')").select("repo", "path", F.posexplode(js_imports(F.col("text"))).alias("n", "spec"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    js = js.filter("spec like '.%'").withColumn("base", normalized(F.concat_ws("/", folder, F.col("spec")))).filter("base is not null")
    tried = F.array(*(F.struct(F.concat("base", F.lit(e)).alias("target"), F.lit(False).alias("folder")) for e in JS_TRIED), F.struct(F.col("base").alias("target"), F.lit(True).alias("folder")))
    js = js.select("repo", "path", "n", F.posexplode(tried).alias("rank", "t")).select("repo", "path", "n", "rank", "t.*")
    made = py.withColumns({"kind": F.lit("python"), "folder": F.lit(None).cast("boolean")}).unionByName(js.withColumn("kind", F.lit("js")))
    if go_prefixes is not None:
        go = files.filter("lang = 'go'").select("repo", "path", F.posexplode(go_imports(F.col("text"))).alias("n", "spec")).join(go_prefixes, "repo")
        go = go.filter((F.col("spec") == F.col("prefix")) | F.startswith("spec", F.concat("prefix", F.lit("/"))))
        rest = F.expr("substr(spec, length(prefix) + 2)")
        ways = F.array(F.struct(F.concat(rest, F.lit(".go")).alias("target"), F.lit(False).alias("folder")), F.struct(rest.alias("target"), F.lit(True).alias("folder")))
        go = go.select("repo", "path", "n", F.posexplode(ways).alias("rank", "t"), F.lit("go").alias("kind")).select("repo", "path", "n", "rank", "t.*", "kind")
        made = made.unionByName(go.filter("target != '.go'"))
    return made


def resolved(tried: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo, path, n, kind, module): the module that each import means; unresolved ones are left out.

    A place is a file or a folder that holds one, at any depth; for Python also
    a file without its ending, which goes before a folder of that name.  For
    the others ``folder`` says which of the two a try means.  Equi-joins with
    the set of places, then the best rank.
    """
    folders = paths.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))).alias("target"))
    folders = folders.filter("target != ''").distinct().select("repo", "target", F.col("target").alias("at"), F.lit(True).alias("is_folder"), F.lit(False).alias("stem"))
    plain = paths.select("repo", F.col("path").alias("target"), F.col("path").alias("at"), F.lit(False).alias("is_folder"), F.lit(False).alias("stem"))
    stems = paths.filter("path like '%.py'").select("repo", F.expr("left(path, length(path) - 3)").alias("target"), F.col("path").alias("at"), F.lit(False).alias("is_folder"), F.lit(True).alias("stem"))
    hit = tried.filter("target != ''").join(plain.unionByName(stems).unionByName(folders), ["repo", "target"])
    hit = hit.filter(F.when(F.col("kind") == "python", F.col("stem") | F.col("is_folder")).otherwise(~F.col("stem") & (F.col("folder") == F.col("is_folder"))))
    root = tried.filter("target = '' and kind = 'go'").select("repo", "target", "path", "n", "rank", "kind", "folder", F.lit("").alias("at"), F.lit(True).alias("is_folder"), F.lit(False).alias("stem"))
    best = hit.unionByName(root).groupBy("repo", "path", "n", "kind").agg(F.min_by(F.struct("at", "is_folder"), F.struct("rank", "is_folder", "at")).alias("b"))
    # A folder is its own first segment even at the top, where a file is in the root.
    top = F.when(F.col("b.at") == "", "(root)").when(F.col("b.is_folder"), F.substring_index("b.at", "/", 1)).otherwise(module_of(F.col("b.at")))
    return best.select("repo", "path", "n", "kind", top.alias("module"))


def edge_weights(links: DataFrame, by: list[str], source: str, target: str) -> DataFrame:
    """Weights of edges between different nodes."""
    return links.filter(F.col(source) != F.col(target)).groupBy(*by, F.col(source).alias("source"), F.col(target).alias("target")).agg(F.count("*").alias("weight"))


def cohesion(links: DataFrame, by: list[str], source: str, target: str) -> DataFrame:
    """Share of links that stay within their node, to two decimals; nodes without links have no row."""
    same = F.count_if(F.col(source) == F.col(target))
    return links.groupBy(*by, F.col(source).alias("node")).agg(F.bround(same / F.count("*"), 2).alias("cohesion"))


def module_graph(files: DataFrame, go_prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Modules (repo, module, files, cohesion) and edges (repo, source, target, weight)."""
    links = resolved(imports(files, go_prefixes), files.select("repo", "path")).withColumn("source", module_of(F.col("path")))
    tight = cohesion(links, ["repo"], "source", "module").withColumnRenamed("node", "module")
    modules = files.groupBy("repo", module_of(F.col("path")).alias("module")).agg(F.count("*").alias("files")).join(tight, ["repo", "module"], "left")
    return modules, edge_weights(links, ["repo"], "source", "module")
