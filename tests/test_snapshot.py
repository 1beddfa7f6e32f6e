"""The snapshot of working trees: numbers known from how the trees are made."""

from __future__ import annotations

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from repolith.operators import declared, files, graph, modules
from repolith.plans import profile as P
from repolith.rules import tables
from repolith.sources.gitlog import head, read_gitlog
from repolith.sources.tree import read_tree


@pytest.fixture(scope="module")
def rows(spark, depot, traders, clinic):
    made = P.profile(read_tree(spark, depot, traders, clinic))
    return {r["repo"]: r.asDict(recursive=True) for r in made.collect()}


def test_languages_and_structure(rows):
    r = rows["depot"]
    assert (r["total_files"], r["total_loc"]) == (12, 81)
    assert {x["name"]: (x["files"], x["loc"], x["pct"]) for x in r["languages"]} == {
        "rust": (2, 50, 61.7), "python": (1, 25, 30.9), "shell": (1, 3, 3.7), "vue": (1, 2, 2.5), "sql": (1, 1, 1.2)
    }
    assert [(x["dir"], x["files"], x["role"]) for x in r["top_level_dirs"]] == [("engine", 2, "guessed-entry"), ("report", 2, None), ("screen", 2, "guessed-frontend"), ("plans", 1, None), ("(root)", 5, None)]
    assert [w["code"] for w in r["warnings"]] == ["MIXED_MONOREPO"]
    assert r["config_files"] == ["Cargo.toml", "LICENSE", "pyproject.toml"]
    assert [(x["name"], x["version"], x["risk"]) for x in r["external"]] == [("Django", "==2.2.28", "HIGH"), ("httpx", ">=0.27", None)]
    assert [(x["path"], x["loc"]) for x in r["largest_files"]][:2] == [("engine/main.rs", 37), ("report/totals.py", 25)]
    assert [f["name"] for f in r["frameworks"]] == ["Django"]


def test_size_cap(spark, depot):
    tree = read_tree(spark, depot, max_file_bytes=300)
    code = files.prepared(tree, 300)
    got = {r["name"]: (r["files"], r["loc"]) for r in files.language_stats(code, ["repo"], "lang", F.col("loc")).collect()}
    assert got["rust"] == (2, 13)
    assert sorted(r["path"] for r in code.filter("too_big").collect()) == ["engine/main.rs", "report/totals.py"]


def test_modules_and_entry_points(rows):
    r = rows["traders"]
    edges = {(e["source"], e["target"]): e["weight"] for e in r["internal"]}
    assert edges == {
        ("gate", "ledger"): 1,  # a folder
        ("gate", "(root)"): 1,  # quotes.go goes before quotes/
        ("quotes", "(root)"): 1,  # the prefix alone
        ("(root)", "risk"): 2,
        ("tools", "(root)"): 1,  # format.ts goes before format/
        ("tools", "format"): 1,
        ("web", "format"): 1,
    }
    tight = {m["module"]: (m["files"], m["cohesion"]) for m in r["modules"]}
    assert tight == {"(root)": (3, 0.0), "gate": (1, 0.0), "ledger": (1, None), "quotes": (1, 0.0), "risk": (3, 1.0), "tools": (2, 0.33), "format": (1, None), "web": (1, 0.0)}
    assert [(e["path"], e["type"], e["confidence"]) for e in r["entry_points"]] == [("gate/main.go", "cli", 0.9), ("tools/quote.js", "cli", 0.85), ("desk.py", "cli", 0.8), ("desk.py", "server", 0.8)]
    assert [(x["name"], x["version"], x["kind"], x["risk"]) for x in r["external"]] == [
        ("jest", "^29.0.0", "dev", None), ("github.com/gin-gonic/gin", "v1.9.1", "runtime", None), ("gorm.io/gorm", "v1.25.0", "runtime", None), ("koa", "^2.15", "runtime", None), ("react", "17.0.2", "runtime", "HIGH")
    ]
    assert {(f["name"], f["version"]) for f in r["frameworks"]} == {("Gin", "v1.9.1"), ("GORM", "v1.25.0"), ("Koa", "^2.15"), ("React", "17.0.2"), ("Jest", "^29.0.0"), ("Flask", None)}
    assert r["build_run"]["build_system"] == ["node", "go-modules"]
    assert r["build_run"]["install_cmd"] == ["yarn install", "go mod download"]
    assert r["build_run"]["dev_cmd"] == ["yarn run start", "go run ./gate"]


def test_quality_and_commands(rows):
    r = rows["clinic"]
    assert [(h["path"], h["signal"]) for h in r["complexity_hotspots"]] == [
        ("ward.py", "long-file loc=428"), ("ward.py", "deep-nesting indent=24"), ("ward.py", "cognitive-complexity max=21 fn=triage over=1")
    ]
    assert r["todos"] == {"todo": 2, "fixme": 1}
    assert r["test_evidence"] == {"test_files": 1, "ratio": 0.2, "frameworks": ["pytest"]}
    got = r["build_run"]
    assert got["build_system"] == ["node", "python", "make"] and got["confidence"] == 0.9
    assert got["install_cmd"] == ["npm install", "pip install -r requirements.txt", "poetry install", "make INSTALL"]
    assert got["dev_cmd"] == ["npm run dev"]
    assert got["test_cmd"] == ["npm run test", "pytest", "@pytest -q", "tox -e test"]
    assert got["evidence"] == ["Makefile:install", "Makefile:test", "default", "lock file or manifest: package-lock.json", "package.json scripts.dev: vite", "package.json scripts.test: vitest run"]
    assert {x["name"]: x["version"] for x in r["external"]} == {"sqlalchemy": "~=2.0", "pytest": "==7.4", "requests": None}
    assert {(v["source"], v["target"], v["severity"]) for v in r["layer_violations"]} == {("VisitController", "VisitDao", "HIGH")}


def test_function_scores(spark):
    js = """export async function load(a) {
  if (a) { return 1 }
  for (const x of a) {
    if (x) { go() }
  }
}
class Box {
  open(a) {
    switch (a) { case 1: break }
  }
  if (x) {
}
const late = (a) => { if (a) { while (a) {} } }
function one() { if (1) {} }
"""
    go = "func (b *Box) Open(a int) {\n\tfor a > 0 {\n\t\tif a {\n\t\t}\n\t}\n}\nfunc Close() {\n}\n"
    py = "def a():\n    if x:\n        if y:\n            pass\n\n    return 1\nif z: pass\nclass C:\n    def b(self): return 1\n    def c(self):\n        for i in j: pass"
    want = {"javascript": ("load", 6), "go": ("Open", 3), "python": ("a", 3)}
    for lang, text in (("javascript", js), ("go", go), ("python", py)):
        df = spark.createDataFrame([("r", "p", lang, text)], "repo string, path string, lang string, text string")
        got = files.complexity(df, 1).first()
        assert (got["name"], got["score"]) == want[lang], lang
    empty = spark.createDataFrame([("r", "p", "go", ""), ("r", "q", "python", None), ("r", "s", "rust", "fn a() {}")], "repo string, path string, lang string, text string")
    assert files.complexity(empty, 1).count() == 0 and files.complexity(df.limit(0), 1).count() == 0


def test_profile_json(spark, depot):
    doc = json.loads(P.to_json(P.profile(read_tree(spark, depot))).first()["json"])
    assert doc["schemaVersion"] == "1.0" and doc["totalFiles"] == 12 and doc["layerViolations"] is None


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g"), ("h", "a")], "source string, target string")
    got = {r["node"]: r["component"] for r in graph.cycles(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert [r["node"] for r in graph.self_loops(edges).collect()] == ["g"]
    assert graph.cycles(edges.limit(0)).count() == 0


def test_cycles_of_many_graphs(spark):
    r = random.Random(4)
    edges = [(g, f"n{r.randint(0, 25)}", f"n{r.randint(0, 25)}") for g in "abcdef" for _ in range(r.randint(10, 45))] + [("deep", f"x{i}", f"x{i + 1}") for i in range(9)] + [("deep", "x9", "x0"), (None, "n1", "n2"), ("a", None, "n1")]
    reach = {}
    for g in {g for g, *_ in edges if g}:
        own = {(a, b) for h, a, b in edges if h == g and a and b}
        nodes = {x for e in own for x in e}
        seen = {n: {n} for n in nodes}
        for n in nodes:
            todo = [n]
            while todo:
                x = todo.pop()
                for a, b in own:
                    if a == x and b not in seen[n]:
                        seen[n].add(b)
                        todo.append(b)
        reach |= {(g, n): min(m for m in nodes if m in seen[n] and n in seen[m]) for n in nodes if any(m != n and n in seen[m] for m in seen[n])}
    df = spark.createDataFrame(edges, "component string, source string, target string")
    for one_task in (1_000, 30):
        got = {(x["g"], x["node"]): x["component"] for x in graph.cycles_of_each(df.withColumnRenamed("component", "g"), "g", one_task).collect()}
        assert got == reach
    assert list(graph.strong_components([(f"y{i}", f"y{i + 1}") for i in range(50_000)] + [("y50000", "y0")]))[0].__len__() == 50_001


def test_maven_and_versions(spark):
    pom = """<project><parent><version>9</version></parent><version>1.2.3</version>
<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>managed</artifactId><version>1</version></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot</artifactId><version>2.5.14</version></dependency>
<dependency><groupId>g</groupId><artifactId>x</artifactId></dependency><dependency><groupId>g</groupId><artifactId>x</artifactId></dependency></dependencies></project>"""
    tree = spark.createDataFrame([("r", "pom.xml", bytearray(pom.encode()))], "repo string, path string, content binary")
    got = {r["name"]: (r["version"], r["risk"]) for r in declared.external(declared.declared(tree)).collect()}
    assert got == {"org.springframework.boot:spring-boot": ("2.5.14", "HIGH"), "g:x": ("1.2.3", None)}


def test_import_forms(spark):
    text = "from . import a\nfrom ..b.c import d\nimport os, sys\n    from über.x import y\n"
    r = spark.range(1).select(modules.python_imports(F.lit(text)).alias("i")).first()["i"]
    assert [(x["name"], x["level"]) for x in r] == [("", 1), ("b.c", 2), ("über.x", 0), ("os", 0), ("sys", 0)]
    js = spark.range(1).select(modules.js_imports(F.lit("import x from './a'\nrequire('b'); import('c')\nexport * from \"d\"")).alias("i")).first()["i"]
    assert sorted(js) == ["./a", "b", "c", "d"]


def test_git_log(spark, tmp_path):
    env = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x", "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}
    root = tmp_path / "g"
    root.mkdir()
    run = lambda *a, **e: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, env=env | e)
    run("init", "-q", "-b", "main")
    for day, text in (("2026-06-15", "a\n"), ("2026-08-20", "a\nb\nc\n")):
        (root / "f.txt").write_text(text)
        run("add", "-A")
        run("commit", "-qm", f"change {day}", GIT_AUTHOR_DATE=f"{day}T10:00:00+00:00", GIT_COMMITTER_DATE=f"{day}T10:00:00+00:00")
    got = [(r["ord"], r["at"][:10], r["path"], r["added"], r["removed"]) for r in read_gitlog(spark, str(root)).orderBy("ord").collect()]
    assert got == [(0, "2026-08-20", "f.txt", 2, 0), (1, "2026-06-15", "f.txt", 1, 0)]
    assert head(str(root)) == {"head_branch": "main", "branch_count": 1, "tag_count": 0}
    assert head(str(tmp_path / "none"))["head_branch"] is None


def test_rules_are_sound():
    assert tables.faults() == []


def test_missing_root(spark, tmp_path):
    with pytest.raises(Exception, match="NotADirectory|none"):
        read_tree(spark, str(tmp_path / "none")).count()
