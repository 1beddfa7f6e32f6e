"""Queries of the snapshot operators over working trees made of the tables, and their SQL.

The tables hold no source files, so trees are made of what they do hold:
manifests of declared dependencies, source files of the module links that
documents mention, functions as deep as commits are wide, and for every
repository the files of its language.  The operators read these trees as they
read any other; the SQL knows the results from the tables and writes every rule
value out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.operators import commands, declared, files, graph, modules
from repolith.plans.files import DOCS, docs_of
from repolith.plans.history import COMMITS, commits_of
from repolith.plans.profile import config_files, warnings
from repolith.session import pin
from repolith.storage import table


def as_tree(rows: DataFrame) -> DataFrame:
    """(repo, path, size, content, error) from (repo, path, text)."""
    content = F.col("text").cast("binary")
    return rows.select("repo", "path", F.octet_length("text").cast("long").alias("size"), content.alias("content"), F.lit(False).alias("error"))


def dependencies_of(spark: SparkSession, d: str) -> DataFrame:
    """(repo, kind, name, version): one row for each name as written, but for blanks around it."""
    rows = table(pin(spark), d, "dependencies").select(F.col("repo_id").alias("repo"), "kind", F.trim("name").alias("name"), "version")
    rows = rows.filter("repo is not null and kind in ('runtime', 'dev') and name rlike '^[^ \\t\\r\\n\"<>&]+$'")
    return rows.groupBy("repo", "kind", "name").agg(F.min("version").alias("version"))


def manifests(spark: SparkSession, d: str) -> DataFrame:
    """Trees ``npm:``, ``pip:``, ``go:`` and ``mvn:`` of each repository, with one manifest of its dependencies each."""
    deps = dependencies_of(spark, d)
    version = F.coalesce("version", F.lit(""))
    own = F.when(F.col("version").rlike("^[<>=!~^]"), F.col("version")).when(F.col("version").isNotNull(), F.concat(F.lit("=="), "version")).otherwise("")
    number = F.regexp_extract("version", r"[0-9]+(?:\.[0-9]+)*", 0)
    tagged = F.concat(F.lit(" v"), F.when(number != "", number).otherwise("0.0.0"))
    xml = F.concat(F.lit("<dependency><groupId>org.test</groupId><artifactId>"), "name", F.lit("</artifactId>"), F.when(F.col("version").isNotNull(), F.concat(F.lit("<version>"), F.replace(F.col("version"), F.lit("<"), F.lit("&lt;")), F.lit("</version>"))).otherwise(""), F.lit("</dependency>"))

    def lines(kind: str, line: Column) -> Column:
        """The lines of one kind of dependency, by name."""
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", line.alias("line"))))), lambda s: s["line"])

    def pairs(kind: str) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", version.alias("version"))))))

    whole = deps.groupBy("repo").agg(
        F.to_json(F.struct(pairs("runtime").alias("dependencies"), pairs("dev").alias("devDependencies"))).alias("npm"),
        F.array_join(lines("runtime", F.concat("name", F.lit("[extra] "), own, F.lit(" ; python_version > '3' # why"))), "\n").alias("pip"),
        F.concat(
            F.lit("module x.test/y\n\nrequire (\n"), F.array_join(lines("runtime", F.concat(F.lit("\tpkg.test/"), "name", tagged, F.lit(" // indirect"))), "\n"), F.lit("\n)\n"),
            F.array_join(lines("dev", F.concat(F.lit("require pkg.test/"), "name", tagged)), "\n"),
        ).alias("go"),
        F.concat(
            F.lit('<project xmlns="http://m.test"><parent><version>1</version></parent><version>9.9</version><dependencyManagement><dependencies><dependency><groupId>no</groupId><artifactId>no</artifactId></dependency></dependencies></dependencyManagement><dependencies>'),
            F.array_join(lines("runtime", xml), ""), F.lit("</dependencies></project>"),
        ).alias("mvn"),
    )
    of = {"npm": "package.json", "pip": "requirements.txt", "go": "go.mod", "mvn": "pom.xml"}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("path"), F.col(k).alias("text")) for k, p in of.items())))
    return as_tree(whole.select("repo", each.alias("m")).select(F.concat_ws(":", "m.kind", "repo").alias("repo"), "m.path", "m.text"))


def manifests_declared(spark, d):
    return declared.declared(manifests(spark, d))


def external_risk(spark, d):
    """Risk of packages that rules know, at versions made of the numbers of repositories; a tree for each version."""
    rows = table(pin(spark), d, "repos").select("stars", "forks").distinct()
    number = F.concat(F.substring(F.col("stars").cast("string"), 1, 2), F.lit("."), F.substring(F.col("forks").cast("string"), 1, 1), F.lit(".1"))
    rows = rows.select(number.alias("v")).filter("v is not null").distinct()
    npm = F.format_string('{"dependencies": {"vue": "^%s", "react": "%s", "Node": "v%s", "vuex": "%s"}}', "v", "v", "v", "v")
    pip = F.format_string("Django==%s\npython>=%s\n", "v", "v")
    mvn = F.concat(F.lit("<project>"), *(F.format_string(f"<dependency><groupId>org.springframework{g}</groupId><artifactId>{a}</artifactId><version>%s</version></dependency>", "v") for g, a in ((".boot", "spring-boot-starter"), ("", "spring-core"))), F.lit("</project>"))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("path"), t.alias("text")) for p, t in (("package.json", npm), ("requirements.txt", pip), ("pom.xml", mvn)))))
    tree = as_tree(rows.select(F.col("v").alias("repo"), each.alias("m")).select("repo", "m.*"))
    return declared.external(declared.declared(tree)).select("repo", "name", "version", "risk")


#: Files of a repository by its language.
FILES = {
    "Python": {
        "requirements.txt": "fastapi==0.1\nSQLAlchemy>=2\npytest\n",
        "app.py": "from fastapi import FastAPI\n\napp = FastAPI()\nif __name__ == '__main__':\n    app.run()\n",
        "tests/test_app.py": "if __name__:\n    pass\n",
    },
    "TypeScript": {
        "package.json": '{"bin": {"t": "./bin/t.ts"}, "scripts": {"dev": "vite", "test": "vitest"}, "dependencies": {"vue": "^2.6.1", "koa": "2"}, "devDependencies": {"vitest": "1"}}',
        "src/main.ts": "createApp({})\n",
        "bin/t.ts": "new BrowserWindow()\n",
        "go.work": "",
    },
    "Go": {"go.mod": "module t\n\nrequire github.com/gin-gonic/gin v1.9.1\n", "cmd/run/main.go": "package main\n\nfunc main() {\n}\n", "cmd/run/main_test.go": "package main\n"},
    "Java": {"pom.xml": "<project><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-web</artifactId><version>2.5.14</version></dependency></project>", "src/A.java": "class A {\n}\n"},
    "Vue": {"package.json": '{"scripts": {"start": "x"}}'},
    "Shell": {"Makefile": "install:\n\tsh setup.sh && echo done\ntest: # all\n\t# first\n\tsh check.sh\n", "run": "#!/usr/bin/env bash\necho\n", ".github/workflows/ci.yml": "steps:\n  - run: apt install x\n  - run: sh tests.sh\n"},
    "Rust": {"Cargo.toml": "[package]\n", "src/main.rs": "fn main() {}\n", "README.md": "# r\n", "requirements.txt": "flask\n"},
}


def working_trees(spark: SparkSession, d: str) -> DataFrame:
    """A tree for each repository with a language; those in Vue have a component for each number of an issue."""
    repos = table(pin(spark), d, "repos").filter("id is not null").groupBy(F.col("id").alias("repo")).agg(F.max("primary_language").alias("language"))
    kinds = spark.createDataFrame([(lang, p, t) for lang, fs in FILES.items() for p, t in fs.items()], "language string, path string, text string")
    fixed = repos.join(F.broadcast(kinds), "language").select("repo", "path", "text")
    issues = table(spark, d, "issues").filter("number is not null").select(F.col("repo_id").alias("repo"), "number").distinct()
    parts = repos.filter("language = 'Vue'").join(issues, "repo").select("repo", F.concat(F.lit("web/p"), F.col("number").cast("string"), F.lit(".vue")).alias("path"), F.lit("<template/>\n").alias("text"))
    return as_tree(fixed.unionByName(parts))


def frameworks_found(spark, d):
    tree = working_trees(spark, d)
    made = declared.frameworks(files.prepared(tree), declared.declared(tree))
    return made.select("repo", "name", "version", "category", "confidence", F.get("evidence", F.lit(0)).alias("evidence"))


def entry_points(spark, d):
    tree = working_trees(spark, d)
    return declared.entry_points(files.prepared(tree), tree).select("repo", "path", "type", "confidence", "evidence")


def build_commands(spark, d):
    made = commands.build_run(working_trees(spark, d))
    return made.select("repo", "confidence", *(F.array_join(c, " | ").alias(c) for c in ("build_system", "install_cmd", "dev_cmd", "test_cmd", "evidence")))


def snapshot_facts(spark, d):
    """Files, lines, manifests, ecosystems and warnings of each tree."""
    tree = working_trees(spark, d)
    code = files.prepared(tree)
    sums = code.groupBy("repo").agg(F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"), F.count_if("too_big").alias("too_big"))
    made = warnings(config_files(tree).join(sums, "repo"))
    codes = F.array_join(F.transform("warnings", lambda w: w["code"]), " ")
    return made.select("repo", "total_files", "total_loc", F.array_join("config_files", " ").alias("config_files"), F.array_join("ecosystems", " ").alias("ecosystems"), codes.alias("warnings"))


def tree_languages(spark, d):
    made = files.language_stats(files.prepared(working_trees(spark, d)), ["repo"], "lang", F.col("loc"))
    return made.select("repo", "name", "files", "loc", "pct")


def top_dirs(spark, d):
    return files.top_dirs(files.prepared(working_trees(spark, d)), ["repo"])


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """(repo, doc, n, a, b): "Module a depends on b" in the texts, the n-th of its document."""
    said = F.posexplode(F.regexp_extract_all("text", F.lit(r"Module ([a-z]+ depends on [a-z]+)"), F.lit(1)))
    rows = docs_of(spark, d).filter("repo is not null").select("repo", F.col("doc_id").alias("doc"), said.alias("n", "s"))
    return rows.select("repo", "doc", "n", F.split("s", " ").getItem(0).alias("a"), F.split("s", " ").getItem(3).alias("b"))


def linked_trees(spark: SparkSession, d: str) -> DataFrame:
    """Trees ``py:``, ``js:`` and ``go:`` of each repository, in which a file of a document imports what its modules depend on.

    In ``js:`` there is a file beside each module that is depended on and whose
    name begins with n or a later letter.
    """
    rows = mentions(spark, d)
    b = F.col("b")
    py = F.when(b < "m", F.concat(F.lit("from ..."), b, F.lit(" import run"))).otherwise(F.concat(F.lit("import "), b, F.lit(".core.deep as c, os")))
    js = F.when(b < "g", F.concat(F.lit("import {\n x } from '../"), b, F.lit("'"))).otherwise(F.concat(F.lit('const y = require("./../'), b, F.lit('")')))
    go = F.concat(F.lit('\tq "mod.test/x/'), b, F.lit('"'))
    text = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("n", c.alias("line")))), lambda s: s["line"])
    per = rows.groupBy("repo", "doc", "a").agg(F.array_join(text(py), "\n").alias("py"), F.array_join(text(js), ";\n").alias("js"), F.array_join(text(go), "\n").alias("go"))
    path = lambda folder, ext: F.concat(folder, F.lit("m"), F.col("doc").cast("string"), F.lit(ext))
    inner, flat = F.concat("a", F.lit("/in/")), F.concat("a", F.lit("/"))
    go_text = F.concat(F.lit('package a\n\nimport "fmt"\nimport (\n'), "go", F.lit("\n)\n"))
    trees = [
        per.select(F.concat(F.lit("py:"), "repo").alias("repo"), path(inner, ".py").alias("path"), F.concat("py", F.lit("\n")).alias("text")),
        per.select(F.concat(F.lit("js:"), "repo").alias("repo"), path(flat, ".js").alias("path"), F.col("js").alias("text")),
        per.select(F.concat(F.lit("go:"), "repo").alias("repo"), path(flat, ".go").alias("path"), go_text.alias("text")),
        rows.filter("b >= 'n'").select(F.concat(F.lit("js:"), "repo").alias("repo"), F.concat("b", F.lit(".ts")).alias("path"), F.lit("export const y = 1\n").alias("text")).distinct(),
        rows.select(F.concat(F.lit("go:"), "repo").alias("repo"), F.lit("go.mod").alias("path"), F.lit("module mod.test/x\n").alias("text")).distinct(),
    ]
    made = trees[0]
    for t in trees[1:]:
        made = made.unionByName(t)
    return as_tree(made)


def _graph(spark, d):
    tree = linked_trees(spark, d)
    prefixes = tree.filter("path = 'go.mod'").select("repo", F.regexp_extract(F.col("content").cast("string"), r"(?m)^module\s+(\S+)", 1).alias("prefix"))
    return modules.module_graph(files.prepared(tree).filter("lang is not null"), prefixes)


def module_edges(spark, d):
    return _graph(spark, d)[1]


def module_nodes(spark, d):
    return _graph(spark, d)[0]


def called_trees(spark: SparkSession, d: str) -> DataFrame:
    """A Python file for each module of a repository: a controller that calls the stores of the modules it depends on, and a store."""
    rows = mentions(spark, d).select("repo", "a", "b").distinct()
    calls = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("        "), "b", F.lit("_Store()")))), "\n")
    per = rows.groupBy("repo", "a").agg(calls.alias("calls"))
    text = F.concat(F.lit("class "), "a", F.lit("Controller:\n    def get(self):\n"), "calls", F.lit("\n\n\nclass "), "a", F.lit("Store:\n    pass\n"))
    return as_tree(per.select("repo", F.concat("a", F.lit(".py")).alias("path"), text.alias("text")))


def _calls(spark, d):
    return graph.call_graph(graph.symbols(files.prepared(called_trees(spark, d))))


def call_edges(spark, d):
    return _calls(spark, d)[1]


def call_layers(spark, d):
    nodes, edges = _calls(spark, d)
    at = lambda c: F.concat_ws(" ", "repo", c)
    made = graph.layer_violations(nodes.select(at("node").alias("node"), "type"), edges.select(at("source").alias("source"), at("target").alias("target")))
    return made.select("source", "target", "source_type", "target_type", "severity")


def code_signals(spark, d):
    """Quality signals of a Python file for each commit, with a function nested as deep as the commit changed files."""
    rows = commits_of(spark, d).filter("files_changed >= 1").select(F.concat_ws("@", "repo_id", "sha").alias("repo"), F.least("files_changed", F.lit(60)).cast("int").alias("k"))
    ifs = F.array_join(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.concat(F.repeat(F.lit("    "), i), F.lit("if x:"))), "\n")
    text = F.concat(F.lit("def f(x):\n"), ifs, F.lit("\n"), F.repeat(F.lit("    "), F.col("k") + 1), F.lit("pass\n"))
    return files.hotspots(files.prepared(as_tree(rows.select("repo", F.lit("a.py").alias("path"), text.alias("text"))))).select("repo", "n", "signal")


QUERIES = {
    f.__name__: f
    for f in (
        manifests_declared, external_risk, frameworks_found, entry_points, build_commands, snapshot_facts, tree_languages, top_dirs, module_edges, module_nodes,
        call_edges, call_layers, code_signals,
    )
}

DEPS = """d AS (SELECT repo_id AS repo, kind, trim(name, ' ') AS name, min(version) AS version FROM dependencies
  WHERE repo_id IS NOT NULL AND kind IN ('runtime', 'dev') AND regexp_matches(trim(name, ' '), '^[^ \\t\\r\\n"<>&]+$') GROUP BY ALL),
x AS (SELECT *, CASE WHEN regexp_matches(version, '^[<>=!~^]') THEN version WHEN version IS NOT NULL THEN '==' || version END AS own,
  'v' || coalesce(nullif(regexp_extract(version, '[0-9]+(?:\\.[0-9]+)*'), ''), '0.0.0') AS tag FROM d)"""
TREES = "g AS (SELECT id AS repo, max(primary_language) AS language FROM repos WHERE id IS NOT NULL GROUP BY 1)"
VUE = "v AS (SELECT g.repo, count(DISTINCT number) AS n FROM g JOIN issues i ON i.repo_id = g.repo WHERE language = 'Vue' AND number IS NOT NULL GROUP BY 1)"
SAID = DOCS + """, m AS (SELECT repo, doc_id AS doc, split_part(s, ' ', 1) AS a, split_part(s, ' ', 4) AS b
  FROM (SELECT repo, doc_id, unnest(regexp_extract_all(text, 'Module ([a-z]+ depends on [a-z]+)', 1)) AS s FROM d WHERE repo IS NOT NULL)),
s AS (SELECT DISTINCT repo, a FROM m)"""
LINKED = SAID + """,
l AS (
  SELECT 'py:' || m.repo AS repo, m.a AS source, m.b AS target FROM m JOIN s ON s.repo = m.repo AND s.a = m.b
  UNION ALL SELECT 'js:' || m.repo, m.a, CASE WHEN m.b >= 'n' THEN '(root)' ELSE m.b END FROM m LEFT JOIN s ON s.repo = m.repo AND s.a = m.b WHERE m.b >= 'n' OR s.a IS NOT NULL
  UNION ALL SELECT 'go:' || m.repo, m.a, m.b FROM m JOIN s ON s.repo = m.repo AND s.a = m.b),
f AS (
  SELECT DISTINCT p || ':' || repo AS repo, a AS module, doc::VARCHAR AS file FROM m, (VALUES ('py'), ('js'), ('go')) k(p)
  UNION SELECT 'js:' || repo, '(root)', b FROM m WHERE b >= 'n')"""
LAYER = """CASE WHEN contains({0}, 'controller') OR contains({0}, 'view') OR contains({0}, 'api') THEN 'CONTROLLER' WHEN contains({0}, 'service') THEN 'SERVICE'
  WHEN contains({0}, 'repository') OR contains({0}, 'repos') OR contains({0}, 'dao') OR contains({0}, 'mapper') OR contains({0}, 'store') THEN 'REPOSITORY'
  WHEN contains({0}, 'entity') OR contains({0}, 'model') OR contains({0}, 'domain') OR contains({0}, 'dto') OR contains({0}, 'vo') OR contains({0}, 'po') OR contains({0}, 'schema') THEN 'ENTITY'
  WHEN contains({0}, 'util') OR contains({0}, 'helper') OR contains({0}, 'common') OR contains({0}, 'support') OR contains({0}, 'config') THEN 'UTIL' ELSE 'OTHER' END"""
CALLS = SAID + """, e AS (SELECT DISTINCT m.repo, m.a || 'Controller' AS source, m.b || 'Store' AS target, m.a AS sa, m.b AS sb FROM m JOIN s ON s.repo = m.repo AND s.a = m.b)"""

SQL = {
    "manifests_declared": f"""WITH {DEPS}, r AS (
  SELECT 'npm:' || repo AS repo, name, nullif(trim(version, ' '), '') AS version, kind, 'package.json' AS source, kind = 'dev' AS late FROM x
  UNION ALL SELECT 'pip:' || repo, name, own, 'runtime', 'requirements.txt', false FROM x WHERE kind = 'runtime' AND regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._-]*')
  UNION ALL SELECT 'go:' || repo, 'pkg.test/' || name, tag, 'runtime', 'go.mod', kind = 'dev' FROM x
  UNION ALL SELECT 'mvn:' || repo, 'org.test:' || name, coalesce(nullif(trim(version, ' '), ''), '9.9'), 'runtime', 'pom.xml', false FROM x WHERE kind = 'runtime')
SELECT repo, lower(name) AS key, name, version, kind, source FROM r QUALIFY row_number() OVER (PARTITION BY repo, lower(name) ORDER BY late, name) = 1""",
    "external_risk": """WITH v AS (SELECT DISTINCT substr(stars::VARCHAR, 1, 2) || '.' || substr(forks::VARCHAR, 1, 1) || '.1' AS v FROM repos WHERE stars IS NOT NULL AND forks IS NOT NULL)
SELECT v AS repo, 'vue' AS name, '^' || v AS version, CASE WHEN starts_with(v, '2.') THEN 'HIGH' END AS risk FROM v
UNION ALL SELECT v, 'react', v, CASE WHEN starts_with(v, '16.') OR starts_with(v, '17.') THEN 'HIGH' END FROM v
UNION ALL SELECT v, 'Node', 'v' || v, CASE WHEN starts_with(v, '14.') OR starts_with(v, '16.') OR starts_with(v, '17.') THEN 'HIGH' END FROM v
UNION ALL SELECT v, 'vuex', v, NULL FROM v
UNION ALL SELECT v, 'Django', '==' || v, CASE WHEN starts_with(v, '2.') THEN 'HIGH' END FROM v
UNION ALL SELECT v, 'python', '>=' || v, CASE WHEN starts_with(v, '3.7') OR starts_with(v, '3.8') THEN 'HIGH' END FROM v
UNION ALL SELECT v, 'org.springframework.boot:spring-boot-starter', v, CASE WHEN starts_with(v, '2.5.') OR starts_with(v, '2.6.') OR starts_with(v, '2.7.') THEN 'HIGH' END FROM v
UNION ALL SELECT v, 'org.springframework:spring-core', v, CASE WHEN starts_with(v, '5.3.') THEN 'HIGH' END FROM v""",
    "frameworks_found": f"""WITH {TREES}, {VUE}, k(language, name, version, category, confidence, evidence) AS (VALUES
  ('Python', 'FastAPI', '==0.1', 'web-framework', 0.9::DOUBLE, 'declared: requirements.txt:fastapi@==0.1'),
  ('Python', 'SQLAlchemy', '>=2', 'orm', 0.85, 'declared: requirements.txt:sqlalchemy@>=2'),
  ('Python', 'Pytest', NULL, 'testing', 0.85, 'declared: requirements.txt:pytest'),
  ('TypeScript', 'Vue', '^2.6.1', 'frontend-framework', 0.9, 'declared: package.json:vue@^2.6.1'),
  ('TypeScript', 'Koa', '2', 'web-framework', 0.8, 'declared: package.json:koa@2'),
  ('TypeScript', 'Vitest', '1', 'testing', 0.85, 'declared: package.json:vitest@1'),
  ('TypeScript', 'Electron', NULL, 'desktop-tool', 0.9, 'content: BrowserWindow'),
  ('Go', 'Gin', 'v1.9.1', 'web-framework', 0.9, 'declared: go.mod:github.com/gin-gonic/gin@v1.9.1'),
  ('Go', 'Go Test', NULL, 'testing', 0.7, 'glob **/*_test.go x1'),
  ('Java', 'Spring Boot', '2.5.14', 'web-framework', 0.9, 'declared: pom.xml:org.springframework.boot:spring-boot-starter-web@2.5.14'),
  ('Rust', 'Flask', NULL, 'web-framework', 0.85, 'declared: requirements.txt:flask'))
SELECT repo, name, version, category, confidence, evidence FROM g JOIN k USING (language)
UNION ALL SELECT repo, 'Vue', NULL, 'frontend-framework', 0.7, 'glob **/*.vue x' || n FROM v WHERE n >= 3""",
    "entry_points": f"""WITH {TREES}, k(language, path, type, confidence, evidence) AS (VALUES
  ('Python', 'app.py', 'cli', 0.8::DOUBLE, 'content: if __name__'), ('Python', 'app.py', 'server', 0.85, 'content: FastAPI('),
  ('TypeScript', 'src/main.ts', 'gui', 0.85, 'content: createApp('), ('TypeScript', 'bin/t.ts', 'gui', 0.9, 'content: BrowserWindow'),
  ('TypeScript', 'bin/t.ts', 'cli', 0.85, 'package.json bin -> ./bin/t.ts'), ('Go', 'cmd/run/main.go', 'cli', 0.9, 'content: package main & func main('))
SELECT repo, path, type, confidence, evidence FROM g JOIN k USING (language)""",
    "build_commands": f"""WITH {TREES}, k(language, confidence, build_system, install_cmd, dev_cmd, test_cmd, evidence) AS (VALUES
  ('Python', 0.9::DOUBLE, 'python', 'pip install -r requirements.txt', '', 'pytest', 'default'),
  ('TypeScript', 0.9, 'node', 'npm install', 'npm run dev', 'npm run test', 'lock file or manifest: package.json | package.json scripts.dev: vite | package.json scripts.test: vitest'),
  ('Go', 0.9, 'go-modules', 'go mod download', 'go run ./cmd/run', 'go test ./...', 'default'),
  ('Java', 0.5, '', '', '', '', ''),
  ('Vue', 0.9, 'node', 'npm install', 'npm run start', '', 'lock file or manifest: package.json | package.json scripts.start: x'),
  ('Shell', 0.5, 'make', 'sh setup.sh | apt install x', '', 'sh check.sh | sh tests.sh', 'Makefile:install | Makefile:test | workflow run:'),
  ('Rust', 0.9, 'python', 'pip install -r requirements.txt', '', 'pytest', 'default'))
SELECT repo, confidence, build_system, install_cmd, dev_cmd, test_cmd, evidence FROM g JOIN k USING (language)""",
    "snapshot_facts": f"""WITH {TREES}, {VUE}, k(language, files, loc, config_files, ecosystems, warnings) AS (VALUES
  ('Python', 3, 7, 'requirements.txt', 'python-ecosystem', ''), ('TypeScript', 4, 2, 'go.work package.json', 'node-ecosystem', 'MONOREPO_MARKERS'), ('Go', 3, 5, 'go.mod', 'go', ''),
  ('Java', 2, 2, 'pom.xml', 'java-ecosystem', ''), ('Vue', 1, 0, 'package.json', 'node-ecosystem', ''), ('Shell', 3, 2, 'Makefile', '', ''),
  ('Rust', 4, 1, 'Cargo.toml README.md requirements.txt', 'python-ecosystem rust-ecosystem', 'MIXED_MONOREPO'))
SELECT repo, files + coalesce(n, 0) AS total_files, loc + coalesce(n, 0) AS total_loc, config_files, ecosystems, warnings FROM g JOIN k USING (language) LEFT JOIN v USING (repo)""",
    "tree_languages": f"""WITH {TREES}, {VUE}, k(language, name, files, loc, pct) AS (VALUES
  ('Python', 'python', 2, 7, 100.0::DOUBLE), ('TypeScript', 'typescript', 2, 2, 100.0), ('Go', 'go', 2, 5, 100.0), ('Java', 'java', 1, 2, 100.0), ('Shell', 'shell', 1, 2, 100.0), ('Rust', 'rust', 1, 1, 100.0))
SELECT repo, name, files::BIGINT AS files, loc::BIGINT AS loc, pct FROM g JOIN k USING (language) UNION ALL SELECT repo, 'vue', n, n, 100.0 FROM v""",
    "top_dirs": f"""WITH {TREES}, {VUE}, k(language, dir, files, role) AS (VALUES
  ('Python', '(root)', 2, NULL), ('Python', 'tests', 1, NULL), ('TypeScript', '(root)', 2, NULL), ('TypeScript', 'src', 1, 'guessed-entry'), ('TypeScript', 'bin', 1, NULL),
  ('Go', '(root)', 1, NULL), ('Go', 'cmd', 2, 'guessed-entry'), ('Java', '(root)', 1, NULL), ('Java', 'src', 1, NULL), ('Vue', '(root)', 1, NULL),
  ('Shell', '(root)', 2, NULL), ('Shell', '.github', 1, NULL), ('Rust', '(root)', 3, NULL), ('Rust', 'src', 1, 'guessed-entry'))
SELECT repo, dir, files::BIGINT AS files, role FROM g JOIN k USING (language) UNION ALL SELECT repo, 'web', n, NULL FROM v""",
    "module_edges": f"WITH {LINKED} SELECT repo, source, target, count(*) AS weight FROM l WHERE source <> target GROUP BY ALL",
    "module_nodes": f"""WITH {LINKED}, n AS (SELECT repo, module, count(*) AS files FROM f GROUP BY ALL), c AS (SELECT repo, source AS module, round_even(count_if(source = target) / count(*), 2) AS cohesion FROM l GROUP BY ALL)
SELECT repo, module, files, cohesion FROM n LEFT JOIN c USING (repo, module)""",
    "call_edges": f"WITH {CALLS} SELECT repo, source, target FROM e",
    "call_layers": f"""WITH {CALLS}, t AS (SELECT repo || ' ' || source AS source, repo || ' ' || target AS target,
  {LAYER.format("lower(source || ' ' || sa || '.py')")} AS source_type, {LAYER.format("lower(target || ' ' || sb || '.py')")} AS target_type FROM e)
SELECT *, CASE WHEN source_type = 'CONTROLLER' AND target_type = 'REPOSITORY' THEN 'HIGH' WHEN target_type = 'ENTITY' AND source_type IN ('CONTROLLER', 'SERVICE') THEN 'MEDIUM' END AS severity
FROM t WHERE severity IS NOT NULL""",
    "code_signals": f"""WITH {COMMITS}, k AS (SELECT repo_id || '@' || sha AS repo, least(files_changed, 60) AS k FROM c WHERE files_changed >= 1)
SELECT repo, 1 AS n, 'deep-nesting indent=24' AS signal FROM k WHERE k >= 5
UNION ALL SELECT repo, 2, 'cognitive-complexity max=' || (k * (k + 1) // 2)::BIGINT || ' fn=f over=1' FROM k WHERE k >= 5""",
}
