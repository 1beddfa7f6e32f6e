"""Queries over files, rules and graphs, and their SQL.

Documents stand for files: their paths are ``source/doc_id``; the paths and
dependencies of modules that their texts mention stand for trees and graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions import paths
from repolith.operators import declared, files, graph, modules
from repolith.rules import tables
from repolith.session import pin
from repolith.storage import table
from repolith.streaming import activity as streaming


#: Paths of files that texts mention.
PATH = r"(?:[A-Za-z0-9_-]+/)+[A-Za-z0-9_.-]*[A-Za-z0-9_-]\.[A-Za-z]{1,4}"


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    """(repo, path, lang, size, loc, text) of the documents with text."""
    path = F.concat_ws("/", F.lower(F.trim("source")), F.col("doc_id").cast("string"))
    rows = table(pin(spark), d, "documents").filter("text is not null")
    return rows.select(F.col("repo_id").alias("repo"), "doc_id", path.alias("path"), "lang", F.length("text").cast("long").alias("size"), paths.count_lines(F.col("text")).alias("loc"), "text")


def mentioned(spark: SparkSession, d: str) -> DataFrame:
    """(repo, path, lang): distinct paths of source files that documents mention."""
    found = F.explode(F.regexp_extract_all("text", F.lit(PATH), F.lit(0)))
    rows = docs_of(spark, d).select("repo", found.alias("path")).distinct()
    return rows.withColumn("lang", paths.code_language(paths.extension(F.col("path"))))


def links_of(spark: SparkSession, d: str) -> DataFrame:
    """(repo, source, target): "Module a depends on b" in the texts, one row per mention."""
    said = F.explode(F.regexp_extract_all("text", F.lit(r"Module ([a-z]+ depends on [a-z]+)"), F.lit(1)))
    rows = docs_of(spark, d).select("repo", said.alias("s"))
    return rows.select("repo", F.split("s", " ").getItem(0).alias("source"), F.split("s", " ").getItem(3).alias("target"))


def lang_share(spark, d):
    return files.language_stats(docs_of(spark, d), [], "lang", F.col("loc")).orderBy(F.desc("loc"), "name")


def size_totals(spark, d):
    return docs_of(spark, d).agg(F.count("*").alias("total_files"), F.sum(F.when(F.col("lang").isNotNull(), F.col("loc"))).alias("total_loc"), F.sum("size").alias("chars"))


def largest_files(spark, d):
    return files.largest(docs_of(spark, d), ["repo"])


def text_budget_prefix(spark, d):
    """Documents of each repository within the text budget, in ranges of a thousand ids."""
    made = files.within_budget(docs_of(spark, d), ["repo"], "doc_id", F.col("doc_id"), F.floor(F.col("doc_id") / 1000), "size")
    return made.select("repo", "doc_id", F.col("used").cast("long").alias("used"))


def marker_counts(spark, d):
    return files.marker_counts(docs_of(spark, d), ["lang"], "text", ["TODO", "FIXME", "snapshot", "```"]).withColumnRenamed("```", "fences")


def long_files(spark, d):
    return docs_of(spark, d).filter(F.col("loc") >= tables.LONG_FILE).select("doc_id", F.format_string("long-file loc=%d", F.col("loc")).alias("signal"))


def max_indent(spark, d):
    return docs_of(spark, d).select("doc_id", paths.max_indent(F.col("text")).cast("int").alias("indent"))


def ext_classify(spark, d):
    ext = paths.extension(F.col("path"))
    return mentioned(spark, d).groupBy(ext.alias("ext"), "lang", paths.data_kind(ext).alias("data")).agg(F.count("*").alias("files"))


def test_evidence(spark, d):
    return files.test_evidence(mentioned(spark, d), ["repo"]).select("repo", "test_files", "ratio")


def exclude_globs(spark, d):
    rows = mentioned(spark, d).select("path").distinct()
    return rows.filter(~paths.is_ignored(F.col("path"), ["docs/", "*_gen.go", "search/session.go"]))


def page_module(spark, d):
    return mentioned(spark, d).groupBy("repo", paths.module_of(F.col("path")).alias("module")).agg(F.count("*").alias("files"))


def first_wins_merge(spark, d):
    deps = table(pin(spark), d, "dependencies").filter("repo_id is not null and name is not null").withColumn("dev", F.col("kind") == "dev")
    return declared.first_wins(deps.select("repo_id", "name", "version", "kind", "dev"), ["repo_id"], "name", ["dev", "name", "version"]).select("repo_id", "key", "name", "version", "kind")


def numeric_version(spark, d):
    return table(pin(spark), d, "dependencies").select("version").distinct().withColumn("numeric", paths.numeric_version(F.col("version")))


def edge_weights(spark, d):
    return modules.edge_weights(links_of(spark, d), ["repo"], "source", "target")


def cohesion(spark, d):
    return modules.cohesion(links_of(spark, d), [], "source", "target")


def degrees(spark, d):
    links = links_of(spark, d).select("source", "target").distinct()
    nodes = links.select(F.explode(F.array("source", "target")).alias("node"))
    return graph.degrees(nodes, links, "node")


def scc_cycles(spark, d):
    """Cycles of the modules of each repository; nodes are ``repo|module``."""
    made = graph.cycles_of_each(links_of(spark, d), "repo")
    at = lambda c: F.concat_ws("|", "repo", c).alias(c)
    return made.select(at("node"), at("component"))


def mermaid_lines(spark, d):
    links = links_of(spark, d)
    nodes = links.select(F.explode(F.array("source", "target")).alias("module")).distinct()
    return graph.mermaid(nodes, modules.edge_weights(links, [], "source", "target"), "module")


def json_props(spark, d):
    events = table(pin(spark), d, "events")
    k = F.from_json("props", "k long")["k"]
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def snippets(spark, d):
    return table(pin(spark), d, "issues").select("id", F.substring("title", 1, 50).alias("key"), F.substring("title", 1, 20).alias("snippet")).distinct()


def stream_weeks(spark, d):
    """Events by ISO week and type, as a stream run to its end with complete output.

    The pattern stands for one file as well as for a folder of files.
    """
    schema = table(pin(spark), d, "events").schema
    made = streaming.windowed(streaming.source(spark, f"{d}/events.parque[t]", schema), "ts", ["event_type"], "event_id")
    return streaming.run_to_end(made, "weeks", "complete")


QUERIES = {
    f.__name__: f
    for f in (
        lang_share, size_totals, largest_files, text_budget_prefix, marker_counts, long_files, max_indent, ext_classify, test_evidence, exclude_globs,
        page_module, first_wins_merge, numeric_version, edge_weights, cohesion, degrees, scc_cycles, mermaid_lines, json_props, snippets, stream_weeks,
    )
}

DOCS = """d AS (SELECT repo_id AS repo, doc_id, concat_ws('/', lower(trim(source, ' ')), doc_id::VARCHAR) AS path, lang, length(text)::BIGINT AS size,
  (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END)::BIGINT AS loc, text
  FROM documents WHERE text IS NOT NULL)"""
EXT = "lower(regexp_extract(regexp_extract({}, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1))"
CASE_LANG = """CASE WHEN {0} IN ('py', 'pyi', 'pyw') THEN 'python' WHEN {0} IN ('js', 'mjs', 'cjs', 'jsx') THEN 'javascript' WHEN {0} IN ('ts', 'mts', 'cts', 'tsx') THEN 'typescript'
  WHEN {0} IN ('vue', 'svelte', 'go', 'java', 'php', 'c', 'swift', 'scala', 'css', 'less', 'sql', 'r', 'dart', 'lua', 'zig') THEN {0} WHEN {0} = 'rs' THEN 'rust' WHEN {0} IN ('kt', 'kts') THEN 'kotlin'
  WHEN {0} = 'rb' THEN 'ruby' WHEN {0} = 'h' THEN 'c' WHEN {0} IN ('cpp', 'cc', 'cxx', 'hpp', 'hh') THEN 'cpp' WHEN {0} = 'cs' THEN 'csharp' WHEN {0} IN ('sh', 'bash', 'zsh') THEN 'shell'
  WHEN {0} IN ('ps1', 'psm1') THEN 'powershell' WHEN {0} IN ('bat', 'cmd') THEN 'batch' WHEN {0} IN ('html', 'htm') THEN 'html' WHEN {0} IN ('scss', 'sass') THEN 'scss' WHEN {0} = 'sol' THEN 'solidity' END"""
CASE_DATA = """CASE WHEN {0} IN ('json', 'jsonc') THEN 'json' WHEN {0} IN ('yaml', 'yml') THEN 'yaml' WHEN {0} IN ('toml', 'xml', 'rst', 'csv') THEN {0} WHEN {0} IN ('ini', 'cfg') THEN 'ini'
  WHEN {0} IN ('md', 'markdown') THEN 'markdown' WHEN {0} = 'txt' THEN 'text' WHEN {0} = 'env' THEN 'dotenv' WHEN {0} = 'proto' THEN 'protobuf' WHEN {0} IN ('graphql', 'gql') THEN 'graphql' END"""
IGNORED = """['node_modules', 'vendor', 'dist', 'build', 'out', 'target', '.git', '.venv', 'venv', 'env', '__pycache__', '.pytest_cache', '.ruff_cache', '.mypy_cache', 'coverage', 'htmlcov',
  '.next', '.nuxt', '.cache', '.idea', '.vscode', '.tox', 'site-packages', '.eggs']"""
PATHS = DOCS + f""", p0 AS (SELECT DISTINCT repo, unnest(regexp_extract_all(text, '{PATH}')) AS path FROM d),
p1 AS (SELECT *, {EXT.format('path')} AS ext FROM p0), p AS (SELECT *, {CASE_LANG.format('ext')} AS lang, {CASE_DATA.format('ext')} AS data FROM p1)"""
LINKS = DOCS + """, l0 AS (SELECT repo, unnest(regexp_extract_all(text, 'Module ([a-z]+ depends on [a-z]+)', 1)) AS s FROM d),
l AS (SELECT repo, split_part(s, ' ', 1) AS source, split_part(s, ' ', 4) AS target FROM l0)"""
NODES = "u AS (SELECT DISTINCT source, target FROM l), n AS (SELECT source AS node FROM u UNION SELECT target FROM u)"
IS_TEST = "(regexp_matches(path, '^tests?/') OR contains(path, '/tests/') OR regexp_matches(path, '(^|/)(test_[^/]*\\.py|[^/]*_test\\.py|[^/]*_test\\.go|[^/]*\\.test\\.[^/]*|[^/]*\\.spec\\.[^/]*)$'))"

SQL = {
    "lang_share": f"""WITH {DOCS}, c AS (SELECT lang AS name, count(*) AS files, sum(loc)::BIGINT AS loc FROM d WHERE lang IS NOT NULL GROUP BY 1)
SELECT name, files, loc, round_even(100.0 * loc / sum(loc) OVER (), 1)::DOUBLE AS pct FROM c""",
    "size_totals": f"WITH {DOCS} SELECT count(*) AS total_files, sum(CASE WHEN lang IS NOT NULL THEN loc END)::BIGINT AS total_loc, sum(size)::BIGINT AS chars FROM d",
    "largest_files": f"""WITH {DOCS} SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY loc DESC, path)::INT AS place, path, loc FROM d WHERE lang IS NOT NULL QUALIFY place <= 5""",
    "text_budget_prefix": f"""WITH {DOCS}, b AS (SELECT repo, doc_id, coalesce(sum(size) OVER (PARTITION BY repo ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM d)
SELECT * FROM b WHERE used < 16000000""",
    "marker_counts": f"""WITH {DOCS} SELECT lang, {', '.join(f"sum((length(text) - length(replace(text, '{m}', ''))) // {len(m)})::BIGINT AS {n}" for m, n in (('TODO', 'todo'), ('FIXME', 'fixme'), ('snapshot', 'snapshot'), ('```', 'fences')))} FROM d GROUP BY lang""",
    "long_files": f"WITH {DOCS} SELECT doc_id, 'long-file loc=' || loc AS signal FROM d WHERE loc >= 400",
    "max_indent": f"""WITH {DOCS}, l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), 1) AS n FROM d),
w AS (SELECT doc_id, n, length(replace(regexp_extract(line, '^([ \\t]*)', 1), chr(9), '    ')) AS w FROM l WHERE trim(line, ' ' || chr(9)) <> '')
SELECT d.doc_id, coalesce((array_agg(w ORDER BY n) FILTER (w >= 24))[1], max(w), 0)::INT AS indent FROM d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""",
    "ext_classify": f"WITH {PATHS} SELECT ext, lang, data, count(*) AS files FROM p GROUP BY ALL",
    "test_evidence": f"""WITH {PATHS}, t AS (SELECT repo, count(*) AS c, count_if({IS_TEST}) AS t FROM p WHERE lang IS NOT NULL GROUP BY ALL)
SELECT repo, t AS test_files, CASE WHEN t > 0 THEN round_even(t / c, 2) END AS ratio FROM t""",
    "exclude_globs": f"""WITH {PATHS} SELECT DISTINCT path FROM p WHERE NOT (list_has_any(string_split(path, '/')[1:-2], {IGNORED})
  OR regexp_matches(path, '(_gen\\.go|\\.min\\.js|\\.min\\.css|\\.map|\\.lock|\\.pb\\.go)$|(^|/)package-lock\\.json$|(^|/)pnpm-lock\\.yaml$') OR contains(path, '.generated.')
  OR starts_with(path, 'docs/') OR list_contains(string_split(path, '/')[1:-2], 'docs') OR path = 'search/session.go')""",
    "page_module": f"WITH {PATHS} SELECT repo, split_part(path, '/', 1) AS module, count(*) AS files FROM p GROUP BY ALL",
    "first_wins_merge": """SELECT repo_id, lower(name) AS key, name, version, kind FROM dependencies WHERE repo_id IS NOT NULL AND name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY repo_id, lower(name) ORDER BY kind = 'dev', name, version NULLS FIRST, kind) = 1""",
    "numeric_version": """SELECT DISTINCT version, CASE WHEN NOT regexp_matches(trim(version, ' '), '^(git\\+|github:|file:|http:|https:)') THEN nullif(regexp_extract(trim(version, ' '), '[0-9]+(?:\\.[0-9]+)*'), '') END AS numeric FROM dependencies""",
    "edge_weights": f"WITH {LINKS} SELECT repo, source, target, count(*) AS weight FROM l WHERE source <> target GROUP BY ALL",
    "cohesion": f"WITH {LINKS} SELECT source AS node, round_even(count_if(source = target) / count(*), 2) AS cohesion FROM l GROUP BY source",
    "degrees": f"""WITH {LINKS}, {NODES} SELECT node, (SELECT count(*) FROM u WHERE target = node) AS in_degree, (SELECT count(*) FROM u WHERE source = node) AS out_degree FROM n""",
    "scc_cycles": f"""WITH RECURSIVE {LINKS}, e AS (SELECT DISTINCT repo || '|' || source AS s, repo || '|' || target AS t FROM l WHERE repo IS NOT NULL AND source <> target),
r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
m AS (SELECT x.s AS node, least(x.s, min(x.t)) AS component FROM r x JOIN r y ON x.s = y.t AND x.t = y.s WHERE x.s <> x.t GROUP BY x.s)
SELECT node, component FROM m""",
    "mermaid_lines": f"""WITH {LINKS}, {NODES}, i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS k FROM n),
w AS (SELECT source, target, count(*) AS w FROM l WHERE source <> target GROUP BY ALL),
x AS (SELECT 0 AS a, 0 AS b, '' AS c, 'flowchart LR' AS line UNION ALL SELECT 1, k, '', '  m' || k || '["' || node || '"]' FROM i
  UNION ALL SELECT 2, -w, source || chr(9) || target, '  m' || s.k || ' -->|' || w || '| m' || t.k FROM w JOIN i s ON s.node = source JOIN i t ON t.node = target)
SELECT row_number() OVER (ORDER BY a, b, c)::INT AS ord, line FROM x""",
    "json_props": "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS sum_k, max((props->>'k')::BIGINT) AS max_k FROM events GROUP BY ALL",
    "snippets": "SELECT DISTINCT id, substr(title, 1, 50) AS key, substr(title, 1, 20) AS snippet FROM issues",
    "stream_weeks": "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL",
}
