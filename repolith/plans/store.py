"""Queries of the entity store and of retrieval, and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith.functions import dates
from repolith.operators import search, store
from repolith.plans.history import COMMITS, commits_of
from repolith.session import pin
from repolith.storage import table

TODAY = date(2026, 8, 31)


def _repo_rows(spark: SparkSession, d: str, last: bool) -> DataFrame:
    """First or last row of each repository by text of its sync time, then of all columns."""
    rows = table(pin(spark), d, "repos").filter("id is not null")
    fields = ["last_synced_at", "arrived_at", *[c for c in rows.columns if c not in ("id", "last_synced_at", "arrived_at")]]
    pick = F.max if last else F.min
    return rows.groupBy("id").agg(pick(F.struct(*fields)).alias("r")).select("id", "r.*")


COLUMNS = ["id", "full_name", "description", "primary_language", "stars", "forks", "is_archived", "pushed_at", "first_synced_at", "last_synced_at"]


def upsert_latest(spark, d):
    """Half of the repositories are known with their first row; all come again with their last."""
    old = _repo_rows(spark, d, False).filter(F.col("stars") % 2 == 0).select(*COLUMNS)
    new = _repo_rows(spark, d, True).select(*COLUMNS)
    return store.upsert(old, new, ["id"], store.UPDATED["repos"])


def _upserted(spark, d, name: str):
    """A table's entities, known with the least of their rows, after the greatest of each came."""
    rows = table(pin(spark), d, name).filter("id is not null")
    rest = [c for c in rows.columns if c != "id"]
    pick = lambda f: rows.groupBy("id").agg(f(F.struct(*rest)).alias("r")).select("id", "r.*")
    return store.upsert(pick(F.min), pick(F.max), ["id"], store.UPDATED[name])


def upsert_commits(spark, d):
    return _upserted(spark, d, "commits")


def upsert_issues(spark, d):
    return _upserted(spark, d, "issues")


def upsert_releases(spark, d):
    return _upserted(spark, d, "releases")


def insert_ignore(spark, d):
    old = table(pin(spark), d, "dependencies").filter("kind = 'runtime'").select("repo_id", "name").distinct()
    new = table(spark, d, "dependencies").filter("kind = 'dev'").select("repo_id", "name").distinct()
    return store.insert_ignore(old.withColumn("first_kind", F.lit("runtime")), new.withColumn("first_kind", F.lit("dev")), ["repo_id", "name"])


def upsert_coalesce(spark, d):
    rows = table(pin(spark), d, "sync_state").filter("entity is not null")
    first = rows.groupBy("entity").agg(F.min(F.struct("last_synced_at", "cursor")).alias("r")).select("entity", "r.*")
    last = rows.groupBy("entity").agg(F.max(F.struct("last_synced_at", "cursor")).alias("r")).select("entity", "r.*")
    return store.upsert_cursor(first, last)


def cascade_delete(spark, d):
    gone = _repo_rows(spark, d, True).filter("is_archived = 1")
    return store.cascade_delete(table(spark, d, "issues").distinct(), gone, "repo_id", "id").select("id", "repo_id", "number", "state")


def entity_id_parse(spark, d):
    ids = table(pin(spark), d, "commits").select("id").distinct()
    return ids.select("id", *(c.alias(n) for n, c in store.entity_parts(F.col("id")).items()))


def entity_id_build(spark, d):
    deps = table(pin(spark), d, "dependencies").select("name", "kind").distinct()
    return deps.select("name", "kind", store.entity_id(F.lit("pkg"), F.col("kind"), F.col("name")).alias("entity_id"))


def source_uris(spark, d):
    rows = table(pin(spark), d, "issues").select(F.lit("issue").alias("kind"), F.col("id"))
    rows = rows.unionByName(table(spark, d, "commits").select(F.lit("commit").alias("kind"), F.col("id"))).unionByName(table(spark, d, "releases").select(F.lit("release").alias("kind"), F.col("id")))
    native = F.element_at(F.split("id", ":", 3), 3)
    full = F.regexp_extract(native, "^([^@#]+)", 1)
    return rows.distinct().select("id", store.source_uri(F.col("kind"), full, native).alias("uri"))


def content_hash(spark, d):
    return table(pin(spark), d, "documents").select("doc_id", store.content_hash(F.col("text")).alias("hash"))


def entity_lookup(spark, d):
    """Every current repository with what a lookup shows of it."""
    return _repo_rows(spark, d, True).select("id", "full_name", "description", "stars", store.source_uri(F.lit("repo"), F.col("full_name"), F.lit("")).alias("uri"))


def adjacency(spark, d):
    deps = table(pin(spark), d, "dependencies").select("repo_id", "kind", "name", "version").distinct()
    return deps.groupBy("repo_id", "kind").agg(F.count("*").alias("entries"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("@", "name", "version"))), " ").alias("names"))


def store_counts(spark, d):
    """One row: counts, the last sync, and whether there are too few repositories to compare."""
    repos = table(pin(spark), d, "repos").agg(F.count_distinct("id").alias("repos"))
    commits = commits_of(spark, d).agg(F.count("*").alias("commits"))
    issues = table(spark, d, "issues").agg(F.count_distinct("id").alias("issues"))
    synced = table(spark, d, "sync_state").agg(F.max("last_synced_at").alias("last_sync"))
    return repos.crossJoin(commits).crossJoin(issues).crossJoin(synced).withColumn("too_few", F.col("repos") < 2)  # one row each


def _texts(spark, d) -> DataFrame:
    """(id, text): messages of commits, titles of issues and descriptions of repositories, each text of an id once."""
    of = {"commits": "message", "issues": "title", "repos": "description"}
    parts = [table(pin(spark), d, t).select("id", F.col(c).alias("text")).filter("id is not null and text is not null") for t, c in of.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def postings(spark, d):
    """Tokens of the three indexed texts with their places, repeats counted."""
    return search.postings(_texts(spark, d), "id", "text").groupBy("token").agg(F.count("*").alias("places"), F.count_distinct("id").alias("docs"))


def index_match(spark, d):
    """Messages that hold one of two phrases, found by the postings of their tokens."""
    texts = commits_of(spark, d).select(F.concat_ws("@", "repo_id", "sha").alias("id"), "message")
    return search.match_postings(search.postings(texts, "id", "message"), "id", ["the scheduler", "timeline"])


def match_any(spark, d):
    titles = table(pin(spark), d, "issues").select("id", "title").distinct()
    return search.match_any(titles, F.col("title"), ["scheduler", "first start"])


def phrase_match(spark, d):
    docs = table(pin(spark), d, "documents").select("doc_id", "text")
    return search.match_any(docs, F.col("text"), ["root folder", "开始"]).select("doc_id")


def _context(spark, d, question):
    names = _repo_rows(spark, d, True).select("id", "full_name", "description")
    commits = commits_of(spark, d).join(names.select(F.col("id").alias("repo_id"), "full_name"), "repo_id").select(F.concat("repo_id", F.lit("@"), "sha").alias("id"), "full_name", "authored_at", "message")
    issues = table(spark, d, "issues").groupBy("id").agg(F.max(F.struct("opened_at", "state", "title", "number", "repo_id")).alias("r")).select("id", "r.*")
    issues = issues.join(names.select(F.col("id").alias("repo_id"), "full_name"), "repo_id")
    return search.context(commits, issues, names, question, TODAY)


def context_blocks(spark, d):
    return _context(spark, d, "2026-03 scheduler timeline 帮我")


def recent_fallback(spark, d):
    return _context(spark, d, "2026年")


def range_filter(spark, d):
    span = dates.parse_range("上半年", TODAY)
    rows = table(pin(spark), d, "issues").select("id", "opened_at", "state").distinct()
    return rows.filter(search.in_range(F.col("opened_at"), span))


def query_terms(spark, d):
    texts = table(pin(spark), d, "documents").select("doc_id", F.array_join(search.query_terms(F.col("text")), " ").alias("terms"))
    return texts.filter("terms is not null")


def question_ranges(spark, d):
    """Ranges that questions name, made of the days of commits and the numbers of issues."""
    day = F.regexp_extract("authored_at", "^([0-9]{4})-([0-9]{2})-", 0)
    months = table(pin(spark), d, "commits").select(F.substring(day, 1, 4).alias("y"), F.substring(day, 6, 2).alias("m")).filter("y != ''").distinct()
    some = table(spark, d, "issues").select(F.col("number").alias("n")).filter("n between 0 and 9999").distinct()
    n = F.col("n").cast("string")
    questions = (
        months.select(F.concat("y", F.lit("-"), "m", F.lit(" 的 scheduler")).alias("question"))
        .unionByName(months.select(F.concat("y", F.lit("年有哪些改动")).alias("question")))
        .unionByName(months.select(F.concat(F.ltrim(F.col("m"), F.lit("0")), F.lit("月份做了什么")).alias("question")))
        .unionByName(some.select(F.concat(F.lit("最近"), n, F.lit("天 timeline")).alias("question")))
        .unionByName(some.select(F.concat(F.lit("近"), n, F.lit("周")).alias("question")))
        .unionByName(some.select(F.concat(F.lit("最近"), n, F.lit("个月")).alias("question")))
        .unionByName(some.select(F.concat(F.lit("issue "), n).alias("question")))
        .distinct()
    )
    return questions.select("question", dates.range_of(F.col("question"), TODAY).alias("r")).select("question", "r.first", "r.last")


QUERIES = {
    f.__name__: f
    for f in (
        upsert_latest, upsert_commits, upsert_issues, upsert_releases, insert_ignore, upsert_coalesce, cascade_delete, entity_id_parse, entity_id_build, source_uris, content_hash, entity_lookup, adjacency,
        store_counts, postings, index_match, match_any, phrase_match, context_blocks, recent_fallback, range_filter, query_terms, question_ranges,
    )
}

REPO_FIELDS = "last_synced_at arrived_at full_name description primary_language stars forks is_fork is_archived visibility created_at pushed_at topics_json my_role first_synced_at".split()
LAST = f"last AS (SELECT * FROM repos WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {', '.join(f + ' DESC NULLS LAST' for f in REPO_FIELDS)}) = 1)"
FIRST = f"first AS (SELECT * FROM repos WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {', '.join(f + ' ASC NULLS FIRST' for f in REPO_FIELDS)}) = 1)"
UPD = ["description", "primary_language", "stars", "forks", "is_archived", "pushed_at", "last_synced_at"]


def _entities(name: str, fields: list[str], updated: list[str]) -> str:
    """The first row of each id, with the fields of the last that an update replaces."""
    order = lambda way: ", ".join(f"{f} {way}" for f in fields)
    shown = ", ".join(f"{'b' if f in updated else 'a'}.{f} AS {f}" for f in fields)
    return f"""WITH a AS (SELECT * FROM {name} WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {order('ASC NULLS FIRST')}) = 1),
b AS (SELECT * FROM {name} WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {order('DESC NULLS LAST')}) = 1)
SELECT a.id, {shown} FROM a JOIN b ON b.id = a.id"""


STOPWORDS = ["什么", "哪些", "怎么", "如何", "我的", "哪个", "那些", "帮我", "最近", "在忙", "正在", "一下", "情况", "了", "在", "我", "是", "有", "的", "请"]
STOPPED = ["the", "a", "an", "and", "or", "to", "of", "in", "for", "on", "with", *STOPWORDS]
CLEANED = "r"
for _w in STOPWORDS:
    CLEANED = f"replace({CLEANED}, '{_w}', ' ')"
TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"
CONTEXT = f"""WITH {COMMITS}, {LAST},
cc AS (SELECT repo_id || '@' || sha AS id, full_name, authored_at, message FROM c JOIN last ON last.id = c.repo_id),
i AS (SELECT * FROM issues QUALIFY row_number() OVER (PARTITION BY id ORDER BY opened_at DESC NULLS LAST, state DESC NULLS LAST, title DESC NULLS LAST, number DESC, repo_id DESC) = 1)"""


def _has(col: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains(' ' || array_to_string({TOKENS.format(col)}, ' ') || ' ', ' {t} ')" for t in terms) + ")"


_MATCH = f"""{CONTEXT},
x AS (SELECT * FROM cc WHERE {_has('message', 'scheduler', 'timeline')} ORDER BY id LIMIT 24),
y AS (SELECT i.id, full_name, number, state, title, opened_at FROM i JOIN last ON last.id = i.repo_id WHERE {_has('title', 'scheduler', 'timeline')} ORDER BY i.id LIMIT 24),
z AS (SELECT id, full_name, description FROM last WHERE {_has('description', 'scheduler', 'timeline')} ORDER BY id LIMIT 8),
b AS (
  SELECT 0 AS k, id AS o, 'commit:' || full_name || '@' || substr(authored_at, 1, 10) AS source, 'commit' AS kind, substr(message, 1, 200) AS text
  FROM x WHERE authored_at IS NULL OR substr(authored_at, 1, 10) BETWEEN '2026-03-01' AND '2026-03-31'
  UNION ALL SELECT 1, id, 'issue:' || full_name || '#' || number, 'issue', '[' || state || '] ' || title FROM y
  WHERE opened_at IS NULL OR opened_at = '' OR substr(opened_at, 1, 10) BETWEEN '2026-03-01' AND '2026-03-31'
  UNION ALL SELECT 2, id, 'repo:' || full_name, 'repo', coalesce(description, '') FROM z)"""
_END = """, u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source || substr(text, 1, 50) ORDER BY k, o) = 1)
SELECT row_number() OVER (ORDER BY k, o)::INT AS ord, source, kind, text FROM u QUALIFY ord <= 8"""

SQL = {
    "upsert_latest": f"""WITH {LAST}, {FIRST}, old AS (SELECT * FROM first WHERE stars % 2 = 0)
SELECT last.id, {', '.join((f"CASE WHEN last.id IS NOT NULL THEN last.{c} ELSE old.{c} END" if c in UPD else f"CASE WHEN old.id IS NOT NULL THEN old.{c} ELSE last.{c} END") + f" AS {c}" for c in COLUMNS[1:])}
FROM last LEFT JOIN old ON old.id = last.id""",
    "insert_ignore": """SELECT repo_id, name, max(CASE WHEN kind = 'runtime' THEN 'runtime' ELSE 'dev' END) AS first_kind FROM dependencies
WHERE kind IN ('runtime', 'dev') GROUP BY ALL""",
    "upsert_coalesce": """WITH a AS (SELECT * FROM sync_state QUALIFY row_number() OVER (PARTITION BY entity ORDER BY last_synced_at, cursor NULLS FIRST) = 1),
b AS (SELECT * FROM sync_state QUALIFY row_number() OVER (PARTITION BY entity ORDER BY last_synced_at DESC, cursor DESC NULLS LAST) = 1)
SELECT entity, b.last_synced_at, coalesce(b.cursor, a.cursor) AS cursor FROM a JOIN b USING (entity)""",
    "cascade_delete": f"""WITH {LAST} SELECT id, repo_id, number, state FROM (SELECT DISTINCT * FROM issues)
WHERE repo_id NOT IN (SELECT id FROM last WHERE is_archived = 1)""",
    "entity_id_parse": """SELECT DISTINCT id, nullif(regexp_extract(id, '^([a-z0-9_-]+):([a-z_]+):([^:]+)$', 1), '') AS connector,
  nullif(regexp_extract(id, '^([a-z0-9_-]+):([a-z_]+):([^:]+)$', 2), '') AS kind, nullif(regexp_extract(id, '^([a-z0-9_-]+):([a-z_]+):([^:]+)$', 3), '') AS native_id FROM commits""",
    "entity_id_build": """SELECT DISTINCT name, kind, CASE WHEN regexp_full_match(kind, '[a-z_]+') AND name <> '' AND NOT contains(name, ':') THEN 'pkg:' || kind || ':' || name END AS entity_id FROM dependencies""",
    "source_uris": """WITH r AS (SELECT DISTINCT id, k, regexp_extract(id, '^[^:]*:[^:]*:(.*)$', 1) AS n FROM (
  SELECT id, 'issue' AS k FROM issues UNION ALL SELECT id, 'commit' FROM commits UNION ALL SELECT id, 'release' FROM releases))
SELECT id, CASE k WHEN 'commit' THEN 'https://github.com/' || regexp_extract(n, '^([^@#]+)', 1) || '/commit/' || split_part(n, '@', -1)
  WHEN 'issue' THEN 'https://github.com/' || regexp_extract(n, '^([^@#]+)', 1) || '/issues/' || split_part(n, '#', -1) ELSE '' END AS uri FROM r""",
    "content_hash": """SELECT doc_id, sha256(regexp_replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), '[\\t\\x0b\\f\\r \\x1c-\\x1f\\x{85}\\p{Z}]+(\\n|$)', '\\1', 'g')) AS hash FROM documents""",
    "entity_lookup": f"WITH {LAST} SELECT id, full_name, description, stars, 'https://github.com/' || full_name AS uri FROM last",
    "adjacency": """WITH d AS (SELECT DISTINCT repo_id, kind, name, version FROM dependencies), e AS (SELECT repo_id, kind, count(*) AS entries FROM d GROUP BY ALL),
n AS (SELECT DISTINCT repo_id, kind, concat_ws('@', name, version) AS x FROM d)
SELECT repo_id, kind, any_value(entries) AS entries, string_agg(x, ' ' ORDER BY x) AS names FROM n JOIN e USING (repo_id, kind) GROUP BY repo_id, kind""",
    "store_counts": f"""WITH {COMMITS}, k AS (SELECT (SELECT count(DISTINCT id) FROM repos) AS repos, (SELECT count(*) FROM c) AS commits,
  (SELECT count(DISTINCT id) FROM issues) AS issues, (SELECT max(last_synced_at) FROM sync_state) AS last_sync) SELECT *, repos < 2 AS too_few FROM k""",
    "postings": f"""WITH t AS (SELECT id, message AS text FROM commits UNION SELECT id, title FROM issues UNION SELECT id, description FROM repos)
SELECT token, count(*) AS places, count(DISTINCT id) AS docs
FROM (SELECT id, unnest({TOKENS.format('text')}) AS token FROM t WHERE id IS NOT NULL) GROUP BY ALL""",
    "index_match": f"WITH {COMMITS} SELECT DISTINCT repo_id || '@' || sha AS id FROM c WHERE {_has('message', 'the scheduler', 'timeline')}",
    "upsert_commits": _entities("commits", ["repo_id", "sha", "authored_at", "author_email", "message", "additions", "deletions", "files_changed", "is_my_commit"], ["authored_at"]),
    "upsert_issues": _entities("issues", ["repo_id", "number", "title", "state", "is_pr", "labels_json", "opened_at", "closed_at"], ["title", "state", "labels_json", "closed_at"]),
    "upsert_releases": _entities("releases", ["repo_id", "tag_name", "name", "published_at", "notes"], ["name", "published_at", "notes"]),
    "query_terms": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{1,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}') AS raw FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, flatten(list_transform(raw, lambda r: CASE WHEN regexp_matches(r, '^[a-z]') THEN [regexp_replace(r, '^[_-]+|[_-]+$', '', 'g')] ELSE string_split_regex(trim({CLEANED}, ' '), ' +') END)) AS l FROM t),
k AS (SELECT doc_id, list_filter(l, lambda x: length(x) >= 2 AND x NOT IN ({', '.join(f"'{w}'" for w in STOPPED)})) AS l FROM p)
SELECT doc_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:8], ' '), '') AS terms FROM k""",
    "question_ranges": """WITH c AS (SELECT DISTINCT substr(authored_at, 1, 4) AS y, substr(authored_at, 6, 2) AS m FROM commits WHERE regexp_matches(authored_at, '^[0-9]{4}-[0-9]{2}-')),
n AS (SELECT DISTINCT number::INT AS n FROM issues WHERE number BETWEEN 0 AND 9999), d AS (SELECT DATE '2026-08-31' AS d),
q AS (
  SELECT y || '-' || m || ' 的 scheduler' AS question, make_date(y::INT, m::INT, 1) AS a, last_day(make_date(y::INT, m::INT, 1)) AS b FROM c
  UNION SELECT y || '年有哪些改动', make_date(y::INT, 1, 1), make_date(y::INT, 12, 31) FROM c
  UNION SELECT ltrim(m, '0') || '月份做了什么', make_date(2026, m::INT, 1), last_day(make_date(2026, m::INT, 1)) FROM c
  UNION SELECT '最近' || n || '天 timeline', d - n, d FROM n, d
  UNION SELECT '近' || n || '周', d - 7 * n, d FROM n, d
  UNION SELECT '最近' || n || '个月', (d - to_months(n))::DATE, d FROM n, d
  UNION SELECT 'issue ' || n, NULL, NULL FROM n)
SELECT question, strftime(a, '%Y-%m-%d') AS first, strftime(b, '%Y-%m-%d') AS last FROM q""",
    "match_any": f"SELECT DISTINCT id, title FROM issues WHERE {_has('title', 'scheduler', 'first start')}",
    "phrase_match": f"SELECT doc_id FROM documents WHERE {_has('text', 'root folder', '开始')}",
    "context_blocks": _MATCH + _END,
    "recent_fallback": CONTEXT
    + """, x AS (SELECT * FROM cc ORDER BY authored_at DESC NULLS LAST, id LIMIT 8),
b AS (SELECT 0 AS k, id AS o, 'commit:' || full_name || '@' || substr(authored_at, 1, 10) AS source, 'commit' AS kind, substr(message, 1, 200) AS text
  FROM x WHERE authored_at IS NULL OR substr(authored_at, 1, 10) BETWEEN '2026-01-01' AND '2026-12-31')"""
    + _END,
    "range_filter": """SELECT DISTINCT id, opened_at, state FROM issues
WHERE opened_at IS NULL OR opened_at = '' OR substr(opened_at, 1, 10) BETWEEN '2026-01-01' AND '2026-06-30'""",
}
