"""Command line and line-based RPC over the query functions.

    python -m repolith.cli scan PATH [-o FILE] [--pretty] [--mode full|lite|auto] [--format json|summary] [--skip-git] [--fail-fast]
    python -m repolith.cli architect PATH
    python -m repolith.cli graph PATH --format summary|mermaid|json
    python -m repolith.cli evolution PATH [--days N] [--top N] [--format summary|json]
    python -m repolith.cli signals PATH [--months N] [--format json|summary]
    python -m repolith.cli timeline --signals FILE [--theta X] [--labels FILE] [--format text|gantt|json]
    python -m repolith.cli ask QUESTION --store FOLDER [--limit N] [--format text|json]
    python -m repolith.cli init --store FOLDER
    python -m repolith.cli sync --store FOLDER --pages FOLDER --owner LOGIN
    python -m repolith.cli serve [--store FOLDER]
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolith import __version__
from repolith.functions.time import now_iso
from repolith.operators import graph, timeline
from repolith.plans import evolution as E
from repolith.plans import profile as P
from repolith.plans.collect import Store
from repolith.plans.memory import Memory
from repolith.rules import words
from repolith.session import get_session
from repolith.sources.gitlog import head, read_gitlog, read_month_manifests, vcs
from repolith.sources.tree import read_tree

PACK = "schemaVersion string, repo string, truncated boolean, months array<struct<month:string,commits:long,contributors:long,new_dirs:array<string>,deps_added:array<string>,top_terms:array<string>>>"


def scan(spark: SparkSession, path: str, mode: str = "full", skip_git: bool = False, fail_fast: bool = False) -> dict:
    """The profile of one working tree as a document, with what its history tells.

    ``auto`` is the full profile, or the reduced one where that fails.  A
    history that can't be read is a warning; with ``fail_fast`` files that can't
    be read are an error.
    """
    if mode == "auto":
        try:
            return scan(spark, path, "full", skip_git, fail_fast)
        except (ValueError, PySparkException):
            return scan(spark, path, "lite", skip_git, fail_fast)
    tree = read_tree(spark, path)
    if fail_fast and (lost := tree.filter("error").select("path").head()):
        raise ValueError(f"can't be read: {lost['path']}")
    row = P.to_json((P.lite if mode == "lite" else P.profile)(tree)).first()
    doc = json.loads(row["json"]) if row else {"totalFiles": 0, "warnings": [{"code": "EMPTY_REPO", "detail": "no files"}]}
    git = {} if skip_git else head(path)
    doc["vcs"] = vcs(path)
    doc["git"] = None
    if git.get("head_branch") is not None:
        facts = documents(E.git_facts(read_gitlog(spark, path)))
        doc["git"] = {P.camel(k): v for k, v in (git | (facts[0] if facts else {})).items() if k != "repo"}
    elif not skip_git:
        doc["warnings"] = [*(doc.get("warnings") or []), {"code": "GIT_META_UNAVAILABLE", "detail": "no history could be read"}]
    return doc


def scan_summary(doc: dict) -> str:
    """A profile on a few lines: at most five languages and three frameworks."""
    languages = ", ".join(f"{x['name']} {x['pct']}%" for x in (doc.get("languages") or [])[:5])
    frames = ", ".join(x["name"] for x in (doc.get("frameworks") or [])[:3])
    git = doc.get("git") or {}
    lines = [
        f"files: {doc.get('totalFiles', 0)}, lines: {doc.get('totalLoc', 0)}",
        f"languages: {languages or '-'}",
        f"frameworks: {frames or '-'}",
        f"modules: {len(doc.get('modules') or [])}, edges: {len(doc.get('internal') or [])}, entry points: {len(doc.get('entryPoints') or [])}",
        f"history: {git.get('commitCount', '-')} commits, {git.get('contributorCount', '-')} people",
    ]
    return "\n".join([*lines, *(f"warning: {w['code']} {w['detail']}" for w in doc.get("warnings") or [])])


def signals_summary(pack: dict) -> str:
    """A signal pack on a line for each month."""
    return "\n".join(f"{m['month']}  {m['commits']} commits, {m['contributors']} people; new: {', '.join([*m['new_dirs'], *m['deps_added']]) or '-'}; {', '.join(m['top_terms'])}" for m in pack["months"])


def mermaid_of(spark: SparkSession, doc: dict) -> str:
    modules = spark.createDataFrame([(m["module"],) for m in doc.get("modules") or []], "module string")
    links = spark.createDataFrame([(e["source"], e["target"], e["weight"]) for e in doc.get("internal") or []], "source string, target string, weight long")
    return "\n".join(r["line"] for r in graph.mermaid(modules, links, "module").orderBy("ord").collect())


def architect(spark: SparkSession, path: str) -> dict:
    """What a reader of the architecture needs: the profile and the drawing of its modules."""
    doc = scan(spark, path)
    return {"profile": doc, "mermaid": mermaid_of(spark, doc)}


def graph_facts(spark: SparkSession, doc: dict) -> dict:
    """Degrees of the modules, and cycles of modules and of symbols, of one profile."""
    links = spark.createDataFrame([(e["source"], e["target"]) for e in doc.get("internal") or []], "source string, target string")
    nodes = spark.createDataFrame([(m["module"],) for m in doc.get("modules") or []], "module string")
    calls = spark.createDataFrame([(e["source"], e["target"]) for e in doc.get("callEdges") or []], "source string, target string")

    def rings(edges: DataFrame) -> list[dict]:
        made = graph.cycles(edges).groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members")).orderBy("component")
        return [{"members": r["members"], "severity": "MAJOR"} for r in made.collect()]

    return {"degrees": documents(graph.degrees(nodes, links, "module").orderBy("module")), "cycles": rings(links), "callCycles": rings(calls)}


def module_graph(spark: SparkSession, path: str, form: str) -> str:
    doc = scan(spark, path, skip_git=True)
    edges = doc.get("internal") or []
    if form == "json":
        known = {"modules": doc.get("modules"), "internal": edges, "external": doc.get("external")}
        return json.dumps(known | graph_facts(spark, doc), ensure_ascii=False)
    if form == "mermaid":
        return mermaid_of(spark, doc)
    return "\n".join([f"{len(doc.get('modules') or [])} modules, {len(edges)} edges", *(f"{e['source']} -> {e['target']} ({e['weight']})" for e in edges[:5])])


def documents(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def evolution(spark: SparkSession, path: str, days: int | None = None, top: int = words.TOP_FILES) -> dict | None:
    """None where git is not usable; an empty history has no rows."""
    if head(path)["head_branch"] is None:
        return None
    found = documents(E.evolution(read_gitlog(spark, path, days=days), top))
    return found[0] if found else {"total": 0, "trend": [], "top_files": [], "authors": [], "hotspots": []}


def signals(spark: SparkSession, path: str, months: int | None = None) -> dict:
    rows = documents(E.signals(read_gitlog(spark, path), read_month_manifests(spark, path), months).orderBy("month"))
    fields = ["month", "commits", "contributors", "new_dirs", "deps_added", "top_terms"]
    return {"schemaVersion": "1.0", "repo": Path(path).resolve().name, "truncated": any(r["truncated"] for r in rows), "months": [{k: r[k] for k in fields} for r in rows]}


def stages(months: DataFrame, repo: str, theta: float = words.THETA) -> DataFrame:
    """The timeline of monthly slices: sparse months merged, cut into stages, small stages folded."""
    buckets = timeline.merge_sparse(months, repo)
    staged = timeline.stages(timeline.similarity(buckets, repo), repo, theta)
    final = staged.join(timeline.merge_small(staged, repo), [repo, "stage"]).select(repo, "month", F.col("new_stage").alias("stage"))
    return timeline.stage_stats(buckets, final, repo)


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """Months of a signal pack; an error where it is not one."""
    pack = spark.read.schema(PACK).json(path, multiLine=True)
    first = pack.first()
    if first is None or first["months"] is None:
        raise ValueError(f"{path} is not a signal pack")
    if not first["months"]:
        raise ValueError(f"{path} has no months")
    return pack.select("repo", F.explode("months").alias("m")).select(F.coalesce("repo", F.lit("")).alias("repo"), "m.*")


def run_timeline(spark: SparkSession, path: str, theta: float, labels: dict[str, str], form: str) -> str:
    made = documents(stages(read_pack(spark, path), "repo", theta).orderBy("stage"))
    for s in made:
        s["label"] = labels.get(str(s["stage"]))
    if form == "json":
        return json.dumps(made, ensure_ascii=False)
    name = lambda s: s["label"] or f"Stage {s['stage'] + 1}"
    if form == "gantt":

        def after(month: str) -> str:
            n = int(month[:4]) * 12 + int(month[5:7])
            return f"{n // 12:04}-{n % 12 + 1:02}"

        return "\n".join(["gantt", "  dateFormat YYYY-MM", *(f"  {name(s)} : {s['start_month']}, {after(s['end_month'])}" for s in made)])
    return "\n".join(f"{s['start_month']} .. {s['end_month']}  {name(s)}: {s['commits']} commits, {s['max_contributors']} people; {', '.join(s['terms'])}" for s in made)


def memory_tools(spark: SparkSession, folder: str) -> dict:
    """What a client may ask of a store."""
    m = Memory(spark, folder)
    return {
        "memory_search": lambda query, limit=words.EVIDENCE, **_: documents(m.search(query, date.today(), limit).orderBy("ord")),
        "memory_get": lambda entity_id, **_: documents(m.get(entity_id)),
        "memory_timeline": lambda entity_id, theta=words.THETA, **_: documents(m.timeline(entity_id, theta).orderBy("stage")),
        "memory_related": lambda entity_id, **_: documents(m.related(entity_id)),
        "memory_observe": lambda **_: documents(m.observe()),
    }


def tools(spark: SparkSession) -> dict:
    """What a client may call of working copies, by name."""
    return {
        "repo_scan": lambda path, **_: scan(spark, path),
        "repo_graph": lambda path, format="summary", **_: module_graph(spark, path, format),
        "repo_signals": lambda path, months=None, **_: signals(spark, path, months),
        "repo_evolution": lambda path, top=words.TOP_FILES, **_: evolution(spark, path, None, top),
    }


def _schema(required: dict[str, str], optional: dict[str, str] | None = None) -> dict:
    """Arguments of a tool: names and their JSON types."""
    return {"type": "object", "properties": {n: {"type": t} for n, t in (required | (optional or {})).items()}, "required": list(required)}


#: What each tool takes.
ARGUMENTS = {
    "repo_scan": _schema({"path": "string"}),
    "repo_graph": _schema({"path": "string"}, {"format": "string"}),
    "repo_signals": _schema({"path": "string"}, {"months": "integer"}),
    "repo_evolution": _schema({"path": "string"}, {"top": "integer"}),
    "memory_search": _schema({"query": "string"}, {"limit": "integer"}),
    "memory_get": _schema({"entity_id": "string"}),
    "memory_timeline": _schema({"entity_id": "string"}, {"theta": "number"}),
    "memory_related": _schema({"entity_id": "string"}),
    "memory_observe": _schema({}),
}
PROTOCOL = "2024-11-05"


def answer(line: str, known: dict) -> dict | None:
    """The reply to one line of JSON-RPC; None to notifications."""
    ident = None

    def error(code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}

    def result(made: dict) -> dict:
        return {"jsonrpc": "2.0", "id": ident, "result": made}

    try:
        asked = json.loads(line)
    except ValueError:
        return error(-32700, "not JSON")
    if not isinstance(asked, dict):
        return error(-32600, "not an object")
    ident, method, params = asked.get("id"), asked.get("method"), asked.get("params") or {}
    if "id" not in asked:
        return None
    if method == "initialize":
        return result({"protocolVersion": params.get("protocolVersion") or PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "repolith", "version": __version__}})
    if method == "ping":
        return result({})
    if method == "tools/list":
        return result({"tools": [{"name": n, "description": (ARGUMENTS.get(n) and n.replace("_", " ")) or n, "inputSchema": ARGUMENTS.get(n, _schema({}))} for n in known]})
    if method != "tools/call":
        return error(-32601, f"no method {method}")
    name = params.get("name")
    if name not in known:
        return error(-32602, f"no tool {name}")
    given = params.get("arguments") or {}
    if missing := [a for a in ARGUMENTS.get(name, {}).get("required", []) if a not in given]:
        return error(-32602, f"{name} needs {', '.join(missing)}")
    try:
        made = known[name](**given)
    except Exception as x:  # noqa: BLE001
        return error(-32602, str(x).split("\n")[0])
    return result({"content": [{"type": "text", "text": made if isinstance(made, str) else json.dumps(made, ensure_ascii=False)}]})


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="repolith")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "graph", "evolution", "signals", "architect"):
        sub.add_parser(name).add_argument("path")
    c = sub.choices
    c["scan"].add_argument("-o", "--output")
    c["scan"].add_argument("--pretty", action="store_true")
    c["scan"].add_argument("--mode", default="full", choices=["full", "lite", "auto"])
    c["scan"].add_argument("--format", default="json", choices=["json", "summary"])
    c["scan"].add_argument("--skip-git", action="store_true")
    c["scan"].add_argument("--fail-fast", action="store_true")
    c["graph"].add_argument("--format", default="summary", choices=["summary", "mermaid", "json"])
    c["evolution"].add_argument("--days", type=int)
    c["evolution"].add_argument("--top", type=int, default=words.TOP_FILES)
    c["evolution"].add_argument("--format", default="json", choices=["summary", "json"])
    c["signals"].add_argument("--months", type=int)
    c["signals"].add_argument("--format", default="json", choices=["json", "summary"])
    t = sub.add_parser("timeline")
    t.add_argument("--signals", required=True)
    t.add_argument("--theta", type=float, default=words.THETA)
    t.add_argument("--labels")
    t.add_argument("--format", default="text", choices=["text", "gantt", "json"])
    sub.add_parser("serve").add_argument("--store")
    sub.add_parser("init").add_argument("--store", required=True)
    y = sub.add_parser("sync")
    for name in ("--store", "--pages", "--owner"):
        y.add_argument(name, required=True)
    q = sub.add_parser("ask")
    q.add_argument("question")
    q.add_argument("--store", required=True)
    q.add_argument("--limit", type=int, default=words.EVIDENCE)
    q.add_argument("--format", default="text", choices=["text", "json"])
    a = p.parse_args(argv)
    if getattr(a, "path", None) and not Path(a.path).is_dir():
        print(f"not a folder: {a.path}", file=sys.stderr)
        return 2
    spark = get_session("repolith")
    if a.command == "scan":
        try:
            doc = scan(spark, a.path, a.mode, a.skip_git, a.fail_fast)
        except ValueError as x:
            print(x, file=sys.stderr)
            return 2
        text = scan_summary(doc) if a.format == "summary" else json.dumps(doc, ensure_ascii=False, indent=2 if a.pretty else None)
        if a.output:
            Path(a.output).write_text(text + "\n", encoding="utf-8")
            return 0
    elif a.command == "graph":
        text = module_graph(spark, a.path, a.format)
    elif a.command == "evolution":
        made = evolution(spark, a.path, a.days, a.top)
        if a.format == "summary" and made:
            text = "\n".join([f"{made['total']} commits", *(f"{w['week']} {w['commits']} +{w['added']} -{w['removed']}" for w in made["trend"][-6:])])
        else:
            text = json.dumps(made, ensure_ascii=False)
    elif a.command == "signals":
        pack = signals(spark, a.path, a.months)
        text = signals_summary(pack) if a.format == "summary" else json.dumps(pack, ensure_ascii=False)
    elif a.command == "architect":
        text = json.dumps(architect(spark, a.path), ensure_ascii=False)
    elif a.command == "init":
        text = "\n".join(Store(spark, a.store).init()) or "nothing to do"
    elif a.command == "sync":
        now = spark.range(1).select(now_iso()).first()[0]
        text = json.dumps(Store(spark, a.store).sync(a.pages, a.owner, now))
    elif a.command == "timeline":
        try:
            text = run_timeline(spark, a.signals, a.theta, json.loads(Path(a.labels).read_text()) if a.labels else {}, a.format)
        except ValueError as x:
            print(x, file=sys.stderr)
            return 2
    elif a.command == "ask":
        found = memory_tools(spark, a.store)["memory_search"](a.question, a.limit)
        text = json.dumps(found, ensure_ascii=False) if a.format == "json" else "\n".join(f"[{b['source']}] {b['text'][:120]}" for b in found)
    else:
        known = tools(spark) | (memory_tools(spark, a.store) if a.store else {})
        for line in sys.stdin:
            if line.strip() and (reply := answer(line, known)) is not None:
                print(json.dumps(reply, ensure_ascii=False), flush=True)
        return 0
    print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
