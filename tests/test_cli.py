"""Commands and replies over small working copies."""

from __future__ import annotations

import json
import subprocess

import pytest

from repolith import cli


@pytest.fixture(scope="module")
def copy(tmp_path_factory):
    root = tmp_path_factory.mktemp("c") / "copy"
    root.mkdir()
    env = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x", "PATH": "/usr/bin:/bin", "HOME": str(root.parent)}
    run = lambda *a, **e: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True, env=env | e)
    run("init", "-q", "-b", "main")
    steps = [("2026-06-15", {"core/a.py": "x = 1\n", "package.json": '{"dependencies": {"koa": "1"}}'}, "parser first"), ("2026-08-20", {"web/b.py": "y\n" * 2100, "package.json": '{"dependencies": {"koa": "1", "vue": "3"}}'}, "parser again")]
    for day, files, subject in steps:
        for name, text in files.items():
            (root / name).parent.mkdir(exist_ok=True)
            (root / name).write_text(text)
        run("add", "-A")
        run("commit", "-qm", subject, GIT_AUTHOR_DATE=f"{day}T10:00:00+00:00", GIT_COMMITTER_DATE=f"{day}T10:00:00+00:00")
    return str(root)


def test_evolution(spark, copy, tmp_path):
    got = cli.evolution(spark, copy)
    assert got["total"] == 2 and [w["week"] for w in got["trend"]] == ["2026-06-15", "2026-08-17"]
    assert got["authors"] == [{"author": "A", "commits": 2, "added": 2103}]
    assert [(h["path"], h["level"]) for h in got["hotspots"]] == [("web/b.py", "HIGH")]
    assert got["top_files"][0]["path"] == "package.json"
    assert cli.evolution(spark, str(tmp_path)) is None


def test_signals_and_timeline(spark, copy, tmp_path):
    pack = cli.signals(spark, copy)
    assert [(m["month"], m["new_dirs"], m["deps_added"], m["top_terms"][0]) for m in pack["months"]] == [("2026-06", ["core"], ["koa"], "parser"), ("2026-08", ["web"], ["vue"], "parser")]
    assert [m["month"] for m in cli.signals(spark, copy, 1)["months"]] == ["2026-08"]
    months = [{"month": f"2026-0{m}", "commits": 9, "contributors": 1, "new_dirs": d, "deps_added": [], "top_terms": []} for m, d in ((1, ["a"]), (2, ["a"]), (4, ["b"]), (5, ["b"]))]
    path = tmp_path / "pack.json"
    path.write_text(json.dumps({"schemaVersion": "1.0", "repo": "r", "truncated": False, "months": months}))
    assert "Start: 18 commits" in cli.run_timeline(spark, str(path), 0.6, {"0": "Start"}, "text")
    assert "Stage 2 : 2026-04, 2026-06" in cli.run_timeline(spark, str(path), 0.6, {}, "gantt")
    path.write_text(json.dumps({"months": []}))
    with pytest.raises(ValueError):
        cli.read_pack(spark, str(path))


def test_scan_and_graph(spark, traders):
    doc = cli.scan(spark, traders)
    assert doc["git"] is None and len(doc["modules"]) == 8 and doc["warnings"][-1]["code"] == "GIT_META_UNAVAILABLE"
    lines = cli.module_graph(spark, traders, "mermaid").split("\n")
    assert lines[0] == "flowchart LR" and len(lines) == 16


def test_graph_facts(spark):
    edge = lambda a, b: {"source": a, "target": b}
    doc = {"modules": [{"module": m} for m in "abcd"], "internal": [edge("a", "b"), edge("b", "a"), edge("b", "c")], "callEdges": [edge("x", "y")]}
    got = cli.graph_facts(spark, doc)
    assert got["cycles"] == [{"members": ["a", "b"], "severity": "MAJOR"}] and got["callCycles"] == []
    assert [(d["module"], d["in_degree"], d["out_degree"]) for d in got["degrees"]] == [("a", 1, 1), ("b", 1, 2), ("c", 1, 0), ("d", 0, 0)]


def test_lite(spark, traders):
    lite, full = cli.scan(spark, traders, "lite"), cli.scan(spark, traders)
    assert all(lite[k] == full[k] for k in ("languages", "totalFiles", "largestFiles", "configFiles"))
    assert [(e["path"], e["type"]) for e in lite["entryPoints"]] == [("gate/main.go", "cli"), ("tools/quote.js", "cli"), ("desk.py", "cli")]
    assert lite["warnings"][0] == {"code": "SCAN_MODE", "detail": "lite"} and lite["buildRun"]["confidence"] == 0.6


def test_replies():
    known = {"echo": lambda **a: a, "bad": lambda: 1 / 0}
    ask = lambda **x: cli.answer(json.dumps(x), known)
    assert cli.answer("{", known)["error"]["code"] == -32700 and cli.answer("[]", known)["error"]["code"] == -32600
    assert ask(id=1, method="x")["error"]["code"] == -32601 and ask(id=1, method="tools/call", params={"name": "x"})["error"]["code"] == -32602
    assert ask(id=1, method="tools/call", params={"name": "bad"})["error"]["code"] == -32602
    assert json.loads(ask(id=1, method="tools/call", params={"name": "echo", "arguments": {"a": 1}})["result"]["content"][0]["text"]) == {"a": 1}
    assert ask(method="tools/list") is None and len(ask(id=2, method="tools/list")["result"]["tools"]) == 2
    assert ask(id=3, method="ping")["result"] == {} and ask(id=4, method="initialize")["result"]["capabilities"] == {"tools": {}}
    assert ask(id=5, method="initialize", params={"protocolVersion": "x"})["result"]["protocolVersion"] == "x" and ask(method="notifications/initialized") is None
    listed = cli.answer(json.dumps({"id": 6, "method": "tools/list"}), {"repo_scan": None})["result"]["tools"]
    assert listed[0]["inputSchema"]["required"] == ["path"]
    assert "needs path" in cli.answer(json.dumps({"id": 7, "method": "tools/call", "params": {"name": "repo_scan"}}), {"repo_scan": None})["error"]["message"]
    assert cli.main(["scan", "/no/such/folder"]) == 2


def test_history_in_scan(spark, copy):
    doc = cli.scan(spark, copy, "lite")
    assert (doc["git"]["commitCount"], doc["git"]["contributorCount"], doc["git"]["activityByMonth"]) == (2, 1, {"2026-06": 1, "2026-08": 1})
    assert doc["vcs"] == {"kind": "git", "remote": None, "worktree": False} and cli.scan(spark, copy, "lite", skip_git=True)["git"] is None
    text = cli.scan_summary(doc)
    assert text.startswith("files: 3,") and "2 commits, 1 people" in text
    assert cli.signals_summary(cli.signals(spark, copy)).split("\n")[1].startswith("2026-08  1 commits, 1 people; new: web, vue; parser")
