"""Pages of a forge's interface, and the tools over a store."""

from __future__ import annotations

import io
import json
import urllib.error
from datetime import date

import pytest

from repolith import cli
from repolith.plans.memory import Memory
from repolith.sources import fetch, payloads

D = "/root/testdata/sf0.001"


def test_payloads(spark, tmp_path):
    folder = tmp_path / "commits"
    folder.mkdir()
    item = lambda i, login="Me": {"sha": f"s{i}" if i != 2 else "", "author": {"login": login} if i else None, "commit": {"message": f"m{i}", "author": {"date": "2026-01-01T00:00:00Z", "email": "a@x"}}, "stats": {"additions": i, "deletions": 0, "total": i}}
    pages = {"o__a__1": [item(0), item(1)], "o__a__2": [item(2), item(3)], "o__a__3": [item(4)], "o__a__4": [item(5), item(6)], "o__b__1": [], "o__c__2": [item(7), item(8)], "o__d__1": {"message": "no list"}}
    for name, doc in pages.items():
        (folder / f"{name}.json").write_text(json.dumps(doc))
    rows = payloads.commits(payloads.read_pages(spark, str(folder), "commits", per_page=2), "me").collect()
    assert sorted((r["id"], r["is_my_commit"]) for r in rows) == [("github:commit:o/a@s0", 0), ("github:commit:o/a@s1", 1), ("github:commit:o/a@s3", 1), ("github:commit:o/a@s4", 1)]
    folder = tmp_path / "issues"
    folder.mkdir()
    (folder / "o__a__1.json").write_text(json.dumps([{"number": 7, "title": "T", "labels": [{"name": "错误"}], "pull_request": {"url": "x"}}, {"number": 8}]))
    got = [(r["number"], r["is_pr"], r["labels_json"], r["state"]) for r in payloads.issues(payloads.read_pages(spark, str(folder), "issues")).orderBy("number").collect()]
    assert got == [(7, 1, '["错误"]', "open"), (8, 0, "[]", "open")]
    folder = tmp_path / "repos"
    folder.mkdir()
    (folder / "me__1.json").write_text(json.dumps([{"full_name": "o/a", "topics": ["x"], "fork": True}]))
    r = payloads.repos(payloads.read_pages(spark, str(folder), "repos"), "2026-01-01T00:00:00Z").first()
    assert (r["id"], r["stars"], r["is_fork"], r["topics_json"], r["visibility"]) == ("github:repo:o/a", 0, 1, '["x"]', "public")


class Forge:
    """Answers of a forge by page, some of them refusals."""

    def __init__(self, answers):
        self.answers, self.asked, self.slept = list(answers), [], []

    def __call__(self, request, timeout):
        self.asked.append((request.full_url, request.headers.get("Authorization")))
        a = self.answers.pop(0)
        if isinstance(a, int):
            raise urllib.error.HTTPError(request.full_url, a, "no", {"X-RateLimit-Remaining": "0"}, None)
        return io.BytesIO(json.dumps(a).encode() if a is not None else b"no json")


def test_fetch(spark, tmp_path):
    forge = Forge([[{"number": 1}, {"number": 2}], 403, [{"number": 3}]])
    how = {"opener": forge, "sleep": forge.slept.append}
    assert fetch.save("https://forge.test/issues?state=all", str(tmp_path), "o/a", "t", per_page=2, **how) == 3
    assert forge.slept == [60] and forge.asked[0] == ("https://forge.test/issues?state=all&per_page=2&page=1", "Bearer t")
    assert sorted(r["number"] for r in payloads.issues(payloads.read_pages(spark, str(tmp_path), "issues", per_page=2)).collect()) == [1, 2, 3]
    for answers, error in (([404], fetch.NotFound), ([429, 429], fetch.RateLimited), ([500], fetch.FetchError), ([None], fetch.FetchError)):
        forge = Forge(answers)
        with pytest.raises(error):
            fetch.get("https://forge.test/x", opener=forge, sleep=forge.slept.append)
    assert list(fetch.pages("https://forge.test/x", opener=Forge([{"message": "no list"}]))) == []
    assert len(list(fetch.pages("https://forge.test/x", per_page=1, max_pages=2, opener=Forge([[1], [2], [3]])))) == 2


def test_memory(spark):
    m = Memory(spark, D)
    repo = m.table("commits").groupBy("repo_id").count().orderBy("count", ascending=False).first()["repo_id"]
    got = m.get(repo).first()
    assert got["uri"] == f"https://github.com/{got['full_name']}" and got["kind"] == "repo"
    for bad in ("x", "a:b", "github:release:x"):
        with pytest.raises(ValueError):
            m.get(bad)
    stages = m.timeline(repo).collect()
    assert sum(s["commits"] for s in stages) == m.months(repo).agg({"commits": "sum"}).first()[0]
    assert m.search("scheduler", date(2026, 6, 1), 3).count() <= 3
    one = m.observe().first()
    assert one["repos"] > 1 and not one["too_few"]
    known = cli.memory_tools(spark, D)
    reply = cli.answer(json.dumps({"id": 1, "method": "tools/call", "params": {"name": "memory_related", "arguments": {"entity_id": repo}}}), known)
    assert "result" in reply
    assert "error" in cli.answer(json.dumps({"id": 1, "method": "tools/call", "params": {"name": "memory_get", "arguments": {"entity_id": "x"}}}), known)
