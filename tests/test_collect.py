"""The store's life: tables, runs over pages, the index, verdicts."""

from __future__ import annotations

import json
from datetime import date

import pytest

from repolith.operators import search
from repolith.plans.collect import TABLES, Store
from repolith.plans.memory import Memory
from repolith.storage import scope, _written

NOW = "2026-06-01T00:00:00Z"


def pages(root, **kinds):
    for kind, docs in kinds.items():
        (root / kind).mkdir(parents=True, exist_ok=True)
        for name, doc in docs.items():
            (root / kind / f"{name}.json").write_text(json.dumps(doc))
    return str(root)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    made = s.init()
    assert set(TABLES) < set(made) and s.init() == []
    first = pages(
        tmp_path / "one",
        repos={"me__1": [{"full_name": "me/a", "description": "a small Parser"}, {"full_name": "me/b"}]},
        commits={"me__a__1": [{"sha": "1", "author": {"login": "ME"}, "commit": {"message": "fix the parser", "author": {"date": NOW}}}, {"sha": "2", "commit": {"message": "lexer"}}]},
    )
    assert s.sync(first, "me", NOW) == {"repos": 2, "commits": 2, "issues": 0, "releases": 0}
    found = lambda name, *p: sorted(r["id"].rsplit(":", 1)[1] for r in s.match(name, list(p)).collect())
    assert found("commits", "the parser") == ["me/a@1"] and found("repos", "parser") == ["me/a"] and found("commits", "parser the") == [] and found("commits") == []
    assert s.table("commits").filter("is_my_commit = 1").count() == 1
    # a second run: a changed title, a commit that keeps its message, a new description
    second = pages(
        tmp_path / "two",
        repos={"me__1": [{"full_name": "me/a", "description": "a lexer"}]},
        commits={"me__a__1": [{"sha": "1", "commit": {"message": "other words", "author": {"date": "2026-01-01T00:00:00Z"}}}]},
        issues={"me__a__1": [{"number": 7, "title": "crash"}]},
    )
    assert s.sync(second, "me", "2026-07-01T00:00:00Z") == {"repos": 1, "commits": 1, "issues": 1, "releases": 0}
    assert found("repos", "parser") == [] and found("repos", "lexer") == ["me/a"] and found("commits", "the parser") == ["me/a@1"]
    assert s.table("commits").filter("sha = '1'").first()["authored_at"] == "2026-01-01T00:00:00Z"
    assert s.table("repos").filter("full_name = 'me/a'").first()[["first_synced_at", "last_synced_at"][0]] == NOW
    assert [tuple(r) for r in s.table("sync_state").collect()] == [("repos:me", "2026-07-01T00:00:00Z", None)]
    # a question goes through the index
    memory = Memory(spark, s.folder)
    assert set(memory.index()) == {"commits", "issues", "repos"}
    assert [(r["kind"], r["text"]) for r in memory.search("parser crash lexer", date(2026, 6, 1)).orderBy("ord").collect()] == [
        ("commit", "fix the parser"), ("commit", "lexer"), ("issue", "[open] crash"), ("repo", "a lexer")
    ]
    # verdicts, and what goes with a repository
    s.judge(spark.createDataFrame([("github:repo:me/a", "keep", None, NOW)], TABLES["verdicts"]))
    with pytest.raises(ValueError, match="no verdict: maybe"):
        s.judge(spark.createDataFrame([("github:repo:me/b", "maybe", None, NOW)], TABLES["verdicts"]))
    s.delete("repos", spark.createDataFrame([("github:repo:me/a",)], "id string"))
    assert s.table("repos").count() == 1 and s.table("commits").count() == s.table("issues").count() == s.table("verdicts").count() == 0
    assert found("commits", "parser") == [] and found("issues", "crash") == [] and s.table("index_repos").count() == 0
    s.drop()
    assert s.init() == made


def test_match_postings(spark):
    df = spark.createDataFrame([(1, "Fix the Café login"), (2, "login café"), (3, None), (4, "修复登录页面"), (5, ""), (6, "a a b")], "id int, t string")
    index = search.postings(df, "id", "t")
    found = lambda *p: sorted(r["id"] for r in search.match_postings(index, "id", list(p)).collect())
    assert found("cafe login") == [1] and found("login") == [1, 2] and found("登录") == [] and found("修复登录页面", "the cafe") == [1, 4] and found() == [] and found('"') == []
    assert found("a b") == [6] and found("a a") == [6] and found("b a") == []
    assert search.match_expression(["a", 'b "c"', ' " ']) == '"a" OR "b c"'


def test_scope(spark, tmp_path):
    from repolith.storage import materialize

    before = len(_written)
    with scope():
        assert materialize(spark.range(3).toDF("id"), "t").count() == 3
        path = _written[-1][1]
    assert len(_written) == before
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()
