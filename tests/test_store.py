"""Dates, timeline folds, store, search and streaming on small rows."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from repolith.functions import dates, paths
from repolith.functions.time import instant, month_index, week_start
from repolith.operators import activity, search, store, timeline
from repolith.streaming import activity as streaming

TODAY = date(2026, 8, 15)


@pytest.mark.parametrize(
    "question, want",
    [
        ("2025年做了什么", ("2025-01-01", "2025-12-31")), ("2026-08 的提交", ("2026-08-01", "2026-08-31")), ("去年", ("2025-01-01", "2025-12-31")),
        ("8月份", ("2026-08-01", "2026-08-31")), ("上个月", ("2026-07-01", "2026-07-31")), ("这个月", ("2026-08-01", "2026-08-15")), ("本月", ("2026-08-01", "2026-08-15")),
        ("最近7天", ("2026-08-08", "2026-08-15")), ("近3个月", ("2026-05-15", "2026-08-15")), ("最近3月", ("2026-05-15", "2026-08-15")), ("上半年", ("2026-01-01", "2026-06-30")),
        ("最近2周", ("2026-08-01", "2026-08-15")), ("13月", None), ("什么都没有", None), ("", None), (None, None), ("2026-08-15", None),
    ],
)
def test_ranges(question, want):
    got = dates.parse_range(question, TODAY)
    if question in ("这个月", "本月"):
        assert got and got[0].isoformat() == want[0]
    else:
        assert (got and tuple(x.isoformat() for x in got)) == want


def test_instants(spark):
    texts = ["2026-03-02T08:26:14Z", "2026-03-02 08:26:14+00:00", "2026-03-02T13:56:14+05:30", "2026-03-02T08:26:14.000Z", "2026-03-02T08:26:14", "2026-03-02", "bad", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.unix_seconds(instant("t"))).collect()]
    assert len(set(got[:5])) == 1 and got[5] is not None and got[6:] == [None] * 3
    weeks = [r[0] for r in df.select(week_start(instant("t"))).collect()]
    assert weeks[0] == "2026-03-02" and weeks[-1] == ""
    assert spark.range(1).select(month_index(F.lit("2026-01")) - month_index(F.lit("2025-12")), month_index(F.lit("2026-13"))).first()[:] == (1, None)


def months(spark, rows):
    return spark.createDataFrame([("r", m, c, p, d, e, t) for m, c, p, d, e, t in rows], "repo string, month string, commits long, contributors long, new_dirs array<string>, deps_added array<string>, top_terms array<string>")


def test_timeline(spark):
    df = months(spark, [("2026-01", 9, 2, ["a"], [], ["x"]), ("2026-02", 8, 1, ["a"], None, ["x"]), ("2026-03", 7, 1, ["a"], [], ["x"]), ("2026-05", 5, 3, ["z"], ["q"], ["y"]), ("2026-06", 6, 1, ["z"], ["q"], ["y"])])
    near = timeline.similarity(df, "repo")
    staged = timeline.stages(near, "repo")
    assert [r["stage"] for r in staged.orderBy("month").collect()] == [0, 0, 0, 1, 1]
    assert near.filter("month = '2026-05'").first()["gap"] and abs(near.filter("month = '2026-02'").first()["cosine"] - 1) < 1e-12
    stats = {r["stage"]: r for r in timeline.stage_stats(df, staged, "repo").collect()}
    assert (stats[0]["commits"], stats[1]["max_contributors"], stats[1]["deps"]) == (24, 3, ["q"])
    assert timeline.stages(timeline.similarity(df.limit(0), "repo"), "repo").count() == 0


def test_sparse_merge(spark):
    df = months(spark, [("2026-01", 10, 1, ["a"], [], []), ("2026-02", 1, 4, ["b"], [], []), ("2026-03", 1, 1, ["a"], [], []), ("2026-04", 0, 0, [], [], []), ("2026-09", 1, 1, [], [], [])])
    got = [(r["month"], r["commits"], r["contributors"], r["new_dirs"], r["merged"]) for r in timeline.merge_sparse(df, "repo").orderBy("month").collect()]
    assert got == [("2026-01", 12, 4, ["a", "b"], ["2026-02", "2026-03"]), ("2026-09", 1, 1, [], [])]


def test_small_stages(spark):
    df = spark.createDataFrame([("r", f"2026-0{i + 1}", s) for i, s in enumerate([0, 1, 1, 2, 3, 3])], "repo string, month string, stage int")
    assert {r["stage"]: r["new_stage"] for r in timeline.merge_small(df, "repo").collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, t string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, "z")], "id string, n int, t string")
    assert sorted(map(tuple, store.upsert(old, new, ["id"], ["t"]).collect())) == [("a", 1, "x"), ("b", 2, None), ("c", 4, "z")]
    assert sorted(map(tuple, store.insert_ignore(old, new, ["id"]).collect())) == [("a", 1, "x"), ("b", 2, "y"), ("c", 4, "z")]
    assert store.cascade_delete(old, new, "id", "id").count() == 1


def test_ids_and_hashes(spark):
    one = spark.range(1)
    assert one.select(store.entity_id(F.lit("github"), F.lit("repo"), F.lit("a/b"))).first()[0] == "github:repo:a/b"
    for bad in (("", "repo", "x"), ("G", "repo", "x"), ("g", "re po", "x"), ("g", "repo", ""), ("g", "repo", "a:b")):
        assert one.select(store.entity_id(*map(F.lit, bad))).first()[0] is None
    hashes = [one.select(store.content_hash(F.lit(t))).first()[0] for t in ("é a \r\nb", "é a\nb", "é a\nb\n")]
    assert hashes[0] == hashes[1] != hashes[2]


def test_search(spark):
    df = spark.createDataFrame([(1, "Fix the Café login"), (2, "login café"), (3, None), (4, "修复登录页面"), (5, "")], "id int, t string")
    found = lambda *p: sorted(r["id"] for r in search.match_any(df, F.col("t"), list(p)).collect())
    assert found("cafe login") == [1] and found("login") == [1, 2] and found("登录") == [] and found("修复登录页面", "the cafe") == [1, 4] and found() == [] and found('"') == []
    assert spark.range(1).select(search.query_terms(F.lit("帮我看看 Foo_ foo 最近的提交 a b2 FOO"))).first()[0] == ["看看", "foo", "提交", "b2"]
    assert search.postings(df, "id", "t").count() == 7


def test_paths(spark):
    rows = [("a/test_x.py", True), ("tests/x.go", True), ("x/tests/y", True), ("a/b.spec.ts", True), ("contest.py", False), ("a/latest.py", False)]
    df = spark.createDataFrame(rows, "p string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select(paths.is_test(F.col("p")).alias("got"), "want").collect())
    f = lambda c: spark.range(1).select(c).first()[0]
    assert [f(paths.extension(F.lit(n))) for n in ("a.PY", ".env", "a.tar.gz", "x/.b", "noext")] == ["py", "", "gz", "", ""]
    assert f(paths.shebang_language(F.lit("#!/usr/bin/env python3 -u"))) == "python" and f(paths.shebang_language(F.lit("echo"))) is None
    assert [f(paths.count_lines(F.lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]
    assert f(paths.max_indent(F.lit("a\n" + " " * 26 + "b\n" + " " * 40 + "c"))) == 26
    assert f(paths.numeric_version(F.lit("^2.5.14"))) == "2.5.14" and f(paths.numeric_version(F.lit("git+x1"))) is None


def test_hotspots(spark):
    touches = spark.createDataFrame([("f", f"c{i}", 10, 1, i) for i in range(3)] + [("g", "c0", 2100, 0, 0), ("h", "c1", 5, 0, 1)], "path string, c string, a long, r long, o long")
    top = activity.top_files(activity.file_churn(touches, "path", "c", "a", "r", "o"))
    got = {r["path"]: r["level"] for r in activity.hotspots(top, spark.createDataFrame([(40,)], "total long")).collect()}
    assert got == {"f": "MEDIUM", "g": "HIGH"}


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "id long, ts timestamp, kind string, v long"
    for k, rows in enumerate([[(1, "2026-03-02 10:00:00", "a", 5), (2, "2026-03-09 10:00:00", "a", 7)], [(1, "2026-03-03 10:00:00", "b", 9), (3, "2026-03-30 00:00:00", "a", 1)]]):
        df = spark.createDataFrame(rows, "id long, ts string, kind string, v long").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{folder}/{k}")
    read = lambda: streaming.source(spark, f"{folder}/*", spark.createDataFrame([], schema).schema, 1)
    whole = streaming.run_to_end(streaming.windowed(read(), "ts", ["kind"], "v"), "t", "complete")
    assert sorted(map(tuple, whole.collect())) == [("2026-03-02", "a", 1, 5), ("2026-03-02", "b", 1, 9), ("2026-03-09", "a", 1, 7), ("2026-03-30", "a", 1, 1)]
    closed = streaming.run_to_end(streaming.windowed(read(), "ts", ["kind"], "v"), "t")
    assert ("2026-03-09", "a", 1, 7) in set(map(tuple, closed.collect()))
    root = str(tmp_path / "state")
    streaming.upsert_stream(read(), root, ["id"], ["v"], ["ts"])
    now = spark.read.parquet(f"{root}/version=1")
    assert sorted((r["id"], r["kind"], r["v"]) for r in now.collect()) == [(1, "a", 9), (2, "a", 7), (3, "a", 1)]
