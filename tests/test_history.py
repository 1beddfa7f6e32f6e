"""The ledger and incremental runs against brute force, and runs that fail."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from repolith.operators import history, incremental

T0 = datetime(2026, 1, 1)


def at(n):
    return T0 + timedelta(minutes=n)


def rows_of(seed, keys=4, n=60):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        v = r.randint(0, 30)
        rows.append((f"k{r.randint(1, keys)}", at(v), at(v + r.choice([0, 0, 1, 5, 40])), r.choice([1, 2, None]), r.choice(["a", None])))
    return rows + rows[:5]


def believed(rows, t):
    """(key, valid) -> state as known at t: the latest recorded, then the greatest."""
    held = {}
    least = lambda x: (x is not None, x or 0) if not isinstance(x, str) else (True, x)
    for k, v, r, *s in rows:
        if r <= t:
            order = (r, tuple((x is not None, x if x is not None else 0) for x in s))
            if (k, v) not in held or order > held[k, v][0]:
                held[k, v] = (order, tuple(s))
    return {k: s for k, (_, s) in held.items()}


@pytest.fixture(scope="module")
def frame(spark):
    def made(rows):
        df = spark.createDataFrame(rows, "id string, v timestamp, r timestamp, n long, valid_from string")
        return df.withColumns({"range": F.lit("clash"), "key": F.lit(1), "state": F.lit(2)})

    return made


@pytest.mark.parametrize("seed, limit", [(1, 10_000), (2, 10_000), (3, 12), (4, 7)])
def test_ledger(frame, seed, limit):
    rows = rows_of(seed)
    made = history.ledger(frame(rows), "id", F.col("v"), F.col("r"), {"n": F.col("n"), "text": F.col("valid_from")}, rows_per_sweep=limit)
    got = [r.asDict() for r in made.collect()]
    if limit < 100:
        assert max(r["range"] for r in got) > 0
    for t in [at(m) for m in range(0, 75, 5)] + [at(9999)]:
        want = believed(rows, t)
        now = [r for r in got if r["recorded_from"] <= t and (r["recorded_to"] is None or r["recorded_to"] > t)]
        assert {(r["id"], r["valid_from"]): (r["n"], r["text"]) for r in now} == want and len(now) == len(want)
        for r in now:  # periods follow one another
            later = [v for k, v in want if k == r["id"] and v > r["valid_from"]]
            assert r["valid_to"] == (min(later) if later else None)
    assert all(r["recorded_to"] is None or r["recorded_to"] > r["recorded_from"] for r in got)


@pytest.mark.parametrize("limit", [10_000, 9])
def test_versions(frame, limit):
    rows = rows_of(7)
    made = history.ledger(frame(rows), "id", F.col("v"), F.col("r"), {"n": F.col("n")}, rows_per_sweep=limit)
    for t in (None, at(25)):
        got = {(r["id"], r["valid_from"]): (r["n"], r["valid_to"]) for r in history.versions(history.as_known(made, None if t is None else F.lit(t)), "id", ["n"]).collect()}
        one = [(k, v, r, n) for k, v, r, n, _ in rows]
        state = believed(one, at(9999) if t is None else t)
        want = {}
        for key in {k for k, _ in state}:
            times = sorted(v for k, v in state if k == key)
            starts = [v for i, v in enumerate(times) if i == 0 or state[key, v] != state[key, times[i - 1]]]
            want |= {(key, v): (state[key, v][0], nxt) for v, nxt in zip(starts, [*starts[1:], None])}
        assert got == want


def test_ledger_odd_rows(frame):
    rows = [(None, at(1), at(1), 1, "x"), ("a", None, at(1), 1, "x"), ("a", at(3), None, 1, "x"), ("a", at(3), at(5), 1, "x"), ("a", at(2), at(6), 2, None)]
    got = [r.asDict() for r in history.ledger(frame(rows), "id", F.col("v"), F.col("r"), {"n": F.col("n")}).collect()]
    assert {(r["valid_from"], r["valid_to"], r["n"]) for r in got if r["recorded_to"] is None} == {(at(3), None, 1), (at(2), at(3), 2)}
    assert history.ledger(frame(rows).limit(0), "id", F.col("v"), F.col("r"), {"n": F.col("n")}).count() == 0


def test_pending(spark):
    rows = [
        ("o/a", "o", "2026-01-01T00:00:00Z", at(0), 1), ("o/a", "o", "2026-01-02T01:00:00+01:00", at(1), 1),  # seen, unchanged
        ("o/b", "o", "2026-01-01T00:00:00Z", at(0), 1), ("o/b", "o", "2026-01-03T00:00:00Z", at(90), 2),  # changed since
        ("o/c", "o", "2026-01-01T00:00:00Z", at(99), 1),  # arrived late
        ("p/a", "p", "2026-01-01T00:00:00Z", at(0), 1), ("p/b", "p", "2026-01-01T00:00:00Z", at(0), 1),  # the run stopped after p/a
        ("q/a", "q", "2026-01-01T00:00:00Z", at(0), 1),  # no run yet
        ("r/a", "r", "2026-01-01T00:00:00Z", None, 1), (None, "o", "2026-01-01T00:00:00Z", at(0), 1),
        ("s/a", "s", "2026-01-01T00:00:00Z", at(0), 1),  # unreadable cursor
    ]
    df = spark.createDataFrame(rows, "id string, owner string, seen string, arrived timestamp, n long")
    end = (T0 + timedelta(minutes=60)).replace(tzinfo=timezone.utc).isoformat()
    state = [("repos:o", end, None), ("repos:o", "2020-01-01T00:00:00Z", "x"), ("repos:p", end, "MjAyNi0wMS0wMVQwMDowMDowMFp8cC9h"), ("repos:r", end, None), ("repos:s", end, "cursor:v2:1"), ("commits:q", end, None), (None, end, None)]
    marks = incremental.watermarks(spark.createDataFrame(state, "entity string, last_synced_at string, cursor string"), "repos:")
    from repolith.functions.time import instant

    run = lambda d, upto=None: sorted(r["id"] for r in incremental.pending(d, marks, "id", F.col("owner"), instant("seen"), F.col("arrived"), {"n": F.col("n")}, upto).collect())
    assert run(df) == ["o/b", "o/c", "p/b", "q/a", "r/a", "s/a"]
    assert run(df, F.lit(at(80))) == ["p/b", "q/a", "r/a", "s/a"]
    assert run(df.limit(0)) == []


def test_runs_survive_failures(spark, tmp_path):
    root = str(tmp_path / "runs")
    source = lambda n: spark.range(n).withColumnRenamed("id", "seq")
    runs = incremental.Runs(spark, root)
    assert runs.run(source(0), "seq", lambda d, _: d) is None and runs.read() is None
    assert runs.run(source(10), "seq", lambda d, _: d)["watermark"] == "9"
    assert runs.run(source(10), "seq", lambda d, _: d) is None

    def die():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        runs.run(source(25), "seq", lambda d, _: d, before_commit=die)
    assert sorted(r["seq"] for r in runs.read().collect()) == list(range(10))
    # rows that come while a run is on the way wait: the limit was fixed at its start
    other = incremental.Runs(spark, root)
    made = runs.run(source(25), "seq", lambda d, _: d)
    assert (made["low"], made["watermark"]) == ("9", "24")
    # of two runs from one state only one commits
    with pytest.raises(FileExistsError):
        runs.run(source(40), "seq", lambda d, _: d, before_commit=lambda: other.run(source(30), "seq", lambda d, _: d))
    assert runs.run(source(40), "seq", lambda d, _: d)["low"] == "29"
    assert sorted(r["seq"] for r in runs.read().collect()) == list(range(40))
    with pytest.raises(ValueError, match="without seq"):
        runs.run(spark.createDataFrame([(None,)], "seq long"), "seq", lambda d, _: d)
    # a row that comes behind the watermark is not skipped in silence
    late = source(60).unionByName(spark.createDataFrame([(5,)], "seq long"))
    with pytest.raises(ValueError, match="1 rows came behind"):
        runs.run(late, "seq", lambda d, _: d)
    # outputs of runs that died are removed, committed ones are kept
    assert runs.sweep() == 2 and runs.sweep() == 0
    assert sorted(r["seq"] for r in runs.read().collect()) == list(range(40))
    assert runs.last()["number"] == len(runs.commits()) - 1


def test_rows_that_come_during_a_run(spark, tmp_path):
    """The limit is fixed at the start: what the source gets while the work goes on is left to the next run."""
    path = str(tmp_path / "source")
    spark.range(10).withColumnRenamed("id", "seq").write.parquet(path)
    runs = incremental.Runs(spark, str(tmp_path / "runs"))

    def work(new, until):
        spark.range(10, 14).withColumnRenamed("id", "seq").write.mode("append").parquet(path)
        return new.select("seq").join(spark.read.parquet(path).groupBy().count(), how="cross")

    assert runs.run(spark.read.parquet(path), "seq", work)["watermark"] == "9"
    assert sorted(r["seq"] for r in runs.read().collect()) == list(range(10))
    assert runs.run(spark.read.parquet(path), "seq", lambda new, until: new.withColumn("count", until.groupBy().count().first()["count"] + new["seq"] * 0))["low"] == "9"
    assert sorted(r["seq"] for r in runs.read().collect()) == list(range(14))
    # rows without a place are part of each run where work may repeat
    odd = spark.createDataFrame([(None, 1), (20, 2)], "seq long, x int")
    again = incremental.Runs(spark, str(tmp_path / "again"))
    again.run(odd, "seq", lambda new, _: new, unplaced=True)
    assert again.read().count() == 2 and again.run(odd, "seq", lambda new, _: new, unplaced=True) is None
