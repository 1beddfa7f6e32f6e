"""The commit log of a working copy, with changed lines by file, as a data source."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo string, ord long, sha string, author string, email string, at string, subject string, path string, added long, removed long"
TIMEOUT = 60


def git(root: str, *args: str) -> str | None:
    """Output of a git command; None where git or the repository is not usable."""
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=TIMEOUT)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout.decode("utf-8", "replace") if run.returncode == 0 else None


def log(root: str, days: int | None = None) -> Iterator[tuple]:
    """(ord, sha, author, email, at, subject, path, added, removed), newest commit first; a commit without files has one row."""
    args = ["log", "--numstat", "--no-renames", "--date=iso-strict", "--pretty=format:%x1e%H%x1f%an%x1f%ae%x1f%ad%x1f%s"]
    out = git(root, *args, *([f"--since={days} days ago"] if days else []))
    for n, entry in enumerate((out or "").split("\x1e")[1:]):
        head, *lines = entry.split("\n")
        parts = head.split("\x1f")
        if len(parts) != 5 or not parts[0]:
            continue
        touched = [x.split("\t") for x in lines if x.count("\t") == 2]
        for added, removed, path in touched or [(None, None, None)]:
            yield (n, *parts, path, None if path is None else int(added) if added.isdigit() else 0, None if path is None else int(removed) if removed.isdigit() else 0)


class _Part(InputPartition):
    def __init__(self, root: str):
        self.root = root


class GitLogReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in options["path"].split(",") if r]
        self.days = int(options["days"]) if options.get("days") else None

    def partitions(self) -> list[_Part]:
        return [_Part(r) for r in self.roots]

    def read(self, part: _Part) -> Iterator[tuple]:
        repo = os.path.basename(os.path.normpath(part.root))
        for row in log(part.root, self.days):
            yield (repo, *row)


class GitLogSource(DataSource):
    """``spark.read.format("gitlog").option("days", 90).load("/path/a,/path/b")``"""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitLogReader:
        return GitLogReader(self.options)


def read_gitlog(spark: SparkSession, *roots: str, days: int | None = None):
    """One row for each file that a commit touched."""
    spark.dataSource.register(GitLogSource)
    reader = spark.read.format("gitlog")
    return (reader.option("days", str(days)) if days else reader).load(",".join(roots))


def head(root: str) -> dict:
    """Branch, and numbers of branches and tags, of a working copy; Nones where git is not usable."""
    branch = git(root, "rev-parse", "--abbrev-ref", "HEAD")
    branches, tags = git(root, "branch", "--list"), git(root, "tag", "--list")
    count = lambda x: None if x is None else len([y for y in x.splitlines() if y.strip()])
    return {"head_branch": branch and branch.strip(), "branch_count": count(branches), "tag_count": count(tags)}


def vcs(root: str) -> dict:
    """Kind, address and worktree of a working copy: ``.git`` may be a folder, or a file that points elsewhere."""
    at = os.path.join(root, ".git")
    pointer = None
    if os.path.isfile(at):
        with open(at, encoding="utf-8", errors="replace") as f:
            kind, _, where = f.read().strip().partition(":")
        pointer = where.strip() if kind == "gitdir" else None
    if not os.path.isdir(at) and pointer is None:
        return {"kind": None, "remote": None, "worktree": False}
    remote = git(root, "remote", "get-url", "origin")
    return {"kind": "git", "remote": remote.strip() if remote and remote.strip() else None, "worktree": pointer is not None and "/worktrees/" in pointer.replace("\\", "/")}


MANIFESTS = ["go.mod", "package.json", "pyproject.toml", "requirements.txt"]


def month_end_manifests(root: str) -> Iterator[tuple[str, str, list[str]]]:
    """(repo, month, names): names declared in the root manifests at the last commit of each month."""
    from repolith.operators.declared import read_manifest

    last: dict[str, str] = {}
    for line in (git(root, "log", "--reverse", "--date=iso-strict", "--pretty=format:%H%x1f%ad") or "").splitlines():
        sha, _, at = line.partition("\x1f")
        if at:
            last[at[:7]] = sha
    for month, sha in last.items():
        names = {n.lower() for m in MANIFESTS for n, _, _ in read_manifest(m, git(root, "show", f"{sha}:{m}") or "")}
        yield os.path.basename(os.path.normpath(root)), month, sorted(names)


def read_month_manifests(spark: SparkSession, *roots: str):
    """``month_end_manifests`` of many repositories, one task for each."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [x for r in b.column(0).to_pylist() for x in month_end_manifests(r)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string()))], names=["repo", "month", "names"])

    return spark.createDataFrame([(r,) for r in roots], "root string").repartition(len(roots)).mapInArrow(run, "repo string, month string, names array<string>")
