"""A directory tree as a data source, hidden files and all.

Spark's file sources leave out names that start with ``.`` or ``_``, of which
repositories have many.  Folders that are left out are not entered; only files
that a detector reads are opened.  Of the files that are left out, lock files in
the root are rows without size, content and ``error``: only their names count.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from repolith.rules import tables

SCHEMA = "repo string, path string, size long, content binary, error boolean"
#: Files whose content is read whatever their language.
READ = {*tables.MANIFESTS, *tables.MONOREPO}
LOCKS = {name for name, _ in tables.LOCKS}


class _Part(InputPartition):
    def __init__(self, root: str, top: str, files_only: bool):
        self.root, self.top, self.files_only = root, top, files_only


def patterns_of(root: str, name: str) -> list[str]:
    """Patterns of a repository's own ignore file: one per line, ``#`` starts a comment."""
    try:
        with open(os.path.join(root, name), encoding="utf-8", errors="replace") as f:
            lines = [x.strip() for x in f]
    except OSError:
        return []
    return [x for x in lines if x and not x.startswith("#")]


def ignored(path: str, name: str, patterns: list[str], folder: bool) -> bool:
    """The rules of ``functions.paths.is_ignored`` while walking, so that nothing below is read."""
    if folder and name in tables.IGNORED_DIRS:
        return True
    if not folder and any(fnmatchcase(name, g) or fnmatchcase(path, g) for g in tables.IGNORED_FILES):
        return True
    for p in patterns:
        q = p.rstrip("/")
        if path == q or path.startswith(q + "/") or (p.endswith("/") and name == q):
            return True
        if not p.endswith("/") and (fnmatchcase(path, p) or fnmatchcase(name, p)):
            return True
    return False


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [r for r in options["path"].split(",") if r]
        self.ignore_file = options.get("ignorefile") or ".repolithignore"
        self.cap = int(options.get("maxfilebytes") or tables.MAX_FILE_BYTES)
        for r in self.roots:
            if not os.path.isdir(r):
                raise NotADirectoryError(r)

    def partitions(self) -> list[_Part]:
        """One for the files in a root and one for each folder in it."""
        made = []
        for root in self.roots:
            made.append(_Part(root, "", True))
            made += [_Part(root, e.name, False) for e in sorted(os.scandir(root), key=lambda e: e.name) if e.is_dir(follow_symlinks=False)]
        return made

    def read(self, part: _Part) -> Iterator[tuple]:
        patterns = patterns_of(part.root, self.ignore_file)
        repo = os.path.basename(os.path.normpath(part.root))
        if part.top and ignored(part.top, part.top, patterns, True):
            return
        for folder, folders, files in os.walk(os.path.join(part.root, part.top)):
            rel = os.path.relpath(folder, part.root).replace(os.sep, "/")
            prefix = "" if rel == "." else rel + "/"
            folders[:] = [] if part.files_only else [d for d in sorted(folders) if not ignored(prefix + d, d, patterns, True)]
            for name in sorted(files):
                if ignored(prefix + name, name, patterns, False):
                    if not prefix and name in LOCKS:
                        yield repo, name, None, None, None
                    continue
                full = os.path.join(folder, name)
                try:
                    size = os.stat(full).st_size
                    yield repo, prefix + name, size, self.content(full, name, prefix, size), False
                except OSError:
                    yield repo, prefix + name, None, None, True

    def content(self, full: str, name: str, prefix: str, size: int) -> bytes | None:
        ext = name[1:].rpartition(".")[2].lower() if "." in name[1:] else ""
        wanted = ext in tables.CODE or not ext or name in READ or prefix == ".github/workflows/"
        if not wanted or size > self.cap:
            return None
        with open(full, "rb") as f:
            if ext or name in READ or f.read(2) == b"#!":
                f.seek(0)
                return f.read()
        return None


class TreeSource(DataSource):
    """``spark.read.format("repotree").load("/path/a,/path/b")``"""

    @classmethod
    def name(cls) -> str:
        return "repotree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, *roots: str, ignore_file: str | None = None, max_file_bytes: int | None = None):
    """(repo, path, size, content, error) of the files of repositories' working trees."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("repotree")
    for k, v in (("ignoreFile", ignore_file), ("maxFileBytes", max_file_bytes)):
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load(",".join(roots))
