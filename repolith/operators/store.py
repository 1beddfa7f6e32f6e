"""The store of entities: upserts, lookups, identifiers, hashes.

A table is a DataFrame; an upsert gives the next state.  Which columns an update
may change differs by entity, so it is a parameter and never "latest row wins".
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Columns that an update replaces, by entity; the others keep their first value.
UPDATED = {
    "repos": ["description", "primary_language", "stars", "forks", "is_archived", "pushed_at", "last_synced_at"],
    "commits": ["authored_at"],
    "issues": ["title", "state", "labels_json", "closed_at"],
    "releases": ["name", "published_at", "notes"],
}
# Entity kinds and their verdicts.
KINDS = ("repo", "commit", "issue", "release")
VERDICTS = ("dead", "revisit", "keep")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of each key the one that is last in ``order``, then in all its columns; partial before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), *rest)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def upsert(state: DataFrame, updates: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """The state after the updates (one row per key in each): new keys come in, known ones change in ``updated`` only."""
    rest = [c for c in state.columns if c not in keys]
    new = updates.select(*keys, F.struct(*rest).alias("_new"))
    old = state.select(*keys, F.struct(*rest).alias("_old"))
    joined = old.join(new, keys, "full")
    cols = []
    for c in rest:
        first, second = ("_new", "_old") if c in updated else ("_old", "_new")
        cols.append(F.when(F.col(first).isNotNull(), F.col(first)[c]).otherwise(F.col(second)[c]).alias(c))
    return joined.select(*keys, *cols)


def insert_ignore(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The state with the rows whose key it doesn't have."""
    return state.unionByName(rows.join(state.select(*keys), keys, "left_anti").select(*state.columns))


def upsert_cursor(state: DataFrame, updates: DataFrame) -> DataFrame:
    """sync_state after a run: the time is replaced, the cursor only by one that is not null."""
    new = updates.select("entity", F.col("last_synced_at").alias("_t"), F.col("cursor").alias("_c"))
    return state.join(new, "entity", "full").select("entity", F.coalesce("_t", "last_synced_at").alias("last_synced_at"), F.coalesce("_c", "cursor").alias("cursor"))


def cascade_delete(child: DataFrame, gone: DataFrame, foreign: str, key: str) -> DataFrame:
    """The child rows whose parent is not deleted."""
    return child.join(gone.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def entity_id(connector: Column, kind: Column, native: Column) -> Column:
    """``connector:kind:native``; null where a part is not valid (a native id is not empty and has no colon)."""
    ok = connector.rlike("^[a-z0-9_-]+$") & kind.rlike("^[a-z_]+$") & (native != "") & ~native.contains(":")
    return F.when(ok, F.concat_ws(":", connector, kind, native))


def entity_parts(ident: Column) -> dict[str, Column]:
    """connector, kind and native id of an identifier; null where it is not valid."""
    pattern = r"^([a-z0-9_-]+):([a-z_]+):([^:]+)$"
    return {n: F.when(ident.rlike(pattern), F.regexp_extract(ident, pattern, i)) for i, n in enumerate(("connector", "kind", "native_id"), 1)}


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed form (no built-in function has it); only texts beyond ASCII are touched."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize_content(text: Column) -> Column:
    """Composed characters, one kind of line end, no blanks at the ends of lines."""
    composed = F.when(text.rlike(r"[^\x00-\x7f]"), nfc(F.make_valid_utf8(text))).otherwise(text)
    return F.regexp_replace(F.replace(composed, F.lit("\r\n"), F.lit("\n")), r"[\t\x0b\f\r \x1c-\x1f\x{85}\p{Z}]+(?=\n|\z)", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of a text's normalized form."""
    return F.sha2(normalize_content(text), 256)


def source_uri(kind: Column, full_name: Column, native: Column, host: str = "https://github.com") -> Column:
    """Where an entity can be seen, by kind; empty for kinds that have no page."""
    base = F.concat(F.lit(f"{host}/"), full_name)
    return (
        F.when(kind == "repo", base)
        .when(kind == "commit", F.concat(base, F.lit("/commit/"), F.substring_index(native, "@", -1)))
        .when(kind == "issue", F.concat(base, F.lit("/issues/"), F.substring_index(native, "#", -1)))
        .otherwise("")
    )
