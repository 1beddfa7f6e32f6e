"""Queries of the problems on text and pairs, and their SQL."""

from __future__ import annotations

from repolith.llm import queries_corpus, queries_pairs

QUERIES = {**queries_corpus.QUERIES, **queries_pairs.QUERIES}
SQL = {**queries_corpus.SQL, **queries_pairs.SQL}
