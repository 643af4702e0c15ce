"""All queries of the text-overlap engine and their DuckDB twins."""

from __future__ import annotations

from textloom.plans import corpus, tables, texts

FLAGSHIP = "coverage"
QUERIES: dict = {**texts.QUERIES, **tables.QUERIES, **corpus.QUERIES}
SQL: dict = {**texts.SQL, **tables.SQL, **corpus.SQL}
