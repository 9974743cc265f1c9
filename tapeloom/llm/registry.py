"""All queries of this folder."""

from __future__ import annotations

from tapeloom.llm import q_documents  # noqa: F401
from tapeloom.llm.catalog import QUERIES, SQL


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)
