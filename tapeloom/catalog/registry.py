"""All registered queries."""

from __future__ import annotations

from tapeloom.catalog import events, features, indicators, metrics, monitor, portfolio, signals, sources, streams, studies, trades  # noqa: F401
from tapeloom.catalog.base import QUERIES, SQL


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)
