"""Queries of the engine."""

from . import admission, evaluation, groups, more, patching, pipeline, transitions, views
from .registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
