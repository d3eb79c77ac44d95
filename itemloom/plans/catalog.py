"""The named queries over the tables of a data folder, and their DuckDB counterparts.

Papers are orders and questions their lines (score: quantity, difficulty: ten times the discount);
usage is the events table; the concept tree is region / nation / supplier; texts are documents.
"""

from __future__ import annotations

from itemloom.plans import bank, evaluation, exam, ingest, lifecycle, papers, similar, tagging, trees, usage  # noqa: F401  they register
from itemloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
