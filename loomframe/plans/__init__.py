"""Registered queries: operators bound to the test tables, with the SQL that each must agree with."""

from loomframe.plans import corpus, items, lifecycle, records, runs, sessions, store, streams, text, vectors  # noqa: F401
from loomframe.plans.views import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
