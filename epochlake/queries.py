"""Registered queries of the trial, event and signal operators, and their SQL."""

from __future__ import annotations

from .plans import aggs_queries, columns_queries, events_queries, joins_queries, ordered_queries, signal_queries, source_queries, trace_queries  # noqa: F401
from .plans.base import ORACLES, QUERIES  # noqa: F401
