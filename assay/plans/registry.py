"""All queries of the engine's own operators: importing the modules registers them."""

from __future__ import annotations

from . import artifact_queries, audit_queries, import_queries, io_queries, qa_queries, report_queries  # noqa: F401
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
