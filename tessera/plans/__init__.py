"""The registered queries: QUERIES by name, ORACLES with the SQL for the same rows."""

from . import answers, costs, dialogue, evaluation, extras, facts, graphs, layout, ledger, lexicons, operations, publishing, quality, reports, retrieval, segments, sourcing, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
