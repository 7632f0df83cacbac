"""Named queries over the test tables, each with the SQL that must give the same rows."""

from vectrail.plans.catalog import embedding, ingest, quantization, scoring, searching, storage
from vectrail.plans.catalog.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "embedding",
    "ingest",
    "quantization",
    "scoring",
    "searching",
    "storage",
]
