"""All registered queries; importing the modules fills the registry."""

from tidewatch.plans import queries_fleet, queries_more, queries_scan, queries_stream, queries_tables, queries_text  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
