"""The warm-start snapshot of a reader: six result sets in one call."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame

from tidewatch.operators.aggregates import table_counts
from tidewatch.operators.joins import home_zones
from tidewatch.operators.rows import json_safe
from tidewatch.operators.topk import (
    SNAPSHOT_ANOMALIES,
    knowledge_rows,
    latest_anomalies,
    newest_oldest_first,
    recent_or_latest,
    snapshot,
)
from tidewatch.session import materialize


def written(section: DataFrame) -> DataFrame:
    """Run a section now, so that its failure shows here."""
    return materialize(section, "section")


def warm_start(
    tables: Mapping[str, Callable[[], DataFrame]], now: Column, action: Callable[[DataFrame], object] = written
) -> dict[str, object]:
    """``tables``: functions giving vessels, anomalies, dispatches, knowledge, traffic.

    Every section is built and run on its own; one that fails is ``None``. By
    default a section is a table written to the shared folder, since the vessel
    list grows with the fleet; ``action`` must run the section, not only name it.
    """
    sections = {
        "vessels": lambda: home_zones(tables["vessels"]()),
        "anomalies": lambda: json_safe(latest_anomalies(tables["anomalies"](), n=SNAPSHOT_ANOMALIES)),
        "dispatches": lambda: json_safe(recent_or_latest(tables["dispatches"](), now)),
        "knowledge": lambda: json_safe(knowledge_rows(tables["knowledge"]())),
        "traffic": lambda: json_safe(
            newest_oldest_first(tables["traffic"]().select("zone", "window_start", "request_count"))
        ),
        "counts": lambda: table_counts({n: (t(), None) for n, t in tables.items() if n != "vessels"}),
    }
    return snapshot(sections, action)
