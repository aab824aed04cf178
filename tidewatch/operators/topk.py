"""Sorted and limited reads. Every limit is the feature of its report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.keyed import keep_latest
from tidewatch.operators.rows import in_zones, project, since

# Sizes of the reports.
SERIES, LATEST, SNAPSHOT_ANOMALIES, MAP_ROWS, MAP_SPARE, CHART_ROWS, QUEUE, FEED, CARDS = 500, 50, 20, 50, 5, 340, 30, 60, 12


def traffic_series(traffic: DataFrame, zones: Sequence[str] = (), cutoff=None, n: int = SERIES) -> DataFrame:
    chosen = since(in_zones(traffic, zones), cutoff, "window_start")
    return chosen.orderBy("window_start", "zone").limit(n)


def latest_anomalies(anomalies: DataFrame, zones: Sequence[str] = (), cutoff=None, n: int = LATEST) -> DataFrame:
    chosen = since(in_zones(anomalies, zones, "pickup_zone"), cutoff, "window_time")
    return chosen.orderBy(F.desc("window_time"), "pickup_zone").limit(n)


def recent_or_latest(
    dispatches: DataFrame,
    now: Column,
    minutes: int = 15,
    n: int = MAP_ROWS,
    spare: int = MAP_SPARE,
    time: str = "dispatched_at",
    tie: Sequence[str] = ("pickup_zone", "window_time"),
) -> DataFrame:
    """The last minutes' rows, or the newest ``spare`` ones when there are none.

    One sort with limit; the choice is made on the at most ``n`` rows it leaves.
    """
    top = dispatches.orderBy(F.desc(time), *tie).limit(max(n, spare))
    recent = F.coalesce(F.col(time) >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), F.lit(False))
    rank = F.row_number().over(Window.orderBy(F.desc(time), *tie))
    seen = top.withColumns({"__recent": recent, "__rank": rank})
    any_recent = F.max("__recent").over(Window.partitionBy())
    keep = F.when(any_recent, F.col("__recent") & (F.col("__rank") <= n)).otherwise(F.col("__rank") <= spare)
    return seen.withColumn("__keep", keep).where("__keep").drop("__recent", "__rank", "__keep")


def newest_oldest_first(traffic: DataFrame, n: int = CHART_ROWS) -> DataFrame:
    top = traffic.orderBy(F.desc("window_start"), "zone").limit(n)
    return top.orderBy("window_start", F.desc("zone"))


def dispatch_log(log: DataFrame, cutoff=None, n: int = LATEST) -> DataFrame:
    return since(log, cutoff, "dispatched_at").orderBy(F.desc("dispatched_at"), "pickup_zone", "window_time").limit(n)


def newest_unique(df: DataFrame, keys: Sequence[str], time: str, n: int = QUEUE, tie: Sequence[str] = ()) -> DataFrame:
    """The ``n`` newest keys, each with its newest row."""
    return keep_latest(df, keys, time, tie).orderBy(F.desc(time), *keys).limit(n)


def knowledge_rows(kb: DataFrame, n: int = CARDS) -> DataFrame:
    return project(kb, drop=["embedding"]).orderBy("document_id").limit(n)


def snapshot(sections: Mapping[str, Callable[[], DataFrame]], action: Callable[[DataFrame], object]) -> dict[str, object]:
    """Several result sets in one call; a section that fails is empty (None)."""
    out: dict[str, object] = {}
    for name, build in sections.items():
        try:
            out[name] = action(build())
        except Exception:  # noqa: BLE001 - one broken section must not blank the others
            out[name] = None
    return out
