"""Lookups, as-of matches and overlap joins.

No join is hinted to broadcast: with adaptive execution Spark broadcasts a side
once its measured size allows it, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.scans import asof, running_before, running_low, time_chunk

HOUR = 3600
DAY = 86_400


def home_zones(vessels: DataFrame) -> DataFrame:
    """vessel_id -> base_zone, without empty ids or zones."""
    return vessels.where((F.col("vessel_id") != "") & (F.col("base_zone") != "")).select("vessel_id", "base_zone")


def with_home_zone(boats: DataFrame, vessels: DataFrame, how: str = "inner") -> DataFrame:
    return boats.join(home_zones(vessels), "vessel_id", how)


def match_dispatches(anomalies: DataFrame, dispatches: DataFrame, chunk_seconds: int = DAY) -> DataFrame:
    """The anomaly each dispatch answers, one to one.

    A dispatch of the same (zone, window) matches first. The others, in order of
    ``dispatched_at``, each take the newest still open anomaly of their zone at or
    before that time, so a dispatch stays unmatched only if none is open then.

    Taking the newest open one is a stack: an anomaly goes onto it, a dispatch takes
    the top. The height after each event is a running sum above its running low,
    and a dispatch's anomaly is the last one put at the height it takes from.

    Both sides hold at most one row per (pickup_zone, window_time).
    """
    keys = ["pickup_zone", "window_time"]
    open_anomalies = anomalies.select(*keys).join(dispatches.select(*keys), keys, "left_anti")
    exact = dispatches.join(anomalies.select(*keys), keys, "left_semi").select(
        *keys, F.col("window_time").alias("dispatch_window"), "dispatched_at", F.lit("window").alias("matched_by")
    )
    loose = dispatches.join(anomalies.select(*keys), keys, "left_anti").where(F.col("dispatched_at").isNotNull())
    events = open_anomalies.select("pickup_zone", F.col("window_time").alias("at"), "window_time", F.lit(1).alias("step")).unionByName(
        loose.select("pickup_zone", F.col("dispatched_at").alias("at"), "window_time", F.lit(-1).alias("step"))
    )
    order = ["at", F.desc("step"), "window_time"]
    chunk = time_chunk("at", chunk_seconds)
    summed = running_before(events, ["pickup_zone"], order, chunk, {"__before": F.col("step")})
    placed = running_low(summed, ["pickup_zone"], order, chunk, "__before", "__low")
    height = F.col("__before") - F.least("__low", F.lit(0))
    placed = placed.withColumn("height", F.when(F.col("step") == 1, height + 1).otherwise(height))
    near = asof(
        placed.where("step = -1 AND height > 0").select("pickup_zone", "height", F.col("window_time").alias("dispatch_window"), F.col("at").alias("dispatched_at")),
        placed.where("step = 1").select("pickup_zone", "height", "window_time"),
        ["pickup_zone", "height"],
        "dispatched_at",
        "window_time",
        "hit",
        chunk_seconds,
    ).select("pickup_zone", F.col("hit.window_time").alias("window_time"), "dispatch_window", "dispatched_at", F.lit("as_of").alias("matched_by"))
    return exact.unionByName(near)


def nearest_window(
    probes: DataFrame,
    windows: DataFrame,
    probe_time: str,
    window_time: str = "window_start",
    keys: Sequence[str] = (),
    chunk_seconds: int = HOUR,
    salts: int = 8,
) -> DataFrame:
    """Each probe with the window nearest in time (the earlier one on a tie).

    Probes may be raw rows, many per instant and zone, hence the salts.
    """
    times = windows.select(*keys, F.col(window_time).alias("nearest")).distinct()
    before = asof(probes, times, keys, probe_time, "nearest", "__b", chunk_seconds, salts=salts)
    both = asof(before, times, keys, probe_time, "nearest", "__f", chunk_seconds, "forward", salts)
    at = F.unix_micros(probe_time)
    gap_b, gap_f = at - F.unix_micros("__b.nearest"), F.unix_micros("__f.nearest") - at
    nearer_before = F.col("__f").isNull() | (gap_b <= gap_f)
    return both.withColumn("nearest", F.when(nearer_before, F.col("__b.nearest")).otherwise(F.col("__f.nearest"))).drop(
        "__b", "__f"
    )


ENRICHED = ("anomaly_reason", "top_chunk_1", "top_chunk_2", "top_chunk_3")


def current_anomalies(
    base: DataFrame, enriched: DataFrame, keys: Sequence[str] = ("pickup_zone", "window_time"), fields: Sequence[str] = ENRICHED
) -> DataFrame:
    """Anomalies with their enrichment where there is one.

    Precedence is declared, not by arrival: enriched fields win over the sink's,
    so a replay of the sink never erases them.
    """
    overlay = enriched.select(*keys, *[F.col(f).alias(f"__e_{f}") for f in fields])
    joined = base.join(overlay, list(keys), "left")
    return joined.withColumns(
        {f: F.coalesce(F.col(f"__e_{f}"), F.col(f)) if f in base.columns else F.col(f"__e_{f}") for f in fields}
    ).drop(*[f"__e_{f}" for f in fields])


def without_evidence(
    anomalies: DataFrame,
    enriched: DataFrame,
    now: Column,
    delay_seconds: int = 40,
    arrival: str = "ingested_at",
    keys: Sequence[str] = ("pickup_zone", "window_time"),
) -> DataFrame:
    """Anomalies older than the delay that no enrichment has reached."""
    due = anomalies.where(F.col(arrival) <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay_seconds)))
    done = enriched.where(F.coalesce("top_chunk_1", F.lit("")) != "").select(*keys)
    return due.join(done, list(keys), "left_anti")


def normalise_midnight(events: DataFrame, start: str = "event_time_start", end: str = "event_time_end") -> DataFrame:
    """An end before the start belongs to the next day."""
    return events.withColumn(
        end, F.when(F.col(end) < F.col(start), F.col(end) + F.expr("INTERVAL 1 DAY")).otherwise(F.col(end))
    )


def overlapping_events(
    surges: DataFrame,
    events: DataFrame,
    hours: int = 1,
    time: str = "window_time",
    zone: str = "pickup_zone",
    bucket_seconds: int = 6 * HOUR,
) -> DataFrame:
    """Pairs of a surge and an event of its zone whose range meets the surge ± hours.

    Ranges are cut into buckets so the join is an equality on (zone, bucket); a
    pair that shares several buckets is kept in the first common one only.
    """
    step = hours * HOUR
    s_lo, s_hi = F.unix_seconds(time) - step, F.unix_seconds(time) + step

    def bucket(seconds: Column) -> Column:
        return F.floor(seconds / bucket_seconds)

    left = surges.withColumns({"__s0": bucket(s_lo), "__s1": bucket(s_hi)}).withColumn(
        "__bucket", F.explode(F.sequence("__s0", "__s1"))
    )
    e = normalise_midnight(events).withColumn("__zone", F.col("zone")).drop("zone")
    e_lo, e_hi = F.unix_seconds("event_time_start"), F.unix_seconds(F.coalesce("event_time_end", "event_time_start"))
    right = e.withColumns({"__e0": bucket(e_lo), "__e1": bucket(e_hi)}).withColumn(
        "__bucket", F.explode(F.sequence("__e0", "__e1"))
    )
    window = F.make_dt_interval(F.lit(0), F.lit(hours))
    meets = (F.col("event_time_start") <= F.col(time) + window) & (
        F.coalesce("event_time_end", "event_time_start") >= F.col(time) - window
    )
    pairs = left.join(right.withColumnRenamed("__bucket", "__b2"), (F.col(zone) == F.col("__zone")) & (F.col("__bucket") == F.col("__b2")))
    return pairs.where((F.col("__bucket") == F.greatest("__s0", "__e0")) & meets).drop(
        "__s0", "__s1", "__e0", "__e1", "__bucket", "__b2", "__zone"
    )


# Tables whose changes are fed to readers.
WATCHED = ["analytics.zone_anomalies", "fleet.dispatch_log", "analytics.zone_traffic", "events.knowledge_base"]


def watched(changes: DataFrame, collections: Sequence[str] | DataFrame = WATCHED) -> DataFrame:
    if isinstance(collections, DataFrame):
        return changes.join(collections.select("collection").distinct(), "collection", "left_semi")
    return changes.where(F.col("collection").isin(list(collections)))
