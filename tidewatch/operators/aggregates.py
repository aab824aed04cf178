"""Windowed traffic and the other grouped summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zones shown before any traffic exists.
FALLBACK_ZONES = [
    "Bywater",
    "Central Business District (CBD)",
    "French Quarter",
    "Garden District",
    "Marigny",
    "Uptown",
    "Warehouse District",
]


def zone_traffic(rides: DataFrame, size: str = "1 minute", start: str | None = None) -> DataFrame:
    """Tumbling windows per zone; the same code for tables and streams.

    Counts and sums are combined before the shuffle, so a zone holding most of
    the rides still sends one row per window and task.
    """
    return (
        rides.groupBy(F.window("request_ts", size, startTime=start).alias("w"), "pickup_zone")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.sum("number_of_passengers").alias("total_passengers"),
            F.sum(F.col("price").cast("decimal(10,2)")).alias("total_revenue"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            (F.col("w.end") - F.expr("INTERVAL '0.001' SECOND")).alias("window_time"),
            "pickup_zone",
            "request_count",
            "total_passengers",
            "total_revenue",
        )
    )


def heat_map(traffic: DataFrame) -> DataFrame:
    numbers = ("request_count", "total_passengers", "total_revenue")
    return traffic.groupBy("zone").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in numbers])


def zones(traffic: DataFrame, fallback: Sequence[str] = FALLBACK_ZONES) -> DataFrame:
    """Distinct zones in order; the fallback list when there is no row at all."""
    found = traffic.select("zone").where(F.col("zone").isNotNull()).distinct()
    spark = traffic.sparkSession
    spare = spark.range(1).select(F.explode(F.array(*[F.lit(z) for z in fallback])).alias("zone"))
    none = found.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    return found.unionByName(spare.where(none.scalar())).orderBy("zone")


def table_counts(tables: Mapping[str, tuple[DataFrame | None, str | None]], cutoff: Column | None = None) -> DataFrame:
    """(label, value) per table. A table that is not there counts NULL, never 0.

    ``tables`` maps a label to (table, time column); with a cutoff only rows from
    then on count, where a time column is named.
    """
    parts = []
    for label, (df, time) in tables.items():
        if df is None:
            continue
        if cutoff is not None and time is not None:
            df = df.where(F.col(time) >= cutoff)
        parts.append(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(label).alias("label"), "value"))
    spark = next(df for df, _ in tables.values() if df is not None).sparkSession
    for label in (n for n, (df, _) in tables.items() if df is None):
        parts.append(spark.range(1).select(F.lit(label).alias("label"), F.lit(None).cast("long").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Labels of the summary figures.
KPI_LABELS = {
    "ride_requests": "Ride Requests",
    "zone_traffic": "Traffic Windows",
    "anomalies": "Anomalies Detected",
    "dispatches": "Dispatches Logged",
    "knowledge_base": "KB Events",
}


def kpi_rows(counts: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in KPI_LABELS.items() for x in pair])
    return counts.select(F.coalesce(F.try_element_at(names, "label"), "label").alias("label"), "value")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    present = [F.col(k).isNotNull() for k in keys]
    for cond in present:
        df = df.where(cond)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def status_rollup(checks: DataFrame, group: str = "component_group", status: str = "status") -> DataFrame:
    """Any fail: unhealthy; else any ok: healthy; else unknown. Warnings never fail."""
    fail, ok = F.bool_or(F.col(status) == "fail"), F.bool_or(F.col(status) == "ok")
    return checks.groupBy(group).agg(
        F.when(F.coalesce(fail, F.lit(False)), F.lit("unhealthy"))
        .when(F.coalesce(ok, F.lit(False)), F.lit("healthy"))
        .otherwise(F.lit("unknown"))
        .alias("overall"),
        F.count_if(F.col(status) == "warn").alias("warnings"),
    )


# Stages a change may pass.
STAGES = ["requests", "window", "detect", "context", "agent", "dispatch"]


def stage_counters(feed: DataFrame) -> DataFrame:
    """Counters per stage of a change feed; also runs in update mode on a stream.

    ``feed``: collection, request_count, has_evidence. Each change adds to the
    stages it passes; the number of requests comes from the traffic rows. A table
    gives every stage, with 0 where nothing passed.
    """
    c = F.col("collection")
    traffic, anomaly, dispatch = (c == x for x in ("zone_traffic", "zone_anomalies", "dispatch_log"))

    def step(stage: str, amount) -> Column:
        return F.struct(F.lit(stage).alias("stage"), F.coalesce(amount, F.lit(0)).cast("long").alias("amount"))

    steps = (
        F.when(traffic, F.array(step("requests", F.col("request_count")), step("window", F.lit(1))))
        .when(anomaly, F.array(step("detect", F.lit(1)), step("context", F.col("has_evidence").cast("int"))))
        .when(dispatch, F.array(step("agent", F.lit(1)), step("dispatch", F.lit(1))))
    )
    amounts = feed.select(F.inline(steps))
    if not feed.isStreaming:
        none = F.array(*[step(s, F.lit(0)) for s in STAGES])
        amounts = amounts.unionByName(feed.sparkSession.range(1).select(F.inline(none)))
    return amounts.groupBy("stage").agg(F.sum("amount").alias("value"))


def latest_per_zone(traffic: DataFrame, zone: str = "zone", time: str = "window_start", value: str = "request_count") -> DataFrame:
    """Newest value of each zone; combined map-side, one row per zone and task moves."""
    newest = F.max(F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    return traffic.groupBy(zone).agg(newest.alias("m")).select(
        zone, F.col("m.t").alias(time), F.col("m.v").alias(value)
    )


def chart_domain(traffic: DataFrame, time: str = "window_start", value: str = "request_count") -> DataFrame:
    """First and last time at least a minute apart, and the top value, at least 1."""
    t0, t1 = F.min(time), F.max(time)
    return traffic.agg(
        t0.alias("t0"),
        F.greatest(t1, t0 + F.expr("INTERVAL 60 SECONDS")).alias("t1"),
        F.greatest(F.max(value), F.lit(1)).cast("long").alias("n_max"),
    ).where(F.col("t0").isNotNull())
