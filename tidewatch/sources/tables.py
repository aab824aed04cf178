"""The test tables read in the roles of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def rides_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_rides(table(spark, sf_dir, "events"))


def as_rides(events: DataFrame) -> DataFrame:
    """Ride requests: zone from ``event_type``, passengers from ``props``."""
    return events.select(
        F.col("event_id").cast("string").alias("request_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("customer_email"),
        F.col("event_type").alias("pickup_zone"),
        F.concat(F.lit("stop-"), (F.col("user_id") % 7).cast("string")).alias("drop_off_zone"),
        F.col("value").alias("price"),
        (_k() % 6 + 1).cast("int").alias("number_of_passengers"),
        F.col("ts").cast("timestamp").alias("request_ts"),
    )


def rides_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second series: shipped lines as rides, zone from the supplier's nation."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("request_id"),
            F.col("n_name").alias("pickup_zone"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").cast("int").alias("number_of_passengers"),
            F.col("l_shipdate").cast("timestamp").alias("request_ts"),
        )
    )


def vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as vessels; one in four is not available."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", "s_name", "s_nationkey")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_name").alias("vessel_id"),
            F.concat(F.lit("Boat "), key.cast("string")).alias("vessel_name"),
            F.col("n_name").alias("base_zone"),
            F.when(key % 4 == 0, F.lit("in_dock")).otherwise(F.lit("available")).alias("availability"),
            (5 + key % 5).cast("int").alias("capacity"),
            F.col("n_name").alias("current_zone"),
        )
    )


def zone_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stops of one path: zone, idx."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("zone"), F.col("n_nationkey").alias("idx"))


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path point per nation, zig-zagging west."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.alias("idx"),
        (F.lit(-90.0) - key * F.lit(0.01)).alias("lon"),
        (F.lit(29.9) + (key % 5) * F.lit(0.02)).alias("lat"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as calendar events spread over January 2024.

    Starts and ends are given as a day and hours, so events that cross midnight
    arrive with an end before their start, as in hand-written calendars.
    """
    doc = F.col("doc_id")
    zones = F.array(*[F.lit(z) for z in ("click", "error", "purchase", "signup", "view")])
    impacts = F.array(*[F.lit(z) for z in ("high", "medium", "low")])
    day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((doc % 30).cast("int"))
    start_hour = (doc * 7 % 24).cast("int")
    end_hour = ((doc * 7 + 1 + doc % 5) % 24).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("Event "), doc.cast("string")).alias("event_name"),
        F.element_at(zones, (doc % 5 + 1).cast("int")).alias("zone"),
        F.col("text").alias("description"),
        F.concat(F.lit("Hall "), F.col("lang")).alias("venue"),
        F.col("n_chars").cast("int").alias("expected_attendance"),
        F.col("source").alias("event_type"),
        F.element_at(impacts, (doc % 3 + 1).cast("int")).alias("impact_level"),
        (day + F.make_dt_interval(F.lit(0), start_hour)).alias("event_time_start"),
        (day + F.make_dt_interval(F.lit(0), end_hour)).alias("event_time_end"),
    )


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the text of the document of the same id."""
    zones = F.array(*[F.lit(z) for z in ("click", "error", "purchase", "signup", "view")])
    impacts = F.array(*[F.lit(z) for z in ("high", "medium", "low")])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return (
        table(spark, sf_dir, "embeddings")
        .join(docs, F.col("vec_id") == F.col("doc_id"), "left")
        .select(
            F.col("vec_id").cast("string").alias("document_id"),
            F.col("text").alias("chunk"),
            "embedding",
            F.element_at(zones, (F.col("label") % 5 + 1).cast("int")).alias("zone"),
            F.element_at(impacts, (F.col("vec_id") % 3 + 1).cast("int")).alias("impact_level"),
            F.when(F.col("label") < 7, F.lit("m-2")).otherwise(F.lit("m-1")).alias("embedding_model"),
        )
    )
