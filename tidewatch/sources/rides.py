"""Ride-request scans: declared-schema read, captured messages, event-time rebase."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.schemas import CAPTURED, RIDES

DISORDER = "5 seconds"


def read_rides(spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet", **options) -> DataFrame:
    """Rides as a table, or as a stream with its watermark.

    ``fmt="kafka"`` goes through the same call where the connector is on the
    classpath; its value column is then decoded with :func:`decode_wire`.
    """
    if stream:
        return with_event_time(spark.readStream.format(fmt).options(**options).schema(RIDES).load(path))
    return spark.read.format(fmt).options(**options).schema(RIDES).load(path)


def with_event_time(rides: DataFrame, delay: str = DISORDER) -> DataFrame:
    """Bounded disorder on ``request_ts``; zone-less timestamps are read as UTC."""
    return rides.withColumn("request_ts", F.col("request_ts").cast("timestamp")).withWatermark("request_ts", delay)


# -- captured messages: base64 of 0x00, 4-byte schema id, Avro record ---------


def read_captured(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTURED).json(path)


def wire_bytes(value: str = "value") -> Column:
    return F.try_to_binary(F.col(value), F.lit("base64"))


def wire_schema_id(raw: Column) -> Column:
    """Schema id of a message, null when it is not in wire format."""
    framed = (F.length(raw) >= 5) & (F.hex(F.substring(raw, 1, 1)) == "00")
    return F.when(framed, F.conv(F.hex(F.substring(raw, 2, 4)), 16, 10).cast("long"))


def schema_audit(captured: DataFrame) -> DataFrame:
    """Messages per embedded schema id; ``in_wire_format=false`` counts the others."""
    sid = wire_schema_id(wire_bytes())
    return (
        captured.select(sid.alias("schema_id"))
        .groupBy("schema_id")
        .agg(F.count(F.lit(1)).alias("messages"))
        .withColumn("in_wire_format", F.col("schema_id").isNotNull())
    )


def ride_avro(body: Column) -> Column:
    """An Avro ride record as a struct, where the connector is on the classpath; null for a bad record."""
    from pyspark.sql.avro.functions import from_avro

    kinds = {"string": "string", "double": "double", "integer": "int", "timestamp": {"type": "long", "logicalType": "timestamp-millis"}}
    fields = [{"name": f.name, "type": kinds[f.dataType.typeName()]} for f in RIDES.fields]
    return from_avro(body, json.dumps({"type": "record", "name": "ride", "fields": fields}), {"mode": "PERMISSIVE"})


def decode_wire(captured: DataFrame, body: Callable[[Column], Column] = ride_avro) -> DataFrame:
    """Captured messages as partition, offset, schema_id, the fields of ``body`` and ``error``; no row is dropped.

    ``body`` turns the bytes behind the frame into a struct, or null where they are no
    record. Rows with ``error`` (not_wire_format, bad_record) have no fields and go to the
    dead-letter table, see ``operators.validate``.
    """
    framed = captured.withColumn("__raw", wire_bytes()).withColumn("__schema", wire_schema_id(F.col("__raw")))
    payload = F.when(F.col("__schema").isNotNull(), F.expr("substring(__raw, 6)"))
    read = framed.withColumn("__body", payload).withColumn("__fields", body(F.col("__body")))
    error = F.when(F.col("__schema").isNull(), "not_wire_format").when(F.col("__fields").isNull(), "bad_record")
    return read.select("partition", "offset", F.col("__schema").alias("schema_id"), "__fields.*", error.alias("error"))


# -- event-time rebase --------------------------------------------------------


def rebase(df: DataFrame, ends_at: datetime | str, ts: str = "request_ts") -> DataFrame:
    """Shift every timestamp so that the newest one lands on ``ends_at``.

    The newest value is one aggregate row joined back (a scalar subquery), so
    one pass over the footer-sized column decides the shift on the cluster.
    """
    newest = df.agg(F.max(F.unix_micros(ts)).alias("__newest"))
    target = F.unix_micros(F.lit(str(ends_at)).cast("timestamp"))
    shifted = F.timestamp_micros(F.unix_micros(ts) + target - newest.scalar())
    return df.withColumn(ts, shifted)
