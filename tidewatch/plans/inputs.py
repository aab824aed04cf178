"""Derived inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.aggregates import zone_traffic
from tidewatch.operators.rows import zone_traffic_sink
from tidewatch.plans.surge import surge_anomalies
from tidewatch.session import materialize
from tidewatch.sources import tables as t

EVENT_WINDOW, LINE_WINDOW, CONFIDENCE = "1 hour", "7 days", 99.0


def traffic(spark: SparkSession, d: str) -> DataFrame:
    return zone_traffic(t.rides_from_events(spark, d), EVENT_WINDOW)


def line_traffic(spark: SparkSession, d: str) -> DataFrame:
    return zone_traffic(t.rides_from_lineitem(spark, d), LINE_WINDOW)


def sunk_traffic(spark: SparkSession, d: str) -> DataFrame:
    return zone_traffic_sink(traffic(spark, d))


def surges(spark: SparkSession, d: str) -> DataFrame:
    return surge_anomalies(t.rides_from_events(spark, d), EVENT_WINDOW, confidence=CONFIDENCE)


def line_surges(spark: SparkSession, d: str) -> DataFrame:
    return surge_anomalies(t.rides_from_lineitem(spark, d), LINE_WINDOW, confidence=CONFIDENCE, chunk_seconds=365 * 86_400)


def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    return as_raw(t.table(spark, d, "events"))


def as_raw(events: DataFrame) -> DataFrame:
    """Messages of an older producer: missing zones, times as numbers, text or nothing."""
    k = F.get_json_object("props", "$.k").cast("int") % 5
    ts = F.col("ts").cast("timestamp")
    shown = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    kinds = F.array(F.unix_millis(ts).cast("string"), F.lit(None), F.lit("soon"), shown, shown)
    start = F.element_at(kinds, k + 1)
    return events.select(
        "event_id",
        F.when(F.col("user_id") % 11 != 0, F.col("event_type")).alias("zone"),
        start.alias("window_start"),
        "value",
    )


def dispatches(spark: SparkSession, d: str) -> DataFrame:
    """Dispatches of the weekly series: half name a boat, the others hold no JSON."""
    s = line_surges(spark, d)
    boat = F.lpad((F.col("request_count") % 10).cast("string"), 9, "0")
    listed = F.concat(
        F.lit('[{"vessel_id":"Supplier#'), boat, F.lit('","new_zone":"'), "pickup_zone", F.lit('"},{"new_zone":"x"}]')
    )
    log = s.select(
        "pickup_zone",
        "window_time",
        "request_count",
        F.when(F.col("request_count") % 2 == 0, listed).otherwise(F.lit("no boats named")).alias("dispatch_json"),
    )
    return materialize(log, "dispatches")


def dispatch_log(spark: SparkSession, d: str) -> DataFrame:
    """Log rows per zone and hour; quiet hours carry no dispatch time."""
    return traffic(spark, d).select(
        "pickup_zone",
        "window_time",
        F.when(
            F.col("request_count") > 1,
            F.col("window_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("total_passengers") * 60),
        ).alias("dispatched_at"),
        F.concat(
            F.lit("<tool_call>{}</tool_call>**Dispatch Summary:** Sent "),
            F.col("request_count").cast("string"),
            F.lit(" boats.\n\n**Dispatch JSON:**\n{}"),
        ).alias("dispatch_summary"),
        F.concat(F.lit('{"boats":'), F.col("request_count").cast("string"), F.lit("}")).alias("dispatch_json"),
    )


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns wrapped the way agents reply, in four shapes."""
    shape, text = F.col("turn") % 4, F.col("text")
    tools = F.lit('Let me look.\n<tool_call> {"name": "list"} </tool_call>\n<TOOL_RESPONSE> [1,\n2] </TOOL_RESPONSE>\n\n')
    reply = (
        F.when(shape == 0, F.concat(tools, F.lit("**Dispatch Summary:** "), text, F.lit("\n\n**Dispatch JSON:**\n{}\n\nAPI Response:\n{}")))
        .when(shape == 1, F.concat(F.lit("Dispatch Summary:\n"), text, F.lit("\n\nDispatch JSON:\n```json\n{\"a\": 1}\n```\n\nAPI Response:\n{\"ok\": true}")))
        .when(shape == 2, F.concat(tools, text, F.lit("\n\n\n\nDispatch JSON: {}")))
        .otherwise(F.concat(F.lit("__"), text, F.lit("__ \n")))
    )
    return t.table(spark, d, "conversations").select("conv_id", "turn", reply.alias("reply"))


def leaky_notes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a credential line made from their own ids."""
    doc = F.col("doc_id").cast("string")
    line = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("\npassword=hunter"), doc, F.lit("; user=bob")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit('\n{"api_key": "k'), doc, F.lit('-0123456789"}')))
        .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("\nAuthorization: Bearer abc"), doc, F.lit("DEFGHIJK end")))
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit("\nmongodb+srv://bob:p"), doc, F.lit("w@host/db secret: 'ab'")))
        .otherwise(F.lit(""))
    )
    return t.table(spark, d, "documents").select("doc_id", F.concat("text", line).alias("text"))


RAW_LOG_SQL = """log AS (
  SELECT pickup_zone, window_time,
         CASE WHEN request_count > 1 THEN window_time + to_minutes(CAST(total_passengers AS INTEGER)) END AS dispatched_at,
         '<tool_call>{}</tool_call>**Dispatch Summary:** Sent ' || request_count || ' boats.' || chr(10) || chr(10)
           || '**Dispatch JSON:**' || chr(10) || '{}' AS dispatch_summary,
         '{"boats":' || request_count || '}' AS dispatch_json
  FROM traffic)"""

DISPATCHES_SQL = """dispatches AS (
  SELECT pickup_zone, window_time, request_count,
         CASE WHEN request_count % 2 = 0 THEN '[{"vessel_id":"Supplier#' || lpad(CAST(request_count % 10 AS VARCHAR), 9, '0')
           || '","new_zone":"' || pickup_zone || '"},{"new_zone":"x"}]' ELSE 'no boats named' END AS dispatch_json
  FROM surges)"""

TRANSCRIPT_SQL = """replies AS (
  SELECT conv_id, turn, CASE turn % 4
    WHEN 0 THEN 'Let me look.' || chr(10) || '<tool_call> {"name": "list"} </tool_call>' || chr(10)
      || '<TOOL_RESPONSE> [1,' || chr(10) || '2] </TOOL_RESPONSE>' || chr(10) || chr(10) || '**Dispatch Summary:** ' || text
      || chr(10) || chr(10) || '**Dispatch JSON:**' || chr(10) || '{}' || chr(10) || chr(10) || 'API Response:' || chr(10) || '{}'
    WHEN 1 THEN 'Dispatch Summary:' || chr(10) || text || chr(10) || chr(10) || 'Dispatch JSON:' || chr(10) || '```json' || chr(10)
      || '{"a": 1}' || chr(10) || '```' || chr(10) || chr(10) || 'API Response:' || chr(10) || '{"ok": true}'
    WHEN 2 THEN 'Let me look.' || chr(10) || '<tool_call> {"name": "list"} </tool_call>' || chr(10)
      || '<TOOL_RESPONSE> [1,' || chr(10) || '2] </TOOL_RESPONSE>' || chr(10) || chr(10) || text
      || chr(10) || chr(10) || chr(10) || chr(10) || 'Dispatch JSON: {}'
    ELSE '__' || text || '__ ' || chr(10) END AS reply
  FROM conversations)"""

NOTES_SQL = """notes AS (
  SELECT doc_id, text || CASE doc_id % 5
    WHEN 0 THEN chr(10) || 'password=hunter' || doc_id || '; user=bob'
    WHEN 1 THEN chr(10) || '{"api_key": "k' || doc_id || '-0123456789"}'
    WHEN 2 THEN chr(10) || 'Authorization: Bearer abc' || doc_id || 'DEFGHIJK end'
    WHEN 3 THEN chr(10) || 'mongodb+srv://bob:p' || doc_id || 'w@host/db secret: ''ab'''
    ELSE '' END AS text
  FROM documents)"""
