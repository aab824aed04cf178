"""Scans, sinks, filters, projections, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.exprs import as_timestamp, to_number
from tidewatch.operators import rows, validate
from tidewatch.operators.aggregates import zone_traffic
from tidewatch.plans import inputs as i
from tidewatch.plans.registry import (
    CALENDAR_SQL,
    EVENT_SURGES,
    EVENT_TRAFFIC,
    KB_SQL,
    MINUTE_US,
    RAW_SQL,
    RIDES,
    query,
    traffic_sql,
)
from tidewatch.sources import rides, sinks
from tidewatch.sources import tables as t
from tidewatch.sources.schemas import RIDES as RIDE_FIELDS


@query("s1_rides", f"WITH {RIDES} SELECT * FROM rides")
def _(spark, d):
    return t.rides_from_events(spark, d)


@query(
    "s2_decode_wire",
    f"""WITH {RIDES} SELECT request_id, customer_email, pickup_zone, drop_off_zone, price, number_of_passengers,
    date_trunc('milliseconds', request_ts) AS request_ts, 100042 AS schema_id FROM rides""",
)
def _(spark, d):
    """Every ride as a framed message with a JSON body, decoded to all its fields; a bad message would show as nulls."""
    fields = {f.name: f.dataType.simpleString() for f in RIDE_FIELDS} | {"request_ts": "bigint"}
    ride = t.rides_from_events(spark, d).withColumn("request_ts", F.unix_millis("request_ts"))
    sent = F.concat(F.lit(b"\x00\x00\x01\x86\xca"), F.to_json(F.struct(*fields)).cast("binary"))
    captured = ride.select(F.base64(sent).alias("value"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"))
    decoded = rides.decode_wire(captured, lambda body: F.from_json(body.cast("string"), ", ".join(f"{n} {k}" for n, k in fields.items())))
    return decoded.select(
        *[c for c in fields if c != "request_ts"], F.timestamp_millis("request_ts").alias("request_ts"), F.col("schema_id").cast("int").alias("schema_id")
    )


@query(
    "s2_split_wire",
    """SELECT event_id AS "offset", CASE WHEN user_id % 10 <> 0 THEN CAST(7 AS BIGINT) END AS schema_id,
    CASE WHEN user_id % 10 <> 0 AND user_id % 10 <> 1 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
    CASE user_id % 10 WHEN 0 THEN 'not_wire_format' WHEN 1 THEN 'bad_record' END AS error FROM events""",
)
def _(spark, d):
    """Framed messages split from others; JSON bodies read, cut ones marked."""
    bare = F.col("props").cast("binary")
    sent = F.when(F.col("user_id") % 10 == 1, F.expr("substring(cast(props AS binary), 1, 3)")).otherwise(bare)
    raw = F.when(F.col("user_id") % 10 == 0, bare).otherwise(F.concat(F.lit(b"\x00\x00\x00\x00\x07"), sent))
    captured = t.table(spark, d, "events").select(
        F.base64(raw).alias("value"), (F.col("user_id") % 6).cast("int").alias("partition"), F.col("event_id").alias("offset")
    )

    def body(column):
        fields = F.from_json(column.cast("string"), "k int")
        return F.when(fields["k"].isNotNull(), fields)

    return rides.decode_wire(captured, body).drop("partition")


@query(
    "s3_schema_audit",
    """SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(7 AS BIGINT) END AS schema_id, count(*) AS messages,
    user_id % 10 <> 0 AS in_wire_format FROM events GROUP BY ALL""",
)
def _(spark, d):
    framed = F.concat(F.lit(b"\x00\x00\x00\x00\x07"), F.col("props").cast("binary"))
    raw = F.when(F.col("user_id") % 10 == 0, F.col("props").cast("binary")).otherwise(framed)
    return rides.schema_audit(t.table(spark, d, "events").select(F.base64(raw).alias("value")))


@query(
    "s4_rebase",
    f"""WITH {RIDES}, newest AS (SELECT max(epoch_us(request_ts)) AS m FROM rides)
    SELECT request_id, make_timestamp(epoch_us(request_ts) + epoch_us(TIMESTAMP '2026-01-01 00:00:00') - m) AS request_ts
    FROM rides, newest""",
)
def _(spark, d):
    return rides.rebase(t.rides_from_events(spark, d).select("request_id", "request_ts"), "2026-01-01 00:00:00")


@query(
    "s5_zone_traffic_sink",
    f"""WITH {EVENT_TRAFFIC} SELECT pickup_zone AS zone, window_start, window_end, request_count, total_passengers,
    CAST(total_revenue AS DOUBLE) AS total_revenue FROM traffic""",
)
def _(spark, d):
    return i.sunk_traffic(spark, d).withColumn("total_revenue", F.col("total_revenue").cast("double"))


REASON_SQL = """'Surge detected in ' || pickup_zone || ': ' || request_count || ' ride requests vs expected '
    || expected_requests || coalesce(' (' || round(CAST(request_count AS DOUBLE) / nullif(CAST(expected_requests AS DOUBLE), 0), 1)
    || 'x baseline)', '')"""


@query(
    "s6_anomaly_sink",
    f"""WITH {EVENT_SURGES} SELECT pickup_zone, window_time, request_count, expected_requests,
    {REASON_SQL} AS anomaly_reason, CAST(NULL AS VARCHAR) AS top_chunk_1, CAST(NULL AS VARCHAR) AS top_chunk_2,
    CAST(NULL AS VARCHAR) AS top_chunk_3 FROM surges""",
)
def _(spark, d):
    return rows.anomaly_sink(i.surges(spark, d))


@query(
    "s7_publish_documents",
    f"""WITH {CALENDAR_SQL} SELECT 'id-' || doc_id AS key,
    '{{"event_name":"' || event_name || '","event_type":"' || event_type || '","venue":"' || venue || '","zone":"' || zone
    || '","event_time_start":"' || strftime(event_time_start, '%Y-%m-%dT%H:%M:%S.%f+00:00')
    || '","event_time_end":"' || strftime(event_time_end, '%Y-%m-%dT%H:%M:%S.%f+00:00')
    || '","expected_attendance":' || expected_attendance || ',"description":' || to_json(description) || ',"impact_level":"' || impact_level
    || '","created_at":"2024-01-01T00:00:00.000000+00:00","updated_at":"2024-01-02T00:00:00.000000+00:00"}}' AS value FROM calendar""",
)
def _(spark, d):
    number = F.substring_index("event_name", " ", -1)
    dated = t.calendar(spark, d).withColumns(
        {"document_id": F.concat(F.lit("id-"), number), "created_at": F.lit("2024-01-01").cast("timestamp"), "updated_at": F.lit("2024-01-02").cast("timestamp")}
    )
    return sinks.publish_documents(dated, "document_id")


@query(
    "s11_retained_size",
    """WITH parts AS (SELECT user_id AS topic, event_type AS partition, min(event_id) AS earliest,
      CASE WHEN count(*) > 3 THEN max(event_id) END AS latest FROM events GROUP BY ALL)
    SELECT topic, CASE WHEN count(latest) = count(*) THEN CAST(sum(greatest(latest - earliest, 0)) AS BIGINT) END AS retained
    FROM parts GROUP BY topic""",
)
def _(spark, d):
    offsets = (
        t.table(spark, d, "events")
        .groupBy(F.col("user_id").alias("topic"), F.col("event_type").alias("partition"))
        .agg(F.min("event_id").alias("earliest"), F.when(F.count(F.lit(1)) > 3, F.max("event_id")).alias("latest"))
    )
    return sinks.retained_size(offsets)


@query("f1_surges_only", f"WITH {EVENT_SURGES} SELECT pickup_zone, window_time, request_count, expected_requests FROM surges")
def _(spark, d):
    return rows.surges(i.surges(spark, d)).select("pickup_zone", "window_time", "request_count", "expected_requests")


@query(
    "f2_zone_filter",
    f"WITH {EVENT_TRAFFIC} SELECT pickup_zone, window_start, request_count FROM traffic WHERE pickup_zone IN ('click', 'view')",
)
def _(spark, d):
    return rows.in_zones(i.traffic(spark, d), ["click", "view"], "pickup_zone").select(
        "pickup_zone", "window_start", "request_count"
    )


@query(
    "f2_zone_semi_join",
    f"""WITH {RIDES} SELECT request_id, pickup_zone FROM rides
    WHERE pickup_zone IN (SELECT event_type FROM events WHERE value > 355)""",
)
def _(spark, d):
    wanted = t.table(spark, d, "events").where(F.col("value") > 355).select(F.col("event_type").alias("zone"))
    return rows.in_zones(t.rides_from_events(spark, d), wanted, "pickup_zone").select("request_id", "pickup_zone")


@query("f3_time_filter", f"WITH {RIDES} SELECT request_id, request_ts FROM rides WHERE request_ts >= TIMESTAMP '2024-01-20 06:00:00'")
def _(spark, d):
    return rows.since(t.rides_from_events(spark, d), "2024-01-20 06:00:00", "request_ts").select("request_id", "request_ts")


REASONS_SQL = """concat_ws(',',
      CASE WHEN zone IS NULL THEN 'missing:zone' END, CASE WHEN window_start IS NULL THEN 'missing:window_start' END,
      CASE WHEN window_start IS NOT NULL AND try_cast(window_start AS DOUBLE) IS NULL
        AND try_cast(window_start AS TIMESTAMP) IS NULL THEN 'type:window_start' END)"""


def _raw_rules():
    return [
        validate.required("zone"),
        validate.required("window_start"),
        validate.typed("window_start", *validate.TIME_TYPES),
    ]


@query(
    "f4_validate",
    f"WITH {RAW_SQL}, c AS (SELECT *, {REASONS_SQL} AS reason FROM raw) SELECT event_id, zone, window_start, value FROM c WHERE reason = ''",
)
def _(spark, d):
    return validate.split(i.raw_messages(spark, d), _raw_rules())[0]


@query(
    "f4_dead_letters",
    f"""WITH {RAW_SQL}, c AS (SELECT *, {REASONS_SQL} AS reason FROM raw)
    SELECT event_id, reason FROM c WHERE reason <> ''""",
)
def _(spark, d):
    dead = validate.split(i.raw_messages(spark, d), _raw_rules())[1]
    return dead.select(F.get_json_object("document", "$.event_id").cast("long").alias("event_id"), "reason")


@query(
    "f5_type_guard",
    f"""WITH {RAW_SQL} SELECT event_id, zone, window_start FROM raw WHERE zone IS NOT NULL AND window_start IS NOT NULL
    AND (try_cast(window_start AS DOUBLE) IS NOT NULL OR try_cast(window_start AS TIMESTAMP) IS NOT NULL)""",
)
def _(spark, d):
    guarded = validate.type_guard(i.raw_messages(spark, d), zone=["string"], window_start=validate.TIME_TYPES)
    return guarded.select("event_id", "zone", "window_start")


@query(
    "f6_breach_counts",
    f"""WITH {RAW_SQL} SELECT 'zone_traffic' AS table_name, 'missing:zone' AS rule, count(*) FILTER (zone IS NULL) AS breaches FROM raw
    UNION ALL SELECT 'zone_traffic', 'missing:window_start', count(*) FILTER (window_start IS NULL) FROM raw
    UNION ALL SELECT 'zone_traffic', 'type:window_start', count(*) FILTER (window_start IS NOT NULL AND
      try_cast(window_start AS DOUBLE) IS NULL AND try_cast(window_start AS TIMESTAMP) IS NULL) FROM raw""",
)
def _(spark, d):
    return validate.breach_counts(i.raw_messages(spark, d), _raw_rules(), "zone_traffic")


@query(
    "f7_embedding_shape",
    """SELECT vec_id, CASE WHEN vec_id % 19 = 0 THEN 'items:embedding' WHEN vec_id % 17 = 0 THEN 'dim:embedding' ELSE 'missing:embedding' END
    AS reason FROM embeddings WHERE vec_id % 19 = 0 OR vec_id % 17 = 0 OR vec_id % 13 = 0""",
)
def _(spark, d):
    v = F.col("vec_id")
    vec = (
        F.when(v % 19 == 0, F.slice("embedding", 1, 0))
        .when(v % 17 == 0, F.slice("embedding", 1, 32))
        .when(v % 13 != 0, F.col("embedding"))
    )
    given = t.table(spark, d, "embeddings").select("vec_id", vec.alias("embedding"))
    dead = validate.split(given, validate.embedding_rules(dim=64))[1]
    return dead.select(F.get_json_object("document", "$.vec_id").cast("long").alias("vec_id"), "reason")


@query("p1_allow_list", f"WITH {KB_SQL} SELECT document_id, zone, impact_level FROM kb")
def _(spark, d):
    return rows.project(t.knowledge_base(spark, d), ["document_id", "zone", "impact_level", "venue"], drop=["venue"])


@query("p2_promote", "SELECT doc_id, text AS description, text AS chunk FROM documents")
def _(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", F.col("text").alias("description"))
    return rows.promote(docs, chunk="description")


@query(
    "p3_provenance",
    """SELECT vec_id, TIMESTAMP '2024-02-01' AS embedded_at, 'm-2' AS embedding_model, 64 AS embedding_dim, 1 AS schema_version
    FROM embeddings""",
)
def _(spark, d):
    kb = t.table(spark, d, "embeddings").select("vec_id", F.lit("2024-02-01").cast("timestamp").alias("at"))
    return rows.with_provenance(kb, "m-2", 64, "at").drop("at")


@query("p3_stale_embeddings", f"WITH {KB_SQL} SELECT document_id, embedding_model FROM kb WHERE embedding_model IS DISTINCT FROM 'm-2'")
def _(spark, d):
    return rows.stale_embeddings(t.knowledge_base(spark, d), "m-2").select("document_id", "embedding_model")


@query(
    "p5_epoch_ms",
    f"""WITH {RAW_SQL} SELECT event_id, make_timestamp(CAST(try_cast(window_start AS DOUBLE) AS BIGINT) * 1000) AS window_start
    FROM raw""",
)
def _(spark, d):
    raw = i.raw_messages(spark, d)
    return raw.select("event_id", as_timestamp("window_start", "string").alias("window_start"))


@query(
    "p6_zone_alias",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN 'Central Business District (CBD)' ELSE o_orderpriority END AS zone
    FROM orders""",
)
def _(spark, d):
    short = F.when(F.col("o_orderpriority") == "2-HIGH", "CBD").otherwise(F.col("o_orderpriority"))
    return rows.normalise_zone(t.table(spark, d, "orders").select("o_orderkey", short.alias("zone")))


@query(
    "p7_safe_numbers",
    f"WITH {RAW_SQL} SELECT event_id, coalesce(try_cast(window_start AS DOUBLE), 0) AS number, try_cast(zone AS DOUBLE) AS nothing FROM raw",
)
def _(spark, d):
    return i.raw_messages(spark, d).select(
        "event_id", to_number("window_start").alias("number"), to_number("zone", None).alias("nothing")
    )


@query(
    "p8_json_documents",
    f"""WITH {RIDES}, {traffic_sql(MINUTE_US)} SELECT '{{"pickup_zone":"' || pickup_zone || '","window_start":"'
    || strftime(window_start, '%Y-%m-%dT%H:%M:%S.%f+00:00') || '","request_count":' || request_count || '}}' AS doc FROM traffic""",
)
def _(spark, d):
    traffic = zone_traffic(t.rides_from_events(spark, d))
    return rows.json_documents(traffic.select("pickup_zone", "window_start", "request_count"))


@query(
    "p9_anomaly_cards",
    f"""WITH {EVENT_SURGES} SELECT pickup_zone AS zone, window_time, CAST(request_count AS DOUBLE) AS actual_count,
    CAST(expected_requests AS DOUBLE) AS expected_count, CAST(request_count - expected_requests AS DOUBLE) AS surplus,
    round(CASE WHEN expected_requests > 0 THEN request_count / CAST(expected_requests AS DOUBLE) END, 6) AS multiple,
    {REASON_SQL} AS anomaly_reason, CAST(0 AS INTEGER) AS chunks FROM surges""",
)
def _(spark, d):
    cards = rows.anomaly_cards(rows.anomaly_sink(i.surges(spark, d)))
    return cards.withColumn("multiple", F.round("multiple", 6)).withColumn("chunks", F.size("rag_chunks")).drop("rag_chunks")


@query(
    "p10_dispatch_entries",
    f"""WITH {EVENT_TRAFFIC}, {i.RAW_LOG_SQL} SELECT pickup_zone AS zone, coalesce(dispatched_at, window_time) AS dispatched_at,
    regexp_extract(dispatch_summary, '(Sent \\d+ boats\\.)', 1) AS summary,
    CASE request_count % 3 WHEN 0 THEN dispatch_json WHEN 1 THEN 'boats: ' || request_count ELSE '' END AS dispatch_json,
    request_count % 3 = 0 AS parsed FROM log JOIN (SELECT pickup_zone, window_time, request_count FROM traffic) USING (pickup_zone, window_time)""",
)
def _(spark, d):
    n = F.regexp_extract("dispatch_json", r"(\d+)", 1).cast("long")
    mixed = F.when(n % 3 == 0, F.col("dispatch_json")).when(n % 3 == 1, F.concat(F.lit("boats: "), n.cast("string")))
    return rows.dispatch_entries(i.dispatch_log(spark, d).withColumn("dispatch_json", mixed))


@query(
    "p11_knowledge_cards",
    f"""WITH {CALENDAR_SQL} SELECT event_name, zone, venue, expected_attendance, lower(impact_level) AS impact_level,
    event_type, substring(description, 1, 180) AS description FROM calendar""",
)
def _(spark, d):
    return rows.knowledge_cards(t.calendar(spark, d))
