"""Streaming jobs run to the end of the given table; their output is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.keyed import KeyedTable, upsert_replace
from tidewatch.plans import inputs as i
from tidewatch.plans import surge
from tidewatch.plans.queries_tables import SCORED_OUT, TRAFFIC_OUT, _scored, as_double, at
from tidewatch.plans.registry import EVENT_SURGES, EVENT_TRAFFIC, RAW_SQL, query, scored_sql
from tidewatch.session import materialize, new_path
from tidewatch.sources import tables as t
from tidewatch.sources.rides import with_event_time
from tidewatch.sources.schemas import TRAFFIC
from tidewatch.streaming import jobs, stateful


def _streamed(spark, d, name: str) -> DataFrame:
    """A test table as a stream."""
    path = f"{d}/{name}.parquet"
    # as a pattern the path may be one file or a folder of files
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def _finish(q) -> None:
    q.awaitTermination()


def _traffic_table(spark, d) -> str:
    """Closed windows of the ride stream, written by the traffic job."""
    out, mark = new_path(spark, "stream-traffic"), new_path(spark, "mark")
    rides = with_event_time(t.as_rides(_streamed(spark, d, "events")))
    _finish(jobs.append(jobs.traffic(rides, i.EVENT_WINDOW), out, mark))
    return out


CLOSED = "window_end <= (SELECT max(ts) FROM events) - INTERVAL 5 SECOND"


@query("st2_stream_traffic", f"WITH {EVENT_TRAFFIC} {TRAFFIC_OUT} WHERE {CLOSED}")
def _(spark, d):
    return as_double(spark.read.schema(TRAFFIC).parquet(_traffic_table(spark, d)), "total_revenue")


@query(
    "st8_flush_open_windows",
    f"WITH {EVENT_TRAFFIC} {TRAFFIC_OUT} WHERE window_end <= TIMESTAMP '2024-01-28 12:00:00'",
)
def _(spark, d):
    rides = t.rides_from_events(spark, d)
    return as_double(jobs.flush_until(rides, at("2024-01-28 12:00:00"), i.EVENT_WINDOW), "total_revenue")


@query(
    "w5_stream_detect",
    f"WITH {EVENT_TRAFFIC}, closed AS (SELECT * FROM traffic WHERE {CLOSED}), {scored_sql(source='closed')} {SCORED_OUT}",
)
def _(spark, d):
    out, mark = new_path(spark, "stream-scored"), new_path(spark, "mark")
    windows = jobs.table_stream(spark, _traffic_table(spark, d), TRAFFIC)
    _finish(jobs.append(stateful.detect_stream(windows, confidence=i.CONFIDENCE), out, mark))
    return _scored(spark.read.parquet(out))


@query(
    "st6_keyed_sink",
    f"""WITH {RAW_SQL}, ok AS (SELECT zone, try_cast(window_start AS TIMESTAMP) AS window_start, event_id FROM raw
      WHERE zone IS NOT NULL AND try_cast(window_start AS TIMESTAMP) IS NOT NULL)
    SELECT zone, window_start, max(event_id) AS event_id FROM ok GROUP BY ALL""",
)
def _(spark, d):
    """The same history is sent twice; the table is that of one run."""
    table = KeyedTable(new_path(spark, "keyed"), ["zone", "window_start"], "day", F.to_date("window_start"))
    for _ in range(2):
        raw = i.as_raw(_streamed(spark, d, "events")).select("zone", F.col("window_start").try_cast("timestamp").alias("window_start"), "event_id")
        _finish(jobs.keyed_sink(raw, table, new_path(spark, "mark"), merge=upsert_replace, order="event_id"))
    return table.read(spark).select("zone", "window_start", "event_id")


@query(
    "st7_overdue",
    f"""WITH {EVENT_TRAFFIC}, a AS (SELECT pickup_zone, window_time, request_count FROM traffic WHERE request_count >= 3),
    e AS (SELECT *, window_time + to_seconds(request_count * 17 % 80) AS told FROM a WHERE request_count % 4 <> 0),
    seen AS (SELECT least((SELECT max(window_time) FROM a), (SELECT max(told) FROM e)) - INTERVAL 5 SECOND AS till)
    SELECT a.pickup_zone, a.window_time, a.request_count FROM a LEFT JOIN e USING (pickup_zone, window_time), seen
    WHERE a.window_time + INTERVAL 40 SECOND <= till AND (e.told IS NULL OR e.told > a.window_time + INTERVAL 40 SECOND)""",
)
def _(spark, d):
    """Anomalies and evidence as two event streams; a timer for every anomaly."""
    rows = i.traffic(spark, d).where(F.col("request_count") >= 3).select("pickup_zone", "window_time", "request_count", F.col("window_time").alias("ingested_at"))
    rows = materialize(rows, "anomalies")
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("request_count") * 17 % 80)
    told = rows.where(F.col("request_count") % 4 != 0).withColumns({"enriched_at": F.col("window_time") + delay, "top_chunk_1": F.lit("a document")})
    told = materialize(told.select("pickup_zone", "window_time", "enriched_at", "top_chunk_1"), "evidence")
    streams = [spark.readStream.schema(x.schema).parquet(str(x.inputFiles()[0]).rsplit("/", 1)[0]) for x in (rows, told)]
    out, mark = new_path(spark, "overdue"), new_path(spark, "mark")
    _finish(jobs.append(stateful.overdue(*streams), out, mark))
    return spark.read.schema(rows.schema).parquet(out).select("pickup_zone", "window_time", "request_count")


@query(
    "st7_backfill_keys",
    f"""WITH {EVENT_SURGES} SELECT pickup_zone, window_time, 'backfill' AS enriched_by FROM surges WHERE request_count % 2 = 0""",
)
def _(spark, d):
    """Half of the anomalies were enriched in time; the others are filled in."""
    return _backfilled(spark, d).select("pickup_zone", "window_time", "enriched_by")


@query("st7_backfill_evidence")
def _(spark, d):
    return _backfilled(spark, d)


def _backfilled(spark, d):
    anomalies = materialize(surge.announced(i.surges(spark, d)).withColumn("ingested_at", F.col("window_time")), "anomalies")
    done = anomalies.where(F.col("request_count") % 2 == 1)
    enriched = done.select("pickup_zone", "window_time", F.lit("a document").alias("top_chunk_1"))
    kb = surge.knowledge_rows(t.calendar(spark, d), at("2024-02-01"))[0]
    return jobs.backfill_evidence(anomalies, enriched, materialize(kb, "knowledge"), at("2024-02-01"))
