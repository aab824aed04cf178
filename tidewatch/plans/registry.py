"""Named queries over the test tables, each beside the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where SQL cannot say it or is too slow."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


# -- SQL shared by the oracles ---------------------------------------------------

HOUR_US, MINUTE_US, WEEK_US = 3_600_000_000, 60_000_000, 604_800_000_000

RIDES = r"""rides AS (
  SELECT CAST(event_id AS VARCHAR) AS request_id, 'user' || user_id || '@example.com' AS customer_email,
         event_type AS pickup_zone, 'stop-' || (user_id % 7) AS drop_off_zone, value AS price,
         CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) % 6 + 1 AS number_of_passengers, ts AS request_ts
  FROM events)"""

LINES = """rides AS (
  SELECT l_orderkey || '-' || l_linenumber AS request_id, n_name AS pickup_zone, l_extendedprice AS price,
         CAST(l_quantity AS INTEGER) AS number_of_passengers, l_shipdate AS request_ts
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def traffic_sql(us: int) -> str:
    start = f"make_timestamp((epoch_us(request_ts) // {us}) * {us})"
    end = f"make_timestamp((epoch_us(request_ts) // {us}) * {us} + {us})"
    return f"""traffic AS (
  SELECT {start} AS window_start, {end} AS window_end, {end} - INTERVAL 1 MILLISECOND AS window_time, pickup_zone,
         count(*) AS request_count, CAST(sum(number_of_passengers) AS BIGINT) AS total_passengers,
         sum(CAST(price AS DECIMAL(10,2))) AS total_revenue
  FROM rides GROUP BY ALL)"""


Z99 = 2.5758293035489004


def scored_sql(max_train: int = 7000, part: str = "pickup_zone", source: str = "traffic") -> str:
    return f"""framed AS (
  SELECT *, count(*) OVER w AS n, avg(request_count) OVER w AS m, stddev_samp(request_count) OVER w AS s
  FROM {source}
  WINDOW w AS (PARTITION BY {part} ORDER BY window_time ROWS BETWEEN {max_train} PRECEDING AND 1 PRECEDING)),
bounded AS (
  SELECT *, CASE WHEN n >= 15 THEN m END AS forecast,
         CASE WHEN n >= 15 THEN m - {Z99} * s * sqrt(1 + 1.0 / n) END AS lower_bound,
         CASE WHEN n >= 15 THEN m + {Z99} * s * sqrt(1 + 1.0 / n) END AS upper_bound
  FROM framed),
scored AS (
  SELECT *, coalesce(request_count < lower_bound OR request_count > upper_bound, false) AS is_anomaly FROM bounded)"""


SURGES_SQL = """surges AS (
  SELECT pickup_zone, window_time, request_count, total_passengers, total_revenue,
         CAST(round(forecast) AS BIGINT) AS expected_requests, upper_bound, lower_bound
  FROM scored WHERE is_anomaly AND request_count > upper_bound)"""

EVENT_TRAFFIC = f"{RIDES}, {traffic_sql(HOUR_US)}"
EVENT_SURGES = f"{EVENT_TRAFFIC}, {scored_sql()}, {SURGES_SQL}"
LINE_TRAFFIC = f"{LINES}, {traffic_sql(WEEK_US)}"
LINE_SURGES = f"{LINE_TRAFFIC}, {scored_sql()}, {SURGES_SQL}"

CALENDAR_SQL = """calendar AS (
  SELECT doc_id, 'Event ' || doc_id AS event_name,
         ['click','error','purchase','signup','view'][doc_id % 5 + 1] AS zone, text AS description,
         'Hall ' || lang AS venue, CAST(n_chars AS INTEGER) AS expected_attendance, source AS event_type,
         ['high','medium','low'][doc_id % 3 + 1] AS impact_level,
         TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INTEGER)) + to_hours(CAST(doc_id * 7 % 24 AS INTEGER)) AS event_time_start,
         TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INTEGER))
           + to_hours(CAST((doc_id * 7 + 1 + doc_id % 5) % 24 AS INTEGER)) AS event_time_end
  FROM documents)"""

KB_SQL = """kb AS (
  SELECT CAST(vec_id AS VARCHAR) AS document_id, d.text AS chunk, CAST(embedding AS DOUBLE[]) AS embedding,
         ['click','error','purchase','signup','view'][label % 5 + 1] AS zone,
         ['high','medium','low'][vec_id % 3 + 1] AS impact_level,
         CASE WHEN label < 7 THEN 'm-2' ELSE 'm-1' END AS embedding_model
  FROM embeddings LEFT JOIN documents d ON vec_id = doc_id)"""

# Messages of an older producer: missing zones, times as numbers, text or nothing.
RAW_SQL = """raw AS (
  SELECT event_id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE event_type END AS zone,
         CASE CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) % 5
           WHEN 0 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) WHEN 1 THEN NULL WHEN 2 THEN 'soon'
           ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS window_start, value
  FROM events)"""
