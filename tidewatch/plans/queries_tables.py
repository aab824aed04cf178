"""Aggregates, detection, reports, keyed tables, joins and the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import aggregates as agg
from tidewatch.operators import anomaly, feed, joins, keyed, seasonal, topk
from tidewatch.plans import inputs as i
from tidewatch.plans.inputs import RAW_LOG_SQL
from tidewatch.plans.registry import (
    CALENDAR_SQL,
    EVENT_SURGES,
    EVENT_TRAFFIC,
    LINE_SURGES,
    LINE_TRAFFIC,
    MINUTE_US,
    RAW_SQL,
    RIDES,
    WEEK_US,
    query,
    scored_sql,
    traffic_sql,
)
from tidewatch.sources import tables as t


def at(text: str):
    return F.lit(text).cast("timestamp")


def as_double(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# -- aggregates ---------------------------------------------------------------------

TRAFFIC_OUT = """SELECT window_start, window_end, window_time, pickup_zone, request_count, total_passengers,
    CAST(total_revenue AS DOUBLE) AS total_revenue FROM traffic"""


@query("a1_zone_traffic", f"WITH {RIDES}, {traffic_sql(MINUTE_US)} {TRAFFIC_OUT}")
def _(spark, d):
    return as_double(agg.zone_traffic(t.rides_from_events(spark, d)), "total_revenue")


@query("a1_zone_traffic_lineitem", f"WITH {LINE_TRAFFIC} {TRAFFIC_OUT}")
def _(spark, d):
    return as_double(i.line_traffic(spark, d), "total_revenue")


@query(
    "a2_heat_map",
    f"""WITH {EVENT_TRAFFIC} SELECT pickup_zone AS zone, CAST(sum(request_count) AS BIGINT) AS request_count,
    CAST(sum(total_passengers) AS BIGINT) AS total_passengers, CAST(sum(total_revenue) AS DOUBLE) AS total_revenue
    FROM traffic GROUP BY 1""",
)
def _(spark, d):
    return as_double(agg.heat_map(i.sunk_traffic(spark, d)), "total_revenue")


@query("a3_zones", "SELECT DISTINCT event_type AS zone FROM events")
def _(spark, d):
    return agg.zones(t.rides_from_events(spark, d).select(F.col("pickup_zone").alias("zone")))


@query(
    "a4_table_counts",
    f"""WITH {EVENT_TRAFFIC} SELECT 'Ride Requests' AS label, (SELECT count(*) FROM rides WHERE request_ts >= TIMESTAMP '2024-01-15') AS value
    UNION ALL SELECT 'Traffic Windows', (SELECT count(*) FROM traffic WHERE window_start >= TIMESTAMP '2024-01-15')
    UNION ALL SELECT 'KB Events', (SELECT count(*) FROM documents) UNION ALL SELECT 'Dispatches Logged', NULL""",
)
def _(spark, d):
    tables = {
        "ride_requests": (t.rides_from_events(spark, d), "request_ts"),
        "zone_traffic": (i.traffic(spark, d), "window_start"),
        "knowledge_base": (t.table(spark, d, "documents"), None),
        "dispatches": (None, "dispatched_at"),
    }
    return agg.kpi_rows(agg.table_counts(tables, at("2024-01-15")))


@query("a5_duplicate_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return agg.duplicate_keys(t.table(spark, d, "events"), ["user_id", "event_type"])


@query(
    "a6_status_rollup",
    """WITH c AS (SELECT o_custkey AS component_group, CASE o_orderstatus WHEN 'F' THEN 'warn' WHEN 'O' THEN 'ok' ELSE 'fail' END AS status
      FROM orders)
    SELECT component_group, CASE WHEN bool_or(status = 'fail') THEN 'unhealthy' WHEN bool_or(status = 'ok') THEN 'healthy'
      ELSE 'unknown' END AS overall, count(*) FILTER (status = 'warn') AS warnings FROM c GROUP BY 1""",
)
def _(spark, d):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "warn").when(s == "O", "ok").otherwise("fail")
    checks = t.table(spark, d, "orders").select(F.col("o_custkey").alias("component_group"), status.alias("status"))
    return agg.status_rollup(checks)


@query(
    "a7_stage_counters",
    f"""WITH {EVENT_SURGES} SELECT 'requests' AS stage, (SELECT CAST(sum(request_count) AS BIGINT) FROM traffic) AS value
    UNION ALL SELECT 'window', (SELECT count(*) FROM traffic) UNION ALL SELECT 'detect', (SELECT count(*) FROM surges)
    UNION ALL SELECT 'context', 0 UNION ALL SELECT 'agent', (SELECT count(*) FROM traffic WHERE request_count > 5)
    UNION ALL SELECT 'dispatch', (SELECT count(*) FROM traffic WHERE request_count > 5)""",
)
def _(spark, d):
    traffic = i.traffic(spark, d)

    def part(df, name):
        return df.select(F.lit(name).alias("collection"), "request_count", F.lit(False).alias("has_evidence"))

    changes = (
        part(traffic, "zone_traffic")
        .unionByName(part(i.surges(spark, d), "zone_anomalies"))
        .unionByName(part(traffic.where(F.col("request_count") > 5), "dispatch_log"))
    )
    return agg.stage_counters(changes)


@query(
    "a8_latest_per_zone",
    f"""WITH {EVENT_TRAFFIC} SELECT pickup_zone AS zone, max(window_start) AS window_start,
    arg_max(request_count, window_start) AS request_count FROM traffic GROUP BY 1""",
)
def _(spark, d):
    return agg.latest_per_zone(i.sunk_traffic(spark, d))


@query(
    "a9_chart_domain",
    f"""WITH {EVENT_TRAFFIC} SELECT min(window_start) AS t0, greatest(max(window_start), min(window_start) + INTERVAL 60 SECOND) AS t1,
    greatest(max(request_count), 1) AS n_max FROM traffic""",
)
def _(spark, d):
    return agg.chart_domain(i.sunk_traffic(spark, d))


# -- detection -------------------------------------------------------------------------

SCORED_OUT = """SELECT pickup_zone, window_time, request_count, round(forecast, 6) AS forecast,
    round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound, is_anomaly FROM scored"""
SCORED = ["pickup_zone", "window_time", "request_count", "forecast", "lower_bound", "upper_bound", "is_anomaly"]


def _scored(df):
    return rounded(df.select(*SCORED), "forecast", "lower_bound", "upper_bound")


@query("w1_detect", f"WITH {EVENT_TRAFFIC}, {scored_sql()} {SCORED_OUT}")
def _(spark, d):
    return _scored(anomaly.detect(i.traffic(spark, d), confidence=99.0))


@query("w1_detect_short_memory", f"WITH {EVENT_TRAFFIC}, {scored_sql(100)} {SCORED_OUT}")
def _(spark, d):
    return _scored(anomaly.detect(i.traffic(spark, d), confidence=99.0, max_train=100))


@query("w1_detect_lineitem", f"WITH {LINE_TRAFFIC}, {scored_sql(52)} {SCORED_OUT}")
def _(spark, d):
    return _scored(anomaly.detect(i.line_traffic(spark, d), confidence=99.0, max_train=52, chunk_seconds=365 * 86_400))


@query(
    "w1_detect_double",
    f"""WITH {LINE_TRAFFIC}, prices AS (SELECT pickup_zone, window_time,
      10000000.0::DOUBLE + CAST(total_revenue AS DOUBLE) / request_count * 0.731::DOUBLE AS request_count FROM traffic),
    {scored_sql(52, source='prices')} SELECT pickup_zone, window_time, round(request_count, 2) AS price, round(forecast, 2) AS forecast,
    round(upper_bound - lower_bound, 2) AS width, is_anomaly FROM scored""",
)
def _(spark, d):
    """Mean prices far from zero, where sums of squares would lose the differences."""
    price = F.lit(1e7) + F.col("total_revenue").cast("double") / F.col("request_count") * 0.731
    prices = i.line_traffic(spark, d).select("pickup_zone", "window_time", price.alias("price"))
    scored = anomaly.detect(prices, "price", confidence=99.0, max_train=52, chunk_seconds=365 * 86_400)
    return scored.select(
        "pickup_zone", "window_time", F.round("price", 2).alias("price"), F.round("forecast", 2).alias("forecast"),
        F.round(F.col("upper_bound") - F.col("lower_bound"), 2).alias("width"), "is_anomaly",
    )


SURGES_OUT = """SELECT pickup_zone, window_time, request_count, total_passengers, CAST(total_revenue AS DOUBLE) AS total_revenue,
    expected_requests, round(upper_bound, 6) AS upper_bound, round(lower_bound, 6) AS lower_bound, true AS is_surge FROM surges"""


@query("w2_surge_anomalies", f"WITH {EVENT_SURGES} {SURGES_OUT}")
def _(spark, d):
    return rounded(as_double(i.surges(spark, d), "total_revenue"), "upper_bound", "lower_bound")


@query("w2_surge_anomalies_lineitem", f"WITH {LINE_SURGES} {SURGES_OUT}")
def _(spark, d):
    return rounded(as_double(i.line_surges(spark, d), "total_revenue"), "upper_bound", "lower_bound")


Z99 = 2.5758293035489004
#: Keeps rounded values off the ties, where the last bit of a sum decides.
NUDGE = 1e-7


@query(
    "w3_detect_trend_order1",
    f"""WITH {EVENT_TRAFFIC}, lagged AS (SELECT *, lag(request_count) OVER z AS x, row_number() OVER z - 1 AS i FROM traffic
      WINDOW z AS (PARTITION BY pickup_zone ORDER BY window_time)),
    fits AS (SELECT *, CASE WHEN regr_sxx(request_count, x) OVER w > 0 THEN regr_slope(request_count, x) OVER w ELSE 0 END AS b,
      CASE WHEN regr_sxx(request_count, x) OVER w > 0 THEN regr_intercept(request_count, x) OVER w
        ELSE avg(request_count) FILTER (x IS NOT NULL) OVER w END AS a, CAST(regr_count(request_count, x) OVER w AS BIGINT) AS n,
      regr_syy(request_count, x) OVER w AS syy, regr_sxy(request_count, x) OVER w AS sxy FROM lagged
      WINDOW w AS (PARTITION BY pickup_zone ORDER BY window_time ROWS BETWEEN 336 PRECEDING AND 1 PRECEDING)),
    ready AS (SELECT *, i >= 15 AS ok, {Z99} * sqrt(greatest(syy - b * sxy, 0) / nullif(n - 2, 0)) * sqrt(1 + 1.0 / nullif(n, 0)) AS half FROM fits)
    SELECT pickup_zone, window_time, CASE WHEN ok THEN round(a + b * x + {NUDGE}, 3) END AS forecast, CASE WHEN ok THEN round(2 * half + {NUDGE}, 3) END AS width,
    coalesce(ok AND (request_count < a + b * x - half OR request_count > a + b * x + half), false) AS is_anomaly FROM ready""",
)
def _(spark, d):
    scored = anomaly.detect_trend(i.traffic(spark, d), confidence=99.0, max_train=336, order=1)
    return scored.select(
        "pickup_zone", "window_time", F.round(F.col("forecast") + NUDGE, 3).alias("forecast"),
        F.round(F.col("upper_bound") - F.col("lower_bound") + NUDGE, 3).alias("width"), "is_anomaly",
    )


@query(
    "w4_decompose",
    f"WITH {EVENT_TRAFFIC} SELECT pickup_zone, window_time, CAST(request_count AS DOUBLE) AS parts, true AS small FROM traffic",
)
def _(spark, d):
    """Trend, day and remainder add up to the value, and the trend stays within the values."""
    traffic = i.traffic(spark, d).select("pickup_zone", "window_time", "request_count")
    parts = seasonal.decompose(traffic, 3600, 24)
    most = traffic.agg(F.max("request_count")).scalar()
    small = (F.abs("trend") <= 2 * most) & (F.abs("seasonal") <= 2 * most)
    return parts.select("pickup_zone", "window_time", F.round(F.col("trend") + F.col("seasonal") + F.col("remainder"), 6).alias("parts"), small.alias("small"))


@query("w3_detect_trend")
def _(spark, d):
    return _scored(anomaly.detect_trend(i.traffic(spark, d), confidence=99.0, max_train=336))


@query(
    "w4_detect_seasonal",
    f"WITH {EVENT_TRAFFIC}, seasons AS (SELECT *, hour(window_time) AS season FROM traffic), "
    f"{scored_sql(part='pickup_zone, season', source='seasons')} {SCORED_OUT}",
)
def _(spark, d):
    return _scored(anomaly.detect_seasonal(i.traffic(spark, d), confidence=99.0, chunk_seconds=10 * 86_400))


@query(
    "w6_last_windows",
    f"""WITH {EVENT_TRAFFIC} SELECT pickup_zone AS zone, window_start, request_count,
    CAST(row_number() OVER (PARTITION BY pickup_zone ORDER BY window_start DESC) AS INTEGER) AS rn FROM traffic QUALIFY rn <= 60""",
)
def _(spark, d):
    return anomaly.last_windows(i.sunk_traffic(spark, d).select("zone", "window_start", "request_count"))


# -- reports ------------------------------------------------------------------------------

ROW = "window_start, pickup_zone AS zone, request_count"


def _short(df):
    return df.select("window_start", "zone", "request_count")


@query(
    "t1_traffic_series",
    f"""WITH {EVENT_TRAFFIC} SELECT {ROW} FROM traffic WHERE pickup_zone IN ('click', 'error') AND window_start >= TIMESTAMP '2024-01-05'
    ORDER BY window_start, zone LIMIT 500""",
)
def _(spark, d):
    return _short(topk.traffic_series(i.sunk_traffic(spark, d), ["click", "error"], "2024-01-05"))


@query(
    "t2_latest_anomalies",
    f"""WITH {EVENT_SURGES} SELECT pickup_zone, window_time, request_count FROM surges
    ORDER BY window_time DESC, pickup_zone LIMIT 50""",
)
def _(spark, d):
    return topk.latest_anomalies(i.surges(spark, d)).select("pickup_zone", "window_time", "request_count")


LOG = "pickup_zone, window_time, dispatched_at"


@query(
    "t3_recent_dispatches",
    f"""WITH {EVENT_TRAFFIC}, {RAW_LOG_SQL}, top AS (SELECT {LOG} FROM log WHERE dispatched_at >= TIMESTAMP '2024-01-20' - INTERVAL 15 MINUTE
      ORDER BY dispatched_at DESC, pickup_zone, window_time LIMIT 50) SELECT * FROM top""",
)
def _(spark, d):
    return topk.recent_or_latest(i.dispatch_log(spark, d), at("2024-01-20")).select("pickup_zone", "window_time", "dispatched_at")


@query(
    "t3_latest_dispatches",
    f"""WITH {EVENT_TRAFFIC}, {RAW_LOG_SQL} SELECT {LOG} FROM log WHERE dispatched_at IS NOT NULL
    ORDER BY dispatched_at DESC, pickup_zone, window_time LIMIT 5""",
)
def _(spark, d):
    return topk.recent_or_latest(i.dispatch_log(spark, d), at("2025-01-01")).select("pickup_zone", "window_time", "dispatched_at")


@query(
    "t4_newest_oldest_first",
    f"WITH {EVENT_TRAFFIC} SELECT {ROW} FROM traffic ORDER BY window_start DESC, zone LIMIT 340",
)
def _(spark, d):
    return _short(topk.newest_oldest_first(i.sunk_traffic(spark, d)))


@query(
    "t5_dispatch_log",
    f"""WITH {EVENT_TRAFFIC}, {RAW_LOG_SQL} SELECT {LOG} FROM log WHERE dispatched_at >= TIMESTAMP '2024-01-10'
    ORDER BY dispatched_at DESC, pickup_zone, window_time LIMIT 50""",
)
def _(spark, d):
    return topk.dispatch_log(i.dispatch_log(spark, d), "2024-01-10").select("pickup_zone", "window_time", "dispatched_at")


@query(
    "t6_newest_unique",
    """WITH latest AS (SELECT user_id, event_type, ts, event_id FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
    SELECT * FROM latest ORDER BY ts DESC, user_id, event_type LIMIT 30""",
)
def _(spark, d):
    events = t.table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return topk.newest_unique(events, ["user_id", "event_type"], "ts", tie=["event_id"])


# -- keyed tables ----------------------------------------------------------------------------


def _halves(spark, d):
    traffic = i.traffic(spark, d).select("pickup_zone", "window_start", "request_count", "total_passengers")
    target = traffic.where(F.col("window_start") < at("2024-01-20"))
    batch = traffic.where(F.col("window_start") >= at("2024-01-10")).withColumn("request_count", F.col("request_count") * 10)
    return target, batch


HALVES = f"""{EVENT_TRAFFIC}, target AS (SELECT pickup_zone, window_start, request_count, total_passengers FROM traffic
    WHERE window_start < TIMESTAMP '2024-01-20'), batch AS (SELECT pickup_zone, window_start, request_count * 10 AS request_count,
    total_passengers FROM traffic WHERE window_start >= TIMESTAMP '2024-01-10')"""


@query(
    "k1_upsert_replace",
    f"""WITH {HALVES} SELECT pickup_zone, window_start, request_count, NULL::BIGINT AS total_passengers FROM batch
    UNION ALL SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.pickup_zone = t.pickup_zone
    AND b.window_start = t.window_start)""",
)
def _(spark, d):
    target, batch = _halves(spark, d)
    return keyed.upsert_replace(target, batch.drop("total_passengers"), ["pickup_zone", "window_start"])


@query(
    "k2_upsert_merge",
    f"""WITH {HALVES} SELECT coalesce(b.pickup_zone, t.pickup_zone) AS pickup_zone, coalesce(b.window_start, t.window_start) AS window_start,
    CASE WHEN b.pickup_zone IS NULL THEN t.request_count ELSE b.request_count END AS request_count, t.total_passengers
    FROM target t FULL JOIN batch b ON b.pickup_zone = t.pickup_zone AND b.window_start = t.window_start""",
)
def _(spark, d):
    target, batch = _halves(spark, d)
    return keyed.upsert_merge(target, batch.drop("total_passengers"), ["pickup_zone", "window_start"])


@query(
    "k3_keep_latest",
    """SELECT user_id, event_type, event_id, ts FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def _(spark, d):
    events = t.table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return keyed.keep_latest(events, ["user_id", "event_type"], "ts", ["event_id"])


@query(
    "k4_upsert_touch",
    f"""WITH {HALVES} SELECT coalesce(b.pickup_zone, t.pickup_zone) AS pickup_zone, coalesce(b.window_start, t.window_start) AS window_start,
    CASE WHEN b.pickup_zone IS NULL THEN t.request_count ELSE b.request_count END AS request_count,
    CASE WHEN b.pickup_zone IS NULL THEN t.total_passengers ELSE b.total_passengers END AS total_passengers,
    CASE WHEN t.pickup_zone IS NULL THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-02-01' END AS created_at,
    CASE WHEN b.pickup_zone IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-03-01' END AS updated_at
    FROM target t FULL JOIN batch b ON b.pickup_zone = t.pickup_zone AND b.window_start = t.window_start""",
)
def _(spark, d):
    target, batch = _halves(spark, d)
    target = target.withColumns({"created_at": at("2024-02-01"), "updated_at": at("2024-02-01")})
    return keyed.upsert_touch(target, batch, ["pickup_zone", "window_start"], at("2024-03-01"))


@query("k5_changed_rows", "SELECT doc_id FROM documents WHERE lang = 'fr' OR doc_id % 4 = 0")
def _(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "text", "lang")
    known = docs.where(F.col("doc_id") % 4 != 0)
    edited = docs.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return keyed.changed_rows(edited, known, ["doc_id"], ["text", "lang"]).select("doc_id")


@query(
    "k6_retention",
    f"""WITH {EVENT_TRAFFIC}, {RAW_LOG_SQL} SELECT pickup_zone, window_time FROM log
    WHERE dispatched_at IS NULL OR dispatched_at >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY""",
)
def _(spark, d):
    kept = keyed.retain(i.dispatch_log(spark, d), "dispatched_at", at("2024-01-25"), keyed.RETENTION_DAYS["zone_traffic"])
    return kept.select("pickup_zone", "window_time")


@query("k7_numeric_time_purge", f"WITH {RAW_SQL} SELECT event_id, window_start FROM raw WHERE try_cast(window_start AS DOUBLE) IS NULL")
def _(spark, d):
    return keyed.purge_numeric_time(i.raw_messages(spark, d), "window_start").select("event_id", "window_start")


@query("k8_missing_key_purge", f"WITH {RAW_SQL} SELECT event_id FROM raw WHERE zone IS NOT NULL AND window_start IS NOT NULL")
def _(spark, d):
    return keyed.purge_missing_keys(i.raw_messages(spark, d), ["zone", "window_start"]).select("event_id")


# -- joins ------------------------------------------------------------------------------------


@query(
    "j2_home_zone",
    """SELECT l_orderkey, l_linenumber, s_name AS vessel_id, n_name AS base_zone
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
)
def _(spark, d):
    boats = t.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("vessel_id"),
    )
    return joins.with_home_zone(boats, t.vessels(spark, d))


MATCH = f"""{EVENT_TRAFFIC}, {RAW_LOG_SQL}, a AS (SELECT pickup_zone, window_time FROM traffic WHERE request_count >= 4),
  dp AS (SELECT pickup_zone, window_time, dispatched_at FROM log WHERE dispatched_at IS NOT NULL),
  exact AS (SELECT dp.pickup_zone, dp.window_time, dp.window_time AS dispatch_window, dispatched_at, 'window' AS matched_by
    FROM dp JOIN a USING (pickup_zone, window_time)),
  steps AS (SELECT pickup_zone, window_time AS tm, window_time, 1 AS step FROM a ANTI JOIN dp USING (pickup_zone, window_time)
    UNION ALL SELECT pickup_zone, dispatched_at, window_time, -1 FROM dp ANTI JOIN a USING (pickup_zone, window_time)),
  totals AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY pickup_zone ORDER BY tm, step DESC, window_time
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps),
  heights AS (SELECT *, before - least(0, min(before) OVER (PARTITION BY pickup_zone ORDER BY tm, step DESC, window_time
    ROWS UNBOUNDED PRECEDING)) + CASE WHEN step = 1 THEN 1 ELSE 0 END AS height FROM totals),
  top AS (SELECT *, lag(window_time) OVER (PARTITION BY pickup_zone, height ORDER BY tm, step DESC, window_time) AS pushed FROM heights),
  near AS (SELECT pickup_zone, pushed AS window_time, window_time AS dispatch_window, tm AS dispatched_at, 'as_of' AS matched_by
    FROM top WHERE step = -1 AND height > 0)"""


@query("j3_match_dispatches", f"WITH {MATCH} SELECT * FROM exact UNION ALL SELECT * FROM near")
def _(spark, d):
    anomalies = i.traffic(spark, d).where(F.col("request_count") >= 4).select("pickup_zone", "window_time")
    sent = i.dispatch_log(spark, d).where(F.col("dispatched_at").isNotNull())
    return joins.match_dispatches(anomalies, sent.select("pickup_zone", "window_time", "dispatched_at"))


@query(
    "j4_nearest_window",
    f"""WITH {RIDES}, {traffic_sql(WEEK_US // 28)}, w AS (SELECT DISTINCT pickup_zone, window_start FROM traffic WHERE request_count > 10),
    b AS (SELECT r.request_id, r.pickup_zone, r.request_ts, w.window_start AS before FROM rides r ASOF LEFT JOIN w
      ON r.pickup_zone = w.pickup_zone AND r.request_ts >= w.window_start),
    f AS (SELECT r.request_id, w.window_start AS after FROM rides r ASOF LEFT JOIN w
      ON r.pickup_zone = w.pickup_zone AND r.request_ts <= w.window_start)
    SELECT request_id, CASE WHEN after IS NULL OR epoch_us(request_ts) - epoch_us(before) <= epoch_us(after) - epoch_us(request_ts)
      THEN before ELSE after END AS nearest FROM b JOIN f USING (request_id)""",
)
def _(spark, d):
    rides = t.rides_from_events(spark, d).select("request_id", "pickup_zone", "request_ts")
    windows = agg.zone_traffic(t.rides_from_events(spark, d), "6 hours").where(F.col("request_count") > 10)
    return joins.nearest_window(rides, windows, "request_ts", keys=["pickup_zone"]).select("request_id", "nearest")


@query(
    "j5_current_anomalies",
    f"""WITH {EVENT_TRAFFIC}, e AS (SELECT pickup_zone, window_time, 'because' AS r FROM traffic WHERE request_count > 5)
    SELECT pickup_zone, window_time, coalesce(r, 'n=' || request_count) AS anomaly_reason,
    CASE WHEN r IS NOT NULL THEN 'doc' END AS top_chunk_1 FROM traffic LEFT JOIN e USING (pickup_zone, window_time)""",
)
def _(spark, d):
    traffic = i.traffic(spark, d)
    base = traffic.select(
        "pickup_zone", "window_time",
        F.concat(F.lit("n="), F.col("request_count").cast("string")).alias("anomaly_reason"),
        F.lit(None).cast("string").alias("top_chunk_1"),
    )
    enriched = traffic.where(F.col("request_count") > 5).select(
        "pickup_zone", "window_time", F.lit("because").alias("anomaly_reason"), F.lit("doc").alias("top_chunk_1")
    )
    return joins.current_anomalies(base, enriched, fields=["anomaly_reason", "top_chunk_1"])


@query(
    "j6_without_evidence",
    f"""WITH {EVENT_TRAFFIC} SELECT pickup_zone, window_time FROM traffic WHERE request_count <= 5
    AND window_end <= TIMESTAMP '2024-01-25' - INTERVAL 40 SECOND""",
)
def _(spark, d):
    traffic = i.traffic(spark, d)
    enriched = traffic.select(
        "pickup_zone", "window_time", F.when(F.col("request_count") > 5, F.lit("doc")).alias("top_chunk_1")
    )
    due = joins.without_evidence(traffic, enriched, at("2024-01-25"), arrival="window_end")
    return due.select("pickup_zone", "window_time")


@query(
    "j8_overlapping_events",
    f"""WITH {EVENT_SURGES}, {CALENDAR_SQL}, c AS (SELECT event_name, zone, impact_level, event_time_start,
      CASE WHEN event_time_end < event_time_start THEN event_time_end + INTERVAL 1 DAY ELSE event_time_end END AS event_time_end FROM calendar)
    SELECT pickup_zone, window_time, event_name, event_time_end FROM surges JOIN c ON zone = pickup_zone
      AND event_time_start <= window_time + INTERVAL 1 HOUR AND event_time_end >= window_time - INTERVAL 1 HOUR
    WHERE impact_level = 'high'""",
)
def _(spark, d):
    high = t.calendar(spark, d).where(F.col("impact_level") == "high")
    pairs = joins.overlapping_events(i.surges(spark, d).select("pickup_zone", "window_time"), high)
    return pairs.select("pickup_zone", "window_time", "event_name", "event_time_end")


@query("j9_watched", "SELECT event_id, event_type AS collection FROM events WHERE event_type IN ('click', 'purchase')")
def _(spark, d):
    changes = t.table(spark, d, "events").select("event_id", F.col("event_type").alias("collection"))
    return joins.watched(changes, ["click", "purchase"])


@query(
    "g1_change_feed",
    f"""WITH {EVENT_TRAFFIC}, {RAW_LOG_SQL} SELECT 'analytics.zone_traffic' AS collection, 'insert' AS operationType, window_end AS ts,
      '{{"pickup_zone":"' || pickup_zone || '","request_count":' || request_count
      || ',"window_end":"' || strftime(window_end, '%Y-%m-%dT%H:%M:%S.%f+00:00') || '"}}' AS doc FROM traffic
    UNION ALL SELECT 'fleet.dispatch_log', 'replace', window_time, '{{"pickup_zone":"' || pickup_zone
      || '","window_time":"' || strftime(window_time, '%Y-%m-%dT%H:%M:%S.%f+00:00') || '"}}' FROM log
      WHERE dispatched_at IS NOT NULL""",
)
def _(spark, d):
    traffic = i.traffic(spark, d)
    log = i.dispatch_log(spark, d).withColumn(
        "operationType", F.when(F.col("dispatched_at").isNull(), "delete").otherwise("replace")
    )
    tables = {
        "analytics.zone_traffic": traffic.select("pickup_zone", "request_count", "window_end"),
        "fleet.dispatch_log": log.select("pickup_zone", "operationType", "window_time"),
        "events.drafts": traffic.select("pickup_zone"),
    }
    arrived = {"analytics.zone_traffic": F.col("window_end"), "fleet.dispatch_log": F.col("window_time")}
    return feed.change_feed(tables, arrived)
