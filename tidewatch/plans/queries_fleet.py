"""Vector search, the knowledge base, dispatch and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.operators import dispatch, nearest, paths, vector
from tidewatch.plans import inputs as i
from tidewatch.plans import surge
from tidewatch.plans.inputs import DISPATCHES_SQL
from tidewatch.plans.registry import CALENDAR_SQL, EVENT_SURGES, KB_SQL, LINE_SURGES, query
from tidewatch.session import materialize
from tidewatch.sources import tables as t

# -- vector search -------------------------------------------------------------------


def _queries(spark, d):
    return t.knowledge_base(spark, d).withColumn("query_id", F.col("document_id"))


def _near_sql(where: str = "", k: int = 3) -> str:
    return f"""pairs AS (SELECT q.document_id AS query_id, b.document_id, b.chunk,
      round(list_cosine_similarity(q.embedding, b.embedding), 9) AS cosine FROM kb q JOIN kb b ON true {where}),
    hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, document_id) AS INTEGER) AS rank FROM pairs
      QUALIFY rank <= {k})"""


HITS_OUT = "SELECT query_id, document_id, rank, round(cosine, 6) AS cosine, round((1 + cosine) / 2, 6) AS score FROM hits"


def _hits(df):
    return df.withColumns({"cosine": F.round("cosine", 6), "score": F.round("score", 6)})


@query("v1_top_k", f"WITH {KB_SQL}, {_near_sql()} {HITS_OUT}")
def _(spark, d):
    return _hits(vector.search(_queries(spark, d), t.knowledge_base(spark, d)))


@query("v2_filtered_top_k", f"WITH {KB_SQL}, {_near_sql('AND q.zone = b.zone AND q.impact_level = b.impact_level')} {HITS_OUT}")
def _(spark, d):
    return _hits(vector.search(_queries(spark, d), t.knowledge_base(spark, d), match=["zone", "impact_level"]))


@query("v3_cells_exact", f"WITH {KB_SQL}, {_near_sql()} {HITS_OUT}")
def _(spark, d):
    return _hits(vector.search_cells(_queries(spark, d), vector.Cells(t.knowledge_base(spark, d))))


@query("v3_cells_candidates")
def _(spark, d):
    return _hits(vector.search_cells(_queries(spark, d), vector.Cells(t.knowledge_base(spark, d)), exact=False))


@query(
    "x9_hit_columns",
    f"""WITH {KB_SQL}, {_near_sql()} SELECT query_id, max(document_id) FILTER (rank = 1) AS top_document_1, max(chunk) FILTER (rank = 1) AS top_chunk_1,
    max(document_id) FILTER (rank = 2) AS top_document_2, max(chunk) FILTER (rank = 2) AS top_chunk_2, max(document_id) FILTER (rank = 3) AS top_document_3,
    CAST(NULL AS VARCHAR) AS top_document_4 FROM hits GROUP BY 1""",
)
def _(spark, d):
    kb = t.knowledge_base(spark, d)
    hits = vector.search_results(vector.search(_queries(spark, d), kb), kb)
    at = surge.hit
    return hits.select(
        "query_id",
        at("search_results", 1, "document_id").alias("top_document_1"),
        at("search_results", 1, "chunk").alias("top_chunk_1"),
        at("search_results", 2, "document_id").alias("top_document_2"),
        at("search_results", 2, "chunk").alias("top_chunk_2"),
        at("search_results", 3, "document_id").alias("top_document_3"),
        at("search_results", 4, "document_id").alias("top_document_4"),
    )


@query(
    "v5_chunks",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS ws FROM documents),
    n AS (SELECT *, len(ws) AS n FROM w WHERE len(ws) > 0),
    c AS (SELECT *, unnest(range(0, greatest(CAST(ceil((n - 256) / 224.0) AS BIGINT), 0) + 1)) AS i FROM n)
    SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(ws[i * 224 + 1 : i * 224 + 256], ' ') AS chunk,
      CAST(len(ws[i * 224 + 1 : i * 224 + 256]) AS INTEGER) AS n_words FROM c""",
)
def _(spark, d):
    return vector.chunks(t.table(spark, d, "documents"), key="doc_id")


@query(
    "v7_freshness",
    f"""WITH {KB_SQL} SELECT embedding_model, CAST(len(embedding) AS INTEGER) AS embedding_dim, count(*) AS documents,
    count(embedding) AS embedded, embedding_model = 'm-2' AS is_current FROM kb GROUP BY ALL""",
)
def _(spark, d):
    return vector.freshness(t.knowledge_base(spark, d), "m-2")


# -- knowledge base and explanation ------------------------------------------------------


def _built(spark, d):
    rows = surge.knowledge_rows(t.calendar(spark, d), F.lit("2024-02-01").cast("timestamp"))[0]
    return materialize(rows, "knowledge")


@query(
    "v4_build_knowledge_base",
    f"""WITH {CALENDAR_SQL} SELECT 'event-' || doc_id || '-' || zone AS document_id, description AS chunk, event_name, zone, impact_level,
    CASE WHEN length(trim(description)) > 0 THEN 64 END AS embedding_dim, 'hash-1' AS embedding_model, TIMESTAMP '2024-02-01' AS embedded_at FROM calendar""",
)
def _(spark, d):
    kb = _built(spark, d).withColumn("embedding_dim", F.size("embedding"))
    return kb.select(
        "document_id", "chunk", "event_name", "zone", "impact_level", "embedding_dim", "embedding_model", "embedded_at"
    )


def first_sentence(prompt: Column) -> Column:
    """A call that answers with the beginning of the first document in the prompt."""
    document = F.regexp_extract(prompt, r"<<DOC 1 START>>\n[^\n]*\n[^\n]*\n([^\n]*?)(\. |\n)", 1)
    return F.concat(F.lit("Likely related: "), document)


@query("v6_explained_surges")
def _(spark, d):
    return surge.explained(i.surges(spark, d), _built(spark, d), first_sentence)


@query(
    "v6_explained_keys",
    f"""WITH {EVENT_SURGES}, {CALENDAR_SQL} SELECT pickup_zone, window_time, request_count, expected_requests, least(3, (SELECT count(*) FROM calendar)) AS chunks
    FROM surges WHERE EXISTS (SELECT 1 FROM calendar)""",
)
def _(spark, d):
    """Every surge with as many chunks as there are, up to three, and a reason from the first."""
    found = surge.explained(i.surges(spark, d), _built(spark, d), first_sentence)
    chunks = F.size(F.filter(F.array(*[f"top_chunk_{n}" for n in (1, 2, 3)]), lambda c: c.isNotNull()))
    told = F.concat(F.lit("Likely related: "), F.substring_index("top_chunk_1", "\n", 1))
    agrees = F.startswith(told, F.col("anomaly_reason")) & (F.length("anomaly_reason") > F.length(F.lit("Likely related:")))
    return found.where(agrees).select("pickup_zone", "window_time", "request_count", "expected_requests", chunks.cast("long").alias("chunks"))


# -- dispatch ---------------------------------------------------------------------------------


def _plan_sql(rounds: int = 12) -> str:
    """Rounds written out, more than the tables need: a round that claims nothing changes nothing."""
    parts = [
        f"""{LINE_SURGES}, stops AS (SELECT n_name AS zone, n_nationkey AS idx FROM nation),
  need AS (SELECT pickup_zone, window_time, request_count - expected_requests AS need, idx FROM surges
    JOIN stops ON zone = pickup_zone WHERE request_count > expected_requests),
  fleet AS (SELECT s_name AS vessel_id, n_name AS base_zone, n_nationkey AS vidx, CAST(5 + s_suppkey % 5 AS BIGINT) AS capacity FROM supplier
    JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0),
  taken0 AS (SELECT pickup_zone, window_time, '' AS vessel_id, 0 AS round, 0 AS cost, CAST(0 AS BIGINT) AS capacity FROM need WHERE false)"""
    ]
    for r in range(1, rounds + 1):
        parts.append(f"""
  free{r} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vidx ORDER BY capacity DESC, vessel_id) - 1 AS place FROM fleet
    WHERE vessel_id NOT IN (SELECT vessel_id FROM taken{r - 1})),
  short{r} AS MATERIALIZED (SELECT *, least(8 - boats, CAST(ceil(short / CAST((SELECT max(capacity) FROM free{r}) AS DOUBLE)) AS BIGINT)) AS asks
    FROM (SELECT n.pickup_zone, n.window_time, idx, need - coalesce(sum(capacity), 0) AS short, count(vessel_id) AS boats
    FROM need n LEFT JOIN taken{r - 1} x ON x.pickup_zone = n.pickup_zone AND x.window_time = n.window_time
    GROUP BY n.pickup_zone, n.window_time, idx, need) WHERE short > 0 AND boats < 8),
  claim{r} AS (SELECT *, abs(idx - vidx) AS cost FROM (SELECT idx, sum(asks) AS wanted, sum(short) AS lack FROM short{r} GROUP BY idx) JOIN free{r} ON idx <> vidx
    QUALIFY row_number() OVER (PARTITION BY idx ORDER BY abs(idx - vidx), capacity DESC, vessel_id) <= wanted),
  best{r} AS (SELECT * FROM claim{r} QUALIFY cost = min(cost) OVER (PARTITION BY vessel_id)),
  won{r} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY cost, capacity DESC, vessel_id) - 1 AS slot FROM (SELECT * FROM best{r}
    QUALIFY row_number() OVER (PARTITION BY vessel_id ORDER BY lack DESC, idx) - 1 = place % count(*) OVER (PARTITION BY vessel_id))),
  first{r} AS (SELECT *, sum(asks) OVER (PARTITION BY idx ORDER BY short DESC, window_time, pickup_zone ROWS UNBOUNDED PRECEDING) - asks AS before FROM short{r}),
  taken{r} AS MATERIALIZED (SELECT * FROM taken{r - 1} UNION ALL SELECT pickup_zone, window_time, vessel_id, {r}, cost, capacity
    FROM first{r} f JOIN won{r} w ON f.idx = w.idx AND slot >= before AND slot < before + asks)""")
    return ",".join(parts) + f", assigned AS (SELECT t.*, base_zone FROM taken{rounds} t JOIN fleet USING (vessel_id))"


PLAN_SQL = _plan_sql()


def _plan(spark, d):
    return dispatch.plan(i.line_surges(spark, d), t.vessels(spark, d), t.zone_index(spark, d))


@query(
    "dsp_plan",
    f"WITH {PLAN_SQL} SELECT pickup_zone, window_time, vessel_id, round, cost, capacity, base_zone FROM assigned",
)
def _(spark, d):
    return _plan(spark, d)


@query(
    "dsp2_completed_actions",
    f"""WITH {PLAN_SQL}, per AS (SELECT pickup_zone, window_time, count(*) AS n, sum(capacity) AS seats,
      string_agg('{{"vessel_id":"' || vessel_id || '","new_zone":"' || pickup_zone || '","new_availability":"hired"}}', ',' ORDER BY vessel_id) AS boats,
      array_to_string(list_sort(list_distinct(list(base_zone))), ', ') AS zones FROM assigned GROUP BY 1, 2)
    SELECT pickup_zone, window_time, request_count, 'Surge detected: ' || request_count || ' requests (expected ' || expected_requests || ')' AS anomaly_reason,
      'Due to the surge in demand in ' || pickup_zone || ' as a result of high demand, we dispatched ' || n || ' additional boats from ' || zones || '.'
        AS dispatch_summary, '[' || boats || ']' AS dispatch_json,
      '{{"status":"success","boats_dispatched":' || n || ',"total_capacity_added":' || seats || '}}' AS api_response
    FROM surges JOIN per USING (pickup_zone, window_time)""",
)
def _(spark, d):
    s = materialize(i.line_surges(spark, d), "surges")
    return dispatch.completed_actions(s, dispatch.plan(s, t.vessels(spark, d), t.zone_index(spark, d)))


@query(
    "dsp3_vessels_after_dispatch",
    f"""WITH {PLAN_SQL} SELECT s_name AS vessel_id, 'Boat ' || s_suppkey AS vessel_name, n_name AS base_zone,
      CASE WHEN a.vessel_id IS NOT NULL THEN 'hired' WHEN s_suppkey % 4 = 0 THEN 'in_dock' ELSE 'available' END AS availability,
      CAST(5 + s_suppkey % 5 AS INTEGER) AS capacity, coalesce(a.pickup_zone, n_name) AS current_zone
    FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN assigned a ON a.vessel_id = s_name""",
)
def _(spark, d):
    return dispatch.apply_dispatch(t.vessels(spark, d), _plan(spark, d))


# -- paths ------------------------------------------------------------------------------------------

STITCH_SQL = """pts AS (SELECT event_type AS path_id, user_id AS way, event_id AS pos,
      CAST(CAST(regexp_extract(props, '"k": *(\\d+)', 1) AS INTEGER) % 4 AS DOUBLE) AS lon, CAST(user_id % 3 AS DOUBLE) AS lat FROM events),
  ends AS (SELECT path_id, way, min(pos) AS p0, arg_min(lon, pos) AS lon0, arg_min(lat, pos) AS lat0, arg_max(lon, pos) AS lon1,
      arg_max(lat, pos) AS lat1 FROM pts GROUP BY 1, 2),
  joint AS (SELECT path_id, way, p0 AS pos FROM ends WINDOW w AS (PARTITION BY path_id ORDER BY way)
      QUALIFY lag(lon1) OVER w = lon0 AND lag(lat1) OVER w = lat0),
  kept AS (SELECT * FROM pts ANTI JOIN joint USING (path_id, way, pos) WHERE lon BETWEEN 0 AND 2 AND lat BETWEEN 0 AND 2)"""


@query(
    "r1_stitch",
    f"""WITH {STITCH_SQL} SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY way DESC, pos DESC) - 1 AS idx, lon, lat FROM kept""",
)
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    points = t.table(spark, d, "events").select(
        F.col("event_type").alias("path_id"),
        F.col("user_id").alias("way"),
        F.col("event_id").alias("pos"),
        (k % 4).cast("double").alias("lon"),
        (F.col("user_id") % 3).cast("double").alias("lat"),
    )
    return paths.stitch(points, {"lon": (0.0, 2.0), "lat": (0.0, 2.0)})


def _hops(spark, d):
    """Zone pairs that lines travel: from the customer's nation to the supplier's."""
    nation = t.table(spark, d, "nation").select("n_nationkey", "n_name")
    cust = t.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    orders = t.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    sup = t.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    keys = (
        t.table(spark, d, "lineitem")
        .select("l_orderkey", "l_suppkey")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("c_nationkey", "s_nationkey")
        .distinct()
    )
    a, b = nation.alias("a"), nation.alias("b")
    named = keys.join(a, F.col("c_nationkey") == F.col("a.n_nationkey")).join(b, F.col("s_nationkey") == F.col("b.n_nationkey"))
    return named.select(F.col("a.n_name").alias("origin"), F.col("b.n_name").alias("destination"))


HOPS_SQL = """hops AS (SELECT DISTINCT a.n_name AS origin, b.n_name AS destination, c_nationkey AS a, s_nationkey AS b
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE c_nationkey <> s_nationkey),
  way AS (SELECT origin, destination, abs(n_nationkey - a) AS seq, n_nationkey AS idx, -90.0::DOUBLE - n_nationkey * 0.01::DOUBLE AS lon,
    29.9::DOUBLE + (n_nationkey % 5) * 0.02::DOUBLE AS lat FROM hops JOIN nation ON n_nationkey BETWEEN least(a, b) AND greatest(a, b)),
  seg AS (SELECT *, coalesce(sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)), 0) AS len FROM way
    WINDOW w AS (PARTITION BY origin, destination ORDER BY seq)),
  progress AS (SELECT *, sum(len) OVER (PARTITION BY origin, destination ORDER BY seq) / sum(len) OVER (PARTITION BY origin, destination) AS share FROM seg)"""


@query("r2_paths", f"WITH {HOPS_SQL} SELECT origin, destination, CAST(seq AS INTEGER) AS seq, idx, round(lon, 6) AS lon, round(lat, 6) AS lat FROM way")
def _(spark, d):
    path = paths.paths(_hops(spark, d), t.zone_index(spark, d), t.waypoints(spark, d))
    return path.select("origin", "destination", "seq", "idx", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("w7_path_progress", f"WITH {HOPS_SQL} SELECT origin, destination, CAST(seq AS INTEGER) AS seq, round(share, 6) AS share FROM progress")
def _(spark, d):
    path = paths.paths(_hops(spark, d), t.zone_index(spark, d), t.waypoints(spark, d))
    return paths.with_progress(path, ["origin", "destination"]).select("origin", "destination", "seq", F.round("share", 6).alias("share"))


@query(
    "r3_constant_speed",
    f"""WITH {HOPS_SQL} SELECT origin, destination, CAST(seq AS INTEGER) AS seq, CAST(floor(round(1000 + share * 8000, 6)) AS BIGINT) AS t_ms
    FROM progress""",
)
def _(spark, d):
    path = paths.paths(_hops(spark, d), t.zone_index(spark, d), t.waypoints(spark, d))
    return paths.with_times(path, ["origin", "destination"], F.lit(1000)).select("origin", "destination", "seq", "t_ms")


TRIPS_SQL = f"""{LINE_SURGES}, {DISPATCHES_SQL}, homes AS (SELECT s_name AS vessel_id, n_name AS origin FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  listed AS (SELECT pickup_zone, window_time, vessel_id, origin FROM dispatches JOIN homes ON vessel_id = 'Supplier#' || lpad(CAST(request_count % 10 AS VARCHAR), 9, '0')
    WHERE request_count % 2 = 0 AND origin <> pickup_zone),
  spare AS (SELECT d.pickup_zone, d.window_time, vessel_id, origin FROM dispatches d ANTI JOIN listed l USING (pickup_zone, window_time)
    JOIN homes ON origin <> d.pickup_zone QUALIFY row_number() OVER (PARTITION BY d.pickup_zone, d.window_time ORDER BY vessel_id) <= 3),
  trips AS (SELECT * FROM listed UNION ALL SELECT * FROM spare)"""


@query("r4_trips", f"WITH {TRIPS_SQL} SELECT pickup_zone, window_time, vessel_id, origin FROM trips")
def _(spark, d):
    return paths.trip_starts(i.dispatches(spark, d), t.vessels(spark, d), t.zone_index(spark, d))


@query(
    "x2_listed_boats",
    f"""WITH {LINE_SURGES}, {DISPATCHES_SQL} SELECT pickup_zone, window_time, 0 AS item,
      'Supplier#' || lpad(CAST(request_count % 10 AS VARCHAR), 9, '0') AS vessel_id FROM dispatches WHERE request_count % 2 = 0""",
)
def _(spark, d):
    return paths.listed_boats(i.dispatches(spark, d))


DJB2 = """CAST(list_reduce(list_prepend(CAST(5381 AS HUGEINT), list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
    lambda h, c: (h * 33 + c) % 4294967296) % 22000 AS BIGINT)"""


@query(
    "r5_positions",
    f"""WITH {TRIPS_SQL}, ends AS (SELECT t.*, a.n_nationkey AS a, b.n_nationkey AS b, {DJB2.format('vessel_id')} AS t0 FROM trips t
      JOIN nation a ON a.n_name = origin JOIN nation b ON b.n_name = pickup_zone),
    way AS (SELECT pickup_zone, window_time, vessel_id, t0, abs(n_nationkey - a) AS seq, -90.0::DOUBLE - n_nationkey * 0.01::DOUBLE AS lon,
      29.9::DOUBLE + (n_nationkey % 5) * 0.02::DOUBLE AS lat FROM ends JOIN nation ON n_nationkey BETWEEN least(a, b) AND greatest(a, b)),
    seg AS (SELECT *, coalesce(sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)), 0) AS len FROM way
      WINDOW w AS (PARTITION BY pickup_zone, window_time, vessel_id ORDER BY seq)),
    timed AS (SELECT *, CAST(floor(round(t0 + sum(len) OVER (w ROWS UNBOUNDED PRECEDING) / sum(len) OVER (PARTITION BY pickup_zone, window_time, vessel_id)
      * 8000, 6)) AS BIGINT) AS ms FROM seg WINDOW w AS (PARTITION BY pickup_zone, window_time, vessel_id ORDER BY seq)),
    legs AS (SELECT *, lead(lon) OVER w AS lon1, lead(lat) OVER w AS lat1, lead(ms) OVER w AS ms1 FROM timed
      WINDOW w AS (PARTITION BY pickup_zone, window_time, vessel_id ORDER BY seq)),
    hit AS (SELECT * FROM legs WHERE 15000 BETWEEN ms AND ms1
      QUALIFY row_number() OVER (PARTITION BY pickup_zone, window_time, vessel_id ORDER BY seq) = 1)
    SELECT pickup_zone, window_time, vessel_id, round(lon + (lon1 - lon) * (15000 - ms) / greatest(ms1 - ms, 1), 6) AS lon,
      round(lat + (lat1 - lat) * (15000 - ms) / greatest(ms1 - ms, 1), 6) AS lat, round(degrees(atan2(lat1 - lat, lon1 - lon)), 6) AS heading FROM hit""",
)
def _(spark, d):
    points = paths.trips(i.dispatches(spark, d), t.vessels(spark, d), t.zone_index(spark, d), t.waypoints(spark, d))
    found = paths.positions(points, 15_000)
    return found.withColumns({c: F.round(c, 6) for c in ("lon", "lat", "heading")})


@query(
    "r6_zone_markers",
    """WITH z AS (SELECT c_custkey AS ord, c_mktsegment || c_nationkey AS zone, CAST(c_nationkey AS BIGINT) AS lon, length(c_mktsegment) AS lat,
      c_acctbal > 9900 AS act FROM customer), n AS (SELECT *, zone IN (SELECT zone FROM z WHERE act) AS flag FROM z)
    SELECT lon, lat, arg_min(zone, ord) AS name, bool_or(flag) AS is_active FROM n GROUP BY 1, 2""",
)
def _(spark, d):
    zone = F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))
    places = t.table(spark, d, "customer").select(
        F.col("c_custkey").alias("ord"),
        zone.alias("zone"),
        F.col("c_nationkey").cast("long").alias("lon"),
        F.length("c_mktsegment").cast("long").alias("lat"),
        "c_acctbal",
    )
    return paths.zone_markers(places.drop("c_acctbal"), places.where(F.col("c_acctbal") > 9900))


@query(
    "j7_nearest_point",
    """WITH q AS (SELECT event_id AS zone, value AS lon, CAST(user_id AS DOUBLE) AS lat FROM events),
    w AS (SELECT p_partkey AS idx, p_retailprice - 900 AS lon, CAST(p_size * 3 AS DOUBLE) AS lat FROM part)
    SELECT zone, arg_min(idx, (pow(q.lon - w.lon, 2) + pow(q.lat - w.lat, 2), idx)) AS idx,
      round(min(pow(q.lon - w.lon, 2) + pow(q.lat - w.lat, 2)), 6) AS d2 FROM q, w GROUP BY zone""",
)
def _(spark, d):
    points = t.table(spark, d, "events").select(
        F.col("event_id").alias("zone"), F.col("value").alias("lon"), F.col("user_id").cast("double").alias("lat")
    )
    marks = t.table(spark, d, "part").select(
        F.col("p_partkey").alias("idx"), (F.col("p_retailprice") - 900).alias("lon"), (F.col("p_size") * 3).cast("double").alias("lat")
    )
    return nearest.nearest_point(points, marks).withColumn("d2", F.round("d2", 6))
