"""Loading, accounting, model calls, the snapshot, and streams fed in several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import first_embedding
from tidewatch.operators import joins
from tidewatch.operators.aggregates import latest_per_zone, stage_counters
from tidewatch.operators.keyed import RETENTION_DAYS, KeyedTable, remove_keys, upsert_merge
from tidewatch.operators.models import HashEmbedder, embed, generate, lateral
from tidewatch.plans import bootstrap
from tidewatch.plans import inputs as i
from tidewatch.plans.registry import CALENDAR_SQL, EVENT_TRAFFIC, RAW_SQL, RIDES, query
from tidewatch.session import materialize, new_path
from tidewatch.sources import seeds, sinks
from tidewatch.sources import tables as t
from tidewatch.sources.captured_stream import captured_stream, write_captured
from tidewatch.sources.rides import with_event_time
from tidewatch.streaming import jobs

# -- sources and sinks ------------------------------------------------------------


@query("s8_ingest_stamp", "SELECT event_id, ts AS ingested_at, true AS file_time FROM events")
def _(spark, d):
    """The stamp of a source column, and the file's own where none is given."""
    events = t.table(spark, d, "events")
    by_file = sinks.stamp(events, "file_time").withColumn("ts", F.col("ts").cast("timestamp"))
    return sinks.stamp(by_file, source=F.col("ts")).select("event_id", "ingested_at", F.col("file_time").isNotNull().alias("file_time"))


SEED_DAY = "2024-03-05"


@query(
    "s9_seed_calendar",
    f"""WITH {CALENDAR_SQL} SELECT event_name, zone, description, venue, expected_attendance, event_type, impact_level,
    TIMESTAMP '{SEED_DAY}' + to_hours(hour(event_time_start)) + to_minutes(CAST(doc_id % 60 AS INTEGER)) AS event_time_start,
    TIMESTAMP '{SEED_DAY}' + to_hours(hour(event_time_end)) AS event_time_end, 'event-' || doc_id || '-' || zone AS document_id FROM calendar""",
)
def _(spark, d):
    """The calendar as hand-written JSON lists, read back for a day."""
    n = F.substring_index("event_name", " ", -1).cast("long")
    clock = {
        "event_time_start_hour": F.hour("event_time_start"),
        "event_time_start_min": (n % 60).cast("int"),
        "event_time_end_hour": F.hour("event_time_end"),
        "event_time_end_min": F.lit(0),
    }
    path = new_path(spark, "seeds")
    seeds.write_lists(t.calendar(spark, d).withColumns(clock).drop("event_time_start", "event_time_end"), path)
    return seeds.read_calendar(spark, path, SEED_DAY)


@query(
    "s10_write_accounting",
    "SELECT count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag <> 'R') AS success FROM lineitem",
)
def _(spark, d):
    lines = t.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    counted, seen = sinks.accounted(lines, F.col("l_returnflag") == "R")
    materialize(counted, "accounted")
    return spark.createDataFrame([tuple(seen.get[k] for k in ("total", "failed", "success"))], "total long, failed long, success long")


@query(
    "s12_load_once",
    """WITH n AS (SELECT count(*) AS c FROM part) SELECT * FROM (SELECT 1 AS step, false AS refused, c AS rows FROM n UNION ALL
    SELECT 2, true, c FROM n UNION ALL SELECT 3, false, 2 * c FROM n)""",
)
def _(spark, d):
    """First load, a second one, and a forced one."""
    parts, path, out = t.table(spark, d, "part").select("p_partkey"), new_path(spark, "load"), []
    for step in (1, 2, 3):
        refused = False
        try:
            sinks.load_once(spark, parts, path, force=step == 3)
        except sinks.AlreadyLoaded:
            refused = True
        out.append((step, refused, spark.read.parquet(path).count()))
    return spark.createDataFrame(out, "step int, refused boolean, rows long")


@query("p4_first_embedding", "SELECT vec_id, CASE WHEN label % 3 > 0 THEN CAST(embedding AS DOUBLE[]) END AS embedding FROM embeddings")
def _(spark, d):
    """Replies of an embedding service: a list of results, sometimes empty."""
    one, two = F.struct("embedding"), F.struct(F.reverse("embedding").alias("embedding"))
    data = F.when(F.col("label") % 3 == 1, F.array(one)).when(F.col("label") % 3 == 2, F.array(one, two)).otherwise(F.array())
    replies = t.table(spark, d, "embeddings").select("vec_id", data.cast("array<struct<embedding:array<double>>>").alias("data"))
    return replies.select("vec_id", first_embedding("data").alias("embedding"))


# -- calls ----------------------------------------------------------------------------


def _sentences(texts: list) -> list:
    return [[{"n": k, "sentence": s} for k, s in enumerate(x.split(". ")) if len(s) > 80] for x in texts]


LATERAL_SQL = """calls AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS sentence, unnest(range(0, len(string_split(text, '. ')))) AS n
  FROM conversations)"""


@query("j1_lateral_call", f"WITH {LATERAL_SQL} SELECT conv_id, turn, CAST(n AS INTEGER) AS n, sentence FROM calls WHERE length(sentence) > 80")
def _(spark, d):
    turns = t.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return lateral(turns, "text", _sentences, "n int, sentence string").drop("text")


@query(
    "j1_lateral_call_left",
    f"""WITH {LATERAL_SQL}, long AS (SELECT * FROM calls WHERE length(sentence) > 80)
    SELECT c.conv_id, c.turn, CAST(n AS INTEGER) AS n, sentence FROM conversations c LEFT JOIN long USING (conv_id, turn)""",
)
def _(spark, d):
    turns = t.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return lateral(turns, "text", _sentences, "n int, sentence string", "left").drop("text")


@query(
    "m1_embed",
    """SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN 64 END AS dim, CASE WHEN turn % 5 <> 4 THEN CASE WHEN trim(text) = '' THEN 0.0 ELSE 1.0 END END AS norm
    FROM conversations""",
)
def _(spark, d):
    turns = t.table(spark, d, "conversations").withColumn("said", F.when(F.col("turn") % 5 != 4, F.col("text")))
    vectors = embed(turns, "said", HashEmbedder())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.select("conv_id", "turn", F.size("embedding").alias("dim"), F.round(norm, 5).alias("norm"))


class Opening:
    """Stands in for a text model: repeats the first words, refuses prompts that begin with T."""

    def write(self, prompts, max_tokens):
        if any(p.startswith("T") for p in prompts):
            raise ValueError("refused")
        return [" ".join(p.split(" ")[: min(max_tokens, 3)]) for p in prompts]


@query(
    "m2_generate",
    """SELECT conv_id, turn, CASE WHEN text NOT LIKE 'T%' THEN array_to_string(string_split(text, ' ')[1:3], ' ') END AS response,
    CASE WHEN text LIKE 'T%' THEN 'ValueError: refused' END AS response_error FROM conversations""",
)
def _(spark, d):
    turns = t.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return generate(turns, "text", Opening(), on_error="row", retries=1, timeout=60).drop("text")


# -- the snapshot --------------------------------------------------------------------------


@query(
    "t7_snapshot",
    f"""WITH {EVENT_TRAFFIC}, {CALENDAR_SQL} SELECT * FROM (SELECT 'vessels' AS section, (SELECT count(*) FROM supplier) AS rows UNION ALL
    SELECT 'anomalies', least(20, (SELECT count(*) FROM traffic)) UNION ALL SELECT 'dispatches', NULL UNION ALL
    SELECT 'knowledge', least(12, (SELECT count(*) FROM calendar)) UNION ALL
    SELECT 'traffic', least(340, (SELECT count(*) FROM traffic)) UNION ALL SELECT 'counts', 4)""",
)
def _(spark, d):
    """Six sections; the one whose table turns out unreadable is empty."""
    traffic = materialize(i.sunk_traffic(spark, d), "snapshot-traffic")

    def broken() -> DataFrame:
        return traffic.select(F.col("zone").alias("pickup_zone"), F.raise_error(F.lit("unreadable")).cast("timestamp").alias("dispatched_at"))

    tables = {
        "vessels": lambda: t.vessels(spark, d),
        "anomalies": lambda: traffic.select(F.col("zone").alias("pickup_zone"), F.col("window_start").alias("window_time"), F.col("window_start").alias("detected_at"), "request_count"),
        "dispatches": broken,
        "knowledge": lambda: t.calendar(spark, d).withColumn("document_id", F.col("event_name")),
        "traffic": lambda: traffic,
    }
    found = bootstrap.warm_start(tables, F.lit("2024-02-01").cast("timestamp"))
    return spark.createDataFrame([(k, None if v is None else v.count()) for k, v in found.items()], "section string, rows long")


# -- streams fed in batches -----------------------------------------------------------------------


def _fed(spark, batches: list[DataFrame], consume) -> str:
    """Write one batch after the other into a folder; ``consume`` runs to the end after each."""
    path = new_path(spark, "feed")
    for batch in batches:
        batch.write.mode("append").parquet(path)
        consume(path)
    return path


def _rides(spark, d, keep):
    return t.as_rides(t.table(spark, d, "events").where(keep))


@query("st1_watermarked_rides", f"WITH {RIDES} SELECT request_id, pickup_zone, request_ts FROM rides")
def _(spark, d):
    """A watermark alone holds nothing back, also rows that come late."""
    out, mark = new_path(spark, "st1"), new_path(spark, "mark")
    newer = F.col("event_id") % 2 == 0

    def consume(path):
        rides = with_event_time(jobs.table_stream(spark, path, _rides(spark, d, newer).schema))
        jobs.append(rides.select("request_id", "pickup_zone", "request_ts"), out, mark).awaitTermination()

    _fed(spark, [_rides(spark, d, newer), _rides(spark, d, ~newer)], consume)
    return spark.read.parquet(out)


LATE_SQL = f"""{RIDES}, mark AS (SELECT epoch_ms(max(request_ts)) * 1000 - 5000000 AS w FROM rides WHERE CAST(request_id AS BIGINT) % 2 = 0)"""


@query(
    "st3_late_rows",
    f"""WITH {LATE_SQL} SELECT count(*) AS input_rows, count(*) FILTER (CAST(request_id AS BIGINT) % 2 = 1 AND epoch_us(request_ts) <= w) AS late_rows
    FROM rides, mark""",
)
def _(spark, d):
    """Rows behind the watermark are dropped by a stateful step, and the progress log counts them."""
    path, out, mark, newer = new_path(spark, "progress"), new_path(spark, "st3"), new_path(spark, "mark"), F.col("event_id") % 2 == 0
    log = jobs.ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:

        def consume(folder):
            rides = with_event_time(jobs.table_stream(spark, folder, _rides(spark, d, newer).schema))
            q = jobs.append(rides.dropDuplicatesWithinWatermark(["request_id"]).select("request_id"), out, mark)
            q.awaitTermination()
            log.wait_for(q)

        _fed(spark, [_rides(spark, d, newer), _rides(spark, d, ~newer)], consume)
    finally:
        spark.streams.removeListener(log)
    return jobs.progress_rows(spark, path).agg(F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"))


@query(
    "st3_late_table",
    f"""WITH {LATE_SQL}, told AS (SELECT *, CAST(request_id AS BIGINT) % 2 = 1 AND (epoch_us(request_ts) // 3600000000 + 1) * 3600000000 <= w AS is_late FROM rides, mark)
    SELECT pickup_zone, is_late, count(*) AS rows, CAST(sum(number_of_passengers) AS BIGINT) AS passengers FROM told GROUP BY ALL""",
)
def _(spark, d):
    """Late rows are kept as rows: counted and late ones together are all."""
    path, mark, newer = new_path(spark, "split"), new_path(spark, "mark"), F.col("event_id") % 2 == 0
    schema = _rides(spark, d, newer).schema

    def consume(feed):
        jobs.split_late(jobs.table_stream(spark, feed, schema), path, mark, size="1 hour").awaitTermination()

    _fed(spark, [_rides(spark, d, newer), _rides(spark, d, ~newer)], consume)
    both = jobs.on_time(spark, path, schema).withColumn("is_late", F.lit(False)).unionByName(jobs.late(spark, path, schema).withColumn("is_late", F.lit(True)))
    return both.groupBy("pickup_zone", "is_late").agg(F.count(F.lit(1)).alias("rows"), F.sum("number_of_passengers").alias("passengers"))


def _running(spark, rows: DataFrame, total, table: KeyedTable) -> DataFrame:
    """A table's rows fed in three batches to an update-mode aggregate; the keyed table at the end."""
    rows, mark = materialize(rows, "changes"), new_path(spark, "mark")
    parts = [rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == k) for k in range(3)]

    def consume(feed):
        jobs.running_table(total(jobs.table_stream(spark, feed, rows.schema)), table, mark).awaitTermination()

    _fed(spark, parts, consume)
    return table.read(spark)


@query(
    "a7_running_counters",
    f"""WITH {EVENT_TRAFFIC} SELECT 'requests' AS stage, CAST(sum(request_count) AS BIGINT) AS value FROM traffic UNION ALL SELECT 'window', count(*) FROM traffic
    UNION ALL SELECT 'detect', count(*) FILTER (request_count % 3 > 0) FROM traffic UNION ALL SELECT 'context', count(*) FILTER (request_count % 3 = 1) FROM traffic
    UNION ALL SELECT 'agent', count(*) FILTER (request_count % 2 = 1) FROM traffic UNION ALL SELECT 'dispatch', count(*) FILTER (request_count % 2 = 1) FROM traffic""",
)
def _(spark, d):
    """Counters of a feed that arrives in batches; each sends the stages that changed."""
    traffic = i.traffic(spark, d)
    n = F.col("request_count")

    def part(df, name):
        return df.select(F.lit(name).alias("collection"), "request_count", (n % 3 == 1).alias("has_evidence"), "pickup_zone", "window_time")

    feed = part(traffic, "zone_traffic").unionByName(part(traffic.where(n % 3 > 0), "zone_anomalies")).unionByName(part(traffic.where(n % 2 == 1), "dispatch_log"))
    table = KeyedTable(new_path(spark, "counters"), ["stage"], "part", F.lit("all"))
    return _running(spark, feed, stage_counters, table).select("stage", "value")


@query(
    "a8_running_latest",
    f"""WITH {EVENT_TRAFFIC} SELECT pickup_zone AS zone, max(window_start) AS window_start, arg_max(request_count, window_start) AS request_count FROM traffic GROUP BY 1""",
)
def _(spark, d):
    """The newest window of every zone while windows arrive in any order."""
    table = KeyedTable(new_path(spark, "latest"), ["zone"], "part", F.lit("all"))
    return _running(spark, i.sunk_traffic(spark, d).select("zone", "window_start", "request_count"), latest_per_zone, table).drop("part", "batch")


def _captured(spark, d) -> DataFrame:
    return t.table(spark, d, "events").select(
        (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("event_type").alias("key"),
        F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("ts"),
    )


_FROM_SQL = """half AS (SELECT max(event_id) // 2 AS h FROM events), first AS (SELECT user_id % 3 AS part,
    coalesce(min(event_id) FILTER (ts >= TIMESTAMP '2024-01-08 00:00:00'), any_value(h) + 1) AS low FROM events, half WHERE event_id <= h GROUP BY 1)"""


@query(
    "st5_start_positions",
    f"""WITH {_FROM_SQL} SELECT 'earliest' AS start, CAST(user_id % 3 AS INTEGER) AS partition, event_id AS "offset", event_type AS key FROM events
    UNION ALL SELECT 'latest', user_id % 3, event_id, event_type FROM events, half WHERE event_id > h
    UNION ALL SELECT 'instant', user_id % 3, event_id, event_type FROM events JOIN first ON user_id % 3 = part WHERE event_id >= low""",
)
def _(spark, d):
    """Three consumers of one capture start before it grows and are restarted after."""
    path = new_path(spark, "capture")
    rows = materialize(_captured(spark, d), "messages")
    half = rows.agg(F.floor(F.max("offset") / 2).alias("h")).first()["h"]
    starts = {"earliest": "earliest", "latest": "latest", "instant": "2024-01-08T00:00:00"}
    out = {name: (new_path(spark, name), new_path(spark, "mark")) for name in starts}
    for part in (F.col("offset") <= half, F.col("offset") > half):
        write_captured(rows.where(part), path)
        for name, start in starts.items():
            jobs.append(captured_stream(spark, path, start), *out[name]).awaitTermination()
    parts = [spark.read.schema(rows.schema).parquet(p).select(F.lit(name).alias("start"), "partition", "offset", "key") for name, (p, _) in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "st4_fan_out",
    f"""WITH {RIDES} SELECT 'sink' AS consumer, count(*) AS rows FROM rides UNION ALL SELECT 'explain', count(DISTINCT pickup_zone) FROM rides
    UNION ALL SELECT 'act', 0""",
)
def _(spark, d):
    """Three consumers of one table; the one that fails leaves the others alone."""
    path = new_path(spark, "fan-in")
    t.rides_from_events(spark, d).write.parquet(path)
    schema = t.rides_from_events(spark, d).schema
    outs = {c: new_path(spark, f"fan-{c}") for c in ("sink", "explain", "act")}

    def act(batch, batch_id):
        raise RuntimeError("no boats")

    queries = jobs.fan_out(
        lambda: jobs.table_stream(spark, path, schema),
        {
            "sink": lambda b, n: b.write.mode("overwrite").parquet(f"{outs['sink']}/batch={n}"),
            "explain": lambda b, n: b.select("pickup_zone").distinct().write.mode("overwrite").parquet(f"{outs['explain']}/batch={n}"),
            "act": act,
        },
        new_path(spark, "mark"),
    )
    counts = []
    for name, q in queries.items():
        try:
            q.awaitTermination()
            counts.append((name, spark.read.parquet(outs[name]).count()))
        except Exception:  # noqa: BLE001 - the failure is that query's own
            counts.append((name, 0))
    return spark.createDataFrame(counts, "consumer string, rows long")


@query("st5_start_position", f"WITH {RIDES} SELECT request_id FROM rides WHERE request_ts >= TIMESTAMP '2024-01-15'")
def _(spark, d):
    path, out = new_path(spark, "st5-in"), new_path(spark, "st5")
    rides = t.rides_from_events(spark, d)
    rides.write.parquet(path)
    stream = jobs.from_now(jobs.table_stream(spark, path, rides.schema), "request_ts", F.lit("2024-01-15").cast("timestamp"))
    jobs.append(stream.select("request_id"), out, new_path(spark, "mark")).awaitTermination()
    return spark.read.parquet(out)


@query(
    "st9_stall_report",
    """SELECT * FROM (SELECT 'streams' AS component_group, 'late' AS name, 'warn' AS status UNION ALL SELECT 'streams', 'rides', 'ok'
    UNION ALL SELECT 'streams', 'surges', 'fail') WHERE (SELECT count(*) FROM events) > 0""",
)
def _(spark, d):
    """A stream over the events that ran, one that only started, and one that failed."""
    path, folder = new_path(spark, "progress"), new_path(spark, "st9-in")
    rides = t.rides_from_events(spark, d)
    rides.write.parquet(folder)
    log = jobs.ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        named = jobs.table_stream(spark, folder, rides.schema).writeStream.queryName("rides").option("checkpointLocation", new_path(spark, "mark"))
        q = named.trigger(availableNow=True).format("parquet").start(new_path(spark, "st9"))
        q.awaitTermination()
        log.wait_for(q)
    finally:
        spark.streams.removeListener(log)
    progress = jobs.progress_rows(spark, path)
    started = spark.createDataFrame([("streams", "late", None, 0, 0, 0), ("streams", "surges", 4, 10, 0, 0)], progress.schema)
    return jobs.stall_report(progress.unionByName(started), failed=["surges"])


@query("k9_offer_once", f"WITH {EVENT_TRAFFIC} SELECT DISTINCT pickup_zone, window_time FROM traffic")
def _(spark, d):
    """Each window is announced three times; it is offered once."""
    path, out = new_path(spark, "k9-in"), new_path(spark, "k9")
    once = i.traffic(spark, d).select("pickup_zone", "window_time", F.col("window_end").alias("ingested_at"))
    again = once.withColumn("after", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    again = again.withColumn("ingested_at", F.col("ingested_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("after"))).drop("after")
    rows = materialize(again, "announcements")
    rows.write.parquet(path)
    stream = jobs.offer_once(jobs.table_stream(spark, path, rows.schema)).select("pickup_zone", "window_time")
    jobs.append(stream, out, new_path(spark, "mark")).awaitTermination()
    return spark.read.parquet(out)


@query(
    "j5_stream_enrichment",
    f"""WITH {EVENT_TRAFFIC}, e AS (SELECT pickup_zone, window_time FROM traffic WHERE request_count > 3),
    done AS (SELECT max(window_time) - INTERVAL 2 HOUR AS w FROM traffic)
    SELECT pickup_zone, window_time, request_count, CASE WHEN e.window_time IS NOT NULL THEN 'because of ' || t.pickup_zone END AS cause
    FROM traffic t LEFT JOIN e USING (pickup_zone, window_time) WHERE t.window_time < (SELECT w FROM done) - INTERVAL 1 HOUR""",
)
def _(spark, d):
    """Anomalies and their enrichment as two streams; what left the state by the last watermark is compared."""
    left, right, out = new_path(spark, "j5-a"), new_path(spark, "j5-e"), new_path(spark, "j5")
    traffic = materialize(i.traffic(spark, d).select("pickup_zone", "window_time", "request_count", F.col("window_time").alias("ingested_at")), "j5-traffic")
    found = traffic.where("request_count > 3").select(
        "pickup_zone", "window_time", F.concat(F.lit("because of "), "pickup_zone").alias("cause"), (F.col("window_time") + F.expr("INTERVAL 1 MINUTE")).alias("enriched_at")
    )
    traffic.write.parquet(left)
    found.unionByName(
        traffic.agg(F.max("window_time").alias("window_time")).select(F.lit("none").alias("pickup_zone"), "window_time", F.lit("").alias("cause"), F.col("window_time").alias("enriched_at"))
    ).write.parquet(right)
    joined = jobs.enriched_stream(
        jobs.table_stream(spark, left, traffic.schema), jobs.table_stream(spark, right, spark.read.parquet(right).schema), "ingested_at", "enriched_at"
    )
    jobs.append(joined.select("pickup_zone", "window_time", "request_count", "cause"), out, new_path(spark, "mark")).awaitTermination()
    last = traffic.agg(F.max("window_time").alias("__last"))
    done = F.col("__last") - F.expr("INTERVAL 3 HOURS")
    return spark.read.parquet(out).join(F.broadcast(last)).where(F.col("window_time") < done).drop("__last")  # one row


def _raw_batches(spark, d):
    """The raw messages in three batches, newest first, so that later batches hold older rows."""
    raw = i.raw_messages(spark, d).select("zone", F.col("window_start").try_cast("timestamp").alias("window_start"), "event_id")
    raw = materialize(raw, "raw")
    return [raw.where(F.pmod(F.col("event_id"), F.lit(3)) == k) for k in (2, 0, 1)]


def _sunk(spark, d, table):
    mark = new_path(spark, "mark")

    def consume(path):
        stream = jobs.table_stream(spark, path, _SUNK)
        jobs.keyed_sink(stream, table, mark, order="event_id").awaitTermination()

    _fed(spark, _raw_batches(spark, d), consume)
    return table


_SUNK = "zone string, window_start timestamp, event_id long"


@query(
    "st6_out_of_order_batches",
    f"""WITH {RAW_SQL}, ok AS (SELECT zone, try_cast(window_start AS TIMESTAMP) AS window_start, event_id FROM raw
      WHERE zone IS NOT NULL AND try_cast(window_start AS TIMESTAMP) IS NOT NULL)
    SELECT zone, window_start, max(event_id) AS event_id FROM ok GROUP BY ALL""",
)
def _(spark, d):
    table = KeyedTable(new_path(spark, "keyed"), ["zone", "window_start"], "day", F.to_date("window_start"))
    return _sunk(spark, d, table).read(spark).select("zone", "window_start", "event_id")


@query(
    "st6_rejected_rows",
    f"""WITH {RAW_SQL} SELECT event_id, zone, try_cast(window_start AS TIMESTAMP) AS window_start FROM raw
    WHERE zone IS NULL OR try_cast(window_start AS TIMESTAMP) IS NULL""",
)
def _(spark, d):
    table = KeyedTable(new_path(spark, "keyed"), ["zone", "window_start"], "day", F.to_date("window_start"))
    return spark.read.parquet(_sunk(spark, d, table).rejected).select("event_id", "zone", "window_start")


# -- versions of a keyed table ------------------------------------------------------------


@query(
    "g1_change_capture",
    """WITH numbered AS (SELECT user_id, event_id, value, event_id % 3 AS part,
      row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id DESC) AS nth FROM events),
    one AS (SELECT user_id, event_id, value, 'new' AS state FROM numbered WHERE part = 0 AND nth = 1),
    b2 AS (SELECT n.user_id, n.event_id, n.value, 'again' AS state FROM numbered n LEFT JOIN one USING (user_id)
      WHERE part = 1 AND nth = 1 AND (one.event_id IS NULL OR n.event_id >= one.event_id)),
    two AS (SELECT * FROM b2 UNION ALL SELECT * FROM one WHERE user_id NOT IN (SELECT user_id FROM b2)),
    b3 AS (SELECT n.user_id, n.event_id, n.value FROM numbered n LEFT JOIN two USING (user_id)
      WHERE part = 2 AND nth = 1 AND (two.event_id IS NULL OR n.event_id >= two.event_id)),
    three AS (SELECT user_id, b3.event_id, b3.value, two.state FROM b3 LEFT JOIN two USING (user_id)
      UNION ALL SELECT * FROM two WHERE user_id NOT IN (SELECT user_id FROM b3))
    SELECT 1 AS version, 'insert' AS operationType, * FROM one
    UNION ALL SELECT 2, CASE WHEN user_id IN (SELECT user_id FROM one) THEN 'replace' ELSE 'insert' END, * FROM b2
    UNION ALL SELECT 3, CASE WHEN user_id IN (SELECT user_id FROM two) THEN 'update' ELSE 'insert' END, * FROM three
      WHERE user_id IN (SELECT user_id FROM b3)
    UNION ALL SELECT 4, 'delete', * FROM three WHERE user_id % 10 = 0""",
)
def _(spark, d):
    """What four batches changed: rows put in, replaced, merged into and removed."""
    table = KeyedTable(new_path(spark, "captured"), ["user_id"], "bucket", F.pmod("user_id", F.lit(8)))
    events = t.table(spark, d, "events").select("user_id", "event_id", "value")
    part = lambda n: events.where(F.col("event_id") % 3 == n)
    table.apply(part(0).withColumn("state", F.lit("new")), order="event_id")
    table.apply(part(1).withColumn("state", F.lit("again")), order="event_id")
    table.apply(part(2), upsert_merge, order="event_id")
    table.apply(events.where("user_id % 10 = 0").select("user_id"), remove_keys)
    return table.changes(spark).select(F.col("version").cast("int").alias("version"), "operationType", "user_id", "event_id", "value", "state")


@query(
    "k6_drop_by_manifest",
    f"""WITH {EVENT_TRAFFIC}, {i.RAW_LOG_SQL} SELECT pickup_zone, window_time, dispatched_at FROM log
    WHERE dispatched_at IS NULL OR dispatched_at >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY""",
)
def _(spark, d):
    """Retention of a stored table: old partitions go unread, partly old ones are written anew."""
    table = KeyedTable(new_path(spark, "log"), ["pickup_zone", "window_time"], "day", F.to_date("window_time"), time="dispatched_at")
    table.apply(i.dispatch_log(spark, d).select("pickup_zone", "window_time", "dispatched_at"))
    table.drop_before(spark, F.lit("2024-01-25").cast("timestamp"), RETENTION_DAYS["zone_traffic"])
    return table.read(spark).select("pickup_zone", "window_time", "dispatched_at")
