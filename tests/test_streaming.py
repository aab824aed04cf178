"""Streams give what the batch run gives; restarts and late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import aggregates as agg
from tidewatch.operators.anomaly import detect
from tidewatch.operators.feed import change_feed
from tidewatch.operators.keyed import KeyedTable, upsert_merge
from tidewatch.operators.models import embed
from tidewatch.operators.validate import required
from tidewatch.sources.rides import read_rides
from tidewatch.sources.schemas import RIDES, TRAFFIC
from tidewatch.streaming import jobs, stateful

T0 = dt.datetime(2026, 5, 29, 8, 0)
TRAFFIC_COLUMNS = ["window_start", "window_end", "window_time", "pickup_zone", "request_count", "total_passengers", "total_revenue"]


def ride(i, second, zone="a"):
    return (f"R{i}", "x@y.z", zone, "b", 2.5, 1 + i % 3, T0 + dt.timedelta(seconds=second))


def land(spark, path, *batches):
    """One file per batch, read in order."""
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, RIDES).coalesce(1).write.mode("append").parquet(f"{path}/b{n}")


def stream(spark, path, **options):
    return read_rides(spark, f"{path}/*", stream=True, maxFilesPerTrigger=1, **options)


def done(query):
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_closed_windows_equal_batch(spark, tmp_path):
    rng = random.Random(4)
    base = [ride(i, i * 2 + rng.randint(-2, 2), "ab"[i % 2]) for i in range(200)]
    land(spark, tmp_path / "in", base[:70], base[70:140], base[140:], [ride(999, 3600)])
    done(jobs.append(jobs.traffic(stream(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.schema(TRAFFIC).parquet(str(tmp_path / "out"))
    want = agg.zone_traffic(read_rides(spark, f"{tmp_path}/in/*")).where(F.col("window_start") < F.lit(T0 + dt.timedelta(hours=1)))
    assert rows_of(got.select(*TRAFFIC_COLUMNS)) == rows_of(want.select(*TRAFFIC_COLUMNS))
    # the window of the last event stays open; a batch run gives it on request
    flushed = jobs.flush_until(read_rides(spark, f"{tmp_path}/in/*"), F.lit(T0 + dt.timedelta(hours=2)))
    assert flushed.count() == want.count() + 1


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    land(spark, tmp_path / "in", [ride(0, 0)], [ride(1, 300)], [ride(2, 310)], [ride(3, 1)], [ride(4, 306)], [ride(5, 900)], [ride(6, 901)])
    log = jobs.ProgressLog(spark, str(tmp_path / "progress"))
    spark.streams.addListener(log)
    try:
        q = done(jobs.append(jobs.traffic(stream(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")))
        log.wait_for(q)
    finally:
        spark.streams.removeListener(log)
    progress = jobs.progress_rows(spark, str(tmp_path / "progress"))
    assert progress.agg(F.sum("late_rows")).first()[0] == 1
    got = {r.window_start: r.request_count for r in spark.read.schema(TRAFFIC).parquet(str(tmp_path / "out")).collect()}
    assert got == {T0: 1, T0 + dt.timedelta(minutes=5): 3}  # the row 4 s late still counts
    assert [tuple(r) for r in jobs.stream_health(progress).collect()] == [("streams", "healthy", 0)]


def test_started_without_progress_warns(spark):
    df = spark.createDataFrame([("s", "q1", None, 0, 0, 0), ("s", "q2", 3, 5, 0, 0)], jobs._PROGRESS)
    assert dict((r.name, r.status) for r in jobs.stall_report(df).collect()) == {"q1": "warn", "q2": "ok"}
    assert jobs.stream_health(df, failed=["q2"]).first().overall == "unhealthy"


@pytest.mark.parametrize("max_train, more", [(7000, 0), (12, 0), (12, 1_000_000_000)])
def test_stateful_detector_equals_batch(spark, tmp_path, max_train, more):
    rng = random.Random(9)
    rides = [ride(m * 100 + j, m * 60 + j, z) for z in "ab" for m in range(40) for j in range(rng.randint(1, 6))]
    traffic = agg.zone_traffic(spark.createDataFrame(rides, RIDES)).select(*TRAFFIC_COLUMNS)
    traffic = traffic.withColumn("request_count", F.col("request_count") + more)
    for n, (lo, hi) in enumerate([(0, 7), (7, 25), (25, 40)]):
        part = traffic.where(F.minute("window_start").between(lo, hi - 1))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/t/b{n}")
    source = jobs.table_stream(spark, f"{tmp_path}/t/*", TRAFFIC, files_per_trigger=1)
    scored = stateful.detect_stream(source, confidence=99.0, min_train=5, max_train=max_train)
    done(jobs.append(scored, str(tmp_path / "out"), str(tmp_path / "cp")))
    cols = ["pickup_zone", "window_time", "is_anomaly", F.round("forecast", 6).alias("f"), F.round("upper_bound", 6).alias("u")]
    want = detect(traffic, confidence=99.0, min_train=5, max_train=max_train)
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).select(*cols)) == rows_of(want.select(*cols))


def test_detector_writes_what_a_batch_changes(spark, monkeypatch):
    """The state of a long history: few entries a batch are written, old ones go, sums stay exact."""
    import numpy as np
    import pandas as pd

    class Value:
        held = None

        def get(self):
            return self.held

        def update(self, x):
            self.held = x

    class Entries(dict):
        writes = 0

        def containsKey(self, k):
            return k in self

        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            self.writes += 1
            self[k] = v

        def removeKey(self, k):
            del self[k]

    for whole in (True, False):
        d = stateful.Detector("v", "at", whole, 5, 1000, 2.5, 0.0)
        d.sums, d.buckets = Value(), Entries()
        rng, values, got = np.random.default_rng(3), [], []
        for size in [1, 2500, *[3] * 200]:
            new = rng.integers(0, 50, size) + 10_000_000 if whole else rng.normal(5, 2, size)
            frame = pd.DataFrame({"v": new, "at": range(len(values), len(values) + size)})
            values += new.tolist()
            d.buckets.writes = 0
            got.append(pd.concat(d.handleInputRows(("a",), iter([frame]), None)))
            assert d.buckets.writes <= size // stateful.BUCKET + 2 and len(d.buckets) <= 1000 // stateful.BUCKET + 2
        forecast, x = pd.concat(got)["forecast"].to_numpy(), np.array(values, float)
        plain = [x[max(0, i - 1000) : i].mean() if i >= 5 else np.nan for i in range(len(x))]
        assert np.allclose(forecast, plain, rtol=1e-12, equal_nan=True)


def test_overdue_anomalies_come_once_as_time_passes(spark, tmp_path):
    """Cancelled in time, before the anomaly, too late, never, by an empty text, twice, and not yet due."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    asked = [("in time", 0), ("before", 30), ("too late", 40), ("never", 50), ("empty", 60), ("twice", 70), ("restart", 150), ("open", 990)]
    told = [("before", 10, "doc"), ("in time", 39, "doc"), ("empty", 61, ""), ("too late", 90, "doc"), ("twice", 71, "doc"), ("twice", 200, "doc"), ("end", 1000, "doc")]
    schema = "pickup_zone string, window_time timestamp, n long, ingested_at timestamp"
    evidence = "pickup_zone string, window_time timestamp, top_chunk_1 string, enriched_at timestamp"

    def more(lo, hi):
        for name, kind, rows in (
            ("a", schema, [(z, T0, 7, at(s)) for z, s in asked if lo <= s < hi]),
            ("e", evidence, [(z, T0, c, at(s)) for z, s, c in told if lo <= s < hi]),
        ):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/b{lo}")

    def run():
        streams = (jobs.table_stream(spark, f"{tmp_path}/{n}/*", spark.createDataFrame([], k).schema, 1) for n, k in (("a", schema), ("e", evidence)))
        done(jobs.append(stateful.overdue(*streams), str(tmp_path / "out"), str(tmp_path / "cp")))
        return {(r.pickup_zone, r.n) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()}

    for lo, hi in ((0, 45), (45, 95)):
        more(lo, hi)
    run()
    for lo, hi in ((95, 180), (180, 980), (980, 2000)):
        more(lo, hi)
    want = {("too late", 7), ("never", 7), ("empty", 7), ("restart", 7)}
    assert run() == want and spark.read.schema(schema).parquet(str(tmp_path / "out")).count() == len(want)


def test_keyed_sink_with_dead_letters_is_replayable(spark, tmp_path):
    schema = "zone string, t timestamp, n long"
    data = [[("a", T0, 1), (None, T0, 5), ("b", T0, 2)], [("a", T0, 7), ("c", T0 + dt.timedelta(days=1), 3)]]
    for n, batch in enumerate(data):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    table = KeyedTable(str(tmp_path / "table"), ["zone", "t"], "day", F.to_date("t"))

    def run(checkpoint):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        done(jobs.keyed_sink(source, table, str(tmp_path / checkpoint), [required("zone")], str(tmp_path / "dlq")))
        return rows_of(table.read(spark).select("zone", "t", "n"))

    first = run("cp1")
    assert first == [("a", T0, 7), ("b", T0, 2), ("c", T0 + dt.timedelta(days=1), 3)]
    assert run("cp2") == first  # the whole history again
    assert run("cp2") == first  # a restart with nothing new
    assert spark.read.parquet(str(tmp_path / "dlq")).count() == 1


def test_enrichment_sink_merges(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "table"), ["pickup_zone", "window_time"], "day", F.to_date("window_time"))
    schema = "pickup_zone string, window_time timestamp, anomaly_reason string, ingested_at timestamp"
    table.apply(spark.createDataFrame([("a", T0, "plain", T0), ("b", T0, "plain", T0)], schema))
    late = spark.createDataFrame([("a", T0, "model")], "pickup_zone string, window_time timestamp, anomaly_reason string")
    table.apply(late, upsert_merge)
    got = rows_of(table.read(spark).select("pickup_zone", "anomaly_reason", "ingested_at"))
    assert got == [("a", "model", T0), ("b", "plain", T0)]


def test_consumers_fail_on_their_own(spark, tmp_path):
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "t"))
    seen = []

    def broken(batch, batch_id):
        raise RuntimeError("explain path is down")

    queries = jobs.fan_out(
        lambda: jobs.table_stream(spark, str(tmp_path / "t"), spark.range(1).schema),
        {"act": lambda b, _: seen.append(b.count()), "explain": broken},
        str(tmp_path / "cp"),
    )
    done(queries["act"])
    with pytest.raises(Exception, match="explain path is down"):
        queries["explain"].awaitTermination(60)
    assert seen == [4]


def test_new_consumer_starts_at_a_time(spark):
    df = spark.createDataFrame([(T0,), (T0 + dt.timedelta(hours=1),)], "t timestamp")
    assert jobs.from_now(df, "t", F.lit(T0 + dt.timedelta(minutes=1))).count() == 1 and jobs.from_now(df, "t", None).count() == 2


def test_offered_once_per_window(spark, tmp_path):
    schema = "pickup_zone string, window_time timestamp, ingested_at timestamp"
    batches = [[("a", T0, T0), ("a", T0, T0)], [("a", T0, T0 + dt.timedelta(seconds=60)), ("b", T0, T0)]]
    for n, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    done(jobs.append(jobs.offer_once(source), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).select("pickup_zone")) == [("a",), ("b",)]


def test_counters_and_feed_run_on_streams(spark, tmp_path):
    schema = "collection string, request_count long, has_evidence boolean"
    spark.createDataFrame([("zone_traffic", 5, False), ("zone_anomalies", 9, True), ("dispatch_log", 0, False)], schema).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = agg.stage_counters(source).writeStream.format("memory").queryName("stages").outputMode("complete").trigger(availableNow=True).start()
    done(q)
    assert dict(map(tuple, spark.table("stages").collect())) == {"requests": 5, "window": 1, "detect": 1, "context": 1, "agent": 1, "dispatch": 1}
    out = change_feed({"analytics.zone_traffic": source})
    done(out.writeStream.format("memory").queryName("feed").trigger(availableNow=True).start())
    assert spark.table("feed").count() == 3


def test_backfill_skips_what_got_evidence_meanwhile(spark):
    schema = "pickup_zone string, window_time timestamp, request_count long, expected_requests long, anomaly_reason string, ingested_at timestamp"
    old, young = T0 - dt.timedelta(seconds=60), T0 - dt.timedelta(seconds=10)
    a = spark.createDataFrame([("a", T0, 9, 3, "Surge. ", old), ("b", T0, 9, 3, "Surge", young), ("c", T0, 9, 3, "Surge", old)], schema)
    enriched = spark.createDataFrame([("c", T0, "doc")], "pickup_zone string, window_time timestamp, top_chunk_1 string")
    kb = embed(
        spark.createDataFrame([("d1", "jazz night", "Jazz", "concert", "low"), ("d2", "parade day", "Parade", "parade", "high")],
                              "document_id string, chunk string, event_name string, event_type string, impact_level string"), "chunk",
    )
    got = jobs.backfill_evidence(a, enriched, kb, F.lit(T0)).collect()
    assert [r.pickup_zone for r in got] == ["a"]
    assert got[0].anomaly_reason == "Surge. Likely cause: Parade (parade, high impact)."
    assert {got[0].top_chunk_1, got[0].top_chunk_2} == {"jazz night", "parade day"} and got[0].top_chunk_3 == ""


def messages(spark, lo, hi):
    """Offset n of partition n % 2 is n; a message a minute."""
    from tidewatch.sources.captured_stream import SCHEMA

    rows = [(n % 2, n, f"k{n}", f"v{n}", T0 + dt.timedelta(minutes=n)) for n in range(lo, hi)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("start", "first"), [("earliest", 0), ("latest", 40), ("2026-05-29T08:21:00", 21), ("2026-05-29T10:20:30+02:00", 21), ("2027-01-01T00:00:00", 40)])
def test_captured_messages_from_a_start_position(spark, tmp_path, start, first):
    from tidewatch.sources.captured_stream import captured_stream, write_captured

    path, got = str(tmp_path / "capture"), lambda: sorted(r.offset for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run = lambda s=start: done(jobs.append(captured_stream(spark, path, s), str(tmp_path / "out"), str(tmp_path / "cp")))
    write_captured(messages(spark, 0, 25), path)
    write_captured(messages(spark, 25, 40), path)
    run()
    assert got() == list(range(first, 40))
    write_captured(messages(spark, 40, 50), path)
    write_captured(messages(spark, 50, 53).withColumn("partition", F.lit(7)), path)  # a partition that is new
    run("latest")  # a checkpoint goes on where it ended, whatever the start says
    assert got() == list(range(first, 53))
    rows = {r.offset: (r.partition, r.key, r.ts) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows[45] == (1, "k45", T0 + dt.timedelta(minutes=45)) and rows[51][0] == 7


def test_late_rows_are_kept_beside(spark, tmp_path):
    land(spark, tmp_path / "in", [ride(0, 0)], [ride(1, 300)], [ride(2, 310)], [ride(3, 1)], [ride(4, 306)], [ride(5, 900), ride(6, 2)], [ride(7, 250)])
    source = jobs.table_stream(spark, f"{tmp_path}/in/*", RIDES, files_per_trigger=1)
    done(jobs.split_late(source, str(tmp_path / "out"), str(tmp_path / "cp")))
    ids = lambda df: sorted(r.request_id for r in df.collect())
    kept, late = jobs.on_time(spark, str(tmp_path / "out"), RIDES), jobs.late(spark, str(tmp_path / "out"), RIDES)
    assert ids(late) == ["R3", "R6", "R7"] and ids(kept) == ["R0", "R1", "R2", "R4", "R5"]
    assert {r.request_id: r.batch for r in late.collect()} == {"R3": 3, "R6": 5, "R7": 6}
    assert jobs.late(spark, str(tmp_path / "none"), RIDES).count() == 0


def test_running_totals_merge_batches_and_runs(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "table"), ["zone"], "part", F.lit("all"))
    schema = "zone string, n long"

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        source = jobs.table_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
        done(jobs.running_table(source.groupBy("zone").agg(F.sum("n").alias("n")), table, str(tmp_path / "cp")))
        return {r.zone: r.n for r in table.read(spark).collect()}

    feed(("a", 1), ("b", 2))
    feed(("a", 10))
    assert run() == {"a": 11, "b": 2}
    feed(("b", 5), ("c", 7))
    assert run() == {"a": 11, "b": 7, "c": 7}
