"""Rows, validation, keyed tables, joins, reports and sources on small fixtures."""

import datetime as dt
import decimal
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.exprs import canonical_zone
from tidewatch.operators import aggregates as agg
from tidewatch.operators import feed, joins, keyed, rows as r, topk, validate
from tidewatch.plans.bootstrap import warm_start
from tidewatch.sources import rides, seeds, sinks

T0 = dt.datetime(2026, 5, 29, 8, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


# -- rows ----------------------------------------------------------------------


def test_heat_map_sums_per_zone(spark, rows):
    df = spark.createDataFrame([("CBD", 10, 1, 5.0), ("CBD", 15, 2, 6.0), ("Uptown", 5, 1, None)], "zone string, request_count long, total_passengers long, total_revenue double")
    assert rows(agg.heat_map(df)) == [("CBD", 25, 3, 11.0), ("Uptown", 5, 1, 0.0)]


def test_anomaly_card(spark):
    df = spark.createDataFrame(
        [("CBD", at(0), 50, 30, "why", "a", "b", "c"), (None, at(1), None, 0, None, "", None, "c")],
        "pickup_zone string, window_time timestamp, request_count long, expected_requests long, anomaly_reason string, top_chunk_1 string, top_chunk_2 string, top_chunk_3 string",
    )
    a, b = r.anomaly_cards(df).collect()
    assert (a.surplus, a.rag_chunks, round(a.multiple, 3)) == (20.0, ["a", "b", "c"], 1.667)
    assert (b.zone, b.actual_count, b.multiple, b.anomaly_reason, b.rag_chunks) == ("Unknown", 0.0, None, "", ["c"])


def test_card_takes_renamed_fields(spark):
    df = spark.createDataFrame([("A", at(0), 9, 3, "x")], "pickup_zone string, detected_at timestamp, actual_count long, expected_count long, anomaly_reason string")
    card = r.anomaly_cards(df).first()
    assert (card.surplus, card.window_time, card.rag_chunks) == (6.0, at(0), [])


def test_dispatch_entry_time_falls_back(spark):
    df = spark.createDataFrame(
        [("A", None, at(0), "Dispatched 6 boats.", "{}"), ("A", at(5), at(0), "<tool_call>x</tool_call>\nDispatch Summary: Sent 6 boats.\n\nDispatch JSON:\n{}", "bad")],
        "pickup_zone string, dispatched_at timestamp, window_time timestamp, dispatch_summary string, dispatch_json string",
    )
    a, b = r.dispatch_entries(df).collect()
    assert (a.dispatched_at, a.summary, a.parsed) == (at(0), "Dispatched 6 boats.", True)
    assert (b.dispatched_at, b.summary, b.parsed) == (at(5), "Sent 6 boats.", False)


def test_knowledge_card_defaults(spark):
    df = spark.createDataFrame([("E", None, "x" * 300)], "event_name string, impact_level string, description string")
    card = r.knowledge_cards(df).first()
    assert (card.impact_level, card.expected_attendance, card.zone, len(card.description)) == ("low", 0, "Unknown", 180)


def test_zone_and_time_filters(spark):
    df = spark.createDataFrame([("a", at(0)), ("b", at(10))], "zone string, window_start timestamp")
    assert r.in_zones(df, []).count() == 2 and r.in_zones(df, ["a"]).count() == 1
    assert r.since(df, None, "window_start").count() == 2
    assert r.since(df, at(10), "window_start").count() == 1
    ms = df.select("zone", F.unix_millis("window_start").alias("t"))
    assert r.since(ms, at(10), "t", epoch_millis=True).count() == 1


def test_json_safe_documents(spark):
    df = spark.createDataFrame(
        [(decimal.Decimal("1.50"), at(0), [(b"\x01", at(1))], {"k": decimal.Decimal("2.00")}, None)],
        "d decimal(10,2), t timestamp, l array<struct<id: binary, at: timestamp>>, m map<string, decimal(5,2)>, n string",
    )
    doc = json.loads(r.json_documents(df).first().doc)
    assert doc == {
        "d": 1.5,
        "t": "2026-05-29T08:00:00.000000+00:00",
        "l": [{"id": "01", "at": "2026-05-29T08:01:00.000000+00:00"}],
        "m": {"k": 2.0},
        "n": None,
    }


def test_multiple_label(spark):
    df = spark.createDataFrame([(12.6,), (3.44,)], "m double")
    assert [x.l for x in df.select(r.multiple_label(F.col("m")).alias("l")).collect()] == ["×13", "×3.4"]


def test_alias(spark):
    assert spark.range(1).select(canonical_zone(F.lit("CBD")).alias("z")).first().z == "Central Business District (CBD)"


# -- validation ---------------------------------------------------------------------


def test_every_row_is_valid_or_dead(spark):
    df = spark.createDataFrame([("a", "1700000000000"), ("a", "soon"), (None, None), ("b", "2024-01-01 00:00:00")], "zone string, window_start string")
    valid, dead = validate.split(df.withColumn("window_end", F.lit(None).cast("string")), validate.zone_traffic_rules(), F.lit(at(0)))
    assert valid.count() == 2
    got = {d.reason: d for d in dead.collect()}
    assert set(got) == {"type:window_start", "missing:zone,missing:window_start"}
    assert json.loads(got["type:window_start"].document)["window_start"] == "soon" and got["type:window_start"]._ts == at(0)


def test_status_rollup(spark, rows):
    df = spark.createDataFrame([("a", "ok"), ("a", "fail"), ("b", "warn"), ("b", "ok"), ("c", "warn"), ("d", "unknown")], "component_group string, status string")
    assert rows(agg.status_rollup(df)) == [("a", "unhealthy", 0), ("b", "healthy", 1), ("c", "unknown", 1), ("d", "unknown", 0)]


def test_zones_fall_back_when_empty(spark):
    df = spark.createDataFrame([], "zone string")
    assert [x.zone for x in agg.zones(df).collect()] == agg.FALLBACK_ZONES
    assert [x.zone for x in agg.zones(spark.createDataFrame([("b",), ("a",), ("b",)], "zone string")).collect()] == ["a", "b"]


def test_chart_domain_is_a_minute_wide(spark):
    df = spark.createDataFrame([(at(0), 0)], "window_start timestamp, request_count long")
    assert tuple(agg.chart_domain(df).first()) == (at(0), at(1), 1)


# -- keyed -----------------------------------------------------------------------------


def test_replace_drops_missing_fields_and_merge_keeps_them(spark, rows):
    target = spark.createDataFrame([(1, "a", "keep"), (2, "b", "old")], "id int, v string, extra string")
    batch = spark.createDataFrame([(2, None), (3, "c")], "id int, v string")
    assert rows(keyed.upsert_replace(target, batch, ["id"])) == [(1, "a", "keep"), (2, None, None), (3, "c", None)]
    assert rows(keyed.upsert_merge(target, batch, ["id"])) == [(1, "a", "keep"), (2, None, "old"), (3, "c", None)]


def test_touch_keeps_created(spark, rows):
    target = spark.createDataFrame([(1, "a", at(0), at(0))], "id int, v string, created_at timestamp, updated_at timestamp")
    batch = spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string")
    got = rows(keyed.upsert_touch(target, batch, ["id"], F.lit(at(9))))
    assert got == [(1, "b", at(0), at(9)), (2, "c", at(9), at(9))]


def test_changed_rows_tells_shifted_text_apart(spark):
    known = spark.createDataFrame([(1, "ab", "c"), (2, "x", None)], "id int, p string, q string")
    batch = spark.createDataFrame([(1, "a", "bc"), (2, "x", None), (3, "n", "n")], "id int, p string, q string")
    assert sorted(x.id for x in keyed.changed_rows(batch, known, ["id"], ["p", "q"]).collect()) == [1, 3]


def test_retention_keeps_rows_without_time(spark):
    df = spark.createDataFrame([(None,), (at(0),), (at(-60 * 24 * 8),)], "t timestamp")
    assert keyed.retain(df, "t", F.lit(at(1)), 7).count() == 2


def test_numeric_time_purge(spark):
    df = spark.createDataFrame([("1700000000000",), ("2024-01-01",), (None,)], "t string")
    assert keyed.purge_numeric_time(df, "t").count() == 2


def test_keyed_table_replay_gives_the_same_rows(spark, rows, tmp_path):
    table = keyed.KeyedTable(str(tmp_path / "t"), ["zone", "t"], "day", F.to_date("t"))
    first = spark.createDataFrame([("a", at(0), 1), ("b", at(60 * 24), 2), (None, at(0), 9)], "zone string, t timestamp, n long")
    second = spark.createDataFrame([("a", at(0), 5), ("a", at(0), 7), ("c", at(60 * 48), 3)], "zone string, t timestamp, n long")
    table.apply(first)
    table.apply(second, order="n")
    once = rows(table.read(spark).select("zone", "t", "n"))
    table.apply(second, order="n")
    assert rows(table.read(spark).select("zone", "t", "n")) == once == [("a", at(0), 7), ("b", at(60 * 24), 2), ("c", at(60 * 48), 3)]


# -- joins and feed ----------------------------------------------------------------------


def test_match_prefers_the_window_then_the_newest_open(spark, rows):
    a = spark.createDataFrame([("z", at(0)), ("z", at(10)), ("z", at(20)), ("y", at(5))], "pickup_zone string, window_time timestamp")
    d = spark.createDataFrame(
        [("z", at(10), at(11)), ("z", at(12), at(25)), ("z", at(13), at(26)), ("y", at(1), at(4))],
        "pickup_zone string, window_time timestamp, dispatched_at timestamp",
    )
    got = rows(joins.match_dispatches(a, d, chunk_seconds=60))
    near = [("z", at(0), at(13), at(26), "as_of"), ("z", at(20), at(12), at(25), "as_of")]
    assert got == sorted([("z", at(10), at(10), at(11), "window"), *near], key=repr)


def test_overlap_across_midnight_and_buckets(spark, rows):
    s = spark.createDataFrame([("z", dt.datetime(2026, 5, 30, 2, 30))], "pickup_zone string, window_time timestamp")
    e = spark.createDataFrame(
        [
            ("late", "z", dt.datetime(2026, 5, 29, 19), dt.datetime(2026, 5, 29, 2)),
            ("long", "z", dt.datetime(2026, 5, 20), dt.datetime(2026, 6, 20)),
            ("early", "z", dt.datetime(2026, 5, 29, 10), dt.datetime(2026, 5, 29, 12)),
            ("other", "y", dt.datetime(2026, 5, 30, 2), dt.datetime(2026, 5, 30, 3)),
        ],
        "event_name string, zone string, event_time_start timestamp, event_time_end timestamp",
    )
    assert rows(joins.overlapping_events(s, e).select("event_name")) == [("late",), ("long",)]


def test_replayed_sink_does_not_erase_enrichment(spark):
    base = spark.createDataFrame([("z", at(0), "plain", None)], "pickup_zone string, window_time timestamp, anomaly_reason string, top_chunk_1 string")
    e = spark.createDataFrame([("z", at(0), "model", "doc")], base.schema)
    row = joins.current_anomalies(base, e, fields=["anomaly_reason", "top_chunk_1"]).first()
    assert (row.anomaly_reason, row.top_chunk_1) == ("model", "doc")


def test_feed_passes_watched_and_drops_deletes(spark, rows):
    df = spark.createDataFrame([(1, "insert"), (2, "delete")], "id int, operationType string")
    got = feed.change_feed({"fleet.dispatch_log": df, "other.table": df}, {"fleet.dispatch_log": F.lit(at(0))})
    assert rows(got) == [("fleet.dispatch_log", "insert", at(0), '{"id":1}')]


def test_recent_or_latest(spark):
    df = spark.createDataFrame([("z", at(i), at(i)) for i in range(10)] + [("n", at(0), None)], "pickup_zone string, window_time timestamp, dispatched_at timestamp")
    assert topk.recent_or_latest(df, F.lit(at(20))).count() == 5
    assert topk.recent_or_latest(df, F.lit(at(100)), spare=3).count() == 3
    assert topk.recent_or_latest(df, F.lit(at(9)), minutes=2).count() == 3
    assert topk.recent_or_latest(df.limit(0), F.lit(at(0))).count() == 0


def test_snapshot_survives_a_broken_section(spark):
    traffic = spark.createDataFrame([("z", at(0), 3)], "zone string, window_start timestamp, request_count long")
    kb = spark.createDataFrame([("d", [1.0])], "document_id string, embedding array<double>")
    vessels = spark.createDataFrame([("V1", "z"), ("", "z")], "vessel_id string, base_zone string")

    def broken():
        raise RuntimeError("no such table")

    got = warm_start(
        {"vessels": lambda: vessels, "anomalies": broken, "dispatches": broken, "knowledge": lambda: kb, "traffic": lambda: traffic},
        F.lit(at(0)),
        lambda df: [x.asDict() for x in df.collect()],
    )
    assert got["anomalies"] is None and got["dispatches"] is None and got["counts"] is None
    assert got["vessels"] == [{"vessel_id": "V1", "base_zone": "z"}]
    assert got["knowledge"] == [{"document_id": "d"}] and got["traffic"][0]["request_count"] == 3


# -- sources -------------------------------------------------------------------------------


def test_captured_messages_are_framed_decoded_and_audited(spark, tmp_path):
    import base64
    import json

    framed = lambda body, schema=100_123: base64.b64encode(b"\x00" + schema.to_bytes(4, "big") + body).decode()
    good = [(None, framed(json.dumps({"zone": f"é{n}", "n": n}).encode()), n % 3, n) for n in range(20)]
    bad = [(None, "AQID", 0, 101), (None, framed(b"{", 0), 0, 102), (None, "%%%", 0, 103), (None, None, 0, 104), (None, "", 0, 105), (None, framed(b"", 0), 0, 106)]
    spark.createDataFrame(good + bad, rides.CAPTURED).write.json(str(tmp_path / "c"))
    read = rides.read_captured(spark, str(tmp_path / "c"))

    def body(column):
        fields = F.from_json(column.cast("string"), "zone string, n int")
        return F.when(fields["zone"].isNotNull(), fields)

    got = rides.decode_wire(read, body)
    errors = {x.offset: x.error for x in got.where("error is not null").collect()}
    assert errors == {101: "not_wire_format", 102: "bad_record", 103: "not_wire_format", 104: "not_wire_format", 105: "not_wire_format", 106: "bad_record"}
    assert sorted((x.offset, x.partition, x.schema_id, x.zone, x.n) for x in got.where("error is null").collect()) == [(n, n % 3, 100_123, f"é{n}", n) for n in range(20)]
    audit = {x.schema_id: (x.messages, x.in_wire_format) for x in rides.schema_audit(read).collect()}
    assert audit == {100_123: (20, True), 0: (2, True), None: (4, False)}


def test_decode_query_gives_every_field_of_every_ride(spark, tmp_path):
    import __spark_entry__ as entry

    events = [(n, n, "click", n / 3, f'{{"k": {n}}}', at(n)) for n in range(12)] + [(12, None, None, None, None, None)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.request_id: tuple(r)[1:] for r in entry.queries()["s2_decode_wire"](spark, str(tmp_path)).collect()}
    assert got["10"] == ("user10@example.com", "click", "stop-3", 10 / 3, 5, at(10), 100_042)
    assert got["11"] == ("user11@example.com", "click", "stop-4", 11 / 3, 6, at(11), 100_042)
    assert got["12"] == (None, None, None, None, None, None, 100_042) and len(got) == 13


def test_rebase_ends_at_target(spark):
    df = spark.createDataFrame([(at(0),), (at(7),)], "request_ts timestamp")
    got = sorted(x.request_ts for x in rides.rebase(df, "2030-01-01 00:00:00").collect())
    assert got == [dt.datetime(2029, 12, 31, 23, 53), dt.datetime(2030, 1, 1)]


def test_retained_size_unknown_is_not_zero(spark, rows):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 3), ("b", 0, None), ("b", 0, 4)], "topic string, earliest long, latest long")
    assert rows(sinks.retained_size(df)) == [("a", 10), ("b", None)]


def test_load_once_refuses_a_full_or_unknown_target(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(3)
    sinks.load_once(spark, df, path)
    with pytest.raises(sinks.AlreadyLoaded):
        sinks.load_once(spark, df, path)
    sinks.load_once(spark, df, path, force=True)
    assert spark.read.parquet(path).count() == 6
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(sinks.AlreadyLoaded):
        sinks.load_once(spark, df, str(tmp_path / "odd"))


def test_write_accounting(spark, tmp_path):
    df = spark.range(5).withColumn("error", F.when(F.col("id") >= 3, F.lit("undelivered")))
    out, seen = sinks.accounted(df, F.col("error").isNotNull())
    out.write.parquet(str(tmp_path / "o"))
    assert seen.get == {"total": 5, "failed": 2, "success": 3}


def test_ingest_stamp_comes_from_the_file(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "f"))
    stamped = sinks.stamp(spark.read.parquet(str(tmp_path / "f")))
    assert rows_of(stamped) == rows_of(sinks.stamp(spark.read.parquet(str(tmp_path / "f"))))
    assert stamped.where("ingested_at is null").count() == 0


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_seed_calendar(spark, tmp_path):
    event = {
        "event_name": "Frenchmen Street Live", "zone": "Marigny", "description": "x", "venue": "v", "expected_attendance": 10,
        "event_type": "music", "impact_level": "high", "event_time_start_hour": 19, "event_time_start_min": 0,
        "event_time_end_hour": 2, "event_time_end_min": 30,
    }
    (tmp_path / "c.json").write_text(json.dumps([event]))
    row = seeds.read_calendar(spark, str(tmp_path / "c.json"), "2026-05-29").first()
    assert (row.event_time_start, row.event_time_end) == (dt.datetime(2026, 5, 29, 19), dt.datetime(2026, 5, 29, 2, 30))
    assert row.document_id == "frenchmen-street-live-marigny"
    (tmp_path / "v.json").write_text(json.dumps([{"vessel_id": "V", "base_zone": "Uptown", "capacity": 6}]))
    assert seeds.read_vessels(spark, str(tmp_path / "v.json")).first().capacity == 6


def test_seed_lists_are_bounded_and_whole(spark, tmp_path, monkeypatch):
    """Lists don't grow with the table, nor with an id that many rows share."""
    import __spark_entry__ as entry

    monkeypatch.setattr(seeds, "LIST_BYTES", 2_000, raising=False)
    text = 'say "hi",\n[{ä\u2028}]\\'
    docs = [(8, text * 5, "en", "web", 7)] * 300 + [(None, text, None, None, None)] * 3 + [(n, None, "de", "web", n) for n in range(40)]
    docs += [(41, "x" * 5_000, "en", "web", 5_000), (42, "", "en", "web", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    df = entry.queries()["s9_seed_calendar"](spark, str(tmp_path))
    assert max(Path(f.removeprefix("file:")).stat().st_size for f in df.inputFiles()) < 8_000
    got = sorted(((r.event_name, r.description, r.expected_attendance) for r in df.collect()), key=repr)
    assert got == sorted(((n if n is None else f"Event {n}", x, size) for n, x, _, _, size in docs), key=repr)


def test_materialized_tables_can_be_released(spark, tmp_path):
    from tidewatch.session import materialize, release

    kept = materialize(spark.range(3), "kept")
    gone = materialize(spark.range(3), "gone")
    files = gone.inputFiles()
    release(gone)
    spark.range(2).write.parquet(str(tmp_path / "own"))
    release(spark.read.parquet(str(tmp_path / "own")))
    assert kept.count() == 3 and spark.read.parquet(str(tmp_path / "own")).count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(files[0]).count()


def test_dispatches_take_the_newest_open_anomaly_in_turn(spark, rows):
    import datetime as dt
    import random

    r, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    minute = lambda n: t0 + dt.timedelta(minutes=n)
    a = sorted({(r.choice("xy"), minute(r.randrange(400))) for _ in range(80)})
    d = [(z, minute(1000 + k), minute(r.randrange(400))) for k, z in enumerate(r.choice("xyz") for _ in range(90))]
    d += [(z, w, w + dt.timedelta(minutes=1)) for z, w in a[::9]]
    got = joins.match_dispatches(
        spark.createDataFrame(a, "pickup_zone string, window_time timestamp"),
        spark.createDataFrame(d, "pickup_zone string, window_time timestamp, dispatched_at timestamp"),
        chunk_seconds=3600,
    )
    exact = {(z, w) for z, w, _ in d} & set(a)
    want = [(z, w, w, at, "window") for z, w, at in d if (z, w) in exact]
    open_ = sorted(set(a) - exact, key=lambda x: x[1])
    for z, w, at in sorted((x for x in d if (x[0], x[1]) not in exact), key=lambda x: (x[2], x[1])):
        mine = [x for x in open_ if x[0] == z and x[1] <= at]
        if mine:
            open_.remove(mine[-1])
            want.append((z, mine[-1][1], w, at, "as_of"))
    assert rows(got) == sorted(want, key=repr)


def test_keyed_table_reads_touched_partitions_only_and_keeps_newer_rows(spark, tmp_path, rows):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1 + n)
    table = keyed.KeyedTable(str(tmp_path / "t"), ["zone", "t"], "day", F.to_date("t"))
    schema = "zone string, t timestamp, seq long"
    table.apply(spark.createDataFrame([("a", day(0), 5), ("b", day(1), 1), (None, day(1), 9)], schema), order="seq")
    opened = table.read(spark, ["2024-01-01"]).inputFiles()
    assert opened and all("2024-01-01" in f for f in opened) and any("2024-01-02" in f for f in table.read(spark).inputFiles())
    table.apply(spark.createDataFrame([("a", day(0), 3), ("c", day(0), 1)], schema), order="seq")
    assert rows(table.read(spark).select("zone", "seq")) == [("a", 5), ("b", 1), ("c", 1)]
    assert [r["seq"] for r in spark.read.parquet(table.rejected).collect()] == [9]
    assert len(table._manifest(spark)[1]["versions"]) == 2
    assert [r["seq"] for r in spark.read.parquet(table.outdated).collect()] == [3]
    table.vacuum(spark, letters=True)
    assert table.read(spark).count() == 3 and table._numbers(spark) == [2]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(table.rejected)


def test_null_and_empty_partitions_lose_no_rows(spark, rows, tmp_path):
    """Partitions named by nothing, by an empty text, by the word null and by a path keep apart."""
    table = keyed.KeyedTable(str(tmp_path / "t"), ["k"], "part", F.col("p"))
    schema = "k long, p string, v string"
    values = [None, "", "null", "=", "a/b=c", "__HIVE_DEFAULT_PARTITION__"]
    table.apply(spark.createDataFrame([(k, p, "old") for k, p in enumerate(values)], schema))
    table.apply(spark.createDataFrame([(k + 10, p, "new") for k, p in enumerate(values)], schema))
    want = sorted([(k, p, "old") for k, p in enumerate(values)] + [(k + 10, p, "new") for k, p in enumerate(values)], key=repr)
    assert rows(table.read(spark).select("k", "p", "v")) == want
    assert rows(table.read(spark, [None]).select("k")) == [(0,), (10,)] and rows(table.read(spark, [""]).select("k")) == [(1,), (11,)]


def test_rows_without_an_order_are_the_oldest(spark, rows, tmp_path):
    table = keyed.KeyedTable(str(tmp_path / "t"), ["k"], "part", F.col("k") % 2)
    schema = "k long, seq long, v string"
    table.apply(spark.createDataFrame([(1, None, "a"), (2, 5, "a")], schema), order="seq")
    table.apply(spark.createDataFrame([(1, None, "b"), (2, None, "b"), (3, None, "b"), (4, 1, "x"), (4, None, "y")], schema), order="seq", name="two")
    assert rows(table.read(spark).select("k", "seq", "v")) == [(1, None, "b"), (2, 5, "a"), (3, None, "b"), (4, 1, "x")]
    assert rows(spark.read.parquet(f"{table.outdated}/batch=two").select("k", "v")) == [(2, "b")]
    table.apply(spark.createDataFrame([(1, 7, "c"), (1, None, "d")], schema), order="seq")
    assert rows(table.read(spark, ["1"]).select("k", "seq", "v")) == [(1, 7, "c"), (3, None, "b")]


def test_two_writers_lose_nothing(spark, rows, tmp_path):
    """The second writer commits while the first merges: once elsewhere, once in the same partition."""
    table = keyed.KeyedTable(str(tmp_path / "t"), ["k"], "part", F.col("k") % 2)
    frame = lambda *r: spark.createDataFrame(list(r), "k long, n long")
    table.apply(frame((0, 0), (1, 0)))
    calls = []

    def merge_beside(other):
        def merge(target, batch, keys):
            calls.append(other)
            if calls.count(other) == 1:
                table.apply(other)
            return keyed.upsert_replace(target, batch, keys)

        return merge

    table.apply(frame((2, 2)), merge_beside(frame((3, 3))))
    assert len(calls) == 1 and rows(table.read(spark).select("k", "n")) == [(0, 0), (1, 0), (2, 2), (3, 3)]
    calls.clear()
    table.apply(frame((4, 4)), merge_beside(frame((2, 9), (6, 6))))
    assert len(calls) == 2 and rows(table.read(spark).select("k", "n")) == [(0, 0), (1, 0), (2, 9), (3, 3), (4, 4), (6, 6)]
    assert table._numbers(spark) == [1, 2, 3, 4, 5]
    assert not table._publish(spark, 5, {})


def test_changes_of_all_four_kinds(spark, rows, tmp_path):
    table = keyed.KeyedTable(str(tmp_path / "t"), ["k"], "part", F.col("k") % 2)
    frame = lambda *r: spark.createDataFrame(list(r), "k long, n long")
    table.apply(frame((1, 1), (2, 2), (3, 3)))
    table.apply(frame((1, 5), (2, 2), (4, 4)))
    table.apply(frame((3, 8)), keyed.upsert_merge)
    table.apply(frame((2, None), (9, None)), keyed.remove_keys)
    got = rows(table.changes(spark).select("version", "operationType", "k", "n"))
    assert got == [(1, "insert", 1, 1), (1, "insert", 2, 2), (1, "insert", 3, 3), (2, "insert", 4, 4), (2, "replace", 1, 5), (3, "update", 3, 8), (4, "delete", 2, 2)]
    assert rows(table.changes(spark, 2, 3).select("operationType", "k")) == [("update", 3)] and table.changes(spark, 4).count() == 0
    assert rows(table.read(spark).select("k", "n")) == [(1, 5), (3, 8), (4, 4)]
    table.vacuum(spark)
    with pytest.raises(ValueError, match="version 3 is gone"):
        table.changes(spark, 3)


def test_old_partitions_are_dropped_unread(spark, rows, tmp_path):
    import shutil

    day = lambda n: dt.datetime(2024, 1, 1 + n // 24, n % 24)
    table = keyed.KeyedTable(str(tmp_path / "t"), ["k"], "part", F.col("k") % 4, time="t")
    data = [(k, day(24 * (k % 4) + 6 * (k // 4)) if k != 12 else None) for k in range(16)]
    frame = spark.createDataFrame(data, "k long, t timestamp")
    table.apply(frame)
    now, days = F.lit("2024-01-05 09:00:00").cast("timestamp"), 2  # the limit is 9:00 of the third day
    want = rows(keyed.retain(frame, "t", now, days))
    versions = table._manifest(spark)[1]["versions"]
    assert sorted(table._by_age({"versions": versions}, table._limit(spark, now, days))) == [["=0", "=2"], ["=1"], ["=3"]]
    shutil.rmtree(versions["=1"]["path"].removeprefix("file:"))  # reading it would fail
    assert rows(table.retain(spark, "t", now, days).select("k", "t")) == want
    table.drop_before(spark, now, days)
    after = table._manifest(spark)[1]["versions"]
    assert set(after) == {"=0", "=2", "=3"} and after["=3"] == versions["=3"]
    assert rows(table.read(spark).select("k", "t")) == want
    table.drop_before(spark, now, days)
    assert rows(table.read(spark).select("k", "t")) == want


def test_a_batch_lost_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(str(tmp_path / "t"), ["k"], "part", F.col("k") % 2)
    table.apply(spark.createDataFrame([(1, "old"), (2, "old")], "k long, v string"))
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.apply(spark.createDataFrame([(1, "new")], "k long, v string"))
    assert {r.v for r in table.read(spark).collect()} == {"old"}
    table.apply(spark.createDataFrame([(1, "new")], "k long, v string"))
    assert {(r.k, r.v) for r in table.read(spark).collect()} == {(1, "new"), (2, "old")}


def test_scratch_leaves_the_shared_folder_empty(spark):
    from tidewatch.session import materialize, scratch, shared_dir

    make = spark._jvm.org.apache.hadoop.fs.Path
    folder = make(f"{shared_dir(spark)}/tables")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda: {f.getPath().getName() for f in fs.listStatus(folder)} if fs.exists(folder) else set()
    before = names()
    with scratch(spark):
        assert materialize(spark.range(5), "x").count() == 5 and len(names() - before) == 1
    assert names() == before


def test_a_cluster_may_share_a_folder_of_the_file_system(spark, tmp_path, monkeypatch):
    from tidewatch import session

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_configured", lambda _: f"file://{tmp_path}/shared/")
    assert session.shared_dir(spark) == f"file://{tmp_path}/shared"
    assert session.materialize(spark.range(5), "x").count() == 5
    assert not [p.name for p in (tmp_path / "shared").iterdir() if p.name.startswith("probe")]
    # neither set: the warehouse
    monkeypatch.setattr(session, "_configured", lambda _: None)
    assert session.shared_dir(spark) == f"{spark.conf.get('spark.sql.warehouse.dir')}/tidewatch"


def test_a_folder_that_loses_rows_is_refused_on_a_cluster(spark, tmp_path, monkeypatch):
    from tidewatch import session

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    (tmp_path / "taken").write_text("")
    monkeypatch.setattr(session, "_configured", lambda _: f"file://{tmp_path}/taken")
    with pytest.raises(RuntimeError, match="cannot write and read"):
        session.shared_dir(spark)
    reader = type(spark.read)
    whole = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths: whole(self, *paths).where("id > 0"))
    monkeypatch.setattr(session, "_configured", lambda _: f"file://{tmp_path}/own")
    with pytest.raises(RuntimeError, match="gave back"):
        session.shared_dir(spark)


def test_a_snapshot_section_that_fails_late_is_empty(spark):
    from tidewatch.plans.bootstrap import warm_start

    bad = spark.range(3).select(F.raise_error(F.lit("late")).cast("string").alias("vessel_id"), F.lit("z").alias("base_zone"))
    traffic = spark.createDataFrame([("z", dt.datetime(2024, 1, 1), 3)], "zone string, window_start timestamp, request_count long")
    got = warm_start({"vessels": lambda: bad, "traffic": lambda: traffic}, F.lit("2024-01-01").cast("timestamp"))
    assert got["vessels"] is None and got["traffic"].count() == 1 and got["counts"].count() == 1
