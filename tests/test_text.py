"""Cleaning, sections, redaction and expressions on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import exprs, prompts, text


@pytest.fixture
def value(spark):
    def run(fn, *args, types=None):
        names = [f"c{i}" for i in range(len(args))]
        schema = ", ".join(f"{n} {t}" for n, t in zip(names, types or ["string"] * len(args)))
        return spark.createDataFrame([args], schema).select(fn(*names).alias("v")).first().v

    return run


RAW = (
    "I'll look at the fleet.\n\n"
    '<tool_call> {"name": "list"} </tool_call>\n<tool_response> {"vessels": []} </tool_response>\n\n'
    "Going ahead.\n\nDispatch Summary: Due to the surge in Marigny, we sent 6 boats. 94 seats.\n\n"
    'Dispatch JSON:\n{\n  "zone": "Marigny"\n}\nAPI Response:\n{\n  "status": "success"\n}'
)


@pytest.mark.parametrize(
    "raw,want",
    [
        (RAW, "Due to the surge in Marigny, we sent 6 boats. 94 seats."),
        ("Sent 6 boats (94 seats).", "Sent 6 boats (94 seats)."),
        ('Looking.\n<TOOL_CALL>{\n}</TOOL_CALL>\n<tool_response>x</tool_response>\nDone.', "Looking.\n\nDone."),
        ("", ""),
        (None, ""),
        ("**Dispatch Summary:** Sent 6 boats.\n\n**Dispatch JSON:**\n{}\n\n**API Response:**\n{}", "Sent 6 boats."),
        ("**Dispatch Summary:**\n\nSent 3 boats to Marigny.\n\n**Dispatch JSON:**\n{}", "Sent 3 boats to Marigny."),
        ("Dispatch Summary:\n\nDispatch JSON:\n{}", "Dispatch Summary:"),
        ("prose\n\n\n\n\nmore\nAPI Response: {}", "prose\n\nmore"),
        ("dispatch   summary a *bold* word api  response: x", "a *bold* word"),
        ("** \x0b kept", "\x0b kept".strip()),
    ],
)
def test_clean_summary(value, raw, want):
    assert value(text.clean_summary, raw) == want


def test_sections_of_a_reply(value):
    reply = 'Dispatch Summary:\nLine one\nline two\n\nDispatch JSON:\n```json\n[{"vessel_id": "V1"}]\n```\n\nAPI Response:\n{"ok": true}\n'
    assert value(text.summary_section, reply) == "Line one\nline two"
    assert value(text.json_section, reply) == '[{"vessel_id": "V1"}]'
    assert value(text.response_section, reply) == '{"ok": true}'
    assert value(text.summary_section, "no sections") == "no sections"
    assert value(text.json_section, "no sections") is None


@pytest.mark.parametrize(
    "raw,want",
    [
        ("password=hunter2secret", "password=hunt…et"),
        ("password=short", "password=***"),
        ('{"api_key": "abcdefghij", "name": "bob"}', '{"api_key": "abcd…ij", "name": "bob"}'),
        ("secret: 'abc'", "secret: '***'"),
        # the scheme word after a secret name counts as its value
        ("Authorization: Bearer abcdefghijkl", "Authorization: *** abcd…kl"),
        ("sent Bearer abcdefghijkl on", "sent Bearer abcd…kl on"),
        ("sent basic abc= on", "sent basic *** on"),
        ("  api_key : AKIA1234FAKE5678", "  api_key : AKIA…78"),
        ("api_key=", "api_key="),
        ('password="abc.+*?d12345"', 'password="abc.…45"'),
        ('{"environment":"env-abc123"}', '{"environment":"env-abc123"}'),
        ("mongodb+srv://bob:pa55@host/db", "mongodb+srv://bob:***@host/db"),
        ("MY_SESSION-TOKEN_2 = 12345678;x", "MY_SESSION-TOKEN_2 = 1234…78;x"),
        ("password=abc,defghijklm next", "password=***,defghijklm next"),
        ("password=api_key=abcdef", "password=api_…ef"),
        ("env-abc12345 lkc-xyz host=example.com", "env-abc12345 lkc-xyz host=example.com"),
        ("the key to success: work", "the key to success: work"),
        ("monkey=banana1234", "monkey=banana1234"),
        ("", ""),
        (None, None),
    ],
)
def test_redact(value, raw, want):
    once = value(text.redact, raw)
    assert once == want
    assert value(text.redact, once) == once


def test_redact_is_idempotent_on_whole_documents(spark):
    from tidewatch.plans.inputs import leaky_notes

    df = leaky_notes(spark, "/root/testdata/sf0.001").select(text.redact("text").alias("a"))
    assert df.where(text.redact("a") != F.col("a")).count() == 0


def test_hide_uri_credentials(value):
    assert value(text.hide_uri_credentials, "at mongodb://u:p@h/x") == "at mongodb://<redacted>@h/x"


def test_plain_and_escaped(value):
    assert value(text.plain_text, "**a**\n---\n\n\n\nb ") == "a\n\nb"
    assert value(text.escape_html, '<a href="x">&</a>') == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"


@pytest.mark.parametrize("now", [1_700_000_123_456, 0, 1, 59_999, 60_000])
def test_window_bounds(value, now):
    start = value(exprs.window_start_ms, now, types=["long"])
    end = value(exprs.window_end_ms, now, types=["long"])
    assert start <= now < end and end - start == 60_000 and start % 60_000 == 0


def test_seconds_to_next_window(value):
    at = dt.datetime(2026, 5, 6, 12, 3, 40)
    assert value(exprs.seconds_to_next_window, at, types=["timestamp"]) == 20
    assert value(lambda c: exprs.seconds_to_next_window(c, 5), at, types=["timestamp"]) == 80


@pytest.mark.parametrize(
    "name,zone,want",
    [
        ("Essence Music Festival", "CBD", "essence-music-festival-cbd"),
        ("Garden District Home & Garden Tour", "Garden District", "garden-district-home-garden-tour-garden-district"),
        ("Saints Game (Home)", "CBD", "saints-game-home-cbd"),
        ("Café Señor", "Ñ", "cafe-senor-n"),
        ("!Test!", "Z!", "test-z"),
        (None, "x", "x"),
    ],
)
def test_slug(value, name, zone, want):
    assert value(exprs.slug, name, zone) == want


def test_boats_and_json(value):
    assert [b.vessel_id for b in value(exprs.boats, ' [{"vessel_id":"V1"},{}]')] == ["V1", None]
    assert value(exprs.boats, '{"vessel_id":"V1"}') is None
    assert value(exprs.boats, "not json") is None
    assert value(exprs.is_json, '{"a": 1}') is True and value(exprs.is_json, "oops") is False
    assert value(exprs.is_json, None) is False


def test_first_embedding(spark):
    df = spark.createDataFrame([([([1.0],)],), ([],)], "data array<struct<embedding: array<double>>>")
    assert [r.e for r in df.select(exprs.first_embedding().alias("e")).collect()] == [[1.0], None]


def test_djb2(value):
    def djb2(s):
        h = 5381
        for c in s:
            h = (h * 33 + ord(c)) & 0xFFFFFFFF
        return h

    for s in ("VESSEL-13", "", "a much longer vessel identifier 0123456789"):
        assert value(exprs.djb2, s) == djb2(s)


def test_percent_and_ratio(value):
    both = ["long", "long"]
    assert value(exprs.percent_over, 15, 10, types=both) == 50.0
    assert value(lambda a, e: exprs.percent_over(a, e, integer_pct=True), 25, 10, types=both) == 100.0
    assert value(exprs.percent_over, 15, 0, types=both) is None
    assert value(exprs.ratio, 100, 10, types=both) == 10.0


def test_prompt_is_null_with_too_few_hits(spark):
    hits = spark.sql("select 'q' as query, array(struct('a' as document_id, 'x' as chunk, 0.5d as score)) as search_results")
    assert hits.select(prompts.guarded_prompt().alias("p")).first().p is None
    assert "<<DOC 1 START>>\nScore: 0.5\nSource: a\nx\n<<DOC 1 END>>" in hits.select(prompts.guarded_prompt(docs=1).alias("p")).first().p


def test_surge_texts(spark):
    row = [("French Quarter", dt.datetime(2026, 5, 29, 17, 4, 59, 999000), 30, 0)]
    df = spark.createDataFrame(row, "pickup_zone string, window_time timestamp, request_count long, expected_requests long")
    got = df.select(
        prompts.surge_reason().alias("r"), prompts.surge_query().alias("q"), prompts.dispatch_request().alias("d"),
        prompts.fallback_query().alias("f"),
    ).first()
    assert got.r == "Surge detected in French Quarter: 30 ride requests vs expected 0"
    assert "at 5:04 PM (17:04) during evening dinner period (5:00 PM - 8:00 PM)" in got.q
    assert "between 4:04 PM and 6:04 PM. Expected: 0, Actual: 30 (+N/A%)" in got.q
    assert got.d.endswith("in 5 minutes (expected 0). Surge ratio: N/Ax")
    assert got.f.startswith("Transportation demand surge in French Quarter at 5:04 PM. Expected: 0, Actual: 30.")
