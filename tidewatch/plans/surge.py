"""Whole jobs: detect, explain, act, and the knowledge base behind them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import hit, slug
from tidewatch.functions.prompts import guarded_prompt, surge_query
from tidewatch.operators.aggregates import zone_traffic
from tidewatch.operators.anomaly import detect, select_surges
from tidewatch.operators.keyed import changed_rows, upsert_replace
from tidewatch.operators.models import Embedder, HashEmbedder, Writer, embed, generate
from tidewatch.operators.rows import anomaly_sink, project, promote, surges, with_provenance
from tidewatch.operators.validate import calendar_rules, embedding_rules, split
from tidewatch.operators.vector import search, search_results
from tidewatch.session import materialize


def surge_anomalies(rides: DataFrame, size: str = "1 minute", **detector) -> DataFrame:
    """Rides -> windows per zone -> detector -> surges (the anomaly stream's rows).

    The windows are written once: the detector reads them twice, and the rides
    behind them are by far the larger table.
    """
    return select_surges(detect(materialize(zone_traffic(rides, size), "traffic"), **detector))


def announced(anomalies: DataFrame) -> DataFrame:
    """The critical path: announced from the numbers alone, without waiting for evidence."""
    return anomaly_sink(anomalies)


def explained(
    anomalies: DataFrame,
    kb: DataFrame,
    writer: Writer | Callable[[Column], Column],
    embedder: Embedder | None = None,
    k: int = 3,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Surges with the model's reason and the k nearest documents.

    The search text is built once, embedded, and shown to the writer. Surges
    without hits leave no row, as a lateral join does, unless kept.
    """
    asked = surges(anomalies).withColumn("query", surge_query()).withColumn("query_id", F.col("query"))
    asked = materialize(asked, "asked")
    vectors = embed(asked.select("query_id", "query").distinct(), "query", embedder or HashEmbedder(), "query")
    hits = search_results(search(vectors, kb, k), kb)
    found = asked.join(hits, "query_id", "left" if keep_unmatched else "inner")
    replied = generate(found.withColumn("prompt", guarded_prompt()), "prompt", writer)
    return replied.select(
        "pickup_zone",
        "window_time",
        "request_count",
        "expected_requests",
        F.trim("response").alias("anomaly_reason"),
        *[hit("search_results", n, "chunk").alias(f"top_chunk_{n}") for n in (1, 2, 3)],
    )


# Columns of the knowledge base.
KB_COLUMNS = [
    "document_id",
    "chunk",
    "embedding",
    "event_name",
    "event_time_start",
    "event_time_end",
    "venue",
    "expected_attendance",
    "zone",
    "event_type",
    "impact_level",
    "embedded_at",
    "embedding_model",
    "embedding_dim",
    "schema_version",
]


def with_document_id(calendar: DataFrame) -> DataFrame:
    made = slug("event_name", "zone")
    return calendar.withColumn("document_id", F.coalesce("document_id", made) if "document_id" in calendar.columns else made)


def knowledge_rows(calendar: DataFrame, arrived: Column, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows for the knowledge base, dead letters) of calendar events."""
    model = embedder or HashEmbedder()
    valid, dead = split(with_document_id(calendar), calendar_rules())
    vectors = embed(promote(valid, chunk="description"), "chunk", model, "document", on_error="row")
    good, unusable = split(vectors.drop("embedding_error"), embedding_rules("embedding", model.dim))
    rows = with_provenance(good.withColumn("__at", arrived), model.name, model.dim, "__at")
    return project(rows, KB_COLUMNS), dead.unionByName(unusable)


def refreshed_knowledge_base(kb: DataFrame, calendar: DataFrame, arrived: Column, embedder: Embedder | None = None) -> DataFrame:
    """The knowledge base after a calendar load: only new or changed descriptions
    are embedded, then replaced by document id."""
    model = embedder or HashEmbedder()
    current = kb.where(F.col("embedding_model") == model.name)
    named = with_document_id(calendar)
    content = ["description", "event_name", "zone", "event_time_start", "event_time_end", "venue", "impact_level"]
    known = current.withColumn("description", F.col("chunk"))
    fresh, _ = knowledge_rows(changed_rows(named, known, ["document_id"], content), arrived, model)
    return upsert_replace(kb, fresh, ["document_id"])
