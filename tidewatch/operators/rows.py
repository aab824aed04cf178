"""Filters and projections."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.exprs import canonical_zone, is_json, ratio, to_number
from tidewatch.functions.prompts import surge_reason
from tidewatch.functions.text import clean_summary

# Time ranges a reader may choose; None keeps everything.
TIME_RANGES = {
    "15m": timedelta(minutes=15),
    "1h": timedelta(hours=1),
    "6h": timedelta(hours=6),
    "24h": timedelta(hours=24),
    "all": None,
}


def surges(anomalies: DataFrame) -> DataFrame:
    return anomalies.where(F.col("is_surge"))


def in_zones(df: DataFrame, zones: Sequence[str] | DataFrame | None, column: str = "zone") -> DataFrame:
    """Rows of the given zones; an empty list means no filter.

    A DataFrame of zones (column ``zone``) is used as a semi join, for lists too
    long to be literals.
    """
    if isinstance(zones, DataFrame):
        wanted = zones.select(F.col("zone").alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin(list(zones))) if zones else df


def since(df: DataFrame, cutoff: datetime | str | None, column: str, epoch_millis: bool = False) -> DataFrame:
    """Rows at or after ``cutoff``; ``None`` keeps all. The filter reaches the scan."""
    if cutoff is None:
        return df
    limit = F.lit(str(cutoff)).cast("timestamp")
    return df.where(F.col(column) >= (F.unix_millis(limit) if epoch_millis else limit))


def normalise_zone(df: DataFrame, column: str = "zone") -> DataFrame:
    return df.withColumn(column, canonical_zone(column))


def project(df: DataFrame, allow: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Only the allowed columns that exist, without the excluded ones."""
    keep = [c for c in (allow if allow is not None else df.columns) if c in df.columns and c not in drop]
    return df.select(*keep)


def promote(df: DataFrame, **renames: str) -> DataFrame:
    """``promote(df, chunk="description")`` copies a column under a second name."""
    return df.withColumns({new: F.col(old) for new, old in renames.items()})


def with_provenance(df: DataFrame, model: str, dim: int, embedded_at: str, version: int = 1) -> DataFrame:
    return df.withColumns(
        {
            "embedded_at": F.col(embedded_at),
            "embedding_model": F.lit(model),
            "embedding_dim": F.lit(dim),
            "schema_version": F.lit(version),
        }
    )


def stale_embeddings(kb: DataFrame, current_model: str) -> DataFrame:
    """Rows embedded by another model (or by none); only these are embedded again."""
    return kb.where(~F.col("embedding_model").eqNullSafe(F.lit(current_model)))


def anomaly_sink(anomalies: DataFrame, detected_at: Column | None = None) -> DataFrame:
    """Rows announced at once: a reason from the numbers, evidence still empty."""
    none = F.lit(None).cast("string")
    out = surges(anomalies).select(
        "pickup_zone",
        "window_time",
        "request_count",
        "expected_requests",
        surge_reason().alias("anomaly_reason"),
        none.alias("top_chunk_1"),
        none.alias("top_chunk_2"),
        none.alias("top_chunk_3"),
    )
    return out if detected_at is None else out.withColumn("detected_at", detected_at)


def zone_traffic_sink(traffic: DataFrame) -> DataFrame:
    return traffic.select(
        F.col("pickup_zone").alias("zone"),
        "window_start",
        "window_end",
        "request_count",
        "total_passengers",
        F.col("total_revenue").cast("decimal(10,2)").alias("total_revenue"),
    )


def _first(df: DataFrame, names: Sequence[str]) -> Column:
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None)


def anomaly_cards(anomalies: DataFrame) -> DataFrame:
    """Actual, expected, surplus, multiple and the non-empty evidence chunks."""
    actual = to_number(_first(anomalies, ["request_count", "actual_count"]))
    expected = to_number(_first(anomalies, ["expected_requests", "expected_count"]))
    chunks = [F.col(c) for c in ("top_chunk_1", "top_chunk_2", "top_chunk_3") if c in anomalies.columns]
    listed = F.filter(F.array(*chunks), lambda c: c.isNotNull() & (c != "")) if chunks else F.array().cast("array<string>")
    return anomalies.select(
        F.coalesce("pickup_zone", F.lit("Unknown")).alias("zone"),
        _first(anomalies, ["window_time", "detected_at"]).alias("window_time"),
        actual.alias("actual_count"),
        expected.alias("expected_count"),
        (actual - expected).alias("surplus"),
        F.when(expected > 0, F.try_divide(actual, expected)).alias("multiple"),
        F.coalesce("anomaly_reason", F.lit("")).alias("anomaly_reason"),
        listed.alias("rag_chunks"),
    )


def dispatch_entries(log: DataFrame) -> DataFrame:
    return log.select(
        F.coalesce("pickup_zone", F.lit("Unknown")).alias("zone"),
        F.coalesce("dispatched_at", "window_time").alias("dispatched_at"),
        clean_summary("dispatch_summary").alias("summary"),
        F.coalesce("dispatch_json", F.lit("")).alias("dispatch_json"),
        is_json("dispatch_json").alias("parsed"),
    )


def knowledge_cards(kb: DataFrame, description_cap: int = 180) -> DataFrame:
    def text(name: str, default: str) -> Column:
        return (F.coalesce(name, F.lit(default)) if name in kb.columns else F.lit(default)).alias(name)

    attendance = F.coalesce("expected_attendance", F.lit(0)) if "expected_attendance" in kb.columns else F.lit(0)
    return kb.select(
        text("event_name", "Unknown"),
        text("zone", "Unknown"),
        text("venue", ""),
        attendance.alias("expected_attendance"),
        F.lower(text("impact_level", "low")).alias("impact_level"),
        text("event_type", ""),
        F.substring(F.coalesce("description", F.lit("")), 1, description_cap).alias("description"),
    )


def multiple_label(multiple: Column) -> Column:
    """``×12`` from ten up, ``×3.4`` below."""
    return F.concat(
        F.lit("×"),
        F.when(multiple >= 10, F.round(multiple, 0).cast("long").cast("string")).otherwise(
            F.format_string("%.1f", multiple)
        ),
    )


def _safe(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DecimalType):
        return col.cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _safe(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(col, lambda _, v: _safe(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [_safe(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col


def json_safe(df: DataFrame) -> DataFrame:
    """Every column in a form JSON can hold: decimals as doubles, times as ISO
    text with a UTC offset, binary ids as hex; nested values likewise."""
    return df.select(*[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def document(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The given columns of ``df`` as one JSON-safe document."""
    fields = [df.schema[c] for c in (columns or df.columns)]
    safe = [_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]
    return F.to_json(F.struct(*safe), {"ignoreNullFields": "false"})


def json_documents(df: DataFrame, alias: str = "doc") -> DataFrame:
    return df.select(document(df).alias(alias))
