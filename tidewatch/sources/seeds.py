"""Reference tables loaded from JSON files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.exprs import slug
from tidewatch.sources.schemas import CALENDAR, VESSELS

#: Bytes at which a written list ends: whoever reads a list holds its rows at once.
LIST_BYTES = 2**22


def on_day(day: Column, hour: str, minute: str) -> Column:
    return day.cast("timestamp") + F.make_dt_interval(F.lit(0), F.col(hour), F.col(minute))


def read_calendar(spark: SparkSession, path: str, day: str) -> DataFrame:
    """Events of a day. Times are given as hour and minute; an event over midnight
    has its end before its start here and is put right where ranges are compared."""
    base = F.lit(day).cast("date")
    raw = spark.read.schema(CALENDAR).option("multiLine", "true").json(path)
    clock = [f"event_time_{e}_{u}" for e in ("start", "end") for u in ("hour", "min")]
    return (
        raw.withColumns(
            {
                "event_time_start": on_day(base, "event_time_start_hour", "event_time_start_min"),
                "event_time_end": on_day(base, "event_time_end_hour", "event_time_end_min"),
            }
        )
        .drop(*clock)
        .withColumn("document_id", slug("event_name", "zone"))
    )


def write_lists(rows: DataFrame, path: str) -> None:
    """The rows as JSON lists, one list a file and as many as they need.

    A task fills one list after the other in its order of rows, so no list grows with the
    table or with a key that many rows share.
    """
    most = LIST_BYTES

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda: pa.RecordBatch.from_pydict({"value": pa.array([b"[" + b",".join(held) + b"]"], pa.binary())})
        held, size = [], 0
        for batch in batches:
            for row in batch.column(0):
                held.append(row.as_py())
                size += len(held[-1])
                if size >= most:
                    yield whole()
                    held, size = [], 0
        if held:
            yield whole()

    texts = rows.select(F.to_json(F.struct(*rows.columns)).cast("binary").alias("value"))
    values = texts.mapInArrow(lists, "value binary").select(F.col("value").cast("string"))
    values.write.option("maxRecordsPerFile", 1).text(path)


def read_vessels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VESSELS).option("multiLine", "true").json(path)
