"""Outgoing rows: keyed documents, ingest stamps, write accounting, load guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidewatch.operators.rows import document

# Fields of a published calendar event.
PUBLISHED = [
    "event_name",
    "event_type",
    "venue",
    "zone",
    "event_time_start",
    "event_time_end",
    "expected_attendance",
    "description",
    "impact_level",
    "created_at",
    "updated_at",
]


def publish_documents(df: DataFrame, key: str, fields: Sequence[str] = PUBLISHED) -> DataFrame:
    """(key, value) rows for a topic: the id as text and the chosen fields as JSON."""
    present = [f for f in fields if f in df.columns]
    return df.select(F.col(key).cast("string").alias("key"), document(df, present).alias("value"))


def stamp(df: DataFrame, column: str = "ingested_at", source: Column | None = None) -> DataFrame:
    """Arrival time of each row from its source, so that a replay stamps the same.

    Files give their modification time; for Kafka pass ``F.col("timestamp")``.
    """
    return df.withColumn(column, source if source is not None else F.col("_metadata.file_modification_time"))


def accounted(df: DataFrame, failed: Column, name: str = "writes") -> tuple[DataFrame, Observation]:
    """The rows with a count of (total, failed, success) taken while they are written."""
    seen = Observation(name)
    bad = F.count_if(F.coalesce(failed, F.lit(True)))
    total = F.count(F.lit(1))
    return df.observe(seen, total.alias("total"), bad.alias("failed"), (total - bad).alias("success")), seen


def retained_size(offsets: DataFrame) -> DataFrame:
    """Messages kept per topic: sum of latest - earliest, never below 0 per partition.

    One unknown offset makes the topic's size unknown (null), not 0.
    """
    size = F.sum(F.greatest(F.col("latest") - F.col("earliest"), F.lit(0)))
    known = (F.count("earliest") == F.count(F.lit(1))) & (F.count("latest") == F.count(F.lit(1)))
    return offsets.groupBy("topic").agg(F.when(known, size).alias("retained"))


class AlreadyLoaded(RuntimeError):
    """The target holds rows, or it is not known whether it does."""


def load_once(spark: SparkSession, df: DataFrame, path: str, force: bool = False) -> None:
    """Append to an empty or new target only, unless forced."""
    if not force:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            try:
                empty = spark.read.schema(df.schema).parquet(path).isEmpty()
            except (AnalysisException, Exception) as exc:
                raise AlreadyLoaded(f"cannot tell whether {path} is empty") from exc
            if not empty:
                raise AlreadyLoaded(f"{path} already holds rows")
    df.write.mode("append").parquet(path)
