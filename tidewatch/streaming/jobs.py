"""Structured Streaming jobs. Tables between the steps take the place of topics:
each consumer reads them with its own checkpoint and fails on its own."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewatch.operators.aggregates import status_rollup, zone_traffic
from tidewatch.operators.joins import without_evidence
from tidewatch.operators.keyed import KeyedTable, upsert_replace
from tidewatch.operators.models import Embedder, embed, explain
from tidewatch.operators.validate import Rule, split
from tidewatch.functions.exprs import hit
from tidewatch.functions.prompts import fallback_query
from tidewatch.operators.vector import search, search_results
from tidewatch.session import materialize
from tidewatch.streaming.stateful import own_state


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream. Back-pressure bounds a batch; nothing is dropped."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def from_now(stream: DataFrame, column: str, start: Column | None) -> DataFrame:
    """Start position of a new consumer: rows from ``start`` on; ``None`` replays all."""
    return stream if start is None else stream.where(F.col(column) >= start)


def enriched_stream(base: DataFrame, enriched: DataFrame, base_time: str, enriched_time: str, delay: str = "1 hour") -> DataFrame:
    """Anomalies with their enrichment as two streams join: left outer by (zone, window).

    Both sides carry a watermark of ``delay``; an anomaly whose enrichment has not
    come within it leaves the state with the numbers alone.
    """
    left = base.withWatermark(base_time, delay).alias("a")
    right = enriched.withWatermark(enriched_time, delay).alias("e")
    on = [F.col(f"a.{k}") == F.col(f"e.{k}") for k in ("pickup_zone", "window_time")]
    near = F.expr(f"e.{enriched_time} BETWEEN a.{base_time} AND a.{base_time} + INTERVAL {delay}")
    extra = [F.col(f"e.{c}") for c in enriched.columns if c not in base.columns]
    return left.join(right, [*on, near], "leftOuter").select("a.*", *extra)


def traffic(rides: DataFrame, size: str = "1 minute") -> DataFrame:
    """Closed windows of a watermarked ride stream (append mode).

    Rows not later than the watermark delay are counted; later ones are dropped
    and show up in :func:`progress_rows`. A window closes when a later event
    arrives; :func:`flush_until` gives the open ones.
    """
    return zone_traffic(rides, size)


def append(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    with own_state(df.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start(path)


def flush_until(rides: DataFrame, until: Column, size: str = "1 minute") -> DataFrame:
    """Windows that end by ``until`` from the ride table, for idle zones whose last
    window no event will close. A batch run instead of heartbeat rows."""
    return zone_traffic(rides, size).where(F.col("window_end") <= until)


def keyed_sink(
    stream: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    rules: Sequence[Rule] = (),
    dead_letters: str | None = None,
    merge: Callable = upsert_replace,
    order: str | None = None,
    tie: Sequence[str] = (),
    once: bool = True,
) -> StreamingQuery:
    """Validate each batch, upsert the good rows, append the others to a dead-letter table.

    The upsert gives the same table when a batch runs twice, and dead letters are
    written under their batch id, so a restart repeats nothing. Rows that break no
    rule but lack a key are in ``table.rejected``, under the same id.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            valid, dead = split(batch, rules, F.current_timestamp()) if rules else (batch, None)
            if dead is not None and dead_letters:
                dead.write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")
            table.apply(valid, merge, order, tie, str(batch_id))
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_table(totals: DataFrame, table: KeyedTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Running aggregates of a stream as a keyed table: each batch sends the keys that changed (update mode).

    ``totals`` is grouped by the table's keys. The state merges the partial sums; a row
    carries the batch that it is of, so a batch that runs again replaces nothing newer.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch.withColumn("batch", F.lit(batch_id).cast("long")), order="batch", name=str(batch_id))

    writer = totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    with own_state(totals.sparkSession):
        return (writer.trigger(availableNow=True) if once else writer).start()


def split_late(
    rides: DataFrame, path: str, checkpoint: str, at: str = "request_ts", size: str = "1 minute", delay: str = "5 seconds", once: bool = True
) -> StreamingQuery:
    """Rows whose window has closed before their batch go to a side table, all others to the main one.

    The watermark lags one batch: it is the newest time of the batches before, less
    ``delay``, and a row is late if its window of ``size`` ends by then, as in
    :func:`traffic`. Every batch writes its rows, its late rows and its newest time under its own number,
    so a batch that runs again writes the same files. Read with :func:`on_time` and :func:`late`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = _numbered(spark, f"{path}/newest", "newest timestamp").where(F.col("batch") < batch_id)
        mark = seen.agg(F.max("newest").alias("m")).select(F.expr(f"m - INTERVAL {delay}")).first()[0]  # one row a batch
        batch.persist()
        try:
            closed = F.window(at, size)["end"] <= F.lit(mark).cast("timestamp")
            behind = F.coalesce(closed, F.lit(False))
            batch.where(~behind).write.mode("overwrite").parquet(f"{path}/on_time/batch={batch_id}")
            batch.where(behind).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            batch.agg(F.max(at).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = rides.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _numbered(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """What batches have written under their numbers; none yet is an empty table."""
    schema = T.StructType([*T.StructType.fromDDL(ddl).fields, T.StructField("batch", T.LongType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def on_time(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that :func:`split_late` let through, with their batch."""
    return _numbered(spark, f"{path}/on_time", schema.toDDL())


def late(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that came too late, with their batch."""
    return _numbered(spark, f"{path}/late", schema.toDDL())


def fan_out(
    open_stream: Callable[[], DataFrame], consumers: Mapping[str, Callable[[DataFrame, int], None]], checkpoint: str, once: bool = True
) -> dict[str, StreamingQuery]:
    """One table, several consumers, each its own query and checkpoint."""
    out = {}
    for name, consume in consumers.items():
        writer = (
            open_stream().writeStream.queryName(name).foreachBatch(consume).option("checkpointLocation", f"{checkpoint}/{name}")
        )
        out[name] = (writer.trigger(availableNow=True) if once else writer).start()
    return out


def offer_once(anomalies: DataFrame, column: str = "ingested_at", seconds: int = 600) -> DataFrame:
    """Each (zone, window) once within the time span, for streams."""
    return anomalies.withWatermark(column, f"{seconds} seconds").dropDuplicatesWithinWatermark(["pickup_zone", "window_time"])


# -- late evidence ---------------------------------------------------------------------------


def backfill_evidence(
    anomalies: DataFrame,
    enriched: DataFrame,
    kb: DataFrame,
    now: Column,
    embedder: Embedder | None = None,
    delay_seconds: int = 40,
) -> DataFrame:
    """Evidence for anomalies that got none within the delay; a scheduled job.

    Anomalies enriched meanwhile are not touched. The result is merged onto the
    anomaly table by (pickup_zone, window_time).
    """
    due = without_evidence(anomalies, enriched, now, delay_seconds)
    asked = materialize(due.withColumn("query_id", fallback_query()), "asked")
    vectors = embed(asked.select("query_id").distinct(), "query_id", embedder, "query")  # written once by embed
    fields = [c for c in ("chunk", "event_name", "event_type", "impact_level") if c in kb.columns]
    hits = search_results(search(vectors, kb, 3), kb, fields)
    found = explain(asked.join(hits, "query_id"))
    return found.select(
        "pickup_zone",
        "window_time",
        "anomaly_reason",
        *[F.coalesce(hit("search_results", n, "chunk"), F.lit("")).alias(f"top_chunk_{n}") for n in (1, 2, 3)],
        now.alias("enriched_at"),
        F.lit("backfill").alias("enriched_by"),
    )


# -- progress ------------------------------------------------------------------------------------

_PROGRESS = "component_group string, name string, batch_id long, input_rows long, late_rows long, state_rows long"


class ProgressLog(StreamingQueryListener):
    """Every progress report of a session's streams, one small JSON file each, so none is lost.

    Register with ``spark.streams.addListener(log)``; :func:`progress_rows` reads the folder.
    """

    def __init__(self, spark: SparkSession, path: str, group: str = "streams"):
        self.spark, self.path, self.group = spark, path, group
        self.seen: dict[str, int] = {}

    def _write(self, file: str, **row) -> None:
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        target = make(f"{self.path}/{file}.json")
        out = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(json.dumps({"component_group": self.group, **row}), "utf-8"))
        out.close()

    def wait_for(self, query: StreamingQuery, seconds: float = 30) -> None:
        """Reports come through the listener bus; wait for those of a query that has ended."""
        last = query.lastProgress
        wanted = last["batchId"] if last else -1
        end = time.monotonic() + seconds
        while time.monotonic() < end and self.seen.get(str(query.runId), -1) < wanted:
            time.sleep(0.05)

    def onQueryStarted(self, event) -> None:
        self._write(f"{event.runId}-start", name=event.name or str(event.id), input_rows=0, late_rows=0, state_rows=0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write(
            f"{p.runId}-{p.batchId}-{p.timestamp.replace(':', '')}",
            name=p.name or str(p.id),
            batch_id=p.batchId,
            input_rows=p.numInputRows,
            late_rows=sum(o.numRowsDroppedByWatermark for o in p.stateOperators),
            state_rows=sum(o.numRowsTotal for o in p.stateOperators),
        )
        self.seen[str(p.runId)] = p.batchId

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    """Progress reports that :class:`ProgressLog` wrote, as a table; a started stream has a row without batch."""
    return spark.read.schema(_PROGRESS).json(path)


def stall_report(progress: DataFrame, failed: Sequence[str] = ()) -> DataFrame:
    """Status per query: failed, ok, or warn when started without any progress."""
    per = progress.groupBy("component_group", "name").agg(F.max("batch_id").alias("last"))
    status = (
        F.when(F.col("name").isin(list(failed)), "fail").when(F.col("last").isNotNull(), "ok").otherwise("warn")
        if failed
        else F.when(F.col("last").isNotNull(), "ok").otherwise("warn")
    )
    return per.select("component_group", "name", status.alias("status"))


def stream_health(progress: DataFrame, failed: Sequence[str] = ()) -> DataFrame:
    return status_rollup(stall_report(progress, failed))
