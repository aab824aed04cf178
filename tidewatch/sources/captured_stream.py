"""Captured messages as a stream with offsets per partition and a start position.

A capture is a Parquet table cut by ``partition``, whose files hold the messages' key,
value, offset and time. The stream's position is the next offset of every partition; a
micro-batch reads, in one task a partition, the messages between two positions. Positions
come from file footers; a checkpoint continues where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "partition int, offset long, key string, value string, ts timestamp"


def write_captured(messages: DataFrame, path: str) -> None:
    """Add messages (partition, offset, key, value, ts) to a capture; times are kept as microseconds, which footers have bounds of."""
    messages.select("partition", "offset", "key", "value", F.unix_micros("ts").alias("us")).write.mode("append").partitionBy("partition").parquet(path)


def captured_stream(spark: SparkSession, path: str, start: str = "latest") -> DataFrame:
    """A capture as a stream. ``start`` counts for a new checkpoint only: ``earliest``,
    ``latest`` (what comes from now on), or an instant such as ``2024-01-05T00:00:00``
    (without a zone in UTC): from the first message of each partition at or after it."""
    spark.dataSource.register(CapturedSource)
    return spark.readStream.format("captured").option("path", path).option("start", start).load()


class Span(InputPartition):
    """Messages of one partition between two offsets."""

    def __init__(self, partition: int, low: int, high: int):
        super().__init__((partition, low, high))
        self.partition, self.low, self.high = partition, low, high


class CapturedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CapturedReader:
        return CapturedReader(self.options["path"], self.options.get("start", "latest"))


class CapturedReader(DataSourceStreamReader):
    def __init__(self, path: str, start: str):
        self.path, self.start = path, start
        if start not in ("earliest", "latest"):
            at = datetime.fromisoformat(start)
            since = (at if at.tzinfo else at.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)
            self.instant = since // timedelta(microseconds=1)

    def _files(self) -> list:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        if system.get_file_info(folder).type == fs.FileType.NotFound:
            return []
        return list(ds.dataset(folder, filesystem=system, format="parquet", partitioning="hive").get_fragments())

    def _bounds(self) -> list[tuple[int, object, int, int, object]]:
        """(partition, row group, lowest and highest offset, newest time) of every row group, from the footers."""
        import pyarrow.dataset as ds

        out = []
        for file in self._files():
            partition = int(ds.get_partition_keys(file.partition_expression)["partition"])
            for group in file.split_by_row_group():
                for info in group.row_groups:
                    known = info.statistics or {}
                    if "offset" in known:
                        out.append((partition, group, known["offset"]["min"], known["offset"]["max"], known.get("us", {}).get("max")))
        return out

    def initialOffset(self) -> dict:
        if self.start == "latest":
            return self.latestOffset()
        low: dict[str, int] = {}
        for partition, group, least, _, newest in self._bounds():
            if self.start != "earliest":
                least = self._first(group, newest)
            if least is not None:
                low[str(partition)] = min(low.get(str(partition), least), least)
        # a partition without a message that late starts behind its last one
        return (self.latestOffset() if self.start != "earliest" else {}) | low

    def _first(self, group, newest) -> int | None:
        """The first offset of a row group at or after the instant; its rows are read only if some are that late."""
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        if newest is not None and newest < self.instant:
            return None
        return pc.min(group.to_table(columns=["offset"], filter=ds.field("us") >= self.instant)["offset"]).as_py()

    def latestOffset(self) -> dict:
        high: dict[str, int] = {}
        for partition, _, _, most, _ in self._bounds():
            high[str(partition)] = max(high.get(str(partition), 0), most + 1)
        return high

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(int(p), start.get(p, 0), high) for p, high in sorted(end.items()) if high > start.get(p, 0)]

    def read(self, partition: Span) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds

        between = (ds.field("offset") >= partition.low) & (ds.field("offset") < partition.high)
        for file in self._files():
            if int(ds.get_partition_keys(file.partition_expression)["partition"]) != partition.partition:
                continue
            for batch in file.scanner(columns=["offset", "key", "value", "us"], filter=between).to_batches():
                at = pa.array([partition.partition] * batch.num_rows, pa.int32())
                ts = batch["us"].cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([at, batch["offset"], batch["key"], batch["value"], ts], ["partition", "offset", "key", "value", "ts"])
