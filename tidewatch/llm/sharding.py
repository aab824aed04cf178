"""Longest-processing-time scheduling of documents into shards.

Groups of equal texts stay together. The driver schedules *sizes*, not groups: a
heap takes the sizes in falling order and deals the groups of one size to the
least-loaded shards. Groups of one size are alike to the schedule, so it is
enough to know how many of them each shard gets; which ones follows from a
distributed numbering of the groups of a size.

Bounds: sizes up to ``FINE`` bytes are scheduled exactly; larger ones fall into
1,024 classes per power of two. So the driver and the broadcast schedule hold
at most FINE + 1,024 * 48 classes, whatever the table's size. Large groups are
placed first, their true loads are summed by Spark, and the exactly known small
ones level what the classes left uneven.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, numbered, source, table, text_key

FINE = 16_384


def deal(loads: list[float], size: float, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard gets, least-loaded first.

    Equal to popping the heap ``count`` times. Many groups are dealt at once up to
    a common level, which leaves fewer than one round for the heap.
    """
    got = [0] * len(loads)
    if count > 4 * len(loads):
        low, high = min(loads), max(loads) + size * (count / len(loads) + 2)
        for _ in range(100):
            level = (low + high) / 2
            if sum(max(0, int((level - x) // size)) for x in loads) <= count - len(loads):
                low = level
            else:
                high = level
        got = [max(0, int((low - x) // size)) for x in loads]
        loads[:] = [x + n * size for x, n in zip(loads, got, strict=True)]
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(got)):
        x, i = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (x + size, i))
    for x, i in heap:
        loads[i] = x
    return got


def schedule(classes: list[tuple[int, float, int]], loads: list[float]) -> pd.DataFrame:
    """Upper rank of each shard in every class; ``classes`` holds (class, size, groups)."""
    rows = []
    for cls, size, count in sorted(classes, key=lambda c: (-c[1], c[0])):
        ends, total = [], 0
        for n in deal(loads, size, count):
            total += n
            ends.append(total)
        rows.append((cls, ends))
    return pd.DataFrame(rows, columns=["cls", "ends"])


def _place(groups: DataFrame, loads: list[float]) -> DataFrame:
    """``groups`` (key, bytes, cls) with their shard, beginning from ``loads``."""
    spark = groups.sparkSession
    found = groups.groupBy("cls").agg(F.avg("bytes"), F.count(F.lit(1))).collect()  # bounded number of classes
    plan = schedule([tuple(r) for r in found], loads)
    if plan.empty:
        return groups.select("key", "bytes", F.lit(0).alias("shard")).limit(0)
    plan = spark.createDataFrame(plan, "cls long, ends array<long>")
    ranked = numbered(groups, ["cls"], ["key"], "rank")
    return ranked.join(F.broadcast(plan), "cls").select(
        "key", "bytes", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard")
    )


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and a slot without gaps for every row of ``docs``.

    size is the UTF-8 length of the text plus 8. Equal texts share a shard; a null
    text counts as the empty one (they stay together too, crc32 0). Repeated rows
    and null or repeated ids keep one slot each. An empty table gives no rows. A
    group of more than 1/shards of all bytes makes its shard the largest: it may
    not be cut.
    """
    base = source(docs, doc_id=doc_id, text=text).select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        text_key(F.col("text")).alias("key"),
        F.monotonically_increasing_id().alias("uid"),
    )
    base = materialize(base, "shard-rows")
    power = F.length(F.bin("bytes")) - 1
    coarse = FINE + power * 1024 + F.floor((F.col("bytes") / F.pow(F.lit(2.0), power) - 1) * 1024)
    groups = base.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = groups.withColumn("cls", F.when(F.col("bytes") <= FINE, F.col("bytes")).otherwise(coarse).cast("long"))
    groups = materialize(groups, "shard-groups")
    loads = [0.0] * shards
    large = materialize(_place(groups.filter(F.col("cls") > FINE), loads), "shard-large")
    loads = [0.0] * shards
    for shard, size in large.groupBy("shard").agg(F.sum("bytes")).collect():  # one row a shard
        loads[shard] = float(size)
    small = _place(groups.filter(F.col("cls") <= FINE), loads)
    placed = materialize(large.union(small).select("key", "shard"), "shard-placed")
    out = materialize(base.join(placed, "key").drop("key"), "shard-dealt")
    return numbered(out, ["shard"], ["uid"], "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes, equal texts together."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
