"""Helpers the operators of this folder share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.session import materialize, release

__all__ = ["components", "kept", "materialize", "numbered", "release", "remembering", "small_batches", "source", "table", "text_key", "tasks", "unused"]

#: Rows of one Arrow batch: texts differ in length by five orders of magnitude.
BATCH_ROWS = 256
#: Words or segments that a worker remembers from one task to the next.
REST = 100_000


def kept(kind: str, key: object, make: Callable[[], Any]) -> Any:
    """``make()``, once in the life of a Python worker; later tasks of the worker get the same object.

    Functions of the package travel by value, so its own globals are new in every task.
    A worker holds one object: those that earlier jobs left go first.
    """
    state = sys.modules.setdefault("tidewatch_worker_state", types.ModuleType("tidewatch_worker_state")).__dict__
    for other in [k for k in state if not k.startswith("__") and (k != kind or state[k][0] != key)]:
        del state[other]
    if kind not in state:
        state[kind] = (key, make())
    return state[kind][1]


@contextmanager
def remembering(kind: str, key: object, make: Callable[[], Any]) -> Iterator[Any]:
    """:func:`kept` for the length of a task. An object that remembers more than ``REST`` parts of texts forgets them at its end.

    Short tasks overlap, so Spark keeps more workers than cores, and those that wait
    would hold on to full caches.
    """
    found = kept(kind, key, make)
    try:
        yield found
    finally:
        if len(found) > REST:
            found.forget()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, so that a worker holds few long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def source(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names, whatever else ``df`` holds.

    ``source(docs, doc_id="doc_id", text="body")``: other columns are dropped, so
    theirs cannot clash with the operator's.
    """
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as keep it apart from the columns of ``df``."""
    while name in df.columns:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text; null stands for the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, rows_per_task: int = 20_000) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in chunks of about ``rows_per_task``.

    ``keys`` must come from a small domain (lengths, shards, size classes): their
    counts are broadcast. A key with many rows is cut by a hash of ``order`` into
    as many parts as its count needs; each part is numbered on its own and moved
    by the sizes of the parts before it. ``df`` is read three times.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("__n") / rows_per_task)).cast("long")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    cut = df.join(F.broadcast(counts.withColumn("__parts", parts).drop("__n")), keys).withColumn(
        "__part", F.pmod(F.xxhash64(*order), F.col("__parts"))
    )
    sizes = cut.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    own = Window.partitionBy(*keys, "__part").orderBy(*order)
    return (
        cut.join(offsets, [*keys, "__part"])
        .withColumn(name, F.col("__offset") + F.row_number().over(own) - 1)
        .drop("__parts", "__part", "__offset")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that ``edges`` name; root is the component's smallest node.

    Alternating large-star and small-star steps: each step links the neighbours of
    a node to their minimum, so paths shorten geometrically and the edges end as
    stars. A step is two aggregations and a join on the node; a hub's minimum is
    combined before its shuffle. Every step is written to the shared folder, which
    cuts the lineage. The driver holds one count a step.
    """

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if small:
            both = pairs  # u > v
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        if small:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        else:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.filter(F.col("u") > F.col("v")).distinct()

    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") > F.col("v")).distinct()
    pairs = materialize(pairs, "links")
    state = None
    while True:
        step = materialize(star(pairs, small=False), "large-star")
        after = materialize(star(step, small=True), "small-star")
        release(pairs)
        release(step)
        pairs = after
        seen = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
