"""All pairs of a group, cut into units of bounded size.

A group goes into blocks by a hash, and each pair of blocks is one unit of work.
Units are dealt out by (group, low, high), come one after the other in a sorted
partition and stream by, so no task holds a whole group. What a unit finds leaves
it as numbers and spanning forests, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``size`` members the smallest one that the pairs connect it to."""
    root = np.arange(size)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def block_pairs(blocks: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of member numbers for a unit: within a block, or across two."""
    if low == high:
        return np.triu_indices(len(blocks), 1)
    a, b = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def in_blocks(df: DataFrame, key: str, size: str, member: str, block: int) -> DataFrame:
    """A row for every unit that ``member`` of group ``key`` takes part in, units together and sorted.

    A group of ``size`` members has ceil(size / block) blocks; a member meets each
    of them in one unit (key, low, high).
    """
    count = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member), F.greatest(count, F.lit(1))).cast("int")
    cut = df.withColumn("block", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)))
    cut = cut.withColumn("low", F.least("block", "__other")).withColumn("high", F.greatest("block", "__other")).drop("__other")
    return cut.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high", member)


def units(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one unit at a time, from a partition sorted by (key, low, high)."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        same = np.ones(b.num_rows, bool)
        for c in (key, "low", "high"):
            values = b[c].to_numpy(zero_copy_only=False)
            same[1:] &= values[1:] == values[:-1]
        starts = np.flatnonzero(~same).tolist()
        if rest and any(rest[-1][c][rest[-1].num_rows - 1] != b[c][0] for c in (key, "low", "high")):
            yield pa.Table.from_batches(rest)
            rest = []
        at = 0
        for s in starts:
            yield pa.Table.from_batches([*rest, b.slice(at, s - at)])
            rest, at = [], s
        rest.append(b.slice(at))
    if rest:
        yield pa.Table.from_batches(rest)
