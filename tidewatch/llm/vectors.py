"""Near-duplicate vectors by lattice hashing.

A table projects unit vectors at random onto a few blocks of eight dimensions and
decodes every block to the nearest point of the E8 lattice; the points together
name a cell. A vector is at home in its own cell and probes the cells in which one
block takes the next nearest lattice points. Home vectors of a cell are compared
with each other and with those that probe it, by cosine in double precision.

Equal vectors of a label are one class. A task keeps a spanning forest of the
links it finds, so a dense cell costs no row a pair. The forests' components are
exact; inside a component all pairs are compared once more, in blocks, to count
every link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.blocks import block_pairs, forest, in_blocks, units
from tidewatch.llm.common import components, materialize, small_batches, source, table

THRESHOLD = 0.93
#: Tables, blocks of eight dimensions a cell, probes a block, lattice units a unit of length:
#: two vectors of 64 dimensions at cosine 0.93 meet in some cell 99 times in 100.
TABLES, BLOCKS, PROBES, SCALE = 8, 2, 1, 1.2
BLOCK = 128


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 (twice their coordinates, whole numbers) for rows of eight numbers."""

    def even(y: np.ndarray) -> np.ndarray:
        """Nearest whole points with an even sum: where it is odd, the worst rounding goes the other way."""
        r = np.rint(y)
        off = y - r
        worst = np.abs(off).argmax(axis=1)
        rows = np.arange(len(y))
        step = np.where(off[rows, worst] >= 0, 1.0, -1.0)
        r[rows, worst] += step * (r.sum(axis=1) % 2 != 0)
        return r

    whole, half = even(x), even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return (2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: the way from a point to its neighbours."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (2, -2):
                for b in (2, -2):
                    v = [0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = [1 if bits >> k & 1 else -1 for k in range(8)]
        if v.count(-1) % 2 == 0:
            out.append(v)
    return np.array(out)


def projections(dimensions: int) -> np.ndarray:
    """Orthonormal directions of every table: (TABLES, 8 * BLOCKS, dimensions)."""
    rng = np.random.default_rng(88)
    width = 8 * BLOCKS
    out = []
    for _ in range(TABLES):
        q, _ = np.linalg.qr(rng.standard_normal((max(dimensions, width), width)))
        out.append(q.T[:, :dimensions] * np.sqrt(max(dimensions, width) / 8))
    return np.array(out)


def cells(unit: np.ndarray, label: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell hash, at home) of the vectors, one dimension count at a time."""
    ways = shortest()
    rows, names, home = [], [], []
    for t, p in enumerate(projections(unit.shape[1])):
        y = (unit @ p.T * SCALE).reshape(len(unit), BLOCKS, 8)
        own = np.stack([decode(y[:, b]) for b in range(BLOCKS)], axis=1)
        every = [(own, True)]
        for b in range(BLOCKS):
            off = 2 * y[:, b] - own[:, b]
            near = np.argsort(-(off @ ways.T), axis=1, kind="stable")[:, :PROBES]
            for k in range(PROBES):
                other = own.copy()
                other[:, b] += ways[near[:, k]]
                every.append((other, False))
        for points, at_home in every:
            raw = np.ascontiguousarray(points.reshape(len(unit), -1).astype(np.int16))
            salt = f"{t}:{unit.shape[1]}:"
            names += [
                int.from_bytes(hashlib.blake2b(f"{salt}{n}:".encode() + r.tobytes(), digest_size=8).digest(), "little", signed=True)
                for n, r in zip(label, raw, strict=True)
            ]
            rows.append(np.arange(len(unit)))
            home.append(np.full(len(unit), at_home))
    return np.concatenate(rows), np.array(names, np.int64), np.concatenate(home)


def stored(values: list | None, kind: str) -> bytes | None:
    """The components as they are, or None for what links with nothing."""
    if not values or any(v is None for v in values):
        return None
    v = np.array(values, kind)
    return v.tobytes() if np.isfinite(v).all() and v.any() else None


def unit_vectors(raw: list[bytes], kind: str) -> np.ndarray:
    """Stored vectors of one length, in double precision and of length 1."""
    v = np.stack([np.frombuffer(x, kind) for x in raw]).astype(float)
    v /= np.abs(v).max(axis=1)[:, None]  # so that no square overflows or vanishes
    return v / np.linalg.norm(v, axis=1)[:, None]


def _linked(t: pa.Table, threshold: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit with a cosine of at least ``threshold``; all its vectors have one length."""
    left, right = block_pairs(t["block"].to_numpy(), t["low"][0].as_py(), t["high"][0].as_py())
    if "home" in t.column_names:
        home = t["home"].to_numpy()
        met = home[left] | home[right]
        left, right = left[met], right[met]
    v = unit_vectors(t["vector"].to_pylist(), kind)
    hit = (v @ v.T)[left, right] >= threshold
    return left[hit], right[hit]


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Rows are compared within equal labels and equal lengths. Null labels, null, zero
    or empty vectors and ones with a null or non-finite component link with
    nothing. Null ids count as larger than all others. Repeated rows link with each
    other.
    """
    small_batches(vectors.sparkSession)
    rows = source(vectors, vec_id=vec_id, embedding=embedding, label=label).withColumn("uid", F.monotonically_increasing_id())
    rows = rows.withColumn("label", F.col("label").cast("string"))
    kind = "<f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"

    def read(batches):
        for b in batches:
            labels = b["label"].to_pylist()
            raw = [None if n is None else stored(e, kind) for e, n in zip(b["embedding"].to_pylist(), labels, strict=True)]
            keys = [
                None if r is None else hashlib.blake2b(f"{n}:".encode() + r, digest_size=16).digest() for r, n in zip(raw, labels, strict=True)
            ]
            arrays = [b["uid"], b["vec_id"], b["label"], pa.array(keys, pa.binary()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "vec_id", "label", "key", "vector"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    rows = rows.mapInArrow(read, f"uid long, vec_id {id_type}, label string, key binary, vector binary")
    rows = materialize(rows, "vector-rows")
    first = F.struct(F.col("vec_id").isNull().alias("last"), "vec_id")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label")
    )
    classes = materialize(classes, "vector-classes")

    def hashed(batches):
        for b in batches:
            raw, labels = b["vector"].to_pylist(), b["label"].to_pylist()
            for size in sorted({len(r) for r in raw}):
                at = [i for i, r in enumerate(raw) if len(r) == size]
                unit = unit_vectors([raw[i] for i in at], kind)
                row, cell, home = cells(unit, [labels[i] for i in at])
                own = pa.array(np.array(at)[row])
                arrays = [pa.array(cell), pa.array(home), b["key"].take(own), b["vector"].take(own)]
                yield pa.RecordBatch.from_arrays(arrays, ["cell", "home", "key", "vector"])

    inside = materialize(classes.select("key", "vector", "label").mapInArrow(hashed, "cell long, home boolean, key binary, vector binary"), "cells")
    sizes = inside.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("used")).filter("size > 1 AND used").drop("used")

    def link(batches):
        for t in units(batches, "cell"):
            left, right = _linked(t, threshold, kind) if t.num_rows > 1 else ([], [])
            if not len(left):
                continue
            root, keys = forest(t.num_rows, left, right), t["key"].combine_chunks()
            node = np.flatnonzero(root != np.arange(t.num_rows))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(node)), keys.take(pa.array(root[node]))], ["a", "b"])

    links = in_blocks(inside.join(sizes, "cell"), "cell", "size", "key", BLOCK).mapInArrow(link, "a binary, b binary")
    groups = materialize(components(links.distinct()).withColumnRenamed("node", "key"), "vector-groups")
    members = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root").join(classes.select("key", "vector", "copies"), "key")

    def count(batches):
        for t in units(batches, "root"):
            left, right = _linked(t, threshold, kind)
            copies, n = t["copies"].to_numpy(), t.num_rows
            found = np.bincount(left, copies[right], n) + np.bincount(right, copies[left], n)
            yield pa.RecordBatch.from_arrays([t["key"].combine_chunks(), pa.array(found.astype(np.int64))], ["key", "links"])

    counted = in_blocks(members, "root", "size", "key", BLOCK).mapInArrow(count, "key binary, links long")
    totals = counted.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.drop("vector", "label").join(totals, "key", "left").join(groups, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = materialize(known, "vector-known")
    heads = known.groupBy("root").agg(F.min("first").alias("head"))
    facts = known.join(heads, "root").select("key", "copies", "links", F.col("head.vec_id").alias("head"))
    out = rows.select("vec_id", "key").join(facts, "key", "left")
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("head"))
    return out.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of near duplicates among the embeddings of each label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
