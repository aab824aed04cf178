"""Join of documents on the Jaccard similarity of their word n-grams, with Bayesian pruning.

1. Equal texts are one class; only classes take part from here on.
2. 128 MinHash values a class, in 32 bands of 4: two classes at similarity 0.8 miss
   each other in all bands with a probability of 5e-8.
3. Classes that meet in a band are compared 16 MinHash values at a time. Under a
   uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1);
   a pair goes as soon as its chance of 0.8 or more falls below ``TOLERANCE``.
   A task keeps a spanning forest of the pairs that live, not the pairs.
4. The forests' components are clusters: every pair that lived is inside one. Each
   cluster is read once, with its n-grams: pairs are pruned as before and the rest
   verified exactly. A task gives a class its number of links, and a spanning
   forest of them.

Large buckets and clusters are cut into blocks of bounded size by a hash, and each pair of blocks is one unit of work, so no task holds a whole group and
no pair becomes a row. Units of one key come one after the other in a sorted
partition and are worked off as they stream by.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.blocks import block_pairs, forest, in_blocks, units
from tidewatch.llm.common import components, materialize, remembering, small_batches, source, table, text_key, unused
from tidewatch.llm.decontaminate import words

WORDS, THRESHOLD = 5, 0.8
HASHES, BANDS, STEP = 128, 32, 16
TOLERANCE = 1e-6
#: Members of a block: of MinHash values while pruning, of whole n-gram sets while verifying.
PRUNE_BLOCK, BLOCK = 512, 128
CACHE_WORDS = 250_000

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MIX = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[-1]
    return h ^ (h >> np.uint64(29))


class Shingler(dict):
    """Distinct 64-bit hashes of the n-grams of texts; maps words already met to their hashes."""

    def __init__(self, width: int):
        super().__init__()
        self.width = width

    forget = dict.clear

    def __missing__(self, word: str) -> int:
        digest = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        found = self[word] = int.from_bytes(digest, "little")
        return found

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted. A text of fewer words than ``width`` is one n-gram; without words it has none."""
        w = words(text)
        if not w:
            return np.zeros(0, np.uint64)
        if len(self) > CACHE_WORDS:
            self.forget()
        ids = np.fromiter(map(self.__getitem__, w), np.uint64, len(w))
        n = min(self.width, len(ids))
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            h = _mixed(h + ids[k : len(ids) - n + 1 + k] * _MIX[0]) + _MIX[1]
        return np.unique(h)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """128 values of 32 bits, in chunks so that a long text needs no large matrix."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[None, i : i + 1024] * _A[:, None] + _B[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, fewest matches among the first n values with which a pair lives on)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(similarity >= t) under Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m).
        below, m = 0.0, 0
        for m in range(n + 1):  # noqa: B007
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
        out.append((n, m))
    return out


def living(sigs: np.ndarray, left: np.ndarray, right: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left, right) that incremental comparison does not drop."""
    matches, done = np.zeros(len(left), np.int64), 0
    for n, least in needed:
        if not len(left):
            break
        matches += (sigs[left, done:n] == sigs[right, done:n]).sum(axis=1)
        stay = matches >= least
        left, right, matches, done = left[stay], right[stay], matches[stay], n
    return left, right


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """uid, doc_id, key and MinHash values (null without words) of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", text_key(F.col("text")).alias("key"), "text")
    schema = rows.drop("text").withColumn("sig", F.lit(None).cast("binary")).schema

    def sign(batches):
        with remembering("shingler", width, lambda: Shingler(width)) as shingler:
            for b in batches:
                found = [shingler.shingles(t) for t in b["text"].to_pylist()]
                sigs = pa.array([minhash(s).astype("<u4").tobytes() if len(s) else None for s in found], pa.binary())
                yield pa.RecordBatch.from_arrays([b["uid"], b["doc_id"], b["key"], sigs], ["uid", "doc_id", "key", "sig"])

    return rows.mapInArrow(sign, schema)


def candidate_clusters(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(key, cluster) of the classes that some pair survives pruning with."""
    spark = classes.sparkSession
    per = HASHES // BANDS

    def bands(batches):
        salt = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[2]
        for b in batches:
            if not b.num_rows:
                continue
            s = _signatures(b["sig"]).astype(np.uint64).reshape(-1, BANDS, per)
            h = np.broadcast_to(salt, s.shape[:2]).copy()
            for k in range(per):
                h = _mixed(h + s[:, :, k] * _MIX[3])
            keys = b["key"].take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), keys], ["bucket", "key"])

    rows = classes.select("key", "sig").mapInArrow(bands, "bucket long, key binary")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = rows.join(shared, "bucket").join(classes.select("key", "sig"), "key")
    needed = needed_matches(threshold)

    def prune(batches):
        for t in units(batches, "bucket"):
            if t.num_rows < 2:
                continue
            low, high = t["low"][0].as_py(), t["high"][0].as_py()
            left, right = living(_signatures(t["sig"]), *block_pairs(t["block"].to_numpy(), low, high), needed)
            if not len(left):
                continue
            root = forest(t.num_rows, left, right)
            node = np.flatnonzero(root != np.arange(t.num_rows))
            keys = t["key"].combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(node)), keys.take(pa.array(root[node]))], ["a", "b"])

    small_batches(spark)
    links = in_blocks(met, "bucket", "size", "key", block).mapInArrow(prune, "a binary, b binary")
    return components(links.distinct()).withColumnRenamed("node", "key").withColumnRenamed("root", "cluster")


def verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """A row for each class and unit: its linked documents and classes, and a class its forest links it to."""
    spark = docs.sparkSession
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    members = clusters.join(sizes, "cluster").join(classes.select("key", "sig", "copies"), "key")
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    schema = "key binary, cluster binary, size long, sig binary, copies long, shingles binary"

    def shingle(batches):
        with remembering("shingler", width, lambda: Shingler(width)) as shingler:
            for b in batches:
                found = pa.array([shingler.shingles(t).tobytes() for t in b["text"].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(b[c] for c in ("key", "cluster", "size", "sig", "copies")), found], ["key", "cluster", "size", "sig", "copies", "shingles"]
                )

    small_batches(spark)
    full = members.join(texts, "key").select("key", "cluster", "size", "sig", "copies", "text").mapInArrow(shingle, schema)
    full = materialize(full, "near-members")
    needed = needed_matches(threshold)

    def verify(batches):
        for t in units(batches, "cluster"):
            n, low, high = t.num_rows, t["low"][0].as_py(), t["high"][0].as_py()
            left, right = living(_signatures(t["sig"]), *block_pairs(t["block"].to_numpy(), low, high), needed)
            sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            left, right = exact(sets, left, right, threshold)
            if not len(left):
                continue
            copies = t["copies"].to_numpy()
            docs_linked = np.bincount(left, copies[right], n) + np.bincount(right, copies[left], n)
            classes_linked = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
            root, keys = forest(n, left, right), t["key"].combine_chunks()
            node = np.flatnonzero(classes_linked)
            columns = [
                keys.take(pa.array(node)),
                pa.array(docs_linked[node].astype(np.int64)),
                pa.array(classes_linked[node].astype(np.int64)),
                keys.take(pa.array(root[node])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "docs", "classes", "root"])

    work = in_blocks(full, "cluster", "size", "key", block)
    return work.mapInArrow(verify, "key binary, docs long, classes long, root binary")


def exact(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets have a Jaccard similarity of at least ``threshold``."""
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    stay = np.zeros(len(left), bool)
    cuts = np.flatnonzero(np.diff(left)) + 1
    for part in np.split(np.arange(len(left)), cuts):
        if not len(part):
            continue
        own, others = sets[left[part[0]]], [sets[j] for j in right[part]]
        sizes = np.array([len(o) for o in others])
        every = np.concatenate(others)
        at = np.searchsorted(own, every)
        hit = own[np.minimum(at, len(own) - 1)] == every
        common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        # Whole numbers, so that a similarity of exactly the threshold counts.
        stay[part] = common * 1000 >= round(threshold * 1000) * (len(own) + sizes - common)
    return left[stay], right[stay]


def near_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WORDS,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    prune_block: int = PRUNE_BLOCK,
) -> DataFrame:
    """Each row's class, links and group of near duplicates.

    doc_id, class_id (smallest id of an equal text), n_links (other rows with a
    similarity of ``threshold`` or more, copies included), component_id (smallest id
    that links reach), kept (one row of each group: that of the smallest id, the
    first such row where ids repeat) and key (:func:`text_key`).

    Words are :func:`~tidewatch.llm.decontaminate.words`. Rows without words link with
    nothing and are kept. Null ids count as larger than all others.
    """
    docs = source(docs, doc_id=doc_id, text=text)
    rows = materialize(signed(docs, width), "near-rows")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
    classes = (
        rows.filter("sig IS NOT NULL")
        .groupBy("key")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    )
    classes = materialize(classes, "near-classes")
    clusters = materialize(candidate_clusters(classes, threshold, prune_block), "near-clusters")
    found = materialize(verified(docs, classes, clusters, width, threshold, block), "near-links")
    groups = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("classes").alias("classes"))
    known = classes.drop("sig").join(counts, "key", "left").join(groups.withColumnRenamed("node", "key"), "key", "left")
    known = materialize(known.withColumn("root", F.coalesce("root", "key")), "near-known")
    heads = known.groupBy("root").agg(F.min("first").alias("head"))
    facts = known.join(heads, "root").select(
        "key",
        F.col("first.doc_id").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
        F.coalesce("classes", F.lit(0)).alias("n_class_links"),
        F.col("head.doc_id").alias("component_id"),
        F.col("head.uid").alias("head_uid"),
    )
    out = rows.select("uid", "doc_id", "key").join(facts, "key", "left")
    return out.select(
        "doc_id",
        F.when(F.col("head_uid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_class_links", F.lit(0)).cast("long").alias("n_class_links"),
        F.when(F.col("head_uid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("uid") == F.col("head_uid"), F.lit(True)).alias("kept"),
        "key",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns kept.

    The row that stays is the one with the group's smallest id. Rows alike in id and
    text are told apart by nothing, so one of them stays if their group keeps that id;
    rows without words all stay.
    """
    decided = near_groups(docs, doc_id, text, **options).filter("kept")
    key, own, nth = (unused(docs, name) for name in ("__key", "__id", "__nth"))
    stay = decided.select(F.col("key").alias(key), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(own)).distinct()
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    keyed = docs.withColumn(key, text_key(F.col(text))).withColumn(own, F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    rows = keyed.join(stay, [key, own], "left_semi")
    rows = rows.withColumn(nth, F.when(wordless, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return rows.dropDuplicates([key, own, nth]).select(*docs.columns)


def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among the documents: one row a document with its class, links and group."""
    return near_groups(table(spark, sf_dir, "documents")).drop("key")
