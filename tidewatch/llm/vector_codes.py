"""Vector codes by Lloyd's rounds on cover trees.

Every component becomes a whole number, every vector eight equal parts, every part
position a codebook. Spark cuts the vectors into chunks once, and each chunk gets
one cover tree a part position over its distinct sub-vectors, written down with
their cumulative sums. A round reads the trees with the codebooks:

- an entry goes from a node's list once it is farther from the node's centre than
  the nearest entry by more than twice the node's radius (triangle inequality);
- a node with one entry left gives its whole subtree to it, as one difference of
  cumulative sums; an ambiguous node descends;
- at the leaves the entries left are compared exactly, in whole numbers.

A task sends one row an entry, so the driver sees ``PARTS * ENTRIES`` rows a round
whatever the table. A vector that a third of the rows share is one point of a tree.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, source, table, tasks

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this have squared distances that a long can't hold.
LARGEST = 1 << 14
#: Vectors of a chunk, points of a leaf, and how much smaller the cover of a node's children is.
CHUNK, LEAF, SHRINK = 2048, 8, 2.0
#: More than the rounding of a square root.
_SLACK = 1e-12


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, in whole numbers."""
    return (points * points).sum(axis=1)[:, None] - 2 * (points @ book.T) + (book * book).sum(axis=1)[None, :]


class CoverTree:
    """A cover tree over distinct whole-number points that stand for ``weights`` rows each.

    A node's points are ``order[lo:hi]``, its centre is one of them and its radius
    reaches the farthest. Children's centres are farther from each other than the
    cover radius (the node's by ``SHRINK``), and every point is within it of its
    child's centre.
    """

    def __init__(self, points: np.ndarray, weights: np.ndarray):
        order = np.arange(len(points))
        start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
        centre, lo, hi, first, kids, radius, at = [start], [0], [len(points)], [0], [0], [0.0], 0
        while at < len(centre):
            own = order[lo[at] : hi[at]]
            spread = points[own]
            near = ((spread - points[centre[at]]) ** 2).sum(axis=1)
            far = int(near.max())
            radius[at] = float(np.sqrt(far)) * (1 + _SLACK)
            if len(own) > LEAF and far:
                cover, owner, centres = far / SHRINK**2, np.zeros(len(own), np.int64), [centre[at]]
                while near.max() > cover:
                    q = int(near.argmax())
                    centres.append(int(own[q]))
                    d = ((spread - spread[q]) ** 2).sum(axis=1)
                    closer = d < near
                    owner[closer], near = len(centres) - 1, np.minimum(near, d)
                order[lo[at] : hi[at]] = own[np.argsort(owner, kind="stable")]
                ends = lo[at] + np.cumsum(np.bincount(owner, minlength=len(centres)))
                first[at], kids[at] = len(centre), len(centres)
                centre += centres
                lo += [lo[at], *ends[:-1].tolist()]
                hi += ends.tolist()
                for column in (first, kids, radius):
                    column += [0] * len(centres)
            at += 1
        self.points, self.order, self.place = points[order].astype(np.int32), order, np.argsort(order)[centre]
        self.lo, self.hi, self.first, self.kids = (np.array(x, np.int32) for x in (lo, hi, first, kids))
        self.radius = np.array(radius, float)
        zero = np.zeros((1, points.shape[1]), np.int64)
        self.sums = np.concatenate([zero, np.cumsum(points[order] * weights[order][:, None], axis=0)])
        self.counts = np.concatenate([[0], np.cumsum(weights[order])])

    @classmethod
    def of(cls, state: dict) -> CoverTree:
        """The tree whose ``vars()`` were written down."""
        tree = cls.__new__(cls)
        vars(tree).update(state)
        return tree

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges (lo, hi) of ``order`` and the entry nearest to all their points, ties to the lower one."""
        nodes, alive = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(nodes):
            d = np.sqrt(squared(self.points[self.place[nodes]].astype(np.int64), book).astype(float))
            d[~alive] = np.inf
            nearest = d.min(axis=1, keepdims=True)
            reach = 2 * self.radius[nodes][:, None]
            alive &= d <= nearest + reach + _SLACK * (nearest + reach)
            sole = alive.sum(axis=1) == 1
            found.append((self.lo[nodes[sole]], self.hi[nodes[sole]], alive[sole].argmax(axis=1)))
            nodes, alive = nodes[~sole], alive[~sole]
            leaf = self.kids[nodes] == 0
            if leaf.any():
                at, which = spans(self.lo[nodes[leaf]], self.hi[nodes[leaf]])
                exact = squared(self.points[at].astype(np.int64), book)
                exact[~alive[leaf][which]] = np.iinfo(np.int64).max
                found.append((at, at + 1, exact.argmin(axis=1)))
            nodes, alive = nodes[~leaf], alive[~leaf]
            below, which = spans(self.first[nodes], self.first[nodes] + self.kids[nodes])
            nodes, alive = below, alive[which]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is from."""
    sizes = (hi - lo).astype(np.int64)
    which = np.repeat(np.arange(len(lo)), sizes)
    ahead = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return np.arange(int(sizes.sum())) - ahead[which] + lo[which], which


def whole_vectors(df: DataFrame) -> DataFrame:
    """vec_id, label and v, the components as whole numbers, of the rows that have codes."""
    good = F.forall("vector", lambda x: F.coalesce(F.abs(x) <= LARGEST, F.lit(False)) & ~F.isnan(x))
    v = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return df.filter(F.col("vector").isNotNull() & good).select("vec_id", "label", v.alias("v"))


def trees(rows: DataFrame, width: int) -> DataFrame:
    """Chunks of the vectors: ids, labels, and the trees with each vector's point in them."""
    if rows.rdd.getNumPartitions() < rows.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(tasks(rows.sparkSession))
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def chunk(batch: pa.Table) -> pa.RecordBatch:
        vectors = padded(batch["v"].combine_chunks(), width)
        made = []
        for part in np.split(vectors, PARTS, axis=1):
            points, where, weights = np.unique(part, axis=0, return_inverse=True, return_counts=True)
            tree = CoverTree(points.astype(np.int64), weights.astype(np.int64))
            made.append((vars(tree), where.reshape(-1).astype(np.int32)))
        ids, labels = (batch[c].combine_chunks() for c in ("vec_id", "label"))
        offsets = pa.array([0, batch.num_rows], pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, x) for x in (ids, labels)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(made, 5)], pa.binary())], ["ids", "labels", "trees"])

    def cut(batches):
        rest: list[pa.RecordBatch] = []
        for b in batches:
            rest.append(b)
            while sum(x.num_rows for x in rest) >= CHUNK:
                held = pa.Table.from_batches(rest)
                yield chunk(held.slice(0, CHUNK))
                rest = held.slice(CHUNK).to_batches()
        if sum(x.num_rows for x in rest):
            yield chunk(pa.Table.from_batches(rest))

    return rows.mapInArrow(cut, f"ids array<{id_type}>, labels array<{label_type}>, trees binary")


def padded(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows of ``width * PARTS`` numbers, zeros behind the shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width * PARTS), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out[row, np.arange(int(sizes.sum())) - start[row]] = column.flatten().to_numpy()
    return out


def lloyd(chunks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean, unused ones as they were."""
    width = books.shape[2]

    def sums(batches):
        total = np.zeros((PARTS, books.shape[1], width + 1), np.int64)
        for b in batches:
            for blob in b["trees"].to_pylist():
                for p, (state, _) in enumerate(pickle.loads(blob)):
                    tree = CoverTree.of(state)
                    lo, hi, entry = tree.assign(books[p])
                    np.add.at(total[p, :, 1:], entry, tree.sums[hi] - tree.sums[lo])
                    np.add.at(total[p, :, 0], entry, tree.counts[hi] - tree.counts[lo])
        part, entry = np.nonzero(total[:, :, 0])
        columns = [part.astype(np.int32), entry.astype(np.int32), *total[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = ["part", "entry", "n", *(f"s{k}" for k in range(width))]
    schema = "part int, entry int, " + ", ".join(f"{c} long" for c in names[2:])
    after = books.copy()
    totals = chunks.select("trees").mapInArrow(sums, schema).groupBy("part", "entry")
    for row in totals.agg(*[F.sum(c).alias(c) for c in names[2:]]).collect():  # PARTS * ENTRIES rows at most
        after[row["part"], row["entry"]] = [row[c] // row["n"] for c in names[3:]]
    return after


def coded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distance to the entries) of every vector."""
    id_type, label_type = (chunks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))
    digits = np.array([f"{k:02x}" for k in range(max(books.shape[1], 1))])

    def code(batches):
        for b in batches:
            for i, blob in enumerate(b["trees"].to_pylist()):
                text, error = None, 0
                for p, (state, where) in enumerate(pickle.loads(blob)):
                    tree = CoverTree.of(state)
                    lo, hi, entry = tree.assign(books[p])
                    at, which = spans(lo, hi)
                    own = np.zeros(len(tree.order), np.int64)
                    own[tree.order[at]] = entry[which]
                    far = np.zeros(len(own), np.int64)
                    far[tree.order] = ((tree.points - books[p][own[tree.order]]) ** 2).sum(axis=1)
                    names = digits[own[where]]
                    text, error = names if text is None else np.char.add(text, names), error + far[where]
                ids, labels = (b[c].slice(i, 1).flatten() for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(code, f"vec_id {id_type}, label {label_type}, code string, error long")


def compress(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of the vectors, and the codebooks (part, entry, component).

    Vectors that are null or hold a component that is null, not finite or beyond
    ``LARGEST`` have no code and no row. Shorter vectors are filled up with zeros to the
    longest one and to a multiple of ``PARTS``; an empty vector is all zeros. The first
    codebooks are the ``ENTRIES`` smallest ids, null ids last, equal ids by their
    vectors; fewer rows make fewer entries. Repeated rows are coded alike, each on its
    own. Other columns are dropped. An empty table has no rows and no entries.
    """
    rows = whole_vectors(source(df, vec_id=vec_id, vector=vector, label=label))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    width = max(-(-(longest or 0) // PARTS), 1)
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow()
    first = padded(head["v"].combine_chunks(), width) if head.num_rows else np.zeros((0, width * PARTS), np.int64)
    books = np.stack(np.split(first, PARTS, axis=1))
    chunks = materialize(trees(rows, width), "cover-trees")
    for _ in range(rounds if len(first) else 0):
        books = lloyd(chunks, books)
    return coded(chunks, books), books


def books_digest(books: np.ndarray) -> str:
    """Digest of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors, and the errors of their labels."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = materialize(codes, "vector-codes")
    by_label = codes.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("own"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def _round(k: int) -> str:
    """Two steps of one round: assignment to the books of round k, and the books after it."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT r, p, min(d * {ENTRIES} + e) % {ENTRIES} AS e, min(d) AS d FROM (
    SELECT s.r, s.p, b.e, sum((s.x - b.x) * (s.x - b.x)) AS d FROM parts s JOIN book{k} b ON s.p = b.p AND s.i = b.i GROUP BY s.r, s.p, b.e)
  GROUP BY r, p),
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT s.p, n.e, s.i, (sum(s.x) - ((sum(s.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
    FROM parts s JOIN near{k} n ON s.r = n.r AND s.p = n.p GROUP BY s.p, n.e, s.i) m ON b.p = m.p AND b.e = m.e AND b.i = m.i),"""


OP11_SQL = f"""
WITH whole AS (
  SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r FROM whole),
spread AS (SELECT r, len(v) // {PARTS} AS w, unnest(v) AS x, unnest(range(len(v))) AS k FROM numbered),
parts AS MATERIALIZED (SELECT r, k // w AS p, k % w AS i, x FROM spread),
book0 AS MATERIALIZED (SELECT p, r AS e, i, x FROM parts WHERE r < {ENTRIES}),{"".join(_round(k) for k in range(ROUNDS))}
final AS MATERIALIZED (
  SELECT r, p, min(d * {ENTRIES} + e) % {ENTRIES} AS e, min(d) AS d FROM (
    SELECT s.r, s.p, b.e, sum((s.x - b.x) * (s.x - b.x)) AS d FROM parts s JOIN book{ROUNDS} b ON s.p = b.p AND s.i = b.i GROUP BY s.r, s.p, b.e)
  GROUP BY r, p),
codes AS (SELECT r, string_agg(lower(printf('%02x', CAST(e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM final GROUP BY r)
SELECT n.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY n.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{ROUNDS}) AS codebooks_sha256
FROM numbered n JOIN codes c ON n.r = c.r"""
