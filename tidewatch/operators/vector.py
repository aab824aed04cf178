"""Vector search: exact, filtered, and by cells; knowledge chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialize

#: Rows of a block while there are few blocks, and values (rows times dimensions) of the largest one.
BLOCK, BLOCK_VALUES = 2048, 2**22
#: Rows of the two sides that are multiplied at once in a task.
QUERY_ROWS, ITEM_ROWS = 1024, 4096
#: Differences (rows times centres times dimensions) that a task holds at once.
GAPS = 2**18
DIGITS = 9


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    """:func:`_unit` of vectors from Arrow; a part of the rows at a time, so that little is held besides the result."""
    sizes = pc.unique(pc.list_value_length(vectors))
    if len(sizes) != 1:
        raise ValueError("all vectors must have the same length")
    m, at = np.empty((len(vectors), sizes[0].as_py())), 0
    for chunk in vectors.chunks:
        for low in range(0, len(chunk), ITEM_ROWS):
            part = chunk[low : low + ITEM_ROWS]
            flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            norm = np.linalg.norm(flat, axis=1, keepdims=True)
            m[at : at + len(part)] = flat / np.where(norm == 0, 1, norm)
            at += len(part)
    return m


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _distances(units: np.ndarray, centres: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, their distances to all centres), for a few rows at a time: as many as keep the differences under ``GAPS``."""
    step = max(1, GAPS // max(1, centres.size))
    for low in range(0, len(units), step):
        rows = slice(low, low + step)
        yield rows, np.linalg.norm(units[rows, None, :] - centres[None], axis=2)


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best columns per row; ties go to the lower
    column. ``scores`` is used up."""
    k = min(k, scores.shape[1])
    rows = np.arange(len(scores))
    cols, best = np.empty((len(scores), k), dtype=np.int64), np.empty((len(scores), k))
    for place in range(k):
        cols[:, place] = scores.argmax(axis=1)
        best[:, place] = scores[rows, cols[:, place]]
        scores[rows, cols[:, place]] = -np.inf
    return np.repeat(rows, k), cols.ravel(), best.ravel()


def _kept(k: int, rows: int, r: np.ndarray, c: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, scores) of the k best candidates of each row, best first; places without one hold column -1.
    A score that is no number counts as the highest, as Spark sorts it."""
    key = np.where(np.isnan(score), np.inf, score)
    order = np.lexsort((c, -key, r))
    r, c, score = r[order], c[order], score[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    best = place < k
    cols, scores = np.full((rows, k), -1, dtype=np.int64), np.full((rows, k), -np.inf)
    cols[r[best], place[best]], scores[r[best], place[best]] = c[best], score[best]
    return cols, scores


def _near(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all pairs in double precision."""
    if metric == "cosine":
        return np.round(a @ b.T, DIGITS)
    s = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d : d + 1] - b[:, d]
        s -= np.square(gap, out=gap)
    return s


def _candidates(a32: np.ndarray, b32: np.ndarray, least: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(row, column) of the pairs that may be among the k best, by single precision, whose error
    is below ``slack``; ``least`` is each row's k-th best score so far. None if they are many."""
    near = a32 @ b32.T
    if k <= near.shape[1] and np.isinf(least).any():
        least = np.maximum(least, np.partition(near, near.shape[1] - k, axis=1)[:, -k] - slack)
    may = near >= (least - slack - 10.0**-DIGITS).astype(np.float32)[:, None]
    if np.count_nonzero(may) > may.size // 16:
        return None
    return np.divmod(np.flatnonzero(may), may.shape[1])


def _scored_pairs(
    a: np.ndarray, b: np.ndarray, a32: np.ndarray | None, b32: np.ndarray | None, least: np.ndarray, k: int, metric: str, slack: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the pairs that may be among the k best of their row; see :func:`_candidates`."""
    found = None if a32 is None else _candidates(a32, b32, least, k, slack)
    if found is None:
        return _top(_near(a, b, metric), k)
    r, c = found
    exact = (np.einsum("ij,ij->i", a[r[i : i + 65_536]], b[c[i : i + 65_536]]) for i in range(0, len(r), 65_536))
    return r, c, np.round(np.concatenate([np.empty(0), *exact]), DIGITS)


def _merged(cols: np.ndarray, scores: np.ndarray, r: np.ndarray, c: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_kept` of what is held so far and of further candidates."""
    n, k = cols.shape
    old = cols >= 0
    return _kept(k, n, np.concatenate([np.nonzero(old)[0], r]), np.concatenate([cols[old], c]), np.concatenate([scores[old], score]))


def _single(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray | None, np.ndarray | None, float]:
    """Both sides in single precision, if that may sort out pairs, and the bound of its error."""
    slack = 4 * (a.shape[1] + 4) * float(np.finfo(np.float32).eps)
    if metric != "cosine" or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return None, None, slack
    return a.astype(np.float32), b.astype(np.float32), slack


def _best_of_blocks(a: np.ndarray, b: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k best rows of ``b`` for each row of ``a``; ties go to the lower column.

    Products are taken piece by piece. For the cosine single precision sorts out what is
    certainly worse than the best so far; the others are scored in double precision.
    """
    a32, b32, slack = _single(a, b, metric)
    out = []
    for low in range(0, len(a), QUERY_ROWS):
        rows = slice(low, low + QUERY_ROWS)
        n = len(a[rows])
        cols, scores = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -np.inf)
        for at in range(0, len(b), ITEM_ROWS):
            items = slice(at, at + ITEM_ROWS)
            singles = (None, None) if a32 is None else (a32[rows], b32[items])
            r, c, s = _scored_pairs(a[rows], b[items], *singles, scores[:, -1], k, metric, slack)
            if len(r):
                cols, scores = _merged(cols, scores, r, c + at, s)
        held = cols >= 0
        out.append((np.nonzero(held)[0] + low, cols[held], scores[held]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _best_of_cells(
    a: np.ndarray, least: np.ndarray, open_: np.ndarray, b: np.ndarray, cell: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_best_of_blocks`, of the rows of ``b`` whose cell is open to the row of ``a``.

    ``open_``: row by cell; ``cell``: of each row of ``b``. What scores below ``least`` is left out.
    """
    a32, b32, slack = _single(a, b, "cosine")
    cols, scores = np.full((len(a), k), -1, dtype=np.int64), np.full((len(a), k), -np.inf)
    order = np.argsort(cell, kind="stable")
    edges = np.searchsorted(cell[order], np.arange(open_.shape[1] + 1))
    for start, end, mine in zip(edges, edges[1:], open_.T):
        members, queries = order[start:end], np.flatnonzero(mine)
        for at in range(0, len(members), ITEM_ROWS):
            items = members[at : at + ITEM_ROWS]
            for low in range(0, len(queries), QUERY_ROWS):
                rows = queries[low : low + QUERY_ROWS]
                singles = (None, None) if a32 is None else (a32[rows], b32[items])
                bound = np.maximum(least[rows], scores[rows, -1])
                r, c, s = _scored_pairs(a[rows], b[items], *singles, bound, k, "cosine", slack)
                may = ~(s < bound[r])
                if may.any():
                    cols[rows], scores[rows] = _merged(cols[rows], scores[rows], r[may], items[c[may]], s[may])
    held = cols >= 0
    return np.nonzero(held)[0], cols[held], scores[held]


def _ceil(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / size), F.lit(1)).cast("int")


def _grid(block_rows: int, tasks: int) -> tuple[Column, Column]:
    """Numbers of blocks of the queries and of the items, from __nq, __ni and __dim.

    As few as give ``tasks`` pairs of blocks, since every row is sent once for each block
    of the other side, and as many as keep a block under ``BLOCK_VALUES``.
    """
    most = F.greatest(F.lit(block_rows), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.col("__dim"), F.lit(1))))
    few_q, few_i = _ceil(F.col("__nq"), F.lit(block_rows)), _ceil(F.col("__ni"), F.lit(block_rows))
    side = F.lit(math.ceil(tasks**0.5))
    q = F.greatest(_ceil(F.col("__nq"), most), F.least(few_q, F.greatest(side, _ceil(F.lit(tasks), few_i))))
    return q, F.greatest(_ceil(F.col("__ni"), most), F.least(few_i, _ceil(F.lit(tasks), q)))


def best_pairs(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    group: str | None = None,
    metric: str = "cosine",
    block_rows: int = BLOCK,
) -> DataFrame:
    """(query_id, item_id, score) of the ``k`` best items of each query.

    ``queries``: query_id, vec [, group]; ``items``: item_id, vec [, group]. With
    a group only items of the query's group are compared.

    Both sides are cut by id hash into blocks, per group; each (query block, item
    block) is one task's work, which multiplies pieces of them and emits ``k`` rows per
    query. Blocks have about ``block_rows`` rows while that gives few pairs of blocks for
    each core, and grow up to ``BLOCK_VALUES`` values after that, so the vectors sent grow with the rows up
    to there, and beyond it with the rows times the number of such blocks; the comparisons
    grow with the pairs. No side is collected or broadcast, a group of any size is
    spread over its blocks, and no list of pairs exists.
    """
    tasks = 8 * queries.sparkSession.sparkContext.defaultParallelism
    size = lambda df: df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).alias("s")).scalar()
    if group is None:
        queries, items, group = queries.withColumn("__g", F.lit(0)), items.withColumn("__g", F.lit(0)), "__g"
        counts = {"__nq": size(queries)["n"], "__ni": size(items)["n"], "__dim": F.coalesce(size(items)["dim"], F.lit(1))}
        q, i = queries.withColumns(counts), items.withColumns(counts)
    else:
        n_q = queries.groupBy(group).agg(F.count(F.lit(1)).alias("__nq"))
        n_i = items.groupBy(group).agg(F.count(F.lit(1)).alias("__ni"), F.max(F.size("vec")).alias("__dim"))
        sizes = n_q.join(n_i, group)
        q, i = queries.join(sizes, group), items.join(sizes, group)
    q_blocks, i_blocks = _grid(block_rows, tasks)
    q = q.withColumns({"__qs": q_blocks, "__is": i_blocks})
    i = i.withColumns({"__qs": q_blocks, "__is": i_blocks})
    own_q = F.pmod(F.xxhash64("query_id"), F.col("__qs")).cast("int")
    own_i = F.pmod(F.xxhash64("item_id"), F.col("__is")).cast("int")
    q = q.select(
        "query_id", "vec", F.col(group).alias("g"), own_q.alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("__is") - 1)).alias("ib"),
    )
    i = i.select(
        "item_id", "vec", F.col(group).alias("g"), own_i.alias("ib"),
        F.explode(F.sequence(F.lit(0), F.col("__qs") - 1)).alias("qb"),
    )

    out = T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField("item_id", i.schema["item_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            none = [f.name for f in out.fields]
            return pd.DataFrame(columns=none).astype({"score": "float64"})
        right = right.sort_values("item_id", ignore_index=True)
        if metric == "cosine":
            a, b = _unit(left["vec"]), _unit(right["vec"])
        else:
            a, b = np.stack(left["vec"].to_numpy()).astype(float), np.stack(right["vec"].to_numpy()).astype(float)
        r, c, best = _best_of_blocks(a, b, k, metric)
        return pd.DataFrame(
            {"query_id": left["query_id"].to_numpy()[r], "item_id": right["item_id"].to_numpy()[c], "score": best}
        )

    cells = ["g", "qb", "ib"]
    part = q.groupBy(*cells).cogroup(i.groupBy(*cells)).applyInPandas(score, out)
    return best_of(part, k)


def best_of(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _nonzero(vec: str) -> Column:
    return F.exists(vec, lambda x: x != 0)


def _as_queries(df: DataFrame, group: Sequence[str] = (), vec: str = "embedding", key: str = "query_id") -> DataFrame:
    cols = [F.col(key).alias("query_id"), F.col(vec).alias("vec")]
    return df.where(F.col(vec).isNotNull() & _nonzero(vec)).select(*cols, *([F.struct(*group).alias("grp")] if group else []))


def _as_items(df: DataFrame, group: Sequence[str] = (), vec: str = "embedding", key: str = "document_id") -> DataFrame:
    cols = [F.col(key).alias("item_id"), F.col(vec).alias("vec")]
    return df.where(F.col(vec).isNotNull() & _nonzero(vec)).select(*cols, *([F.struct(*group).alias("grp")] if group else []))


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "query_id",
        F.col("item_id").alias("document_id"),
        "rank",
        F.col("score").alias("cosine"),
        ((1 + F.col("score")) / 2).alias("score"),
    )


def search(queries: DataFrame, kb: DataFrame, k: int = 3, match: Sequence[str] = (), block_rows: int = BLOCK) -> DataFrame:
    """Exact top-k by cosine as rows: query_id, document_id, rank, cosine, score.

    ``match`` names columns both sides hold (zone, impact, type): only documents
    equal in them are compared. Zero vectors take no part.
    """
    group = "grp" if match else None
    return _scored(best_pairs(_as_queries(queries, match), _as_items(kb, match), k, group, block_rows=block_rows))


def search_results(hits: DataFrame, kb: DataFrame, fields: Sequence[str] = ("chunk",)) -> DataFrame:
    """Hits as one array of structs per query, best first. At most k per query."""
    docs = kb.select("document_id", *fields)
    row = F.struct("rank", "document_id", "score", "cosine", *fields)
    return (
        hits.join(docs, "document_id", "left")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(row)).alias("search_results"))
    )


# -- cells ----------------------------------------------------------------------------


class Cells:
    """Vectors grouped round k-means centres of the unit sphere.

    The driver holds the centres and per-cell sizes and radii only: ``nlist`` rows,
    by default the square root of the number of vectors, so that finding the cells
    of a query and searching them cost about the same. Centres are fitted on all
    vectors, once written down with their unit form.
    """

    def __init__(self, kb: DataFrame, nlist: int | None = None, seed: int = 7):
        items = materialize(_as_items(kb).withColumn("unit", array_to_vector(_unit_sql("vec"))), "units")
        nlist = nlist or max(1, round(items.count() ** 0.5))
        model = KMeans(
            k=nlist, seed=seed, featuresCol="unit", predictionCol="cell", maxIter=5, initSteps=1, tol=1e-3
        ).fit(items.select("unit"))
        self.centres = np.array(model.clusterCenters())
        self.items = materialize(model.transform(items).select("item_id", "vec", "cell"), "cells")
        self.sizes = np.zeros(len(self.centres))
        self.radii = np.zeros(len(self.centres))
        far = self._distance_to_own(self.items).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r"))
        for row in far.toLocalIterator():
            self.sizes[row["cell"]], self.radii[row["cell"]] = row["n"], row["r"]

    def _distance_to_own(self, items: DataFrame) -> DataFrame:
        centres = self.centres

        @F.pandas_udf(T.DoubleType())
        def dist(vec: pd.Series, cell: pd.Series) -> pd.Series:
            return pd.Series(np.linalg.norm(_unit(vec) - centres[cell.to_numpy()], axis=1))

        return items.withColumn("d", dist("vec", "cell"))

    def probes(self, queries: DataFrame, candidates: int) -> DataFrame:
        """Nearest cells until they hold ``candidates`` vectors."""
        centres, sizes = self.centres, self.sizes

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def cells(vec: pd.Series) -> pd.Series:
            out = []
            for _, d in _distances(_unit(vec), centres):
                near = np.argsort(d, axis=1, kind="stable")
                held = np.cumsum(sizes[near], axis=1)
                out += [row[: int(np.searchsorted(h, candidates)) + 1].tolist() for row, h in zip(near, held)]
            return pd.Series(out)

        return queries.withColumn("probed", cells("vec"))

    def bins(self, rows: int) -> list[list[int]]:
        """Cells side by side in bins of about ``rows`` vectors; a larger cell has its place in several."""
        bins, held = [[]], 0.0
        for cell, n in enumerate(self.sizes):
            parts = math.ceil(n / rows)
            for _ in range(parts):
                if bins[-1] and held + n / parts > rows:
                    bins.append([])
                    held = 0.0
                bins[-1].append(cell)
                held += n / parts
        return bins

    def binned(self, bins: list[list[int]]) -> DataFrame:
        """The items with their bin and their cell's place in it."""
        places = [[] for _ in self.sizes]
        for b, held in enumerate(bins):
            for place, cell in enumerate(held):
                places[cell].append((b, place))
        spark = self.items.sparkSession
        table = spark.createDataFrame([(c, x) for c, x in enumerate(places) if x], "cell int, at array<struct<bin:int,place:int>>")
        part = F.pmod(F.xxhash64("item_id", "vec"), F.size("at")).cast("int")
        return self.items.join(table, "cell").withColumn("at", F.get("at", part)).select("item_id", "vec", "at.bin", "at.place")

    def remaining(self, queries: DataFrame, bins: list[list[int]]) -> DataFrame:
        """Cells not probed yet that may hold something as near as the k-th hit: for each bin
        the bits of its open cells, or null.

        A member lies within its cell's radius of the centre, so a cell whose
        centre is farther than radius + k-th distance cannot improve the result.
        """
        centres, radii, sizes = self.centres, self.radii, self.sizes
        # bits fill whole bytes of each bin; the spare ones stand for a cell that is never open
        bits = np.concatenate([np.append(np.array(b, dtype=int), [len(centres)] * (-len(b) % 8)) for b in bins]).astype(int)
        ends = np.cumsum([-(-len(b) // 8) for b in bins]).tolist()

        @F.pandas_udf(T.ArrayType(T.BinaryType()))
        def cells(vec: pd.Series, probed: pd.Series, kth: pd.Series) -> pd.Series:
            reach, out = np.sqrt(np.maximum(0, 2 - 2 * kth.to_numpy()))[:, None], []
            for rows, d in _distances(_unit(vec), centres):
                open_ = np.zeros((len(d), len(centres) + 1), dtype=bool)
                open_[:, :-1] = (d - radii <= reach[rows] + 1e-6) & (sizes > 0)
                for o, p in zip(open_, probed[rows]):
                    o[p] = False
                for packed in np.packbits(open_[:, bits], axis=1):
                    parts = [packed[start:end] for start, end in zip([0, *ends], ends)]
                    out.append([x.tobytes() if x.any() else None for x in parts])
            return pd.Series(out)

        return queries.withColumn("more", cells("vec", "probed", "kth"))


def _unit_sql(vec: str) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # bound as a lambda argument, the norm is taken once per row and not per element
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(vec, lambda x: x.cast("double") / n)), 1)


def search_cells(
    queries: DataFrame, cells: Cells, k: int = 3, candidates: int = 20, exact: bool = True, block_rows: int = BLOCK
) -> DataFrame:
    """Top-k through cells: the nearest cells holding ``candidates`` vectors first.

    With ``exact=True`` the cells that could still hold a better hit are searched
    too, so the result equals :func:`search`; ``False`` stops at the candidates,
    like an index with a candidate limit.
    """
    # each step that runs Python is written once; the block counts below re-read it
    probed = materialize(cells.probes(_as_queries(queries), candidates), "probed")
    first_q = probed.select("query_id", "vec", F.explode("probed").alias("cell"))
    first = best_pairs(first_q, cells.items, k, "cell", block_rows=block_rows).select("query_id", "item_id", "score")
    if not exact:
        return _scored(best_of(first, k))
    first = materialize(first, "hits")
    # The k-th best score so far bounds what is still worth looking at.
    bound = F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-1.0)).alias("kth")
    kth = first.groupBy("query_id").agg(bound)
    seen = probed.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(-1.0)))
    return _scored(best_of(first.unionByName(_open_pairs(seen, cells, k, block_rows)), k))


def _open_pairs(seen: DataFrame, cells: Cells, k: int, block_rows: int) -> DataFrame:
    """(query_id, item_id, score) of hits in the cells still open to a query, none worse than its ``kth``.

    Where a bound closes few cells, nearly all are open to each query. So a query is sent once
    for each bin of cells that has an open one, with the bits of the open ones, and an item once for each block
    of queries: as :func:`best_pairs` deals its blocks, but multiplying only what is open.
    """
    spark = seen.sparkSession
    tasks = 8 * spark.sparkContext.defaultParallelism
    n_items = int(cells.sizes.sum())
    counts = {"__nq": seen.count(), "__ni": n_items, "__dim": cells.centres.shape[1]}
    q_blocks, i_blocks = spark.range(1).select(*[F.lit(n).alias(name) for name, n in counts.items()]).select(*_grid(block_rows, tasks)).first()
    bins = cells.bins(math.ceil(n_items / i_blocks))
    rest = materialize(cells.remaining(seen, bins).select("query_id", "vec", "kth", "more"), "more")
    block = F.pmod(F.xxhash64("query_id", "vec"), F.lit(q_blocks)).cast("int")
    q = rest.select("query_id", "vec", "kth", block.alias("qb"), F.posexplode("more").alias("bin", "open")).where("open IS NOT NULL")
    i = cells.binned(bins).select("*", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    out = T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField("item_id", i.schema["item_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = lambda r, c: [left["query_id"].take(r), right["item_id"].take(c)]
        if not len(left) or not len(right):
            none = np.empty(0, dtype=np.int64)
            return pa.table([*ids(none, none), pa.array([], pa.float64())], out.names)
        right = right.take(pc.sort_indices(right, [("item_id", "ascending")], null_placement="at_start"))
        open_ = np.unpackbits(np.frombuffer(b"".join(left["open"].to_pylist()), np.uint8).reshape(len(left), -1), axis=1).astype(bool)
        kth = left["kth"].to_numpy()
        r, c, best = _best_of_cells(
            _units(left["vec"]), np.where(kth > -1, kth, -np.inf), open_, _units(right["vec"]), right["place"].to_numpy(), k
        )
        return pa.table([*ids(r, c), pa.array(best)], out.names)

    # pairs of a block and a bin take long and are few: more partitions than pairs, or several meet in one
    q, i = (side.repartition(2 * q_blocks * len(bins), "qb", "bin") for side in (q, i))
    return q.groupBy("qb", "bin").cogroup(i.groupBy("qb", "bin")).applyInArrow(score, out)


# -- chunks and freshness ----------------------------------------------------------------


def chunks(
    docs: DataFrame, text: str = "text", key: str = "document_id", size: int = 256, overlap: int = 32
) -> DataFrame:
    """Windows of ``size`` words, each sharing ``overlap`` with the one before.

    Keyed by (document, chunk_index). The last window is the one reaching the end.
    """
    step = size - overlap
    words = F.filter(F.split(F.col(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    n = F.size("__w")
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    pieces = F.transform(starts, lambda s: F.array_join(F.slice("__w", s + 1, F.lit(size)), " "))
    return (
        docs.select(key, words.alias("__w"))
        .where(n > 0)
        .select(key, F.posexplode(pieces).alias("chunk_index", "chunk"))
        .withColumn("n_words", F.size(F.split("chunk", " ")))
    )


def freshness(kb: DataFrame, current_model: str) -> DataFrame:
    """Rows and embedded rows per model version, and whether it is the current one."""
    return kb.groupBy("embedding_model", F.size("embedding").alias("embedding_dim")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count("embedding").alias("embedded"),
        F.max(F.col("embedding_model") == current_model).alias("is_current"),
    )
