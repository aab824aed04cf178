"""Nearest waypoint by tiles with bounds.

Waypoints are packed into tiles, level by level: the quantiles of x cut a tile into
slices, those of y the slices into children, until a tile holds few waypoints. Every
tile knows its box. A point first goes down to one leaf, at each level into the child
whose box is nearest; the nearest waypoint there bounds the true distance. Then it
goes down again into every child whose box is not farther than that bound, and meets
the waypoints of those leaves only. A point far outside still meets the tiles that
face it, clusters make more levels, and no step pairs points with all waypoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize, tasks

#: Most slices along an axis when a tile is cut, and waypoints a leaf should hold.
FAN, LEAF = 4, 32


def _finite(column: str) -> Column:
    return F.coalesce(F.abs(F.col(column)) < float("inf"), F.lit(False)) & ~F.isnan(column)


def _cut(rows: DataFrame, axis: str, slices: int) -> DataFrame:
    """``rows`` with each large node cut along ``axis`` by its own quantiles; equal values stay together."""
    at = [k / slices for k in range(1, slices)]
    cuts = rows.groupBy("node").agg(F.percentile_approx(axis, at, 1000).alias("cuts"), F.count(F.lit(1)).alias("n"))
    own = F.size(F.filter("cuts", lambda c: c < F.col(axis)))
    part = F.when(F.col("n") > LEAF, own).otherwise(F.lit(0))
    return rows.join(cuts, "node").withColumn("node", F.col("node") * FAN + part).drop("cuts", "n")


def _levels(marks: DataFrame, count: int) -> tuple[list[DataFrame], DataFrame]:
    """(parent, children with their boxes) of every level from the root down, and (node, marks) of the leaves.

    Distinct places can always be cut further, so a level follows while some tile is
    large. The driver sees the size of the largest one a level.
    """
    rows, levels, biggest = marks.withColumn("node", F.lit(0).cast("long")), [], count
    while biggest > 2 * LEAF:
        slices = min(FAN, max(2, round((biggest / LEAF) ** 0.5)))
        rows = materialize(_cut(_cut(rows, "x", slices), "y", slices), "tiles")
        box = [f(c).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max)]
        boxes = materialize(rows.groupBy("node").agg(*box, F.count(F.lit(1)).alias("n")), "boxes")
        child = F.struct("node", "min_x", "max_x", "min_y", "max_y")
        levels.append(boxes.groupBy(F.expr(f"node div {FAN * FAN}").alias("parent")).agg(F.collect_list(child).alias("children")))
        biggest = boxes.agg(F.max("n")).first()[0]
    # at most 2 * LEAF marks a node, which the loop has measured
    return levels, rows.groupBy("node").agg(F.collect_list(F.struct("x", "y", "idx")).alias("marks"))


def _apart(low: Column, high: Column, at: Column) -> Column:
    """How far a coordinate lies outside a range."""
    return F.greatest(low - at, at - high, F.lit(0.0))


def _to_box(box: Column) -> Column:
    """Squared distance to a box: at most that of any waypoint in it, also as rounded."""
    dx, dy = _apart(box["min_x"], box["max_x"], F.col("px")), _apart(box["min_y"], box["max_y"], F.col("py"))
    return dx * dx + dy * dy


def _to_mark(mark: Column) -> Column:
    dx, dy = F.col("px") - mark["x"], F.col("py") - mark["y"]
    return dx * dx + dy * dy


def _below(rows: DataFrame, levels: list[DataFrame], depth: int) -> DataFrame:
    """``rows`` beside the children of their node; the root is one row."""
    table = F.broadcast(levels[depth]) if depth == 0 else levels[depth]
    return rows.join(table, F.col("node") == F.col("parent")).drop("parent", "node")


def nearest_point(points: DataFrame, waypoints: DataFrame, key: str = "zone") -> DataFrame:
    """Nearest waypoint of each point: ``key``, idx and d2, the squared distance (lowest idx on a tie).

    Points without two finite coordinates have no row, waypoints without them are
    not met, and without waypoints there are no rows.
    """
    places = waypoints.select("idx", F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
    places = places.where(_finite("x") & _finite("y")).groupBy("x", "y").agg(F.min("idx").alias("idx"))
    marks = materialize(places, "marks")
    count = marks.count()
    asked = points.select(F.col("lon").cast("double").alias("px"), F.col("lat").cast("double").alias("py"))
    # a few bytes a point and much work: spread by number, not by size (by a key of its own, or the two shuffles become one)
    asked = asked.where(_finite("px") & _finite("py")).distinct().repartition(tasks(points.sparkSession), F.xxhash64("px", "py"))
    asked = asked.withColumn("node", F.lit(0).cast("long"))
    if not count:
        return points.limit(0).select(key, F.lit(None).cast(marks.schema["idx"].dataType).alias("idx"), F.lit(None).cast("double").alias("d2"))
    levels, leaves = _levels(marks, count)
    if levels:
        leaves = materialize(leaves, "leaves")
    first = asked
    for depth in range(len(levels)):
        nearest = F.array_min(F.transform("children", lambda c: F.struct(_to_box(c).alias("d"), c["node"].alias("node"))))
        # never null, so the next join has no reason to work it out once more for a filter
        first = _below(first, levels, depth).withColumn("node", F.coalesce(nearest["node"], F.lit(-1))).drop("children")
    bound = F.array_min(F.transform("marks", lambda m: F.struct(_to_mark(m).alias("d2"), m["idx"].alias("idx"))))
    best = first.join(leaves if levels else F.broadcast(leaves), "node").select("px", "py", bound.alias("b"))
    if levels:
        every = materialize(best, "bounds").select("px", "py", F.col("b.d2").alias("bound"), F.lit(0).cast("long").alias("node"))
        for depth in range(len(levels)):
            near = F.transform(F.filter("children", lambda c: _to_box(c) <= F.col("bound")), lambda c: c["node"])
            every = _below(every, levels, depth).withColumn("node", F.explode(near)).drop("children")
        met = every.join(leaves, "node").select("px", "py", bound.alias("b"))
        best = met.groupBy("px", "py").agg(F.min("b").alias("b"))
    found = best.select(F.col("px").alias("__px"), F.col("py").alias("__py"), F.col("b.idx").alias("idx"), F.col("b.d2").alias("d2"))
    on = (F.col("lon").cast("double") == F.col("__px")) & (F.col("lat").cast("double") == F.col("__py"))
    return points.select(key, "lon", "lat").join(found, on).select(key, "idx", "d2")
