"""Paths along the waypoints, trips of dispatched boats, positions and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import boats, heading_deg, lerp, start_offset_ms
from tidewatch.operators.joins import home_zones
from tidewatch.operators.scans import running_before

# Playback loop, trip length, boats of a trip without a list, map bounds.
LOOP_MS, DURATION_MS, SPARE_BOATS = 30_000, 8_000, 3
BOUNDS = {"lon": (-90.20, -89.95), "lat": (29.89, 29.97)}
POINTS_PER_CHUNK = WAYS_PER_CHUNK = 4096


def stitch(points: DataFrame, bounds: dict = BOUNDS, reverse: bool = True) -> DataFrame:
    """Polylines joined in way order into one numbered path per ``path_id``.

    ``points``: path_id, way (whole number), pos, lon, lat. A way's first point is dropped where
    it repeats the last point of the way before; points outside the bounds are
    cut; numbering starts at the far end when reversed.
    """
    one = {"__n": F.lit(1).cast("long")}
    ends = points.groupBy("path_id", "way").agg(
        F.min(F.struct("pos", "lon", "lat")).alias("first"), F.max(F.struct("pos", "lon", "lat")).alias("last")
    )
    # ways are numbered in order, and each meets the one before by its number
    numbered = running_before(ends, ["path_id"], ["way"], F.floor(F.col("way") / WAYS_PER_CHUNK), one)
    before = numbered.select("path_id", (F.col("__n") + 1).alias("__n"), F.col("last").alias("__b"))
    joint = (
        numbered.join(before, ["path_id", "__n"])
        .where((F.col("__b.lon") == F.col("first.lon")) & (F.col("__b.lat") == F.col("first.lat")))
        .select("path_id", "way", F.col("first.pos").alias("pos"))
    )
    kept = points.join(joint, ["path_id", "way", "pos"], "left_anti").where(
        F.col("lon").between(*bounds["lon"]) & F.col("lat").between(*bounds["lat"])
    )
    # (way, block of positions) is a chunk that grows along the path
    chunk = F.struct("way", F.floor(F.col("pos") / POINTS_PER_CHUNK))
    kept = running_before(
        kept, ["path_id"], ["way", "pos"], chunk, one, True, lambda c: F.floor(c.getField("way") / WAYS_PER_CHUNK)
    )
    idx = F.col("__n_total") - 1 - F.col("__n") if reverse else F.col("__n")
    return kept.select("path_id", idx.alias("idx"), "lon", "lat")


def paths(pairs: DataFrame, stops: DataFrame, waypoints: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """Waypoints between two zones in travel order, as rows (``seq`` from 0).

    No rows for equal or unmapped zones. The stretch is unrolled into its
    indices, so the waypoints are met by an equality join.
    """
    a = stops.select(F.col("zone").alias(origin), F.col("idx").alias("__a"))
    b = stops.select(F.col("zone").alias(destination), F.col("idx").alias("__b"))
    stretch = pairs.join(a, origin).join(b, destination).where(F.col("__a") != F.col("__b"))
    steps = stretch.select(*pairs.columns, F.posexplode(F.sequence("__a", "__b")).alias("seq", "idx"))
    return steps.join(waypoints.select("idx", "lon", "lat"), "idx")


def with_progress(path: DataFrame, trip: list[str]) -> DataFrame:
    """Share of the distance covered at each point (0 at the first)."""
    order = Window.partitionBy(*trip).orderBy("seq")
    dx, dy = F.col("lon") - F.lag("lon").over(order), F.col("lat") - F.lag("lat").over(order)
    seg = path.withColumn("__len", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    whole = F.sum("__len").over(Window.partitionBy(*trip))
    part = F.col("__len") / F.when(F.col("__whole") == 0, F.lit(1.0)).otherwise(F.col("__whole"))
    return (
        seg.withColumn("__whole", whole)
        .withColumn("__part", part)
        .withColumn("share", F.sum("__part").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("__len", "__whole", "__part")
    )


def with_times(path: DataFrame, trip: list[str], start: Column, duration_ms: int = DURATION_MS) -> DataFrame:
    """Constant-speed time of each point in whole milliseconds, cut off (a millionth short of the next counts as it)."""
    return with_progress(path, trip).withColumn("t_ms", F.floor(F.round(start + F.col("share") * duration_ms, 6)).cast("long"))


def listed_boats(dispatches: DataFrame) -> DataFrame:
    """Boats named in ``dispatch_json``; items without an id are dropped."""
    items = dispatches.select("pickup_zone", "window_time", F.posexplode(boats("dispatch_json")).alias("item", "boat"))
    return items.where(F.coalesce(F.col("boat.vessel_id"), F.lit("")) != "").select(
        "pickup_zone", "window_time", "item", "boat.vessel_id"
    )


def trip_starts(dispatches: DataFrame, vessels: DataFrame, stops: DataFrame, spare: int = SPARE_BOATS) -> DataFrame:
    """(pickup_zone, window_time, vessel_id, origin) of each trip.

    Boats listed by the dispatch with a mapped home in another zone. A dispatch
    without any such boat gets the first ``spare`` vessels by id that are not
    based in its zone. For those, the ``2 * spare`` lowest ids are enough once each
    home zone has given its first ``spare``: at most ``spare`` of them are of the
    dispatch's own zone.
    """
    mapped = stops.select("zone", "idx")
    to = dispatches.join(mapped.select(F.col("zone").alias("pickup_zone"), F.col("idx").alias("__to")), "pickup_zone")
    homes = home_zones(vessels).join(mapped.select(F.col("zone").alias("base_zone"), F.col("idx").alias("__from")), "base_zone")

    listed = listed_boats(to).join(homes, "vessel_id")
    listed = listed.join(mapped.select(F.col("zone").alias("pickup_zone"), F.col("idx").alias("__to")), "pickup_zone")
    usable = (
        listed.where(F.col("__from") != F.col("__to"))
        .select("pickup_zone", "window_time", "vessel_id", F.col("base_zone").alias("origin"))
        .distinct()
    )

    first = F.row_number().over(Window.partitionBy("base_zone").orderBy("vessel_id"))
    short = homes.withColumn("__rn", first).where(F.col("__rn") <= spare)
    choice = short.orderBy("vessel_id", "base_zone").limit(2 * spare).agg(
        F.array_sort(F.collect_list(F.struct("vessel_id", "base_zone", "__from"))).alias("c")
    ).scalar()
    bare = to.join(usable.select("pickup_zone", "window_time").distinct(), ["pickup_zone", "window_time"], "left_anti")
    other = bare.withColumn("__choice", choice).select(
        "pickup_zone",
        "window_time",
        "__to",
        F.explode(F.slice(F.filter("__choice", lambda v: v["base_zone"] != F.col("pickup_zone")), 1, spare)).alias("v"),
    )
    made_up = other.where(F.col("v.__from") != F.col("__to")).select(
        "pickup_zone", "window_time", F.col("v.vessel_id").alias("vessel_id"), F.col("v.base_zone").alias("origin")
    )
    return usable.unionByName(made_up)


TRIP = ["pickup_zone", "window_time", "vessel_id"]


def trips(
    dispatches: DataFrame, vessels: DataFrame, stops: DataFrame, waypoints: DataFrame, loop_ms: int = LOOP_MS, duration_ms: int = DURATION_MS
) -> DataFrame:
    """Trips as timed path points: the trip keys, origin, seq, lon, lat, share, t_ms."""
    starts = trip_starts(dispatches, vessels, stops)
    path = paths(starts, stops, waypoints, origin="origin", destination="pickup_zone")
    return with_times(path, [*TRIP, "origin"], start_offset_ms("vessel_id", loop_ms, duration_ms), duration_ms)


def positions(points: DataFrame, at_ms: int, trip: list[str] = TRIP) -> DataFrame:
    """Where each active trip is at a time: lon, lat, heading. The first matching
    segment counts when the time falls on a point."""
    order = Window.partitionBy(*trip).orderBy("seq")
    nxt = {f"__{c}": F.lead(c).over(order) for c in ("lon", "lat", "t_ms")}
    seg = points.withColumns(nxt).where(F.col("__t_ms").isNotNull() & F.lit(at_ms).between(F.col("t_ms"), F.col("__t_ms")))
    one = seg.groupBy(*trip).agg(
        F.min(F.struct("seq", "lon", "lat", "t_ms", "__lon", "__lat", "__t_ms")).alias("s")
    )
    s = F.col("s")
    share = (F.lit(at_ms) - s["t_ms"]) / F.greatest(s["__t_ms"] - s["t_ms"], F.lit(1))
    return one.select(
        *trip,
        lerp(s["lon"], s["__lon"], share).alias("lon"),
        lerp(s["lat"], s["__lat"], share).alias("lat"),
        heading_deg(s["__lon"] - s["lon"], s["__lat"] - s["lat"]).alias("heading"),
    )


def zone_markers(coordinates: DataFrame, active: DataFrame) -> DataFrame:
    """One marker per coordinate, active if any name of it is.

    ``coordinates``: zone, lon, lat in display order ``ord``; ``active``: zone.
    """
    flags = active.select("zone").distinct().withColumn("__on", F.lit(True))
    named = coordinates.join(flags, "zone", "left")
    return named.groupBy("lon", "lat").agg(
        F.min_by("zone", "ord").alias("name"), F.coalesce(F.bool_or("__on"), F.lit(False)).alias("is_active")
    )
