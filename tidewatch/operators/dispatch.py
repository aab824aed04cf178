"""Vessel assignment for surges, and the rows it produces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidewatch.functions.prompts import dispatch_reason
from tidewatch.operators.keyed import upsert_merge
from tidewatch.operators.scans import running_before
from tidewatch.session import materialize, release

# Most boats per surge, and the state of a dispatched boat.
MAX_BOATS = 8
HIRED = "hired"
SURGE = ["pickup_zone", "window_time"]
#: Stops of the path in one chunk.
STOPS = 4096


def _numbered(boats: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boats numbered along the path from 0, upwards and downwards, larger ones first at
    a stop; and for each zone the first number beyond it on either side."""
    supply = boats.groupBy(F.col("stop").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    along = supply.unionByName(zones.select(F.col("zone").alias("at"), F.lit(0).cast("long").alias("n"))).groupBy("at").agg(F.sum("n").alias("n"))
    line = running_before(along, [], ["at"], F.floor(F.col("at") / STOPS), {"below": F.col("n")}, totals=True)
    beyond = F.col("below_total") - F.col("below") - F.col("n")
    place = F.row_number().over(Window.partitionBy("stop").orderBy(F.col("capacity").desc(), "vessel_id")) - 1
    placed = boats.withColumn("place", place).join(line.withColumnRenamed("at", "stop"), "stop")
    placed = placed.withColumns({"up": F.col("below") + F.col("place"), "down": beyond + F.col("place")})
    ends = line.withColumns({"first_up": F.col("below") + F.col("n"), "first_down": beyond + F.col("n")})
    asked = zones.join(ends.select(F.col("at").alias("zone"), "first_up", "first_down"), "zone")
    return placed.select("vessel_id", "stop", "capacity", "place", "up", "down"), asked


def _claims(asked: DataFrame, boats: DataFrame) -> DataFrame:
    """The ``wanted`` nearest boats of each zone, those of its own stop excluded.

    On either side of a zone its nearest boats have consecutive numbers along the path,
    so a zone names ``wanted`` numbers a side and meets those boats by equality.
    """

    def side(first: str, number: str) -> DataFrame:
        span = F.sequence(F.col(first), F.col(first) + F.col("wanted") - 1)
        return asked.withColumn(number, F.explode(span)).join(boats, number).select("zone", "wanted", "lack", "vessel_id", "stop", "capacity", "place")

    near = side("first_up", "up").unionByName(side("first_down", "down")).withColumn("cost", F.abs(F.col("zone") - F.col("stop")))
    order = ["cost", F.col("capacity").desc(), "vessel_id"]
    nth = running_before(near, ["zone"], order, F.col("cost"), {"nth": F.lit(1).cast("long")})
    return nth.where(F.col("nth") < F.col("wanted"))


def plan(surges: DataFrame, vessels: DataFrame, stops: DataFrame, max_boats: int = MAX_BOATS) -> DataFrame:
    """Boats sent to each surge: pickup_zone, window_time, vessel_id, round, cost, capacity, base_zone.

    Seats needed are requests above the expected ones. In a round

    - a surge still short of seats asks for as many boats as it needs at the least: the
      seats it lacks by those of the largest free boat, up to ``max_boats`` in all;
    - the surges of a stop together claim that many boats, nearest first (then larger,
      then the lower id), from other stops;
    - a boat goes to the nearest claiming stop. Stops equally near take turns along the
      boats of its stop, the one that lacks more seats first;
    - at a stop, surges that lack more (then earlier, then by zone) take first, each the
      nearest boats that are left.

    All this is running sums of demand against running sums of supply, so a round hands
    out every claimed boat. Rounds end when none is claimed, so a surge is left short
    only with ``max_boats`` boats or when no other stop has a free one. A boat that a
    nearer stop took is made up for in the next round: rounds grow with the number of
    stops that contend for the same boats, not with the boats.

    What a round took is one small table in the shared folder; plans don't hold earlier rounds.
    """
    need = materialize(
        surges.select(*SURGE, (F.col("request_count") - F.col("expected_requests")).cast("long").alias("need"))
        .where(F.col("need") > 0)
        .join(stops.select(F.col("zone").alias("pickup_zone"), F.col("idx").alias("zone")), "pickup_zone"),
        "need",
    )
    fleet = materialize(
        vessels.where((F.col("availability") == "available") & (F.col("vessel_id") != ""))
        .select("vessel_id", F.col("base_zone").alias("zone"), F.col("capacity").cast("long").alias("capacity"))
        .where("capacity > 0")
        .join(stops, "zone")
        .select("vessel_id", F.col("zone").alias("base_zone"), F.col("idx").alias("stop"), "capacity"),
        "fleet",
    )
    rounds: list[DataFrame] = []
    while True:
        free, short = fleet, need.withColumns({"left": F.col("need"), "boats": F.lit(0).cast("long")})
        if rounds:
            taken = reduce(DataFrame.unionByName, rounds)
            free = fleet.join(taken.select("vessel_id"), "vessel_id", "left_anti")
            got = taken.groupBy(*SURGE).agg(F.sum("capacity").alias("seats"), F.count(F.lit(1)).alias("boats"))
            short = need.join(got, SURGE, "left").withColumn("left", F.col("need") - F.coalesce("seats", F.lit(0)))
            short = short.withColumn("boats", F.coalesce("boats", F.lit(0)))
        largest = free.agg(F.max("capacity").alias("c")).scalar()
        short = short.where((F.col("left") > 0) & (F.col("boats") < max_boats))
        short = short.withColumn("asks", F.least(max_boats - F.col("boats"), F.ceil(F.col("left") / largest)).cast("long"))
        short = materialize(short, "short")
        boats, asked = _numbered(free, short.groupBy("zone").agg(F.sum("asks").alias("wanted"), F.sum("left").alias("lack")))
        boats = materialize(boats, "boats")
        claims = _claims(asked, boats)
        nearest = claims.groupBy("vessel_id", "stop", "capacity", "place").agg(
            F.min("cost").alias("cost"),
            F.sort_array(F.collect_list(F.struct("cost", (-F.col("lack")).alias("l"), "zone"))).alias("all"),
        )
        tied = F.filter("all", lambda c: c["cost"] == F.col("cost"))  # two at most, one on either side
        turn = F.get(tied, F.pmod(F.col("place"), F.size(tied)).cast("int"))["zone"]
        won = nearest.select("vessel_id", "capacity", "cost", turn.alias("zone"))
        order = ["cost", F.col("capacity").desc(), "vessel_id"]
        won = running_before(won, ["zone"], order, F.col("cost"), {"slot": F.lit(1).cast("long")})
        first = running_before(short.withColumn("neg", -F.col("left")), ["zone"], ["neg", "window_time", "pickup_zone"], F.col("neg"), {"before": F.col("asks")})
        slots = first.withColumn("slot", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("asks") - 1)))
        sent = slots.join(won, ["zone", "slot"]).select(*SURGE, "vessel_id", F.lit(len(rounds) + 1).alias("round"), "cost", "capacity")
        seen = Observation()
        rounds.append(materialize(sent.observe(seen, F.count(F.lit(1)).alias("boats")), f"round{len(rounds) + 1}"))
        release(short)
        release(boats)
        if seen.get["boats"] == 0:
            break
    return reduce(DataFrame.unionByName, rounds).join(fleet.select("vessel_id", "base_zone"), "vessel_id")


def completed_actions(surges: DataFrame, assigned: DataFrame, cause: str | None = None) -> DataFrame:
    """One row per answered surge: reason, summary, boats as JSON, response."""
    boat = F.struct("vessel_id", F.col("pickup_zone").alias("new_zone"), F.lit(HIRED).alias("new_availability"))
    per_surge = assigned.groupBy(*SURGE).agg(
        F.array_sort(F.collect_list(boat)).alias("boats"),
        F.array_sort(F.collect_set("base_zone")).alias("from_zones"),
        F.sum("capacity").alias("seats"),
    )
    because = F.coalesce(F.col(cause), F.lit("high demand")) if cause else F.lit("high demand")
    n = F.size("boats").cast("string")
    return surges.join(per_surge, SURGE).select(
        *SURGE,
        "request_count",
        dispatch_reason().alias("anomaly_reason"),
        F.concat(
            F.lit("Due to the surge in demand in "), F.col("pickup_zone"), F.lit(" as a result of "), because,
            F.lit(", we dispatched "), n, F.lit(" additional boats from "), F.array_join("from_zones", ", "), F.lit("."),
        ).alias("dispatch_summary"),
        F.to_json("boats").alias("dispatch_json"),
        F.to_json(
            F.struct(
                F.lit("success").alias("status"),
                F.size("boats").alias("boats_dispatched"),
                F.col("seats").alias("total_capacity_added"),
            )
        ).alias("api_response"),
    )


def from_replies(replies: DataFrame, response: str = "response") -> DataFrame:
    """Completed actions from the free-text replies of an agent."""
    from tidewatch.functions.text import json_section, response_section, summary_section

    return replies.select(
        *SURGE,
        "request_count",
        dispatch_reason().alias("anomaly_reason"),
        summary_section(response).alias("dispatch_summary"),
        json_section(response).alias("dispatch_json"),
        response_section(response).alias("api_response"),
    )


def apply_dispatch(vessels: DataFrame, assigned: DataFrame) -> DataFrame:
    """Vessel table after the dispatch: current zone and availability change,
    the base zone never does."""
    moved = assigned.groupBy("vessel_id").agg(F.min("pickup_zone").alias("current_zone"))
    return upsert_merge(vessels, moved.withColumn("availability", F.lit(HIRED)), ["vessel_id"])
