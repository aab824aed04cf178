"""Stream operators with keyed state and timers.

They run on the state store that keeps entries apart, so a batch writes what it
changes and not a key's whole state; :func:`own_state` sets it while a query starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.anomaly import CONFIDENCE, MAX_TRAIN, MIN_TRAIN, z_value

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Values of one entry of the detector's history.
BUCKET = 128


@contextmanager
def own_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state entry by entry; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


# -- detector -----------------------------------------------------------------------


class Detector(StatefulProcessor):
    """A key's last ``max_train`` values in buckets, and their sums.

    A batch reads and writes the newest bucket, and reads those buckets whose values
    leave the window; a bucket out of it goes. What is written is in proportion to the
    new rows, whatever the length of the window.
    """

    def __init__(self, value: str, at: str, whole: bool, min_train: int, max_train: int, z: float, min_sd: float):
        self.value, self.at, self.whole = value, at, whole
        self.min_train, self.max_train, self.z, self.min_sd = min_train, max_train, z, min_sd

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Sums of whole numbers are written as text: exact at any size.
        self.sums = handle.getValueState("sums", "n long, origin double, total string, square string")
        self.buckets = handle.getMapState("values", "bucket long", "v array<double>")

    def close(self) -> None: ...

    def _bucket(self, number: int) -> list[float]:
        return list(self.buckets.getValue((number,))[0]) if self.buckets.containsKey((number,)) else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.at, ignore_index=True)
        new = frame[self.value].to_numpy(float)
        number = int if self.whole else float
        known = self.sums.get()
        n, origin = (known[0], known[1]) if known else (0, float(new[0]))
        total, square = (number(known[2]), number(known[3])) if known else (number(0), number(0))
        first = max(0, n - self.max_train)  # position of the oldest value inside the sums
        newest = n // BUCKET
        held = {newest: self._bucket(newest)}
        kept = set(range(first // BUCKET, newest + 1))
        out = {"forecast": [], "lower_bound": [], "upper_bound": [], "is_anomaly": []}
        for x in new:
            count = n - first
            mean = half = np.nan
            if count >= max(self.min_train, 2):
                mean = float(total + number(origin) * count) / count
                spread = float(count * square - total * total)
                sd = max(np.sqrt(max(spread, 0.0) / (float(count) * (count - 1))), self.min_sd)
                half = self.z * sd * np.sqrt(1 + 1 / count)
            out["forecast"].append(mean)
            out["lower_bound"].append(mean - half)
            out["upper_bound"].append(mean + half)
            out["is_anomaly"].append(bool(x < mean - half or x > mean + half))
            c = number(x - origin)
            total, square = total + c, square + c * c
            held.setdefault(n // BUCKET, []).append(float(x))
            n += 1
            if n - first > self.max_train:
                b = first // BUCKET
                if b not in held:
                    held[b] = self._bucket(b)
                old = number(held[b][first % BUCKET] - origin)
                total, square = total - old, square - old * old
                first += 1
        self.sums.update((n, origin, str(total), str(square)))
        for b in {newest} | {b for b in held if b > newest}:
            if b >= first // BUCKET:
                self.buckets.updateValue((b,), (held[b],))
        for b in kept:
            if b < first // BUCKET and self.buckets.containsKey((b,)):
                self.buckets.removeKey((b,))
        yield frame.assign(**out)


def detect_stream(
    traffic: DataFrame,
    value: str = "request_count",
    at: str = "window_time",
    key: str = "pickup_zone",
    min_train: int = MIN_TRAIN,
    max_train: int = MAX_TRAIN,
    confidence: float = CONFIDENCE,
    min_sd: float = 0.0,
) -> DataFrame:
    """The detector over a stream of closed windows, equal to the batch one when
    windows of a zone arrive in order of time.

    Runs on the table the traffic job writes; start it inside :func:`own_state`.
    """
    extra = [T.StructField(c, T.DoubleType()) for c in ("forecast", "lower_bound", "upper_bound")]
    schema = T.StructType([*traffic.schema.fields, *extra, T.StructField("is_anomaly", T.BooleanType())])
    whole = isinstance(traffic.schema[value].dataType, T.IntegralType)
    detector = Detector(value, at, whole, min_train, max_train, z_value(confidence), min_sd)
    scored = traffic.groupBy(key).transformWithStateInPandas(detector, schema, "append", "None")
    return scored.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in extra})


# -- evidence that does not come --------------------------------------------------------


class Waiting(StatefulProcessor):
    """Holds an anomaly until its evidence comes or its time is up."""

    def __init__(self, columns: Sequence[str], delay_seconds: int):
        self.columns, self.delay = list(columns), delay_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "due long, answered boolean, row string")

    def close(self) -> None: ...

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.held.get()
        due, answered, row = known if known else (None, False, None)
        frame = pd.concat(list(rows))
        asked = frame[~frame["answers"]].sort_values("at_ms")
        if len(asked) and due is None:
            due, row = int(asked["at_ms"].iloc[0]) + self.delay, asked["row"].iloc[0]
            self.handle.registerTimer(due)
        came = frame.loc[frame["answers"], "at_ms"]
        if len(came):
            # evidence may come before its anomaly; after the time is up it is too late
            answered = answered or due is None or bool((came <= due).any())
        if answered and due is not None:
            self.handle.deleteTimer(due)
        self.held.update((due, bool(answered), row))
        yield pd.DataFrame({"row": pd.Series([], dtype=str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, answered, row = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"row": [] if answered else [row]})


def overdue(
    anomalies: DataFrame,
    evidence: DataFrame,
    at: str = "ingested_at",
    evidence_at: str = "enriched_at",
    delay_seconds: int = 40,
    keys: Sequence[str] = ("pickup_zone", "window_time"),
    lateness: str = "5 seconds",
) -> DataFrame:
    """Anomalies whose evidence has not come within the delay, once each, as the streams pass that time.

    Every anomaly sets a timer in event time; evidence (with some text in
    ``top_chunk_1``) cancels it. Rows may be late by ``lateness``. Of anomalies with one
    key the first of a batch counts. Start it inside :func:`own_state`.
    """
    schema = anomalies.schema
    asked = anomalies.select(*keys, F.col(at).alias("__at"), F.lit(False).alias("answers"), F.to_json(F.struct("*")).alias("row"))
    told = evidence.where(F.coalesce("top_chunk_1", F.lit("")) != "")
    told = told.select(*keys, F.col(evidence_at).alias("__at"), F.lit(True).alias("answers"), F.lit(None).cast("string").alias("row"))
    # the watermark is that of both streams together, so the slower one holds timers back
    both = asked.withWatermark("__at", lateness).unionByName(told.withWatermark("__at", lateness))
    both = both.withColumn("at_ms", F.unix_millis("__at"))
    waiting = Waiting(schema.names, delay_seconds)
    late = both.groupBy(*keys).transformWithStateInPandas(waiting, "row string", "append", "EventTime")
    return late.select(F.from_json("row", schema).alias("r")).select("r.*")
