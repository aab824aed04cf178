"""Seasonal-trend decomposition by local regression (STL), cut along time.

Every step of the decomposition looks at a bounded neighbourhood: the same phase a few
periods around, a moving average of a period, the trend's window. So a key's history is
cut into chunks that carry a margin of that reach on both sides, and a chunk's own rows
come out as if the whole history had been there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.anomaly import detect

#: Windows of a chunk.
CHUNK = 20_000
PASSES = 2


def _odd(x: float) -> int:
    n = int(np.ceil(x))
    return n + 1 - n % 2


def windows_of(period: int, seasonal: int) -> tuple[int, int]:
    """Windows of the low-pass and of the trend smoothing: odd, at least a period, and 1.5 periods over 1 - 1.5 / seasonal."""
    return _odd(period), _odd(1.5 * period / (1 - 1.5 / seasonal))


def reach(period: int, seasonal: int) -> int:
    """How far away a value can still count."""
    low, trend = windows_of(period, seasonal)
    return PASSES * ((seasonal + 2) * period + 2 * period + 4 + low + trend)


def loess(y: np.ndarray, q: int, at: np.ndarray) -> np.ndarray:
    """Local linear fits with tricube weights over the ``q`` nearest of evenly spaced values."""
    n, k = len(y), min(q, len(y))
    left = np.clip(at - (k - 1) // 2, 0, n - k)
    x = left[:, None] + np.arange(k)
    d = np.abs(x - at[:, None])
    h = np.maximum(d.max(axis=1, keepdims=True) + max(0, (q - n) // 2), 1)
    # the farthest value still counts a little, so that windows of two have a slope
    w = (1 - (d / (h * 1.001)) ** 3) ** 3
    w /= w.sum(axis=1, keepdims=True)
    values = y[x]
    middle = (w * x).sum(axis=1, keepdims=True)
    off = x - middle
    spread = (w * off * off).sum(axis=1)
    slope = np.where(spread > 1e-12, (w * off * values).sum(axis=1) / np.where(spread > 1e-12, spread, 1), 0)
    return (w * values).sum(axis=1) + slope * (at - middle[:, 0])


def _average(y: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(y, np.ones(k) / k, "valid")


def stl(y: np.ndarray, period: int, seasonal: int) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal part) of evenly spaced values; fewer than two periods have no seasonal part."""
    n, (low, window) = len(y), windows_of(period, seasonal)
    here = np.arange(n)
    if n < 2 * period:
        return loess(y, window, here), np.zeros(n)
    trend = np.zeros(n)
    for _ in range(PASSES):
        cycle = np.zeros(n + 2 * period)
        for phase in range(period):
            sub = (y - trend)[phase::period]
            cycle[phase::period][: len(sub) + 2] = loess(sub, seasonal, np.arange(-1, len(sub) + 1))
        level = loess(_average(_average(_average(cycle, period), period), 3), low, here)
        season = cycle[period : period + n] - level
        trend = loess(y - season, window, here)
    return trend, season


def decompose(
    traffic: DataFrame,
    step_seconds: int,
    period: int,
    seasonal: int = 7,
    value: str = "request_count",
    at: str = "window_time",
    key: str = "pickup_zone",
    chunk: int = CHUNK,
) -> DataFrame:
    """``traffic`` with trend, seasonal and remainder, which add up to the value.

    Windows are ``step_seconds`` apart, one row a key and window; a window without a row
    counts as 0, a null value too (its remainder makes up for it). ``period`` is in windows,
    ``seasonal`` in periods (odd). Rows without a time or key have null parts.
    """
    margin = reach(period, seasonal)
    usable = F.col(at).isNotNull() & F.col(key).isNotNull()
    rows = traffic.where(usable).withColumn("__pos", F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / step_seconds))
    ends = rows.groupBy(key).agg(F.min("__pos").alias("__first"), F.max("__pos").alias("__last"))
    rows = rows.join(ends, key).withColumn("__rel", F.col("__pos") - F.col("__first"))
    last = F.floor((F.col("__last") - F.col("__first")) / chunk)
    low = F.greatest(F.floor((F.col("__rel") - margin) / chunk), F.lit(0))
    high = F.least(F.floor((F.col("__rel") + margin) / chunk), last)
    spread = rows.withColumn("__chunk", F.explode(F.sequence(low, high))).withColumn("__until", F.col("__last") - F.col("__first"))
    parts = [T.StructField(c, T.DoubleType()) for c in ("trend", "seasonal", "remainder")]
    schema, columns = T.StructType([*traffic.schema.fields, *parts]), traffic.columns

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        number, rel = int(frame["__chunk"].iloc[0]), frame["__rel"].to_numpy(np.int64)
        start = max(0, number * chunk - margin)
        stop = min(int(frame["__until"].iloc[0]), (number + 1) * chunk - 1 + margin)
        y = np.zeros(stop - start + 1)
        y[rel - start] = frame[value].astype(float).fillna(0.0).to_numpy()
        trend, season = stl(y, period, seasonal)
        own = frame[frame["__rel"] // chunk == number]
        place = own["__rel"].to_numpy(np.int64) - start
        rest = own[value].astype(float).to_numpy() - trend[place] - season[place]
        return own[columns].assign(trend=trend[place], seasonal=season[place], remainder=rest)

    done = spread.groupBy(key, "__chunk").applyInPandas(smooth, schema)
    none = [F.lit(None).cast("double").alias(f.name) for f in parts]
    return done.unionByName(traffic.where(~usable).select("*", *none))


def detect_deseasoned(traffic: DataFrame, step_seconds: int, period: int, seasonal: int = 7, value: str = "request_count", **options) -> DataFrame:
    """The detector on what is left of a value without its seasonal part; ``options`` are those of :func:`detect`."""
    parts = decompose(traffic, step_seconds, period, seasonal, value)
    return detect(parts.withColumn("deseasoned", F.col(value) - F.col("seasonal")), value="deseasoned", **options)
