"""Surge detection against each key's own history."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.scans import KEY, key_of, running_before, time_chunk

# The detector's defaults.
MIN_TRAIN, MAX_TRAIN, CONFIDENCE = 15, 7000, 99.999
DAY = 86_400


def z_value(confidence: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - confidence / 100) / 2)


def interval(n: Column, total: Column, squares: Column, z: float, min_train: int, min_sd: float = 0.0):
    """(forecast, half width) of the next value, from count, sum and sum of squares."""
    enough = n >= max(min_train, 2)
    count = F.when(enough, n.cast("double"))
    mean = total.cast("double") / count
    spread = F.greatest((n * squares - total * total).cast("double"), F.lit(0.0))
    sd = F.greatest(F.sqrt(spread / (count * (count - 1))), F.lit(min_sd))
    return mean, F.lit(z) * sd * F.sqrt(1 + 1 / count)


def detect(
    df: DataFrame,
    value: str = "request_count",
    time: str = "window_time",
    keys: Sequence[str] = ("pickup_zone",),
    min_train: int = MIN_TRAIN,
    max_train: int = MAX_TRAIN,
    confidence: float = CONFIDENCE,
    min_sd: float = 0.0,
    chunk_seconds: int = DAY,
) -> DataFrame:
    """Add forecast, lower_bound, upper_bound, is_anomaly.

    The baseline of a row is the mean of its key's previous ``max_train`` values
    (itself excluded) with a prediction interval; bounds are null and nothing is
    flagged below ``min_train`` values.

    A sliding frame costs ``max_train`` steps per row. Here running totals are
    taken once, and the totals of ``max_train`` rows earlier are brought next to
    a row by one shuffle on (key, position). Whole numbers are summed exactly;
    other numbers relative to an origin near their key's mean, so that large
    values with small differences keep their digits.
    """
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    wide = "decimal(38,0)" if whole else "double"
    if whole:
        based, origin, x = df, F.lit(0.0), F.col(value).cast("decimal(20,0)")
    else:
        # rounded to a float, so the order of summation does not show
        centre = df.groupBy(key_of(keys).alias(KEY)).agg(F.avg(F.col(value).cast("double")).cast("float").cast("double").alias("__origin"))
        based = df.withColumn(KEY, key_of(keys)).join(centre, KEY).drop(KEY)
        origin, x = F.col("__origin"), F.col(value).cast("double") - F.col("__origin")
    scored = running_before(
        based,
        keys,
        [time],
        time_chunk(time, chunk_seconds),
        {"__n": F.lit(1).cast("long"), "__sx": x, "__sxx": (x * x)},
        totals=True,
    ).drop("__sx_total", "__sxx_total")

    # A row is needed again, as the start of the frame, ``max_train`` rows later.
    sums = [F.col("__n").alias("n"), F.col("__sx").cast(wide).alias("sx"), F.col("__sxx").cast(wide).alias("sxx")]
    here = F.struct(F.col("__n").alias("at"), F.lit(True).alias("cur"), *sums)
    later = F.struct((F.col("__n") + max_train).alias("at"), F.lit(False).alias("cur"), *sums)
    roles = F.when(F.col("__n") + max_train < F.col("__n_total"), F.array(here, later)).otherwise(F.array(here))
    placed = scored.withColumn("__role", F.explode(roles)).withColumn("__at", F.col("__role.at"))

    slot = Window.partitionBy(*keys, "__at")

    def gone(name: str) -> Column:
        old = F.max(F.when(~F.col("__role.cur"), F.col(f"__role.{name}"))).over(slot)
        return F.coalesce(old, F.lit(0).cast(wide if name != "n" else "long"))

    framed = placed.withColumns(
        {f"__f_{name}": F.col(f"__role.{name}") - gone(name) for name in ("n", "sx", "sxx")}
    ).where(F.col("__role.cur"))

    mean, half = interval(F.col("__f_n"), F.col("__f_sx"), F.col("__f_sxx"), z_value(confidence), min_train, min_sd)
    out = framed.withColumns({"forecast": mean + origin, "__half": half})
    out = out.withColumns(
        {"lower_bound": F.col("forecast") - F.col("__half"), "upper_bound": F.col("forecast") + F.col("__half")}
    )
    outside = (F.col(value) < F.col("lower_bound")) | (F.col(value) > F.col("upper_bound"))
    return out.withColumn("is_anomaly", F.coalesce(outside, F.lit(False))).select(
        *df.columns, "forecast", "lower_bound", "upper_bound", "is_anomaly"
    )


def detect_seasonal(df: DataFrame, season: Column | None = None, time: str = "window_time", keys=("pickup_zone",), **options):
    """The detector with its history also split by season (default: hour of day)."""
    part = season if season is not None else F.hour(time)
    scored = detect(df.withColumn("season", part), time=time, keys=[*keys, "season"], **options)
    return scored


def select_surges(scored: DataFrame, value: str = "request_count") -> DataFrame:
    """Anomalies above the upper bound, in the shape of the anomaly stream."""
    return scored.where(F.col("is_anomaly") & (F.col(value) > F.col("upper_bound"))).select(
        "pickup_zone",
        "window_time",
        "request_count",
        "total_passengers",
        F.col("total_revenue").cast("decimal(10,2)").alias("total_revenue"),
        F.round("forecast").cast("long").alias("expected_requests"),
        "upper_bound",
        "lower_bound",
        F.col("is_anomaly").alias("is_surge"),
    )


def last_windows(traffic: DataFrame, k: int = 60, zone: str = "zone", time: str = "window_start") -> DataFrame:
    """Newest ``k`` windows of each zone; every task first keeps its own ``k``."""
    newest = Window.partitionBy(zone).orderBy(F.col(time).desc())
    return traffic.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= k)


# -- trend-following variant -------------------------------------------------------


def _autoregress(y: np.ndarray, wanted: np.ndarray, order: int, min_train: int, max_train: int, z: float) -> np.ndarray:
    """One-step forecasts and half widths of the ``wanted`` positions, each from a least-squares fit on its past.

    The normal equations of all fits are differences of running sums, solved as one
    batch. Values count from the mean of ``y``, which a fit with a constant allows.
    """
    out = np.full((len(y), 2), np.nan)
    rows = len(y) - order
    at = wanted[(wanted >= max(min_train, order + 1)) & (wanted > order)]
    if rows <= 0 or not len(at):
        return out
    origin = y.mean()
    y = y - origin
    lags = np.column_stack([np.ones(rows)] + [y[order - 1 - j : len(y) - 1 - j] for j in range(order)])
    target = y[order:]
    gram = np.concatenate([np.zeros((1, order + 1, order + 1)), np.cumsum(lags[:, :, None] * lags[:, None, :], axis=0)])
    moment = np.concatenate([np.zeros((1, order + 1)), np.cumsum(lags * target[:, None], axis=0)])
    power = np.concatenate([[0.0], np.cumsum(target * target)])
    hi = at - order
    lo = np.maximum(hi - max_train, 0)
    n = hi - lo
    at, hi, lo, n = (v[n - order - 1 >= 1] for v in (at, hi, lo, n))
    if not len(at):
        return out
    g, m, p = gram[hi] - gram[lo], moment[hi] - moment[lo], power[hi] - power[lo]
    count = n[:, None].astype(float)
    x, mean = g[:, 0, 1:] / count, m[:, 0] / n
    spread = g[:, 1:, 1:] - count[:, :, None] * x[:, :, None] * x[:, None, :]
    # a lag that never changed has no slope; what is left of it is rounding
    still = np.einsum("nii->ni", spread) <= 1e-10 * np.einsum("nii->ni", g[:, 1:, 1:])
    spread = np.where(still[:, :, None] | still[:, None, :], 0.0, spread)
    shared = m[:, 1:] - count * x * mean[:, None]
    beta = (np.linalg.pinv(spread, rcond=1e-12, hermitian=True) @ shared[:, :, None])[:, :, 0]
    rest = p - n * mean * mean - (beta * shared).sum(axis=1)
    sd = np.sqrt(np.maximum(rest, 0.0) / (n - order - 1))
    now = np.column_stack([y[at - 1 - j] for j in range(order)])
    out[at, 0] = mean + ((now - x) * beta).sum(axis=1) + origin
    out[at, 1] = z * sd * np.sqrt(1 + 1 / n)
    return out


def detect_trend(
    df: DataFrame,
    value: str = "request_count",
    time: str = "window_time",
    keys: Sequence[str] = ("pickup_zone",),
    order: int = 3,
    min_train: int = MIN_TRAIN,
    max_train: int = MAX_TRAIN,
    confidence: float = CONFIDENCE,
    chunk_seconds: int = DAY,
) -> DataFrame:
    """:func:`detect` with an autoregressive forecast instead of the mean.

    Blocks of ``max_train`` positions are scored independently; each also gets
    the rows its fits look back on. So a task holds at most
    ``2 * max_train + order`` rows however long a key's history is.
    """
    z, keys, history = z_value(confidence), list(keys), max_train + order
    numbered = running_before(df, keys, [time], time_chunk(time, chunk_seconds), {"__n": F.lit(1).cast("long")})
    size = history
    own = F.floor(F.col("__n") / size)
    placed = numbered.withColumn("__block", F.explode(F.array(own, own + 1))).withColumn("__own", F.col("__block") == own)

    fields = df.schema.fields + [
        T.StructField("forecast", T.DoubleType()),
        T.StructField("__half", T.DoubleType()),
    ]

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__n", ignore_index=True)
        fit = _autoregress(group[value].to_numpy(float), np.flatnonzero(group["__own"]), order, min_train, max_train, z)
        group["forecast"], group["__half"] = fit[:, 0], fit[:, 1]
        return group.loc[group["__own"], [f.name for f in fields]]

    scored = placed.groupBy(*keys, "__block").applyInPandas(score, T.StructType(fields))
    nan_free = {c: F.when(~F.isnan(c), F.col(c)) for c in ("forecast", "__half")}
    out = scored.withColumns(nan_free).withColumns(
        {"lower_bound": F.col("forecast") - F.col("__half"), "upper_bound": F.col("forecast") + F.col("__half")}
    )
    outside = (F.col(value) < F.col("lower_bound")) | (F.col(value) > F.col("upper_bound"))
    return out.withColumn("is_anomaly", F.coalesce(outside, F.lit(False))).drop("__half")
