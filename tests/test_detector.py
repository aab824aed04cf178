"""Scans and detector against brute force."""

import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.anomaly import detect, detect_seasonal, detect_trend, select_surges, z_value
from tidewatch.operators.scans import asof, running_before, time_chunk

T0 = dt.datetime(2024, 1, 1)


def series(spark, data):
    """data: zone -> list of counts, one window a minute."""
    out = [
        (zone, T0 + dt.timedelta(minutes=i, milliseconds=-1), n, n * 2)
        for zone, values in data.items()
        for i, n in enumerate(values, 1)
    ]
    return spark.createDataFrame(out, "pickup_zone string, window_time timestamp, request_count long, total_passengers long")


def brute(values, min_train, max_train, z, min_sd=0.0):
    out = []
    for i, x in enumerate(values):
        past = values[max(0, i - max_train) : i]
        if len(past) < max(min_train, 2):
            out.append((None, None, False))
            continue
        m, s = statistics.fmean(past), max(statistics.stdev(past), min_sd)
        half = z * s * (1 + 1 / len(past)) ** 0.5
        out.append((m, m + half, bool(x > m + half or x < m - half)))
    return out


@pytest.mark.parametrize("max_train,chunk", [(7000, 86_400), (20, 600), (5, 60), (33, 3600)])
def test_detect_equals_sliding_baseline(spark, max_train, chunk):
    rng = random.Random(max_train)
    data = {z: [rng.randint(0, 9) for _ in range(90)] for z in "ab"} | {"c": [4] * 40 + [5] * 3, "d": [1, 2]}
    got = detect(series(spark, data), confidence=99.0, min_train=4, max_train=max_train, chunk_seconds=chunk).collect()
    want = {z: brute(v, 4, max_train, z_value(99.0)) for z, v in data.items()}
    assert len(got) == sum(map(len, data.values()))
    for r in got:
        i = round((r.window_time - T0).total_seconds() / 60) - 1
        m, hi, flag = want[r.pickup_zone][i]
        assert r.is_anomaly == flag
        assert (r.forecast is None) == (m is None)
        if m is not None:
            assert r.forecast == pytest.approx(m) and r.upper_bound == pytest.approx(hi)


def test_constant_history_flags_any_rise_unless_min_sd(spark):
    df = series(spark, {"a": [4] * 20 + [5]})
    assert detect(df, min_train=15).where("is_anomaly").count() == 1
    assert detect(df, min_train=15, min_sd=1.0).where("is_anomaly").count() == 0


def test_large_counts_stay_exact(spark):
    big = 10**12
    df = series(spark, {"a": [big + i % 2 for i in range(40)]})
    last = detect(df, min_train=15).orderBy(F.desc("window_time")).first()
    past = [i % 2 for i in range(39)]
    half = z_value(99.999) * statistics.stdev(past) * (1 + 1 / 39) ** 0.5
    assert last.upper_bound - last.forecast == pytest.approx(half, rel=1e-3)


def test_select_surges_keeps_rises_only(spark):
    df = series(spark, {"a": [50, 51] * 10 + [0], "b": [50, 51] * 10 + [99]}).withColumn(
        "total_revenue", F.lit(1).cast("decimal(20,2)")
    )
    got = select_surges(detect(df)).collect()
    assert [(r.pickup_zone, r.request_count, r.expected_requests, r.is_surge) for r in got] == [("b", 99, 51, True)]


def test_seasonal_history_is_split(spark):
    rows = [("a", T0 + dt.timedelta(hours=h), (h % 24) * 10 + h // 24 % 2, 0) for h in range(24 * 20)]
    df = spark.createDataFrame(rows, "pickup_zone string, window_time timestamp, request_count long, total_passengers long")
    got = detect_seasonal(df, min_train=5).where("forecast is not null").collect()
    assert got and all(abs(r.forecast - (r.window_time.hour * 10 + 0.5)) <= 0.5 for r in got)


@pytest.mark.parametrize("max_train", [12, 1000])
def test_trend_equals_refit_per_row(spark, max_train):
    rng = np.random.default_rng(3)
    y = np.round(20 + 0.5 * np.arange(60) + rng.normal(0, 2, 60)).astype(int).tolist()
    got = detect_trend(series(spark, {"a": y}), order=2, min_train=8, max_train=max_train, confidence=99.0, chunk_seconds=600)
    got = {r.window_time: r for r in got.collect()}
    assert len(got) == 60
    p, v = 2, np.array(y, float)
    for i in range(60):
        r = got[T0 + dt.timedelta(minutes=i + 1, milliseconds=-1)]
        rows = np.arange(max(p, i - max_train), i)
        if i < 8 or len(rows) - p - 1 < 1:
            assert r.forecast is None
            continue
        X = np.column_stack([np.ones(len(rows))] + [v[rows - j] for j in range(1, p + 1)])
        beta, *_ = np.linalg.lstsq(X, v[rows], rcond=None)
        assert r.forecast == pytest.approx(np.r_[1, v[i - 1], v[i - 2]] @ beta, rel=1e-4)


@pytest.mark.parametrize("coarse", [None, lambda c: F.floor(c / 3)])
def test_running_before_with_null_and_hot_keys(spark, coarse):
    rng = random.Random(1)
    raw = [(rng.choice(["hot", "hot", "hot", None, "x"]), T0 + dt.timedelta(seconds=i * 37), rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(raw, "k string, t timestamp, v long")
    got = running_before(df, ["k"], ["t"], time_chunk("t", 600), {"s": F.col("v")}, True, coarse).collect()
    assert len(got) == 300
    pdf = pd.DataFrame(raw, columns=["k", "t", "v"])
    pdf["k"] = pdf.k.fillna("~")
    pdf["before"] = pdf.groupby("k").v.cumsum() - pdf.v
    want = {t: (b, pdf.v[pdf.k == k].sum()) for k, t, b in zip(pdf.k, pdf.t, pdf.before)}
    assert all((r.s, r.s_total) == want[r.t] for r in got)


@pytest.mark.parametrize("direction,salts", [("backward", 1), ("forward", 1), ("backward", 5), ("forward", 3)])
def test_asof_equals_merge_asof(spark, direction, salts):
    rng = random.Random(5)
    left = sorted((T0 + dt.timedelta(seconds=rng.randint(0, 20_000)), rng.choice("ab"), i) for i in range(200))
    right = sorted({(T0 + dt.timedelta(seconds=rng.randint(0, 20_000)), rng.choice("ab")) for _ in range(60)})
    l, r = spark.createDataFrame(left, "t timestamp, k string, i long"), spark.createDataFrame(right, "rt timestamp, k string")
    got = {x.i: x.hit.rt if x.hit else None for x in asof(l, r, ["k"], "t", "rt", "hit", 900, direction, salts).collect()}
    want = pd.merge_asof(
        pd.DataFrame(left, columns=["t", "k", "i"]), pd.DataFrame(right, columns=["rt", "k"]), left_on="t", right_on="rt", by="k", direction=direction
    )
    assert len(got) == 200
    assert all(got[i] == (None if pd.isna(w) else w.to_pydatetime()) for i, w in zip(want.i, want.rt))


def test_large_doubles_keep_their_differences(spark):
    import datetime as dt
    import random
    from statistics import mean, stdev

    from pyspark.sql import functions as F

    from tidewatch.operators.anomaly import detect, z_value

    r = random.Random(5)
    x = [1e9 + r.gauss(0, 1) for _ in range(60)]
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("z", t0 + dt.timedelta(minutes=k), v) for k, v in enumerate(x)], "pickup_zone string, window_time timestamp, v double")
    got = detect(df, "v", confidence=99.0, max_train=30).orderBy("window_time").select((F.col("upper_bound") - F.col("forecast")).alias("half"), "forecast").collect()
    for k in range(15, 60):
        past = x[max(0, k - 30) : k]
        half = z_value(99.0) * stdev(past) * (1 + 1 / len(past)) ** 0.5
        assert abs(got[k]["half"] - half) < 1e-4 and abs(got[k]["forecast"] - mean(past)) < 1e-5


# -- seasonal-trend decomposition ------------------------------------------------------


def plain_loess(y, q, x):
    """One local fit, with lists."""
    n = len(y)
    k = min(q, n)
    left = min(max(x - (k - 1) // 2, 0), n - k)
    near = range(left, left + k)
    h = max(max(abs(i - x) for i in near) + max(0, (q - n) // 2), 1) * 1.001
    w = [(1 - (abs(i - x) / h) ** 3) ** 3 for i in near]
    total = sum(w)
    mx, my = (sum(a * b for a, b in zip(w, c)) / total for c in (near, [y[i] for i in near]))
    sxx = sum(a * (i - mx) ** 2 for a, i in zip(w, near)) / total
    sxy = sum(a * (i - mx) * y[i] for a, i in zip(w, near)) / total
    return my + (sxy / sxx * (x - mx) if sxx > 1e-12 else 0)


def plain_stl(y, period, seasonal):
    from tidewatch.operators.seasonal import PASSES, windows_of

    n, (low, window) = len(y), windows_of(period, seasonal)
    trend = [0.0] * n
    for _ in range(PASSES):
        cycle = [0.0] * (n + 2 * period)
        for phase in range(period):
            sub = [y[i] - trend[i] for i in range(phase, n, period)]
            for j in range(-1, len(sub) + 1):
                cycle[phase + (j + 1) * period] = plain_loess(sub, seasonal, j)
        wide = cycle
        for k in (period, period, 3):
            cycle = [sum(cycle[i : i + k]) / k for i in range(len(cycle) - k + 1)]
        season = [wide[i + period] - plain_loess(cycle, low, i) for i in range(n)]
        trend = [plain_loess([a - b for a, b in zip(y, season)], window, i) for i in range(n)]
    return trend, season


def test_decomposition_equals_plain_loops_in_any_chunks(spark):
    from tidewatch.operators.seasonal import decompose

    rng = random.Random(6)
    shape = [0, 1, 5, 9, 4]
    series = {"long": 400, "short": 7, "two": 10}
    rows, y = [], {}
    for zone, n in series.items():
        y[zone] = [0.0] * n
        for k in range(n):
            if 0 < k < n - 1 and rng.random() < 0.1:
                continue  # a window without rides
            y[zone][k] = 20 + k / 10 + shape[k % 5] + rng.randint(0, 3)
            rows.append((zone, T0 + dt.timedelta(hours=k), y[zone][k]))
    df = spark.createDataFrame([*rows, ("long", None, 1.0), (None, T0, 2.0)], "pickup_zone string, window_time timestamp, request_count double")
    for chunk in (60, 100_000):
        got = decompose(df, 3600, 5, chunk=chunk).collect()
        assert len(got) == len(rows) + 2 and sum(r.trend is None for r in got) == 2
        for zone in ("long", "two"):
            trend, season = plain_stl(y[zone], 5, 7)
            for r in got:
                if r.pickup_zone == zone and r.window_time:
                    k = round((r.window_time - T0).total_seconds() / 3600)
                    assert abs(r.trend - trend[k]) < 1e-6 and abs(r.seasonal - season[k]) < 1e-6
                    assert abs(r.trend + r.seasonal + r.remainder - r.request_count) < 1e-9
        assert all(r.seasonal == 0 for r in got if r.pickup_zone == "short")


def test_a_season_is_no_anomaly_but_a_shift_in_it_is(spark):
    from tidewatch.operators.seasonal import detect_deseasoned

    rng = random.Random(1)
    values = [[2, 3, 40, 60, 8, 2][k % 6] + rng.randint(0, 1) for k in range(300)]
    values[250] += 30  # at an hour that is otherwise quiet
    rows = [("z", T0 + dt.timedelta(hours=k), v) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "pickup_zone string, window_time timestamp, request_count long")
    plain = {r.window_time for r in detect(df, confidence=99.9, min_train=60).where("is_anomaly").collect()}
    found = {r.window_time for r in detect_deseasoned(df, 3600, 6, confidence=99.9, min_train=60).where("is_anomaly").collect()}
    at = T0 + dt.timedelta(hours=250)
    # the same hours a few days around take a part of the jump into their season
    assert at in found and at not in plain and all(abs(t - at) <= dt.timedelta(hours=3 * 6) for t in found)
