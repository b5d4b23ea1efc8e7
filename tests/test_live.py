"""Live panel: the stream's newest versions equal the batch prefix rule, whatever the order of arrival."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from airgrid.operators import clean
from airgrid.schemas import MEASUREMENT, POLLUTANTS
from airgrid.session import scratch_path
from airgrid.streaming import live

T0 = datetime(2024, 3, 1)


def readings(n_hours=150, seed=1):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b"):
        for h in range(n_hours):
            for p in POLLUTANTS:
                for _ in range(rng.choice([0, 1, 1, 2])):
                    if (s == "b" and 40 <= h < 47) or rng.random() < 0.3:          # long and short gaps
                        continue
                    rows.append((s, 47.0, 17.0, T0 + timedelta(hours=h, minutes=rng.randrange(60)), p, rng.choice([-1.0, 3.0, 7.5, 20.25])))
    return rows


def plain(rows):
    out = {}
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        lo, hi = (f(r[3] for r in own).replace(minute=0) for f in (min, max))
        n = int((hi - lo).total_seconds() // 3600) + 1
        for p in POLLUTANTS:
            v = [[] for _ in range(n)]
            for r in own:
                if r[4] == p and r[5] >= 0:
                    v[int((r[3] - lo).total_seconds() // 3600)].append(r[5])
            mean = [sum(x) / len(x) if x else None for x in v]
            for i in range(n):
                fill = mean[i]
                if fill is None:
                    prev = next((j for j in range(i - 1, -1, -1) if mean[j] is not None), None)
                    nxt = next((j for j in range(i + 1, n) if mean[j] is not None), None)
                    if prev is not None and i - prev <= 3:
                        fill = mean[prev] if nxt is None else mean[prev] + (mean[nxt] - mean[prev]) * (i - prev) / (nxt - prev)
                out[s, lo + timedelta(hours=i), p] = (mean[i], fill)
    return out


def got(spark, sink):
    out = {}
    for r in live.read_live(spark, sink).collect():
        for p in POLLUTANTS:
            out[r["location"], r["datetime"], p] = (r[p], r[f"{p}_filled"])
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k, pair in a.items():
        for x, y in zip(pair, b[k], strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), (k, pair, b[k])


def land(spark, rows, path):
    spark.createDataFrame(rows, MEASUREMENT).coalesce(1).write.mode("append").parquet(path)


def test_shuffled_late_arrival_and_restart_equal_the_batch(spark):
    rows = readings()
    rng = random.Random(5)
    # arrival: event time plus a delay of up to 30 hours; six slices, a restart after three
    order = sorted(rows, key=lambda r: r[3] + timedelta(hours=rng.uniform(0, 30)))
    # a gap that is filled late must still be in the ring of 48 hours
    src, sink, ck = (scratch_path(spark, f"live-{x}") for x in ("src", "sink", "ck"))
    cut = [order[i * len(order) // 6:(i + 1) * len(order) // 6] for i in range(6)]
    for part in cut[:3]:
        land(spark, part, src)
        live.run_live(spark, src, sink, ck, files_per_trigger=1)
    for part in cut[3:]:
        land(spark, part, src)
    live.run_live(spark, src, sink, ck)                      # restarted: the state comes from the checkpoint
    same(got(spark, sink), plain(rows))


def test_one_backfill_and_readings_older_than_the_ring(spark):
    rows = readings(120, seed=2) + [("c", 0.0, 0.0, None, "pm25", 1.0), ("c", 0.0, 0.0, T0, "o3", 4.0)]
    src, sink, ck = (scratch_path(spark, f"live-{x}") for x in ("src", "sink", "ck"))
    land(spark, rows, src)
    live.run_live(spark, src, sink, ck)
    dated = [r for r in rows if r[3] is not None]
    same(got(spark, sink), plain(dated))
    land(spark, [("a", 47.0, 17.0, T0 + timedelta(hours=2), "pm25", 999.0)], src)
    live.run_live(spark, src, sink, ck)
    same(got(spark, sink), plain(dated))
    assert spark.read.parquet(sink).where("location = 'a'").agg(F.max("late")).first()[0] in (0, 1)


def test_gap_filling_equals_the_batch_rule(spark):
    x = np.array([np.nan, 1, np.nan, np.nan, 4, np.nan, np.nan, np.nan, np.nan, np.nan, 10, np.nan, np.nan, np.nan, np.nan])
    df = spark.createDataFrame([("s", T0 + timedelta(hours=i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)],
                               "location string, datetime timestamp, pm25 double")
    for c in ("pm10", "no2", "so2", "temperature", "humidity", "wind_speed", "precipitation", "latitude", "longitude"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    want = [r["pm25"] for r in clean.interpolate_station(df).orderBy("datetime").collect()]
    have = live.fill_gaps(x)
    assert [None if np.isnan(v) else round(float(v), 9) for v in have] == [None if v is None else round(v, 9) for v in want]
