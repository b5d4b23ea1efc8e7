"""Cleaning, alignment and gap filling (C01, C06, C09, S10) on hand-made edge fixtures."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from airgrid.functions.text import fold_name
from airgrid.operators import clean
from airgrid.functions.interp import interpolate

N = None


def _series(spark, values, key="a"):
    t0 = datetime(2024, 1, 1)
    rows = [(key, t0 + timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "location string, datetime timestamp, x double")


def _collect(df, col="x"):
    return [r[col] for r in df.orderBy("location", "datetime").collect()]


def test_fold_name():
    assert fold_name('"Győr Szent István" ') == "Gyor Szent Istvan"
    assert fold_name(None) == "None"


def test_clean_locations_distinct_join(spark):
    df = spark.createDataFrame([('"Győr Szent István" ', 1), ('"Győr Szent István" ', 2), ("Pécs", 3)],
                               "location string, v int")
    out = sorted((r["location"], r["v"]) for r in clean.clean_locations(df).collect())
    assert out == [("Gyor Szent Istvan", 1), ("Gyor Szent Istvan", 2), ("Pecs", 3)]


def test_interpolation_gap_pattern(spark):
    vals = [N, N, 1, N, N, N, N, N, 7, N, 9, N, N, N, N, N]
    once = interpolate(_series(spark, vals), ["x"])
    assert _collect(once) == [N, N, 1, 2, 3, 4, N, N, 7, 8, 9, 9, 9, 9, N, N]
    twice = interpolate(once, ["x"])
    assert _collect(twice) == [N, N, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 9, 9, 9]


def test_interpolation_matches_pandas_random(spark):
    rng = random.Random(7)
    rows, frames = [], []
    for key in ("a", "b", "c"):
        vals = [None if rng.random() < 0.5 else round(rng.uniform(0, 100), 2) for _ in range(120)]
        frames.append(pd.Series(vals, dtype="float64").interpolate(limit=3, limit_direction="forward"))
        rows.append(_series(spark, vals, key))
    df = rows[0].unionByName(rows[1]).unionByName(rows[2])
    got = _collect(interpolate(df, ["x"]))
    want = [None if math.isnan(v) else v for s in frames for v in s.tolist()]
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None and w is None) or abs(g - w) < 1e-9


def test_resample_subhour_grid(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 20), 1.0, 0.0, 0.0, 0.0),
                                ("a", datetime(2024, 1, 1, 3, 10), 2.0, 0.0, 0.0, 0.0)],
                               "location string, datetime timestamp, pm25 double, pm10 double, no2 double, so2 double")
    out = clean.resample_pollutants(df).orderBy("datetime").collect()
    assert [r["datetime"].hour for r in out] == [0, 1, 2, 3]
    assert [r["pm25"] for r in out] == [1.0, None, None, 2.0]


def test_pivot_drops_null_keys(spark):
    rows = [("s", 47.0, 17.0, datetime(2024, 1, 1), "pm25", 5.0),
            ("s", None, 17.0, datetime(2024, 1, 1, 1), "pm25", 6.0),
            ("s", 47.0, 17.0, datetime(2024, 1, 1), "pm25", 7.0)]
    df = spark.createDataFrame(rows, "location string, latitude double, longitude double, "
                                     "datetime timestamp, parameter string, value double")
    out = clean.pivot_measurements(df).collect()
    assert len(out) == 1 and out[0]["pm25"] == 6.0


def test_clean_pollutants_sentinel(spark):
    df = spark.createDataFrame([(-1.0, -5.0), (3.0, -2.0)], "pm25 double, temperature double")
    df = df.withColumns({"pm10": F.lit(1.0), "no2": F.lit(1.0), "so2": F.lit(1.0)})
    out = clean.clean_pollutants(df).collect()
    assert out[0]["pm25"] is None and out[0]["temperature"] == -5.0 and out[1]["pm25"] == 3.0


def test_chunked_interpolation_equals_per_station(spark):
    from conftest import SF01
    from airgrid.catalog import common as cm
    b = cm.base(spark, SF01)
    a = clean.interpolate_pollutants(b, chunk_hours=None)
    for hours in (48, 7):
        c = clean.interpolate_pollutants(b, chunk_hours=hours)
        assert c.count() == a.count()
        assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0


def test_chunked_interpolation_long_gap_across_blocks(spark):
    vals = [5, N, N, N, N, N, N, N, N, N, 15, N, N, 3, N, N, N, N, N]
    a = clean.interpolate_pollutants(_series(spark, vals).withColumnRenamed("x", "pm25"), ["pm25"],
                                     chunk_hours=None)
    c = clean.interpolate_pollutants(_series(spark, vals).withColumnRenamed("x", "pm25"), ["pm25"],
                                     chunk_hours=4)
    assert _collect(a, "pm25") == _collect(c, "pm25")
