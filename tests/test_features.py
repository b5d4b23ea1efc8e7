"""Feature operators (F01-F18) against pandas on small fixtures."""

import random
from datetime import datetime, timedelta

import pandas as pd

from airgrid.functions.windows import rolling_mean_prev, rolling_std_prev, station_window
from airgrid.operators import features
from airgrid.schemas import FEATURES


def _frame(spark, vals, wind=None):
    t0 = datetime(2024, 1, 1)
    wind = wind or [1.0] * len(vals)
    rows = [("a", t0 + timedelta(hours=i), 47.6, 17.6, None if v is None else float(v), w, 10.0, 50.0, 0.0,
             1.0, 1.0, 1.0) for i, (v, w) in enumerate(zip(vals, wind))]
    return spark.createDataFrame(rows, "location string, datetime timestamp, latitude double, longitude double, "
                                       "pm25 double, wind_speed double, temperature double, humidity double, "
                                       "precipitation double, pm10 double, no2 double, so2 double")


def test_rolling_mean_full_frame(spark):
    df = _frame(spark, [1, 2, None, 4, 5, 6, 7])
    w = station_window()
    got = [r["m"] for r in df.select("datetime", rolling_mean_prev("pm25", 3, w).alias("m"))
           .orderBy("datetime").collect()]
    assert got == [None] * 6 + [5.0]


def test_rolling_stats_match_pandas(spark):
    rng = random.Random(3)
    vals = [None if rng.random() < 0.2 else rng.uniform(0, 50) for _ in range(200)]
    df = _frame(spark, vals)
    w = station_window()
    rows = df.select("datetime", rolling_mean_prev("pm25", 6, w).alias("m"),
                     rolling_std_prev("pm25", 12, w).alias("s")).orderBy("datetime").collect()
    s = pd.Series(vals, dtype="float64")
    m6 = s.rolling(6).mean().shift(1)
    s12 = s.rolling(12).std().shift(1)
    for r, a, b in zip(rows, m6, s12):
        assert (r["m"] is None) == pd.isna(a)
        assert (r["s"] is None) == pd.isna(b)
        if r["m"] is not None:
            assert abs(r["m"] - a) < 1e-9
        if r["s"] is not None:
            assert abs(r["s"] - b) < 1e-9


def test_stagnation_missing_wind_counts_zero(spark):
    df = _frame(spark, [1] * 8, wind=[1.0, None, 1.0, 5.0, 1.0, 1.0, 1.0, 1.0])
    out = features.weather_features(df).orderBy("datetime").collect()
    assert [r["stagnation_hours_6h"] for r in out] == [None] * 6 + [4.0, 4.0]


def test_build_features_complete_and_unseen_station(spark):
    tr = _frame(spark, list(range(30)))
    feats, fit = features.build_features(tr)
    assert features.check_features(feats) == []
    assert set(FEATURES) <= set(feats.columns)
    other = tr.withColumn("location", tr["location"].substr(0, 0))
    applied, _ = features.build_features(other, fit)
    assert {r["location_id"] for r in applied.collect()} == {-1}


def test_weekend_and_heating_flags(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 6, 5),), (datetime(2024, 6, 3, 5),)], "datetime timestamp")
    out = features.time_features(df).orderBy("datetime").collect()
    assert out[0]["weekend_flag"] == 1 and out[0]["heating_season_flag"] == 1
    assert out[1]["weekend_flag"] == 0 and out[1]["heating_season_flag"] == 0


def test_chunked_windows_equal_per_station(spark):
    from conftest import SF01
    from airgrid.catalog import common as cm
    p = cm.prepared(spark, SF01)
    a, fit = features.build_features(p.train, chunk_hours=None)
    b, _ = features.build_features(p.train, fit, chunk_hours=48)   # many blocks per station
    cols = [c for c in a.columns]
    assert sorted(b.columns) == sorted(cols)
    diff = a.select(*cols).exceptAll(b.select(*cols)).count() + b.select(*cols).exceptAll(a.select(*cols)).count()
    assert a.count() == b.count() and diff == 0


def test_binned_density_lies_within_its_bound(spark):
    import numpy as np

    from airgrid.operators import explore
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.gamma(2, 12, 4000), [0.0, 0.0, 400.0]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "pm25 double")
    for cells in (1 << 16, 4096, 512):
        a = {r["i"]: r["density"] for r in explore.kde(df, cells=cells).collect()}
        b = {r["i"]: r["density"] for r in explore.kde(df, exact=True).collect()}
        bound = explore.kde_error(v.min(), v.max(), v.std(ddof=1), len(v), cells)
        assert len(a) == 200 and max(abs(a[i] - b[i]) for i in a) <= bound + 1e-12
    assert explore.kde_error(v.min(), v.max(), v.std(ddof=1), len(v)) < 1e-7


def test_station_index_over_range_partitions(spark):
    from airgrid.operators import features
    names = [f"s{i:03d}" for i in range(300)]
    df = spark.createDataFrame([(n, 1.0, 2.0) for n in reversed(names)] * 2 + [(None, 1.0, 2.0)], "location string, latitude double, longitude double")
    fit = features.fit_spatial(df)
    assert {r["location"]: r["location_id"] for r in fit.mapping.collect()} == {n: i for i, n in enumerate(names)} and fit.n_stations == 300
