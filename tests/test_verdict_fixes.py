"""Edge cases of lookups, cleaning, stores, explanations and searches."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.functions.quantiles import exact_quantiles_many
from airgrid.operators.search import Study
from airgrid.operators import clean, explain, explore, models, splits
from airgrid.operators import forecast as fc
from airgrid.schemas import FEATURES, TARGET, WEATHER_COLS
from airgrid.session import scratch_path
from airgrid.sources import files, stations

T0 = datetime(2024, 1, 1)


def test_asof_picks_the_latest_earlier_row(spark):
    rng = random.Random(1)
    times = sorted({T0 + timedelta(minutes=rng.randrange(0, 6000)) for _ in range(150)})
    w = [(t, float(i), float(i % 7), 1.0, 0.0) for i, t in enumerate(times)]
    weather = spark.createDataFrame(w, "datetime timestamp, " + ", ".join(f"{c} double" for c in WEATHER_COLS))
    targets = [T0 + timedelta(minutes=rng.randrange(-3000, 9000), seconds=rng.randrange(60)) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in targets], "target timestamp").repartition(7)
    got = fc.asof_weather(df, weather).collect()
    assert len(got) == 800
    for r in got:
        before = [x for x in w if x[0] <= r["target"]]
        want = before[-1] if before else w[-1]
        assert (r["weather_time"], r["temperature"]) == (want[0], want[1])
        assert r["weather_time"] <= r["target"] or not before
    none = fc.asof_weather(df, weather.limit(0)).first()
    assert none["weather_time"] is None and none["temperature"] is None


def test_nan_never_survives_cleaning(spark):
    nan = float("nan")
    long = spark.createDataFrame([("a", 1.0, 2.0, T0, "pm25", nan), ("a", 1.0, 2.0, T0, "pm25", 4.0), ("a", 1.0, 2.0, T0, "no2", nan)],
                                 "location string, latitude double, longitude double, datetime timestamp, parameter string, value double")
    r = clean.pivot_measurements(long).first()
    assert r["pm25"] == 4.0 and r["no2"] is None
    wide = spark.createDataFrame([(nan, -1.0, 3.0, None)], "pm25 double, pm10 double, no2 double, so2 double")
    r = clean.clean_pollutants(wide).first()
    assert (r["pm25"], r["pm10"], r["no2"], r["so2"]) == (None, None, 3.0, None)
    w = spark.createDataFrame([(T0, 1.0, 45), (T0, nan, 50)], "datetime timestamp, temperature double, weather_code int")
    r = clean.dedup_weather(w).first()
    assert r["temperature"] == 1.0 and r["weather_code"] == 50


def test_feature_store_keeps_station_names(spark):
    df = spark.createDataFrame([("007", T0, 1.0), ("12", T0 + timedelta(days=40), 2.0)], "location string, datetime timestamp, x double")
    path = scratch_path(spark, "names")
    files.write_features(df, path)
    back = files.read_features(spark, path)
    assert back.schema == df.schema
    assert sorted(r["location"] for r in back.collect()) == ["007", "12"]


def test_names_that_fold_alike_are_one_station(spark):
    rows = [('"a"', 1.0, 2.0, "pm25", 1), ("a ", 1.5, 2.0, "pm25", 2), ("a", 1.0, 2.0, "no2", 3)]
    df = spark.createDataFrame(rows, "location string, latitude double, longitude double, parameter string, sensor_id long")
    reg = stations.registry(df).collect()
    assert len(reg) == 1 and reg[0]["lat"] == 1.0 and reg[0]["sensors"] == {"pm25": [1, 2], "no2": [3]}
    long = spark.createDataFrame([("a", T0, "pm25", 3.0)], "location string, datetime timestamp, parameter string, value double")
    two = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.5, 2.0)], "location string, latitude double, longitude double")
    assert clean.resample_station(long, two).count() == 1
    assert clean.station_coordinates(two).count() == 1


@pytest.mark.parametrize("lat,lon,km", [(60.0, 10.0, 1000.0), (0.0, 179.95, 25.0), (89.9, 0.0, 50.0), (-47.0, -179.99, 300.0), (10.0, 5.0, 0.0)])
def test_box_never_loses_a_station_of_the_circle(spark, lat, lon, km):
    rng = random.Random(2)
    pts = [(max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * (0.02 + km / 100))), (lon + rng.uniform(-1, 1) * 25 + 540) % 360 - 180)
           for _ in range(1500)] + [(lat, lon), (lat, -lon)]
    df = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(pts)], "location string, lat double, lon double")
    d = stations.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    want = {r["location"] for r in df.where(d <= km).collect()}
    assert {r["location"] for r in stations.within_radius(df, lat, lon, km).collect()} == want


def test_exact_quantiles_in_one_pass(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 40, 501).astype(float)
    y = rng.standard_normal(501)
    rows = [(float(a), None if i % 5 == 0 else float(b), None) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows + [(float("nan"), None, None)], "x double, y double, z double")
    got = exact_quantiles_many(df, ["x", "y", "z"], [0.0, 0.25, 0.5, 0.9, 1.0])
    assert np.allclose(got["x"], np.quantile(x, [0, 0.25, 0.5, 0.9, 1]))
    assert np.allclose(got["y"], np.quantile([b for i, b in enumerate(y) if i % 5], [0, 0.25, 0.5, 0.9, 1]))
    assert got["z"] == [None] * 5


def test_histogram_has_all_bins(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (9.9,)], "pm25 double")
    rows = sorted((r["bin"], r["n"]) for r in explore.histogram(df, "pm25", 10).collect())
    assert rows == [(0, 1), *[(i, 0) for i in range(1, 9)], (9, 2)]


class Linear:
    """prediction = 2 a - b, never c."""

    def transform(self, df):
        return df.withColumn("prediction", 2 * F.col("a") - F.col("b") + 0 * F.col("c"))


def _rows(spark, n=300):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((n, 3))
    return spark.createDataFrame([(*map(float, r), float(2 * r[0] - r[1])) for r in m], "a double, b double, c double, label double"), m


def test_permutation_importance_is_deterministic_and_ignores_unused(spark):
    df, _ = _rows(spark)
    got = {r["feature"]: r["importance"] for r in explain.permutation_importance(df.coalesce(1), Linear(), ["a", "b", "c"]).collect()}
    again = {r["feature"]: r["importance"] for r in explain.permutation_importance(df.coalesce(1), Linear(), ["a", "b", "c"]).collect()}
    assert got == pytest.approx(again, abs=1e-12) and abs(got["c"]) < 1e-9
    assert got["a"] > got["b"] > 0.1
    assert abs(got["a"] - 2 * 4 / 5) < 0.35                       # permuting a leaves twice its share of the variance


def test_shuffle_is_one_to_one(spark):
    for n in (1, 2, 7, 100, 1001):
        got = [r[0] for r in spark.range(n).select(explain._shuffled(F.col("id"), n, 3)).collect()]
        assert sorted(got) == list(range(n))


def test_shapley_values_of_a_linear_model_and_repeated_rows(spark):
    df, m = _rows(spark, 60)
    df = df.withColumn("k", F.col("a"))
    phi = explain.shapley_values(df, Linear(), ["a", "b", "c"], permutations=40, keys=["k"]).collect()
    mean = m.mean(0)
    err = [r["phi"] - 2 * (r["k"] - mean[0]) for r in phi if r["feature"] == "a"]
    assert len(phi) == 180 and abs(np.mean(err)) < 0.3 and np.std(err) < 0.8
    one = {r["feature"]: r["importance"] for r in explain.sampled_shapley(df, Linear(), ["a", "b", "c"], permutations=30).collect()}
    two = {r["feature"]: r["importance"] for r in explain.sampled_shapley(df.unionByName(df), Linear(), ["a", "b", "c"], permutations=30).collect()}
    assert one["c"] == two["c"] == 0
    for f in ("a", "b"):
        assert abs(one[f] - two[f]) < 0.15 * one[f]


def test_search_values_lie_in_the_spaces_and_best_trial_wins(spark):
    for name, space in models.SEARCH_SPACES.items():
        study = Study(space, startup=5)
        for t in study.ask(10) + [x for _ in range(10) for x in study.ask(3)]:
            study.tell(t, float(len(study.trials)))
            for k, spec in space.items():
                if spec[0] == "cat":
                    assert t[k] in spec[1]
                else:
                    assert spec[1] <= float(t[k]) <= spec[2], (name, k)
    res = spark.createDataFrame([(0, "x", 2.0), (1, "y", 1.0)], "trial int, params string, cv_mae double")
    assert models.best_trial(res).first()["params"] == "y"


def _training_rows(spark, n=240):
    rng = np.random.default_rng(9)
    cols = ", ".join(f"{f} double" for f in FEATURES)
    rows = []
    for i in range(n):
        x = rng.standard_normal(len(FEATURES))
        rows.append(("s", T0 + timedelta(hours=i), float(np.exp(1 + 0.3 * x[0]) ), *map(float, x)))
    return spark.createDataFrame(rows, f"location string, datetime timestamp, {TARGET} double, {cols}")


def test_search_refit_gap_and_ablation(spark):
    df = _training_rows(spark).cache()
    train, test = df.where(F.col("datetime") < F.lit(T0 + timedelta(hours=200))), df.where(F.col("datetime") >= F.lit(T0 + timedelta(hours=200)))
    found = models.cv_search(train, {"kind": "ridge"}, models.SEARCH_SPACES["Ridge"], trials=3, folds=2).collect()
    assert len(found) == 3 and all(r["cv_mae"] > 0 for r in found)
    presets = {"Ridge": models.PRESETS["Ridge"], "Weak": {"kind": "ridge", "alpha": 1e6}}
    res = models.train_and_select(train, test, presets, select_on="validation")
    # The choice does not see the test rows: with their target scrambled it stays the same.
    odd = test.withColumn(TARGET, 100 - F.col(TARGET))
    same = models.train_and_select(train, odd, presets, select_on="validation")
    assert (res.members, res.best) == (same.members, same.best) and res.members[0] == "Ridge"
    gap = {r["part"]: r for r in models.gap_report(res.models, train, test, ["Ridge"]).collect()}
    assert gap["train"]["MAE"] > 0 and gap["test"]["MAE"] > 0
    other = train.unionByName(train.withColumn("location", F.lit("t")).withColumn(TARGET, F.lit(50.0)))
    board = {(r["experiment"], r["model"]): r["MAE"] for r in models.group_ablation(other, test, "t", presets).collect()}
    assert board["without t", "Ridge"] < board["all", "Ridge"]


def test_stored_model_predicts_the_same(spark):
    train = _training_rows(spark).withColumn("pm10", F.when(F.col("no2") > 0, F.col("pm10")))
    m = models.fit_model(train, "T", {"kind": "boost", "rounds": 3, "max_depth": 2, "seed": 1})
    path = scratch_path(spark, "models")
    files.save_models([models.fit_model(train, "R", models.PRESETS["Ridge"]), m], path)
    back = files.load_models(spark, path)
    assert [b.name for b in back] == ["R", "T"] and back[1].spec == m.spec
    a = m.predict(train).select("datetime", F.col("pm25_pred").alias("a"))
    b = back[1].predict(train).select("datetime", F.col("pm25_pred").alias("b"))
    assert max(abs(r["a"] - r["b"]) for r in a.join(b, "datetime").collect()) == 0


def test_pca_and_clusters_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 3)) @ np.array([[2, 1, 0], [0, 1, 0.5], [0, 0, 0.3]])
    df = spark.createDataFrame([("s", T0 + timedelta(hours=i), *map(float, r)) for i, r in enumerate(x)],
                               "location string, datetime timestamp, a double, b double, c double")
    got = [r["explained_variance"] for r in explore.pca_variance(df, ["a", "b", "c"]).orderBy("component").collect()]
    ev = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert np.allclose(got, ev / ev.sum(), atol=1e-9)
    elbow, labels = explore.kmeans_elbow(df, ["a", "b", "c"], ks=range(3, 4), label_k=3)
    rows = labels.collect()
    assert len(rows) == 200
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    lab = np.array([r["cluster"] for r in sorted(rows, key=lambda r: r["datetime"])])
    inertia = sum(((z[lab == k] - z[lab == k].mean(0)) ** 2).sum() for k in range(3))
    assert math.isclose(inertia, elbow.first()["inertia"], rel_tol=1e-2)


def test_validation_tail_is_the_latest_part(spark):
    early, late = models.validation_tail(_training_rows(spark, 60))
    assert early.agg(F.max("datetime")).first()[0] < late.agg(F.min("datetime")).first()[0]
    assert late.count() == 10 and splits.ts_folds(60)[-1].val_end == 60
