"""Model layer: Ridge closed form parity, both recursion paths agree, leaderboard shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.catalog import common as cm
from airgrid.operators import clean, models, splits
from airgrid.operators import forecast as fc

from conftest import SF01


@pytest.fixture(scope="module")
def data(spark):
    tr, te, fit, _ = cm.test_features(spark, SF01)
    train = splits.complete_cases(splits.add_target(tr)).cache()
    test = splits.complete_cases(splits.add_target(te)).cache()
    return train, test, fit


@pytest.fixture(scope="module")
def ridge(data):
    train, _, _ = data
    return models.fit_model(train, "Ridge", models.PRESETS["Ridge"])


def test_ridge_as_linear_expression_matches_spark_ml(data, ridge):
    _, test, _ = data
    a = ridge.predict(test).select("location", "datetime", F.col("pm25_pred").alias("a"))
    lin = models.to_linear(ridge)
    b = lin.predict(test).select("location", "datetime", F.col("_pred").alias("b"))
    rows = a.join(b, ["location", "datetime"]).collect()
    assert rows and max(abs(r["a"] - r["b"]) for r in rows) < 1e-6


def test_recursion_paths_agree(spark, data, ridge):
    """The vectorised (mapInPandas) and the per-step Spark ML recursions give the same forecast."""
    _, _, fit = data
    meas, wx = cm.inputs(spark, SF01)
    base = clean.base_from_measurements(meas, wx)
    wxd = clean.dedup_weather(wx)
    ml = fc.forecast_latest(base, wxd, fc.MLForecaster([ridge]), fit)
    lin = fc.forecast_latest(base, wxd, models.to_linear(ridge), fit)
    j = ml.select("location", "horizon", F.col("pm25_pred").alias("a")).join(
        lin.select("location", "horizon", F.col("pm25_pred").alias("b")), ["location", "horizon"]).collect()
    assert len(j) == 36
    assert max(abs(r["a"] - r["b"]) for r in j) < 1e-6


def test_leaderboard_and_ensemble(data):
    train, test, _ = data
    presets = {"Ridge": models.PRESETS["Ridge"],
               "HistGB": {**models.PRESETS["HistGB"], "rounds": 5, "max_depth": 3}}
    res = models.train_and_select(train, test, presets)
    board = {r["model"]: r for r in res.board.collect()}
    assert set(board) == {"Ridge", "HistGB", "ENSEMBLE"}
    assert len(res.members) == 2 and res.best in board
    assert all(r["MAE"] >= 0 for r in board.values())


def test_predictions_non_negative(data, ridge):
    _, test, _ = data
    assert ridge.predict(test).where(F.col("pm25_pred") < 0).count() == 0


def test_tree_ensemble_recursion_agrees_with_steps(spark, data, ridge):
    """Flat trees inside the recursion forecast what one transform per step does, with exact effects."""
    train, _, fit = data
    boosted = models.fit_model(train, "B", {"kind": "boost", "rounds": 20, "max_depth": 4, "min_leaf": 10})
    meas, wx = cm.inputs(spark, SF01)
    base, wxd = clean.base_from_measurements(meas, wx), clean.dedup_weather(wx)
    members = [ridge, boosted]
    steps = fc.forecast_latest(base, wxd, fc.MLForecaster(members), fit)
    flat = fc.forecast_latest(base, wxd, models.as_forecaster(members), fit, explain=True).cache()
    j = steps.select("location", "horizon", F.col("pm25_pred").alias("a")).join(flat, ["location", "horizon"]).collect()
    assert len(j) == 36 and max(abs(r["a"] - r["pm25_pred"]) for r in j) < 1e-6
    assert all(len(r["effects"]) == 34 for r in j)
    one = fc.forecast_latest(base, wxd, models.as_forecaster([boosted]), fit, explain=True).collect()
    empty = boosted.trees.attributions(np.zeros((1, 34)))[1]
    assert max(abs(np.expm1(empty + sum(e["value"] for e in r["effects"])) - r["pm25_pred"]) for r in one) < 1e-9
    back = fc.backtest(base, wxd, models.as_forecaster(members), fit)
    assert back.count() > 1000 and back.where(F.col("y_pred").isNull()).count() == 0
