"""Composed jobs run end to end (offline training job, backtest plan)."""

from airgrid.operators import clean, models
from airgrid.operators import forecast as fc
from airgrid.plans import backtest, offline, serving
from airgrid.sources import files, fixtures

from pyspark.sql import functions as F

from conftest import SF01


def test_offline_job_and_backtest_plan(spark):
    meas, wx = fixtures.load(spark, SF01, 3)
    presets = {"Ridge": models.PRESETS["Ridge"],
               "HistGB": {**models.PRESETS["HistGB"], "rounds": 3, "max_depth": 3}}
    res = offline.run(meas, wx, presets)
    m = res.metrics.first()
    assert m["n"] > 0 and m["MAE"] >= 0 and m["MASE"] is not None
    assert res.training.best in {"Ridge", "HistGB", "ENSEMBLE"}
    base = clean.base_from_measurements(meas, wx)
    # serving with the stored model: five drivers for every step
    loaded = serving.load_forecaster(spark, res.model_path)
    names = res.training.members if res.training.best == "ENSEMBLE" else [res.training.best]
    assert [m.name for m in files.load_models(spark, res.model_path)] == names and len(loaded.parts) == len(names)
    wxd = clean.dedup_weather(wx)
    a = fc.forecast_latest(base, wxd, loaded, res.fit)
    b = fc.forecast_latest(base, wxd, models.as_forecaster([res.training.models[n] for n in names]), res.fit)
    key = ["location", "horizon"]
    pairs = a.select(*key, F.col("pm25_pred").alias("a")).join(b.select(*key, F.col("pm25_pred").alias("b")), key).collect()
    assert len(pairs) == 36 and max(abs(r["a"] - r["b"]) for r in pairs) < 1e-9
    served = serving.batch_forecast(base, wxd, loaded, res.fit).collect()
    assert len(served) == 3
    for r in served:
        assert len(r["forecast"]) == 12 and all(len(s["drivers"]) == 5 for s in r["forecast"])
    bt, hz, org = backtest.run(base, clean.dedup_weather(wx), fc.BLEND)
    assert sorted(r["horizon"] for r in hz.collect()) == list(range(1, 13))
    assert org.count() == bt.select("location", "forecast_origin").distinct().count()
