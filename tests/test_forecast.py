"""Forecasting, recommendation and explanation operators."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from airgrid.operators import advise, explain, splits
from airgrid.operators import forecast as fc


def _weather(spark, start, hours):
    rows = [(start + timedelta(hours=i), 10.0 + i, 50.0, 1.0 + i % 3, 0.0, 0) for i in range(hours)]
    return spark.createDataFrame(rows, "datetime timestamp, temperature double, humidity double, "
                                       "wind_speed double, precipitation double, weather_code int")


def _base(spark, n=80, key="a", gaps=()):
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        v = None if i in gaps else float(10 + (i % 7))
        rows.append((key, t0 + timedelta(hours=i), 47.6, 17.6, 1.0, 2.0, v, 3.0, 5.0, 60.0, 1.5, 0.0))
    return spark.createDataFrame(rows, "location string, datetime timestamp, latitude double, longitude double, "
                                       "no2 double, pm10 double, pm25 double, so2 double, temperature double, "
                                       "humidity double, wind_speed double, precipitation double")


def test_asof_before_first_row_takes_last_row(spark):
    wx = _weather(spark, datetime(2024, 1, 2), 5)
    tg = spark.createDataFrame([(datetime(2024, 1, 1, 10),), (datetime(2024, 1, 2, 2, 30),)], "target timestamp")
    out = {r["target"]: r["temperature"] for r in fc.asof_weather(tg, wx, "target").collect()}
    assert out[datetime(2024, 1, 1, 10)] == 14.0          # none at or before -> last row
    assert out[datetime(2024, 1, 2, 2, 30)] == 12.0       # latest at or before 02:30


def test_local_time_dst(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 31, 1, 30),)], "datetime timestamp")
    assert fc.local_time(df).first()["datetime_local"] == datetime(2024, 3, 31, 3, 30)


def test_recursion_matches_python_loop(spark):
    base = _base(spark, 60)
    wx = _weather(spark, datetime(2024, 1, 1), 80)
    model = fc.LinearForecaster(coefs={"pm25_lag1": 0.6, "pm25_roll6": 0.4})
    out = fc.forecast_latest(base, wx, model).orderBy("horizon").collect()
    hist = [float(10 + (i % 7)) for i in range(60)]
    preds = []
    for _ in range(12):
        lag1 = hist[-1]
        roll6 = sum(hist[-6:]) / 6
        p = max(0.0, 0.6 * lag1 + 0.4 * roll6)
        hist.append(p)
        preds.append(p)
    assert [r["horizon"] for r in out] == list(range(1, 13))
    for r, p in zip(out, preds):
        assert abs(r["pm25_pred"] - p) < 1e-9


def test_backtest_state_ignores_future_rows(spark):
    wx = _weather(spark, datetime(2024, 1, 1), 100)
    a = fc.backtest(_base(spark, 80, gaps=(55, 56)), wx, fc.BLEND)
    # change rows after an origin: its forecasts must not move
    b_rows = _base(spark, 80, gaps=(55, 56)).withColumn(
        "pm25", F.when(F.col("datetime") > datetime(2024, 1, 3, 5), F.col("pm25") * 3).otherwise(F.col("pm25")))
    b = fc.backtest(b_rows, wx, fc.BLEND)
    o = datetime(2024, 1, 3, 5)
    pa = [r["y_pred"] for r in a.where(F.col("forecast_origin") == o).orderBy("horizon").collect()]
    pb = [r["y_pred"] for r in b.where(F.col("forecast_origin") == o).orderBy("horizon").collect()]
    assert pa and pa == pb


def test_backtest_origin_range(spark):
    wx = _weather(spark, datetime(2024, 1, 1), 100)
    bt = fc.backtest(_base(spark, 80), wx, fc.BLEND)
    n_origins = bt.select("forecast_origin").distinct().count()
    assert n_origins == 80 - 12 - 48
    assert bt.count() == n_origins * 12


def test_recommend_window_tie_takes_earliest(spark):
    t0 = datetime(2024, 1, 1)
    vals = [5.0, 1.0, 1.0, 1.0, 9.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([("a", t0 + timedelta(hours=i), v) for i, v in enumerate(vals)],
                               "location string, datetime timestamp, pm25_pred double")
    w = advise.recommend_window(df).first()
    assert w["window_end"] == t0 + timedelta(hours=3) and w["window_start"] == t0 + timedelta(hours=1)


def test_top_drivers(spark):
    eff = [("pm25_lag1", 3.0), ("hour_sin", 9.0), ("wind_speed", -4.0), ("so2", 0.5), ("pm10", 0.5),
           ("no2", -0.1), ("temperature", 2.0), ("custom_x", 1.0)]
    df = spark.createDataFrame([(eff,)], "effects array<struct<feature:string,value:double>>")
    out = df.select(explain.top_drivers(F.col("effects")).alias("d")).first()["d"]
    assert [(e["feature"], e["direction"]) for e in out] == [
        ("Wind", "down"), ("Recent PM", "up"), ("Temperature", "up"), ("custom_x", "up"), ("PM10", "up")]


def test_global_position_is_exact(spark):
    df = _base(spark, 30, "a").unionByName(_base(spark, 20, "b"))
    pos = sorted(r["pos"] for r in splits.global_position(df).collect())
    assert pos == list(range(50))


def test_ts_folds_layout():
    f = splits.ts_folds(60, 5)
    assert [(x.train_end, x.val_end) for x in f] == [(10, 20), (20, 30), (30, 40), (40, 50), (50, 60)]
