"""E-B re-aimed as a batch job (P09): forecasts, explanations and advice for every station.

Output, one row per station: the last 12 observed hours, the 12-hour forecast
(with local time, band colour, top drivers and warnings), and the recommended
window with its advice text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.operators import advise, explain, models, splits
from airgrid.operators import forecast as fc
from airgrid.schemas import KEY, TIME
from airgrid.session import cut_lineage
from airgrid.sources import files


def load_forecaster(spark: SparkSession, path: str) -> fc.MLForecaster:
    """The model or ensemble that the offline job stored."""
    return models.as_forecaster(files.load_models(spark, path))


def batch_forecast(base: DataFrame, weather: DataFrame, model: fc.Forecaster, fit=None,
                   horizon: int = fc.HORIZON) -> DataFrame:
    hist = fc.serving_history(fc.recent_rows(base), weather)          # the hours that a forecast looks back on
    tail = splits.last_valid_history(hist, 12)
    fcst = fc.forecast_latest(base, weather, model, fit, horizon, explain=True)
    fcst = advise.attach_weather_code(fcst, weather)
    fcst = advise.concentration_band(fc.local_time(fcst))
    fcst = cut_lineage(fcst.withColumn("drivers", explain.top_drivers(F.col("effects"))))     # used three times
    win = advise.recommend_window(fcst, "pm25_pred")
    facts = advise.window_output(advise.window_facts(fcst, win))
    fc_rows = fcst.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(
        TIME, "datetime_local", "pm25_pred", "band_colour", "weather_code", "drivers",
        "missing_features", "is_extreme"))).alias("forecast"))
    hist_rows = tail.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(
        TIME, "pm25", "weather_code"))).alias("history"))
    return hist_rows.join(fc_rows, KEY, "full").join(facts, KEY, "left")
