"""Recommendation operators.

All per station: the best window is a guarded 3-row trailing mean and a
``row_number`` (first minimum); window facts are a range join expressed as a
join on the station key plus a time filter (each station has one window).
The weather-code dimension is a fixed table of a few dozen codes, so it is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgrid.schemas import KEY, LOCAL_TZ, TIME

# ---- fixed values that must equal the reference's -----------------------------
PM_THRESHOLD = 15.0
GOOD_WEATHER = [0, 1, 2, 3]
GOOD_SHARE = 0.5
ADVICE_BOTH = "🌿 Best time for outdoor activities and ventilation"
ADVICE_PM = "🪟 Best time for ventilation"
ADVICE_WEATHER = "⚠️ Air quality is poor – avoid outdoor activities"
ADVICE_NONE = "🚫 Poor air quality – keep windows closed"
# concentration bands: upper bound (inclusive) -> colour
BANDS = [(12.0, "#d4edda"), (35.0, "#fff3cd"), (55.0, "#ffe5b4")]
BAND_ABOVE = "#f8d7da"
NIGHT_BEFORE, NIGHT_FROM = 6, 20
# WMO weather-code groups: (codes, class, day icon, night icon)
WEATHER_GROUPS = [
    ([0], "clear", "☀️", "🌙"),
    ([1, 2, 3], "partly_cloudy", "⛅", "☁️"),
    ([45, 48], "fog", "🌫️", "🌫️"),
    ([51, 53, 55], "drizzle", "🌦️", "🌧️"),
    ([56, 57], "freezing_drizzle", "🌧️❄️", "🌧️❄️"),
    ([61, 63, 65], "rain", "🌧️", "🌧️"),
    ([66, 67], "freezing_rain", "🌧️❄️", "🌧️❄️"),
    ([71, 73, 75], "snow", "❄️", "❄️"),
    ([77], "snow_grains", "🌨️", "🌨️"),
    ([80, 81, 82], "rain_showers", "🌦️", "🌧️"),
    ([85, 86], "snow_showers", "🌨️", "🌨️"),
    ([95], "thunderstorm", "⛈️", "⛈️"),
    ([96, 99], "thunderstorm_hail", "⛈️🧊", "⛈️🧊"),
]
FALLBACK_CLASS, FALLBACK_ICON = "other", "☁️"
# --------------------------------------------------------------------------------


def recommend_window(df: DataFrame, value: str = "pm25_pred", window: int = 3,
                     key: str = KEY, time: str = TIME) -> DataFrame:
    """Per station, the trailing ``window``-row mean (all rows present) with the
    lowest value; ties go to the earliest end.  start = end - (window - 1) hours."""
    w = Window.partitionBy(key).orderBy(time)
    f = w.rowsBetween(-(window - 1), 0)
    m = F.when(F.count(value).over(f) == window, F.avg(value).over(f))
    scored = df.select(key, time, m.alias("window_mean")).where("window_mean IS NOT NULL")
    best = Window.partitionBy(key).orderBy("window_mean", time)
    top = scored.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    return top.select(key, (F.col(time) - F.make_dt_interval(F.lit(0), F.lit(window - 1)))
                      .alias("window_start"), F.col(time).alias("window_end"), "window_mean")


def attach_weather_code(df: DataFrame, weather: DataFrame, time: str = TIME) -> DataFrame:
    """Left join of the hourly weather code on the exact time."""
    codes = weather.groupBy(TIME).agg(F.max("weather_code").alias("weather_code"))
    return df.join(codes.withColumnRenamed(TIME, time), time, "left")


def window_facts(series: DataFrame, windows: DataFrame, value: str = "pm25_pred",
                 time: str = TIME) -> DataFrame:
    """B03 + B04: mean value, share of good-weather codes and representative code per window.

    Representative code: the code of the middle row (index len // 2), else the
    first non-NULL code, else NULL.
    """
    rows = (series.join(windows, KEY)
            .where((F.col(time) >= F.col("window_start")) & (F.col(time) <= F.col("window_end"))))
    packed = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"),
                                                  F.col("weather_code").alias("c"))))
    g = rows.groupBy(KEY, "window_start", "window_end").agg(
        F.avg(value).alias("avg_pm"),
        F.count("weather_code").alias("_nc"),
        F.count(F.when(F.col("weather_code").isin(GOOD_WEATHER), 1)).alias("_ng"),
        packed.alias("_rows"))
    mid = F.try_element_at("_rows", (F.size("_rows") / 2).cast("int") + 1)["c"]
    first_valid = F.try_element_at(F.filter("_rows", lambda r: r["c"].isNotNull()), F.lit(1))["c"]
    return g.select(KEY, "window_start", "window_end", "avg_pm",
                    F.when(F.col("_nc") > 0, F.col("_ng") / F.col("_nc")).otherwise(F.lit(0.0))
                    .alias("weather_ratio"),
                    F.coalesce(mid, first_valid).alias("weather_code"))


def advice(facts: DataFrame) -> DataFrame:
    """B05 + B06: advice text from (pm below threshold) x (good-weather share)."""
    pm_ok = F.col("avg_pm") < PM_THRESHOLD
    wx_ok = F.col("weather_ratio") >= GOOD_SHARE
    text = (F.when(pm_ok & wx_ok, ADVICE_BOTH).when(pm_ok, ADVICE_PM)
            .when(wx_ok, ADVICE_WEATHER).otherwise(ADVICE_NONE))
    return facts.withColumn("recommendation_text", text)


def window_output(facts: DataFrame) -> DataFrame:
    """The recommended-window struct per station."""
    return advice(facts).select(KEY, F.struct(
        F.col("window_start").alias("start"), F.col("window_end").alias("end"),
        "recommendation_text", "weather_code").alias("recommended_window"))


def concentration_band(df: DataFrame, value: str = "pm25_pred") -> DataFrame:
    """Colour band of a concentration (upper bounds inclusive)."""
    c = None
    for ub, colour in BANDS:
        c = F.when(F.col(value) <= ub, colour) if c is None else c.when(F.col(value) <= ub, colour)
    return df.withColumn("band_colour", c.otherwise(BAND_ABOVE))


def weather_codes(spark: SparkSession) -> DataFrame:
    """The code dimension (a fixed table of WMO codes)."""
    rows = [(code, cls, day, night) for codes, cls, day, night in WEATHER_GROUPS for code in codes]
    return spark.createDataFrame(rows, "weather_code int, weather_class string, icon_day string, icon_night string")


def weather_icon(df: DataFrame, time: str = TIME, tz: str = LOCAL_TZ) -> DataFrame:
    """Weather class and day/night icon (night: local hour < 6 or >= 20)."""
    dim = F.broadcast(weather_codes(df.sparkSession))
    local_hour = F.hour(F.from_utc_timestamp(F.col(time), tz))
    night = (local_hour < NIGHT_BEFORE) | (local_hour >= NIGHT_FROM)
    j = df.join(dim, "weather_code", "left")
    return j.select(*df.columns, night.cast("int").alias("is_night"),
                    F.coalesce("weather_class", F.lit(FALLBACK_CLASS)).alias("weather_class"),
                    F.coalesce(F.when(night, F.col("icon_night")).otherwise(F.col("icon_day")),
                               F.lit(FALLBACK_ICON)).alias("icon"))
