"""Fixed schemas and the domain's named column lists (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "location"
TIME = "datetime"

# ---- fixed values that must equal the reference's ---------------------------
# pollutants kept in the base table, in base-table order
POLLUTANTS = ["no2", "pm10", "pm25", "so2"]
# every parameter the raw feed may carry (co and o3 are dropped after the pivot)
ALL_PARAMETERS = ["pm25", "pm10", "no2", "so2", "co", "o3"]
DROPPED_PARAMETERS = ["co", "o3"]
WEATHER_COLS = ["temperature", "humidity", "wind_speed", "precipitation"]
COORD_COLS = ["latitude", "longitude"]
BASE_COLUMNS = ["location", "datetime", "latitude", "longitude",
                "no2", "pm10", "pm25", "so2",
                "temperature", "humidity", "wind_speed", "precipitation"]
FEATURES = [
    "pm10", "no2", "so2",
    "pm25_lag1", "pm25_lag3", "pm25_lag6", "pm25_lag24",
    "pm25_roll6", "pm25_roll24", "pm25_trend_3h", "pm25_std_12h",
    "hour", "hour_sin", "hour_cos", "month", "month_sin", "month_cos",
    "weekend_flag", "heating_season_flag",
    "temperature", "humidity", "wind_speed", "precipitation",
    "temp_change_3h", "humidity_change_3h", "wind_change_3h",
    "stagnation_index", "temp_wind_interaction", "mixing_index",
    "ventilation_index", "stagnation_hours_6h",
    "location_id", "lat_norm", "lon_norm",
]
# rows with a NULL in any of these are dropped before fitting / scoring
REQUIRED_COLUMNS = [
    "pm25_next", "pm25_lag1", "pm25_lag3", "pm25_lag6", "pm25_lag24",
    "pm25_roll6", "pm25_roll24", "pm25_trend_3h", "pm25_std_12h",
    "temp_change_3h", "humidity_change_3h", "wind_change_3h",
    "stagnation_hours_6h",
]
HEATING_MONTHS = [10, 11, 12, 1, 2, 3, 4]
INTERP_LIMIT = 3
HORIZON = 12               # forecast steps, hours
HISTORY_HOURS = 48         # readings that a forecast looks back on
EXTREME = 500.0            # predictions above are flagged
LOW_WIND = 2.0             # wind below counts as stagnant
TARGET = "pm25_next"
LOCAL_TZ = "Europe/Budapest"
# ------------------------------------------------------------------------------

MEASUREMENT = T.StructType([
    T.StructField("location", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("datetime", T.TimestampType()),
    T.StructField("parameter", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

WEATHER = T.StructType([
    T.StructField("datetime", T.TimestampType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("humidity", T.DoubleType()),
    T.StructField("wind_speed", T.DoubleType()),
    T.StructField("precipitation", T.DoubleType()),
    T.StructField("weather_code", T.IntegerType()),
])

WIDE_POLLUTANTS = T.StructType(
    [T.StructField("datetime", T.TimestampType()),
     T.StructField("location", T.StringType()),
     T.StructField("latitude", T.DoubleType()),
     T.StructField("longitude", T.DoubleType())]
    + [T.StructField(p, T.DoubleType()) for p in ALL_PARAMETERS])

STATION = T.StructType([
    T.StructField("location", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("sensors", T.MapType(T.StringType(), T.ArrayType(T.LongType()))),
])
