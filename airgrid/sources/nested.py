"""Nested JSON ingest (S07, S08) with explicit schemas.

Landed API pages are read as JSON lines.  Parallel hourly arrays are zipped and
exploded; result lists are exploded and flattened by struct paths.  Each page is
one row, so explode work spreads with the pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.schemas import KEY, TIME

# ---- fixed values: field names of the landed weather payload -------------------
WEATHER_FIELDS = [("temperature_2m", "temperature"), ("relative_humidity_2m", "humidity"),
                  ("wind_speed_10m", "wind_speed"), ("precipitation", "precipitation"),
                  ("weather_code", "weather_code")]
WEATHER_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm"
MEASUREMENT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"
# ---------------------------------------------------------------------------------

WEATHER_JSON = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("hourly", T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()))]
        + [T.StructField(src, T.ArrayType(T.IntegerType() if src == "weather_code" else T.DoubleType()))
           for src, _ in WEATHER_FIELDS])),
])

MEASUREMENT_JSON = T.StructType([
    T.StructField("location", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("period", T.StructType([
            T.StructField("datetime_from", T.StructType([T.StructField("utc", T.StringType())]))])),
        T.StructField("parameter", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("value", T.DoubleType()),
    ]))),
])


def parse_weather(pages: DataFrame) -> DataFrame:
    """Zip the parallel ``hourly`` arrays into rows, rename, parse UTC times."""
    h = F.col("hourly")
    zipped = F.arrays_zip(h["time"].alias("time"), *[h[src].alias(src) for src, _ in WEATHER_FIELDS])
    rows = pages.select(F.explode(zipped).alias("r"))
    return rows.select(F.to_timestamp(F.col("r.time"), WEATHER_TIME_FORMAT).alias(TIME),
                       *[F.col(f"r.{src}").alias(dst) for src, dst in WEATHER_FIELDS])


def read_weather_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_weather(spark.read.schema(WEATHER_JSON).json(path))


def parse_measurements(pages: DataFrame) -> DataFrame:
    """One row per result; time is the *start* of the averaging period (UTC)."""
    r = pages.select(KEY, "latitude", "longitude", F.explode("results").alias("r"))
    return r.select(KEY, "latitude", "longitude",
                    F.to_timestamp(F.col("r.period.datetime_from.utc"), MEASUREMENT_TIME_FORMAT).alias(TIME),
                    F.col("r.parameter.name").alias("parameter"),
                    F.nanvl(F.col("r.value"), F.lit(None).cast("double")).alias("value"))


def read_measurements_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_measurements(spark.read.schema(MEASUREMENT_JSON).json(path))


def weather_pages(weather: DataFrame) -> DataFrame:
    """Land an hourly weather table as day pages with parallel arrays (the API layout)."""
    day = F.to_date(TIME)
    packed = F.array_sort(F.collect_list(F.struct(F.col(TIME).alias("t"),
                                                  *[F.col(dst).alias(src) for src, dst in WEATHER_FIELDS])))
    g = weather.groupBy(day.alias("_d")).agg(packed.alias("_a"))
    return g.select(F.struct(
        F.transform("_a", lambda s: F.date_format(s["t"], WEATHER_TIME_FORMAT)).alias("time"),
        *[F.transform("_a", _get(src)).alias(src) for src, _ in WEATHER_FIELDS]).alias("hourly"))


def measurement_pages(long: DataFrame) -> DataFrame:
    """Land readings as pages per (station, hour) with nested result objects."""
    res = F.struct(
        F.struct(F.struct(F.date_format(TIME, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc")).alias("datetime_from"))
        .alias("period"),
        F.struct(F.col("parameter").alias("name")).alias("parameter"),
        F.col("value").alias("value"))
    g = long.groupBy(KEY, "latitude", "longitude", F.date_trunc("hour", TIME).alias("_h"))
    return g.agg(F.collect_list(res).alias("results")).drop("_h")


def _get(name: str):
    return lambda s: s[name]
