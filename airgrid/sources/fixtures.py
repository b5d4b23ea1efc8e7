"""Adapter from the driver's ``events`` table to the domain tables.

* MEASUREMENT: one reading per event; the station is ``user_id % stations``.
* WEATHER: one row per hour, aggregated from the events of that hour.

Both are plain projections / aggregations, so column pruning and predicate
pushdown reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values of the adapter ---------------------------------------------
EVENT_PARAMETER = [("view", "pm25"), ("click", "pm10"), ("purchase", "no2"),
                   ("signup", "so2"), ("error", "o3")]
WEATHER_CODES = [0, 2, 45, 51, 61, 71, 80, 95]
SENTINEL_EVERY = 50          # every 50th event reads -1 ("no reading")
STATION_PREFIX = '"Győr '    # raw names carry quotes, an accent and a trailing blank
BASE_LAT, BASE_LON, STEP_DEG = 47.6, 17.6, 0.01
DEFAULT_STATIONS = 3
# ------------------------------------------------------------------------------


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def station_id(stations: int) -> Column:
    return F.col("user_id") % F.lit(stations)


def raw_station_name(stations: int) -> Column:
    return F.concat(F.lit(STATION_PREFIX), station_id(stations).cast("string"), F.lit('" '))


def _coord(base: float, stations: int) -> Column:
    # decimal arithmetic, then double: identical in every SQL engine
    return F.expr(f"cast({base} + (user_id % {stations}) * {STEP_DEG} as double)")


def parameter_of(event_type: Column) -> Column:
    out = None
    for ev, par in EVENT_PARAMETER:
        out = (F.when(event_type == ev, par) if out is None
               else out.when(event_type == ev, par))
    return out


def measurements(events: DataFrame, stations: int = DEFAULT_STATIONS,
                 hourly: bool = True) -> DataFrame:
    """Long readings ``location, latitude, longitude, datetime, parameter, value``.

    ``hourly=False`` keeps the raw event time to exercise sub-hour resampling.
    """
    ts = F.date_trunc("hour", F.col("ts")) if hourly else F.col("ts")
    return events.select(
        raw_station_name(stations).alias("location"),
        _coord(BASE_LAT, stations).alias("latitude"),
        _coord(BASE_LON, stations).alias("longitude"),
        ts.cast("timestamp").alias("datetime"),
        parameter_of(F.col("event_type")).alias("parameter"),
        F.when(F.col("event_id") % SENTINEL_EVERY == 0, F.lit(-1.0))
         .otherwise(F.col("value")).cast("double").alias("value"),
    )


def weather(events: DataFrame) -> DataFrame:
    """Hourly weather ``datetime, temperature, humidity, wind_speed, precipitation, weather_code``."""
    s_ev = F.sum("event_id")
    codes = F.array(*[F.lit(c) for c in WEATHER_CODES])
    return (events
            .groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp").alias("datetime"))
            .agg((F.pmod(s_ev, F.lit(300)).cast("double") / 10.0 - 5.0).alias("temperature"),
                 (40.0 + F.pmod(F.sum("user_id"), F.lit(60)).cast("double")).alias("humidity"),
                 (F.pmod(s_ev, F.lit(80)).cast("double") / 10.0).alias("wind_speed"),
                 (F.pmod(F.count(F.lit(1)), F.lit(7)).cast("double") / 10.0).alias("precipitation"),
                 F.element_at(codes, (F.pmod(s_ev, F.lit(8)) + 1).cast("int"))
                  .cast("int").alias("weather_code")))


def load(spark: SparkSession, sf_dir: str, stations: int = DEFAULT_STATIONS,
         hourly: bool = True) -> tuple[DataFrame, DataFrame]:
    """(measurements, weather) for a scale-factor folder."""
    ev = read_table(spark, sf_dir, "events")
    return measurements(ev, stations, hourly), weather(ev)
