"""Catalog: sources, sinks and registry operators.

File round trips land data that Spark derives from the driver tables in the
shared checkpoint folder and read it back with the explicit schemas.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.catalog import common as cm
from airgrid.catalog import sql_parts as sp
from airgrid.catalog.registry import query
from airgrid.operators import clean
from airgrid.schemas import BASE_COLUMNS, WEATHER_COLS
from airgrid.session import scratch_path
from airgrid.sources import files, fixtures, nested, stations

WITH_BASE = "WITH " + sp.BASE_CTES
_WIDE_OUT = sp.out(["latitude", "longitude", "pm25", "pm10", "no2", "so2", "co", "o3"])


@query("s01_pollutants_csv", WITH_BASE + "\nSELECT datetime, location, " + _WIDE_OUT + " FROM wide")
def s01_pollutants_csv(spark, sf_dir):
    """Wide pollutant table landed as CSV and read back with the fixed schema."""
    path = scratch_path(spark, "pollutants-csv")
    files.write_csv(cm.wide(spark, sf_dir), path)
    return files.read_pollutants_csv(spark, path)


@query("s02_weather_csv", WITH_BASE + "\nSELECT datetime, " + sp.out(sp.WX) + " FROM wx_raw")
def s02_weather_csv(spark, sf_dir):
    """Weather CSV with a stray index column; the index is projected away."""
    _, wx = cm.inputs(spark, sf_dir)
    path = scratch_path(spark, "weather-csv")
    files.write_csv(wx.select("datetime", *WEATHER_COLS), path, index=True)
    return files.read_weather_csv(spark, path)


@query("s03_features_parquet", WITH_BASE + ",\n" + sp.interp_station("filled", "base") +
       "\nSELECT " + sp.out(BASE_COLUMNS, keep={"location", "datetime"}) + " FROM filled")
def s03_features_parquet(spark, sf_dir):
    """Gap-filled panel written as Parquet by month, read back."""
    path = scratch_path(spark, "panel-parquet")
    files.write_features(clean.interpolate_station(cm.base(spark, sf_dir)), path)
    return files.read_features(spark, path).select(*BASE_COLUMNS)


@query("s05_metrics_json", WITH_BASE + "\nSELECT CAST(count(*) AS BIGINT) AS n, " +
       sp.r("avg(pm25)", "mean_pm25") + ", " + sp.r("max(pm25)", "max_pm25") + " FROM base")
def s05_metrics_json(spark, sf_dir):
    """A one-row metric record through the JSON sink."""
    rec = cm.base(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg("pm25").alias("mean_pm25"),
                                     F.max("pm25").alias("max_pm25"))
    path = scratch_path(spark, "metrics-json")
    files.write_metrics_json(rec, path)
    return spark.read.schema("n long, mean_pm25 double, max_pm25 double").json(path)


@query("s07_weather_json", WITH_BASE + "\nSELECT datetime, " + sp.out(sp.WX) +
       ", CAST(weather_code AS BIGINT) AS weather_code FROM wx_raw")
def s07_weather_json(spark, sf_dir):
    """Day pages with parallel hourly arrays, zipped and exploded back to rows."""
    _, wx = cm.inputs(spark, sf_dir)
    path = scratch_path(spark, "weather-json")
    nested.weather_pages(wx).write.mode("overwrite").json(path)
    return nested.read_weather_json(spark, path)


@query("s08_measurement_json", WITH_BASE + "\nSELECT location, " + sp.out(["latitude", "longitude"]) +
       ", datetime, parameter, " + sp.r("value", "value") + " FROM meas")
def s08_measurement_json(spark, sf_dir):
    """Nested result pages flattened to one reading per row."""
    meas, _ = cm.inputs(spark, sf_dir)
    path = scratch_path(spark, "measurement-json")
    nested.measurement_pages(meas).write.mode("overwrite").json(path)
    return nested.read_measurements_json(spark, path)


@query("s09_time_range", WITH_BASE + "\nSELECT " + sp.out(BASE_COLUMNS, keep={"location", "datetime"}) +
       " FROM base WHERE datetime BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
def s09_time_range(spark, sf_dir):
    """Inclusive time-range filter pushed into the Parquet scan of a landed panel."""
    path = scratch_path(spark, "panel-range")
    files.write_features(cm.base(spark, sf_dir), path)
    return files.time_range(files.read_features(spark, path), "2024-01-10 00:00:00",
                            "2024-01-20 12:00:00").select(*BASE_COLUMNS)


@query("s11_station_resample", WITH_BASE + """,
m AS (SELECT trim(strip_accents(replace(location, '"', ''))) AS location, datetime, parameter, value FROM meas),
pt AS (SELECT location, datetime, """ + ", ".join(
    f"avg(CASE WHEN parameter = '{p}' THEN value END) AS {p}" for p in sp.POLL) + """
       FROM m WHERE datetime IS NOT NULL GROUP BY location, datetime),
h AS (SELECT location, date_trunc('hour', datetime) AS datetime, """ + ", ".join(
    f"avg({p}) AS {p}" for p in sp.POLL) + """ FROM pt GROUP BY 1, 2),
sp AS (SELECT location, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime
       FROM (SELECT location, min(datetime) AS lo, max(datetime) AS hi FROM h GROUP BY location))
SELECT s.location, s.datetime, """ + sp.out(["latitude", "longitude"] + sp.POLL) + """
FROM sp s LEFT JOIN h USING (location, datetime) LEFT JOIN coords USING (location)""")
def s11_station_resample(spark, sf_dir):
    """Readings without coordinates -> hourly grid per station + registry coordinates."""
    meas, _ = cm.inputs(spark, sf_dir)
    long = clean.clean_locations(meas.select("location", "datetime", "parameter", "value"))
    coords = clean.clean_locations(meas.select("location", "latitude", "longitude").distinct())
    return clean.resample_station(long, coords)


def _registry(spark, sf_dir, k=cm.STATIONS):
    ev = cm.events(spark, sf_dir)
    # sensor = the reporting user (several sensors per station and parameter)
    readings = ev.select(fixtures.raw_station_name(k).alias("location"),
                         F.expr(f"cast({fixtures.BASE_LAT} + (user_id % {k}) * {fixtures.STEP_DEG} as double)")
                         .alias("latitude"),
                         F.expr(f"cast({fixtures.BASE_LON} + (user_id % {k}) * {fixtures.STEP_DEG} as double)")
                         .alias("longitude"),
                         fixtures.parameter_of(F.col("event_type")).alias("parameter"),
                         F.col("user_id").alias("sensor_id"))
    return stations.registry(readings)


_REG = """,
reg_pairs AS (SELECT DISTINCT trim(strip_accents(replace(location, '"', ''))) AS location, latitude AS lat,
                     longitude AS lon, parameter, user_id AS sensor_id
              FROM (SELECT *, concat('"Győr ', CAST(user_id % {k} AS VARCHAR), '" ') AS location,
                           CAST(47.6 + (user_id % {k}) * 0.01 AS DOUBLE) AS latitude,
                           CAST(17.6 + (user_id % {k}) * 0.01 AS DOUBLE) AS longitude,
                           CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10'
                                WHEN 'purchase' THEN 'no2' WHEN 'signup' THEN 'so2' WHEN 'error' THEN 'o3' END AS parameter
                    FROM events))"""


@query("s12_radius_search", "WITH " + _REG.format(k=1500).lstrip(",\n") + """,
st AS (SELECT DISTINCT location, lat, lon FROM reg_pairs),
d AS (SELECT *, 2 * 6371.0 * asin(sqrt(pow(sin((radians(lat) - radians(47.6875)) / 2), 2)
        + cos(radians(47.6875)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(17.6504)) / 2), 2))) AS distance_km
      FROM st)
SELECT location, """ + sp.out(["lat", "lon", "distance_km"]) + " FROM d WHERE distance_km <= 25.0")
def s12_radius_search(spark, sf_dir):
    """Stations (one per user) within 25 km of the reference point; box prefilter, then haversine."""
    st = _registry(spark, sf_dir, 1500)
    return stations.within_radius(st).select("location", "lat", "lon", "distance_km")


@query("s13_sensor_index", "WITH " + _REG.format(k=3).lstrip(",\n") + """
SELECT DISTINCT CAST(sensor_id AS BIGINT) AS sensor_id, parameter, location, """ +
       sp.out(["lat", "lon"]).replace("AS lat,", "AS latitude,").replace("AS lon", "AS longitude") +
       " FROM reg_pairs WHERE parameter IN ('pm25', 'pm10', 'no2', 'so2', 'co', 'o3')")
def s13_sensor_index(spark, sf_dir):
    return stations.sensor_index(_registry(spark, sf_dir))


@query("s14_sensor_map", "WITH " + _REG.format(k=3).lstrip(",\n") + """,
idx AS (SELECT DISTINCT sensor_id, parameter, location FROM reg_pairs)
SELECT parameter, location, CAST(count(*) AS BIGINT) AS n_sensors,
       string_agg(CAST(sensor_id AS VARCHAR), ',' ORDER BY sensor_id) AS sensors
FROM idx WHERE parameter IN ('pm25', 'pm10', 'no2', 'so2', 'co', 'o3') GROUP BY parameter, location""")
def s14_sensor_map(spark, sf_dir):
    """(parameter, location) -> sorted sensor list (flattened to text for comparison)."""
    m = stations.sensor_map(stations.sensor_index(_registry(spark, sf_dir)))
    return m.select("parameter", "location", F.size("sensors").cast("long").alias("n_sensors"),
                    F.array_join(F.col("sensors").cast("array<string>"), ",").alias("sensors"))


@query("s15_unknown_requests", "WITH " + _REG.format(k=3).lstrip(",\n") + """,
req AS (SELECT DISTINCT trim(strip_accents(replace(concat('"Győr ', CAST(user_id % 5 AS VARCHAR), '" '), '"', '')))
               AS location FROM events)
SELECT location FROM req r WHERE NOT EXISTS (SELECT 1 FROM reg_pairs g WHERE g.location = r.location)""")
def s15_unknown_requests(spark, sf_dir):
    """Forecast requests for 5 stations checked against the 3-station registry (anti-join)."""
    ev = cm.events(spark, sf_dir)
    req = clean.clean_locations(ev.select(fixtures.raw_station_name(5).alias("location")).distinct())
    return stations.unknown_requests(req, _registry(spark, sf_dir))


@query("s04_forecast_csv", WITH_BASE + ",\n" + sp.forecast_state(
    "r._rn = (SELECT max(r2._rn) FROM rows r2 WHERE r2.location = r.location)") + ",\n" + sp.recursion() + "\n" +
    "\nUNION ALL ".join(
        f"SELECT origin + INTERVAL {s} HOUR AS datetime, location, {sp.r(f'p{s}', 'pm25_pred')}, "
        f"timezone('Europe/Budapest', timezone('UTC', origin + INTERVAL {s} HOUR)) AS datetime_local FROM r12"
        for s in range(1, 13)))
def s04_forecast_csv(spark, sf_dir):
    """Forecast table (with local time) through the CSV sink and back."""
    from airgrid.operators import forecast as fc
    _, wx = cm.inputs(spark, sf_dir)
    out = fc.local_time(fc.forecast_latest(cm.base(spark, sf_dir), clean.dedup_weather(wx), fc.BLEND))
    path = scratch_path(spark, "forecast-csv")
    files.write_csv(out.select("datetime", "location", "pm25_pred", "datetime_local"), path)
    return spark.read.schema("datetime timestamp, location string, pm25_pred double, datetime_local timestamp") \
        .option("header", True).option("timestampFormat", files.TS_FORMAT).csv(path)


@query("s06_artifact_store", "WITH " + sp.FEATS_CTES + "\nSELECT m.location, CAST(m.location_id AS BIGINT) "
       "AS location_id, " + sp.r("fm.lat_mean", "lat_mean") + ", " + sp.r("fm.lon_mean", "lon_mean") +
       " FROM fit_map m, fit_means fm")
def s06_artifact_store(spark, sf_dir):
    """Fitted spatial artifacts saved to the shared folder and loaded back."""
    from airgrid.operators.features import SpatialFit
    _, fit, _ = cm.train_features(spark, sf_dir)
    path = scratch_path(spark, "artifacts")
    fit.save(path)
    back = SpatialFit.load(spark, path)
    return back.mapping.select("location", "location_id",
                               F.lit(back.lat_mean).cast("double").alias("lat_mean"),
                               F.lit(back.lon_mean).cast("double").alias("lon_mean"))
