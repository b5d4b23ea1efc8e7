"""Station registry, sensor index and request checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.functions.text import clean_names
from airgrid.schemas import ALL_PARAMETERS, KEY

EARTH_KM = 6371.0
# ---- fixed values: the reference's search point and radius -------------------
SEARCH_LAT, SEARCH_LON, SEARCH_RADIUS_KM = 47.6875, 17.6504, 25.0
# --------------------------------------------------------------------------------


def registry(readings: DataFrame, sensor_col: str = "sensor_id") -> DataFrame:
    """STATION table ``location, lat, lon, sensors map<parameter, array<sensor>>``.

    ``readings``: location, latitude, longitude, parameter, sensor_id.  The map is
    built per station from the distinct (parameter, sensor) pairs, so its size is
    bounded by the sensors of a station, not by readings.  Names are folded before
    grouping: raw names that fold alike are one station, with its smallest coordinates.
    """
    named = clean_names(readings.select(KEY, "latitude", "longitude", "parameter", sensor_col).distinct(), KEY)
    per_param = named.select(KEY, "parameter", sensor_col).distinct().groupBy(KEY, "parameter").agg(
        F.array_sort(F.collect_list(sensor_col)).alias("_ids"))
    sensors = per_param.groupBy(KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", "_ids")))).alias("sensors"))
    places = named.groupBy(KEY).agg(F.min(F.struct("latitude", "longitude")).alias("at"))
    return (places.join(sensors, KEY, "left")
            .select(KEY, F.col("at.latitude").alias("lat"), F.col("at.longitude").alias("lon"), "sensors"))


def haversine_km(lat1, lon1, lat2, lon2):
    """Great-circle distance in km (columns or literals, degrees)."""
    r = F.radians
    dlat = r(lat2) - r(lat1)
    dlon = r(lon2) - r(lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def within_radius(stations: DataFrame, lat: float = SEARCH_LAT, lon: float = SEARCH_LON,
                  radius_km: float = SEARCH_RADIUS_KM, lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Stations within ``radius_km`` of a point.

    A latitude/longitude bounding box (plain comparisons, pushable to Parquet)
    discards far stations before the exact haversine test.  The box holds the whole
    circle: all longitudes when a pole lies inside, two ranges across the 180th meridian.
    """
    angle = radius_km / EARTH_KM
    dlat = math.degrees(angle) * (1 + 1e-9) + 1e-9
    box = F.col(lat_col).between(lat - dlat, lat + dlat)
    if abs(lat) + dlat < 90 and math.sin(angle) < math.cos(math.radians(lat)):
        dlon = math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(lat)))) * (1 + 1e-9) + 1e-9
        lo, hi, x = lon - dlon, lon + dlon, F.col(lon_col)
        around = x.between(lo, hi)
        if lo < -180:
            around = around | (x >= lo + 360)
        if hi > 180:
            around = around | (x <= hi - 360)
        box = box & around
    d = haversine_km(F.lit(lat), F.lit(lon), F.col(lat_col), F.col(lon_col))
    return stations.where(box).withColumn("distance_km", d).where(F.col("distance_km") <= radius_km)


def sensor_index(stations: DataFrame, parameters: list[str] = ALL_PARAMETERS) -> DataFrame:
    """One row per sensor of the kept parameters; NULL coordinates stay NULL."""
    e = stations.select(KEY, "lat", "lon", F.explode("sensors").alias("parameter", "_ids"))
    e = e.where(F.col("parameter").isin(parameters))
    return e.select(F.explode("_ids").alias("sensor_id"), "parameter", KEY,
                    F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))


def sensor_map(index: DataFrame) -> DataFrame:
    """(parameter, location) -> sorted list of sensor ids.

    The list is bounded by the sensors of one station; all stations of a parameter
    are never gathered into one row.
    """
    return index.groupBy("parameter", KEY).agg(F.array_sort(F.collect_list("sensor_id")).alias("sensors"))


def unknown_requests(requests: DataFrame, stations: DataFrame, col: str = KEY) -> DataFrame:
    """Requested stations that are not in the registry (``left_anti``)."""
    return requests.join(stations.select(F.col(KEY).alias(col)), col, "left_anti")
