"""Feature operators F01-F18.

All per-station window features share one window spec, so the whole feature
table costs one shuffle on the station key and one sort; every expression is
built-in and stays inside whole-stage code generation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgrid.functions.windows import (CHUNK, HALO, chunk_window, diff, rolling_mean_prev,
                                       rolling_std_prev, rolling_sum_prev_rows, station_window,
                                       with_time_chunks)
from airgrid.schemas import FEATURES, HEATING_MONTHS, KEY, LOW_WIND, TIME
from airgrid.session import cut_lineage

LAGS = (1, 3, 6, 24)
LOOKBACK = 24            # the longest backward look of any window feature, in rows (= hours)
CHUNK_HOURS = 30 * 24    # per-station block size of the chunked window plan


def pm_features(df: DataFrame, col: str = "pm25", w=None) -> DataFrame:
    """Lags, previous-window means, 3-row trend, previous-12 sample std."""
    w = w or station_window()
    out = {f"{col}_lag{k}": F.lag(col, k).over(w) for k in LAGS}
    out[f"{col}_roll6"] = rolling_mean_prev(col, 6, w)
    out[f"{col}_roll24"] = rolling_mean_prev(col, 24, w)
    out[f"{col}_trend_3h"] = diff(col, 3, w)
    out[f"{col}_std_12h"] = rolling_std_prev(col, 12, w)
    return df.withColumns(out)


def time_features(df: DataFrame, time: str = TIME) -> DataFrame:
    """Hour, month, their sin/cos, weekend and heating-season flags (UTC)."""
    hour = F.hour(time)
    month = F.month(time)
    return df.withColumns({
        "hour": hour,
        "hour_sin": F.sin(2 * math.pi * hour / 24),
        "hour_cos": F.cos(2 * math.pi * hour / 24),
        "month": month,
        "month_sin": F.sin(2 * math.pi * month / 12),
        "month_cos": F.cos(2 * math.pi * month / 12),
        "weekend_flag": (F.weekday(time) >= 5).cast("int"),
        "heating_season_flag": month.isin(HEATING_MONTHS).cast("int"),
    })


def weather_features(df: DataFrame, w=None) -> DataFrame:
    """3-row weather deltas, physical indices, low-wind hours in the last 6 rows."""
    w = w or station_window()
    t, h, v = F.col("temperature"), F.col("humidity"), F.col("wind_speed")
    low = (F.coalesce(v < LOW_WIND, F.lit(False))).cast("int")   # missing wind counts 0
    return df.withColumns({
        "temp_change_3h": diff("temperature", 3, w),
        "humidity_change_3h": diff("humidity", 3, w),
        "wind_change_3h": diff("wind_speed", 3, w),
        "stagnation_index": h / (v + 0.5),
        "temp_wind_interaction": t * v,
        "mixing_index": (t + 273.15) * (v + 1.0) / (h + 20.0),
        "ventilation_index": v * (t + 273.15),
        "stagnation_hours_6h": rolling_sum_prev_rows(low, 6, w).cast("double"),
    })


@dataclass
class SpatialFit:
    """F15 artifacts: row-weighted coordinate means and the alphabetical station index."""
    lat_mean: float | None
    lon_mean: float | None
    mapping: DataFrame   # location, location_id
    n_stations: int = -1

    def save(self, path: str) -> None:
        spark = self.mapping.sparkSession
        (self.mapping.write.mode("overwrite").parquet(f"{path}/location_mapping"))
        (spark.createDataFrame([(self.lat_mean, self.lon_mean)], "lat_mean double, lon_mean double")
         .write.mode("overwrite").json(f"{path}/means"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SpatialFit":
        m = spark.read.json(f"{path}/means").first()
        mapping = spark.read.parquet(f"{path}/location_mapping")
        return SpatialFit(m["lat_mean"], m["lon_mean"], mapping, mapping.count())


def fit_spatial(train: DataFrame) -> SpatialFit:
    """the two means (one tiny aggregate) and location -> 0-based alphabetical id.

    The distinct stations are cut once: range partitions in order of the name, numbered
    inside and shifted by the counts of the partitions before (one row a partition).
    """
    means = train.agg(F.avg("latitude").alias("a"), F.avg("longitude").alias("b")).first()
    names = cut_lineage(train.select(KEY).where(F.col(KEY).isNotNull()).distinct().repartitionByRange(KEY)
                        .withColumn("_part", F.spark_partition_id()))
    sizes = names.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    skip, n = [], 0
    for r in sizes.orderBy("_part").collect():
        skip.append((r["_part"], n))
        n += r["_size"]
    starts = train.sparkSession.createDataFrame(skip, "_part int, _skip long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(KEY)) - 1
    mapping = (names.withColumn("_at", inside).join(starts, "_part")
               .select(KEY, (F.col("_at") + F.col("_skip")).cast("int").alias("location_id")))
    return SpatialFit(means["a"], means["b"], cut_lineage(mapping), n)


def apply_spatial(df: DataFrame, fit: SpatialFit) -> DataFrame:
    """F16: centred coordinates and station id (unseen stations get -1).

    No hint: the join is broadcast when the index is measured to be small.
    """
    out = df.join(fit.mapping, KEY, "left")
    return out.withColumns({
        "lat_norm": F.col("latitude") - F.lit(fit.lat_mean).cast("double"),
        "lon_norm": F.col("longitude") - F.lit(fit.lon_mean).cast("double"),
        "location_id": F.coalesce(F.col("location_id"), F.lit(-1)).cast("int"),
    })


def build_features(df: DataFrame, fit: SpatialFit | None = None,
                   chunk_hours: int | None = CHUNK_HOURS) -> tuple[DataFrame, SpatialFit]:
    """F01..F16 in order; fits the spatial artifacts when ``fit`` is None.

    With ``chunk_hours`` the window features run on (station, time block)
    partitions with a 24-hour halo (``with_time_chunks``): identical results on
    the gap-free hourly panel, and a station with a very long or very dense
    series is split over many tasks.  ``None`` uses one partition per station.
    """
    if fit is None:
        fit = fit_spatial(df)
    if chunk_hours:
        cols = df.columns
        w = chunk_window()
        ch = with_time_chunks(df, chunk_hours, LOOKBACK)
        out = weather_features(time_features(pm_features(ch, w=w)), w=w)
        out = out.where(~F.col(HALO)).drop(CHUNK, HALO)
        out = out.select(*cols, *[c for c in out.columns if c not in cols])
    else:
        out = weather_features(time_features(pm_features(df)))
    return apply_spatial(out, fit), fit


def check_features(df: DataFrame, features: list[str] = FEATURES) -> list[str]:
    """names of required features missing from ``df`` (schema only, no job)."""
    have = set(df.columns)
    return [f for f in features if f not in have]
