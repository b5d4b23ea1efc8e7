"""Ingest shaping, cleaning, hourly alignment and gap filling.

Raw volume lives in the long readings.  It is reduced once, by the pivot's
hash aggregation (partial aggregation happens map-side, so a station holding a
third of all readings is pre-combined per task before the shuffle).  Every later
step works on the hourly panel, whose size is stations x hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.interp import interpolate, interpolate_chunked
from airgrid.functions.text import clean_names
from airgrid.session import cut_lineage
from airgrid.schemas import (ALL_PARAMETERS, BASE_COLUMNS, COORD_COLS, DROPPED_PARAMETERS,
                             INTERP_LIMIT, KEY, POLLUTANTS, TIME, WEATHER_COLS)

HOUR = "interval 1 hour"


# ---------------------------------------------------------------- S10 / S11 --

def no_nan(c: str) -> Column:
    """A double without NaN: NULL stands for every missing reading."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def pivot_measurements(long: DataFrame, parameters: list[str] = ALL_PARAMETERS) -> DataFrame:
    """Long readings -> one row per (datetime, location, latitude, longitude).

    Mean per parameter (duplicate readings and several sensors of one parameter
    are averaged); rows with a NULL key are dropped.  The parameter list is fixed,
    so the pivot plans no extra job to discover values.
    """
    keys = [TIME, KEY] + COORD_COLS
    valid = long.where(F.col(TIME).isNotNull() & F.col(KEY).isNotNull()
                       & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return valid.groupBy(*keys).pivot("parameter", parameters).agg(F.avg(no_nan("value")))


def resample_station(long: DataFrame, stations: DataFrame,
                     parameters: list[str] = POLLUTANTS) -> DataFrame:
    """Readings of stations without coordinates -> hourly grid + station metadata.

    ``long``: ``location, datetime, parameter, value``; ``stations``: ``location,
    latitude, longitude``.  Mean per exact timestamp (the pivot), then hourly mean of
    those, on a gap-free grid per station.  Of several coordinates of one station the
    smallest pair is used, so no row doubles.
    """
    per_ts = (long.where(F.col(TIME).isNotNull())
              .groupBy(KEY, TIME).pivot("parameter", parameters).agg(F.avg(no_nan("value"))))
    hourly = (per_ts.groupBy(KEY, F.date_trunc("hour", TIME).cast("timestamp").alias(TIME))
              .agg(*[F.avg(p).alias(p) for p in parameters]))
    grid = hourly_spine(hourly).join(hourly, [KEY, TIME], "left")
    return grid.join(station_coordinates(stations), KEY, "left")


# ------------------------------------------------------------------ C01-C05 --

def clean_locations(df: DataFrame, col: str = KEY) -> DataFrame:
    """Strip quotes, NFKD-fold to ASCII, trim (computed once per distinct name)."""
    return clean_names(df, col)


def dedup_weather(weather: DataFrame) -> DataFrame:
    """One row per timestamp, mean of every weather column (the largest code: codes have no mean)."""
    cols = [c for c in weather.columns if c != TIME]
    return weather.groupBy(TIME).agg(*[(F.max(c) if c == "weather_code" else F.avg(no_nan(c))).alias(c) for c in cols])


def merge_weather(pollution: DataFrame, weather: DataFrame,
                  weather_cols: list[str] = WEATHER_COLS) -> DataFrame:
    """Left equi-join on the exact timestamp (off-hour readings get NULL weather).

    The weather table has one row per hour; AQE broadcasts it when its runtime
    size is under the threshold and falls back to a shuffle join otherwise.
    """
    w = dedup_weather(weather.select(TIME, *weather_cols))
    return pollution.join(w, TIME, "left")


def drop_unused(df: DataFrame, expected: list[str] = POLLUTANTS,
                dropped: list[str] = DROPPED_PARAMETERS) -> DataFrame:
    """Drop co/o3, add any absent pollutant column as NULL."""
    out = df.drop(*[c for c in dropped if c in df.columns])
    missing = {c: F.lit(None).cast("double") for c in expected if c not in out.columns}
    return out.withColumns(missing) if missing else out


def clean_pollutants(df: DataFrame, cols: list[str] = POLLUTANTS) -> DataFrame:
    """Negative readings (the -1 sentinel) and NaN become NULL; weather is exempt."""
    return df.withColumns({c: F.when(no_nan(c) >= 0, F.col(c)) for c in cols if c in df.columns})


# ------------------------------------------------------------------ C06-C08 --

def hourly_spine(hourly: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Every hour between each station's own first and last hour."""
    bounds = hourly.groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    return bounds.select(key, F.explode(F.sequence("_lo", "_hi", F.expr(HOUR))).alias(time))


def resample_pollutants(df: DataFrame, cols: list[str] = POLLUTANTS) -> DataFrame:
    """Floor to the hour, mean per station-hour, gap-free grid per station."""
    hourly = (df.groupBy(KEY, F.date_trunc("hour", TIME).cast("timestamp").alias(TIME))
              .agg(*[F.avg(c).alias(c) for c in cols]))
    return hourly_spine(hourly).join(hourly, [KEY, TIME], "left")


def resample_weather(df: DataFrame, cols: list[str] = WEATHER_COLS) -> DataFrame:
    """One row per distinct timestamp, hourly mean (weather has no station key).

    After C03 all rows of one timestamp carry the same weather, so any one of them
    stands for the timestamp.  Hours without a row are absent here and come out
    NULL in the left join of C08, which equals a full hourly grid.
    """
    per_ts = df.groupBy(TIME).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
    return (per_ts.groupBy(F.date_trunc("hour", TIME).cast("timestamp").alias(TIME))
            .agg(*[F.avg(c).alias(c) for c in cols]))


def station_coordinates(df: DataFrame) -> DataFrame:
    """One (latitude, longitude) per location: the smallest pair, so a station never fans out."""
    pair = F.min(F.struct(*COORD_COLS)).alias("_at")
    return df.groupBy(KEY).agg(pair).select(KEY, "_at.*")


def resample_hourly(df: DataFrame) -> DataFrame:
    """C06 + C07 + C08: station grid, joined to the weather grid and coordinates."""
    grid = resample_pollutants(df)
    out = (grid.join(resample_weather(df), TIME, "left")
           .join(station_coordinates(df), KEY, "left"))
    return out.select(*BASE_COLUMNS)


# ------------------------------------------------------------------ C09-C11 --

CHUNK_HOURS = 30 * 24


def interpolate_pollutants(df: DataFrame, cols: list[str] = POLLUTANTS,
                           limit: int = INTERP_LIMIT, chunk_hours: int | None = CHUNK_HOURS,
                           fill: str = "linear") -> DataFrame:
    """Per station, linear by row position, forward, at most ``limit`` rows per gap.

    ``fill="forward"`` repeats the last value instead, so that no filled value looks ahead.

    With ``chunk_hours`` (the default) the windows run on (station, time block)
    partitions (``interpolate_chunked``), exact on the gap-free hourly panel;
    ``None`` uses one window partition per station.
    """
    cols = [c for c in cols if c in df.columns]
    if chunk_hours:
        return interpolate_chunked(df, cols, chunk_hours, KEY, TIME, limit, fill)
    return interpolate(df, cols, KEY, TIME, limit, fill)


def interpolate_weather(df: DataFrame, cols: list[str] = WEATHER_COLS,
                        limit: int = INTERP_LIMIT, fill: str = "linear") -> DataFrame:
    """The same rule over the one-row-per-hour weather of the panel.

    Deliberate fix: gaps are filled along time on the distinct hours of the
    panel, not across station borders of a location-major row order.  The
    hour table is bounded by the time span (not by stations or readings), so a
    single ordered window over it is cheap; it is joined back on ``datetime``.
    """
    hours = df.groupBy(TIME).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
    filled = interpolate(hours, cols, None, TIME, limit, fill)
    return df.drop(*cols).join(filled, TIME, "left").select(*df.columns)


def interpolate_station(df: DataFrame, limit: int = INTERP_LIMIT, fill: str = "linear") -> DataFrame:
    """C09 + C10 on a base-shaped panel."""
    return interpolate_pollutants(interpolate_weather(df, limit=limit, fill=fill), limit=limit, fill=fill)


def build_base_dataset(pollution: DataFrame, weather: DataFrame, materialize: bool = True) -> DataFrame:
    """C11: wide pollutants + weather -> hourly base panel (not yet gap-filled).

    With ``materialize`` the two reduced hand-offs are cut with reliable
    checkpoints: the cleaned wide table (read three times by the resampling:
    grid, weather, coordinates) and the base panel (read by every later stage),
    so the raw readings are scanned once.
    """
    df = drop_unused(pollution)            # absent pollutants as NULL
    df = clean_locations(df)
    df = merge_weather(df, weather)
    df = drop_unused(df)
    df = clean_pollutants(df)
    if materialize:
        df = cut_lineage(df)
    base = resample_hourly(df)
    return cut_lineage(base) if materialize else base


def base_from_measurements(long: DataFrame, weather: DataFrame, materialize: bool = True) -> DataFrame:
    """S10 + C11.  The pivot is cut first, since the name folding reads it twice."""
    wide = pivot_measurements(long)
    return build_base_dataset(cut_lineage(wide) if materialize else wide, weather, materialize)
