"""Catalog: composed jobs and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.catalog import common as cm
from airgrid.catalog import sql_parts as sp
from airgrid.catalog.registry import query
from airgrid.operators import advise, clean
from airgrid.operators import forecast as fc
from airgrid.plans import serving
from airgrid.session import cut_lineage, scratch_path
from airgrid.streaming import hourly, live


_LABELS = {"pm25_lag1": (3, "Recent PM"), "pm25_roll6": (7, "Avg PM (6h)"), "pm25_roll24": (8, "Avg PM (24h)"),
           "temperature": (19, "Temperature"), "humidity": (20, "Humidity"), "wind_change_3h": (25, "Wind Change"),
           "stagnation_hours_6h": (30, "stagnation_hours_6h")}
_HZ = range(1, 13)
_P09 = ("WITH " + sp.BASE_CTES + ",\n" +
        sp.forecast_state("r._rn = (SELECT max(r2._rn) FROM rows r2 WHERE r2.location = r.location)") + ",\n" +
        sp.recursion() + ",\n" + sp.interp_station("filled", "base") + """,
codes AS (SELECT datetime, max(weather_code) AS weather_code FROM wx_raw GROUP BY datetime),
hist AS (SELECT * FROM (SELECT location, datetime, pm25, row_number() OVER (PARTITION BY location ORDER BY datetime DESC) AS k
                        FROM filled WHERE pm25 IS NOT NULL) WHERE k <= 12),
eff AS (""" + "\nUNION ALL ".join(
    f"SELECT location, {s} AS horizon, '{_LABELS[f][1]}' AS label, {_LABELS[f][0]} AS pos, "
    f"{c} * coalesce(CAST({sp.blend_feats(s)[f]} AS DOUBLE), 0.0) AS v FROM {'st' if s == 1 else f'r{s - 1}'}"
    for s in _HZ for f, c in sp.BLEND_COEFS if f in _LABELS) + """),
rk AS (SELECT *, row_number() OVER (PARTITION BY location, horizon ORDER BY abs(v) DESC, pos) AS k FROM eff),
drv AS (SELECT location, horizon, string_agg(label || CASE WHEN v > 0 THEN ' up' ELSE ' down' END, ', ' ORDER BY k) AS drivers
        FROM rk WHERE k <= 5 GROUP BY location, horizon),
miss AS (""" + "\nUNION ALL ".join(f"SELECT location, {s} AS horizon, {sp.missing_names(s)} AS missing_features "
                                  f"FROM {'st' if s == 1 else f'r{s - 1}'}" for s in _HZ) + """),
fcs AS (""" + "\nUNION ALL ".join(f"SELECT location, {s} AS horizon, origin + INTERVAL {s} HOUR AS datetime, p{s} AS v FROM r12"
                                 for s in _HZ) + """),
m AS (SELECT location, datetime, CASE WHEN count(v) OVER f = 3 THEN avg(v) OVER f END AS window_mean
      FROM fcs WINDOW f AS (PARTITION BY location ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
win AS (SELECT location, datetime - INTERVAL 2 HOUR AS window_start, datetime AS window_end FROM (
        SELECT *, row_number() OVER (PARTITION BY location ORDER BY window_mean, datetime) AS k
        FROM m WHERE window_mean IS NOT NULL) WHERE k = 1),
rw AS (SELECT t.location, t.datetime, t.v, c.weather_code, w.window_start, w.window_end,
              row_number() OVER (PARTITION BY t.location ORDER BY t.datetime) - 1 AS i,
              count(*) OVER (PARTITION BY t.location) AS n
       FROM fcs t JOIN win w ON t.location = w.location AND t.datetime BETWEEN w.window_start AND w.window_end
       LEFT JOIN codes c ON c.datetime = t.datetime),
facts AS (SELECT location, window_start, window_end, avg(v) AS avg_pm,
          CASE WHEN count(weather_code) > 0 THEN count(*) FILTER (WHERE weather_code IN (0, 1, 2, 3)) / count(weather_code)
               ELSE 0.0 END AS weather_ratio,
          coalesce(max(weather_code) FILTER (WHERE i = n // 2),
                   arg_min(weather_code, datetime) FILTER (WHERE weather_code IS NOT NULL)) AS weather_code
          FROM rw GROUP BY location, window_start, window_end)
SELECT h.location, 'history' AS part, h.datetime, CAST(NULL AS TIMESTAMP) AS until, """ + sp.r("h.pm25", "value") + """,
       CAST(c.weather_code AS BIGINT) AS weather_code, CAST(NULL AS VARCHAR) AS band_colour, CAST(NULL AS VARCHAR) AS drivers,
       CAST(NULL AS VARCHAR) AS missing_features, CAST(NULL AS BIGINT) AS is_extreme, CAST(NULL AS VARCHAR) AS recommendation_text
FROM hist h LEFT JOIN codes c USING (datetime)
UNION ALL
SELECT f.location, 'forecast', f.datetime, timezone('Europe/Budapest', timezone('UTC', f.datetime)), """ + sp.r("f.v", "value") + """,
       CAST(c.weather_code AS BIGINT), CASE WHEN f.v <= 12.0 THEN '#d4edda' WHEN f.v <= 35.0 THEN '#fff3cd'
       WHEN f.v <= 55.0 THEN '#ffe5b4' ELSE '#f8d7da' END, d.drivers, n.missing_features,
       CAST(CASE WHEN f.v > 500 THEN 1 ELSE 0 END AS BIGINT), NULL
FROM fcs f JOIN drv d USING (location, horizon) JOIN miss n USING (location, horizon) LEFT JOIN codes c ON c.datetime = f.datetime
UNION ALL
SELECT location, 'window', window_start, window_end, NULL, CAST(weather_code AS BIGINT), NULL, NULL, NULL, NULL, """ +
        f"CASE WHEN avg_pm < 15 AND weather_ratio >= 0.5 THEN '{advise.ADVICE_BOTH}' WHEN avg_pm < 15 THEN '{advise.ADVICE_PM}' "
        f"WHEN weather_ratio >= 0.5 THEN '{advise.ADVICE_WEATHER}' ELSE '{advise.ADVICE_NONE}' END FROM facts")


@query("p09_batch_forecast_job", _P09)
def p09_batch_forecast_job(spark, sf_dir):
    """Serving output for every station in one job, its nested parts as rows: the observed hours,
    the forecast hours (local time as ``until``) with their drivers and warnings, the recommended window."""
    _, wx = cm.inputs(spark, sf_dir)
    out = cut_lineage(serving.batch_forecast(cm.base(spark, sf_dir), clean.dedup_weather(wx), fc.BLEND))
    text, whole, none = (F.lit(None).cast(t) for t in ("string", "long", "timestamp"))
    h = out.select("location", F.explode("history").alias("e")).select(
        "location", F.lit("history").alias("part"), "e.datetime", none.alias("until"), F.col("e.pm25").alias("value"),
        "e.weather_code", text.alias("band_colour"), text.alias("drivers"), text.alias("missing_features"),
        whole.alias("is_extreme"), text.alias("recommendation_text"))
    named = F.transform("e.drivers", lambda d: F.concat_ws(" ", d["feature"], d["direction"]))
    f = out.select("location", F.explode("forecast").alias("e")).select(
        "location", F.lit("forecast").alias("part"), "e.datetime", F.col("e.datetime_local").alias("until"),
        F.col("e.pm25_pred").alias("value"), "e.weather_code", "e.band_colour", F.array_join(named, ", ").alias("drivers"),
        F.array_join("e.missing_features", ",").alias("missing_features"), F.col("e.is_extreme").cast("long").alias("is_extreme"),
        text.alias("recommendation_text"))
    w = out.select("location", F.lit("window").alias("part"), F.col("recommended_window.start").alias("datetime"),
                   F.col("recommended_window.end").alias("until"), F.lit(None).cast("double").alias("value"),
                   "recommended_window.weather_code", text.alias("band_colour"), text.alias("drivers"),
                   text.alias("missing_features"), whole.alias("is_extreme"), "recommended_window.recommendation_text")
    return h.unionByName(f).unionByName(w)


@query("r01_stream_hourly_means", "WITH " + sp.MEAS.strip().replace(
    "CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime", "CAST(ts AS TIMESTAMP) AS datetime") + """
SELECT date_trunc('hour', datetime) AS datetime, location, parameter, """ + sp.r("avg(value)", "value") +
       """, CAST(count(*) AS BIGINT) AS n FROM meas GROUP BY 1, 2, 3""")
def r01_stream_hourly_means(spark, sf_dir):
    """Readings landed in time order (one file per 5 days), streamed one file per
    trigger (availableNow) into watermarked hourly means."""
    meas, _ = cm.inputs(spark, sf_dir, hourly=False)
    src = scratch_path(spark, "landing")
    hourly.land_in_order(meas, src, chunk_days=5)
    sink = scratch_path(spark, "hourly-sink")
    hourly.run_hourly(spark, src, sink, scratch_path(spark, "hourly-ckpt"), files_per_trigger=1)
    return hourly.read_hourly(spark, sink)


@query("r01_live_panel", "WITH " + sp.MEAS.strip().replace(
    "CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime", "CAST(ts AS TIMESTAMP) AS datetime") + """,
h AS (SELECT location, date_trunc('hour', datetime) AS datetime, """ + ", ".join(
    f"avg(CASE WHEN parameter = '{p}' AND value >= 0 THEN value END) AS {p}" for p in ("no2", "pm10", "pm25", "so2")) + """
      FROM meas GROUP BY 1, 2),
spine AS (SELECT location, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime
          FROM (SELECT location, min(datetime) AS lo, max(datetime) AS hi FROM h GROUP BY location)),
grid AS (SELECT s.location, s.datetime, no2, pm10, pm25, so2 FROM spine s LEFT JOIN h USING (location, datetime)),
""" + sp.interp_state("st", "grid", ["no2", "pm10", "pm25", "so2"]) + "\nSELECT location, datetime, " + ", ".join(
    f"{sp.r(p, p)}, {sp.r(f'{p}__f', f'{p}_filled')}" for p in ("no2", "pm10", "pm25", "so2")) + " FROM st")
def r01_live_panel(spark, sf_dir):
    """Readings landed in time order, streamed one file per trigger through the stateful ring of
    each station: newest version of every hour, raw and gap-filled."""
    meas, _ = cm.inputs(spark, sf_dir, hourly=False)
    src, sink = scratch_path(spark, "live-landing"), scratch_path(spark, "live-sink")
    hourly.land_in_order(meas, src, chunk_days=5)
    live.run_live(spark, src, sink, scratch_path(spark, "live-ckpt"), files_per_trigger=1)
    return live.read_live(spark, sink)
