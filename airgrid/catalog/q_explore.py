"""Catalog: exploratory analysis and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.catalog import common as cm
from airgrid.catalog import sql_parts as sp
from airgrid.catalog.registry import query
from airgrid.operators import clean, explore
from airgrid.schemas import BASE_COLUMNS

WITH_BASE = "WITH " + sp.BASE_CTES
WITH_PANELS = "WITH " + sp.PANELS_CTES
NUM_BASE = ["latitude", "longitude"] + sp.POLL + sp.WX
NUM_MERGED = ["latitude", "longitude"] + sp.POLL + sp.WX


def _merged(spark, sf_dir):
    _, wx = cm.inputs(spark, sf_dir)
    df = clean.clean_locations(clean.drop_unused(cm.wide(spark, sf_dir)))
    return clean.merge_weather(df, wx)


def _cleaned(spark, sf_dir):
    return clean.clean_pollutants(_merged(spark, sf_dir))


def _union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


@query("e01_missing_pct", WITH_BASE + "\n" + _union([
    f"SELECT '{c}' AS column_name, {sp.r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100', 'missing_pct')} FROM base"
    for c in BASE_COLUMNS]))
def e01_missing_pct(spark, sf_dir):
    return explore.missing_pct(cm.base(spark, sf_dir))


_E02_COLS = [c for c in BASE_COLUMNS if c != "location"]


@query("e02_missing_by_station", WITH_BASE + ",\nl AS (" + _union([
    f"SELECT location, '{c}' AS column_name, round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 1) "
    f"AS missing_pct FROM base GROUP BY location" for c in _E02_COLS]) +
    ")\nSELECT location, column_name, " + sp.r("missing_pct", "missing_pct") +
    " FROM l WHERE column_name IN (SELECT column_name FROM l GROUP BY column_name HAVING max(missing_pct) > 0)")
def e02_missing_by_station(spark, sf_dir):
    return explore.missing_by_station(cm.base(spark, sf_dir))


@query("e03_negative_counts", WITH_BASE + ",\nl AS (" + _union([
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} < 0) AS neg_count FROM merged" for c in NUM_MERGED]) +
    ")\nSELECT column_name, CAST(neg_count AS BIGINT) AS neg_count FROM l WHERE neg_count > 0")
def e03_negative_counts(spark, sf_dir):
    return explore.negative_counts(_merged(spark, sf_dir), NUM_MERGED)


@query("e04_time_steps", WITH_BASE + """,
s AS (SELECT date_diff('second', lag(datetime) OVER (PARTITION BY location ORDER BY datetime), datetime) AS step_seconds
      FROM cleaned)
SELECT CAST(step_seconds AS BIGINT) AS step_seconds, CAST(count(*) AS BIGINT) AS n FROM s
WHERE step_seconds IS NOT NULL GROUP BY step_seconds ORDER BY n DESC, step_seconds LIMIT 10""")
def e04_time_steps(spark, sf_dir):
    return explore.time_steps(_cleaned(spark, sf_dir))


@query("e05_duplicate_keys", WITH_BASE + """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM cleaned GROUP BY datetime, location)""")
def e05_duplicate_keys(spark, sf_dir):
    return explore.duplicate_keys(_cleaned(spark, sf_dir))


@query("e06_continuity", WITH_BASE + """,
s AS (SELECT date_diff('second', lag(datetime) OVER (PARTITION BY location ORDER BY datetime), datetime) AS s FROM base)
SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE s <> 3600) AS BIGINT) AS violations
FROM s WHERE s IS NOT NULL""")
def e06_continuity(spark, sf_dir):
    return explore.continuity_violations(cm.base(spark, sf_dir))


_STATS = [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"),
          ("min", "min({c})"), ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
          ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})")]


@query("e07_summary", WITH_BASE + "\n" + _union([
    f"SELECT '{c}' AS column_name, '{s}' AS stat, {sp.r(e.format(c=c), 'value')} FROM base"
    for c in NUM_BASE for s, e in _STATS]))
def e07_summary(spark, sf_dir):
    return explore.summary(cm.base(spark, sf_dir), NUM_BASE)


@query("e08_histogram", WITH_BASE + """,
b AS (SELECT min(pm25) AS lo, max(pm25) AS hi, (max(pm25) - min(pm25)) / 100 AS w FROM base),
h AS (SELECT CAST(least(floor((pm25 - lo) / w), 99) AS INTEGER) AS bin FROM base, b WHERE pm25 IS NOT NULL)
SELECT CAST(g.bin AS BIGINT) AS bin, """ + sp.r("lo + g.bin * w", "lo") + ", " + sp.r("lo + (g.bin + 1) * w", "hi") +
    """, CAST(count(h.bin) AS BIGINT) AS n FROM b, range(100) g(bin) LEFT JOIN h ON h.bin = g.bin GROUP BY g.bin, lo, w""")
def e08_histogram(spark, sf_dir):
    return explore.histogram(cm.base(spark, sf_dir), "pm25", 100)


@query("e09_kde", WITH_BASE + """,
s AS (SELECT count(pm25) AS n, stddev_samp(pm25) AS sd, min(pm25) AS lo, max(pm25) AS hi FROM base),
p AS (SELECT n, sd * pow(n, -1.0 / 5.0) AS h, lo, hi FROM s),
g AS (SELECT n, h, lo - 3.0 * h AS g0, (hi + 3.0 * h - (lo - 3.0 * h)) / 199 AS step FROM p),
v AS (SELECT pm25 AS v, count(*) AS c FROM base WHERE pm25 IS NOT NULL GROUP BY pm25),
k AS (SELECT i, sum(c * exp(-0.5 * ((g0 + i * step - v) / h) * ((g0 + i * step - v) / h))) AS s
      FROM v, g, range(200) r(i) GROUP BY i)
SELECT CAST(i AS BIGINT) AS i, """ + sp.r("g0 + i * step", "x") + ", " +
    sp.r("s * (1.0 / (n * h * sqrt(2 * pi())))", "density") + " FROM k, g")
def e09_kde(spark, sf_dir):
    return explore.kde(cm.base(spark, sf_dir), "pm25", 200)


@query("e10_box_stats", WITH_BASE + """,
q AS (SELECT location, quantile_cont(pm25, 0.25) AS q1, quantile_cont(pm25, 0.5) AS median,
             quantile_cont(pm25, 0.75) AS q3 FROM base WHERE pm25 IS NOT NULL GROUP BY location),
j AS (SELECT b.location, b.pm25 AS x, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr
      FROM base b JOIN q ON b.location = q.location WHERE b.pm25 IS NOT NULL)
SELECT location, """ + sp.out(["q1", "median", "q3", "iqr"]) + ", " +
    sp.r("min(x) FILTER (WHERE x >= q1 - 1.5 * iqr)", "whisker_low") + ", " +
    sp.r("max(x) FILTER (WHERE x <= q3 + 1.5 * iqr)", "whisker_high") +
    ", CAST(count(*) FILTER (WHERE x < q1 - 1.5 * iqr OR x > q3 + 1.5 * iqr) AS BIGINT) AS n_outliers"
    " FROM j GROUP BY location, q1, median, q3, iqr")
def e10_box_stats(spark, sf_dir):
    return explore.box_stats(cm.base(spark, sf_dir))


@query("e11_zscore_outliers", WITH_BASE + """,
z AS (SELECT location, datetime, pm25, (pm25 - avg(pm25) OVER (PARTITION BY location))
             / stddev_samp(pm25) OVER (PARTITION BY location) AS z FROM base)
SELECT location, datetime, """ + sp.out(["pm25", "z"]) + " FROM z WHERE abs(z) > 5")
def e11_zscore_outliers(spark, sf_dir):
    return explore.zscore_outliers(cm.base(spark, sf_dir)).select("location", "datetime", "pm25", "z")


@query("e12_clip_log", WITH_BASE + "\nSELECT location, datetime, " +
       sp.r("least(pm25, 300.0)", "pm25_clip") + ", " + sp.r("ln(1 + pm25)", "pm25_log") + " FROM base")
def e12_clip_log(spark, sf_dir):
    return explore.clip_log(cm.base(spark, sf_dir)).select("location", "datetime", "pm25_clip", "pm25_log")


@query("e13_seasonality", WITH_PANELS + """,
p AS (SELECT location, pm25, hour(datetime) AS hour, isodow(datetime) - 1 AS weekday, month(datetime) AS month FROM train),
g AS (SELECT location, hour, weekday, month, avg(pm25) AS m, grouping(hour) AS gh, grouping(weekday) AS gw
      FROM p GROUP BY GROUPING SETS ((location, hour), (location, weekday), (location, month)))
SELECT CASE WHEN gh = 0 THEN 'hour' WHEN gw = 0 THEN 'weekday' ELSE 'month' END AS profile,
       CAST(coalesce(hour, weekday, month) AS BIGINT) AS period, location, """ + sp.r("m", "mean_pm25") + " FROM g")
def e13_seasonality(spark, sf_dir):
    return explore.seasonality(cm.prepared(spark, sf_dir).train)


@query("e14_lag_correlation", WITH_PANELS + ",\nl AS (SELECT location, pm25, " + ", ".join(
    f"lag(pm25, {k}) OVER (PARTITION BY location ORDER BY datetime) AS l{k}" for k in range(1, 25)) +
    " FROM train),\nc AS (" + _union([f"SELECT location, {k} AS lag, corr(pm25, l{k}) AS c FROM l GROUP BY location"
                                      for k in range(1, 25)]) +
    ")\nSELECT CAST(lag AS BIGINT) AS lag, " + sp.r("avg(c)", "mean_corr") + " FROM c GROUP BY lag")
def e14_lag_correlation(spark, sf_dir):
    return explore.lag_correlation(cm.prepared(spark, sf_dir).train)


@query("e15_acf", WITH_PANELS + """,
s AS (SELECT location, datetime, pm25, pm25 - avg(pm25) OVER (PARTITION BY location) AS d FROM train WHERE pm25 IS NOT NULL),
p AS (SELECT location, """ + ", ".join(
    f"d * lead(d, {k}) OVER (PARTITION BY location ORDER BY datetime) AS p{k}" for k in range(0, 49)) + """ FROM s),
t AS (SELECT location, """ + ", ".join(f"sum(p{k}) AS s{k}" for k in range(0, 49)) + """ FROM p GROUP BY location)
""" + "\nUNION ALL ".join(f"SELECT location, CAST({k} AS BIGINT) AS lag, {sp.r(f's{k} / s0', 'acf')} FROM t"
                          for k in range(0, 49)))
def e15_acf(spark, sf_dir):
    return explore.acf(cm.prepared(spark, sf_dir).train)


_E16 = [c for c in BASE_COLUMNS if c not in ("location", "datetime")]


@query("e16_missing_map", WITH_BASE + "\n" + _union([
    f"SELECT datetime, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing "
    f"FROM base GROUP BY datetime" for c in _E16]))
def e16_missing_map(spark, sf_dir):
    return explore.missing_map(cm.base(spark, sf_dir), _E16)


@query("e16_station_series", WITH_BASE + "\nSELECT datetime, " + sp.r("pm25", "pm25") +
       " FROM base WHERE location = 'Gyor 1'")
def e16_station_series(spark, sf_dir):
    return explore.station_series(cm.base(spark, sf_dir), "Gyor 1").select("datetime", F.col("pm25"))
