"""Catalog: metrics, forecasting, backtesting and recommendation (V, P, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.catalog import common as cm
from airgrid.catalog import sql_parts as sp
from airgrid.catalog.registry import query
from airgrid.operators import advise, clean, forecast as fc, metrics, splits
from airgrid.schemas import FEATURES

WITH_BASE = "WITH " + sp.BASE_CTES
WITH_FEATS = "WITH " + sp.FEATS_CTES
HZ = range(1, 13)


def _weather(spark, sf_dir):
    _, wx = cm.inputs(spark, sf_dir)
    return clean.dedup_weather(wx)


# ------------------------------------------------------------------ V ---------
_BLEND_ONE = ("greatest(0.0, 0.0" + "".join(f" + {c} * coalesce(CAST({f} AS DOUBLE), 0.0)"
                                            for f, c in sp.BLEND_COEFS) + ")")
_SCORED = (WITH_FEATS + ",\nsc AS (SELECT *, " + _BLEND_ONE + " AS pm25_pred FROM ("
           "SELECT *, lead(pm25, 1) OVER (PARTITION BY location ORDER BY datetime) AS pm25_next FROM ftest) "
           "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in
                                  ["pm25_next", "pm25_lag1", "pm25_lag3", "pm25_lag6", "pm25_lag24",
                                   "pm25_roll6", "pm25_roll24", "pm25_trend_3h", "pm25_std_12h",
                                   "temp_change_3h", "humidity_change_3h", "wind_change_3h",
                                   "stagnation_hours_6h"]) + ")")


def _scored(spark, sf_dir):
    """Complete test rows scored one step ahead by the persistence blend."""
    _, te, _, _ = cm.test_features(spark, sf_dir)
    t = splits.complete_cases(splits.add_target(te))
    return fc.BLEND.predict(t).withColumnRenamed("_pred", "pm25_pred")


@query("v01_v06_metrics", _SCORED + """
SELECT CAST(count(*) AS BIGINT) AS n, """ + ", ".join([
    sp.r("avg(abs(pm25_next - pm25_pred))", "MAE"),
    sp.r("sqrt(avg(pow(pm25_next - pm25_pred, 2)))", "RMSE"),
    sp.r("avg(abs(pm25_next - pm25_pred) / greatest(abs(pm25_next), 2.220446049250313e-16))", "MAPE"),
    sp.r("avg(2 * abs(pm25_pred - pm25_next) / (abs(pm25_next) + abs(pm25_pred) + 1e-6))", "SMAPE"),
    sp.r("1.0 - sum(pow(pm25_next - pm25_pred, 2)) / (var_pop(pm25_next) * count(pm25_next))", "R2"),
    sp.r("avg(CASE WHEN pm25_lag1 IS NOT NULL THEN abs(pm25_next - pm25_lag1) END)", "naive_MAE"),
    sp.r("avg(abs(pm25_next - pm25_pred)) / avg(CASE WHEN pm25_lag1 IS NOT NULL THEN abs(pm25_next - pm25_lag1) END)", "MASE"),
]) + " FROM sc")
def v01_v06_metrics(spark, sf_dir):
    """MAE, RMSE, MAPE, SMAPE, R2, MASE of the one-step blend on complete test rows."""
    return metrics.regression_metrics(_scored(spark, sf_dir))


@query("v07_baseline_mae", _SCORED + "\nSELECT " + sp.r("avg(abs(pm25_next - pm25_lag1))", "baseline_MAE") +
       ", CAST(count(*) AS BIGINT) AS n FROM sc WHERE pm25_lag1 IS NOT NULL")
def v07_baseline_mae(spark, sf_dir):
    return metrics.baseline_mae(_scored(spark, sf_dir))


@query("v10_residuals", _SCORED + "\nSELECT location, datetime, " +
       sp.out(["pm25_next", "pm25_pred"]).replace("AS pm25_next", "AS y_true").replace("AS pm25_pred", "AS y_pred") +
       ", " + sp.r("pm25_next - pm25_pred", "residual") + " FROM sc")
def v10_residuals(spark, sf_dir):
    return metrics.residuals(_scored(spark, sf_dir))


@query("v10_residual_histogram", _SCORED + """,
rs AS (SELECT pm25_next - pm25_pred AS residual FROM sc),
b AS (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 50 AS w FROM rs),
h AS (SELECT CAST(least(floor((residual - lo) / w), 49) AS INTEGER) AS bin FROM rs, b)
SELECT CAST(g.bin AS BIGINT) AS bin, """ + sp.r("lo + g.bin * w", "lo") + ", " + sp.r("lo + (g.bin + 1) * w", "hi") +
       ", CAST(count(h.bin) AS BIGINT) AS n FROM (SELECT * FROM b WHERE lo IS NOT NULL) b, range(50) g(bin) LEFT JOIN h ON h.bin = g.bin GROUP BY g.bin, lo, w")
def v10_residual_histogram(spark, sf_dir):
    return metrics.residual_histogram(metrics.residuals(_scored(spark, sf_dir)), 50)


# ------------------------------------------------------------------ P01 -------
@query("p01_asof_weather", WITH_BASE + """,
tg AS (SELECT location, datetime, datetime + INTERVAL 90 MINUTE AS target FROM base),
wlast AS (SELECT * FROM wxd ORDER BY datetime DESC LIMIT 1),
j AS (SELECT tg.*, w.datetime AS wtime, w.temperature, w.humidity, w.wind_speed, w.precipitation
      FROM tg ASOF LEFT JOIN wxd w ON tg.target >= w.datetime)
SELECT location, datetime, target, """ + ", ".join(
    sp.r(f"coalesce({c}, (SELECT {c} FROM wlast))", c) for c in sp.WX) +
    ", coalesce(wtime, (SELECT datetime FROM wlast)) AS weather_time FROM j")
def p01_asof_weather(spark, sf_dir):
    """Latest weather at or before each target (reading time + 90 min); last row if none."""
    b = cm.base(spark, sf_dir)
    tg = b.select("location", "datetime", (F.col("datetime") + F.expr("interval 90 minutes")).alias("target"))
    return fc.asof_weather(tg, _weather(spark, sf_dir), "target")


@query("p01_asof_subhour", """
WITH w AS (SELECT CAST(ts AS TIMESTAMP) AS datetime, CAST(max(event_id % 300) AS DOUBLE) AS temperature,
                  CAST(max(user_id % 60) AS DOUBLE) AS humidity, CAST(max(event_id % 7) AS DOUBLE) AS wind_speed,
                  CAST(max(event_id % 3) AS DOUBLE) AS precipitation
           FROM events WHERE event_type = 'view' GROUP BY ts),
tg AS (SELECT CAST(event_id AS BIGINT) AS event_id,
              CAST(ts AS TIMESTAMP) + (event_id % 41 - 20) * INTERVAL 1 DAY AS target FROM events WHERE event_type <> 'view'),
wlast AS (SELECT * FROM w ORDER BY datetime DESC LIMIT 1),
j AS (SELECT tg.*, w.datetime AS wtime, w.temperature, w.humidity, w.wind_speed, w.precipitation
      FROM tg ASOF LEFT JOIN w ON tg.target >= w.datetime)
SELECT event_id, target, """ + ", ".join(
    sp.r(f"CASE WHEN wtime IS NULL THEN (SELECT {c} FROM wlast) ELSE {c} END", c) for c in sp.WX) +
    ", coalesce(wtime, (SELECT datetime FROM wlast)) AS weather_time FROM j")
def p01_asof_subhour(spark, sf_dir):
    """As-of lookup on weather at raw event times; targets before, inside and after its range."""
    ev = cm.events(spark, sf_dir)
    at = F.col("ts").cast("timestamp")
    d = lambda c, n: F.max((F.col(c) % n).cast("double"))
    w = ev.where("event_type = 'view'").groupBy(at.alias("datetime")).agg(
        d("event_id", 300).alias("temperature"), d("user_id", 60).alias("humidity"),
        d("event_id", 7).alias("wind_speed"), d("event_id", 3).alias("precipitation"))
    days = F.make_dt_interval((F.col("event_id") % 41 - 20).cast("int"))
    tg = ev.where("event_type <> 'view'").select(F.col("event_id").cast("long").alias("event_id"), (at + days).alias("target"))
    return fc.asof_weather(tg, w, "target")


@query("v07_one_step_naive", _SCORED + "\nSELECT " + sp.r("avg(abs(pm25_next - pm25))", "baseline_MAE") +
       ", CAST(count(*) AS BIGINT) AS n FROM sc WHERE pm25 IS NOT NULL")
def v07_one_step_naive(spark, sf_dir):
    """MAE of the value one hour before the target (the other baseline is two hours before it)."""
    return metrics.baseline_mae(_scored(spark, sf_dir), naive="pm25")


# ------------------------------------------------------------------ P03 -------
_P03_STATE = sp.forecast_state("r._rn = (SELECT max(r2._rn) FROM rows r2 WHERE r2.location = r.location)")
_P03_SQL = (WITH_BASE + ",\n" + _P03_STATE + ",\n" + sp.recursion() + "\n" + "\nUNION ALL ".join(
    f"SELECT location, origin, CAST({s} AS BIGINT) AS horizon, origin + INTERVAL {s} HOUR AS datetime, "
    f"{sp.r(f'p{s}', 'pm25_pred')} FROM r12" for s in HZ))


def _forecast(spark, sf_dir, explain=False):
    return fc.forecast_latest(cm.base(spark, sf_dir), _weather(spark, sf_dir), fc.BLEND, None,
                              explain=explain)


@query("p03_recursive_forecast", _P03_SQL)
def p03_recursive_forecast(spark, sf_dir):
    """12-step recursive forecast from each station's last hour (persistence-blend model)."""
    return _forecast(spark, sf_dir).select("location", "origin", "horizon", "datetime", "pm25_pred")


@query("p02_next_row_features", WITH_BASE + ",\n" + _P03_STATE + ",\nx AS (SELECT location, origin, " + ", ".join(
    f"{e} AS f_{f}" for f, e in sp.future_feats(1).items()) + " FROM st)\nSELECT location, origin, " + ", ".join(
    f"CAST(f_{f} AS BIGINT) AS {f}" if f in sp.INT_FEATURES else sp.r(f"f_{f}", f) for f in sp.FEATURE_ORDER) + " FROM x")
def p02_next_row_features(spark, sf_dir):
    """The synthesised first future row: all features (persisted pollutants, as-of weather, lags)."""
    b = cm.base(spark, sf_dir)
    st = fc.latest_origins(fc.origin_state(b))
    full = fc.assemble_state(st, fc.future_weather(st, _weather(spark, sf_dir)))
    none = F.lit(None).cast("double")
    f = fc.step_features(1, F.col("pm"), {"location_id": F.lit(-1), "lat_norm": none, "lon_norm": none})
    return full.select("location", "origin", *[f[c].alias(c) for c in FEATURES])


_MISSING_RATIO = "CASE WHEN missing_features = '' THEN 0.0 ELSE len(string_split(missing_features, ',')) / 34.0 END"


@query("p04_input_warnings", WITH_BASE + ",\n" + _P03_STATE + ",\n" + sp.recursion() + "\n" + "\nUNION ALL ".join(
    f"SELECT location, CAST({s} AS BIGINT) AS horizon, CAST(CASE WHEN p > 500 THEN 1 ELSE 0 END AS BIGINT) AS is_extreme, "
    f"missing_features, {sp.r(_MISSING_RATIO, 'missing_ratio')} FROM ("
    f"SELECT r.location, r.p{s} AS p, m.missing_features FROM r12 r JOIN (SELECT location, {sp.missing_names(s)} AS missing_features "
    f"FROM {'st' if s == 1 else f'r{s - 1}'}) m USING (location))" for s in HZ))
def p04_input_warnings(spark, sf_dir):
    """Per forecast step: extreme-prediction flag, names and share of missing features."""
    return _forecast(spark, sf_dir).select("location", "horizon", "is_extreme",
                                           F.array_join("missing_features", ",").alias("missing_features"), "missing_ratio")


@query("p06_local_time", WITH_BASE + """
SELECT location, datetime, timezone('Europe/Budapest', timezone('UTC', datetime)) AS datetime_local FROM base""")
def p06_local_time(spark, sf_dir):
    return fc.local_time(cm.base(spark, sf_dir).select("location", "datetime"))


_HIST = ",\n".join([sp.interp_station("filled", "base")])


@query("p07_plot_frame", WITH_BASE + ",\n" + _P03_STATE + ",\n" + sp.recursion() + ",\n" + _HIST + """,
h AS (SELECT location, datetime, pm25, row_number() OVER (PARTITION BY location ORDER BY datetime DESC) AS k
      FROM filled WHERE pm25 IS NOT NULL)
SELECT location, datetime, """ + sp.r("pm25", "value") + """, 'recent' AS kind FROM h WHERE k <= 12
UNION ALL SELECT location, datetime, """ + sp.r("pm25", "value") + """, 'forecast' AS kind FROM h WHERE k = 1
""" + "".join(f"UNION ALL SELECT location, origin + INTERVAL {s} HOUR, {sp.r(f'p{s}', 'value')}, 'forecast' FROM r12\n"
              for s in HZ))
def p07_plot_frame(spark, sf_dir):
    """Last 12 actuals + join point + 12 forecast hours per station."""
    hist = clean.interpolate_station(cm.base(spark, sf_dir))
    return fc.plot_frame(hist, _forecast(spark, sf_dir))


# ------------------------------------------------------------------ P08 -------
_P08_STATE = sp.forecast_state("r._rn >= 48 AND r._rn <= r._n - 13", truth=True)
_P08_SQL = (WITH_BASE + ",\n" + _P08_STATE + ",\n" + sp.recursion() + ",\nbt AS (" + "\nUNION ALL ".join(
    f"SELECT r.location, r.origin AS forecast_origin, {s} AS horizon, j.pm25 AS y_true, r.p{s} AS y_pred "
    f"FROM r12 r JOIN rows j ON j.location = r.location AND j._rn = r.origin_rn + {s}" for s in HZ) + ")")


def _backtest(spark, sf_dir):
    return fc.backtest(cm.base(spark, sf_dir), _weather(spark, sf_dir), fc.BLEND, None)


@query("p08_walk_forward", _P08_SQL + "\nSELECT location, forecast_origin, CAST(horizon AS BIGINT) AS horizon, " +
       sp.out(["y_true", "y_pred"]) + " FROM bt")
def p08_walk_forward(spark, sf_dir):
    """Every origin with 48 h history and 12 h truth, prefix-only gap filling, all stations."""
    return _backtest(spark, sf_dir)


@query("p08_last_row_weather", WITH_BASE + ",\n" + sp.forecast_state("r._rn >= 48 AND r._rn <= r._n - 13", truth=True, last_row=True) +
       ",\n" + sp.recursion() + "\n" + "\nUNION ALL ".join(
           f"SELECT location, origin AS forecast_origin, CAST({s} AS BIGINT) AS horizon, {sp.r(f'p{s}', 'y_pred')} FROM r12" for s in HZ))
def p08_last_row_weather(spark, sf_dir):
    """The backtest with the last weather row for every target hour."""
    out = fc.backtest(cm.base(spark, sf_dir), _weather(spark, sf_dir), fc.BLEND, None, weather_rule="last_row")
    return out.select("location", "forecast_origin", "horizon", "y_pred")


@query("v08_metrics_by_horizon", _P08_SQL + "\nSELECT CAST(horizon AS BIGINT) AS horizon, " +
       sp.r("sqrt(avg(pow(y_true - y_pred, 2)))", "RMSE") + ", " + sp.r("avg(abs(y_true - y_pred))", "MAE") +
       ", CAST(count(*) AS BIGINT) AS n FROM bt WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY horizon")
def v08_metrics_by_horizon(spark, sf_dir):
    return metrics.by_horizon(_backtest(spark, sf_dir))


@query("v09_error_by_origin", _P08_SQL + "\nSELECT location, forecast_origin, " +
       sp.r("avg(y_pred - y_true)", "mean_error") + " FROM bt GROUP BY location, forecast_origin")
def v09_error_by_origin(spark, sf_dir):
    return metrics.error_by_origin(_backtest(spark, sf_dir))


# ------------------------------------------------------------------ P10 -------
@query("p10_serving_history", WITH_BASE + ",\n" + sp.interp_station("filled", "base") + """,
codes AS (SELECT datetime, max(weather_code) AS weather_code FROM wx_raw GROUP BY datetime)
SELECT """ + sp.out(sp.BASE_COLS, keep={"location", "datetime"}) +
       ", CAST(c.weather_code AS BIGINT) AS weather_code FROM filled f LEFT JOIN codes c USING (datetime)")
def p10_serving_history(spark, sf_dir):
    _, wx = cm.inputs(spark, sf_dir)
    return fc.serving_history(cm.base(spark, sf_dir), wx)


# ------------------------------------------------------------------ B ---------
_TEST_PANELS = "WITH " + sp.PANELS_CTES
_B01 = """,
m AS (SELECT location, datetime, CASE WHEN count(pm25) OVER f = 3 THEN avg(pm25) OVER f END AS window_mean
      FROM test WINDOW f AS (PARTITION BY location ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
win AS (SELECT location, datetime - INTERVAL 2 HOUR AS window_start, datetime AS window_end, window_mean FROM (
        SELECT *, row_number() OVER (PARTITION BY location ORDER BY window_mean, datetime) AS k
        FROM m WHERE window_mean IS NOT NULL) WHERE k = 1)"""


def _test_series(spark, sf_dir):
    return cm.prepared(spark, sf_dir).test


@query("b01_recommend_window", _TEST_PANELS + _B01 + "\nSELECT location, window_start, window_end, " +
       sp.r("window_mean", "window_mean") + " FROM win")
def b01_recommend_window(spark, sf_dir):
    """Best 3-hour window per station on the gap-filled test series."""
    return advise.recommend_window(_test_series(spark, sf_dir), "pm25")


@query("b01_recommend_window_forecast", WITH_BASE + ",\n" + _P03_STATE + ",\n" + sp.recursion() + """,
fcs AS (""" + "\nUNION ALL ".join(f"SELECT location, origin + INTERVAL {s} HOUR AS datetime, p{s} AS v FROM r12"
                                  for s in HZ) + """),
m AS (SELECT location, datetime, CASE WHEN count(v) OVER f = 3 THEN avg(v) OVER f END AS window_mean
      FROM fcs WINDOW f AS (PARTITION BY location ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT location, datetime - INTERVAL 2 HOUR AS window_start, datetime AS window_end, """ +
       sp.r("window_mean", "window_mean") + """ FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY window_mean, datetime) AS k FROM m
  WHERE window_mean IS NOT NULL) WHERE k = 1""")
def b01_recommend_window_forecast(spark, sf_dir):
    """Best 3-hour window per station over the 12-hour forecast."""
    return advise.recommend_window(_forecast(spark, sf_dir), "pm25_pred")


_B02 = ",\ncodes AS (SELECT datetime, max(weather_code) AS weather_code FROM wx_raw GROUP BY datetime)"


@query("b02_attach_weather_code", _TEST_PANELS + _B02 +
       "\nSELECT t.location, t.datetime, " + sp.r("t.pm25", "pm25") +
       ", CAST(c.weather_code AS BIGINT) AS weather_code FROM test t LEFT JOIN codes c USING (datetime)")
def b02_attach_weather_code(spark, sf_dir):
    _, wx = cm.inputs(spark, sf_dir)
    return advise.attach_weather_code(_test_series(spark, sf_dir), wx).select(
        "location", "datetime", "pm25", "weather_code")


_B03 = _TEST_PANELS + _B01 + _B02 + """,
rw AS (SELECT t.location, t.datetime, t.pm25, c.weather_code, w.window_start, w.window_end,
              row_number() OVER (PARTITION BY t.location ORDER BY t.datetime) - 1 AS i,
              count(*) OVER (PARTITION BY t.location) AS n
       FROM test t JOIN win w ON t.location = w.location AND t.datetime BETWEEN w.window_start AND w.window_end
       LEFT JOIN codes c ON c.datetime = t.datetime),
facts AS (SELECT location, window_start, window_end, avg(pm25) AS avg_pm,
          CASE WHEN count(weather_code) > 0 THEN count(*) FILTER (WHERE weather_code IN (0, 1, 2, 3)) / count(weather_code)
               ELSE 0.0 END AS weather_ratio,
          coalesce(max(weather_code) FILTER (WHERE i = n // 2),
                   arg_min(weather_code, datetime) FILTER (WHERE weather_code IS NOT NULL)) AS weather_code
          FROM rw GROUP BY location, window_start, window_end)"""


def _facts(spark, sf_dir):
    _, wx = cm.inputs(spark, sf_dir)
    s = advise.attach_weather_code(_test_series(spark, sf_dir), wx)
    return advise.window_facts(s, advise.recommend_window(s, "pm25"), "pm25")


@query("b03_b04_window_facts", _B03 + "\nSELECT location, window_start, window_end, " +
       sp.out(["avg_pm", "weather_ratio"]) + ", CAST(weather_code AS BIGINT) AS weather_code FROM facts")
def b03_b04_window_facts(spark, sf_dir):
    """Mean pm in the window, good-weather share, representative weather code."""
    return _facts(spark, sf_dir)


_ADVICE = (f"CASE WHEN avg_pm < 15 AND weather_ratio >= 0.5 THEN '{advise.ADVICE_BOTH}' "
           f"WHEN avg_pm < 15 THEN '{advise.ADVICE_PM}' WHEN weather_ratio >= 0.5 THEN '{advise.ADVICE_WEATHER}' "
           f"ELSE '{advise.ADVICE_NONE}' END")


@query("b05_b06_advice", _B03 + "\nSELECT location, window_start AS start, window_end AS \"end\", "
       f"{_ADVICE} AS recommendation_text, CAST(weather_code AS BIGINT) AS weather_code FROM facts")
def b05_b06_advice(spark, sf_dir):
    """Advice text and the recommended-window record (flattened)."""
    w = advise.window_output(_facts(spark, sf_dir))
    return w.select("location", "recommended_window.*")


@query("b07_concentration_band", WITH_BASE + ",\n" + _P03_STATE + ",\n" + sp.recursion() + "\n" +
       "\nUNION ALL ".join(
           f"SELECT location, CAST({s} AS BIGINT) AS horizon, CASE WHEN p{s} <= 12.0 THEN '#d4edda' "
           f"WHEN p{s} <= 35.0 THEN '#fff3cd' WHEN p{s} <= 55.0 THEN '#ffe5b4' ELSE '#f8d7da' END AS band_colour "
           f"FROM r12" for s in HZ))
def b07_concentration_band(spark, sf_dir):
    return advise.concentration_band(_forecast(spark, sf_dir)).select("location", "horizon", "band_colour")


def _icon_sql() -> str:
    cls = " ".join(f"WHEN weather_code IN ({', '.join(map(str, codes))}) THEN '{c}'"
                   for codes, c, _, _ in advise.WEATHER_GROUPS)
    icon = " ".join(f"WHEN weather_code IN ({', '.join(map(str, codes))}) THEN "
                    f"CASE WHEN night = 1 THEN '{n}' ELSE '{d}' END"
                    for codes, _, d, n in advise.WEATHER_GROUPS)
    return (WITH_BASE + """,
lw AS (SELECT datetime, weather_code, CASE WHEN hour(timezone('Europe/Budapest', timezone('UTC', datetime))) < 6
              OR hour(timezone('Europe/Budapest', timezone('UTC', datetime))) >= 20 THEN 1 ELSE 0 END AS night
       FROM wx_raw)
SELECT datetime, CAST(weather_code AS BIGINT) AS weather_code, CAST(night AS BIGINT) AS is_night, """ +
            f"CASE {cls} ELSE 'other' END AS weather_class, CASE {icon} ELSE '☁️' END AS icon FROM lw")


@query("b08_weather_icon", _icon_sql())
def b08_weather_icon(spark, sf_dir):
    _, wx = cm.inputs(spark, sf_dir)
    return advise.weather_icon(wx.select("datetime", "weather_code"))
