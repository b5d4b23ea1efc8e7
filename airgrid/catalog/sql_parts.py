"""ANSI SQL (DuckDB dialect) formulations of the catalog queries.

These are the independent check of the Spark plans: each query is written
from the operator's definition over the raw driver views (``events`` ...), and
the driver compares both results.  The pieces below are CTE bodies that later
CTEs refer to by name.
"""

from __future__ import annotations

K = 3
D = 6

POLL = ["no2", "pm10", "pm25", "so2"]
WX = ["temperature", "humidity", "wind_speed", "precipitation"]
REQUIRED = ["pm25_next", "pm25_lag1", "pm25_lag3", "pm25_lag6", "pm25_lag24", "pm25_roll6", "pm25_roll24",
            "pm25_trend_3h", "pm25_std_12h", "temp_change_3h", "humidity_change_3h", "wind_change_3h", "stagnation_hours_6h"]
BASE_COLS = ["location", "datetime", "latitude", "longitude"] + POLL + WX


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE) * 1.000000000001, {D}) + 0.0 AS {name}"


def cols(names: list[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}{c}" for c in names)


# --------------------------------------------------------------- adapter ------
MEAS = f"""
meas AS (
  SELECT concat('"Győr ', CAST(user_id % {K} AS VARCHAR), '" ') AS location,
         CAST(47.6 + (user_id % {K}) * 0.01 AS DOUBLE) AS latitude,
         CAST(17.6 + (user_id % {K}) * 0.01 AS DOUBLE) AS longitude,
         CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime,
         CASE event_type WHEN 'view' THEN 'pm25' WHEN 'click' THEN 'pm10'
              WHEN 'purchase' THEN 'no2' WHEN 'signup' THEN 'so2' WHEN 'error' THEN 'o3' END AS parameter,
         CAST(CASE WHEN event_id % 50 = 0 THEN -1.0 ELSE value END AS DOUBLE) AS value
  FROM events)"""

WX_RAW = """
wx_raw AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime,
         CAST(sum(event_id) % 300 AS DOUBLE) / 10.0 - 5.0 AS temperature,
         40.0 + CAST(sum(user_id) % 60 AS DOUBLE) AS humidity,
         CAST(sum(event_id) % 80 AS DOUBLE) / 10.0 AS wind_speed,
         CAST(count(*) % 7 AS DOUBLE) / 10.0 AS precipitation,
         CAST([0, 2, 45, 51, 61, 71, 80, 95][CAST(sum(event_id) % 8 AS INTEGER) + 1] AS INTEGER) AS weather_code
  FROM events GROUP BY 1)"""

# Pivot, NULL keys dropped
WIDE = """
wide AS (
  SELECT datetime, location, latitude, longitude,
         avg(CASE WHEN parameter = 'pm25' THEN value END) AS pm25,
         avg(CASE WHEN parameter = 'pm10' THEN value END) AS pm10,
         avg(CASE WHEN parameter = 'no2' THEN value END) AS no2,
         avg(CASE WHEN parameter = 'so2' THEN value END) AS so2,
         avg(CASE WHEN parameter = 'co' THEN value END) AS co,
         avg(CASE WHEN parameter = 'o3' THEN value END) AS o3
  FROM meas
  WHERE datetime IS NOT NULL AND location IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
  GROUP BY datetime, location, latitude, longitude)"""

# C04 + C01 + C02 + C03 + C05
CLEANED = """
named AS (
  SELECT datetime, trim(strip_accents(replace(location, '"', ''))) AS location,
         latitude, longitude, no2, pm10, pm25, so2
  FROM wide),
wxd AS (
  SELECT datetime, avg(temperature) AS temperature, avg(humidity) AS humidity,
         avg(wind_speed) AS wind_speed, avg(precipitation) AS precipitation
  FROM wx_raw GROUP BY datetime),
merged AS (
  SELECT n.*, w.temperature, w.humidity, w.wind_speed, w.precipitation
  FROM named n LEFT JOIN wxd w ON n.datetime = w.datetime),
cleaned AS (
  SELECT datetime, location, latitude, longitude,
         CASE WHEN no2 >= 0 THEN no2 END AS no2,
         CASE WHEN pm10 >= 0 THEN pm10 END AS pm10,
         CASE WHEN pm25 >= 0 THEN pm25 END AS pm25,
         CASE WHEN so2 >= 0 THEN so2 END AS so2,
         temperature, humidity, wind_speed, precipitation
  FROM merged)"""

# C06 + C07 + C08
RESAMPLED = """
poll_h AS (
  SELECT location, date_trunc('hour', datetime) AS datetime,
         avg(no2) AS no2, avg(pm10) AS pm10, avg(pm25) AS pm25, avg(so2) AS so2
  FROM cleaned GROUP BY 1, 2),
spine AS (
  SELECT location, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime
  FROM (SELECT location, min(datetime) AS lo, max(datetime) AS hi FROM poll_h GROUP BY location)),
poll_grid AS (
  SELECT s.location, s.datetime, p.no2, p.pm10, p.pm25, p.so2
  FROM spine s LEFT JOIN poll_h p ON s.location = p.location AND s.datetime = p.datetime),
wx_ts AS (
  SELECT datetime, max(temperature) AS temperature, max(humidity) AS humidity,
         max(wind_speed) AS wind_speed, max(precipitation) AS precipitation
  FROM cleaned GROUP BY datetime),
wx_h AS (
  SELECT date_trunc('hour', datetime) AS datetime, avg(temperature) AS temperature,
         avg(humidity) AS humidity, avg(wind_speed) AS wind_speed, avg(precipitation) AS precipitation
  FROM wx_ts GROUP BY 1),
coords AS (SELECT DISTINCT location, latitude, longitude FROM cleaned),
base AS (
  SELECT g.location, g.datetime, c.latitude, c.longitude, g.no2, g.pm10, g.pm25, g.so2,
         w.temperature, w.humidity, w.wind_speed, w.precipitation
  FROM poll_grid g LEFT JOIN wx_h w ON g.datetime = w.datetime
  LEFT JOIN coords c ON g.location = c.location)"""

BASE_CTES = ",".join([MEAS, WX_RAW, WIDE, CLEANED, RESAMPLED])


def interp(name: str, src: str, columns: list[str], fill: list[str],
           part: str | None = "location", order: str = "datetime", limit: int = 3) -> str:
    """CTEs ``{name}_rn``, ``{name}_p`` and ``{name}``: position-linear fill, forward limit."""
    pby = f"PARTITION BY {part} " if part else ""
    wb = f"({pby}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wf = f"({pby}ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    parts = []
    for c in fill:
        parts.append(f"last_value(CASE WHEN {c} IS NOT NULL THEN _rn END IGNORE NULLS) OVER {wb} AS {c}__pi")
        parts.append(f"last_value({c} IGNORE NULLS) OVER {wb} AS {c}__px")
        parts.append(f"first_value(CASE WHEN {c} IS NOT NULL THEN _rn END IGNORE NULLS) OVER {wf} AS {c}__ni")
        parts.append(f"first_value({c} IGNORE NULLS) OVER {wf} AS {c}__nx")
    sel = []
    for c in columns:
        if c in fill:
            sel.append(
                f"CASE WHEN {c} IS NOT NULL THEN {c} "
                f"WHEN {c}__pi IS NULL OR _rn - {c}__pi > {limit} THEN NULL "
                f"WHEN {c}__ni IS NULL THEN {c}__px "
                f"ELSE {c}__px + ({c}__nx - {c}__px) * CAST(_rn - {c}__pi AS DOUBLE) / CAST({c}__ni - {c}__pi AS DOUBLE) END AS {c}")
        else:
            sel.append(c)
    return (f"{name}_rn AS (SELECT *, row_number() OVER ({pby}ORDER BY {order}) AS _rn FROM {src}),\n"
            f"{name}_p AS (SELECT *, {', '.join(parts)} FROM {name}_rn),\n"
            f"{name} AS (SELECT {', '.join(sel)} FROM {name}_p)")


def interp_station(name: str, src: str, columns: list[str] = BASE_COLS) -> str:
    """C10 (weather over the distinct hours of ``src``) then C09 (pollutants per station)."""
    hours = (f"{name}_wh AS (SELECT datetime, {', '.join(f'max({c}) AS {c}' for c in WX)} "
             f"FROM {src} GROUP BY datetime)")
    wfill = interp(f"{name}_wf", f"{name}_wh", ["datetime"] + WX, WX, None)
    rest = [c for c in columns if c not in WX]
    joined = (f"{name}_wj AS (SELECT {', '.join('s.' + c for c in rest)}, "
              f"{', '.join('f.' + c for c in WX)} FROM {src} s LEFT JOIN {name}_wf f "
              f"ON s.datetime = f.datetime)")
    reorder = f"{name}_wo AS (SELECT {', '.join(columns)} FROM {name}_wj)"
    pfill = interp(name, f"{name}_wo", columns, [c for c in POLL if c in columns])
    return ",\n".join([hours, wfill, joined, reorder, pfill])


SPLIT = """
q AS (SELECT quantile_cont(epoch_us(datetime), 0.75) AS split FROM base),
train_raw AS (SELECT b.* FROM base b, q WHERE CAST(epoch_us(b.datetime) AS DOUBLE) < q.split),
test_raw AS (SELECT b.* FROM base b, q WHERE CAST(epoch_us(b.datetime) AS DOUBLE) >= q.split)"""

CONTEXT = f"""
tail24 AS (
  SELECT {cols(BASE_COLS)} FROM (
    SELECT *, row_number() OVER (PARTITION BY location ORDER BY datetime DESC) AS _k FROM train)
  WHERE _k <= 24),
ctx_raw AS (SELECT * FROM tail24 UNION ALL SELECT {cols(BASE_COLS)} FROM test_raw)"""

TEST_SEMI = f"""
test AS (
  SELECT {cols(BASE_COLS, 'c.')} FROM ctx c
  WHERE EXISTS (SELECT 1 FROM test_raw t WHERE t.location = c.location AND t.datetime = c.datetime))"""

PANELS_CTES = ",\n".join([
    BASE_CTES, SPLIT, interp_station("train", "train_raw"), CONTEXT,
    interp_station("ctx", "ctx_raw"), TEST_SEMI])

W = "(PARTITION BY location ORDER BY datetime)"


def wprev(n: int) -> str:
    return f"(PARTITION BY location ORDER BY datetime ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


FEATURE_EXPRS = {
    "pm25_lag1": f"lag(pm25, 1) OVER {W}",
    "pm25_lag3": f"lag(pm25, 3) OVER {W}",
    "pm25_lag6": f"lag(pm25, 6) OVER {W}",
    "pm25_lag24": f"lag(pm25, 24) OVER {W}",
    "pm25_roll6": f"CASE WHEN count(pm25) OVER {wprev(6)} = 6 THEN avg(pm25) OVER {wprev(6)} END",
    "pm25_roll24": f"CASE WHEN count(pm25) OVER {wprev(24)} = 24 THEN avg(pm25) OVER {wprev(24)} END",
    "pm25_trend_3h": f"pm25 - lag(pm25, 3) OVER {W}",
    "pm25_std_12h": f"CASE WHEN count(pm25) OVER {wprev(12)} = 12 THEN stddev_samp(pm25) OVER {wprev(12)} END",
    "hour": "CAST(hour(datetime) AS BIGINT)",
    "hour_sin": "sin(2 * pi() * hour(datetime) / 24)",
    "hour_cos": "cos(2 * pi() * hour(datetime) / 24)",
    "month": "CAST(month(datetime) AS BIGINT)",
    "month_sin": "sin(2 * pi() * month(datetime) / 12)",
    "month_cos": "cos(2 * pi() * month(datetime) / 12)",
    "weekend_flag": "CAST(CASE WHEN isodow(datetime) >= 6 THEN 1 ELSE 0 END AS BIGINT)",
    "heating_season_flag": "CAST(CASE WHEN month(datetime) IN (10, 11, 12, 1, 2, 3, 4) THEN 1 ELSE 0 END AS BIGINT)",
    "temp_change_3h": f"temperature - lag(temperature, 3) OVER {W}",
    "humidity_change_3h": f"humidity - lag(humidity, 3) OVER {W}",
    "wind_change_3h": f"wind_speed - lag(wind_speed, 3) OVER {W}",
    "stagnation_index": "humidity / (wind_speed + 0.5)",
    "temp_wind_interaction": "temperature * wind_speed",
    "mixing_index": "(temperature + 273.15) * (wind_speed + 1.0) / (humidity + 20.0)",
    "ventilation_index": "wind_speed * (temperature + 273.15)",
    "stagnation_hours_6h": (f"CASE WHEN count(*) OVER {wprev(6)} = 6 THEN CAST(sum(CASE WHEN wind_speed < 2 "
                            f"THEN 1 ELSE 0 END) OVER {wprev(6)} AS DOUBLE) END"),
}
INT_FEATURES = {"hour", "month", "weekend_flag", "heating_season_flag", "location_id"}


def features_cte(name: str, src: str) -> str:
    """Feature table ``name`` over panel ``src`` using the train fit (``fit_means``, ``fit_map``)."""
    exprs = ", ".join(f"{e} AS {k}" for k, e in FEATURE_EXPRS.items())
    return (f"{name}_w AS (SELECT *, {exprs} FROM {src}),\n"
            f"{name} AS (SELECT f.*, CAST(coalesce(m.location_id, -1) AS BIGINT) AS location_id, "
            f"f.latitude - fm.lat_mean AS lat_norm, f.longitude - fm.lon_mean AS lon_norm "
            f"FROM {name}_w f LEFT JOIN fit_map m ON f.location = m.location, fit_means fm)")


FIT = """
fit_means AS (SELECT avg(latitude) AS lat_mean, avg(longitude) AS lon_mean FROM train),
fit_map AS (SELECT location, row_number() OVER (ORDER BY location) - 1 AS location_id
            FROM (SELECT DISTINCT location FROM train WHERE location IS NOT NULL))"""

FEATS_CTES = ",\n".join([PANELS_CTES, FIT, features_cte("ftrain", "train"),
                         features_cte("ftest", "test")])


def out(names: list[str], ints: set[str] = frozenset(), keep: set[str] = frozenset()) -> str:
    """Select list: doubles rounded, ints as BIGINT, ``keep`` passed through."""
    sel = []
    for c in names:
        if c in keep:
            sel.append(c)
        elif c in ints:
            sel.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            sel.append(r(c, c))
    return ", ".join(sel)


# ----------------------------------------------------------- forecasting ------
def interp_state(name: str, src: str, fill: list[str], part: str | None = "location",
                 order: str = "datetime", limit: int = 3) -> str:
    """CTE ``name`` = ``src`` + ``_rn`` + per column ``c__pi, c__px, c__ni, c__f`` (filled)."""
    pby = f"PARTITION BY {part} " if part else ""
    wb = f"({pby}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    wf = f"({pby}ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    parts = []
    for c in fill:
        parts += [f"last_value(CASE WHEN {c} IS NOT NULL THEN _rn END IGNORE NULLS) OVER {wb} AS {c}__pi",
                  f"last_value({c} IGNORE NULLS) OVER {wb} AS {c}__px",
                  f"first_value(CASE WHEN {c} IS NOT NULL THEN _rn END IGNORE NULLS) OVER {wf} AS {c}__ni",
                  f"first_value({c} IGNORE NULLS) OVER {wf} AS {c}__nx"]
    fills = [f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}__pi IS NULL OR _rn - {c}__pi > {limit} THEN NULL "
             f"WHEN {c}__ni IS NULL THEN {c}__px ELSE {c}__px + ({c}__nx - {c}__px) * CAST(_rn - {c}__pi AS DOUBLE)"
             f" / CAST({c}__ni - {c}__pi AS DOUBLE) END AS {c}__f" for c in fill]
    return (f"{name}_rn AS (SELECT *, row_number() OVER ({pby}ORDER BY {order}) AS _rn FROM {src}),\n"
            f"{name}_q AS (SELECT *, {', '.join(parts)} FROM {name}_rn),\n"
            f"{name} AS (SELECT *, {', '.join(fills)} FROM {name}_q)")


def view(c: str, j: str, origin_rn: str, rn: str = "_rn") -> str:
    """Prefix-only value of row ``j`` of column ``c`` as seen from ``origin_rn``."""
    return (f"CASE WHEN {j}.{c} IS NOT NULL OR {j}.{c}__ni <= {origin_rn} THEN {j}.{c}__f "
            f"WHEN {j}.{c}__pi IS NOT NULL AND {j}.{rn} - {j}.{c}__pi <= 3 THEN {j}.{c}__px END")


def padl(expr: str, n: int) -> str:
    return f"list_reverse(list_resize(list_reverse({expr}), {n}))"


def forecast_state(origin_where: str, truth: bool = False, last_row: bool = False) -> str:
    """CTEs from ``base`` (and ``wxd``) to ``st``: one row per origin with the state lists."""
    wcols = ["temperature", "humidity", "wind_speed"]
    extra = ", count(*) OVER (PARTITION BY location) AS _n" if truth else ""
    return ",\n".join([
        "pb AS (SELECT location, datetime, latitude, longitude, pm25, pm10, no2, so2 FROM base)",
        interp_state("pst", "pb", ["pm25", "pm10", "no2", "so2"]),
        "wh AS (SELECT datetime, " + ", ".join(f"max({c}) AS {c}" for c in wcols) + " FROM base GROUP BY datetime)",
        interp_state("wst", "wh", wcols, None),
        "rows AS (SELECT p.*, w._rn AS _wrn, " + ", ".join(
            f"w.{c}, w.{c}__pi, w.{c}__px, w.{c}__ni, w.{c}__f" for c in wcols) +
        f"{extra} FROM pst p LEFT JOIN wst w ON p.datetime = w.datetime)",
        f"origins AS (SELECT * FROM rows r WHERE {origin_where})",
        "st0 AS (SELECT o.location, o.datetime AS origin, o._rn AS origin_rn, o._wrn AS owrn, "
        "o.latitude, o.longitude, " +
        ", ".join(f"CASE WHEN o.{c} IS NOT NULL THEN o.{c} WHEN o.{c}__pi IS NOT NULL AND o._rn - o.{c}__pi <= 3 "
                  f"THEN o.{c}__px END AS {c}" for c in ["pm10", "no2", "so2"]) + ", " +
        padl(f"list({view('pm25', 'j', 'o._rn')} ORDER BY j._rn) FILTER (WHERE j._rn >= o._rn - 23)", 24) + " AS pm, " +
        padl(f"list({view('temperature', 'j', 'o._wrn', '_wrn')} ORDER BY j._rn) FILTER (WHERE j._rn >= o._rn - 2)", 3) + " AS t3, " +
        padl(f"list({view('humidity', 'j', 'o._wrn', '_wrn')} ORDER BY j._rn) FILTER (WHERE j._rn >= o._rn - 2)", 3) + " AS h3, " +
        padl(f"list({view('wind_speed', 'j', 'o._wrn', '_wrn')} ORDER BY j._rn) FILTER (WHERE j._rn >= o._rn - 5)", 6) + " AS w6 "
        "FROM origins o JOIN rows j ON j.location = o.location AND j._rn BETWEEN o._rn - 23 AND o._rn "
        "GROUP BY ALL)",
        "tg AS (SELECT DISTINCT origin, s, origin + s * INTERVAL 1 HOUR AS target FROM st0, range(1, 13) r(s))",
        "wlast AS (SELECT * FROM wxd ORDER BY datetime DESC LIMIT 1)",
        "fw AS (SELECT tg.origin, list(coalesce(w.temperature, (SELECT temperature FROM wlast)) ORDER BY tg.s) AS ft, "
        "list(coalesce(w.humidity, (SELECT humidity FROM wlast)) ORDER BY tg.s) AS fh, "
        "list(coalesce(w.wind_speed, (SELECT wind_speed FROM wlast)) ORDER BY tg.s) AS fv, "
        "list(coalesce(w.precipitation, (SELECT precipitation FROM wlast)) ORDER BY tg.s) AS fp "
        + ("FROM tg LEFT JOIN wxd w ON false GROUP BY tg.origin)" if last_row else
           "FROM tg ASOF LEFT JOIN wxd w ON tg.target >= w.datetime GROUP BY tg.origin)"),
        "st AS (SELECT s.*, list_concat(s.t3, f.ft) AS wt, list_concat(s.h3, f.fh) AS wh, "
        "list_concat(list_slice(s.w6, 4, 6), f.fv) AS ww, list_concat(s.w6, f.fv) AS wf, f.fp AS wp "
        "FROM st0 s JOIN fw f ON s.origin = f.origin)",
    ])


def _lsum(expr: str) -> str:
    return f"list_reduce({expr}, lambda a, x: a + x)"


def _mean_full(n: int) -> str:
    sl = f"list_slice(pm, -{n}, -1)"
    return (f"CASE WHEN len({sl}) = {n} AND len(list_filter({sl}, lambda x: x IS NOT NULL)) = {n} "
            f"THEN {_lsum(sl)} / {n} END")


BLEND_COEFS = [("pm25_lag1", 0.5), ("pm25_roll6", 0.3), ("pm25_roll24", 0.2), ("wind_change_3h", -0.1),
               ("stagnation_hours_6h", 0.5), ("temperature", 0.05), ("humidity", -0.02), ("hour_sin", 1.0)]


def blend_feats(s: int) -> dict[str, str]:
    """SQL of the future-row features the blend uses, at step ``s``."""
    return {
        "pm25_lag1": "pm[-1]",
        "pm25_roll6": _mean_full(6),
        "pm25_roll24": _mean_full(24),
        "wind_change_3h": f"ww[{s + 3}] - ww[{s}]",
        "stagnation_hours_6h": (f"CASE WHEN origin_rn + {s} - 6 >= 1 THEN CAST(list_reduce(list_transform("
                                f"list_slice(wf, {s}, {s + 5}), lambda v: CASE WHEN v < 2 THEN 1 ELSE 0 END), "
                                f"lambda a, x: a + x) AS DOUBLE) END"),
        "temperature": f"wt[{s + 3}]",
        "humidity": f"wh[{s + 3}]",
        "hour_sin": f"sin(2 * pi() * hour(origin + INTERVAL {s} HOUR) / 24)",
    }


def future_feats(s: int) -> dict[str, str]:
    """SQL of all features of the future row at step ``s``, from the state before its own value is appended.

    Without a spatial fit: no station number, no normalised coordinates.
    """
    t, h, v, ts = f"wt[{s + 3}]", f"wh[{s + 3}]", f"ww[{s + 3}]", f"(origin + INTERVAL {s} HOUR)"
    tail = "list_slice(pm, -12, -1)"
    full = f"len({tail}) = 12 AND len(list_filter({tail}, lambda x: x IS NOT NULL)) = 12"
    mean12 = f"({_lsum(tail)} / 12)"
    ss = _lsum(f"list_transform({tail}, lambda x: pow(x - {mean12}, 2))")
    return blend_feats(s) | {
        "pm10": "pm10", "no2": "no2", "so2": "so2",
        "pm25_lag3": "pm[-3]", "pm25_lag6": "pm[-6]", "pm25_lag24": "pm[-24]", "pm25_trend_3h": "pm[-1] - pm[-3]",
        "pm25_std_12h": f"CASE WHEN {full} THEN sqrt({ss} / 11) END",
        "hour": f"hour({ts})", "hour_cos": f"cos(2 * pi() * hour({ts}) / 24)",
        "month": f"month({ts})", "month_sin": f"sin(2 * pi() * month({ts}) / 12)",
        "month_cos": f"cos(2 * pi() * month({ts}) / 12)",
        "weekend_flag": f"CASE WHEN isodow({ts}) >= 6 THEN 1 ELSE 0 END",
        "heating_season_flag": f"CASE WHEN month({ts}) IN (10, 11, 12, 1, 2, 3, 4) THEN 1 ELSE 0 END",
        "wind_speed": v, "precipitation": f"wp[{s}]",
        "temp_change_3h": f"{t} - wt[{s}]", "humidity_change_3h": f"{h} - wh[{s}]",
        "stagnation_index": f"{h} / ({v} + 0.5)", "temp_wind_interaction": f"{t} * {v}",
        "mixing_index": f"({t} + 273.15) * ({v} + 1.0) / ({h} + 20.0)", "ventilation_index": f"{v} * ({t} + 273.15)",
        "location_id": "-1", "lat_norm": "CAST(NULL AS DOUBLE)", "lon_norm": "CAST(NULL AS DOUBLE)",
    }


def missing_names(s: int) -> str:
    """SQL of the comma-joined names of the features that are NULL at step ``s``, in feature order."""
    feats = future_feats(s)
    names = ", ".join(f"CASE WHEN ({feats[f]}) IS NULL THEN '{f}' END" for f in FEATURE_ORDER)
    return f"array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',')"


# Written out here and not taken from the code under test.
FEATURE_ORDER = """pm10 no2 so2 pm25_lag1 pm25_lag3 pm25_lag6 pm25_lag24 pm25_roll6 pm25_roll24 pm25_trend_3h
pm25_std_12h hour hour_sin hour_cos month month_sin month_cos weekend_flag heating_season_flag temperature humidity
wind_speed precipitation temp_change_3h humidity_change_3h wind_change_3h stagnation_index temp_wind_interaction
mixing_index ventilation_index stagnation_hours_6h location_id lat_norm lon_norm""".split()


def blend_step(s: int) -> str:
    feats = blend_feats(s)
    raw = "0.0" + "".join(f" + {c} * coalesce(CAST({feats[f]} AS DOUBLE), 0.0)" for f, c in BLEND_COEFS)
    return f"greatest(0.0, {raw})"


def recursion(src: str = "st", horizon: int = 12) -> str:
    """Unrolled recursive forecast with the persistence blend: CTEs ``r1`` .. ``r{horizon}``."""
    out = []
    prev = src
    for s in range(1, horizon + 1):
        out.append(f"r{s} AS (SELECT * REPLACE (list_append(pm, {blend_step(s)}) AS pm), "
                   f"{blend_step(s)} AS p{s} FROM {prev})")
        prev = f"r{s}"
    return ",\n".join(out)
