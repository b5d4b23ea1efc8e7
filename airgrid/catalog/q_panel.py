"""Catalog: ingest shaping, cleaning, splits and features (S10, C, T, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.catalog import common as cm
from airgrid.catalog import sql_parts as sp
from airgrid.catalog.registry import query
from airgrid.operators import clean, features, splits
from airgrid.schemas import BASE_COLUMNS, FEATURES, POLLUTANTS, REQUIRED_COLUMNS, WEATHER_COLS

WITH_BASE = "WITH " + sp.BASE_CTES
WITH_PANELS = "WITH " + sp.PANELS_CTES
WITH_FEATS = "WITH " + sp.FEATS_CTES
BASE_OUT = sp.out(BASE_COLUMNS, keep={"location", "datetime"})


# ------------------------------------------------------------------ S10 ------
@query("s10_pivot", WITH_BASE + "\nSELECT datetime, location, " + sp.out(["latitude", "longitude", "pm25", "pm10", "no2", "so2", "co", "o3"]) +
       " FROM wide")
def s10_pivot(spark, sf_dir):
    """Long readings -> wide per (datetime, location, lat, lon), mean per parameter."""
    return cm.wide(spark, sf_dir)


# ------------------------------------------------------------------ C01-C11 --
@query("c01_clean_locations",
       WITH_BASE + "\nSELECT DISTINCT location AS raw_location, "
       "trim(strip_accents(replace(location, '\"', ''))) AS location FROM meas")
def c01_clean_locations(spark, sf_dir):
    meas, _ = cm.inputs(spark, sf_dir)
    names = meas.select(F.col("location").alias("raw_location")).distinct()
    return clean.clean_locations(names.withColumn("location", F.col("raw_location")))


@query("c02_weather_dedup",
       WITH_BASE + "\nSELECT datetime, " + sp.out(sp.WX) + " FROM wxd")
def c02_weather_dedup(spark, sf_dir):
    _, wx = cm.inputs(spark, sf_dir)
    return clean.dedup_weather(wx.select("datetime", *WEATHER_COLS))


@query("c03_merge_weather",
       WITH_BASE + "\nSELECT datetime, location, " +
       sp.out(["latitude", "longitude", "no2", "pm10", "pm25", "so2"] + sp.WX) + " FROM merged")
def c03_merge_weather(spark, sf_dir):
    _, wx = cm.inputs(spark, sf_dir)
    df = clean.clean_locations(clean.drop_unused(cm.wide(spark, sf_dir)))
    return clean.merge_weather(df, wx)


@query("c04_drop_unused",
       WITH_BASE + "\nSELECT datetime, location, " +
       sp.out(["latitude", "longitude", "pm25", "pm10", "no2", "so2"]) + " FROM wide")
def c04_drop_unused(spark, sf_dir):
    return clean.drop_unused(cm.wide(spark, sf_dir))


@query("c05_clean_pollutants",
       WITH_BASE + "\nSELECT datetime, location, " +
       sp.out(["latitude", "longitude", "no2", "pm10", "pm25", "so2"] + sp.WX) + " FROM cleaned")
def c05_clean_pollutants(spark, sf_dir):
    _, wx = cm.inputs(spark, sf_dir)
    df = clean.clean_locations(clean.drop_unused(cm.wide(spark, sf_dir)))
    return clean.clean_pollutants(clean.merge_weather(df, wx))


def _cleaned(spark, sf_dir):
    _, wx = cm.inputs(spark, sf_dir)
    df = clean.clean_locations(clean.drop_unused(cm.wide(spark, sf_dir)))
    return clean.clean_pollutants(clean.merge_weather(df, wx))


@query("c06_resample_pollutants",
       WITH_BASE + "\nSELECT location, datetime, " + sp.out(sp.POLL) + " FROM poll_grid")
def c06_resample_pollutants(spark, sf_dir):
    return clean.resample_pollutants(_cleaned(spark, sf_dir))


@query("c06_resample_subhour",
       (WITH_BASE + "\nSELECT location, datetime, " + sp.out(sp.POLL) + " FROM poll_grid")
       .replace("CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime,\n         CASE event_type",
                "CAST(ts AS TIMESTAMP) AS datetime,\n         CASE event_type"))
def c06_resample_subhour(spark, sf_dir):
    """C06 on raw sub-hour reading times: floor, mean, gap-free grid per station."""
    meas, wx = cm.inputs(spark, sf_dir, hourly=False)
    df = clean.clean_locations(clean.drop_unused(clean.pivot_measurements(meas)))
    return clean.resample_pollutants(clean.clean_pollutants(clean.merge_weather(df, wx)))


@query("c07_resample_weather",
       WITH_BASE + "\nSELECT datetime, " + sp.out(sp.WX) + " FROM wx_h")
def c07_resample_weather(spark, sf_dir):
    return clean.resample_weather(_cleaned(spark, sf_dir))


@query("c08_resample_joins", WITH_BASE + "\nSELECT " + BASE_OUT + " FROM base")
def c08_resample_joins(spark, sf_dir):
    return clean.resample_hourly(_cleaned(spark, sf_dir))


@query("c09_interpolate_pollutants",
       WITH_BASE + ",\n" + sp.interp("filled", "base", sp.BASE_COLS, sp.POLL) +
       "\nSELECT " + BASE_OUT + " FROM filled")
def c09_interpolate_pollutants(spark, sf_dir):
    return clean.interpolate_pollutants(cm.base(spark, sf_dir))


@query("c10_interpolate_weather",
       WITH_BASE + ",\nwh AS (SELECT datetime, " + ", ".join(f"max({c}) AS {c}" for c in sp.WX) +
       " FROM base GROUP BY datetime),\n" + sp.interp("filled", "wh", ["datetime"] + sp.WX, sp.WX, None) +
       "\nSELECT datetime, " + sp.out(sp.WX) + " FROM filled")
def c10_interpolate_weather(spark, sf_dir):
    """Weather gap filling on the one-row-per-hour table of the panel."""
    b = cm.base(spark, sf_dir)
    hours = b.groupBy("datetime").agg(*[F.first(c, ignorenulls=True).alias(c) for c in WEATHER_COLS])
    return clean.interpolate(hours, WEATHER_COLS, None)


@query("c11_base_dataset",
       WITH_BASE + ",\n" + sp.interp_station("filled", "base") + "\nSELECT " + BASE_OUT + " FROM filled")
def c11_base_dataset(spark, sf_dir):
    """Base panel, gap-filled (C09 + C10) as the serving history uses it."""
    return clean.interpolate_station(cm.base(spark, sf_dir))


# ------------------------------------------------------------------ T01-T10 --
@query("t01_quantile_split",
       WITH_BASE + ",\n" + sp.SPLIT.strip() +
       "\nSELECT location, datetime, 'train' AS part FROM train_raw"
       "\nUNION ALL SELECT location, datetime, 'test' AS part FROM test_raw")
def t01_quantile_split(spark, sf_dir):
    b = cm.base(spark, sf_dir)
    tr, te = splits.quantile_split(b)
    return (tr.select("location", "datetime", F.lit("train").alias("part"))
            .unionByName(te.select("location", "datetime", F.lit("test").alias("part"))))


@query("t02_date_split",
       WITH_BASE + "\nSELECT location, datetime, CASE WHEN datetime < TIMESTAMP '2024-01-20 00:00:00' "
       "THEN 'train' ELSE 'test' END AS part FROM base")
def t02_date_split(spark, sf_dir):
    b = cm.base(spark, sf_dir)
    tr, te = splits.date_split(b, "2024-01-20 00:00:00")
    return (tr.select("location", "datetime", F.lit("train").alias("part"))
            .unionByName(te.select("location", "datetime", F.lit("test").alias("part"))))


@query("t03_last_n", WITH_PANELS + "\nSELECT " + BASE_OUT + " FROM tail24")
def t03_last_n(spark, sf_dir):
    p = cm.prepared(spark, sf_dir)
    return splits.last_n(p.train, 24)


@query("t04_context_union", WITH_PANELS + "\nSELECT " + BASE_OUT + " FROM ctx")
def t04_context_union(spark, sf_dir):
    p = cm.prepared(spark, sf_dir)
    _, test_raw = splits.split_at(p.base, p.split_us)
    return splits.with_context(p.train, test_raw)


@query("t05_test_panel", WITH_PANELS + "\nSELECT " + BASE_OUT + " FROM test")
def t05_test_panel(spark, sf_dir):
    return cm.prepared(spark, sf_dir).test


@query("t05_train_panel", WITH_PANELS + "\nSELECT " + BASE_OUT + " FROM train")
def t05_train_panel(spark, sf_dir):
    return cm.prepared(spark, sf_dir).train


@query("t06_target",
       WITH_PANELS + "\nSELECT location, datetime, " + sp.r("pm25", "pm25") + ", " +
       sp.r("lead(pm25, 1) OVER (PARTITION BY location ORDER BY datetime)", "pm25_next") + " FROM train")
def t06_target(spark, sf_dir):
    p = cm.prepared(spark, sf_dir)
    return splits.add_target(p.train).select("location", "datetime", "pm25", "pm25_next")


@query("t06_target_consistent", WITH_FEATS + "\nSELECT location, datetime, " + sp.r("pm25", "pm25_next") + ", " +
       sp.r("pm25_lag1 - pm25_lag3", "pm25_trend_3h") + " FROM ftrain")
def t06_target_consistent(spark, sf_dir):
    """Target and trend aligned as in a forecast: a row's features predict the row itself."""
    tr, _, _ = cm.train_features(spark, sf_dir)
    return splits.add_target(tr, align="consistent").select("location", "datetime", "pm25_next", "pm25_trend_3h")


@query("t05_keep_context", WITH_PANELS + ",\n" + sp.FIT + ",\n" + sp.features_cte("fctx", "ctx") +
       "\nSELECT c.location, c.datetime, " + ", ".join(sp.r(f"c.{x}", x) for x in ("pm25_lag24", "pm25_roll24", "temp_change_3h")) +
       " FROM fctx c WHERE EXISTS (SELECT 1 FROM test_raw t WHERE t.location = c.location AND t.datetime = c.datetime)")
def t05_keep_context(spark, sf_dir):
    """Test features built before the train context is removed: the first test rows keep their lags."""
    prep = splits.prepare_panels(cm.base(spark, sf_dir), keep_context=True)
    feats, _ = features.build_features(prep.test, features.fit_spatial(prep.train))
    return splits.drop_context(feats, prep).select("location", "datetime", "pm25_lag24", "pm25_roll24", "temp_change_3h")


@query("c09_forward_fill", WITH_BASE + """,
n AS (SELECT *, row_number() OVER w AS rn FROM base WINDOW w AS (PARTITION BY location ORDER BY datetime)),
p AS (SELECT location, datetime, """ + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER b AS {c}, rn - last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS {c}_age"
    for c in ("no2", "pm10", "pm25", "so2")) + """ FROM n
      WINDOW b AS (PARTITION BY location ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT location, datetime, """ + ", ".join(sp.r(f"CASE WHEN {c}_age <= 3 THEN {c} END", c) for c in ("no2", "pm10", "pm25", "so2")) + " FROM p")
def c09_forward_fill(spark, sf_dir):
    """Gap filling that repeats the last value: no filled value uses a later one."""
    return clean.interpolate_pollutants(cm.base(spark, sf_dir), fill="forward").select("location", "datetime", "no2", "pm10", "pm25", "so2")


_REQ_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in REQUIRED_COLUMNS)
_T07_COLS = ["location", "datetime"] + REQUIRED_COLUMNS


@query("t07_complete_cases",
       WITH_FEATS + ",\nt AS (SELECT *, lead(pm25, 1) OVER (PARTITION BY location ORDER BY datetime) "
       "AS pm25_next FROM ftrain)\nSELECT " +
       sp.out(_T07_COLS, keep={"location", "datetime"}) +
       " FROM t WHERE " + _REQ_NOT_NULL)
def t07_complete_cases(spark, sf_dir):
    tr, _, _ = cm.train_features(spark, sf_dir)
    return splits.complete_cases(splits.add_target(tr)).select(*_T07_COLS)


@query("t08_ts_folds",
       WITH_FEATS + """,
t AS (SELECT *, lead(pm25, 1) OVER (PARTITION BY location ORDER BY datetime) AS pm25_next FROM ftrain),
cc AS (SELECT location, datetime FROM t WHERE """ + _REQ_NOT_NULL + """),
pos AS (SELECT datetime, row_number() OVER (ORDER BY datetime, location) - 1 AS pos FROM cc),
n AS (SELECT count(*) AS n, count(*) // 6 AS m FROM cc),
folds AS (SELECT f AS fold, n - (5 - f) * m AS train_end, n - (5 - f) * m + m AS val_end
          FROM n, range(5) r(f))
SELECT CAST(fold AS BIGINT) AS fold,
       CAST(count(*) FILTER (WHERE pos < train_end) AS BIGINT) AS n_train,
       max(datetime) FILTER (WHERE pos < train_end) AS train_max,
       CAST(count(*) FILTER (WHERE pos >= train_end AND pos < val_end) AS BIGINT) AS n_val,
       min(datetime) FILTER (WHERE pos >= train_end AND pos < val_end) AS val_min,
       max(datetime) FILTER (WHERE pos >= train_end AND pos < val_end) AS val_max
FROM folds, pos GROUP BY fold""")
def t08_ts_folds(spark, sf_dir):
    """Expanding time-series CV folds over complete training rows ordered by (datetime, location)."""
    tr, _, _ = cm.train_features(spark, sf_dir)
    cc = splits.complete_cases(splits.add_target(tr)).select("location", "datetime")
    return splits.fold_table(cc, 5)


@query("t10_last_valid_history",
       WITH_PANELS + "\nSELECT " + BASE_OUT + " FROM (SELECT *, row_number() OVER "
       "(PARTITION BY location ORDER BY datetime DESC) AS _k FROM test WHERE pm25 IS NOT NULL) WHERE _k <= 12")
def t10_last_valid_history(spark, sf_dir):
    return splits.last_valid_history(cm.prepared(spark, sf_dir).test, 12)


# ------------------------------------------------------------------ F01-F18 --
def _fq(cols_: list[str], src: str = "ftrain") -> str:
    return (WITH_FEATS + "\nSELECT location, datetime, " +
            sp.out(cols_, ints=sp.INT_FEATURES) + f" FROM {src}")


_F = {
    "f01_lags": ["pm25_lag1", "pm25_lag3", "pm25_lag6", "pm25_lag24"],
    "f02_rolling_means": ["pm25_roll6", "pm25_roll24"],
    "f03_trend": ["pm25_trend_3h"],
    "f04_rolling_std": ["pm25_std_12h"],
    "f05_calendar": ["hour", "month"],
    "f06_cyclic": ["hour_sin", "hour_cos", "month_sin", "month_cos"],
    "f07_weekend": ["weekend_flag"],
    "f08_heating_season": ["heating_season_flag"],
    "f09_weather_deltas": ["temp_change_3h", "humidity_change_3h", "wind_change_3h"],
    "f10_stagnation_index": ["stagnation_index"],
    "f11_temp_wind": ["temp_wind_interaction"],
    "f12_mixing_index": ["mixing_index"],
    "f13_ventilation_index": ["ventilation_index"],
    "f14_stagnation_hours": ["stagnation_hours_6h"],
    "f16_spatial_apply": ["location_id", "lat_norm", "lon_norm"],
}


def _feature_query(name: str, cols_: list[str]):
    @query(name, _fq(cols_))
    def fn(spark, sf_dir):
        tr, _, _ = cm.train_features(spark, sf_dir)
        return tr.select("location", "datetime", *cols_)
    fn.__name__ = name
    return fn


for _name, _cols in _F.items():
    _feature_query(_name, _cols)


@query("f15_spatial_fit",
       WITH_FEATS + "\nSELECT m.location, CAST(m.location_id AS BIGINT) AS location_id, " +
       sp.r("fm.lat_mean", "lat_mean") + ", " + sp.r("fm.lon_mean", "lon_mean") +
       " FROM fit_map m, fit_means fm")
def f15_spatial_fit(spark, sf_dir):
    _, fit, _ = cm.train_features(spark, sf_dir)
    return fit.mapping.select("location", "location_id",
                              F.lit(fit.lat_mean).cast("double").alias("lat_mean"),
                              F.lit(fit.lon_mean).cast("double").alias("lon_mean"))


_ALL_F = [c for c in FEATURES if c not in POLLUTANTS + WEATHER_COLS]


@query("f17_build_features_train",
       WITH_FEATS + "\nSELECT " + sp.out(BASE_COLUMNS + _ALL_F, ints=sp.INT_FEATURES,
                                         keep={"location", "datetime"}) + " FROM ftrain")
def f17_build_features_train(spark, sf_dir):
    tr, _, _ = cm.train_features(spark, sf_dir)
    return tr.select(*BASE_COLUMNS, *_ALL_F)


@query("f17_build_features_test",
       WITH_FEATS + "\nSELECT " + sp.out(BASE_COLUMNS + _ALL_F, ints=sp.INT_FEATURES,
                                         keep={"location", "datetime"}) + " FROM ftest")
def f17_build_features_test(spark, sf_dir):
    _, te, _, _ = cm.test_features(spark, sf_dir)
    return te.select(*BASE_COLUMNS, *_ALL_F)


@query("f18_feature_check",
       WITH_FEATS + "\n" + "\nUNION ALL ".join(
           f"SELECT '{f}' AS feature, CAST(1 AS BIGINT) AS present, CAST(count({f}) AS BIGINT) AS non_null_rows "
           f"FROM ftrain" for f in FEATURES))
def f18_feature_check(spark, sf_dir):
    """Every FEATURES name exists in the train table, with its non-NULL row count."""
    tr, _, _ = cm.train_features(spark, sf_dir)
    missing = set(features.check_features(tr))
    present = [f for f in FEATURES if f not in missing]
    wide = tr.agg(*[F.count(F.col(f)).alias(f) for f in present])
    long = wide.unpivot([], present, "feature", "non_null_rows")
    return long.withColumn("present", F.lit(1))
