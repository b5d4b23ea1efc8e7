"""Forecasting and backtesting.

Recursive forecasting runs for every (station, origin) at once.  Each origin is
one row holding the state the recursion needs as arrays:

* ``pm``     the last 24 gap-filled pm25 values (as seen from the origin),
* ``wt/wh/ww`` temperature, humidity, wind for the last 3 rows and the 12 future hours,
* ``wf``     wind for the last 6 rows and the 12 future hours (low-wind flags),
* ``wp``     future precipitation,
* the static columns of the origin row (pm10, no2, so2, coordinates, station id).

A step derives the feature columns from the arrays, scores them with the model
(one ``transform`` over all origins), and appends the prediction to ``pm``.
The state is built with one window pass partitioned by station; the steps need
no shuffle at all.  Lineage is cut with reliable checkpoints every few steps.

Future weather is an as-of lookup (latest weather row at or before the target
hour) on the hourly weather table, which has no station key and is bounded by
the time span; it is computed once per distinct origin hour.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions.interp import _RN, interpolation_state
from airgrid.functions.recursion import LinearMember, TreeMember, make_scorer
from airgrid.schemas import (EXTREME, FEATURES, HEATING_MONTHS, HISTORY_HOURS, HORIZON, KEY, LOCAL_TZ, LOW_WIND,
                             POLLUTANTS, TIME, WEATHER_COLS)
from airgrid.session import cut_lineage

HISTORY = 24


# ------------------------------------------------------------------ P01 ------

def asof_weather(targets: DataFrame, weather: DataFrame, target_col: str = "target",
                 cols: list[str] = WEATHER_COLS) -> DataFrame:
    """Attach, for each target time, the latest weather row with time <= target.

    If no such row exists the last row of the weather table is used.  The weather
    becomes one row per hour of an hour grid: the rows inside the hour, one per
    instant in time order, and the last row before the hour.  The grid spans the
    weather and target range (bounded by time, never by the number of targets) and
    is joined on the hour; the row is then picked inside the joined row, so targets
    need no id and the result does not depend on how they are partitioned.
    """
    w = weather.select(F.col(TIME).alias("_wt"), *cols).where(F.col("_wt").isNotNull())
    packed = F.struct(F.col("_wt"), *[F.col(c) for c in cols])
    inside = (w.groupBy("_wt").agg(F.max(packed).alias("_r"))
              .groupBy(F.date_trunc("hour", "_wt").alias("_h")).agg(F.array_sort(F.collect_list("_r")).alias("_in")))
    # two tiny driver-side aggregates: the weather range with its last row, the target range
    wrow = w.agg(F.min(F.date_trunc("hour", "_wt")).alias("lo"), F.max(packed).alias("_r")).first()
    hi = targets.agg(F.max(F.date_trunc("hour", target_col)).alias("hi")).first()["hi"]
    lo, last = wrow["lo"], wrow["_r"]
    if lo is None or hi is None:
        return targets.withColumns({**{c: F.lit(None).cast("double") for c in cols},
                                    "weather_time": F.lit(None).cast("timestamp")})
    grid = targets.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(lo), F.lit(max(hi, lo)), F.expr("interval 1 hour"))).alias("_h"))
    grid = (grid.join(inside, "_h", "left")
            .withColumn("_before", F.last(F.try_element_at("_in", F.lit(-1)), ignorenulls=True).over(
                Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1))))
    t = F.col(target_col)
    joined = targets.withColumn("_h", F.date_trunc("hour", t)).join(grid, "_h", "left")
    lastlit = F.struct(F.lit(last["_wt"]).alias("_wt"), *[F.lit(last[c]).alias(c) for c in cols])
    r = F.coalesce(F.try_element_at(F.filter("_in", lambda x: x["_wt"] <= t), F.lit(-1)), F.col("_before"), lastlit)
    return (joined.withColumn("_r", r)
            .select(*[F.col(c) for c in targets.columns], *[F.col("_r")[c].alias(c) for c in cols],
                    F.col("_r")["_wt"].alias("weather_time")))


# ------------------------------------------------------------------ models ---

class Forecaster:
    """Scores a frame that carries the FEATURES columns; adds ``_pred`` (pm25 scale)."""

    def predict(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def attributions(self, df: DataFrame) -> Column | None:
        """Optional per-row array<struct<feature,value>> of additive contributions."""
        return None


@dataclass
class LinearForecaster(Forecaster):
    """``max(0, intercept + sum coef * coalesce(x, fill))``; exact additive attributions.

    With ``log_target`` the linear part is in ``log1p`` space and is mapped back
    with ``max(0, expm1(.))``.
    """
    coefs: dict[str, float]
    intercept: float = 0.0
    fills: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    log_target: bool = False

    def _x(self, f: str, feats: dict[str, Column] | None = None) -> Column:
        c = feats[f] if feats is not None else F.col(f)
        return F.coalesce(c.cast("double"), F.lit(float(self.fills.get(f, 0.0))))

    def raw(self, feats: dict[str, Column] | None = None) -> Column:
        out = F.lit(float(self.intercept))
        for f, c in self.coefs.items():
            out = out + F.lit(float(c)) * self._x(f, feats)
        return out

    def predict_expr(self, feats: dict[str, Column] | None = None) -> Column:
        raw = self.raw(feats)
        return F.greatest(F.lit(0.0), F.expm1(raw) if self.log_target else raw)

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_pred", self.predict_expr())

    def attributions_expr(self, feats: dict[str, Column] | None = None) -> Column:
        return F.array(*[F.struct(F.lit(f).alias("feature"),
                                  (F.lit(float(c)) * (self._x(f, feats) - F.lit(float(self.means.get(f, 0.0)))))
                                  .alias("value"))
                         for f, c in self.coefs.items()])

    def attributions(self, df: DataFrame | None = None) -> Column:
        return self.attributions_expr()


    @property
    def members(self) -> list:
        return [LinearMember(self.coefs, self.intercept, self.fills, self.means)]

    @property
    def effect_names(self) -> list[str]:
        return list(self.coefs)


@dataclass
class EnsembleForecaster(Forecaster):
    """Mean of back-transformed members (M01, M09, P05): linear models and flat trees, in any mix.

    The members travel as arrays and are scored inside the recursion; effects are exact
    Shapley values (closed form or path weights), averaged over members.
    """
    parts: list                      # LinearForecaster or FlatTrees over FEATURES
    log_target: bool = True

    @property
    def members(self) -> list:
        return [m for p in self.parts for m in (p.members if isinstance(p, LinearForecaster) else [TreeMember(p, FEATURES)])]

    @property
    def effect_names(self) -> list[str]:
        return FEATURES


# The fixed persistence blend used as the SQL-checkable forecaster of the catalog.
BLEND = LinearForecaster(coefs={"pm25_lag1": 0.5, "pm25_roll6": 0.3, "pm25_roll24": 0.2,
                                "wind_change_3h": -0.1, "stagnation_hours_6h": 0.5,
                                "temperature": 0.05, "humidity": -0.02, "hour_sin": 1.0})


@dataclass
class MLForecaster(Forecaster):
    """Mean of back-transformed Spark ML members trained on ``log1p`` target."""
    members: list            # fitted PipelineModels with a "prediction" output
    log_target: bool = True

    def predict(self, df: DataFrame) -> DataFrame:
        out = df
        cols = []
        for i, m in enumerate(self.members):
            scored = m.transform(out)
            p = F.col("prediction")
            val = F.greatest(F.lit(0.0), F.expm1(p) if self.log_target else p)
            keep = [c for c in out.columns]
            out = scored.select(*keep, val.alias(f"_m{i}"))
            cols.append(F.col(f"_m{i}"))
        mean = cols[0]
        for c in cols[1:]:
            mean = mean + c
        return out.withColumn("_pred", mean / len(cols)).drop(*[f"_m{i}" for i in range(len(cols))])


# ------------------------------------------------------------------ state ----

def _pad_left(arr: Column, n: int) -> Column:
    """Left-pad an array with NULLs to length ``n`` (rows before the series start)."""
    pad = F.array_repeat(F.lit(None).cast("double"), F.greatest(F.lit(0), F.lit(n) - F.size(arr)))
    return F.concat(pad, arr)


def _view(arr_col: Column, origin_rn: Column, limit: int = 3) -> Column:
    """Prefix-only value of each collected row as seen from ``origin_rn`` (§ gap filling)."""
    return F.transform(arr_col, lambda s: F.when(
        s["x"].isNotNull() | (s["ni"] <= origin_rn), s["f"]).when(
        s["pi"].isNotNull() & ((s["rn"] - s["pi"]) <= limit), s["px"]))


def _packed(c: str, rn: str) -> Column:
    return F.struct(F.col(rn).alias("rn"), F.col(c).alias("x"), F.col(f"{c}_pi").alias("pi"),
                    F.col(f"{c}_px").alias("px"), F.col(f"{c}_ni").alias("ni"),
                    F.col(f"{c}_filled").alias("f"))


def origin_state(base: DataFrame, weather_hours: DataFrame | None = None,
                 history: int = HISTORY, last_rows: int | None = None,
                 truth: int | None = None) -> DataFrame:
    """Per (station, row): prefix-only gap-filled state arrays ending at that row.

    ``base`` is the un-filled hourly panel.  Weather is filled on the distinct
    hours of the panel (C10 rule) and viewed from each origin's hour.
    """
    w = Window.partitionBy(KEY).orderBy(TIME)
    df = interpolation_state(base, ["pm25", "pm10", "no2", "so2"], KEY, TIME).withColumnRenamed(_RN, "_rn")
    # weather state on the one-row-per-hour table (bounded by the time span)
    hours = (weather_hours if weather_hours is not None else
             base.groupBy(TIME).agg(*[F.first(c, ignorenulls=True).alias(c) for c in WEATHER_COLS]))
    hours = (interpolation_state(hours, ["temperature", "humidity", "wind_speed"], None, TIME)
             .withColumnRenamed(_RN, "_wrn"))
    wsel = [TIME, "_wrn"] + [f"{c}{s}" for c in ["temperature", "humidity", "wind_speed"]
                             for s in ["", "_pi", "_px", "_ni", "_filled"]]
    df = df.drop(*WEATHER_COLS).join(hours.select(*wsel), TIME, "left")
    if last_rows:
        top = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
        df = df.withColumn("_k", F.row_number().over(top)).where(F.col("_k") <= last_rows).drop("_k")
    rn, wrn = F.col("_rn"), F.col("_wrn")
    w24 = w.rowsBetween(-(history - 1), 0)
    w3 = w.rowsBetween(-2, 0)
    w6 = w.rowsBetween(-5, 0)
    last = {}
    for c in ["pm10", "no2", "so2"]:
        # prefix view of the origin row itself: value, or a trailing-gap repeat
        last[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(
            F.col(f"{c}_pi").isNotNull() & ((rn - F.col(f"{c}_pi")) <= 3), F.col(f"{c}_px"))
    state = df.select(
        KEY, TIME, "_rn", "latitude", "longitude",
        _pad_left(_view(F.collect_list(_packed("pm25", "_rn")).over(w24), rn), history).alias("pm"),
        _pad_left(_view(F.collect_list(_packed("temperature", "_wrn")).over(w3), wrn), 3).alias("_t3"),
        _pad_left(_view(F.collect_list(_packed("humidity", "_wrn")).over(w3), wrn), 3).alias("_h3"),
        _pad_left(_view(F.collect_list(_packed("wind_speed", "_wrn")).over(w6), wrn), 6).alias("_w6"),
        *[v.alias(c) for c, v in last.items()],
        *([F.array(*[F.lead("pm25", h).over(w) for h in range(1, truth + 1)]).alias("_truth"),
           F.count(F.lit(1)).over(Window.partitionBy(KEY)).alias("_n")] if truth else []),
    )
    return state


def future_weather(origins: DataFrame, weather: DataFrame, horizon: int = HORIZON, rule: str = "asof") -> DataFrame:
    """Per distinct origin time: arrays of the as-of weather for the next ``horizon`` hours.

    ``rule="last_row"`` gives every hour the table's last row: what is left of the as-of
    rule when the forecast table begins after all target hours.
    """
    if rule not in ("asof", "last_row"):
        raise ValueError("rule must be asof or last_row")
    if rule == "last_row":
        weather = weather.orderBy(F.col(TIME).desc()).limit(1)
    o = origins.select(TIME).distinct()
    t = o.select(TIME, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_s"))
    t = t.withColumn("target", F.col(TIME) + F.make_dt_interval(F.lit(0), F.col("_s")))
    aw = asof_weather(t, weather, "target")
    packed = F.struct("_s", *WEATHER_COLS)
    g = aw.groupBy(TIME).agg(F.array_sort(F.collect_list(packed)).alias("_f"))
    return g.select(TIME, *[F.transform("_f", _field(c)).alias(f"_f_{c}") for c in WEATHER_COLS])


def _field(name: str):
    return lambda s: s[name]


def assemble_state(state: DataFrame, fut: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Join future weather to the origin state; arrays of prefix + future values.

    ``fut`` has one row per distinct origin hour (bounded by the time span), so
    the join is a broadcast join when small and a shuffle join otherwise (AQE).
    """
    j = state.join(fut, TIME, "left")
    return j.select(*(keep or []),
        KEY, F.col(TIME).alias("origin"), F.col("_rn").alias("origin_rn"),
        "latitude", "longitude", "pm10", "no2", "so2", "pm",
        F.concat("_t3", "_f_temperature").alias("wt"),
        F.concat("_h3", "_f_humidity").alias("wh"),
        F.concat(F.slice("_w6", 4, 3), "_f_wind_speed").alias("ww"),
        F.concat("_w6", "_f_wind_speed").alias("wf"),
        F.col("_f_precipitation").alias("wp"),
    )


# ------------------------------------------------------------------ P02/P03 --

def _mean_full(arr: Column, n: int) -> Column:
    sl = F.slice(arr, -n, n)
    nn = F.size(F.filter(sl, lambda x: x.isNotNull()))
    tot = F.aggregate(sl, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return F.when((F.size(sl) == n) & (nn == n), tot / n)


def _std_full(arr: Column, n: int) -> Column:
    sl = F.slice(arr, -n, n)
    nn = F.size(F.filter(sl, lambda x: x.isNotNull()))
    mean = F.aggregate(sl, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))) / n
    ss = F.aggregate(sl, F.lit(0.0), lambda acc, x: acc + F.pow(F.coalesce(x, F.lit(0.0)) - mean, 2))
    return F.when((F.size(sl) == n) & (nn == n), F.sqrt(ss / (n - 1)))


def step_features(s, pm: Column, spatial: dict[str, Column]) -> dict[str, Column]:
    """Feature columns of the future row at step ``s`` (1-based int or Column) from the state."""
    s = F.lit(s) if isinstance(s, int) else s
    ts = F.col("origin") + F.make_dt_interval(F.lit(0), s)
    hour, month = F.hour(ts), F.month(ts)
    t_now = F.element_at("wt", s + 3)
    h_now = F.element_at("wh", s + 3)
    v_now = F.element_at("ww", s + 3)
    lows = F.transform(F.slice("wf", s, F.lit(6)),
                       lambda v: F.coalesce(v < LOW_WIND, F.lit(False)).cast("int"))
    stag = F.when(F.col("origin_rn") + s - 6 >= 1,
                  F.aggregate(lows, F.lit(0), lambda a, x: a + x).cast("double"))
    lag = {k: F.element_at(pm, -k) for k in (1, 3, 6, 24)}
    out = {
        "datetime": ts,
        "pm10": F.col("pm10"), "no2": F.col("no2"), "so2": F.col("so2"),
        "pm25_lag1": lag[1], "pm25_lag3": lag[3], "pm25_lag6": lag[6], "pm25_lag24": lag[24],
        "pm25_roll6": _mean_full(pm, 6), "pm25_roll24": _mean_full(pm, 24),
        # the future row carries a copy of the previous value as its own pm25
        "pm25_trend_3h": lag[1] - lag[3],
        "pm25_std_12h": _std_full(pm, 12),
        "hour": hour, "hour_sin": F.sin(2 * math.pi * hour / 24), "hour_cos": F.cos(2 * math.pi * hour / 24),
        "month": month, "month_sin": F.sin(2 * math.pi * month / 12),
        "month_cos": F.cos(2 * math.pi * month / 12),
        "weekend_flag": (F.weekday(ts) >= 5).cast("int"),
        "heating_season_flag": month.isin(HEATING_MONTHS).cast("int"),
        "temperature": t_now, "humidity": h_now, "wind_speed": v_now,
        "precipitation": F.element_at("wp", s),
        "temp_change_3h": t_now - F.element_at("wt", s),
        "humidity_change_3h": h_now - F.element_at("wh", s),
        "wind_change_3h": v_now - F.element_at("ww", s),
        "stagnation_index": h_now / (v_now + 0.5),
        "temp_wind_interaction": t_now * v_now,
        "mixing_index": (t_now + 273.15) * (v_now + 1.0) / (h_now + 20.0),
        "ventilation_index": v_now * (t_now + 273.15),
        "stagnation_hours_6h": stag,
    }
    out.update(spatial)
    return out


_EFF_T = "array<struct<feature:string,value:double>>"
_REC_T = ("struct<horizon:int,datetime:timestamp,pm25_pred:double,"
          f"missing_features:array<string>,effects:{_EFF_T}>")


def _spatial(state: DataFrame, fit) -> tuple[DataFrame, dict[str, Column]]:
    if fit is not None:
        df = state.join(fit.mapping, KEY, "left")
        return df, {"location_id": F.coalesce(F.col("location_id"), F.lit(-1)).cast("int"),
                    "lat_norm": F.col("latitude") - F.lit(fit.lat_mean).cast("double"),
                    "lon_norm": F.col("longitude") - F.lit(fit.lon_mean).cast("double")}
    df = state.withColumn("location_id", F.lit(-1))
    return df, {"location_id": F.lit(-1), "lat_norm": F.lit(None).cast("double"),
                "lon_norm": F.lit(None).cast("double")}


def _missing(feats: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(feats[f].isNull(), F.lit(f)) for f in FEATURES]),
                    lambda v: v.isNotNull())


def _finish(out: DataFrame) -> DataFrame:
    return _diagnostics(out.select(KEY, "origin", F.explode("_out").alias("r")).select(KEY, "origin", "r.*"))


_FC_SCHEMA = ("location string, origin timestamp, horizon int, datetime timestamp, pm25_pred double, "
              "missing_flags array<boolean>, effect_values array<double>")
_BT_SCHEMA = ("location string, origin timestamp, horizon int, datetime timestamp, pm25_pred double, "
              "y_true double")
_STATE_COLS = ["location", "origin", "origin_rn", "pm10", "no2", "so2", "pm", "wt", "wh", "ww", "wf", "wp",
               "location_id", "lat_norm", "lon_norm"]


def recursive_forecast(state: DataFrame, model: Forecaster, fit=None, horizon: int = HORIZON,
                       explain: bool = False, truth: str | None = None) -> DataFrame:
    """P02 + P03 (+P04, X03 when ``explain``): ``horizon`` recursive steps for all origins.

    Linear models, flat trees and their ensembles: the recursion runs vectorised over
    Arrow batches in ``mapInPandas`` (per partition, no shuffle, no plan growth, no
    checkpoint).  Any other model with a ``transform``: one ``transform`` per step over
    all origins, with a reliable checkpoint after each step; ``explain`` adds the
    Shapley values of every member, sampled over the rows of all steps and averaged
    over members.  With ``truth`` (an array column of the next ``horizon`` actual
    values) the output carries ``y_true`` instead of the diagnostics (backtests).
    Otherwise the output has location, origin, horizon, datetime, pm25_pred,
    missing_features, effects, missing_ratio, is_extreme.
    """
    df, spatial = _spatial(state, fit)
    df = df.withColumns(spatial)
    if isinstance(model, (LinearForecaster, EnsembleForecaster)):
        mode, effects = "backtest" if truth else "forecast", model.effect_names if explain and not truth else None
        members = df.sparkSession.sparkContext.broadcast(model.members)       # bounded by the size of the models
        fn = make_scorer(members, model.log_target, horizon, FEATURES, mode, effects)
        cols = _STATE_COLS + ([F.col(truth).alias("_truth")] if truth else [])
        out = df.select(*cols).mapInPandas(fn, _BT_SCHEMA if truth else _FC_SCHEMA)
        return out if truth else _diagnostics(_named(out, effects or []))

    wanted = explain and not truth
    seen = []
    keep = [c for c in df.columns if c != "pm"]
    df = df.withColumn("_out", F.array().cast(f"array<{_REC_T}>"))
    for s in range(1, horizon + 1):
        feats = step_features(s, F.col("pm"), spatial)
        x = df.withColumns(feats)
        scored = model.predict(x)
        rec = F.struct(F.lit(s).alias("horizon"), F.col("datetime"), F.col("_pred").alias("pm25_pred"),
                       _missing({f: F.col(f) for f in FEATURES}).alias("missing_features"),
                       F.array().cast(_EFF_T).alias("effects")).cast(_REC_T)
        inputs = F.struct(*[F.col(f).cast("double").alias(f) for f in FEATURES])
        df = cut_lineage(scored.select(*keep, F.concat("pm", F.array(F.col("_pred"))).alias("pm"),
                                       F.concat("_out", F.array(rec)).alias("_out"),
                                       *([inputs.alias("_x")] if wanted else [])))
        if wanted:
            seen.append(df.select(KEY, F.col("origin").alias("_origin"), F.lit(s).alias("_step"), "_x.*"))
            df = df.drop("_x")
    if truth:
        z = df.select(KEY, "origin", F.explode(F.arrays_zip(F.col("_out").alias("r"),
                                                            F.col(truth).alias("t"))).alias("z"))
        return z.select(KEY, "origin", "z.r.horizon", "z.r.datetime", "z.r.pm25_pred",
                        F.col("z.t").alias("y_true"))
    out = _finish(df)
    return _with_effects(out, seen, model) if wanted else out


def _with_effects(out: DataFrame, seen: list[DataFrame], model: "MLForecaster") -> DataFrame:
    """Replace the empty ``effects`` by each member's sampled Shapley values, averaged over members."""
    from functools import reduce

    from airgrid.operators.explain import shapley_values
    rows = reduce(DataFrame.unionByName, seen)
    parts = [shapley_values(rows, m, FEATURES, keys=[KEY, "_origin", "_step"]) for m in model.members]
    both = reduce(DataFrame.unionByName, parts).groupBy(KEY, "_origin", "_step", "feature").agg(
        (F.sum("phi") / len(parts)).alias("value"))
    eff = both.groupBy(KEY, "_origin", "_step").agg(
        F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("_eff"))
    same = (out[KEY] == eff[KEY]) & (out["origin"] == eff["_origin"]) & (out["horizon"] == eff["_step"])
    cols = [F.coalesce(F.col("_eff"), out["effects"]).alias("effects") if c == "effects" else out[c] for c in out.columns]
    return out.join(eff, same, "left").select(*cols)


def _named(out: DataFrame, effects: list[str]) -> DataFrame:
    """Names of the missing features and (feature, value) effects from the flag and value arrays."""
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    flagged = F.filter(F.arrays_zip(names(FEATURES).alias("f"), F.col("missing_flags").alias("m")), lambda z: z["m"])
    eff = (F.arrays_zip(names(effects).alias("feature"), F.col("effect_values").alias("value")).cast(_EFF_T)
           if effects else F.array().cast(_EFF_T))
    return out.select(KEY, "origin", "horizon", "datetime", "pm25_pred",
                      F.transform(flagged, lambda z: z["f"]).alias("missing_features"), eff.alias("effects"))


def _diagnostics(out: DataFrame) -> DataFrame:
    return out.withColumns({
        "missing_ratio": F.size("missing_features") / F.lit(float(len(FEATURES))),
        "is_extreme": (F.col("pm25_pred") > EXTREME).cast("int"),
    })


# ------------------------------------------------------------------ P06/P07 --

def local_time(df: DataFrame, col: str = TIME, tz: str = LOCAL_TZ, name: str = "datetime_local") -> DataFrame:
    """Wall-clock time in ``tz`` (DST-aware)."""
    return df.withColumn(name, F.from_utc_timestamp(F.col(col), tz))


def plot_frame(history: DataFrame, forecast: DataFrame, n: int = 12) -> DataFrame:
    """Last ``n`` actuals, the join point (last actual) and the forecast, per station."""
    w = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
    h = (history.where(F.col("pm25").isNotNull()).withColumn("_k", F.row_number().over(w))
         .where(F.col("_k") <= n))
    recent = h.select(KEY, TIME, F.col("pm25").alias("value"), F.lit("recent").alias("kind"))
    start = h.where(F.col("_k") == 1).select(KEY, TIME, F.col("pm25").alias("value"),
                                             F.lit("forecast").alias("kind"))
    fc = forecast.select(KEY, TIME, F.col("pm25_pred").alias("value"), F.lit("forecast").alias("kind"))
    return recent.unionByName(start).unionByName(fc)


# ------------------------------------------------------------------ P08-P10 --

def latest_origins(state: DataFrame) -> DataFrame:
    """The last row of each station (forecast from now)."""
    w = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
    return state.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def recent_rows(base: DataFrame, hours: int = HISTORY_HOURS) -> DataFrame:
    """The last ``hours`` hours of each station's panel."""
    ends = base.groupBy(F.col(KEY).alias("_key")).agg(F.max(TIME).alias("_end"))
    return (base.join(ends, F.col(KEY) == F.col("_key"))
            .where(F.col(TIME) > F.col("_end") - F.make_dt_interval(F.lit(0), F.lit(hours))).select(*base.columns))


def forecast_latest(base: DataFrame, weather: DataFrame, model: Forecaster, fit=None,
                    horizon: int = HORIZON, explain: bool = False, history_hours: int | None = HISTORY_HOURS) -> DataFrame:
    """P03/P09 core: forecast ``horizon`` hours from each station's last row.

    The state needs the last ``HISTORY`` rows and the gap filling three rows more,
    so only the last ``history_hours`` of each station are read (None: all).
    """
    recent = recent_rows(base, history_hours) if history_hours else base
    st = cut_lineage(latest_origins(origin_state(recent, last_rows=HISTORY)))
    full = assemble_state(st, future_weather(st, weather, horizon))
    return recursive_forecast(full, model, fit, horizon, explain=explain)


def backtest(base: DataFrame, weather: DataFrame, model: Forecaster, fit=None,
             lag_hours: int = 48, horizon: int = HORIZON, weather_rule: str = "asof") -> DataFrame:
    """Walk-forward over every origin with ``lag_hours`` history and ``horizon`` truth rows.

    Origin rows are the ``lag_hours``-th through the ``(n - horizon - 1)``-th row of a
    station; the state of an origin sees rows up to it only (prefix gap filling);
    truth is the un-filled pm25 of the next ``horizon`` rows, taken in the same
    window pass as the state (no join).
    """
    st = origin_state(base, truth=horizon)
    st = st.where((F.col("_rn") >= lag_hours) & (F.col("_rn") <= F.col("_n") - horizon - 1))
    st = cut_lineage(st)
    full = assemble_state(st, future_weather(st, weather, horizon, weather_rule), keep=["_truth"])
    fc = recursive_forecast(full, model, fit, horizon, truth="_truth")
    return fc.select(KEY, F.col("origin").alias("forecast_origin"), "horizon", "y_true",
                     F.col("pm25_pred").alias("y_pred"))


def serving_history(base: DataFrame, weather: DataFrame) -> DataFrame:
    """P10: gap-filled base + weather code (left join on time), NULL pm25 rows kept (Q10 fix)."""
    from airgrid.operators.clean import interpolate_station
    codes = weather.select(TIME, "weather_code").groupBy(TIME).agg(F.max("weather_code").alias("weather_code"))
    return interpolate_station(base).join(codes, TIME, "left")


__all__ = ["asof_weather", "LinearForecaster", "EnsembleForecaster", "MLForecaster", "BLEND", "origin_state",
           "future_weather", "assemble_state", "recursive_forecast", "forecast_latest",
           "backtest", "local_time", "plot_frame", "serving_history", "POLLUTANTS"]
