"""Vectorised recursive scoring of linear and tree forecasters inside ``mapInPandas``.

Each Arrow batch holds many (station, origin) states; the 12 recursive steps
run as numpy column operations over the whole batch (no per-row Python).  Sums
over windows are taken left to right, the same order as the SQL definition, so
results are bit-for-bit reproducible.  Missing values are NaN here and NULL in
Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd

from airgrid.functions.treekit import FlatTrees
from airgrid.schemas import HEATING_MONTHS, LOW_WIND


def _seq_sum(cols: list[np.ndarray]) -> np.ndarray:
    acc = np.zeros_like(cols[0])
    for c in cols:
        acc = acc + c
    return acc


def _mean_last(pm: list[np.ndarray], n: int) -> np.ndarray:
    return _seq_sum(pm[-n:]) / n              # NaN if any value is missing


def _std_last(pm: list[np.ndarray], n: int) -> np.ndarray:
    cols = pm[-n:]
    mean = _seq_sum(cols) / n
    ss = _seq_sum([(c - mean) * (c - mean) for c in cols])
    return np.sqrt(ss / (n - 1))


def _stack(series: pd.Series, width: int) -> np.ndarray:
    """(rows, width) float matrix of an array column, left-padded with NaN."""
    vals = series.to_numpy()
    try:
        m = np.stack(vals).astype("float64")          # fast path: equal lengths, no NULL arrays
        if m.ndim == 2 and m.shape[1] == width:
            return m
    except (ValueError, TypeError):
        pass
    out = np.full((len(vals), width), np.nan)
    for i, v in enumerate(vals):
        if v is not None:
            a = np.asarray(v, dtype="float64")
            out[i, width - len(a):] = a
    return out


def step_features(s: int, pm: list[np.ndarray], b: dict) -> dict[str, np.ndarray]:
    """All model features of the future row at step ``s`` (1-based)."""
    ts = b["origin"] + pd.Timedelta(hours=s)
    hour = ts.dt.hour.to_numpy().astype("float64")
    month = ts.dt.month.to_numpy().astype("float64")
    wd = ts.dt.weekday.to_numpy()
    t, h, v = b["wt"][:, s + 2], b["wh"][:, s + 2], b["ww"][:, s + 2]
    flags = [np.where(np.isnan(c), 0, (c < LOW_WIND).astype("int64")) for c in b["wf"][:, s - 1:s + 5].T]
    stag = np.where(b["origin_rn"] + s - 6 >= 1, _seq_sum(flags).astype("float64"), np.nan)
    return {
        "pm10": b["pm10"], "no2": b["no2"], "so2": b["so2"],
        "pm25_lag1": pm[-1], "pm25_lag3": pm[-3], "pm25_lag6": pm[-6], "pm25_lag24": pm[-24],
        "pm25_roll6": _mean_last(pm, 6), "pm25_roll24": _mean_last(pm, 24),
        "pm25_trend_3h": pm[-1] - pm[-3],          # the future row copies the previous value
        "pm25_std_12h": _std_last(pm, 12),
        "hour": hour, "hour_sin": np.sin(2 * math.pi * hour / 24), "hour_cos": np.cos(2 * math.pi * hour / 24),
        "month": month, "month_sin": np.sin(2 * math.pi * month / 12),
        "month_cos": np.cos(2 * math.pi * month / 12),
        "weekend_flag": (wd >= 5).astype("float64"),
        "heating_season_flag": np.isin(month, HEATING_MONTHS).astype("float64"),
        "temperature": t, "humidity": h, "wind_speed": v, "precipitation": b["wp"][:, s - 1],
        "temp_change_3h": t - b["wt"][:, s - 1], "humidity_change_3h": h - b["wh"][:, s - 1],
        "wind_change_3h": v - b["ww"][:, s - 1],
        "stagnation_index": h / (v + 0.5), "temp_wind_interaction": t * v,
        "mixing_index": (t + 273.15) * (v + 1.0) / (h + 20.0), "ventilation_index": v * (t + 273.15),
        "stagnation_hours_6h": stag,
        "location_id": b["location_id"], "lat_norm": b["lat_norm"], "lon_norm": b["lon_norm"],
    }


@dataclass
class LinearMember:
    """intercept + sum coef * x, with fills for missing values and means that centre the effects."""
    coefs: dict[str, float]
    intercept: float
    fills: dict[str, float]
    means: dict[str, float]

    def score(self, x: dict[str, np.ndarray], n: int, features: list[str] | None) -> tuple[np.ndarray, np.ndarray | None]:
        raw, effects = np.full(n, float(self.intercept)), {}
        for f, c in self.coefs.items():
            filled = np.where(np.isnan(x[f]), float(self.fills.get(f, 0.0)), x[f])
            raw = raw + float(c) * filled
            if features is not None:
                effects[f] = float(c) * (filled - float(self.means.get(f, 0.0)))
        if features is None:
            return raw, None
        return raw, np.column_stack([effects.get(f, np.zeros(n)) for f in features])


@dataclass
class TreeMember:
    """Flat trees over ``columns``; effects are exact Shapley values."""
    trees: FlatTrees
    columns: list[str]

    def score(self, x: dict[str, np.ndarray], n: int, features: list[str] | None) -> tuple[np.ndarray, np.ndarray | None]:
        m = np.column_stack([np.asarray(x[f], dtype="float64") for f in self.columns])
        raw = self.trees.predict(m)
        if features is None:
            return raw, None
        phi, _ = self.trees.attributions(m)
        place = {f: j for j, f in enumerate(self.columns)}
        return raw, np.column_stack([phi[:, place[f]] if f in place else np.zeros(n) for f in features])


def make_scorer(members, log_target: bool, horizon: int, features: list[str], mode: str,
                effects: list[str] | None = None, history: int = 24):
    """Returns the ``mapInPandas`` function. ``mode``: "forecast" or "backtest".

    ``members``: broadcast list of LinearMember and TreeMember; a step's prediction is
    the mean of their predictions on the original scale, its effects (of the features
    ``effects``, None: no effects) the mean of theirs on the fitted scale.
    """
    def score(batches):
        models = members.value
        for pdf in batches:
            if pdf.empty:
                continue
            n = len(pdf)
            b = {"origin": pd.to_datetime(pdf["origin"]).reset_index(drop=True),
                 "origin_rn": pdf["origin_rn"].to_numpy(dtype="float64")}
            for c in ("pm10", "no2", "so2", "location_id", "lat_norm", "lon_norm"):
                b[c] = pdf[c].to_numpy(dtype="float64", na_value=np.nan)
            for c, w in (("wt", 3 + horizon), ("wh", 3 + horizon), ("ww", 3 + horizon),
                         ("wf", 6 + horizon), ("wp", horizon)):
                b[c] = _stack(pdf[c], w)
            pmat = _stack(pdf["pm"], history)
            pm = [pmat[:, j] for j in range(history)]
            out = {"horizon": [], "datetime": [], "pm25_pred": [], "miss": [], "eff": []}
            for s in range(1, horizon + 1):
                x = step_features(s, pm, b)
                scored = [m.score(x, n, effects) for m in models]
                each = [np.maximum(0.0, np.expm1(raw) if log_target else raw) for raw, _ in scored]
                pred = _seq_sum(each) / len(each)
                pm.append(pred)
                out["horizon"].append(np.full(n, s, dtype="int32"))
                out["datetime"].append((b["origin"] + pd.Timedelta(hours=s)).to_numpy())
                out["pm25_pred"].append(pred)
                if mode == "forecast":
                    out["miss"].append(np.column_stack([np.isnan(np.asarray(x[f], dtype="float64")) for f in features]))
                    out["eff"].append(_seq_sum([e for _, e in scored]) / len(scored) if effects else np.empty((n, 0)))
            # rows ordered (origin, horizon)
            order = np.arange(n * horizon).reshape(horizon, n).T.ravel()
            res = pd.DataFrame({
                "location": np.repeat(pdf["location"].to_numpy(), horizon),
                "origin": np.repeat(b["origin"].to_numpy(), horizon),
                "horizon": np.concatenate(out["horizon"])[order],
                "datetime": np.concatenate(out["datetime"])[order],
                "pm25_pred": np.concatenate(out["pm25_pred"])[order],
            })
            if mode == "forecast":
                # flags and values as arrays; Spark SQL turns them into names and structs
                res["missing_flags"] = list(np.concatenate(out["miss"])[order])
                res["effect_values"] = list(np.concatenate(out["eff"])[order])
            else:
                truth = _stack(pdf["_truth"], horizon)
                res["y_true"] = truth.ravel()
            yield res
    return score
