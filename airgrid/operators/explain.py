"""Explanations.

* X01 permutation importance: every repeat permutes the rows by a one-to-one map of
  their positions; rows and donors meet in one join per repeat and all
  (feature, repeat) permutations are scored in one scoring job.
* X02 global attribution: exact for linear models (coef x centred value, in
  columns) and for tree ensembles (path weights, one pass over the rows); for other
  models sampled Shapley values (Strumbelj & Kononenko,
  2014) as one job over row x permutation x background sample.
* X03 per-forecast drivers: filter, relabel, order by |value|, keep 5.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.operators import metrics
from airgrid.operators.forecast import LinearForecaster
from airgrid.schemas import FEATURES
from airgrid.session import cut_lineage, scratch_path

# ---- fixed values: display names and ignored features of the explanation ------
FEATURE_LABELS = {
    "pm25_lag1": "Recent PM", "pm25_lag3": "PM (3h ago)", "pm25_lag6": "PM (6h ago)",
    "pm25_lag24": "PM (24h ago)", "pm25_trend_3h": "Trend", "pm25_roll6": "Avg PM (6h)",
    "pm25_roll24": "Avg PM (24h)", "pm25_std_12h": "Variability",
    "temperature": "Temperature", "humidity": "Humidity", "wind_speed": "Wind", "precipitation": "Rain",
    "temp_change_3h": "Temp Change", "humidity_change_3h": "Humidity Change", "wind_change_3h": "Wind Change",
    "stagnation_index": "Air Stagnation", "mixing_index": "Mixing", "ventilation_index": "Ventilation",
    "temp_wind_interaction": "Temp × Wind Effect",
    "pm10": "PM10", "no2": "NO₂", "so2": "SO₂",
}
IGNORED = ["hour_sin", "hour_cos", "month", "month_sin", "month_cos", "weekend_flag",
           "location_id", "lat_norm", "lon_norm"]
TOP = 5
# ----------------------------------------------------------------------------------


def top_drivers(effects: Column, top: int = TOP, order: list[str] = FEATURES) -> Column:
    """Drop ignored features, relabel, sort by |value| desc (stable on feature
    order), keep ``top``, add direction (``up`` if value > 0 else ``down``)."""
    pos = F.create_map(*[x for i, f in enumerate(order) for x in (F.lit(f), F.lit(i))])
    labels = F.create_map(*[x for k, v in FEATURE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    kept = F.filter(effects, lambda e: ~e["feature"].isin(IGNORED))
    keyed = F.transform(kept, lambda e: F.struct(
        (-F.abs(e["value"])).alias("k1"), F.coalesce(pos[e["feature"]], F.lit(len(order))).alias("k2"),
        e["feature"].alias("feature"), e["value"].alias("value")))
    ranked = F.slice(F.array_sort(keyed), 1, top)
    return F.transform(ranked, lambda e: F.struct(
        F.coalesce(labels[e["feature"]], e["feature"]).alias("feature"),
        e["value"].alias("value"),
        F.when(e["value"] > 0, "up").otherwise("down").alias("direction")))


def linear_attributions(df: DataFrame, model: LinearForecaster, top: int | None = None) -> DataFrame:
    """X02 for linear models: mean |coef x (x - mean)| per feature (exact Shapley values)."""
    eff = model.attributions_expr()
    e = df.select(F.explode(eff).alias("e")).select("e.feature", F.abs("e.value").alias("a"))
    out = e.groupBy("feature").agg(F.avg("a").alias("importance"))
    return out.orderBy(F.desc("importance"), "feature").limit(top) if top else out


def tree_values(df: DataFrame, model, keys: list[str]) -> DataFrame:
    """``keys``, base and phi (array in the model's feature order): exact Shapley values of each row.

    ``base`` + sum of ``phi`` is the prediction on the fitted scale.  Rows are explained
    inside their Arrow batch; nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.trees)         # bounded by the size of the model

    def explain(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            phi, base = shared.value.attributions(_matrix(cols))
            yield pd.DataFrame({"base": np.full(len(phi), base), "phi": list(phi)})
    explain.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    out = F.pandas_udf(explain, "base double, phi array<double>")(*[F.col(f).cast("double") for f in model.features])
    return df.select(*keys, out.alias("_e")).select(*keys, "_e.base", "_e.phi")


def tree_attributions(df: DataFrame, model, top: int | None = None) -> DataFrame:
    """X02 for tree ensembles: mean |phi| per feature over every row, added up inside each batch."""
    shared = df.sparkSession.sparkContext.broadcast(model.trees)
    features = list(model.features)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            phi, _ = shared.value.attributions(f.to_numpy(dtype="float64", na_value=np.nan))
            yield pd.DataFrame({"feature": features, "total": np.abs(phi).sum(axis=0), "n": len(phi)})

    parts = df.select(*[F.col(f).cast("double") for f in features]).mapInPandas(add, "feature string, total double, n long")
    out = parts.groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("importance"))
    return out.orderBy(F.desc("importance"), "feature").limit(top) if top else out


def _matrix(cols) -> np.ndarray:
    return np.column_stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in cols])


_LOW = (1 << 33) - 1        # monotonically_increasing_id: row number in the lower bits


def _indexed(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows with positions 0..n-1 in ``_pos``, stored so that they never change, and n."""
    laid = cut_lineage(df.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))     # a row per partition
    skip = sizes.withColumn("_skip", F.coalesce(F.sum("_size").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = sizes.agg(F.sum("_size")).first()[0] or 0
    out = (laid.withColumn("_part", part).join(skip.select("_part", "_skip"), "_part")
           .withColumn("_pos", F.col("_skip") + F.col("_mid").bitwiseAND(F.lit(_LOW))))
    return out.drop("_part", "_skip", "_mid"), int(n)


def _shuffled(pos: Column, n: int, seed: int) -> Column:
    """A seeded one-to-one map of 0..n-1 onto itself (two affine steps modulo n)."""
    rng = random.Random(seed)
    for _ in range(2):
        a = rng.randrange(1, min(max(n, 2), 1 << 29))
        while math.gcd(a, n) != 1:
            a += 1
        pos = F.pmod(pos * F.lit(a) + F.lit(rng.randrange(0, max(n, 1))), F.lit(max(n, 1)))
    return pos


def shapley_values(rows: DataFrame, model, features: list[str] = FEATURES, background: DataFrame | None = None,
                   permutations: int = 8, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """keys, feature and phi: sampled Shapley values (log-space prediction) of each row.

    For every (row, permutation) one background row z is drawn from all of them;
    along the permutation, feature j switches from z to x and phi_j is the prediction
    change at that switch, averaged over permutations.  Rows are told apart by
    position, so equal rows do not mix.  Coalition k adds its score to the feature
    switched last and takes it from the one switched next, so one aggregate is
    enough.  ``keys`` name each row (default: its position).
    """
    x, _ = _indexed(rows.select(*(keys or []), *features))
    bg, nb = _indexed((background if background is not None else rows).select(*features))
    names = F.array(*[F.lit(f) for f in features])
    last = len(features) - 1
    perm = x.select("_pos", *(keys or []), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"),
                    F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_p"))
    perm = perm.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "_pos", "_p"), F.lit(max(nb, 1))))
    order = F.transform(F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda i: F.struct(F.xxhash64(F.lit(seed), "_pos", "_p", i).alias("h"), i.alias("i")))), lambda s: s["i"])
    z = bg.select(F.col("_pos").alias("_b"), F.array(*[F.col(f).cast("double") for f in features]).alias("_z"))
    pairs = perm.withColumn("_ord", order).join(z, "_b")
    co = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(last + 1))).alias("_k"))
    mixed = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.when(
        F.array_position("_ord", i) <= F.col("_k"), F.element_at("_x", i + 1)).otherwise(F.element_at("_z", i + 1)))
    path = scratch_path(rows.sparkSession, "coalitions")
    ids = ["_pos", *(keys or []), "_k", "_ord"]
    co.select(*ids, mixed.alias("_m")).write.parquet(path)
    co = rows.sparkSession.read.parquet(path).select(*ids, *[F.col("_m")[i].alias(f) for i, f in enumerate(features)])
    scored = model.transform(co).select(*ids, F.col("prediction").alias("_y"))
    moves = F.concat(
        F.when(F.col("_k") > 0, F.array(F.struct(F.try_element_at("_ord", F.greatest(F.col("_k"), F.lit(1))).alias("i"),
                                                 F.col("_y").alias("d"))))
        .otherwise(F.array().cast("array<struct<i:int,d:double>>")),
        F.when(F.col("_k") <= last, F.array(F.struct(F.try_element_at("_ord", F.least(F.col("_k"), F.lit(last)) + 1).alias("i"),
                                                     (-F.col("_y")).alias("d"))))
        .otherwise(F.array().cast("array<struct<i:int,d:double>>")))
    per = scored.select("_pos", *(keys or []), F.explode(moves).alias("m"))
    return (per.groupBy("_pos", *(keys or []), F.element_at(names, F.col("m.i") + 1).alias("feature"))
            .agg((F.sum("m.d") / permutations).alias("phi")))


def sampled_shapley(df: DataFrame, model, features: list[str] = FEATURES, background: DataFrame | None = None,
                    permutations: int = 8, seed: int = 42) -> DataFrame:
    """X02 for any model: mean |phi| per feature over every row of ``df``."""
    phi = shapley_values(df, model, features, background, permutations, seed)
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def permutation_importance(df: DataFrame, model, features: list[str] = FEATURES, repeats: int = 5,
                           seed: int = 42, target: str = "label") -> DataFrame:
    """Mean drop of R^2 (on the log target) when one feature is permuted.

    ``model.transform`` must add ``prediction``.  Each repeat has one permutation of
    all rows: a one-to-one map of row positions, so rows meet their donors in one
    join per repeat; the features are then swapped one at a time after the join.
    """
    base, n = _indexed(df.select(*features, target))
    donor = base.select(F.col("_pos").alias("_from"), F.struct(*features).alias("_d"))
    draws = F.array(*[F.struct(F.lit(r).alias("_r"), _shuffled(F.col("_pos"), n, seed + r).alias("_from")) for r in range(repeats)])
    rows = base.withColumn("_t", F.explode(draws)).select("*", "_t.*").drop("_t").join(donor, "_from")
    each = rows.withColumn("_f", F.explode(F.array(*[F.lit(f) for f in features])))
    swapped = each.select(target, "_f", "_r", *[F.when(F.col("_f") == f, F.col("_d")[f]).otherwise(F.col(f)).alias(f)
                                                for f in features])
    per = model.transform(swapped).groupBy("_f", "_r").agg(metrics.r2(target, "prediction").alias("r2"))
    ref = model.transform(df).agg(metrics.r2(target, "prediction").alias("r2")).first()["r2"]
    return per.groupBy(F.col("_f").alias("feature")).agg(
        (F.lit(ref) - F.avg("r2")).alias("importance"), F.stddev_samp("r2").alias("importance_std"))
