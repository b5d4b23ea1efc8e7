"""Catalog: models, explanations and structure analysis (M, X, T09, E17, E18, P05, V11).

Model fits have no SQL equivalent; these entries are rows-only checks and fit the
reference's presets as they are (``models.PRESETS``: 715 trees of depth 16, 309, 723
and 615 boosting rounds).  One session fits each preset once per input folder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import functions as F

from airgrid.catalog import common as cm
from airgrid.catalog import sql_parts as sp
from airgrid.catalog.registry import query
from airgrid.operators import explain, explore, metrics, models, splits
from airgrid.operators import forecast as fc
from airgrid.operators.clean import dedup_weather
from airgrid.schemas import FEATURES, TARGET

HZ = range(1, 13)
_MEMO: dict = {}


def _memo(spark, sf_dir, name, make):
    """Fitted models are reused by the catalog entries of one session (same data, same presets)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def _complete(spark, sf_dir):
    def make():
        tr, te, fit, _ = cm.test_features(spark, sf_dir)
        train = splits.complete_cases(splits.add_target(tr)).cache()
        test = splits.complete_cases(splits.add_target(te)).cache()
        return train, test, fit
    return _memo(spark, sf_dir, "complete", make)


def _fit(spark, sf_dir, name):
    train, test, fit = _complete(spark, sf_dir)
    m = _memo(spark, sf_dir, f"fit:{name}", lambda: models.fit_model(train, name, models.PRESETS[name]))
    return m, train, test, fit


# ------------------------------------------------------------------ M ---------
@query("m01_log_target", "WITH " + sp.FEATS_CTES + """,
t AS (SELECT *, lead(pm25, 1) OVER (PARTITION BY location ORDER BY datetime) AS pm25_next FROM ftrain)
SELECT location, datetime, """ + sp.r("ln(1 + pm25_next)", "label") + ", " +
       sp.r("greatest(0.0, exp(ln(1 + pm25_next)) - 1)", "back") + " FROM t WHERE pm25_next IS NOT NULL")
def m01_log_target(spark, sf_dir):
    """Training label log1p(y) and its inverse max(0, expm1(.))."""
    tr, _, _ = cm.train_features(spark, sf_dir)
    t = models.with_label(splits.add_target(tr).where(F.col(TARGET).isNotNull()))
    return t.select("location", "datetime", "label", models.back_transform(F.col("label")).alias("back"))


def _model_query(qname: str, model_name: str):
    @query(qname)
    def fn(spark, sf_dir):
        m, _, test, _ = _fit(spark, sf_dir, model_name)
        return m.predict(test).select("location", "datetime", TARGET, "pm25_pred")
    fn.__name__ = qname
    fn.__doc__ = f"{model_name} preset fitted on log1p target; test predictions."
    return fn


for _q, _m in [("m02_random_forest", "RandomForest"), ("m03_hist_gradient_boosting", "HistGB"),
               ("m04_leafwise_boosting", "LGBM"), ("m05_depth3_boosting", "XGB"), ("m06_ridge", "Ridge")]:
    _model_query(_q, _m)


_COMPLETE = ("WITH " + sp.FEATS_CTES + """,
ctrain AS (SELECT * FROM (SELECT *, lead(pm25, 1) OVER (PARTITION BY location ORDER BY datetime) AS pm25_next FROM ftrain)
  WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in sp.REQUIRED) + """),
ctest AS (SELECT * FROM (SELECT *, lead(pm25, 1) OVER (PARTITION BY location ORDER BY datetime) AS pm25_next FROM ftest)
  WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in sp.REQUIRED) + ")")


@query("m07_missing_fill", _COMPLETE + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, " + sp.r(f"coalesce(quantile_cont(CAST({c} AS DOUBLE), 0.5), 0.0)", "median") +
    f", CAST(count(*) FILTER (WHERE {c} IS NULL) > 0 AS BIGINT) AS has_indicator FROM ctrain" for c in FEATURES))
def m07_missing_fill(spark, sf_dir):
    """Train medians per feature and which features get a missing indicator."""
    train, _, _ = _complete(spark, sf_dir)
    f = models.fit_missing(train)
    rows = [(c, float(v), int(c in f.indicators)) for c, v in f.medians.items()]
    return spark.createDataFrame(rows, "feature string, median double, has_indicator int")


def _training(spark, sf_dir):
    train, test, fit = _complete(spark, sf_dir)

    def make():
        # fits overlap: each is a chain of short jobs
        with ThreadPoolExecutor(max_workers=4) as pool:
            fitted = dict(zip(models.PRESETS, pool.map(lambda n: _fit(spark, sf_dir, n)[0], models.PRESETS), strict=True))
        return models.select(fitted, test)
    res = _memo(spark, sf_dir, "training", make)
    return res, train, test, fit


@query("m08_leaderboard")
def m08_leaderboard(spark, sf_dir):
    """MAE and R2 of every preset and of the top-2 ensemble on the test rows."""
    res, _, _, _ = _training(spark, sf_dir)
    return res.board


@query("m09_top2_ensemble")
def m09_top2_ensemble(spark, sf_dir):
    """Predictions of the mean of the two best members (back-transformed, clamped)."""
    res, _, test, _ = _training(spark, sf_dir)
    sc = models.score({n: res.models[n] for n in res.members}, test)
    mean = sum(F.col(f"pred_{n}") for n in res.members) / len(res.members)
    return sc.select("location", "datetime", TARGET, mean.alias("pm25_pred"),
                     F.lit(",".join(res.members)).alias("members"))


@query("m10_best_model")
def m10_best_model(spark, sf_dir):
    res, _, _, _ = _training(spark, sf_dir)
    return res.board.where(F.col("model") == res.best)


@query("m11_gap_report")
def m11_gap_report(spark, sf_dir):
    """Train vs test MAE / R2 of the best model (or the ensemble members)."""
    res, train, test, _ = _training(spark, sf_dir)
    names = res.members if res.best == "ENSEMBLE" else [res.best]
    return models.gap_report(res.models, train, test, names)


@query("m12_random_search")
def m12_random_search(spark, sf_dir):
    """Seeded search by a Parzen estimator (the name is of the first version, a random search):
    50 trials of the Ridge space, the family the reference's script is set to, mean MAE over
    5 expanding time-series folds."""
    return _search(spark, sf_dir)


def _search(spark, sf_dir):
    train, _, _ = _complete(spark, sf_dir)
    return _memo(spark, sf_dir, "search", lambda: models.cv_search(
        train, {"kind": "ridge"}, models.SEARCH_SPACES["Ridge"], trials=50, folds=5).cache())


@query("m13_refit_best")
def m13_refit_best(spark, sf_dir):
    """Refit the best trial on all training rows; MAE / R2 on test."""
    train, test, _ = _complete(spark, sf_dir)
    best = _search(spark, sf_dir).orderBy("cv_mae", "trial").first()
    import ast
    m = models.fit_model(train, "best", {"kind": "ridge", **ast.literal_eval(best["params"])})
    p = m.predict(test)
    return p.agg(metrics.mae(TARGET, "pm25_pred").alias("MAE"), metrics.r2(TARGET, "pm25_pred").alias("R2"),
                 F.lit(best["params"]).alias("params"))


@query("t09_group_ablation")
def t09_group_ablation(spark, sf_dir):
    """Leaderboard with all stations vs without one station in training."""
    train, test, _ = _complete(spark, sf_dir)
    res, _, _, _ = _training(spark, sf_dir)
    return models.group_ablation(train, test, "Gyor 1", models.PRESETS, with_all=res)


# ------------------------------------------------------------------ X ---------
@query("x01_permutation_importance")
def x01_permutation_importance(spark, sf_dir):
    """Mean R2 drop (log target) per permuted feature, 5 repeats, Ridge model."""
    m, _, test, _ = _fit(spark, sf_dir, "Ridge")
    return explain.permutation_importance(models.with_label(test), m, FEATURES, repeats=5)


_ATTRIBUTION = _COMPLETE + ",\nimp AS (" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(abs({c} * (coalesce(CAST({f} AS DOUBLE), 0.0) - "
    f"(SELECT avg(coalesce(CAST({f} AS DOUBLE), 0.0)) FROM ctrain)))) AS importance FROM ctest"
    for f, c in sp.BLEND_COEFS) + ")"


def _centred_blend(spark, sf_dir):
    """The fixed blend with its train means, so that attributions are centred."""
    train, test, _ = _complete(spark, sf_dir)
    means = train.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in fc.BLEND.coefs]).first()
    return replace(fc.BLEND, means={c: float(means[c] or 0.0) for c in fc.BLEND.coefs}), test


@query("x02_linear_attribution", _ATTRIBUTION + "\nSELECT feature, " + sp.r("importance", "importance") + " FROM imp")
def x02_linear_attribution(spark, sf_dir):
    """Exact Shapley importance of the fixed blend: mean |coef (x - mean)|, top 10."""
    model, test = _centred_blend(spark, sf_dir)
    return explain.linear_attributions(test, model, top=10)


@query("x02_ridge_attribution")
def x02_ridge_attribution(spark, sf_dir):
    """Exact Shapley importance of the fitted Ridge, centred on its train means."""
    m, _, test, _ = _fit(spark, sf_dir, "Ridge")
    return explain.linear_attributions(test, models.to_linear(m), top=10)


@query("x02_sampled_shapley")
def x02_sampled_shapley(spark, sf_dir):
    """Sampled Shapley importance of a boosted-tree model over all test rows."""
    m, _, test, _ = _fit(spark, sf_dir, "HistGB")
    return explain.sampled_shapley(test, m, FEATURES)


@query("x02_tree_attribution")
def x02_tree_attribution(spark, sf_dir):
    """Exact Shapley importance of the histogram-boosted trees over all test rows, top 10."""
    m, _, test, _ = _fit(spark, sf_dir, "HistGB")
    return explain.tree_attributions(test, m, top=10)


@query("x03_tree_drivers")
def x03_tree_drivers(spark, sf_dir):
    """Per forecast step: top-5 exact effects on the forecast of the boosted trees."""
    m, _, _, fit = _fit(spark, sf_dir, "HistGB")
    _, wx = cm.inputs(spark, sf_dir)
    f = fc.forecast_latest(cm.base(spark, sf_dir), dedup_weather(wx), models.as_forecaster([m]), fit, explain=True)
    d = f.select("location", "horizon", F.posexplode(explain.top_drivers(F.col("effects"))).alias("_i", "e"))
    return d.select("location", "horizon", (F.col("_i") + 1).alias("rank"), "e.feature", "e.value", "e.direction")


def _x03_sql() -> str:
    from airgrid.operators.explain import FEATURE_LABELS, IGNORED, TOP
    pos = {f: i for i, f in enumerate(FEATURES)}
    lab = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_LABELS.items())
    # step s sees the state before its own append: st for s = 1, r{s-1} after
    return ("WITH " + sp.BASE_CTES + ",\n" +
            sp.forecast_state("r._rn = (SELECT max(r2._rn) FROM rows r2 WHERE r2.location = r.location)") +
            ",\n" + sp.recursion() + ",\neff AS (" + "\nUNION ALL ".join(
                f"SELECT location, {s} AS horizon, '{f}' AS f, {pos.get(f, len(FEATURES))} AS pos, "
                f"{c} * coalesce(CAST({sp.blend_feats(s)[f]} AS DOUBLE), 0.0) AS value FROM "
                f"{'st' if s == 1 else f'r{s - 1}'}"
                for s in HZ for f, c in sp.BLEND_COEFS if f not in IGNORED) + "),\n"
            "rk AS (SELECT *, row_number() OVER (PARTITION BY location, horizon ORDER BY abs(value) DESC, pos) AS rank "
            "FROM eff)\n"
            f"SELECT location, CAST(horizon AS BIGINT) AS horizon, CAST(rank AS BIGINT) AS rank, "
            f"CASE f {lab} ELSE f END AS feature, {sp.r('value', 'value')}, "
            f"CASE WHEN value > 0 THEN 'up' ELSE 'down' END AS direction FROM rk WHERE rank <= {TOP}")


@query("x03_top_drivers", _x03_sql())
def x03_top_drivers(spark, sf_dir):
    """Per forecast step: top-5 feature effects (relabelled, ignored features dropped)."""
    _, wx = cm.inputs(spark, sf_dir)
    f = fc.forecast_latest(cm.base(spark, sf_dir), dedup_weather(wx), fc.BLEND, None, explain=True)
    d = f.select("location", "horizon", F.posexplode(explain.top_drivers(F.col("effects"))).alias("_i", "e"))
    return d.select("location", "horizon", (F.col("_i") + 1).alias("rank"), "e.feature", "e.value",
                    "e.direction")


# ------------------------------------------------------------------ E17/E18 ---
@query("e17_pca_variance")
def e17_pca_variance(spark, sf_dir):
    tr, _, _ = cm.train_features(spark, sf_dir)
    return explore.pca_variance(tr, FEATURES)


@query("e17_pca_projection")
def e17_pca_projection(spark, sf_dir):
    tr, _, _ = cm.train_features(spark, sf_dir)
    return explore.pca_projection(tr, FEATURES, ["location", "datetime"])


@query("e18_kmeans_elbow")
def e18_kmeans_elbow(spark, sf_dir):
    tr, _, _ = cm.train_features(spark, sf_dir)
    elbow, _ = explore.kmeans_elbow(tr, FEATURES)
    return elbow


@query("e18_kmeans_clusters")
def e18_kmeans_clusters(spark, sf_dir):
    tr, _, _ = cm.train_features(spark, sf_dir)
    _, labels = explore.kmeans_elbow(tr, FEATURES, ks=range(5, 6))
    return labels.select("location", "datetime", "cluster")


# ------------------------------------------------------------------ P05/V11 ---
@query("p05_ensemble_forecast")
def p05_ensemble_forecast(spark, sf_dir):
    """Recursive 12-step forecast scored by an ensemble of Ridge and boosted trees."""
    _, _, fit = _complete(spark, sf_dir)
    members = [_fit(spark, sf_dir, n)[0] for n in ("Ridge", "HistGB")]
    _, wx = cm.inputs(spark, sf_dir)
    out = fc.forecast_latest(cm.base(spark, sf_dir), dedup_weather(wx), models.as_forecaster(members), fit)
    return out.select("location", "origin", "horizon", "datetime", "pm25_pred", "missing_ratio", "is_extreme")


@query("p08_walk_forward_ensemble")
def p08_walk_forward_ensemble(spark, sf_dir):
    """Walk-forward backtest of the fitted top-2 ensemble over every origin of every station."""
    res, _, _, fit = _training(spark, sf_dir)
    _, wx = cm.inputs(spark, sf_dir)
    model = models.as_forecaster([res.models[n] for n in res.members])
    return fc.backtest(cm.base(spark, sf_dir), dedup_weather(wx), model, fit)


@query("v11_metric_record", _ATTRIBUTION + """,
sc AS (SELECT *, greatest(0.0, """ + "0.0" + "".join(f" + {c} * coalesce(CAST({f} AS DOUBLE), 0.0)" for f, c in sp.BLEND_COEFS) +
       """) AS p FROM ctest),
m AS (SELECT count(*) AS n, avg(abs(pm25_next - p)) AS mae, sqrt(avg(pow(pm25_next - p, 2))) AS rmse FROM sc)
SELECT CAST(n AS BIGINT) AS n, """ + sp.r("mae", "MAE") + ", " + sp.r("rmse", "RMSE") + ", feature, " +
       sp.r("importance", "importance") + " FROM m, imp")
def v11_metric_record(spark, sf_dir):
    """Metric record of the fixed blend; its map of the top-10 features as rows."""
    model, test = _centred_blend(spark, sf_dir)
    scored = model.predict(test).withColumnRenamed("_pred", "pm25_pred")
    rec = metrics.metric_record(metrics.regression_metrics(scored), explain.linear_attributions(test, model))
    return rec.select("n", "MAE", "RMSE", F.explode("top_features").alias("feature", "importance"))


# Queries that fit tree ensembles, the quickest first.
SLOW = ["m03_hist_gradient_boosting", "m05_depth3_boosting", "m02_random_forest", "m04_leafwise_boosting", "x02_tree_attribution",
        "x03_tree_drivers", "x02_sampled_shapley", "p05_ensemble_forecast", "m08_leaderboard", "m09_top2_ensemble",
        "m10_best_model", "m11_gap_report", "p08_walk_forward_ensemble", "t09_group_ablation"]
