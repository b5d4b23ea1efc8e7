"""Model training and selection.

* Targets are fitted in ``log1p`` space and mapped back with ``max(0, expm1(.))``.
* Tree ensembles are ``operators.trees`` on bin codes; they see missing values as such
  (M07) and are fitted uncut from the reference's presets.
* Ridge is Spark ML's normal-equation solver on median-filled features.
* Fits of a search run concurrently from a driver thread pool: each fit is a
  distributed Spark job, the pool only overlaps them.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions.quantiles import exact_quantiles_many
from airgrid.operators import metrics, splits, trees
from airgrid.operators.forecast import EnsembleForecaster, LinearForecaster
from airgrid.operators.search import Study
from airgrid.operators.trees import BoostSpec, ForestSpec, TreeModel
from airgrid.schemas import FEATURES, KEY, TARGET
from airgrid.session import cut_lineage

LABEL = "label"
ROWS_PER_PARTITION = 250_000     # layout of the cached training rows, which every tree level reads

# ---- fixed values: the reference's tuned presets --------------------------------
# Boosting parameters that the reference leaves at its libraries' defaults are written out: 31 leaves
# of the histogram learner; 20 rows and a hessian of 0.001 a leaf, and rows that are never drawn anew,
# of the leaf-wise learner; a hessian of one and an L2 of one of the depth-wise learner.
PRESETS = {
    "RandomForest": dict(kind="forest", trees=715, max_depth=16, min_split=9, min_leaf=3, columns=None, seed=42),
    "HistGB": dict(kind="boost", rounds=309, learning_rate=0.052392441315122884, max_depth=6, max_leaves=31,
                   min_leaf=89, l2=0.10712858441423956, max_bins=172, seed=42),
    "LGBM": dict(kind="boost", rounds=723, learning_rate=0.012885472793169907, max_depth=11, max_leaves=71,
                 min_leaf=20, min_weight=1e-3, row_share=0.6904437214202783, row_every=0,
                 column_share=0.6924371848724423, seed=42),
    "XGB": dict(kind="boost", rounds=615, learning_rate=0.08447106507617709, max_depth=3, min_weight=1.0, l2=1.0,
                row_share=0.9593316490919434, column_share=0.743423049049403, seed=42),
    "Ridge": dict(kind="ridge", alpha=0.01007089724896645),
}
# ------------------------------------------------------------------------------------


# ------------------------------------------------------------------ M07 ------

@dataclass
class MissingFill:
    """Train medians per feature and the indicator columns.

    ``constant`` lists features with one value on the training rows; they are
    left out of linear designs (their centred column is zero, so a ridge gives
    them a zero coefficient anyway, and keeping them makes the normal equations
    singular).
    """
    medians: dict[str, float]
    indicators: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)
    means: dict[str, float] = field(default_factory=dict)      # of the filled training columns

    def transform(self, df: DataFrame) -> DataFrame:
        ind = {f"{c}__missing": F.col(c).isNull().cast("double") for c in self.indicators}
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in self.medians.items()}
        return df.withColumns(ind).withColumns(filled)

    @property
    def columns(self) -> list[str]:
        return ([c for c in self.medians if c not in self.constant]
                + [f"{c}__missing" for c in self.indicators])


def fit_missing(train: DataFrame, cols: list[str] = FEATURES, indicators: bool = True) -> MissingFill:
    """Exact medians in one pass, counts in another; indicators for columns that have NULLs in train."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.sum(x).alias(f"s_{c}"))
        aggs.append(F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}"))
        aggs.append((F.min(x) == F.max(x)).alias(f"k_{c}"))
    row = train.agg(*aggs).first()
    exact = exact_quantiles_many(train, cols, [0.5])
    med = {c: (exact[c][0] if exact[c][0] is not None else 0.0) for c in cols}
    ind = [c for c in cols if indicators and row[f"n_{c}"] > 0]
    const = [c for c in cols if not indicators and row[f"k_{c}"] is not False]   # NULL: all missing
    means = {c: ((row[f"s_{c}"] or 0.0) + row[f"n_{c}"] * med[c]) / max(row["n"], 1) for c in cols}
    return MissingFill(med, ind, const, means)


def with_label(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Fit on ``log1p(y)``."""
    return df.withColumn(LABEL, F.log1p(F.col(target)))


def back_transform(c):
    """M01 inverse: ``max(0, expm1(p))``."""
    return F.greatest(F.lit(0.0), F.expm1(c))


# ------------------------------------------------------------------ M02-M06 --

def ridge(alpha: float, n: int, sd: float) -> LinearRegression:
    """sklearn's alpha on the sum of squares == Spark's regParam on the mean, after Spark's
    internal label scaling by its standard deviation."""
    return LinearRegression(featuresCol="features", labelCol=LABEL, regParam=alpha * (sd if sd else 1.0) / max(n, 1),
                            elasticNetParam=0.0, standardization=False, solver="normal")


def tree_spec(preset: dict) -> BoostSpec | ForestSpec:
    kind = {"boost": BoostSpec, "forest": ForestSpec}[preset["kind"]]
    known = {f.name for f in fields(kind)}
    unknown = set(preset) - known - {"kind"}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return kind(**{k: v for k, v in preset.items() if k != "kind"})


@dataclass
class FittedModel:
    name: str
    fill: MissingFill
    model: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Spark ML ``transform`` contract: adds ``prediction`` (log space); the features stay as they are."""
        given = df.withColumn("_given", F.struct(*self.fill.medians))
        out = self.model.transform(self.fill.transform(given))
        return out.withColumns({c: F.col("_given")[c] for c in self.fill.medians}).drop(
            "_given", *[f"{c}__missing" for c in self.fill.indicators])

    def predict(self, df: DataFrame, name: str = "pm25_pred") -> DataFrame:
        return self.transform(df).withColumn(name, back_transform(F.col("prediction"))) \
            .drop("prediction", "features")

    def save(self, path: str) -> None:
        """The pipeline and one JSON row with the fills."""
        self.model.write().overwrite().save(f"{path}/pipeline")
        f = self.fill
        (SparkSession.active().createDataFrame([(self.name, f.medians, f.indicators, f.constant, f.means)], _FILL)
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/fill"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedModel":
        r = spark.read.schema(_FILL).parquet(f"{path}/fill").first()
        # a map does not keep its order; the features' order is the vector's
        order = [c for c in FEATURES if c in r["medians"]] + sorted(c for c in r["medians"] if c not in FEATURES)
        fill = MissingFill({c: r["medians"][c] for c in order}, list(r["indicators"]), list(r["constant"]), dict(r["means"]))
        return FittedModel(r["name"], fill, PipelineModel.load(f"{path}/pipeline"))


_FILL = ("name string, medians map<string,double>, indicators array<string>, constant array<string>, "
         "means map<string,double>")


def _prepared(train: DataFrame, fill: MissingFill) -> DataFrame:
    """Label and feature vector of the training rows, stored for the many passes of a fit."""
    data = VectorAssembler(inputCols=fill.columns, outputCol="features", handleInvalid="error").transform(
        with_label(fill.transform(train))).select(LABEL, "features")
    data = cut_lineage(data)
    parts = max(1, -(-data.count() // ROWS_PER_PARTITION))
    return data.coalesce(parts) if parts < data.rdd.getNumPartitions() else data


def fit_model(train: DataFrame, name: str, preset: dict, features: list[str] = FEATURES) -> "FittedModel | TreeModel":
    """Fit one preset on complete training rows (label = log1p(pm25_next))."""
    if preset["kind"] != "ridge":
        return trees.fit_trees(with_label(train).select(*features, LABEL, *_identity(train, features)), name,
                               tree_spec(preset), LABEL, features)
    fill = fit_missing(train, features, indicators=False)
    data = _prepared(train, fill).persist()
    try:
        model = ridge(preset["alpha"], *label_stats(data)).fit(data)
    finally:
        data.unpersist()
    asm = VectorAssembler(inputCols=fill.columns, outputCol="features", handleInvalid="error")
    return FittedModel(name, fill, PipelineModel([asm, model]))


def _identity(df: DataFrame, features: list[str]) -> list[str]:
    """Columns besides the features that tell rows apart in the learners' draws."""
    return [c for c in ("location", "datetime") if c in df.columns and c not in features]


def label_stats(data: DataFrame) -> tuple[int, float]:
    r = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(LABEL).alias("sd")).first()
    return r["n"], r["sd"]


def to_linear(m: FittedModel) -> LinearForecaster:
    """A fitted Ridge as an expression model (exact, recursion in one projection)."""
    lr = m.model.stages[-1]
    coefs = dict(zip(m.fill.columns, [float(v) for v in lr.coefficients]))
    return LinearForecaster(coefs=coefs, intercept=float(lr.intercept), fills=dict(m.fill.medians),
                            means=dict(m.fill.means), log_target=True)


def as_forecaster(members: list) -> EnsembleForecaster:
    """Ensemble-aware scoring for the recursion (mean of back-transformed members)."""
    return EnsembleForecaster([m.trees if isinstance(m, TreeModel) else to_linear(m) for m in members], log_target=True)


# ------------------------------------------------------------------ M08-M11 --

def score(models: dict[str, FittedModel | TreeModel], df: DataFrame, target: str = TARGET) -> DataFrame:
    """Wide predictions: one ``pred_<name>`` column per model (original scale)."""
    out = df
    for name, m in models.items():
        scored = m.transform(out)
        out = scored.select(*out.columns, back_transform(F.col("prediction")).alias(f"pred_{name}"))
    return out


def leaderboard(scored: DataFrame, names: list[str], target: str = TARGET,
                ensemble: list[str] | None = None) -> DataFrame:
    """MAE and R2 per model (and the ensemble of ``ensemble`` members) in one pass."""
    df = scored
    cols = list(names)
    if ensemble:
        mean = sum(F.col(f"pred_{n}") for n in ensemble) / len(ensemble)
        df = df.withColumn("pred_ENSEMBLE", mean)
        cols.append("ENSEMBLE")
    aggs = []
    for n in cols:
        aggs += [metrics.mae(target, f"pred_{n}").alias(f"{n}|MAE"), metrics.r2(target, f"pred_{n}").alias(f"{n}|R2")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"`{n}|MAE`").alias("MAE"),
                                        F.col(f"`{n}|R2`").alias("R2")) for n in cols]))
    return wide.select(rows.alias("r")).select("r.*")


def top_members(board: DataFrame, k: int = 2) -> list[str]:
    """The ``k`` best models by MAE (the ensemble row excluded)."""
    rows = board.where(F.col("model") != "ENSEMBLE").orderBy("MAE", "model").limit(k).collect()
    return [r["model"] for r in rows]


def best_model(board: DataFrame) -> str:
    """Lowest MAE, the ensemble included."""
    return board.orderBy("MAE", "model").first()["model"]


def gap_report(models: dict[str, FittedModel | TreeModel], train: DataFrame, test: DataFrame,
               names: list[str]) -> DataFrame:
    """MAE and R2 of a model (or the mean of several) on train and test."""
    out = None
    for part, df in (("train", train), ("test", test)):
        sc = score({n: models[n] for n in names}, df)
        mean = sum(F.col(f"pred_{n}") for n in names) / len(names)
        r = sc.withColumn("_p", mean).agg(metrics.mae(TARGET, "_p").alias("MAE"),
                                           metrics.r2(TARGET, "_p").alias("R2"))
        r = r.withColumn("part", F.lit(part))
        out = r if out is None else out.unionByName(r)
    return out


@dataclass
class TrainingResult:
    models: dict[str, FittedModel | TreeModel]
    board: DataFrame
    members: list[str]
    best: str


def validation_tail(train: DataFrame, share: float = 1 / 6) -> tuple[DataFrame, DataFrame]:
    """T08-style split: the last ``share`` of the training rows in time order is for validation."""
    pos = splits.global_position(train)
    cut = int(train.count() * (1 - share))
    return pos.where(F.col("pos") < cut).drop("pos"), pos.where(F.col("pos") >= cut).drop("pos")


def select(models: dict[str, FittedModel | TreeModel], test: DataFrame, members: list[str] | None = None) -> TrainingResult:
    """M08-M10 on fitted models: board, members (the two best unless given) and best model on ``test``."""
    scored = cut_lineage(score(models, test))
    members = members or top_members(leaderboard(scored, list(models)))
    board = leaderboard(scored, list(models), ensemble=members)
    return TrainingResult(models, board, members, best_model(board))


def train_and_select(train: DataFrame, test: DataFrame, presets: dict[str, dict] = PRESETS,
                     parallel: int = 4, select_on: str = "test") -> TrainingResult:
    """M02-M10 as the offline job runs them (fits overlap in a small thread pool).

    ``select_on="test"`` picks members and best model on the test rows, as the
    reference does.  ``"validation"`` picks them on the last part of the training
    rows, with models fitted on the part before, and then fits on all of them; the
    board still shows the test error, which then had no say in the choice.
    """
    if select_on not in ("test", "validation"):
        raise ValueError("select_on must be test or validation")

    def fit_all(rows: DataFrame) -> dict[str, FittedModel | TreeModel]:
        with ThreadPoolExecutor(max_workers=parallel) as ex:
            futs = {n: ex.submit(fit_model, rows, n, p) for n, p in presets.items()}
            return {n: f.result() for n, f in futs.items()}

    if select_on == "test":
        return select(fit_all(train), test)
    early, late = validation_tail(train)
    tail = select(fit_all(early), late)
    final = select(fit_all(train), test, tail.members)
    return TrainingResult(final.models, final.board, tail.members, tail.best)


# ------------------------------------------------------------------ M12/M13 --

# ---- fixed values: the reference's search spaces (kind, lower, upper or choices) ------
SEARCH_SPACES = {
    "RandomForest": {"trees": ("int", 200, 800), "max_depth": ("int", 5, 30), "min_split": ("int", 2, 20),
                     "min_leaf": ("int", 1, 10), "columns": ("cat", ["sqrt", "log2", None])},
    "HistGB": {"rounds": ("int", 100, 400), "learning_rate": ("log", 0.01, 0.2), "max_depth": ("int", 3, 12),
               "min_leaf": ("int", 10, 100), "l2": ("float", 0.0, 1.0), "max_bins": ("int", 64, 255)},
    "LGBM": {"rounds": ("int", 200, 800), "learning_rate": ("log", 0.01, 0.2), "max_leaves": ("int", 16, 128),
             "max_depth": ("int", -1, 12), "row_share": ("float", 0.6, 1.0), "column_share": ("float", 0.6, 1.0)},
    "XGB": {"rounds": ("int", 200, 800), "learning_rate": ("log", 0.01, 0.2), "max_depth": ("int", 3, 10),
            "row_share": ("float", 0.6, 1.0), "column_share": ("float", 0.6, 1.0)},
    "Ridge": {"alpha": ("log", 0.01, 10.0)},
}
# ------------------------------------------------------------------------------------


@dataclass
class _Fold:
    """What all trials share of one fold: training rows of either kind and the rows to score."""
    train: DataFrame
    valid: DataFrame
    ridge: tuple | None = None
    binned: dict = field(default_factory=dict)


def _fold_score(fold: _Fold, preset: dict) -> float:
    """Validation MAE (original scale) of one parameter set on one fold."""
    if preset["kind"] == "ridge":
        data, stats, valid = fold.ridge
        p = ridge(preset["alpha"], *stats).fit(data).transform(valid)
    else:
        spec = tree_spec(preset)
        if spec.max_bins not in fold.binned:
            fold.binned[spec.max_bins] = trees.bin_rows(fold.train, LABEL, FEATURES, spec.max_bins)
        data = fold.binned[spec.max_bins]
        flat = trees.fit_boosting(data, spec) if isinstance(spec, BoostSpec) else trees.fit_forest(data, spec)
        p = TreeModel("trial", FEATURES, flat).transform(fold.valid)
    return p.withColumn("_p", back_transform(F.col("prediction"))).agg(metrics.mae(TARGET, "_p").alias("m")).first()["m"]


def cv_search(train: DataFrame, base_preset: dict, space: dict, trials: int = 50, folds: int = 5, seed: int = 42,
              batch: int = 5, parallel: int = 4, startup: int = 10) -> DataFrame:
    """Mean validation MAE (original scale) of each trial over expanding folds.

    Trials come from a tree-structured Parzen estimator (``operators.search``) in
    batches that are scored together; the result depends on seed and batch, not on
    ``parallel``.  Fills, vectors and bin codes of a fold are prepared once.
    """
    pos = cut_lineage(splits.global_position(train))
    spark = train.sparkSession
    prepared = []
    for f in splits.ts_folds(pos.count(), folds):
        tr, va = splits.fold_frames(pos, f)
        if base_preset["kind"] == "ridge":
            fill = fit_missing(tr, FEATURES, indicators=False)
            data = _prepared(tr, fill).persist()
            asm = VectorAssembler(inputCols=fill.columns, outputCol="features", handleInvalid="error")
            prepared.append(_Fold(tr, va, (data, label_stats(data),
                                           cut_lineage(asm.transform(fill.transform(va)).select("features", TARGET)))))
        else:
            prepared.append(_Fold(cut_lineage(with_label(tr).select(*FEATURES, LABEL, *_identity(tr, FEATURES))),
                                  cut_lineage(va.select(*FEATURES, TARGET))))
    study, rows = Study(space, seed, startup), []
    try:
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            while len(rows) < trials:
                asked = study.ask(min(batch, trials - len(rows)))
                jobs = [[pool.submit(_fold_score, f, {**base_preset, **t}) for f in prepared] for t in asked]
                for t, js in zip(asked, jobs, strict=True):
                    maes = [j.result() for j in js]
                    loss = float(sum(maes) / len(maes))
                    study.tell(t, loss)
                    rows.append((len(rows), str(t), loss))
    finally:
        for f in prepared:
            if f.ridge:
                f.ridge[0].unpersist()
            for b in f.binned.values():
                b.blocks.unpersist()
    return spark.createDataFrame(rows, "trial int, params string, cv_mae double")


def best_trial(results: DataFrame) -> DataFrame:
    """The parameters of the lowest mean CV MAE."""
    return results.agg(F.min_by("params", "cv_mae").alias("params"), F.min("cv_mae").alias("cv_mae"))


def group_ablation(train: DataFrame, test: DataFrame, group: str, presets: dict[str, dict],
                   key: str = KEY, with_all: TrainingResult | None = None) -> DataFrame:
    """Leaderboard with and without one station in training (same test set).

    ``with_all``: the result on all stations, if it is already at hand."""
    with_g = (with_all or train_and_select(train, test, presets)).board.withColumn("experiment", F.lit("all"))
    without = train_and_select(splits.exclude_group(train, group, key), test, presets).board
    return with_g.unionByName(without.withColumn("experiment", F.lit(f"without {group}")))
