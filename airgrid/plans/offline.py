"""E-A: the offline job (ingest shaping -> base -> split -> features -> train -> evaluate).

One driver program; every stage is a lazy DataFrame and hand-offs are Parquet
tables in the shared folder (restartable, and they cut lineage).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from airgrid.operators import clean, features, metrics, models, splits
from airgrid.schemas import TARGET
from airgrid.session import scratch_path
from airgrid.sources import files


@dataclass
class OfflineResult:
    train_path: str
    test_path: str
    fit: features.SpatialFit
    training: models.TrainingResult
    model_path: str
    metrics: DataFrame


def run(long: DataFrame, weather: DataFrame, presets: dict | None = None,
        out_dir: str | None = None, select_on: str = "validation") -> OfflineResult:
    """Train, choose (on a validation tail of the training rows by default), evaluate on the
    test rows and store the chosen model or ensemble for serving."""
    spark = long.sparkSession
    base = clean.base_from_measurements(long, weather)
    prep = splits.prepare_panels(base)
    train, fit = features.build_features(prep.train)
    test, _ = features.build_features(prep.test, fit)
    root = out_dir or scratch_path(spark, "offline")
    files.write_features(train, f"{root}/train")
    files.write_features(test, f"{root}/test")
    fit.save(f"{root}/artifacts")
    tr = splits.complete_cases(splits.add_target(files.read_features(spark, f"{root}/train")))
    te = splits.complete_cases(splits.add_target(files.read_features(spark, f"{root}/test")))
    res = models.train_and_select(tr, te, presets or models.PRESETS, select_on=select_on)
    names = res.members if res.best == "ENSEMBLE" else [res.best]
    files.save_models([res.models[n] for n in names], f"{root}/models")
    sc = models.score({n: res.models[n] for n in names}, te)
    pred = sum(sc[f"pred_{n}"] for n in names) / len(names)
    m = metrics.regression_metrics(sc.withColumn("pm25_pred", pred), TARGET, "pm25_pred")
    files.write_metrics_json(m, f"{root}/evaluation")
    return OfflineResult(f"{root}/train", f"{root}/test", fit, res, f"{root}/models", m)
