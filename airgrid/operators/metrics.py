"""Error metrics and diagnostics (V01-V11): single aggregation passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.operators import explore

EPS = 2.220446049250313e-16      # float64 machine epsilon (MAPE floor)
SMAPE_EPS = 1e-6


def _abs_err(y: str, p: str) -> Column:
    return F.abs(F.col(y) - F.col(p))


def mae(y: str, p: str) -> Column:
    """V01."""
    return F.avg(_abs_err(y, p))


def rmse(y: str, p: str) -> Column:
    """V02."""
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2)))


def r2(y: str, p: str) -> Column:
    """1 - SSE / SST (SST = population variance x n)."""
    sse = F.sum(F.pow(F.col(y) - F.col(p), 2))
    sst = F.var_pop(y) * F.count(y)
    return F.lit(1.0) - sse / sst


def mape(y: str, p: str) -> Column:
    """Mean |y - p| / max(|y|, eps), as a fraction."""
    return F.avg(_abs_err(y, p) / F.greatest(F.abs(F.col(y)), F.lit(EPS)))


def smape(y: str, p: str) -> Column:
    """V05."""
    return F.avg(2 * F.abs(F.col(p) - F.col(y)) / (F.abs(F.col(y)) + F.abs(F.col(p)) + SMAPE_EPS))


def regression_metrics(df: DataFrame, y: str = "pm25_next", p: str = "pm25_pred",
                       naive: str | None = "pm25_lag1") -> DataFrame:
    """V01-V06 in one pass; MASE divides by the MAE of ``naive`` on rows where it exists."""
    aggs = [F.count(F.lit(1)).alias("n"), mae(y, p).alias("MAE"), rmse(y, p).alias("RMSE"),
            mape(y, p).alias("MAPE"), smape(y, p).alias("SMAPE"), r2(y, p).alias("R2")]
    if naive:
        naive_mae = F.avg(F.when(F.col(naive).isNotNull(), _abs_err(y, naive)))
        aggs += [naive_mae.alias("naive_MAE"), (mae(y, p) / naive_mae).alias("MASE")]
    return df.agg(*aggs)


def baseline_mae(df: DataFrame, y: str = "pm25_next", naive: str = "pm25_lag1") -> DataFrame:
    """MAE of the persistence forecast."""
    return df.where(F.col(naive).isNotNull()).agg(mae(y, naive).alias("baseline_MAE"),
                                                  F.count(F.lit(1)).alias("n"))


def by_horizon(bt: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MAE and RMSE per horizon; rows with NULL truth are ignored."""
    v = bt.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return v.groupBy("horizon").agg(rmse(y, p).alias("RMSE"), mae(y, p).alias("MAE"),
                                    F.count(F.lit(1)).alias("n"))


def error_by_origin(bt: DataFrame, y: str = "y_true", p: str = "y_pred",
                    keys: tuple[str, ...] = ("location", "forecast_origin")) -> DataFrame:
    """Mean signed error (pred - true) per forecast origin."""
    return bt.groupBy(*keys).agg(F.avg(F.col(p) - F.col(y)).alias("mean_error"))


def residuals(df: DataFrame, y: str = "pm25_next", p: str = "pm25_pred",
              keys: tuple[str, ...] = ("location", "datetime")) -> DataFrame:
    """Residual per row with prediction and truth (the data behind the residual plots)."""
    return df.select(*keys, F.col(y).alias("y_true"), F.col(p).alias("y_pred"),
                     (F.col(y) - F.col(p)).alias("residual"))


def residual_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """50-bin histogram of residuals."""
    return explore.histogram(df, "residual", bins)


def metric_record(metrics: DataFrame, importances: DataFrame | None = None,
                  top: int = 10) -> DataFrame:
    """One row of metrics plus ``top_features`` map (feature -> importance)."""
    if importances is None:
        return metrics
    top_df = importances.orderBy(F.desc("importance"), "feature").limit(top)
    m = top_df.agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance")))
                   .alias("top_features"))
    return _attach(metrics, m)


def _attach(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (both sides are single aggregate rows)."""
    k = "_one"
    return left.withColumn(k, F.lit(1)).join(one_row.withColumn(k, F.lit(1)), k).drop(k)
