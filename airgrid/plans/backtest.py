"""E-C: walk-forward validation over every station and origin, with error summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from airgrid.operators import forecast as fc
from airgrid.operators import metrics
from airgrid.session import cut_lineage


def run(base: DataFrame, weather: DataFrame, model: fc.Forecaster, fit=None,
        lag_hours: int = 48, horizon: int = fc.HORIZON) -> tuple[DataFrame, DataFrame, DataFrame]:
    bt = cut_lineage(fc.backtest(base, weather, model, fit, lag_hours, horizon))
    return bt, metrics.by_horizon(bt), metrics.error_by_origin(bt)
