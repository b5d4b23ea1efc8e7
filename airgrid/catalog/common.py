"""Shared plumbing of the query catalog: fixture loading and result finishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.operators import clean, features, splits
from airgrid.session import prepare
from airgrid.sources import fixtures

STATIONS = 3          # K of the events adapter used by every catalog query
DIGITS = 6            # doubles are compared after rounding to this many places
# Summation order differs between engines; a relative nudge far below the kept
# precision makes values that sit one ulp off a rounding tie round the same way.
NUDGE = 1.000000000001


def finish(df: DataFrame) -> DataFrame:
    """Round doubles, widen integers to bigint: the shape both engines agree on."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") * F.lit(NUDGE), DIGITS) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def inputs(spark: SparkSession, sf_dir: str, stations: int = STATIONS,
           hourly: bool = True) -> tuple[DataFrame, DataFrame]:
    prepare(spark)
    return fixtures.load(spark, sf_dir, stations, hourly)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return fixtures.read_table(spark, sf_dir, "events")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    meas, _ = inputs(spark, sf_dir)
    return clean.pivot_measurements(meas)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    meas, wx = inputs(spark, sf_dir)
    return clean.base_from_measurements(meas, wx)


def prepared(spark: SparkSession, sf_dir: str) -> splits.PreparedData:
    return splits.prepare_panels(base(spark, sf_dir))


def train_features(spark: SparkSession, sf_dir: str):
    p = prepared(spark, sf_dir)
    tr, fit = features.build_features(p.train)
    return tr, fit, p


def test_features(spark: SparkSession, sf_dir: str):
    tr, fit, p = train_features(spark, sf_dir)
    te, _ = features.build_features(p.test, fit)
    return tr, te, fit, p
