"""File sources and sinks (S01-S06, S09): explicit schemas, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airgrid.operators.clean import no_nan
from airgrid.schemas import ALL_PARAMETERS, KEY, TIME, WEATHER_COLS, WIDE_POLLUTANTS

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_pollutants_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide pollutant CSV; any absent pollutant column comes back NULL."""
    df = (spark.read.schema(WIDE_POLLUTANTS).option("header", True)
          .option("timestampFormat", TS_FORMAT).option("enforceSchema", False)
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return df.select(TIME, KEY, "latitude", "longitude", *[no_nan(c).alias(c) for c in ALL_PARAMETERS])


WEATHER_CSV = T.StructType(
    [T.StructField("_index", T.LongType()), T.StructField(TIME, T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in WEATHER_COLS])


def read_weather_csv(spark: SparkSession, path: str) -> DataFrame:
    """Weather CSV written with its row index; the index column is projected away."""
    df = (spark.read.schema(WEATHER_CSV).option("header", True)
          .option("timestampFormat", TS_FORMAT).csv(path))
    return df.select(TIME, *[no_nan(c).alias(c) for c in WEATHER_COLS])


def write_csv(df: DataFrame, path: str, index: bool = False) -> None:
    """CSV sink (header, fixed timestamp format); ``index`` adds a row-index column."""
    out = df
    if index:
        out = df.select(F.monotonically_increasing_id().alias("_index"), *df.columns)
    (out.write.mode("overwrite").option("header", True).option("timestampFormat", TS_FORMAT)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


MONTH = "_month"


def write_features(df: DataFrame, path: str) -> None:
    """S03 sink: Parquet by month, rows sorted by station inside the files.

    Time reads prune folders, station reads prune row groups, and the number of
    folders follows the time span and not the number of stations.
    """
    out = df.withColumn(MONTH, F.date_format(TIME, "yyyy-MM"))
    (out.repartition(MONTH, KEY).sortWithinPartitions(MONTH, KEY, TIME)
     .write.mode("overwrite").partitionBy(MONTH).parquet(path))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """S03 scan: column types as stored in the files; the folder column is only for pruning."""
    return spark.read.parquet(path).drop(MONTH)


def write_metrics_json(df: DataFrame, path: str) -> None:
    """Metric record as JSON (one small row)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def time_range(df: DataFrame, start: str, end: str, col: str = TIME) -> DataFrame:
    """Keep ``start <= t <= end`` (both inclusive); pushed to the Parquet scan."""
    return df.where(F.col(col).between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def save_models(models: list, path: str) -> None:
    """The members of an ensemble (or one model), each in its own form (trees, or a pipeline with its fills)."""
    from airgrid.operators.trees import TreeModel
    for k, m in enumerate(models):
        m.save(f"{path}/{k}")
    spark = SparkSession.active()
    rows = [(k, m.name, "trees" if isinstance(m, TreeModel) else "pipeline") for k, m in enumerate(models)]
    spark.createDataFrame(rows, "place int, name string, form string").coalesce(1).write.mode("overwrite").json(f"{path}/members")


def load_models(spark: SparkSession, path: str) -> list:
    from airgrid.operators.models import FittedModel
    from airgrid.operators.trees import TreeModel
    members = spark.read.schema("place int, name string, form string").json(f"{path}/members").orderBy("place").collect()
    return [(TreeModel if r["form"] == "trees" else FittedModel).load(spark, f"{path}/{r['place']}") for r in members]
