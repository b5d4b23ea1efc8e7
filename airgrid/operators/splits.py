"""Splits and history context.

Global positions (T08) never use a window without ``partitionBy`` on the fact
table: rows are counted per timestamp (one small row per hour), the running
offset is taken over that hour table, and the rank inside an hour comes from a
window partitioned by the timestamp.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.operators.clean import interpolate_station
from airgrid.session import cut_lineage
from airgrid.schemas import INTERP_LIMIT, KEY, REQUIRED_COLUMNS, TARGET, TIME


def quantile_split_point(df: DataFrame, q: float = 0.75, exact: bool = True) -> float:
    """The q-quantile of row timestamps (linear interpolation), in epoch µs."""
    us = F.unix_micros(F.col(TIME))
    agg = F.percentile(us, q) if exact else F.percentile_approx(us, q, 100000)
    return float(df.agg(agg.alias("q")).first()["q"])


def split_at(df: DataFrame, split_us: float) -> tuple[DataFrame, DataFrame]:
    """Rows strictly before the split point, and the rest."""
    us = F.unix_micros(F.col(TIME)).cast("double")
    return df.where(us < F.lit(split_us)), df.where(us >= F.lit(split_us))


def quantile_split(df: DataFrame, q: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Time split at the q-quantile of rows."""
    return split_at(df, quantile_split_point(df, q))


def date_split(df: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """``< date`` / ``>= date``."""
    ts = F.to_timestamp(F.lit(date))
    return df.where(F.col(TIME) < ts), df.where(F.col(TIME) >= ts)


def last_n(df: DataFrame, n: int = 24, key: str = KEY, time: str = TIME) -> DataFrame:
    """The last ``n`` rows of each station (top-k per group)."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def with_context(train: DataFrame, test: DataFrame, n: int = 24,
                 limit: int = INTERP_LIMIT) -> DataFrame:
    """``n``-row train tail per station + test, gap-filled again (second pass)."""
    ctx = last_n(train, n).unionByName(test.select(*train.columns))
    return interpolate_station(ctx, limit)


def restrict_to(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Keep rows whose (location, datetime) appears in ``keys`` (semi-join)."""
    return df.join(keys.select(KEY, TIME).distinct(), [KEY, TIME], "left_semi")


def add_target(df: DataFrame, col: str = "pm25", name: str = TARGET, align: str = "reference") -> DataFrame:
    """The next row's value per station.

    In forecasts the features of a future row predict that row itself.  With
    ``align="consistent"`` training does the same: the target is the row's own value
    and the trend starts from the value before it, as it does in a future row.
    """
    if align not in ("reference", "consistent"):
        raise ValueError("align must be reference or consistent")
    if align == "consistent":
        trend = {"pm25_trend_3h": F.col("pm25_lag1") - F.col("pm25_lag3")} if "pm25_trend_3h" in df.columns else {}
        return df.withColumns({name: F.col(col), **trend})
    return df.withColumn(name, F.lead(col, 1).over(Window.partitionBy(KEY).orderBy(TIME)))


def complete_cases(df: DataFrame, cols: list[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Drop rows with a NULL in any required column (others may stay NULL)."""
    return df.na.drop(subset=cols)


def global_position(df: DataFrame, order: tuple[str, str] = (TIME, KEY)) -> DataFrame:
    """Exact 0-based row position under ``ORDER BY time, key`` without a global window."""
    t, k = order
    per_t = df.groupBy(t).agg(F.count(F.lit(1)).alias("_n"))
    offsets = per_t.withColumn(
        "_off", F.sum("_n").over(Window.orderBy(t).rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select(t, F.coalesce("_off", F.lit(0)).alias("_off"))
    inner = F.row_number().over(Window.partitionBy(t).orderBy(k)) - 1
    return (df.join(offsets, t, "left")
            .withColumn("pos", (F.col("_off") + inner).cast("long")).drop("_off"))


@dataclass
class Fold:
    fold: int
    train_end: int     # exclusive position
    val_start: int
    val_end: int       # exclusive


def ts_folds(n: int, splits: int = 5) -> list[Fold]:
    """Expanding-window folds (sklearn ``TimeSeriesSplit`` layout)."""
    m = n // (splits + 1)
    out = []
    for i in range(splits):
        train_end = n - (splits - i) * m
        out.append(Fold(i, train_end, train_end, train_end + m))
    return out


def fold_frames(df_pos: DataFrame, fold: Fold) -> tuple[DataFrame, DataFrame]:
    p = F.col("pos")
    return (df_pos.where(p < fold.train_end),
            df_pos.where((p >= fold.val_start) & (p < fold.val_end)))


def fold_table(df: DataFrame, splits: int = 5) -> DataFrame:
    """Per fold: row counts and time bounds of the train and validation parts."""
    pos = global_position(df)
    n = df.count()
    # the fold bounds are driver constants: one conditional aggregation per fold
    aggs = []
    for f in ts_folds(n, splits):
        p = F.col("pos")
        tr = p < f.train_end
        va = (p >= f.val_start) & (p < f.val_end)
        aggs += [F.sum(tr.cast("long")).alias(f"n_train_{f.fold}"),
                 F.max(F.when(tr, F.col(TIME))).alias(f"train_max_{f.fold}"),
                 F.sum(va.cast("long")).alias(f"n_val_{f.fold}"),
                 F.min(F.when(va, F.col(TIME))).alias(f"val_min_{f.fold}"),
                 F.max(F.when(va, F.col(TIME))).alias(f"val_max_{f.fold}")]
    wide = pos.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(f.fold).alias("fold"),
                 F.col(f"n_train_{f.fold}").alias("n_train"),
                 F.col(f"train_max_{f.fold}").alias("train_max"),
                 F.col(f"n_val_{f.fold}").alias("n_val"),
                 F.col(f"val_min_{f.fold}").alias("val_min"),
                 F.col(f"val_max_{f.fold}").alias("val_max"))
        for f in ts_folds(n, splits)]))
    return wide.select(rows.alias("r")).select("r.*")


def exclude_group(df: DataFrame, group: str, key: str = KEY) -> DataFrame:
    """Training rows without one station (hold-out ablation)."""
    return df.where(F.col(key) != F.lit(group))


def last_valid_history(df: DataFrame, n: int = 12, col: str = "pm25") -> DataFrame:
    """The last ``n`` rows with a non-NULL ``col`` per station."""
    return last_n(df.where(F.col(col).isNotNull()), n)


@dataclass
class PreparedData:
    base: DataFrame
    train: DataFrame            # gap-filled train panel
    test: DataFrame             # gap-filled test panel (after the 24-row context pass)
    split_us: float
    test_rows: DataFrame | None = None      # keys of the test rows, where ``test`` still holds its context


def prepare_panels(base: DataFrame, q: float = 0.75, context: int = 24, materialize: bool = True,
                   keep_context: bool = False) -> PreparedData:
    """T01 + C09/C10 + T03-T05 as the offline job does it.

    With ``keep_context`` the test panel keeps the train rows before it, so that the
    first test rows have their lags; ``drop_context`` removes them after the features.

    The gap-filled train and test panels are the job's hand-off tables; with
    ``materialize`` they are cut with reliable checkpoints, so the feature
    builds, the spatial fit and the test context read them instead of
    re-running the gap filling.
    """
    split_us = quantile_split_point(base, q)
    train_raw, test_raw = split_at(base, split_us)
    train = interpolate_station(train_raw)
    if materialize:
        train = cut_lineage(train)
    test = with_context(train, test_raw, context)
    if not keep_context:
        test = restrict_to(test, test_raw)
    if materialize:
        test = cut_lineage(test)
    return PreparedData(base, train, test, split_us, test_raw.select(KEY, TIME) if keep_context else None)


def drop_context(features: DataFrame, data: PreparedData) -> DataFrame:
    """The rows of ``features`` that are test rows."""
    return features if data.test_rows is None else restrict_to(features, data.test_rows)
