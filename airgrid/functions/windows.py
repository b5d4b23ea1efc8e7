"""Window specs and full-frame guarded rolling aggregates.

Every per-station window shares one spec (partition by station, order by time),
so Catalyst plans one Exchange + Sort for all of them.  After the hourly grid is
built a station holds at most one row per hour, so a station partition is
bounded by the length of the series, not by the raw reading volume.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from airgrid.schemas import KEY, TIME


def station_window(key: str | None = KEY, time: str = TIME) -> WindowSpec:
    """``partitionBy(key).orderBy(time)``; ``key=None`` only for one-row-per-hour tables."""
    if key is None:
        return Window.orderBy(time)
    return Window.partitionBy(key).orderBy(time)


def _prev(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-n, -1)


def rolling_mean_prev(col: str | Column, n: int, w: WindowSpec) -> Column:
    """Mean of the previous ``n`` rows; NULL unless all ``n`` exist and are non-NULL.

    Equals pandas ``rolling(n).mean().shift(1)`` within a group.
    """
    c = F.col(col) if isinstance(col, str) else col
    f = _prev(w, n)
    return F.when(F.count(c).over(f) == n, F.avg(c).over(f))


def rolling_std_prev(col: str | Column, n: int, w: WindowSpec) -> Column:
    """Sample standard deviation (ddof 1) of the previous ``n`` rows, full frame only."""
    c = F.col(col) if isinstance(col, str) else col
    f = _prev(w, n)
    return F.when(F.count(c).over(f) == n, F.stddev_samp(c).over(f))


def rolling_sum_prev_rows(col: str | Column, n: int, w: WindowSpec) -> Column:
    """Sum of the previous ``n`` rows of a never-NULL column; NULL until ``n`` rows exist."""
    c = F.col(col) if isinstance(col, str) else col
    f = _prev(w, n)
    return F.when(F.count(F.lit(1)).over(f) == n, F.sum(c).over(f))


def diff(col: str, k: int, w: WindowSpec) -> Column:
    """``x - x[k rows earlier]`` (pandas ``diff(k)``)."""
    return F.col(col) - F.lag(col, k).over(w)


CHUNK = "_chunk"
HALO = "_halo"


def with_time_chunks(df: DataFrame, chunk_hours: int, halo: int, time: str = TIME) -> DataFrame:
    """Split each station's series into ``chunk_hours`` blocks plus a ``halo``-hour copy.

    Rows in the last ``halo`` hours of a block are also emitted into the next
    block (flagged ``_halo``), so a window partitioned by (station, block) sees
    the ``halo`` rows before every row it owns.  On a gap-free hourly panel a
    look-back of ``halo`` rows equals ``halo`` hours, so backward-looking window
    features computed per block equal the per-station ones, while one hot
    station is spread over many tasks.  Only ``halo / chunk_hours`` of the rows
    are duplicated.
    """
    h = F.floor(F.unix_seconds(F.col(time)) / 3600)
    c = F.floor(h / chunk_hours)
    tag = lambda chunk, halo_row: F.struct(chunk.cast("long").alias(CHUNK), F.lit(halo_row).alias(HALO))
    late = h - c * chunk_hours >= chunk_hours - halo
    tags = F.when(late, F.array(tag(c, False), tag(c + 1, True))).otherwise(F.array(tag(c, False)))
    # one explode, so that the frame is read once
    return df.withColumn("_tag", F.explode(tags)).select(*df.columns, "_tag.*")


def chunk_window(key: str = KEY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(key, CHUNK).orderBy(time)


def with_position_chunks(df: DataFrame, chunk_rows: int, halo: int, key: str = KEY, time: str = TIME,
                         block_hours: int = 720) -> DataFrame:
    """Split each station's rows into ``chunk_rows`` consecutive rows plus a ``halo``-row copy of those before.

    Positions count rows, not hours, so they serve where rows are missing: rows are
    numbered inside time blocks, and the counts of the blocks before (one row per
    station and block) give the offset.  Owned rows have ``_halo`` false.
    """
    part = F.floor(F.unix_seconds(F.col(time)) / (3600 * block_hours))
    rows = df.withColumn("_part", part)
    starts = (rows.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_skip", F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_in").rowsBetween(
                  Window.unboundedPreceding, -1)), F.lit(0))).drop("_n"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(time)) - 1
    placed = (rows.withColumn("_at", inside).join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in")))
              .withColumn("_pos", F.col("_skip") + F.col("_at")))
    c = F.floor(F.col("_pos") / chunk_rows)
    tag = lambda chunk, halo_row: F.struct(chunk.cast("long").alias(CHUNK), F.lit(halo_row).alias(HALO))
    late = F.col("_pos") - c * chunk_rows >= chunk_rows - halo
    tags = F.when(late, F.array(tag(c, False), tag(c + 1, True))).otherwise(F.array(tag(c, False)))
    return placed.withColumn("_tag", F.explode(tags)).select(*df.columns, "_tag.*")
