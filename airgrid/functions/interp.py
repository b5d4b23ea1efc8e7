"""Position-linear gap filling with a forward limit, as window expressions.

For every row ``rn`` of a group, with ``(pi, px)`` the last non-NULL position and
value at or before it and ``(ni, nx)`` the first non-NULL position and value at
or after it:

* the value itself if present;
* NULL if there is no earlier value or the gap is already longer than ``limit``;
* ``px`` when no later value exists (a trailing gap repeats the last value);
* ``px + (nx - px) * (rn - pi) / (ni - pi)`` otherwise.

This is pandas ``interpolate(limit=limit, limit_direction="forward")`` on
equally spaced rows.  Interior gaps are drawn toward the *next* valid reading,
so a filled value uses data after it (kept on purpose for the training panel;
backtests use prefix-only views instead).  With ``fill="forward"`` a gap repeats its
last value, so no filled value looks ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from airgrid.functions.windows import station_window
from airgrid.schemas import INTERP_LIMIT, KEY, TIME

_RN = "_rn"


def _reverse(w_key: str | None, time: str) -> WindowSpec:
    """Running frame over the descending order: "first at or after" in O(n).

    (A ``rowsBetween(0, unboundedFollowing)`` frame is re-aggregated for every
    row, which is quadratic in the series length.)
    """
    w = Window.partitionBy(w_key) if w_key else Window
    return w.orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)


def _parts(c: str, w: WindowSpec, key: str | None = KEY,
           time: str = TIME) -> tuple[Column, Column, Column, Column]:
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = _reverse(key, time)
    x = F.col(c)
    pos = F.when(x.isNotNull(), F.col(_RN))
    pi = F.last(pos, ignorenulls=True).over(back)
    px = F.last(x, ignorenulls=True).over(back)
    ni = F.last(pos, ignorenulls=True).over(ahead)
    nx = F.last(x, ignorenulls=True).over(ahead)
    return pi, px, ni, nx


def fill_expr(c: str, pi: Column, px: Column, ni: Column, nx: Column,
              limit: int = INTERP_LIMIT, fill: str = "linear", at: str = _RN) -> Column:
    if fill not in ("linear", "forward"):
        raise ValueError("fill must be linear or forward")
    rn = F.col(at)
    x = F.col(c)
    out = F.when(x.isNotNull(), x).when(pi.isNull() | ((rn - pi) > limit), F.lit(None).cast("double"))
    if fill == "forward":
        return out.otherwise(px)
    return out.when(ni.isNull(), px).otherwise(px + (nx - px) * (rn - pi) / (ni - pi))


def interpolate(df: DataFrame, cols: list[str], key: str | None = KEY,
                time: str = TIME, limit: int = INTERP_LIMIT, fill: str = "linear") -> DataFrame:
    """Fill ``cols`` in place per ``key`` group (``key=None``: one global order).

    ``key=None`` is meant for tables with one row per hour (the weather grid);
    never use it on the per-station fact table.
    """
    w = station_window(key, time)
    out = df.withColumn(_RN, F.row_number().over(w))
    filled = {}
    for c in cols:
        pi, px, ni, nx = _parts(c, w, key, time)
        filled[c] = fill_expr(c, pi, px, ni, nx, limit, fill)
    return out.withColumns(filled).drop(_RN)


def interpolation_state(df: DataFrame, cols: list[str], key: str | None = KEY,
                        time: str = TIME, limit: int = INTERP_LIMIT) -> DataFrame:
    """Adds ``_rn`` and, per column, ``{c}_pi, _px, _ni, _filled`` (prefix-only views)."""
    w = station_window(key, time)
    out = df.withColumn(_RN, F.row_number().over(w))
    add = {}
    for c in cols:
        pi, px, ni, nx = _parts(c, w, key, time)
        add.update({f"{c}_pi": pi, f"{c}_px": px, f"{c}_ni": ni,
                    f"{c}_filled": fill_expr(c, pi, px, ni, nx, limit)})
    return out.withColumns(add)


def interpolate_chunked(df: DataFrame, cols: list[str], chunk_hours: int, key: str = KEY,
                        time: str = TIME, limit: int = INTERP_LIMIT, fill: str = "linear") -> DataFrame:
    """The same fill on (station, time block) partitions, for a gap-free hourly panel.

    Row positions are hour indices.  The backward part needs the previous valid
    value within ``limit`` rows, so each block gets a ``limit``-hour halo from
    the block before.  The next valid value may lie in a later block: every
    block's first valid (hour, value) is taken per column, and the nearest later
    one is carried back with a window over the small (station, block) table.
    A station with a very long or dense series is thus spread over many tasks.
    """
    from airgrid.functions.windows import CHUNK, HALO, with_time_chunks
    hour = F.floor(F.unix_seconds(F.col(time)) / 3600).cast("long")
    ch = with_time_chunks(df.withColumn("_h", hour), chunk_hours, limit, time)
    own = ch.where(~F.col(HALO))
    firsts = own.groupBy(key, CHUNK).agg(*[
        F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("_h").alias("h"), F.col(c).alias("x"))))
        .alias(f"_f_{c}") for c in cols])
    later = Window.partitionBy(key).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select(key, CHUNK, *[F.last(f"_f_{c}", ignorenulls=True).over(later).alias(f"_a_{c}")
                                        for c in cols])
    j = ch.join(after, [key, CHUNK], "left")
    w = Window.partitionBy(key, CHUNK).orderBy(time)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key, CHUNK).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = F.col("_h")
    filled = {}
    for c in cols:
        x = F.col(c)
        pos = F.when(x.isNotNull(), h)
        pi = F.last(pos, ignorenulls=True).over(back)
        px = F.last(x, ignorenulls=True).over(back)
        ni = F.coalesce(F.last(pos, ignorenulls=True).over(ahead), F.col(f"_a_{c}.h"))
        nx = F.coalesce(F.last(x, ignorenulls=True).over(ahead), F.col(f"_a_{c}.x"))
        filled[c] = fill_expr(c, pi, px, ni, nx, limit, fill, "_h")
    out = j.withColumns(filled).where(~F.col(HALO))
    return out.select(*df.columns)
