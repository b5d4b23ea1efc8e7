"""R01 with state: a live hourly panel per station, as the batch would show it up to now.

Readings stream in by station in any order.  The state of a station is a ring: sums and
counts of the last ``HISTORY_HOURS`` hours per pollutant, and the few hours before that
gap filling looks back on.  Each trigger folds new readings into their hours (late ones
correct hours still in the ring), fills gaps by the prefix rule (between two values on a
line, after the last one by repetition, three hours at most) and emits the hours that
the ring can still change.  An event-time timer drops a station that has been silent for
longer than the ring.  The newest version of an hour is its value; the sink keeps one
folder per micro-batch, so a replayed batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from airgrid.schemas import HISTORY_HOURS, INTERP_LIMIT, KEY, MEASUREMENT, POLLUTANTS, TIME

_STATE = "first long, last long, sums array<double>, counts array<long>, late long"
PANEL = (f"{KEY} string, {TIME} timestamp, " + ", ".join(f"{p} double" for p in POLLUTANTS)
         + ", " + ", ".join(f"{p}_filled double" for p in POLLUTANTS) + ", late long")
_HOUR = 3600


def fill_gaps(x: np.ndarray, limit: int = INTERP_LIMIT) -> np.ndarray:
    """A column of hours with NaN gaps: the first ``limit`` hours of each gap are filled, on the line
    to the next value or, behind the last one, by repetition; nothing before the first value."""
    known = np.flatnonzero(~np.isnan(x))
    out = x.copy()
    if not len(known):
        return out
    at = np.arange(len(x))
    before = np.searchsorted(known, at, side="right") - 1
    gap = np.isnan(x) & (before >= 0)
    prev = known[np.maximum(before, 0)]
    gap &= at - prev <= limit
    after = np.minimum(before + 1, len(known) - 1)
    nxt = known[after]
    inner = gap & (nxt > at)
    out[gap] = x[prev[gap]]
    share = (at[inner] - prev[inner]) / (nxt[inner] - prev[inner])
    out[inner] = x[prev[inner]] + (x[nxt[inner]] - x[prev[inner]]) * share
    return out


class Ring:
    """Sums and counts of consecutive hours; ``first`` is the station's first hour, ``last`` the newest."""

    def __init__(self, first: int, last: int, sums: np.ndarray, counts: np.ndarray, late: int):
        self.first, self.last, self.sums, self.counts, self.late = first, last, sums, counts, late

    @staticmethod
    def load(held: tuple) -> "Ring":
        first, last, sums, counts, late = held
        return Ring(first, last, np.array(sums).reshape(-1, len(POLLUTANTS)), np.array(counts, np.int64).reshape(-1, len(POLLUTANTS)), late)

    def dump(self) -> tuple:
        return (int(self.first), int(self.last), self.sums.ravel().tolist(), self.counts.ravel().tolist(), int(self.late))

    @property
    def start(self) -> int:
        return self.last - len(self.sums) + 1

    def fold(self, hour: np.ndarray, column: np.ndarray, value: np.ndarray, hours: int) -> None:
        """Add readings; hours that have left the ring are counted as late and change nothing."""
        size = hours + INTERP_LIMIT
        floor = max(self.first, self.last - hours + 1) if len(self.sums) >= size else min(self.first, int(hour.min()))
        floor = max(floor, self.last - hours + 1)
        keep = hour >= floor
        self.late += int((~keep).sum())
        hour, column, value = hour[keep], column[keep], value[keep]
        if not len(hour):
            return
        self.first = min(self.first, int(hour.min()))
        lo, hi = min(self.start, int(hour.min())), max(self.last, int(hour.max()))
        sums, counts = np.zeros((hi - lo + 1, len(POLLUTANTS))), np.zeros((hi - lo + 1, len(POLLUTANTS)), np.int64)
        at = self.start - lo
        sums[at:at + len(self.sums)], counts[at:at + len(self.sums)] = self.sums, self.counts
        real = column >= 0
        np.add.at(sums, (hour[real] - lo, column[real]), value[real])
        np.add.at(counts, (hour[real] - lo, column[real]), 1)
        self.sums, self.counts, self.last = sums, counts, hi

    def panel(self, since: int) -> pd.DataFrame:
        """Hours from ``since`` on, raw and filled."""
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(self.counts > 0, self.sums / self.counts, np.nan)
        out = {TIME: pd.to_datetime((self.start + np.arange(len(mean))) * _HOUR, unit="s")}
        out |= {p: mean[:, j] for j, p in enumerate(POLLUTANTS)}
        out |= {f"{p}_filled": fill_gaps(mean[:, j]) for j, p in enumerate(POLLUTANTS)}
        hours = self.start + np.arange(len(mean))
        return pd.DataFrame(out)[hours >= max(since, self.first)]

    def trim(self, hours: int) -> None:
        size = hours + INTERP_LIMIT
        self.sums, self.counts = self.sums[-size:], self.counts[-size:]


def _update(hours: int):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(frames))
        new = new[new[TIME].notna()]
        if new.empty:
            return
        hour = new[TIME].to_numpy().astype("datetime64[s]").astype(np.int64) // _HOUR
        place = {p: j for j, p in enumerate(POLLUTANTS)}
        value = new["value"].to_numpy(dtype="float64", na_value=np.nan)
        column = new["parameter"].map(place).fillna(-1).to_numpy(dtype=np.int64)
        column = np.where(value >= 0, column, -1)                    # the -1 sentinel and NaN are no values
        if state.exists:
            ring = Ring.load(state.get)
            since = ring.last - hours + 1
        else:
            empty = np.empty((0, len(POLLUTANTS)))
            top = int(hour.max())
            ring, since = Ring(int(hour.min()), top, np.zeros((1, empty.shape[1])), np.zeros((1, empty.shape[1]), np.int64), 0), -(1 << 62)
            ring.first, ring.last = top, top
            ring.fold(np.arange(int(hour.min()), top + 1), np.full(top - int(hour.min()) + 1, -1), np.zeros(top - int(hour.min()) + 1), 1 << 40)
        ring.fold(hour, column, value, hours if state.exists else 1 << 40)
        out = ring.panel(since)
        ring.trim(hours)
        state.update(ring.dump())
        state.setTimeoutTimestamp(max((int(ring.last) + hours + 1) * _HOUR * 1000, state.getCurrentWatermarkMs() + 1))
        yield out.assign(**{KEY: key[0], "late": ring.late})[[KEY, *out.columns, "late"]]
    return update


def live_panel(stream: DataFrame, hours: int = HISTORY_HOURS) -> DataFrame:
    """Changed hours of every station: hourly means (NULL: no reading) and their filled values.

    Readings without a time are left out, negative values and unknown parameters count
    as no value but extend the hours; readings older than ``hours`` before a station's
    newest hour are only counted (``late``).
    """
    readings = stream.select(KEY, F.col(TIME).cast("timestamp").alias(TIME), "parameter", "value")
    return (readings.withWatermark(TIME, f"{hours} hours").groupBy(KEY)
            .applyInPandasWithState(_update(hours), PANEL, _STATE, "update", GroupStateTimeout.EventTimeTimeout))


def run_live(spark: SparkSession, source: str, sink: str, checkpoint: str, hours: int = HISTORY_HOURS,
             files_per_trigger: int | None = None, available_now: bool = True):
    """Start the stream; with ``available_now`` it processes what has landed and stops."""
    reader = spark.readStream.schema(MEASUREMENT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def write_batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    w = (live_panel(reader.parquet(source), hours).writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")).start()
    if available_now:
        q.awaitTermination()
    return q


def read_live(spark: SparkSession, sink: str) -> DataFrame:
    """The newest version of every station and hour."""
    raw = spark.read.parquet(sink)
    cols = [c for c in raw.columns if c not in (KEY, TIME, "batch_id", "late")]
    latest = raw.groupBy(KEY, TIME).agg(F.max_by(F.struct(*cols), "batch_id").alias("r"))
    return latest.select(KEY, TIME, "r.*")
