"""Structured Streaming forms of the monitors: windowed counts with late data, dedup within a horizon, relistings."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_EPOCH = datetime.date(1970, 1, 1)
_DAY_MS = 86_400_000
#: The state store that state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def windowed(events: DataFrame, time: str, by: str, size: str = "1 day", late: str = "2 days", value: str = "value") -> DataFrame:
    """Count and sum of a value by time window; a window closes once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def first_seen(events: DataFrame, key: str, time: str, horizon: str = "45 days") -> DataFrame:
    """The first row of each key within the watermark's horizon."""
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def kept_listings(events: DataFrame, key: str, day: str, gap: int = 45) -> DataFrame:
    """(key, kept_day) of a stream of listings: a day is kept if it lies more than gap days after the key's last kept one.

    The state of a key is one date, and no key is ever dropped: for backfills of a bounded list of keys. Days of a key must
    arrive in order, as a feed by day does; a day before the last kept one is a relisting of it. settled_listings() needs neither.
    """
    kind = dict(events.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for d in sorted({x for pdf in frames for x in pdf[day] if x is not None}):
            if last is None or (d - last).days > gap:
                kept.append(d)
                last = d
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), "kept_day": kept})

    return events.select(key, day).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, kept_day date", "last date", "append", GroupStateTimeout.NoTimeout)


class _Listings(StatefulProcessor):
    """A key's days that the watermark has not passed, and its last kept day. A timer on each waiting day decides it; one gap days after
    the last kept day forgets the key, as any later day would be kept without it."""

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "day int")
        self.waiting = handle.getMapState("waiting", "day int", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for d in sorted({(x - _EPOCH).days for x in pdf["day"]}):
                if d * _DAY_MS > passed and not self.waiting.containsKey((d,)):
                    self.waiting.updateValue((d,), (True,))
                    self.handle.registerTimer(d * _DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for d in sorted(k[0] for k in self.waiting.keys()):
            if d * _DAY_MS <= passed:
                self.waiting.removeKey((d,))
                if last is None or d - last > self.gap:
                    kept.append(d)
                    last = d
        if last is not None and (last + self.gap) * _DAY_MS <= passed:
            self.last.clear()
        elif kept:
            self.last.update((last,))
            self.handle.registerTimer((last + self.gap) * _DAY_MS)
        if kept:
            yield pd.DataFrame({self.key: [key[0]] * len(kept), "kept_day": [_EPOCH + datetime.timedelta(d) for d in kept]})

    def close(self) -> None:
        pass


def settled_listings(events: DataFrame, key: str, day: str, gap: int = 45, late: int = 7) -> DataFrame:
    """(key, kept_day) of an endless stream of listings: a day is kept if it lies more than gap days after the key's last kept one.

    Days may arrive in any order, up to late days behind the newest day seen: a day is decided once the watermark has passed
    it, in order, and a day that comes after the watermark is late and ignored. A key is forgotten gap days after its last kept day, so
    state holds the keys of the last gap + late days and no others. Null days and repeated rows count for nothing; a null
    key is a key. Needs the session's state store to be STORE.
    """
    kind = dict(events.dtypes)[key]
    rows = events.select(key, F.col(day).alias("day"), F.col(day).cast("timestamp").alias("_at")).where("day is not null").withWatermark("_at", f"{late} days")
    return rows.groupBy(key).transformWithStateInPandas(_Listings(key, gap), f"{key} {kind}, kept_day date", "Append", "EventTime")
