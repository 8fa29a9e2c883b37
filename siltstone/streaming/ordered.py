"""Keyed state that sees its rows in order of event time, however the stream cuts them into batches.

Rows wait in the state until the watermark has passed them; a timer then takes them out.  The few
rows of a small key wait in one value beside its state, read and written once a batch; those of a
larger one wait in slots of time and are taken out slot by slot, so memory holds one slot of one
key.  What becomes due by the clock
(an expired lease, a wait that is over) happens between rows, at its own time.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InTimeOrder(StatefulProcessor):
    """Subclasses fold rows (time in microseconds first) into a state that JSON can hold, and tell what comes out.

    Rows of one time are taken in the order of their other columns; what is due at a row's time comes first.
    """

    columns: tuple[str, ...] = ()
    out: tuple[str, ...] = ()
    slot_us = 3_600_000_000
    #: So many rows of a key wait beside its state.
    near = 1_000

    def start(self) -> dict:
        return {}

    def on_row(self, state: dict, row: list) -> list[tuple]:
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        """When the clock alone changes the state next."""

    def on_due(self, state: dict, at: int) -> list[tuple]:
        return []

    def over(self, state: dict, now: int) -> bool:
        """Whether the state can be forgotten while no rows wait."""
        return False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string")
        self.pending = handle.getMapState("pending", "slot bigint", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, near, far = self._held()
        first = None
        for frame in rows:
            for row in zip(*(frame[c].tolist() for c in self.columns), strict=True):
                row = [None if v is None or v != v else v for v in row]
                near.append(row)
                first = row[0] if first is None else min(first, row[0])
            if far or len(near) > self.near:
                far = True
                self._into_slots(near)
                near = []
        if first is not None:
            self.state.update((json.dumps([state, near, far]),))
            self._wake(first, timerValues)
        return iter(())

    def _held(self) -> tuple[dict, list, bool]:
        """The key's state, the rows that wait beside it, and whether others wait in slots."""
        held = self.state.get()
        return tuple(json.loads(held[0])) if held is not None else (self.start(), [], False)

    def _into_slots(self, rows: list[list]) -> None:
        slots = defaultdict(list)
        for row in rows:
            slots[row[0] // self.slot_us].append(row)
        for slot, new in slots.items():
            held = json.loads(self.pending.getValue((slot,))[0]) if self.pending.containsKey((slot,)) else []
            self.pending.updateValue((slot,), (json.dumps(held + new),))

    def _take(self, state: dict, rows: list[list], now: int) -> tuple[list[tuple], list[list]]:
        """What comes out of the rows up to now, and the rows after it."""
        rows, told = sorted(rows, key=lambda r: [(v is not None, v) for v in r]), []
        for i, row in enumerate(rows):
            if row[0] > now:
                return told, rows[i:]
            told += self._until(state, row[0])
            told += self.on_row(state, row)
        return told, []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state, near, far = self._held()
        then = None
        told, near = self._take(state, near, now)
        if near:
            then = near[0][0]
        waiting = sorted(k[0] for k in self.pending.keys()) if far else []
        for slot in waiting:
            if slot * self.slot_us > now:
                then = slot * self.slot_us
                break
            more, later = self._take(state, json.loads(self.pending.getValue((slot,))[0]), now)
            told += more
            if later:
                self.pending.updateValue((slot,), (json.dumps(later),))
                then = later[0][0]
            else:
                self.pending.removeKey((slot,))
            if told:
                yield self._frame(key, told)
                told = []
            if later:
                break
        told += self._until(state, now)
        if told:
            yield self._frame(key, told)
        alarm = self.due(state)
        if then is None and alarm is None and self.over(state, now):
            self.state.clear()
        else:
            self.state.update((json.dumps([state, near, far and then is not None]),))
        wake = min((t for t in (then, alarm) if t is not None), default=None)
        if wake is not None:
            self._wake(wake, timerValues)

    def _until(self, state: dict, now: int) -> list[tuple]:
        told = []
        while (at := self.due(state)) is not None and at <= now:
            told += self.on_due(state, at)
        return told

    def _wake(self, at: int, timerValues) -> None:
        # in whole milliseconds, when the time has surely passed
        self.handle.registerTimer(max(-(-at // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def _frame(self, key, told: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *t) for t in told], columns=list(self.out))

    def close(self) -> None:
        pass


def in_time_order(events: DataFrame, time: str, key: str, processor: InTimeOrder, schema: str, lateness: str) -> DataFrame:
    """Applies a processor to each key's rows; its first column is the time in microseconds, made from ``time``.

    Rows without a time or key are left out, as neither has a place in an order.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    others = [c for c in processor.columns if c != "us"]
    # a millisecond later, so that a row at the watermark itself is not late
    timed = events.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(key, micros.alias("us"), *others, (F.col(time).cast("timestamp") + F.expr("INTERVAL 1 MILLISECOND")).alias("__due"))
    return timed.withWatermark("__due", lateness).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Streams that start within keep their state in RocksDB, which timers need."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, old)
