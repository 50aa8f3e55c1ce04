"""Keyed state of streams: quotas that deny, and phases with a cursor and a gap, told in the order of event time.

What is decided for a request depends on those before it, and a stream brings them in any order. So rows wait in their key's state until the watermark has
passed them, then they are told in order of time and key, as the batch forms (writes.admit, lifecycle.phase_updates) tell them; a timer wakes a key for its
earliest row. Both forms agree on all rows that come within the lateness; the engine drops what comes later than that. A key's state holds the rows of
the lateness at most, and a few numbers. State of this kind needs the RocksDB provider (PROVIDER) in the session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.lifecycle import QUOTAS, next_phase, phase_waits
from ..operators.writes import quota_end, quota_start

#: Session setting and value that keyed state needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them. A row is (at, key, ...), at in microseconds; `fields` is its schema."""

    def __init__(self, fields: str, names: tuple[str, ...], told: str, out: tuple[str, ...]) -> None:
        self.fields, self.names, self.schema, self.out = fields, names, told, Row(*out)

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.told = handle.getValueState("told", self.schema)
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int) -> None:
        """One timer for a key, at its earliest millisecond."""
        held = self.timer.get()
        if held is None or at < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        new = [tuple(r[c] for c in self.names) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(-(-r[0] // 1000) for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        rows = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in rows if r[0] <= passed * 1000), key=lambda r: (r[0], r[1] is not None, r[1]))
        rest = [r for r in rows if r[0] > passed * 1000]
        state = self.told.get()
        for r in due:
            state, out = self.step(key, None if state is None else tuple(state), r)
            yield self.out(*key, *out)
        if due:
            self.told.update(state)
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self._wake(min(-(-r[0] // 1000) for r in rest))
        elif (until := self.until(key)) is not None:
            if until <= passed:
                self.told.clear()
            else:
                self._wake(until)

    def step(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        """(state after the row, what is told of it)."""
        raise NotImplementedError

    def until(self, key: tuple) -> int | None:
        """The millisecond after which a key's state is of no more use; none: kept."""
        return None


class Quota(InOrder):
    """Key (ns, kind, start, end): the first `limit` requests of a window are admitted; denied ones don't count."""

    def __init__(self, limits: dict[str, int], key_type: str) -> None:
        super().__init__(f"at long, key {key_type}", ("at", "key"), "n long", ("ns", "kind", "start", "end", "at", "key", "admitted"))
        self.limits = limits

    def step(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        n = state[0] if state else 0
        admitted = n < self.limits[key[1]]
        return (n + admitted,), (*row, admitted)

    def until(self, key: tuple) -> int | None:
        return key[3] // 1000


class Phase(InOrder):
    """Key (phase, ns): an update counts if its cursor advances and its phase's gap since the last one that counted is over."""

    def __init__(self, waits: dict[str, int], key_type: str, cursor_type: str) -> None:
        super().__init__(f"at long, key {key_type}, cursor {cursor_type}, items long", ("at", "key", "cursor", "items"), f"at long, cursor {cursor_type}, runs long, items long", ("phase", "ns", "at", "key", "told", "cursor", "runs", "items"))
        self.waits = waits

    def step(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        state, told = next_phase(state, row[0], row[2], row[3], phase_waits(self.waits, key[0]))
        return state, (*row[:2], told, *state[1:])


def _ready(rows: DataFrame) -> None:
    if rows.sparkSession.conf.get(PROVIDER[0], "") != PROVIDER[1]:
        raise ValueError(f"set {PROVIDER[0]} to {PROVIDER[1]}")


def _type(rows: DataFrame, name: str) -> str:
    return rows.schema[name].dataType.simpleString()


def _time(at: str | Column) -> Column:
    return F.timestamp_micros(at)


def admit(requests: DataFrame, limits: dict[str, int] = QUOTAS, late: str = "5 minutes") -> DataFrame:
    """A stream of requests(ns, kind, ts, key) with admitted and retry_after, the seconds to the end of the window of a denied one.

    Equals writes.admit over the same rows. Requests of a kind without a limit pass at once. A window's count goes when the watermark passes its end.
    Rows without ns or key count like others; those without ts are dropped, as no watermark passes them.
    """
    _ready(requests)
    rows = requests.select("ns", "kind", F.col("ts").cast("timestamp").alias("ts"), "key").filter("ts is not null").withWatermark("ts", late)
    bound = F.coalesce(F.col("kind").isin(*limits), F.lit(False)) if limits else F.lit(False)
    held = rows.filter(bound).select("ns", "kind", F.unix_micros(quota_start()).alias("start"), F.unix_micros(quota_end()).alias("end"), "ts", F.unix_micros("ts").alias("at"), "key")
    out = f"ns {_type(requests, 'ns')}, kind string, start long, end long, at long, key {_type(requests, 'key')}, admitted boolean"
    told = held.groupBy("ns", "kind", "start", "end").transformWithState(Quota(limits, _type(requests, "key")), out, "append", "EventTime")
    wait = F.when(~F.col("admitted"), F.floor(F.col("end") / 1_000_000) - F.floor(F.col("at") / 1_000_000)).otherwise(F.lit(0))
    told = told.select("ns", "kind", _time("at").alias("ts"), "key", "admitted", wait.cast("long").alias("retry_after"))
    return told.unionByName(rows.filter(~bound).select("ns", "kind", "ts", "key", F.lit(True).alias("admitted"), F.lit(0).cast("long").alias("retry_after")))


def phase_updates(updates: DataFrame, waits: dict[str, int] | None = None, late: str = "5 minutes") -> DataFrame:
    """A stream of updates(phase, ns, ts, key, cursor, items) with what lifecycle.phase_updates tells of each.

    State is a row for each phase and namespace and stays, as their cursor does.
    """
    _ready(updates)
    rows = updates.select("phase", "ns", F.col("ts").cast("timestamp").alias("ts"), "key", "cursor", F.col("items").cast("long").alias("items")).filter("ts is not null").withWatermark("ts", late)
    held = rows.withColumn("at", F.unix_micros("ts"))
    key, cursor = _type(updates, "key"), _type(updates, "cursor")
    out = f"phase string, ns {_type(updates, 'ns')}, at long, key {key}, told string, cursor {cursor}, runs long, items long"
    told = held.groupBy("phase", "ns").transformWithState(Phase(waits or {}, key, cursor), out, "append", "EventTime")
    return told.select("phase", "ns", _time("at").alias("ts"), "key", "told", "cursor", "runs", "items")
