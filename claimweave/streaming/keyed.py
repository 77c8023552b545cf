"""Streams with a state per key that follows event time: rows wait for the watermark, so their order of arrival does not matter.

A key holds the rows that the watermark has not passed, in a list, and one timer for the earliest of them.  When
it fires, the rows up to the watermark leave in order of time and id.  A row behind the watermark on arrival is late and
dropped by Spark.  What a key remembers beyond its waiting rows ends by a timer too, so a key that falls silent leaves no
state.  Waiting rows of a key are bounded by the watermark's delay.

These jobs need the RocksDB state store (``use_keyed_state``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import users


# The driver starts a helper process for such streams that need not have this package on its path, so processors travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def use_keyed_state(spark: SparkSession) -> None:
    """Set the state store that keyed state needs, for the session's later streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Rows of a key handed to `follow` in order of time and id once the watermark has passed them.

    waiting is the DDL of the rows, whose first columns are t (milliseconds) and id; memory the DDL of what is
    remembered of those that left.  Subclasses give `follow` and `until`.
    """

    waiting: str
    memory: str

    def follow(self, key: tuple, rows: list[tuple], held: tuple | None) -> tuple[list[tuple], tuple | None]:
        """What the rows give, and what is remembered after them."""
        raise NotImplementedError

    def until(self, held: tuple) -> int:
        """The time (milliseconds) from which the memory decides nothing."""
        raise NotImplementedError

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.waiting)
        self.held = handle.getValueState("held", self.memory)

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        came = [tuple(None if pd.isna(v) else v for v in r) for f in rows for r in f[self.columns].itertuples(index=False)]
        if came:
            self.rows.appendList([(int(t), *rest) for t, *rest in came])
            self._wake(min(int(r[0]) for r in came))
        return iter([])

    def _wake(self, at: int) -> None:
        """One timer a key: the earliest of what is asked."""
        set_ = list(self.handle.listTimers())
        if not set_ or at < min(set_):
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.rows.get())
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        held = tuple(self.held.get()) if self.held.exists() else None
        out, held = self.follow(key, due, held)
        self.rows.clear()
        if later:
            self.rows.put(later)
        if held is not None and self.until(held) <= now:
            held = None
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
        nexts = [later[0][0]] if later else []
        nexts += [self.until(held)] if held is not None else []
        # This timer is gone once it has been handled, and it was the key's only one.
        if nexts:
            self.handle.registerTimer(max(min(nexts), now + 1))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class Throttle(Ordered):
    """Accepts a row if none was accepted in the `milliseconds` before."""

    waiting, memory, names = "t long, id long", "free long", ["key", "t", "id"]

    def __init__(self, milliseconds: int):
        super().__init__(["t", "id"])
        self.milliseconds = milliseconds

    def follow(self, key, rows, held):
        free, out = held[0] if held else None, []
        for t, i in rows:
            # Of one time only the smallest id is first, so that it alone can be accepted.
            if free is None or t >= free:
                out.append((key[0], t, i))
                free = t + self.milliseconds
        return out, None if free is None else (free,)

    def until(self, held):
        return held[0]


class Drift(Ordered):
    """Numbers a user's rows and compares each with the one before."""

    waiting, memory = "t long, id long, score int, zone string", "t long, step int, score int, zone string"
    names = ["user_id", "id", "step", "score", "delta", "trend", "zone_changed"]

    def __init__(self, idle: int):
        super().__init__(["t", "id", "score", "zone"])
        self.idle = idle

    def follow(self, key, rows, held):
        out = []
        at, step, score, zone = held or (0, 0, None, None)
        for t, i, now, place in rows:
            delta, step = None if score is None else now - score, step + 1
            trend = "improving" if delta is not None and delta > 2 else "worsening" if delta is not None and delta < -2 else "steady"
            out.append((key[0], i, step, now, delta, trend, zone is not None and zone != place))
            at, score, zone = t, now, place
        return out, (at, step, score, zone) if step else None

    def until(self, held):
        return held[0] + self.idle


class Expiry(StatefulProcessor):
    """Tells of a key once nothing was saved for it for so long."""

    def __init__(self, milliseconds: int):
        self.milliseconds = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("saved", "t long")

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        latest = max((int(f["t"].max()) for f in rows if len(f)), default=None)
        before = self.saved.get()[0] if self.saved.exists() else None
        if latest is not None and (before is None or latest > before):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.saved.update((latest,))
            self.handle.registerTimer(latest + self.milliseconds)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        saved = self.saved.get()[0]
        self.saved.clear()
        yield pd.DataFrame([(key[0], saved, saved + self.milliseconds)], columns=["user_id", "saved", "expired"])

    def close(self) -> None:
        pass


def _millis(column: str):
    return F.unix_millis(F.col(column)).alias("t")


def throttle_stream(snapshots: DataFrame, seconds: int = 300, delay: str = "1 hour") -> DataFrame:
    """Snapshots (key, ts, id) accepted per key: `seconds` or more after the last accepted one; those without a time all are.

    Equal to users.throttle over all rows that are no later than `delay` behind the latest: a whole second counts as one time.
    A key's state ends `seconds` after its last accepted row.
    """
    seen = snapshots.select("key", F.date_trunc("second", "ts").alias("ts"), F.col("id").cast("bigint").alias("id"))
    timed = seen.where(F.col("ts").isNotNull()).withWatermark("ts", delay).select("key", "ts", "id", _millis("ts"))
    kind = snapshots.schema["key"].dataType.simpleString()
    kept = timed.groupBy("key").transformWithStateInPandas(Throttle(1000 * seconds), f"key {kind}, t long, id long", "append", "eventTime")
    return kept.select("key", F.timestamp_millis("t").alias("ts"), "id").unionByName(seen.where(F.col("ts").isNull()))


def trajectory_stream(snapshots: DataFrame, delay: str = "1 hour", idle_days: int = 400) -> DataFrame:
    """Snapshots (user_id, ts, id, y) with their number, score and change against the user's one before; without a place they do not count.

    Equal to users.drift over all rows that are no later than `delay` behind the latest.  A user who has had no snapshot for
    `idle_days` starts anew.
    """
    rows = snapshots.where(F.col("y").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    rows = rows.select("user_id", "ts", _millis("ts"), F.col("id").cast("bigint").alias("id"), users.health_score(F.col("y")).alias("score"), users.zone(F.col("y")).alias("zone"))
    kind = snapshots.schema["user_id"].dataType.simpleString()
    out = f"user_id {kind}, id long, step int, score int, delta int, trend string, zone_changed boolean"
    return rows.groupBy("user_id").transformWithStateInPandas(Drift(idle_days * 86_400_000), out, "append", "eventTime")


def expiry_stream(contexts: DataFrame, days: int = 30, delay: str = "1 hour") -> DataFrame:
    """user_id, saved, expired: contexts (user_id, ts) that were not saved again for `days`, as the watermark passes that time."""
    rows = contexts.where(F.col("ts").isNotNull()).withWatermark("ts", delay).select("user_id", "ts", _millis("ts"))
    kind = contexts.schema["user_id"].dataType.simpleString()
    gone = rows.groupBy("user_id").transformWithStateInPandas(Expiry(days * 86_400_000), f"user_id {kind}, saved long, expired long", "append", "eventTime")
    return gone.select("user_id", F.timestamp_millis("saved").alias("saved"), F.timestamp_millis("expired").alias("expired"))
