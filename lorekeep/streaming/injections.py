"""The retrieval log over a stream: pending injections are state, turns stamp them, timers end their grace.

A session's state is its open injections. A later injection demotes them, the next turn within the grace stamps and drops them, and
the timer of each ends its wait. Timers and checkpoints are the state store's, so a restart goes on where the stream stopped
and emits nothing again. Needs the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorekeep.operators.injections import GRACE_HOURS

STAMPED = "session string, id long, memory long, injected boolean, turn long, state string"
OPEN = "id long, memory long, us long, injected boolean"


def _processor(grace: int) -> StatefulProcessor:
    class Stamps(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getListState("open", OPEN)

        def _rows(self, key, rows, turn, state) -> Iterator[Row]:
            for r in rows:
                yield Row(session=key[0], id=r[0], memory=r[1], injected=r[3], turn=turn, state=state)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            waiting = [tuple(r) for r in self.open.get()]
            for r in sorted(rows, key=lambda r: (r.us, r.id)):  # of one trigger
                over = [w for w in waiting if w[2] + grace < r.us]
                yield from self._rows(key, over, None, "expired")
                waiting = [w for w in waiting if w[2] + grace >= r.us]
                if r.kind == "turn":
                    yield from self._rows(key, waiting, r.id, "stamped")
                    waiting = []
                else:
                    waiting = [(*w[:3], False) for w in waiting] + [(r.id, r.memory, r.us, True)]
            self._keep(waiting)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            now = timerValues.getCurrentWatermarkInMs() * 1000
            waiting = [tuple(r) for r in self.open.get()]
            yield from self._rows(key, [w for w in waiting if w[2] + grace < now], None, "expired")
            self._keep([w for w in waiting if w[2] + grace >= now])

        def _keep(self, waiting) -> None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if waiting:
                self.open.put(waiting)
                self.handle.registerTimer((min(w[2] for w in waiting) + grace) // 1000 + 1)
            else:
                self.open.clear()

        def close(self) -> None:
            pass

    return Stamps()


def stamped_stream(log: DataFrame, *, grace_hours: float = GRACE_HOURS, late: str = "10 minutes") -> DataFrame:
    """session, id, memory, injected, turn and state (stamped or expired) of the injections of a stream (session, at, id, kind, memory), in append mode."""
    rows = log.where(F.col("kind").isin("inject", "turn")).withWatermark("at", late)
    rows = rows.select(F.col("session").cast("string").alias("session"), "at", F.unix_micros("at").alias("us"), F.col("id").cast("long").alias("id"), "kind", F.col("memory").cast("long").alias("memory"))
    return rows.groupBy("session").transformWithState(
        statefulProcessor=_processor(int(grace_hours * 3600e6)), outputStructType=STAMPED, outputMode="Append", timeMode="EventTime"
    )
