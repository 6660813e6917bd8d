"""Streaming twins: sessions that close by gap, cap, terminal outcome or end marker, and idempotent drains.

State is kept for open runs only and is dropped when a run closes, by event-time timeout where no closing
row comes. The batch operators in ``operators.sessions`` give the same runs over stored logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.operators.sessions import GAP_SECONDS, MAX_TURNS, TERMINAL

CLOSED = "session_id string, started timestamp, ended timestamp, n_turns long, outcome string"
STATE = "started double, ended double, n_turns long, outcome string"


def closed_runs(rows: DataFrame, *, gap_s: int = GAP_SECONDS, max_turns: int = MAX_TURNS, late: str = "10 minutes") -> DataFrame:
    """Closed runs of a stream with (session_id, created_at, outcome), in append mode."""

    def step(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        out = []
        start, end, n, last = state.get if state.exists else (0.0, 0.0, 0, "")

        def close() -> None:
            nonlocal n
            if n:
                out.append((key[0], pd.Timestamp(start, unit="s"), pd.Timestamp(end, unit="s"), n, last))
            n = 0

        if state.hasTimedOut:
            close()
        for rows in batches:
            rows = rows.sort_values("created_at")
            at, outcome = rows["created_at"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6, rows["outcome"].to_numpy()
            over = np.isin(outcome.astype(str), list(TERMINAL))
            if n and len(at) and at[0] - end > gap_s:
                close()
            breaks = np.flatnonzero((np.diff(at) > gap_s) | over[:-1]) + 1
            for first, stop in zip([0, *breaks], [*breaks, len(at)]):  # no gap and no terminal row inside
                while first < stop:
                    if n >= max_turns:
                        close()
                    taken = min(stop - first, max_turns - n)
                    start = at[first] if not n else start
                    end = max(at[first + taken - 1], end) if n else at[first + taken - 1]
                    first, n, last = first + taken, n + taken, outcome[first + taken - 1]
                if stop < len(at) or stop and over[stop - 1]:
                    close()
        if n:
            state.update((float(start), float(end), int(n), last))
            state.setTimeoutTimestamp(max(int((end + gap_s) * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "started", "ended", "n_turns", "outcome"])

    watched = rows.select("session_id", "created_at", "outcome").withWatermark("created_at", late)
    return watched.groupBy("session_id").applyInPandasWithState(step, CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def gap_sessions(rows: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Sessions by gap alone, as a built-in window aggregation."""
    at = F.session_window("created_at", gap)
    watched = rows.withWatermark("created_at", late)
    return watched.groupBy("session_id", at.alias("w")).agg(F.count(F.lit(1)).alias("n_turns")).select("session_id", "w.start", "w.end", "n_turns")


def drain(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], key: str = "uid"):
    """Run what is available once: each micro-batch is deduplicated by ``key`` and handed to ``apply`` with its
    number. The checkpoint's offsets play the part of claims: a batch is retried until it was applied, so
    ``apply`` must be idempotent by batch number (write to a path that names it, and overwrite)."""

    def batch(df: DataFrame, n: int) -> None:
        apply(df.dropDuplicates([key]), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unresolved_watermark(episodes: DataFrame, resolved: DataFrame, current: float) -> float:
    """The next start of the scan: just before the earliest unresolved episode, else the latest end."""
    left = episodes.join(resolved.select("session_id", "run"), ["session_id", "run"], "left_anti").agg(F.min("started")).first()[0]
    if left is not None:
        return max(current, left.timestamp() - 0.001)
    end = episodes.agg(F.max("ended")).first()[0]
    return current if end is None else max(current, end.timestamp())
