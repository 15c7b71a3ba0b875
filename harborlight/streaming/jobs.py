"""Streaming forms of the stateful operators: bounded state by watermarks, the same rules as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scan import FAILURES
from ..operators.spine import DEDUP_KEY, with_hash
from ..operators.triage import REVIEW_RESULT, review_step


def distinct_observations(stream: DataFrame, event_time: str = "observed_at", late: str = "1 day") -> DataFrame:
    """Observations once per run, source, type and content; a repeat later than ``late`` counts as new."""
    rows = with_hash(stream).withColumn("source_identifier", F.coalesce("source_identifier", F.lit("")))
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(DEDUP_KEY)


def windowed_counts(stream: DataFrame, at: str, size: str, slide: str | None, keys: list[str], value: Column, late: str) -> DataFrame:
    """Counts and sums per tumbling or sliding window; what comes later than ``late`` is left out."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(stream: DataFrame, by: str, at: str, gap: str, late: str) -> DataFrame:
    w = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(by, w.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def _timed(stream: DataFrame, at: str | None, late: str) -> tuple[DataFrame, str]:
    """The stream with its event time in milliseconds (0 without one), and how long its state is kept."""
    if at is None:
        return stream.withColumn("__ms", F.lit(0).cast("long")), GroupStateTimeout.NoTimeout
    return stream.withWatermark(at, late).withColumn("__ms", F.unix_millis(at)), GroupStateTimeout.EventTimeTimeout


def _keep_until(state: GroupState, rows: pd.DataFrame, at: str | None, idle_hours: float) -> None:
    if at is not None:
        state.setTimeoutTimestamp(int(rows["__ms"].max()) + int(idle_hours * 3_600_000))


def review_stream(events: DataFrame, at: str | None = None, late: str = "1 day", idle_hours: float = 24 * 365) -> DataFrame:
    """What came of each review, with each insight's state kept between batches.

    ``events``: as for the batch fold, with the insight's own recommendation and kev_locked_visible. Within a batch events go
    in order of occurrence. With an event time ``at``, an insight's state goes once nothing has come for ``idle_hours`` of it; without
    one it stays.
    """
    events, timeout = _timed(events, at, late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        current = tuple(state.get) if state.exists else None
        out = []
        for e in rows.sort_values(["occurred_at", "event_id"]).to_dict("records"):
            e = {k: None if isinstance(v, float) and pd.isna(v) else v for k, v in e.items()}
            current = current or ("proposed", None, None, e["own"], bool(e["kev_locked_visible"]))
            result, after = review_step(current, e)
            out.append((key[0], e["event_id"], result, current[0], after[0], after[2] or after[3]))
            current = after
        if current:
            state.update(current)
            _keep_until(state, rows, at, idle_hours)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REVIEW_RESULT.split(", ")])

    keep = "state string, outcome string, by_analyst string, own string, exploited boolean"
    return events.groupBy("insight_id").applyInPandasWithState(step, REVIEW_RESULT, keep, "append", timeout)


def breaker_stream(outcomes: DataFrame, halt_after: int = 3, at: str | None = None, late: str = "1 hour", idle_hours: float = 24) -> DataFrame:
    """(run_id, pos, outcome, streak, reached): the circuit breaker, with each run's streak kept between batches.

    With an event time ``at``, a run's state goes once nothing has come for ``idle_hours`` of it; without one it stays.
    """
    outcomes, timeout = _timed(outcomes, at, late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        streak, halted = state.get if state.exists else (0, False)
        out = []
        for pos, outcome in rows.sort_values("pos")[["pos", "outcome"]].itertuples(index=False):
            reached = not halted
            if outcome == "scanned":
                streak = 0
            elif outcome in FAILURES:
                streak += 1
                halted = halted or streak >= halt_after
            out.append((key[0], pos, outcome, streak, reached))
        state.update((streak, halted))
        _keep_until(state, rows, at, idle_hours)
        yield pd.DataFrame(out, columns=["run_id", "pos", "outcome", "streak", "reached"])

    schema = "run_id string, pos long, outcome string, streak long, reached boolean"
    return outcomes.groupBy("run_id").applyInPandasWithState(step, schema, "streak long, halted boolean", "append", timeout)


def against_snapshot(stream: DataFrame, snapshot: DataFrame, key: str, at: str, ttl_hours: int, late: str = "1 day") -> DataFrame:
    """Stream rows with the snapshot's columns where it was fresh at the row's time (fetched_at within ``ttl_hours``), else ``fresh`` is
    false and they are null: a stale or missing signal is told from "not listed". The stream's state holds nothing; the snapshot
    is read anew for every batch if its table is."""
    rows = stream.withWatermark(at, late).join(snapshot, key, "left")
    fresh = F.coalesce((F.col("fetched_at") <= F.col(at)) & (F.col(at) - F.col("fetched_at") < F.make_dt_interval(hours=F.lit(ttl_hours))), F.lit(False))
    signals = [c for c in snapshot.columns if c not in (key, "fetched_at")]
    return rows.select(*stream.columns, fresh.alias("fresh"), *[F.when(fresh, F.col(c)).alias(c) for c in signals])
