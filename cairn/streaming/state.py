"""Keyed state: recent feeds and request limits, for streams and for tables.

For a table, a feed is a ranked window (Spark limits the rows of a group before it shuffles them), and limits are replayed
in the order of events, each host's rows streaming through one task that holds one state.  For a stream, the same is kept as
state by key; rows of a micro-batch are sorted by time and id, and later batches come after.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Samples kept of all operations, rows kept of a job's feed and of its errors. Fixed values.
SAMPLES, FEED, ERRORS = 5000, 50, 20
#: Requests at once to a host at first, at least and at most; successes in a row for one more; pause in microseconds. Fixed values.
FIRST, LEAST, MOST, STREAK, PAUSE = 4, 1, 16, 25, 30_000_000

LIMITS = "host string, at long, event_id long, limit long, streak long, pause_until long"


def recent_samples(samples: DataFrame, at: str, tie: str, n: int = SAMPLES) -> DataFrame:
    """The last ``n`` rows: a bounded report, sorted in each task before it is merged."""
    return samples.orderBy(F.desc(at), F.desc(tie)).limit(n)


def recent_feeds(rows: DataFrame, job: str, is_error, at: str, tie: str, feed: int = FEED, errors: int = ERRORS) -> DataFrame:
    """Each job's last ``feed`` rows and last ``errors`` errors, with nth counted from the newest of its kind."""
    marked = rows.withColumn("is_error", is_error)
    nth = F.row_number().over(Window.partitionBy(job, "is_error").orderBy(F.desc(at), F.desc(tie)))
    return marked.withColumn("nth", nth).where(F.col("nth") <= max(feed, errors)).where(F.col("nth") <= F.when(F.col("is_error"), errors).otherwise(feed))


def next_limit(state: tuple[int, int, int], outcome: str, at: int) -> tuple[int, int, int]:
    """(limit, streak, pause_until) after a request at microsecond ``at``: success, limited, or anything else, an error."""
    limit, streak, pause_until = state
    if outcome == "limited":
        return max(LEAST, limit // 2), 0, max(pause_until, at + PAUSE)
    if outcome != "success":
        return limit, 0, pause_until
    if streak + 1 >= STREAK and limit < MOST:
        return limit + 1, 0, pause_until
    return limit, streak + 1, pause_until


def replay_limits(requests: DataFrame) -> DataFrame:
    """``LIMITS`` after each of ``requests`` (host, at in microseconds, event_id, outcome)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state = None, (FIRST, 0, 0)
        for b in batches:
            after = []
            for h, at, outcome in zip(b["host"], b["at"], b["outcome"]):
                if h != host:
                    host, state = h, (FIRST, 0, 0)
                state = next_limit(state, outcome, at)
                after.append(state)
            yield pd.concat([b[["host", "at", "event_id"]], pd.DataFrame(after, columns=["limit", "streak", "pause_until"], index=b.index, dtype="int64")], axis=1)

    rows = requests.select("host", "at", "event_id", "outcome").where("host IS NOT NULL AND at IS NOT NULL")
    return rows.repartition("host").sortWithinPartitions("host", "at", "event_id").mapInPandas(run, LIMITS)


def stream_limits(requests: DataFrame) -> DataFrame:
    """``LIMITS`` of a stream of requests, as after each request of the batches so far."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (FIRST, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        after = []
        for at, outcome in zip(rows["at"].tolist(), rows["outcome"]):
            now = next_limit(now, outcome, at)
            after.append(now)
        state.update(now)
        yield pd.concat([rows[["host", "at", "event_id"]].reset_index(drop=True), pd.DataFrame(after, columns=["limit", "streak", "pause_until"], dtype="int64")], axis=1)

    rows = requests.select("host", "at", "event_id", "outcome").where("host IS NOT NULL AND at IS NOT NULL")
    return rows.groupBy("host").applyInPandasWithState(run, LIMITS, "limit long, streak long, pause_until long", "append", GroupStateTimeout.NoTimeout)


FEEDS = "job string, at array<long>, notes array<string>"


def stream_feeds(rows: DataFrame, n: int = FEED) -> DataFrame:
    """``FEEDS``: each job's last ``n`` rows of a stream (job, at in microseconds, note), newest first, after each batch that has some.

    State is bounded by ``n``: a frame is merged and cut before the next is taken.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for f in frames:
            kept = sorted([*kept, *zip(f["at"].tolist(), f["note"])], key=lambda x: (x[0], x[1] or ""), reverse=True)[:n]
        at, notes = [k[0] for k in kept], [k[1] for k in kept]
        state.update((at, notes))
        yield pd.DataFrame({"job": [key[0]], "at": [at], "notes": [notes]})

    held = rows.select("job", "at", "note").where("job IS NOT NULL AND at IS NOT NULL")
    return held.groupBy("job").applyInPandasWithState(run, FEEDS, "at array<long>, notes array<string>", "update", GroupStateTimeout.NoTimeout)
