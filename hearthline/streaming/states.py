"""States of sources folded from a stream of events, in order of event time whatever order they arrive in.

Each source keeps its own clock: the newest event time it has seen. Events younger than a horizon before it stay open, as
(time, id, outcome), and older ones are settled into one summary, so a source's state is bounded by what happens within the
horizon. An event that arrives between open ones is folded in its place, and the rows after it are sent anew; readers take the
latest version of each event (latest_states). An event that comes after its place was settled is marked late and
changes nothing. Repeated deliveries of an open event count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

PAUSE_AFTER, RESUME_AFTER = 3, 2
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Summary = tuple[bool | None, int, str]


def step(before: Summary, failed: bool) -> Summary:
    """(last outcome, how often in a row, state) after one more event."""
    last, run, state = before
    run = run + 1 if last == failed else 1
    if failed and run >= PAUSE_AFTER:
        state = "paused"
    elif not failed and run >= RESUME_AFTER:
        state = "active"
    return failed, run, state


# A source's state: the summary up to a place (time, id), the newest time seen, and the events after that place as three arrays.
STATE = "ts long, id long, failed boolean, run int, state string, newest long, open_ts array<long>, open_id array<long>, open_failed array<boolean>"


def source_fold(horizon: int, columns: list[str]):
    """The fold of one source's new events; Spark hands its state over with the rows, many sources at a time."""

    def fold(key: tuple, rows: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        place, summary, newest, known = None, (None, 0, "active"), None, {}
        if kept.exists:
            at_ts, at_id, *last, newest, times, ids, outcomes = kept.get
            place, summary = None if at_ts is None else (at_ts, at_id), tuple(last)
            known = dict(zip(zip(times, ids), outcomes))
        new, late = {}, []
        for part in rows:
            for t, i, x in zip(part["ts"].tolist(), part["id"].tolist(), part["failed"].tolist()):
                at = (t, i)
                if place and at <= place:
                    late.append((*at, x))
                elif at not in known:
                    new[at] = x
        out = [(*x, 0, summary[2], True) for x in late]
        if new:
            first, known = min(new), known | new
            newest = max(newest, max(new)[0]) if newest is not None else max(new)[0]
            settled, now = summary, summary
            still = []
            for at in sorted(known):
                now = step(now, known[at])
                if at >= first:
                    out.append((*at, known[at], now[1], now[2], False))
                if at[0] < newest - horizon:
                    place, settled = at, now
                else:
                    still.append((*at, known[at]))
            kept.update((*(place or (None, None)), *settled, newest, *(map(list, zip(*still)) if still else ([], [], []))))
        if out:
            yield pd.DataFrame(dict(zip(columns, [[key[0]] * len(out), *zip(*out)])))

    return fold


def source_states(stream: DataFrame, table: str, checkpoint: str, key: str, ts: str, event_id: str, failed: Column, horizon: str = "7 days") -> StreamingQuery:
    """Folds a stream of events into table; a batch that is replayed overwrites its own rows."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKS:  # keeps states on disk, not in an executor's heap
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    micros = int(pd.Timedelta(horizon).total_seconds() * 1_000_000)
    columns = ["key", "ts", "id", "failed", "run", "state", "late"]
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where(F.col(ts).isNotNull() & F.col(event_id).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.col(event_id).cast("long").alias("id"), F.coalesce(failed, F.lit(False)).alias("failed"))
    out = f"key {kind}, ts long, id long, failed boolean, run int, state string, late boolean"
    folded = rows.groupBy("key").applyInPandasWithState(source_fold(micros, columns), out, STATE, "update", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.timestamp_micros("ts").alias("at"), *columns).drop("ts").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return folded.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(spark: SparkSession, table: str) -> DataFrame:
    """key, id, at, failed, run, state, late of every event, as its latest version has it."""
    rows = spark.read.parquet(table)
    best = F.max_by(F.struct("at", "failed", "run", "state", "late"), F.struct((~F.col("late")).alias("in_time"), "batch"))
    return rows.groupBy("key", "id").agg(best.alias("v")).select("key", "id", "v.*")


def folded(outcomes: list[bool]) -> Summary:
    """The summary after these outcomes, for tests and small histories."""
    return reduce(step, outcomes, (None, 0, "active"))
