"""Stateful streams with timers: first matches with and without a deadline, and changes of each key's newest state.

Both keep a row of state for each key that is not yet over in RocksDB and touch only keys that have new rows or a timer
that runs out, so a trigger's work follows its own rows. Rows are reduced to one per key in every quarter of a million of a
task before they are shuffled: a key with most of the rows sends few.

The clock is the newest event time up to the trigger before, told by Spark's watermark. The watermark itself is set `HORIZON`
back, since Spark silently drops what is older; here every row reaches its key, and what comes too late is a row of
the result. Event times must be later than `HORIZON` after 1970 for the clock to run.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from jobfacts.functions import states
from jobfacts.session import shipped

MINUTE = 60_000_000
HORIZON_DAYS = 3650
_HORIZON = HORIZON_DAYS * 1440 * MINUTE
#: Times are written with 20 digits, so that texts sort as they do.
_SHIFT = 1 << 62
#: A task reduces so many rows at once, some 100 bytes each, and hands them on in batches of so many.
_HELD, _BATCH = 1 << 18, 10_000
_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _ordered(us: Column, text: Column) -> Column:
    """One text that sorts by time, then by `text` with null first; null without a time."""
    digits = F.lpad((us + F.lit(_SHIFT)).cast("string"), 20, "0")
    return F.concat(digits, F.coalesce(F.concat(F.lit("1"), text), F.lit("0")))


def _parts(ordered: str) -> tuple[int, str | None]:
    return int(ordered[:20]) - _SHIFT, ordered[21:] if ordered[20] == "1" else None


def _reduced(rows: DataFrame, key: list[str], how: dict[str, str]) -> DataFrame:
    """`rows` (key and the columns of `how`) with one row per key of `_HELD` rows of a task: least or greatest values."""

    def reduced(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables).group_by(key).aggregate(list(how.items()))
        return table.select([*key, *[f"{c}_{f}" for c, f in how.items()]]).rename_columns([*key, *how])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_arrays(batch.columns, names=[*key, *how]))
                new += batch.num_rows
            if new >= _HELD:
                held, new = [reduced(held)], 0
                if held[0].num_rows >= _HELD // 2:  # few rows have a key in common
                    yield from held.pop().to_batches(_BATCH)
        if held:
            yield from reduced(held).to_batches(_BATCH)

    return rows.select(*key, *how).mapInArrow(run, rows.select(*key, *how).schema)


def _timed(rows: DataFrame) -> DataFrame:
    """`rows` with the clock set by seen; the time itself is not sent on, since tasks pay for each value of a row."""
    return rows.withColumn("at", F.timestamp_micros("seen")).withWatermark("at", f"{HORIZON_DAYS} days").drop("at")


def _clock(timer_values) -> int | None:
    """The newest event time before this trigger."""
    ms = timer_values.getCurrentWatermarkInMs()
    return ms * 1000 + _HORIZON if ms > 0 else None


def _alarm(us: int) -> int:
    """The timer that runs out as soon as the clock is at `us`."""
    return max(1, -(-(us - _HORIZON) // 1000))


class FirstMatch(StatefulProcessor):
    """The first match of each key, or that there was none in time: one row a key, and rows for what came too late."""

    def __init__(self, key: list[str], wait: int | None, delay: int, keep: int):
        self.key, self.wait, self.delay, self.keep = key, wait, delay, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "first long, match string, decided boolean, alarm long")

    def _due(self, first: int, match: str | None) -> int | None:
        """When the key's wait is over."""
        ends = [x for x in (match and _parts(match)[0], None if self.wait is None else first + self.wait) if x is not None]
        return min(ends, default=None)

    def _outcome(self, first: int, match: str | None) -> tuple:
        """When it was decided, and the match if that was it."""
        due = self._due(first, match)
        return due, match if match and _parts(match)[0] <= due else None

    def _row(self, key: tuple, kind: str, first: int, match: str | None) -> Row:
        end, kept = _parts(match) if match else (None, None)
        due, found = self._outcome(first, match)
        return Row(**dict(zip(self.key, key, strict=True)), kind=kind, first=first, end=end, kept=kept, due=due, matched=found is not None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, match, seen = None, None, None
        for r in rows:
            first = r["first"] if first is None else min(first, r["first"])
            match = min(filter(None, (match, r["match"])), default=None)
            seen = r["seen"] if seen is None else max(seen, r["seen"])
        held, clock = self.facts.get(), _clock(timerValues)
        if held is None:
            if clock is not None and seen < clock - self.keep:  # its key may have been decided and forgotten
                yield self._row(key, "late", first, match)
                return
            if self.wait is None and match is None:
                return
            decided, alarm = False, None
        else:
            old = held[0], held[1]
            first, match = min(first, held[0]), min(filter(None, (match, held[1])), default=None)
            decided, alarm = held[2], held[3]
            if (first, match) == old:
                return
            if decided:
                if self._outcome(first, match) != self._outcome(*old):
                    yield self._row(key, "late", first, match)
                    self.facts.update((first, match, True, alarm))
                return
        due = _alarm(self._due(first, match) + self.delay)
        if due != alarm:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            self.handle.registerTimer(due)
        self.facts.update((first, match, False, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.facts.get()
        if held is None:
            return
        first, match, decided, alarm = held
        if decided:
            self.facts.clear()
            return
        yield self._row(key, "outcome", first, match)
        over = self._due(first, match) + self.delay + self.keep
        if _clock(timerValues) >= over:
            self.facts.clear()
            return
        forget = max(_alarm(over), alarm + 1)
        self.handle.registerTimer(forget)
        self.facts.update((first, match, True, forget))

    def close(self) -> None:
        pass


def first_matches(
    stream: DataFrame, key: list[str], matches: Column, kept: Column, wait: int | None, delay: int, keep: int
) -> DataFrame:
    """Key columns, kind, first, end, kept, due, matched of a stream with a column ts; times are epoch microseconds.

    first is the key's first status, end its first match with its `kept` (of several at one time the smallest). With
    `wait` the key's time is over at first + wait; due is when it was decided, matched whether by the match.

    kind outcome comes once for a key, when the clock is `delay` past the decision; until then late rows still count.
    kind late: facts that came after that and change the outcome (due and matched are the new ones), or so late that the key
    may have been forgotten, which is `keep` after its decision. first and end of all rows of a key together are those
    of all its statuses.

    Without `wait`, keys without a match have no state. Rows without a key or a time are left out.
    """
    us = micros(F.col("ts"))
    known = F.col("ts").isNotNull()
    for k in key:
        known = known & F.col(k).isNotNull()
    hit = F.coalesce(matches, F.lit(False))
    rows = stream.filter(known).select(
        *key, us.alias("first"), F.when(hit, _ordered(us, kept)).alias("match"), us.alias("seen")
    )
    shipped(stream.sparkSession)
    reduced = _timed(_reduced(rows, key, {"first": "min", "match": "min", "seen": "max"}))
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in key)
    return reduced.groupBy(*key).transformWithState(
        FirstMatch(key, wait, delay, keep), f"{kinds}, kind string, first long, end long, kept string, due long, matched boolean", "append", "EventTime"
    )


class NewestState(StatefulProcessor):
    """What each key's newest state changes in the counts: one less of the old state, one more of the new."""

    def __init__(self, keep: int, over: list[str]):
        self.keep, self.over = keep, over

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "newest string, alarm long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(r["newest"] for r in rows)
        held, clock = self.newest.get(), _clock(timerValues)
        if held is None and clock is not None and _parts(newest)[0] < clock - self.keep:
            yield Row(cluster=key[0], state=None, n=0, late=1)
            return
        if held is not None and held[0] >= newest:
            return
        at, text = _parts(newest)
        state = text[2:] if text[1] == "1" else None
        if held is not None:
            before = _parts(held[0])[1]
            before = before[2:] if before[1] == "1" else None
            if before != state:
                yield Row(cluster=key[0], state=before, n=-1, late=0)
        if held is None or before != state:
            yield Row(cluster=key[0], state=state, n=1, late=0)
        alarm = _alarm(at + self.keep) if state in self.over else None
        if held is not None and held[1] is not None and held[1] != alarm:
            self.handle.deleteTimer(held[1])
        if alarm is not None and (held is None or held[1] != alarm):
            self.handle.registerTimer(alarm)
        self.newest.update((newest, alarm))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def state_changes(stream: DataFrame, over: list[str], keep: int) -> DataFrame:
    """cluster, state, n, late of a stream (cluster, job_id, state, ts): what to add to the number of jobs in each state.

    A job counts in its newest state; of states at one time a terminal one, then the last by name. A job in a state of
    `over` is forgotten `keep` after it; a status older than that of a job that is not known is counted as late and
    as nothing else. Rows without a job or a time are left out.
    """
    us = micros(F.col("ts"))
    ended = F.when(F.coalesce(states.is_terminal(F.col("state")), F.lit(False)), F.lit("1")).otherwise(F.lit("0"))
    ranked = F.concat(ended, F.coalesce(F.concat(F.lit("1"), F.col("state")), F.lit("0")))
    rows = stream.filter("job_id IS NOT NULL AND ts IS NOT NULL").select(
        F.coalesce("cluster", F.lit("")).alias("cluster"), "job_id", _ordered(us, ranked).alias("newest"), us.alias("seen")
    )
    shipped(stream.sparkSession)
    reduced = _timed(_reduced(rows, ["cluster", "job_id"], {"newest": "max", "seen": "max"}))
    return reduced.groupBy("cluster", "job_id").transformWithState(
        NewestState(keep, over), "cluster string, state string, n long, late long", "append", "EventTime"
    )
