"""Sighting state of a stream: first, last and count of each fingerprint, kept in the state store."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadsift.operators.dedupe import IDENTITY
from leadsift.streaming.runs import needs_rocksdb

PARTS = "job_fingerprint string, occurrences long, first_at timestamp, last_at timestamp"
COUNTED = T.StructType(
    [
        T.StructField("job_fingerprint", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("first_seen_at", T.TimestampType()),
        T.StructField("last_seen_at", T.TimestampType()),
        T.StructField("seen_count", T.LongType()),
    ]
)
_STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "count")])
_EPOCH = dt.datetime(1970, 1, 1)


def _micros(at: dt.datetime) -> int:
    if at.tzinfo is not None:
        return (at - _EPOCH.replace(tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return int(at.timestamp() * 1_000_000)


def _moment(micros: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(micros / 1_000_000, dt.timezone.utc).astimezone().replace(tzinfo=None)


def partly_folded(sightings: DataFrame) -> DataFrame:
    """(job_fingerprint, seen_at) -> one row per fingerprint and Arrow batch, before any shuffle.

    A fingerprint that holds a third of all sightings reaches its state as a few counts.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"job_fingerprint": batch.column(0), "first_at": batch.column(1), "last_at": batch.column(1)})
            out = table.group_by("job_fingerprint").aggregate([([], "count_all"), ("first_at", "min"), ("last_at", "max")])
            columns = ("job_fingerprint", "count_all", "first_at_min", "last_at_max")
            yield from out.select(columns).rename_columns(["job_fingerprint", "occurrences", "first_at", "last_at"]).to_batches()

    return sightings.select("job_fingerprint", "seen_at").where("job_fingerprint IS NOT NULL").mapInArrow(fold, PARTS)


#: Spellings that a task holds before it passes them on.
HELD_SPELLINGS = 200_000


def folded_spellings(sightings: DataFrame) -> DataFrame:
    """(identity columns, seen_at) -> (identity columns, occurrences, first_at, last_at), few rows a spelling.

    Each task folds what it holds, so that a spelling seen very often travels as a few rows; equal
    spellings then meet in one task and are folded again. What is costly for a name is left to be
    done for each spelling and not for each sighting.
    """
    names = list(IDENTITY)
    measures = ["occurrences", "first_at", "last_at"]

    def folded(table: pa.Table) -> pa.Table:
        out = table.group_by(names).aggregate([("occurrences", "sum"), ("first_at", "min"), ("last_at", "max")])
        return out.select([*names, "occurrences_sum", "first_at_min", "last_at_max"]).rename_columns([*names, *measures])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            held.append(pa.table({c: batch.column(c) for c in batch.schema.names}))
            waiting += batch.num_rows
            if waiting >= HELD_SPELLINGS:
                held = [folded(pa.concat_tables(held))]
                waiting = 0
                if held[0].num_rows >= HELD_SPELLINGS:
                    yield from held.pop().to_batches()
        if held:
            yield from folded(pa.concat_tables(held)).to_batches()

    one = sightings.select(*[F.col(c).cast("string").alias(c) for c in names], F.lit(1).cast("long").alias("occurrences"), F.col("seen_at").alias("first_at"), F.col("seen_at").alias("last_at"))
    schema = ", ".join(f"{c} string" for c in names) + ", occurrences long, first_at timestamp, last_at timestamp"
    return one.mapInArrow(fold, schema).repartition(*names).mapInArrow(fold, schema)


class SightingState(StatefulProcessor):
    """First, last and count of one fingerprint; forgotten after ``idle`` without a sighting.

    Emits ``first`` or ``again`` with the new totals once per micro-batch and key, and ``gone``
    with the last totals when the watermark has passed the idle time after the last sighting.
    """

    def __init__(self, idle: dt.timedelta | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def _row(self, key: str, event: str, state: tuple) -> Row:
        return Row(job_fingerprint=key, event=event, first_seen_at=_moment(state[0]), last_seen_at=_moment(state[1]), seen_count=state[2])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.seen.get() if self.seen.exists() else None
        first, last, count = known or (None, None, 0)
        for row in rows:
            begin, end = _micros(row.first_at), _micros(row.last_at)
            first = begin if first is None else min(first, begin)
            last = end if last is None else max(last, end)
            count += row.occurrences
        self.seen.update((first, last, count))
        if self.idle is not None:
            if known is not None:
                self.handle.deleteTimer(self._due(known[1]))
            self.handle.registerTimer(self._due(last))
        yield self._row(key[0], "again" if known else "first", (first, last, count))

    def _due(self, last: int) -> int:
        return last // 1000 + int(self.idle.total_seconds() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            state = self.seen.get()
            self.seen.clear()
            yield self._row(key[0], "gone", state)

    def close(self) -> None:
        pass


def sighting_states(sightings: DataFrame, idle: dt.timedelta | None = None, lateness: str = "0 seconds") -> DataFrame:
    """Sighting stream -> one row per fingerprint and micro-batch with running totals.

    ``sightings(job_fingerprint, seen_at)``, or ``(job_fingerprint, occurrences, first_at, last_at)``
    where they are folded already. Sightings may come in any order: times only widen.
    State lives in the RocksDB store under the query's checkpoint, so a restart counts nothing
    twice. Without ``idle`` nothing is forgotten. With it, a fingerprint not seen for so long (by
    the watermark, ``lateness`` behind the latest sighting) leaves the state and starts anew if it
    comes back. Rows without a fingerprint are left out.
    """
    needs_rocksdb(sightings.sparkSession)
    counted = "occurrences" in sightings.columns
    folded = sightings.select("job_fingerprint", "occurrences", "first_at", "last_at").where("job_fingerprint IS NOT NULL") if counted else partly_folded(sightings)
    if idle is not None:
        folded = folded.withWatermark("last_at", lateness)
    return folded.groupBy("job_fingerprint").transformWithState(
        statefulProcessor=SightingState(idle), outputStructType=COUNTED, outputMode="Update", timeMode="None" if idle is None else "EventTime"
    )


def latest_states(emitted: DataFrame) -> DataFrame:
    """What a stream of ``sighting_states`` without ``idle`` has emitted -> the present totals.

    Counts only grow while a fingerprint is known, so its greatest emitted count is the present one.
    """
    totals = F.struct("seen_count", "first_seen_at", "last_seen_at")
    return emitted.groupBy("job_fingerprint").agg(F.max(totals).alias("_t")).select("job_fingerprint", "_t.*")
