"""Structured Streaming jobs over the batch operators."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from leadsift.operators.commands import apply_commands, command_replies, parse_commands
from leadsift.operators.dedupe import dedupe
from leadsift.operators.digest import alert_digest, description_worklist
from leadsift.operators.extract import extract
from leadsift.operators.maintenance import rescore
from leadsift.operators.pages import fetch_descriptions
from leadsift.operators.relevance import relevant_messages
from leadsift.operators.score import score
from leadsift.plans.intake import find_postings
from leadsift.rules import DEFAULT_RULES, RulePack
from leadsift.sources.snapshots import StateTable
from leadsift.streaming.runs import into_folder, observed, run_available


def unique_messages(messages: DataFrame, lateness: str = "3 days") -> DataFrame:
    """Drop repeated message ids of a stream; state is bounded by the watermark."""
    return messages.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["source_id"])


def recent(messages: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Event-time window up to ``as_of``; works on batches and streams."""
    return messages.filter(F.col("received_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))


@dataclasses.dataclass(frozen=True)
class CycleOptions:
    since_hours: int = 48
    alert_limit: int = 5
    include_investigate: bool = False
    minimum_score: int | None = None
    max_seen_count: int | None = 3
    description_limit: int | None = None


def run_cycle(
    table: StateTable, messages: DataFrame, as_of, *, batch_id: int, stream: str = "messages",
    rules: RulePack = DEFAULT_RULES, options: CycleOptions = CycleOptions(),
    snapshots: DataFrame | None = None, commands: DataFrame | None = None, chat_id: str | None = None,
    send: Callable[[DataFrame], None] | None = None, reply: Callable[[DataFrame], None] | None = None,
) -> None:
    """Ingest, rescore, enrich, alert, apply commands; an error stops the cycle.

    Ingest is tagged with the batch, so a replay never counts a sighting twice; the later steps
    give the same rows when they are repeated. Each step rewrites only the buckets of the rows it
    changes. Commands of other chats than ``chat_id`` are ignored; ``reply`` gets a row for each
    command. A ``stream`` name belongs to one checkpoint: a new checkpoint needs a new name.
    """
    table.upsert(find_postings(messages, as_of, rules), as_of, stream=f"{stream}/ingest", batch_id=batch_id)
    changed = rescore(table.read(), as_of, rules).preview
    table.update(lambda state: rescore(state, as_of, rules).apply(), changed)
    if snapshots is not None:
        due = description_worklist(table.read(), options.description_limit, options.include_investigate)
        due = table.staged(due)
        table.update(lambda state: fetch_descriptions(state, due, snapshots, as_of), due)
    if send is not None:
        send(
            alert_digest(
                table.read(), as_of, options.since_hours, options.alert_limit,
                options.include_investigate, options.minimum_score, options.max_seen_count,
            )
        )
    if commands is not None:
        if chat_id is None:
            raise ValueError("commands need the chat_id they may come from")
        mine = parse_commands(commands, chat_id)
        if reply is not None:
            reply(command_replies(table.read(), mine))
        table.update(lambda state: apply_commands(state, mine, as_of), mine.filter("id IS NOT NULL"))


def cycle_stream(
    messages: DataFrame, table: StateTable, as_of: Callable[[], object], checkpoint: str,
    **cycle,
) -> DataStreamWriter:
    """Message stream -> state. Start it with ``.start()``; runs what is available."""

    def each(batch: DataFrame, batch_id: int) -> None:
        run_cycle(table, batch, as_of(), batch_id=batch_id, **cycle)

    return (
        messages.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def command_stream(
    updates: DataFrame, table: StateTable, outbox: str, as_of: Callable[[], object],
    checkpoint: str, chat_id: str,
) -> DataStreamWriter:
    """Command feed -> status updates and reply rows (one folder per batch); repeats change nothing."""

    def each(batch: DataFrame, batch_id: int) -> None:
        commands = parse_commands(batch, chat_id)
        replies = command_replies(table.read(), commands)
        replies.write.mode("overwrite").parquet(f"{outbox}/batch={batch_id}")
        now = as_of()
        table.update(lambda state: apply_commands(state, commands, now), commands.filter("id IS NOT NULL"))

    return (
        updates.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def sighting_counts(sightings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Running first, last and count per fingerprint of a sighting stream.

    ``sightings(job_fingerprint, seen_at)``. A declarative aggregate keeps three
    values per key and combines map-side before the state store.
    """
    return (
        sightings.withWatermark("seen_at", lateness)
        .groupBy("job_fingerprint")
        .agg(
            F.min("seen_at").alias("first_seen_at"),
            F.max("seen_at").alias("last_seen_at"),
            F.count(F.lit(1)).alias("seen_count"),
        )
    )


def counted_intake(
    messages: DataFrame, as_of, out: str, checkpoint: str, rules: RulePack = DEFAULT_RULES
) -> dict[str, int]:
    """Message stream -> scored postings under ``out``, and what happened to the rows on the way.

    Filter and extraction run in the streaming plan and are observed there; the counts come from
    the query's progress. Each micro-batch is de-duplicated and scored from what the plan has
    written, so no row is extracted twice.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 1_000_000)

    def watch(df: DataFrame, name: str) -> DataFrame:
        return df.observe(name, F.count(F.lit(1)).alias("rows"))

    kept = watch(relevant_messages(watch(messages, "loaded"), rules), "relevant")
    parsed = watch(extract(kept, as_of, rules), "parsed")
    stored = 0

    def each(batch: DataFrame, batch_id: int) -> None:
        nonlocal stored
        into_folder(f"{out}/parsed")(batch, batch_id)
        extracted = spark.read.schema(parsed.schema).parquet(f"{out}/parsed/batch={batch_id}")
        counts = Observation()
        rows = score(dedupe(extracted), rules).observe(counts, F.count(F.lit(1)).alias("rows"))
        into_folder(f"{out}/scored")(rows, batch_id)
        stored += counts.get["rows"]

    seen = observed(run_available(parsed, out, checkpoint, "append", each))
    loaded, relevant, found = (seen.get(n, 0) for n in ("loaded", "relevant", "parsed"))
    return {"loaded": loaded, "filtered_out": loaded - relevant, "parsed": found, "duplicates": found - stored, "stored": stored}
