"""Streaming queries: each runs a stream over all that its table holds and reads what it has stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import duck as d
from bindings import oracles as o
from bindings import relations as rel
from bindings.queries import AS_OF, ORACLES, big, query
from bindings.state_queries import _CMD, _STATE, _UPSERT, stamp, stored, upsert_view
from bindings import state_queries as s
from leadsift.functions.dates import timestamp
from leadsift.operators import state as st
from leadsift.operators.dedupe import fingerprint
from leadsift.operators.score import normalize_postings
from leadsift.sources.shared import shared_folder
from leadsift.sources.snapshots import StateTable
from leadsift.streaming import jobs
from leadsift.streaming.runs import emitted, run_available
from leadsift.streaming.sightings import folded_spellings, latest_states, sighting_states


def _finished(stream, mode: str = "append"):
    """What a stream has emitted when all of its input is read."""
    out = shared_folder(stream.sparkSession, "stream")
    run_available(stream, f"{out}/rows", f"{out}/checkpoint", mode)
    return emitted(stream, f"{out}/rows")


def _sighting_stream(spark, sf):
    seen = normalize_postings(rel.streamed(spark, sf, rel.SIGHTINGS, "lineitem"))
    return seen.select(fingerprint().alias("job_fingerprint"), "seen_at")


def _fold_view(df):
    return df.select(
        F.col("job_fingerprint").alias("fingerprint"), big("seen_count", "occurrences"), stamp("first_seen_at"), stamp("last_seen_at")
    )


@query("streamed_sighting_states", ORACLES["sighting_fold"])
def streamed_sighting_states(spark, sf):
    """Keyed state in the state store, updated by the sighting stream."""
    spelled = normalize_postings(folded_spellings(rel.streamed(spark, sf, rel.SIGHTINGS, "lineitem")))
    seen = spelled.select(fingerprint().alias("job_fingerprint"), "occurrences", "first_at", "last_at")
    return _fold_view(latest_states(_finished(sighting_states(seen), "update")))


@query("streamed_sighting_counts", ORACLES["sighting_fold"])
def streamed_sighting_counts(spark, sf):
    """The declarative aggregate over the same stream."""
    return _fold_view(latest_states(_finished(jobs.sighting_counts(_sighting_stream(spark, sf), "3650 days"), "update")))


_LINE_MAIL = """
  SELECT CAST(l_orderkey AS STRING) AS source_id, l_linenumber AS part, CAST(l_shipdate AS TIMESTAMP) AS received_at FROM {lineitem}
"""


@query("streamed_unique_messages", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS source_id FROM lineitem")
def streamed_unique_messages(spark, sf):
    mail = rel.streamed(spark, sf, _LINE_MAIL, "lineitem")
    return _finished(jobs.unique_messages(mail, "3650 days")).select("source_id")


@query("streamed_recent", "SELECT CAST(l_orderkey AS VARCHAR) AS source_id, CAST(l_linenumber AS BIGINT) AS part FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 2400 HOUR")
def streamed_recent(spark, sf):
    mail = rel.streamed(spark, sf, _LINE_MAIL, "lineitem")
    return _finished(jobs.recent(mail, timestamp("1998-06-01 00:00:00"), 2400)).select("source_id", big("part"))


@query(
    "streamed_command_replies",
    ORACLES["command_replies"],
)
def streamed_command_replies(spark, sf):
    out = shared_folder(spark, "commands")
    table = StateTable(spark, f"{out}/state", 8)
    table.replace(stored(spark, sf))
    feed = rel.streamed(spark, sf, rel.COMMANDS, "events")
    jobs.command_stream(feed, table, f"{out}/replies", lambda: AS_OF, f"{out}/checkpoint", "me").start().awaitTermination()
    return spark.read.parquet(f"{out}/replies/batch=*").select("update_id", "reply")


@query("streamed_commands_state", ORACLES["state_after_commands"])
def streamed_commands_state(spark, sf):
    out = shared_folder(spark, "commands")
    table = StateTable(spark, f"{out}/state", 8)
    table.replace(stored(spark, sf))
    feed = rel.streamed(spark, sf, rel.COMMANDS, "events")
    jobs.command_stream(feed, table, f"{out}/replies", lambda: AS_OF, f"{out}/checkpoint", "me").start().awaitTermination()
    return table.read().select("id", "status", stamp("updated_at"))


@query(
    "streamed_cycle",
    o._with(*o.FLOW, final=f"SELECT {d.fingerprint()} AS job_fingerprint, count(*) AS seen_count, 'New' AS status FROM scored GROUP BY 1"),
)
def streamed_cycle(spark, sf):
    """Message stream -> ingest and rescoring of the stored state."""
    out = shared_folder(spark, "cycle")
    table = StateTable(spark, f"{out}/state", 8)
    mail = rel.streamed(spark, sf, rel.ALERTS, "orders")
    jobs.cycle_stream(mail, table, lambda: AS_OF, f"{out}/checkpoint").start().awaitTermination()
    return table.read().select("job_fingerprint", big("seen_count"), "status")


@query(
    "streamed_counts",
    o._with(
        *o.FLOW,
        final="""SELECT unnest(['loaded', 'filtered_out', 'parsed', 'duplicates', 'stored']) AS step, unnest([a, a - r, x, x - k, k]) AS n_rows
          FROM (SELECT (SELECT count(*) FROM raw_alerts) AS a, (SELECT count(*) FROM alerts) AS r, (SELECT count(*) FROM postings) AS x, (SELECT count(*) FROM deduped) AS k) t""",
    ),
)
def streamed_counts(spark, sf):
    out = shared_folder(spark, "counts")
    counts = jobs.counted_intake(rel.streamed(spark, sf, rel.ALERTS, "orders"), AS_OF, out, f"{out}/checkpoint")
    return spark.createDataFrame(list(counts.items()), "step string, n_rows bigint")


@query("upsert_stored_batches", _UPSERT)
def upsert_stored_batches(spark, sf):
    """Two batches into the stored table; the second rewrites the buckets of its fingerprints alone."""
    seen = s.sightings(spark, sf)
    table = StateTable(spark, shared_folder(spark, "state"), 16)
    table.upsert(seen.filter("seen_at >= '1998-06-01'"), seen_at="seen_at", stream="sightings", batch_id=0)
    early = seen.filter("seen_at < '1998-06-01'")
    for _ in range(2):  # the second time is a replay
        table.upsert(early, seen_at="seen_at", stream="sightings", batch_id=1)
    return upsert_view(table.read())
