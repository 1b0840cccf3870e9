"""Keyed stream state, stream de-duplication, the recency window and observed counts."""

import datetime as dt

from pyspark.sql import functions as F

from leadsift.streaming import sightings
from leadsift.functions.dates import timestamp
from leadsift.streaming.jobs import counted_intake, recent, unique_messages
from leadsift.streaming.runs import emitted, run_available
from leadsift.streaming.sightings import latest_states, partly_folded, sighting_states

SEEN = "job_fingerprint STRING, seen_at TIMESTAMP"
START = dt.datetime(2026, 7, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def add(spark, folder, schema, *rows):
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(folder))


def totals(df):
    return {r.job_fingerprint: (r.seen_count, r.first_seen_at, r.last_seen_at) for r in df.collect()}


def test_state_survives_restarts_and_any_order(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = sighting_states(spark.readStream.schema(SEEN).parquet(str(source)))
        run_available(stream, out, checkpoint)
        return emitted(stream, out)

    add(spark, source, SEEN, ("a", at(5)), ("a", at(3)), ("b", at(4)), (None, at(1)))
    assert totals(latest_states(run())) == {"a": (2, at(3), at(5)), "b": (1, at(4), at(4))}
    assert totals(latest_states(run())) == {"a": (2, at(3), at(5)), "b": (1, at(4), at(4))}  # nothing new
    add(spark, source, SEEN, ("a", at(1)), *[("hot", at(i % 7)) for i in range(500)])
    rows = run()
    assert totals(latest_states(rows)) == {"a": (3, at(1), at(5)), "b": (1, at(4), at(4)), "hot": (500, at(0), at(6))}
    assert {(r.job_fingerprint, r.event, r.seen_count) for r in rows.collect()} == {
        ("a", "first", 2), ("b", "first", 1), ("a", "again", 3), ("hot", "first", 500),
    }


def test_idle_fingerprints_leave_the_state(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in ([("a", at(0)), ("b", at(0))], [("b", at(40))], [("c", at(60))], [("a", at(61))]):
        add(spark, source, SEEN, *rows)
        stream = sighting_states(spark.readStream.schema(SEEN).parquet(str(source)), idle=dt.timedelta(hours=48))
        run_available(stream, out, checkpoint)
    events = sorted((r.job_fingerprint, r.event, r.seen_count, r.last_seen_at) for r in emitted(stream, out).collect())
    assert ("a", "gone", 1, at(0)) in events
    # Seen again after it was forgotten: it starts anew. The other one was seen in time.
    assert [e[1:3] for e in events if e[0] == "b"] == [("again", 2), ("first", 1)]
    assert [e for e in events if e[0] == "a" and e[1] == "first"] == [("a", "first", 1, at(0)), ("a", "first", 1, at(61))]


def test_a_hot_fingerprint_is_folded_before_the_shuffle(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("job_fingerprint"), F.timestamp_seconds(F.col("id")).alias("seen_at"))
    folded = partly_folded(rows.repartition(4))
    assert folded.count() <= 8 and folded.agg(F.sum("occurrences")).first()[0] == 20_000


def test_message_ids_are_unique_also_across_restarts(spark, tmp_path):
    schema = "source_id STRING, received_at TIMESTAMP, subject STRING"
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in ([("1", at(0), "x"), ("1", at(1), "y"), ("2", at(2), "z")], [("1", at(3), "again"), ("3", None, "no time"), ("3", None, "no time")]):
        add(spark, source, schema, *rows)
        stream = unique_messages(spark.readStream.schema(schema).parquet(str(source)))
        run_available(stream, out, checkpoint, "append")
    found = emitted(stream, out)
    assert sorted(r.source_id for r in found.collect()) == ["1", "2", "3"]
    window = recent(spark.readStream.schema(schema).parquet(str(source)), timestamp("2026-07-01T04:00:00"), 2)
    run_available(window, str(tmp_path / "recent"), str(tmp_path / "cp2"), "append")
    assert sorted((r.source_id, r.subject) for r in emitted(window, str(tmp_path / "recent")).collect()) == [("1", "again"), ("2", "z")]


def test_counts_of_a_stream(spark, tmp_path):
    schema = "source_id STRING, msg_seq BIGINT, subject STRING, sender STRING, received_at TIMESTAMP, body STRING"
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    good = [(str(i), i, "Data Scientist", "jobs@greenhouse.io", None, f"Company: firm {i // 2}\nRole: Data Scientist") for i in range(6)]
    add(spark, source, schema, *good, ("n", 9, "Lunch?", "friend@mail.example", None, "noon"))
    got = counted_intake(spark.readStream.schema(schema).parquet(str(source)), "2026-07-01T00:00:00", out, checkpoint)
    assert got == {"loaded": 7, "filtered_out": 1, "parsed": 6, "duplicates": 3, "stored": 3}
    assert spark.read.parquet(f"{out}/scored/batch=*").count() == 3
    again = counted_intake(spark.readStream.schema(schema).parquet(str(source)), "2026-07-01T00:00:00", out, checkpoint)
    assert again == dict.fromkeys(got, 0)


def test_spellings_fold_before_names_are_normalised(spark, monkeypatch):
    at = [dt.datetime(2026, 7, d) for d in (1, 2, 3)]
    rows = [("cohere", None, None, "l", at[i % 3]) for i in range(50)] + [("Cohere ", None, None, "l", at[0]), (None, None, None, "l", at[1])]
    seen = spark.createDataFrame(rows, "company STRING, title STRING, location STRING, job_link STRING, seen_at TIMESTAMP")
    for held in (3, 200_000):
        monkeypatch.setattr(sightings, "HELD_SPELLINGS", held)
        got = {}
        for r in sightings.folded_spellings(seen.repartition(4)).collect():
            assert r.title is None and r.job_link == "l"
            got.setdefault(r.company, []).append((r.occurrences, r.first_at, r.last_at))
        assert got == {"cohere": [(50, at[0], at[2])], "Cohere ": [(1, at[0], at[0])], None: [(1, at[1], at[1])]}
