"""Snapshots, replays, maintenance and streams."""

import datetime as dt
import json
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from leadsift.operators import state as st
from leadsift.operators.commands import command_replies, parse_commands
from leadsift.sources.landing import read_updates, stream_updates
from leadsift.sources.snapshots import StateTable
from leadsift.streaming.jobs import command_stream, cycle_stream

DAY1, DAY2 = "2026-07-01T00:00:00", "2026-07-02T00:00:00"
MESSAGE = "source_id STRING, msg_seq BIGINT, subject STRING, sender STRING, received_at TIMESTAMP, body STRING"


def mail(spark, *items):
    rows = [
        (str(i), i, s, "jobs@greenhouse.io", None, f"Company: {c}\nRole: {s}\nhttps://x.example/{c}")
        for i, (c, s) in enumerate(items)
    ]
    return spark.createDataFrame(rows, MESSAGE)


def scored(spark, *items):
    from leadsift.plans.intake import find_postings

    return find_postings(mail(spark, *items), DAY1)


def test_upsert_counts_and_keeps(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"))
    assert table.read().count() == 0
    table.upsert(scored(spark, ("cohere", "Applied AI Engineer"), ("td", "Data Analyst")), DAY1, stream="s", batch_id=0)
    again = scored(spark, ("Cohere ", "applied ai engineer"), ("rbc", "Data Scientist"))
    table.upsert(again, DAY2, stream="s", batch_id=1)
    table.upsert(again, DAY2, stream="s", batch_id=1)  # replay
    rows = {r.company: r for r in table.read().collect()}
    assert set(rows) == {"Cohere", "TD", "Rbc"}
    assert rows["Cohere"].seen_count == 2 and rows["TD"].seen_count == 1
    assert str(rows["Cohere"].first_seen_at) < str(rows["Cohere"].last_seen_at)
    assert {r.status for r in rows.values()} == {"New"}


def test_late_batch_gives_the_same_state(spark):
    early, late = scored(spark, ("cohere", "Applied AI Engineer"), ("td", "Data Analyst")), scored(spark, ("cohere", "Applied AI Engineer"), ("bmo", "ML Engineer"))
    in_order = st.upsert(st.upsert(st.empty_state(spark), early, DAY1), late, DAY2)
    reversed_order = st.upsert(st.upsert(st.empty_state(spark), late, DAY2), early, DAY1)
    assert sorted(map(str, in_order.collect())) == sorted(map(str, reversed_order.collect()))


def test_old_state_gets_ids_and_counts(spark):
    base = st.upsert(st.empty_state(spark), scored(spark, ("cohere", "Applied AI Engineer")), DAY1)
    old = st.evolve_state(base.drop("id"), DAY1)
    assert [r.id for r in old.collect()] == [r.id for r in base.collect()]
    bare = base.withColumns({"id": F.lit(None).cast("bigint"), "seen_count": F.lit(None).cast("int")})
    row = st.upsert(bare, scored(spark, ("cohere", "Applied AI Engineer")), DAY2).first()
    assert row.id == base.first().id and row.seen_count == 1


def bucket_files(table):
    """Data files of each bucket of the newest generation."""
    folder = Path(table.path) / table._generations()[-1]
    return {b.name: {f.name for f in b.glob("*.parquet")} for b in folder.glob("bucket=*")}


def test_a_batch_rewrites_the_buckets_of_its_rows_alone(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), buckets=32)
    table.upsert(scored(spark, *[(f"firm {i}", "Data Scientist") for i in range(12)]), DAY1)
    before, state = bucket_files(table), {r.id: r for r in table.read().collect()}
    assert len(before) == 32 and len(state) == 12
    table.upsert(scored(spark, ("firm 3", "Data Scientist"), ("another", "ML Engineer")), DAY2)
    after = bucket_files(table)
    rewritten = {b for b in before if before[b] != after[b]}
    touched = table.read().where("last_seen_at > '2026-07-01 12:00:00'").select(table.bucket()).distinct().collect()
    assert rewritten == {f"bucket={r.bucket}" for r in touched} and 1 <= len(rewritten) <= 2
    rows = table.read().collect()
    assert len(rows) == 13 and sorted(r.seen_count for r in rows) == [1] * 12 + [2]
    assert sum(state.get(r.id) == r for r in rows) == 11

    one = next(r for r in rows if r.seen_count == 2)
    updates = spark.createDataFrame([(one.id, "Applied", 1)], "id bigint, status string, update_id bigint")
    table.update(lambda state: st.set_status(state, updates, DAY2), updates)
    last = bucket_files(table)
    assert [b for b in last if last[b] != after[b]] == [f"bucket={table.read().where(F.col('id') == one.id).select(table.bucket()).first()[0]}"]
    assert table.read().where("status = 'Applied'").count() == 1 and len(table._generations()) == 1


def test_a_cut_off_write_is_replayed_bucket_by_bucket(spark, tmp_path):
    """Buckets of a batch that were written before the failure keep it, the others get it once."""
    batch = scored(spark, *[(f"firm {i}", "Data Scientist") for i in range(8)])
    table = StateTable(spark, str(tmp_path / "state"), buckets=16)
    table.upsert(batch, DAY1, stream="s", batch_id=0)
    folder = Path(table.path) / table._generations()[-1]
    bucket = table.read().select(table.bucket()).first().bucket
    kept = tmp_path / "kept"
    shutil.copytree(folder / f"bucket={bucket}", kept)
    table.upsert(batch, DAY2, stream="s", batch_id=1)
    for file in (folder / f"bucket={bucket}").iterdir():
        file.unlink()
    for file in kept.iterdir():
        shutil.copy(file, folder / f"bucket={bucket}" / file.name)
    spark.catalog.refreshByPath(str(folder))
    assert {r.seen_count for r in table.read().collect()} == {1, 2}
    for _ in range(2):
        table.upsert(batch, DAY2, stream="s", batch_id=1)
        assert [r.seen_count for r in table.read().collect()] == [2] * 8


def test_rows_that_change_buckets_make_a_generation(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), buckets=16)
    batch = scored(spark, ("cohere", "Applied AI Engineer"), ("td", "Data Analyst"))
    table.upsert(batch, DAY1, stream="s", batch_id=4)

    def merged(state):
        return st.collapse_fingerprints(state.withColumn("job_fingerprint", F.lit("x")))

    ids = table.read().select("id")
    table.update(merged, ids)
    (row,) = table.read().collect()
    assert row.seen_count == 2 and len(table._generations()) == 2
    table.upsert(batch, DAY2, stream="s", batch_id=4)  # the tags moved on with the generation
    assert table.read().count() == 1
    table.replace(table.staged(table.read()))
    assert len(table._generations()) == 2 and StateTable(spark, table.path, buckets=3).buckets == 16
    # A generation that Spark has not finished is not read.
    (Path(table.path) / "gen=9999999999-16").mkdir()
    assert table.read().count() == 1


def test_streams_match_batch(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"))
    source = tmp_path / "mail"
    mail(spark, ("cohere", "Applied AI Engineer"), ("td", "Data Scientist")).write.parquet(str(source))
    stream = spark.readStream.schema(MESSAGE).parquet(str(source))
    cycle_stream(stream, table, lambda: DAY1, str(tmp_path / "cp")).start().awaitTermination()
    batch = scored(spark, ("cohere", "Applied AI Engineer"), ("td", "Data Scientist"))
    expected = {(r.company, r.score) for r in batch.collect()}
    assert {(r.company, r.score) for r in table.read().collect()} == expected

    row = table.read().filter("company = 'TD'").first()
    feed = tmp_path / "feed"
    feed.mkdir()
    updates = [
        {"update_id": 1, "message": {"chat": {"id": "me"}, "text": f"/reviewed {row.id}"}},
        {"update_id": 2, "message": {"chat": {"id": "me"}, "text": f"/applied {row.id}"}},
        {"update_id": 3, "message": {"chat": {"id": "you"}, "text": f"/skip {row.id}"}},
        {"update_id": 4, "message": {"chat": {"id": "me"}, "text": "/applied 5"}},
        {"update_id": 5, "message": {"chat": {"id": "me"}, "text": "hello"}},
    ]
    (feed / "u.json").write_text("\n".join(map(json.dumps, updates)))
    replies = command_replies(table.read(), parse_commands(read_updates(spark, str(feed)), "me"))
    assert [r.reply for r in replies.orderBy("update_id").collect()][2] == "No job found with id 5."
    out = str(tmp_path / "outbox")
    command_stream(
        stream_updates(spark, str(feed)), table, out, lambda: DAY2, str(tmp_path / "cp2"), "me"
    ).start().awaitTermination()
    assert table.read().filter("company = 'TD'").first().status == "Applied"
    assert spark.read.parquet(out).count() == 3


def test_fingerprint_collisions_merge(spark):
    base = st.upsert(st.empty_state(spark), scored(spark, ("cohere", "Applied AI Engineer"), ("td", "Data Analyst")), DAY1)
    same = base.withColumn("job_fingerprint", F.lit("x")).withColumn("status", F.when(F.col("company") == "TD", "Applied").otherwise("New"))
    merged = st.collapse_fingerprints(same).collect()
    assert len(merged) == 1 and merged[0].seen_count == 2 and merged[0].status == "Applied"


def test_old_state_gets_all_columns(spark):
    old = spark.createDataFrame([(1, "f", "CA$100k", "https://a")], "id BIGINT, job_fingerprint STRING, salary_range STRING, job_link STRING")
    row = st.evolve_state(old, DAY1).first()
    assert (row.salary_estimate, row.source_url, row.is_expired) == (100000, "https://a", False)
    assert list(row.asDict()) == list(st.STATE_COLUMNS)


def test_names_are_normalised_after_the_first_fold(spark):
    """Spellings fold into one fingerprint; text rules run over spellings and not over occurrences."""
    fields = "company STRING, title STRING, location STRING, work_mode STRING, salary_range STRING, seniority STRING, required_skills ARRAY<STRING>, preferred_skills ARRAY<STRING>"
    schema = f"msg_seq BIGINT, card_idx INT, seen_at TIMESTAMP, {fields}, job_link STRING, source_email STRING, posted_date STRING, is_expired BOOLEAN, score INT, category STRING, explanation STRING"
    at = [dt.datetime(2026, 7, d) for d in (1, 2, 3)]
    rows = [
        (i, 0, when, company, "ml engineer", place, None, pay, None, ["RAG"], [], link, "a@x.example", None, False, i, "Skip", f"why {i}")
        for i, (when, company, place, pay, link) in enumerate([
            (at[1], "cohere", None, "CA$100k", None), (at[2], " Cohere ", "", "CA$200k", ""), (at[0], "cohere", None, "CA$300k", None),
            (None, "cohere", "", None, None), (at[2], None, None, None, "l"), (None, "Unknown", None, None, "l"),
        ])
    ]
    fold = st.fold_sightings(spark.createDataFrame(rows, schema), seen_at="seen_at")
    got = {r.latest.company: r for r in fold.collect()}
    assert set(got) == {"Cohere", "Unknown"}
    cohere, unknown = got["Cohere"], got["Unknown"]
    assert (cohere.occurrences, cohere.first_at, cohere.last_at) == (4, at[0], at[2])
    assert (cohere.latest.score, cohere.latest.salary_range, cohere.latest.salary_estimate, cohere.latest.source_url) == (1, "CA$200k", 200_000, "")
    assert (unknown.occurrences, unknown.latest.score, unknown.latest.source_url) == (2, 4, "l")
    assert [f.dataType.simpleString() for f in fold.schema.fields if f.name in ("job_fingerprint", "occurrences")] == ["string", "int"]
    lines = fold._jdf.queryExecution().optimizedPlan().toString().splitlines()
    normalised = [i for i, line in enumerate(lines) if "sha2(" in line]
    folds = [i for i, line in enumerate(lines) if "Aggregate [" in line]
    assert len(folds) == 2 and normalised and folds[0] < min(normalised) and max(normalised) < folds[1]
