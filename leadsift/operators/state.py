"""Current-state table of opportunities: schema, upsert and row updates.

All functions are DataFrame -> DataFrame. ``snapshots.StateTable`` stores results.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsift.functions.dates import timestamp
from leadsift.functions.labels import normalize_status
from leadsift.functions.money import estimate_salary
from leadsift.operators.dedupe import IDENTITY, fingerprint
from leadsift.operators.score import normalize_postings

STATE_COLUMNS = {
    "id": "bigint",
    "job_fingerprint": "string",
    "first_seen_at": "timestamp",
    "last_seen_at": "timestamp",
    "seen_count": "int",
    "company": "string",
    "title": "string",
    "location": "string",
    "work_mode": "string",
    "salary_range": "string",
    "salary_estimate": "bigint",
    "seniority": "string",
    "required_skills": "array<string>",
    "preferred_skills": "array<string>",
    "job_link": "string",
    "source_url": "string",
    "canonical_url": "string",
    "source_email": "string",
    "posted_date": "string",
    "job_description": "string",
    "job_description_url": "string",
    "job_description_fetched_at": "timestamp",
    "job_description_error": "string",
    "description_status": "string",
    "description_source": "string",
    "is_expired": "boolean",
    "score": "int",
    "category": "string",
    "explanation": "string",
    "status": "string",
    "created_at": "timestamp",
    "updated_at": "timestamp",
}
# Columns an upsert refreshes; everything else of a known row is kept.
REFRESHED = (
    "company", "title", "location", "work_mode", "salary_range", "salary_estimate",
    "seniority", "required_skills", "preferred_skills", "job_link", "source_url",
    "source_email", "posted_date", "is_expired", "score", "category", "explanation",
)
REWRITTEN = ("job_fingerprint", *REFRESHED)
# Refreshed columns that an occurrence has beside its identity; the others follow from these.
_OCCURRENCE = tuple(c for c in REFRESHED if c not in (*IDENTITY, "salary_estimate", "source_url"))


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in STATE_COLUMNS.items()))


def surrogate_id(key: Column) -> Column:
    """Positive 63-bit id of a fingerprint; needs no global numbering."""
    return F.xxhash64(key).bitwiseAND(F.lit(2**63 - 1))


def _in_order(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in STATE_COLUMNS.items()])


def fold_sightings(
    scored: DataFrame, order: tuple[str, ...] = ("msg_seq", "card_idx"), seen_at: str | None = None
) -> DataFrame:
    """One row per fingerprint: the last occurrence's fields, count, first and last time.

    ``seen_at`` names a time column when occurrences carry their own run time.
    Aggregated map-side first, so one posting seen very often stays one small row
    per task before the shuffle. Names are normalised once for each spelling of a
    posting and not once for each occurrence; spellings with equal fingerprints are
    folded again.
    """
    rank = F.struct(*([F.col(seen_at)] if seen_at else []), *[F.col(c) for c in order])
    times = [(F.min, seen_at, "first_at"), (F.max, seen_at, "last_at")] if seen_at else []
    spelled = scored.groupBy(*IDENTITY).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.max(rank).alias("_rank"),
        F.max_by(F.struct(*_OCCURRENCE), rank).alias("_last"),
        *[fold(column).alias(name) for fold, column, name in times],
    )
    rows = normalize_postings(spelled).withColumn("job_fingerprint", fingerprint())
    fields = {c: F.col(f"_last.{c}") for c in _OCCURRENCE} | {
        "salary_estimate": estimate_salary(F.col("_last.salary_range")), "source_url": F.col("job_link"),
    }
    latest = F.struct(*[fields.get(c, F.col(c)).alias(c) for c in REFRESHED])
    return rows.groupBy("job_fingerprint").agg(
        F.sum("occurrences").cast("int").alias("occurrences"),
        F.max_by(latest, F.col("_rank")).alias("latest"),
        *[fold(name).alias(name) for fold, _, name in times],
    )


def upsert(
    state: DataFrame,
    scored: DataFrame,
    as_of: Column | dt.datetime | str | None = None,
    *,
    order: tuple[str, ...] = ("msg_seq", "card_idx"),
    seen_at: str | None = None,
) -> DataFrame:
    """Merge scored postings into the state and count sightings.

    New rows start as status New. Known rows get the refreshed fields and a new
    last sighting; first sighting, status, canonical URL and description stay.
    Give ``as_of`` (one run time) or ``seen_at`` (a time column of ``scored``).
    """
    fold = fold_sightings(scored, order, seen_at)
    if seen_at is None:
        now = timestamp(as_of)
        fold = fold.withColumns({"first_at": now, "last_at": now})
    return merge_fold(state, fold)


def merge_fold(state: DataFrame, fold: DataFrame) -> DataFrame:
    """Full outer merge of folded sightings and state; both sides are one row per key.

    Batches may come in any order: times only widen, and the fields of the later sighting
    stay. A row without an id or a count gets one.
    """
    s, b = state.alias("s"), fold.alias("b")
    joined = s.join(b, F.col("s.job_fingerprint") == F.col("b.job_fingerprint"), "full_outer")
    seen = F.col("b.occurrences").isNotNull()
    known = F.col("s.job_fingerprint").isNotNull()
    later = F.col("b.last_at") >= F.col("s.last_seen_at")
    newest = seen & F.coalesce(later, F.lit(True))
    key = F.coalesce(F.col("s.job_fingerprint"), F.col("b.job_fingerprint"))
    fresh = {
        "id": F.coalesce(F.col("s.id"), surrogate_id(key)),
        "job_fingerprint": key,
        "first_seen_at": F.least(F.col("s.first_seen_at"), F.col("b.first_at")),
        "last_seen_at": F.greatest(F.col("b.last_at"), F.col("s.last_seen_at")),
        "seen_count": F.coalesce(F.col("s.seen_count"), F.lit(0))
        + F.coalesce(F.col("b.occurrences"), F.lit(0)),
        "status": F.when(known, F.col("s.status")).otherwise(F.lit("New")),
        "created_at": F.least(F.col("s.created_at"), F.col("b.first_at")),
        "updated_at": F.greatest(F.col("b.last_at"), F.col("s.updated_at")),
    }
    for name in REFRESHED:
        fresh[name] = F.when(newest, F.col(f"b.latest.{name}")).otherwise(F.col(f"s.{name}"))
    return joined.select(
        *[fresh.get(c, F.col(f"s.{c}")).cast(t).alias(c) for c, t in STATE_COLUMNS.items()]
    )


def evolve_state(state: DataFrame, as_of: Column | dt.datetime | str) -> DataFrame:
    """Older state -> full schema: absent columns are added, four are filled."""
    now = timestamp(as_of)

    def old(name: str) -> Column:
        return F.col(name) if name in state.columns else F.lit(None).cast(STATE_COLUMNS[name])

    filled = {
        "created_at": F.coalesce(old("first_seen_at"), old("last_seen_at"), now),
        "updated_at": F.coalesce(old("last_seen_at"), old("first_seen_at"), now),
        "is_expired": F.lit(False),
        "salary_estimate": estimate_salary(old("salary_range")),
        "source_url": old("job_link"),
        "seen_count": F.lit(1),
        "status": F.lit("New"),
        "id": surrogate_id(old("job_fingerprint")),
    }
    absent = {
        name: filled.get(name, F.lit(None)).cast(kind)
        for name, kind in STATE_COLUMNS.items()
        if name not in state.columns
    }
    return _in_order(state.withColumns(absent) if absent else state)


def update_rows(state: DataFrame, changes: DataFrame, columns: tuple[str, ...], as_of) -> DataFrame:
    """Overwrite ``columns`` (NULLs included) and updated_at on the ids in ``changes``."""
    new = changes.select("id", F.struct(*columns).alias("_new"))
    joined = state.join(new, "id", "left")
    hit = F.col("_new").isNotNull()
    values = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in columns}
    values["updated_at"] = F.when(hit, timestamp(as_of)).otherwise(F.col("updated_at"))
    return _in_order(joined.withColumns(values))


def latest_per_id(updates: DataFrame, order: str, *columns: str) -> DataFrame:
    """Last update per id in ``order``."""
    picked = updates.groupBy("id").agg(F.max_by(F.struct(*columns), F.col(order)).alias("_v"))
    return picked.select("id", "_v.*")


def set_status(state: DataFrame, updates: DataFrame, as_of, order: str = "update_id") -> DataFrame:
    """Apply (id, status) updates, last one per id wins; unknown statuses do nothing."""
    valid = updates.withColumn("status", normalize_status(F.col("status"))).filter("status IS NOT NULL")
    return update_rows(state, latest_per_id(valid, order, "status"), ("status",), as_of)


def invalid_statuses(updates: DataFrame) -> DataFrame:
    """Updates whose status is not allowed, kept for inspection instead of failing."""
    return updates.filter(normalize_status(F.col("status")).isNull())


def set_canonical_urls(state: DataFrame, resolved: DataFrame, as_of) -> DataFrame:
    """Store (id, canonical_url) on resolved rows only."""
    found = resolved.filter("canonical_url IS NOT NULL")
    return update_rows(state, found, ("canonical_url",), as_of)


DESCRIPTION_COLUMNS = (
    "job_description", "job_description_url", "job_description_error",
    "description_status", "description_source", "job_description_fetched_at",
)


def set_descriptions(state: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Store page results; a failed fetch clears the earlier text."""
    timed = results.withColumn("job_description_fetched_at", timestamp(as_of))
    return update_rows(state, timed, DESCRIPTION_COLUMNS, as_of)


def delete_rows(state: DataFrame, doomed: DataFrame) -> DataFrame:
    return state.join(doomed.select("id"), "id", "left_anti").select(*STATE_COLUMNS)


def find_row(state: DataFrame, row_id: int) -> DataFrame:
    return state.filter(F.col("id") == row_id)


def replace_scored(state: DataFrame, rescored: DataFrame, as_of) -> DataFrame:
    """Overwrite parsed and scored fields by id, refresh fingerprints, merge collisions.

    Rows that end up with the same fingerprint become one: earliest first and
    latest last sighting, summed counts, fields of the latest updated row, and the
    latest status that is not New.
    """
    fields = rescored.withColumns(
        {
            "salary_estimate": estimate_salary(F.col("salary_range")),
            "source_url": F.col("job_link"),
            "job_fingerprint": fingerprint(),
        }
    )
    return collapse_fingerprints(update_rows(state, fields, REWRITTEN, as_of))


def collapse_fingerprints(state: DataFrame) -> DataFrame:
    merged = ("first_seen_at", "created_at", "last_seen_at", "seen_count", "status")
    kept = [c for c in STATE_COLUMNS if c not in (*merged, "job_fingerprint")]
    recent = F.struct("updated_at", "last_seen_at", "id")
    moved = F.when(F.col("status") != "New", recent)
    out = state.groupBy("job_fingerprint").agg(
        F.max_by(F.struct(*kept), recent).alias("_row"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.min("created_at").alias("created_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        F.sum("seen_count").alias("seen_count"),
        F.coalesce(F.max_by("status", moved), F.lit("New")).alias("status"),
    )
    return _in_order(out.select("job_fingerprint", *merged, "_row.*"))
