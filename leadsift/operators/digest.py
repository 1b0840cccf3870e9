"""Review order, ranked digests, work lists and review tables.

Every list is a filter followed by ``orderBy().limit()``, which Spark plans as a
per-task top-k. Text is rendered from at most ``limit`` rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsift.functions import labels
from leadsift.functions.money import salary_label
from leadsift.functions.text import preview, truncate
from leadsift.operators.eligibility import (
    alert_rows,
    digest_rows,
    has_description,
    needs_canonical_url,
    needs_description,
)
from leadsift.rules import APPLY, INVESTIGATE, SKIP
from leadsift.sources.shared import shared_folder

ALERT_WHY_CHARS = 260


def review_order() -> list[Column]:
    """Category rank, newest first sighting, score; id settles ties."""
    category = F.col("category")
    rank = F.when(category == APPLY, 0).when(category == INVESTIGATE, 1).when(category == SKIP, 2).otherwise(3)
    return [rank, F.desc("first_seen_at"), F.desc("score"), F.col("id")]


def review_list(state: DataFrame) -> DataFrame:
    return state.orderBy(*review_order())


def top_review(state: DataFrame, condition: Column, limit: int) -> DataFrame:
    return state.filter(condition).orderBy(*review_order()).limit(limit)


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Number at most ``limit`` already selected rows."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def ranked_rows(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """All rows numbered from 1 in ``order``, without bringing them into one task.

    Rows go to ranges of the order; each range is numbered on its own, from the number of rows in
    the ranges before it. The ranges are written to the shared folder, so that the numbers agree
    with the counts also after a lost executor. Rows equal in all of ``order`` share a range and
    are numbered in any order, so end it with a key.
    """
    folder = shared_folder(rows.sparkSession, "ranked")
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(folder)
    kept = rows.sparkSession.read.schema(ranged.schema).parquet(folder)
    counts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range: as many as there were partitions, whatever the number of rows.
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        kept.withColumn("_inside", inside).join(F.broadcast(before), "_range")
        .select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))
    )


def ranked_digest(
    scored: DataFrame,
    limit: int = 10,
    include_skips: bool = False,
    tie_order: tuple[str, ...] = ("msg_seq", "card_idx"),
) -> DataFrame:
    """Best scored postings of a run; equal scores keep input order."""
    order = [F.desc("score"), *[F.col(c) for c in tie_order]]
    shown = scored if include_skips else scored.filter(F.col("category").isin(APPLY, INVESTIGATE))
    return _numbered(shown.orderBy(*order).limit(limit), order)


def stored_digest(
    state: DataFrame, as_of: Column | dt.datetime | str, since_hours: int = 24,
    limit: int = 10, include_investigate: bool = False,
) -> DataFrame:
    rows = top_review(state, digest_rows(as_of, since_hours, include_investigate), limit)
    return _numbered(rows, review_order())


def alert_digest(
    state: DataFrame, as_of: Column | dt.datetime | str, since_hours: int = 48, limit: int = 5,
    include_investigate: bool = False, minimum_score: int | None = None,
    max_seen_count: int | None = 3,
) -> DataFrame:
    test = alert_rows(as_of, since_hours, include_investigate, minimum_score, max_seen_count)
    return _numbered(top_review(state, test, limit), review_order())


def description_worklist(
    state: DataFrame, limit: int | None = 5, include_investigate: bool = False, force: bool = False
) -> DataFrame:
    due = state.filter(needs_description(include_investigate, force))
    return due if limit is None else due.orderBy(*review_order()).limit(limit)


def resolution_worklist(
    state: DataFrame, limit: int | None = 10, include_investigate: bool = False, force: bool = False
) -> DataFrame:
    due = state.filter(needs_canonical_url(include_investigate, force))
    return due if limit is None else due.orderBy(*review_order()).limit(limit)


def review_table(state: DataFrame, debug: bool = False) -> DataFrame:
    """Compact or debug columns for review, unordered; see ``review_order``."""
    compact = {
        "id": F.col("id"),
        "score": F.col("score"),
        "action": labels.category_label(F.col("category")),
        "status": labels.status_label(F.col("status")),
        "desc": labels.description_flag(
            F.col("job_description"), F.col("description_status"), F.col("job_description_error")
        ),
        "added": labels.short_time(F.col("first_seen_at")),
        "company": truncate(F.col("company"), 13),
        "title": truncate(F.col("title"), 76 if debug else 92),
    }
    if debug:
        kind = labels.row_employment_type()
        compact |= {
            "salary": salary_label(F.col("salary_estimate"), "-"),
            "type": F.when(kind == "Unknown", "-").otherwise(kind),
            "seen": F.col("seen_count"),
            "expired": labels.yes_no(F.col("is_expired"), "Y", "N"),
            "posted": labels.compact_age(F.col("posted_date")),
        }
    return state.select(*[value.alias(name) for name, value in compact.items()])


def row_details(rows: DataFrame) -> DataFrame:
    """Labelled detail columns of single rows, blanks spelled out."""

    def shown(name: str, missing: str) -> Column:
        return F.coalesce(F.nullif(name, F.lit("")), F.lit(missing)).alias(name)

    return rows.select(
        "id", "company", "title", "score", "category", "status",
        shown("location", "Unknown location"),
        shown("work_mode", "Unknown"),
        labels.row_employment_type().alias("employment_type"),
        shown("salary_range", "Unknown"),
        salary_label(F.col("salary_estimate")).alias("salary_estimation"),
        labels.yes_no(F.col("is_expired")).alias("expired"),
        shown("posted_date", "Unknown"),
        shown("job_link", "No job URL found"),
        F.coalesce(
            F.nullif("source_url", F.lit("")), F.nullif("job_link", F.lit("")),
            F.lit("No source URL found"),
        ).alias("source_url"),
        shown("canonical_url", "Unknown"),
        labels.yes_no(F.coalesce("job_description", F.lit("")) != "").alias("description_fetched"),
        shown("description_status", "Unknown"),
        shown("description_source", "Unknown"),
        "job_description_fetched_at", "job_description_error", "seen_count",
        "first_seen_at", "last_seen_at", "created_at", "updated_at",
    )


def review_descriptions(state: DataFrame, limit: int = 10, chars: int = 600) -> DataFrame:
    """Fetched descriptions in review order with length, source, URL and preview."""
    urls = [F.nullif(c, F.lit("")) for c in ("job_description_url", "canonical_url", "source_url", "job_link")]
    rows = _numbered(top_review(state, has_description(), limit), review_order())
    return rows.select(
        "rank", "id", "company", "title",
        F.coalesce(F.nullif("description_source", F.lit("")), F.lit("Unknown")).alias("source"),
        F.coalesce(*urls, F.lit("Unknown")).alias("url"),
        F.length("job_description").alias("chars"),
        preview(F.col("job_description"), chars).alias("preview"),
    )


# ---------------------------------------------------------------------------
# Rendered text: one row, one column, from at most ``limit`` ranked rows
# ---------------------------------------------------------------------------
def _heading(include_investigate: bool) -> str:
    return "Apply now and Investigate" if include_investigate else APPLY


def _link() -> Column:
    return F.coalesce(F.nullif("job_link", F.lit("")), F.lit("No job URL found"))


def _render(rows: DataFrame, head: Column | str, block: Column, empty: str, gap: str) -> DataFrame:
    blocks = F.sort_array(F.collect_list(F.struct("rank", block.alias("text"))))
    text = F.array_join(F.transform(blocks, lambda b: b["text"]), gap)
    head = F.lit(head) if isinstance(head, str) else head
    return rows.agg(F.count(F.lit(1)).alias("n"), text.alias("body")).select(
        F.when(F.col("n") == 0, F.lit(empty)).otherwise(F.concat(head, F.col("body"))).alias("text")
    )


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def render_ranked(ranked: DataFrame, heading: str = "Ranked action digest") -> DataFrame:
    block = _line(
        F.col("rank"), ". ", F.col("category"), " [", F.col("score"), "]\n   ",
        F.col("company"), " - ", F.col("title"), "\n   Location: ",
        F.coalesce(F.nullif("location", F.lit("")), F.lit("Unknown location")),
        "\n   Link: ", _link(), "\n   Why: ", F.col("explanation"),
    )
    return _render(ranked, f"{heading}\n\n", block, "No Apply now or Investigate opportunities found.", "\n")


def render_stored(ranked: DataFrame, since_hours: int = 24, include_investigate: bool = False) -> DataFrame:
    kind = _heading(include_investigate)
    block = _line(
        F.col("rank"), ". [", F.col("score"), "] #", F.col("id"), " ", F.col("company"), " - ",
        F.col("title"), "\n   First seen: ", labels.short_time(F.col("first_seen_at")),
        "\n   Link: ", _link(), "\n   Why: ", F.col("explanation"),
    )
    return _render(
        ranked, f"{kind} digest - last {since_hours} hour(s)\n\n", block,
        f"No {kind} jobs first seen in the last {since_hours} hour(s).", "\n",
    )


def render_alert(
    ranked: DataFrame, since_hours: int = 48, include_investigate: bool = False,
    minimum_score: int | None = None, max_seen_count: int | None = 3,
) -> DataFrame:
    kind = _heading(include_investigate)
    limits = [f"score >= {minimum_score}"] if minimum_score is not None else []
    limits += [f"seen < {max_seen_count}"] if max_seen_count is not None else []
    scope = f"{since_hours} hour(s)" + (f" with {' and '.join(limits)}" if limits else "")
    employment = labels.row_employment_type()
    block = _line(
        F.col("rank"), ". [", F.col("score"), "] #", F.col("id"), " ", F.col("company"), " - ",
        F.col("title"), "\n   Posted: ", labels.compact_age(F.col("posted_date")), " | Salary: ",
        salary_label(F.col("salary_estimate"), "-"), " | Type: ",
        F.when(employment == "Unknown", "-").otherwise(employment),
        "\n   Link: ", _link(), "\n   Why: ", truncate(F.col("explanation"), ALERT_WHY_CHARS),
    )
    head = _line("Digest: ", F.col("n"), f" {kind} job(s)\nWindow: last {scope}\n\n")
    return _render(ranked, head, block, f"No {kind} jobs found in the last {scope}.", "\n\n")
