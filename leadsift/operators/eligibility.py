"""Row predicates over the state table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsift.functions.dates import timestamp
from leadsift.functions.text import WS_CHARS, blank_to_null
from leadsift.functions.urls import is_blocked_url
from leadsift.operators.extract import COMPANY_HIRING
from leadsift.rules import APPLY, INVESTIGATE


def visible(include_investigate: bool) -> Column:
    return F.col("category").isin(*([APPLY, INVESTIGATE] if include_investigate else [APPLY]))


def _has(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def source_link() -> Column:
    return F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("job_link", F.lit("")))


def _first_seen_since(as_of, hours: int) -> Column:
    now = timestamp(as_of)
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    # A row without a readable time counts as just seen.
    return F.col("first_seen_at").isNull() | (F.col("first_seen_at") >= cutoff)


def digest_rows(
    as_of: Column | dt.datetime | str, since_hours: int = 24, include_investigate: bool = False
) -> Column:
    return visible(include_investigate) & ~F.col("is_expired") & _first_seen_since(as_of, since_hours)


def alert_rows(
    as_of: Column | dt.datetime | str,
    since_hours: int = 48,
    include_investigate: bool = False,
    minimum_score: int | None = None,
    max_seen_count: int | None = 3,
) -> Column:
    """Digest rows still New, seen fewer than ``max_seen_count`` times."""
    test = digest_rows(as_of, since_hours, include_investigate) & (F.col("status") == "New")
    if minimum_score is not None:
        test = test & (F.col("score") >= minimum_score)
    if max_seen_count is not None:
        test = test & (F.col("seen_count") < max_seen_count)
    return test


def _open(include_investigate: bool) -> Column:
    return visible(include_investigate) & (F.col("status") == "New") & ~F.col("is_expired")


def needs_description(include_investigate: bool = False, force: bool = False) -> Column:
    linked = _has("canonical_url") | _has("source_url") | _has("job_link")
    test = _open(include_investigate) & linked
    return test if force else test & ~_has("job_description")


def needs_canonical_url(include_investigate: bool = False, force: bool = False) -> Column:
    test = _open(include_investigate) & is_blocked_url(source_link())
    return test if force else test & ~_has("canonical_url")


def has_description() -> Column:
    return F.coalesce(F.btrim("job_description", F.lit(WS_CHARS)), F.lit("")) != ""


def hiring_repair() -> Column:
    """(company, title) read from a stored 'X is hiring a Y' title, NULL otherwise."""
    title = F.col("title")
    hit = F.when(F.lower(title).contains("is hiring"), F.regexp_extract(title, COMPANY_HIRING, 1) != "")
    return F.when(
        hit,
        F.struct(
            blank_to_null(F.regexp_extract(title, COMPANY_HIRING, 1)).alias("company"),
            blank_to_null(F.regexp_extract(title, COMPANY_HIRING, 2)).alias("title"),
        ),
    )


def fetch_target() -> Column:
    """(url, source) to read page text from; a blocked link without canonical URL has none."""
    link = source_link()
    return (
        F.when(_has("canonical_url"), F.struct(F.col("canonical_url").alias("url"), F.lit("canonical_url").alias("source")))
        .when(
            is_blocked_url(link),
            F.struct(F.lit(None).cast("string").alias("url"), F.lit("linkedin_alert_only").alias("source")),
        )
        .otherwise(F.struct(link.alias("url"), F.lit("source_url").alias("source")))
    )
