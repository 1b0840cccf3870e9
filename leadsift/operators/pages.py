"""Page snapshots -> stored descriptions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsift.functions.dates import timestamp
from leadsift.functions.html import looks_like_html, page_text
from leadsift.functions.text import count_hits, has_any, let, paragraphs, squeeze
from leadsift.functions.urls import url_scheme
from leadsift.operators.dedupe import keep_first
from leadsift.operators.eligibility import fetch_target
from leadsift.operators.state import set_descriptions
from leadsift.rules import (
    AUTHWALL_PHRASES,
    DESCRIPTION_MIN_CHARS,
    LOGIN_WALL_PHRASES,
)

BLOCKED_ERROR = "LinkedIn alert URL has no canonical posting URL."


def decode_payload(payload: Column, content_type: Column) -> Column:
    """Bytes -> text by the charset of the content type, bad bytes replaced.

    Valid UTF-8 is cast. The rest goes through an Arrow UDF: Spark's own decoder knows seven charsets
    and fails on bad bytes.
    """

    @F.pandas_udf("string")
    def decode(data: pd.Series, charset: pd.Series) -> pd.Series:
        def one(raw, name):
            if raw is None:
                return None
            try:
                return bytes(raw).decode(name or "utf-8", errors="replace")
            except LookupError:
                return bytes(raw).decode("utf-8", errors="replace")

        return pd.Series([one(r, n) for r, n in zip(data, charset)], dtype="object")

    charset = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=([^;\s]+)", 1)
    text = payload.cast("string")
    plain = F.coalesce(F.lower(charset).isin("", "utf-8", "utf8") & F.is_valid_utf8(text), F.lit(False))
    return F.when(plain, text).otherwise(decode(F.when(~plain, payload), charset))


def quality_error(text: Column, url: Column) -> Column:
    """Why a text must not be stored: auth wall, login wall, too short; else NULL."""

    def check(low: Column) -> Column:
        flat = squeeze(low)
        wall = F.coalesce(F.lower(url).contains("linkedin.com/ssr-login"), F.lit(False)) | let(
            flat,
            lambda t: (
                t.contains("we're signing you in") & t.contains("discover people, jobs, and more")
            )
            | (t.contains("linkedin") & (count_hits(t, LOGIN_WALL_PHRASES) >= 3)),
        )
        return (
            F.when(has_any(low, AUTHWALL_PHRASES), "authwall detected")
            .when(wall, "login wall detected")
            .when(F.length(text) < DESCRIPTION_MIN_CHARS, "description text below 500 characters")
        )

    return let(F.lower(text), check)


def describe_pages(
    snapshots: DataFrame, extractor: Callable[[Column], Column] | None = None, max_chars: int | None = None
) -> DataFrame:
    """(url, final_url, content_type, html, fetch_error) -> url, description, final_url, error.

    Descriptions are whole unless ``max_chars`` cuts them.
    """
    whole = F.col("text") if max_chars is None else F.left("text", F.lit(max_chars))
    html = F.coalesce("html", F.lit(""))
    is_html = F.lower(F.coalesce("content_type", F.lit(""))).contains("html") | looks_like_html(html)
    readable = F.coalesce("fetch_error", F.lit("")) == ""
    texts = snapshots.select(
        "url", "final_url", "fetch_error",
        F.when(readable, F.when(is_html, page_text(html, extractor)).otherwise(paragraphs(html))).alias("text"),
    )
    checked = texts.withColumn("problem", quality_error(F.col("text"), F.col("final_url")))
    missing = F.coalesce("url", F.lit("")) == ""
    odd = ~url_scheme(F.col("url")).isin("http", "https")
    error = (
        F.when(missing, "missing job URL")
        .when(odd, "unsupported URL scheme")
        .when(F.coalesce("fetch_error", F.lit("")) != "", F.col("fetch_error"))
        .when(F.col("text") == "", "no readable text found")
        .otherwise(F.col("problem"))
    )
    return checked.withColumn("error", error).select(
        "url",
        F.when(F.col("error").isNull(), whole).alias("description"),
        F.when(missing, F.lit(None).cast("string"))
        .when(odd | F.col("final_url").isNull(), F.col("url"))
        .otherwise(F.col("final_url"))
        .alias("final_url"),
        "error",
    )


def snapshot_at(wanted: DataFrame, snapshots: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """As-of join: for each (url, at) of ``wanted`` the ``columns`` of the last snapshot not after ``at``.

    Both sides go into one time line per URL, on which the last snapshot is carried forward: one
    shuffle, and no row meets more than its own snapshot. Pages travel as a key: the line holds
    (url, fetched_at) alone, cut to the wanted URLs, and the pages themselves are joined to the
    chosen snapshots. Times of one URL are spread over as many tasks as it has days: the carry
    runs within a day first, and days pass on their last snapshot. Of two snapshots of one moment
    the one with the lesser final URL counts.
    """
    page = F.struct(*[F.col(c) for c in columns])
    asked = wanted.select("url", "at").distinct()
    kept = snapshots.where("url IS NOT NULL AND fetched_at IS NOT NULL").join(asked.select("url").distinct(), "url", "left_semi")
    moments = kept.select("url", F.col("fetched_at").alias("at"), F.col("fetched_at").alias("snapshot_at")).distinct()
    line = moments.withColumn("asked", F.lit(False)).unionByName(
        asked.withColumns({"snapshot_at": F.lit(None).cast("timestamp"), "asked": F.lit(True)})
    )
    line = line.withColumn("day", F.to_date("at"))
    in_day = Window.partitionBy("url", "day").orderBy("at", F.col("snapshot_at").asc_nulls_last())
    carried = line.withColumn("_same_day", F.last("snapshot_at", ignorenulls=True).over(in_day))
    days = line.groupBy("url", "day").agg(F.max("snapshot_at").alias("_last"))
    before = Window.partitionBy("url").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = days.select("url", "day", F.last("_last", ignorenulls=True).over(before).alias("_earlier"))
    chosen = (
        carried.where("asked").join(earlier, ["url", "day"])
        .select("url", "at", F.coalesce("_same_day", "_earlier").alias("fetched_at"))
        .where("fetched_at IS NOT NULL")
    )
    best = kept.join(chosen.select("url", "fetched_at").distinct(), ["url", "fetched_at"], "left_semi")
    best = keep_first(best, [F.col("url"), F.col("fetched_at")], [F.col("final_url")]).select("url", "fetched_at", page.alias("_page"))
    return chosen.join(best, ["url", "fetched_at"]).select("url", "at", "fetched_at", "_page.*")


def fetch_results(
    worklist: DataFrame, snapshots: DataFrame, extractor: Callable[[Column], Column] | None = None, as_of=None
) -> DataFrame:
    """Work-list rows joined with the text of their page.

    Only wanted pages are read into text, once per URL, before the join back; a
    page shared by very many rows is extracted a single time. Snapshots with a
    ``fetched_at`` are those last fetched not after ``as_of``, or the newest without it.
    """
    due = worklist.select("id", "source_url", "job_link", fetch_target().alias("_t")).select(
        "id", "_t.url", "_t.source", F.coalesce(F.nullif("source_url", F.lit("")), "job_link").alias("link")
    )
    wanted = due.select("url").filter("url IS NOT NULL").distinct()
    if as_of is not None and "fetched_at" in snapshots.columns:
        asked = wanted.withColumn("at", timestamp(as_of))
        pages = snapshot_at(asked, snapshots, ("final_url", "content_type", "html", "fetch_error"))
    else:
        order = [F.desc("fetched_at")] if "fetched_at" in snapshots.columns else [F.col("final_url")]
        pages = keep_first(snapshots.join(wanted, "url", "left_semi"), [F.col("url")], order)
    texts = describe_pages(pages, extractor).withColumn("_seen", F.lit(True))
    # Blocked rows have no URL and may be most of the list: they take no part in the join.
    found = due.filter("url IS NOT NULL").join(texts, "url", "left")
    joined = found.unionByName(due.filter("url IS NULL"), allowMissingColumns=True)
    blocked = F.col("url").isNull()
    return joined.select(
        "id",
        F.col("description").alias("job_description"),
        F.when(blocked, F.col("link")).otherwise(F.coalesce("final_url", "url")).alias("job_description_url"),
        F.when(blocked, F.lit(BLOCKED_ERROR))
        .when(F.col("_seen").isNull(), F.lit("page snapshot missing"))
        .otherwise(F.col("error"))
        .alias("job_description_error"),
        F.when(blocked, "linkedin_blocked")
        .when(F.col("description").isNotNull(), "fetched")
        .otherwise("fetch_failed")
        .alias("description_status"),
        F.col("source").alias("description_source"),
    )


def fetch_descriptions(
    state: DataFrame, worklist: DataFrame, snapshots: DataFrame, as_of,
    extractor: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """State after reading the pages of a work list."""
    return set_descriptions(state, fetch_results(worklist, snapshots, extractor, as_of), as_of)
