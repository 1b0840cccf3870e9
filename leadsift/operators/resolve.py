"""Canonical posting URLs from search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsift.functions.text import has_any
from leadsift.functions.urls import is_generic_path, is_rejected_url, squash, title_tokens, url_host, url_path
from leadsift.operators.dedupe import keep_first
from leadsift.operators.state import set_canonical_urls
from leadsift.rules import ATS_MARKERS, CAREER_PATH_WORDS, SEARCH_SITES, SEARCH_WORDS


def search_queries(company: Column, title: Column, location: Column) -> Column:
    """Ten ordered query strings: five site-bound, five general."""
    place = F.when(
        F.coalesce(location, F.lit("")) != "", F.concat(F.lit(' "'), location, F.lit('"'))
    ).otherwise(F.lit(""))
    base = F.concat(F.lit('"'), company, F.lit('" "'), title, F.lit('"'), place)
    return F.array(
        *[F.concat(F.lit(f"site:{site} "), base) for site in SEARCH_SITES],
        *[F.concat(base, F.lit(f" {word}")) for word in SEARCH_WORDS],
    )


def query_rows(state: DataFrame, key: str = "id") -> DataFrame:
    """One row per query to run for a work list."""
    return state.select(
        F.col(key).alias("opportunity_key"),
        F.posexplode(search_queries(F.col("company"), F.col("title"), F.col("location"))).alias(
            "query_idx", "query"
        ),
    )


def first_provider(hits: DataFrame) -> DataFrame:
    """Per query only the hits of the first provider that returned any.

    The lowest rank is a map-side aggregate joined back, so one query with very
    many hits is never held in a single window.
    """
    best = hits.groupBy("opportunity_key", "query_idx").agg(F.min("provider_rank").alias("provider_rank"))
    return hits.join(best, ["opportunity_key", "query_idx", "provider_rank"])


def candidate_score() -> Column:
    """Score over columns url, hit_title, snippet, company, title; see ``score_hits``."""
    n, matched = F.size("_tokens"), F.col("_matched")
    ats, in_text, in_host = F.col("_ats"), F.col("_in_text"), F.col("_in_host")
    career = has_any(F.col("_path"), CAREER_PATH_WORDS)
    refused = (
        F.col("_rejected")
        | ((n > 0) & (matched == 0))
        | (~ats & ~(in_text & in_host & F.col("_in_url") & ~is_generic_path(F.col("_path"))))
    )
    ground = F.when(ats, 80).when(in_host, 60).when(career, 30).otherwise(0)
    share = F.when(n > 0, F.bround(F.lit(25.0) * matched / n).cast("int")).otherwise(0)
    total = (
        ground
        + F.when(in_text, 15).otherwise(0)
        + share
        - F.when(~career & ~ats, 20).otherwise(0)
    )
    return F.when(refused, 0).otherwise(F.greatest(total, F.lit(0))).cast("int")


def score_hits(hits: DataFrame) -> DataFrame:
    """Add ``candidate_score`` to rows of url, hit_title, snippet, company, title."""
    staged = hits.select(
        "*",
        F.lower(
            F.concat_ws(
                " ", F.coalesce("hit_title", F.lit("")), F.coalesce("snippet", F.lit("")), "url"
            )
        ).alias("_text"),
        url_host(F.col("url")).alias("_host"),
        url_path(F.col("url")).alias("_path"),
        squash(F.col("company")).alias("_key"),
        title_tokens(F.col("title")).alias("_tokens"),
        is_rejected_url(F.col("url")).alias("_rejected"),
    )
    known = F.col("_key") != ""
    tested = staged.select(
        "*",
        F.size(F.filter("_tokens", lambda t: F.col("_text").contains(t))).alias("_matched"),
        F.exists(
            "_tokens", lambda t: F.concat_ws(" ", "_host", "_path").contains(t)
        ).alias("_in_url"),
        (known & squash(F.col("_text")).contains(F.col("_key"))).alias("_in_text"),
        (known & squash(F.col("_host")).contains(F.col("_key"))).alias("_in_host"),
        has_any(F.col("_host"), ATS_MARKERS).alias("_ats"),
    )
    return tested.select(*hits.columns, candidate_score().alias("candidate_score"))


def best_candidates(scored: DataFrame) -> DataFrame:
    """Best URL per opportunity: first hit per URL, then score, then earliest.

    Both steps are row-number filters, which Spark cuts down before each shuffle.
    """
    first = keep_first(
        scored, [F.col("opportunity_key"), F.col("url")], ["query_idx", "result_idx"]
    )
    best = keep_first(
        first.filter("candidate_score > 0"),
        [F.col("opportunity_key")],
        [F.desc("candidate_score"), F.col("query_idx"), F.col("result_idx")],
    )
    return best.select("opportunity_key", F.col("url").alias("canonical_url"), "candidate_score")


def resolve(opportunities: DataFrame, hits: DataFrame, key: str = "id") -> DataFrame:
    """Opportunities joined with their hits -> best canonical URL per opportunity."""
    wanted = opportunities.select(F.col(key).alias("opportunity_key"), "company", "title")
    usable = first_provider(hits.filter("coalesce(url, '') <> ''"))
    joined = usable.withColumnRenamed("title", "hit_title").join(wanted, "opportunity_key")
    return best_candidates(score_hits(joined))


def resolve_state(state: DataFrame, worklist: DataFrame, hits: DataFrame, as_of) -> DataFrame:
    """State with the canonical URLs found for a work list."""
    found = resolve(worklist, hits).withColumnRenamed("opportunity_key", "id")
    return set_canonical_urls(state, found, as_of)
