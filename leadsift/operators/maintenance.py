"""Preview/apply pairs over the state table.

Each operator returns a ``Change``: ``preview`` lists what would change and
``apply()`` gives the new state; both come from one plan and run no action.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsift.functions.names import normalize_company, normalize_title
from leadsift.operators.eligibility import hiring_repair
from leadsift.operators.relevance import is_noise_row
from leadsift.operators.score import score
from leadsift.operators.state import delete_rows, replace_scored
from leadsift.rules import DEFAULT_RULES, SKIP, RulePack

POSTING_FIELDS = (
    "company", "title", "location", "work_mode", "salary_range", "seniority",
    "required_skills", "preferred_skills", "job_link", "source_email",
    "posted_date", "is_expired",
)
COMPARED = ("score", "category", "is_expired", "company", "title", "explanation")


@dataclasses.dataclass(frozen=True)
class Change:
    preview: DataFrame
    apply: Callable[[], DataFrame]


def rows_as_postings(state: DataFrame, company: Column | None = None, title: Column | None = None) -> DataFrame:
    """State rows as postings, optionally with another company and title."""
    fields = {f: F.col(f) for f in POSTING_FIELDS}
    if company is not None:
        fields["company"] = company
    if title is not None:
        fields["title"] = title
    old = F.struct(*COMPARED).alias("old")
    return state.select("id", *[value.alias(name) for name, value in fields.items()], old)


def _rescored(postings: DataFrame, rules: RulePack) -> DataFrame:
    return score(postings, rules)


def _previewed(rescored: DataFrame) -> DataFrame:
    return rescored.select(
        "id",
        *[F.col(f"old.{c}").alias(f"old_{c}") for c in COMPARED],
        *[F.col(c).alias(f"new_{c}") for c in COMPARED],
    )


def rescore(state: DataFrame, as_of, rules: RulePack = DEFAULT_RULES) -> Change:
    """Rows whose score, category, expiry, names or explanation change."""
    changed = _rescored(rows_as_postings(state), rules).filter(
        ~F.struct(*COMPARED).eqNullSafe(F.col("old"))
    )
    return Change(_previewed(changed), lambda: replace_scored(state, changed, as_of))


def normalize_rows(state: DataFrame, as_of, rules: RulePack = DEFAULT_RULES) -> Change:
    """Rows whose stored company or title is not in normal form."""
    company, title = normalize_company(F.col("company")), normalize_title(F.col("title"))
    postings = rows_as_postings(state, company, title).filter(
        ~(F.col("company").eqNullSafe(F.col("old.company")) & F.col("title").eqNullSafe(F.col("old.title")))
    )
    rescored = _rescored(postings, rules)
    return Change(_previewed(rescored), lambda: replace_scored(state, rescored, as_of))


def repair_hiring(state: DataFrame, as_of, rules: RulePack = DEFAULT_RULES) -> Change:
    """Rows whose title still reads 'X is hiring a Y'."""
    found = state.withColumn("_fix", hiring_repair()).filter("_fix IS NOT NULL")
    rescored = _rescored(
        rows_as_postings(found, F.col("_fix.company"), F.col("_fix.title")), rules
    )
    return Change(_previewed(rescored), lambda: replace_scored(state, rescored, as_of))


def clean_noise(state: DataFrame) -> Change:
    """Skip rows that carry a noise marker."""
    return _deletion(state, is_noise_row())


def clean_skipped(state: DataFrame) -> Change:
    return _deletion(state, F.col("category") == SKIP)


def _deletion(state: DataFrame, doomed: Column) -> Change:
    """A deletion decided by the row itself needs no join: keep the other rows."""
    rows = state.filter(doomed)
    return Change(
        rows.select("id", "score", "company", "title"),
        lambda: state.filter(~F.coalesce(doomed, F.lit(False))),
    )


def delete_ids(state: DataFrame, ids: DataFrame) -> Change:
    """Rows listed by id; an anti join."""
    return Change(state.join(ids.select("id"), "id", "left_semi"), lambda: delete_rows(state, ids))
