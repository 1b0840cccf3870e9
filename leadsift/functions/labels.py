"""Short labels used by tables, digests and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsift.functions.text import WS, let, lit_map, strip, truncate
from leadsift.rules import STATUS_ALIASES

# Wording of contract, full-time and relocation signals.
CONTRACT = r"(?iuU)\b(?:contract|contractor|temporary|temp|[0-9]+\s*[- ]?\s*month)\b"
FULL_TIME = r"(?iuU)\b(?:full[ -]?time|permanent|fte)\b"
RELOCATION = r"(?iuU)\brelocat(?:e|ion|ing)\b"


def employment_type(*parts: Column) -> Column:
    """Contract beats Full-time beats Unknown over all given texts."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))
    return let(
        text,
        lambda t: F.when(t.rlike(CONTRACT), "Contract")
        .when(t.rlike(FULL_TIME), "Full-time")
        .otherwise("Unknown"),
    )


def quoted_list(values: Column) -> Column:
    """JSON-like list text: list items never run into each other."""
    return F.concat(F.lit('["'), F.array_join(values, '", "'), F.lit('"]'))


def row_employment_type() -> Column:
    """Employment type over the seven stored fields, explanation included."""
    return employment_type(
        F.col("title"), F.col("seniority"), F.col("work_mode"), F.col("salary_range"),
        quoted_list(F.col("required_skills")), quoted_list(F.col("preferred_skills")),
        F.col("explanation"),
    )


def normalize_status(status: Column) -> Column:
    """Workflow status for any known alias; NULL when not allowed."""
    return F.try_element_at(lit_map(STATUS_ALIASES), F.lower(strip(status)))


def compact_age(text: Column) -> Column:
    """'37 minutes ago' -> '37m', '2 months ago' -> '2mo'."""
    pattern = rf"([0-9]+){WS}*(minute|hour|day|week|month)"
    suffix = {"minute": "m", "hour": "h", "day": "d", "week": "w", "month": "mo"}

    def label(low: Column) -> Column:
        unit = F.regexp_extract(low, pattern, 2)
        return (
            F.when(low.isin("unknown", "none", ""), "-")
            .when(low == "today", "today")
            .when(
                unit != "",
                F.concat(
                    F.regexp_extract(low, pattern, 1), F.try_element_at(lit_map(suffix), unit)
                ),
            )
            .otherwise(truncate(strip(text), 6))
        )

    return F.when(text.isNull() | (text == ""), "-").otherwise(
        let(F.rtrim(F.lower(strip(text)), F.lit(".")), label)
    )


def _alias(value: Column, aliases: dict[str, str], size: int) -> Column:
    return F.coalesce(F.try_element_at(lit_map(aliases), value), truncate(value, size))


def category_label(category: Column) -> Column:
    return _alias(category, {"Apply now": "Apply", "Investigate": "Inv", "Skip": "Skip"}, 5)


def status_label(status: Column) -> Column:
    short = {
        "New": "New", "Reviewed": "Review", "Applied": "Appl", "Skipped": "Skip",
        "Follow-up needed": "Follow",
    }
    return _alias(status, short, 6)


def description_flag(description: Column, status: Column, error: Column) -> Column:
    """Y fetched, Blk blocked, Err failed, N not tried; in that order."""
    return (
        F.when(F.coalesce(description, F.lit("")) != "", "Y")
        .when(status == "linkedin_blocked", "Blk")
        .when(F.coalesce(error, F.lit("")) != "", "Err")
        .otherwise("N")
    )


def yes_no(flag: Column, yes: str = "Yes", no: str = "No") -> Column:
    return F.when(flag, yes).otherwise(no)


def short_time(moment: Column) -> Column:
    return F.coalesce(F.date_format(moment, "MM-dd HH:mm"), F.lit("-"))
