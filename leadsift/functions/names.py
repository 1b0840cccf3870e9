"""Display normalisation of company names and role titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsift.functions.text import any_of, is_lower, let, lit_map, squeeze, title_case
from leadsift.rules import ACRONYMS, COMPANY_NAMES

_EDGE = " -*|"

# Suffixes dropped from company names (text is squeezed first).
COMPANY_TRIMS = (
    r"(?iu)\s+(?:is hiring|jobs?|careers?|hiring)$",
    r"(?iu)\s*:\s*(?:up to|update|new jobs?|jobs?|hiring).*$",
    r"(?iu)\s+-\s*(?:up to|jobs?|hiring).*$",
    r"(?iu)\s+and more$",
)
PRONOUN_LIKE = r"(?iuU)\b(?:you|your|we|can|help|get|noticed|project|ring)\b"
# Prefixes and suffixes dropped from titles, in this order.
TITLE_TRIMS = (
    r"(?iu)^message replied:\s*",
    r"(?iu)^re:\s*",
    r"(?iu)^fw(?:d)?:\s*",
    r"(?iu)^.+?,\s+apply to\s+",
    r"(?iu)^new jobs similar to\s+",
    r"(?iu)^.+?,\s+your job(?:'|')?s expiring on .*?:\s*",
    r"\s+-\s+[0-9]+\s*$",
    r"(?iu)\s*\|\s*remote\s*$",
    r"(?iu)\s*\((?:remote|hybrid|on-site|onsite)\)\s*$",
)
CORE_TITLE = (
    r"(?iuU)(?:exciting\s+)?((?:senior\s+|staff\s+)?(?:machine learning engineer|"
    r"ml engineer|data scientist|ai engineer|applied ai engineer))\b"
)


def _drop(text: Column, patterns: tuple[str, ...], marks: str, unmarked: tuple[int, ...]) -> Column:
    """Patterns removed in turn; those not in `unmarked` match only texts with one of `marks`."""

    def dropped(value: Column, some: tuple[str, ...]) -> Column:
        for pattern in some:
            value = F.regexp_replace(value, pattern, "")
        return value

    return let(
        text,
        lambda t: F.when(t.rlike(marks), dropped(t, patterns)).otherwise(dropped(t, tuple(patterns[i] for i in unmarked))),
    )


def fix_acronyms(text: Column) -> Column:
    """Upper-case the known role acronyms left in title case."""

    def fix(value: Column) -> Column:
        fixed = value
        for word, acronym in ACRONYMS:
            fixed = F.regexp_replace(fixed, rf"(?U)\b{word}\b", acronym)
        return F.when(any_of(value.contains(w) for w, _ in ACRONYMS), fixed).otherwise(value)

    return let(text, fix)


def normalize_company(name: Column) -> Column:
    """Consistent company spelling; NULL or '' gives 'Unknown'."""

    def spell(text: Column) -> Column:
        key = F.btrim(F.replace(F.lower(text), F.lit("."), F.lit("")))
        plain = (
            (text != "")
            & (F.size(F.split(text, " ")) <= 3)
            & ~text.rlike(PRONOUN_LIKE)
            & ~F.substring(text, 2, 2**31 - 1).rlike(r"\p{Lu}")
        )
        return F.coalesce(
            F.try_element_at(lit_map(COMPANY_NAMES), key),
            F.when(plain, fix_acronyms(title_case(text))).otherwise(text),
        )

    cleaned = F.rtrim(_drop(F.btrim(squeeze(name), F.lit(_EDGE)), COMPANY_TRIMS, "[:-]", (0, 3)), F.lit("."))
    return F.when(name.isNull() | (name == ""), F.lit("Unknown")).otherwise(let(cleaned, spell))


def normalize_title(title: Column) -> Column:
    """Consistent role title; NULL or '' gives 'Unknown role'."""
    cleaned = F.rtrim(_drop(F.btrim(squeeze(title), F.lit(_EDGE)), TITLE_TRIMS, "[:,|(-]", (4,)), F.lit("."))
    cased = let(cleaned, lambda t: F.when(is_lower(t), title_case(t)).otherwise(t))
    return F.when(title.isNull() | (title == ""), F.lit("Unknown role")).otherwise(
        fix_acronyms(cased)
    )


def clean_title(title: Column) -> Column:
    """Normalised title, reduced to its core role phrase when it has one.

    A core phrase is made of plain words, so word-initial capitals and the two
    acronyms it can hold are all the normalisation it needs.
    """

    def core_only(core: Column) -> Column:
        words = F.initcap(core)
        for word in ("Ai", "Ml"):
            words = F.replace(words, F.lit(f"{word} "), F.lit(f"{word.upper()} "))
        return words

    return let(
        normalize_title(title),
        lambda t: let(
            F.regexp_extract(t, CORE_TITLE, 1),
            lambda core: F.when(core == "", t).otherwise(core_only(core)),
        ),
    )
