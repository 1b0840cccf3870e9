"""Additive rule score with an explanation.

Three column stages: texts, matched terms, points. Every stage is bound before
the next one reads it, so a text is lower-cased and searched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsift.functions import dates, labels
from leadsift.functions.money import max_salary
from leadsift.functions.names import normalize_company, normalize_title
from leadsift.functions.text import column_cache, first_name, has_any, hits, sql_text
from leadsift.rules import (
    AI_FOCUS_TERMS,
    APPLY,
    CORE_ROLE_TERMS,
    DEFAULT_RULES,
    HIGH_INTENT_TERMS,
    INVESTIGATE,
    SKIP,
    TARGET_ROLE_TERMS,
    TIER_A_NEEDS_AI_FOCUS,
    RulePack,
    display_name,
)

# Components in explanation order.
_COMPONENTS = (
    "role", "location", "skills", "domain", "always", "tier", "strategic", "seniority",
    "salary", "fresh", "penalty", "expired",
)
STALE_DAYS = 14
FRESH_MINUTES = 120


@column_cache
def _normal_names() -> dict[str, Column]:
    return {"company": normalize_company(F.col("company")), "title": normalize_title(F.col("title"))}


def normalize_postings(df: DataFrame) -> DataFrame:
    """Normalised company and title, everything else untouched."""
    return df.withColumns(_normal_names())


def searchable_text() -> Column:
    """Lower-cased company, title, place, level, mode and skills."""
    parts = [
        F.col("company"), F.col("title"), F.col("location"), F.col("seniority"),
        F.col("work_mode"), F.array_join("required_skills", " "),
        F.array_join("preferred_skills", " "),
    ]
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def _texts(df: DataFrame) -> DataFrame:
    skills = F.concat("required_skills", "preferred_skills")
    return df.select(
        "*",
        F.lower("title").alias("_title"),
        F.lower(F.concat_ws(" ", "company", "title")).alias("_name"),
        searchable_text().alias("_all"),
        F.lower(F.array_join(skills, " ")).alias("_skills"),
        F.lower(
            F.concat_ws(
                " ", "title", "company", F.array_join("required_skills", " "),
                F.array_join("preferred_skills", " "),
            )
        ).alias("_domain"),
        dates.age_days(F.col("posted_date")).alias("_days"),
        dates.age_minutes(F.col("posted_date")).alias("_minutes"),
        max_salary(F.nullif("salary_range", F.lit(""))).alias("_salary"),
    )


def _matches(df: DataFrame, rules: RulePack) -> DataFrame:
    return df.select(
        "*",
        first_name("_all", rules.never).alias("_never"),
        first_name("_all", rules.always).alias("_always"),
        F.array_join(hits("_title", rules.role_terms), ", ").alias("_roles"),
        hits("_skills", rules.skill_terms).alias("_skill_hits"),
        hits("_domain", rules.domain_terms).alias("_domain_hits"),
        first_name("_name", rules.tier_a).alias("_a"),
        first_name("_name", rules.tier_b).alias("_b"),
        first_name("_name", rules.tier_c).alias("_c"),
        first_name("_all", rules.ai_native).alias("_native"),
        first_name("_all", rules.tier_c).alias("_c_any"),
        has_any("_title", TARGET_ROLE_TERMS).alias("_target"),
        has_any("_all", AI_FOCUS_TERMS).alias("_focus"),
        has_any("_all", HIGH_INTENT_TERMS).alias("_intent"),
        has_any("_all", rules.strategic_terms).alias("_strategic"),
        has_any("_all", rules.limited_terms).alias("_limited"),
        F.expr(f"coalesce(is_expired, false) OR coalesce(_days >= {STALE_DAYS}, false)").alias("_expired"),
    )


def _cases(*branches: tuple[Column, int, str | Column]) -> Column:
    """First true branch as (points, why); none gives (0, NULL)."""
    column = None
    for test, points, why in branches:
        value = F.struct(
            F.lit(points).alias("points"),
            (F.lit(why) if isinstance(why, str) else why).alias("why"),
        )
        column = F.when(test, value) if column is None else column.when(test, value)
    nothing = F.struct(F.lit(0).alias("points"), F.lit(None).cast("string").alias("why"))
    return column.otherwise(nothing)


def _named(prefix: str, name: Column, rules: RulePack, suffix: str = "") -> Column:
    """Explanation with a configured company in its display spelling."""
    terms = {
        *rules.tier_a, *rules.tier_b, *rules.tier_c, *rules.always, *rules.never, *rules.ai_native,
    }
    pairs = ", ".join(f"{sql_text(t)}, {sql_text(display_name(t))}" for t in sorted(terms))
    shown = F.try_element_at(F.expr(f"map({pairs})"), name)
    return F.concat(F.lit(prefix), shown, F.lit(suffix))


@column_cache
def _components(rules: RulePack) -> dict[str, Column]:
    col = F.col
    title, target, focus = col("_title"), col("_target"), col("_focus")
    level = F.lower(F.coalesce("seniority", F.lit("")))
    any_true = F.lit(True)
    picky = col("_a").isin(*TIER_A_NEEDS_AI_FOCUS) & ~focus

    def level_is(word: str) -> Column:
        return level.contains(word) | title.contains(word)

    return {
        "role": _cases(
            (col("_roles") != "", 30, F.concat(F.lit("strong role-title match: "), col("_roles"))),
            (has_any("_title", CORE_ROLE_TERMS), 28, "core role-family match"),
            (has_any("_title", ("machine learning", "ai")), 22, "partial role-title match"),
            (has_any("_title", ("analyst", "marketing")), 0, "role title is outside target roles"),
            (any_true, 8, "role title has limited target alignment"),
        ),
        "location": _cases((any_true, 20, "location not scored yet")),
        "skills": F.struct(
            F.least(F.lit(25), F.size("_skill_hits") * 5).alias("points"),
            F.when(F.size("_skill_hits") == 0, "no target skill match found")
            .otherwise(
                F.concat(
                    F.lit("target skills matched: "),
                    F.array_join(F.slice("_skill_hits", 1, 5), ", "),
                )
            )
            .alias("why"),
        ),
        "domain": _cases(
            (
                target & (F.size("_domain_hits") > 0),
                8,
                F.concat(
                    F.lit("relevant DS domain signal: "),
                    F.array_join(F.slice("_domain_hits", 1, 4), ", "),
                ),
            )
        ),
        "always": _cases(
            (col("_always").isNotNull(), 15, _named("personal company whitelist: ", col("_always"), rules))
        ),
        "tier": _cases(
            (picky, 0, _named("", col("_a"), rules, " needs AI/platform focus for tier A boost")),
            (col("_a").isNotNull(), 10, _named("tier A company preference: ", col("_a"), rules)),
            (col("_b").isNotNull(), 6, _named("tier B company preference: ", col("_b"), rules)),
            (
                col("_c").isNotNull() & focus,
                3,
                _named("traditional enterprise with AI/platform focus: ", col("_c"), rules),
            ),
        ),
        "strategic": _cases(
            (
                col("_native").isNotNull() & target & col("_strategic"),
                14,
                _named("strategic next step: ", col("_native"), rules, " moves toward AI engineering"),
            ),
            (
                (F.coalesce("job_link", F.lit("")) != "") & target & col("_intent"),
                6,
                "strategic next step: role builds Applied AI/AI systems direction",
            ),
            (
                col("_c_any").isNotNull() & col("_limited"),
                -8,
                _named(
                    "limited strategic movement: ", col("_c_any"), rules,
                    " role appears enterprise/compliance-focused",
                ),
            ),
            (col("_limited"), -4, "limited strategic movement toward long-term AI direction"),
        ),
        "seniority": _cases(
            (level_is("staff"), 15, "staff-level growth signal"),
            (level_is("senior"), 14, "senior-level match"),
            (level_is("junior"), -12, "junior role is below target seniority"),
            (level == "", 4, "seniority unclear"),
            (any_true, 6, "seniority has limited target alignment"),
        ),
        "salary": _cases(
            (F.coalesce("salary_range", F.lit("")) == "", 3, "salary missing"),
            (col("_salary").isNull(), 4, "salary listed but could not be parsed"),
            (col("_salary") >= 200_000, 10, "salary signal is strong"),
            (col("_salary") >= 160_000, 7, "salary signal is reasonable"),
            (col("_salary") >= 120_000, 4, "salary signal is moderate"),
            (any_true, 0, "salary appears below target trajectory"),
        ),
        "fresh": _cases(
            (col("_minutes") <= FRESH_MINUTES, 0, "fresh posting: posted within the last 2 hours")
        ),
        "penalty": _penalties(),
        "expired": _cases(
            (col("_expired"), 0, "job appears expired or no longer accepting applications")
        ),
    }


def _penalties() -> Column:
    stale = F.concat(
        F.lit("posting is more than 2 weeks old: "), F.col("_days").cast("string"), F.lit(" days")
    )
    rules = (
        (F.lower("work_mode") == "on-site", -12, F.lit("on-site role is a preference mismatch")),
        (F.col("_all").rlike(labels.CONTRACT), -8, F.lit("contract role is less preferred")),
        (F.col("_all").rlike(labels.RELOCATION), -15, F.lit("relocation requirement is a preference mismatch")),
        (F.col("_days") >= STALE_DAYS, 0, stale),
        (F.col("_title").contains("analyst"), -10, F.lit("analyst title is below target scope")),
        (F.col("company") == "Unknown", -8, F.lit("company missing")),
        (F.coalesce("job_link", F.lit("")) == "", -4, F.lit("apply link missing")),
    )
    points = sum((F.when(test, p).otherwise(0) for test, p, _ in rules), F.lit(0))
    why = F.concat_ws(", ", *[F.when(test, text) for test, _, text in rules])
    return F.struct(points.alias("points"), F.nullif(why, F.lit("")).alias("why"))


def category(score: Column, rules: RulePack = DEFAULT_RULES) -> Column:
    return (
        F.when(score >= rules.apply_at, APPLY)
        .when(score >= rules.investigate_at, INVESTIGATE)
        .otherwise(SKIP)
    )


def score_details(postings: DataFrame, rules: RulePack = DEFAULT_RULES) -> DataFrame:
    """Normalised postings plus one (points, why) struct per score component."""
    components = _components(rules)
    staged = _matches(_texts(normalize_postings(postings)), rules)
    kept = [F.col(c) for c in postings.columns if c != "is_expired"]
    return staged.select(
        *kept,
        F.col("_expired").alias("is_expired"),
        F.col("_never").alias("blacklisted"),
        *[components[name].alias(f"c_{name}") for name in _COMPONENTS],
    )


def score(postings: DataFrame, rules: RulePack = DEFAULT_RULES) -> DataFrame:
    """Postings -> normalised postings with score, category and explanation.

    The result struct is unpacked by ``inline``: a later filter on score or
    category then reads the value instead of re-deriving the whole rubric.
    """
    parts = [f"c_{name}" for name in _COMPONENTS]
    total = " + ".join(f"{p}.points" for p in parts)
    banned = F.col("blacklisted").isNotNull()
    why = F.when(
        banned, _named("company is on personal blacklist: ", F.col("blacklisted"), rules)
    ).otherwise(F.concat_ws("; ", *[f"{p}.why" for p in parts]))
    points = F.when(banned | F.col("is_expired"), 0).otherwise(
        F.expr(f"greatest(0, least(100, {total}))")
    )
    scored = score_details(postings, rules).select(
        *postings.columns,
        F.inline(F.array(F.struct(points.cast("int").alias("score"), why.alias("explanation")))),
    )
    return scored.select(
        *postings.columns, "score", category(F.col("score"), rules).alias("category"), "explanation"
    )
