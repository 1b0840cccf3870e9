"""Messages -> postings: one row per posting found in a message.

The array of cards is built per message and exploded early, so that all field
rules run once as ordinary columns over the posting's own text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsift.functions import dates
from leadsift.functions.names import clean_title, normalize_company
from leadsift.functions.text import (
    BLANK,
    NWS,
    URL,
    WS,
    _SPACES,
    any_of,
    blank_to_null,
    column_cache,
    has_any,
    hits,
    let,
    rx,
    sections,
    squeeze,
    squeezed_lines,
    strip,
)
from leadsift.rules import (
    CARD_NOISE_LINES,
    CARD_NOISE_PARTS,
    CARD_ROLE_TERMS,
    DEFAULT_RULES,
    PREFERRED_HEADERS,
    SECTION_STOPS,
    SENDER_COMPANIES,
    SIGNATURE_COMPANIES,
    RulePack,
)

FIELDS = (
    "company", "title", "location", "work_mode", "salary_range", "seniority",
    "required_skills", "preferred_skills", "job_link", "source_email",
    "posted_date", "is_expired",
)

# ---------------------------------------------------------------------------
# Patterns of message wording.
# ---------------------------------------------------------------------------
# Whatever comes between, a match ends where the run of visible signs does: the shortest way there finds it too.
CARD_URL = rf"(?iu)https?://{NWS}*?linkedin\.com/{NWS}*?jobs/view/(?:[!-~]++|[^!-~\s{_SPACES}]++)*+"
HIRING = rf"(?iud)we(?:'re| are) hiring (?:a |an )?(.+?)(?: on| for|\.|\n)"
_ROLE = (
    r"(?:Data Scientist|Machine Learning Scientist|Machine Learning Engineer|"
    r"ML Scientist|ML Engineer|AI Engineer|Applied AI Engineer)"
)
# A match that starts behind a letter, or one sign further, would have started at that letter:
# the look-behind spares those starts, and with them a pass over the rest of the line each.
COMPANY_HIRING = (
    rf"(?iu)(?<![A-Z][0-9&.' -]{{0,1}})([A-Z][A-Za-z0-9&.' -]+?){WS}+is hiring{WS}+(?:a |an )?"
    rf"((?:Senior/Staff{WS}+|Senior{WS}+|Staff{WS}+)?(?:Applied{WS}+)?{_ROLE})"
)
CONTRACT_SUBJECT = (
    rf"(?iuUd)^(.+?){WS}+Contract Opportunity\b.*?\b"
    rf"((?:Senior{WS}+|Staff{WS}+)?(?:Data Scientist|Machine Learning Engineer|"
    r"ML Engineer|AI Engineer|Applied AI Engineer))\b"
)
CONTRACT_PROSE = rf"(?U)(?:\b[0-9]+\s*-\s*month\s+)?([A-Z][A-Za-z&. ]+?){WS}+contract{WS}+via{WS}+"
SUBJECT_TRIMS = (
    rf"(?iud)^.+?,{WS}+your job(?:'|')?s expiring on .*?:{WS}*",
    rf"(?iud)^.+?,{WS}+apply to{WS}+",
    rf"(?iu)^new jobs similar to{WS}+",
    rf"(?iu)^(?:{WS}*(?:new job|message replied|re|fw|fwd){WS}*:{WS}*)+",
)
_CARD_ROLE = "|".join(CARD_ROLE_TERMS)
_PLACES = (
    "remote", "hybrid", "on-site", "onsite", "canada", "united states", "toronto", "vancouver", "montreal", "ontario",
)
_REGIONS = ("ON", "BC", "QC", "AB", "NY", "CA", "WA", "MA", "TX", "IL")
PLACE_WORDS = rf"(?U)\b(?:{'|'.join(_PLACES)})\b"
REGION_CODES = rf"(?U)(?:,\s*|\b)(?:{'|'.join(_REGIONS)})\b"
CARD_SUFFIXES = (
    r"(?iuUd)\s+posted\s+on\s+[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b.*$",
    r"(?iuUd)\s+[0-9]+\s+applicants?.*$",
)


# ---------------------------------------------------------------------------
# Field rules (Column -> Column)
# ---------------------------------------------------------------------------
def subject_core(subject: Column) -> Column:
    """Subject without alert boilerplate and reply or forward prefixes."""
    text = core = strip(subject)
    for pattern in SUBJECT_TRIMS:
        core = F.regexp_replace(core, pattern, "")
    # All patterns but the third hold a comma or a colon.
    return F.when(text.contains(",") | text.contains(":"), core).otherwise(F.regexp_replace(text, SUBJECT_TRIMS[2], ""))


def labelled(text: Column, lowered: Column, label: str) -> Column:
    """``Label: value`` on a line, else the next non-blank line below ``Label``."""
    inline = F.regexp_extract(text, rf"(?iumd)^{label}{WS}*:{WS}*(.+)$", 1)
    below = rf"(?iumd)^{BLANK}*{label}{WS}*\n{WS}*({NWS}.*)$"
    value = let(
        inline,
        lambda v: F.when(v != "", blank_to_null(v)).otherwise(
            blank_to_null(F.regexp_extract(text, below, 1))
        ),
    )
    return F.when(lowered.contains(label.lower()), value)


def first_url(text: Column) -> Column:
    return F.when(text.contains("://"), F.rtrim(rx(text, f"({URL})"), F.lit(").,")))


def work_mode(lowered: Column) -> Column:
    return (
        F.when(lowered.contains("hybrid"), "Hybrid")
        .when(lowered.contains("remote"), "Remote")
        .when(has_any(lowered, ("on-site", "onsite")), "On-site")
    )


def seniority(title_low: Column, text_low: Column) -> Column:
    """Level from words or years of experience in title and text."""

    def seen(word: str) -> Column:
        return title_low.contains(word) | text_low.contains(word)

    level_three = seen("3") & F.concat(title_low, F.lit("\n"), text_low).rlike(
        rf"(?U)(?:-{WS}*|level{WS}*)3\b"
    )
    return (
        F.when(seen("staff"), "Staff")
        .when(seen("senior"), "Senior")
        .when(seen("junior") | seen("1-2 years"), "Junior")
        .when(level_three | seen("8+ years") | seen("5+ years"), "Senior")
    )


def skill_hits(lowered: str, rules: RulePack = DEFAULT_RULES) -> Column:
    return hits(lowered, rules.skill_labels())


def preferred_text(text: Column, lowered: Column) -> Column:
    """Text of the optional-preference sections, '' when there is none."""
    return F.when(
        has_any(lowered, PREFERRED_HEADERS), sections(text, PREFERRED_HEADERS, SECTION_STOPS)
    ).otherwise(F.lit(""))


def raw_title(subject: Column, text: Column, lowered: Column) -> Column:
    """First title source that speaks, before cleaning; NULL when none does."""
    subject_low = F.lower(subject)
    vague = subject_low.contains("opportunity") & subject_low.contains("applied ai")
    return F.coalesce(
        labelled(text, lowered, "Role"),
        F.when(
            lowered.contains("hiring ") & has_any(lowered, ("we're h", "we are h")), rx(text, HIRING)
        ),
        F.when(subject_low.contains("is hiring"), rx(subject, COMPANY_HIRING, 2)),
        F.when(lowered.contains("is hiring"), rx(text, COMPANY_HIRING, 2)),
        F.when(subject_low.contains("contract opportunity"), rx(subject, CONTRACT_SUBJECT, 2)),
        F.when(
            subject_low.contains(" at "), F.get(F.split(subject, rf"(?iu){WS}+at{WS}+", 2), F.lit(0))
        ),
        F.when(subject.contains(" - "), F.substring_index(subject, " - ", 1)),
        F.when(vague, F.lit("Applied AI role")),
        F.nullif(subject, F.lit("")),
    )


def posting_title(subject: Column, text: Column, lowered: Column) -> Column:
    """Cleaned title, or NULL when the message names none.

    The vague-outreach title is already in its final form, and cleaning keeps it.
    """
    return let(
        raw_title(subject, text, lowered),
        lambda t: F.when(t == "Applied AI role", t).when(t.isNotNull(), clean_title(t)),
    )


def posting_company(subject: Column, sender: Column, text: Column, lowered: Column) -> Column:
    """Company from label, prose, subject, sender or signature, else 'Unknown'."""
    subject_low = F.lower(subject)
    after_dash = F.get(F.split(subject, " - ", 2), F.lit(1))
    named = F.coalesce(
        F.when(lowered.contains("contract"), rx(text, CONTRACT_PROSE)),
        F.when(subject_low.contains("is hiring"), rx(subject, COMPANY_HIRING)),
        F.when(lowered.contains("is hiring"), rx(text, COMPANY_HIRING)),
        F.when(subject_low.contains("contract opportunity"), rx(subject, CONTRACT_SUBJECT)),
        rx(subject, rf"(?iud){WS}+at{WS}+(.+)$"),
        F.when(
            (F.coalesce(after_dash, F.lit("")) != "")
            & ~F.lower(after_dash).contains("marketing"),
            after_dash,
        ),
    )
    signed_lines = F.regexp_extract_all(
        text,
        F.lit(rf"(?md)^{BLANK}*({'|'.join(SIGNATURE_COMPANIES)}){WS}*$"),
        F.lit(1),
    )
    signed = F.when(
        any_of(text.contains(c) for c in SIGNATURE_COMPANIES),
        F.try_element_at(signed_lines, F.lit(-1)),
    )
    sender_low = F.lower(sender)
    return F.coalesce(
        labelled(text, lowered, "Company"),
        let(named, lambda n: F.when(n.isNotNull(), normalize_company(n))),
        *[F.when(sender_low.contains(d), F.lit(c)) for d, c in SENDER_COMPANIES],
        signed,
        F.lit("Unknown"),
    )


# ---------------------------------------------------------------------------
# Cards of multi-posting messages
# ---------------------------------------------------------------------------
def card_urls(text: Column) -> Column:
    """All posting URLs of a text, trailing punctuation removed."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(CARD_URL), F.lit(0)), lambda u: F.rtrim(u, F.lit(").,"))
    )


def is_digest(subject: Column, sender: Column, body: Column) -> Column:
    """Board message with two posting URLs, or with one and a posted-on date."""
    named = F.lower(F.concat_ws(" ", sender, subject)).contains("linkedin")
    urls = let(
        F.size(F.regexp_extract_all(body, F.lit(CARD_URL), F.lit(0))),
        lambda n: (n >= 2) | ((n == 1) & body.rlike(dates.POSTED_ON)),
    )
    return F.when(named, urls).otherwise(F.lit(False))


def card_line(line: Column) -> Column:
    """Of a squeezed line."""
    bare = F.when(line.contains("://"), squeeze(F.regexp_replace(line, URL, ""))).otherwise(line)
    return F.btrim(bare, F.lit(" -*|"))


def is_card_noise(lowered: Column) -> Column:
    """Of a lower-cased line without line ends."""
    return lowered.isin(*CARD_NOISE_LINES) | has_any(lowered, CARD_NOISE_PARTS)


def strip_card_suffix(line: Column) -> Column:
    cut = line
    for pattern in CARD_SUFFIXES:
        cut = F.regexp_replace(cut, pattern, "")
    # Both suffixes hold a digit, and few lines do.
    return strip(F.when(line.rlike("[0-9]"), cut).otherwise(line))


def is_card_title(line: Column) -> Column:
    return let(
        F.lower(strip_card_suffix(line)),
        lambda low: low.rlike(_CARD_ROLE) & ~is_card_noise(low),
    )


def is_card_place(line: Column, lowered: Column) -> Column:
    """The patterns run only on lines that hold one of their words."""
    return (has_any(lowered, _PLACES) & lowered.rlike(PLACE_WORDS)) | (has_any(line, _REGIONS) & line.rlike(REGION_CODES))


def is_short(line: Column) -> Column:
    """Five words at most, and no posting date, which holds a slash."""
    return (F.substring_index(line, " ", 5) == line) & ~(line.contains("/") & line.rlike(dates.POSTED_ON))


#: Kinds of a card's line; those of a company are plain and short.
_DROPPED, _PLAIN, _TITLE, _PLACE, _COMPANY = -1, 0, 1, 2, 3


def card_lines(body: Column) -> Column:
    """Lines of a message as (url, text, kind); each is searched once, whatever cards it lies in."""

    def kind(x: Column, low: Column) -> Column:
        # A line without digits has no suffix, and is known to be no noise by then.
        return (
            F.when((x == "") | is_card_noise(low), _DROPPED)
            .when(has_any(low, CARD_ROLE_TERMS) & (~x.rlike("[0-9]") | is_card_title(x)), _TITLE)
            .when(is_card_place(x, low), _PLACE).when(is_short(x), _COMPANY).otherwise(_PLAIN)
        )

    def read(line: Column) -> Column:
        url = F.when(line.contains("://"), F.rtrim(F.regexp_extract(line, f"({CARD_URL})", 1), F.lit(").,")))
        return let(
            F.struct(url.alias("url"), card_line(line).alias("text")),
            lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"), let(F.lower(x["text"]), lambda low: kind(x["text"], low)).alias("kind")),
        )

    return F.transform(squeezed_lines(body), read)


def message_cards(body: Column) -> Column:
    """Array of card structs (card_idx, url, title, company, place, text) of a message.

    Each posting URL owns the lines from the previous URL (eight at most) to four
    lines after it. A card needs a title and a company and must be the first of
    its company, title and URL in the message. Its title is its first title-like line,
    its company the first company-like one among the four after that, else the three before.
    """

    def cards(all_lines: Column) -> Column:
        at = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(all_lines) - 1, F.lit(0))),
            lambda i: F.coalesce(F.get(all_lines, i)["url"], F.lit("")) != "",
        )
        return let(at, lambda ix: F.transform(ix, lambda i, k: card(all_lines, i, F.get(ix, k - 1))))

    def card(all_lines: Column, i: Column, previous: Column) -> Column:
        start = F.greatest(F.coalesce(previous + 1, F.lit(0)), i - 8, F.lit(0))
        own = F.filter(F.slice(all_lines, start + 1, i + 5 - start), lambda x: x["kind"] != _DROPPED)
        return let(own, lambda lines: let(lines["kind"], lambda kinds: named(all_lines, i, lines, kinds)))

    def named(all_lines: Column, i: Column, lines: Column, kinds: Column) -> Column:
        at = (F.array_position(kinds, F.lit(_TITLE)) - 1).cast("int")
        place = (F.array_position(kinds, F.lit(_PLACE)) - 1).cast("int")

        def company(t: Column) -> Column:
            after = F.array_position(F.slice(kinds, t + 2, F.lit(4)), F.lit(_COMPANY)).cast("int")
            before = F.array_position(F.reverse(F.slice(kinds, F.greatest(t - 3, F.lit(0)) + 1, F.least(t, F.lit(3)))), F.lit(_COMPANY)).cast("int")
            where = F.when(after > 0, t + after).when(before > 0, t - before)
            return F.get(lines, where)["text"]

        return let(
            F.when(at >= 0, at),
            lambda t: let(
                F.when(t.isNotNull(), company(t)),
                lambda c: F.when(
                    c.isNotNull(),
                    F.struct(
                        normalize_company(c).alias("company"),
                        let(F.get(lines, t)["text"], card_title).alias("title"),
                        F.get(all_lines, i)["url"].alias("url"), i.alias("pos"),
                        F.get(lines, F.when(place >= 0, place))["text"].alias("place"),
                        F.array_join(lines["text"], "\n").alias("text"),
                    ),
                ),
            ),
        )

    def card_title(line: Column) -> Column:
        return let(F.when(line.rlike("[0-9]"), strip_card_suffix(line)).otherwise(line), clean_title)

    def keyed(card: Column) -> Column:
        return F.struct(
            F.lower(card["company"]).alias("c"), F.lower(card["title"]).alias("t"), card["url"].alias("url"), card["pos"].alias("card_idx"),
            card["title"].alias("title"), card["company"].alias("company"), card["place"].alias("place"), card["text"].alias("text"),
        )

    def first_of_key(cards: Column) -> Column:
        def is_first(card: Column, i: Column) -> Column:
            prev = F.get(cards, i - 1)
            return (i == 0) | ~(
                (prev["c"] == card["c"]) & (prev["t"] == card["t"]) & (prev["url"] == card["url"])
            )

        return F.filter(cards, is_first)

    complete = F.filter(
        let(card_lines(body), cards),
        lambda c: (F.coalesce(c["title"], F.lit("")) != "") & (F.coalesce(c["company"], F.lit("")) != ""),
    )
    unique = let(F.array_sort(F.transform(complete, keyed)), first_of_key)
    return F.transform(
        unique, lambda c: F.struct(*[c[f].alias(f) for f in ("card_idx", "url", "title", "company", "place", "text")])
    )


# ---------------------------------------------------------------------------
# Operator
# ---------------------------------------------------------------------------
@column_cache
def _message_columns(as_of) -> list[Column]:
    """What is found once a message, whatever its postings: kind, core subject, expiry."""
    return [
        is_digest(F.col("subject"), F.col("sender"), F.col("body")).alias("digest"),
        subject_core(F.col("subject")).alias("subject"),
        dates.is_expired(F.col("subject"), F.col("body"), dates.timestamp(as_of)).alias("is_expired"),
    ]


@column_cache
def _card_column() -> list[Column]:
    """One struct per posting."""
    null = F.lit(None).cast("string")
    whole = F.array(
        F.struct(
            F.lit(0).alias("card_idx"), null.alias("url"), null.alias("title"),
            null.alias("company"), null.alias("place"), F.col("body").alias("text"),
        )
    )
    return [
        F.explode(F.when(F.col("digest"), message_cards(F.col("body"))).otherwise(whole)).alias("card"),
    ]


@column_cache
def _name_column() -> Column:
    """Title and company of a posting, dropped when it names neither.

    Dropping inside the array keeps the two cascades from being evaluated a
    second time by a pushed-down filter.
    """
    text, low, digest = F.col("card.text"), F.col("low"), F.col("digest")
    found = F.struct(
        F.when(digest, F.col("card.title"))
        .otherwise(posting_title(F.col("subject"), text, low))
        .alias("title"),
        F.when(digest, F.col("card.company"))
        .otherwise(posting_company(F.col("subject"), F.col("sender"), text, low))
        .alias("company"),
    )
    return F.inline(
        F.filter(
            F.array(found),
            lambda x: (F.coalesce(x["title"], F.lit("")) != "") | (x["company"] != "Unknown"),
        )
    )


@column_cache
def _field_columns(as_of) -> list[Column]:
    """The remaining posting fields over the posting's own text."""
    text, low, digest = F.col("card.text"), F.col("low"), F.col("digest")
    now = dates.timestamp(as_of)
    return [
        F.when(digest, F.col("card.place"))
        .otherwise(labelled(text, low, "Location"))
        .alias("location"),
        work_mode(low).alias("work_mode"),
        F.when(~digest, labelled(text, low, "Salary")).alias("salary_range"),
        seniority(F.lower("role"), low).alias("seniority"),
        F.array_except("all_skills", "liked_skills").alias("required_skills"),
        F.when(digest, F.array().cast("array<string>"))
        .otherwise(F.col("liked_skills"))
        .alias("preferred_skills"),
        F.when(digest, F.col("card.url")).otherwise(first_url(text)).alias("job_link"),
        F.col("sender").alias("source_email"),
        F.when(
            digest,
            F.coalesce(dates.card_posted_on(text), dates.age_text(F.col("received_at"), now)),
        )
        .otherwise(dates.posting_age(text, F.col("received_at"), now))
        .alias("posted_date"),
    ]


def extract(
    messages: DataFrame, as_of: Column | dt.datetime | str, rules: RulePack = DEFAULT_RULES
) -> DataFrame:
    """Messages (source_id, msg_seq, subject, sender, received_at, body) -> postings.

    Output: source_id, msg_seq, card_idx and the twelve posting fields. No shuffle.
    """
    plain = messages.select(
        "source_id", "msg_seq", "received_at",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("subject", "sender", "body")],
    )
    kept = ("source_id", "msg_seq", "received_at", "sender")
    messages = plain.select(*kept, "body", *_message_columns(as_of))
    cards = messages.select(*kept, "digest", "subject", "is_expired", *_card_column())
    typed = (
        cards.select("*", F.lower("card.text").alias("low"))
        .select("*", _name_column())
        .select(
            "*",
            F.expr("CASE WHEN coalesce(title, '') = '' THEN 'Unknown role' ELSE title END AS role"),
            F.lower(preferred_text(F.col("card.text"), F.col("low"))).alias("liked"),
        )
        .select(
            "*",
            skill_hits("low", rules).alias("all_skills"),
            F.when(F.col("liked") == "", F.array().cast("array<string>"))
            .otherwise(skill_hits("liked", rules))
            .alias("liked_skills"),
        )
    )
    return typed.select(
        "source_id", "msg_seq", F.col("card.card_idx").alias("card_idx"), "company",
        F.col("role").alias("title"), *_field_columns(as_of), "is_expired",
    )
