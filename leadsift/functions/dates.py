"""Age text, posting age and expiry dates, always against an explicit ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsift.functions.text import WS, blank_to_null, has_any, let, lit_map, rx
from leadsift.rules import EXPIRED_PHRASES, MONTHS

POSTED_ON = rf"(?iuU)\bposted{WS}+on{WS}+([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}})\b"
_EXPIRY = (
    rf"(?iuU)\b(?:expiring|expires|deadline){WS}+(?:on{WS}+)?([A-Za-z]{{3,9}})\.?{WS}+([0-9]{{1,2}})\b"
)
# A text with a closing phrase holds one of these; few others do.
_STEMS = ("expired", "no longer a", "has closed")
_CLOSED = (*_STEMS, *(p for p in EXPIRED_PHRASES if not any(s in p for s in _STEMS)))
# Months are accepted in full, as three letters, and as "sept".
_MONTH_NUMBER = {
    key: str(n)
    for n, name in enumerate(MONTHS, 1)
    for key in (name, name[:3], *(["sept"] if name == "september" else []))
}


def timestamp(as_of: Column | dt.datetime | str) -> Column:
    """Column for a point in time; naive datetimes and strings mean UTC."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit((as_of - epoch) // dt.timedelta(microseconds=1)))


def parse_timestamp(text: Column, fallback: Column) -> Column:
    """Stored timestamp text; unreadable values become ``fallback``."""
    return F.coalesce(F.try_to_timestamp(text), fallback)


def _age_parts(text: Column, units: dict[str, int]) -> Column:
    pattern = rf"([0-9]+){WS}*({'|'.join(units)})"

    def value(low: Column) -> Column:
        count = F.regexp_extract(low, pattern, 1).try_cast("bigint")
        unit = F.regexp_extract(low, pattern, 2)
        factor = F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in units.items()])
        return F.try_multiply(count, factor.cast("bigint"))

    return let(F.lower(text), value)


def age_minutes(text: Column) -> Column:
    """'37 minutes ago' -> 37; hours count 60; anything else NULL."""
    return _age_parts(text, {"minute": 1, "hour": 60})


def age_days(text: Column) -> Column:
    """'3 weeks ago' -> 21; minutes and hours are day 0; otherwise NULL."""
    return _age_parts(text, {"minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30})


def posted_before(received_at: Column, age: Column) -> Column:
    """Receipt time minus a relative age text; NULL when the text gives none."""

    def shift(low: Column) -> Column:
        def number(unit: str) -> Column:
            return F.coalesce(
                F.regexp_extract(low, rf"([0-9]+){WS}+{unit}", 1).try_cast("int"), F.lit(0)
            )

        unit = F.regexp_extract(low, rf"([0-9]+){WS}+(day|week)", 2)
        count = F.regexp_extract(low, rf"([0-9]+){WS}+(day|week)", 1).try_cast("int")
        minutes = (
            F.when(low.contains("minute"), number("minute").cast("bigint"))
            .when(low.contains("hour"), number("hour").cast("bigint") * 60)
            .when(unit == "day", count.cast("bigint") * 1440)
            .when(unit == "week", count.cast("bigint") * 10080)
        )
        return F.timestamp_micros(F.unix_micros(received_at) - minutes * 60_000_000)

    return let(F.lower(age), shift)


def age_text(moment: Column, as_of: Column) -> Column:
    """Compact age such as '5 hours ago', never below '1 minute ago'."""

    def words(secs: Column) -> Column:
        def many(size: int, unit: str) -> Column:
            return F.concat((F.floor(secs / size)).cast("string"), F.lit(f" {unit} ago"))

        return (
            F.when(secs < 120, F.lit("1 minute ago"))
            .when(secs < 3600, many(60, "minutes"))
            .when(secs < 7200, F.lit("1 hour ago"))
            .when(secs < 86400, many(3600, "hours"))
            .when(secs < 172800, F.lit("1 day ago"))
            .otherwise(many(86400, "days"))
        )

    return F.when(moment.isNotNull(), let(F.timestamp_diff("SECOND", moment, as_of), words))


def posted_text(body: Column) -> Column:
    """Text after 'Posted' up to a full stop or line end."""
    return F.when(
        F.lower(body).contains("posted"),
        blank_to_null(F.regexp_extract(body, rf"(?iud)Posted{WS}+(.+?)(?:\.|\n|$)", 1)),
    )


def posting_age(body: Column, received_at: Column, as_of: Column) -> Column:
    """Age text re-based to ``as_of`` where the message time is known."""
    return let(
        posted_text(body),
        lambda said: F.coalesce(
            age_text(posted_before(received_at, said), as_of),
            said,
            age_text(received_at, as_of),
        ),
    )


def card_posted_on(text: Column) -> Column:
    return F.when(text.contains("/"), F.concat(F.lit("posted on "), rx(text, POSTED_ON)))


def expiry_date(text: Column, as_of: Column) -> Column:
    """Date in 'expires on Mar 5'; months far behind ``as_of`` mean next year."""

    def dated(found: Column) -> Column:
        month = F.try_element_at(lit_map(_MONTH_NUMBER), F.lower(F.regexp_extract(found, _EXPIRY, 1)))
        day = F.regexp_extract(found, _EXPIRY, 2)
        year = F.year(as_of) + F.when(
            month.cast("int") < F.month(as_of) - 6, F.lit(1)
        ).otherwise(F.lit(0))
        this_year = F.try_to_date(F.concat_ws("-", F.year(as_of), month, day), "y-M-d")
        any_year = F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")
        return F.when(month.isNotNull() & this_year.isNotNull(), any_year)

    return let(F.regexp_extract(text, _EXPIRY, 0), dated)


def is_expired(subject: Column, body: Column, as_of: Column) -> Column:
    """Closed by wording, or by an expiry date before the day of ``as_of``."""

    def check(text: Column) -> Column:
        return let(
            F.lower(text),
            lambda low: (has_any(low, _CLOSED) & has_any(low, EXPIRED_PHRASES))
            | F.when(
                has_any(low, ("expiring", "expires", "deadline")),
                F.coalesce(expiry_date(text, as_of) < F.to_date(as_of), F.lit(False)),
            ).otherwise(F.lit(False)),
        )

    return let(F.concat(subject, F.lit("\n"), body), check)
