"""URL parts and loose match keys, safe on malformed URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsift.functions.text import any_of, let
from leadsift.rules import (
    BLOCKED_HOSTS,
    GENERIC_PATHS,
    REJECTED_HOSTS,
    TITLE_STOP_WORDS,
)

_HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(?:\[([^\]]*)\]|([^/:?#]*))"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port or brackets; '' when there is none."""
    return let(
        F.lower(url),
        lambda u: F.concat(F.regexp_extract(u, _HOST, 1), F.regexp_extract(u, _HOST, 2)),
    )


def url_path(url: Column) -> Column:
    """Lower-case path without query, fragment or last-segment parameters."""
    path = F.regexp_extract(
        F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )
    return F.regexp_replace(path, ";[^/]*$", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def is_blocked_url(url: Column) -> Column:
    """Posting hosts whose pages must not be fetched directly."""
    return F.coalesce(url_host(url).isin(*BLOCKED_HOSTS), F.lit(False))


def is_rejected_url(url: Column) -> Column:
    """Board and aggregator hosts, sub-domains included."""
    return let(
        url_host(url),
        lambda h: h.isin(*REJECTED_HOSTS) | any_of(h.endswith("." + d) for d in REJECTED_HOSTS),
    )


def is_generic_path(path: Column) -> Column:
    return F.btrim(path, F.lit("/")).isin(*GENERIC_PATHS)


def title_tokens(text: Column) -> Column:
    """Words of three or more letters or digits, stop words dropped, order kept."""
    return F.filter(
        F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)),
        lambda t: ~t.isin(*TITLE_STOP_WORDS),
    )


def squash(text: Column) -> Column:
    """Only the letters and digits, lower-cased."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
