"""Page text as column expressions: visible text, containers, JSON-LD postings.

Containers are found by tag and attribute patterns with balanced end tags. That
covers well-formed pages; it is not a full HTML tree.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsift.functions.text import count_hits, let, paragraphs
from leadsift.rules import DESCRIPTION_MARKERS, HIDDEN_TAGS

_MARKUP = (
    r"(?is)<!--.*?-->"
    rf"|<({'|'.join(HIDDEN_TAGS)})\b[^>]*>.*?(?:</\1\s*>|\z)"
    r"|<[!/?a-z][^>]*>"
)
_CHROME = r"(?is)<(nav|header|footer|aside|form)\b[^>]*>.*?</\1\s*>"
_JSON_LD = r"(?is)<script\b[^>]*?\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script"

# Containers tried in this order.
CONTAINERS = (
    ("data-qa", "job-description"), ("data-testid", "job-description"),
    ("data-test", "job-description"), ("class", "job-description"),
    ("id", "job-description"), ("class", "posting-description"),
    ("class", "section-wrapper"), ("class", "content-intro"),
    ("class", "ashby-job-posting"), ("class", "job__description"),
    ("class", "description"), ("tag", "main"), ("tag", "article"),
)


def _entity_map() -> str:
    """Named references, frequent ones first, and the cp1252 numeric ones."""
    named = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    first = ("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot")
    table = {k: named[k] for k in first} | named
    for code in range(0x80, 0xA0):
        char = bytes([code]).decode("cp1252", errors="ignore")
        if char:
            table |= {f"#{code}": char, f"#x{code:x}": char, f"#X{code:X}": char}
    return json.dumps(table)


_ENTITIES = _entity_map()


def unescape(text: Column) -> Column:
    """Decode ``;``-ended character references, each exactly once."""
    table = F.from_json(F.lit(_ENTITIES), "map<string,string>")

    def numeric(ref: Column) -> Column:
        code = F.when(
            F.lower(ref).startswith("#x"), F.conv(F.substring(ref, 3, 8), 16, 10)
        ).otherwise(F.substring(ref, 2, 8)).try_cast("bigint")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        bad = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | (code == 0)
        return F.when(bad, F.lit("\ufffd")).otherwise(char)

    def decoded(piece: Column) -> Column:
        def replace(ref: Column) -> Column:
            value = F.when(ref == "", F.lit(None).cast("string")).otherwise(
                F.coalesce(
                    F.try_element_at(table, ref), F.when(ref.startswith("#"), numeric(ref))
                )
            )
            return let(
                value,
                lambda v: F.when(v.isNull(), F.concat(F.lit("&"), piece)).otherwise(
                    F.concat(v, F.substring(piece, F.length(ref) + 2, F.length(piece)))
                ),
            )

        return let(
            F.regexp_extract(
                piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1
            ),
            replace,
        )

    def join(pieces: Column) -> Column:
        return F.concat(
            F.get(pieces, F.lit(0)),
            F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""),
        )

    return F.when(text.contains("&"), let(F.split(text, "&"), join)).otherwise(text)


def visible_text(html: Column) -> Column:
    """Text nodes one per line, hidden elements and comments dropped."""
    return paragraphs(unescape(F.regexp_replace(html, _MARKUP, "\n")))


def _open_tag(kind: str, name: str) -> str:
    if kind == "tag":
        return rf"(?is)<{name}\b[^>]*>"
    if kind == "class":
        value = rf"(?:\"(?:[^\"]*\s)?{name}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{name}(?:\s[^']*)?'|{name}(?=[\s>]))"
    else:
        value = rf"(?:\"{name}\"|'{name}'|{name}(?=[\s>]))"
    return rf"(?is)<[a-z][a-z0-9-]*(?=\s)(?:[^>]*?\s){re.escape(kind)}\s*=\s*{value}[^>]*>"


def container_html(html: Column, kind: str, name: str) -> Column:
    """First matching element with its balanced content, NULL when absent."""

    def balanced(rest: Column) -> Column:
        tag = F.regexp_extract(rest, r"^<([A-Za-z][A-Za-z0-9-]*)", 1)

        def cut(pieces: Column) -> Column:
            end = F.aggregate(
                pieces,
                F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done")),
                lambda acc, p: F.when(acc["done"], acc).otherwise(
                    F.struct(
                        (acc["depth"] + F.when(p.startswith("</"), -1).otherwise(1)).alias("depth"),
                        (acc["n"] + 1).alias("n"),
                        (p.startswith("</") & (acc["depth"] == 1)).alias("done"),
                    )
                ),
                lambda acc: F.when(acc["done"], acc["n"] - 1).otherwise(acc["n"]),
            )
            return F.array_join(F.slice(pieces, F.lit(1), end), "")

        return let(F.split(rest, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"\b)"))), cut)

    return let(
        F.regexp_instr(html, F.lit(_open_tag(kind, name))),
        lambda at: F.when(at > 0, let(F.substring(html, at, F.length(html)), balanced)),
    )


def looks_like_description(text: Column) -> Column:
    """At least 120 characters and two posting markers."""
    return (F.length(text) >= 120) & let(
        F.lower(text), lambda low: count_hits(low, DESCRIPTION_MARKERS) >= 2
    )


def _variant_text(item: Column, name: str) -> Column:
    path = f"$.{name}"
    listed = F.try_variant_get(item, path, "array<string>")
    value = F.coalesce(
        F.when(listed.isNotNull() & (F.size(listed) > 0), F.concat(F.lit("['"), F.array_join(listed, "', '"), F.lit("']"))),
        F.when(listed.isNull(), F.try_variant_get(item, path, "string")),
        F.lit(""),
    )
    return F.when(value.isin("0", "false", "{}"), F.lit("")).otherwise(value)


def posting_items(raw: Column) -> Column:
    """JSON-LD text -> array of its objects (list, @graph or single object)."""
    parsed = F.try_parse_json(raw)
    return let(
        parsed,
        lambda v: F.coalesce(
            F.try_variant_get(v, "$", "array<variant>"),
            F.try_variant_get(v, "$['@graph']", "array<variant>"),
            F.when(v.isNotNull(), F.array(v)),
            F.array().cast("array<variant>"),
        ),
    )


def posting_item_text(item: Column) -> Column:
    kinds = F.coalesce(
        F.try_variant_get(item, "$['@type']", "array<string>"),
        F.array(F.try_variant_get(item, "$['@type']", "string")),
    )
    parts = [
        _variant_text(item, n)
        for n in ("title", "description", "responsibilities", "qualifications", "skills")
    ]
    is_posting = F.exists(kinds, lambda k: F.lower(F.coalesce(k, F.lit(""))) == "jobposting")
    return F.when(is_posting, paragraphs(F.concat_ws("\n", *parts))).otherwise(F.lit(""))


def json_ld_text(html: Column) -> Column:
    """Text of all JobPosting objects of a page, '' when there is none."""

    def per_script(raw: Column) -> Column:
        return F.array_join(
            F.filter(F.transform(posting_items(raw), posting_item_text), lambda t: t != ""), "\n"
        )

    scripts = F.regexp_extract_all(html, F.lit(_JSON_LD), F.lit(1))
    return F.when(
        F.lower(html).contains("ld+json"),
        F.array_join(F.filter(F.transform(scripts, per_script), lambda t: t != ""), "\n"),
    ).otherwise(F.lit(""))


def container_text(html: Column, lowered: Column) -> Column:
    """Text of the first container that reads like a posting, NULL when none does."""
    present = [
        F.when(
            lowered.contains(f"<{name}" if kind == "tag" else name), container_html(html, kind, name)
        )
        for kind, name in CONTAINERS
    ]
    texts = F.transform(F.filter(F.array(*present), lambda c: c.isNotNull()), visible_text)
    return F.get(F.filter(texts, looks_like_description), F.lit(0))


def main_content(html: Column) -> Column:
    """Visible text of the article or main element, else of the page without chrome."""
    body = F.coalesce(container_html(html, "tag", "article"), container_html(html, "tag", "main"), html)
    return visible_text(F.regexp_replace(body, _CHROME, "\n"))


def page_text(html: Column, extractor: Callable[[Column], Column] | None = None) -> Column:
    """JSON-LD posting, posting container, main content, visible text; first non-empty.

    ``extractor`` replaces the main-content step: any Column function or pandas UDF.
    """

    def unless_empty(text: Column) -> Column:
        return let(text, lambda t: F.when(t != "", t))

    return F.coalesce(
        unless_empty(json_ld_text(html)),
        let(F.lower(html), lambda low: container_text(html, low)),
        unless_empty(paragraphs((extractor or main_content)(html))),
        visible_text(html),
    )


def looks_like_html(text: Column) -> Column:
    head = F.lower(F.left(text, F.lit(1000)))
    return head.contains("<html") | head.contains("<body") | head.contains("<!doctype html")
