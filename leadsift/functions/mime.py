"""Internet messages as column expressions: headers, parts, transfer encodings, charsets.

A message is handled as text of one character per byte (ISO-8859-1), so that patterns
and positions hold for any content. Only characters of charsets that Spark cannot decode
pass through Arrow.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsift.functions.text import let, lit_map

_BYTES = "ISO-8859-1"
_WORD = r"=\?[^?\s]+\?[BbQq]\?[^?\s]*\?="
_BOUNDARY = r"(?imd)^content-type:[ \t]*multipart/[^\n]*?;[ \t]*boundary[ \t]*=[ \t]*(?:\"([^\"\n]+)\"|([^\s;\"]+))"

# Charsets decoded in the JVM, zone names of message dates in hours.
UTF8_NAMES = ("utf-8", "utf8")
ASCII_NAMES = ("", "us-ascii", "ascii")
LATIN1_NAMES = ("iso-8859-1", "iso8859-1", "latin-1", "latin1")
ZONE_HOURS = {
    "ut": 0, "utc": 0, "gmt": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5,
    "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
}
_MONTHS = {m: str(i) for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}


def raw_text(raw: Column) -> Column:
    """Bytes -> text of one character per byte; NULL -> ''."""
    return F.coalesce(F.decode(raw, _BYTES), F.lit(""))


def split_head(text: Column) -> Column:
    """Struct (head, body): the head ends before the first line that is no header line.

    Folded header lines are joined. A blank line after the head belongs to neither.
    """
    at = F.regexp_instr(text, F.lit(r"(?md)^(?![!-9;-~]*:|[ \t]|From )"))

    def halves(at: Column) -> Column:
        end = F.when(at > 0, at).otherwise(F.length(text) + 1)
        return F.struct(
            F.regexp_replace(F.substring(text, F.lit(1), end - 1), r"\r?\n(?=[ \t])", "").alias("head"),
            F.regexp_replace(F.substring(text, end, F.length(text)), r"\A\r?\n", "").alias("body"),
        )

    return let(at, halves)


def header(head: Column, name: str) -> Column:
    """Value of the first such header, '' when absent."""
    return F.rtrim(F.regexp_extract(head, rf"(?imd)^{name}:[ \t]*([^\n]*)", 1), F.lit("\r"))


def parameter(value: Column, name: str) -> Column:
    return F.regexp_extract(value, rf"(?i);[ \t]*{name}[ \t]*=[ \t]*\"?([^\";\s]+)", 1)


def content_type(head: Column) -> Column:
    """Lower-case type of a head; text/plain when absent or malformed."""
    found = F.lower(F.regexp_extract(header(head, "content-type"), r"^([^\s;/]+/[^\s;/]+)[ \t]*(?:;|$)", 1))
    return let(found, lambda t: F.when(t == "", "text/plain").otherwise(t))


def unquoted(text: Column) -> Column:
    """Quoted-printable text decoded, one character per byte."""
    pieces = F.split(F.regexp_replace(text, r"=[ \t]*\r?\n", ""), "=(?=[0-9A-Fa-f]{2})")
    return let(
        pieces,
        lambda ps: F.concat(
            F.get(ps, F.lit(0)),
            F.array_join(
                F.transform(
                    F.slice(ps, F.lit(2), F.size(ps)),
                    lambda p: F.concat(
                        F.char(F.conv(F.left(p, F.lit(2)), 16, 10).cast("bigint")), F.substring(p, 3, 2**31 - 1)
                    ),
                ),
                "",
            ),
        ),
    )


def unbased(text: Column) -> Column:
    """Base64 text -> bytes; other characters are passed over, a torn end is dropped."""
    def padded(s: Column) -> Column:
        whole = F.when(F.length(s) % 4 == 1, F.left(s, F.length(s) - 1)).otherwise(s)
        return let(whole, lambda w: F.concat(w, F.repeat(F.lit("="), (4 - F.length(w) % 4) % 4)))

    return F.coalesce(
        F.try_to_binary(let(F.regexp_replace(text, r"=[\s\S]*\z|[^A-Za-z0-9+/]", ""), padded), F.lit("base64")),
        F.lit(b""),
    )


def _data(encoding: Column, text: Column) -> Column:
    return (
        F.when(encoding == "base64", unbased(text))
        .when(encoding == "quoted-printable", F.encode(unquoted(text), _BYTES))
        .otherwise(F.encode(text, _BYTES))
    )


def _in_jvm(charset: Column) -> Column:
    return charset.isin(*UTF8_NAMES, *ASCII_NAMES, *LATIN1_NAMES)


def decode_pieces(pieces: Column) -> Column:
    """Array of (data, charset) -> array of texts; bad bytes replaced, unknown charsets ''.

    Spark decodes UTF-8, ASCII and Latin-1; Arrow gets the pieces in other charsets only.
    """

    @F.pandas_udf("array<string>")
    def decoded(batch: pd.Series) -> pd.Series:
        def one(piece):
            try:
                return bytes(piece["data"]).decode(piece["charset"], errors="replace")
            except LookupError:
                return ""

        return pd.Series([[one(p) for p in row] for row in batch], dtype="object")

    others = decoded(F.filter(pieces, lambda p: ~_in_jvm(p["charset"])))

    def in_jvm(p: Column) -> Column:
        latin = F.decode(p["data"], _BYTES)
        return (
            F.when(p["charset"].isin(*UTF8_NAMES), F.make_valid_utf8(p["data"].cast("string")))
            .when(p["charset"].isin(*ASCII_NAMES), F.regexp_replace(latin, "[\x80-\xff]", "�"))
            .when(p["charset"].isin(*LATIN1_NAMES), latin)
        )

    def merged(found: Column) -> Column:
        # The n-th piece of another charset is the n-th element of what Arrow gave back.
        return F.transform(
            pieces,
            lambda p, i: F.coalesce(
                in_jvm(p),
                F.get(found, F.size(F.filter(F.slice(pieces, F.lit(1), i), lambda q: ~_in_jvm(q["charset"])))),
            ),
        )

    return let(others, merged)


def header_pieces(value: Column) -> Column:
    """Header value -> array of (data, charset): encoded words, and plain text as UTF-8.

    White space between two encoded words is no text.
    """
    joined = F.regexp_replace(value, rf"({_WORD})[ \t]+(?={_WORD})", "$1")

    def piece(text: Column) -> Column:
        inner = F.regexp_extract(text, r"^=\?[^?]*\?[BbQq]\?([^?]*)\?=$", 1)
        encoding = F.when(F.lower(F.regexp_extract(text, r"\?([BbQq])\?", 1)) == "b", "base64").otherwise("quoted-printable")
        charset = F.lower(F.regexp_extract(text, r"^=\?([^?*]+)", 1))
        return F.when(
            text.rlike(rf"^{_WORD}$"),
            F.struct(
                _data(encoding, F.when(encoding == "base64", inner).otherwise(F.translate(inner, "_", " "))).alias("data"),
                charset.alias("charset"),
            ),
        ).otherwise(F.struct(F.encode(text, _BYTES).alias("data"), F.lit("utf-8").alias("charset")))

    plain = F.array(F.struct(F.encode(value, _BYTES).alias("data"), F.lit("utf-8").alias("charset")))
    marked = value.contains("=?") | value.contains("?=")
    return F.when(marked, F.transform(F.split(joined, rf"(?={_WORD})|(?<=\?=)"), piece)).otherwise(plain)


def leaf_texts(text: Column) -> Column:
    """Message text -> array of its leaf parts, head and body each, in order.

    The text is cut at lines that could be delimiters of any multipart head in it, then
    folded with the stack of open boundaries: a delimiter closes what lies inside its
    multipart; one that is not open belongs to the text of the part it stands in.
    """
    unfolded = F.regexp_replace(text, r"\r?\n(?=[ \t])", "")
    names = F.array_distinct(
        F.filter(
            F.concat(
                F.regexp_extract_all(unfolded, F.lit(_BOUNDARY), F.lit(1)),
                F.regexp_extract_all(unfolded, F.lit(_BOUNDARY), F.lit(2)),
            ),
            lambda b: b != "",
        )
    )
    escaped = lambda b: F.regexp_replace(b, r"([^A-Za-z0-9])", r"\\$1")

    def cut(names: Column) -> Column:
        pattern = F.concat(
            F.lit("(?md)(?=^--(?:"), F.array_join(F.transform(names, escaped), "|"), F.lit(r")(?:--)?[ \t]*\r?$)")
        )
        return F.when(F.size(names) > 0, F.split(text, pattern)).otherwise(F.array(text))

    def opened(segment: Column) -> Column:
        """Boundary that the head of a segment opens, '' for a leaf."""
        found = lambda v: F.coalesce(
            F.nullif(F.regexp_extract(v, _BOUNDARY, 1), F.lit("")), F.regexp_extract(v, _BOUNDARY, 2)
        )
        return let(split_head(segment)["head"], found)

    def unwrapped(segment: Column) -> Column:
        """The message inside an attached message, else the segment."""
        return let(
            split_head(segment),
            lambda s: F.when(content_type(s["head"]) == "message/rfc822", s["body"]).otherwise(segment),
        )

    empty = F.array().cast("array<string>")

    def enter(stack: Column, parts: Column, segment: Column) -> Column:
        def by_kind(segment: Column) -> Column:
            return let(
                opened(segment),
                lambda name: F.when(
                    name != "",
                    F.struct(F.concat(stack, F.array(name)).alias("stack"), parts.alias("parts"), F.lit(False).alias("inside")),
                ).otherwise(
                    F.struct(stack.alias("stack"), F.concat(parts, F.array(segment)).alias("parts"), F.lit(True).alias("inside"))
                ),
            )

        return let(unwrapped(segment), by_kind)

    def step(state: Column, segment: Column) -> Column:
        line = F.regexp_extract(segment, r"(?d)\A--([^\n]*?)[ \t]*\r?(?:\n|\z)", 1)
        rest = F.regexp_replace(segment, r"\A[^\n]*\n?", "")

        def act(line: Column) -> Column:
            opens = F.coalesce(F.array_position(state["stack"], line), F.lit(0)).cast("int")
            closed = F.regexp_replace(line, r"--\z", "")
            closes = F.when(line.endswith("--"), F.coalesce(F.array_position(state["stack"], closed), F.lit(0))).otherwise(0).cast("int")
            more = F.struct(
                state["stack"].alias("stack"),
                F.when(
                    state["inside"],
                    F.concat(
                        F.slice(state["parts"], F.lit(1), F.size(state["parts"]) - 1),
                        F.array(F.concat(F.element_at(state["parts"], -1), segment)),
                    ),
                ).otherwise(state["parts"]).alias("parts"),
                state["inside"].alias("inside"),
            )
            return (
                F.when(opens > 0, enter(F.slice(state["stack"], F.lit(1), opens), state["parts"], rest))
                .when(
                    closes > 0,
                    F.struct(
                        F.slice(state["stack"], F.lit(1), closes - 1).alias("stack"),
                        state["parts"].alias("parts"), F.lit(False).alias("inside"),
                    ),
                )
                .otherwise(more)
            )

        return let(line, act)

    def folded(segments: Column) -> Column:
        first = enter(empty, empty, F.get(segments, F.lit(0)))
        rest = F.slice(segments, F.lit(2), F.size(segments))
        return let(first, lambda state: F.aggregate(rest, state, step)["parts"])

    # Without a multipart or an attached message in it the text is its only leaf.
    nested = let(F.lower(text), lambda low: low.contains("multipart/") | low.contains("message/rfc822"))
    return F.when(nested, let(let(names, cut), folded)).otherwise(F.array(text))


def part_pieces(texts: Column) -> Column:
    """Leaf texts -> array of (type, data, charset); parts that are no text have no data."""

    def piece(text: Column) -> Column:
        def read(s: Column) -> Column:
            kind = content_type(s["head"])
            body = F.regexp_replace(s["body"], r"\r?\n\z", "")
            data = _data(F.lower(F.trim(header(s["head"], "content-transfer-encoding"))), body)
            return F.struct(
                kind.alias("type"),
                F.when(kind.startswith("text/"), data).otherwise(F.lit(b"")).alias("data"),
                F.lower(parameter(header(s["head"], "content-type"), "charset")).alias("charset"),
            )

        return let(split_head(text), read)

    return F.transform(texts, piece)


def message_date(value: Column) -> Column:
    """Date header -> timestamp; without a known zone UTC, NULL when unreadable."""
    pattern = (
        r"^\s*(?:[A-Za-z]{3,9},?\s*)?([0-9]{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+([0-9]{4}|[0-9]{2})\s+"
        r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\s+([+-][0-9]{4}|[A-Za-z]+))?"
    )
    # One search: the seven groups as one text, '' where a group took no part.
    groups = F.split(F.regexp_replace(value, rf"{pattern}[\s\S]*", ",".join(f"${i}" for i in range(1, 8))), ",")
    found = F.when(value.rlike(pattern), groups).otherwise(F.array_repeat(F.lit(""), 7))

    def read(found: Column) -> Column:
        group = lambda i: F.get(found, F.lit(i - 1))
        number = lambda i: group(i).try_cast("int")
        century = F.when(F.length(group(3)) == 4, 0).when(number(3) < 69, 2000).otherwise(1900)
        local = F.try_make_timestamp(
            number(3) + century, F.try_element_at(lit_map(_MONTHS), F.lower(group(2))).cast("int"), number(1),
            number(4), number(5), F.coalesce(number(6), F.lit(0)).cast("decimal(8,6)"), F.lit("UTC"),
        )
        return F.timestamp_seconds(F.unix_timestamp(local) - let(group(7), seconds))

    def seconds(zone: Column) -> Column:
        figures = F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60
        hours = F.try_element_at(lit_map({k: str(v) for k, v in ZONE_HOURS.items()}), F.lower(zone)).cast("int")
        return (
            F.when(zone.startswith("+"), figures).when(zone.startswith("-"), -figures)
            .otherwise(F.coalesce(hours * 3600, F.lit(0)))
        )

    return let(found, read)
