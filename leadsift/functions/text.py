"""Text building blocks. Every function maps Column -> Column, JVM-side.

Patterns are written for Unicode text: ``WS`` is the full white-space class and
``(?iu)`` folds case beyond ASCII. ``let`` binds a value once, because Spark does
not share repeated sub-expressions inside CASE branches or filters.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = r"\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = rf"[\s{_SPACES}]"
BLANK = rf"[ \t\x0b\f\r{_SPACES}]"
NWS = rf"[^\s{_SPACES}]"
EOL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Printable ASCII first: the long runs of a URL then need one range test per character.
URL = rf"https?://(?:[!-~]++|[^!-~\s{_SPACES}]++)++"
# White space that ends no line.
_INLINE = r" \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"


def column_cache(build):
    """Keep the columns built for hashable arguments.

    Columns name their inputs only, so one built expression serves any number of
    DataFrames; building a large one costs thousands of driver calls.
    """
    built: dict = {}

    @functools.wraps(build)
    def cached(*args):
        key = (id(SparkContext._jvm), *args)
        try:
            hash(key)
        except TypeError:
            return build(*args)
        if key not in built:
            built[key] = build(*args)
        return built[key]

    return cached


def lit_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rx(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL (not '') when the pattern does not match.

    The pattern is extended to swallow the rest of the text: one match, no second
    evaluation to tell a miss from an empty group.
    """
    return F.get(
        F.regexp_extract_all(text, F.lit(rf"(?:{pattern})[\s\S]*"), F.lit(group)), F.lit(0)
    )


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def strip(text: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    """Collapse every white-space run to one space and trim."""
    # A single space before a visible ASCII sign is left where it is.
    return F.btrim(F.regexp_replace(text, rf"(?! ?[!-~]){WS}+", " "), F.lit(" "))


def lines(text: Column) -> Column:
    return F.split(text, EOL)


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def squeezed_lines(text: Column) -> Column:
    """Non-blank lines, each trimmed and with one space for every run of white space.

    Printable ASCII has no other white space than spaces and line feeds. The look-aheads tell most
    signs of other texts by one range test.
    """
    spaced = F.regexp_replace(text, rf"(?![!-~\n])[{_INLINE}]++", " ")
    cut = F.when(text.rlike(r"[^ -~\n]"), F.split(spaced, rf"(?![ -~])(?:{EOL})")).otherwise(F.split(text, "\n"))
    trimmed = F.filter(F.transform(cut, lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")
    return F.transform(trimmed, lambda x: F.when(x.contains("  "), F.regexp_replace(x, "  +", " ")).otherwise(x))


def paragraphs(text: Column) -> Column:
    """Collapse white space inside each line and drop blank lines."""
    return F.array_join(
        F.filter(F.transform(lines(text), squeeze), lambda x: x != ""), "\n"
    )


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def sql_text(value: str) -> str:
    """SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def shortest(words: Iterable[str]) -> list[str]:
    """The words that hold no other word: a text with any of ``words`` has one of these."""
    once = list(dict.fromkeys(words))
    return [w for w in once if not any(o != w and o in w for o in once)]


def any_sql(name: str, words: Iterable[str]) -> str:
    """SQL test for any word inside the lower-cased text ``name``.

    Long word lists are written as SQL text: one driver call instead of several
    per word.
    """
    return " OR ".join(f"contains({name}, {sql_text(w)})" for w in shortest(words)) or "false"


def has_any(lowered: Column | str, words: Iterable[str]) -> Column:
    """True when any word is a substring of already lower-cased text."""
    if isinstance(lowered, str):
        return F.expr(any_sql(lowered, words))
    return any_of([lowered.contains(w) for w in shortest(words)])


def count_hits(lowered: Column, words: Iterable[str]) -> Column:
    return reduce(operator.add, [lowered.contains(w).cast("int") for w in words], F.lit(0))


def hits(lowered: str, labels: Mapping[str, str] | Iterable[str]) -> Column:
    """Ordered array of the labels whose word occurs in the lower-cased column."""
    pairs = labels.items() if isinstance(labels, Mapping) else [(w, w) for w in labels]
    found = ", ".join(
        f"CASE WHEN contains({lowered}, {sql_text(w)}) THEN {sql_text(label)} END" for w, label in pairs
    )
    return F.expr(f"array_except(array({found or 'CAST(NULL AS STRING)'}), array(CAST(NULL AS STRING)))")


def first_name(lowered: str, names: Iterable[str]) -> Column:
    """First configured name present with no letter or digit touching it."""

    def test(name: str) -> str:
        alone = sql_text(rf"(?<![a-z0-9]){re.escape(name)}(?![a-z0-9])")
        word = sql_text(name)
        return f"CASE WHEN contains({lowered}, {word}) AND {lowered} RLIKE {alone} THEN {word} END"

    tests = [*[test(n) for n in names], "CAST(NULL AS STRING)"]
    return F.expr(f"coalesce({', '.join(tests)})")


def is_lower(text: Column) -> Column:
    """Has letters and none of them is upper-case."""
    return (F.lower(text) == text) & (F.upper(text) != text)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest."""
    runs = F.regexp_extract_all(
        text, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0)
    )
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 2**31 - 1))),
        ),
        "",
    )


def truncate(text: Column, size: int) -> Column:
    """Cut to ``size`` characters, the last one being a full stop when cut."""
    return F.when(
        F.length(text) > size, F.concat(F.left(text, F.lit(max(size - 1, 0))), F.lit("."))
    ).otherwise(text)


def preview(text: Column, size: int) -> Column:
    """One-line preview; a size of zero or less gives ''."""
    return F.lit("") if size <= 0 else let(squeeze(text), lambda t: truncate(t, size))


def sections(text: Column, headers: Iterable[str], stops: Iterable[str]) -> Column:
    """Text of the sections opened by a header line and closed by a stop line.

    Header and stop lines become control marks, so that one linear regex pass
    collects all sections of a text of any length. Lines are trimmed.
    """
    opened, closed = "\x01", "\x02"

    def whole_line(words: Iterable[str]) -> str:
        return rf"(?iumd)^{BLANK}*(?:{'|'.join(words)}){BLANK}*$"

    marked = F.when(
        has_any(text, (opened, closed)), F.translate(text, opened + closed, "  ")
    ).otherwise(text)
    marked = F.regexp_replace(marked, whole_line(headers), opened)
    marked = F.regexp_replace(marked, whole_line(stops), closed)
    groups = F.regexp_extract_all(
        F.concat(marked, F.lit("\n" + closed)), F.lit(f"{opened}([^{opened}{closed}]*)"), F.lit(1)
    )
    kept = F.filter(groups, lambda g: g != "\n")
    return F.array_join(
        F.transform(
            kept,
            lambda g: F.array_join(
                F.transform(F.split(F.substring(g, F.lit(2), F.length(g) - 2), "\n"), strip), "\n"
            ),
        ),
        "\n",
    )
