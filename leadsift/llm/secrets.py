"""Secret scans: known shapes, and windows of high entropy in candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadsift.llm.common import with_results

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
#: What ASSIGN needs, for a fast look before it runs.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Unbroken strings that may hold a secret.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
WINDOW = 20
#: Classes, narrowest first: all characters of a candidate, and how many different ones there are.
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 16),
    ("base32", re.compile(r"[A-Z2-7=]+|[a-z2-7=]+"), 32),
    ("one case", re.compile(r"[A-Z0-9]+|[a-z0-9]+"), 36),
    ("base62", re.compile(r"[A-Za-z0-9]+"), 62),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 65),
)
#: Standard deviations below the expected entropy of a random window that still count.
MARGIN = 2.0
#: Candidates that are no secrets: identifiers, and pieces that all read like words or numbers.
IDENTIFIER = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
BETWEEN, RUN = re.compile(r"[/_=+-]+"), re.compile(r"[A-Za-z]+|[0-9]+")
WORD = re.compile(r"[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*")
#: A piece up to this long says nothing; letters mixed with digits read like words if their runs have this length on average.
SHORT_PIECE, MEAN_RUN = 4, 7


@lru_cache
def threshold(alphabet: int, width: int = WINDOW) -> float:
    """Bits a character that a window of random characters reaches but for `MARGIN` deviations.

    The entropy is log2(width) - sum of n log2(n) / width over the counts of the characters, which
    are multinomial: mean and variance follow from the counts of one and of two characters.
    """

    def chance(n: int, of: int, p: float) -> float:
        return math.comb(of, n) * p**n * (1 - p) ** (of - n)

    cost = [n * math.log2(n) if n else 0.0 for n in range(width + 1)]
    one = [chance(n, width, 1 / alphabet) for n in range(width + 1)]
    mean = sum(p * c for p, c in zip(one, cost, strict=True))
    square = sum(p * c * c for p, c in zip(one, cost, strict=True))
    both = sum(
        one[n] * cost[n] * sum(chance(m, width - n, 1 / (alphabet - 1)) * cost[m] for m in range(width - n + 1)) for n in range(width + 1)
    )
    variance = alphabet * (square - mean * mean) + alphabet * (alphabet - 1) * (both - mean * mean)
    return math.log2(width) - (alphabet * mean + MARGIN * math.sqrt(variance)) / width


def _reads_like_words(piece: str) -> bool:
    if len(piece) <= SHORT_PIECE:
        return True
    runs = RUN.findall(piece)
    return (len(runs) == 1 or len(piece) >= MEAN_RUN * len(runs)) and all(r.isdigit() or WORD.fullmatch(r) for r in runs)


def allowed(s: str) -> bool:
    """Whether a candidate is an identifier or a path of words and numbers."""
    return bool(IDENTIFIER.fullmatch(s)) or all(_reads_like_words(p) for p in BETWEEN.split(s))


def high_windows(s: str, width: int, least: float) -> list[tuple[int, int]]:
    """Maximal stretches of `s` covered by windows of `width` characters with at least `least` bits.

    One pass: a window's sum of n log n changes by two characters from one place to the next.
    """
    cost = [0.0] + [n * math.log2(n) for n in range(1, width + 2)]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += cost[n + 1] - cost[n]
        counts[c] = n + 1
        if i >= width:
            out = s[i - width]
            n = counts[out]
            total += cost[n - 1] - cost[n]
            counts[out] = n - 1
        if i >= width - 1 and math.log2(width) - total / width >= least - 1e-9:
            start = i - width + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def _entropy_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    s = text[start:end]
    if allowed(s):
        return []
    alphabet = next(n for _, characters, n in CLASSES if characters.fullmatch(s))
    return [(start + a, start + b) for a, b in high_windows(s, WINDOW, threshold(alphabet))]


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every span, sorted."""
    spans: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                spans.append((m.start(), 0, m.end()))
    for c in CANDIDATE.finditer(text):
        at, until = c.span()
        inside = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, at, until)]
        inside += [(m.start(), 2, m.end()) for m in HEX.finditer(text, at, until)]
        known = [*spans, *inside]
        spans += inside
        spans += [(a, 3, b) for a, b in _entropy_spans(text, at, until) if not any(x <= a and b <= y for x, _, y in known)]
    return sorted(spans)


FIELDS = [
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_entropy", T.LongType()),
]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with the secrets of each whole text, in code points, end exclusive.

    Assignments, access keys and long hexadecimal runs always count. Every unbroken string of 20
    or more characters is scanned by windows of 20 characters; its narrowest character class says how
    much entropy a window of random characters has, and stretches that reach it but for two standard
    deviations are added, outside the other spans. Strings whose pieces between `/ _ = + -` all read
    like words or numbers are allowed, so letters of one case without a digit are never secrets. Null
    and empty texts have no spans; repeated rows give repeated results; an empty table gives an
    empty result; input columns named like results are replaced.
    """

    def fn(texts: list[str]) -> list[list]:
        out = []
        for t in texts:
            spans = spans_of(t)
            base = [s for s in spans if s[1] < 3]
            n = [sum(s[1] == k for s in spans) for k in range(4)]
            out.append((*n[:3], hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), n[3]))
        return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in FIELDS]

    return with_results(docs, text, FIELDS, fn, drop_text=not keep_text)


def redacted(text: str, mask: str = "[SECRET]") -> str:
    """The text with each span (overlapping ones joined) replaced by `mask`."""
    out, at = [], 0
    joined: list[list[int]] = []
    for a, _, b in spans_of(text):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    for a, b in joined:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])
