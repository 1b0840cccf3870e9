"""Periodic runs of words: minimizers at doubling scales seed them, short periods are scanned directly."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leadsift.llm.common import with_results

#: A run is at least this long and holds its period this often.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Periods up to this are found by comparing the text with itself at that lag.
DIRECT_LAGS = 16
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _doubled(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of `2 * length` words from those of `length` words, by start."""
    return _mixed(hashes[:-length] * np.uint64(_ODD) + (hashes[length:] ^ np.uint64(length)))


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the leftmost least hash of some `width` hashes in a row, ascending.

    Minima of 1, 2, 4 ... places are doubled up to the greatest power within the width; two of
    those cover each window.
    """
    value, place = hashes, np.arange(len(hashes))
    length = 1
    while 2 * length <= width:
        later = value[length:] < value[:-length]
        place = np.where(later, place[length:], place[:-length])
        value = np.where(later, value[length:], value[:-length])
        length *= 2
    if length < width:
        step = width - length
        later = value[step:] < value[:-step]
        place = np.where(later, place[step:], place[:-step])
    return np.unique(place)


def _reach(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch of places i around `at` with words[i] == words[i + lag], end exclusive."""
    last = len(words) - lag
    end, step = at, 16
    while end < last:
        stop = min(last, end + step)
        differs = np.flatnonzero(words[end:stop] != words[end + lag : stop + lag])
        if len(differs):
            end += int(differs[0])
            break
        end, step = stop, step * 2
    begin, step = at, 16
    while begin > 0:
        stop = max(0, begin - step)
        differs = np.flatnonzero(words[stop:begin] != words[stop + lag : begin + lag])
        if len(differs):
            begin = stop + int(differs[-1]) + 1
            break
        begin, step = stop, step * 2
    return begin, end


def _prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


def _repeats(words: np.ndarray, begin: int, end: int, lag: int) -> bool:
    head = min(end, begin + 64)
    if not np.array_equal(words[begin : head - lag], words[begin + lag : head]):
        return False
    return np.array_equal(words[begin : end - lag], words[begin + lag : end])


def _is_run(words: np.ndarray, begin: int, end: int, period: int) -> bool:
    """Whether words that repeat at distance `period` are a run with no smaller period.

    A stretch of four periods that has a smaller one too has a proper divisor as a period.
    """
    if end - begin < max(LEAST_WORDS, LEAST_PERIODS * period):
        return False
    return not any(_repeats(words, begin, end, period // p) for p in _prime_factors(period))


def _direct(words: np.ndarray, lag: int) -> list[tuple[int, int]]:
    """All longest stretches with words[i] == words[i + lag] that are long enough for a run."""
    same = np.concatenate([[0], (words[:-lag] == words[lag:]).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(same))
    begins, ends = edges[::2], edges[1::2] + lag
    full = ends - begins >= max(LEAST_WORDS, LEAST_PERIODS * lag)
    return list(zip(begins[full].tolist(), ends[full].tolist(), strict=True))


def periodic_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    `words` are numbers, equal for equal words. At the scale of 2^s words, strings of 2^(s+1)
    words are hashed and the least of each 2^s neighbours is kept. A run of period q, with
    2^s < q <= 2^(s+1), holds a kept string and the same one kept q words on, with no equal one
    between them, since a string of q words or more occurs once in a smallest period. So equal
    kept strings that follow each other at such a distance are all the seeds there need be; each
    is extended word by word, and seeds within a stretch already seen at that distance are passed
    over. Equal hashes only seed: the words decide. Periods up to `DIRECT_LAGS` are compared at
    every place.
    """
    n = len(words)
    found = []
    for lag in range(1, min(DIRECT_LAGS, n // LEAST_PERIODS) + 1):
        found += [(b, e - b, lag) for b, e in _direct(words, lag) if _is_run(words, b, e, lag)]
    width, length = 1, 1
    hashes = _mixed(words.astype(np.uint64) + np.uint64(_ODD))
    while LEAST_PERIODS * (width + 1) <= n:
        while length < 2 * width:
            hashes, length = _doubled(hashes, length), 2 * length
        if 2 * width > DIRECT_LAGS:
            kept = window_minima(hashes, width)
            order = np.argsort(hashes[kept], kind="stable")
            place = kept[order]
            lags = np.diff(place)
            seed = (hashes[place[1:]] == hashes[place[:-1]]) & (lags > max(width, DIRECT_LAGS)) & (lags <= 2 * width)
            starts, lags = place[:-1][seed], lags[seed]
            seen: dict[int, int] = {}
            for i in np.lexsort((starts, lags)):
                at, lag = int(starts[i]), int(lags[i])
                if at < seen.get(lag, 0):
                    continue
                begin, end = _reach(words, at, lag)
                seen[lag] = max(end, at + 1)
                if _is_run(words, begin, end + lag, lag):
                    found.append((begin, end + lag - begin, lag))
        width *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without the repetitions of any run: of each its first period stays."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]


def text_words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return text.encode().split()


FIELDS = [
    T.StructField("n_runs", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()),
    T.StructField("exponent_milli", T.LongType()),
    T.StructField("runs_sha256", T.StringType()),
    T.StructField("collapsed_sha256", T.StringType()),
]


def described(words: list[bytes], runs: list[tuple[int, int, int]]) -> list:
    longest = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    exponent = 1000 * longest[1] // longest[2] if runs else None
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = b" ".join(collapsed(words, runs))
    return [len(runs), *longest, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]


def text_runs(docs: DataFrame, text: str = "text", also: tuple[str, ...] = (), edit=None) -> DataFrame:
    """`docs` with `n_runs`, the longest run, and digests of all runs and of the text without repetitions.

    A run is a stretch of words with smallest period q, at least four periods and six words long,
    that no neighbouring word extends. `start`, `length` and `period` are those of the longest run
    (ties: first, then smallest period), null where there is none. `edit(words, *also)` may change
    the words of a text first.

    Each text is worked on whole and alone, in n log n steps; long ones need some hundred bytes a
    word. Null and empty texts have no words and no runs; repeated rows get equal results; an
    empty table gives an empty result. Extra columns pass through, those named like results are
    replaced.
    """

    def run(texts: list[str], *more: list) -> list[list]:
        out = []
        for text_, *values in zip(texts, *more, strict=True):
            words = text_words(text_)
            if edit is not None:
                words = edit(words, *values)
            out.append(described(words, periodic_runs(numbered(words))))
        return [[row[i] for row in out] for i in range(len(FIELDS))]

    return with_results(docs, text, FIELDS, run, also=also)
