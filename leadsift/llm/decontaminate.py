"""Benchmark decontamination: a broadcast hash set of test windows against all training windows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import zip_longest

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsift.llm.common import record, with_results, written

#: A word: no ASCII character but digits and lower-case letters.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Test words that one broadcast holds; a larger benchmark goes through in several passes, which
#: hashing deals so evenly that half the bound is the size aimed at.
BROADCAST_WORDS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.encode().lower().decode())  # lowers A-Z only


class WindowSet:
    """Windows of the test items: word numbers, sorted hashes by window length, exact windows."""

    def __init__(self, items: list[tuple[object, list[str]]], width: int):
        self.number: dict[str, int] = {}
        self.exact: dict[tuple[int, ...], set] = defaultdict(set)
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            for i in range(max(1, len(ids) - width + 1)) if ids else ():
                self.exact[tuple(ids[i : i + width])].add(item)
        by_length = defaultdict(list)
        for window in self.exact:
            by_length[len(window)].append(self.hashes(np.array(window, np.int64), len(window))[0])
        self.sorted = {n: np.unique(np.array(h, np.uint64)) for n, h in by_length.items()}

    @staticmethod
    def hashes(ids: np.ndarray, width: int) -> np.ndarray:
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        out = np.zeros(len(ids) - width + 1, np.uint64)
        for i in range(width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + len(out)]
        return out

    def hits(self, words: list[str]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        get = self.number.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        covered, items = np.zeros(len(words) + 1, np.int64), set()
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for n, table in self.sorted.items():
            starts = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(starts):
                continue
            found = self.hashes(ids, n)[starts]
            at = np.minimum(np.searchsorted(table, found), len(table) - 1)
            for s in starts[table[at] == found]:
                if owners := self.exact.get(tuple(ids[s : s + n])):  # verified word by word
                    items |= owners
                    covered[s] += 1
                    covered[s + n] -= 1
        return np.cumsum(covered[:-1]) > 0, items


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(T.LongType())),
]


def _joined(items: set) -> str:
    return ",".join(sorted(items))


def decontamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", keep_text: bool = False
) -> DataFrame:
    """`docs` with the words, hits and items of each text; the text itself only with `keep_text`.

    Windows are `width` words of an item, or all its words if it has fewer. Each pass over the
    documents broadcasts the set of at most BROADCAST_WORDS test words (or of one longer item); a
    larger benchmark takes several passes, each written to the shared folder, and the next adds to
    the hits of the last. `hit_spans` lists word positions, start and end in turn, of the maximal
    hit runs. Null texts and items have no words and are never hit; an empty benchmark hits nothing;
    null item ids take part as "null"; an empty table gives an empty result; input columns named like results are replaced.
    """
    spark = docs.sparkSession
    words = F.regexp_count(F.coalesce(F.translate(item_text, UPPER, LOWER), F.lit("")), F.lit(WORD.pattern))
    numbered = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t"), words.alias("n")).distinct()
    passes = max(1, -(-(numbered.agg(F.sum("n")).first()[0] or 0) // (BROADCAST_WORDS // 2)))
    numbered = numbered.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(passes)))
    done = docs
    for b in range(passes):
        rows = numbered.where(F.col("b") == b).toLocalIterator()
        shared = spark.sparkContext.broadcast(WindowSet([(r["i"], words_of(r["t"] or "")) for r in rows], width))

        def fn(texts: list[str], spans: list = (), before: list = (), shared=shared) -> list[list]:
            out = []
            for t, old, known in zip_longest(texts, spans, before, fillvalue=()):
                found = words_of(t)
                hit, items = shared.value.hits(found)
                for low, high in zip(old[::2], old[1::2], strict=True):
                    hit[low:high] = True
                items = items.union(known)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                n = int(hit.sum())
                digest = hashlib.sha256(_joined(items).encode()).hexdigest()
                out.append((len(found), n, len(items), digest, n > 0, sorted(items), edges.tolist()))
            return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in FIELDS]

        last = b == passes - 1
        done = with_results(done, text, FIELDS, fn, drop_text=last and not keep_text, also=("hit_spans", "hit_items") if b else ())
        if not last:
            done = written(done, "decontamination-pass")
            shared.unpersist()
    return done


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text") -> DataFrame:
    """The rows and columns of `docs` whose text holds no window of a benchmark item."""
    tagged = docs.select(record(docs), F.col(text).alias("_text"))
    checked = decontamination(tagged, benchmark, width, "_text")
    return checked.where("NOT contaminated").select("_record.*")
