"""Repeated byte strings: suffixes filtered by a difference-cover sample, sorted bucket by bucket."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsift.llm.common import utf8_bytes, written

#: Prime q; the cover has q + 1 residues of q * q + q + 1.
COVER_ORDER = 13
#: Text that one task holds at a time, except for a longer single text.
CHUNK_BYTES = 4 << 20
LEAST_CHUNKS, LEAST_BUCKET_BITS = 64, 8
BASE = 0x9E3779B97F4A7C15
#: The cover's order for words: 6 of 31 residues.
WORD_COVER_ORDER = 5
#: Kinds of messages to a chunk, and how many bytes of a name each keeps.
COPY, SAMPLE, WINDOW, WORD_SAMPLE, WORD_WINDOW = range(5)
KEPT_BYTES = {SAMPLE: 5, WINDOW: 7, WORD_SAMPLE: 5, WORD_WINDOW: 7}
MESSAGE = "chunk long, kind int, bucket long, h1 long, h2 long, home boolean, bits binary"
SORTED = "bucket long, kind int, chunk long, names binary"


@lru_cache
def difference_cover(q: int = COVER_ORDER) -> tuple[int, ...]:
    """q + 1 residues modulo v = q*q + q + 1 of which every residue is a difference (Singer).

    They are the powers of a cubic field element that have no square term; the first cubic whose
    powers give a cover is taken.
    """
    v = q * q + q + 1
    for a, b, c in product(range(q), range(q), range(1, q)):
        x, found = (1, 0, 0), []
        for i in range(v):
            if x[2] == 0:
                found.append(i)
                if len(found) > q + 1:
                    break
            lead = x[2]
            x = (lead * c % q, (x[0] + lead * b) % q, (x[1] + lead * a) % q)
        if len(found) == q + 1 and len({(s - t) % v for s in found for t in found}) == v:
            return tuple(found)
    raise ValueError("q must be prime")


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    space = np.zeros(256, bool)
    space[list(b" \t\n\x0b\x0c\r")] = True
    return space


class Strings:
    """Symbols of some texts end to end, and which of their strings of `length` symbols are repeated.

    `order` is that of the difference cover. With `apart`, a string counts as repeated only if
    another text has it.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, length: int, order: int, kinds: tuple[int, int], apart: bool, messages: pd.DataFrame, bucket_bits: int):
        self.sizes, self.length, self.order, self.kinds, self.apart = sizes, length, order, kinds, apart
        self.messages, self.bucket_bits = messages, bucket_bits
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = len(symbols)
        power, self.inverse = _powers(1 << max(20, int(n + 1).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(0x51ED27)) * power[:n], out=self.sums[1:])

    def names(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """64-bit names of the strings of this length that start at `at`."""
        x = (self.sums[at + length] - self.sums[at]) * self.inverse[at]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _modulus(self) -> int:
        return self.order * self.order + self.order + 1

    def sample(self) -> tuple[np.ndarray, int]:
        """Starts of the sampled suffixes, and the length of which each has at least that much left.

        Two equal strings of `length` symbols have a sampled place at the same distance, less than
        the cover's modulus, from their starts; what follows it within the strings is equal too.
        """
        v = self._modulus()
        rest = self.length - v + 1
        sampled = np.zeros(v, bool)
        sampled[list(difference_cover(self.order))] = True
        out = []
        for begin, size in zip(self.begins, self.sizes, strict=False):
            if size >= self.length:
                out.append(begin + np.flatnonzero(np.resize(sampled, size - rest + 1)))
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), rest

    def _buckets(self, names: np.ndarray) -> np.ndarray:
        return (names >> np.uint64(64 - self.bucket_bits)).astype(np.int64)

    def _told(self, names: np.ndarray, kind: int) -> np.ndarray:
        """Which of the sorted distinct names also occur in other chunks, from the buckets' answers."""
        told = np.zeros(len(names), bool)
        answers = self.messages[self.messages["kind"] == kind]
        buckets = self._buckets(names)
        edges = np.searchsorted(buckets, np.stack([answers["bucket"], answers["bucket"] + 1]).astype(np.int64))
        for low, high, bits in zip(*edges, answers["bits"], strict=True):
            told[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low)
        return told

    def _texts(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, side="right") - 1

    def repeated(self, at: np.ndarray, length: int, kind: int) -> np.ndarray:
        names, first, back, count = np.unique(self.names(at, length), return_index=True, return_inverse=True, return_counts=True)
        if self.apart:
            text = self._texts(at)
            several = np.zeros(len(names), bool)
            several[back[text != text[first][back]]] = True
        else:
            several = count > 1
        return (self._told(names, kind) | several)[back]

    def windows(self) -> np.ndarray:
        """Starts of the strings that a repeated sampled suffix makes worth sorting."""
        at, rest = self.sample()
        at = at[self.repeated(at, rest, self.kinds[0])]
        text = self._texts(at)
        low = np.maximum(at - self._modulus() + 1, self.begins[text])
        high = np.minimum(at, self.begins[text + 1] - self.length)
        inside = high >= low
        cover = np.zeros(len(self.sums), np.int32)
        np.add.at(cover, low[inside], 1)
        np.add.at(cover, high[inside] + 1, -1)
        return np.flatnonzero(np.cumsum(cover[:-1]) > 0)

    def covered(self) -> np.ndarray:
        """Which symbols lie in a repeated string."""
        at = self.windows()
        at = at[self.repeated(at, self.length, self.kinds[1])]
        cover = np.zeros(len(self.sums), np.int32)
        cover[at] += 1
        cover[at + self.length] -= 1
        return np.cumsum(cover[:-1]) > 0

    def to_sort(self, at: np.ndarray, length: int, chunk: int, kind: int) -> pd.DataFrame:
        """One row for each bucket: the distinct names of the chunk that fall in it, in order.

        The bucket is the top of a name, so a name needs only the bytes below it.
        """
        names = np.unique(self.names(at, length))
        kept_bytes = KEPT_BYTES[kind]
        full, first = np.unique(self._buckets(names), return_index=True)
        edges = [*first.tolist(), len(names)]
        low = ((names << np.uint64(self.bucket_bits)) >> np.uint64(64 - 8 * kept_bytes)).astype("<u8")
        raw = low.view(np.uint8).reshape(-1, 8)[:, :kept_bytes]
        return pd.DataFrame(
            {
                "bucket": full.astype(np.int64), "kind": np.int32(kind), "chunk": np.int64(chunk),
                "names": [raw[low:high].tobytes() for low, high in zip(edges, edges[1:])],
            }
        )


class Chunk:
    """The distinct texts of a chunk that others do not stand for, as bytes and as words."""

    def __init__(self, texts: pd.DataFrame, messages: pd.DataFrame, length: int, words: int, bucket_bits: int):
        copies = messages[messages["kind"] == COPY]
        self.copied = set(zip(copies["h1"], copies["h2"], strict=True))
        away = copies[~copies["home"].astype(bool)]
        skip = set(zip(away["h1"], away["h2"], strict=True))
        least = min(length, 2 * words - 1)
        by_hash = {}
        for h1, h2, data in zip(texts["h1"], texts["h2"], texts["data"], strict=True):
            if len(data) >= least and (h1, h2) not in skip:
                by_hash[(h1, h2)] = data
        self.keys = sorted(by_hash)
        parts = [by_hash[k] for k in self.keys]
        sizes = np.array([len(p) for p in parts], np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        self.bytes = Strings(data, sizes, length, COVER_ORDER, (SAMPLE, WINDOW), False, messages, bucket_bits)
        # A text's end ends its last word: no word reaches over it.
        edge = np.zeros(len(data) + 1, bool)
        edge[self.bytes.begins] = True
        inside = np.concatenate([[False], ~_space()[data], [False]])
        begins = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        counts = np.diff(np.searchsorted(begins, self.bytes.begins))
        symbols = self.bytes.names(begins, ends - begins)
        self.words = Strings(symbols, counts, words, WORD_COVER_ORDER, (WORD_SAMPLE, WORD_WINDOW), True, messages, bucket_bits)

    def sampled(self, chunk: int) -> pd.DataFrame:
        return pd.concat([x.to_sort(*x.sample(), chunk, x.kinds[0]) for x in (self.bytes, self.words)])

    def windows(self, chunk: int) -> pd.DataFrame:
        return pd.concat([x.to_sort(x.windows(), x.length, chunk, x.kinds[1]) for x in (self.bytes, self.words)])


def _ties(bucket: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sort one bucket of a kind: tell each chunk which of its names another chunk has too."""
    kind, kept_bytes = bucket[1], KEPT_BYTES[bucket[1]]
    counts = [len(x) // kept_bytes for x in rows["names"]]
    wide = np.zeros((sum(counts), 8), np.uint8)
    wide[:, :kept_bytes] = np.frombuffer(b"".join(rows["names"]), np.uint8).reshape(-1, kept_bytes)
    names = wide.view("<u8").ravel()
    order = np.argsort(names, kind="stable")
    equal = names[order][1:] == names[order][:-1]
    tied = np.zeros(len(names), bool)
    tied[order[1:]] |= equal
    tied[order[:-1]] |= equal
    out, at = [], 0
    for n in counts:
        out.append(np.packbits(tied[at : at + n]).tobytes())
        at += n
    some = [b.strip(b"\0") != b"" for b in out]
    answer = pd.DataFrame({"chunk": rows["chunk"], "kind": np.int32(kind), "bucket": np.int64(bucket[0])})
    answer["h1"], answer["h2"], answer["home"], answer["bits"] = np.int64(0), np.int64(0), False, out
    return answer[some]


def repeated_strings(docs: DataFrame, length: int = 400, words: int = 51, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes of each text covered by a `length`-byte string that starts anywhere else too.

    Returns the key, `n_bytes`, `n_removed`, `n_spans` (maximal removed runs), `kept_sha256`,
    `n_passage_words` and `removed` (starts and ends in turn, as byte places). Strings never cross
    texts and are judged on the input. `n_passage_words` tells what the byte rule leaves: the words
    in passages of `words` words or more that another row has too, whatever white space lies
    between them; they are found in the same way, with words in place of bytes, and not removed.

    Texts go to chunks by hash. Equal whole texts are told by two 64-bit hashes; one chunk works on
    such a text for all its copies. Each chunk samples its suffixes by a difference cover and gives
    the buckets the names of what follows; a bucket is sorted on its own and answers which names
    are tied between chunks. Only suffixes with a tied sample inside can be equal for `length`
    bytes: their names are sorted bucket by bucket in the same way. Names are 64-bit
    hashes in place of ranks, since nothing beyond `length` bytes has to be ordered. A chunk sends
    a name once however often it has it.

    Null texts are empty, texts under `length` bytes lose nothing; rows with equal texts each lose
    all of it from `length` bytes on; null keys are kept; an empty table gives an empty result.
    """
    total = docs.agg(F.coalesce(F.sum(utf8_bytes(text)), F.lit(0))).first()[0]
    chunks = max(LEAST_CHUNKS, -(-total // CHUNK_BYTES))
    bucket_bits = max(LEAST_BUCKET_BITS, (2 * chunks - 1).bit_length())
    whole = F.coalesce(text, F.lit(""))
    texts = docs.select(
        F.pmod(F.xxhash64(key, text), F.lit(chunks)).alias("chunk"), F.col(key).alias("doc"),
        F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(7), whole).alias("h2"), F.encode(whole, "UTF-8").alias("data"),
    )
    places = texts.groupBy("chunk", "h1", "h2").agg(F.count("*").alias("n"))
    shared = places.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("chunk").alias("first")).where("n > 1").drop("n")
    copies = written(
        places.join(shared, ["h1", "h2"]).select(
            "chunk", F.lit(COPY).alias("kind"), F.lit(0).cast("long").alias("bucket"), "h1", "h2",
            (F.col("chunk") == F.col("first")).alias("home"), F.lit(None).cast("binary").alias("bits"),
        ),
        "text-copies",
    )
    by_chunk = texts.groupBy("chunk")

    def sampled(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return Chunk(left, right, length, words, bucket_bits).sampled(key[0])

    def sorted_windows(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return Chunk(left, right, length, words, bucket_bits).windows(key[0])

    def cleaned(chunk: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(left, right, length, words, bucket_bits)
        removed, passage, place = c.bytes.covered(), c.words.covered(), {k: i for i, k in enumerate(c.keys)}
        out = []
        for doc, h1, h2, data in zip(left["doc"], left["h1"], left["h2"], left["data"], strict=True):
            gone, shared, i = np.zeros(len(data), bool), 0, place.get((h1, h2))
            if (h1, h2) in c.copied:
                gone[:] = len(data) >= length
                shared = len(data.split())
                shared = shared if shared >= words else 0
            elif i is not None:
                gone = removed[c.bytes.begins[i] : c.bytes.begins[i + 1]]
                shared = int(passage[c.words.begins[i] : c.words.begins[i + 1]].sum())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((doc, len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), shared, edges.tolist()))
        frame = pd.DataFrame(out, columns=[*names])
        frame["doc"] = pd.Series([o[0] for o in out], dtype=object)
        return frame

    names = ("doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "removed")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, removed array<long>"
    samples = by_chunk.cogroup(copies.groupBy("chunk")).applyInPandas(sampled, SORTED)
    known = copies.unionByName(samples.groupBy("bucket", "kind").applyInPandas(_ties, MESSAGE))
    windows = by_chunk.cogroup(known.groupBy("chunk")).applyInPandas(sorted_windows, SORTED)
    known = known.unionByName(windows.groupBy("bucket", "kind").applyInPandas(_ties, MESSAGE))
    return by_chunk.cogroup(known.groupBy("chunk")).applyInPandas(cleaned, schema).withColumnRenamed("doc", key)
