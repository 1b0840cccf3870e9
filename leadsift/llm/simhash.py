"""SimHash near-duplicates through a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsift.llm.common import record, unpacked, with_results, written
from leadsift.llm.graph import components

SEED = 42
#: Fan-out of the index and members of a leaf.
FANOUT = 16
#: Queries that walk the index together: at first, and at most.
FIRST_BLOCK, QUERY_BLOCK = 64, 2048
#: Rows of one key that are searched together; larger keys are dealt into parts.
KEY_BLOCK = 16_384
#: Similarity of near copies, as a fraction.
SIMILAR = (4, 5)
#: Sets of at most so many shingles meet by a shared shingle, since few votes make SimHash bits unsteady.
SHORT = 48
#: Shingles of one group of candidates that are compared together; larger groups are dealt into parts.
SET_BLOCK = 1 << 20
MIX = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle of `width` words of the text with A-Z lowered, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(docs: DataFrame, width: int = 3, text: str = "text", name: str = "fingerprint_bits") -> DataFrame:
    """Append the 64-bit SimHash of each text as a signed long (null and empty texts: 0); drops the text."""

    def fn(texts: list[str]) -> list[list]:
        return [[_signed(majority_bits(shingle_hashes(t, width))) for t in texts]]

    return with_results(docs, text, [T.StructField(name, T.LongType())], fn, drop_text=True)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each pattern in the Gray-code sequence (prefix XOR of its bits)."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints of W words in Gray order under a tree of factored bit patterns.

    A node keeps the bits on which all fingerprints below it agree and its ancestors do not
    already say so. A search carries the differences met so far down the tree and leaves a whole
    group as soon as they exceed the bound.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.argsort(gray_rank(points[:, 0]), kind="stable")
        self.points = points[self.order]
        low = high = self.points
        levels = []
        while len(low) > 1 or not levels:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            levels.append((low, ~(low ^ high)))
        self.levels = []  # from the root: pattern, and mask without what the parent has
        for i, (pattern, mask) in enumerate(reversed(levels)):
            parent = np.arange(len(mask)) // FANOUT
            own = mask & ~levels[len(levels) - i][1][parent] if i else mask
            self.levels.append((pattern, own))
        self.masks = levels[0][1]

    def roots(self, most: int) -> np.ndarray:
        """For each input row a row that stands for all it reaches by links of at most `most` bits.

        Query blocks begin small and double. What earlier blocks have joined is not compared
        again: a walk also leaves nodes whose rows all have the query's root, so a dense group
        costs little more than its first queries.
        """
        n = len(self.points)
        root = np.arange(n)
        start, size = 0, FIRST_BLOCK
        while start < n:
            query = np.arange(start, min(n, start + size))
            self._unite(root, *self._found(query, root, self._uniform(root) if start else None, most))
            start, size = start + size, min(2 * size, QUERY_BLOCK)
        out = np.empty(n, np.int64)
        out[self.order] = self.order[root]
        return out

    def _uniform(self, root: np.ndarray) -> list[np.ndarray]:
        """By level from the tree's root: the root that all rows below a node have, or -1."""
        low, high, out = root, root, []
        for _ in self.levels:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out[::-1]

    def _found(self, query, root, uniform, most) -> tuple[np.ndarray, np.ndarray]:
        """Links from the queries to rows of other roots that come later in Gray order."""
        node, met = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        for depth, (pattern, own) in enumerate(self.levels):
            if depth:
                query, node, met = self._children(query, node, met, len(pattern))
            met = met + np.bitwise_count((self.points[query] ^ pattern[node]) & own[node]).sum(1)
            keep = met <= most
            if uniform:
                keep &= uniform[depth][node] != root[query]
            query, node, met = query[keep], node[keep], met[keep]
        query, node, met = self._children(query, node, met, len(self.points))
        keep = (node > query) & (root[node] != root[query])
        query, node, met = query[keep], node[keep], met[keep]
        met = met + np.bitwise_count((self.points[query] ^ self.points[node]) & ~self.masks[node // FANOUT]).sum(1)
        return query[met <= most], node[met <= most]

    @staticmethod
    def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            least = np.minimum(ra, rb)
            np.minimum.at(root, ra, least)
            np.minimum.at(root, rb, least)
            while (root[root] != root).any():
                root[:] = root[root]

    @staticmethod
    def _children(query, node, met, n):
        child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        inside = child < n
        return np.repeat(query, FANOUT)[inside], child[inside], np.repeat(met, FANOUT)[inside]


def linked(rows: DataFrame, most: int, block: int = KEY_BLOCK) -> DataFrame:
    """Links (`a`, `b`) that connect, within each `_key`, what differs in at most `most` bits.

    `rows` has `_key` (long), `_id` (long) and `_words` (array of longs). What shares a key is
    searched together, large keys as `_connected` says. A search over n rows gives fewer than n
    links, which connect the same rows as all its pairs would.
    """

    def search(column: pa.ListArray) -> np.ndarray:
        return GrayIndex(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)).roots(most)

    return _connected(rows.withColumn("_n", F.lit(1).cast("long")), "_words", search, block)


def _connected(
    rows: DataFrame, values: str, search: Callable[[pa.ListArray], np.ndarray], block: int
) -> DataFrame:
    """Links (`a`, `b`) that connect, within each `_key`, what `search` links; no task holds a large key.

    `rows` has `_key`, `_id`, its weight `_n` and `values`. A key of
    more than `block` weight, found by a sum with map-side combining, is dealt into parts by a hash
    of the row, and its smallest row is put into every part: what is close to it, or to
    something close to it in the same part, is joined in the first pass, so work on a group of
    copies grows with the group and not with its square. Rows of a key that lie outside its heaviest
    component then meet every part; rows of one component need not meet. Where these others
    exceed a block themselves, every two parts meet instead. No link is lost either way.
    """
    large = written(
        rows.groupBy("_key").agg(F.sum("_n").alias("_n"), F.min("_id").alias("_hub")).where(F.col("_n") > block)
        .select("_key", "_hub", F.ceil(F.col("_n") / block).alias("_parts")),
        "large-keys",
    )
    # Spark broadcasts the table of large keys if its size is below the session's threshold.
    marked = rows.join(large, "_key", "left")
    part = F.pmod(F.xxhash64("_id"), F.col("_parts"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda j: F.xxhash64("_key", j))
    own = F.array(F.xxhash64("_key", part))
    keys = F.when(F.col("_parts").isNull(), F.array("_key")).when(F.col("_id") == F.col("_hub"), every).otherwise(own)
    others = [c for c in rows.columns if c not in ("_key", "_n")]

    def searched(dealt: DataFrame) -> DataFrame:
        filled = dealt.select(F.explode("_keys").alias("_key"), "_id", values)
        return _searched(filled.repartition("_key").sortWithinPartitions("_key", "_id"), values, search)

    first = written(searched(marked.select(*others, keys.alias("_keys"))).distinct(), "links-first")
    if large.isEmpty():
        return first
    labels = components(first)
    placed = written(
        rows.join(large, "_key").join(labels.withColumnRenamed("node", "_id"), "_id", "left")
        .select("_key", "_id", "_n", "_parts", F.coalesce("label", "_id").alias("_label")),
        "large-placed",
    )
    shares = placed.groupBy("_key", "_label").agg(F.sum("_n").alias("_n"))
    rest = written(
        shares.groupBy("_key").agg(F.max_by("_label", F.struct("_n", "_label")).alias("_main"), (F.sum("_n") - F.max("_n")).alias("_rest"))
        .where("_rest > 0"),
        "large-rest",
    )
    if rest.isEmpty():
        return first
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda j: j != F.col("_part")),
        lambda j: F.xxhash64("_key", F.least("_part", j), F.greatest("_part", j)),
    )
    meets = F.when(F.col("_rest") > block, pairs).when(F.col("_label") == F.col("_main"), own).otherwise(every)
    again = written(
        placed.join(rest, "_key").withColumn("_part", part).select("_key", "_id", meets.alias("_keys")), "large-again"
    )
    return first.unionByName(searched(rows.join(again, ["_key", "_id"]).select(*others, "_keys")))


def _dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """`rows` with the keys of `large` (`_key`, `_parts`) dealt into parts of which every two share a new key."""
    part = F.pmod(F.xxhash64("_id"), F.col("_parts"))
    meets = F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda j: j != F.col("_part")),
        lambda j: F.xxhash64("_key", F.least("_part", j), F.greatest("_part", j)),
    )
    others = [c for c in rows.columns if c != "_key"]
    keys = F.when(F.col("_parts").isNull(), F.array("_key")).otherwise(meets)
    return rows.join(large, "_key", "left").withColumn("_part", part).select(F.explode(keys).alias("_key"), *others)


def _searched(ordered: DataFrame, values: str, search: Callable[[pa.ListArray], np.ndarray]) -> DataFrame:
    """Links (`a`, `b`) from each `_id` to that of its root, as `search` finds them in the lists of one `_key`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def groups(table: pa.Table, last: bool):
            key = table.column("_key").combine_chunks().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(key)) + 1
            bounds = np.concatenate([[0], cut, [len(key)]]) if len(key) else np.zeros(1, int)
            done = len(bounds) - 1 if last else len(bounds) - 2
            out = []
            if done > 0:
                ids = table.column("_id").combine_chunks().to_numpy(zero_copy_only=False)
                column = table.column(values).combine_chunks()
                for k in np.flatnonzero(np.diff(bounds[: done + 1]) > 1):
                    own = ids[bounds[k] : bounds[k + 1]]
                    root = search(column.slice(bounds[k], len(own)))
                    apart = root != np.arange(len(root))
                    out.append((own[apart], own[root[apart]]))
            return out, table.slice(bounds[max(done, 0)]) if len(key) else None

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            out, rest = groups(rest, False)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])
        if rest is not None:
            out, _ = groups(rest, True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def _block_keys(bits: Column, most: int) -> Column:
    """Keys of which fingerprints within `most` bits share at least one.

    64 bits in most + 4 parts: at least 4 parts are equal, so one of the choices of 4 parts is.
    """
    parts = most + 4
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    masks = [sum(((1 << (edges[p + 1] - edges[p])) - 1) << edges[p] for p in chosen) for chosen in combinations(range(parts), 4)]
    return F.array(*[F.xxhash64(F.lit(i), bits.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])


def simhash_components(docs: DataFrame, width: int = 3, most: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the text, plus `fingerprint` (16 hex digits) and `component_id`.

    Documents link when their fingerprints differ in at most `most` bits; `component_id` is the
    smallest key that a document reaches. A group's smallest key is written before it goes back to
    the nodes, so a group of any size meets it in a join of two plain tables. Equal fingerprints are one node, whatever their number,
    and the index holds each fingerprint once under every choice of 4 of `most` + 4 bit ranges, so
    the rows of one key agree on those bits. Null keys take part but are never the smallest unless
    all are null; null and empty texts have fingerprint 0 and link with each other like any other;
    repeated rows share a node; an empty table gives an empty result.
    """
    packed = docs.select(record(docs, without=text), F.col(text).alias("_text"))
    prints = written(with_fingerprint(packed, width, "_text", "_bits"), "simhash-prints")
    nodes = prints.groupBy("_bits").agg(F.min(f"_record.`{key}`").alias("_least"))
    rows = nodes.select(F.explode(_block_keys(F.col("_bits"), most)).alias("_key"), F.col("_bits").alias("_id"), F.array("_bits").alias("_words"))
    labels = components(linked(rows, most).distinct())
    groups = written(
        nodes.join(labels.withColumnRenamed("node", "_bits"), "_bits", "left").withColumn("_group", F.coalesce("label", "_bits")).drop("label"),
        "simhash-groups",
    )
    least = written(groups.groupBy("_group").agg(F.min("_least").alias("component_id")), "simhash-least")
    named = written(groups.select("_bits", "_group").join(least, "_group").select("_bits", "component_id"), "simhash-named")
    return prints.join(named, "_bits").select(
        *unpacked([c for c in docs.columns if c not in (text, "fingerprint", "component_id")]),
        F.lower(F.lpad(F.hex("_bits"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """256 SimHash bits from the 64-bit shingle hashes (each as often as it is given), as four signed words."""
    words = []
    for salt in MIX:
        mixed = hashes ^ salt
        if salt:
            mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(33)
        words.append(_signed(majority_bits(mixed)))
    return words


def set_name(distinct: np.ndarray) -> bytes:
    """The hash of a set of shingles by which equal sets are found."""
    return xxhash.xxh3_128_digest(distinct.tobytes(), SEED)


def _prefix(n):
    """How many of the n smallest-first shingles of a set hold one of those of any similar set."""
    return n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1


def similar_roots(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each set (ascending distinct `values`, one after the other) the first that it reaches by links of `SIMILAR`.

    Sets meet where their prefixes share a value, which no similar pair can miss, and are compared
    in full, unless earlier comparisons have already joined them.
    """
    n = len(sizes)
    starts = np.cumsum(sizes) - sizes
    counts = np.where(sizes > 0, _prefix(sizes), 0)
    owner = np.repeat(np.arange(n), counts)
    token = values[np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    place = np.arange(len(owner))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], token[1:] != token[:-1]]), place, 0)) if len(owner) else place
    later = place[first < place]
    later = later[np.argsort(owner[later], kind="stable")]
    root = np.arange(n)

    def compare(x: int, others: np.ndarray) -> None:
        own, step = values[starts[x] : starts[x] + sizes[x]], 1
        others = others[SIMILAR[1] * np.minimum(sizes[others], sizes[x]) >= SIMILAR[0] * np.maximum(sizes[others], sizes[x])]
        while len(others := others[root[others] != root[x]]):
            for y in others[:step]:
                if root[y] == root[x]:
                    continue
                theirs = values[starts[y] : starts[y] + sizes[y]]
                common = int((own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs).sum())
                if common * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * int(sizes[x] + sizes[y]):
                    least, most = sorted((root[x], root[y]))
                    root[root == most] = least
            others, step = others[step:], 2 * step

    for at in np.split(later, np.flatnonzero(np.diff(owner[later])) + 1) if len(later) else ():
        x = owner[at[0]]
        compare(x, np.unique(owner[at - 1]))
        met = np.concatenate([owner[first[i] : i] for i in at])
        compare(x, np.unique(met[root[met] != root[x]]))
    return root


def class_keys(hashes: np.ndarray, classes: int = 20) -> list[int]:
    """Keys of which near copies share some: sums of the distinct shingles in a few residue classes.

    The modulus is the power of two that leaves about five shingles in a class, and the next one,
    so texts of nearly the same length have a modulus in common. Sets of at most `SHORT` shingles
    have none: see `short_keys`.
    """
    distinct = np.unique(hashes)
    if len(distinct) <= SHORT:
        return []
    level = int(np.floor(np.log2(len(distinct) / 5)))
    keys = []
    for k in range(level, level + 2):
        residue = distinct >> np.uint64(8) & np.uint64((1 << k) - 1)
        for g in range(min(1 << k, classes)):
            if len(members := distinct[residue == g]):
                keys.append(_signed(xxhash.xxh64_intdigest(members.tobytes(), k * 64 + g)))
    return keys


def short_keys(hashes: np.ndarray) -> list[int]:
    """The smallest shingles of a short set: two similar sets, one of at most `SHORT`, share one of them."""
    distinct = np.unique(hashes)
    n = len(distinct)
    if not n or n * SIMILAR[0] > SHORT * SIMILAR[1]:
        return []
    return distinct[: _prefix(n)].view(np.int64).tolist()


def similar(sets: DataFrame, sizes: DataFrame, block: int = SET_BLOCK) -> DataFrame:
    """Links (`a`, `b`) that connect, within each `_key`, the sets of at least `SIMILAR`.

    `sets` has `_key` (long), `_id` (long) and `_set` (ascending distinct longs as unsigned);
    `sizes` has `_key` and the size `_n` of each. Keys of more than `block` values are dealt into
    parts that meet pairwise, so a task holds about two parts whatever the size of a key.
    """
    large = written(
        sizes.groupBy("_key").agg(F.sum("_n").alias("_n")).where(F.col("_n") > block).select("_key", F.ceil(F.col("_n") / block).alias("_parts")),
        "large-groups",
    )

    def search(column: pa.ListArray) -> np.ndarray:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return similar_roots(sizes, column.flatten().to_numpy(zero_copy_only=False).view(np.uint64))

    return _searched(_dealt(sets, large).repartition("_key").sortWithinPartitions("_key", "_id"), "_set", search)


def near_copies(docs: DataFrame, width: int = 5, most: int = 60, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `is_copy` and `duplicate_of`: null for the row of each group that stays, else that row's key.

    Documents link when the sets of their five-word shingles have a Jaccard similarity of at least
    0.8. That is an expected difference of 39 of 256 SimHash bits; `most` lies over three standard
    deviations above and only says which documents are compared. Candidates share one of some
    forty sums over small residue classes of their shingles, and the Gray-ordered index finds what
    lies within `most` bits; short texts are candidates when they share one of their smallest
    shingles. What candidates connect is compared set by set, and only links of 0.8 remain. Equal
    sets, whose 128-bit hashes agree, are one node; repetitions within a text count nowhere. The row with the smallest key stays
    (null keys last; among equal keys one row). Null and empty texts are copies of each other;
    an empty table gives an empty result; input columns named like results are replaced.
    """
    columns = [c for c in docs.columns if c not in ("duplicate_of", "is_copy")]
    rows = docs.select(record(docs.select(*[F.col(f"`{c}`") for c in columns]), without=text), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    fields = [T.StructField("_name", T.BinaryType()), T.StructField("_words", T.ArrayType(T.LongType())), T.StructField("_keys", T.ArrayType(T.LongType()))]
    fields += [T.StructField("_short", T.ArrayType(T.LongType())), T.StructField("_n", T.LongType())]

    def fn(texts: list[str]) -> list[list]:
        sets = [np.unique(shingle_hashes(t, width)) for t in texts]
        columns = zip(*[(set_name(h), wide_fingerprint(h), class_keys(h), short_keys(h), len(h)) for h in sets], strict=True)
        return [list(c) for c in columns] if sets else [[] for _ in fields]

    def sets_of(texts: list[str]) -> list[list]:
        return [[np.unique(shingle_hashes(t, width)).view(np.int64) for t in texts]]

    # The texts are written along: row numbers stay what they are when executors are lost.
    base = written(rows, "near-rows")
    prints = written(with_results(base.select("_row", F.col(f"_record.`{key}`").alias("_doc"), "_text"), "_text", fields, fn, drop_text=True), "near-prints")
    first = F.struct(F.col("_doc").isNull().alias("unknown"), F.col("_doc").alias("doc"), F.col("_row").alias("row"))
    nodes = written(
        prints.groupBy("_name").agg(
            F.min(first).alias("_first"), F.min_by(F.struct("_words", "_keys", "_short", "_n"), "_row").alias("_of"), F.min("_row").alias("_id")
        ).select("_name", "_first", "_id", "_of.*"),
        "near-nodes",
    )
    # One pass for both: rows of a short key agree in all bits.
    near = nodes.select(F.explode("_keys").alias("_key"), "_id", "_words")
    near = near.unionByName(nodes.select(F.explode("_short").alias("_key"), "_id", F.array(*[F.lit(0).cast("long")] * len(MIX)).alias("_words")))
    met = components(linked(near, most).distinct()).select(F.col("node").alias("_id"), F.col("label").alias("_key"))
    met = written(nodes.select("_id", "_n").join(met, "_id"), "near-met")

    texts = met.select("_key", "_id").join(base.select(F.col("_row").alias("_id"), "_text"), "_id")
    sets = with_results(texts, "_text", [T.StructField("_set", T.ArrayType(T.LongType()))], sets_of, drop_text=True)
    labels = components(similar(sets, met).distinct())
    groups = written(
        nodes.join(labels.withColumnRenamed("node", "_id"), "_id", "left").select("_name", "_first", F.coalesce("label", "_id").alias("_group")),
        "near-groups",
    )
    stays = written(groups.groupBy("_group").agg(F.min("_first").alias("_stays")), "near-stays")
    named = written(groups.select("_name", "_group").join(stays, "_group").select("_name", "_stays"), "near-named")
    verdict = prints.join(named, "_name").select(
        "_row", F.when(F.col("_stays.row") != F.col("_row"), F.col("_stays")).alias("_stays")
    )
    return base.join(verdict, "_row").select(
        *unpacked(columns, **{text: F.col("_text")}), F.col("_stays.doc").alias("duplicate_of"), F.col("_stays").isNotNull().alias("is_copy")
    )
