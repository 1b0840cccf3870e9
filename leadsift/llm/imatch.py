"""I-Match fingerprints: mid-frequency terms, sorted, hashed under randomised lexicon subsets."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsift.llm.common import written

#: Anything between terms: ASCII characters other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Terms with an inverse document frequency ln(documents / documents with the term) in this band.
IDF_LOW, IDF_HIGH = 1.6, 6.2
#: A text with fewer terms in the band is told by all its terms.
LEAST_TERMS = 8
SUBSETS, LEVELS = 16, 3
#: The first level with as many cells as subsets.
CELL_LEVEL = 4
#: A lexicon up to this size goes to all tasks; a greater one is joined.
LEXICON_TERMS = 1 << 18
SLOTS = 1 << 16
#: Hexadecimal digits of a subset's hash, and what stands for a subset without terms.
DIGITS, NONE = 4, "...."


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), 0)


def terms(text: Column) -> Column:
    """Distinct hashes of the lower-cased terms of a text."""
    words = F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", low: float = IDF_LOW, high: float = IDF_HIGH) -> DataFrame:
    """Hashes `h` of the terms whose document frequency over all of `docs` lies in the band; written.

    A document has d distinct terms on average, so no more than d * e^high terms can be as frequent
    as the band asks for, however many documents there are.
    """
    n = docs.count()
    frequent = docs.select(F.explode(terms(F.coalesce(text, F.lit("")))).alias("h")).groupBy("h").count()
    band = F.col("count").between(n * math.exp(-high), n * math.exp(-low))
    return written(frequent.where(band).select("h"), "imatch-lexicon")


def _slots(lex: DataFrame) -> DataFrame:
    """One row: an array in which the terms of a slot lie together, for constant-time lookup."""
    slot = F.pmod("h", F.lit(SLOTS)).cast("int")
    filled = lex.groupBy(slot.alias("slot")).agg(F.collect_list("h").alias("hs"))
    every = lex.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(filled, "slot", "left")
    held = F.struct("slot", F.coalesce("hs", F.array().cast("array<bigint>")).alias("hs"))
    return written(every.agg(F.transform(F.sort_array(F.collect_list(held)), lambda x: x["hs"]).alias("slots")), "imatch-slots")


def _in_lexicon(rows: DataFrame, lex: DataFrame, bound: int) -> DataFrame:
    """`rows` with `_band`: of each term array in `_terms` the terms that the lexicon has."""
    if lex.count() <= bound:
        slots = _slots(lex)
        return rows.withColumn("_slots", slots.scalar()).withColumn(
            "_band",
            F.transform(
                "_terms",
                lambda hs: F.filter(hs, lambda h: F.array_contains(F.get("_slots", F.pmod(h, F.lit(SLOTS)).cast("int")), h)),
            ),
        ).drop("_slots")
    kept = written(rows.withColumn("_row", F.monotonically_increasing_id()), "imatch-terms")
    each = kept.select("_row", F.posexplode("_terms").alias("_at", "_hs")).select("_row", "_at", F.explode("_hs").alias("h"))
    band = each.join(lex, "h").groupBy("_row").agg(F.collect_list(F.struct("_at", "h")).alias("_found"))
    found = F.coalesce("_found", F.array().cast("array<struct<_at:int,h:bigint>>"))
    return kept.join(band, "_row", "left").withColumn(
        "_band",
        F.transform(
            F.sequence(F.lit(0), F.size("_terms") - 1),
            lambda at: F.transform(F.filter(found, lambda x: x["_at"] == at), lambda x: x["h"]),
        ),
    ).drop("_row", "_found")


def fingerprint(kept: Column, text: Column, seed: int = 41) -> Column:
    """The level in hexadecimal, then `SUBSETS` hashes at it and at each of the next `LEVELS` - 1.

    At level l a lexicon subset has each term with probability 2^-l, by a seeded hash: below level
    `CELL_LEVEL` each subset has a hash of its own, from there on the subsets are the first cells
    of one random partition of the lexicon. The level is that at which a subset has one or two of
    the text's terms, so short and long texts alike are told by subsets that an edit mostly leaves
    alone. A text without terms is told by a hash of all of it.
    """

    def hashed(hs: Column) -> Column:
        code = F.lpad(F.hex(F.xxhash64(hs).bitwiseAND(0xFFFF)), DIGITS, "0")
        return F.when(F.size(hs) == 0, NONE).otherwise(code)

    def subsets(hs: Column, level: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
        numbers = F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long"))
        own = F.transform(numbers, lambda j: hashed(F.filter(hs, lambda h: F.xxhash64(F.lit(seed), j, h).bitwiseAND(mask) == 0)))
        cell = F.transform(hs, lambda h: F.struct(F.xxhash64(F.lit(seed), h).bitwiseAND(mask).alias("cell"), h.alias("h")))
        shared = _let(
            F.filter(cell, lambda x: x["cell"] < SUBSETS),
            lambda xs: F.transform(numbers, lambda j: hashed(F.transform(F.filter(xs, lambda x: x["cell"] == j), lambda x: x["h"]))),
        )
        return F.array_join(F.when(level < CELL_LEVEL, own).otherwise(shared), "")

    def at_levels(hs: Column) -> Column:
        level = F.length(F.bin(F.size(hs).cast("long"))) - 1
        return F.concat(F.lpad(F.hex(level.cast("long")), 2, "0"), *[subsets(hs, level + i) for i in range(LEVELS)])

    whole = F.concat(F.lit("~"), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    return _let(F.array_sort(kept), lambda hs: F.when(F.size(hs) == 0, whole).otherwise(at_levels(hs)))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the subsets that either text has terms in, at the levels both fingerprints have,
    the share k / n with equal hashes, as 2k / (n + k), the share of terms that stay."""
    level_a, level_b = (F.conv(F.substring(x, 1, 2), 16, 10).cast("int") for x in (a, b))

    def compared(first_a: Column, first_b: Column, count: Column) -> Column:
        def code(x: Column, first: Column, i: Column) -> Column:
            return F.substr(x, 3 + DIGITS * (first + i), F.lit(DIGITS))

        pairs = F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.struct(code(a, first_a, i).alias("a"), code(b, first_b, i).alias("b"))
        )
        told = F.filter(pairs, lambda p: (p["a"] != NONE) | (p["b"] != NONE))
        return _let(
            told,
            lambda t: F.when(F.size(t) == 0, 0.0).otherwise(
                _let(F.size(F.filter(t, lambda p: p["a"] == p["b"])), lambda k: 2.0 * k / (F.size(t) + k))
            ),
        )

    later = F.greatest(level_a, level_b)
    shared = LEVELS - (later - F.least(level_a, level_b))
    return (
        F.when(a == b, 1.0)
        .when(a.startswith("~") | b.startswith("~") | (shared <= 0), 0.0)
        .otherwise(compared((later - level_a) * SUBSETS, (later - level_b) * SUBSETS, shared * SUBSETS))
    )


def _followers(keys: DataFrame) -> DataFrame:
    """(`_id`, `_hash`, `_next_id`, `_next_hash`) for each distinct key, the first one after the last.

    Keys go to ranges, each range is numbered on its own, and the first keys of the ranges, one
    row for each, tell what follows a range's last key.
    """
    here = F.struct("_id", "_hash")
    ranged = keys.repartitionByRange("_id", "_hash").select("_id", "_hash", F.spark_partition_id().alias("_part"))
    ranged = written(ranged, "imatch-order")
    firsts = ranged.groupBy("_part").agg(F.min(here).alias("_first"))
    after = firsts.select(
        "_part",
        F.coalesce(F.lead("_first").over(Window.orderBy("_part")), F.min("_first").over(Window.partitionBy())).alias("_after"),
    )
    following = F.lead(here).over(Window.partitionBy("_part").orderBy("_id", "_hash"))
    linked = ranged.withColumn("_follows", following).join(F.broadcast(after), "_part")
    return linked.select("_id", "_hash", F.coalesce("_follows", "_after").alias("_next")).select(
        "_id", "_hash", F.col("_next._id").alias("_next_id"), F.col("_next._hash").alias("_next_hash")
    )


def _same(left: DataFrame, right: DataFrame, id_: str, hash_: str) -> Column:
    return left["_id"].eqNullSafe(right[id_]) & (left["_hash"] == right[hash_])


def imatch(docs: DataFrame, key: str = "doc_id", text: str = "text", lexicon_bound: int = LEXICON_TERMS) -> DataFrame:
    """The key, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`, `near_edited`, `near_next`.

    The edited text has its last quarter (rounded down) replaced by as many first code points of
    the next document, by ascending key. Texts meet their next one by the key and a hash of the
    text: the heads go to the earlier document, so each text is shuffled once. Rows with equal keys
    follow each other by the hash; rows with equal key and text are one place in the order and get
    equal results. Null keys come first; null texts are empty. Empty texts and texts without a
    letter or digit are told by a hash of all of it. A single document is its own next one; an
    empty table gives an empty result. Other columns are not returned. Very long texts are held
    one at a time in a task, with eight bytes for each distinct term.
    """
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    lex = lexicon(docs.select(F.col(text).alias("text")))
    keys = rows.groupBy("_id", "_hash").agg(F.max(F.length("_text")).alias("_n"))
    links = written(_followers(keys.drop("_n")), "imatch-links")
    sized = keys.join(links.withColumnsRenamed({"_id": "_a", "_hash": "_b"}), F.col("_id").eqNullSafe(F.col("_a")) & (F.col("_hash") == F.col("_b")))
    wanted = sized.where("_n >= 4").select(
        F.col("_id").alias("_to_id"), F.col("_hash").alias("_to_hash"), F.floor(F.col("_n") / 4).cast("int").alias("_quarter"), "_next_id", "_next_hash"
    )
    # Links are small beside the texts; only their measured size may make them a broadcast side.
    heads = (
        rows.join(wanted, _same(rows, wanted, "_next_id", "_next_hash"))
        .select("_to_id", "_to_hash", F.substr("_text", F.lit(1), F.col("_quarter")).alias("_head"))
        .groupBy("_to_id", "_to_hash").agg(F.first("_head").alias("_head"))
    )
    n = F.length("_text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("_text", F.lit(1), n - quarter), F.coalesce("_head", F.lit("")))
    pairs = rows.join(heads, _same(rows, heads, "_to_id", "_to_hash"), "left").select(
        "_id", "_hash", n.cast("long").alias("n_chars"), F.array(F.col("_text"), edited).alias("_texts")
    )
    with_terms = pairs.withColumn("_terms", F.transform("_texts", terms))
    told = _in_lexicon(with_terms, lex, lexicon_bound).select(
        "_id", "_hash", "n_chars", F.sha2(F.get("_texts", 1).cast("binary"), 256).alias("edited_sha256"),
        F.transform(
            F.arrays_zip("_texts", "_terms", "_band"),
            lambda x: fingerprint(F.when(F.size(x["_band"]) >= LEAST_TERMS, x["_band"]).otherwise(x["_terms"]), x["_texts"]),
        ).alias("_prints"),
    )
    prints = written(
        told.select("_id", "_hash", "n_chars", "edited_sha256", F.get("_prints", 0).alias("fingerprint"), F.get("_prints", 1).alias("edited_fingerprint")),
        "imatch-prints",
    )
    following = prints.select(F.col("_id").alias("_of_id"), F.col("_hash").alias("_of_hash"), F.col("fingerprint").alias("_following")).dropDuplicates(["_of_id", "_of_hash"])
    linked = prints.join(links.withColumnsRenamed({"_id": "_a", "_hash": "_b"}), F.col("_id").eqNullSafe(F.col("_a")) & (F.col("_hash") == F.col("_b")))
    return linked.join(following, F.col("_next_id").eqNullSafe(F.col("_of_id")) & (F.col("_next_hash") == F.col("_of_hash"))).select(
        F.col("_id").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"),
    )
