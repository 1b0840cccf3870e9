"""Quality rules: whole-text counts, and lines that too many documents of a host have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsift.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line is over the limit in a host if more distinct documents have it than both of these allow.
LINE_DOCS, LINE_SHARE = 20, 0.01
#: A document is depleted if fewer words, or a smaller share of its words, are left.
LEFT_WORDS, LEFT_SHARE = 10, 0.3


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normalised_line(line: Column) -> Column:
    """A-Z lowered, digit runs as 0, runs of ASCII white space and punctuation as one space, trimmed."""
    low = F.regexp_replace(F.translate(line, UPPER, LOWER), "[0-9]+", "0")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _counted(docs: DataFrame, text: str, key: str, host: str) -> DataFrame:
    """One row for each document with its counts and (hash, words) of its lines; written once."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        record.alias("_record"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"),
        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("_host"),
    )
    bare = F.length(F.translate(whole, " \t\n\x0b\x0c\r", ""))
    split = rows.select(
        "_record", "_row", "_host", F.xxhash64(whole).alias("_hash"), bare.cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(_words(whole), lambda w: F.xxhash64(w)).alias("_words"),
        F.filter(F.split(whole, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "").alias("_lines"),
    )
    # Hash and place of each window in hash order: equal windows lie side by side, in n log n.
    n = F.size("_words")
    window = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]).alias("h"), i.alias("at")),
    )
    sorted_windows = split.select(
        "_record", "_row", "_host", "_hash", "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.when(n >= WINDOW, window).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))).alias("_sorted"),
        F.transform("_lines", lambda x: F.struct(F.xxhash64(normalised_line(x)).alias("h"), F.size(_words(x)).alias("words"))).alias("_lines"),
    )
    again = F.filter(
        F.transform(
            "_sorted",
            lambda x, i: F.when((F.get("_sorted", i - 1)["h"] == x["h"]) | (F.get("_sorted", i + 1)["h"] == x["h"]), x["at"]),
        ),
        F.isnotnull,
    )
    starts = sorted_windows.withColumn("_starts", F.sort_array(again)).drop("_sorted")
    reach = F.transform("_starts", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - at, F.lit(WINDOW))))
    repeated = F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)
    return written(starts.withColumn("n_repeat_words", repeated).drop("_starts"), "quality-rows")


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", keep_text: bool = False) -> DataFrame:
    """`docs` with counts, `base_failed`, `removed_lines`, `left_words` and `kept`; with `keep_text` also `clean_text`.

    Lines are compared by a 64-bit hash of their normal form, within a host (null is a host). A
    document counts once for a line however often it has it, and exact copies count as one
    document, so a text that is merely copied loses no line. Lines without a letter or digit have
    one normal form together. A line over the limit goes from all documents of the host; what
    keeps too few words is depleted and rejected. Counting is two grouped sums with map-side
    combining; lines over the limit come back through a join on plain tables that adaptive
    execution can split or broadcast by their real size.

    Null and empty texts have no words and fail; repeated rows are judged alike; an empty table
    gives an empty result; input columns named like results are replaced. `clean_text` is the text
    without the removed lines.
    """
    rows = _counted(docs, text, key, host)
    lines = rows.select("_row", "_host", "_hash", F.explode("_lines").alias("_line")).select(
        "_row", "_host", "_hash", F.col("_line.h").alias("_h"), F.col("_line.words").alias("_w")
    )
    limits = rows.groupBy("_host", "_hash").agg(F.lit(1).alias("one")).groupBy("_host").agg(F.greatest(F.lit(LINE_DOCS), LINE_SHARE * F.count("*")).alias("_limit"))
    spread = lines.groupBy("_host", "_h", "_hash").agg(F.lit(1).alias("one")).groupBy("_host", "_h").agg(F.count("*").alias("_docs"))
    over = written(spread.where(F.col("_docs") > LINE_DOCS).join(limits, "_host").where("_docs > _limit").select("_host", "_h"), "quality-lines")
    lost = lines.join(over, ["_host", "_h"]).groupBy("_row").agg(
        F.count("*").alias("_n"), F.sum("_w").alias("_lost"), F.collect_set("_h").alias("_gone")
    )
    left = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words"))
    made = {
        "n_words": F.col("n_words"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.col("n_dup_lines"), "n_repeat_words": F.col("n_repeat_words"), "base_failed": failed,
        "kept": ~failed & ~depleted, "removed_lines": F.coalesce("_n", F.lit(0)).cast("long"), "left_words": left,
    }
    if keep_text:
        stays = F.filter(
            F.split(F.col(f"_record.{text}"), "\n"),
            lambda x: (F.regexp_replace(x, SPACE, "") == "") | ~F.array_contains(F.coalesce("_gone", F.array().cast("array<bigint>")), F.xxhash64(normalised_line(x))),
        )
        made["clean_text"] = F.array_join(stays, "\n")
    kept = [F.col(f"_record.`{c}`") for c in docs.columns if c not in made]
    return rows.join(lost, "_row", "left").select(*kept, *[v.alias(k) for k, v in made.items()])
