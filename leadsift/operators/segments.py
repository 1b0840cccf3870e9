"""Size-bounded message segments of any text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsift.functions.text import rstrip

MESSAGE_LIMIT, SAFE_LIMIT = 4096, 3800
_END = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def split_segments(text: Column, limit: int = MESSAGE_LIMIT, safe: int = SAFE_LIMIT) -> Column:
    """Whole text when it fits, else whole lines packed up to ``safe`` characters.

    Longer lines are cut hard. One fold over the lines: the open segment never
    grows past ``safe``, so the work is linear in the text.
    """
    none = F.array().cast("array<string>")
    kept_ends = F.regexp_extract_all(text, F.lit(rf"[^{_END}]*(?:\r\n|[{_END}])|[^{_END}]+"), F.lit(0))

    def pieces(line: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(line), F.lit(safe))
        return F.transform(starts, lambda i: rstrip(F.substring(line, i, F.lit(safe))))

    def step(acc: Column, line: Column) -> Column:
        open_text, done = acc["open"], acc["done"]
        flushed = F.concat(done, F.array(rstrip(open_text)))
        long = F.length(line) > safe
        full = F.length(open_text) + F.length(line) > safe
        return F.struct(
            F.when(long, F.lit("")).when(full, line).otherwise(F.concat(open_text, line)).alias("open"),
            F.when(long & (open_text == ""), F.concat(done, pieces(line)))
            .when(long, F.concat(flushed, pieces(line)))
            .when(full, flushed)
            .otherwise(done)
            .alias("done"),
        )

    packed = F.aggregate(
        kept_ends,
        F.struct(F.lit("").alias("open"), none.alias("done")),
        step,
        lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(
            F.concat(acc["done"], F.array(rstrip(acc["open"])))
        ),
    )
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)


def segment_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, segment_no, segment) outbox rows of a text table."""
    return df.select(*keys, F.posexplode(split_segments(F.col(text))).alias("segment_no", "segment"))
