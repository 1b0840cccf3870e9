"""Identity keys and first-copy-wins de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsift.functions.names import normalize_company, normalize_title
from leadsift.functions.text import column_cache, squeeze

IDENTITY = ("company", "title", "location", "job_link")


def identity_key(*columns: str) -> list[Column]:
    """Case- and space-blind key columns; NULL counts as ''."""
    return [squeeze(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in columns or IDENTITY]


@column_cache
def fingerprint() -> Column:
    """sha-256 over the identity of the normalised posting."""
    named = [
        normalize_company(F.col("company")),
        normalize_title(F.col("title")),
        F.coalesce(F.col("location"), F.lit("")),
        F.coalesce(F.col("job_link"), F.lit("")),
    ]
    return F.sha2(F.concat_ws("|", *[squeeze(F.lower(c)) for c in named]), 256)


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given order.

    Planned as a row-number filter: Spark cuts each map partition to one row per
    key before the shuffle, so a key that holds most rows stays cheap.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    first = Window.partitionBy(*names).orderBy(*order)
    return (
        keyed.withColumn("_row", F.row_number().over(first)).filter("_row = 1").drop("_row", *names)
    )


def dedupe(postings: DataFrame, order: Sequence[str] = ("msg_seq", "card_idx")) -> DataFrame:
    """First copy of every posting in message and card order."""
    return keep_first(postings, identity_key(), order)
