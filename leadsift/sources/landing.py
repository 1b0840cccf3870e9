"""Landing tables: chat commands and search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

UPDATE_SCHEMA = (
    "update_id BIGINT, message STRUCT<chat: STRUCT<id: STRING>, text: STRING>"
)
# Where four search services keep their hits (list path, url, snippet).
HIT_SHAPES = {
    "serper": ("organic", "link", "snippet"),
    "serpapi": ("organic_results", "link", "snippet"),
    "brave": ("web.results", "url", "description"),
    "google": ("items", "link", "snippet"),
}


def flatten_updates(updates: DataFrame) -> DataFrame:
    """Update records -> update_id, chat_id, text; records without text stay for offsets."""
    return updates.select(
        "update_id", F.col("message.chat.id").alias("chat_id"), F.col("message.text").alias("text")
    )


def read_updates(spark: SparkSession, directory: str) -> DataFrame:
    return flatten_updates(spark.read.schema(UPDATE_SCHEMA).json(directory))


def stream_updates(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    """Command feed as a stream; the checkpoint keeps the offset."""
    reader: DataStreamReader = spark.readStream.schema(UPDATE_SCHEMA)
    return flatten_updates(reader.option("maxFilesPerTrigger", max_files).json(directory))


def _hit_shape(url: str, snippet: str):
    return lambda h: F.struct(
        h[url].alias("url"),
        F.coalesce(h["title"], F.lit("")).alias("title"),
        F.coalesce(h[snippet], F.lit("")).alias("snippet"),
    )


def parse_hits(payloads: DataFrame) -> DataFrame:
    """(opportunity_key, query_idx, provider, provider_rank, payload) -> one row per hit.

    Each provider's shape is read with its own schema in a single pass over the
    payloads; hits without URL are dropped, broken payloads give no hits.
    """
    arrays = None
    for provider, (path, url, snippet) in HIT_SHAPES.items():
        item = f"ARRAY<STRUCT<{url}: STRING, title: STRING, {snippet}: STRING>>"
        *outer, last = path.split(".")
        schema = f"STRUCT<{last}: {item}>"
        for name in reversed(outer):
            schema = f"STRUCT<{name}: {schema}>"
        found = F.from_json(F.col("payload"), schema)
        for name in path.split("."):
            found = found[name]
        same = F.transform(found, _hit_shape(url, snippet))
        case = F.col("provider") == provider
        arrays = F.when(case, same) if arrays is None else arrays.when(case, same)
    return payloads.select(
        "opportunity_key", "query_idx", "provider_rank",
        F.posexplode(arrays).alias("result_idx", "hit"),
    ).select(
        "opportunity_key", "query_idx", "provider_rank", "result_idx", "hit.url", "hit.title", "hit.snippet"
    ).filter("coalesce(url, '') <> ''")
