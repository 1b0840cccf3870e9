"""Two-pass external shuffle into shards whose row counts differ by at most one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadsift.llm.common import utf8_bytes, written


#: Buckets in one group of the running sum.
BUCKET_RUN = 1_024


def _starts(counts: DataFrame) -> DataFrame:
    """(`_bucket`, `_start`): the rows in the buckets before, summed by groups and within each group."""
    grouped = counts.withColumn("_group", F.floor(F.col("_bucket") / BUCKET_RUN))
    groups = grouped.groupBy("_group").agg(F.sum("_n").alias("_in_group"))
    before = groups.select("_group", (F.sum("_in_group").over(Window.orderBy("_group")) - F.col("_in_group")).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("_group").orderBy("_bucket")) - F.col("_n")
    return grouped.withColumn("_inside", inside).join(before, "_group").select("_bucket", (F.col("_before") + F.col("_inside")).alias("_start"))


def shuffled_shards(
    docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows and columns of `docs`, plus `shard` (int) and `slot` (long, gapless from 0 in each shard).

    Pass one scatters each row by a seeded hash of its key and place in the input into one of as
    many buckets as keep a bucket near `bucket_bytes`, and writes the scattered rows to the shared
    folder, so that a repeated task reads the same assignment. Pass two brings one bucket at a time
    together, shuffles it (the built-in array shuffle is a seeded Fisher-Yates), and lays the
    buckets end to end; the shards are equal cuts of that order, the first ones a row longer.

    Nulls and empty texts count as rows like any other; repeated rows scatter independently, since
    the place in the input enters the hash; an empty table gives an empty result. Input columns
    named `shard` or `slot` are replaced.
    """
    kept = docs.drop("shard", "slot")
    size = utf8_bytes(text) + 16
    total = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    rows, buckets = total["n"], shards * max(1, -(-total["b"] // (shards * bucket_bytes)))
    scatter = F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id())
    record = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    scattered = written(
        kept.select(record.alias("_record"), scatter.alias("_at")).withColumn("_bucket", F.pmod("_at", F.lit(buckets))),
        "scattered",
    )
    starts = _starts(scattered.groupBy("_bucket").agg(F.count("*").alias("_n")))
    # As many tasks as buckets, whatever the session's default, so a task holds a bucket or a few.
    # Sorted before collecting, so that a bucket's order does not depend on how its blocks arrive.
    bucketed = (
        scattered.repartition(buckets, "_bucket")
        .sortWithinPartitions("_bucket", "_at")
        .groupBy("_bucket")
        .agg(F.shuffle(F.collect_list("_record"), seed).alias("_records"))
    )
    placed = bucketed.join(starts, "_bucket").select("_start", F.posexplode("_records").alias("_pos", "_record"))
    at, long_rows = F.col("_start") + F.col("_pos"), rows % shards
    each = rows // shards
    head = long_rows * (each + 1)
    in_head = at < head
    tail = at - head
    shard = F.when(in_head, F.floor(at / (each + 1))).otherwise(long_rows + F.floor(tail / max(each, 1)))
    slot = F.when(in_head, at % (each + 1)).otherwise(tail % max(each, 1))
    return placed.select("_record.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
