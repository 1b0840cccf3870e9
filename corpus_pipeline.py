"""A training corpus from `documents`: toxicity, near copies, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before, and returns the
columns of documents (the last one adds shard and slot). Toxic documents, all but one document of
each group of near copies, and documents that hold a benchmark window go; the mix takes every
source at least once whole and at most twice, in pieces of documents; the shards hold all pieces.

Null keys, texts and sources, repeated rows and empty tables pass every stage: null and empty texts
are copies of each other and have no words for the mix to take; a null source is one source. Extra
columns pass through whatever their names, but `shard` and `slot` are replaced by the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsift.llm.common import record, shared_dir, table, unpacked
from leadsift.llm.decontaminate import without_contaminated
from leadsift.llm.mixing import Mix
from leadsift.llm.sharding import shuffled_shards
from leadsift.llm.simhash import near_copies
from leadsift.llm.toxicity import toxicity

#: Words of a training sequence.
BLOCK_WORDS = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity(docs.select(record(docs), "doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select("_record.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = near_copies(docs.select(record(docs, without="text"), "doc_id", "text"))
    return judged.where("NOT is_copy").select(*unpacked(docs.columns, text=F.col("text")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = docs.select(record(docs, without="text"), "doc_id", "text", "source")
    mix = Mix(packed, (3, 1, 2), share=1.5, cap=2.0, least=1.0, block_words=BLOCK_WORDS)
    text = F.col("text")
    return mix.pieces().select(*unpacked(docs.columns, text=text, n_chars=F.length(text).cast("long")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shuffled_shards(docs, 40)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Hash functions, a fitted model and a keyed permutation decide the rows: no SQL gives them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
