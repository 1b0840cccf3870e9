"""Mailbox dumps: raw RFC 822 messages to message rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadsift.functions import mime
from leadsift.operators.dedupe import keep_first
from leadsift.operators.relevance import is_relevant
from leadsift.rules import DEFAULT_RULES, RulePack

_UID_SPAN = 2**32


def read_mailbox_files(spark: SparkSession, directory: str) -> DataFrame:
    """``<directory>/<mailbox>/<uid>.eml`` -> mailbox, uid, raw."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.eml").load(directory)
    path = F.split(F.col("path"), "/")
    return files.select(
        F.element_at(path, -2).alias("mailbox"),
        F.regexp_extract(F.element_at(path, -1), r"^([0-9]+)", 1).try_cast("bigint").alias("uid"),
        F.col("content").alias("raw"),
    )


def newest_per_mailbox(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest messages of every mailbox, cut down before the shuffle; all without a limit."""
    if limit is None:
        return raw
    newest = Window.partitionBy("mailbox").orderBy(F.desc("uid"))
    return raw.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit).drop("_n")


def mailbox_rank(labels: Sequence[str], main: str = "INBOX") -> Column:
    """Scan order: labels first, then the main mailbox; NULL when not scanned."""
    order = list(dict.fromkeys(m for m in [*labels, main] if m))
    return F.coalesce(*[F.when(F.col("mailbox") == name, F.lit(i)) for i, name in enumerate(order)])


def decode_messages(raw: DataFrame) -> DataFrame:
    """Headers and leaf parts of raw messages by column functions (``functions.mime``).

    Parts keep their order; the body is chosen by ``choose_body``. NULL bytes are an empty
    message, an unreadable date is NULL, parts that are no text and texts in an unknown
    charset are ''. Headers are decoded before the parts: a filter on headers comes first.
    """
    heads = raw.select("mailbox", "uid", mime.raw_text(F.col("raw")).alias("_text")).select(
        "*", mime.split_head(F.col("_text"))["head"].alias("_head")
    )

    def decoded(name: str) -> Column:
        return mime.decode_pieces(F.col(name))

    named = heads.select(
        "mailbox", "uid", "_text",
        F.trim(mime.header(F.col("_head"), "message-id")).alias("message_id"),
        mime.header_pieces(mime.header(F.col("_head"), "subject")).alias("_subject"),
        mime.header_pieces(mime.header(F.col("_head"), "from")).alias("_sender"),
        mime.message_date(mime.header(F.col("_head"), "date")).alias("received_at"),
        mime.content_type(F.col("_head")).rlike("^(?:multipart/|message/rfc822$)").alias("multipart"),
    ).select(
        "mailbox", "uid", "_text", "message_id",
        F.array_join(decoded("_subject"), "").alias("subject"),
        F.array_join(decoded("_sender"), "").alias("sender"),
        "received_at", "multipart",
    )
    parts = named.withColumn("_parts", mime.part_pieces(mime.leaf_texts(F.col("_text"))))
    pieces = F.transform("_parts", lambda p: F.struct(p["data"].alias("data"), p["charset"].alias("charset")))
    return parts.withColumn("_pieces", pieces).select(
        "mailbox", "uid", "message_id", "subject", "sender", "received_at", "multipart",
        F.zip_with(
            "_parts", decoded("_pieces"), lambda p, text: F.struct(p["type"].alias("type"), text.alias("content"))
        ).alias("parts"),
    )


def choose_body() -> Column:
    """First plain-text part, else first HTML part, else ''; single parts as they are."""

    def first(kind: str) -> Column:
        return F.get(F.filter("parts", lambda p: p["type"] == kind), F.lit(0))["content"]

    return F.when(
        F.col("multipart"), F.coalesce(first("text/plain"), first("text/html"), F.lit(""))
    ).otherwise(F.coalesce(F.get("parts", F.lit(0))["content"], F.lit("")))


def to_messages(decoded: DataFrame, rank: Column) -> DataFrame:
    """Decoded mail -> messages; one copy per message id, first in scan order.

    ``msg_seq`` packs mailbox rank and reversed 32-bit uid: newest first inside a
    mailbox, without a global numbering.
    """
    source_id = F.when(
        F.col("message_id") != "", F.concat(F.lit("mail:"), F.col("message_id"))
    ).otherwise(F.concat_ws(":", F.lit("mail"), "mailbox", F.col("uid").cast("string")))
    rows = decoded.withColumn("_rank", rank).filter("_rank IS NOT NULL").select(
        source_id.alias("source_id"),
        (F.col("_rank") * _UID_SPAN + (_UID_SPAN - 1 - F.col("uid"))).alias("msg_seq"),
        "subject", "sender", "received_at", choose_body().alias("body"),
    )
    return keep_first(rows, [F.col("source_id")], ["msg_seq"])


def load_mailboxes(
    raw: DataFrame, labels: Sequence[str] = (), main: str = "INBOX", limit: int | None = None,
    rules: RulePack = DEFAULT_RULES,
) -> DataFrame:
    """Messages (the newest `limit` of each mailbox) whose headers look relevant, de-duplicated."""
    rank = mailbox_rank(labels, main)
    decoded = decode_messages(newest_per_mailbox(raw.filter(rank.isNotNull()), limit))
    kept = decoded.filter(is_relevant(rules, body="''"))
    return to_messages(kept, rank)
