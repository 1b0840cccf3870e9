"""Text-file messages: ``From:`` and ``Subject:`` lines, a blank line, the body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsift.functions.text import EOL, lines, strip

HEADER_LINES = 10
MESSAGE_SCHEMA = (
    "source_id STRING, msg_seq STRING, subject STRING, sender STRING, "
    "received_at TIMESTAMP, body STRING"
)


def header_value(all_lines: Column, name: str) -> Column:
    """Value of ``name:`` within the first ten lines; NULL when absent or blank."""
    head = F.filter(F.slice(all_lines, 1, HEADER_LINES), lambda x: x.startswith(name + ":"))
    value = F.substring(F.get(head, F.lit(0)), len(name) + 2, 2**31 - 1)
    return F.nullif(strip(value), F.lit(""))


def message_body(all_lines: Column) -> Column:
    """Lines after the first blank one; the whole text when there is none."""
    start = F.array_position(F.transform(all_lines, lambda x: strip(x) == ""), F.lit(True))
    return strip(F.array_join(F.slice(all_lines, start.cast("int") + 1, F.size(all_lines) + 1), "\n"))


def parse_message_text(df: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """(file name, whole text) rows -> messages ordered by file name."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    # A final line end closes the last line; it does not open an empty one.
    closed = F.regexp_replace(F.col(text), rf"(?:{EOL})\z", "")
    split = df.select(F.col(name), stem.alias("stem"), lines(closed).alias("parts"))
    parts = F.col("parts")
    return split.select(
        F.col("stem").alias("source_id"),
        F.col(name).alias("msg_seq"),
        F.coalesce(header_value(parts, "Subject"), F.col("stem")).alias("subject"),
        F.coalesce(header_value(parts, "From"), F.lit("Unknown")).alias("sender"),
        F.lit(None).cast("timestamp").alias("received_at"),
        message_body(parts).alias("body"),
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_message_files(spark: SparkSession, directory: str) -> DataFrame:
    """Messages of all ``*.txt`` files; a missing directory is an empty inbox.

    ``msg_seq`` is the file name itself: it sorts like the list order and needs
    no global numbering.
    """
    if not path_exists(spark, directory):
        return spark.createDataFrame([], MESSAGE_SCHEMA)
    raw = spark.read.text(directory, wholetext=True, pathGlobFilter="*.txt")
    return parse_message_text(
        raw.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    )
