"""Status commands such as ``/applied 123``: parse, apply, reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsift.functions.text import lit_map, strip
from leadsift.operators.state import set_status
from leadsift.rules import COMMAND_STATUSES

COMMAND = r"(?U)^/(\w+)(?:@\w+)?\s+([0-9]+)\s*$"
HELP = (
    "Unknown command. Use /applied <job_id>, /reviewed <job_id>, "
    "/skipped <job_id>, or /followup <job_id>."
)


def command_status(text: Column) -> Column:
    """Status a command asks for; NULL when the text is no status command."""
    return F.try_element_at(
        lit_map(COMMAND_STATUSES), F.lower(F.regexp_extract(strip(text), COMMAND, 1))
    )


def command_target(text: Column) -> Column:
    """Digits of the addressed row."""
    return F.regexp_extract(strip(text), COMMAND, 2)


def parse_commands(updates: DataFrame, chat_id: str | None = None) -> DataFrame:
    """(update_id, chat_id, text) -> slash texts with status and id; other chats drop out."""
    mine = updates if chat_id is None else updates.filter(F.col("chat_id") == chat_id)
    text = F.col("text")
    return (
        mine.filter(strip(text).startswith("/"))
        .select(
            "update_id", "chat_id", "text",
            command_status(text).alias("status"), command_target(text).alias("target"),
        )
        .withColumn("id", F.when(F.col("status").isNotNull(), F.col("target").try_cast("bigint")))
    )


def command_replies(state: DataFrame, commands: DataFrame) -> DataFrame:
    """One reply per command: done, no such row, or help."""
    rows = state.select("id", F.col("company").alias("_company"), F.col("title").alias("_title"))
    said = (
        F.when(F.col("status").isNull(), F.lit(HELP))
        .when(F.col("_title").isNull(), F.concat(F.lit("No job found with id "), F.col("target"), F.lit(".")))
        .otherwise(
            F.concat(
                F.lit("Updated #"), F.col("id").cast("string"), F.lit(" to "), F.col("status"), F.lit(": "),
                F.col("_company"), F.lit(" - "), F.col("_title"),
            )
        )
    )
    # Help texts have no id and stay out of the join.
    found = commands.filter("id IS NOT NULL").join(rows, "id", "left")
    joined = found.unionByName(commands.filter("id IS NULL"), allowMissingColumns=True)
    return joined.select("update_id", "chat_id", said.alias("reply"))


def apply_commands(state: DataFrame, commands: DataFrame, as_of) -> DataFrame:
    """State after all commands, the last one per row winning."""
    return set_status(state, commands.filter("id IS NOT NULL"), as_of)


def next_offset(updates: DataFrame) -> DataFrame:
    """Offset after a feed, ignored updates included."""
    return updates.agg((F.max("update_id") + 1).alias("next_offset"))
