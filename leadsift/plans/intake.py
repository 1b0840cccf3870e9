"""Composed plans: messages -> ranked postings, and one full maintenance cycle."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leadsift.operators.dedupe import dedupe
from leadsift.operators.extract import extract
from leadsift.operators.relevance import relevant_messages
from leadsift.operators.score import score
from leadsift.rules import DEFAULT_RULES, RulePack


def find_postings(messages: DataFrame, as_of, rules: RulePack = DEFAULT_RULES) -> DataFrame:
    """Filter, extract, de-duplicate and score: one lazy plan with one shuffle."""
    return score(dedupe(extract(relevant_messages(messages, rules), as_of, rules)), rules)


@dataclasses.dataclass(frozen=True)
class Counts:
    """Row counts of a run, filled by whatever action runs the plan."""

    loaded: Observation
    relevant: Observation
    parsed: Observation
    kept: Observation

    def summary(self) -> dict[str, int]:
        loaded, relevant, parsed, kept = (
            o.get["rows"] for o in (self.loaded, self.relevant, self.parsed, self.kept)
        )
        return {
            "loaded": loaded, "filtered_out": loaded - relevant, "parsed": parsed,
            "duplicates": parsed - kept, "stored": kept,
        }


def find_postings_counted(
    messages: DataFrame, as_of, rules: RulePack = DEFAULT_RULES
) -> tuple[DataFrame, Counts]:
    """As ``find_postings``, with step counts observed on the way and no extra pass."""
    counts = Counts(*[Observation() for _ in range(4)])

    def watch(df: DataFrame, observation: Observation) -> DataFrame:
        return df.observe(observation, F.count(F.lit(1)).alias("rows"))

    relevant = watch(relevant_messages(watch(messages, counts.loaded), rules), counts.relevant)
    parsed = watch(extract(relevant, as_of, rules), counts.parsed)
    kept = watch(dedupe(parsed), counts.kept)
    return score(kept, rules), counts
