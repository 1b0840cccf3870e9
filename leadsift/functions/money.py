"""Salary text: highest figure, estimate and label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsift.functions.text import WS, let


def max_salary(text: Column) -> Column:
    """Highest figure in a salary text; figures under 1000 count as thousands."""

    def annual(raw: Column) -> Column:
        return let(
            F.coalesce(F.replace(raw, F.lit(","), F.lit("")).try_cast("bigint"), F.lit(2**63 - 1)),
            lambda v: F.when(v < 1000, v * 1000).otherwise(v),
        )

    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit("[0-9][0-9,]*"), F.lit(0)), annual))


def salary_figures(text: Column) -> Column:
    """Annual figures in text order; decimals and a 'k' suffix are understood."""

    def annual(raw: Column) -> Column:
        return let(
            F.regexp_replace(raw, r"[^0-9.]", "").try_cast("double"),
            lambda v: F.bround(
                F.when((v < 1000) | F.lower(raw).endswith("k"), v * 1000).otherwise(v)
            ).try_cast("bigint"),
        )

    found = F.regexp_extract_all(text, F.lit(rf"[0-9][0-9,]*(?:\.[0-9]+)?{WS}*[kK]?"), F.lit(0))
    return F.array_compact(F.transform(found, annual))


def estimate_salary(text: Column) -> Column:
    """Single figure as is, otherwise the half-even rounded middle of the range."""
    return let(
        salary_figures(text),
        lambda v: F.when(
            F.size(v) > 0,
            F.bround((F.array_min(v).cast("double") + F.array_max(v)) / 2).try_cast("bigint"),
        ),
    )


def salary_label(estimate: Column, missing: str = "Unknown") -> Column:
    """'CA$215k' style label."""
    thousands = F.bround(estimate.cast("double") / 1000).cast("bigint").cast("string")
    return F.coalesce(F.concat(F.lit("CA$"), thousands, F.lit("k")), F.lit(missing))
