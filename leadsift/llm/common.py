"""What several operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from leadsift.sources.shared import shared_base as shared_dir

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts the lineage, survives executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8_bytes(text: str | Column = "text") -> Column:
    """UTF-8 length of the text, 0 for null."""
    return F.coalesce(F.octet_length(F.col(text) if isinstance(text, str) else text), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def record(docs: DataFrame, without: str | None = None) -> Column:
    """All columns of `docs` but `without` as one struct `_record`, out of the way of an operator's names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != without]).alias("_record")


def unpacked(columns: list[str], **given: Column) -> list[Column]:
    """The named columns of `_record` again, those in `given` from there."""
    return [given[c].alias(c) if c in given else F.col(f"_record.`{c}`") for c in columns]


def with_results(
    docs: DataFrame,
    text: str,
    fields: list[T.StructField],
    fn: Callable[..., list[list]],
    drop_text: bool = False,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Append columns that `fn` makes from the texts of one Arrow batch (null: empty text).

    The columns `also` are handed to `fn` as further lists.

    Other columns pass through untouched; one named like a result is replaced by it.
    """
    made = {f.name.lower() for f in fields}
    keep = [c for c in docs.columns if c.lower() not in made and not (drop_text and c == text)]
    schema = T.StructType([docs.schema[c] for c in keep] + fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [*keep, *(f.name for f in fields)]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text_in"), *also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            more = [c.to_pylist() for c in batch.columns[len(keep) + 1 :]]
            made_columns = [pa.array(v, t) for v, t in zip(fn(texts, *more), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made_columns], names=names)

    return source.mapInArrow(run, schema)
