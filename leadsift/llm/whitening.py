"""Whitening of embeddings: blockwise QR on Spark, a bidiagonal solver for the triangle that is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from leadsift.llm.bidiagonal import leading_directions
from leadsift.llm.common import written

#: Entries are counted in steps of one part in this many.
STEPS = 256
#: Triangles that one task puts on top of each other.
FAN = 8
#: Rows of one block of the QR.
BLOCK_ROWS = 8192
FIELDS = [
    T.StructField("component", T.IntegerType()),
    T.StructField("n", T.LongType()),
    T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.DoubleType()),
    T.StructField("explained", T.DoubleType()),
    T.StructField("identity_error", T.DoubleType()),
]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _triangle(blocks: list[np.ndarray], width: int) -> np.ndarray:
    """The d x d factor R of the rows put on top of each other."""
    stacked = np.vstack([np.zeros((0, width)), *blocks])
    r = np.linalg.qr(stacked, mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def _summed(parts: DataFrame) -> dict[int, float | int]:
    """Sums of `value` by `place`: one row for each place reaches the driver."""
    return {r["place"]: r["value"] for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect()}


def _column_sums(fit: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += _matrix(batch.column(0), width).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"place": np.arange(width, dtype=np.int32), "value": total})

    found = _summed(fit.mapInArrow(run, "place int, value long"))
    return np.array([found.get(i, 0) for i in range(width)], np.int64)


def stacked_triangle(fit: DataFrame, centre: np.ndarray) -> np.ndarray:
    """R of the centred rows: one QR for each partition, then of `FAN` triangles at a time.

    Every level is written, so that a lost executor repeats one level at most; one triangle,
    whose size depends on the width alone, reaches the driver.
    """
    width = len(centre)
    schema = "part long, r binary"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = np.zeros((0, width)), None
        for batch in batches:
            part = batch.column(1)[0].as_py() if len(batch) and part is None else part
            for at in range(0, len(batch), BLOCK_ROWS):
                block = _matrix(batch.column(0).slice(at, BLOCK_ROWS), width) - centre
                r = _triangle([r, block], width)
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "r": [r.tobytes()]}, schema=pa.schema([("part", pa.int64()), ("r", pa.binary())]))

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks = [np.frombuffer(b).reshape(width, width) for b in rows.sort_values("part")["r"]]
        return pd.DataFrame({"part": [key[0]], "r": [_triangle(blocks, width).tobytes()]})

    level = written(
        fit.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(local, schema), "whitening-triangles"
    )
    last = level.agg(F.max("part")).first()[0]
    while last is not None and last > 0:
        last //= FAN
        level = written(level.groupBy(F.floor(F.col("part") / FAN).alias("part_")).applyInPandas(merged, schema), "whitening-triangles")
    top = level.first()
    return np.zeros((width, width)) if top is None else np.frombuffer(top["r"]).reshape(width, width)


def _identity_error(fit: DataFrame, n: int, centre: np.ndarray, project: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    width, count = project.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count))
        for batch in batches:
            z = (_matrix(batch.column(0), width) - centre) @ project
            total[:count] += z.T @ z
            total[count] += z.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"place": np.arange(total.size, dtype=np.int32), "value": total.ravel()})

    found = _summed(fit.mapInArrow(run, "place int, value double"))
    total = np.array([found[i] for i in range((count + 1) * count)]).reshape(count + 1, count) / n
    return float(np.abs(total[:count] - np.outer(total[count], total[count]) - np.eye(count)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n * x - S)^2 for each row, exact; null where a long does not hold it."""
    most = float(np.abs(x).max(initial=0)) * n + float(np.abs(sums).max(initial=0))
    if x.shape[1] * most * most < 2.0**62:
        return np.square(n * x - sums).sum(axis=1).tolist()
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whitening(vectors: DataFrame, components: int = 4, vector: str = "embedding") -> DataFrame:
    """A row for each usable vector and leading component: `component`, `n`, `deviation`, `whitened`,
    `explained`, `identity_error`.

    Entries become x = floor(256 * entry). The fit takes each distinct x once: n of them, with
    sums S. The centred rows go through QR block by block and triangle by triangle; the last
    triangle R is made bidiagonal by reflections, dqds finds its singular values and twisted
    factorisations the right vectors, which are the eigenvectors of the covariance. Everything of
    the size of the data stays in tasks; the driver gets S, one R and sums of products.

    Null vectors and vectors with null or non-finite entries are dropped; of vectors of several
    lengths only the longest have a common covariance, the others are dropped as well. Repeated
    rows are fitted once and each returned. Components without variance cannot be whitened and
    are left out, so a single distinct vector gives no rows, like an empty table. `deviation` is
    null where it exceeds a long. Other columns pass through, those named like results are
    replaced; null keys stay.
    """
    names = [f.name for f in FIELDS]
    keep = [c for c in vectors.columns if c != vector and c.lower() not in names]
    entries = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & F.forall(entries, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    x = F.transform(entries, lambda c: F.floor(STEPS * c).cast("long"))
    # A null entry would not survive the floor, and filters may run in any order: null it as a whole.
    numbered = [f"c{i}" for i in range(len(keep))]
    rows = vectors.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, numbered, strict=True)], F.when(usable, x).alias("_x")).where("_x IS NOT NULL")
    rows = written(rows, "whitening-rows")
    width = rows.agg(F.max(F.size("_x"))).first()[0] or 0
    rows = rows.where(F.size("_x") == width)
    fit = written(rows.select("_x").distinct(), "whitening-fit")
    n = fit.count() if width else 0
    schema = T.StructType([vectors.schema[c] for c in keep] + FIELDS)
    if n == 0:
        return rows.sparkSession.createDataFrame([], schema)
    sums = _column_sums(fit, width)
    centre = sums / n
    values, directions = leading_directions(stacked_triangle(fit, centre), components)
    count = directions.shape[1]
    if count == 0:
        return rows.sparkSession.createDataFrame([], schema)
    project = directions / np.sqrt(values[:count] / n)
    explained = values[:count] / values.sum()
    error = _identity_error(fit, n, centre, project)
    types = [to_arrow_type(f.dataType) for f in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch.column(len(keep)), width)
            z = (found - centre) @ project
            each = pa.array(np.repeat(np.arange(len(found)), count))
            made = [
                np.tile(np.arange(1, count + 1), len(found)), np.full(z.size, n),
                [v for v in _deviations(found, n, sums) for _ in range(count)],
                z.ravel(), np.tile(explained, len(found)), np.full(z.size, error),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(c.take(each) for c in batch.columns[: len(keep)]), *(pa.array(v, t) for v, t in zip(made, types, strict=True))],
                names=[*numbered, *names],
            )

    between = T.StructType([T.StructField(i, vectors.schema[c].dataType) for c, i in zip(keep, numbered, strict=True)] + FIELDS)
    return rows.mapInArrow(run, between).toDF(*keep, *names)
