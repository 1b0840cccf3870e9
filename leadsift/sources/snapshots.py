"""The state table on a shared path: partitioned Parquet of which a batch rewrites what it touches.

Rows lie in buckets by a hash of their fingerprint. A change writes the buckets of its rows and
no other, by Spark's dynamic partition overwrite. Changes that move rows between buckets write a
new generation of the whole table; readers take the newest one that Spark has marked complete.
Every bucket has a row without a fingerprint that names the stream batches merged into it, stored
with the rows by the same write, so a replayed batch is a no-op bucket by bucket.

One writer at a time, as a streaming query and its checkpoint guarantee; readers that must not
see a change halfway run between changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsift.functions.dates import timestamp
from leadsift.operators.state import STATE_COLUMNS, empty_state, fold_sightings, merge_fold
from leadsift.sources.shared import shared_folder

_STORED = ", ".join(f"{c} {t}" for c, t in STATE_COLUMNS.items()) + ", applied map<string,bigint>, bucket int"


class StateTable:
    """State of opportunities under ``path``: read, upsert, update, replace.

    ``buckets`` counts for a new table only; a stored one keeps its own. Choose it so that a
    bucket is a task's worth of rows.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self._new_buckets = spark, path.rstrip("/"), buckets

    def _generations(self) -> list[str]:
        """Folders of complete generations, oldest first."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/gen=*/_SUCCESS")
        found = done.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(done)
        return sorted(f.getPath().getParent().getName() for f in found or [])

    @property
    def buckets(self) -> int:
        """Buckets of the stored table, which its folder names."""
        found = self._generations()
        return int(found[-1].rpartition("-")[2]) if found else self._new_buckets

    def _stored(self) -> DataFrame | None:
        found = self._generations()
        return self.spark.read.schema(_STORED).parquet(f"{self.path}/{found[-1]}") if found else None

    def bucket(self, fingerprint: str = "job_fingerprint") -> Column:
        return F.pmod(F.xxhash64(fingerprint), F.lit(self.buckets)).cast("int").alias("bucket")

    def _headers(self, stored: DataFrame | None, buckets: list[int], tag: dict[str, int]) -> DataFrame:
        """The row without a fingerprint of each of ``buckets``: what was applied, with ``tag`` added."""
        rows = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        if stored is None:
            known = rows.withColumn("_known", F.lit(None).cast("map<string,bigint>"))
        else:
            old = stored.where("job_fingerprint IS NULL").select("bucket", F.col("applied").alias("_known"))
            known = rows.join(F.broadcast(old), "bucket", "left")
        none = F.create_map().cast("map<string,bigint>")
        added = F.create_map(*[F.lit(v) for pair in tag.items() for v in pair]).cast("map<string,bigint>") if tag else none
        kept = F.map_filter(F.coalesce("_known", none), lambda k, _: ~k.isin(*tag) if tag else F.lit(True))
        blank = [F.lit(None).cast(t).alias(c) for c, t in STATE_COLUMNS.items()]
        return known.select(*blank, F.map_concat(kept, added).alias("applied"), "bucket")

    def _write(self, state: DataFrame, headers: DataFrame, folder: str, mode: str) -> None:
        rows = state.select(*STATE_COLUMNS, F.lit(None).cast("map<string,bigint>").alias("applied"), self.bucket())
        (
            rows.unionByName(headers).repartition("bucket")
            .write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(f"{self.path}/{folder}")
        )

    def staged(self, df: DataFrame) -> DataFrame:
        """``df`` written aside: a lost executor never repeats what made it, and its size is known."""
        folder = shared_folder(self.spark, "state")
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    # -- public ------------------------------------------------------------
    def read(self) -> DataFrame:
        """The state; an empty table before the first write."""
        stored = self._stored()
        return empty_state(self.spark) if stored is None else self._rows(stored)

    @staticmethod
    def _rows(stored: DataFrame) -> DataFrame:
        return stored.where("job_fingerprint IS NOT NULL").select(*STATE_COLUMNS)

    def replace(self, state: DataFrame, tag: dict[str, int] | None = None) -> None:
        """Store ``state`` as a new generation; the one before stays for readers that are on it."""
        found, buckets = self._generations(), self.buckets
        number = int(found[-1][4:].partition("-")[0]) + 1 if found else 1
        headers = self._headers(self._stored(), list(range(buckets)), tag or {})
        self._write(state, headers, f"gen={number:010d}-{buckets}", "static")
        for old in found[:-1]:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def upsert(
        self, scored: DataFrame, as_of=None, *, order=("msg_seq", "card_idx"),
        seen_at: str | None = None, stream: str | None = None, batch_id: int | None = None,
    ) -> None:
        """Fold a batch of scored postings into the buckets its fingerprints lie in.

        Buckets that hold the batch already are left alone: a replay, also of a write that was cut
        off between two buckets, counts nothing twice.
        """
        fold = fold_sightings(scored, order, seen_at)
        if seen_at is None:
            now = timestamp(as_of)
            fold = fold.withColumns({"first_at": now, "last_at": now})
        tag = {} if stream is None else {stream: batch_id}
        stored = self._stored()
        if stored is None:
            self.replace(merge_fold(empty_state(self.spark), fold), tag)
            return
        folded = self.staged(fold.withColumn("bucket", self.bucket()))
        touched = {r[0] for r in folded.select("bucket").distinct().collect()}
        if stream is not None:
            done = stored.where(F.col("job_fingerprint").isNull() & (F.try_element_at("applied", F.lit(stream)) >= batch_id))
            touched -= {r[0] for r in done.select("bucket").collect()}
        if touched:
            here = F.col("bucket").isin(*sorted(touched))
            merged = merge_fold(self._rows(stored.where(here)), folded.where(here).drop("bucket"))
            self._write(merged, self._headers(stored, sorted(touched), tag), self._generations()[-1], "dynamic")

    def update(self, change: Callable[[DataFrame], DataFrame], ids: DataFrame) -> None:
        """Apply ``change`` (state -> state) where it changes or drops no row but those of ``ids``.

        It sees and rewrites the buckets of these rows alone. If it moves a row to another
        bucket, it is applied to the whole state instead, which becomes a new generation.
        """
        stored = self._stored()
        if stored is None:
            return
        rows = stored.where("job_fingerprint IS NOT NULL")
        touched = sorted(r[0] for r in rows.join(ids.select("id"), "id", "left_semi").select("bucket").distinct().collect())
        if not touched:
            return
        part = rows.where(F.col("bucket").isin(*touched))
        changed = self.staged(change(part.select(*STATE_COLUMNS)))
        was = part.select(F.col("id"), F.col("bucket").alias("_was"))
        moved = changed.select("id", self.bucket()).join(was, "id").where("bucket <> _was")
        if moved.isEmpty():
            self._write(changed, self._headers(stored, touched, {}), self._generations()[-1], "dynamic")
        else:
            self.replace(self.staged(change(self.read())))
