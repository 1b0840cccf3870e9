"""Running a stream over what is available, into tables that batch queries read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocksdb(spark: SparkSession) -> None:
    """Keyed state with several values and timers is kept by the RocksDB provider alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def into_folder(out: str) -> Callable[[DataFrame, int], None]:
    """A sink with one folder per micro-batch: a repeated batch replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def run_available(
    stream: DataFrame, out: str, checkpoint: str, mode: str = "update", sink: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Run ``stream`` until nothing new is available and return the ended query.

    Rows go to folders under ``out``, or to ``sink``.
    """
    spark = stream.sparkSession
    if sink is None:
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=none")
    query = (
        stream.writeStream.foreachBatch(sink or into_folder(out))
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def emitted(stream: DataFrame, out: str) -> DataFrame:
    """All rows that ``run_available`` has written, over all its batches."""
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/batch=*")


def observed(query: StreamingQuery) -> dict[str, int]:
    """Row counts observed in the streaming plan, added up over the micro-batches of a run."""
    total: dict[str, int] = {}
    for progress in query.recentProgress:
        for name, row in progress.observedMetrics.items():
            total[name] = total.get(name, 0) + row["rows"]
    return total
