"""Where a stream keeps its checkpoint and its batches' rows.

With a store (a folder that all executors see) and a name, a job that is started again goes on where it stopped: the checkpoint knows which
files were read and holds the state of its operators, and rows of earlier runs stay. Without one, a job has fresh folders and sees all
that is there now. A batch that is run again after a failure replaces its own folder, so no row is written twice. An empty stream
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, ship


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], name: str, schema: str, store: str | None = None, mode: str = "append") -> DataFrame:
    """work's rows of all batches so far, with the number of their batch as `round`; schema has no column of that name."""
    spark = ship(stream.sparkSession)
    base = f"{store.rstrip('/')}/{name}" if store else fresh_path(spark, name)
    out = f"{base}/rows"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/round=-1")  # so that no rows at all read as none

    def keep(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/round={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{schema}, round long").parquet(out)


def newest(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows with the same key those of the latest batch, without `round`: what an operator in update mode stands at."""
    rest = [c for c in rows.columns if c not in (*key, "round")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "round").alias("_last"))
    return last.select(*key, *(F.col("_last")[c].alias(c) for c in rest))
