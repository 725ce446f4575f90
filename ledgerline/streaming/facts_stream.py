"""Continuous ingest: each micro-batch of facts is merged into the stored ones, newest filing first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.facts import FACT_KEY, newest_wins
from ledgerline.sources.store import Store


def merge_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = FACT_KEY, date_col: str = "filing_date", partition_col: str = "ticker", once: bool = True) -> StreamingQuery:
    """Merge a stream of facts into the store at `path`; readers see each micro-batch whole or not at all.

    A micro-batch replaces the rows of the `partition_col` values that occur in it by their merge with what is stored. Its number is
    published with it, so a batch that runs again after a failure changes nothing.
    """
    store = Store(stream.sparkSession, path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("_new", F.lit(1)).withColumn("_seq", F.monotonically_increasing_id())
        stored = store.read()
        if stored is not None:
            old = stored.join(batch.select(partition_col).distinct(), partition_col, "left_semi")
            fresh = fresh.unionByName(old.withColumn("_new", F.lit(0)).withColumn("_seq", F.lit(0).cast("long")), allowMissingColumns=True)
        store.replace(newest_wins(fresh, keys, date_col, F.desc("_new"), F.desc("_seq")).drop("_new", "_seq"), [partition_col], (checkpoint, batch_id))

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/log")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time_col: str, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and key, for streams with a watermark and for tables alike."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
