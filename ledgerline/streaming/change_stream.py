"""Changes between the periods of each key as they close: sums kept by the stream, each held against the key's last closed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.functions.scalars import moved
from ledgerline.sources.store import _folder

OUTPUT = "key string, day date, total long, previous long, changed boolean"
_LAST = "key string, total long"
_DAY_MS = 86_400_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closed_days(stream: DataFrame, key: str, time_col: str, amount: str, late: str = "1 day") -> DataFrame:
    """(key, day, total) of a stream, one row a key and day as soon as the watermark, `late` behind the newest time, has passed its end.

    Rows of a day that has closed are left out, rows without a key, a time or an amount too. State is one sum for each open day and key, and
    lives in the checkpoint, so a stream that is started again goes on where it stopped. Days are those of UTC.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(time_col).cast("timestamp").alias("time"), F.col(amount).cast("long").alias("amount")).dropna()
    sums = rows.withWatermark("time", late).groupBy("key", F.window("time", "1 day").alias("w")).agg(F.sum("amount").alias("total"))
    return sums.select("key", F.date_from_unix_date(F.floor(F.unix_millis("w.start") / _DAY_MS).cast("int")).alias("day"), "total")


def daily_changes_of_table(rows: DataFrame, key: str, time_col: str, amount: str, tolerance: float = 0.05) -> DataFrame:
    """The same rows of a whole table, all of whose days are closed."""
    day = F.date_from_unix_date(F.floor(F.unix_millis(F.col(time_col).cast("timestamp")) / _DAY_MS).cast("int"))
    sums = rows.select(F.col(key).cast("string").alias("key"), day.alias("day"), F.col(amount).cast("long").alias("amount")).dropna().groupBy("key", "day").agg(F.sum("amount").alias("total"))
    previous = F.lag("total").over(Window.partitionBy("key").orderBy("day"))
    return sums.withColumn("previous", previous).withColumn("changed", moved(F.col("total"), F.col("previous"), tolerance))


def run_changes(spark: SparkSession, source: str, schema: StructType, path: str, checkpoint: str, key: str, time_col: str, amount: str, files: int | None = None, tolerance: float = 0.05, **options) -> DataFrame:
    """Take what files there are below `source` (`files` a batch), add the changes of the days that close to `path`, and read all of them.

    Days close in order. Each is held against the key's day before: one that closes in the same batch, or the last of earlier batches, which a small table
    beside the checkpoint holds. Both are written by the batch's number, so a batch that runs again writes the same files.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)

    def add(batch: DataFrame, number: int) -> None:
        store, target = _folder(spark, f"{checkpoint}/last")
        before = [n for s in (store.listStatus(target) if store.exists(target) else []) if (n := int(s.getPath().getName())) < number]
        last = spark.read.schema(_LAST).parquet(f"{checkpoint}/last/{max(before)}") if before else spark.createDataFrame([], _LAST)
        batch = batch.persist()
        by_key = Window.partitionBy("key").orderBy("day")
        held = batch.withColumn("_lag", F.lag("total").over(by_key)).join(last.withColumnRenamed("total", "_last"), "key", "left")
        rows = held.withColumn("previous", F.coalesce("_lag", "_last")).withColumn("changed", moved(F.col("total"), F.col("previous"), tolerance))
        rows.select("key", "day", "total", "previous", "changed").write.mode("overwrite").parquet(f"{path}/batch={number}")
        newest = batch.groupBy("key").agg(F.max_by("total", "day").alias("_new"))
        last.join(newest, "key", "full").select("key", F.coalesce("_new", "total").alias("total")).write.mode("overwrite").parquet(f"{checkpoint}/last/{number}")
        batch.unpersist()

    query = closed_days(stream, key, time_col, amount, **options).writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(path).drop("batch")
