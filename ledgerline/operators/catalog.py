"""Listings and small series operators: corpus counts, modes with a tie rule, eviction, scaling and down-sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listing(chunks: DataFrame, keys: Sequence[str] = ("ticker", "document_type", "filing_year")) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"))


def ledger(rows: DataFrame, group: str, member: str, weight: str) -> DataFrame:
    """One row a group: its members in falling order as text, their number and the total weight."""
    return rows.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set(F.col(member).cast("string")), asc=False), ",").alias("members"), F.countDistinct(member).alias("n_members"), F.sum(weight).alias("total"))


def summary_text(listed: DataFrame, label: Column, none: str = "The corpus is empty.") -> DataFrame:
    """One row: all labels, sorted and joined; a sentence if there are none."""
    text = F.array_join(F.array_sort(F.collect_list(label)), "; ")
    return listed.agg(F.when(F.count("*") > 0, text).otherwise(none).alias("summary"))


def mode_first(rows: DataFrame, keys: Sequence[str], label: str, pos: str) -> DataFrame:
    """The most frequent label that is not blank; of equals the one seen first."""
    named = rows.withColumn("_l", F.trim(label)).where("_l <> ''")
    counts = named.groupBy(*keys, "_l").agg(F.count("*").alias("n"), F.min(pos).alias("_p"))
    return counts.groupBy(*keys).agg(F.max_by("_l", F.struct("n", -F.col("_p").cast("long"))).alias(label), F.max("n").alias("n"))


def evict(tasks: DataFrame, cap: int = 200) -> DataFrame:
    """The tasks that stay when a new one comes in: the oldest finished go until fewer than `cap` are left; running ones never go."""
    finished = F.coalesce(F.col("state").isin("completed", "failed"), F.lit(False))
    # Of the finished ones at most cap - 1 stay, the newest, so each task hands on no more than these.
    room = tasks.agg((F.lit(cap - 1) - F.count_if(~finished)).alias("_room"))
    newest = tasks.where(finished).withColumn("_n", F.row_number().over(Window.orderBy(F.desc("updated_at"), F.desc("task_id")))).where(F.col("_n") <= cap - 1)
    return tasks.where(~finished).unionByName(newest.join(F.broadcast(room), F.lit(True)).where("_n <= _room").drop("_n", "_room"))


def scale_unit(rows: DataFrame, keys: Sequence[str], value: str, out: str = "scaled") -> DataFrame:
    """Values of each key scaled to [0, 1]; constant series are zero."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn(out, (F.col(value) - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0)))


def downsample(rows: DataFrame, keys: Sequence[str], order: str, value: str, points: int) -> DataFrame:
    """At most `points` values of each series at even places, the last of them the last value; NaN values are left out."""
    series = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_s"))
    n = F.size("_s")
    place = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.when(i == points - 1, n - 1).otherwise(F.least(F.floor(i * n / points).cast("int"), n - 1)))
    at = F.when(n > points, place).otherwise(F.sequence(F.lit(0), n - 1))
    return series.withColumn("_at", at).select(*keys, F.posexplode(F.transform("_at", lambda i: F.col("_s")[i])).alias("pos", "x")).select(*keys, "pos", F.col("x.o").alias(order), F.col("x.v").alias(value))


def chart_series(specs: DataFrame, spec: str) -> DataFrame:
    """(type, series) of chart specifications in JSON: the series named, else the keys of the rows but for the name, as first seen."""
    parsed = F.from_json(spec, "type string, series array<string>, data array<map<string,string>>")
    keys = F.filter(F.array_distinct(F.flatten(F.transform(parsed["data"], F.map_keys))), lambda k: k != "name")
    named = F.filter(parsed["series"], lambda s: s.isNotNull())
    return specs.withColumn("chart_type", F.coalesce(parsed["type"], F.lit("bar"))).withColumn("series_names", F.when(F.size(named) > 0, named).otherwise(keys))


def latest_stage(events: DataFrame, key: str, stage: str, at: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(stage, at).alias(stage), F.max(at).alias(at))
