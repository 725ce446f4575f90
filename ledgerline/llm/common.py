"""Helpers shared by the corpus operators: scratch tables, package shipping, shard bounds."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Applications whose workers have the package.
_SHIPPED: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one is made only for local masters."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _folder(spark: SparkSession, path: str):
    """(file system, path) as Hadoop sees them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is there when the driver ends goes with it."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    store, target = _folder(spark, path)
    store.deleteOnExit(target)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        store, target = _folder(t.sparkSession, t.scratch_path)
        store.delete(target, True)


#: Bytes of an Arrow batch unless the session sets a number: documents may be long, and a worker holds a whole batch.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = "67108864b"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not share the driver's path, and bound their batches by bytes.

    The bound is read when a query runs, so it stays set for the session; a session's own number is left alone.
    """
    if spark.conf.get(_BATCH_CONF, None) in (None, _BATCH_DEFAULT):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(), "ledgerline_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


#: Bytes of texts that a task encodes together, so that each distinct word is computed once for many of them.
GROUP_BYTES = 2 << 20


def text_groups(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Slices of the batches with a column of text in bytes as strings, of about GROUP_BYTES each or one longer text.

    Bytes that are no UTF-8 count as replacement characters.
    """
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // GROUP_BYTES
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for start, stop in zip(edges, edges[1:]):
            if stop > start:
                part = b.slice(start, stop - start)
                try:
                    texts = part.column(column).cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in part.column(column).to_pylist()], pa.string())
                yield part, texts


def string_bytes(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, size) of strings that stand one after the other."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(strings.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(strings) else np.zeros(0, dtype=np.uint8)
    return raw, offsets[:-1] - offsets[:1], np.diff(offsets)


def gather(values: np.ndarray, counts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values picked by number: (values, counts) of the runs in `index`, one after the other."""
    begins = np.cumsum(counts) - counts
    picked = counts[index]
    ends = np.cumsum(picked)
    return values[np.repeat(begins[index] - ends + picked, picked) + np.arange(ends[-1] if len(ends) else 0)], picked


def scatter(n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of n runs from parts, each of (numbers of its runs, values, counts)."""
    order = np.concatenate([p[0] for p in parts])
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    return gather(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), back)


def small_side(df: DataFrame, limit: int, max_bytes: int = 32 << 20) -> bool:
    """True if a materialized table has at most `limit` rows and so many bytes of text, so that it may be broadcast."""
    text = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = F.lit(0).cast("long")
    for t in text:
        size = size + t
    rows, size = df.limit(limit + 1).agg(F.count("*"), size).first()
    return rows <= limit and size <= max_bytes


def publish(store: fs.FileSystem, base: str, renames: list[tuple[str, str]]) -> None:
    """Rename files below a folder, some at a time."""
    with ThreadPoolExecutor(16) as pool:
        list(pool.map(lambda x: store.move(f"{base}/{x[0]}", f"{base}/{x[1]}"), renames))


#: Bits of a map of keys: at most 2^19 rows of two longs, whatever the number of keys.
MAP_BITS = 25


def key_map(hashes: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """(word, mask) of the bits that the 64-bit numbers of column `hash` set in a map of 2^bits bits.

    Repeated numbers set one bit; null ones are not allowed. No number gives an empty map, in which nothing is.
    """
    marks = hashes.selectExpr(f"shiftrightunsigned(hash, {64 - bits + 6}) as word", f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int)) as mask")
    return materialize(marks.groupBy("word").agg(F.bit_or("mask").alias("mask")), "key-map")


def in_map(rows: DataFrame, keys: DataFrame, hashed: Column, flag: str, bits: int = MAP_BITS) -> DataFrame:
    """The rows with a boolean: false if their key surely is none of those in the map. The map is broadcast; its size is bounded by its bits.

    Rows may repeat and hold nulls, as long as `hashed` is not null; an empty table stays empty.
    """
    marked = rows.withColumn("_hash", hashed).withColumn("_word", F.expr(f"shiftrightunsigned(_hash, {64 - bits + 6})"))
    found = marked.join(F.broadcast(keys.withColumnRenamed("word", "_word").withColumnRenamed("mask", "_mask")), "_word", "left")
    return found.withColumn(flag, F.expr(f"coalesce(_mask & shiftleft(1L, cast(shiftrightunsigned(_hash, {64 - bits}) & 63 as int)) <> 0, false)")).drop("_word", "_hash", "_mask")


def row_key(id_col: Column, text: Column) -> Column:
    """32 bytes that tell rows apart by id and text; a null text counts as empty, a null id as none."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.unhex(F.sha2(F.concat(digest, F.coalesce(F.concat(F.lit(":"), id_col.cast("string")), F.lit(""))), 256))


def without_rows(docs: DataFrame, key: Column, gone: DataFrame, twins: DataFrame, bits: int = MAP_BITS) -> DataFrame:
    """The rows of `docs`, all columns, whose key is not in `gone`; of rows that share a key in `twins` one stays.

    Both tables have one column `key`. A bounded map of their keys tells rows that surely stay as they are; only the others, which
    are little more than those of the two tables, are joined by key, and only their texts can be shuffled.
    """
    marks = key_map(gone.union(twins).select(F.xxhash64("key").alias("hash")), bits)
    # The whole row travels as one struct, so that no column of it can clash with a name used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    rows = in_map(rows, marks, F.xxhash64("key"), "maybe", bits)
    judged = rows.where("maybe").join(gone, "key", "left_anti").dropDuplicates(["key"])
    return rows.where("not maybe").select("row").union(judged.select("row")).select("row.*")


def shard_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows to their group by one key, whatever share of the rows a group has.

    `size` names the number of rows of each group, `total` is the number of all rows. Groups of over a thousandth of the rows are fewer
    than a thousand and are broadcast; the rows of the rest, and those without a group, meet by shuffle and none of these is hot.
    """
    hot = F.col(size) > max(1, total // 1000)
    cols = [c for c in groups.columns if c != key]
    big = groups.where(hot).select(F.col(key).alias("_hot"), *(F.col(c).alias(f"_big_{c}") for c in cols))
    rest = groups.where(~hot).withColumnRenamed(key, "_rest")
    near = rows.join(F.broadcast(big), F.col(key) == F.col("_hot"), "left")
    # A row that has its group, or has no key, takes a key of its own that no group has.
    own = F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.struct(F.lit(0).cast("long").alias("a"), F.col(key).alias("k"))).otherwise(F.struct((F.monotonically_increasing_id() + 1).alias("a"), F.lit(None).cast(rows.schema[key].dataType).alias("k")))
    both = near.withColumn("_own", own).join(rest.withColumn("_own", F.struct(F.lit(0).cast("long").alias("a"), F.col("_rest").alias("k"))).drop("_rest"), "_own", "left")
    return both.select(*rows.columns, *(F.coalesce(F.col(f"_big_{c}"), F.col(c)).alias(c) for c in cols))


@dataclass(frozen=True)
class Shards:
    """Lower bounds of ranges of (id, hash): rows without an id come first, by hash alone; hashes split what has one id."""

    unnamed: tuple[int, ...]
    ids: tuple[int, ...]
    hashes: tuple[int, ...]

    @property
    def count(self) -> int:
        return max(1, len(self.unnamed) + len(self.ids))

    def find(self, keys: pd.Series, known: pd.Series, hashes: pd.Series) -> np.ndarray:
        """The number of the range of each row; keys that are not known are any number."""
        out = np.zeros(len(keys), dtype=np.int32)
        known, h = known.to_numpy(dtype=bool), _unsigned(hashes)
        if self.unnamed:
            out[~known] = np.searchsorted(np.array(self.unnamed[1:], dtype=np.uint64), h[~known], side="right")
        if self.ids:
            bounds, cuts = np.array(self.ids, dtype=np.uint64), np.array(self.hashes, dtype=np.uint64)
            k, h = _unsigned(keys[known]), h[known]
            low, high = np.searchsorted(bounds, k, side="left"), np.searchsorted(bounds, k, side="right")
            at = high - 1
            split = np.flatnonzero(high - low > 1)
            for first in np.unique(low[split]):
                own = split[low[split] == first]
                at[own] = first + np.searchsorted(cuts[first : high[own[0]]], h[own], side="right") - 1
            out[known] = len(self.unnamed) + np.maximum(at, 0)
        return out


def _unsigned(values: pd.Series) -> np.ndarray:
    """64-bit integers as unsigned ones in the same order."""
    return values.to_numpy(dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def whole_numbers(df: DataFrame, col: str) -> None:
    """Raise unless a column holds whole numbers of at most 64 bits."""
    kind = df.schema[col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{col} has to be a whole number of at most 64 bits, not {kind}")


def range_shards(df: DataFrame, key: str, hashed: str, weight, shards: int, fan: int = 256) -> Shards:
    """At most about 2 * `shards` ranges of (long key, 64-bit hash) of nearly equal weight.

    Histograms of `fan` equal bins are refined where a bin is heavy, all heavy bins of a level in one job, so the bounds depend on the
    rows alone and take at most eight jobs; a level brings at most `shards` * `fan` / 2 sums to the driver. A key that is heavy
    alone, or no key, is split by the hash into equal ranges, which are even unless whole rows repeat.
    """
    lo, hi, total, none = df.agg(F.min(key), F.max(key), F.sum(weight).cast("long"), F.sum(F.when(F.col(key).isNull(), weight)).cast("long")).first()
    target = max(1, -(-int(total or 0) // shards))

    def cuts(w: int) -> list[int]:
        n = max(1, -(-w // target)) if w > 2 * target else 1
        return [i * (1 << 64) // n for i in range(n)]

    unnamed = tuple(cuts(int(none))) if none is not None else ()
    pieces: list[tuple[int, int, int]] = []
    todo = [] if lo is None else [(int(lo) + (1 << 63), int(hi) + (1 << 63) + 1)]
    while todo:
        todo.sort()
        starts = np.array([a for a, _ in todo], dtype=np.uint64)
        lasts = np.array([b - 1 for _, b in todo], dtype=np.uint64)
        widths = np.array([max(1, -(-(b - a) // fan)) for a, b in todo], dtype=np.uint64)

        @F.pandas_udf("long")
        def bin_of(keys: pd.Series) -> pd.Series:
            k = _unsigned(keys)
            r = np.searchsorted(starts, k, side="right") - 1
            inside = (r >= 0) & (k <= lasts[np.maximum(r, 0)])
            r = np.maximum(r, 0)
            return pd.Series(np.where(inside, r * fan + ((k - starts[r]) // widths[r]).astype(np.int64), -1))

        level, todo = todo, []
        for row in df.where(F.col(key).isNotNull()).groupBy(bin_of(F.col(key)).alias("bin")).agg(F.sum(weight).cast("long").alias("w")).where("bin >= 0").collect():
            r, i = divmod(int(row["bin"]), fan)
            width = int(widths[r])
            start = level[r][0] + i * width
            if row["w"] > 2 * target and width > 1:
                todo.append((start, min(level[r][1], start + width)))
            else:
                pieces.append((start, width, int(row["w"])))
    ids, hashes, run = [], [], 0
    for start, width, w in sorted(pieces):
        split = cuts(w) if width == 1 else [0]
        if len(split) > 1:
            ids += [start] * len(split)
            hashes += split
            run = target
            continue
        if not ids or (run and run + w > target):
            ids.append(start)
            hashes.append(0)
            run = 0
        run += w
    return Shards(unnamed, tuple(ids), tuple(hashes))


def with_shard(df: DataFrame, key: str, hashed: str, shards: Shards, name: str) -> DataFrame:
    """Add the number of the range that holds the row, and deal each range to a partition of its own."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series, known: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(shards.find(keys, known, hashes))

    # A nullable column would reach pandas as floats, which cannot hold all 64-bit integers.
    return df.withColumn(name, shard(F.coalesce(F.col(key), F.lit(0).cast("long")), F.col(key).isNotNull(), F.col(hashed))).repartitionById(shards.count, F.col(name))
