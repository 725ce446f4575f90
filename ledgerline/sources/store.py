"""A table of Parquet files that readers see whole: each commit adds a folder and is published by one small version file."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new name in the folder that the driver and all executors share; what is there goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    store, target = _folder(spark, path)
    store.deleteOnExit(target)
    return path


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def kept(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back, for results that several plans go on from."""
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer published the version first."""


class Store:
    """Rows replaced by key, as of the last published version.

    `path`/data holds a folder a commit, `path`/gone the keys whose older rows are dead, and `path`/versions one file a version, which
    names the commits in order and the folder of dead keys. A version file is made whole under another name and then renamed, which fails if
    the version is there: so readers see all of a commit or nothing, a writer that dies leaves folders that no version names, and of two writers
    one raises Conflict. Files of older versions stay until `vacuum`, so a reader that has begun ends well.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        store, target = _folder(self.spark, f"{self.path}/versions")
        if not store.exists(target):
            return []
        return sorted(int(s.getPath().getName()) for s in store.listStatus(target) if s.getPath().getName().isdigit())

    def state(self) -> dict:
        """{version, commits, gone, schema, tags} of the last version."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "commits": [], "gone": None, "schema": None, "tags": {}}
        text = self.spark.read.text(f"{self.path}/versions/{versions[-1]:012d}", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, state: dict) -> None:
        store, final = _folder(self.spark, f"{self.path}/versions/{state['version']:012d}")
        _, draft = _folder(self.spark, f"{self.path}/versions/_{uuid.uuid4().hex}")
        store.mkdirs(final.getParent())
        out = store.create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        # Of two writers that come here together, the file system lets one have the name.
        claim = final.suffix(".claim")
        try:
            store.create(claim, False).close()
        except Exception as e:
            store.delete(draft, False)
            raise Conflict(f"version {state['version']} is taken") from e
        if store.exists(final) or not store.rename(draft, final):
            raise Conflict(f"version {state['version']} is taken")

    def read(self) -> DataFrame | None:
        """The rows of the last version; None before the first."""
        return self._rows(self.state())

    def _rows(self, state: dict) -> DataFrame | None:
        if not state["commits"]:
            return None
        schema = T.StructType.fromJson(state["schema"])
        wide = T.StructType([*schema.fields, T.StructField("_commit", T.LongType())])
        rows = self.spark.read.schema(wide).parquet(*(f"{self.path}/data/{c}" for c in state["commits"]))
        if state["gone"]:
            gone = self.spark.read.parquet(f"{self.path}/gone/{state['gone']}")
            same = F.col("r._commit") < F.col("g._before")
            for c in (c for c in gone.columns if c != "_before"):
                same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}"))
            rows = rows.alias("r").join(gone.alias("g"), same, "left_anti")
        return rows.drop("_commit")

    def replace(self, rows: DataFrame, keys: Sequence[str], tag: tuple[str, int] | None = None) -> int:
        """Publish the rows in place of all that share their keys; the version. Columns that older rows lack are null in these.

        `tag` is a name and a number that grows: a commit whose number is not above the last one of its name is left out, so a batch that runs
        again changes nothing. Files are clustered by key, so a filter on keys skips files and row groups.
        """
        state = self.state()
        if tag and state["tags"].get(tag[0], -1) >= tag[1]:
            return state["version"]
        version, name = state["version"] + 1, uuid.uuid4().hex
        held = rows.withColumn("_commit", F.lit(version).cast("long"))
        held.repartition(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.path}/data/{name}")
        written = self.spark.read.schema(held.schema).parquet(f"{self.path}/data/{name}")
        gone = state["gone"]
        old = self._rows(state)
        if old is not None:
            fresh = written.select(*keys).distinct()
            hit = fresh.alias("f").join(old.select(*keys).distinct().alias("o"), _equal("f", "o", keys), "left_semi").withColumn("_before", F.lit(version).cast("long"))
            dead = hit.unionByName(self.spark.read.parquet(f"{self.path}/gone/{gone}")) if gone else hit
            gone = uuid.uuid4().hex
            dead.groupBy(*keys).agg(F.max("_before").alias("_before")).write.parquet(f"{self.path}/gone/{gone}")
        fields = {f["name"]: f for f in (state["schema"] or {"fields": []})["fields"]}
        fields |= {f["name"]: f for f in json.loads(rows.schema.json())["fields"]}
        schema = {"type": "struct", "fields": list(fields.values())}
        self._publish({"version": version, "commits": [*state["commits"], name], "gone": gone, "schema": schema, "tags": state["tags"] | ({tag[0]: tag[1]} if tag else {})})
        return version

    def compact(self) -> int:
        """Publish the same rows as one commit without dead keys; the version."""
        state = self.state()
        rows = self._rows(state)
        if rows is None:
            return 0
        name, version = uuid.uuid4().hex, state["version"] + 1
        rows.withColumn("_commit", F.lit(version).cast("long")).write.parquet(f"{self.path}/data/{name}")
        self._publish(state | {"version": version, "commits": [name], "gone": None})
        return version

    def vacuum(self) -> int:
        """Delete folders and versions that the last version does not need; how many. Not for use while others write or read older versions."""
        state, n = self.state(), 0
        for part, kept in (("data", set(state["commits"])), ("gone", {state["gone"]}), ("versions", {f"{state['version']:012d}", f"{state['version']:012d}.claim"})):
            store, target = _folder(self.spark, f"{self.path}/{part}")
            for s in store.listStatus(target) if store.exists(target) else []:
                if s.getPath().getName() not in kept:
                    n += bool(store.delete(s.getPath(), True))
        return n


def _equal(a: str, b: str, keys: Sequence[str]):
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out
