"""What the engine takes from outside as callables: embedding, summaries and model replies, applied batch by batch in tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.sources.store import Store, scratch_folder

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Summarize = Callable[[Sequence[str]], Sequence[str]]


def hash_embedder(dim: int = 64) -> Embed:
    """A deterministic stand-in: signed hashes of words, scaled to unit length."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype("float32").tolist())
        return out

    return embed


def embed_texts(df: DataFrame, text_col: str, embed: Embed, out: str = "vector", batch: int = 100) -> DataFrame:
    """The rows with a vector; `embed` is called with at most `batch` texts, in the tasks that hold them."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            known = texts.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(known), batch) for v in embed(known[i : i + batch])])

    return df.withColumn(out, run(F.col(text_col)))


class Results:
    """Results kept between runs, by the digest of what was sent: a store of (digest, result)."""

    def __init__(self, spark: SparkSession, path: str, kind: str):
        self.store, self.kind = Store(spark, path), kind
        self.spark = spark

    def read(self) -> DataFrame:
        kept = self.store.read()
        return self.spark.createDataFrame([], f"digest string, result {self.kind}") if kept is None else kept

    def add(self, rows: DataFrame) -> None:
        self.store.replace(rows, ["digest"])


def call_once(df: DataFrame, text_col: str, call: Callable[[Sequence[str]], Sequence], out: str, kind: str = "string", kept: Results | None = None, most_items: int = 100, most_chars: int = 100_000, retries: int = 2) -> DataFrame:
    """The rows with the result of their text: each distinct text is sent once, whatever number of rows has it, and not at all if its result is kept.

    Texts that are equal meet by their digest, so a hot text is one row before it is sent. A call takes at most `most_items` texts of at
    most `most_chars` characters together (a longer one goes alone). A call that raises, or brings another number of results, is tried
    `retries` times more and then item by item; an item that still fails has a null result, which is not kept. Null texts are not sent and have
    null. What is new is written down before it is joined, so no text is sent again by a task that runs twice.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_digest", F.sha2(text_col, 256))
    texts = keyed.where(F.col(text_col).isNotNull()).groupBy(F.col("_digest").alias("digest")).agg(F.first(text_col).alias("text"))
    if kept is not None:
        texts = texts.join(kept.read().select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(own: list[str]) -> list:
            for _ in range(retries + 1):
                try:
                    got = list(call(own))
                except Exception:  # noqa: BLE001 - whatever stands behind the callable may fail in any way
                    continue
                if len(got) == len(own):
                    return got
            return [None] if len(own) == 1 else [x for t in own for x in send([t])]

        for b in batches:
            own, size, results = [], 0, []
            for t in b.column(1).to_pylist():
                if own and (len(own) == most_items or size + len(t) > most_chars):
                    results += send(own)
                    own, size = [], 0
                own.append(t)
                size += len(t)
            results += send(own) if own else []
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"digest": b.column(0).to_pylist(), "result": pd.Series(results, dtype=object)}), schema=schema, preserve_index=False)

    schema = to_arrow_schema(T.StructType.fromDDL(f"digest string, result {kind}"))
    path = scratch_folder(spark, "calls")
    texts.mapInArrow(run, schema=f"digest string, result {kind}").write.parquet(path)
    found = spark.read.schema(f"digest string, result {kind}").parquet(path)
    if kept is not None:
        kept.add(found.where("result is not null"))
        found = kept.read().unionByName(found.where("result is null"))
    found = found.select(F.col("digest").alias("_digest"), F.col("result").alias(out))
    return keyed.join(found, "_digest", "left").drop("_digest")


def summarize_tables(elements: DataFrame, doc_col: str, pos_col: str, content_col: str, summarize: Summarize, batch: int = 6) -> DataFrame:
    """(doc, pos, summary): tables of a document in batches of `batch` a call; where the count does not fit, one call a table."""
    keys = elements.select(F.col(doc_col).alias("doc"), F.col(pos_col).alias("pos"), F.coalesce(F.col(content_col), F.lit("")).alias("content"))
    numbered = keys.selectExpr("*", f"floor((row_number() over (partition by doc order by pos) - 1) / {batch}) as part")
    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema.fields}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        # Shares of one call's room, but never under the least that a table needs.
        room = max(1500, 8000 // len(frame))
        texts = [t[:room] for t in frame["content"]]
        got = list(summarize(texts))
        if len(got) != len(texts):
            got = [next(iter(summarize([t])), "") for t in texts]
        return pd.DataFrame({"doc": frame["doc"], "pos": frame["pos"], "summary": got})

    out = numbered.groupBy("doc", "part").applyInPandas(run, schema=f"doc {kinds['doc']}, pos {kinds['pos']}, summary string")
    return out.select(F.col("doc").alias(doc_col), F.col("pos").alias(pos_col), "summary")
