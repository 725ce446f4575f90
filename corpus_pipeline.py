"""From raw documents to a deduplicated, mixed and encoded corpus; each stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize
from ledgerline.llm.exact_dedup import drop_exact_copies
from ledgerline.llm.golay_dedup import drop_near_copies
from ledgerline.llm.lang_compress import drop_rejected, learn
from ledgerline.llm.piece_codec import encode
from ledgerline.llm.queries import PIECE_MODEL
from ledgerline.llm.source_mix import mixed_documents, written_order


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the dictionaries are learnt from the labelled documents themselves.

    Null, empty and letterless texts go; every row is judged by its own text, however long. Empty in, empty out.
    """
    return drop_rejected(docs, learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id; a null text is an empty one, a null id the smallest.

    Of rows that tie in id and text one stays. Empty in, empty out.
    """
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (fingerprints within four bits), that with the least id.

    A row without an id stays only where no other of its component has one; texts without a word are one component. Empty in, empty out.
    """
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more: sources are repeated towards equal shares, none over twice as often as another.

    A null source is one of the empty name; rows that share id and source are taken together; texts without a token come in every pass.
    Empty in, empty out.
    """
    return mixed_documents(docs, target_entropy=0.95, max_repeat=2.0)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document with their byte spans, and its place in the mixed order; a null or empty text has no piece.

    The order is that of the written mix: `mix_order` grows with it, over all files. Empty in, empty out.
    """
    placed = docs.select(F.struct("doc_id", written_order(docs).alias("mix_order")).alias("place"), "text")
    return encode(placed, PIECE_MODEL, "place").select("place.*", "ids", "begins", "ends")


STAGES = [
    ("language ID", identify),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", pieces),
]

#: Compression, fingerprints and pieces are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
