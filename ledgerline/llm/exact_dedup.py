"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import MAP_BITS, discard, in_map, join_groups, key_map, materialize, row_key, without_rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, bits: int = MAP_BITS, carry: Sequence[Column] = ()) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, then the `carry` columns (expressions over the input).

    Texts are equal when they are identical; a null counts as the empty text. Of equal texts the row with the largest id
    stays (null ids sort lowest). Repeated rows are copies too: of rows that tie in text and id exactly one is kept.
    Empty tables give no rows. Other columns, whatever their names, are ignored. Long texts are hashed where they are read.

    Lengths are counted first; only rows of a repeated length get a prefix hash; only rows of a repeated
    (length, prefix) are read whole and hashed by SHA-256. What repeats is broadcast as a map of 2^`bits` bits, which has the same
    bounded size for every corpus: a chance hit costs one more hash and changes no result, and beyond some 2^`bits` groups
    nearly all rows are hashed. No text is shuffled, and rows meet their group without a hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lengths = docs.groupBy(F.octet_length(text).alias("_n")).agg(F.count("*").alias("_c")).where("_c > 1")
    lengths = key_map(lengths.select(F.xxhash64("_n").alias("hash")), bits)
    sized = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), F.octet_length(text).alias("_n"), F.struct(F.lit(0), *carry).alias("_carry"))
    probed = in_map(sized, lengths, F.xxhash64("_n"), "_l", bits).withColumn("_p", F.when(F.col("_l"), F.xxhash64(F.substring("_t", 1, prefix_chars))))
    prefixes = probed.where("_l").groupBy("_n", "_p").agg(F.count("*").alias("_c")).where("_c > 1")
    prefixes = key_map(prefixes.select(F.xxhash64("_n", "_p").alias("hash")), bits)
    full = in_map(probed, prefixes, F.xxhash64("_n", "_p"), "_s", bits)
    rows = materialize(full.select("_id", F.monotonically_increasing_id().alias("_rid"), F.when(F.col("_l") & F.col("_s"), F.unhex(F.sha2("_t", 256))).alias("_h"), "_carry"), "exact-rows")
    discard(lengths, prefixes)

    best = F.max(F.struct("_id", "_rid")).alias("_best")
    groups = materialize(rows.where("_h is not null").groupBy("_h").agg(best, F.count("*").alias("_c")).where("_c > 1"), "exact-groups")
    joined = join_groups(rows, groups, "_h", "_c", rows.count())
    names = [c for c in rows.schema["_carry"].dataType.names[1:]]
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_c").isNull(), F.col("_id")).otherwise(F.col("_best._id")).alias("keep_id"),
        F.coalesce("_c", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_best._rid") == F.col("_rid"), F.lit(True)).alias("kept"),
        *(F.col("_carry").getField(c).alias(c) for c in names),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, without those that `exact_dedup` drops.

    Rows are told apart by id and text: of equal texts the rows with the largest id stay, of rows that tie in both one. Null ids sort
    lowest, a null text is an empty one, an empty table gives no rows. Texts that are copies of none are not shuffled.
    """
    key = row_key(F.col(id_col), F.col(text_col))
    found = materialize(exact_dedup(docs, id_col, text_col, carry=[key.alias("key")], **options).where("not kept").select("key", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("twin")), "exact-gone")
    return without_rows(docs, key, found.where("not twin").select("key"), found.where("twin").select("key"))
