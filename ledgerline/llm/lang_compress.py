"""Language identification by compression: the dictionary that makes a text smallest names its language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ship_package

_NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
_SPACE = 1 << 30


def letters_of(text: str) -> bytes:
    """Lower-cased letters in UTF-8, one space for anything between them."""
    body = _NOT_LETTERS.sub(" ", text.lower())
    if not body.replace(" ", "").isalpha():
        # Fractions, powers and the like count as word characters, but are no letters.
        body = " ".join("".join(c if c.isalpha() else " " for c in body).split())
    return body.strip().encode()


@dataclass(frozen=True)
class Dictionaries:
    """Raw-content dictionaries by language, in order of falling frequency: the first of equals is the likelier one."""

    langs: tuple[str, ...]
    contents: tuple[bytes, ...]
    block: int

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        # Short matches and a hash-chain search find the word parts that tell languages apart in small blocks.
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=17, chain_log=16, hash_log=16, search_log=4, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False)
        return [zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for c in self.contents]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 64, max_chars: int = 4096, dict_bytes: int = 32_768, block: int = 2048, max_langs: int = 256) -> Dictionaries:
    """Fit one dictionary a language on a bounded sample of the labelled rows.

    The sample is of three times `docs_per_lang` rows of each language, those with the least hash of id and text among all its rows; of a
    text of more than `max_chars` characters a stretch of that length is taken, which begins at a place told by the hash. Their letters
    fill `dict_bytes`. Counts by language cover all rows. Null and repeated ids are sampled like others, since the text counts too; rows
    that repeat each other count once. Rows with a null text or language teach nothing. Without a labelled row nothing is learnt.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(5)), F.lit(_SPACE)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).limit(max_langs + 1).collect()
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    counts.sort(key=lambda r: (-r["n"], r["lang"]))
    if not counts:
        return Dictionaries((), (), block)
    wanted, wide = 3 * docs_per_lang, F.lit(None).cast("long")
    for r in counts:
        # Twice what is wanted passes the threshold, so that the order can choose; the least row always does.
        wide = F.when(F.col("lang") == r["lang"], F.lit(max(r["least"] + 1, min(_SPACE, 2 * wanted * _SPACE // r["n"])))).otherwise(wide)
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1).cast("int")
    drawn = rows.where(F.col("h") < wide).select("lang", "h", F.substring("text", begin + 1, F.lit(max_chars)).alias("text")).distinct()
    first = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("rank") <= wanted)
    sample = first.select("lang", "rank", "text").collect()
    contents = []
    for r in counts:
        own = [letters_of(x["text"]) for x in sorted((x for x in sample if x["lang"] == r["lang"]), key=lambda x: x["rank"])]
        contents.append(b" ".join(own)[:dict_bytes] or b"        ")
    return Dictionaries(tuple(r["lang"] for r in counts), tuple(contents), block)


def classify(docs: DataFrame, model: Dictionaries, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01) -> DataFrame:
    """One row per input row: id, lang_pred, score, rejected.

    The whole text is compressed block by block with each dictionary. `score` is the margin: one less the ratio of the smallest
    size to the next, from 0 to 1. A row is rejected when its margin is below `min_margin` or it has no letter; a null or
    letterless text is `und` with score 0. A tie goes to the more frequent language; a single learned language scores 1; with
    none learned every row is `und` and rejected. Bytes that are no UTF-8 are no letters. Repeated rows give repeated results; other columns are not looked at.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = [c.compress for c in model.compressors()]
        for b in batches:
            langs, scores = [], []
            for text in b.column(1):
                body = letters_of((text.as_py() or b"").decode("utf-8", "replace"))
                if not body or not packers:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                blocks = [body[i : i + model.block] for i in range(0, len(body), model.block)]
                sizes = [sum(len(p(x)) for x in blocks) for p in packers]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                rest = [s for i, s in enumerate(sizes) if i != best]
                langs.append(model.langs[best])
                scores.append(1.0 - sizes[best] / min(rest) if rest else 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema=f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), "lang_pred", "score", ((F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin)).alias("rejected"))


def drop_rejected(docs: DataFrame, model: Dictionaries, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.01) -> DataFrame:
    """The rows of `docs`, all columns, whose language is told with a wide enough margin.

    Each row goes or stays by its own text, whatever its id; null, empty and letterless texts go, long ones are judged whole. With
    nothing learnt no row stays; an empty table gives no rows.
    """
    judged = classify(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text")), model, "_row", "_text", min_margin)
    return judged.where("not rejected").select("_row.*")
