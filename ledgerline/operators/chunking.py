"""Documents to chunks: section carry-forward, a fold to page-size pieces with overlap, and chunk rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.html import clean_tables
from ledgerline.functions.text import collapse_spaces
from ledgerline.sources.tables import chunk_id

# Fixed values.
TARGET, OVERLAP, LEAST = 2500, 250, 200


def carry_sections(elements: DataFrame, doc: str, pos: str, header: Column, title: Column, first: str = "Preamble") -> DataFrame:
    """Elements with the last header before them as their section; header rows themselves go."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = elements.withColumn("_h", F.coalesce(header, F.lit(False)))
    return marked.withColumn("section", F.coalesce(F.last(F.when(F.col("_h"), collapse_spaces(title)), ignorenulls=True).over(w), F.lit(first))).where("not _h").drop("_h")


def merge_chunks(elements: DataFrame, doc: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(doc, pos, kind, section, content) from elements (doc, pos, kind, section, content).

    Texts of one section are joined by blank lines; a piece that has reached the target closes before the next text and hands it
    its tail. A table stands alone; neither it nor a change of section hands anything on. An element is never split, a null content
    counts as empty.

    The elements of a document are sorted together and folded as they stream by: time follows their number and memory holds the
    piece that is open, however long the document is.
    """
    kind_of = elements.schema[doc].dataType.simpleString()
    rows = elements.select(F.col(doc).alias("doc"), "pos", "kind", "section", F.coalesce("content", F.lit("")).alias("content"))
    rows = rows.repartition(F.col("doc")).sortWithinPartitions("doc", "pos", "kind", "section", "content").drop("pos")
    blank = " \t\n\v\f\r"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, section, held, size = None, 0, None, [], 0
        out: list[tuple] = []

        def close() -> str:
            nonlocal at, held, size
            text = "\n\n".join(held)
            if text.strip(blank):
                out.append((key, at, "text", section, text.strip(blank)))
                at += 1
            held, size = [], 0
            return text

        def packed(keys: pa.DataType) -> pa.RecordBatch:
            kinds = [keys, pa.int32(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names=["doc", "pos", "kind", "section", "content"])

        keys = pa.null()
        for b in batches:
            keys = b.schema.field("doc").type
            for d, kind, name, content in zip(*(c.to_pylist() for c in b.columns)):
                if d != key:
                    close()
                    key, at = d, 0
                if kind == "table":
                    close()
                    out.append((key, at, "table", name, content))
                    at += 1
                    continue
                if held and name != section:
                    close()
                elif held and size >= target:
                    last = close()
                    if len(last) > overlap:
                        last = last[-overlap:] if overlap else ""
                        last = last[last.find(" ") + 1 :]
                    held, size = [last], len(last)
                section = name
                size += len(content) + (2 if held else 0)
                held.append(content)
            if out:
                yield packed(keys)
                out.clear()
        close()
        if out:
            yield packed(keys)

    folded = rows.mapInArrow(fold, schema=f"doc {kind_of}, pos int, kind string, section string, content string")
    return folded.withColumnRenamed("doc", doc)


def chunk_rows(merged: DataFrame, doc: str, summaries: DataFrame | None = None, least: int = LEAST, raw_html: Column | None = None, meta: Sequence[Column] | None = None, offset: int = 0) -> DataFrame:
    """Chunks long enough to keep, numbered by their place before the cut; a table takes its summary as text and its cleaned HTML as payload.

    `raw_html` is a table's HTML (else its content), `meta` (ticker, form, year, quarter) makes chunk ids with `offset` added to the place.
    """
    rows = merged.where(F.length("content") >= least)
    if summaries is not None:
        rows = rows.join(summaries.select(doc, "pos", "summary"), [doc, "pos"], "left")
    else:
        rows = rows.withColumn("summary", F.lit(None).cast("string"))
    table = F.col("kind") == "table"
    # Only tables reach the parser.
    cleaned = clean_tables(F.when(table, F.coalesce(raw_html if raw_html is not None else F.col("content"), F.col("content"))))
    rows = rows.withColumn("raw_payload", F.coalesce(cleaned, F.col("content")))
    if meta is not None:
        rows = rows.withColumn("chunk_id", chunk_id(*meta, F.col("pos") + offset))
    return rows.withColumn("text_content", F.when(table, F.coalesce(F.nullif("summary", F.lit("")), "content")).otherwise(F.col("content"))).withColumn("chunk_type", F.when(table, "table").otherwise("text"))


def section_map(elements: DataFrame, doc: str, section: str = "section") -> DataFrame:
    """(doc, sections): the contents of each section in order, sections as first seen."""
    listed = elements.groupBy(doc, section).agg(F.min("pos").alias("_p"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("_c"))
    return listed.groupBy(doc).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_p", section, "_c"))), lambda x: F.struct(x[section], x["_c"]))).alias("sections"))
