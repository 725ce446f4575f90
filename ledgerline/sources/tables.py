"""Stored tables: document chunks by filing, JSON indexes and registries, and statements as text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.vectors import checked
from ledgerline.sources.store import Store

FILING = ("ticker", "document_type", "filing_year", "filing_quarter")
CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("cik", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("filing_year", T.IntegerType()),
        T.StructField("filing_quarter", T.StringType()),
        T.StructField("period_of_report", T.DateType()),
        T.StructField("sec_item_section", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("text_content", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)
HOLDINGS_INDEX = "fund string, cik string, ticker string, issuer string, value double, shares double, pct double, as_of string, change string, prev_shares double"


def with_schema(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """All columns of the schema in order: missing ones by their default (else null), others cast."""
    defaults = defaults or {}
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields))


def chunk_id(ticker: Column, form: Column, year: Column, quarter: Column, index: Column) -> Column:
    """The filing and the place, padded to five digits and never cut."""
    return F.concat_ws("_", ticker, form, year.cast("string"), quarter, F.format_string("%05d", index.cast("long")))


def write_chunks(chunks: DataFrame, path: str, dim: int) -> None:
    """Replace the filings that occur among the chunks, and only these; vectors of another width raise.

    The replacement is one commit of a store: readers see the filings as they were until all are written, also if the write fails.
    """
    rows = with_schema(chunks, CHUNKS).withColumn("vector", checked(F.col("vector"), dim))
    Store(chunks.sparkSession, path).replace(rows, FILING)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table; columns that older files lack hold the default of their type: '' for text, 0 for numbers, else null."""
    stored = Store(spark, path).read()
    if stored is None:
        return spark.createDataFrame([], CHUNKS)
    blank = {f.name: "" if f.dataType.typeName() == "string" else 0 if f.dataType.typeName() == "integer" else None for f in CHUNKS.fields}
    # Commits of one table may differ in their columns.
    return with_schema(stored, CHUNKS, blank).fillna({k: v for k, v in blank.items() if v is not None})


def upsert_filings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Without a partitioned store: rows of `incoming`, and those of `stored` from other filings."""
    return stored.join(incoming.select(*FILING).distinct(), list(FILING), "left_anti").unionByName(incoming, allowMissingColumns=True)


def save_index(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("as_of").parquet(path)


def load_index(spark: SparkSession, path: str, schema: str = HOLDINGS_INDEX) -> DataFrame:
    """The stored index; no rows if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def index_summary(rows: DataFrame, refreshed_at: Column) -> DataFrame:
    return rows.agg(refreshed_at.alias("refreshed_at"), F.countDistinct("cik").alias("funds"), F.count("*").alias("n_rows"))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, cik) of the funds of a JSON file, {"funds": [...]} or a list; entries without a cik are dropped."""
    raw = spark.read.schema("funds array<struct<name:string,cik:string>>, name string, cik string").json(path, multiLine=True)
    own = raw.where("cik is not null").select("name", "cik")
    return raw.select(F.explode("funds").alias("f")).select("f.*").where("cik is not null").unionByName(own)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file, {"cases": [...]} or a list, numbered in order."""
    case = "query string, ticker string, doc_type string, year int, section string, sections array<string>"
    inner = case.replace(" string", ":string").replace(" int", ":int").replace(" array", ":array")
    raw = spark.read.schema(f"cases array<struct<{inner}>>, {case}").json(path, multiLine=True)
    nested = raw.select(F.explode("cases").alias("c")).select("c.*")
    flat = raw.where("query is not null").select(*nested.columns)
    both = nested.unionByName(flat)
    return both.select(F.monotonically_increasing_id().alias("case_id"), "query", "ticker", "doc_type", "year", F.coalesce("sections", F.when(F.col("section").isNotNull(), F.array("section")), F.array().cast("array<string>")).alias("sections"))


def csv_lines(df: DataFrame, drop: tuple[str, ...] = ("level", "abstract", "dimension")) -> DataFrame:
    """One column `line`: each row as CSV, without the structural columns."""
    keep = [c for c in df.columns if c not in drop]
    return df.select(F.to_csv(F.struct(*keep)).alias("line"))


def text_lines(df: DataFrame, drop: tuple[str, ...] = ("level", "abstract", "dimension")) -> DataFrame:
    keep = [c for c in df.columns if c not in drop]
    return df.select(F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keep)).alias("line"))
