"""The fact base: extraction from reported rows, newest filing wins, validation, reads by period, and segments."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import axis_label, bare_concept, blank_to_null, close_to, fixed, keeps_period, number, period, strip, unit
from ledgerline.sources.taxonomy import SEGMENT_REVENUE

FACT_KEY = ("ticker", "canonical_key", "period_end")


def best_row(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given; ranks are cut before the shuffle where Spark can."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def newest_wins(df: DataFrame, keys: Sequence[str], date_col: str, *ties: Column) -> DataFrame:
    """One row a key: the latest date (none counts as oldest); of equals the first by `ties`, such as a falling arrival number."""
    return best_row(df, keys, F.col(date_col).desc_nulls_last(), *ties)


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = FACT_KEY, date_col: str = "filing_date", seq_col: str = "arrival_seq") -> DataFrame:
    """Stored and incoming facts merged: an incoming fact replaces an equal key unless its filing is older."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return newest_wins(both, keys, date_col, F.desc("_new"), F.desc(seq_col)).drop("_new")


def merge_filings(filings: DataFrame, key: str = "filing_id", seq_col: str = "arrival_seq", updated: Sequence[str] = ("filing_date", "period_of_report")) -> DataFrame:
    """One row a filing: its first row, but the latest values of the updated columns."""
    fixed = [c for c in filings.columns if c not in (key, *updated)]
    return filings.groupBy(key).agg(*(F.min_by(F.struct(c), seq_col).getField(c).alias(c) for c in fixed), *(F.max_by(F.struct(c), seq_col).getField(c).alias(c) for c in updated)).select(*filings.columns)


def last_write_wins(df: DataFrame, keys: Sequence[str], seq_col: str = "arrival_seq") -> DataFrame:
    return best_row(df, keys, F.desc(seq_col))


def top_periods(df: DataFrame, keys: Sequence[str], period_col: str, n: int) -> DataFrame:
    """The rows of the n newest periods of each key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(period_col)))
    return df.withColumn("period_rank", rank).where(F.col("period_rank") <= n)


def read_facts(facts: DataFrame, ticker: str, keys: Sequence[str] | None = None, statement: str | None = None, periods: int = 4) -> DataFrame:
    rows = facts.where(F.col("ticker") == ticker.strip().upper())
    if keys:
        rows = rows.where(F.col("canonical_key").isin(*keys))
    if statement:
        rows = rows.where(F.col("statement") == statement)
    return top_periods(rows, ["ticker", "canonical_key"], "period_end", periods).orderBy("canonical_key", F.desc("period_end"))


def extract(rows: DataFrame, filings: DataFrame, concepts: DataFrame) -> DataFrame:
    """Facts of reported rows: (filing, frame, row, concept, value, period, dimensioned) joined to filings and taxonomy.

    Rows with dimensions, of unknown concepts, of other than the form's own periods, without a number or with NaN are dropped.
    Of several concepts for one line item and period the one of best priority stays, then the first seen. The taxonomy
    is a fixed table of some tens of rows and is broadcast.
    """
    named = rows.where(~F.coalesce("is_dimensioned", F.lit(False))).withColumn("source_concept", F.col("concept")).withColumn("concept", bare_concept(F.col("concept"))).join(F.broadcast(concepts), "concept")
    # Exploding its one element keeps the filters behind what is read. Moved before it they would repeat the whole reading for each of their terms, in a method too long for the JVM to compile.
    read = F.struct(number(F.col("numeric_value").cast("string")).alias("value"), period(F.col("period_key")).alias("p"))
    named = named.withColumn("_read", F.explode(F.array(read))).withColumn("value", F.col("_read.value")).withColumn("p", F.col("_read.p")).where("value is not null and p is not null")
    full = named.join(filings.select("filing_id", "ticker", "cik", "form_type", "filing_date"), "filing_id")
    full = full.where(keeps_period(F.col("p.period_type"), F.col("p.period_start"), F.col("p.period_end"), F.col("form_type")))
    one = best_row(full.withColumn("period_end", F.col("p.period_end")), ["filing_id", "canonical_key", "period_end"], F.col("priority"), F.col("frame_ord"), F.col("row_ord"))
    return one.select(
        "ticker", "cik", "canonical_key", "statement", "value", unit(F.col("canonical_key")).alias("unit"), "p.period_type", "period_end", "p.period_start",
        F.year("period_end").alias("fiscal_year"), "fiscal_period", "source_concept", F.lit("xbrl").alias("source_method"), "filing_id", "filing_date", F.lit(1.0).alias("confidence"),
    )


#: The line items that have to add up.
_PARTS = ("revenue", "cost_of_revenue", "gross_profit", "total_liabilities", "total_equity", "total_assets")


def _rules(part: Callable[[str], Column]) -> list[tuple[str, Column, Column]]:
    """(rule, what its parts make, what was reported)."""
    return [("gross_profit", part("revenue") - part("cost_of_revenue"), part("gross_profit")), ("balance_sheet", part("total_liabilities") + part("total_equity"), part("total_assets"))]


def violations(facts: DataFrame, keys: Sequence[str] = ("ticker", "period_end")) -> DataFrame:
    """(keys, rule, detail) where a period's gross profit or balance sheet does not add up; missing parts flag nothing."""
    wide = facts.where(F.col("canonical_key").isin(*_PARTS)).groupBy(*keys).pivot("canonical_key", list(_PARTS)).agg(F.first("value", ignorenulls=True))
    found = [F.when(~close_to(made, told), F.struct(F.lit(rule).alias("rule"), F.concat(fixed(made, 2), F.lit(" is not "), fixed(told, 2)).alias("detail"))) for rule, made, told in _rules(F.col)]
    return wide.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("v")).select(*keys, "v.*")


def flag_low_confidence(facts: DataFrame, keys: Sequence[str] = ("ticker", "period_end"), low: float = 0.5) -> DataFrame:
    """The facts; those of a period with a violation have at most the low confidence, those without a period's whole key keep theirs.

    The parts are looked up over each period's own rows, so the facts are made once and not a second time for their violations.
    """
    period_rows = Window.partitionBy(*keys)
    parts = {f"_{k}": F.first(F.when(F.col("canonical_key") == k, F.col("value")), ignorenulls=True).over(period_rows) for k in _PARTS}
    bad = reduce(or_, (F.coalesce(~close_to(made, told), F.lit(False)) for _, made, told in _rules(lambda k: F.col(f"_{k}"))))
    bad = reduce(and_, (F.col(k).isNotNull() for k in keys), bad)
    flagged = facts.withColumns(parts).withColumn("confidence", F.when(bad, F.least("confidence", F.lit(low))).otherwise(F.col("confidence")))
    return flagged.select(*keys, *(c for c in facts.columns if c not in keys))


def segments(records: DataFrame) -> DataFrame:
    """Revenue rows with exactly one dimension: (axis, member) from the map column `dims`, with labels; blank members are dropped."""
    used = F.map_filter("dims", lambda k, v: v.isNotNull() & (F.lower(v) != "nan"))
    rows = records.where(F.coalesce("is_dimensioned", F.lit(False)) & bare_concept(F.col("concept")).isin(*SEGMENT_REVENUE)).withColumn("_used", used).where(F.size("_used") == 1)
    axis = F.regexp_replace(F.element_at(F.map_keys("_used"), 1), "^dim_", "")
    member = F.coalesce(blank_to_null(F.col("dimension_member_label")), blank_to_null(F.col("label")))
    rows = rows.withColumn("axis", axis_label(axis)).withColumn("member", member).withColumn("value", number(F.col("numeric_value").cast("string"))).withColumn("p", period(F.col("period_key")))
    return rows.where("member is not null and value is not null and p is not null").drop("_used")


def segment_read(rows: DataFrame, entity: str, axis: str, member: str, period_col: str, value: str, members: int = 6) -> DataFrame:
    """Per entity's newest period and axis: rank, member and value by falling value, cut to `members`, and how many there are."""
    newest = rows.withColumn("_latest", F.max(period_col).over(Window.partitionBy(entity))).where(F.col(period_col) == F.col("_latest")).drop("_latest")
    by_axis = Window.partitionBy(entity, axis)
    ranked = newest.withColumn("rank", F.row_number().over(by_axis.orderBy(F.desc(value), F.asc(member)))).withColumn("n_members", F.count("*").over(by_axis))
    return ranked.where(F.col("rank") <= members)


def latest_date(df: DataFrame, keys: Sequence[str], date_col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.nullif(F.col(date_col).cast("string"), F.lit(""))).alias("latest"))


def covered(facts: DataFrame) -> DataFrame:
    return facts.select("ticker").distinct().orderBy("ticker")


def coverage(tickers: DataFrame, facts: DataFrame) -> DataFrame:
    """(ticker, covered, message): whether a ticker has revenue, or other facts only, or none."""
    seen = facts.groupBy("ticker").agg(F.max(F.col("canonical_key") == "revenue").alias("core"))
    message = F.when(F.col("core"), None).when(F.col("core").isNotNull(), "limited coverage: no revenue reported").otherwise("no financials could be extracted")
    return tickers.join(seen, "ticker", "left").select("ticker", F.coalesce("core", F.lit(False)).alias("covered"), message.alias("message"))


def ingest_facts(requested: DataFrame, rows: DataFrame, filings: DataFrame, concepts: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """The stored facts after an ingest of facts alone: reported rows of requested tickers without facts (all requested ones, if forced)
    become facts, those of periods that do not add up lose confidence, and all are merged with what is stored, newest filing first."""
    wanted = to_ingest(requested, stored, force)
    # The tickers are narrow: only the filings that are wanted meet their rows.
    fresh = extract(rows, filings.join(wanted, "ticker", "left_semi"), concepts)
    flagged = flag_low_confidence(fresh).withColumn("arrival_seq", F.lit(0).cast("long"))
    return upsert(stored, flagged)


def to_ingest(requested: DataFrame, facts: DataFrame, force: bool = False) -> DataFrame:
    """Requested tickers, cleaned and distinct, without those that have facts."""
    wanted = requested.select(F.upper(strip(F.col("ticker"))).alias("ticker")).where("ticker <> ''").distinct()
    return wanted if force else wanted.join(facts.select("ticker").distinct(), "ticker", "left_anti")
