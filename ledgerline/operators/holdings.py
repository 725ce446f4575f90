"""Insider trades and fund books: rollups, merged positions, changes between quarters, and who holds what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import blank_to_null, change_label, clean_ticker, fixed, number, number_or_zero, trade_side


def insider_rows(raw: DataFrame) -> DataFrame:
    """Trades with a side and clean numbers: shares that cannot be read are zero, prices and values null."""
    value = number(F.col("value").cast("string"))
    return raw.withColumns({"side": trade_side(F.col("code")), "shares": number_or_zero(F.col("shares").cast("string")), "price": number(F.col("price").cast("string")), "value": value, "date": F.substring("date", 1, 10)})


def insider_limits(rows: DataFrame, entity: str, filing_col: str, seq_col: str, filings: int = 12, limit: int = 40) -> DataFrame:
    """The trades of an entity's first filings, cut to a number of rows."""
    w = Window.partitionBy(entity)
    ranked = rows.withColumn("_f", F.dense_rank().over(w.orderBy(filing_col))).where(F.col("_f") <= filings)
    return ranked.withColumn("_n", F.row_number().over(w.orderBy(filing_col, seq_col))).where(F.col("_n") <= limit).drop("_f", "_n")


def insider_flow(rows: DataFrame, keys: Sequence[str], side: Column | None = None, shares: Column | None = None) -> DataFrame:
    """Buys, sells, and shares bought, sold and net; from the columns side and shares unless others are given."""
    side, shares = F.col("side") if side is None else side, F.col("shares") if shares is None else shares
    bought, sold = F.sum(F.when(side == "buy", shares).otherwise(0.0)), F.sum(F.when(side == "sell", shares).otherwise(0.0))
    return rows.groupBy(*keys).agg(F.count_if(side == "buy").alias("buys"), F.count_if(side == "sell").alias("sells"), bought.alias("shares_bought"), sold.alias("shares_sold")).withColumn("net_shares", F.col("shares_bought") - F.col("shares_sold"))


def position_key(order: Sequence[str] = ("cusip", "issuer", "ticker")) -> Column:
    """The first identifier that is there; the fund view and the index differ in the order of the last two."""
    return F.coalesce(*(blank_to_null(F.col(c).cast("string")) for c in order), F.lit("?"))


def merge_positions(rows: DataFrame, book: Sequence[str], key: str, value: Column, shares: Column, first: Sequence[str] = (), seq: str | None = None) -> DataFrame:
    """One row a position of a book: value and shares summed, other columns of the first row."""
    kept = [F.min_by(F.struct(c), seq).getField(c).alias(c) for c in first] if seq else []
    return rows.groupBy(*book, key).agg(F.sum(value).alias("value"), F.sum(shares).alias("shares"), *kept)


def fund_top(positions: DataFrame, book: Sequence[str], key: str, n: int = 25, reported: str | None = None) -> DataFrame:
    """The n largest positions of each book with rank, share of the book in percent, and the number of positions before the cut.

    The total is the reported one unless that is missing or zero, else the sum.
    """
    w = Window.partitionBy(*book)
    total = F.sum("value").over(w)
    if reported:
        total = F.coalesce(F.nullif(F.col(reported), F.lit(0.0)), total)
    ranked = positions.withColumns({"total_value": total, "total_holdings": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(F.desc("value"), F.asc(key)))})
    return ranked.where(F.col("rank") <= n).withColumn("pct", F.round(F.coalesce(F.try_divide(F.col("value") * 100, F.col("total_value")), F.lit(0.0)), 2))


def latest_two(rows: DataFrame, book: Sequence[str], period_col: str) -> DataFrame:
    """Rows of each book's two newest periods with quarter_rank 1 and 2."""
    return rows.withColumn("quarter_rank", F.dense_rank().over(Window.partitionBy(*book).orderBy(F.desc(period_col)))).where("quarter_rank <= 2")


def position_changes(positions: DataFrame, book: Sequence[str], key: str) -> DataFrame:
    """Positions of two quarters (quarter_rank 1 and 2) side by side with a label of the change; what was left shows as exited.

    One pass: each position's two quarters meet in one aggregate over the sums, not in a join of the table with itself.
    """
    now, before = F.col("quarter_rank") == 1, F.col("quarter_rank") == 2

    def summed(c: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0))

    both = positions.groupBy(*book, key).agg(summed("value", now).alias("value"), summed("shares", now).alias("shares"), summed("shares", before).alias("prev_shares"), F.bool_or(now & F.col("value").isNotNull()).alias("_held"))
    both = both.where(F.col("_held") | (F.col("prev_shares") > 0))
    total = F.sum("value").over(Window.partitionBy(*book))
    return both.withColumn("pct", F.round(F.coalesce(F.try_divide(F.col("value") * 100, total), F.lit(0.0)), 2)).withColumn("change", change_label(F.col("shares"), F.col("prev_shares"))).drop("_held")


def holders(index: DataFrame, ticker: str) -> DataFrame:
    """Index rows of one ticker, holders before exits, by falling value."""
    rows = index.where(clean_ticker(F.col("ticker")) == ticker.strip().upper())
    return rows.withColumn("is_exit", F.col("change") == "exited").orderBy("is_exit", F.desc("value"), "fund")


def source_rows(table: DataFrame) -> DataFrame:
    """Positions of a fund report by our names (issuer, ticker, cusip, value, shares), other columns as they are."""
    return table.withColumnsRenamed({"Issuer": "issuer", "Ticker": "ticker", "Cusip": "cusip", "Value": "value", "SharesPrnAmount": "shares"})


def refresh_index(registry: DataFrame, filings: DataFrame, fund: str = "cik", period_col: str = "report_period", key: str = "position") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, errors, counts) from each registered fund's two newest reports.

    The index has one row a fund and position with the change; errors one row (fund, error) for each fund without a report or with a value
    that cannot be read, which is left out of the index as a whole; counts is one row: funds, rows, errors. `filings` holds positions as
    reported (source_rows), with the fund and the period of the report.
    """
    rows = filings.join(registry.select(fund).distinct(), fund, "left_semi").withColumn(key, position_key(("cusip", "ticker", "issuer")))
    recent = latest_two(rows, [fund], period_col)
    bad = recent.where((F.col("value").isNotNull() & number(F.col("value").cast("string")).isNull()) | (F.col("shares").isNotNull() & number(F.col("shares").cast("string")).isNull()))
    unread = bad.groupBy(fund).agg(F.lit("a value cannot be read").alias("error"))
    absent = registry.select(fund).distinct().join(rows.select(fund), fund, "left_anti").withColumn("error", F.lit("no 13F"))
    errors = absent.unionByName(unread)
    clean = recent.join(unread.select(fund), fund, "left_anti")
    merged = merge_positions(clean, [fund, "quarter_rank", period_col], key, number_or_zero(F.col("value").cast("string")), number_or_zero(F.col("shares").cast("string")))
    as_of = merged.where("quarter_rank = 1").groupBy(fund).agg(F.max(period_col).alias("as_of"))
    index = position_changes(merged, [fund], key).join(as_of, fund)
    marks = registry.select(fund).distinct().select(F.lit("fund").alias("m")).unionByName(errors.select(F.lit("error").alias("m"))).unionByName(index.select(F.lit("row").alias("m")))
    counts = marks.agg((F.count_if(F.col("m") == "fund") - F.count_if(F.col("m") == "error")).alias("funds"), F.count_if(F.col("m") == "row").alias("rows"), F.count_if(F.col("m") == "error").alias("errors"))
    return index, errors, counts


def _listed(order: Sequence[Column], line: Column, top: int, when: Column | None = None) -> Column:
    """Lines of a group in an order, the first `top`, as an array."""
    item = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), line.alias("l"))
    listed = F.array_sort(F.collect_list(item if when is None else F.when(when, item)))
    return F.transform(F.slice(listed, 1, top), lambda x: x["l"])


def insider_text(trades: DataFrame, entity: str, order: Sequence[Column], top: int = 8) -> DataFrame:
    """(entity, text) of its trades (date, insider, position, side, shares, price, description): sums and the first of them."""
    shares, price = F.col("shares"), F.col("price")
    line = F.concat(F.lit("  "), "date", F.lit(" "), "insider", F.lit(" ("), "position", F.lit(") "), F.upper("side"), F.lit(" "), fixed(shares, 0, True), F.lit(" sh"), F.when(F.coalesce(price, F.lit(0.0)) != 0, F.concat(F.lit(" @ $"), fixed(price, 2, True))).otherwise(""), F.lit(" ["), "description", F.lit("]"))
    bought, sold = F.sum(F.when(F.col("side") == "buy", shares).otherwise(0.0)), F.sum(F.when(F.col("side") == "sell", shares).otherwise(0.0))
    rows = trades.groupBy(entity).agg(F.count_if(F.col("side") == "buy").alias("b"), F.count_if(F.col("side") == "sell").alias("s"), bought.alias("bs"), sold.alias("ss"), _listed(order, line, top).alias("l"))
    # The wording of the lines.
    head = F.concat(F.col(entity).cast("string"), F.lit(" insider activity (recent Form 4s): "), F.col("b").cast("string"), F.lit(" open-market buys ("), fixed(F.col("bs"), 0, True), F.lit(" sh), "), F.col("s").cast("string"), F.lit(" sells ("), fixed(F.col("ss"), 0, True), F.lit(" sh), net "), fixed(F.col("bs") - F.col("ss"), 0, True), F.lit(" sh."))
    return rows.select(entity, F.array_join(F.concat(F.array(head), "l"), "\n").alias("text"))


def fund_text(positions: DataFrame, fund: str, name: Column, as_of: Column, top: int = 10) -> DataFrame:
    """(fund, text) from fund_top's rows: size of the book and its largest positions."""
    line = F.concat(F.lit("  "), name, F.lit(": "), F.lit("$"), fixed(F.col("value"), 0, True), F.lit(" ("), fixed(F.col("pct"), 1), F.lit("%)"))
    rows = positions.groupBy(fund).agg(F.max(as_of.cast("string")).alias("a"), F.max("total_holdings").alias("n"), F.max("total_value").alias("v"), _listed([F.col("rank")], line, top).alias("l"))
    # The wording of the lines.
    head = F.concat(F.col(fund).cast("string"), F.lit(" 13F holdings as of "), "a", F.lit(": "), F.col("n").cast("string"), F.lit(" positions, $"), fixed(F.col("v"), 0, True), F.lit(" total. Top holdings:"))
    return rows.select(fund, F.array_join(F.concat(F.array(head), "l"), "\n").alias("text"))


def ownership_text(index: DataFrame, ticker: str, fund: str, refreshed_at: Column, top: int = 12) -> DataFrame:
    """(ticker, text): the funds that hold it by falling value with the change, then those that left."""
    name = F.col(fund).cast("string")
    tag = F.when(F.coalesce("change", F.lit("unchanged")).isin("unchanged", ""), "").otherwise(F.concat(F.lit(" ["), "change", F.lit("]")))
    held = F.concat(F.lit("  "), name, F.lit(": "), F.lit("$"), fixed(F.col("value"), 0, True), F.lit(", "), fixed(F.col("shares"), 0, True), F.lit(" sh ("), fixed(F.col("pct"), 1), F.lit("% of book)"), tag)
    left = F.concat(F.lit("  "), name, F.lit(": EXITED (held "), fixed(F.col("prev_shares"), 0, True), F.lit(" sh prior quarter)"))
    order = [-F.col("value"), F.col(fund)]
    gone = F.col("change") == "exited"
    rows = index.groupBy(ticker).agg(_listed(order, held, top, ~gone).alias("h"), _listed(order, left, top, gone).alias("x"), F.max(F.substring(refreshed_at.cast("string"), 1, 10)).alias("a"))
    # The wording of the lines.
    head = F.concat(F.lit("Tracked funds holding "), F.col(ticker), F.lit(" (as of "), "a", F.lit("):"))
    return rows.select(ticker, F.array_join(F.concat(F.array(head), "h", "x"), "\n").alias("text"))


def ownership_summary(index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Funds that hold, that came, added, trimmed and left, and the value held."""
    return index.groupBy(*keys).agg(F.count_if(F.col("change") != "exited").alias("holders"), *(F.count_if(F.col("change") == c).alias(c) for c in ("new", "added", "trimmed", "exited")), F.sum("value").alias("value"))
