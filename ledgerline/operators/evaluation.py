"""Retrieval quality: the first matching rank of each case, hit rates and mean reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.retrieval import blocks, near_pairs


def case_matches() -> Column:
    """Over cases (ticker, doc_type, year, sections) joined to results (r_ticker, r_type, r_year, r_section): what a case leaves open matches all."""
    section = F.lower(F.coalesce("r_section", F.lit("")))
    named = F.exists("sections", lambda s: F.contains(section, F.lower(s)))
    return (
        (F.upper("ticker") == F.upper("r_ticker"))
        & (F.col("doc_type").isNull() | (F.col("doc_type") == F.col("r_type")))
        & (F.col("year").isNull() | (F.col("year") == F.col("r_year")))
        & (F.coalesce(F.size("sections"), F.lit(0)).isin(0, -1) | named)
    )


def first_ranks(cases: DataFrame, results: DataFrame, match: Column, case: str = "case_id", rank: str = "rank") -> DataFrame:
    """(case, first_rank): null where no result matches."""
    best = cases.join(results, case).where(F.coalesce(match, F.lit(False))).groupBy(case).agg(F.min(rank).alias("first_rank"))
    return cases.select(case).distinct().join(best, case, "left")


def report(ranks: DataFrame, ks: Sequence[int] = (1, 3, 5), digits: int = 4) -> DataFrame:
    """One row: number of cases, hit rate at each k and MRR; zeros without a case."""
    hits = [F.round(F.coalesce(F.avg(F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))), F.lit(0.0)), digits).alias(f"hit_{k}") for k in ks]
    mrr = F.round(F.coalesce(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)), digits).alias("mrr")
    return ranks.agg(F.count("*").alias("n"), *hits, mrr)


def report_text(ranks: DataFrame, cases: DataFrame, ks: Sequence[int] = (1, 3, 5), case: str = "case_id", title: str = "Retrieval eval") -> DataFrame:
    """One row, column `text`: a line a case with its rank, ticker and query, and the totals under a rule.

    `cases` has ticker and query. A report is read by people: its cases are a stated set, and their lines are joined in one row.
    """
    rank = F.coalesce(F.col("first_rank").cast("string"), F.lit("\u2014"))
    line = F.concat(F.lit("  rank="), F.lpad(rank, 3, " "), F.lit("  "), F.rpad("ticker", F.greatest(F.lit(6), F.length("ticker")), F.lit(" ")), F.lit(" "), F.substring("query", 1, 54))
    lines = ranks.join(cases, case).select(F.col(case).alias("o"), line.alias("t"))
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias("body"))
    totals = report(ranks, ks)
    hits = [F.concat(F.lit(f"hit@{k}="), F.col(f"hit_{k}").cast("string")) for k in ks]
    foot = F.concat(F.lit("  n="), F.col("n").cast("string"), F.lit("  MRR="), F.col("mrr").cast("string"), F.lit("  "), F.concat_ws("  ", *hits))
    parts = [F.lit(""), F.lit(title), F.lit("=" * 40), F.nullif("body", F.lit("")), F.lit("-" * 40), foot]
    return body.join(totals, F.lit(True)).select(F.array_join(F.array_compact(F.array(*parts)), "\n").alias("text"))


def run_cases(cases: DataFrame, chunks: DataFrame, filters: dict[str, str], measure: Column, match: Column, item: str, top_k: int = 5, ks: Sequence[int] = (1, 3, 5), case: str = "case_id", cosine: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(ranks, report) of searching every case within its own filters.

    `filters` names a column of the chunks by that of the cases that has to equal it where the case gives a value. The cases are a stated
    set, broadcast against all chunks in blocks; each task keeps `top_k` rows a case by falling `measure` (ties by item) before anything is shuffled.
    Where `measure` is the cosine of two vectors (of cases and of chunks, named by `cosine`) to nine digits, and a case does not find the chunk of its own id,
    products of matrices leave few pairs to measure.
    """
    allowed = F.lit(True)
    for own, theirs in filters.items():
        allowed = allowed & (F.col(own).isNull() | (F.col(own) == F.col(theirs)))
    ranked = None
    for part in blocks(cases, case):
        if cosine:
            asked = part.withColumns({"query_id": F.col(case), "_q": F.col(cosine[0])} | {f"_w{i}": F.col(own) for i, own in enumerate(filters)})
            met = near_pairs(chunks.withColumnsRenamed({item: "item_id", cosine[1]: "_v"}), asked, top_k, within=list(filters.values()), skip_self=True)
            met = met.drop("query_id", "_q").withColumnsRenamed({"item_id": item, "_v": cosine[1]}).where(allowed)
        else:
            met = chunks.join(F.broadcast(part), allowed)
        scored = met.select(case, item, measure.alias("score"), F.coalesce(match, F.lit(False)).alias("hit"))
        first = scored.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(F.desc("score"), item))).where(F.col("rank") <= top_k)
        ranked = first if ranked is None else ranked.unionByName(first)
    best = ranked.where("hit").groupBy(case).agg(F.min("rank").alias("first_rank"))
    ranks = cases.select(case).join(best, case, "left")
    return ranks, report(ranks, ks)
