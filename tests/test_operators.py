"""Operators on small literal tables: nulls, ties, boundaries and the rules that differ between similar operators."""

import datetime as dt
import itertools
import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import html, scalars, text
from ledgerline.operators import catalog, chunking, conversation, evaluation, facts, holdings, retrieval, similarity, valuation, vector_index, watchlist
from ledgerline.plans import catalogue
from ledgerline.sources import boundary, folders, tables, taxonomy
from ledgerline.sources.store import Conflict, Store
from ledgerline.streaming import change_stream, facts_stream


def one(spark, column, **values):
    """The value of an expression over one row of literals."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


# Scalars ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("key,want", [("instant_2024-06-30", ("instant", None, dt.date(2024, 6, 30))), ("duration_2024-01-01_2024-06-30", ("duration", dt.date(2024, 1, 1), dt.date(2024, 6, 30))), ("instant_a_b", None), ("duration_2024-01-01", None), ("instant_2024-13-01", None), ("x", None), (None, None)])
def test_period(spark, key, want):
    got = one(spark, scalars.period(F.col("k")), k=key)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("days,form,kept", [(299, "10-K", False), (300, "10-K", True), (120, "10-Q", True), (121, "10-Q", False), (None, "10-Q", False)])
def test_period_boundaries(spark, days, form, kept):
    end = dt.date(2024, 12, 31)
    start = None if days is None else end - dt.timedelta(days)
    assert one(spark, scalars.keeps_period(F.lit("duration"), F.col("s").cast("date"), F.col("e"), F.lit(form)), s=start, e=end) is kept
    assert one(spark, scalars.keeps_period(F.lit("instant"), F.lit(None).cast("date"), F.col("e"), F.lit(form)), e=end) is True


def test_cleaning(spark):
    assert [one(spark, scalars.clean_ticker(F.col("t")), t=t) for t in (" ab\n", "", "nan", None)] == ["AB", None, None, None]
    assert [one(spark, scalars.is_ticker(F.col("t")), t=t) for t in ("brk.b", "1A", "A" * 11, "x' OR 1", None)] == [True, False, False, False, False]
    assert [one(spark, scalars.is_iso_date(F.col("d")), d=d) for d in ("2024-02-29", "2023-02-29", "2024-13-01", "2024-1-1", None)] == [True, False, False, False, False]
    assert [one(spark, scalars.number(F.col("n")), n=n) for n in ("1.5", "NaN", "x", None)] == [1.5, None, None, None]
    assert [one(spark, scalars.number_or_zero(F.col("n")), n=n) for n in ("1.5", "NaN", "x", None)] == [1.5, 0.0, 0.0, 0.0]
    assert one(spark, scalars.bare_concept(F.col("c")), c="a:b:c") == "b:c"
    assert [one(spark, scalars.trade_side(F.col("c")), c=c) for c in (" p ", "S", "G", "", None)] == ["buy", "sell", "other", "other", "other"]
    assert [one(spark, scalars.clamp_doc_type(F.col("c").cast("string")), c=c) for c in ("10-q", "8-K", None)] == ["10-Q", "10-K", None]
    assert [one(spark, scalars.unit(F.col("c")), c=c) for c in ("eps_basic", "shares_diluted", "revenue")] == ["USD/shares", "shares", "USD"]
    assert [one(spark, scalars.filing_quarter(F.col("f"), F.col("d").cast("date")), f=f, d=d) for f, d in (("10-K", dt.date(2024, 5, 1)), ("10-Q", dt.date(2024, 4, 1)), ("10-Q", None))] == ["FY", "Q2", "Q?"]


def test_staleness_and_verdicts(spark):
    now = F.to_timestamp(F.lit("2024-03-01T00:00:00Z"))
    assert [one(spark, scalars.is_stale(F.col("s").cast("string"), now, 30), s=s) for s in ("2024-01-31T00:00:00Z", "2024-02-01T00:00:00Z", "", None)] == [True, False, True, True]
    assert [one(spark, scalars.verdict(F.col("u").cast("double")), u=u) for u in (0.2, 0.1999, -0.2, None)] == ["cheap", "fair", "expensive", None]
    assert [one(spark, scalars.change_label(F.col("a").cast("double"), F.col("b").cast("double")), a=a, b=b) for a, b in ((1, 0), (0, 1), (2, 1), (1, 2), (1, 1), (None, None))] == ["new", "exited", "added", "trimmed", "unchanged", "unchanged"]
    assert [one(spark, scalars.moved(F.col("a").cast("double"), F.col("b").cast("double")), a=a, b=b) for a, b in ((100, 95), (100, 95.1), (None, 1), (0, 0))] == [True, False, None, False]
    assert [one(spark, scalars.money(F.col("v").cast("double")), v=v) for v in (2.5e9, -3.4e6, 1234.0, None)] == ["$2.5B", "$-3.4M", "$1,234", "n/a"]


def test_payload_cut(spark):
    rows = "<tr>abc</tr>" * 300
    cut = one(spark, scalars.cut_payload(F.col("p"), F.lit(True)), p=rows)
    assert len(cut) <= 2000 and cut.endswith("</tr>") and len(cut) > 1980
    assert one(spark, scalars.cut_payload(F.col("p"), F.lit(True)), p="x" * 3000) == "x" * 2000
    assert one(spark, scalars.cut_payload(F.col("p"), F.lit(False)), p="short") == "short"


# Text ------------------------------------------------------------------------------------------------------------------


def test_text_functions(spark):
    assert one(spark, text.tokens(F.col("t")), t="Étion's 10-K, R&D") == ["tion", "s", "10", "k", "r", "d"]
    assert one(spark, text.tail(F.col("t"), 5), t="aaaa bb cc") == "cc" and one(spark, text.tail(F.col("t"), 5), t="aaaaaaaaa") == "aaaaa" and one(spark, text.tail(F.col("t"), 50), t="all of it") == "all of it"
    assert [one(spark, text.is_header(F.col("t").cast("string")), t=t) for t in ("Item 1A. Risk Factors", "ITEM 7", "Items of note", None)] == [True, True, False, False]
    assert one(spark, text.action(F.col("r")), r='```json\n{"tool": "search", "input": "x", "thought": "t"}\n```').asDict() == {"tool": "search", "input": "{}", "thought": "t"}
    assert one(spark, text.action(F.col("r")), r='say {"tool": "a", "input": {"k": 1}} done')["input"] == '{"k":1}'
    assert one(spark, text.action(F.col("r")), r="garbage") is None
    assert one(spark, text.review(F.col("r")), r='{"status": "ok", "issues": "one"}').asDict() == {"status": "ok", "issues": ["one"]}
    assert one(spark, text.review(F.col("r")), r="x").asDict() == {"status": "unknown", "issues": []}
    assert one(spark, text.citations(F.col("t")), t="a [1] b [12]") == [1, 12] and one(spark, text.chart_block(F.col("t")), t="a<chart>\n{}</chart>") == "\n{}"


def test_jaccard_is_symmetric(spark):
    rng = random.Random(1)
    for _ in range(5):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(5))] for _ in range(2))
        row = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
        x, y = row.select(text.jaccard(F.array_distinct("a"), F.array_distinct("b")), text.jaccard(F.array_distinct("b"), F.array_distinct("a"))).first()
        assert x == y == (len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0)


@pytest.mark.parametrize(
    "given,want",
    [
        ("<table><tr><td>Net</td><td>$</td><td>12</td></tr></table>", "<table><tbody><tr><td>Net</td><td>$12</td></tr></tbody></table>"),
        ("<table><tr><td>a</td></tr><tr><td>7</td><td>45</td><td>%</td></tr></table>", "<table><thead><tr><td>a</td></tr></thead><tbody><tr><td>7</td><td>45%</td></tr></tbody></table>"),
        ("<table><tr><td> </td></tr><tr><th colspan=2>20</th></tr></table>", '<table><tbody><tr><th colspan="2">20</th></tr></tbody></table>'),
        ("<table><tr><td>x<table><tr><td>99</td></tr></table></td></tr></table>", "<table><tbody><tr><td>x<table><tr><td>99</td></tr></table></td></tr></tbody></table>"),
        ("no table", "no table"), ("  ", "  "), (None, None), ("<table><tr><td>$</td></tr></table>", "<table><thead><tr><td>$</td></tr></thead></table>"),
        ("<table><tr><td>a</td></tr><tr><td>9</td></tr></table>", "<table><thead><tr><td>a</td></tr><tr><td>9</td></tr></thead></table>"),
        ('<table class="x"><tr><td></td></tr></table>', '<table class="x"></table>'),
        ('<table id="t"><tr><td class="n" rowspan="2"><b>A</b>&amp;B</td><td>10<table><tr><td>22</td></tr></table></td></tr></table>', '<table id="t"><tbody><tr><td class="n" rowspan="2"><b>A</b>&amp;B</td><td>10<table><tr><td>22</td></tr></table></td></tr></tbody></table>'),
        ("<table><tr><td>x<td>5000<tr><th>y", "<table><tbody><tr><td>x</td><td>5000</td></tr><tr><th>y</th></tr></tbody></table>"),
    ],
)
def test_table_cleaning(given, want):
    assert html.clean_table(given) == want


def test_table_cleaning_in_batches_and_partition(spark):
    rows = spark.createDataFrame([(1, "<h1>A</h1><p>one</p><table><tr><td>x</td></tr></table><script>no</script><p>two"), (2, None)], "id long, html string")
    assert [r["c"] for r in rows.select("id", html.clean_tables(F.col("html")).alias("c")).orderBy("id").collect()][1] is None
    got = [(r["id"], r["pos"], r["kind"], r["content"]) for r in html.partition(rows, "id", "html").orderBy("id", "pos").collect()]
    assert got == [(1, 0, "title", "A"), (1, 1, "text", "one"), (1, 2, "table", "x"), (1, 3, "text", "two")]


# Facts -----------------------------------------------------------------------------------------------------------------

YEAR, LAST = "duration_2023-01-01_2023-12-31", "duration_2022-01-01_2022-12-31"
RAW = [
    ("f1", 0, 0, "us-gaap:Revenues", "100", YEAR, False, "FY"),
    ("f1", 0, 1, "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax", "90", YEAR, None, "FY"),
    ("f1", 0, 2, "us-gaap:Revenues", "50", YEAR, True, "FY"),
    ("f1", 0, 3, "us-gaap:Revenues", "80", LAST, False, "FY"),
    ("f1", 0, 4, "us-gaap:Revenues", "20", "duration_2023-10-01_2023-12-31", False, "Q4"),
    ("f1", 1, 5, "us-gaap:Assets", "NaN", "instant_2023-12-31", False, "FY"),
    ("f1", 1, 6, "us-gaap:Liabilities", "60", "instant_2023-12-31", False, "FY"),
    ("f1", 1, 7, "x:Unheard", "1", YEAR, False, "FY"),
    ("f1", 1, 8, "NetIncomeLoss", "n/a", YEAR, False, "FY"),
    ("f1", 1, 9, "GrossProfit", "1", "broken", False, "FY"),
    ("f1", 0, 10, "us-gaap:GrossProfit", "30", YEAR, False, "FY"),
    ("f1", 1, 11, "us-gaap:GrossProfit", "31", YEAR, False, "FY"),
]
FRAME = "filing_id string, frame_ord int, row_ord int, concept string, numeric_value string, period_key string, is_dimensioned boolean, fiscal_period string"


def test_extraction(spark):
    filings = spark.createDataFrame([("f1", "0001", "AB", "10-K", "2024-02-01")], "filing_id string, cik string, ticker string, form_type string, filing_date string")
    got = facts.extract(spark.createDataFrame(RAW, FRAME), filings, taxonomy.concepts(spark))
    rows = {(r["canonical_key"], str(r["period_end"])): r["value"] for r in got.collect()}
    assert rows == {("revenue", "2023-12-31"): 90.0, ("revenue", "2022-12-31"): 80.0, ("total_liabilities", "2023-12-31"): 60.0, ("gross_profit", "2023-12-31"): 30.0}
    assert {r["statement"] for r in got.collect()} == {"income_statement", "balance_sheet"}


FACT = "ticker string, canonical_key string, period_end string, value double, filing_date string, arrival_seq long"


def test_newest_filing_wins_in_any_order(spark):
    rows = [("A", "revenue", "2023", 1.0, "2024-01-01", 1), ("A", "revenue", "2023", 2.0, "2023-01-01", 2), ("A", "revenue", "2023", 3.0, "2024-01-01", 3), ("B", "revenue", "2023", 4.0, None, 4), ("B", "revenue", "2023", 5.0, None, 5)]
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 40):
        got = facts.newest_wins(spark.createDataFrame(list(order), FACT), facts.FACT_KEY, "filing_date", F.desc("arrival_seq"))
        assert {(r["ticker"], r["value"]) for r in got.collect()} == {("A", 3.0), ("B", 5.0)}
    stored, new = spark.createDataFrame(rows[:1], FACT), spark.createDataFrame([("A", "revenue", "2023", 9.0, "2024-01-01", 0), ("C", "revenue", "2023", 1.0, None, 0)], FACT)
    once = facts.upsert(stored, new)
    assert {(r["ticker"], r["value"]) for r in once.collect()} == {("A", 9.0), ("C", 1.0)}
    assert facts.upsert(once, new).collect() == once.collect() or sorted(facts.upsert(once, new).collect()) == sorted(once.collect())


def test_reads_and_last_writes(spark):
    rows = spark.createDataFrame([("A", "revenue", f"202{i}", float(i), None, i) for i in range(6)], FACT).withColumn("statement", F.lit("income"))
    assert [r["period_end"] for r in facts.read_facts(rows, " a ", ["revenue"], periods=3).collect()] == ["2025", "2024", "2023"]
    assert facts.read_facts(rows, "a", ["other"]).count() == 0
    twice = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0)], "k string, arrival_seq int, v double")
    assert facts.last_write_wins(twice, ["k"]).first()["v"] == 2.0
    filings = spark.createDataFrame([("f", "10-K", "2024-01-01", None, 1), ("f", "10-Q", "2024-02-01", "2023-12-31", 2)], "filing_id string, form string, filing_date string, period_of_report string, arrival_seq int")
    assert tuple(facts.merge_filings(filings).select("form", "filing_date", "period_of_report").first()) == ("10-K", "2024-02-01", "2023-12-31")


def test_violations(spark):
    def period(t, **kv):
        return [(t, k, "2023", v, None, 0) for k, v in kv.items()]

    rows = period("OK", revenue=100.0, cost_of_revenue=60.0, gross_profit=40.0, total_liabilities=1.0, total_equity=2.0, total_assets=3.0) + period("BAD", revenue=100.0, cost_of_revenue=60.0, gross_profit=50.0, total_liabilities=1.0, total_equity=2.0, total_assets=30.0) + period("GAP", revenue=100.0, gross_profit=5.0) + period("EDGE", revenue=100.0, cost_of_revenue=0.0, gross_profit=99.0)
    table = spark.createDataFrame(rows, FACT).withColumn("confidence", F.lit(0.9))
    assert sorted((r["ticker"], r["rule"]) for r in facts.violations(table).collect()) == [("BAD", "balance_sheet"), ("BAD", "gross_profit")]
    flagged = facts.flag_low_confidence(table)
    assert {(r["ticker"], r["confidence"]) for r in flagged.collect()} == {("OK", 0.9), ("BAD", 0.5), ("GAP", 0.9), ("EDGE", 0.9)}


def test_flags_follow_violations(spark):
    parts = ("revenue", "cost_of_revenue", "gross_profit", "total_liabilities", "total_equity", "total_assets")
    values = (None, float("nan"), 0.0, 40.0, 100.0)
    rows = [(f"T{i}", k, "2023", v, 0.9 if i % 2 else None) for i, vs in enumerate(itertools.product(values, repeat=3)) for k, v in zip(parts[:3] if i % 3 else parts[3:], vs)]
    rows += [(t, k, p, v, 0.9) for t, p in ((None, "2023"), ("N", None)) for k, v in (("revenue", 100.0), ("cost_of_revenue", 60.0), ("gross_profit", 50.0))]
    table = spark.createDataFrame(rows + [("T4", "capex", "2023", 1.0, 0.2), ("T4", "capex", "2022", 1.0, 0.9)], "ticker string, canonical_key string, period_end string, value double, confidence double")
    bad = {(r["ticker"], r["period_end"]) for r in facts.violations(table).collect()}
    assert {("N", None), (None, "2023")} < bad and len(bad) > 20
    got = facts.flag_low_confidence(table).select(*table.columns)
    # A period without its whole key is no one's.
    want = [(*r[:4], min(0.5, 0.5 if r[4] is None else r[4]) if (r[0], r[2]) in bad and None not in (r[0], r[2]) else r[4]) for r in table.collect()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_segments_and_coverage(spark):
    geo, seg = "dim_us-gaap:StatementGeographicalAxis", "dim_us-gaap:StatementBusinessSegmentsAxis"
    rows = [
        ("us-gaap:Revenues", "5", YEAR, True, {geo: "US", seg: "nan"}, " US ", None),
        ("us-gaap:Revenues", "6", YEAR, True, {geo: "US", seg: "Cloud"}, "both", None),
        ("us-gaap:Assets", "7", YEAR, True, {geo: "US"}, "US", None),
        ("us-gaap:Revenues", "8", YEAR, True, {seg: "Cloud"}, " ", "Cloud"),
        ("us-gaap:Revenues", "9", YEAR, False, {seg: "Cloud"}, "Cloud", None),
        ("us-gaap:Revenues", "9", YEAR, True, {"dim_x:OddAxis": "o"}, None, None),
    ]
    got = facts.segments(spark.createDataFrame(rows, "concept string, numeric_value string, period_key string, is_dimensioned boolean, dims map<string,string>, dimension_member_label string, label string"))
    assert sorted((r["axis"], r["member"], r["value"]) for r in got.collect()) == [("Geography", "US", 5.0), ("Operating Segment", "Cloud", 8.0)]
    have = spark.createDataFrame([("A", "revenue", "2023", 1.0, None, 0), ("B", "capex", "2023", 1.0, None, 0)], FACT)
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    assert {(r["ticker"], r["covered"]) for r in facts.coverage(asked, have).collect()} == {("A", True), ("B", False), ("C", False)}
    assert [r["ticker"] for r in facts.to_ingest(asked.union(spark.createDataFrame([(" c ",)], "ticker string")), have).collect()] == ["C"]


# Valuation -------------------------------------------------------------------------------------------------------------


def wide(spark, **over):
    base = {k: None for k in valuation.KEYS} | dict(revenue=1000.0, cost_of_revenue=600.0, operating_income=200.0, interest_expense=20.0, pretax_income=180.0, income_tax=36.0, net_income=144.0, operating_cash_flow=210.0, capex=60.0, depreciation_amortization=50.0, total_assets=2000.0, current_assets=500.0, current_liabilities=250.0, cash_and_equivalents=100.0, long_term_debt=300.0, total_equity=800.0, shares_outstanding=100.0)
    row = base | over
    return spark.createDataFrame([("A", 2023, 20.0, *row.values())], "entity string, yr int, price double, " + ", ".join(f"{k} double" for k in row))


def test_metrics(spark):
    m = valuation.period_metrics(wide(spark)).first()
    assert (m["gross_margin"], m["fcf"], m["ebitda"], m["net_debt"], m["current_ratio"], m["interest_coverage"], m["effective_tax_rate"]) == (0.4, 150.0, 250.0, 200.0, 2.0, 10.0, 0.2)
    assert m["roic_approx"] == pytest.approx(200 * 0.8 / 1000) and m["net_debt_to_ebitda"] == 0.8
    m = valuation.period_metrics(wide(spark, operating_income=None, long_term_debt=None, revenue=0.0, capex=None)).first()
    assert [m[k] for k in ("ebitda", "net_debt", "net_margin", "fcf", "roic_approx", "net_debt_to_ebitda")] == [None] * 6
    assert valuation.period_metrics(wide(spark, depreciation_amortization=None)).first()["ebitda"] == 200.0


def test_trends_skip_gaps(spark):
    rows = [("A", 2019, 100.0), ("A", 2021, None), ("A", 2022, 110.0), ("A", 2023, 121.0), ("B", 2023, 5.0), ("C", 2022, -10.0), ("C", 2023, 5.0)]
    got = {r["entity"]: r for r in valuation.trends(spark.createDataFrame(rows, "entity string, yr int, revenue double"), "entity", "yr", ("revenue",)).collect()}
    assert got["A"]["revenue_growth_yoy"] == pytest.approx(0.1) and got["A"]["revenue_cagr"] == pytest.approx(0.1)
    assert got["B"]["revenue_growth_yoy"] is None and got["B"]["revenue_cagr"] is None
    assert got["C"]["revenue_growth_yoy"] == 1.5 and got["C"]["revenue_cagr"] is None


def test_valuation(spark):
    def value(a=valuation.Assumptions(), price=20.0, **over):
        rows = valuation.period_metrics(wide(spark, **over)).withColumns({"revenue_cagr": F.lit(0.5), "price": F.lit(price).cast("double")})
        return valuation.valuation(rows, a).first()

    v = value()
    assert (v["market_cap"], v["enterprise_value"], v["growth_used"]) == (2000.0, 2200.0, 0.20) and v["pe"] == pytest.approx(2000 / 144)
    assert v["dcf_low"] < v["dcf_base"] == v["dcf_high"]
    flows = sum(150 * 1.2**t / 1.09**t for t in range(1, 6)) + 150 * 1.2**5 * 1.025 / 0.065 / 1.09**5
    assert v["dcf_base"] == pytest.approx((flows - 200) / 100) and v["dcf_upside"] == pytest.approx(v["dcf_base"] / 20 - 1)
    assert value(price=None)["pe"] is None and value(price=None)["dcf_base"] is not None and value(price=None)["dcf_upside"] is None
    assert value(capex=500.0)["dcf_base"] is None and value(valuation.Assumptions(discount=0.02))["dcf_base"] is None
    assert value(shares_outstanding=0.0, shares_diluted=50.0)["shares_used"] == 50.0 and value(shares_outstanding=0.0)["market_cap"] is None


def test_signals_and_thesis(spark):
    names = ("net_margin", "roic_approx", "fcf_margin", "net_debt_to_ebitda", "current_ratio", "revenue_growth_yoy", "revenue_cagr", "dcf_upside", "fcf_yield")
    rows = spark.createDataFrame([("up", 0.15, 0.15, 0.10, 1.0, 1.0, 0.10, 0.11, 0.20, 0.03), ("down", 0.04, 0.07, -0.1, 3.1, 0.9, -0.01, 0.05, -0.2, 0.02), ("none", *[None] * 9), ("flat", 0.1, 0.1, 0.05, 2.0, 1.5, 0.0, -0.1, 0.0, 0.05)], "entity string, " + ", ".join(f"{n} double" for n in names))
    got = valuation.signal_rows(rows, ["entity"])
    by = {e: [(r["dimension"], r["direction"]) for r in got.where(f"entity = '{e}'").orderBy("pos").collect()] for e in ("up", "down", "none", "flat")}
    assert by["up"] == [("profitability", "bull"), ("returns", "bull"), ("cash_flow", "bull"), ("balance_sheet", "bull"), ("growth", "bull"), ("valuation", "bull")]
    assert [d for _, d in by["down"]] == ["bear", "bear", "bear", "bear", "neutral", "bear", "bear", "bear", "bear"] and by["none"] == [] and by["flat"] == [("growth", "neutral")]
    valued = rows.withColumns({"yr": F.lit(2024), "price": F.when(F.col("entity") != "flat", 10.0), "dcf_base": F.when(F.col("entity").isin("down", "flat"), 12.345), "dcf_low": F.lit(11.0), "dcf_high": F.lit(13.0)})
    t = {r["entity"]: r["text"].split("\n") for r in valuation.thesis(valued, got, "entity", "yr").collect()}
    assert t["down"][0] == "down — investment thesis scaffold (heuristic signals on filed numbers, latest 2024):"
    watch = t["down"][t["down"].index("WHAT WOULD CHANGE THE VIEW:") + 1 : -1]
    assert watch == [f"  • {valuation.WATCH[d]}" for d in ("profitability", "returns", "cash_flow")]
    assert "VALUATION: price $10.00, DCF intrinsic $12.35 (range $11.00–$13.00) — trading above the DCF estimate." in t["down"] and "WATCH:" in t["down"]
    assert "VALUATION: DCF intrinsic $12.35 (range $11.00–$13.00) — trading above the DCF estimate." in t["flat"]
    assert "  + High net margin (net margin 15.0%)" in t["up"] and t["up"][t["up"].index("BEAR:") + 1] == "  (none flagged)"
    # Bulls alone: one thing to watch for them; no signal at all: nothing to watch, but a text.
    assert t["up"][-2] == f"  • {valuation.WATCH_BULLS}" and "WHAT WOULD CHANGE THE VIEW:" not in t["none"] and t["none"].count("  (none flagged)") == 2
    table = wide(spark)
    text = valuation.fundamentals_text(valuation.period_metrics(table), table, "entity", "yr").first()["text"]
    assert "Revenue $1,000" in text and "Growth — revenue YoY n/a" in text and "history" not in text


# Holdings --------------------------------------------------------------------------------------------------------------


def test_insiders(spark):
    raw = [("A", 1, " p", "10", "2.0", "20"), ("A", 2, "S", "NaN", "x", None), ("A", 3, "S", "4", "1", "4"), ("A", 4, "G", "100", None, None)]
    rows = holdings.insider_rows(spark.createDataFrame(raw, "ticker string, seq int, code string, shares string, price string, value string").withColumn("date", F.lit("2024-01-02T00:00")))
    assert tuple(holdings.insider_flow(rows, ["ticker"]).first()) == ("A", 1, 2, 10.0, 4.0, 6.0)
    assert rows.where("seq = 2").first()["price"] is None and rows.first()["date"] == "2024-01-02"
    many = spark.createDataFrame([("A", f, i) for f in range(20) for i in range(5)], "ticker string, f int, i int")
    cut = holdings.insider_limits(many, "ticker", "f", "i")
    assert cut.count() == 40 and cut.agg(F.max("f")).first()[0] == 7


def test_fund_book(spark):
    rows = spark.createDataFrame([("F", 0.0, 1, "Acme", "AC", "c1", 60.0, 1.0), ("F", 0.0, 2, "Acme B", "AB", "c1", 20.0, 2.0), ("F", 0.0, 3, "Beta", None, None, 20.0, 5.0), ("F", 0.0, 4, "Gamma", "G", " ", 0.0, 0.0)], "fund string, total double, seq int, issuer string, ticker string, cusip string, value double, shares double")
    keyed = rows.withColumn("key", holdings.position_key())
    assert {r["key"] for r in keyed.collect()} == {"c1", "Beta", "Gamma"}
    assert {r["k"] for r in rows.select(holdings.position_key(("cusip", "ticker", "issuer")).alias("k")).collect()} == {"c1", "Beta", "G"}
    merged = holdings.merge_positions(keyed, ["fund"], "key", F.col("value"), F.col("shares"), ["issuer", "total"], "seq")
    top = holdings.fund_top(merged, ["fund"], "key", 2, reported="total").orderBy("rank").collect()
    assert [(r["key"], r["issuer"], r["pct"], r["total_holdings"]) for r in top] == [("c1", "Acme", 80.0, 3), ("Beta", "Beta", 20.0, 3)]


def test_position_changes(spark):
    rows = [("F", q, k, v, s) for q, k, v, s in (("Q2", "new", 10.0, 1.0), ("Q2", "up", 20.0, 5.0), ("Q1", "up", 9.0, 4.0), ("Q2", "down", 10.0, 1.0), ("Q1", "down", 9.0, 4.0), ("Q2", "same", 10.0, 2.0), ("Q1", "same", 10.0, 2.0), ("Q1", "gone", 5.0, 3.0), ("Q1", "ghost", 5.0, 0.0), ("Q0", "old", 1.0, 1.0))] + [("N", "Q2", "only", 1.0, 1.0)]
    table = holdings.latest_two(spark.createDataFrame(rows, "fund string, q string, key string, value double, shares double"), ["fund"], "q")
    got = holdings.position_changes(table, ["fund"], "key")
    assert {(r["fund"], r["key"], r["change"]) for r in got.collect()} == {("F", "new", "new"), ("F", "up", "added"), ("F", "down", "trimmed"), ("F", "same", "unchanged"), ("F", "gone", "exited"), ("N", "only", "new")}
    assert {r["key"]: r["pct"] for r in got.collect()}["up"] == 40.0
    index = got.withColumn("ticker", F.lit(" ab "))
    assert [r["key"] for r in holdings.holders(index, "AB").collect()][-1] == "gone"
    assert holdings.ownership_summary(index, ["ticker"]).first()["holders"] == 5


# Retrieval -------------------------------------------------------------------------------------------------------------


def pool(spark):
    rows = [(1, "alpha beta", 10, "alpha alpha gamma", 1), (1, "alpha beta", 11, "beta", 2), (1, "alpha beta", 12, "delta", 3), (1, "alpha beta", 13, "", 4), (1, "alpha beta", 14, "alpha alpha gamma", 5), (2, "", 10, "alpha", 1), (2, "", 11, "beta", 2)]
    return spark.createDataFrame(rows, "query_id int, query string, item_id int, text string, vec_rank int")


def test_lexical_scores_and_fusion(spark):
    scored = {(r["query_id"], r["item_id"]): r["lex_score"] for r in retrieval.bm25(pool(spark)).collect()}
    assert scored[1, 12] == scored[1, 13] == scored[2, 10] == scored[2, 11] == 0.0 and scored[1, 11] > scored[1, 10] == scored[1, 14] > 0
    fused = {(r["query_id"], r["item_id"]): (r["lex_rank"], r["rank"]) for r in retrieval.fuse(retrieval.bm25(pool(spark))).collect()}
    assert fused[2, 10] == (1, 1) and fused[2, 11] == (2, 2) and fused[1, 11][0] == 1 and fused[1, 12][0] == 4
    both = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "a", 2)], "q int, i string, r int")
    assert len({round(r["rrf"], 12) for r in retrieval.reciprocal_rank_sum(both, "q", "i", "r").collect()}) == 1


def greedy(cands, k, lam):
    left, picked, n = list(cands), [], len(cands)
    sim = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    while left and len(picked) < k:
        best = max(left, key=lambda c: (round(lam * (n - cands.index(c)) / n - (1 - lam) * max((sim(c[1], p[1]) for p in picked), default=0.0), 12), -cands.index(c)))
        picked.append(best)
        left.remove(best)
    return [c[0] for c in picked]


@pytest.mark.parametrize("lam", [0.0, 0.3, 0.7, 1.0])
def test_mmr_is_the_greedy_choice(spark, lam):
    rng = random.Random(int(lam * 10))
    words = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(6))) for _ in range(12)]
    rows = spark.createDataFrame([(1, i, i + 1, w) for i, w in enumerate(words)], "query_id int, item_id int, rank int, text string")
    got = [r["item_id"] for r in retrieval.mmr(rows, 20, lam=lam).orderBy("pick").collect()]
    assert got == greedy([(i, frozenset(w.split())) for i, w in enumerate(words)], 20, lam)
    if lam == 1.0:
        assert got == list(range(12))


def test_predicates(spark):
    rows = spark.createDataFrame([("AB", 2023, "10-K", dt.date(2023, 12, 31)), ("AB", 2024, "10-Q", dt.date(2024, 3, 31))], "ticker string, filing_year int, document_type string, period_of_report date")
    assert rows.where(retrieval.predicate()).count() == 2 and rows.where(retrieval.predicate(ticker=" ab ", year="2023")).count() == 1
    assert rows.where(retrieval.predicate(period_start="2023-12-31", period_end="2024-03-30")).count() == 1
    for bad in (dict(ticker="x' OR '1'='1"), dict(document_type="S-1"), dict(period_end="2024-13-01"), dict(year="x")):
        with pytest.raises(ValueError):
            retrieval.predicate(**bad)
        assert rows.where(retrieval.predicate(**bad, lenient=True)).count() == 2


def test_vectors_and_loops(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<float>")
    for metric, want in (("cosine", [1, 3]), ("l2", [1, 3])):
        got = retrieval.vector_top_k(v, v.where("id = 1"), 2, "id", "v", "id", "v", metric).orderBy("vec_rank").collect()
        assert [r["item_id"] for r in got] == want
    # In blocks of queries the result is the same.
    whole, parts = ([tuple(r) for r in retrieval.vector_top_k(v, v, 2, "id", "v", "id", "v", block=b).orderBy("query_id", "vec_rank").collect()] for b in (1000, 1))
    assert whole == parts and len(whole) == 8
    steps = spark.createDataFrame([("r", 1, "a", 2), ("r", 2, "b", 1), ("r", 3, "b", 1), ("s", 1, "a", 0), ("t", 1, "a", 1)], "run string, step int, sig string, fresh int")
    assert {(r["run"], r["step"], r["reason"]) for r in retrieval.loop_stops(steps, "run", "step", "sig", "fresh").collect()} == {("r", 3, "repeated"), ("s", 1, "nothing new")}
    ctx = retrieval.context_text(spark.createDataFrame([(1, 2, "t2", "p2"), (1, 1, "t1", "p1")], "q int, o int, t string, p string"), "q", "o", F.col("t"), F.col("p")).first()["context"]
    assert ctx == "[1] t1\np1\n\n---\n\n[2] t2\np2"


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "ab", None, None, []), (2, "AB", "10-K", 2023, ["Risk"]), (3, "ZZ", None, None, None)], "case_id int, ticker string, doc_type string, year int, sections array<string>")
    results = spark.createDataFrame([(1, 1, "XX", "10-K", 2023, "a"), (1, 2, "AB", "10-Q", 2020, "b"), (2, 1, "AB", "10-K", 2023, "Item 1A. RISK FACTORS"), (3, 1, "AB", "10-K", 2023, None)], "case_id int, rank int, r_ticker string, r_type string, r_year int, r_section string")
    ranks = evaluation.first_ranks(cases, results, evaluation.case_matches())
    assert {(r["case_id"], r["first_rank"]) for r in ranks.collect()} == {(1, 2), (2, 1), (3, None)}
    assert tuple(evaluation.report(ranks).first()) == (3, 0.3333, 0.6667, 0.6667, 0.5)
    assert tuple(evaluation.report(ranks.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0)


# Documents, conversations, watchlists, catalogue ------------------------------------------------------------------------


def fold(elements):
    """The chunk fold, plainly."""
    out, buf, section = [], None, None

    def flush():
        nonlocal buf
        if buf is not None and buf.strip():
            out.append(("text", section, buf.strip()))
        buf = None

    def tail(t):
        if len(t) <= 250:
            return t
        t = t[-250:]
        return t.split(" ", 1)[1] if " " in t else t

    for kind, sec, content in elements:
        if kind == "table":
            flush()
            out.append((kind, sec, content))
        elif buf is None:
            buf, section = content, sec
        elif sec != section:
            flush()
            buf, section = content, sec
        elif len(buf) >= 2500:
            carried = tail(buf)
            flush()
            buf = carried + "\n\n" + content
        else:
            buf += "\n\n" + content
    flush()
    return out


def test_chunk_fold_against_a_plain_one(spark):
    rng = random.Random(4)
    docs = []
    for d in range(12):
        docs.append([(rng.choice(["text"] * 6 + ["table"]), rng.choice("AAAB"), " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 220)))) for _ in range(rng.randrange(1, 30))])
    docs.append([("text", "A", "x" * 6000), ("text", "A", "y")])
    rows = spark.createDataFrame([(d, i, *e) for d, doc in enumerate(docs) for i, e in enumerate(doc)], "doc_id int, pos int, kind string, section string, content string")
    got = chunking.merge_chunks(rows, "doc_id").orderBy("doc_id", "pos").collect()
    for d, doc in enumerate(docs):
        assert [(r["kind"], r["section"], r["content"]) for r in got if r["doc_id"] == d] == fold(doc)
    kept = chunking.chunk_rows(chunking.merge_chunks(rows, "doc_id"), "doc_id")
    assert kept.agg(F.min(F.length("content"))).first()[0] >= 200


def test_long_documents_fold_in_a_stream(spark):
    """A hundred thousand elements of one section, nulls and empty texts among them, are folded as a plain loop does."""
    rows = spark.range(100_000).selectExpr("cast(id % 2 as int) as doc_id", "cast(id as int) as pos", "'text' as kind", "'A' as section", "if(id % 7 = 0, null, repeat(concat('w', id % 10, ' '), cast(id % 30 as int))) as content")
    got = chunking.merge_chunks(rows, "doc_id").orderBy("doc_id", "pos").collect()
    for d in (0, 1):
        own = [("text", "A", "" if i % 7 == 0 else f"w{i % 10} " * (i % 30)) for i in range(d, 100_000, 2)]
        assert [r["content"] for r in got if r["doc_id"] == d] == [c for _, _, c in fold(own)]


def test_chunk_ids_are_never_cut(spark):
    ids = spark.createDataFrame([(7,), (12345,), (123456,)], "i int").select(tables.chunk_id(F.lit("A"), F.lit("10-K"), F.lit(2023), F.lit("FY"), F.col("i")).alias("c"))
    assert [r["c"] for r in ids.collect()] == ["A_10-K_2023_FY_00007", "A_10-K_2023_FY_12345", "A_10-K_2023_FY_123456"]


def test_deeply_nested_tables():
    deep = "<b>" * 5000 + "12" + "</b>" * 5000
    assert html.clean_table(f"<table><tr><td>{deep}</td></tr></table>") == f"<table><tbody><tr><td>{deep}</td></tr></tbody></table>"


def test_mmr_takes_all_candidates(spark):
    rng = random.Random(5)
    words = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(5))) for _ in range(300)]
    rows = spark.createDataFrame([(1, i, i + 1, w) for i, w in enumerate(words)], "query_id int, item_id int, rank int, text string")
    got = [r["item_id"] for r in retrieval.mmr(rows, 250).orderBy("pick").collect()]
    assert got == greedy([(i, frozenset(w.split())) for i, w in enumerate(words)], 250, 0.7)
    assert [r["item_id"] for r in retrieval.mmr(rows, 40).orderBy("pick").collect()] == got[:40]


def test_bm25_of_any_number_of_candidates(spark):
    rows = spark.range(60).selectExpr("id % 2 as query_id", "id as item_id", "if(id % 2 = 0, 'red fox', '') as query", "concat_ws(' ', repeat('red ', cast(id % 5 as int)), if(id % 3 = 0, 'fox', 'dog')) as text", "id + 1 as vec_rank")
    listed, wide = ({(r["query_id"], r["item_id"]): round(r["lex_score"], 12) for r in retrieval.bm25(rows, max_candidates=n).collect()} for n in (1000, None))
    assert listed == wide and len(wide) == 60 and max(wide.values()) > 0
    with pytest.raises(Exception, match="more than 10"):
        retrieval.bm25(rows, max_candidates=10).collect()


def test_sections_and_summaries(spark):
    rows = spark.createDataFrame([(1, 0, "text", "intro"), (1, 1, "text", "Item 1.  Business"), (1, 2, "text", "body"), (1, 3, "table", "t" * 300)], "doc_id int, pos int, kind string, content string")
    got = chunking.carry_sections(rows, "doc_id", "pos", text.is_header(F.col("content")), F.col("content"))
    assert [(r["pos"], r["section"]) for r in got.orderBy("pos").collect()] == [(0, "Preamble"), (2, "Item 1. Business"), (3, "Item 1. Business")]
    calls = []
    found = boundary.summarize_tables(got.where("kind = 'table'"), "doc_id", "pos", "content", lambda texts: [t[:3] for t in texts])
    assert found.first()["summary"] == "ttt" and calls == []
    rows = chunking.chunk_rows(chunking.merge_chunks(got, "doc_id"), "doc_id", found.withColumn("pos", F.lit(1)))
    assert [(r["chunk_type"], r["text_content"]) for r in rows.where("kind = 'table'").collect()] in ([("table", "ttt")], [("table", "t" * 300)])


def test_near_pairs_are_few_and_hold_the_best(spark):
    """Of 100 x 3,000 pairs few are left to measure; vectors without a measure stay, ties are whole."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8)).round(1).astype(np.float32).astype(np.float64)
    x[1500:1510], x[12] = x[7], 0
    vectors = [v.tolist() for v in x]
    vectors[11], vectors[12], vectors[13], vectors[14] = None, [0.0] * 8, [float("nan")] * 8, [1.0, 2.0]
    rows = spark.createDataFrame(list(enumerate(vectors)), "item_id long, _v array<float>").coalesce(1)
    queries = rows.where("item_id % 30 = 7").withColumnsRenamed({"item_id": "query_id", "_v": "_q"})
    for metric in ("cosine", "l2"):
        found = {}
        for r in retrieval.near_pairs(rows, queries, 5, metric).select("query_id", "item_id").collect():
            found.setdefault(r["query_id"], set()).add(r["item_id"])
        assert len(found) == 100 and sum(map(len, found.values())) < 40_000
        for q, items in found.items():
            a, b = np.array(vectors[q]), x
            with np.errstate(all="ignore"):
                measure = -(b @ a) / np.linalg.norm(b, axis=1) if metric == "cosine" else np.linalg.norm(b - a, axis=1)
            measure[[11, 13, 14] + [12] * (metric == "cosine")] = np.inf
            assert set(np.flatnonzero(measure <= np.sort(measure)[4] + 1e-9).tolist()) | {11, 13, 14} <= items


def test_blocks_keep_references_that_are_cut():
    assert html.blocks("<h1>a &amp; b&amp</h1><p title='&lt'>R&D &lt; &am") == [("title", "a & b&amp", None), ("text", "R&D < &am", None)]
    assert html.blocks("<table><td id='&x'>&amp &gt;</td></table>") == [("table", "&amp >", "<table><td id='&x'>&amp;amp &gt;</td></table>")]


def test_symbols_stand_alone_among_ascii_letters(spark):
    rewrite = text.wants_rewrite(F.col("m"), F.lit(True))
    assert [one(spark, rewrite, m=m) for m in ("SSöß der", "ÄBC x", "xAB x", "AB_ x", "the AB.", "ABCDEF x")] == [False, False, True, True, False, True]


def test_bundle_margins_are_rounded_from_their_binary_value(spark, monkeypatch):
    """0.02285 lies a little below the half and 0.02295 a little above; by their decimal digits both would go up."""
    items = dict.fromkeys((*valuation.KEYS, "price"))
    rows = [("N", y, *(items | {"revenue": 1e5, "net_income": v}).values()) for y, v in ((2001, 2285.0), (2000, 2295.0), (1999, None))]
    wide = spark.createDataFrame(rows, "entity string, yr int, " + ", ".join(f"{k} double" for k in items))
    monkeypatch.setattr(catalogue, "_wide", lambda *_: wide)
    assert catalogue.metrics_bundle(spark, "")["margins",].first()[0] == f"{0.02285:.4f},{0.02295:.4f},-" == "0.0228,0.0230,-"


def test_summaries_fall_back_to_one_call_each(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}") for i in range(8)], "doc_id int, pos int, content string")
    got = boundary.summarize_tables(rows, "doc_id", "pos", "content", lambda texts: ["s" + texts[0]] if len(texts) != 2 else ["a", "b"])
    assert [r["summary"] for r in got.orderBy("pos").collect()] == [f"st{i}" for i in range(6)] + ["a", "b"]


def test_conversations(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f" t{i} ") for i in range(9)] + [(1, 9, "system", "no"), (1, 10, "user", "  "), (2, 0, "user", "And what about last year?"), (3, 0, "user", "hi"), (3, 1, "user", "How did AAPL do?"), (4, 0, "assistant", "x"), (4, 1, "user", "a b c d e f g h i j k l"), (5, 0, "assistant", "x"), (5, 1, "user", "a b c d e f g h i j k"), (6, 0, None, "x")]
    table = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    rows = {r["conv_id"]: r for r in conversation.history(table).collect()}
    assert rows[1]["history"].split("\n") == ["Assistant: t3", "User: t4", "Assistant: t5", "User: t6", "Assistant: t7", "User: t8"] and 6 not in rows
    assert {r["conv_id"]: r["rewrite"] for r in conversation.follow_ups(table).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert conversation.keep_messages(table, "conv_id", "turn", 2).where("conv_id = 1").count() == 2


def test_watchlist(spark):
    a = spark.createDataFrame([(" ab", 2), ("", 1), ("CD", 3)], "ticker string, added_at int")
    both = watchlist.add_tickers(a, spark.createDataFrame([("AB", 9)], "ticker string, added_at int"))
    assert [tuple(r) for r in both.collect()] == [("AB", 2), ("CD", 3)]
    assert [r["ticker"] for r in watchlist.remove_tickers(both, spark.createDataFrame([("ab ",)], "ticker string")).collect()] == ["CD"]
    shape = "ticker string, pe double, dcf_upside double, net_margin double, revenue_growth_yoy double, net_debt_to_ebitda double, signal_labels array<string>, ingested_filing_date date"
    prev = spark.createDataFrame([("A", 10.0, 0.10, 0.2, None, 1.0, ["x", "y"], dt.date(2024, 1, 1)), ("S", 10.0, 0.1, 0.2, 0.1, 1.0, [], None)], shape)
    cur = spark.createDataFrame([("A", 10.6, 0.105, 0.2, 0.3, 1.04, ["z", "y"], dt.date(2024, 2, 1)), ("S", 10.0, 0.1, 0.2, 0.1, 1.0, None, dt.date(2024, 2, 1)), ("N", 1.0, 1.0, 1.0, 1.0, 1.0, ["q"], None)], shape)
    got = [(r["ticker"], r["change"]) for r in watchlist.changes(cur, prev).orderBy("ticker", "pos").collect()]
    assert got == [("A", "P/E 10.0x to 10.6x"), ("A", "New signal: z"), ("A", "Cleared: x"), ("A", "New filing ingested (2024-02-01)")]
    shots = watchlist.read_snapshots(spark.createDataFrame([("A", '{"pe": 1.5}'), ("B", "{oops")], "ticker string, payload string"), "payload", "pe double")
    assert {(r["ticker"], r["snapshot"]["pe"] if r["snapshot"] else None) for r in shots.collect()} == {("A", 1.5), ("B", None)}


def test_catalog_operators(spark):
    rows = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, " "), (2, 0, None)], "k int, pos int, t string")
    assert [tuple(r) for r in catalog.mode_first(rows, ["k"], "t", "pos").collect()] == [(1, "b", 2)]
    tasks = spark.createDataFrame([(f"d{i}", "completed", i) for i in range(4)] + [("r", "running", 0)], "task_id string, state string, updated_at int")
    assert {r["task_id"] for r in catalog.evict(tasks, 4).collect()} == {"d2", "d3", "r"} and catalog.evict(tasks, 10).count() == 5
    line = spark.createDataFrame([(1, i, float(i)) for i in range(25)] + [(1, 99, float("nan")), (2, 0, 7.0)], "k int, o int, v double")
    got = catalog.downsample(line, ["k"], "o", "v", 10)
    assert [r["v"] for r in got.where("k = 1").orderBy("pos").collect()] == [0.0, 2.0, 5.0, 7.0, 10.0, 12.0, 15.0, 17.0, 20.0, 24.0] and got.where("k = 2").count() == 1
    flat = catalog.scale_unit(line.where("k = 2"), ["k"], "v").first()["scaled"]
    assert flat == 0.0 and catalog.summary_text(rows.limit(0), F.col("t")).first()["summary"] == "The corpus is empty."
    spec = json.dumps({"data": [{"name": "a", "x": "1"}, {"name": "b", "y": "2", "x": "3"}]})
    row = catalog.chart_series(spark.createDataFrame([(spec,), ("{}",)], "spec string"), "spec").collect()
    assert (row[0]["chart_type"], row[0]["series_names"]) == ("bar", ["x", "y"])


# Sources and streaming -------------------------------------------------------------------------------------------------


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, ticker string, document_type string, filing_year int, filing_quarter string, text_content string, vector array<float>")


def test_chunk_table(spark, tmp_path):
    path = str(tmp_path / "chunks")
    tables.write_chunks(chunks(spark, [("1", "A", "10-K", 2023, "FY", "old", [1.0, 0.0]), ("2", "B", "10-K", 2023, "FY", "stay", [1.0, 0.0])]), path, 2)
    tables.write_chunks(chunks(spark, [("3", "A", "10-K", 2023, "FY", "new", [1.0, 0.0])]), path, 2)
    got = tables.read_chunks(spark, path)
    assert {(r["chunk_id"], r["text_content"], r["period_of_report"]) for r in got.collect()} == {("3", "new", None), ("2", "stay", None)}
    with pytest.raises(Exception, match="width"):
        tables.write_chunks(chunks(spark, [("4", "A", "10-K", 2023, "FY", "bad", [1.0])]), path, 2)
    merged = tables.upsert_filings(got, chunks(spark, [("9", "B", "10-K", 2023, "FY", "next", [0.0, 1.0])]))
    assert {r["chunk_id"] for r in merged.collect()} == {"3", "9"}
    assert spark.range(1).select(tables.chunk_id(F.lit("A"), F.lit("10-K"), F.lit(2023), F.lit("FY"), F.lit(7))).first()[0] == "A_10-K_2023_FY_00007"


def test_registries_and_indexes(spark, tmp_path):
    path = tmp_path / "funds.json"
    path.write_text(json.dumps({"funds": [{"name": "One", "cik": "1"}, {"name": "None"}]}))
    assert [tuple(r) for r in tables.load_registry(spark, str(path)).collect()] == [("One", "1")]
    path.write_text(json.dumps([{"query": "q", "ticker": "A", "section": "Risk"}, {"query": "r", "ticker": "B", "sections": ["a", "b"]}]))
    assert [r["sections"] for r in tables.load_cases(spark, str(path)).orderBy("case_id").collect()] == [["Risk"], ["a", "b"]]
    assert tables.load_index(spark, str(tmp_path / "nothing")).count() == 0
    rows = spark.createDataFrame([("F", "1", "A", "x", 1.0, 1.0, 100.0, "2024", "new", 0.0), ("G", "1", "B", "y", 1.0, 1.0, 100.0, "2024", "new", 0.0)], tables.HOLDINGS_INDEX)
    tables.save_index(rows, str(tmp_path / "index"))
    assert tables.load_index(spark, str(tmp_path / "index")).count() == 2
    assert tables.index_summary(rows, F.lit("now")).first()["funds"] == 1
    assert tables.csv_lines(rows.select("fund", F.lit(1).alias("level"), "value")).first()["line"] == "F,1.0"


def test_embedding_boundary(spark):
    rows = boundary.embed_texts(spark.createDataFrame([("a b",), ("a b",), (None,)], "t string"), "t", boundary.hash_embedder(8), batch=2).collect()
    assert rows[0]["vector"] == rows[1]["vector"] and sum(x * x for x in rows[0]["vector"]) == pytest.approx(1) and set(rows[2]["vector"]) == {0.0}


def test_stream_of_facts(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    schema = "ticker string, canonical_key string, period_end string, value double, filing_date string"

    def push(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(src)
        q = facts_stream.merge_stream(spark.readStream.schema(schema).parquet(src), out, log)
        q.awaitTermination()
        return {(r["ticker"], r["value"]) for r in Store(spark, out).read().collect()}

    assert push(("A", "revenue", "2023", 1.0, "2024-01-02"), ("B", "revenue", "2023", 1.0, None)) == {("A", 1.0), ("B", 1.0)}
    assert push(("A", "revenue", "2023", 2.0, "2024-01-01")) == {("A", 1.0), ("B", 1.0)}
    assert push(("A", "revenue", "2023", 3.0, "2024-01-02"), ("B", "revenue", "2023", 4.0, "2024-01-01")) == {("A", 3.0), ("B", 4.0)}


def test_store_is_seen_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.read() is None and store.compact() == 0

    store.replace(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, x string"), ["k"])
    store.replace(spark.createDataFrame([(1, "d"), (3, "e")], "k int, x string"), ["k"])
    want = [(1, "d"), (2, "c"), (3, "e")]
    assert sorted(r for r in ((r["k"], r["x"]) for r in store.read().collect()) if r[0]) == want
    store.replace(spark.createDataFrame([(None, "m")], "k int, x string"), ["k"])
    assert [r["x"] for r in store.read().where("k is null").collect()] == ["m"]
    store.replace(spark.createDataFrame([(9, "z")], "k int, x string").where("k < 0"), ["k"])
    # A write that fails leaves the table as it was; a tag is taken once.
    bad = spark.createDataFrame([(2, "bad")], "k int, x string").withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        store.replace(bad, ["k"])
    assert [r for r in ((r["k"], r["x"]) for r in store.read().where("k is not null").orderBy("k").collect())] == want
    store.replace(spark.createDataFrame([(2, "t")], "k int, x string"), ["k"], ("s", 4))
    store.replace(spark.createDataFrame([(2, "u")], "k int, x string"), ["k"], ("s", 4))
    assert (2, "t") in {(r["k"], r["x"]) for r in store.read().collect()}
    # Two writers of one version: the second raises, and its rows are not seen.
    state = store.state()
    store._publish(state | {"version": state["version"] + 1})
    with pytest.raises(Conflict):
        store._publish(state | {"version": state["version"] + 1, "commits": []})
    before = {(r["k"], r["x"]) for r in store.read().collect()}
    store.compact()
    assert store.vacuum() > 5 and {(r["k"], r["x"]) for r in store.read().collect()} == before
    assert len(store.state()["commits"]) == 1
    # A column that comes later is null in older rows.
    store.replace(spark.createDataFrame([(2, "v", 1.5)], "k int, x string, y double"), ["k"])
    assert {(r["k"], r["y"]) for r in store.read().collect()} == {(1, None), (2, 1.5), (3, None), (None, None)}


def test_windowed_counts_on_a_table(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = facts_stream.windowed_counts(events, "ts", "event_type", "value")
    assert got.agg(F.sum("n")).first()[0] == events.count()


def test_catalogue_names_are_unique():
    assert len(catalogue.QUERIES) > 50


def test_vector_index_finds_most_and_holds_all(spark, tmp_path):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    data = [(i, [float(x) for x in centres[i % 12] + 0.4 * rng.normal(size=16)]) for i in range(900)] + [(900, None), (901, [0.0] * 16)]
    rows = spark.createDataFrame(data, "id long, v array<double>")
    index = vector_index.build_index(rows, str(tmp_path / "index"), "id", "v", k=10, trials=40)
    assert {r["item_id"] for r in index.rows(spark).collect()} == set(range(902)) - {900}
    queries = rows.where("id % 50 = 0")
    exact = retrieval.vector_top_k(rows.where("v is not null"), queries.where("v is not null"), 10, "id", "v", "id", "v")
    for broadcast in (10_000, 0):
        found = vector_index.search_index(index, queries, 10, "id", "v", broadcast_rows=broadcast)
        assert vector_index.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    whole = vector_index.search_index(index, queries, 10, "id", "v", probes=1000)
    assert {tuple(r) for r in whole.select("query_id", "item_id", "vec_rank").collect()} == {tuple(r) for r in exact.select("query_id", "item_id", "vec_rank").collect()}
    assert index.probes < len(index.centroids)
    assert vector_index.build_index(rows.limit(100), str(tmp_path / "none"), "id", "v") is None


def test_similar_rows_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for g in ("a", "b", None):
        for f in range(6):
            base = [f"{f}{i}" for i in range(rng.choice([1, 3, 6, 20]))]
            for _ in range(8):
                words = [w if rng.random() > 0.06 else f"x{rng.randrange(30)}" for w in base] + ["common"] * rng.randrange(2)
                rows.append((len(rows), g, words))
    rows += [(len(rows), "a", []), (len(rows) + 1, "a", None)]
    got = {r["item"]: (r["class_id"], r["n_links"]) for r in similarity.similar_rows(spark.createDataFrame(rows, "id long, g string, w array<string>"), "id", "w", ["g"]).collect()}
    sets = {}
    for i, g, w in rows:
        if w:
            sets.setdefault((g, frozenset(w)), i)
    links = {c: sum(g == h and a != b and 100 * len(a & b) >= 80 * len(a | b) for h, b in sets) for (g, a), c in sets.items()}
    assert sum(links.values()) > 20
    assert got == {i: (sets[g, frozenset(w)], links[sets[g, frozenset(w)]]) if w else (None, 0) for i, g, w in rows}


def test_tables_are_cleaned_once_a_batch_and_by_many_tasks(spark):
    """Equal tables are cleaned once a batch, nulls stay, and rows of one small file are dealt over tasks."""
    made = [f"<table><tr><td>{i % 3}0</td></tr></table>" if i % 5 else None for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate(made)), "id long, h string").coalesce(1)
    dealt = html.spread(rows, 500)
    assert dealt.rdd.getNumPartitions() == 6
    want = {i: html.clean_table(h) for i, h in enumerate(made)}
    assert {r["id"]: r["c"] for r in dealt.select("id", html.clean_tables(F.col("h")).alias("c")).collect()} == want


def test_index_search_measures_few_pairs(spark):
    """Of all pairs of a query and the rows of its lists only those near the best ones are measured one by one, and the best are among them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    rows = spark.createDataFrame([(i, [float(c) for c in v], i % 5) for i, v in enumerate(x)], "item_id long, _v array<double>, list int").coalesce(1)
    asked = {q: sorted({q % 5, (q + 1) % 5}) for q in range(0, 600, 50)}
    queries = spark.createDataFrame([(q, [float(c) for c in x[q]], at) for q, at in asked.items()], "query_id long, _q array<double>, _lists array<int>")
    pairs = retrieval.near_pairs(rows, queries, 3, lists=("list", "_lists")).select("query_id", "item_id").collect()
    got = {q: {r["item_id"] for r in pairs if r["query_id"] == q} for q in asked}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, at in asked.items():
        own = [i for i in range(600) if i % 5 in at]
        assert got[q] <= set(own) and set(sorted(own, key=lambda i: -unit[q] @ unit[i])[:3]) <= got[q]
    assert len(pairs) < 12 * 240 / 4


def test_similar_rows_move_no_set_for_each_pair(spark):
    """Near copies meet in blocks and cells that are split; what is shuffled follows the sets, not their pairs."""
    rng = random.Random(4)
    base = [f"word number {i}" for i in range(900)]
    sets = [frozenset(w for w in base if rng.random() > 0.07) | {f"own {i}"} for i in range(70)]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, w array<string>")
    written = lambda: (lambda x: sum(x.apply(i).totalShuffleWrite() for i in range(x.size())))(spark._jsc.sc().statusStore().executorList(False))
    links = [sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in sets) for a in sets]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = written()
        got = {r["item"]: r["n_links"] for r in similarity.similar_rows(rows, "id", "w").collect()}
        moved = written() - began
        split = {r["item"]: r["n_links"] for r in similarity.similar_rows(rows, "id", "w", list_entries=16, cell_pairs=100).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == split == dict(enumerate(links)) and sum(links) > 3000
    assert moved < 8_000_000


@pytest.mark.parametrize(
    "given,want",
    [
        ("<table onclick='x'><tr><td colspan=2 style='a'>1 &lt; 2<script>alert(1)</script></td></tr></table>", '<table><tr><td colspan="2">1 &lt; 2</td></tr></table>'),
        ("<p>a<br/>b<img src=x onerror=y></p>", "a<br>b"),
        ("<svg><td>no</td><svg></svg></svg><span scope='row' class=q>yes", '<span scope="row">yes</span>'),
        ("<td><b>x</td></tr>", "<td>x</td>"),
        ("<iframe><table></iframe>t<!-- c --><object>o", "t"),
        ("<th scope='a\"b'>é&nbsp;</th>", "<th scope=\"a&quot;b\">é\xa0</th>"),
        ("", ""),
        (None, None),
    ],
)
def test_sanitize(given, want):
    assert html.sanitize(given) == want
    assert want is None or html.sanitize(want) == want


@pytest.mark.parametrize("given", ["R&D &am", "a &amp", "&lt;b&gt; &copy=1 &&amp;am", "x & y &nosuch; &#38"])
def test_sanitize_keeps_bare_ampersands(given):
    """Only a reference closed by a semicolon is one; a text cut inside it is not completed."""
    assert html.sanitize(given) == given


def test_texts_are_sent_once(spark, tmp_path):
    """Equal texts cause one call; failures are retried, then sent one by one; what came is kept for the next run, what failed is not."""
    log = tmp_path / "log"
    log.mkdir()

    def call(texts):
        (log / f"{len(list(log.iterdir()))}-{os.getpid()}-{time.time_ns()}").write_text("\n".join(texts))
        if "bad" in texts:
            raise ValueError("bad")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(i, ["a", "b", "bad", None, "c" * 50][i % 5]) for i in range(100)], "id long, t string").coalesce(1)
    kept = boundary.Results(spark, str(tmp_path / "kept"), "string")
    want = {(i, {"a": "A", "b": "B", "c" * 50: "C" * 50}.get(["a", "b", "bad", None, "c" * 50][i % 5])) for i in range(100)}
    for more in (0, 1):
        got = boundary.call_once(rows, "t", call, "out", kept=kept, most_items=10, most_chars=60, retries=1)
        assert {(r["id"], r["out"]) for r in got.collect()} == want
        sent = [p.read_text().split("\n") for p in log.iterdir()]
        assert max(len("".join(s)) for s in sent) <= 60
        fine = [s for s in sent if "bad" not in s]
        assert sorted(x for s in fine for x in s) == ["a", "b", "c" * 50]
        assert sum(s == ["bad"] for s in sent) >= 2 * (more + 1)


def test_new_ids_and_ingest(spark):
    steps = spark.createDataFrame([(1, 1, ["a", "b", "b"]), (1, 2, ["b"]), (1, 3, None), (2, 1, ["b", None]), (1, 4, ["c", "a"])], "run int, step int, ids array<string>")
    assert sorted(tuple(r) for r in retrieval.new_ids(steps, "run", "step", "ids").collect()) == [(1, 1, 2), (1, 2, 0), (1, 3, 0), (1, 4, 1), (2, 1, 1)]


def test_report_as_text(spark):
    cases = spark.createDataFrame([(1, "AB", "what is " + "x" * 60), (2, "LONGERONE", "q")], "case_id int, ticker string, query string")
    ranks = spark.createDataFrame([(1, 2), (2, None)], "case_id int, first_rank int")
    want = ["", "Retrieval eval", "=" * 40, "  rank=  2  AB     what is " + "x" * 46, "  rank=  —  LONGERONE q", "-" * 40, "  n=2  MRR=0.25  hit@1=0.0  hit@3=0.5  hit@5=0.5"]
    assert evaluation.report_text(ranks, cases).first()["text"].split("\n") == want


def test_folders_of_filings_and_registries(spark, tmp_path):
    folders.register(spark)
    path = str(tmp_path / "filings")
    rows = [("10-K", "a", "<p>é"), ("10-K", "b", None), ("8-K", "a", "x" * 100)]
    spark.createDataFrame(rows, "form string, filing_id string, content string").write.format("filing_folder").mode("append").option("path", path).save()
    (tmp_path / "filings" / "10-Q").mkdir()
    (tmp_path / "filings" / "10-Q" / "broken.html").symlink_to(tmp_path / "nowhere")
    source = spark.read.format("filing_folder").option("path", path).option("maxPartitionBytes", 50).load()
    kept = source.where(F.col("form").isin("10-K", "8-K") & (F.col("filing_id") == "a"))
    assert sorted(tuple(r) for r in kept.collect()) == [("10-K", "a", "<p>é"), ("8-K", "a", "x" * 100)]
    assert kept.rdd.getNumPartitions() == 2
    # A job that fails leaves no filing.
    bad = spark.createDataFrame([("10-K", "new", "1"), ("10-K", "a/b", "2")], "form string, filing_id string, content string").coalesce(1)
    with pytest.raises(Exception, match="no file name"):
        bad.write.format("filing_folder").mode("append").option("path", path).save()
    assert source.where(F.col("form") == "10-K").count() == 2
    assert spark.read.format("filing_folder").option("path", str(tmp_path / "none")).load().count() == 0
    funds = tmp_path / "registries"
    funds.mkdir()
    (funds / "one.json").write_text('{"funds": [{"name": "A", "cik": 1}, {"name": "no"}]}\n [{"cik": "2"}]\n{"name": "C", "cik": "3"} 7')
    (funds / "two.json").write_text("")
    got = spark.read.format("fund_registries").option("path", str(funds)).load()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("one", "A", "1"), ("one", None, "2"), ("one", "C", "3")]))
    assert got.where(F.col("registry") == "two").count() == 0


def test_changes_of_closed_days_go_on_after_a_restart(spark, tmp_path):
    """Files that come one by one, with a stop between any two, give the rows of the whole table whose days are closed."""
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = sorted(((rng.choice(["A", "B", None]), start + dt.timedelta(hours=rng.randrange(24 * 9)), rng.randrange(-5, 50)) for _ in range(150)), key=lambda r: r[1])
    schema = spark.createDataFrame([], "ticker string, ts timestamp, amount long").schema
    source = str(tmp_path / "in")
    for part in (rows[:60], rows[60:61], rows[61:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        got = change_stream.run_changes(spark, source, schema, str(tmp_path / "out"), str(tmp_path / "log"), "ticker", "ts", "amount")
    table = change_stream.daily_changes_of_table(spark.createDataFrame(rows, schema), "ticker", "ts", "amount")
    edge = rows[-1][1] - dt.timedelta(days=1)
    want = [tuple(r) for r in table.collect() if dt.datetime.combine(r["day"], dt.time()) + dt.timedelta(days=1) <= edge]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want)) and len(want) > 8


def test_late_rows_of_an_open_day_count(spark, tmp_path):
    """A row behind the watermark counts as long as its day is open, and not when it has closed."""
    schema = spark.createDataFrame([], "ticker string, ts timestamp, amount long").schema
    source = str(tmp_path / "in")
    at = dt.datetime(2024, 1, 1)
    hours = lambda n: at + dt.timedelta(hours=n)
    for part in ([("A", hours(2), 5), ("A", hours(60), 1)], [("A", hours(30), 7), ("A", hours(3), 9)], [("A", hours(100), 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        got = change_stream.run_changes(spark, source, schema, str(tmp_path / "out"), str(tmp_path / "log"), "ticker", "ts", "amount")
    assert sorted((r["day"].day, r["total"], r["previous"]) for r in got.collect()) == [(1, 5, None), (2, 7, 5), (3, 1, 7)]
