"""The query catalogue: every operator applied to the driver's tables, beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import scalars, text, vectors
from ledgerline.functions.html import clean_tables, partition, spread
from ledgerline.operators import catalog, chunking, conversation, evaluation, facts, holdings, retrieval, valuation, watchlist
from ledgerline.plans import nation_year
from ledgerline.sources import tables, taxonomy
from ledgerline.sources.store import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Listings -----------------------------------------------------------------------------------------------------------


@query("SELECT lang, source, count(*) AS chunks FROM documents GROUP BY lang, source")
def corpus_listing(spark, sf):
    return catalog.listing(t(spark, sf, "documents"), ["lang", "source"])


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source DESC) AS members, count(DISTINCT source) AS n_members, sum(n_chars)::BIGINT AS total FROM documents GROUP BY lang")
def corpus_ledger(spark, sf):
    return catalog.ledger(t(spark, sf, "documents"), "lang", "source", "n_chars")


@query("SELECT string_agg(x, '; ' ORDER BY x) AS summary FROM (SELECT lang || ' ' || source || ' (' || count(*) || ' chunks)' AS x FROM documents GROUP BY lang, source)")
def corpus_summary(spark, sf):
    rows = catalog.listing(t(spark, sf, "documents"), ["lang", "source"])
    return catalog.summary_text(rows, F.format_string("%s %s (%d chunks)", "lang", "source", "chunks"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate::DATE AS o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate::DATE >= DATE '1996-01-01' AND o_orderdate::DATE <= DATE '1997-06-30'")
def metadata_filter(spark, sf):
    rows = t(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "cast(o_orderdate as date) as period_of_report")
    return rows.where((F.col("o_orderstatus") == "F") & retrieval.predicate(period_start="1996-01-01", period_end="1997-06-30")).withColumnRenamed("period_of_report", "o_orderdate")


@query("SELECT o_custkey, max(o_orderdate::DATE)::VARCHAR AS latest FROM orders GROUP BY o_custkey")
def latest_scalar(spark, sf):
    return facts.latest_date(t(spark, sf, "orders").selectExpr("o_custkey", "cast(o_orderdate as date) as d"), ["o_custkey"], "d")


@query("SELECT DISTINCT c_mktsegment AS ticker FROM customer")
def distinct_listing(spark, sf):
    return facts.covered(t(spark, sf, "customer").withColumnRenamed("c_mktsegment", "ticker"))


# The fact base --------------------------------------------------------------------------------------------------------

_LINE = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(f"SELECT l_suppkey, l_partkey, l_shipdate::DATE AS l_shipdate, {_LINE} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate::DATE DESC, {', '.join(c + ' DESC' for c in _LINE.split(', '))}) = 1")
def fact_upsert_newest_wins(spark, sf):
    names = _LINE.split(", ")
    rows = t(spark, sf, "lineitem").selectExpr("l_suppkey", "l_partkey", "cast(l_shipdate as date) as l_shipdate", *names)
    return facts.newest_wins(rows, ["l_suppkey", "l_partkey"], "l_shipdate", *(F.desc(c) for c in names))


@query("SELECT o_custkey, yr, total, row_number() OVER (PARTITION BY o_custkey ORDER BY yr DESC)::INTEGER AS period_rank FROM (SELECT o_custkey, year(o_orderdate)::INTEGER AS yr, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY yr DESC) <= 3")
def periods_topn_per_key(spark, sf):
    rows = t(spark, sf, "orders").selectExpr("o_custkey", "year(o_orderdate) as yr", "cast(round(o_totalprice * 100) as bigint) as cents").groupBy("o_custkey", "yr").agg(F.sum("cents").alias("total"))
    return facts.top_periods(rows, ["o_custkey"], "yr", 3)


#: A small taxonomy over part types: first word to a class, with a priority.
CLASSES = (("ECONOMY", "low", 0), ("PROMO", "low", 1), ("SMALL", "size", 0), ("MEDIUM", "size", 1), ("LARGE", "size", 2), ("STANDARD", "plain", 0))


@query(
    "WITH c(w, class, priority) AS (VALUES "
    + ", ".join(f"('{a}', '{b}', {p})" for a, b, p in CLASSES)
    + "), p AS (SELECT p_partkey, p_brand, class, priority, p_type FROM part JOIN c ON split_part(p_type, ' ', 1) = w) SELECT p_brand, class, priority::INTEGER AS priority, p_partkey, p_type FROM p QUALIFY row_number() OVER (PARTITION BY p_brand, class ORDER BY priority, p_partkey) = 1"
)
def priority_dedup(spark, sf):
    table = spark.createDataFrame(CLASSES, "w string, class string, priority int")
    rows = t(spark, sf, "part").withColumn("w", F.substring_index("p_type", " ", 1)).join(F.broadcast(table), "w")
    return facts.best_row(rows, ["p_brand", "class"], F.col("priority"), F.col("p_partkey")).select("p_brand", "class", "priority", "p_partkey", "p_type")


@query("""
    SELECT l_orderkey, l_linenumber, days, CASE WHEN days < 0 THEN 'reversed' WHEN days >= 300 THEN 'annual' WHEN days <= 120 THEN 'quarterly' ELSE 'other' END AS period_class,
           days >= 300 AS annual_kept, days <= 120 AS quarterly_kept, 'Q' || quarter(s) AS calendar_quarter
    FROM (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS s, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::INTEGER AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
""")
def period_classify(spark, sf):
    rows = t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_shipdate as date) as s").join(t(spark, sf, "orders").selectExpr("o_orderkey as l_orderkey", "cast(o_orderdate as date) as o"), "l_orderkey")
    key = scalars.period(F.concat_ws("_", F.lit("duration"), F.col("o").cast("string"), F.col("s").cast("string")))
    rows = rows.withColumn("p", key).withColumn("days", F.datediff("p.period_end", "p.period_start"))
    kind = F.when(F.col("days") < 0, "reversed").when(F.col("days") >= scalars.ANNUAL_MIN_DAYS, "annual").when(F.col("days") <= scalars.QUARTER_MAX_DAYS, "quarterly").otherwise("other")

    def keeps(form: str) -> Column:
        return scalars.keeps_period(F.col("p.period_type"), F.col("p.period_start"), F.col("p.period_end"), F.lit(form))

    return rows.select("l_orderkey", "l_linenumber", "days", kind.alias("period_class"), keeps("10-K").alias("annual_kept"), keeps("10-Q").alias("quarterly_kept"), scalars.filing_quarter(F.lit("10-Q"), F.col("p.period_end")).alias("calendar_quarter"))


@query("""
    WITH s AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) * (100 + round(l_tax * 100)::BIGINT))::DOUBLE / 1000000 AS total FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, total, CASE WHEN abs(total - o_totalprice) <= 0.01e0 * greatest(abs(total), abs(o_totalprice), 1e0) THEN 1e0 ELSE 0.5e0 END AS confidence
    FROM s JOIN orders ON l_orderkey = o_orderkey
""")
def identity_validation(spark, sf):
    def whole(c: str) -> str:
        return f"cast(round({c} * 100) as bigint)"

    sums = t(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.expr(f"sum({whole('l_extendedprice')} * (100 - {whole('l_discount')}) * (100 + {whole('l_tax')}))").cast("double") / 1_000_000).alias("total"))
    rows = sums.join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    good = scalars.close_to(F.col("total"), F.col("o_totalprice"))
    return rows.select("o_orderkey", "total", F.when(good, 1.0).otherwise(0.5).alias("confidence"))


@query(f"""
    WITH {nation_year.SQL}
    SELECT entity, yr, 'gross_profit' AS rule FROM wide WHERE abs((revenue - cost_of_revenue) - gross_profit) > 0.01e0 * greatest(abs(revenue - cost_of_revenue), abs(gross_profit), 1e0)
    UNION ALL
    SELECT entity, yr, 'balance_sheet' FROM (SELECT *, total_assets * 0.55e0 AS total_liabilities FROM wide)
    WHERE abs((total_liabilities + total_equity) - total_assets) > 0.01e0 * greatest(abs(total_liabilities + total_equity), abs(total_assets), 1e0)
""")
def accounting_violations(spark, sf):
    rows = nation_year.facts(spark, sf)
    owed = rows.where("canonical_key = 'total_assets'").withColumns({"canonical_key": F.lit("total_liabilities"), "value": F.col("value") * 0.55})
    return facts.violations(rows.unionByName(owed), ["entity", "yr"]).select("entity", "yr", "rule")


_AXES = """
    WITH b AS (SELECT c_mktsegment, r_name, year(o_orderdate)::INTEGER AS yr, round(o_totalprice * 100)::BIGINT AS cents
               FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    a AS (SELECT 'Geography' AS axis, r_name AS member, yr, sum(cents)::BIGINT AS cents FROM b GROUP BY ALL UNION ALL SELECT 'Operating Segment', c_mktsegment, yr, sum(cents)::BIGINT FROM b GROUP BY ALL)
"""


@query(_AXES + "SELECT axis, member, yr, cents, row_number() OVER (PARTITION BY axis ORDER BY cents DESC, member)::INTEGER AS rank, count(*) OVER (PARTITION BY axis) AS n_members FROM a WHERE yr = (SELECT max(yr) FROM a) QUALIFY row_number() OVER (PARTITION BY axis ORDER BY cents DESC, member) <= 6")
def segment_breakdown(spark, sf):
    places = t(spark, sf, "nation").join(F.broadcast(t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.selectExpr("year(o_orderdate) as yr", "cast(round(o_totalprice * 100) as bigint) as cents", "stack(2, 'us-gaap:StatementGeographicalAxis', r_name, 'us-gaap:StatementBusinessSegmentsAxis', c_mktsegment) as (axis, member)")
    sums = rows.groupBy("axis", "member", "yr").agg(F.sum("cents").alias("cents")).withColumn("axis", scalars.axis_label(F.col("axis"))).withColumn("entity", F.lit("all"))
    return facts.segment_read(sums, "entity", "axis", "member", "yr", "cents").drop("entity")


@query("""
    SELECT ticker, coalesce(core, FALSE) AS covered, CASE WHEN core THEN NULL WHEN core IS NULL THEN 'no financials could be extracted' ELSE 'limited coverage: no revenue reported' END AS message
    FROM (SELECT s_suppkey::VARCHAR AS ticker, bool_or(l_returnflag = 'R') AS core FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey)
""")
def coverage_message(spark, sf):
    seen = t(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("ticker"), F.when(F.col("l_returnflag") == "R", "revenue").otherwise("other").alias("canonical_key"))
    return facts.coverage(t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker")), seen)


# Valuation ------------------------------------------------------------------------------------------------------------


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return valuation.pivot_periods(nation_year.facts(spark, sf), ["entity", "nk", "yr"], [*valuation.KEYS, "price"])


_METRICS = f"""
    WITH {nation_year.SQL},
    m1 AS (SELECT *, operating_cash_flow - capex AS fcf, operating_income + coalesce(depreciation_amortization, 0) AS ebitda, income_tax / nullif(pretax_income, 0) AS effective_tax_rate,
                  CASE WHEN long_term_debt IS NOT NULL OR short_term_debt IS NOT NULL THEN coalesce(long_term_debt, 0) + coalesce(short_term_debt, 0) - coalesce(cash_and_equivalents, 0) - coalesce(short_term_investments, 0) END AS net_debt
           FROM wide),
    m AS (SELECT *, coalesce(gross_profit, revenue - cost_of_revenue) / nullif(revenue, 0) AS gross_margin, operating_income / nullif(revenue, 0) AS operating_margin, net_income / nullif(revenue, 0) AS net_margin,
                 fcf / nullif(revenue, 0) AS fcf_margin, ebitda / nullif(revenue, 0) AS ebitda_margin, net_income / nullif(total_equity, 0) AS roe, net_income / nullif(total_assets, 0) AS roa,
                 operating_income * (1 - coalesce(effective_tax_rate, 0)) / nullif(total_equity + greatest(coalesce(net_debt, 0), 0), 0) AS roic_approx, net_debt / nullif(ebitda, 0) AS net_debt_to_ebitda,
                 current_assets / nullif(current_liabilities, 0) AS current_ratio, operating_income / nullif(interest_expense, 0) AS interest_coverage
          FROM m1),
    pts AS (SELECT entity, k, v, yr, row_number() OVER (PARTITION BY entity, k ORDER BY yr DESC) AS r, row_number() OVER (PARTITION BY entity, k ORDER BY yr) AS q, count(*) OVER (PARTITION BY entity, k) AS n
            FROM (UNPIVOT (SELECT entity, yr, revenue, net_income, operating_income FROM wide) ON revenue, net_income, operating_income INTO NAME k VALUE v) WHERE v IS NOT NULL),
    g AS (SELECT entity, k, (max(v) FILTER (r = 1) - max(v) FILTER (r = 2)) / nullif(abs(max(v) FILTER (r = 2)), 0) AS yoy,
                 CASE WHEN max(n) >= 2 AND max(v) FILTER (q = 1) > 0 AND max(v) FILTER (r = 1) > 0 THEN pow(max(v) FILTER (r = 1) / max(v) FILTER (q = 1), 1e0 / (max(n) - 1)) - 1 END AS cagr
          FROM pts GROUP BY entity, k),
    tr AS (SELECT e.entity, max(yoy) FILTER (k = 'revenue') AS revenue_growth_yoy, max(yoy) FILTER (k = 'net_income') AS net_income_growth_yoy, max(yoy) FILTER (k = 'operating_income') AS operating_income_growth_yoy, max(cagr) FILTER (k = 'revenue') AS revenue_cagr,
                  max(cagr) FILTER (k = 'net_income') AS net_income_cagr, max(cagr) FILTER (k = 'operating_income') AS operating_income_cagr
           FROM (SELECT DISTINCT entity FROM wide) e LEFT JOIN g USING (entity) GROUP BY e.entity),
    l AS (SELECT m.*, tr.* EXCLUDE (entity), least(greatest(coalesce(revenue_cagr, 0.04e0), -0.05e0), 0.2e0) AS growth_used, coalesce(nullif(shares_outstanding, 0), nullif(shares_diluted, 0)) AS shares_used
          FROM m JOIN tr USING (entity) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY yr DESC) = 1),
    d AS (SELECT entity, k, CASE WHEN fcf > 0 AND shares_used > 0 THEN
                 (fcf * (1 + gr) / 1.09e0 + fcf * pow(1 + gr, 2) / pow(1.09e0, 2) + fcf * pow(1 + gr, 3) / pow(1.09e0, 3) + fcf * pow(1 + gr, 4) / pow(1.09e0, 4) + fcf * pow(1 + gr, 5) / pow(1.09e0, 5)
                  + fcf * pow(1 + gr, 5) * 1.025e0 / (0.09e0 - 0.025e0) / pow(1.09e0, 5) - coalesce(net_debt, 0)) / shares_used END AS dcf
          FROM (SELECT *, 'base' AS k, growth_used AS gr FROM l UNION ALL SELECT *, 'low', greatest(growth_used - 0.03e0, -0.05e0) FROM l UNION ALL SELECT *, 'high', least(growth_used + 0.03e0, 0.2e0) FROM l)),
    dd AS (SELECT entity, max(dcf) FILTER (k = 'base') AS dcf_base, max(dcf) FILTER (k = 'low') AS dcf_low, max(dcf) FILTER (k = 'high') AS dcf_high FROM d GROUP BY entity),
    v AS (SELECT l.*, dcf_base, dcf_low, dcf_high, (dcf_base - price) / nullif(price, 0) AS dcf_upside, price * shares_used AS market_cap, price * shares_used + coalesce(net_debt, 0) AS enterprise_value,
                 price * shares_used / nullif(net_income, 0) AS pe, (price * shares_used + coalesce(net_debt, 0)) / nullif(ebitda, 0) AS ev_ebitda, price * shares_used / nullif(fcf, 0) AS p_fcf, price * shares_used / nullif(revenue, 0) AS p_s,
                 fcf / nullif(price * shares_used, 0) AS fcf_yield
          FROM l JOIN dd USING (entity))
"""


@query(f"WITH {nation_year.SQL} SELECT entity, yr, {', '.join(nation_year.ITEMS)} FROM wide")
def period_pivot(spark, sf):
    return _wide(spark, sf).select("entity", "yr", *nation_year.ITEMS)


@query(_METRICS + f"SELECT entity, yr, {', '.join(f'round({k}, 6) AS {k}' for k in valuation.METRICS)} FROM m")
def period_metrics(spark, sf):
    return rounded(valuation.period_metrics(_wide(spark, sf)), 6, *valuation.METRICS).select("entity", "yr", *valuation.METRICS)


_TRENDS = ("revenue_growth_yoy", "net_income_growth_yoy", "operating_income_growth_yoy", "revenue_cagr", "net_income_cagr", "operating_income_cagr")


@query(_METRICS + f"SELECT entity, {', '.join(f'round({k}, 6) AS {k}' for k in _TRENDS)} FROM tr")
def growth_trends(spark, sf):
    return rounded(valuation.trends(_wide(spark, sf), "entity", "yr"), 6, *_TRENDS)


def _valued(spark: SparkSession, sf: str) -> DataFrame:
    """Newest year of each nation with metrics, trends, multiples and cash-flow value; computed once for all that goes on from it."""
    wide = kept(_wide(spark, sf), "nation-years")
    latest = facts.top_periods(valuation.period_metrics(wide), ["entity"], "yr", 1)
    return kept(valuation.valuation(latest.join(valuation.trends(wide, "entity", "yr"), "entity")), "valued")


_MULTIPLES = ("market_cap", "enterprise_value", "pe", "ev_ebitda", "p_fcf", "p_s", "fcf_yield")


@query(_METRICS + f"SELECT entity, yr, {', '.join(f'round({k}, 5) AS {k}' for k in _MULTIPLES)} FROM v")
def valuation_multiples(spark, sf):
    return rounded(_valued(spark, sf), 5, *_MULTIPLES).select("entity", "yr", *_MULTIPLES)


@query(_METRICS + "SELECT entity, round(growth_used, 6) AS growth_used, round(dcf_base, 6) AS dcf_base, round(dcf_low, 6) AS dcf_low, round(dcf_high, 6) AS dcf_high, round(dcf_upside, 6) AS dcf_upside FROM v")
def dcf_range(spark, sf):
    names = ("growth_used", "dcf_base", "dcf_low", "dcf_high", "dcf_upside")
    return rounded(_valued(spark, sf), 6, *names).select("entity", *names)


@query(_METRICS + "SELECT entity, CASE WHEN dcf_upside >= 0.2e0 THEN 'cheap' WHEN dcf_upside <= -0.2e0 THEN 'expensive' WHEN dcf_upside IS NOT NULL THEN 'fair' END AS verdict FROM v")
def verdict_bucket(spark, sf):
    return _valued(spark, sf).select("entity", scalars.verdict(F.col("dcf_upside")).alias("verdict"))


def _pct(c: str) -> str:
    return f"printf('%.1f', {c} * 100) || '%'"


def _mult(c: str) -> str:
    return f"printf('%.1f', {c}) || 'x'"


def _or_na(c: str, shown: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'n/a' ELSE {shown} END"


def _usd(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'n/a' WHEN abs({c}) >= 1e9 THEN '$' || printf('%.1f', {c} / 1e9) || 'B' WHEN abs({c}) >= 1e6 THEN '$' || printf('%.1f', {c} / 1e6) || 'M' ELSE '$' || format('{{:,}}', round({c})::BIGINT) END"


_SIGNALS = f""",
    s AS (
        SELECT entity, 0 AS o, 'profitability' AS dimension, 'bull' AS direction, 'High net margin' AS label, 'net margin ' || {_pct("net_margin")} AS detail FROM v WHERE net_margin >= 0.15e0
        UNION ALL SELECT entity, 1, 'profitability', 'bear', 'Thin net margin', 'net margin ' || {_pct("net_margin")} FROM v WHERE net_margin < 0.05e0
        UNION ALL SELECT entity, 2, 'returns', 'bull', 'Strong returns on capital', 'ROIC≈ ' || {_pct("roic_approx")} FROM v WHERE roic_approx >= 0.15e0
        UNION ALL SELECT entity, 3, 'returns', 'bear', 'Low returns on capital', 'ROIC≈ ' || {_pct("roic_approx")} FROM v WHERE roic_approx < 0.08e0
        UNION ALL SELECT entity, 4, 'cash_flow', 'bull', 'Strong free cash flow', 'FCF margin ' || {_pct("fcf_margin")} FROM v WHERE fcf_margin >= 0.1e0
        UNION ALL SELECT entity, 5, 'cash_flow', 'bear', 'Burning cash', 'FCF margin ' || {_pct("fcf_margin")} FROM v WHERE fcf_margin < 0
        UNION ALL SELECT entity, 6, 'balance_sheet', 'bull', 'Low leverage', 'net debt/EBITDA ' || {_mult("net_debt_to_ebitda")} FROM v WHERE net_debt_to_ebitda <= 1
        UNION ALL SELECT entity, 7, 'balance_sheet', 'bear', 'Elevated leverage', 'net debt/EBITDA ' || {_mult("net_debt_to_ebitda")} FROM v WHERE net_debt_to_ebitda > 3
        UNION ALL SELECT entity, 8, 'balance_sheet', 'neutral', 'Current ratio below 1', 'current ratio ' || printf('%.2f', current_ratio) || 'x' FROM v WHERE current_ratio < 1
        UNION ALL SELECT entity, 9, 'growth', 'bull', 'Double-digit revenue growth', 'revenue +' || {_pct("revenue_growth_yoy")} || ' YoY' FROM v WHERE revenue_growth_yoy >= 0.1e0
        UNION ALL SELECT entity, 10, 'growth', 'bear', 'Revenue declining', 'revenue ' || {_pct("revenue_growth_yoy")} || ' YoY' FROM v WHERE revenue_growth_yoy < 0
        UNION ALL SELECT entity, 11, 'growth', 'neutral', 'Slow revenue growth', 'revenue +' || {_pct("revenue_growth_yoy")} || ' YoY' FROM v WHERE revenue_growth_yoy >= 0 AND revenue_growth_yoy < 0.03e0
        UNION ALL SELECT entity, 12, 'growth', 'bear', 'Decelerating growth', 'YoY ' || {_pct("revenue_growth_yoy")} || ' below ' || {_pct("revenue_cagr")} || ' CAGR' FROM v WHERE revenue_cagr > 0 AND revenue_growth_yoy < revenue_cagr - 0.02e0
        UNION ALL SELECT entity, 13, 'valuation', 'bull', 'Trades below DCF value', '~' || printf('%.0f', dcf_upside * 100) || '% upside to intrinsic' FROM v WHERE dcf_upside >= 0.2e0
        UNION ALL SELECT entity, 14, 'valuation', 'bear', 'Trades above DCF value', '~' || printf('%.0f', -dcf_upside * 100) || '% above intrinsic' FROM v WHERE dcf_upside <= -0.2e0
        UNION ALL SELECT entity, 15, 'valuation', 'bear', 'Low FCF yield', 'FCF yield ' || {_pct("fcf_yield")} FROM v WHERE fcf_yield < 0.03e0)
"""


@query(_METRICS + _SIGNALS + "SELECT entity, (row_number() OVER (PARTITION BY entity ORDER BY o) - 1)::INTEGER AS pos, dimension, direction, label, detail FROM s")
def rule_signals(spark, sf):
    return valuation.signal_rows(_valued(spark, sf), ["entity"])


def _sql_lines(direction: str, mark: str) -> str:
    return f"string_agg('  {mark} ' || label || ' (' || detail || ')', chr(10) ORDER BY o) FILTER (direction = '{direction}')"


_WATCH_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in valuation.WATCH.items())


@query(_METRICS + _SIGNALS + f""", w AS (SELECT entity, dimension, min(o) AS o FROM s WHERE direction = 'bear' GROUP BY ALL),
    x AS (SELECT entity, string_agg('  • ' || CASE dimension {_WATCH_SQL} END, chr(10) ORDER BY o) AS watch FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY entity ORDER BY o) <= 3) GROUP BY entity),
    y AS (SELECT entity, {_sql_lines("bull", "+")} AS bull, {_sql_lines("bear", "-")} AS bear, {_sql_lines("neutral", "·")} AS neutral FROM s GROUP BY entity),
    z AS (SELECT v.*, bull, bear, neutral, coalesce(watch, CASE WHEN bull IS NOT NULL THEN '  • {valuation.WATCH_BULLS}' END) AS watch FROM v LEFT JOIN y USING (entity) LEFT JOIN x USING (entity))
    SELECT entity, concat_ws(chr(10), entity || ' — investment thesis scaffold (heuristic signals on filed numbers, latest ' || yr || '):', 'BULL:', coalesce(bull, '  (none flagged)'), 'BEAR:', coalesce(bear, '  (none flagged)'),
           'WATCH:' || chr(10) || neutral,
           CASE WHEN dcf_base IS NOT NULL THEN 'VALUATION: ' || coalesce('price $' || printf('%.2f', price) || ', ', '') || 'DCF intrinsic $' || printf('%.2f', dcf_base) || ' (range $' || printf('%.2f', dcf_low) || '–$' || printf('%.2f', dcf_high) || ') — trading ' || CASE WHEN coalesce(dcf_upside, 0) > 0 THEN 'below' ELSE 'above' END || ' the DCF estimate.' END,
           'WHAT WOULD CHANGE THE VIEW:' || chr(10) || watch,
           '(Heuristic flags on filed figures — qualitative context (moat, risks) and the final judgment are layered on top; not investment advice.)') AS text
    FROM z""")
def thesis_scaffold(spark, sf):
    valued = _valued(spark, sf)
    return valuation.thesis(valued, valuation.signal_rows(valued, ["entity"]), "entity", "yr")


@query(_METRICS + f""",
    h AS (SELECT entity, max(v) FILTER (k = 'revenue' AND r = 1) AS rev, max(v) FILTER (k = 'net_income' AND r = 1) AS net, max(n) FILTER (k = 'revenue') AS points,
                 string_agg(yr || ': ' || {_usd("v")}, ', ' ORDER BY r) FILTER (k = 'revenue' AND r <= 4) AS past FROM pts GROUP BY entity)
    SELECT entity, concat_ws(chr(10), entity || ' — structured financials (from XBRL filings), latest period ' || yr || ':',
           '  Revenue ' || {_usd("rev")} || ' | Net income ' || {_usd("net")} || ' | FCF ' || {_usd("fcf")} || ' | EBITDA ' || {_usd("ebitda")},
           '  Margins — gross ' || {_or_na("gross_margin", _pct("gross_margin"))} || ', operating ' || {_or_na("operating_margin", _pct("operating_margin"))} || ', net ' || {_or_na("net_margin", _pct("net_margin"))} || ', FCF ' || {_or_na("fcf_margin", _pct("fcf_margin"))},
           '  Returns — ROE ' || {_or_na("roe", _pct("roe"))} || ', ROA ' || {_or_na("roa", _pct("roa"))} || ', ROIC≈ ' || {_or_na("roic_approx", _pct("roic_approx"))},
           '  Balance — net debt ' || {_usd("net_debt")} || ', net-debt/EBITDA ' || {_or_na("net_debt_to_ebitda", _mult("net_debt_to_ebitda"))} || ', current ratio ' || {_or_na("current_ratio", _mult("current_ratio"))},
           '  Growth — revenue YoY ' || {_or_na("revenue_growth_yoy", _pct("revenue_growth_yoy"))} || ', revenue CAGR ' || {_or_na("revenue_cagr", _pct("revenue_cagr"))} || ', net income YoY ' || {_or_na("net_income_growth_yoy", _pct("net_income_growth_yoy"))},
           CASE WHEN points > 1 THEN '  Revenue history — ' || past END) AS text
    FROM v JOIN h USING (entity)""")
def fundamentals_text(spark, sf):
    wide = _wide(spark, sf)
    latest = facts.top_periods(valuation.period_metrics(wide), ["entity"], "yr", 1)
    return valuation.fundamentals_text(latest, wide, "entity", "yr")


@query(_METRICS + f"""
    SELECT entity, concat_ws(chr(10), entity || ' — valuation (latest period ' || yr || '):',
           CASE WHEN price IS NULL THEN '  Price unavailable — multiples skipped (fundamentals + DCF only).' ELSE '  Price $' || printf('%.2f', price) || ' | Market cap ' || {_usd("market_cap")} || ' | EV ' || {_usd("enterprise_value")} END,
           CASE WHEN price IS NOT NULL THEN '  Multiples — P/E ' || {_or_na("pe", _mult("pe"))} || ', EV/EBITDA ' || {_or_na("ev_ebitda", _mult("ev_ebitda"))} || ', P/FCF ' || {_or_na("p_fcf", _mult("p_fcf"))} || ', P/S ' || {_or_na("p_s", _mult("p_s"))} || ', FCF yield ' || {_or_na("fcf_yield", _pct("fcf_yield"))} END,
           CASE WHEN dcf_base IS NOT NULL THEN '  DCF intrinsic value $' || printf('%.2f', dcf_base) || '/share (range $' || printf('%.2f', dcf_low) || '–$' || printf('%.2f', dcf_high) || ')' END,
           CASE WHEN dcf_base IS NOT NULL THEN '  DCF assumptions — 5y, growth ' || {_pct("growth_used")} || ', discount 9.0%, terminal 2.5%' || coalesce('; upside vs price ' || {_pct("dcf_upside")}, '') END,
           CASE WHEN dcf_base IS NOT NULL THEN '  (DCF is a transparent scaffold on stated assumptions — not a recommendation.)' END) AS text
    FROM v""")
def valuation_text(spark, sf):
    return valuation.valuation_text(_valued(spark, sf), "entity", "yr")


@query(_METRICS + """, b AS (SELECT entity, max(yr) AS latest_period, list(yr ORDER BY yr DESC) AS periods, list(round(net_margin, 6) ORDER BY yr DESC) AS margins FROM m GROUP BY entity)
    SELECT entity, latest_period, array_to_string(periods, ',') AS periods, array_to_string(list_transform(margins, lambda x: CASE WHEN x IS NULL THEN '-' ELSE printf('%.4f', x) END), ',') AS margins, round(revenue_cagr, 6) AS revenue_cagr, round(net_income_cagr, 6) AS net_income_cagr FROM b JOIN tr USING (entity)""")
def metrics_bundle(spark, sf):
    rows = valuation.metrics_bundle(_wide(spark, sf), "entity", "yr")
    margin = F.transform("periods", lambda p: F.round(F.element_at("per_period", p)["net_margin"], 6))
    margins = F.array_join(F.transform(margin, lambda x: F.when(x.isNull(), "-").otherwise(scalars.fixed(x, 4))), ",")
    return rows.select("entity", "latest_period", F.array_join(F.transform("periods", lambda p: p.cast("string")), ",").alias("periods"), margins.alias("margins"), *(F.round(F.col("trends")[c], 6).alias(c) for c in ("revenue_cagr", "net_income_cagr")))


@query(_AXES + f""", k AS (SELECT axis, member, cents::DOUBLE / 100 AS v, yr, row_number() OVER (PARTITION BY axis ORDER BY cents DESC, member) AS rank, count(*) OVER (PARTITION BY axis) AS n FROM a WHERE yr = (SELECT max(yr) FROM a)),
    l AS (SELECT axis, max(yr) AS yr, '  ' || axis || ': ' || string_agg(member || ' ' || {_usd("v")}, ', ' ORDER BY rank) FILTER (rank <= 3) || CASE WHEN max(n) > 3 THEN ' (+' || (max(n) - 3) || ' more)' ELSE '' END AS line FROM k GROUP BY axis)
    SELECT 'all' AS entity, 'Revenue by segment (' || max(yr) || '; as reported, may include subtotals):' || chr(10) || string_agg(line, chr(10) ORDER BY axis) AS text FROM l""")
def segments_text(spark, sf):
    rows = segment_breakdown(spark, sf).withColumn("entity", F.lit("all")).withColumn("value", F.col("cents").cast("double") / 100)
    return valuation.segments_text(rows, "entity", "axis", "member", "value", F.col("yr"), 3)


@query(f"""
    WITH {nation_year.SQL},
    c AS (SELECT *, net_income / nullif(revenue, 0) AS nm, price * qty_ / nullif(net_income, 0) AS pe, list_sort(list_filter([CASE WHEN net_income / nullif(revenue, 0) >= 0.15e0 THEN 'high margin' END, CASE WHEN price IS NULL THEN 'no price' END, CASE WHEN revenue > lag(revenue) OVER (PARTITION BY entity ORDER BY yr) THEN 'growing' END], lambda x: x IS NOT NULL)) AS labels
          FROM (SELECT *, shares_outstanding AS qty_ FROM wide)),
    j AS (SELECT n.entity, n.yr, n.nm, o.nm AS onm, n.pe, o.pe AS ope, n.labels, o.labels AS olabels FROM c n JOIN c o ON n.entity = o.entity AND n.yr = (SELECT max(yr) FROM c) AND o.yr = n.yr - 1),
    u AS (SELECT entity, 0 AS o, '' AS s, 'P/E' AS change FROM j WHERE abs(pe - ope) / greatest(abs(ope), abs(pe), 1e-9) >= 0.05e0
          UNION ALL SELECT entity, 1, '', 'Net margin' FROM j WHERE abs(nm - onm) / greatest(abs(onm), abs(nm), 1e-9) >= 0.05e0
          UNION ALL SELECT entity, 2, x, 'New signal: ' || x FROM (SELECT entity, unnest(list_filter(labels, lambda x: NOT list_contains(olabels, x))) AS x FROM j)
          UNION ALL SELECT entity, 3, x, 'Cleared: ' || x FROM (SELECT entity, unnest(list_filter(olabels, lambda x: NOT list_contains(labels, x))) AS x FROM j)
          UNION ALL SELECT entity, 4, '', 'New filing ingested (' || yr || '-12-31)' FROM j)
    SELECT entity, (row_number() OVER (PARTITION BY entity ORDER BY o, s) - 1)::INTEGER AS pos, change FROM u
""")
def snapshot_diff(spark, sf):
    wide = _wide(spark, sf)
    before = wide.select("entity", (F.col("yr") + 1).alias("yr"), F.col("revenue").alias("old"))
    rows = wide.join(before, ["entity", "yr"], "left")
    margin = scalars.safe_div(F.col("net_income"), F.col("revenue"))
    labels = F.array_compact(F.array(F.when(margin >= 0.15, "high margin"), F.when(F.col("price").isNull(), "no price"), F.when(F.col("revenue") > F.col("old"), "growing")))
    none = F.lit(None).cast("double")
    shots = rows.select("entity", "yr", scalars.safe_div(F.col("price") * F.col("shares_outstanding"), F.col("net_income")).alias("pe"), none.alias("dcf_upside"), margin.alias("net_margin"), none.alias("revenue_growth_yoy"), none.alias("net_debt_to_ebitda"), labels.alias("signal_labels"), F.make_date("yr", F.lit(12), F.lit(31)).alias("ingested_filing_date"))
    last = rows.agg(F.max("yr")).first()[0]
    found = watchlist.changes(shots.where(F.col("yr") == last).drop("yr"), shots.where(F.col("yr") == last - 1).drop("yr"), "entity")
    return found.withColumn("change", F.regexp_replace("change", r"^(P/E|Net margin) .*$", "$1"))


@query(_METRICS + _SIGNALS + """SELECT v.entity, CASE WHEN dcf_upside >= 0.2e0 THEN 'cheap' WHEN dcf_upside <= -0.2e0 THEN 'expensive' WHEN dcf_upside IS NOT NULL THEN 'fair' END AS verdict, coalesce(f.labels, '') AS labels, round(revenue, 2) AS revenue
    FROM v LEFT JOIN (SELECT entity, string_agg(label, ',' ORDER BY label) AS labels FROM s WHERE dimension <> 'valuation' GROUP BY entity) f USING (entity)""")
def dashboard_rows(spark, sf):
    valued = _valued(spark, sf)
    rows = watchlist.dashboard(valued, valuation.signal_rows(valued, ["entity"]), key="entity")
    return rows.select("entity", "verdict", F.coalesce(F.array_join("signal_labels", ","), F.lit("")).alias("labels"), F.round("revenue", 2).alias("revenue"))


# Holdings -------------------------------------------------------------------------------------------------------------

_BOOK = """
    WITH l AS (SELECT l_suppkey AS fund, p_brand AS brand, year(l_shipdate) * 10 + quarter(l_shipdate) AS q, round(l_extendedprice * 100)::BIGINT AS cents, round(l_quantity)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
"""


def _books(spark: SparkSession, sf: str) -> DataFrame:
    """Positions in cents and pieces by supplier, brand and quarter."""
    parts = t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    rows = t(spark, sf, "lineitem").selectExpr("l_partkey", "l_suppkey as fund", "year(l_shipdate) * 10 + quarter(l_shipdate) as q", "cast(round(l_extendedprice * 100) as bigint) as cents", "cast(round(l_quantity) as bigint) as n")
    return rows.join(parts, F.col("l_partkey") == F.col("p_partkey"))


@query(_BOOK + "p AS (SELECT fund, brand, sum(cents)::DOUBLE AS value, sum(n)::DOUBLE AS shares FROM l GROUP BY ALL), r AS (SELECT *, sum(value) OVER w AS total_value, count(*) OVER w AS total_holdings, row_number() OVER (PARTITION BY fund ORDER BY value DESC, brand) AS rank FROM p WINDOW w AS (PARTITION BY fund)) SELECT fund, brand, value, shares, total_value, total_holdings, rank::INTEGER AS rank, round(value * 100 / total_value, 2) AS pct FROM r WHERE rank <= 10")
def fund_topn(spark, sf):
    merged = holdings.merge_positions(_books(spark, sf), ["fund"], "brand", F.col("cents").cast("double"), F.col("n").cast("double"))
    return holdings.fund_top(merged, ["fund"], "brand", 10)


_CHANGES = (
    _BOOK
    + """p AS (SELECT fund, brand, q, sum(cents)::DOUBLE AS value, sum(n)::DOUBLE AS shares FROM l GROUP BY ALL),
    k AS (SELECT *, dense_rank() OVER (PARTITION BY fund ORDER BY q DESC) AS qr FROM p),
    b AS (SELECT coalesce(c.fund, o.fund) AS fund, coalesce(c.brand, o.brand) AS brand, coalesce(c.value, 0) AS value, coalesce(c.shares, 0) AS shares, coalesce(o.shares, 0) AS prev_shares
          FROM (SELECT * FROM k WHERE qr = 1) c FULL JOIN (SELECT * FROM k WHERE qr = 2) o ON c.fund = o.fund AND c.brand = o.brand),
    ch AS (SELECT *, round(coalesce(value * 100 / nullif(sum(value) OVER (PARTITION BY fund), 0), 0), 2) AS pct,
                  CASE WHEN prev_shares <= 0 AND shares > 0 THEN 'new' WHEN shares <= 0 AND prev_shares > 0 THEN 'exited' WHEN shares > prev_shares THEN 'added' WHEN shares < prev_shares THEN 'trimmed' ELSE 'unchanged' END AS change FROM b)
"""
)


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    merged = holdings.merge_positions(_books(spark, sf), ["fund", "q"], "brand", F.col("cents").cast("double"), F.col("n").cast("double"))
    return holdings.position_changes(holdings.latest_two(merged, ["fund"], "q"), ["fund"], "brand")


@query(_CHANGES + "SELECT fund, brand, value, shares, prev_shares, pct, change FROM ch")
def position_changes(spark, sf):
    return _changes(spark, sf)


@query(_CHANGES + "SELECT fund, brand AS ticker, value, shares, prev_shares, pct, change, change = 'exited' AS is_exit FROM ch WHERE upper(brand) = 'BRAND#12'")
def holders_of_brand(spark, sf):
    return holdings.holders(_changes(spark, sf).withColumnRenamed("brand", "ticker"), " brand#12 ")


@query(_CHANGES + "SELECT brand, count(*) FILTER (change <> 'exited') AS holders, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'trimmed') AS trimmed, count(*) FILTER (change = 'exited') AS exited, sum(value) AS value FROM ch GROUP BY brand")
def ownership_summary(spark, sf):
    return holdings.ownership_summary(_changes(spark, sf), ["brand"])


@query(_CHANGES + """
    SELECT brand AS ticker, concat_ws(chr(10), 'Tracked funds holding ' || brand || ' (as of 2024-03-31):',
           string_agg('  ' || fund || ': $' || format('{:,}', value::BIGINT) || ', ' || format('{:,}', shares::BIGINT) || ' sh (' || printf('%.1f', pct) || '% of book)' || CASE WHEN change <> 'unchanged' THEN ' [' || change || ']' ELSE '' END, chr(10) ORDER BY value DESC, fund) FILTER (change <> 'exited' AND h <= 12),
           string_agg('  ' || fund || ': EXITED (held ' || format('{:,}', prev_shares::BIGINT) || ' sh prior quarter)', chr(10) ORDER BY value DESC, fund) FILTER (change = 'exited' AND h <= 12)) AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY brand, change = 'exited' ORDER BY value DESC, fund) AS h FROM ch) GROUP BY brand
""")
def ownership_text(spark, sf):
    return holdings.ownership_text(_changes(spark, sf).withColumnRenamed("brand", "ticker"), "ticker", "fund", F.lit("2024-03-31T10:00:00Z"))


@query(_BOOK + """p AS (SELECT fund, brand, sum(cents)::DOUBLE AS value FROM l GROUP BY ALL), r AS (SELECT *, sum(value) OVER w AS tv, count(*) OVER w AS n, row_number() OVER (PARTITION BY fund ORDER BY value DESC, brand) AS rank, round(value * 100 / sum(value) OVER w, 2) AS pct FROM p WINDOW w AS (PARTITION BY fund))
    SELECT fund, fund || ' 13F holdings as of 2024-03-31: ' || max(n) || ' positions, $' || format('{:,}', max(tv)::BIGINT) || ' total. Top holdings:' || chr(10) || string_agg('  ' || brand || ': $' || format('{:,}', value::BIGINT) || ' (' || printf('%.1f', pct) || '%)', chr(10) ORDER BY rank) FILTER (rank <= 10) AS text FROM r GROUP BY fund""")
def fund_text(spark, sf):
    merged = holdings.merge_positions(_books(spark, sf), ["fund"], "brand", F.col("cents").cast("double"), F.col("n").cast("double"))
    return holdings.fund_text(holdings.fund_top(merged, ["fund"], "brand", 25), "fund", F.col("brand"), F.lit("2024-03-31"))


_TRADES = "SELECT l_suppkey, l_shipdate::DATE::VARCHAR AS d, l_orderkey, l_linenumber, l_partkey, l_quantity AS shares, l_extendedprice AS price, CASE l_returnflag WHEN 'N' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'other' END AS side, l_returnflag AS code FROM lineitem"


@query(f"""WITH t AS ({_TRADES}), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY d DESC, l_orderkey, l_linenumber, l_partkey, shares, price) AS r FROM t),
    g AS (SELECT l_suppkey, count(*) FILTER (side = 'buy') AS b, count(*) FILTER (side = 'sell') AS s, coalesce(sum(shares) FILTER (side = 'buy'), 0)::BIGINT AS bs, coalesce(sum(shares) FILTER (side = 'sell'), 0)::BIGINT AS ss,
          string_agg('  ' || d || ' Order ' || l_orderkey || ' (line ' || l_linenumber || ') ' || upper(side) || ' ' || format('{{:,}}', shares::BIGINT) || ' sh @ $' || format('{{:,.2f}}', price) || ' [' || code || ']', chr(10) ORDER BY r) FILTER (r <= 8) AS lines FROM k GROUP BY l_suppkey)
    SELECT l_suppkey, l_suppkey || ' insider activity (recent Form 4s): ' || b || ' open-market buys (' || format('{{:,}}', bs) || ' sh), ' || s || ' sells (' || format('{{:,}}', ss) || ' sh), net ' || format('{{:,}}', bs - ss) || ' sh.' || chr(10) || lines AS text FROM g""")
def insider_text(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("code", F.when(F.col("l_returnflag") == "N", "P").when(F.col("l_returnflag") == "R", "S").otherwise("G")).selectExpr("*", "l_quantity as shares", "l_extendedprice as price", "l_extendedprice as value", "cast(cast(l_shipdate as date) as string) as date")
    trades = holdings.insider_rows(rows).withColumns({"insider": F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")), "position": F.concat(F.lit("line "), F.col("l_linenumber").cast("string")), "description": F.col("l_returnflag")})
    newest = -F.unix_date(F.col("date").cast("date"))
    return holdings.insider_text(trades, "l_suppkey", [newest, *(F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "shares", "price"))])


def _refreshed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers and some unknown funds as the registry; a seventh of the suppliers report a value that cannot be read."""
    registry = t(spark, sf, "supplier").select(F.explode(F.array("s_suppkey", F.when(F.col("s_suppkey") % 10 == 0, -F.col("s_suppkey")))).alias("cik")).where("cik is not null")
    source = t(spark, sf, "lineitem").join(t(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    bad = (F.col("l_suppkey") % 7 == 3) & (F.col("l_linenumber") == 1)
    raw = source.select(F.col("l_suppkey").alias("cik"), F.expr("year(l_shipdate) * 10 + quarter(l_shipdate)").alias("report_period"), F.lit(" ").alias("Cusip"), F.col("p_brand").alias("Ticker"), F.lit("unnamed").alias("Issuer"), F.when(bad, "n/a").otherwise(F.expr("cast(cast(round(l_extendedprice * 100) as bigint) as string)")).alias("Value"), F.expr("cast(cast(round(l_quantity) as bigint) as string)").alias("SharesPrnAmount"))
    return holdings.refresh_index(registry, kept(holdings.source_rows(raw), "holdings-source"))


_REFRESHED = """
    WITH r AS (SELECT s_suppkey AS cik FROM supplier UNION ALL SELECT -s_suppkey FROM supplier WHERE s_suppkey % 10 = 0),
    f AS (SELECT l_suppkey AS cik, p_brand AS position, year(l_shipdate) * 10 + quarter(l_shipdate) AS q, l_suppkey % 7 = 3 AND l_linenumber = 1 AS bad, round(l_extendedprice * 100)::BIGINT AS cents, round(l_quantity)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey),
    k AS (SELECT *, dense_rank() OVER (PARTITION BY cik ORDER BY q DESC) AS qr FROM f QUALIFY dense_rank() OVER (PARTITION BY cik ORDER BY q DESC) <= 2),
    u AS (SELECT cik FROM k GROUP BY cik HAVING bool_or(bad)),
    e AS (SELECT cik, 'a value cannot be read' AS error FROM u UNION ALL SELECT cik, 'no 13F' FROM r WHERE cik NOT IN (SELECT cik FROM f)),
    i AS (SELECT cik, position, coalesce(sum(cents) FILTER (qr = 1), 0)::DOUBLE AS value, coalesce(sum(n) FILTER (qr = 1), 0)::DOUBLE AS shares, coalesce(sum(n) FILTER (qr = 2), 0)::DOUBLE AS prev_shares FROM k WHERE cik NOT IN (SELECT cik FROM u) GROUP BY ALL),
    a AS (SELECT cik, max(q) AS as_of FROM k GROUP BY cik),
    x AS (SELECT *, round(coalesce(value * 100 / nullif(sum(value) OVER (PARTITION BY cik), 0), 0), 2) AS pct,
                 CASE WHEN prev_shares <= 0 AND shares > 0 THEN 'new' WHEN shares <= 0 AND prev_shares > 0 THEN 'exited' WHEN shares > prev_shares THEN 'added' WHEN shares < prev_shares THEN 'trimmed' ELSE 'unchanged' END AS change FROM i)
"""


@query(_REFRESHED + "SELECT x.*, as_of FROM x JOIN a USING (cik)")
def holdings_index(spark, sf):
    return _refreshed(spark, sf)[0]


@query(_REFRESHED + "SELECT * FROM e")
def holdings_index_errors(spark, sf):
    return _refreshed(spark, sf)[1]


@query(_REFRESHED + "SELECT (SELECT count(DISTINCT cik) FROM r) - (SELECT count(*) FROM e) AS funds, (SELECT count(*) FROM x) AS rows, (SELECT count(*) FROM e) AS errors")
def holdings_index_counts(spark, sf):
    return _refreshed(spark, sf)[2]


@query("SELECT l_partkey, count(*) FILTER (l_returnflag = 'N') AS buys, count(*) FILTER (l_returnflag = 'R') AS sells, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS shares_bought, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS shares_sold, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS net_shares FROM lineitem GROUP BY l_partkey")
def insider_flow(spark, sf):
    code = F.when(F.col("l_returnflag") == "N", "p").when(F.col("l_returnflag") == "R", " S ").otherwise("G")
    return holdings.insider_flow(t(spark, sf, "lineitem"), ["l_partkey"], scalars.trade_side(code), F.col("l_quantity"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_partkey FROM (SELECT *, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS f FROM lineitem) WHERE f <= 12 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) <= 8")
def insider_limits(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("seq", F.struct("l_linenumber", "l_partkey", "l_quantity"))
    return holdings.insider_limits(rows, "l_suppkey", "l_orderkey", "seq", 12, 8).select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")


@query("SELECT user_id, arg_max(event_type, (n, -p)) AS event_type, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS p FROM events GROUP BY ALL) GROUP BY user_id")
def dominant_label(spark, sf):
    return catalog.mode_first(t(spark, sf, "events"), ["user_id"], "event_type", "event_id")


# Text and retrieval ---------------------------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"SELECT doc_id, len({_TOKENS})::INTEGER AS n_tokens, len(list_distinct({_TOKENS}))::INTEGER AS n_distinct FROM documents")
def tokenize_stats(spark, sf):
    rows = t(spark, sf, "documents").withColumn("w", text.tokens(F.col("text")))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


_POOL = f"""
    q AS (SELECT item_id AS query_id, text AS query, list_distinct({_TOKENS}) AS qt FROM benchmark WHERE item_id % 50 = 0),
    p AS (SELECT query_id, query, qt, doc_id AS item_id, text, {_TOKENS} AS w FROM q, documents),
    j AS (SELECT *, CASE WHEN len(qt) = 0 OR len(w) = 0 THEN 0e0 ELSE len(list_intersect(qt, list_distinct(w)))::DOUBLE / len(list_distinct(list_concat(qt, w))) END AS jac FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(jac, 9) DESC, item_id) AS vec_rank FROM j),
    c AS (SELECT * FROM k WHERE vec_rank <= 20),
    n AS (SELECT query_id, count(*) AS nn, avg(len(w)) AS av FROM c GROUP BY query_id),
    h AS (SELECT query_id, item_id, len(w) AS ln, x, len(list_filter(w, lambda y: y = x)) AS tf FROM (SELECT query_id, item_id, w, unnest(qt) AS x FROM c)),
    f AS (SELECT query_id, x, count(*) AS df FROM h WHERE tf > 0 GROUP BY ALL),
    b AS (SELECT h.query_id, h.item_id, sum(ln(1 + (nn - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * ln / av))) AS lex FROM h JOIN f USING (query_id, x) JOIN n USING (query_id) WHERE tf > 0 GROUP BY ALL),
    s AS (SELECT c.*, coalesce(lex, 0) AS lex_score FROM c LEFT JOIN b USING (query_id, item_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lex_score, 9) DESC, vec_rank) AS lex_rank FROM s),
    u AS (SELECT *, 1e0 / (60 + vec_rank) + 1e0 / (60 + lex_rank) AS rrf FROM r),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, vec_rank) AS rank FROM u)
"""


def _pool(spark: SparkSession, sf: str, keep: int = 20) -> DataFrame:
    """All documents ranked for every fiftieth benchmark passage by token similarity: the fixed candidates of the lexical stage.

    The stated queries are broadcast against all documents, in blocks; the window keeps `keep` rows a query in each task before anything is
    shuffled.
    """
    queries = t(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.array_distinct(text.tokens(F.col("text"))).alias("_q"))
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", F.array_distinct(text.tokens(F.col("text"))).alias("_d"))
    out = None
    for part in retrieval.blocks(queries, "query_id"):
        scored = docs.join(F.broadcast(part), F.lit(True)).withColumn("similarity", text.jaccard(F.col("_q"), F.col("_d"))).drop("_q", "_d")
        best = scored.withColumn("vec_rank", F.expr("row_number() over (partition by query_id order by round(similarity, 9) desc, item_id)")).where(F.col("vec_rank") <= keep)
        out = best if out is None else out.unionByName(best)
    return out


@query(f"WITH {_POOL} SELECT query_id, item_id, vec_rank::INTEGER AS vec_rank, round(lex_score, 6) AS lex_score FROM s")
def bm25_candidates(spark, sf):
    return rounded(retrieval.bm25(_pool(spark, sf)), 6, "lex_score").select("query_id", "item_id", "vec_rank", "lex_score")


@query(f"WITH {_POOL} SELECT query_id, item_id, vec_rank::INTEGER AS vec_rank, lex_rank::INTEGER AS lex_rank, rank::INTEGER AS rank, round(rrf, 9) AS rrf FROM z")
def rrf_fusion(spark, sf):
    return rounded(retrieval.fuse(retrieval.bm25(_pool(spark, sf))), 9, "rrf").select("query_id", "item_id", "vec_rank", "lex_rank", "rank", "rrf")


@query(f"WITH {_POOL} SELECT query_id AS item_id, rank::INTEGER AS rank, item_id AS doc_id, round(rrf, 9) AS score FROM z WHERE rank <= 5")
def hybrid_search(spark, sf):
    rows = retrieval.fuse(retrieval.bm25(_pool(spark, sf))).where("rank <= 5")
    return rows.select(F.col("query_id").alias("item_id"), "rank", F.col("item_id").alias("doc_id"), F.round("rrf", 9).alias("score"))


@query(f"""
    WITH RECURSIVE {_POOL},
    d AS (SELECT query_id, item_id, rank, list_distinct(w) AS ws, count(*) OVER (PARTITION BY query_id) AS n FROM z),
    y AS (SELECT a.query_id, a.item_id, list({{'i': b.item_id, 'j': CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0e0 ELSE len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))) END}}) AS sims FROM d a JOIN d b USING (query_id) GROUP BY ALL),
    e AS (SELECT d.query_id, d.item_id, rank, (n - rank + 1)::DOUBLE / n AS rel, sims FROM d JOIN y ON d.query_id = y.query_id AND d.item_id = y.item_id),
    m AS (
        SELECT query_id, 1 AS pick, item_id, [item_id] AS taken FROM e WHERE rank = 1
        UNION ALL
        SELECT query_id, pick, item_id, taken FROM (
            SELECT m.query_id, m.pick + 1 AS pick, e.item_id, list_append(m.taken, e.item_id) AS taken,
                   row_number() OVER (PARTITION BY m.query_id ORDER BY round(0.7e0 * rel - 0.3e0 * list_max(list_transform(list_filter(sims, lambda x: list_contains(m.taken, x.i)), lambda x: x.j)), 12) DESC, rank) AS best
            FROM m JOIN e ON m.query_id = e.query_id AND NOT list_contains(m.taken, e.item_id) WHERE m.pick < 5)
        WHERE best = 1)
    SELECT query_id, pick::INTEGER AS pick, item_id FROM m""")
def mmr_rerank(spark, sf):
    return retrieval.search(_pool(spark, sf), 5)


_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9)"


def _vectors(spark: SparkSession, sf: str, metric: str, rows: DataFrame | None = None, k: int = 20) -> DataFrame:
    all_ = t(spark, sf, "embeddings")
    return retrieval.vector_top_k(all_ if rows is None else rows, all_.where("vec_id % 50 = 0"), k, "vec_id", "embedding", "vec_id", "embedding", metric)


@query(f"SELECT q.vec_id AS query_id, e.vec_id AS item_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id)::INTEGER AS vec_rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) <= 20")
def vector_topk(spark, sf):
    return _vectors(spark, sf, "cosine")


@query("WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id)::INTEGER AS vec_rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) <= 20")
def vector_topk_l2(spark, sf):
    all_ = t(spark, sf, "embeddings")
    return retrieval.vector_top_k(all_, all_.where("vec_id % 50 = 0"), 20, "vec_id", "embedding", "vec_id", "embedding", "l2", digits=6)


@query(f"SELECT q.vec_id AS query_id, e.vec_id AS item_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id)::INTEGER AS vec_rank FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.label = 3 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) <= 20")
def filtered_vector_topk(spark, sf):
    return _vectors(spark, sf, "cosine", t(spark, sf, "embeddings").where("label = 3"))


@query(f"""
    WITH r AS (SELECT q.vec_id AS query_id, q.label AS ql, e.label AS el, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rk FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
    f AS (SELECT query_id, min(rk) FILTER (ql = el AND rk <= 5) AS fr FROM r GROUP BY query_id)
    SELECT count(*) AS n, round(avg(CASE WHEN fr <= 1 THEN 1e0 ELSE 0e0 END), 4) AS hit_1, round(avg(CASE WHEN fr <= 3 THEN 1e0 ELSE 0e0 END), 4) AS hit_3, round(avg(CASE WHEN fr <= 5 THEN 1e0 ELSE 0e0 END), 4) AS hit_5, round(avg(coalesce(1e0 / fr, 0)), 4) AS mrr FROM f
""")
def eval_hit_mrr(spark, sf):
    all_ = t(spark, sf, "embeddings")
    cases = all_.where("vec_id % 50 = 0")
    found = retrieval.vector_top_k(all_, cases, 6, "vec_id", "embedding", "vec_id", "embedding", carry=["label"]).where("query_id <> item_id")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by vec_rank)")).where("rank <= 5").select(F.col("query_id").alias("case_id"), F.col("label").alias("r_label"), "rank")
    ranks = evaluation.first_ranks(cases.select(F.col("vec_id").alias("case_id"), "label"), ranked, F.col("label") == F.col("r_label"))
    return evaluation.report(ranks)


@query("""
    WITH c AS (SELECT vec_id AS case_id, embedding AS qe, label AS ql, CASE WHEN vec_id % 100 = 0 THEN label % 4 END AS year FROM embeddings WHERE vec_id % 50 = 0),
    r AS (SELECT case_id, ql, e.label AS el, row_number() OVER (PARTITION BY case_id ORDER BY round(list_cosine_similarity(qe::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rk FROM c, embeddings e WHERE (year IS NULL OR year = e.label % 4) AND e.vec_id <> case_id),
    f AS (SELECT c.case_id, min(rk) FILTER (r.ql = el AND rk <= 5) AS fr FROM c LEFT JOIN r USING (case_id) GROUP BY c.case_id)
    SELECT count(*) AS n, round(avg(CASE WHEN fr <= 1 THEN 1e0 ELSE 0e0 END), 4) AS hit_1, round(avg(CASE WHEN fr <= 3 THEN 1e0 ELSE 0e0 END), 4) AS hit_3, round(avg(CASE WHEN fr <= 5 THEN 1e0 ELSE 0e0 END), 4) AS hit_5, round(avg(coalesce(1e0 / fr, 0)), 4) AS mrr FROM f
""")
def eval_filtered(spark, sf):
    """Each case searched within its own filter: half of them name a year, as the label's class, and half leave it open."""
    all_ = t(spark, sf, "embeddings")
    cases = all_.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), F.col("embedding").alias("q"), F.col("label").alias("ql"), F.when(F.col("vec_id") % 100 == 0, F.col("label") % 4).alias("year"))
    chunks = all_.select(F.col("vec_id").alias("item_id"), "embedding", "label", (F.col("label") % 4).alias("r_year"))
    measure = F.when(F.col("case_id") != F.col("item_id"), F.round(vectors.cosine(F.col("q"), F.col("embedding")), 9))
    # A case does not find itself: it ranks behind all others.
    return evaluation.run_cases(cases, chunks, {"year": "r_year"}, F.coalesce(measure, F.lit(-2.0)), (F.col("ql") == F.col("label")) & (F.col("case_id") != F.col("item_id")), "item_id", cosine=("q", "embedding"))[1]


@query("SELECT q.vec_id AS query_id, e.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6), e.vec_id)::INTEGER AS rank, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS distance, CASE WHEN e.label % 2 = 0 THEN 'l' || e.label END AS period_of_report, e.label % 5 = 0 AS is_synthetic FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6), e.vec_id) <= 5")
def retrieved_rows(spark, sf):
    all_ = t(spark, sf, "embeddings")
    found = retrieval.vector_top_k(all_, all_.where("vec_id % 50 = 0"), 5, "vec_id", "embedding", "vec_id", "embedding", "l2", digits=6).withColumnRenamed("vec_rank", "rank")
    chunks = all_.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 0, F.concat(F.lit("l"), F.col("label").cast("string"))).otherwise("").alias("period_of_report"), "label")
    return retrieval.retrieved(found, chunks, synthetic=F.col("label") % 5 == 0).select("query_id", "item_id", "rank", "distance", "period_of_report", "is_synthetic")


# Documents, conversations and series ----------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    return rows.where(scalars.strip(F.col("content")) != "")


def _sql_tail(c: str) -> str:
    return f"CASE WHEN length({c}) <= 250 THEN {c} WHEN strpos(right({c}, 250), ' ') > 0 THEN substr(right({c}, 250), strpos(right({c}, 250), ' ') + 1) ELSE right({c}, 250) END"


@query(rf"""
    WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS p, x[i] AS content FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
    k AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM l WHERE regexp_matches(content, '\S')),
    f AS (
        SELECT doc_id, i, n, content AS buf, NULL::VARCHAR AS done, 0 AS closed FROM k WHERE i = 1
        UNION ALL
        SELECT f.doc_id, k.i, f.n, CASE WHEN length(f.buf) >= 2500 THEN {_sql_tail("f.buf")} ELSE f.buf END || chr(10) || chr(10) || k.content,
               CASE WHEN length(f.buf) >= 2500 THEN f.buf END, f.closed + CASE WHEN length(f.buf) >= 2500 THEN 1 ELSE 0 END
        FROM f JOIN k ON k.doc_id = f.doc_id AND k.i = f.i + 1),
    c AS (SELECT doc_id, closed - 1 AS pos, done AS t FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, closed, buf FROM f WHERE i = n),
    g AS (SELECT doc_id, pos, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM c)
    SELECT doc_id, pos::INTEGER AS pos, 'text' AS chunk_type, 'Preamble' AS section, length(t)::INTEGER AS n_chars, sha256(t) AS sha256 FROM g WHERE length(t) >= 200
""")
def chunk_overlap(spark, sf):
    elements = _lines(spark, sf).withColumns({"kind": F.lit("text"), "section": F.lit("Preamble")})
    rows = chunking.chunk_rows(chunking.merge_chunks(elements, "doc_id"), "doc_id")
    return rows.select("doc_id", "pos", "chunk_type", "section", F.length("text_content").alias("n_chars"), F.sha2("text_content", 256).alias("sha256"))


@query(r"""
    WITH l AS (SELECT doc_id, i - 1 AS pos, x[i] AS content FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
    k AS (SELECT *, length(content) < 40 AS h FROM l WHERE regexp_matches(content, '\S')),
    c AS (SELECT doc_id, pos, h, coalesce(last_value(CASE WHEN h THEN trim(regexp_replace(content, '\s+', ' ', 'g')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'Preamble') AS section FROM k)
    SELECT doc_id, pos::INTEGER AS pos, section FROM c WHERE NOT h
""")
def section_carry_forward(spark, sf):
    return chunking.carry_sections(_lines(spark, sf), "doc_id", "pos", F.length("content") < 40, F.col("content")).select("doc_id", "pos", "section")


_USABLE = r"""u AS (SELECT conv_id, turn, role, substr(x, 1, {w}) AS x FROM (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM conversations WHERE role IN ('user', 'assistant')) WHERE x <> '')"""
_WHOLE = _USABLE.format(w=1).replace("substr(x, 1, 1) AS x", "x")


@query("WITH " + _USABLE.format(w=600) + ", k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) SELECT conv_id, count(*) AS n_turns, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || x, chr(10) ORDER BY turn) AS history FROM k GROUP BY conv_id")
def history_window(spark, sf):
    return conversation.history(t(spark, sf, "conversations"))


@query("WITH " + _WHOLE + r", f AS (SELECT conv_id, arg_max(x, turn) FILTER (role = 'user') AS message, max(turn) FILTER (role = 'user') AS a, min(turn) AS b FROM u GROUP BY conv_id) SELECT conv_id, message, b < a AND NOT regexp_matches(message, '\b[A-Z]{2,5}\b') AND len(regexp_split_to_array(message, '\s+')) < 12 AS rewrite FROM f WHERE message IS NOT NULL")
def needs_rewrite(spark, sf):
    return conversation.follow_ups(t(spark, sf, "conversations"))


@query("SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')")
def missing_entity_plan(spark, sf):
    return retrieval.missing(t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), t(spark, sf, "orders").where("o_orderdate >= timestamp_ntz '2000-01-01'").select(F.col("o_custkey").alias("id")), ["id"])


@query("""
    WITH d AS (SELECT event_type, ts::DATE AS day, round(sum(round(value * 1000)::BIGINT)::DOUBLE / 1000, 3) AS total FROM events GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d),
    p AS (SELECT event_type, n, unnest(range(0, least(10, n))) AS pos FROM (SELECT DISTINCT event_type, n FROM s))
    SELECT p.event_type, p.pos::INTEGER AS pos, s.day, s.total FROM p JOIN s ON s.event_type = p.event_type AND s.i = CASE WHEN p.n > 10 THEN CASE WHEN p.pos = 9 THEN p.n - 1 ELSE least(floor(p.pos * p.n / 10)::BIGINT, p.n - 1) END ELSE p.pos END
""")
def downsample_series(spark, sf):
    days = t(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum(F.expr("cast(round(value * 1000) as bigint)")).cast("double") / 1000, 3).alias("total"))
    return catalog.downsample(days, ["event_type"], "day", "total", 10)


@query("WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, day, round((n - min(n) OVER w)::DOUBLE / coalesce(nullif(max(n) OVER w - min(n) OVER w, 0), 1), 6) AS scaled FROM d WINDOW w AS (PARTITION BY event_type)")
def sparkline_scale(spark, sf):
    days = t(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return rounded(catalog.scale_unit(days, ["event_type"], "n"), 6, "scaled").drop("n")


@query(r"SELECT page_id, CASE WHEN length(html) <= 2000 THEN html WHEN regexp_extract(substr(html, 1, 2000), '(?s)^.*</p>') <> '' THEN regexp_extract(substr(html, 1, 2000), '(?s)^.*</p>') ELSE substr(html, 1, 2000) END AS payload FROM pages")
def payload_truncate(spark, sf):
    return t(spark, sf, "pages").select("page_id", scalars.cut_payload(F.col("html"), F.lit(True), 2000, "</p>").alias("payload"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, max((props->>'$.k')::BIGINT) AS largest FROM events GROUP BY event_type")
def json_props(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"))


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_stage(spark, sf):
    return catalog.latest_stage(t(spark, sf, "events"), "user_id", "event_type", "ts")


@query("SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 160) AS snippet, CASE WHEN length(text) <= 250 THEN text WHEN strpos(right(text, 250), ' ') > 0 THEN substr(right(text, 250), strpos(right(text, 250), ' ') + 1) ELSE right(text, 250) END AS tail FROM documents")
def snippets_and_tails(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.tail(F.col("text")).alias("tail"))


@query("""
    SELECT s_suppkey, CASE WHEN abs(v) >= 1e9 THEN '$' || printf('%.1f', v / 1e9) || 'B' WHEN abs(v) >= 1e6 THEN '$' || printf('%.1f', v / 1e6) || 'M' ELSE '$' || format('{:,}', round(v)::BIGINT) END AS shown
    FROM (SELECT s_suppkey, floor(abs(s_acctbal) * 1000 + 0.3e0) AS v FROM supplier)
""")
def money_format(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", scalars.money(F.floor(F.abs("s_acctbal") * 1000 + 0.3).cast("double")).alias("shown"))


@query("WITH e AS (SELECT user_id, event_type, event_id FROM events) SELECT event_id, user_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_seen(spark, sf):
    return retrieval.first_seen(t(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


#: Entities of the pages, the last one last.
_ENTITIES = (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'"))


def _sql_plain(c: str) -> str:
    for name, char in _ENTITIES:
        c = f"replace({c}, '{name}', {char})"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


@query(rf"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'), '<head>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'gs') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<h[1-6][^>]*>', chr(1) || chr(2), 'g'), '</?(?:h[1-6]|p|li|div|td|section|article|body|blockquote|pre)(?:\s[^>]*)?>', chr(1), 'g'), '<(?:br|hr|img|input|meta|link|col)(?:\s[^>]*)?/?>', ' ', 'g') AS h FROM a),
    c AS (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT page_id, string_split(regexp_replace(h, '<[^>]*>', '', 'g'), chr(1)) AS x FROM b)),
    d AS (SELECT page_id, i, CASE WHEN x[i] LIKE chr(2) || '%' THEN 'title' ELSE 'text' END AS kind, {_sql_plain("replace(x[i], chr(2), '')")} AS t FROM c),
    e AS (SELECT page_id, kind, t, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM d WHERE t <> ''),
    f AS (SELECT *, kind = 'title' OR regexp_matches(t, '(?i)^item\s+\d+[a-z]?\.?\s*.{{0,60}}$') AS m FROM e),
    g AS (SELECT *, coalesce(last_value(CASE WHEN m THEN t END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'Preamble') AS section FROM f)
    SELECT page_id, pos::INTEGER AS pos, kind, section, sha256(t) AS sha256 FROM g WHERE NOT m
""")
def page_sections(spark, sf):
    """Titles and numbered item lines open sections."""
    blocks = partition(t(spark, sf, "pages"), "page_id", "html")
    rows = chunking.carry_sections(blocks, "page_id", "pos", (F.col("kind") == "title") | text.is_header(F.col("content")), F.col("content"))
    return rows.select("page_id", "pos", "kind", "section", F.sha2("content", 256).alias("sha256"))


# Operators of the fact base, the watchlist and the agent over tables of the same shape ---------------------------------------------


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, max(ts) AS ts, arg_max(value, event_id) AS value FROM (SELECT user_id, event_id, event_type, value, ts FROM events) GROUP BY user_id")
def filing_merge(spark, sf):
    rows = t(spark, sf, "events").select("user_id", "event_type", "ts", "value", F.col("event_id").alias("arrival_seq"))
    return facts.merge_filings(rows, "user_id", "arrival_seq", ("ts", "value")).select("user_id", "event_type", "ts", "value")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_write(spark, sf):
    return facts.last_write_wins(t(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""
    WITH o AS (SELECT o_custkey, o_orderpriority, o_orderdate::DATE AS d, o_orderkey, o_totalprice, o_orderkey % 3 = 0 AS n FROM orders)
    SELECT o_custkey, o_orderpriority, d, o_orderkey, o_totalprice FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY d DESC, n DESC, o_orderkey DESC) = 1
""")
def fact_upsert(spark, sf):
    rows = t(spark, sf, "orders").selectExpr("o_custkey", "o_orderpriority", "cast(o_orderdate as date) as d", "o_orderkey", "o_totalprice")
    late = F.col("o_orderkey") % 3 == 0
    return facts.upsert(rows.where(~late), rows.where(late), ["o_custkey", "o_orderpriority"], "d", "o_orderkey")


@query("""
    SELECT o_orderkey, regexp_matches(upper(trim(o_orderpriority)), '^[A-Z][A-Z0-9.\\-]{0,9}$') AS by_priority, regexp_matches(upper(trim(' ' || o_orderstatus || '.b ')), '^[A-Z][A-Z0-9.\\-]{0,9}$') AS by_status,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'X' || (o_orderkey % 4) END AS ticker, o_orderkey % 3 = 0 AS is_form, o_orderkey % 2 = 0 AS is_date,
           CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS amount, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS amount_or_zero
    FROM orders
""".replace("\\\\", "\\"))
def field_checks(spark, sf):
    key = F.col("o_orderkey")
    amount = F.when(key % 10 == 0, "NaN").when(key % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    shown = F.when(key % 2 == 0, F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")).when(key % 3 == 0, "2001-02-30").otherwise("1.2.2001")
    raw = F.when(key % 8 == 0, " nan ").when(key % 4 == 0, " ").otherwise(F.concat(F.lit(" x"), (key % 4).cast("string")))
    return t(spark, sf, "orders").select(
        "o_orderkey", scalars.is_ticker(F.col("o_orderpriority")).alias("by_priority"), scalars.is_ticker(F.concat(F.lit(" "), "o_orderstatus", F.lit(".b "))).alias("by_status"), scalars.clean_ticker(raw).alias("ticker"),
        scalars.is_doc_type(F.when(key % 3 == 0, "10-Q").otherwise("10-q")).alias("is_form"), scalars.is_iso_date(shown).alias("is_date"), scalars.number(amount).alias("amount"), scalars.number_or_zero(amount).alias("amount_or_zero"),
    )


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y, o_totalprice AS v, o_orderkey % 3 = 0 AS short, o_custkey % 2 = 0 AS annual,
                      CASE o_orderpriority WHEN '1-URGENT' THEN 'revenue' WHEN '2-HIGH' THEN 'revenue' WHEN '3-MEDIUM' THEN 'net_income' WHEN '4-NOT SPECIFIED' THEN 'total_assets' END AS k,
                      CASE o_orderpriority WHEN '1-URGENT' THEN 2 ELSE 0 END AS p FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0),
    f AS (SELECT * FROM r WHERE k IS NOT NULL AND (k = 'total_assets' OR short <> annual))
    SELECT 'C' || o_custkey AS ticker, k AS canonical_key, CASE k WHEN 'total_assets' THEN 'balance_sheet' ELSE 'income_statement' END AS statement, v AS value, make_date(y, 12, 31) AS period_end, y::INTEGER AS fiscal_year
    FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey, k, y ORDER BY p, o_orderkey) = 1
""")
def fact_extraction(spark, sf):
    key, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    concept = F.when(F.col("o_orderpriority") == "1-URGENT", "us-gaap:Revenues").when(F.col("o_orderpriority") == "2-HIGH", "us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax").when(F.col("o_orderpriority") == "3-MEDIUM", "NetIncomeLoss").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "us-gaap:Assets").otherwise("x:Unheard")
    span = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("instant_"), year, F.lit("-12-31"))).when(key % 3 == 0, F.concat(F.lit("duration_"), year, F.lit("-10-01_"), year, F.lit("-12-31"))).otherwise(F.concat(F.lit("duration_"), year, F.lit("-01-01_"), year, F.lit("-12-31")))
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("filing_id"), F.lit(0).alias("frame_ord"), key.alias("row_ord"), concept.alias("concept"), F.when(key % 11 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string")).alias("numeric_value"), span.alias("period_key"), (key % 13 == 0).alias("is_dimensioned"), F.lit("FY").alias("fiscal_period"))
    filings = t(spark, sf, "customer").select(F.col("c_custkey").alias("filing_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.lit("1").alias("cik"), F.when(F.col("c_custkey") % 2 == 0, "10-K").otherwise("10-Q").alias("form_type"), F.lit("2024-01-01").alias("filing_date"))
    return facts.extract(rows, filings, taxonomy.concepts(spark)).select("ticker", "canonical_key", "statement", "value", "period_end", "fiscal_year")


@query(f"""
    WITH {nation_year.SQL},
    b AS (SELECT entity, yr FROM wide WHERE abs((revenue - cost_of_revenue) - gross_profit) > 0.01e0 * greatest(abs(revenue - cost_of_revenue), abs(gross_profit), 1e0))
    SELECT entity, yr, canonical_key, CASE WHEN b.yr IS NOT NULL THEN 0.5e0 ELSE 1e0 END AS confidence
    FROM (UNPIVOT (SELECT entity, yr, revenue, cost_of_revenue, gross_profit FROM wide) ON revenue, cost_of_revenue, gross_profit INTO NAME canonical_key VALUE v) LEFT JOIN b USING (entity, yr) WHERE v IS NOT NULL
""")
def low_confidence(spark, sf):
    rows = nation_year.facts(spark, sf).where(F.col("canonical_key").isin("revenue", "cost_of_revenue", "gross_profit")).withColumn("confidence", F.lit(1.0))
    return facts.flag_low_confidence(rows, ["entity", "yr"]).select("entity", "yr", "canonical_key", "confidence")


@query(_REFRESHED + "SELECT '2024-05-01' AS refreshed_at, count(DISTINCT cik) AS funds, count(*) AS n_rows FROM x")
def index_totals(spark, sf):
    return tables.index_summary(_refreshed(spark, sf)[0], F.lit("2024-05-01"))


@query("""
    WITH k AS (SELECT event_id, user_id % 4 < 3 AS done, ts FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY done ORDER BY ts, event_id) AS n, (SELECT greatest(count(*) - 199, 0) FROM k) AS excess FROM k)
    SELECT event_id FROM r WHERE NOT done OR n > excess
""")
def evicted_tasks(spark, sf):
    state = F.when(F.col("user_id") % 4 == 0, "completed").when(F.col("user_id") % 4 < 3, "failed").otherwise("running")
    return catalog.evict(t(spark, sf, "events").select(F.col("event_id").alias("task_id"), state.alias("state"), F.col("ts").alias("updated_at"))).select(F.col("task_id").alias("event_id"))


@query("""
    WITH s AS (SELECT user_id AS run, event_id AS step, event_type, (props->>'$.k')::BIGINT % 9 AS n, lag(event_type) OVER w AS was, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT run, step, CASE WHEN was = event_type THEN 'repeated' WHEN n = 0 THEN 'nothing new' ELSE 'last step' END AS reason FROM s WHERE was = event_type OR n = 0 OR i >= 5 QUALIFY row_number() OVER (PARTITION BY run ORDER BY step) = 1
""")
def loop_guards(spark, sf):
    steps = t(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("signature"), (F.get_json_object("props", "$.k").cast("long") % 9).alias("new_ids"))
    return retrieval.loop_stops(steps, "run", "step", "signature", "new_ids")


@query(f"WITH {_POOL} SELECT query_id, string_agg('[' || vec_rank || '] Document ' || item_id || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY vec_rank) AS context FROM c WHERE vec_rank <= 3 GROUP BY query_id")
def prompt_context(spark, sf):
    return retrieval.context_text(_pool(spark, sf, 3), "query_id", "vec_rank", F.concat(F.lit("Document "), F.col("item_id").cast("string")), F.col("text"))


@query(r"""
    WITH l AS (SELECT doc_id, i - 1 AS pos, x[i] AS content FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))
    SELECT doc_id, pos::INTEGER AS pos, CASE WHEN pos % 3 = 0 THEN 'table' ELSE 'text' END AS chunk_type, CASE WHEN pos % 6 = 0 THEN 'Table of ' || length(content) || ' characters' ELSE content END AS text_content,
           'D' || doc_id || '_10-K_2024_FY_' || format('{:05d}', pos + 100) AS chunk_id
    FROM l WHERE regexp_matches(content, '\S') AND length(content) >= 200
""")
def table_summaries(spark, sf):
    lines = _lines(spark, sf).withColumn("kind", F.when(F.col("pos") % 3 == 0, "table").otherwise("text"))
    summaries = lines.where("pos % 6 = 0").select("doc_id", "pos", F.format_string("Table of %d characters", F.length("content")).alias("summary"))
    meta = (F.concat(F.lit("D"), F.col("doc_id").cast("string")), F.lit("10-K"), F.lit(2024), F.lit("FY"))
    return chunking.chunk_rows(lines, "doc_id", summaries, meta=meta, offset=100).select("doc_id", "pos", "chunk_type", "text_content", "chunk_id")


@query(r"""
    WITH l AS (SELECT doc_id, i - 1 AS pos, x[i] AS content FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
    k AS (SELECT *, length(content) < 40 AS h FROM l WHERE regexp_matches(content, '\S')),
    c AS (SELECT doc_id, pos, h, content, coalesce(last_value(CASE WHEN h THEN trim(regexp_replace(content, '\s+', ' ', 'g')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'Preamble') AS section FROM k)
    SELECT doc_id, section, count(*)::INTEGER AS n, sha256(string_agg(content, chr(10) ORDER BY pos)) AS sha256 FROM c WHERE NOT h GROUP BY doc_id, section
""")
def section_groups(spark, sf):
    rows = chunking.carry_sections(_lines(spark, sf), "doc_id", "pos", F.length("content") < 40, F.col("content"))
    grouped = chunking.section_map(rows, "doc_id").select("doc_id", F.explode("sections").alias("section", "c"))
    return grouped.select("doc_id", "section", F.size("c").alias("n"), F.sha2(F.array_join("c", "\n"), 256).alias("sha256"))


@query("WITH " + _WHOLE + """, m AS (SELECT conv_id, arg_max(x, turn) AS msg FROM u WHERE role = 'user' AND conv_id % 2 = 0 GROUP BY conv_id),
    k AS (SELECT u.*, row_number() OVER (PARTITION BY u.conv_id ORDER BY turn DESC) AS r, msg FROM u LEFT JOIN m USING (conv_id)),
    j AS (SELECT * FROM k WHERE NOT (r = 1 AND role = 'user' AND x IS NOT DISTINCT FROM msg) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)
    SELECT conv_id, count(*) AS n_turns, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(x, 1, 1000), chr(10) ORDER BY turn) AS history FROM j GROUP BY conv_id""")
def synthesis_history(spark, sf):
    turns = t(spark, sf, "conversations")
    messages = conversation.usable_turns(turns, None).where("role = 'user' and conv_id % 2 = 0").groupBy("conv_id").agg(F.max_by("text", "turn").alias("message"))
    return conversation.synthesis_history(turns, messages)


@query("""
    WITH r AS (SELECT DISTINCT 'C' || c_custkey AS ticker, CASE c_mktsegment WHEN 'BUILDING' THEN '10-Q' ELSE '10-K' END AS doc_type FROM customer)
    SELECT * FROM r WHERE ticker NOT IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderstatus = 'F')
""")
def ingest_plan(spark, sf):
    form = F.when(F.col("c_mktsegment") == "BUILDING", " 10-q ").when(F.col("c_mktsegment") == "MACHINERY", "8-K").when(F.col("c_mktsegment") == "FURNITURE", F.lit(None)).otherwise("10-K")
    requested = t(spark, sf, "customer").select(F.concat(F.lit(" c"), F.col("c_custkey").cast("string")).alias("ticker"), form.alias("doc_type"))
    present = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"))
    return retrieval.ingest_plan(requested, present)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'F') END AS used, least(greatest(o_orderkey % 50 - 10, 1), 20)::INTEGER AS top_k, least(greatest(o_orderkey % 50 - 10, 1), 30)::INTEGER AS insider_limit FROM orders")
def filter_values(spark, sf):
    key = F.col("o_orderkey")
    asked = (key % 50 - 10).cast("int")
    return t(spark, sf, "orders").select("o_orderkey", retrieval.effective(F.when(key % 2 == 0, F.col("o_orderstatus")), F.lit("F"), key % 7 != 0).alias("used"), scalars.clamped(asked, *scalars.SEARCH_TOP).alias("top_k"), scalars.clamped(asked, *scalars.INSIDER_LIMIT).alias("insider_limit"))


@query("""
    WITH b AS (SELECT s_suppkey, s_acctbal * 1000 AS v, abs(s_acctbal) * 1000 AS a, s_acctbal / 700 AS p, s_suppkey % 3 AS k FROM supplier),
    d AS (SELECT *, CASE WHEN a >= 1e6 THEN regexp_replace(printf('%.1f', a / 1e6), '\\.0$', '') || 'M' WHEN a >= 1e3 THEN regexp_replace(printf('%.1f', a / 1e3), '\\.0$', '') || 'K' ELSE printf('%.0f', a) END AS d,
                 CASE WHEN a >= 1e7 THEN printf('%.0f', v / 1e6) || 'M' WHEN a >= 1e6 THEN printf('%.1f', v / 1e6) || 'M' WHEN a >= 1e4 THEN printf('%.0f', v / 1e3) || 'K' WHEN a >= 1e3 THEN printf('%.1f', v / 1e3) || 'K' ELSE printf('%.0f', v) END AS s FROM b)
    SELECT s_suppkey, CASE WHEN v < 0 THEN '−' ELSE '' END || '$' || d AS dollars, s AS shares, '$' || printf('%.2f', p) AS price, CASE WHEN p = 0 THEN NULL WHEN p >= 10 THEN printf('%.0f', p) || '%' ELSE printf('%.1f', p) || '%' END AS pct,
           CASE k WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS tone FROM d
""".replace("\\\\", "\\"))
def display_formats(spark, sf):
    v, p = F.col("s_acctbal") * 1000, F.col("s_acctbal") / 700
    kind = F.element_at(F.array(F.lit("cheap"), F.lit("expensive"), F.lit("fair")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return t(spark, sf, "supplier").select("s_suppkey", scalars.dollars_text(v).alias("dollars"), scalars.shares_text(v).alias("shares"), scalars.price_text(p).alias("price"), scalars.share_of_book_text(p).alias("pct"), scalars.verdict_tone(kind).alias("tone"))


#: Raw errors, told apart by the rule that each meets.
_RAW_ERRORS = ("No XBRL for the form", "HTTP 429", "requests throttled", "SSL handshake", "getaddrinfo failed", "data generated twice", "unexpected token")


@query("SELECT event_id, CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{text_}'" for i, text_ in enumerate([
    "Couldn''t find T' || user_id || '''s 10-K on EDGAR — it may not exist or use a different ticker.", *["SEC EDGAR is rate-limiting right now — try T' || user_id || ' again in a moment."] * 2,
    *["Couldn''t reach SEC EDGAR right now — try T' || user_id || ' again shortly."] * 2, "SEC EDGAR is rate-limiting right now — try T' || user_id || ' again in a moment.", "Couldn''t fetch T' || user_id || '''s 10-K right now — please try again.",
])) + " END AS text FROM events")
def error_texts(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _RAW_ERRORS)), (F.col("event_id") % 7 + 1).cast("int"))
    return t(spark, sf, "events").select("event_id", scalars.friendly_error(raw, F.concat(F.lit("T"), F.col("user_id").cast("string")), F.lit("10-K")).alias("text"))


@query("""
    SELECT p_partkey, '<table class="x">' || CASE WHEN p_size >= 10 THEN '<thead>' || h || '</thead><tbody>' || b || '</tbody>' ELSE '<thead>' || h || b || '</thead>' END || '</table>' AS html
    FROM (SELECT p_partkey, p_size, '<tr><th>Name</th><td colspan="2"><b>' || split_part(p_type, ' ', 1) || '</b></td></tr>' AS h, '<tr><td>Net</td><td>$' || p_size || '%</td><td>a<table><tr><td>$</td><td>1</td></tr></table></td></tr>' AS b FROM part)
""")
def table_cleanup(spark, sf):
    made = F.concat(F.lit('<table class="x"><tr><th>Name</th><td colspan="2"><b>'), F.substring_index("p_type", " ", 1), F.lit("</b></td></tr><tr><td></td><td> </td></tr><tr><td>Net</td><td>$</td><td>"), F.col("p_size").cast("string"), F.lit("</td><td>%</td><td>a<table><tr><td>$</td><td>1</td></tr></table></td></tr></table>"))
    return spread(t(spark, sf, "part").select("p_partkey", "p_type", "p_size")).select("p_partkey", clean_tables(made).alias("html"))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') >= 500 AS stale, o_orderdate::DATE > DATE '1996-06-01' AS newer FROM orders")
def staleness(spark, sf):
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    return t(spark, sf, "orders").select("o_orderkey", scalars.is_stale(day, F.lit("1998-08-02").cast("timestamp"), 500).alias("stale"), watchlist.has_newer_filing(day, F.lit("1996-06-01")).alias("newer"))


@query("SELECT upper(c_mktsegment) AS ticker, least(min(c_custkey), min(c_custkey + 1)) AS added_at FROM customer GROUP BY upper(c_mktsegment) ORDER BY ticker")
def watched_tickers(spark, sf):
    rows = t(spark, sf, "customer")
    mine = rows.select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("ticker"), F.col("c_custkey").alias("added_at"))
    return watchlist.add_tickers(mine, rows.select(F.col("c_mktsegment").alias("ticker"), (F.col("c_custkey") + 1).alias("added_at")).unionByName(rows.limit(1).select(F.lit(" ").alias("ticker"), F.lit(0).cast(rows.schema["c_custkey"].dataType).alias("added_at"))))


_SNAPSHOT = "pe double, dcf_upside double, net_margin double, revenue_growth_yoy double, net_debt_to_ebitda double, signal_labels array<string>, ingested_filing_date date"


def _dashboard_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A dashboard over the nations, half of which have a stored snapshot, one of these unreadable."""
    valued = _valued(spark, sf).withColumn("ingested_filing_date", F.make_date("yr", F.lit(12), F.lit(31)))
    old = F.when(F.col("n_nationkey") == 0, "{unreadable").otherwise('{"pe":null,"net_margin":0.5,"signal_labels":["Old signal"],"ingested_filing_date":"1990-12-31"}')
    stored = t(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("ticker"), F.lit("1991-01-01").alias("taken_at"), old.alias("data"))
    smart = t(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_name").alias("entity"), F.concat(F.lit("Held by "), F.col("n_regionkey").cast("string"), F.lit("\nmore")).alias("text"))
    return watchlist.run_dashboard(valued, valuation.signal_rows(valued, ["entity"]), stored, F.lit("2002-01-01"), _SNAPSHOT, F.lit("2001-06-30").cast("date"), {"smart_money": smart}, "entity")


_DASHBOARD = _METRICS + _SIGNALS + """,
    lab AS (SELECT entity, list(DISTINCT label ORDER BY label) AS labels FROM s WHERE dimension <> 'valuation' GROUP BY entity),
    r AS (SELECT v.*, coalesce(labels, []) AS labels, nk % 2 = 0 AND nk <> 0 AS known FROM v LEFT JOIN lab USING (entity)),
    u AS (SELECT entity, 0 AS o, '' AS x, 'Net margin 50.0% to ' || printf('%.1f', net_margin * 100) || '%' AS c FROM r WHERE known AND abs(net_margin - 0.5e0) / greatest(0.5e0, abs(net_margin), 1e-9) >= 0.05e0
          UNION ALL SELECT entity, 1, l, 'New signal: ' || l FROM (SELECT entity, unnest(labels) AS l FROM r WHERE known)
          UNION ALL SELECT entity, 2, '', 'Cleared: Old signal' FROM r WHERE known
          UNION ALL SELECT entity, 3, '', 'New filing ingested (' || yr || '-12-31)' FROM r WHERE known),
    ch AS (SELECT entity, string_agg(c, '; ' ORDER BY o, x) AS changes FROM u GROUP BY entity)
"""


@query(_DASHBOARD + "SELECT entity, coalesce(changes, '') AS changes, DATE '2001-06-30' > make_date(yr, 12, 31) AS newer_filing, CASE WHEN nk % 3 = 0 THEN 'Held by ' || n_regionkey END AS smart_money FROM r LEFT JOIN ch USING (entity) JOIN nation ON n_name = entity")
def dashboard_run(spark, sf):
    return _dashboard_run(spark, sf)[0].select("entity", "changes", "newer_filing", "smart_money")


@query(_DASHBOARD + "SELECT upper(entity) AS ticker, '2002-01-01' AS taken_at, round(net_margin, 9) AS net_margin, array_to_string(labels, ',') AS labels, yr || '-12-31' AS filed FROM r")
def snapshot_store(spark, sf):
    shots = watchlist.read_snapshots(_dashboard_run(spark, sf)[1].where("taken_at = '2002-01-01'"), "data", _SNAPSHOT)
    rows = shots.select("ticker", F.lit("2002-01-01").alias("taken_at"), "snapshot.*")
    return rows.select("ticker", "taken_at", F.round("net_margin", 9).alias("net_margin"), F.array_join("signal_labels", ",").alias("labels"), F.col("ingested_filing_date").cast("string").alias("filed"))
