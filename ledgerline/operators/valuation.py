"""Ratios, growth, multiples, discounted cash flow, rule signals and their texts, over one row per entity and period."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.scalars import fixed, money, percent, safe_div, times

KEYS = (
    "revenue", "cost_of_revenue", "gross_profit", "operating_income", "interest_expense", "pretax_income", "income_tax", "net_income", "operating_cash_flow", "capex", "depreciation_amortization",
    "total_assets", "current_assets", "cash_and_equivalents", "short_term_investments", "current_liabilities", "long_term_debt", "short_term_debt", "total_equity", "shares_outstanding", "shares_diluted",
)
METRICS = (
    "gross_margin", "operating_margin", "net_margin", "fcf", "fcf_margin", "ebitda", "ebitda_margin", "roe", "roa", "roic_approx", "net_debt", "net_debt_to_ebitda", "current_ratio", "interest_coverage", "effective_tax_rate",
)


@dataclass(frozen=True)
class Assumptions:
    """Of the discounted cash flow; growth falls back to what the rows give, then to the default, and is clamped."""

    years: int = 5
    growth: float | None = None
    discount: float = 0.09
    terminal: float = 0.025
    default_growth: float = 0.04
    low: float = -0.05
    high: float = 0.20
    spread: float = 0.03


def pivot_periods(facts: DataFrame, keys: Sequence[str] = ("ticker", "period_end"), names: Sequence[str] = KEYS) -> DataFrame:
    """Long facts to one row a period; the names are fixed, so no pass over the data looks for them."""
    return facts.groupBy(*keys).pivot("canonical_key", list(names)).agg(F.first("value", ignorenulls=True))


def net_debt() -> Column:
    c = F.col
    debt = F.coalesce("long_term_debt", F.lit(0.0)) + F.coalesce("short_term_debt", F.lit(0.0))
    return F.when(c("long_term_debt").isNotNull() | c("short_term_debt").isNotNull(), debt - F.coalesce("cash_and_equivalents", F.lit(0.0)) - F.coalesce("short_term_investments", F.lit(0.0)))


def period_metrics(wide: DataFrame) -> DataFrame:
    """The rows with the columns METRICS; a missing input or a zero divisor gives null, never zero."""
    c = F.col
    gross = F.coalesce(c("gross_profit"), c("revenue") - c("cost_of_revenue"))
    base = wide.withColumns({"fcf": c("operating_cash_flow") - c("capex"), "ebitda": c("operating_income") + F.coalesce(c("depreciation_amortization"), F.lit(0.0)), "net_debt": net_debt(), "effective_tax_rate": safe_div(c("income_tax"), c("pretax_income"))})
    capital = c("total_equity") + F.greatest(F.coalesce(c("net_debt"), F.lit(0.0)), F.lit(0.0))
    return base.withColumns(
        {
            "gross_margin": safe_div(gross, c("revenue")),
            "operating_margin": safe_div(c("operating_income"), c("revenue")),
            "net_margin": safe_div(c("net_income"), c("revenue")),
            "fcf_margin": safe_div(c("fcf"), c("revenue")),
            "ebitda_margin": safe_div(c("ebitda"), c("revenue")),
            "roe": safe_div(c("net_income"), c("total_equity")),
            "roa": safe_div(c("net_income"), c("total_assets")),
            "roic_approx": safe_div(c("operating_income") * (1 - F.coalesce(c("effective_tax_rate"), F.lit(0.0))), capital),
            "net_debt_to_ebitda": safe_div(c("net_debt"), c("ebitda")),
            "current_ratio": safe_div(c("current_assets"), c("current_liabilities")),
            "interest_coverage": safe_div(c("operating_income"), c("interest_expense")),
        }
    )


def trends(wide: DataFrame, entity: str, period_col: str, names: Sequence[str] = ("revenue", "net_income", "operating_income")) -> DataFrame:
    """One row an entity: for each name growth over its two newest periods with a value, and compound growth over all of them.

    Points count, not years: a gap is passed over. One aggregate gives them all, without a sort of the rows.
    """
    def newest(name: str) -> Column:
        # The array of an entity has one entry a period.
        return F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(F.col(period_col).alias("p"), F.col(name).alias("v")))), asc=False).alias(name)

    listed = wide.groupBy(entity).agg(*(newest(n) for n in names))
    out = [F.when(F.size(n) >= 2, safe_div(F.col(n)[0]["v"] - F.col(n)[1]["v"], F.abs(F.col(n)[1]["v"]))).alias(f"{n}_growth_yoy") for n in names]

    def compound(name: str) -> Column:
        n, last, first = F.size(name), F.try_element_at(name, F.lit(1))["v"], F.try_element_at(name, F.lit(-1))["v"]
        return F.when((n >= 2) & (first > 0) & (last > 0), F.pow(last / first, 1 / (n - 1)) - 1).alias(f"{name}_cagr")

    return listed.select(entity, *out, *map(compound, names))


def metrics_bundle(wide: DataFrame, entity: str, period_col: str) -> DataFrame:
    """One row an entity: latest_period, periods (newest first), per_period (period to its METRICS) and trends."""
    rows = period_metrics(wide).groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(F.col(period_col).alias("p"), F.struct(*METRICS).alias("m"))), asc=False).alias("_r"))
    rows = rows.select(entity, F.col("_r")[0]["p"].alias("latest_period"), F.transform("_r", lambda r: r["p"]).alias("periods"), F.map_from_entries(F.transform("_r", lambda r: F.struct(r["p"], r["m"]))).alias("per_period"))
    grown = trends(wide, entity, period_col)
    return rows.join(grown.select(entity, F.struct(*(c for c in grown.columns if c != entity)).alias("trends")), entity)


def dcf_per_share(fcf: Column, growth: Column, shares: Column, debt: Column, a: Assumptions) -> Column:
    """Value of the growing flows and the perpetuity behind them, less net debt, a share; null without positive flow and shares."""
    flows = F.aggregate(F.sequence(F.lit(1), F.lit(a.years)), F.lit(0.0), lambda s, t: s + fcf * F.pow(1 + growth, t) / F.pow(F.lit(1 + a.discount), t))
    last = fcf * F.pow(1 + growth, F.lit(a.years)) * (1 + a.terminal) / (a.discount - a.terminal) / F.pow(F.lit(1 + a.discount), F.lit(a.years)) if a.discount > a.terminal else F.lit(None).cast("double")
    return F.when((fcf > 0) & (shares > 0), (flows + last - F.coalesce(debt, F.lit(0.0))) / shares)


def valuation(latest: DataFrame, a: Assumptions = Assumptions(), price: str = "price", shares: str | None = None, fallback_growth: str = "revenue_cagr") -> DataFrame:
    """Multiples and the range of the cash-flow value for rows with metrics, a price and growth; zero shares count as missing."""
    c = F.col
    n = F.coalesce(*([F.nullif(c(shares), F.lit(0.0))] if shares else []), F.nullif(c("shares_outstanding"), F.lit(0.0)), F.nullif(c("shares_diluted"), F.lit(0.0)))
    growth = F.least(F.greatest(F.coalesce(F.lit(a.growth).cast("double"), c(fallback_growth), F.lit(a.default_growth)), F.lit(a.low)), F.lit(a.high))
    rows = latest.withColumns({"shares_used": n, "growth_used": growth})
    cap = c(price) * c("shares_used")
    rows = rows.withColumn("market_cap", cap).withColumn("enterprise_value", c("market_cap") + F.coalesce("net_debt", F.lit(0.0)))
    rows = rows.withColumns({"pe": safe_div(c("market_cap"), c("net_income")), "ev_ebitda": safe_div(c("enterprise_value"), c("ebitda")), "p_fcf": safe_div(c("market_cap"), c("fcf")), "p_s": safe_div(c("market_cap"), c("revenue")), "fcf_yield": safe_div(c("fcf"), c("market_cap"))})
    value = {k: dcf_per_share(c("fcf"), g, c("shares_used"), c("net_debt"), a) for k, g in (("dcf_base", c("growth_used")), ("dcf_low", F.greatest(c("growth_used") - a.spread, F.lit(a.low))), ("dcf_high", F.least(c("growth_used") + a.spread, F.lit(a.high))))}
    return rows.withColumns(value).withColumn("dcf_upside", safe_div(c("dcf_base") - c(price), c(price)))


#: The rules in order, as (input, test, dimension, direction, label, detail). In a detail {p} stands for percent, {x} and {xx} for
#: a multiple with one digit or two, {n} and {m} for whole percent and its opposite.
RULES = (
    ("net_margin", ">= 0.15", "profitability", "bull", "High net margin", "net margin {p}"),
    ("net_margin", "< 0.05", "profitability", "bear", "Thin net margin", "net margin {p}"),
    ("roic_approx", ">= 0.15", "returns", "bull", "Strong returns on capital", "ROIC≈ {p}"),
    ("roic_approx", "< 0.08", "returns", "bear", "Low returns on capital", "ROIC≈ {p}"),
    ("fcf_margin", ">= 0.10", "cash_flow", "bull", "Strong free cash flow", "FCF margin {p}"),
    ("fcf_margin", "< 0", "cash_flow", "bear", "Burning cash", "FCF margin {p}"),
    ("net_debt_to_ebitda", "<= 1.0", "balance_sheet", "bull", "Low leverage", "net debt/EBITDA {x}"),
    ("net_debt_to_ebitda", "> 3.0", "balance_sheet", "bear", "Elevated leverage", "net debt/EBITDA {x}"),
    ("current_ratio", "< 1.0", "balance_sheet", "neutral", "Current ratio below 1", "current ratio {xx}"),
    ("revenue_growth_yoy", ">= 0.10", "growth", "bull", "Double-digit revenue growth", "revenue +{p} YoY"),
    ("revenue_growth_yoy", "< 0", "growth", "bear", "Revenue declining", "revenue {p} YoY"),
    ("revenue_growth_yoy", "between 0 and 0.03", "growth", "neutral", "Slow revenue growth", "revenue +{p} YoY"),
    ("revenue_growth_yoy", "< revenue_cagr - 0.02", "growth", "bear", "Decelerating growth", "YoY {p} below {cagr} CAGR"),
    ("dcf_upside", ">= 0.20", "valuation", "bull", "Trades below DCF value", "~{n}% upside to intrinsic"),
    ("dcf_upside", "<= -0.20", "valuation", "bear", "Trades above DCF value", "~{m}% above intrinsic"),
    ("fcf_yield", "< 0.03", "valuation", "bear", "Low FCF yield", "FCF yield {p}"),
)


def _fires(name: str, test: str) -> Column:
    if test.startswith("between"):
        _, low, _, high = test.split()
        return (F.col(name) >= float(low)) & (F.col(name) < float(high))
    if "revenue_cagr" in test:
        return (F.col("revenue_cagr") > 0) & F.expr(f"{name} {test}")
    sign, bound = test.split()
    x = F.col(name)
    return {">=": x >= float(bound), ">": x > float(bound), "<=": x <= float(bound), "<": x < float(bound)}[sign]


def _detail(name: str, form: str) -> Column:
    x = F.col(name)
    values = {"{p}": percent(x), "{x}": times(x), "{xx}": F.concat(fixed(x, 2), F.lit("x")), "{cagr}": percent(F.col("revenue_cagr")), "{n}": fixed(x * 100, 0), "{m}": fixed(-x * 100, 0)}
    return F.concat(*(values.get(part, F.lit(part)) for part in re.split(r"(\{[a-z]+\})", form) if part))


def signal_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, dimension, direction, label, detail): the rules that fire on each row, in the order of the rules."""
    fired = F.array_compact(F.array(*(F.when(_fires(name, test), F.struct(F.lit(d).alias("dimension"), F.lit(s).alias("direction"), F.lit(label).alias("label"), _detail(name, form).alias("detail"))) for name, test, d, s, label, form in RULES)))
    return rows.select(*keys, F.posexplode(fired).alias("pos", "s")).select(*keys, "pos", "s.*")


#: What would change the view, by the dimension of a signal against it, and where there is none.
WATCH = {
    "valuation": "a pullback toward the DCF range, or growth/margins coming in materially above the assumptions",
    "growth": "a return to double-digit revenue growth (or stabilization if declining)",
    "balance_sheet": "deleveraging back below ~3x net debt/EBITDA",
    "profitability": "net margin recovering above ~10%",
    "cash_flow": "a return to positive, sustained free cash flow",
    "returns": "ROIC improving back above ~10%",
}
WATCH_BULLS = "erosion of the bull-case drivers above (margins, growth, or returns weakening)"


def thesis(valued: DataFrame, signals: DataFrame, entity: str, period_col: str) -> DataFrame:
    """(entity, text): signals for and against, where the price stands to the cash-flow value, and what would change the view.

    At most three distinct things to watch are listed, in the order of the signals against; with none of these, one for the bulls.
    Entities without a signal have a text too.
    """
    def side(name: str, mark: str) -> Column:
        got = F.array_sort(F.collect_list(F.when(F.col("direction") == name, F.struct("pos", F.concat(F.lit(mark), "label", F.lit(" ("), "detail", F.lit(")")).alias("t")))))
        return F.transform(got, lambda x: x["t"])

    against = F.array_sort(F.collect_list(F.when(F.col("direction") == "bear", F.struct("pos", "dimension"))))
    dims = F.slice(F.array_distinct(F.transform(against, lambda x: x["dimension"])), 1, 3)
    listed = signals.groupBy(entity).agg(side("bull", "  + ").alias("_bull"), side("bear", "  - ").alias("_bear"), side("neutral", "  · ").alias("_neutral"), dims.alias("_dims"))
    watch = F.create_map(*(F.lit(x) for kv in WATCH.items() for x in kv))
    rows = valued.join(listed, entity, "left")
    none = F.array().cast("array<string>")
    bull, bear, neutral = (F.coalesce(c, none) for c in ("_bull", "_bear", "_neutral"))
    seen = F.transform(F.coalesce("_dims", none), lambda d: F.concat(F.lit("  • "), watch[d]))
    seen = F.when((F.size(seen) == 0) & (F.size(bull) > 0), F.array(F.lit(f"  • {WATCH_BULLS}"))).otherwise(seen)

    def block(title: str, lines: Column, empty: bool = False) -> Column:
        shown = F.when(F.size(lines) == 0, F.array(F.lit("  (none flagged)")) if empty else none).otherwise(lines)
        return F.when(F.size(shown) == 0, none).otherwise(F.concat(F.array(F.lit(title)), shown))

    # The wording of the lines.
    dcf = F.concat(
        F.lit("VALUATION: "), F.coalesce(F.concat(F.lit("price $"), fixed(F.col("price"), 2), F.lit(", ")), F.lit("")) if "price" in valued.columns else F.lit(""), F.lit("DCF intrinsic $"), _range(), F.lit(") — trading "),
        F.when(F.coalesce("dcf_upside", F.lit(0.0)) > 0, "below").otherwise("above"), F.lit(" the DCF estimate."),
    )
    head = F.concat(F.col(entity), F.lit(" — investment thesis scaffold (heuristic signals on filed numbers, latest "), F.col(period_col).cast("string"), F.lit("):"))
    last = F.lit("(Heuristic flags on filed figures — qualitative context (moat, risks) and the final judgment are layered on top; not investment advice.)")
    lines = F.concat(F.array(head), block("BULL:", bull, True), block("BEAR:", bear, True), block("WATCH:", neutral), F.when(F.col("dcf_base").isNotNull(), F.array(dcf)).otherwise(none), block("WHAT WOULD CHANGE THE VIEW:", seen), F.array(last))
    return rows.select(entity, F.array_join(lines, "\n").alias("text"))


def _range(unit: str = "") -> Column:
    """The cash-flow value and its range, up to the bracket that closes it."""
    return F.concat(fixed(F.col("dcf_base"), 2), F.lit(f"{unit} (range $"), fixed(F.col("dcf_low"), 2), F.lit("–$"), fixed(F.col("dcf_high"), 2))


def _joined(*lines: Column) -> Column:
    """Lines that are there, one below the other."""
    return F.concat_ws("\n", *lines)


def fundamentals_text(latest: DataFrame, wide: DataFrame, entity: str, period_col: str, history: int = 4) -> DataFrame:
    """(entity, text) of the newest period with metrics: figures, margins, returns, balance, growth and past revenue.

    Revenue and net income are the newest that are there.
    """
    c = F.col

    def newest(name: str) -> Column:
        return F.sort_array(F.collect_list(F.when(c(name).isNotNull(), F.struct(c(period_col).alias("p"), c(name).alias("v")))), asc=False)

    past = wide.groupBy(entity).agg(newest("revenue").alias("_rev"), F.try_element_at(newest("net_income"), F.lit(1))["v"].alias("_net"))
    rows = latest.drop("revenue", "net_income").join(past, entity).join(trends(wide, entity, period_col), entity)
    shown = F.array_join(F.transform(F.slice("_rev", 1, history), lambda r: F.concat(r["p"].cast("string"), F.lit(": "), money(r["v"]))), ", ")
    # The wording of the lines.
    parts = [
        F.concat(c(entity), F.lit(" — structured financials (from XBRL filings), latest period "), c(period_col).cast("string"), F.lit(":")),
        F.concat(F.lit("  Revenue "), money(F.try_element_at("_rev", F.lit(1))["v"]), F.lit(" | Net income "), money(c("_net")), F.lit(" | FCF "), money(c("fcf")), F.lit(" | EBITDA "), money(c("ebitda"))),
        F.concat(F.lit("  Margins — gross "), percent(c("gross_margin")), F.lit(", operating "), percent(c("operating_margin")), F.lit(", net "), percent(c("net_margin")), F.lit(", FCF "), percent(c("fcf_margin"))),
        F.concat(F.lit("  Returns — ROE "), percent(c("roe")), F.lit(", ROA "), percent(c("roa")), F.lit(", ROIC≈ "), percent(c("roic_approx"))),
        F.concat(F.lit("  Balance — net debt "), money(c("net_debt")), F.lit(", net-debt/EBITDA "), times(c("net_debt_to_ebitda")), F.lit(", current ratio "), times(c("current_ratio"))),
        F.concat(F.lit("  Growth — revenue YoY "), percent(c("revenue_growth_yoy")), F.lit(", revenue CAGR "), percent(c("revenue_cagr")), F.lit(", net income YoY "), percent(c("net_income_growth_yoy"))),
        F.when(F.size("_rev") > 1, F.concat(F.lit("  Revenue history — "), shown)),
    ]
    return rows.select(entity, _joined(*parts).alias("text"))


def valuation_text(valued: DataFrame, entity: str, period_col: str, a: Assumptions = Assumptions(), price: str = "price") -> DataFrame:
    """(entity, text): price and multiples where there is a price, and the cash-flow value with its assumptions where there is one."""
    c = F.col
    dcf = c("dcf_base").isNotNull()
    upside = F.coalesce(F.concat(F.lit("; upside vs price "), F.when(c("dcf_upside").isNotNull(), percent(c("dcf_upside")))), F.lit(""))
    # The wording of the lines.
    parts = [
        F.concat(c(entity), F.lit(" — valuation (latest period "), c(period_col).cast("string"), F.lit("):")),
        F.when(c(price).isNull(), F.lit("  Price unavailable — multiples skipped (fundamentals + DCF only).")).otherwise(F.concat(F.lit("  Price $"), fixed(c(price), 2), F.lit(" | Market cap "), money(c("market_cap")), F.lit(" | EV "), money(c("enterprise_value")))),
        F.when(c(price).isNotNull(), F.concat(F.lit("  Multiples — P/E "), times(c("pe")), F.lit(", EV/EBITDA "), times(c("ev_ebitda")), F.lit(", P/FCF "), times(c("p_fcf")), F.lit(", P/S "), times(c("p_s")), F.lit(", FCF yield "), percent(c("fcf_yield")))),
        F.when(dcf, F.concat(F.lit("  DCF intrinsic value $"), _range("/share"), F.lit(")"))),
        F.when(dcf, F.concat(F.lit(f"  DCF assumptions — {a.years}y, growth "), percent(c("growth_used")), F.lit(", discount "), percent(F.lit(a.discount)), F.lit(", terminal "), percent(F.lit(a.terminal)), upside)),
        F.when(dcf, F.lit("  (DCF is a transparent scaffold on stated assumptions — not a recommendation.)")),
    ]
    return valued.select(entity, _joined(*parts).alias("text"))


def segments_text(members: DataFrame, entity: str, axis: str, member: str, value: str, period: Column, max_members: int = 6) -> DataFrame:
    """(entity, text) from the members of each axis in the newest period, with their rank and number: the largest of each, and how many more."""
    line = F.concat(F.lit("  "), F.col(axis), F.lit(": "), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= max_members, F.struct("rank", F.concat(F.col(member), F.lit(" "), money(F.col(value))).alias("t"))))), lambda x: x["t"]), ", "))
    more = F.max("n_members") - F.least(F.max("n_members"), F.lit(max_members))
    lines = members.groupBy(entity, axis, period.cast("string").alias("_p")).agg(F.concat(line, F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise("")).alias("l"))
    return lines.groupBy(entity, "_p").agg(F.array_sort(F.collect_list(F.struct(axis, "l"))).alias("_l")).select(entity, F.concat(F.lit("Revenue by segment ("), F.col("_p"), F.lit("; as reported, may include subtotals):\n"), F.array_join(F.transform("_l", lambda x: x["l"]), "\n")).alias("text"))
