"""Financial line items by nation and year, made of orders and line items: the valuation queries' common input.

Both forms of the input, DataFrame and SQL, start from exact integer sums (cents, hundredths), so that they give equal doubles.
Some items are withheld for some nations, which exercises the null branches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Line item to its expression over the sums; the expressions hold in both dialects.
ITEMS = {
    "revenue": "e",
    "cost_of_revenue": "ed * 8e0",
    "gross_profit": "CASE WHEN nk % 2 = 0 THEN e - ed * 8e0 END",
    "operating_income": "CASE WHEN nk % 7 <> 3 THEN kept * (0.05e0 + 0.1e0 * (nk % 5)) END",
    "interest_expense": "CASE WHEN nk % 3 = 1 THEN ex * 0.5e0 END",
    "depreciation_amortization": "CASE WHEN nk % 5 <> 0 THEN ex END",
    "pretax_income": "CASE WHEN nk % 7 <> 3 THEN kept * (0.05e0 + 0.1e0 * (nk % 5)) * 0.9e0 END",
    "income_tax": "CASE WHEN nk % 7 <> 3 THEN kept * (0.05e0 + 0.1e0 * (nk % 5)) * 0.9e0 * 0.2e0 END",
    "net_income": "CASE WHEN nk % 7 <> 3 THEN kept * (0.05e0 + 0.1e0 * (nk % 5)) * 0.9e0 * 0.8e0 END",
    "operating_cash_flow": "net * 0.25e0",
    "capex": "CASE WHEN nk % 6 <> 5 THEN ex * (2e0 + 4e0 * (nk % 3)) END",
    "long_term_debt": "CASE WHEN nk % 4 <> 1 THEN 0.4e0 * e END",
    "short_term_debt": "CASE WHEN nk % 4 NOT IN (1, 2) THEN 0.1e0 * e END",
    "cash_and_equivalents": "CASE WHEN nk % 9 <> 8 THEN ef * 0.2e0 END",
    "total_assets": "2e0 * e",
    "total_equity": "0.8e0 * e",
    "current_assets": "0.5e0 * e",
    "current_liabilities": "ed * 10e0",
    "shares_outstanding": "qty",
}
PRICE = "CASE WHEN nk % 8 <> 7 THEN (1.5e0 + 0.5e0 * (nk % 5)) * e / qty END"

SQL = f"""
    sums AS (
        SELECT n_nationkey AS nk, n_name AS entity, year(o_orderdate)::INTEGER AS yr,
               sum(c)::DOUBLE / 100 AS e, sum(c * d)::DOUBLE / 10000 AS ed, sum(c * x)::DOUBLE / 10000 AS ex, sum(c * (100 - d))::DOUBLE / 10000 AS net,
               sum(CASE WHEN l_returnflag <> 'R' THEN c * (100 - d) ELSE 0 END)::DOUBLE / 10000 AS kept, sum(CASE WHEN l_linestatus = 'F' THEN c ELSE 0 END)::DOUBLE / 100 AS ef, sum(q)::DOUBLE AS qty
        FROM (SELECT *, round(l_extendedprice * 100)::BIGINT AS c, round(l_discount * 100)::BIGINT AS d, round(l_tax * 100)::BIGINT AS x, round(l_quantity)::BIGINT AS q FROM lineitem)
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY ALL),
    wide AS (SELECT nk, entity, yr, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in ITEMS.items())}, NULL::DOUBLE AS short_term_investments, NULL::DOUBLE AS shares_diluted, ({PRICE})::DOUBLE AS price FROM sums)
"""


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a nation and year. Lines are summed by order before any join: the joins then move one row an order."""
    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def whole(c: str, scale: int) -> str:
        return f"cast(round({c} * {scale}) as bigint)"

    lines = t("lineitem").selectExpr("l_orderkey", "l_returnflag", "l_linestatus", f"{whole('l_extendedprice', 100)} as c", f"{whole('l_discount', 100)} as d", f"{whole('l_tax', 100)} as x", f"{whole('l_quantity', 1)} as q")
    exact = {"e": "c", "ed": "c * d", "ex": "c * x", "net": "c * (100 - d)", "kept": "if(l_returnflag <> 'R', c * (100 - d), 0)", "ef": "if(l_linestatus = 'F', c, 0)", "qty": "q"}
    by_order = lines.groupBy("l_orderkey").agg(*(F.sum(F.expr(v)).alias(k) for k, v in exact.items()))
    orders = t("orders").selectExpr("o_orderkey", "o_custkey", "year(o_orderdate) as yr")
    customers = t("customer").select("c_custkey", "c_nationkey")
    nations = t("nation").selectExpr("n_nationkey as nk", "n_name as entity")
    rows = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    # 25 nations: a table of fixed size.
    rows = rows.groupBy("c_nationkey", "yr").agg(*(F.sum(k).alias(k) for k in exact)).join(F.broadcast(nations), F.col("c_nationkey") == F.col("nk"))
    scale = {"e": 100, "ed": 10000, "ex": 10000, "net": 10000, "kept": 10000, "ef": 100, "qty": 1}
    return rows.select("nk", "entity", "yr", *((F.col(k).cast("double") / s).alias(k) for k, s in scale.items()))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long facts (entity, nk, yr, canonical_key, value); withheld items have no row."""
    wide = sums(spark, sf_dir).select("entity", "nk", "yr", *(F.expr(v).cast("double").alias(k) for k, v in ITEMS.items()), F.expr(PRICE).cast("double").alias("price"))
    return wide.unpivot(["entity", "nk", "yr"], [*ITEMS, "price"], "canonical_key", "value").where("value is not null")
