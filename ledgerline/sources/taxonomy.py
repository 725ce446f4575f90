"""The concept taxonomy: which reported concepts stand for which line item, best first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Statement, line item, concepts by falling priority.
TAXONOMY = (
    ("income_statement", "revenue", ("RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "Revenues", "SalesRevenueNet", "RevenueNet", "RevenuesNetOfInterestExpense")),
    ("income_statement", "cost_of_revenue", ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold")),
    ("income_statement", "gross_profit", ("GrossProfit",)),
    ("income_statement", "operating_expenses", ("OperatingExpenses", "CostsAndExpenses", "NoninterestExpense")),
    ("income_statement", "net_interest_income", ("InterestIncomeExpenseNet",)),
    ("income_statement", "noninterest_income", ("NoninterestIncome",)),
    ("income_statement", "provision_for_credit_losses", ("ProvisionForLoanLeaseAndOtherLosses", "ProvisionForLoanAndLeaseLosses", "ProvisionForCreditLossExpenseReversal")),
    ("income_statement", "rd_expense", ("ResearchAndDevelopmentExpense",)),
    ("income_statement", "sga_expense", ("SellingGeneralAndAdministrativeExpense", "GeneralAndAdministrativeExpense")),
    ("income_statement", "operating_income", ("OperatingIncomeLoss",)),
    ("income_statement", "interest_expense", ("InterestExpense", "InterestExpenseNonoperating")),
    ("income_statement", "pretax_income", ("IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments")),
    ("income_statement", "income_tax", ("IncomeTaxExpenseBenefit",)),
    ("income_statement", "net_income", ("NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic")),
    ("income_statement", "eps_basic", ("EarningsPerShareBasic",)),
    ("income_statement", "eps_diluted", ("EarningsPerShareDiluted",)),
    ("income_statement", "shares_basic", ("WeightedAverageNumberOfSharesOutstandingBasic",)),
    ("income_statement", "shares_diluted", ("WeightedAverageNumberOfDilutedSharesOutstanding",)),
    ("balance_sheet", "total_assets", ("Assets",)),
    ("balance_sheet", "current_assets", ("AssetsCurrent",)),
    ("balance_sheet", "cash_and_equivalents", ("CashAndCashEquivalentsAtCarryingValue",)),
    ("balance_sheet", "short_term_investments", ("ShortTermInvestments", "MarketableSecuritiesCurrent")),
    ("balance_sheet", "total_liabilities", ("Liabilities",)),
    ("balance_sheet", "current_liabilities", ("LiabilitiesCurrent",)),
    ("balance_sheet", "long_term_debt", ("LongTermDebtNoncurrent", "LongTermDebt")),
    ("balance_sheet", "short_term_debt", ("LongTermDebtCurrent", "DebtCurrent")),
    ("balance_sheet", "total_equity", ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest")),
    ("balance_sheet", "shares_outstanding", ("CommonStockSharesOutstanding",)),
    ("cash_flow", "operating_cash_flow", ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations")),
    ("cash_flow", "capex", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets")),
    ("cash_flow", "depreciation_amortization", ("DepreciationDepletionAndAmortization", "DepreciationAmortizationAndAccretionNet")),
    ("cash_flow", "dividends_paid", ("PaymentsOfDividendsCommonStock", "PaymentsOfDividends")),
    ("cash_flow", "stock_repurchases", ("PaymentsForRepurchaseOfCommonStock",)),
)

# Concepts taken as revenue when it is broken down by segment.
SEGMENT_REVENUE = (
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "RevenueFromContractWithCustomerIncludingAssessedTax",
    "Revenues",
    "RevenuesNetOfInterestExpense",
    "SalesRevenueNet",
)


def concepts(spark: SparkSession, entries=TAXONOMY) -> DataFrame:
    """(concept, canonical_key, statement, priority); a concept listed twice belongs to its first line item."""
    rows, seen = [], set()
    for statement, key, names in entries:
        for i, name in enumerate(names):
            if name not in seen:
                seen.add(name)
                rows.append((name, key, statement, i))
    return spark.createDataFrame(rows, "concept string, canonical_key string, statement string, priority int")
