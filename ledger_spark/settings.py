"""Fixed configuration values: vocabulary, header rules, observations, templates.

Everything in this module is a fixed value that results depend on, written in
natural order.  The tables are small by construction (tens of rows), so frames
made from them are plain local relations that Catalyst may broadcast.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Canonical fields and the header spellings that name them.
# Order matters: a header belongs to the first field that lists it.
# --------------------------------------------------------------------------
FIELDS = [
    # (field id, field, sql type, synonyms)
    (10001, "company_id", "INT",
     ["company_id", "companyid", "company", "co_id", "coid", "entity_id", "org_id", "orgid", "ticker"]),
    (10002, "company_name", "TEXT",
     ["company_name", "companyname", "name", "co_name", "org_name", "organization", "firm"]),
    (10003, "line_item", "TEXT",
     ["line_item", "lineitem", "item", "metric", "line item", "financial_item", "Metric Name"]),
    (10020, "line_item_id", "INT", ["line_item_id", "lineitemid"]),
    (10004, "period_label", "TEXT",
     ["period_label", "periodlabel", "period", "date", "report_date", "as_of", "fiscal_period", "time",
      "time_period", "month", "quarter", "year", "reporting_period", "rpt_period"]),
    (10005, "period_type", "TEXT",
     ["period_type", "periodtype", "frequency", "freq", "type", "granularity", "rpt_type", "rpt_frequency"]),
    (10021, "period_id", "INT", ["period_id", "periodid"]),
    (10006, "start_date", "DATE", ["start_date", "from_date", "begin_date", "effective_date"]),
    (10007, "end_date", "DATE", ["end_date", "to_date", "finish_date", "expiry_date"]),
    (10008, "value", "NUMERIC",
     ["value", "amount", "val", "figure", "reported_value", "actual_value", "budget_value", "total",
      "numeric_value", "amt", "Amount", "Number", "Figure"]),
    (10009, "value_type", "TEXT",
     ["value_type", "valuetype", "scenario", "scenario_type", "basis", "plan", "actual", "budget",
      "forecast", "projected", "prior", "variance"]),
    (10010, "frequency", "TEXT", ["frequency", "freq", "reporting_cycle", "rpt_cycle"]),
    (10011, "currency", "TEXT", ["currency", "curr", "ccy", "iso_currency", "currency_code", "fx"]),
    (10012, "source_file", "TEXT", ["source_file", "file", "filename", "datafile", "file_path"]),
    (10013, "source_page", "INT", ["source_page", "page", "page_number", "pageno", "page_num"]),
    (10014, "source_type", "TEXT", ["source_type", "ingestion_type"]),
    (10015, "notes", "TEXT",
     ["notes", "note", "comments", "description", "remark", "explanation", "footnote"]),
    (10016, "hash", "TEXT", ["hash"]),
]

# Regular-expression families for headers no synonym names.
TAXONOMY = [
    ("id_headers", ["^company[_ ]?id$", "^entity[_ ]?id$", ".*_?id$"]),
    ("name_headers", ["^company[_ ]?name$", "^org(ani[sz]ation)?[_ ]?name$", "^name$"]),
    ("date_headers",
     ["^(start|end)?[_ ]?date$", r"^[A-Za-z]{3,9}[ _]\d{4}$", r"^YTD[ _]\d{4}$", r"^Q[1-4][ _]\d{4}$",
      "^period[_ ]?label$", "^report[_ ]?date$", "^(fiscal|rpt)[_ ]?(period|date)$"]),
    ("period_type_headers",
     ["^(period|frequency|freq)[_ ]?type$", "^monthly$", "^quarterly$", "^ytd$", "^(granularity|cycle)$"]),
    ("value_headers",
     ["^(value|amount|amt|figure)s?$", "^(reported|actual|budget|forecast)[_ ]?value$",
      "^(val|num|numeric)(_?value)?$"]),
    ("scenario_headers", ["^(value|scenario)[_ ]?type$", "^(plan|basis|variance)$"]),
    ("currency_headers", ["^(currency|curr|ccy|fx)(_code)?$", "iso[_ ]?currency[_ ]?code"]),
    ("file_headers", ["^(source|data)?[_ ]?file(name)?$", "^file(path)?$"]),
    ("page_headers", ["^source[_ ]?page$", "^page(nu(mber)?)?$", "^(sheet|tab)[_ ]?id$"]),
    ("notes_headers", ["^(note|comment|remark|footnote)s?$", "^(description|explanation)$"]),
    ("statement_type_headers",
     ["^(statement|report)[_ ]?type$", "^financial[_ ]?statement", "^stmt(_?type)?$"]),
    ("category_headers", ["^(category|group|class|bucket)(s)?$", "category[_ ]?name"]),
    ("financial_item_headers",
     ["^(line[_ ]?item|metric|account|acct)$", "^(description|desc(ri?p(ti(on)?)?)?)$"]),
]

# Which canonical column a taxonomy family feeds when no synonym did.
TAXONOMY_COLUMN = {
    "id_headers": "company_id",
    "name_headers": "company_name",
    "date_headers": "period_label",
    "period_type_headers": "period_type",
    "value_headers": "value",
    "scenario_headers": "value_type",
    "currency_headers": "currency",
    "file_headers": "source_file",
    "page_headers": "source_page",
    "notes_headers": "notes",
    "financial_item_headers": "line_item",
}

# --------------------------------------------------------------------------
# Line items and their aliases.
# --------------------------------------------------------------------------
LINE_ITEMS = [
    (11001, "Revenue",
     ["revenue", "sales", "income", "turnover", "total revenue", "total_revenue", "net sales", "top line",
      "sales revenue", "rev"]),
    (11002, "Gross Profit",
     ["gross profit", "gross_profit", "gross income", "gross margin", "gm", "gross earnings", "grossincome"]),
    (11003, "EBITDA",
     ["ebitda", "EBITDA", "Ebitda", "earnings before interest", "earnings_before_interest",
      "earnings before taxes", "operating profit", "earnings before interest taxes",
      "earnings_before_taxes"]),
]

# Further line items a fresh dimension is seeded with.
SEED_LINE_ITEMS = [
    ("Cost of Goods Sold", ["cogs", "cost_of_sales", "direct_costs"]),
    ("Operating Expenses", ["opex", "operating_costs", "operational_expenses"]),
    ("Depreciation", ["depreciation_expense", "amortization"]),
    ("Interest Expense", ["interest_paid", "financing_costs"]),
    ("Interest Income", ["interest_earned", "interest_revenue"]),
    ("Tax Expense", ["taxes", "income_tax", "tax_provision"]),
    ("Research and Development", ["r_and_d", "rd_expense", "research_development"]),
    ("Marketing Expenses", ["marketing_costs", "advertising", "marketing_spend"]),
    ("General and Administrative", ["g_and_a", "admin_expenses", "overhead"]),
    ("Cash and Equivalents", ["cash", "cash_equiv", "liquid_assets"]),
    ("Accounts Receivable", ["receivables", "ar", "trade_receivables"]),
    ("Inventory", ["stock", "goods_inventory"]),
    ("Prepaid Expenses", ["prepaids", "prepaid_assets"]),
    ("Property Plant Equipment", ["ppe", "fixed_assets", "tangible_assets"]),
    ("Intangible Assets", ["intangibles", "goodwill", "intellectual_property"]),
    ("Investments", ["investment_securities", "marketable_securities"]),
    ("Accounts Payable", ["payables", "ap", "trade_payables"]),
    ("Accrued Expenses", ["accruals", "accrued_liabilities"]),
    ("Short-term Debt", ["current_debt", "short_term_loans"]),
    ("Long-term Debt", ["ltd", "long_term_loans", "non_current_debt"]),
    ("Deferred Revenue", ["unearned_revenue", "deferred_income"]),
    ("Common Stock", ["share_capital", "common_shares"]),
    ("Retained Earnings", ["accumulated_earnings", "earned_surplus"]),
    ("Additional Paid-in Capital", ["apic", "share_premium"]),
    ("Operating Cash Flow", ["cash_from_operations", "operating_activities"]),
    ("Investing Cash Flow", ["cash_from_investing", "investment_activities"]),
    ("Financing Cash Flow", ["cash_from_financing", "financing_activities"]),
    ("Free Cash Flow", ["fcf", "unlevered_free_cash_flow"]),
    ("Capital Expenditures", ["capex", "capital_investments"]),
]

# --------------------------------------------------------------------------
# Periods.
# --------------------------------------------------------------------------
MONTHS = ["January", "February", "March", "April", "May", "June",
          "July", "August", "September", "October", "November", "December"]
PERIOD_PREFIXES = ["period:", "pd:", "time:"]
# Spark datetime patterns for the formats the heuristic parser tries, in order.
DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d"]

# Text tokens.
CURRENCY_SIGNS = "$€£¥"
NULL_WORDS = ["nan", "none", "null"]
# Stands for a missing part of a hashed key.
NULL_PART = "<null>"
NA_TOKENS = ["", "N/A", "NA", "null", "NULL"]
UPLOAD_EXTENSIONS = ["csv", "xlsx", "pdf"]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
DEFAULTS = {"period_type": "Monthly", "frequency": "Monthly", "value_type": "Actual",
            "currency": "USD", "source_type": "CSV"}

# Words used by the text rules.
FINANCIAL_TERMS = ["revenue", "sales", "income", "profit", "loss", "cost", "expense", "ebitda", "margin",
                   "tax", "interest", "depreciation", "amortisation", "gross profit", "operating profit",
                   "net profit"]
LINE_SKIP_TERMS = ["profit and loss", "wilson partners", "management reports", "statutory basis", "monthly",
                   "ytd", "comparison", "actual", "budget", "variance"]
LINE_TERMS = ["revenue", "sales", "income", "profit", "loss", "cost", "expense", "ebitda", "margin", "tax",
              "interest", "depreciation", "amortisation", "staff", "premises", "office", "professional",
              "assets", "liabilities"]
NAME_QUALIFIERS = ["Reported ", "Adjusted ", "Proforma "]
CANONICAL_PHRASES = ["Gross Profit", "Operating Profit", "Net Profit", "Staff Costs", "Revenue"]
HEADER_PERIOD_WORDS = ["feb-25", "feb-24", "actual", "budget", "prior", "ytd"]
HEADER_VARIANCE_WORDS = ["variance", "vs"]
HEADER_PERIOD_LABELS = [("feb-25", "2025-02"), ("feb-24", "2024-02")]
HEADER_DATA_TYPES = ["actual", "budget", "variance"]

# --------------------------------------------------------------------------
# Materiality and observations.
# --------------------------------------------------------------------------
DEFAULT_MATERIALITY = 0.05
METRIC_MATERIALITY = {"Revenue": 0.03, "Gross Profit": 0.04, "EBITDA": 0.06}
OUTLIER_FACTOR = 3.0
TREND_PERIODS = 6

# unit: "pct" rows compare |value| with threshold * 100; "own" rows use their
# own parameter unscaled; "ratio" rows compare |value - 1| with the threshold.
OBSERVATIONS = [
    # (id, name, unit, materiality, importance, category, calculation type, family weight)
    (20001, "growth_mom", "pct", None, 5, "growth_analysis", "MoM Growth", 1.0),
    (20002, "growth_qoq", "pct", None, 4, "growth_analysis", "QoQ Growth", 1.0),
    (20003, "growth_yoy", "pct", None, 5, "growth_analysis", "YoY Growth", 1.0),
    (20004, "variance_vs_budget", "pct", 0.03, 5, "variance_analysis", "Variance vs Budget", 0.9),
    (20005, "variance_vs_forecast", "pct", None, 4, "variance_analysis", "Variance vs Forecast", 0.9),
    (20006, "ytd_performance", "pct", None, 4, "growth_analysis", "YTD Growth", 1.0),
    (20007, "trend_direction", "own", 0.02, 3, "trend_pattern", "Trend Analysis", 0.7),
    (20008, "volatility_measure", "own", 0.15, 2, "trend_pattern", "Volatility Analysis", 0.7),
    (20009, "seasonal_variance", "pct", None, 3, "trend_pattern", "Seasonal Analysis", 0.7),
    (20010, "absolute_change", "own", 0.0, 2, "absolute_magnitude", "Absolute Change", 0.5),
    (20011, "magnitude_check", "own", 2.0, 3, "absolute_magnitude", "Magnitude Analysis", 0.5),
    (20012, "efficiency_ratio", "ratio", 0.05, 3, "ratio_efficiency", "Efficiency Analysis", 0.8),
    (20013, "margin_analysis", "pct", None, 4, "ratio_efficiency", "Margin Analysis", 0.8),
]
OBSERVATION_BY_NAME = {o[1]: o for o in OBSERVATIONS}

# Question templates.  {placeholders} name the value columns of
# an observation row; `cur`, `ref`, `gap` are money, `pct` is the change in %.
TEMPLATES = [
    # (id, observation id, importance, category, priority, weight, text)
    (30001, 20001, 5, "growth_analysis", "high", 1.0,
     "{metric_name} changed {pct}% month-over-month ({cur} vs {ref}). "
     "What operational factors drove this {up:growth|decline}?"),
    (30002, 20002, 4, "growth_analysis", "high", 1.0,
     "{metric_name} showed {pct}% growth quarter-over-quarter. "
     "How does this align with our quarterly targets and strategic initiatives?"),
    (30003, 20003, 5, "growth_analysis", "high", 1.2,
     "Year-over-year {metric_name} {up:increased|decreased} by {pct}% ({abs_gap}). "
     "What strategic initiatives contributed to this performance?"),
    (30004, 20006, 4, "growth_analysis", "high", 1.0,
     "Year-to-date {metric_name} is {pct}% {up:ahead of|behind} last year. "
     "Are we on track for annual targets?"),
    (30011, 20004, 5, "variance_analysis", "high", 1.3,
     "{metric_name} is {pct}% {up:above|below} budget ({cur} vs {ref}). "
     "What explains this variance and what actions are required?"),
    (30012, 20004, 5, "variance_analysis", "high", 1.5,
     "🚨 CRITICAL: {metric_name} variance of {pct}% impacts {abs_gap}. "
     "What immediate corrective actions are required?"),
    (30013, 20005, 4, "variance_analysis", "high", 1.0,
     "{metric_name} came in {pct}% {up:higher|lower} than forecast. "
     "Should we adjust our forecasting methodology or expectations?"),
    (30021, 20007, 3, "trend_pattern", "high", 0.9,
     "{metric_name} shows a {pos:positive|negative} trend over the past {trend_periods} periods. "
     "Is this trend sustainable and aligned with our strategic direction?"),
    (30022, 20008, 2, "trend_pattern", "high", 0.8,
     "{metric_name} volatility is {calc100_1}%. "
     "What factors are driving this variability and how can we improve predictability?"),
    (30023, 20009, 3, "trend_pattern", "high", 0.9,
     "{metric_name} is {pct}% {up:above|below} seasonal norm. "
     "What changed our typical seasonal patterns?"),
    (30031, 20010, 2, "absolute_magnitude", "high", 0.7,
     "Absolute change in {metric_name} was {calc_money}. "
     "Is this magnitude significant relative to our scale of operations?"),
    (30032, 20011, 3, "absolute_magnitude", "high", 0.8,
     "{metric_name} is {calc_1} standard deviations {pos:above|below} its historical mean. "
     "Should this outlier be investigated further?"),
    (30041, 20012, 3, "ratio_efficiency", "high", 0.9,
     "{metric_name} ratio is {calc_2}, {up:improving|declining} from prior periods. "
     "How does this impact our operational efficiency targets?"),
    (30042, 20013, 4, "ratio_efficiency", "high", 1.1,
     "{metric_name} margin is {calc_1}%, {up:up|down} {abs_gap_1}% points. "
     "How does this compare to industry benchmarks and competitors?"),
    (30051, 20001, 4, "growth_analysis", "high", 0.9,
     "Monthly {metric_name} performance shows {pct}% change. "
     "What specific business drivers contributed to this result?"),
    (30052, 20003, 4, "growth_analysis", "high", 1.0,
     "Annual {metric_name} growth of {pct}% represents {gap} impact. "
     "How does this position us for next year's planning?"),
]

PRIORITY_CODES = {"low": 1, "medium": 3, "high": 5}
PRIORITY_LABELS = {1: "Low", 3: "Medium", 5: "High"}

# Free-form templates with {named} placeholders.
PLACEHOLDER_TEMPLATES = [
    # (category, priority, text)
    ("variance_analysis", 5,
     "Revenue is {variance_percent}% {variance_direction} budget (${actual_value} vs ${budget_value}). "
     "What explains this variance and what actions are required?"),
    ("variance_analysis", 4,
     "{metric_name} is {variance_percent}% {variance_direction} than expected. "
     "What factors contributed to this variance?"),
    ("trend_analysis", 4,
     "{metric_name} has {trend_direction} by {change_percent}% over the last {period_count} periods. "
     "What is driving this trend?"),
    ("trend_analysis", 3,
     "The trend in {metric_name} shows {trend_pattern}. "
     "Is this sustainable and what are the implications?"),
    ("benchmark_analysis", 3,
     "{company_name} profit margin is {margin_value}%, which is {comparison} the industry average. "
     "How can this be improved?"),
    ("benchmark_analysis", 3,
     "{metric_name} performance is {performance_level} compared to industry benchmarks. "
     "What strategic actions should be considered?"),
    ("cash_analysis", 4,
     "Cash flow from operations is {cash_flow_value}, while net income is {net_income_value}. "
     "What explains this {cash_quality}?"),
    ("cash_analysis", 4,
     "Working capital has {change_direction} by {change_amount}. "
     "What impact does this have on cash flow and operations?"),
    ("profitability_analysis", 4,
     "Gross margin has {margin_trend} to {current_margin}%. "
     "What pricing or cost factors are driving this change?"),
    ("profitability_analysis", 3,
     "Operating leverage is {leverage_direction} as revenues {revenue_change}. "
     "How should operational efficiency be optimized?"),
    ("risk_analysis", 2,
     "Debt-to-equity ratio is {debt_ratio}, indicating {risk_level} financial leverage. "
     "What are the implications for financial stability?"),
    ("risk_analysis", 2,
     "Current ratio of {current_ratio} suggests {liquidity_status}. "
     "What actions should be taken to manage liquidity risk?"),
]

# --------------------------------------------------------------------------
# Event-log thresholds.
# --------------------------------------------------------------------------
SLOW_MS = {"query": 1000.0, "request": 5000.0, "operation": 2000.0}
RESOURCE_WARNING_PCT = 80.0
HEALTH_DEGRADED_PCT = 90.0
HEALTH_UNHEALTHY_PCT = 95.0
REPEATED_ERROR_COUNT = 5
ERRORS_PER_MINUTE = 10
METRIC_BUFFER = 1000
WINDOW_PIECES = 60
MAX_QUESTIONS = 10

# Which tables can be regenerated and the order to purge them in.
TRANSIENT_TABLES = ["question_logs", "live_questions", "questions", "derived_metrics",
                    "generated_reports", "financial_metrics"]
