"""Reports, listings and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledger_spark.functions import values as V
from ledger_spark.operators import mapping as MP, normalize as N, quality as C, questions as Q, reports as R
from ledger_spark.plans.question_queries import RENDERED_SQL
from ledger_spark.plans.registry import JUDGED_SQL, RAW_SQL, Tables, big, query, r4
from ledger_spark.session import written
from ledger_spark.sources import dimensions as D, sinks


@query("report_metrics", sql=f"""WITH {JUDGED_SQL}
SELECT company_id, CAST(start_date AS VARCHAR) AS start_date, item AS name, canon AS period_label, vt AS value_type,
  {r4('amount', 'value')}, 'USD' AS currency, source_file, {big('page', 'source_page')}, CAST(NULL AS VARCHAR) AS notes FROM facts""")
def report_metrics(t: Tables):
    facts = written(t.facts.drop("start_date", "hash"), "facts")
    return R.report_metrics(facts, D.line_items(t.spark).select("line_item_id", "name"),
                            t.order_calendar)


@query("report_log", sql=f"""WITH {JUDGED_SQL}, mx AS (SELECT max(o_orderdate) AS d FROM orders)
SELECT DISTINCT company_id, 'financial_analysis' AS report_type, 'reports/company_' || company_id || '.pdf' AS file_path, d AS created_at
FROM facts, mx""")
def report_log(t: Tables):
    made = R.companies_with_data(t.facts)
    path = F.concat(F.lit("reports/company_"), F.col("company_id"), F.lit(".pdf"))
    at = t("orders").agg(F.max("o_orderdate").alias("d")).scalar()
    return sinks.report_log(made, "financial_analysis", path, at)


@query("report_questions", sql=f"""WITH {RENDERED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id
  ORDER BY period_label DESC, template_id, metric_name, period_type) AS position FROM rendered)
SELECT {big('company_id', 'company_id')}, {big('position', 'position')},
  CASE WHEN length(question_text) > 80 THEN substr(question_text, 1, 80) || '...' ELSE question_text END AS question,
  'Open' AS status, 'High' AS priority FROM r WHERE position <= 10""")
def report_questions(t: Tables):
    rows = t.questions.withColumn("priority", V.priority_code(F.col("priority")))
    order = [F.desc("period_label"), F.col("template_id"), F.col("metric_name"), F.col("period_type")]
    return R.report_questions(Q.render(rows), order)


@query("report_source_display", sql="""SELECT s_suppkey, CASE WHEN length(stem) > 18 THEN substr(stem, 1, 15) || '...' ELSE stem END AS display
FROM (SELECT s_suppkey, 'upload_' || lower(s_name) AS stem FROM supplier WHERE s_nationkey % 2 = 0
UNION ALL SELECT s_suppkey, 'sheet ' || s_suppkey FROM supplier WHERE s_nationkey % 2 = 1)""")
def report_source_display(t: Tables):
    name = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("upload_"), F.lower("s_name"), F.lit(".v2.csv"))) \
            .otherwise(F.concat(F.lit("sheet "), F.col("s_suppkey"), F.lit(".xlsx")))
    return t("supplier").select("s_suppkey", V.display_source(name).alias("display"))


@query("company_metric_count", sql=f"""WITH {JUDGED_SQL} SELECT company_id, {big('count(*)', 'metrics')} FROM facts GROUP BY company_id""")
def company_metric_count(t: Tables):
    return R.companies_with_data(t.facts)


@query("records_by_company", sql=f"""SELECT o_orderkey, {big('c_nationkey', 'company_id')}, o_orderdate, {r4('o_totalprice', 'amount')}
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7""")
def records_by_company(t: Tables):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("company_id"), "o_orderdate", F.col("o_totalprice").alias("amount"))
    return R.records(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], F.col("company_id") == 7)


@query("records_recent", sql=f"SELECT o_orderkey, o_orderdate, {r4('o_totalprice', 'amount')} FROM orders")
def records_recent(t: Tables):
    rows = t("orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("amount"))
    return R.records(rows, [F.desc("o_orderdate"), F.col("o_orderkey")])


@query("distinct_companies", sql=f"SELECT DISTINCT {big('s_nationkey', 'company_id')} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def distinct_companies(t: Tables):
    """A semi-join: suppliers that shipped anything."""
    return R.distinct_companies(t("supplier").join(t("lineitem"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
                                .select(F.col("s_nationkey").alias("company_id")))


_TABLES = ["lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events", "documents"]


@query("table_inventory", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{'transient' if n in ('lineitem', 'orders', 'events') else 'persistent'}' AS retention, "
    f"{big('count(*)', 'records')} FROM {n}" for n in _TABLES))
def table_inventory(t: Tables):
    return R.table_counts({n: t(n) for n in _TABLES}, transient=["lineitem", "orders", "events"])


@query("purge_preview", sql=f"""
SELECT {big('1', 'position')}, 'events' AS table_name, {big("count(*) FILTER (WHERE event_type = 'error')", 'to_delete')},
  {big("count(*) FILTER (WHERE event_type <> 'error')", 'to_keep')} FROM events
UNION ALL SELECT 2, 'lineitem', count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1997-01-01'),
  count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1997-01-01') FROM lineitem
UNION ALL SELECT 3, 'orders', count(*), 0 FROM orders""")
def purge_preview(t: Tables):
    old = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    return R.purge_preview({n: t(n) for n in ("orders", "events", "lineitem")},
                           {"events": F.col("event_type") == "error", "lineitem": old},
                           order=["events", "lineitem", "orders"])


@query("record_lookup", sql="""SELECT c_custkey AS custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer""")
def record_lookup(t: Tables):
    return R.record_lookup(t("orders").select(F.col("o_custkey").alias("custkey")),
                           t("customer").select(F.col("c_custkey").alias("custkey")), "custkey")


# -- quality -------------------------------------------------------------------

@query("alias_conflicts", sql=f"""SELECT lower(p_name) AS alias_lc, {big('count(DISTINCT p_brand)', 'owners')},
  min(p_brand) AS first_owner, max(p_brand) AS last_owner FROM part GROUP BY lower(p_name) HAVING count(DISTINCT p_brand) > 1""")
def alias_conflicts(t: Tables):
    """Part names as aliases of their brands."""
    return C.alias_conflicts(t("part").select(F.lower("p_name").alias("alias_lc"), "p_brand"), "alias_lc", "p_brand")


@query("rule_violations", sql=f"""WITH {RAW_SQL}
SELECT row_id, 'positive company' AS rule FROM raw_rows WHERE CAST(company_id AS INT) <= 0
UNION ALL SELECT row_id, 'required line_item' FROM raw_rows WHERE line_item IS NULL
UNION ALL SELECT row_id, 'allowed value_type' FROM raw_rows WHERE value_type IS NULL
UNION ALL SELECT row_id, 'valid amount' FROM raw_rows WHERE row_id % 5 IN (1, 2, 4)
UNION ALL SELECT o_orderkey, 'priority 1-3' FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('4', '5')""")
def rule_violations(t: Tables):
    rows = t.raw_rows.join(t("orders").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority"), "row_id")
    return C.rule_violations(rows, "row_id", {
        "positive company": F.col("company_id").try_cast("int") > 0,
        "required line_item": F.col("line_item").isNotNull(),
        "allowed value_type": F.col("value_type").isin("Actual", "Budget", "Forecast"),
        "valid amount": C.valid_amount(F.col("value")),
        "priority 1-3": F.substring("o_orderpriority", 1, 1).try_cast("int").between(1, 3)})


@query("alias_edit", sql="""WITH a AS (SELECT DISTINCT lower(p_name) AS alias_lc, p_brand AS name FROM part WHERE p_size <= 25
  UNION SELECT lower(p_name), p_brand FROM part WHERE p_size > 25)
SELECT alias_lc, name FROM a ANTI JOIN (SELECT DISTINCT lower(p_name) AS alias_lc, p_brand AS name FROM part WHERE p_retailprice > 1850) r
  ON a.alias_lc = r.alias_lc AND a.name = r.name""")
def alias_edit(t: Tables):
    """Names of small parts are there, those of large ones are added, those of dear ones removed."""
    pairs = t("part").select(F.lower("p_name").alias("alias_lc"), F.col("p_brand").alias("name"), "p_size", "p_retailprice")
    pick = lambda condition: pairs.where(condition).select("alias_lc", "name").distinct()
    return C.edit_aliases(pick(F.col("p_size") <= 25), pick(F.col("p_size") > 25), pick(F.col("p_retailprice") > 1850))


@query("pending_versions", sql="""SELECT DISTINCT strftime(l_shipdate, '%Y%m') AS version FROM lineitem
WHERE strftime(l_shipdate, '%Y%m') NOT IN (SELECT strftime(o_orderdate, '%Y%m') FROM orders)""")
def pending_versions(t: Tables):
    """Ship months that no order month covers."""
    month = lambda table, c: t(table).select(F.date_format(c, "yyyyMM").alias("version")).distinct()
    return C.pending(month("lineitem", "l_shipdate"), month("orders", "o_orderdate"))
