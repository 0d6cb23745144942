"""Questions: matching, rendering, ranking, records, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledger_spark import settings
from ledger_spark.functions import values as V
from ledger_spark.operators import metrics as M, questions as Q
from ledger_spark.plans.metric_queries import obs_with
from ledger_spark.plans.registry import FM_SQL, Tables, big, query, r4
from ledger_spark.sources import dimensions as D

_ROWS = ", ".join(f"({i}, {o}, {imp}, '{cat}', '{pri}', {w}::DOUBLE)" for i, o, imp, cat, pri, w, _ in settings.TEMPLATES)
TEMPLATES_SQL = f", tpl(template_id, observation_id, importance, category, priority, weight) AS (VALUES {_ROWS})"
MATCHED_SQL = obs_with() + TEMPLATES_SQL + ", matched AS (SELECT * FROM material JOIN tpl USING (observation_id))"


def _money(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', coalesce({x}, 0.0::DOUBLE))"


def _short(x: str, places: int) -> str:
    text = f"CAST(CAST(coalesce({x}, 0.0) AS DECIMAL(30,{places})) AS VARCHAR)"
    return f"regexp_replace({text}, '(\\.[0-9]+?)0+$', '\\1')" if places > 1 else text


def _pick(test: str, yes: str, no: str) -> str:
    return f"CASE WHEN {test} THEN '{yes}' ELSE '{no}' END"


_PCT = _short("CASE WHEN reference_value <> 0 THEN (current_value - reference_value) / reference_value * 100 END", 2)
_CUR, _REF = _money("current_value"), _money("reference_value")
_GAP, _AGAP = _money("current_value - coalesce(reference_value, 0)"), _money("abs(current_value - coalesce(reference_value, 0))")
_UP = "coalesce(current_value > reference_value, false)"
_POS = "calculated_value > 0"

# The rendered sentences, written out again for DuckDB.
_TEXT = {
    30001: f"metric_name || ' changed ' || {_PCT} || '% month-over-month (' || {_CUR} || ' vs ' || {_REF} || '). What operational factors drove this ' || {_pick(_UP, 'growth', 'decline')} || '?'",
    30002: f"metric_name || ' showed ' || {_PCT} || '% growth quarter-over-quarter. How does this align with our quarterly targets and strategic initiatives?'",
    30003: f"'Year-over-year ' || metric_name || ' ' || {_pick(_UP, 'increased', 'decreased')} || ' by ' || {_PCT} || '% (' || {_AGAP} || '). What strategic initiatives contributed to this performance?'",
    30004: f"'Year-to-date ' || metric_name || ' is ' || {_PCT} || '% ' || {_pick(_UP, 'ahead of', 'behind')} || ' last year. Are we on track for annual targets?'",
    30011: f"metric_name || ' is ' || {_PCT} || '% ' || {_pick(_UP, 'above', 'below')} || ' budget (' || {_CUR} || ' vs ' || {_REF} || '). What explains this variance and what actions are required?'",
    30012: f"'🚨 CRITICAL: ' || metric_name || ' variance of ' || {_PCT} || '% impacts ' || {_AGAP} || '. What immediate corrective actions are required?'",
    30013: f"metric_name || ' came in ' || {_PCT} || '% ' || {_pick(_UP, 'higher', 'lower')} || ' than forecast. Should we adjust our forecasting methodology or expectations?'",
    30021: f"metric_name || ' shows a ' || {_pick(_POS, 'positive', 'negative')} || ' trend over the past 6 periods. Is this trend sustainable and aligned with our strategic direction?'",
    30022: f"metric_name || ' volatility is ' || {_short('calculated_value * 100', 1)} || '%. What factors are driving this variability and how can we improve predictability?'",
    30023: f"metric_name || ' is ' || {_PCT} || '% ' || {_pick(_UP, 'above', 'below')} || ' seasonal norm. What changed our typical seasonal patterns?'",
    30031: f"'Absolute change in ' || metric_name || ' was ' || {_money('calculated_value')} || '. Is this magnitude significant relative to our scale of operations?'",
    30032: f"metric_name || ' is ' || {_short('calculated_value', 1)} || ' standard deviations ' || {_pick(_POS, 'above', 'below')} || ' its historical mean. Should this outlier be investigated further?'",
    30041: f"metric_name || ' ratio is ' || {_short('calculated_value', 2)} || ', ' || {_pick(_UP, 'improving', 'declining')} || ' from prior periods. How does this impact our operational efficiency targets?'",
    30042: f"metric_name || ' margin is ' || {_short('calculated_value', 1)} || '%, ' || {_pick(_UP, 'up', 'down')} || ' ' || {_short('abs(current_value - reference_value)', 1)} || '% points. How does this compare to industry benchmarks and competitors?'",
    30051: f"'Monthly ' || metric_name || ' performance shows ' || {_PCT} || '% change. What specific business drivers contributed to this result?'",
    30052: f"'Annual ' || metric_name || ' growth of ' || {_PCT} || '% represents ' || {_GAP} || ' impact. How does this position us for next year''s planning?'",
}
_CASE = "CASE template_id " + " ".join(f"WHEN {k} THEN {v}" for k, v in _TEXT.items()) + " END"
RENDERED_SQL = MATCHED_SQL + f", rendered AS (SELECT *, {_CASE} AS question_text FROM matched)"
RANKED_SQL = RENDERED_SQL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id
  ORDER BY importance DESC, weight DESC, abs(coalesce(calculated_value, 0)) DESC, template_id, metric_name, period_type, period_label) AS rank
  FROM rendered)"""


@query("observation_templates", sql=f"WITH {MATCHED_SQL} SELECT {big('observation_id', 'observation_id')}, "
       f"{big('template_id', 'template_id')}, category, {big('count(*)', 'questions')} FROM matched GROUP BY ALL")
def observation_templates(t: Tables):
    return t.questions.groupBy("observation_id", "template_id", "category").agg(F.count(F.lit(1)).alias("questions"))


@query("rendered_questions", sql=f"WITH {RENDERED_SQL} SELECT {big('company_id', 'company_id')}, "
       f"{big('template_id', 'template_id')}, metric_name, period_type, period_label, question_text FROM rendered")
def rendered_questions(t: Tables):
    return Q.render(t.questions).select("company_id", "template_id", "metric_name", "period_type", "period_label",
                                        "question_text")


@query("top_questions", sql=f"WITH {RANKED_SQL} SELECT {big('company_id', 'company_id')}, {big('rank', 'rank')}, "
       f"{big('template_id', 'template_id')}, metric_name, period_label, {big('importance', 'importance')}, "
       f"{r4('weight', 'weight')}, {r4('calculated_value', 'calculated_value')}, question_text FROM ranked WHERE rank <= 10")
def top_questions(t: Tables):
    """Ranked before rendering, so only the kept rows are turned into text."""
    return Q.render(Q.top_questions(t.questions)).select(
        "company_id", "rank", "template_id", "metric_name", "period_label", "importance", "weight",
        "calculated_value", "question_text")


@query("question_summary", sql=f"""WITH {MATCHED_SQL}
SELECT 'total' AS dimension, 'all' AS member, {big('count(*)', 'questions')} FROM matched
UNION ALL SELECT 'category', category, count(*) FROM matched GROUP BY category
UNION ALL SELECT 'importance', CAST(importance AS VARCHAR), count(*) FROM matched GROUP BY importance""")
def question_summary(t: Tables):
    return Q.question_summary(t.questions)


@query("question_records", sql=f"""WITH {RENDERED_SQL} SELECT {big('company_id', 'company_id')}, question_text, category,
  {big('5', 'priority')}, CAST(template_id AS VARCHAR) AS template_id, metric_name, period_label,
  {r4('calculated_value', 'calculated_value')} FROM rendered""")
def question_records(t: Tables):
    """Question rows, with some fields read back out of their JSON context."""
    field = lambda path: F.get_json_object("metric_context", path)
    return Q.question_rows(Q.render(t.questions)).select(
        "company_id", "question_text", "category", "priority", field("$.template_id").alias("template_id"),
        field("$.context.metric_name").alias("metric_name"), field("$.context.period_label").alias("period_label"),
        field("$.context.calculated_value").try_cast("double").alias("calculated_value"))


@query("format_helpers", sql=f"""SELECT {big('l_orderkey', 'l_orderkey')}, {big('l_linenumber', 'l_linenumber')},
  {_short('(l_extendedprice - l_quantity * 1000) / l_extendedprice * 100', 2)} AS percent_text,
  {_money('l_extendedprice')} AS currency_text, {_money('abs(l_quantity * 1000 - l_extendedprice)')} AS abs_text,
  {_short('sqrt(l_extendedprice)', 1)} AS smart_text, CASE WHEN l_tax > 0.04 THEN 'above' ELSE 'below' END AS choice
FROM lineitem""")
def format_helpers(t: Tables):
    price, floor = F.col("l_extendedprice"), F.col("l_quantity") * 1000
    return t("lineitem").select(
        "l_orderkey", "l_linenumber",
        V.short_decimal(F.try_divide(price - floor, price) * 100, 2).alias("percent_text"),
        V.format_currency(price).alias("currency_text"), V.format_abs(floor - price).alias("abs_text"),
        V.short_decimal(F.sqrt(price), 1).alias("smart_text"),
        F.when(F.col("l_tax") > 0.04, "above").otherwise("below").alias("choice"))


@query("template_stats", sql=f"""WITH {MATCHED_SQL}, used AS (SELECT DISTINCT tpl.* FROM tpl JOIN matched USING (template_id))
SELECT {big('count(*)', 'total_templates')}, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
  string_agg(DISTINCT priority, ',' ORDER BY priority) AS priorities, {big('min(importance)', 'importance_min')},
  {big('max(importance)', 'importance_max')},
  string_agg(DISTINCT CAST(observation_id AS VARCHAR), ',' ORDER BY CAST(observation_id AS VARCHAR)) AS linked_observations
FROM used""")
def template_stats(t: Tables):
    """Statistics of the templates that the data makes use of."""
    used = D.templates(t.spark).join(t.material.select("observation_id").distinct(), "observation_id", "left_semi")
    return Q.template_stats(used)


@query("template_validation", sql=f"""WITH {obs_with(['growth_mom', 'growth_qoq', 'variance_vs_budget'])}{TEMPLATES_SQL}
SELECT {big('template_id', 'template_id')}, 'warning' AS severity, 'unknown observation' AS rule FROM tpl
WHERE observation_id NOT IN (SELECT observation_id FROM material)""")
def template_validation(t: Tables):
    """Templates checked against the observations that the data produces."""
    made = M.materiality_filter(t.observe(["growth_mom", "growth_qoq", "variance_vs_budget"]))
    return Q.template_validation(D.templates(t.spark), made.select("observation_id"))


_DRAFTS = {  # a template drafted for every part, with faults by its key
    "template_id": "CASE WHEN p_partkey % 11 <> 0 THEN 29990 + p_partkey % 20 END",
    "observation_id": "CASE WHEN p_partkey % 7 <> 0 THEN 20001 + p_partkey % 4 END",
    "template_text": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END",
    "category": "CASE WHEN p_partkey % 13 <> 0 THEN p_brand END",
    "priority": "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'high' END",
    "importance": "CASE WHEN p_partkey % 19 <> 0 THEN p_size END",
}


@query("template_draft_faults", sql=f"""WITH {obs_with(['growth_mom', 'variance_vs_budget'])},
drafts AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _DRAFTS.items())} FROM part),
faults AS ({' UNION ALL '.join(f"SELECT template_id, 'error' AS severity, 'missing {c}' AS rule FROM drafts WHERE coalesce(CAST({c} AS VARCHAR), '') = ''" for c in _DRAFTS)}
  UNION ALL SELECT template_id, 'warning', 'unknown observation' FROM drafts WHERE observation_id NOT IN (SELECT observation_id FROM material)
  UNION ALL SELECT template_id, 'warning', 'id out of range' FROM drafts WHERE template_id < 30001 OR template_id > 39999)
SELECT {big('template_id', 'template_id')}, severity, rule, {big('count(*)', 'drafts')} FROM faults GROUP BY ALL""")
def template_draft_faults(t: Tables):
    """Every rule of the validation, over drafts that break each of them."""
    drafts = t("part").selectExpr(*[f"{x} as {c}" for c, x in _DRAFTS.items()])
    made = M.materiality_filter(t.observe(["growth_mom", "variance_vs_budget"]))
    return (Q.template_validation(drafts, made.select("observation_id"))
             .groupBy("template_id", "severity", "rule").agg(F.count(F.lit(1)).alias("drafts")))


@query("live_questions", sql=f"""WITH {RENDERED_SQL},
dated AS (SELECT company_id, question_text, observation_id,
  CAST(CASE WHEN period_label LIKE 'YTD %' THEN substr(period_label, 5, 4) || '-12-31'
       WHEN period_label LIKE '%-Q%' THEN substr(period_label, 1, 4) || '-' || lpad(CAST(CAST(substr(period_label, 7, 1) AS INT) * 3 AS VARCHAR), 2, '0') || '-28'
       WHEN length(period_label) = 4 THEN period_label || '-12-31' ELSE period_label || '-28' END AS DATE) AS expires_at FROM rendered),
fresh AS (SELECT company_id, question_text, max(expires_at) AS expires_at FROM dated GROUP BY ALL)
SELECT {big('f.company_id', 'company_id')}, f.question_text, CAST(f.expires_at AS VARCHAR) AS expires_at,
  CASE WHEN f.expires_at < (SELECT d FROM nowd) THEN 'expired' ELSE 'live' END AS status
FROM fresh f ANTI JOIN (SELECT company_id, question_text FROM dated WHERE observation_id = 20001) e
  ON f.company_id = e.company_id AND f.question_text = e.question_text""")
def live_questions(t: Tables):
    """Everything but the monthly-growth questions is new; those are live already."""
    label = F.col("period_label")
    year = F.regexp_extract(label, "[0-9]{4}", 0)
    day = (F.when(label.startswith("YTD ") | (F.length(label) == 4), F.concat(year, F.lit("-12-31")))
            .when(label.contains("-Q"), F.concat(year, F.lit("-"), F.lpad(
                (F.right(label, F.lit(1)).try_cast("int") * 3).cast("string"), 2, "0"), F.lit("-28")))
            .otherwise(F.concat(label, F.lit("-28"))))
    rows = Q.render(t.questions).select("company_id", "question_text", "observation_id",
                                        day.cast("date").alias("expires_at"))
    return Q.unlisted_questions(rows, F.col("observation_id") == 20001, t.as_of)


_VARIANCE_TEXT = [text for cat, _, text in settings.PLACEHOLDER_TEMPLATES if cat == "variance_analysis"]


@query("template_placeholders", sql=f"""WITH {obs_with(['growth_mom', 'variance_vs_budget'])},
v AS (SELECT *, CAST(CAST(abs(calculated_value) AS DECIMAL(30,2)) AS VARCHAR) AS p,
   CASE WHEN calculated_value > 0 THEN 'above' ELSE 'below' END AS dir,
   CAST(CAST(current_value AS DECIMAL(30,2)) AS VARCHAR) AS cur, CAST(CAST(reference_value AS DECIMAL(30,2)) AS VARCHAR) AS ref
   FROM material WHERE observation_id = 20004)
SELECT {big('company_id', 'company_id')}, metric_name, period_label, {big('5', 'priority')},
  'variance_percent,variance_direction,actual_value,budget_value' AS variables,
  'Revenue is ' || p || '% ' || dir || ' budget ($' || cur || ' vs $' || ref || '). What explains this variance and what actions are required?' AS question_text
FROM v
UNION ALL SELECT company_id, metric_name, period_label, 4, 'metric_name,variance_percent,variance_direction',
  metric_name || ' is ' || p || '% ' || dir || ' than expected. What factors contributed to this variance?' FROM v""")
def template_placeholders(t: Tables):
    rows = M.materiality_filter(t.observe(["variance_vs_budget"]))
    tpl = Q.placeholders(D.placeholder_templates(t.spark).where(F.col("category") == "variance_analysis"))
    money = lambda c: F.col(c).cast("decimal(30,2)").cast("string")
    text = Q.fill_placeholders(F.col("question_text"), {
        "metric_name": F.col("metric_name"), "actual_value": money("current_value"),
        "budget_value": money("reference_value"),
        "variance_percent": F.abs("calculated_value").cast("decimal(30,2)").cast("string"),
        "variance_direction": F.when(F.col("calculated_value") > 0, "above").otherwise("below")})
    families = D.observations(t.spark).select("observation_id", "category")
    rows = rows.join(families, "observation_id").join(tpl, "category")
    return rows.select("company_id", "metric_name", "period_label", "priority", "variables",
                       text.alias("question_text"))
