"""Derived metrics, observations and materiality over the fact view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledger_spark.operators import metrics as M
from ledger_spark.plans.registry import FM_SQL, Tables, big, query, r4
from ledger_spark.sources import sinks

OBS_COLUMNS = ("observation_id, observation_name, company_id, metric_name, period_type, period_label, "
               "current_value, reference_value, calculated_value")

# Each observation as its own SQL over fm; %s-free, so they can be stacked with UNION ALL.
OBS_SQL = {
    "growth_mom": """SELECT 20001 AS observation_id, 'growth_mom' AS observation_name, c.company_id, c.line_item AS metric_name,
        c.period_type, c.period_label, c.v AS current_value, p.v AS reference_value, (c.v-p.v)/p.v*100 AS calculated_value
      FROM act c JOIN act p USING (company_id, line_item, period_type)
      WHERE c.period_type = 'Monthly' AND p.start_date = c.start_date - INTERVAL 1 MONTH AND p.v <> 0""",
    "growth_qoq": """SELECT 20002, 'growth_qoq', c.company_id, c.line_item, c.period_type, c.period_label, c.v, p.v, (c.v-p.v)/p.v*100
      FROM act c JOIN act p USING (company_id, line_item, period_type)
      WHERE c.period_type = 'Quarterly' AND p.start_date = c.start_date - INTERVAL 3 MONTH AND p.v <> 0""",
    "growth_yoy": """SELECT 20003, 'growth_yoy', company_id, line_item, period_type, period_label, v, pv, (v-pv)/pv*100
      FROM (SELECT *, max(v) OVER (PARTITION BY company_id, line_item, period_type ORDER BY start_date
              RANGE BETWEEN INTERVAL 12 MONTH PRECEDING AND INTERVAL 12 MONTH PRECEDING) AS pv FROM act)
      WHERE pv <> 0""",
    "variance_vs_budget": """SELECT 20004, 'variance_vs_budget', company_id, line_item, period_type, period_label, a, b, (a-b)/b*100
      FROM (SELECT company_id, line_item, period_type, period_label,
              CAST(max(value) FILTER (WHERE value_type = 'Actual') AS DOUBLE) AS a,
              CAST(max(value) FILTER (WHERE value_type = 'Budget') AS DOUBLE) AS b FROM fm GROUP BY ALL)
      WHERE a IS NOT NULL AND b <> 0""",
    "variance_vs_forecast": """SELECT 20005, 'variance_vs_forecast', company_id, line_item, period_type, period_label, a, b, (a-b)/b*100
      FROM (SELECT company_id, line_item, period_type, period_label,
              CAST(max(value) FILTER (WHERE value_type = 'Actual') AS DOUBLE) AS a,
              CAST(max(value) FILTER (WHERE value_type = 'Forecast') AS DOUBLE) AS b FROM fm GROUP BY ALL)
      WHERE a IS NOT NULL AND b <> 0""",
    "ytd_performance": """SELECT 20006, 'ytd_performance', c.company_id, c.line_item, 'Yearly', 'YTD ' || c.y, c.s, p.s, (c.s-p.s)/p.s*100
      FROM (SELECT company_id, line_item, year(start_date) AS y, CAST(sum(value) AS DOUBLE) AS s FROM act
            WHERE period_type = 'Monthly' GROUP BY ALL) c
      JOIN (SELECT company_id, line_item, year(start_date) AS y, CAST(sum(value) AS DOUBLE) AS s FROM act
            WHERE period_type = 'Monthly' GROUP BY ALL) p
        ON c.company_id = p.company_id AND c.line_item = p.line_item AND p.y = c.y - 1
      WHERE p.s <> 0""",
    "trend_direction": """SELECT 20007, 'trend_direction', company_id, line_item, 'Monthly', max_by(period_label, start_date),
        regr_slope(v, n), avg(v), regr_slope(v, n)/avg(v)
      FROM (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY company_id, line_item) AS cnt
            FROM act WHERE period_type = 'Monthly'
            WINDOW w AS (PARTITION BY company_id, line_item ORDER BY start_date))
      WHERE n > cnt - 6 GROUP BY company_id, line_item HAVING count(*) >= 3""",
    "volatility_measure": """SELECT 20008, 'volatility_measure', t.company_id, t.line_item, 'Monthly', l.period_label, t.s, t.m, t.s/t.m
      FROM (SELECT company_id, line_item, stddev_samp(v) AS s, avg(v) AS m FROM act, nowd
            WHERE period_type = 'Monthly' AND start_date >= d - INTERVAL 12 MONTH AND v > 0
            GROUP BY company_id, line_item HAVING count(*) >= 6) t
      JOIN (SELECT company_id, line_item, max_by(period_label, start_date) AS period_label FROM act
            WHERE period_type = 'Monthly' GROUP BY ALL) l USING (company_id, line_item)""",
    "seasonal_variance": """SELECT 20009, 'seasonal_variance', c.company_id, c.line_item, 'Monthly', c.period_label, c.v, s.m, (c.v-s.m)/s.m*100
      FROM act c JOIN (SELECT company_id, line_item, month(start_date) AS mo, avg(v) AS m FROM act, nowd
            WHERE period_type = 'Monthly' AND start_date >= d - INTERVAL 36 MONTH
            GROUP BY ALL HAVING count(*) >= 2) s
        ON c.company_id = s.company_id AND c.line_item = s.line_item AND month(c.start_date) = s.mo, nowd
      WHERE c.period_type = 'Monthly' AND c.start_date >= d - INTERVAL 3 MONTH AND s.m <> 0""",
    "absolute_change": """SELECT 20010, 'absolute_change', company_id, line_item, period_type, period_label, v, pv, abs(v-pv)
      FROM (SELECT *, max(v) OVER (PARTITION BY company_id, line_item, period_type ORDER BY period_seq
              RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS pv FROM act)
      WHERE pv IS NOT NULL""",
    "magnitude_check": """SELECT 20011, 'magnitude_check', c.company_id, c.line_item, 'Monthly', c.period_label, c.v, h.m, (c.v-h.m)/h.s
      FROM act c JOIN (SELECT company_id, line_item, avg(v) AS m, stddev_samp(v) AS s FROM act, nowd
            WHERE period_type = 'Monthly' AND start_date >= d - INTERVAL 24 MONTH
            GROUP BY ALL HAVING count(*) >= 12 AND stddev_samp(v) > 0) h USING (company_id, line_item), nowd
      WHERE c.period_type = 'Monthly' AND c.start_date >= d - INTERVAL 1 MONTH""",
    "efficiency_ratio": """SELECT 20012, 'efficiency_ratio', c.company_id, c.line_item, c.period_type, c.period_label, c.r, p.r, c.r
      FROM ratio c LEFT JOIN ratio p ON c.company_id = p.company_id AND c.line_item = p.line_item
        AND c.period_type = p.period_type AND p.period_seq = c.period_seq - 1
      WHERE c.line_item = 'Gross Profit'""",
    "margin_analysis": """SELECT 20013, 'margin_analysis', c.company_id, c.line_item, c.period_type, c.period_label, c.r*100, p.r*100, c.r*100
      FROM ratio c LEFT JOIN ratio p ON c.company_id = p.company_id AND c.line_item = p.line_item
        AND c.period_type = p.period_type AND p.period_seq = c.period_seq - 1""",
}
RATIO_SQL = """,
ratio AS (SELECT m.company_id, m.line_item, m.period_type, m.period_label, m.period_seq, m.v/r.v AS r
  FROM act m JOIN act r USING (company_id, period_type, period_label)
  WHERE m.line_item IN ('Gross Profit', 'EBITDA') AND r.line_item = 'Revenue' AND r.v > 0)
"""
MONTHLY_ACTUALS = M.needs(["growth_mom"])
_HEADER = f"obs({OBS_COLUMNS})"
MATERIAL_SQL = """,
limits AS (SELECT *, CASE
    WHEN observation_name = 'trend_direction' THEN 0.02 WHEN observation_name = 'volatility_measure' THEN 0.15
    WHEN observation_name = 'absolute_change' THEN 0.0 WHEN observation_name = 'magnitude_check' THEN 2.0
    WHEN observation_name = 'efficiency_ratio' THEN 0.05
    ELSE 100 * CASE metric_name WHEN 'Revenue' THEN 0.03 WHEN 'Gross Profit' THEN 0.04 WHEN 'EBITDA' THEN 0.06
         ELSE CASE WHEN observation_name = 'variance_vs_budget' THEN 0.03 ELSE 0.05 END END END AS threshold FROM obs),
material AS (SELECT * FROM limits
  WHERE CASE WHEN observation_name = 'efficiency_ratio' THEN abs(calculated_value - 1) ELSE abs(calculated_value) END >= threshold)
"""


def obs_with(names=None) -> str:
    """WITH list up to `obs` and `material` for the named observations."""
    parts = [OBS_SQL[n] for n in (names or OBS_SQL)]
    return FM_SQL + RATIO_SQL + f", {_HEADER} AS (" + " UNION ALL ".join(parts) + ")" + MATERIAL_SQL


def obs_select(extra: str = "", source: str = "obs") -> str:
    return (f"SELECT {big('observation_id', 'observation_id')}, observation_name, "
            f"{big('company_id', 'company_id')}, metric_name, period_type, period_label, "
            f"{r4('current_value', 'current_value')}, {r4('reference_value', 'reference_value')}, "
            f"{r4('calculated_value', 'calculated_value')}{extra} FROM {source}")


def _material_sql(*names: str) -> str:
    return f"WITH {obs_with(names)} {obs_select(', ' + r4('threshold', 'threshold'), 'material')}"


def _register(key: str, name: str, what: str) -> None:
    @query(key, sql=_material_sql(name))
    def run(t: Tables):
        return M.materiality_filter(t.observe([name]))
    run.__doc__ = what


_register("growth_mom", "growth_mom", "Material month-over-month growth.")
_register("growth_qoq", "growth_qoq", "Material quarter-over-quarter growth.")
_register("growth_yoy", "growth_yoy", "Material growth on the same period a year earlier.")
_register("variance_vs_budget", "variance_vs_budget", "Material variance against budget.")
_register("variance_vs_forecast", "variance_vs_forecast", "Material variance against forecast.")
_register("volatility", "volatility_measure", "Material coefficient of variation.")
_register("seasonal_variance", "seasonal_variance", "Material deviation from the seasonal mean.")
_register("magnitude_check", "magnitude_check", "Material z-score against two years.")
_register("efficiency_ratio", "efficiency_ratio", "Gross profit to revenue, away from one.")
_register("margin_analysis", "margin_analysis", "Margins on revenue.")


@query("absolute_change", sql=f"WITH {obs_with(['growth_mom', 'absolute_change'])} "
       f"{obs_select('', 'obs')} WHERE observation_id = 20010 AND calculated_value >= 1000")
def absolute_change(t: Tables):
    return t.observe(["absolute_change"]).where(F.col("calculated_value") >= 1000)


@query("ytd_total", sql=f"WITH {FM_SQL} SELECT {big('company_id', 'company_id')}, line_item, "
       f"{big('year(start_date)', 'year')}, {r4('sum(value)', 'ytd_value')}, {big('count(*)', 'months')} "
       "FROM act WHERE period_type = 'Monthly' GROUP BY company_id, line_item, year(start_date)")
def ytd_total(t: Tables):
    return M.ytd_total(t.fm_for(MONTHLY_ACTUALS)).drop("base_metric_id")


@query("ytd_running", sql=f"WITH {FM_SQL} SELECT {big('company_id', 'company_id')}, line_item, period_label, "
       f"{r4('value', 'value')}, {r4('(SELECT sum(b.value) FROM act b WHERE b.company_id = a.company_id AND b.line_item = a.line_item AND b.period_type = a.period_type AND year(b.start_date) = year(a.start_date) AND b.start_date <= a.start_date)', 'ytd_value')} "
       "FROM act a WHERE period_type = 'Monthly'")
def ytd_running(t: Tables):
    return M.ytd_running(t.fm_for(MONTHLY_ACTUALS)).select("company_id", "line_item", "period_label", "value", "ytd_value")


@query("ytd_growth", sql=f"WITH {obs_with()} {obs_select(', ' + r4('threshold', 'threshold'), 'material')} "
       "WHERE observation_id = 20006")
def ytd_growth(t: Tables):
    return M.materiality_filter(M.ytd_growth(t.fm_for(MONTHLY_ACTUALS)))


@query("trend_stats", sql=f"WITH {FM_SQL} SELECT {big('company_id', 'company_id')}, line_item AS metric_name, "
       f"{r4('avg(v)', 'avg_value')}, {r4('stddev_samp(v)', 'volatility')}, {big('count(*)', 'period_count')} "
       "FROM act, nowd WHERE period_type = 'Monthly' AND start_date >= d - INTERVAL 12 MONTH "
       "GROUP BY company_id, line_item HAVING count(*) >= 3")
def trend_stats(t: Tables):
    needs = M.needs(["volatility_measure"])
    return M.trend_stats(t.fm_for(needs), t.now_for(needs))


@query("trend_slope", sql=f"""WITH {FM_SQL}, last6 AS (
  SELECT *, row_number() OVER (PARTITION BY company_id, line_item ORDER BY start_date) AS n,
         row_number() OVER (PARTITION BY company_id, line_item ORDER BY start_date DESC) AS age
  FROM act WHERE period_type = 'Monthly'),
s AS (SELECT company_id, line_item AS metric_name, regr_slope(v, n) AS slope, avg(v) AS mean_value, count(*) AS periods
      FROM last6 WHERE age <= 6 GROUP BY ALL)
SELECT {big('company_id', 'company_id')}, metric_name, {r4('slope', 'slope')}, {r4('mean_value', 'mean_value')},
  {big('periods', 'periods')}, {r4('slope/mean_value', 'relative_slope')},
  CASE WHEN slope/mean_value >= 0.02 THEN 'up' WHEN slope/mean_value <= -0.02 THEN 'down' ELSE 'flat' END AS direction FROM s""")
def trend_slope(t: Tables):
    return M.trend_slope(t.fm_for(MONTHLY_ACTUALS))


@query("outlier_flags", sql=f"""WITH {FM_SQL}, s AS (
  SELECT company_id, line_item, period_type, value_type, avg(CAST(value AS DOUBLE)) AS m,
         stddev_samp(CAST(value AS DOUBLE)) AS s FROM fm GROUP BY ALL)
SELECT {big('f.company_id', 'company_id')}, f.line_item, f.period_type, f.period_label, f.value_type, {r4('f.value', 'value')},
  {r4('(CAST(f.value AS DOUBLE) - s.m) / s.s', 'z_score')}
FROM fm f JOIN s USING (company_id, line_item, period_type, value_type)
WHERE abs(CAST(f.value AS DOUBLE) - s.m) > 2 * s.s""")
def outlier_flags(t: Tables):
    z = (F.col("value").cast("double") - F.col("mean_value")) / F.col("std_value")
    return M.outliers(t.fm, k=2.0).where("is_outlier").select(
        "company_id", "line_item", "period_type", "period_label", "value_type", "value", z.alias("z_score"))


@query("materiality_filter", sql=_material_sql("growth_mom", "variance_vs_budget", "variance_vs_forecast"))
def materiality_filter(t: Tables):
    return M.materiality_filter(t.observe(["growth_mom", "variance_vs_budget", "variance_vs_forecast"]))


@query("all_observations", sql=f"WITH {obs_with()} {obs_select()}")
def all_observations(t: Tables):
    return M.all_observations(t.fm, t.as_of)


_CALC = " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in [
    ("growth_mom", "MoM Growth"), ("growth_qoq", "QoQ Growth"), ("growth_yoy", "YoY Growth"),
    ("ytd_performance", "YTD Growth")])


@query("derived_metrics", sql=f"""WITH {obs_with(['growth_mom', 'growth_qoq', 'growth_yoy', 'ytd_performance'])},
d AS (SELECT *, CASE observation_name {_CALC} END AS ct,
      md5(concat_ws('_', company_id, period_label, metric_name, 'Actual', '')) AS base FROM material)
SELECT {big('company_id', 'company_id')}, period_label, metric_name, ct AS calculation_type, base AS base_metric_id,
  {r4('CAST(calculated_value AS DECIMAL(28,4))', 'calculated_value')}, '%' AS unit, base AS source_ids,
  ct || ' for ' || period_label AS calculation_note, 'Ok' AS corroboration_status, period_type AS frequency FROM d""")
def derived_metrics(t: Tables):
    growth = t.observe(["growth_mom", "growth_qoq", "growth_yoy", "ytd_performance"])
    return M.derived_rows(M.materiality_filter(growth))


_WEIGHTS = """CASE WHEN observation_id IN (20001,20002,20003,20006) THEN 1.0 WHEN observation_id IN (20004,20005) THEN 0.9
  WHEN observation_id IN (20007,20008,20009) THEN 0.7 WHEN observation_id IN (20010,20011) THEN 0.5 ELSE 0.8 END"""
_IMPORTANCE = """CASE WHEN observation_id IN (20001,20003,20004) THEN 5 WHEN observation_id IN (20002,20005,20006,20013) THEN 4
  WHEN observation_id IN (20007,20009,20011,20012) THEN 3 ELSE 2 END"""


@query("weighted_observations", sql=f"""WITH {obs_with()}
SELECT observation_name, {big(_IMPORTANCE, 'importance')}, {r4(_WEIGHTS, 'family_weight')},
  {r4(f'CAST({_IMPORTANCE} AS DOUBLE) * CAST({_WEIGHTS} AS DOUBLE)', 'score')}, {big('count(*)', 'rows')}
FROM material GROUP BY observation_id, observation_name""")
def weighted_observations(t: Tables):
    return (M.weighted(t.material).groupBy("observation_name", "importance", "family_weight", "score")
             .agg(F.count(F.lit(1)).alias("rows")))


@query("latest_cell", sql="""
SELECT CAST(s_nationkey AS BIGINT) AS company_id, 'Revenue' AS line_item, 'Monthly' AS period_type,
  strftime(l_shipdate, '%Y-%m') AS period_label, l_returnflag AS value_type,
  round(CAST(max_by(CAST(l_extendedprice AS DECIMAL(15,2)), l_orderkey * 10 + l_linenumber) AS DOUBLE), 4) + 0.0 AS value
FROM (SELECT s.s_nationkey, l.*, row_number() OVER (PARTITION BY s.s_nationkey, strftime(l_shipdate, '%Y-%m'), l_returnflag
        ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn
      FROM lineitem l JOIN supplier s ON l_suppkey = s_suppkey)
WHERE rn = 1 GROUP BY ALL""")
def latest_cell(t: Tables):
    """Every line is one file's version of a cell; the last ingested wins."""
    from ledger_spark.operators.normalize import latest_cell as latest
    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("company_id"), F.lit("Revenue").alias("line_item"),
        F.lit("Monthly").alias("period_type"), F.date_format("l_shipdate", "yyyy-MM").alias("period_label"),
        F.col("l_returnflag").alias("value_type"), F.col("l_extendedprice").cast("decimal(15,2)").alias("value"),
        "l_orderkey", "l_linenumber")
    return latest(rows, ["l_orderkey", "l_linenumber", "value"])


@query("derived_upsert", sql=f"""WITH {FM_SQL},
y AS (SELECT company_id, line_item, year(start_date) AS y, CAST(sum(value) AS DOUBLE) AS s FROM act
      WHERE period_type = 'Monthly' GROUP BY ALL)
SELECT {big('company_id', 'company_id')}, line_item, {big('y', 'year')},
  {r4('CASE WHEN y >= (SELECT year(d) - 1 FROM nowd) THEN s * 2 ELSE s END', 'value')},
  {big('CASE WHEN y >= (SELECT year(d) - 1 FROM nowd) THEN 2 ELSE 1 END', 'version')} FROM y""")
def derived_upsert(t: Tables):
    """Year totals, of which the last two years arrive again with doubled values."""
    totals = M.ytd_total(t.fm_for(MONTHLY_ACTUALS)).select("company_id", "line_item", "year", F.col("ytd_value").cast("double").alias("value"))
    again = totals.where(F.col("year") >= F.year(t.as_of) - 1).select(
        "company_id", "line_item", "year", (F.col("value") * 2).alias("value"), F.lit(2).alias("version"))
    return sinks.upsert(totals.withColumn("version", F.lit(1)), again, ["company_id", "line_item", "year"], "version")
