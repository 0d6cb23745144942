"""Observations on small facts: gaps, zero bases, thresholds, questions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledger_spark.functions import periods as P
from ledger_spark.operators import metrics as M, questions as Q

def as_of():
    return F.lit("2025-12-01").cast("date")


def facts(spark, rows):
    """(company, item, kind, start, value type, value) -> fact view."""
    df = spark.createDataFrame(rows, "company_id int, line_item string, period_type string, start_date date, "
                                     "value_type string, value double")
    kind, first = F.col("period_type"), F.col("start_date")
    return df.withColumns({"period_label": P.period_label(first, kind), "period_seq": P.period_seq(first, kind),
                           "value": F.col("value").cast("decimal(28,2)")})


def month(n, item="Revenue", vt="Actual", value=100.0, year=2025):
    return (1, item, "Monthly", dt.date(year, n, 1), vt, value)


def values(df, name):
    return {r["period_label"]: r["calculated_value"] for r in df.where(F.col("observation_name") == name).collect()}


def test_growth_skips_gaps_and_zero(spark):
    fm = facts(spark, [month(1, value=100.0), month(2, value=110.0), month(4, value=120.0), month(5, value=0.0),
                       month(6, value=5.0), month(1, value=50.0, year=2024),
                       (1, "Revenue", "Quarterly", dt.date(2025, 1, 1), "Actual", 300.0)])
    assert values(M.observe(fm, as_of()), "growth_mom") == {"2025-02": pytest.approx(10.0), "2025-05": pytest.approx(-100.0)}
    assert values(M.observe(fm, as_of()), "growth_yoy") == {"2025-01": pytest.approx(100.0)}
    assert values(M.observe(fm, as_of()), "growth_qoq") == {}


def test_variance_and_ratio(spark):
    fm = facts(spark, [month(1, value=110.0), month(1, vt="Budget", value=100.0), month(1, vt="Forecast", value=0.0),
                       month(1, "Gross Profit", value=44.0), month(1, "EBITDA", value=-11.0)])
    obs = M.observe(fm, as_of())
    assert values(obs, "variance_vs_budget") == {"2025-01": pytest.approx(10.0)}
    assert values(obs, "variance_vs_forecast") == {}
    assert values(obs, "efficiency_ratio") == {"2025-01": pytest.approx(0.4)}
    margins = {r["metric_name"]: r["calculated_value"] for r in obs.where("observation_name = 'margin_analysis'").collect()}
    assert margins == {"Gross Profit": pytest.approx(40.0), "EBITDA": pytest.approx(-10.0)}


def test_one_scan_serves_all(spark):
    fm = facts(spark, [month(n, value=100.0 + n) for n in range(1, 13)])
    plan = M.observe(fm, as_of())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_slope_and_volatility(spark):
    fm = facts(spark, [month(n, value=100.0 + 10 * n) for n in range(1, 13)])
    row = M.trend_slope(fm).first()
    assert row["slope"] == pytest.approx(10.0) and row["direction"] == "up" and row["periods"] == 6
    assert M.trend_stats(fm, as_of()).first()["period_count"] == 12


def test_materiality_units(spark):
    fm = facts(spark, [month(1, value=100.0), month(2, value=103.5), month(1, "EBITDA", value=100.0),
                       month(2, "EBITDA", value=103.5), month(1, "Other", value=100.0), month(2, "Other", value=104.0)])
    kept = M.materiality_filter(M.observe(fm, as_of(), ["growth_mom"])).collect()
    assert [(r["metric_name"], r["threshold"]) for r in kept] == [("Revenue", pytest.approx(3.0))]
    assert M.materiality_filter(M.observe(fm, as_of(), ["growth_mom"]), override=10.0).count() == 0


def test_ytd(spark):
    fm = facts(spark, [month(1, value=10.0, year=2024), month(1, value=15.0), month(2, value=5.0)])
    row = M.ytd_growth(fm).first()
    assert (row["period_label"], row["calculated_value"]) == ("YTD 2025", pytest.approx(100.0))


def test_outliers(spark):
    fm = facts(spark, [month(n, value=10.0) for n in range(1, 12)] + [month(12, value=1000.0)])
    assert [r["period_label"] for r in M.outliers(fm).where("is_outlier").collect()] == ["2025-12"]


def test_questions(spark):
    fm = facts(spark, [month(1, value=100.0), month(2, value=150.0), month(2, vt="Budget", value=100.0)])
    rows = Q.match_templates(M.materiality_filter(M.observe(fm, as_of())))
    texts = {r["template_id"]: r["question_text"] for r in Q.render(rows).collect()}
    assert texts[30001] == ("Revenue changed 50.0% month-over-month ($150.00 vs $100.00). "
                            "What operational factors drove this growth?")
    assert texts[30012] == ("🚨 CRITICAL: Revenue variance of 50.0% impacts $50.00. "
                            "What immediate corrective actions are required?")
    top = Q.top_questions(rows, 2).orderBy("rank").collect()
    assert [r["template_id"] for r in top] == [30012, 30011]
    summary = {(r["dimension"], r["member"]): r["questions"] for r in Q.question_summary(rows).collect()}
    assert summary[("total", "all")] == rows.count()


def test_template_checks(spark, rows):
    tpl = spark.createDataFrame([(30001, 20001, "t", "c", "high", 5), (1, 9, "", "c", "high", 5)],
                                "template_id int, observation_id int, template_text string, category string, "
                                "priority string, importance int")
    obs = spark.createDataFrame([(20001,)], "observation_id int")
    assert rows(Q.template_validation(tpl, obs)) == [(1, "error", "missing template_text"),
                                                     (1, "warning", "id out of range"), (1, "warning", "unknown observation")]


ALONE = ["growth_mom", "growth_qoq", "growth_yoy", "variance_vs_budget", "variance_vs_forecast", "ytd_performance",
         "trend_direction", "volatility_measure", "seasonal_variance", "absolute_change", "magnitude_check",
         "efficiency_ratio", "margin_analysis"]


def test_alone_equals_together(spark, rows):
    """Pruned to what it needs, each observation has the rows it has among all thirteen."""
    seasons = [month(n, item, vt, 100.0 + 7 * ((n * year) % 11) + n * len(vt), year)
               for year in (2022, 2023, 2024, 2025) for n in range(1, 13)
               for item in ("Revenue", "Gross Profit", "EBITDA") for vt in ("Actual", "Budget", "Forecast")]
    longer = [(1, "Revenue", kind, dt.date(year, 1, 1), "Actual", 50.0 + year) for kind in ("Quarterly", "Yearly")
              for year in (2023, 2024, 2025)]
    fm = facts(spark, seasons + longer + [(1, "Revenue", "Quarterly", dt.date(2025, 4, 1), "Actual", 9.0)]).cache()
    together = M.observe(fm, as_of()).cache()
    plain = lambda df: rows(df.select(*[F.round(c, 9).alias(c) if c.endswith("_value") else c for c in M.OBS]))
    for name in ALONE:
        alone = plain(M.observe(fm, as_of(), [name]))
        assert alone and alone == plain(together.where(F.col("observation_name") == name)), name


def test_needs_reach_the_scan(spark, tmp_path):
    fm = facts(spark, [month(n, vt=vt) for n in range(1, 13) for vt in ("Actual", "Budget")])
    fm.write.partitionBy("period_type").parquet(str(tmp_path / "fm"))
    held = spark.read.parquet(str(tmp_path / "fm"))
    plan = M.observe(held, as_of(), ["volatility_measure"])._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    line = lambda start: next(x for x in plan.splitlines() if x.startswith(start))
    assert "EqualTo(value_type,Actual)" in line("PushedFilters"), plan
    assert "GreaterThanOrEqual(start_date,2024-12-01)" in line("PushedFilters"), plan
    assert "Monthly" in line("PartitionFilters"), plan
    assert plan.count("Scan parquet") == 2  # once in the tree, once in the list of operators


def test_needs_together():
    assert M.needs(["growth_mom", "volatility_measure"]) == M.Needs(frozenset({"Monthly"}))
    assert M.needs(["volatility_measure", "seasonal_variance"]).months == 36
    assert M.needs() == M.Needs(value_types=frozenset({"Actual", "Budget", "Forecast"}))


def test_ratio_items_are_arguments(spark):
    fm = facts(spark, [month(1, "Net Sales", value=200.0), month(1, "Owner's Cut", value=50.0), month(1, "EBITDA", value=20.0)])
    ratios = M.Ratios(base="Net Sales", efficiency=("Owner's Cut",), margins=("Owner's Cut", "EBITDA"))
    obs = M.observe(fm, as_of(), ["efficiency_ratio", "margin_analysis"], ratios)
    assert values(obs, "efficiency_ratio") == {"2025-01": pytest.approx(0.25)}
    assert {r["metric_name"]: r["calculated_value"] for r in obs.where("observation_name = 'margin_analysis'").collect()} \
        == {"Owner's Cut": pytest.approx(25.0), "EBITDA": pytest.approx(10.0)}
    assert M.observe(fm, as_of(), ["margin_analysis"]).count() == 0
