"""Text rules, report listings and quality checks."""

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators import quality as C, reports as R, textrows as X
from ledger_spark.sources import sinks


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "c string").select(column.alias("x")).first()["x"]


def test_term_lines(spark, rows):
    text = "Total Revenue 1,234,567 (2024)\nno number profit\nok\nStaff 12 cost 1,2 345"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert rows(X.term_number_lines(df, "id").select("line_no", "line_item", "value")) == [
        (0, "Revenue", "1,234,567"), (3, "Cost", "345")]


@pytest.mark.parametrize("line, want", [("Gross profit", True), ("Budget 2024", False), ("1,234", False), ("x", False),
                                        ("Widgets", True), ("(12.5)", False), ("ab", False)])
def test_financial_line(spark, line, want):
    assert one(spark, X.is_financial_line(F.col("c")), line) is want


@pytest.mark.parametrize("name, want", [("Reported Gross profit margin", "Gross Profit"), ("Adjusted rent", "rent"),
                                        ("Other revenue", "Revenue")])
def test_clean_line_item(spark, name, want):
    assert one(spark, X.clean_line_item(F.col("c")), name) == want


@pytest.mark.parametrize("cell, want", [("7 (1,234) 99", "(1,234)"), ("5", None), ("12.5%", "12.5")])
def test_first_value(spark, cell, want):
    assert one(spark, X.first_value(F.col("c")), cell) == want


def test_aligned(spark, rows):
    df = spark.createDataFrame([(1, "Revenue\nActual\n\nStaff Costs\nextra", "1,000\n2\n(30)")], "id int, a string, b string")
    assert rows(X.aligned_items(df, ["id"], "a", "b")) == [(1, 0, "Revenue", "1,000"), (1, 2, "Staff Costs", "(30)")]


def test_number_lines(spark):
    assert one(spark, X.has_number_lines(F.col("c")), "1\nx\n2\n(3)") is True
    assert one(spark, X.has_number_lines(F.col("c")), "1\nx\n2") is False


def test_fallback(spark, rows):
    a = spark.createDataFrame([(1, "t")], "page int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "page int, v string")
    assert rows(X.extract_with_fallback(a, b, "page")) == [(1, "t"), (2, "y")]


def test_cells(spark, rows):
    df = spark.createDataFrame([(0, "Feb-25 actual"), (1, "Variance"), (5, "budget"), (2, "(1,000)"), (2, "None")],
                               "row_idx int, cell string")
    tags = rows(X.header_periods(df).select("cell", "kind", "tag_label", "data_type"))
    assert tags == [("Feb-25 actual", "period", "2025-02", "actual"), ("Variance", "variance", None, "variance")]
    assert ("Unknown", "(1,000)") in rows(X.classify_cells(df).select("line_item", "value"))
    assert X.classify_cells(df).count() == 4


def test_purge_and_counts(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert rows(R.purge_preview({"questions": df}, {"questions": F.col("x") > 1})) == [(1, "questions", 1, 2)]
    assert R.purge(df, F.col("x") > 1).count() == 2
    assert rows(R.table_counts({"questions": df, "companies": df})) == [
        ("companies", "persistent", 3), ("questions", "transient", 3)]


def test_rules(spark, rows):
    df = spark.createDataFrame([(1, "5.5", 3), (2, "abc", 9), (3, None, None)], "id int, amount string, priority int")
    got = rows(C.rule_violations(df, "id", {"amount": C.valid_amount(F.col("amount")),
                                            "priority": F.col("priority").between(1, 5)}))
    assert got == [(2, "amount"), (2, "priority"), (3, "amount"), (3, "priority")]


def test_alias_tools(spark, rows):
    df = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X")], "alias_lc string, name string")
    assert rows(C.alias_conflicts(df, "alias_lc", "name")) == [("a", 2, "X", "Y")]
    edited = C.edit_aliases(df, spark.createDataFrame([("c", "Z")], df.schema), df.where("alias_lc = 'b'"))
    assert rows(edited) == [("a", "X"), ("a", "Y"), ("c", "Z")]
    versions = lambda *v: spark.createDataFrame([(x,) for x in v], "version string")
    assert rows(C.pending(versions("1", "2"), versions("1"))) == [("2",)]


def test_log_sink(spark, tmp_path):
    made = spark.createDataFrame([(1,)], "company_id int")
    log = sinks.report_log(made, "financial_analysis", F.lit("r.pdf"), F.lit("2025-01-01").cast("timestamp"))
    sinks.log_report(log, str(tmp_path / "log"))
    sinks.log_report(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
