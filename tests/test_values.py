"""Money, numbers, text, pages, periods, hashes, formats."""

import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledger_spark.functions import periods as P, values as V


def one(spark, column, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols \
        else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("$1,234.50", "1234.50"), ("(5.00)", "-5.00"), ("-2000.00", "-2000.00"), ("(-5)", "-5.00"), ("£ 7", "7.00"),
    ("¥12", "12.00"), ("N/A", None), ("", None), (None, None), ("1.2.3", None)])
def test_money(spark, raw, want):
    assert one(spark, V.parse_money(F.col("c")), c=raw) == (None if want is None else Decimal(want))


@pytest.mark.parametrize("raw, number, whole", [
    ("1,000", 1000.0, True), ("(2.50)", -2.5, False), ("-3", -3.0, True), ("abc", None, None), ("  ", None, None)])
def test_numeric(spark, raw, number, whole):
    got = one(spark, V.clean_numeric(F.col("c")), c=raw)
    assert (got["number"], got["is_integer"]) == (number, whole)


@pytest.mark.parametrize("raw, want", [(" x ", "x"), ("NaN", None), ("None", None), ("", None), ("nulls", "nulls")])
def test_text(spark, raw, want):
    assert one(spark, V.clean_text(F.col("c")), c=raw) == want


@pytest.mark.parametrize("page, sheet, want", [
    ("7", None, 7), ("Page 12 of 40", None, 12), ("Sheet1", "x9", 1), ("none", "tab 3", 3), ("0", "s2", 2),
    ("none", "none", None)])
def test_page(spark, page, sheet, want):
    assert one(spark, V.page_number(F.col("p"), F.col("s")), p=page, s=sheet) == want


def test_pct_change(spark):
    pct = lambda a, b: one(spark, V.pct_change(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert pct(110.0, 100.0) == pytest.approx(10.0)
    assert pct(50.0, -100.0) == pytest.approx(-150.0)
    assert pct(1.0, 0.0) is None and pct(1.0, None) is None and pct(None, 1.0) is None


@pytest.mark.parametrize("raw, want", [
    ("2031-03", ("2031-03", "Monthly")), ("2035/03", ("2035-03", "Monthly")), ("Feb 2025", ("2025-02", "Monthly")),
    ("SEPTEMBER  2024", ("2024-09", "Monthly")), ("2031-Q3", ("2031-Q3", "Quarterly")),
    ("Q2 2031", ("2031-Q2", "Quarterly")), ("4Q2030", ("2030-Q4", "Quarterly")), ("2031", ("2031", "Yearly")),
    ("FY31", ("2031", "Yearly")), ("cy2031", ("2031", "Yearly")), ("period: 2031-01", ("2031-01", "Monthly")),
    ("2031–01", ("2031-01", "Monthly")), ("2031-13", None), ("FY315", None), ("soon", None)])
def test_period_patterns(spark, raw, want):
    got = one(spark, P.parse_canonical(P.canonical_text(F.lower(P.clean_period(F.col("c"))))), c=raw)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("label, kind, start, end, seq", [
    ("2024-02", "Monthly", dt.date(2024, 2, 1), dt.date(2024, 2, 29), 2024 * 12 + 2),
    ("2023-Q4", "Quarterly", dt.date(2023, 10, 1), dt.date(2023, 12, 31), 2023 * 4 + 4),
    ("2023", "Yearly", dt.date(2023, 1, 1), dt.date(2023, 12, 31), 2023),
    ("YTD 2023", "Yearly", dt.date(2023, 1, 1), dt.date(2023, 12, 31), 2023),
    ("2023-13", "Monthly", None, None, None)])
def test_bounds(spark, label, kind, start, end, seq):
    first = P.period_start(F.col("l"), F.col("k"))
    got = spark.createDataFrame([(label, kind)], "l string, k string").select(
        first, P.period_end(first, F.col("k")), P.period_seq(first, F.col("k"))).first()
    assert tuple(got) == (start, end, seq)


@pytest.mark.parametrize("raw, kind, label, start, fallback", [
    ("YTD 2024", "Yearly", "YTD 2024", dt.date(2024, 1, 1), False),
    ("q3 2024 act", "Quarterly", "2024-Q3", dt.date(2024, 7, 1), False),
    ("15 March 2023", "Monthly", "2023-03", dt.date(2023, 3, 1), False),
    ("3/9/2023", "Monthly", "2023-03-09", dt.date(2023, 3, 9), False),
    ("2023-03-09", "Monthly", "2023-03-09", dt.date(2023, 3, 9), False),
    ("whenever", "Monthly", "whenever", dt.date(2025, 5, 5), True),
    ("Dec", "Monthly", "2025-12", dt.date(2025, 12, 1), False)])
def test_heuristic_period(spark, raw, kind, label, start, fallback):
    got = one(spark, P.parse_period(F.col("c"), F.lit("2025-05-05").cast("date")), c=raw)
    assert (got.period_type, got.period_label, got.start_date, got.is_fallback) == (kind, label, start, fallback)


def test_hashes(spark):
    cols = [F.lit(x) for x in (1, "2024-01", "Revenue", "Actual", "f.csv")]
    assert one(spark, V.row_hash(*cols)) == hashlib.md5(b"1_2024-01_Revenue_Actual_f.csv").hexdigest()
    assert one(spark, V.datapoint_hash(*cols)) == hashlib.sha256(b"1|2024-01|Revenue|Actual|f.csv").hexdigest()
    long = "m" * 150
    got = one(spark, V.error_fingerprint(F.lit("E"), F.lit("mod"), F.lit("fn"), F.lit(long)))
    assert got == hashlib.md5(f"E:mod:fn:{long[:100]}".encode()).hexdigest()[:12]


def test_formats(spark):
    assert one(spark, V.format_currency(F.lit(1234567.125))) == "$1,234,567.12"
    assert one(spark, V.format_currency(F.lit(None).cast("double"))) == "$0.00"
    assert one(spark, V.format_abs(F.lit(-3.5))) == "$3.50"
    assert one(spark, V.short_decimal(F.lit(12.5), 2)) == "12.5"
    assert one(spark, V.short_decimal(F.lit(12.0), 2)) == "12.0"
    assert one(spark, V.cut(F.lit("x" * 81))) == "x" * 80 + "..."
    assert one(spark, V.priority_code(F.lit("high"))) == 5
    assert one(spark, V.priority_label(F.lit(2))) == "Medium"


@pytest.mark.parametrize("raw, want", [("a.csv", "a"), ("no_dot", "no_dot"), ("a_very_long_file_name.v2.csv", "a_very_long_fil...")])
def test_display_source(spark, raw, want):
    assert one(spark, V.display_source(F.col("c")), c=raw) == want


@pytest.mark.parametrize("path, want", [("/in/a.xlsx", ("a.xlsx", "XLSX")), ("b", ("b", "CSV"))])
def test_source_tags(spark, path, want):
    assert tuple(one(spark, V.source_tags(F.col("c")), c=path)) == want


def test_null_parts_keep_their_place_in_hashes(spark):
    none = F.lit(None).cast("string")
    assert one(spark, V.error_fingerprint(F.lit("T"), none, F.lit("f"), F.lit("m"))) \
        != one(spark, V.error_fingerprint(F.lit("T"), F.lit("f"), none, F.lit("m")))
    assert one(spark, V.datapoint_hash(F.lit("a"), none)) != one(spark, V.datapoint_hash(none, F.lit("a")))
