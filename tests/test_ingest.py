"""Headers, mapping, the accept/reject split, keyed writes and file scans."""

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators import mapping as M, normalize as N
from ledger_spark.sources import dimensions as D, files, sinks

RAW = ("company_id string, line_item string, period_label string, value string, value_type string, "
       "source_file string, source_page string")


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([
        ("1", "sales", "2025-01", "1500000", None, "a.csv", "1"),
        ("1", "Revenue", "Jan 2025", "(200)", "Budget", "a.csv", "Sheet1"),
        ("1", "Cash Flow", "2025-01", "5", "Actual", "a.csv", "1"),
        ("2", "EBITDA", "someday", "5", "Actual", "a.csv", "1"),
        ("2", "gm", "FY25", "n/a", "Actual", "a.csv", "1"),
        ("2", None, "2025", "5", "Actual", "a.csv", "1"),
    ], RAW)


def test_split_adds_up(spark, raw, rows):
    judged = N.judge(M.map_rows(raw), D.line_items(spark))
    good, bad = N.accepted(judged), N.rejected(judged)
    assert good.count() + bad.count() == raw.count()
    assert rows(bad.select("line_item", "reason")) == sorted([
        ("Cash Flow", "line_item"), ("EBITDA", "period"), ("Gross Profit", "value"), (None, "incomplete")], key=repr)
    got = rows(good.select("line_item", "period_label", "value_type", F.col("value").cast("double"), "currency"))
    assert got == [("Revenue", "2025-01", "Actual", 1500000.0, "USD"), ("Revenue", "2025-01", "Budget", -200.0, "USD")]


def test_alias_beats_pattern(spark, rows):
    cal = D.calendar_between(spark, "1994-06-01", "1996-02-01")
    df = spark.createDataFrame([("FY95",), ("1/95",), ("95-Jan",), ("Jan '95",), ("Jan-Mar 1995",)], "period_label string")
    got = rows(N.resolve_period(df, D.period_aliases(cal)).select("period_label", "canonical_label"))
    assert dict(got) == {"FY95": "1995", "1/95": "1995-01", "95-Jan": "1995-01", "Jan '95": "1995-01",
                         "Jan-Mar 1995": "1995-Q1"}


def test_calendar(spark):
    cal = D.calendar_between(spark, "2015-01-01", "2030-12-31")
    assert {r["period_type"]: r["count"] for r in cal.groupBy("period_type").count().collect()} == {
        "Monthly": 192, "Quarterly": 64, "Yearly": 16}
    assert D.period_aliases(cal).groupBy("alias_lc").count().where("count > 1").count() == 0


def test_append_twice_is_once(spark, raw):
    good = N.accepted(N.judge(M.map_rows(raw), D.line_items(spark)))
    nothing = good.limit(0)
    first = sinks.append_new(nothing, good)
    assert first.count() == 2
    assert sinks.append_new(first, good).count() == 0
    counts = sinks.append_counts(good.unionByName(good), sinks.append_new(first, good.unionByName(good))).first()
    assert tuple(counts) == (4, 0, 4)


def test_upsert(spark, rows):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, version int")
    assert rows(sinks.upsert(old, new, ["k"], "version").select("k", "v")) == [(1, "a"), (2, "c"), (3, "d")]


def test_latest_cell(spark):
    df = spark.createDataFrame([(1, "Revenue", "Monthly", "2025-01", "Actual", 1.0, 1),
                                (1, "Revenue", "Monthly", "2025-01", "Actual", 2.0, 2)],
                               "company_id int, line_item string, period_type string, period_label string, "
                               "value_type string, value double, n int")
    assert [r["value"] for r in N.latest_cell(df, ["n"]).collect()] == [2.0]


def test_headers(spark, rows):
    names = [" Amount", "Metric Name", "FREQ", "customer_id", "Jan 2024", "stmt_type", "colour"]
    headers = spark.createDataFrame([(n,) for n in names], "header string")
    assert rows(M.header_synonyms(headers)) == [(" Amount", "value"), ("FREQ", "period_type"), ("Metric Name", "line_item")]
    assert dict(rows(M.header_taxonomy(headers)))["customer_id"] == "id_headers"
    assert rows(M.unmapped_headers(headers)) == [("colour",)]


def test_canonical_headers(spark):
    df = spark.createDataFrame([("1", "sales", "5", "x")], "`Entity ID` string, `Metric Name` string, Amounts string, colour string")
    assert M.canonical_headers(df).columns == ["company_id", "line_item", "value", "colour"]


def test_suggestion(spark, rows):
    df = spark.createDataFrame([("currncy",), ("zzzzzzzz",)], "n string")
    assert rows(M.suggest_names(df, "n", ["currency", "value"], 3)) == [("currncy", "currency", 1)]


def test_csv_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Date ,Amount\n2025-01, 5 \n,\n2025-02,-2000.00\n")
    df = files.scan_csv(spark, str(tmp_path))
    assert df.columns == ["Date", "Amount", "_source_sheet"]
    assert [tuple(r)[:2] for r in df.collect()] == [("2025-01", "5"), ("2025-02", "-2000.00")]


def test_csv_na_scan_numbers_rows_over_splits(spark, tmp_path):
    lines = [f"{i},x{i}" if i % 3 else "N/A,NULL" for i in range(1, 3001)]
    (tmp_path / "a.csv").write_text("a,b\n" + "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.scan_csv_na(spark, str(tmp_path)).orderBy("_row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["_row_number"] for r in got] == list(range(1, 2001))
    assert [int(r["a"]) for r in got] == [i for i in range(1, 3001) if i % 3]


def test_sheets(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"sheet={name}").mkdir()
        (tmp_path / f"sheet={name}" / "p.csv").write_text("a,b\n1,nan\nnone,\n3,x\n")
    got = sorted(tuple(r) for r in files.scan_sheets(spark, str(tmp_path)).select(
        "_sheet_name", "_row_index", "a").collect())
    assert got == [("one", 2, "1"), ("one", 4, "3"), ("two", 2, "1"), ("two", 4, "3")]


def test_encodings_and_gate(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("é\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("é€\n".encode())
    (tmp_path / "x.exe").write_bytes(b"x")
    scan = files.scan_binary(spark, str(tmp_path))
    texts = {r["path"].split("/")[-1]: r["line"] for r in files.file_lines(files.decode_files(scan)).collect()}
    assert texts["l.csv"] == "é" and texts["u.csv"] == "é€"
    gate = {r["extension"]: r["admitted"] for r in files.admissible_files(scan).collect()}
    assert gate == {"csv": True, "exe": False}


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": \n{"k": 2}\n')
    assert sorted(r["k"] for r in files.scan_jsonl(spark, str(tmp_path), "k long").collect()) == [1, 2]


def test_colliding_headers(spark):
    assert M.header_plan(["amount", "value"]) == {"value": "value", "amount": "amount"}
    assert M.header_plan(["frequency", "period_type", "value"])["period_type"] == "period_type"
    for names in (["amount", "value", "colour"], ["frequency", "period_type", "value"], ["Amount", "amount ", "Amounts"]):
        df = spark.createDataFrame([tuple("x" for _ in names)], ", ".join(f"`{n}` string" for n in names))
        got = M.canonical_headers(df).columns
        assert len({c.lower() for c in got}) == len(names) and "value" in got
        assert M.apply_defaults(M.canonical_headers(df)).count() == 1


def test_append_with_null_key_parts(spark):
    rows = spark.createDataFrame([(1, "2025-01", "Revenue", "Actual", None, 5.0), (1, "2025-01", "Revenue", None, None, 6.0)],
                                 "company_id int, period_label string, line_item string, value_type string, source_file string, value double")
    first = sinks.append_new(rows.limit(0), rows)
    assert first.count() == 2
    assert sinks.append_new(first, rows).count() == 0


def test_held_keys_of_many_partitions(spark, tmp_path):
    path = str(tmp_path / "fact")
    fact = spark.range(30).selectExpr("cast(id as int) as k", "concat('p', id % 3) as part")
    sinks.write_fact(fact, path, "part")
    incoming = spark.createDataFrame([("p1",), ("p9",)], "part string")
    got = sinks.held_keys(spark, path, fact.schema, incoming, ["k"], "part")
    assert sorted(r.k for r in got.collect()) == list(range(1, 30, 3))
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_quoted_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"Line\nitem",value\n"Gross\nprofit","1,5"\n')
    got = files.scan_csv(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert got.columns == ["Line item", "value", "_source_sheet"]
    assert [tuple(r) for r in got.collect()] == [("Gross\nprofit", "1,5", "CSV")]


def test_upload_gate_gives_both_reasons(spark):
    df = spark.createDataFrame([("a/x.CSV", 10), ("a/x.csv", 11), ("a/x.exe", 11), ("noext", 1)], "path string, length long")
    got = {(r["path"], r["admitted"], r["reason"]) for r in files.admissible_files(df, ["csv"], 10).collect()}
    assert got == {("a/x.CSV", True, None), ("a/x.csv", False, "size"), ("a/x.exe", False, "type"), ("noext", False, "type")}


def test_upsert_ties(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "b")], "k int, version int, v string")
    assert rows(sinks.upsert(df.limit(0), df, ["k"], "version").select("k", "v")) == [(1, "b")]
