"""Scans, dimensions, mapping, normalising and the keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledger_spark import settings
from ledger_spark.functions import periods as P, values as V
from ledger_spark.operators import mapping as MP, normalize as N
from ledger_spark.plans.registry import HEADERS_SQL, JUDGED_SQL, RAW_SQL, Tables, big, query, r4
from ledger_spark.session import scratch_path, written
from ledger_spark.sources import dimensions as D, files, sinks


def _values(rows) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(text(v) for v in r) + ")" for r in rows)


ITEM_ALIASES_SQL = "item_alias(alias_lc, name) AS (SELECT DISTINCT * FROM (" + _values(
    [(a.lower(), name) for _, name, aliases in settings.LINE_ITEMS for a in [name, *aliases]]) + "))"
SYNONYMS_SQL = "synonyms(synonym_lc, field, n) AS (SELECT DISTINCT * FROM (" + _values(
    [(s.lower(), field, n) for n, (_, field, _, syns) in enumerate(settings.FIELDS) for s in syns]) + "))"
RULES_SQL = "rules(pos, family, pattern) AS (" + _values(
    [(n, family, p if p.startswith("^") else "^" + p) for n, (family, pats) in enumerate(settings.TAXONOMY)
     for p in pats]) + ")"


def _calendar_sql(table: str, column: str, name: str = "cal") -> str:
    return f"""
months AS (SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m
  FROM (SELECT CAST(min({column}) AS TIMESTAMP) AS lo, CAST(max({column}) AS TIMESTAMP) AS hi FROM {table})),
{name} AS (
  SELECT DISTINCT 'Monthly' AS period_type, strftime(m, '%Y-%m') AS period_label, CAST(m AS DATE) AS start_date,
         last_day(CAST(m AS DATE)) AS end_date, year(m)*12 + month(m) AS period_seq FROM months
  UNION SELECT 'Quarterly', year(m) || '-Q' || quarter(m), CAST(date_trunc('quarter', m) AS DATE),
         last_day(CAST(date_trunc('quarter', m) + INTERVAL 2 MONTH AS DATE)), year(m)*4 + quarter(m) FROM months
  UNION SELECT 'Yearly', CAST(year(m) AS VARCHAR), CAST(date_trunc('year', m) AS DATE),
         make_date(CAST(year(m) AS BIGINT), 12, 31), year(m) FROM months)"""


_ALIAS_SQL = """
spell AS (
  SELECT period_label, period_type, unnest(CASE period_type
    WHEN 'Monthly' THEN [period_label, month(start_date) || '/' || year(start_date), strftime(start_date, '%Y.%m'),
      strftime(start_date, '%b %Y'), strftime(start_date, '%B %Y'), strftime(start_date, '%b-%Y'),
      strftime(start_date, '%b ''%y'), month(start_date) || '/' || strftime(start_date, '%y'),
      strftime(start_date, '%Y %b'), strftime(start_date, '%y-%b')]
    WHEN 'Quarterly' THEN [period_label, 'Q' || quarter(start_date) || ' ' || year(start_date),
      year(start_date) || ' Q' || quarter(start_date), quarter(start_date) || 'Q' || strftime(start_date, '%y'),
      strftime(start_date, '%b') || '-' || strftime(end_date, '%b %Y')]
    ELSE [period_label, strftime(start_date, 'FY%y'), strftime(start_date, 'FY %Y'), strftime(start_date, 'CY%y'),
      strftime(start_date, 'Year %Y')] END) AS alias FROM cal)"""


# -- dimensions ----------------------------------------------------------------

@query("calendar_dim", sql=f"WITH {_calendar_sql('lineitem', 'l_shipdate')} SELECT period_type, period_label, "
       f"CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date, "
       f"{big('period_seq', 'period_seq')} FROM cal")
def calendar_dim(t: Tables):
    return t.ship_calendar


@query("period_alias_dim", sql=f"WITH {_calendar_sql('orders', 'o_orderdate')}, {_ALIAS_SQL} "
       "SELECT DISTINCT lower(alias) AS alias_lc, period_label, period_type FROM spell")
def period_alias_dim(t: Tables):
    return D.period_aliases(t.order_calendar)


@query("line_item_alias_dim", sql=f"""WITH {RAW_SQL}, {ITEM_ALIASES_SQL},
uses AS (SELECT lower(trim(line_item)) AS alias_lc, count(*) AS n FROM raw_rows WHERE line_item IS NOT NULL GROUP BY ALL)
SELECT alias_lc, name, {big('coalesce(n, 0)', 'uses')} FROM item_alias LEFT JOIN uses USING (alias_lc)""")
def line_item_alias_dim(t: Tables):
    """The alias dimension with how often the raw rows use each alias."""
    uses = (t.raw_rows.where("line_item is not null").groupBy(V.lower_trim(F.col("line_item")).alias("alias_lc"))
             .agg(F.count(F.lit(1)).alias("n")))
    return (D.line_item_aliases(D.line_items(t.spark)).join(uses, "alias_lc", "left")
             .select("alias_lc", "name", F.coalesce("n", F.lit(0)).alias("uses")))


@query("field_synonym_dim", sql=f"""WITH {HEADERS_SQL}, {SYNONYMS_SQL},
seen AS (SELECT lower(trim(header)) AS synonym_lc, count(*) AS n FROM headers GROUP BY ALL)
SELECT synonym_lc, field, {big('coalesce(seen.n, 0)', 'uses')} FROM synonyms LEFT JOIN seen USING (synonym_lc)""")
def field_synonym_dim(t: Tables):
    """The synonym dimension with how often each spelling occurs as a header."""
    seen = t.headers.groupBy(V.lower_trim(F.col("header")).alias("synonym_lc")).agg(F.count(F.lit(1)).alias("n"))
    return (D.field_synonyms(t.spark).join(seen, "synonym_lc", "left")
             .select("synonym_lc", "field", F.coalesce("n", F.lit(0)).alias("uses")))


# -- file scans ----------------------------------------------------------------

def _write_csv(t: Tables, df, name: str, partition: str | None = None) -> str:
    path = scratch_path(t.spark, name)
    writer = df.write.option("header", True).option("escape", '"').option("nullValue", "")
    (writer.partitionBy(partition) if partition else writer).csv(path)
    return path


@query("csv_scan_clean", sql=f"""WITH {RAW_SQL}
SELECT CAST(row_id AS VARCHAR) AS row_id, source_file, company_id, nullif(trim(line_item), '') AS line_item,
  trim(period_label) AS period_label, value, value_type, source_page, 'CSV' AS _source_sheet FROM raw_rows""")
def csv_scan_clean(t: Tables):
    """The raw rows written as CSV and scanned back."""
    return files.scan_csv(t.spark, _write_csv(t, t.raw_rows, "raw-csv"))


@query("na_token_scan", sql=f"""WITH {RAW_SQL}
SELECT CAST(row_id AS VARCHAR) AS row_id, nullif(trim(line_item), '') AS line_item,
  CASE WHEN value = 'N/A' THEN NULL ELSE value END AS value, value_type FROM raw_rows""")
def na_token_scan(t: Tables):
    """NA tokens become null and the column that holds nothing else disappears."""
    rows = t.raw_rows.select("row_id", "line_item", "value", "value_type", F.lit("NULL").alias("empty"))
    return files.scan_csv_na(t.spark, _write_csv(t, rows, "na-csv")).drop("_row_number")


@query("encoding_fallback", sql="SELECT doc_id, lang, md5(replace(replace(text, chr(10), ' '), chr(13), ' ')) AS digest "
       "FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents)")
def encoding_fallback(t: Tables):
    """Documents that fit ISO-8859-1 are written that way, the others in UTF-8; one scan reads both."""
    docs = t("documents").select("doc_id", "lang", F.translate("text", "\n\r", "  ").alias("text"))
    line = F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "text")
    narrow = F.col("text").rlike(r"^[\x{0}-\x{ff}]*$")
    root = scratch_path(t.spark, "encoded")
    for fits, charset in ((True, "ISO-8859-1"), (False, "UTF-8")):
        (docs.where(narrow if fits else ~narrow).select(line.alias("line"))
             .write.option("encoding", charset).option("quote", "").option("emptyValue", "")
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
             .option("sep", "\u0001").csv(f"{root}/{charset}"))
    lines = files.file_lines(files.decode_files(files.scan_binary(t.spark, root).where(F.col("length") > 0)))
    parts = F.split("line", r"\|", 3)
    return lines.select(parts[0].alias("doc_id"), parts[1].alias("lang"), F.md5(parts[2]).alias("digest"))


@query("multi_sheet_scan", sql=f"""WITH {RAW_SQL}
SELECT source_file AS _sheet_name, {big('row_number() OVER (PARTITION BY source_file ORDER BY row_id) + 1', '_row_index')},
  CAST(row_id AS VARCHAR) AS row_id, nullif(trim(line_item), '') AS line_item, trim(period_label) AS period_label, value,
  CASE WHEN source_page = 'none' THEN NULL ELSE source_page END AS source_page FROM raw_rows""")
def multi_sheet_scan(t: Tables):
    """One folder per sheet, rows in id order; the scan numbers them across all files of a sheet."""
    rows = t.raw_rows.select("row_id", "line_item", "period_label", "value", "source_page",
                             F.col("source_file").alias("sheet"))
    ordered = rows.repartitionByRange("sheet", "row_id").sortWithinPartitions("sheet", "row_id")
    return files.scan_sheets(t.spark, _write_csv(t, ordered, "sheets", "sheet"))


_UPLOAD_BYTES = 4096


@query("upload_gate", sql=f"""SELECT doc_id, length, extension, reason IS NULL AS admitted, reason FROM (
  SELECT *, CASE WHEN extension = 'exe' THEN 'type' WHEN length > {_UPLOAD_BYTES} THEN 'size' END AS reason FROM (
    SELECT doc_id, {big('strlen(text)', 'length')}, CASE doc_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' ELSE 'exe' END AS extension
    FROM documents))""")
def upload_gate(t: Tables):
    """Every document as an upload of its text's bytes through the gate; both reasons for a rejection occur."""
    kind = F.when(F.col("doc_id") % 3 == 0, "csv").when(F.col("doc_id") % 3 == 1, "PDF").otherwise("exe")
    uploads = t("documents").select("doc_id", F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), kind))
                                    .alias("path"), F.octet_length("text").cast("long").alias("length"))
    return files.admissible_files(uploads, at_most=_UPLOAD_BYTES).drop("path")


@query("csv_quoted_lines", sql=f"""WITH {RAW_SQL}
SELECT CAST(row_id AS VARCHAR) AS row_id, coalesce(value_type, '-') || chr(10) || ', "' || row_id || '"' AS note, 'CSV' AS _source_sheet
FROM raw_rows""")
def csv_quoted_lines(t: Tables):
    """Cells with line ends, commas and quotes, written as CSV and scanned back."""
    note = F.concat(F.coalesce("value_type", F.lit("-")), F.lit('\n, "'), F.col("row_id").cast("string"), F.lit('"'))
    return files.scan_csv(t.spark, _write_csv(t, t.raw_rows.select("row_id", note.alias("note")), "lines-csv"), multi_line=True)


@query("encoded_csv", sql="""SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(trim(lang), '') AS lang, md5(trim(text)) AS digest
FROM documents WHERE trim(text) <> ''""")
def encoded_csv(t: Tables):
    """Documents as CSV cells with their line ends; files of those that fit ISO-8859-1 are in it, others in UTF-8; one scan reads both as columns."""
    docs = t("documents").select("doc_id", "lang", "text")
    narrow = F.col("text").rlike(r"^[\x{0}-\x{ff}]*$")
    root = scratch_path(t.spark, "encoded-csv")
    for fits, charset in ((True, "ISO-8859-1"), (False, "UTF-8")):
        (docs.where(narrow if fits else ~narrow).write.option("header", True).option("quoteAll", True).option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("encoding", charset).csv(f"{root}/{charset}"))
    rows = files.scan_csv(t.spark, f"{root}/*", multi_line=True, fallback=True).where("text is not null")
    return rows.select("doc_id", "lang", F.md5("text").alias("digest"))


@query("file_inventory")
def file_inventory(t: Tables):
    root = scratch_path(t.spark, "inventory")
    t.raw_rows.write.option("header", True).partitionBy("source_page").csv(root)
    return files.file_inventory(t.spark, root)


@query("jsonl_scan", sql="""SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type
FROM events WHERE event_type <> 'error'""")
def jsonl_scan(t: Tables):
    """Events as JSON lines, the error lines cut short: those are skipped."""
    whole = F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type"))
    line = F.when(F.col("event_type") == "error", F.expr("left(_w, length(_w) - 2)")).otherwise(F.col("_w"))
    path = scratch_path(t.spark, "jsonl")
    t("events").withColumn("_w", whole).select(line.alias("value")).write.text(path)
    return files.scan_jsonl(t.spark, path, "event_id long, k long, event_type string")


# -- headers -------------------------------------------------------------------

_FAMILY_SQL = f"""{HEADERS_SQL}, {RULES_SQL},
family AS (SELECT header, min_by(family, pos) AS family FROM (SELECT DISTINCT header FROM headers) h
  JOIN rules ON regexp_matches(header, pattern, 'i') GROUP BY header)"""


@query("header_synonyms", sql=f"""WITH {HEADERS_SQL}, {SYNONYMS_SQL}
SELECT header, min_by(field, n) AS field FROM (SELECT DISTINCT header FROM headers)
JOIN synonyms ON lower(trim(header)) = synonym_lc GROUP BY header""")
def header_synonyms(t: Tables):
    return MP.header_synonyms(t.headers)


@query("header_taxonomy", sql=f"WITH {_FAMILY_SQL} SELECT header, family FROM family")
def header_taxonomy(t: Tables):
    return MP.header_taxonomy(t.headers)


@query("unmapped_headers", sql=f"""WITH {_FAMILY_SQL}, {SYNONYMS_SQL}
SELECT DISTINCT header FROM headers WHERE header NOT IN (SELECT header FROM family)
  AND lower(trim(header)) NOT IN (SELECT synonym_lc FROM synonyms)""")
def unmapped_headers(t: Tables):
    return MP.unmapped_headers(t.headers)


_FIELD_NAMES = [f[1] for f in settings.FIELDS]


@query("alias_suggestion", sql=f"""WITH {HEADERS_SQL}, fields(f) AS (VALUES {', '.join(f"('{f}')" for f in _FIELD_NAMES)}),
d AS (SELECT header, f, levenshtein(lower(trim(header)), f) AS dist FROM (SELECT DISTINCT header FROM headers), fields),
best AS (SELECT *, row_number() OVER (PARTITION BY header ORDER BY dist, f) AS rn FROM d)
SELECT header, f AS suggestion, {big('dist', 'distance')} FROM best WHERE rn = 1 AND dist <= 3""")
def alias_suggestion(t: Tables):
    return MP.suggest_names(t.headers, "header", _FIELD_NAMES, 3)


_WRITTEN = "CASE row_id % 3 WHEN 0 THEN {iso} WHEN 1 THEN {us} ELSE {eu} END"


@query("period_alias_or_date", sql=f"""WITH {JUDGED_SQL},
p AS (SELECT r.row_id, k.canon, k.kind, k.start_date, CAST(r.o_orderdate AS DATE) AS od, trim(r.period_label) AS label FROM raw_rows r JOIN known k USING (row_id))
SELECT row_id, CASE WHEN canon IS NULL THEN {_WRITTEN.format(iso="strftime(od, '%Y-%m-%d')", us="strftime(od, '%m/%d/%Y')", eu="strftime(od, '%d-%m-%Y')")} ELSE label END AS label_as_written,
  coalesce(kind, 'Monthly') AS period_type, coalesce(canon, strftime(od, '%Y-%m-%d')) AS period_label,
  CAST(coalesce(start_date, od) AS VARCHAR) AS start_date, CAST(CASE kind WHEN 'Monthly' THEN last_day(start_date)
    WHEN 'Quarterly' THEN last_day(CAST(start_date + INTERVAL 2 MONTH AS DATE)) WHEN 'Yearly' THEN last_day(CAST(start_date + INTERVAL 11 MONTH AS DATE))
    ELSE od END AS VARCHAR) AS end_date, false AS is_fallback FROM p""")
def period_alias_or_date(t: Tables):
    """Labels that the aliases name, and dates in three written forms in place of the labels that name nothing."""
    days = t("orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").alias("day"))
    form = lambda pattern: F.date_format("day", pattern)
    written = F.when(F.col("row_id") % 3 == 0, form("yyyy-MM-dd")).when(F.col("row_id") % 3 == 1, form("MM/dd/yyyy")).otherwise(form("dd-MM-yyyy"))
    rows = t.raw_rows.select("row_id", "period_label").join(days, "row_id").withColumn(
        "period_label", F.when(F.col("row_id") % 8 == 7, written).otherwise(F.col("period_label")))
    as_of = t("orders").agg(F.max("o_orderdate").cast("date").alias("d")).scalar()
    parsed = P.parse_period(F.col("period_label"), as_of, None, F.col("alias_label"), F.col("alias_type"))
    return N.resolve_alias(rows, D.period_aliases(t.order_calendar)).select("row_id", parsed.alias("p")).select("row_id", "p.*")


# -- rows ----------------------------------------------------------------------

@query("line_item_mapping", sql=f"""WITH {RAW_SQL}
SELECT row_id, CASE row_id % 6 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'Revenue' WHEN 2 THEN 'Gross Profit'
  WHEN 3 THEN 'EBITDA' ELSE line_item END AS line_item FROM raw_rows""")
def line_item_mapping(t: Tables):
    return MP.map_line_item(t.raw_rows).select("row_id", "line_item")


@query("mapped_rows", sql=f"""WITH {RAW_SQL}
SELECT row_id, trim(period_label) AS period_label, 'Monthly' AS period_type, coalesce(value_type, 'Actual') AS value_type,
  'Monthly' AS frequency, 'USD' AS currency, '' AS notes, value, source_page FROM raw_rows""")
def mapped_rows(t: Tables):
    return MP.map_rows(t.raw_rows).select("row_id", "period_label", "period_type", "value_type", "frequency",
                                          "currency", "notes", "value", "source_page")


@query("period_alias_resolve", sql=f"""WITH {RAW_SQL}, {_calendar_sql('orders', 'o_orderdate')}, {_ALIAS_SQL}
SELECT r.row_id, s.period_label AS alias_label, s.period_type AS alias_type FROM raw_rows r
LEFT JOIN (SELECT DISTINCT lower(alias) AS a, period_label, period_type FROM spell) s
  ON lower(regexp_replace(trim(r.period_label), '\\s+', ' ', 'g')) = s.a""")
def period_alias_resolve(t: Tables):
    return N.resolve_alias(t.raw_rows, D.period_aliases(t.order_calendar)).select("row_id", "alias_label", "alias_type")


@query("period_pattern_parse", sql=f"""WITH {RAW_SQL}
SELECT row_id, CASE WHEN row_id % 8 IN (0, 1) THEN strftime(o_orderdate, '%Y-%m')
    WHEN row_id % 8 IN (2, 6) THEN year(o_orderdate) || '-Q' || quarter(o_orderdate)
    WHEN row_id % 8 = 3 THEN CAST(year(o_orderdate) AS VARCHAR)
    WHEN row_id % 8 = 5 THEN '20' || strftime(o_orderdate, '%y') END AS period_label,
  CASE WHEN row_id % 8 IN (0, 1) THEN 'Monthly' WHEN row_id % 8 IN (2, 6) THEN 'Quarterly'
    WHEN row_id % 8 IN (3, 5) THEN 'Yearly' END AS period_type FROM raw_rows""")
def period_pattern_parse(t: Tables):
    """Patterns only: 'Jan-1995' fits none of them and a two-digit year is read as 20YY."""
    return N.resolve_period(t.raw_rows).select("row_id", F.col("canonical_label").alias("period_label"),
                                               F.col("canonical_type").alias("period_type"))


@query("period_bounds", sql=f"""WITH {JUDGED_SQL}
SELECT DISTINCT canon AS period_label, kind AS period_type, CAST(start_date AS VARCHAR) AS start_date,
  CAST(last_day(CAST(start_date + (CASE kind WHEN 'Monthly' THEN INTERVAL 0 MONTH WHEN 'Quarterly' THEN INTERVAL 2 MONTH
    ELSE INTERVAL 11 MONTH END) AS DATE)) AS VARCHAR) AS end_date FROM known WHERE canon IS NOT NULL""")
def period_bounds(t: Tables):
    labels = N.resolve_period(t.raw_rows, D.period_aliases(t.order_calendar)).select(
        F.col("canonical_label").alias("period_label"), F.col("canonical_type").alias("period_type"))
    return N.period_bounds(labels.where("period_label is not null").distinct())


@query("period_heuristic_parse", sql=f"""WITH {RAW_SQL}, mx AS (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders),
p AS (SELECT row_id, trim(period_label) AS label_as_written, row_id % 8 AS f, period_label AS raw, o_orderdate AS od, d,
  coalesce(nullif(regexp_extract(period_label, '20[0-9][0-9]', 0), ''), CAST(year(d) AS VARCHAR)) AS y FROM raw_rows, mx)
SELECT row_id, label_as_written,
  CASE WHEN f IN (0, 4) THEN 'Monthly' WHEN f IN (2, 6) THEN 'Quarterly' ELSE 'Monthly' END AS period_type,
  CASE WHEN f IN (0, 4) THEN y || strftime(od, '-%m') WHEN f IN (2, 6) THEN y || '-Q' || quarter(od) ELSE label_as_written END AS period_label,
  CASE WHEN f IN (0, 4) THEN y || strftime(od, '-%m-01') WHEN f IN (2, 6) THEN y || strftime(date_trunc('quarter', od), '-%m-01')
    ELSE CAST(d AS VARCHAR) END AS start_date,
  CASE WHEN f NOT IN (0, 2, 4, 6) THEN true ELSE false END AS is_fallback FROM p""")
def period_heuristic_parse(t: Tables):
    as_of = t("orders").agg(F.max("o_orderdate").cast("date").alias("d")).scalar()
    parsed = P.parse_period(F.col("period_label"), as_of)
    return t.raw_rows.select("row_id", parsed.alias("p")).select(
        "row_id", "p.label_as_written", "p.period_type", "p.period_label", "p.start_date", "p.is_fallback")


@query("new_periods", sql=f"""WITH {JUDGED_SQL}
SELECT DISTINCT canon AS period_label, kind AS period_type, CAST(start_date AS VARCHAR) AS start_date FROM known
WHERE canon IS NOT NULL AND NOT (kind = 'Monthly' AND start_date BETWEEN (SELECT CAST(date_trunc('month', min(l_shipdate)) AS DATE) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
   AND (SELECT max(l_shipdate) FROM lineitem))
 AND NOT (kind = 'Quarterly' AND start_date >= DATE '1998-01-01') AND NOT (kind = 'Yearly' AND start_date >= DATE '1998-01-01')""")
def new_periods(t: Tables):
    """A calendar over the later shipments knows none of the earlier labels."""
    late = t("lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    cal = D.calendar(late.agg(F.min("l_shipdate").alias("start"), F.max("l_shipdate").alias("end")))
    labels = N.resolve_period(t.raw_rows, D.period_aliases(t.order_calendar))
    return N.new_periods(labels, cal).drop("end_date")


@query("money_parse", sql=f"""WITH {RAW_SQL}, v AS (SELECT row_id, CAST(o_totalprice AS DECIMAL(15,2)) AS v FROM raw_rows JOIN orders ON row_id = o_orderkey)
SELECT row_id, {r4('CASE row_id % 5 WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN -v WHEN 3 THEN -v END', 'amount')} FROM v""")
def money_parse(t: Tables):
    return t.raw_rows.select("row_id", V.parse_money(F.col("value")).alias("amount"))


@query("numeric_clean", sql=f"""WITH {RAW_SQL}
SELECT row_id, {r4("TRY_CAST(regexp_replace(regexp_replace(value, '[$]', '', 'g'), '^\\((.*)\\)$', '-\\1') AS DOUBLE)", 'number')},
  CASE WHEN value = 'N/A' THEN NULL ELSE NOT contains(value, '.') END AS is_integer FROM raw_rows""")
def numeric_clean(t: Tables):
    return t.raw_rows.select("row_id", V.clean_numeric(F.col("value")).alias("n")).select("row_id", "n.*")


@query("text_nullify", sql=f"""WITH {RAW_SQL} SELECT row_id, CASE WHEN source_page = 'none' THEN NULL ELSE source_page END AS page_text,
  nullif(trim(line_item), '') AS item_text FROM raw_rows""")
def text_nullify(t: Tables):
    return t.raw_rows.select("row_id", V.clean_text(F.col("source_page")).alias("page_text"),
                             V.clean_text(F.col("line_item")).alias("item_text"))


@query("page_number", sql=f"""WITH {RAW_SQL} SELECT row_id, {big("CASE source_page WHEN 'Sheet1' THEN 1 WHEN 'Page 12' THEN 12 WHEN '7' THEN 7 ELSE row_id % 7 END", 'page')}
FROM raw_rows""")
def page_number(t: Tables):
    """Falls back to the number in the file name where the page has none."""
    return t.raw_rows.select("row_id", V.page_number(F.col("source_page"), F.col("source_file")).alias("page"))


@query("row_hash_md5", sql=f"WITH {JUDGED_SQL} SELECT row_id, hash FROM facts")
def row_hash_md5(t: Tables):
    return t.facts.select("row_id", "hash")


@query("datapoint_hash", sql=f"WITH {JUDGED_SQL} SELECT row_id, sha256(concat_ws('|', company_id, canon, item, vt, kind, "
       "CAST(amount AS VARCHAR))) AS digest FROM facts")
def datapoint_hash(t: Tables):
    cols = [F.col(c) for c in ("company_id", "period_label", "line_item", "value_type", "period_type", "value")]
    return t.facts.select("row_id", V.datapoint_hash(*cols).alias("digest"))


@query("line_item_fk", sql=f"WITH {JUDGED_SQL} SELECT row_id, {big('item_id', 'line_item_id')} FROM known")
def line_item_fk(t: Tables):
    return N.resolve_line_item(MP.map_line_item(t.raw_rows), D.line_items(t.spark)).select("row_id", "line_item_id")


@query("normalized_rows", sql=f"""WITH {JUDGED_SQL}
SELECT row_id, company_id, canon AS period_label, kind AS period_type, CAST(start_date AS VARCHAR) AS start_date,
  {big('item_id', 'line_item_id')}, {r4('amount', 'value')}, vt AS value_type, 'Monthly' AS frequency, 'USD' AS currency,
  source_file, {big('page', 'source_page')}, 'CSV' AS source_type, hash FROM facts""")
def normalized_rows(t: Tables):
    return t.facts.drop("line_item", "notes")


@query("rejected_rows", sql=f"WITH {JUDGED_SQL} SELECT row_id, reason FROM judged WHERE reason IS NOT NULL")
def rejected_rows(t: Tables):
    return N.rejected(t.judged).select("row_id", "reason")


@query("source_tags", sql=f"""WITH {RAW_SQL} SELECT row_id, source_file AS source_file, 'CSV' AS source_type FROM raw_rows""")
def source_tags(t: Tables):
    path = F.concat(F.lit("/data/in/"), F.col("source_file"))
    return t.raw_rows.select("row_id", V.source_tags(path).alias("s")).select("row_id", "s.*")


# -- keyed writes ----------------------------------------------------------------

_KEY = "company_id, canon, item, vt, source_file"


@query("fact_append_new", sql=f"""WITH {JUDGED_SQL},
held AS (SELECT DISTINCT {_KEY} FROM facts WHERE start_date < DATE '1998-01-01' AND kind = 'Monthly'),
firsts AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY row_id) AS rn FROM facts)
SELECT row_id, company_id, canon AS period_label, item AS line_item, vt AS value_type, source_file, {r4('amount', 'value')}
FROM firsts f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.company_id = f.company_id AND h.canon = f.canon
  AND h.item = f.item AND h.vt = f.vt AND h.source_file = f.source_file)""")
def fact_append_new(t: Tables):
    """The monthly facts before 1998 are held already; the whole input arrives again."""
    columns = ["row_id", *sinks.FACT_KEY, "value"]
    facts = written(t.facts.select(*columns, "start_date", "period_type"), "facts")
    held = facts.where((F.col("start_date") < F.lit("1998-01-01").cast("date")) & (F.col("period_type") == "Monthly"))
    return sinks.append_new(held, facts.select(*columns), order=["row_id"])


@query("seed_missing_line_items", sql=f"""WITH {RAW_SQL}
SELECT DISTINCT line_item AS name FROM raw_rows WHERE row_id % 6 = 4""")
def seed_missing_line_items(t: Tables):
    wanted = MP.map_line_item(t.raw_rows).where("line_item is not null").select(F.col("line_item").alias("name"))
    return sinks.seed_missing(D.line_items(t.spark), wanted)


@query("ingest_summary", sql=f"""WITH {JUDGED_SQL},
held AS (SELECT DISTINCT {_KEY} FROM facts WHERE kind = 'Yearly'),
new AS (SELECT DISTINCT {_KEY} FROM facts EXCEPT SELECT * FROM held)
SELECT {big('count(*)', 'rows_extracted')}, {big('count(*) FILTER (WHERE reason IS NULL)', 'rows_normalized')},
  {big('count(*) FILTER (WHERE reason IS NOT NULL)', 'error_count')},
  {big("count(*) FILTER (WHERE reason = 'incomplete')", 'rejected_incomplete')},
  {big("count(*) FILTER (WHERE reason = 'period')", 'rejected_period')},
  {big("count(*) FILTER (WHERE reason = 'period_id')", 'rejected_period_id')},
  {big("count(*) FILTER (WHERE reason = 'line_item')", 'rejected_line_item')},
  {big("count(*) FILTER (WHERE reason = 'value')", 'rejected_value')},
  {big('(SELECT count(*) FROM new)', 'rows_persisted')},
  {big('count(*) FILTER (WHERE reason IS NULL) - (SELECT count(*) FROM new)', 'rows_skipped')} FROM judged""")
def ingest_summary(t: Tables):
    """The whole ingest from raw headers on, into a fact table that holds the yearly rows."""
    aliases = D.period_aliases(t.order_calendar)
    raw = t.raw_rows.withColumnsRenamed({"line_item": "Metric Name", "period_label": "Period", "value": "Amount",
                                         "value_type": "Scenario", "source_page": "Page"})
    held = written(t.facts.where(F.col("period_type") == "Yearly").select(*sinks.FACT_KEY), "facts")
    _, summary = N.ingest(raw, held, D.line_items(t.spark), aliases, order=["row_id"])
    return summary
