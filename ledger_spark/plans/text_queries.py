"""Text rules over whole documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledger_spark import settings
from ledger_spark.operators import textrows as X
from ledger_spark.plans.registry import Tables, big, query

# Terms that the invented prose contains; the financial lists are defaults, not constants of the rules.
TERMS = ["tion", "ing", "the", "que"]
SKIP = ["copyright", "license"]
WORDS = ["the", "der", "que", "tion"]
PHRASES = ["Ring", "Que"]

# trim() of both engines strips blanks only, so lines keep tabs and carriage returns alike.
LINES_SQL = """
split_lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (SELECT doc_id, i - 1 AS line_no, trim(l[i]) AS line FROM split_lines)
"""


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def _number_like(column: str) -> str:
    return f"regexp_matches(trim({column}), '^[(),0-9.\\s-]+$')"


def _financial(column: str) -> str:
    return (f"CASE WHEN length(trim({column})) < 2 THEN false WHEN {_any(column, SKIP)} THEN false "
            f"WHEN {_any(column, WORDS)} THEN true ELSE length(trim({column})) > 2 AND NOT {_number_like(column)} END")


_TERM_CASE = "CASE " + " ".join(f"WHEN contains(lower(line), '{t}') THEN '{t.title()}'" for t in TERMS) + " END"


@query("term_number_lines", sql=f"""WITH {LINES_SQL},
hits AS (SELECT doc_id, line_no, line, {_TERM_CASE} AS line_item, regexp_extract_all(line, '[0-9,]+\\.?[0-9]*') AS toks FROM lines WHERE length(line) >= 3),
flat AS (SELECT doc_id, line_no, line, line_item, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM hits WHERE line_item IS NOT NULL)
SELECT doc_id, {big('line_no', 'line_no')}, line_item,
  first(tok ORDER BY length(replace(tok, ',', '')) DESC, pos) AS value, line AS raw_text
FROM flat GROUP BY doc_id, line_no, line, line_item""")
def term_number_lines(t: Tables):
    return X.term_number_lines(t("documents"), "doc_id", TERMS)


# The next document by id supplies the second cell.
_PAIRED_SQL = """
cells AS (SELECT a.doc_id, a.text AS labels, b.text AS amounts FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
la AS (SELECT doc_id, list_filter(list_transform(string_split(labels, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l,
  list_filter(list_transform(string_split(amounts, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS v FROM cells),
pairs AS (SELECT doc_id, i - 1 AS position, l[i] AS raw_label, v[i] AS raw_value
  FROM (SELECT *, unnest(range(1, least(len(l), len(v)) + 1)) AS i FROM la))
"""
_BARE_NAME = reduce(lambda x, word: f"replace({x}, '{word}', '')", settings.NAME_QUALIFIERS, "trim(raw_label)")
_NAME_SQL = "CASE " + " ".join(f"WHEN contains(lower({_BARE_NAME}), '{p.lower()}') THEN '{p}'" for p in PHRASES) + f" ELSE {_BARE_NAME} END"
_FIRST_VALUE = ("list_filter(regexp_extract_all(trim({c}), '[\\(]?[0-9,]+\\.?[0-9]*[\\)]?'), "
                "lambda t: length(translate(t, ',()', '')) >= 2)[1]")


def _paired(t: Tables):
    docs = t("documents").select("doc_id", "text")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("amounts"))
    return docs.withColumnRenamed("text", "labels").join(nxt, "doc_id")


@query("cell_alignment", sql=f"WITH {_PAIRED_SQL} SELECT doc_id, {big('position', 'position')}, md5(raw_label) AS label_digest, "
       "md5(raw_value) AS value_digest FROM pairs")
def cell_alignment(t: Tables):
    return X.zip_cells(_paired(t), ["doc_id"], "labels", "amounts").select(
        "doc_id", "position", F.md5("raw_label").alias("label_digest"), F.md5("raw_value").alias("value_digest"))


@query("cell_items", sql=f"""WITH {_PAIRED_SQL}, f AS (SELECT doc_id, position, {_NAME_SQL} AS line_item,
  {_FIRST_VALUE.format(c='raw_value')} AS value FROM pairs WHERE {_financial('raw_label')})
SELECT doc_id, {big('position', 'position')}, md5(line_item) AS item_digest, value FROM f WHERE value IS NOT NULL""")
def cell_items(t: Tables):
    """Aligned cells through all steps: filter of the labels, clean names, first values."""
    return X.aligned_items(_paired(t), ["doc_id"], "labels", "amounts", SKIP, WORDS, PHRASES).select(
        "doc_id", "position", F.md5("line_item").alias("item_digest"), "value")


@query("first_financial_value", sql=f"WITH {LINES_SQL}, f AS (SELECT doc_id, line_no, {_FIRST_VALUE.format(c='line')} AS value FROM lines) "
       f"SELECT doc_id, {big('line_no', 'line_no')}, value FROM f WHERE value IS NOT NULL")
def first_financial_value(t: Tables):
    lines = X.text_lines(t("documents"), "doc_id")
    return lines.select("doc_id", "line_no", X.first_value(F.col("line")).alias("value")).where("value is not null")


@query("line_item_clean", sql="""SELECT p_partkey, CASE WHEN contains(lower(n), 'red widget') THEN 'Red Widget' WHEN contains(lower(n), 'ring') THEN 'Ring' ELSE n END AS cleaned
FROM (SELECT p_partkey, p_name AS n FROM part)""")
def line_item_clean(t: Tables):
    """Part names under the qualifiers, with two phrases as canonical names."""
    qualified = F.concat(F.when(F.col("p_size") % 2 == 0, "Reported ").otherwise("Adjusted "), "p_name", F.lit(" "))
    return t("part").select("p_partkey", X.clean_line_item(qualified, ["Red Widget", "Ring"]).alias("cleaned"))


@query("financial_line_filter", sql=f"WITH {LINES_SQL} SELECT doc_id, {big('count(*)', 'lines')}, "
       f"{big(f'count(*) FILTER (WHERE {_financial(chr(108)+chr(105)+chr(110)+chr(101))})', 'financial')} FROM lines GROUP BY doc_id")
def financial_line_filter(t: Tables):
    lines = X.text_lines(t("documents"), "doc_id")
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(X.is_financial_line(F.col("line"), SKIP, WORDS)).alias("financial"))


@query("number_predicates", sql=f"""SELECT doc_id, {big(f"len(list_filter(string_split(text, chr(10)), lambda x: {_number_like('x')}))", 'number_lines')},
  {big("len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]') OR contains(x, '(')))", 'value_lines')},
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9,().-]'))) >= 3 AS many_numbers FROM documents""")
def number_predicates(t: Tables):
    lines = F.split("text", "\n")
    return t("documents").select(
        "doc_id", F.size(F.filter(lines, X.looks_like_number)).alias("number_lines"),
        F.size(F.filter(lines, X.looks_like_value)).alias("value_lines"),
        X.has_number_lines(F.col("text")).alias("many_numbers"))


@query("token_rows", sql=f"""WITH {LINES_SQL}, w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS w FROM lines)
SELECT doc_id, {big('line_no', 'line_no')}, w[1] AS line_item, w[2] AS period_label, w[3] AS value FROM w WHERE len(w) >= 3""")
def token_rows(t: Tables):
    return X.token_rows(t("documents"), "doc_id")


@query("page_fallback", sql=f"""WITH {LINES_SQL},
prim AS (SELECT doc_id, count(*) AS n FROM lines WHERE {_TERM_CASE} IS NOT NULL AND length(line) >= 3 AND regexp_matches(line, '[0-9,]+') GROUP BY doc_id),
fall AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS w FROM lines) WHERE len(w) >= 3 GROUP BY doc_id)
SELECT doc_id, 'term' AS source, {big('n', 'rows')} FROM prim
UNION ALL SELECT doc_id, 'tokens', n FROM fall WHERE doc_id NOT IN (SELECT doc_id FROM prim)""")
def page_fallback(t: Tables):
    """Term lines where a document has any, else its token rows."""
    count = lambda df, tag: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("source", F.lit(tag))
    return X.extract_with_fallback(count(X.term_number_lines(t("documents"), "doc_id", TERMS), "term"),
                                   count(X.token_rows(t("documents"), "doc_id"), "tokens"), "doc_id")


_CELL = "element_at(array('Feb-25 Actual', 'Feb-24', 'Budget YTD', 'Variance %', 'Actual vs Budget', 'Prior', 'Notes', NULL), CAST(l_orderkey % 8 + 1 AS INT))"
_CELL_SQL = "(['Feb-25 Actual', 'Feb-24', 'Budget YTD', 'Variance %', 'Actual vs Budget', 'Prior', 'Notes', NULL])[CAST(l_orderkey % 8 + 1 AS INT)]"


@query("header_period_tags", sql=f"""WITH c AS (SELECT l_orderkey, l_linenumber, lower({_CELL_SQL}) AS c FROM lineitem WHERE l_linenumber - 1 < 3),
k AS (SELECT *, 'period' AS kind FROM c WHERE {' OR '.join(f"contains(c, '{w}')" for w in ('feb-25', 'feb-24', 'actual', 'budget', 'prior', 'ytd'))}
  UNION ALL SELECT *, 'variance' FROM c WHERE contains(c, 'variance') OR contains(c, 'vs'))
SELECT {big('l_orderkey', 'l_orderkey')}, {big('l_linenumber - 1', 'row_idx')}, kind,
  CASE WHEN contains(c, 'feb-25') THEN '2025-02' WHEN contains(c, 'feb-24') THEN '2024-02' END AS tag_label,
  CASE WHEN contains(c, 'actual') THEN 'actual' WHEN contains(c, 'budget') THEN 'budget' WHEN contains(c, 'variance') THEN 'variance' END AS data_type FROM k""")
def header_period_tags(t: Tables):
    """Each order as a table whose lines are rows."""
    cells = t("lineitem").selectExpr("l_orderkey", "l_linenumber - 1 as row_idx", f"{_CELL} as cell")
    return X.header_periods(cells).drop("cell")


@query("cell_classification", sql=f"""WITH {LINES_SQL}
SELECT doc_id, {big('line_no', 'line_no')}, CASE WHEN {_number_like('line')} THEN 'Unknown' ELSE md5(line) END AS line_item,
  CASE WHEN {_number_like('line')} THEN line END AS value FROM lines WHERE line NOT IN ('', 'None', 'nan')""")
def cell_classification(t: Tables):
    cells = X.text_lines(t("documents"), "doc_id").withColumnRenamed("line", "cell")
    rows = X.classify_cells(cells)
    return rows.withColumn("line_item", F.when(F.col("line_item") == "Unknown", "Unknown").otherwise(F.md5("line_item")))
