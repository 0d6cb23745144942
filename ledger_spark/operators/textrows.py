"""Rules that find line items and amounts in text, as set operations over (key, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledger_spark import settings
from ledger_spark.functions import values as V

NUMBER_TOKEN = r"[0-9,]+\.?[0-9]*"
VALUE_TOKEN = r"[\(]?[0-9,]+\.?[0-9]*[\)]?"


def text_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line): one row per line, trimmed."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")) \
             .withColumn("line", F.trim("line"))


def first_term(c: Column, terms: list[str]) -> Column:
    found = F.lit(None).cast("string")
    for term in reversed(terms):
        found = F.when(F.lower(c).contains(term.lower()), F.lit(term)).otherwise(found)
    return found


def longest_number(c: Column) -> Column:
    """The number with the most characters besides commas; the earliest of equals."""
    tokens = F.regexp_extract_all(c, F.lit(NUMBER_TOKEN), F.lit(0))
    ranked = F.transform(tokens, lambda tok, i: F.struct(
        F.length(F.replace(tok, F.lit(","), F.lit(""))).alias("size"), (-i).alias("back"), tok.alias("token")))
    return F.array_max(ranked)["token"]


def term_number_lines(df: DataFrame, key: str, terms: list[str] | None = None) -> DataFrame:
    """Lines of at least 3 characters that hold a term and a number: (key, line_no, line_item, value, raw_text)."""
    terms = settings.FINANCIAL_TERMS if terms is None else terms
    lines = text_lines(df, key).where((F.length("line") >= 3) & F.col("line").rlike("[0-9,]"))
    return (lines.withColumn("_term", first_term(F.col("line"), terms)).where(F.col("_term").isNotNull())
                 .select(key, "line_no", F.initcap("_term").alias("line_item"),
                         longest_number(F.col("line")).alias("value"), F.col("line").alias("raw_text"))
                 .where(F.col("value").isNotNull()))


def looks_like_number(c: Column) -> Column:
    return F.trim(c).rlike(r"^[(),0-9.\s-]+$")


def looks_like_value(c: Column) -> Column:
    return F.trim(c).rlike("[0-9]") | F.trim(c).contains("(")


def has_number_lines(c: Column, at_least: int = 3) -> Column:
    """At least three lines hold a digit, comma, bracket, dot or dash."""
    return F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x).rlike(r"[0-9,().-]"))) >= at_least


def is_financial_line(c: Column, skip: list[str] | None = None, terms: list[str] | None = None) -> Column:
    text = F.trim(c)
    skip = settings.LINE_SKIP_TERMS if skip is None else skip
    terms = settings.LINE_TERMS if terms is None else terms
    return F.coalesce(F.when(F.length(text) < 2, False).when(V.rlike_any(text, skip), False)
                       .when(V.rlike_any(text, terms), True)
                       .otherwise((F.length(text) > 2) & ~looks_like_number(text)), F.lit(False))


def clean_line_item(c: Column, phrases: list[str] | None = None) -> Column:
    """Drop the qualifiers; a canonical phrase inside the name replaces it, the first listed winning."""
    text = F.trim(c)
    for word in settings.NAME_QUALIFIERS:
        text = F.replace(text, F.lit(word), F.lit(""))
    result = text
    for phrase in reversed(settings.CANONICAL_PHRASES if phrases is None else phrases):
        result = F.when(F.lower(text).contains(phrase.lower()), F.lit(phrase)).otherwise(result)
    return result


def first_value(c: Column) -> Column:
    """The first number token that keeps two characters without commas and brackets."""
    tokens = F.regexp_extract_all(F.trim(c), F.lit(VALUE_TOKEN), F.lit(0))
    return F.get(F.filter(tokens, lambda t: F.length(F.translate(t, ",()", "")) >= 2), F.lit(0))


def zip_cells(df: DataFrame, key: list[str], labels: str, values: str) -> DataFrame:
    """A many-line label cell and a many-line value cell, paired by line position."""
    strip = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.arrays_zip(strip(F.col(labels)).alias("label"), strip(F.col(values)).alias("amount"))
    return (df.select(*key, F.posexplode(pairs).alias("position", "pair"))
              .select(*key, "position", F.col("pair.label").alias("raw_label"),
                      F.col("pair.amount").alias("raw_value"))
              .where(F.col("raw_label").isNotNull() & F.col("raw_value").isNotNull()))


def aligned_items(df: DataFrame, key: list[str], labels: str, values: str, skip: list[str] | None = None,
                  terms: list[str] | None = None, phrases: list[str] | None = None) -> DataFrame:
    """Paired cells kept where the label is a financial line and the value holds a number."""
    pairs = zip_cells(df, key, labels, values)
    return (pairs.where(is_financial_line(F.col("raw_label"), skip, terms))
                 .select(*key, "position", clean_line_item(F.col("raw_label"), phrases).alias("line_item"),
                         first_value(F.col("raw_value")).alias("value"))
                 .where(F.col("value").isNotNull()))


def token_rows(df: DataFrame, key: str) -> DataFrame:
    """Lines of three or more words: the first three are item, period and amount."""
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    return (text_lines(df, key).withColumn("_w", words).where(F.size("_w") >= 3)
            .select(key, "line_no", F.col("_w")[0].alias("line_item"), F.col("_w")[1].alias("period_label"),
                    F.col("_w")[2].alias("value")))


def extract_with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Primary rows where a key has any, otherwise its fallback rows."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti"))


def header_periods(cells: DataFrame, first_rows: int = 3) -> DataFrame:
    """Tag cells of the first rows that name a period or a variance; (…, kind, period_label, data_type)."""
    low = V.lower_trim(F.col("cell"))
    hit = lambda words: V.rlike_any(low, words)
    label, data_type = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, value in reversed(settings.HEADER_PERIOD_LABELS):
        label = F.when(low.contains(word), F.lit(value)).otherwise(label)
    for word in reversed(settings.HEADER_DATA_TYPES):
        data_type = F.when(low.contains(word), F.lit(word)).otherwise(data_type)
    kinds = F.filter(F.array(F.when(hit(settings.HEADER_PERIOD_WORDS), F.lit("period")),
                             F.when(hit(settings.HEADER_VARIANCE_WORDS), F.lit("variance"))),
                     lambda k: k.isNotNull())
    return (cells.where((F.col("row_idx") < first_rows) & F.col("cell").isNotNull())
                 .select(*cells.columns, F.explode(kinds).alias("kind"), label.alias("tag_label"),
                         data_type.alias("data_type")))


def classify_cells(cells: DataFrame) -> DataFrame:
    """A number becomes the value of item 'Unknown', other text an item without value; blanks go."""
    text = F.trim("cell")
    number = looks_like_number(text)
    return (cells.where(F.col("cell").isNotNull() & ~text.isin("", "None", "nan"))
                 .select(*[c for c in cells.columns if c != "cell"],
                         F.when(number, "Unknown").otherwise(text).alias("line_item"),
                         F.when(number, text).alias("value")))
