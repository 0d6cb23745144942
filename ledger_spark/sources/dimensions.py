"""Calendar, period-alias, line-item and header dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledger_spark import settings
from ledger_spark.functions import periods as P
from ledger_spark.session import local_frame


def calendar(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Month, quarter and year periods that touch [start, end], from a one-row frame of bounds."""
    months = bounds.select(F.explode(F.sequence(
        F.trunc(F.col(start).cast("date"), "month"), F.trunc(F.col(end).cast("date"), "month"),
        F.expr("interval 1 month"))).alias("month"))
    kinds = F.array(*[F.struct(F.lit(kind).alias("period_type"), F.trunc("month", unit).alias("start_date"))
                      for kind, unit in (("Monthly", "month"), ("Quarterly", "quarter"), ("Yearly", "year"))])
    rows = months.select(F.explode(kinds).alias("p")).select("p.*").distinct()
    kind, first = F.col("period_type"), F.col("start_date")
    return rows.select(kind, P.period_label(first, kind).alias("period_label"), first,
                       P.period_end(first, kind).alias("end_date"),
                       P.period_seq(first, kind).alias("period_seq"))


def calendar_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    return calendar(local_frame(spark, ["start", "end"], [(start, end)]))


def _alias_spellings(kind, first):
    year = F.year(first).cast("string")
    yy = F.substring(year, 3, 2)
    number = F.month(first).cast("string")
    quarter = F.quarter(first).cast("string")
    abbr = F.date_format(first, "MMM")
    last_abbr = F.date_format(F.add_months(first, 2), "MMM")
    label = P.period_label(first, kind)
    monthly = [label, F.concat_ws("/", number, year), F.date_format(first, "yyyy.MM"),
               F.concat_ws(" ", abbr, year), F.date_format(first, "MMMM yyyy"), F.concat_ws("-", abbr, year),
               F.concat(abbr, F.lit(" '"), yy), F.concat_ws("/", number, yy), F.concat_ws(" ", year, abbr),
               F.concat_ws("-", yy, abbr)]
    quarterly = [label, F.concat(F.lit("Q"), quarter, F.lit(" "), year),
                 F.concat(year, F.lit(" Q"), quarter), F.concat(quarter, F.lit("Q"), yy),
                 F.concat(abbr, F.lit("-"), last_abbr, F.lit(" "), year)]
    yearly = [label, F.concat(F.lit("FY"), yy), F.concat(F.lit("FY "), year), F.concat(F.lit("CY"), yy),
              F.concat(F.lit("Year "), year)]
    return (F.when(kind == "Monthly", F.array(*monthly)).when(kind == "Quarterly", F.array(*quarterly))
             .otherwise(F.array(*yearly)))


def period_aliases(cal: DataFrame) -> DataFrame:
    """(alias_lc, period_label, period_type): every spelling of every period of a calendar."""
    kind, first = F.col("period_type"), F.col("start_date")
    return cal.select(F.explode(_alias_spellings(kind, first)).alias("alias"), "period_label", "period_type") \
              .select(F.lower("alias").alias("alias_lc"), "period_label", "period_type").distinct()


def line_items(spark: SparkSession, seeded: bool = False) -> DataFrame:
    """(line_item_id, name, aliases) of the core items, with the seeder's further ones on request."""
    rows = [(i, name, aliases) for i, name, aliases in settings.LINE_ITEMS]
    if seeded:
        first = 11000 + len(settings.LINE_ITEMS) + 1
        rows += [(first + n, name, aliases) for n, (name, aliases) in enumerate(settings.SEED_LINE_ITEMS)]
    return local_frame(spark, ["line_item_id", "name", "aliases"], rows)


def line_item_aliases(items: DataFrame) -> DataFrame:
    """(alias_lc, name): each alias and the name itself, lower-cased, once."""
    spellings = F.concat(F.array("name"), "aliases")
    return items.select(F.explode(spellings).alias("alias"), "name") \
                .select(F.lower(F.trim("alias")).alias("alias_lc"), "name").distinct()


def field_synonyms(spark: SparkSession) -> DataFrame:
    """(synonym_lc, field, field_order): the header spellings of each canonical field."""
    rows = [(s.lower(), field, n) for n, (_, field, _, synonyms) in enumerate(settings.FIELDS)
            for s in synonyms]
    return local_frame(spark, ["synonym_lc", "field", "field_order"], rows).distinct()


def observations(spark: SparkSession) -> DataFrame:
    return local_frame(spark, ["observation_id", "observation_name", "unit", "materiality", "importance",
                               "category", "calculation_type", "family_weight"], settings.OBSERVATIONS)


def templates(spark: SparkSession) -> DataFrame:
    return local_frame(spark, ["template_id", "observation_id", "importance", "category", "priority",
                               "weight", "template_text"], settings.TEMPLATES)


def placeholder_templates(spark: SparkSession) -> DataFrame:
    return local_frame(spark, ["category", "priority", "question_text"], settings.PLACEHOLDER_TEMPLATES)
