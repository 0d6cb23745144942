"""Report contents and record listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledger_spark import settings
from ledger_spark.functions import values as V


def report_metrics(fact: DataFrame, items: DataFrame, periods: DataFrame, company: Column | None = None) -> DataFrame:
    """Facts with line-item name and period, in start date and name order.

    Spark picks each join by the size it sees; the sort is a range-partitioned one.
    """
    rows = fact if company is None else fact.where(F.col("company_id") == company)
    return (rows.join(items, "line_item_id")
                .join(periods.select("period_label", "period_type", "start_date"),
                      ["period_label", "period_type"])
                .select("company_id", "start_date", "name", "period_label", "value_type", "value", "currency",
                        "source_file", "source_page", "notes")
                .orderBy("company_id", "start_date", "name"))


def report_questions(questions: DataFrame, order: list[Column], n: int = 10, width: int = 80) -> DataFrame:
    """The newest n questions per company: cut text, status, priority label."""
    newest = W.partitionBy("company_id").orderBy(*order)
    return (questions.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= n)
                     .select("company_id", "position", V.cut(F.col("question_text"), width).alias("question"),
                             F.lit("Open").alias("status"), V.priority_label(F.col("priority")).alias("priority")))


def companies_with_data(fact: DataFrame) -> DataFrame:
    return fact.groupBy("company_id").agg(F.count(F.lit(1)).alias("metrics"))


def records(df: DataFrame, order: list[Column], condition: Column | None = None) -> DataFrame:
    """All records, or those of one company or id, newest first; the condition reaches the Parquet scan."""
    return (df if condition is None else df.where(condition)).orderBy(*order)


def distinct_companies(df: DataFrame) -> DataFrame:
    return df.select("company_id").distinct()


def record_lookup(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted keys with whether a record exists."""
    present = df.join(wanted.select(key), key, "left_semi").select(key).distinct() \
                .withColumn("found", F.lit(True))
    return wanted.select(key).join(present, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def table_counts(tables: dict[str, DataFrame], transient: list[str] = settings.TRANSIENT_TABLES) -> DataFrame:
    """(table_name, retention, records) of every table."""
    parts = [df.agg(F.count(F.lit(1)).alias("records"))
               .select(F.lit(name).alias("table_name"),
                       F.lit("transient" if name in transient else "persistent").alias("retention"), "records")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def purge_preview(tables: dict[str, DataFrame], rules: dict[str, Column],
                  order: list[str] = settings.TRANSIENT_TABLES) -> DataFrame:
    """(position, table_name, to_delete, to_keep) in dependency order; nothing is deleted."""
    parts = []
    for position, name in enumerate(n for n in order if n in tables):
        doomed = F.coalesce(rules.get(name, F.lit(True)), F.lit(False))
        parts.append(tables[name].agg(F.count_if(doomed).alias("to_delete"), F.count_if(~doomed).alias("to_keep"))
                     .select(F.lit(position + 1).alias("position"), F.lit(name).alias("table_name"),
                             "to_delete", "to_keep"))
    return reduce(DataFrame.unionByName, parts)


def purge(df: DataFrame, doomed: Column) -> DataFrame:
    """The rows that stay."""
    return df.where(~F.coalesce(doomed, F.lit(False)))
