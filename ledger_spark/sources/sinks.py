"""Keyed writes on plain Parquet: append-if-absent, upsert, dimension seeding, report log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FACT_KEY = ["company_id", "period_label", "line_item", "value_type", "source_file"]


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by `order`.  An aggregate, so duplicates shrink before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(first).select(*key, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by `order`."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(last).select(*key, "_row.*").select(*df.columns)


def append_new(fact: DataFrame, incoming: DataFrame, key: list[str] = FACT_KEY,
               order: list[str] | None = None) -> DataFrame:
    """The incoming rows whose key the fact table does not hold yet, one per key.  Null key parts equal each other."""
    order = order or [c for c in incoming.columns if c not in key]
    return first_per_key(incoming, key, order).join(null_safe_key(fact, key), null_safe_match(key), "left_anti") \
                                              .select(*incoming.columns)


def null_safe_key(df: DataFrame, key: list[str]) -> DataFrame:
    """The key columns under names of their own, for `null_safe_match`."""
    return df.select(*[F.col(c).alias(f"_held_{c}") for c in key])


def null_safe_match(key: list[str]) -> Column:
    """Equality of all key parts, null with null.  Spark joins on it by hash or sort, as on plain equality."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in key])


def append_counts(incoming: DataFrame, new_rows: DataFrame) -> DataFrame:
    """One row (incoming, inserted, skipped)."""
    both = incoming.select(F.lit(1).alias("i"), F.lit(0).alias("n")) \
        .unionAll(new_rows.select(F.lit(0).alias("i"), F.lit(1).alias("n")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.agg(total("i").alias("incoming"), total("n").alias("inserted"),
                    (total("i") - total("n")).alias("skipped"))


def rebalanced(df: DataFrame, column: str) -> DataFrame:
    """Gather rows by `column` before a partitioned write; adaptive execution splits a hot value over many
    tasks and merges small ones, so files come out even."""
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({column}) */ * FROM {{rows}}", rows=df)


def write_fact(new_rows: DataFrame, path: str, partition: str = "period_type") -> None:
    """Append below one folder per value of `partition`."""
    rebalanced(new_rows, partition).write.mode("append").partitionBy(partition).parquet(path)


def held_keys(spark: SparkSession, path: str, schema: StructType, incoming: DataFrame, key: list[str],
              partition: str) -> DataFrame:
    """The keys of a fact table that `incoming` could meet: only the folders of its own partition values.

    The values reach the scan as a join, however many there are; where Spark broadcasts them, it prunes the folders
    while the query runs (the comparison with '' marks the join as selective).  Null values have a folder too.
    """
    held = spark.read.schema(schema).parquet(path)
    values = incoming.where(F.col(partition).cast("string") >= "").select(partition).distinct()
    return held.join(values, partition, "left_semi").unionByName(held.where(F.col(partition).isNull())).select(*key)


def upsert(target: DataFrame, source: DataFrame, key: list[str], version: str, ties: list[str] | None = None) -> DataFrame:
    """Rows of both, the highest version per key winning; of equal versions the highest by `ties` (all other columns)."""
    ties = [c for c in target.columns if c not in (*key, version)] if ties is None else ties
    return last_per_key(target.unionByName(source), key, [version, *ties])


def seed_missing(dim: DataFrame, wanted: DataFrame, key: str = "name") -> DataFrame:
    """The wanted members that the dimension lacks."""
    return wanted.select(key).distinct().join(dim.select(key), key, "left_anti")


def report_log(companies: DataFrame, report_type: str, file_path: Column, created_at: Column) -> DataFrame:
    """One log row per generated report."""
    return companies.select("company_id", F.lit(report_type).alias("report_type"),
                            file_path.alias("file_path"), created_at.alias("created_at"))


def log_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
