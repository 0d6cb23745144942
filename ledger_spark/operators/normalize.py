"""Period resolution, the accept/reject split, de-duplication and the whole ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledger_spark import settings
from ledger_spark.functions import periods as P, values as V
from ledger_spark.operators import mapping as M
from ledger_spark.sources import dimensions as D, sinks

REASONS = ["incomplete", "period", "period_id", "line_item", "value"]


def resolve_alias(df: DataFrame, aliases: DataFrame, column: str = "period_label") -> DataFrame:
    """Add `alias_label`, `alias_type` for labels the alias dimension knows (any case, cleaned)."""
    known = aliases.select(F.col("alias_lc").alias("_clean"), F.col("period_label").alias("alias_label"),
                           F.col("period_type").alias("alias_type"))
    return df.withColumn("_clean", F.lower(P.clean_period(F.col(column)))).join(known, "_clean", "left") \
             .drop("_clean")


def resolve_period(df: DataFrame, aliases: DataFrame | None = None,
                   column: str = "period_label") -> DataFrame:
    """Add `canonical_label`, `canonical_type`: alias first, then the anchored patterns."""
    clean = df.withColumn("_clean", F.lower(P.clean_period(F.col(column))))
    known = F.lit(None).cast("string")
    if aliases is not None:
        clean = clean.join(aliases.select(F.col("alias_lc").alias("_clean"), F.col("period_label").alias("_label"),
                                          F.col("period_type").alias("_type")), "_clean", "left")
        known = F.col("_label")
    # The patterns are tried only on labels that no alias names.
    parsed = clean.withColumn("_text", F.when(known.isNull(), P.canonical_text(F.col("_clean")))) \
                  .withColumn("_p", P.parse_canonical(F.col("_text")))
    label, kind = F.col("_p.period_label"), F.col("_p.period_type")
    if aliases is not None:
        label, kind = F.coalesce("_label", label), F.coalesce("_type", kind)
    return parsed.select(*df.columns, label.alias("canonical_label"), kind.alias("canonical_type"))


def period_bounds(df: DataFrame, label: str = "period_label", kind: str = "period_type") -> DataFrame:
    start = P.period_start(F.col(label), F.col(kind))
    return df.withColumns({"start_date": start, "end_date": P.period_end(start, F.col(kind))})


def new_periods(df: DataFrame, cal: DataFrame) -> DataFrame:
    """Canonical labels that occur in `df` but not in the calendar, with their bounds."""
    seen = df.select(F.col("canonical_label").alias("period_label"),
                     F.col("canonical_type").alias("period_type")).where("period_label is not null").distinct()
    return period_bounds(seen.join(cal.select("period_label", "period_type"),
                                   ["period_label", "period_type"], "left_anti")) \
        .where(F.col("start_date").isNotNull())


def resolve_line_item(df: DataFrame, items: DataFrame, column: str = "line_item") -> DataFrame:
    """Add `line_item_id`: by exact name, else by exact alias, else null."""
    by_name = items.select(F.col("name").alias("_name"), F.col("line_item_id").alias("_by_name"))
    by_alias = (items.select(F.explode("aliases").alias("_alias"), "line_item_id")
                     .groupBy("_alias").agg(F.min("line_item_id").alias("_by_alias")))
    return (df.join(by_name, F.col(column) == F.col("_name"), "left")
              .join(by_alias, F.col(column) == F.col("_alias"), "left")
              .withColumn("line_item_id", F.coalesce("_by_name", "_by_alias"))
              .drop("_name", "_by_name", "_alias", "_by_alias"))


def judge(mapped: DataFrame, items: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Mapped rows plus everything the normaliser derives and `reason`, the first rule a row fails.

    One frame serves both sides of the split, so accepted and rejected rows always add up.
    """
    dated = resolve_period(mapped, aliases)
    start = P.canonical_start(F.col("canonical_label"), F.col("canonical_type"))
    parsed = dated.withColumns({"start_date": start, "amount": V.parse_money(F.col("value"))})
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    # Parsed columns lie below the line-item joins, so a filter on `reason` does not repeat the parsing.
    return resolve_line_item(parsed, items).withColumn(
        "reason",
        F.when(blank("line_item") | blank("period_label") | F.col("value").isNull(), "incomplete")
         .when(F.col("canonical_label").isNull(), "period")
         .when(F.col("start_date").isNull(), "period_id")
         .when(F.col("line_item_id").isNull(), "line_item")
         .when(F.col("amount").isNull(), "value"))


def accepted(judged: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Fact rows of the judged rows that failed no rule."""
    return fact_columns(judged.where(F.col("reason").isNull()), keep)


def fact_columns(judged: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Judged rows in the shape of the fact table."""
    value_type = F.coalesce(V.clean_text(F.col("value_type")), F.lit(settings.DEFAULTS["value_type"]))
    sheet = F.col("_sheet_name") if "_sheet_name" in judged.columns else F.lit(None).cast("string")
    tags = V.source_tags(F.col("source_file"))
    return judged.select(
        *keep, "company_id", F.col("canonical_label").alias("period_label"),
        F.col("canonical_type").alias("period_type"), "start_date", "line_item_id", "line_item",
        F.col("amount").alias("value"), value_type.alias("value_type"),
        F.coalesce(V.clean_text(F.col("frequency")), F.col("canonical_type")).alias("frequency"),
        F.coalesce(V.clean_text(F.col("currency")), F.lit(settings.DEFAULTS["currency"])).alias("currency"),
        tags["source_file"].alias("source_file"),
        V.page_number(F.col("source_page"), sheet).alias("source_page"),
        tags["source_type"].alias("source_type"), V.clean_text(F.col("notes")).alias("notes"),
        V.row_hash(F.col("company_id"), F.col("canonical_label"), F.col("line_item"), value_type,
                   tags["source_file"]).alias("hash"))


def rejected(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("reason").isNotNull())


def latest_cell(fact: DataFrame, order: list[str]) -> DataFrame:
    """One value per (company, period, item, value type) across source files, the last ingested."""
    key = ["company_id", "line_item", "period_type", "period_label", "value_type"]
    return fact.groupBy(*key).agg(F.max_by("value", F.struct(*order)).alias("value"))


def stage_summary(judged: DataFrame, fact: DataFrame, key: list[str] = sinks.FACT_KEY) -> DataFrame:
    """One row of stage counts, from one pass over the judged rows.

    They are counted by (key, reason) first; on those far fewer rows the fact table's keys are looked up.
    """
    groups = fact_columns(judged, ["reason"]).groupBy(*key, "reason").agg(F.count(F.lit(1)).alias("n"))
    held = sinks.null_safe_key(fact, key).distinct().withColumn("_held", F.lit(True))
    good = F.col("reason").isNull()
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return groups.join(held, sinks.null_safe_match(key), "left").agg(
        total(F.lit(True)).alias("rows_extracted"), total(good).alias("rows_normalized"),
        total(~good).alias("error_count"),
        *[total(F.col("reason") == r).alias(f"rejected_{r}") for r in REASONS],
        F.count_if(good & F.col("_held").isNull()).alias("rows_persisted")) \
        .withColumn("rows_skipped", F.col("rows_normalized") - F.col("rows_persisted"))


def ingest(raw: DataFrame, fact: DataFrame, items: DataFrame, period_aliases: DataFrame | None = None,
           order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw string rows -> (new fact rows, one-row summary); nothing runs until one of them is used."""
    order = order or ["source_page", "value"]
    judged = judge(M.map_rows(M.canonical_headers(raw)), items, period_aliases)
    keep = [c for c in order if c in judged.columns and c not in ("source_page", "value")]
    new_rows = sinks.append_new(fact, accepted(judged, keep), order=order)
    return new_rows.drop(*keep), stage_summary(judged, fact)
