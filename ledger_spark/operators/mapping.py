"""Header canonicalisation, line-item aliasing and row defaults."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ledger_spark import settings
from ledger_spark.functions import values as V
from ledger_spark.sources import dimensions as D

MAPPED_COLUMNS = ["line_item", "period_label", "period_type", "value_type", "frequency", "value",
                  "currency", "source_file", "source_page", "notes"]


def header_synonyms(headers: DataFrame, column: str = "header") -> DataFrame:
    """(header, field): by case-insensitive synonym; of several fields the first configured wins."""
    wanted = headers.select(column).distinct().withColumn("synonym_lc", V.lower_trim(F.col(column)))
    return (wanted.join(D.field_synonyms(headers.sparkSession), "synonym_lc")
                  .groupBy(column).agg(F.min_by("field", "field_order").alias("field")))


def taxonomy_family(column):
    """The first family one of whose patterns matches at the start of the header, else null."""
    family = F.lit(None).cast("string")
    for name, patterns in reversed(settings.TAXONOMY):
        hit = F.lit(False)
        for pattern in patterns:
            anchored = pattern if pattern.startswith("^") else f"^{pattern}"
            hit = hit | column.rlike(f"(?i){anchored}")
        family = F.when(hit, F.lit(name)).otherwise(family)
    return family


def header_taxonomy(headers: DataFrame, column: str = "header") -> DataFrame:
    """(header, family) for headers that some rule family matches."""
    return (headers.select(column).distinct().withColumn("family", taxonomy_family(F.col(column)))
                   .where(F.col("family").isNotNull()))


def unmapped_headers(headers: DataFrame, column: str = "header") -> DataFrame:
    """Headers that neither a synonym nor a rule family names."""
    names = headers.select(column).distinct().withColumn("synonym_lc", V.lower_trim(F.col(column)))
    return (names.where(taxonomy_family(F.col(column)).isNull())
                 .join(D.field_synonyms(headers.sparkSession).select("synonym_lc"), "synonym_lc", "left_anti")
                 .select(column))


def header_plan(columns: list[str]) -> dict[str, str]:
    """Raw column -> column for one frame's own header; every target is used once.

    A column that has a canonical name keeps it.  Then synonyms choose, in column order, then rule families.  Of
    columns that differ in case or blanks only, the first keeps a name; the others get a free one (`value_2`).
    """
    fields = {field for _, field, _, _ in settings.FIELDS} | set(settings.TAXONOMY_COLUMN.values())
    plan: dict[str, str] = {}
    for raw in columns:
        if raw in fields:
            plan[raw] = raw
    for raw in columns:
        for _, field, _, synonyms in settings.FIELDS:
            if raw not in plan and field not in plan.values() and raw.lower().strip() in {s.lower() for s in synonyms}:
                plan[raw] = field
    for raw in columns:
        field = settings.TAXONOMY_COLUMN.get(family_of(raw))
        if raw not in plan and field and field not in plan.values():
            plan[raw] = field
    used = {name.lower() for name in plan.values()}
    for raw in columns:
        if raw not in plan:
            name, n = raw, 1
            while name.lower() in used:
                n += 1
                name = f"{raw}_{n}"
            plan[raw] = name
            used.add(name.lower())
    return plan


def family_of(header: str) -> str | None:
    """`taxonomy_family` of one header; a header has few names, so no job is needed."""
    for name, patterns in settings.TAXONOMY:
        if any(re.match(pattern, header, re.IGNORECASE) for pattern in patterns):
            return name
    return None


def canonical_headers(df: DataFrame) -> DataFrame:
    """Rename columns to the canonical vocabulary; a rule family fills a field no synonym named."""
    return df.toDF(*[header_plan(df.columns)[c] for c in df.columns])


def suggest_names(names: DataFrame, column: str, dictionary: list[str], cutoff: int) -> DataFrame:
    """The closest dictionary entry within `cutoff` edits for each distinct name.

    The dictionary is an array literal inside the row expression, so no pair of rows is ever formed.
    """
    text = V.lower_trim(F.col(column))
    nearest = F.array_min(F.transform(F.array(*[F.lit(d) for d in dictionary]), lambda d: F.struct(
        F.levenshtein(text, d).alias("distance"), d.alias("suggestion"))))
    return (names.select(column).distinct().withColumn("_best", nearest)
                 .select(column, F.col("_best.suggestion").alias("suggestion"),
                         F.col("_best.distance").alias("distance"))
                 .where(F.col("distance") <= cutoff))


def map_line_item(df: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Replace a known alias by its canonical name; keep other names as written."""
    aliases = aliases if aliases is not None else D.line_item_aliases(D.line_items(df.sparkSession))
    known = aliases.select(F.col("alias_lc").alias("_alias"), F.col("name").alias("_name"))
    return (df.join(known, V.lower_trim(F.col("line_item")) == F.col("_alias"), "left")
              .withColumn("line_item", F.coalesce("_name", "line_item")).drop("_alias", "_name"))


def apply_defaults(df: DataFrame) -> DataFrame:
    """Missing columns and empty cells get their defaults; labels and notes are trimmed."""
    have = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    is_date = "period_label" in df.columns and dict(df.dtypes)["period_label"] in (
        "date", "timestamp", "timestamp_ntz")
    label = F.date_format("period_label", "yyyy-MM-dd") if is_date else F.trim(have("period_label"))
    changed = {"period_label": F.coalesce(label, F.lit("")),
               "notes": F.coalesce(F.trim(have("notes")), F.lit("")),
               **{c: F.coalesce(have(c), F.lit(settings.DEFAULTS[c]))
                  for c in ("period_type", "value_type", "frequency", "currency")}}
    for name in MAPPED_COLUMNS:
        changed.setdefault(name, have(name))
    return df.withColumns(changed)


def map_rows(df: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Raw string rows -> mapped rows: canonical line item plus defaults."""
    return map_line_item(apply_defaults(df), aliases)
