"""Checks on configuration tables and inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def alias_conflicts(aliases: DataFrame, alias: str, canonical: str) -> DataFrame:
    """Aliases that name more than one canonical."""
    return (aliases.groupBy(alias).agg(F.count_distinct(canonical).alias("owners"),
                                       F.min(canonical).alias("first_owner"), F.max(canonical).alias("last_owner"))
                   .where(F.col("owners") > 1))


def rule_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule a row breaks, in one pass.  A rule is the condition a good row meets."""
    broken = F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in rules.items()])
    return df.select(key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def valid_amount(c: Column) -> Column:
    return c.try_cast("decimal(28,2)").isNotNull()


def edit_aliases(aliases: DataFrame, adds: DataFrame, removes: DataFrame) -> DataFrame:
    """The alias table after additions and removals."""
    return (aliases.unionByName(adds).distinct()
                   .join(removes, [c for c in aliases.columns if c in removes.columns], "left_anti"))


def pending(everything: DataFrame, applied: DataFrame, key: str = "version") -> DataFrame:
    """Versions not applied yet."""
    return everything.join(applied.select(key), key, "left_anti")
