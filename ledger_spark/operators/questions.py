"""From observations to ranked, rendered questions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledger_spark import settings
from ledger_spark.functions import values as V
from ledger_spark.sources import dimensions as D

RANK_TIES = ["template_id", "metric_name", "period_type", "period_label"]


def match_templates(obs: DataFrame, tpl: DataFrame | None = None) -> DataFrame:
    """Each observation with each of its templates.  The template table is sixteen local rows."""
    tpl = tpl if tpl is not None else D.templates(obs.sparkSession)
    return obs.join(tpl.drop("template_text"), "observation_id")


def _money(x: str) -> str:
    return f"concat('$', format_number(coalesce(cast({x} as double), 0D), 2))"


def _short(x: str, places: int) -> str:
    text = f"cast(cast(coalesce({x}, 0D) as decimal(30,{places})) as string)"
    return f"regexp_replace({text}, '([.][0-9]+?)0+$', '$1')" if places > 1 else text


def _text_values() -> dict[str, str]:
    """What a template placeholder stands for, as SQL text over an observation row."""
    gap = "(current_value - coalesce(reference_value, 0D))"
    return {
        "metric_name": "metric_name",
        "pct": _short("try_divide(current_value - reference_value, reference_value) * 100", 2),
        "cur": _money("current_value"), "ref": _money("reference_value"),
        "gap": _money(gap), "abs_gap": _money(f"abs{gap}"),
        "abs_gap_1": _short("abs(current_value - reference_value)", 1),
        "calc_1": _short("calculated_value", 1), "calc_2": _short("calculated_value", 2),
        "calc100_1": _short("calculated_value * 100", 1), "calc_money": _money("calculated_value"),
        "trend_periods": f"'{settings.TREND_PERIODS}'",
    }


_TESTS = {"up": "coalesce(current_value > reference_value, false)", "pos": "calculated_value > 0"}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def compile_template(text: str) -> str:
    """A template as one SQL concat; `{up:a|b}` and `{pos:a|b}` choose a word."""
    values = _text_values()
    parts = []
    for literal, name, choice, _ in string.Formatter().parse(text):
        if literal:
            parts.append(_quoted(literal))
        if name in _TESTS:
            yes, no = choice.split("|")
            parts.append(f"case when {_TESTS[name]} then {_quoted(yes)} else {_quoted(no)} end")
        elif name:
            parts.append(values[name])
    return f"concat({', '.join(parts)})"


def render(df: DataFrame, templates: list[tuple] = settings.TEMPLATES) -> DataFrame:
    """Add `question_text`: each template is compiled once and selected by its id."""
    branches = " ".join(f"when {number} then {compile_template(body)}" for number, *_, body in templates)
    return df.withColumn("question_text", F.expr(f"case template_id {branches} end"))


def top_questions(matched: DataFrame, k: int = settings.MAX_QUESTIONS) -> DataFrame:
    """The k best per company, with their rank.

    Spark limits each task to k rows per company before the shuffle, so a company that owns much of
    the data sends k rows per task and no more.
    """
    size = F.abs(F.coalesce("calculated_value", F.lit(0.0)))
    best = W.partitionBy("company_id").orderBy(F.desc("importance"), F.desc("weight"), F.desc(size), *RANK_TIES)
    return matched.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def question_summary(questions: DataFrame) -> DataFrame:
    """Totals overall, by category and by importance in one pass: (dimension, member, questions)."""
    cube = questions.groupingSets([[], [F.col("category")], [F.col("importance")]],
                                  F.col("category"), F.col("importance")) \
        .agg(F.grouping("category").alias("no_category"), F.grouping("importance").alias("no_importance"),
             F.count(F.lit(1)).alias("questions"))
    return cube.select(
        F.when(F.col("no_category") == 0, "category").when(F.col("no_importance") == 0, "importance")
         .otherwise("total").alias("dimension"),
        F.when(F.col("no_category") == 0, F.col("category"))
         .when(F.col("no_importance") == 0, F.col("importance").cast("string")).otherwise("all").alias("member"),
        "questions")


def question_rows(rendered: DataFrame) -> DataFrame:
    """Rows of the question table with the observation as JSON."""
    context = F.to_json(F.struct(
        "template_id", "observation_id", "importance", "weight",
        F.struct("metric_name", "period_label", "current_value", "reference_value", "calculated_value")
         .alias("context")))
    return rendered.select("company_id", "question_text", "category",
                           V.priority_code(F.col("priority")).alias("priority"), context.alias("metric_context"))


def template_stats(tpl: DataFrame) -> DataFrame:
    """One row: count, categories, priorities, importance range, linked observations."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return tpl.agg(F.count(F.lit(1)).alias("total_templates"), joined("category").alias("categories"),
                   joined("priority").alias("priorities"), F.min("importance").alias("importance_min"),
                   F.max("importance").alias("importance_max"),
                   joined("observation_id").alias("linked_observations"))


def template_validation(tpl: DataFrame, obs: DataFrame) -> DataFrame:
    """(template_id, severity, rule) for every rule a template breaks."""
    known = obs.select(F.col("observation_id").alias("_known")).distinct()
    required = ["template_id", "observation_id", "template_text", "category", "priority", "importance"]
    number = F.col("template_id")
    problems = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""),
                       F.struct(F.lit("error").alias("severity"), F.lit(f"missing {c}").alias("rule")))
                for c in required]
    problems += [
        F.when(F.col("observation_id").isNotNull() & F.col("_known").isNull(),
               F.struct(F.lit("warning").alias("severity"), F.lit("unknown observation").alias("rule"))),
        F.when(~number.between(30001, 39999),
               F.struct(F.lit("warning").alias("severity"), F.lit("id out of range").alias("rule"))),
    ]
    return (tpl.join(known, F.col("observation_id") == F.col("_known"), "left")
               .select("template_id", F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("p"))
               .select("template_id", "p.severity", "p.rule"))


def live_questions(new: DataFrame, existing: DataFrame, as_of: Column) -> DataFrame:
    """New (company, text) pairs that are not live yet, once each, with their status at `as_of`."""
    key = ["company_id", "question_text"]
    fresh = new.groupBy(*key).agg(F.max("expires_at").alias("expires_at"))
    return (fresh.join(existing.select(*key), key, "left_anti")
                 .withColumn("status", F.when(F.col("expires_at") < as_of, "expired").otherwise("live")))


def unlisted_questions(rows: DataFrame, live: Column, as_of: Column) -> DataFrame:
    """`live_questions` where one frame holds the new rows and, marked by `live`, the listed ones: one aggregation, no join."""
    return (rows.groupBy("company_id", "question_text")
                .agg(F.max("expires_at").alias("expires_at"), F.coalesce(F.bool_or(live), F.lit(False)).alias("_live"))
                .where(~F.col("_live")).drop("_live")
                .withColumn("status", F.when(F.col("expires_at") < as_of, "expired").otherwise("live")))


def placeholders(tpl: DataFrame, column: str = "question_text") -> DataFrame:
    """Add `variables`: the placeholder names of a template in order of appearance."""
    return tpl.withColumn("variables", F.regexp_extract_all(F.col(column), F.lit(r"\{(\w+)\}"), F.lit(1)))


def fill_placeholders(text: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return text
