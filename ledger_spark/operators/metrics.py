"""Derived metrics and observations.

All thirteen observations are read off one wide *series frame*: one row per cell
(company, line item, period) holding actual, budget and forecast, its neighbours in calendar time
and the statistics of its series.  Building it takes one map-side-combined aggregation to cells and
two window shuffles over cells, however many observations are asked for; Catalyst drops the window
columns that the chosen observations do not use.

The fact view must hold one value per cell and value type: where several files do, `normalize.latest_cell`
decides first.  A window group is one series (company, line item, period type) or one (company, period), so it is
bounded by the calendar or by the few ratio items, not by the number of input rows.

Each rule declares the facts it reads (`Needs`).  Their union filters the facts before the first shuffle, so one
observation alone reads its own period types, value types, line items and months only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledger_spark import settings
from ledger_spark.functions import periods as P, values as V

SERIES = ["company_id", "line_item", "period_type"]
CELL = [*SERIES, "period_label", "start_date", "period_seq"]
OBS = ["observation_id", "observation_name", "company_id", "metric_name", "period_type", "period_label",
       "current_value", "reference_value", "calculated_value"]


@dataclass(frozen=True)
class Ratios:
    """The line items of the two ratio observations: what is divided, and by what."""

    base: str = "Revenue"
    efficiency: tuple[str, ...] = ("Gross Profit",)
    margins: tuple[str, ...] = ("Gross Profit", "EBITDA")


# -- what a rule reads ---------------------------------------------------------

@dataclass(frozen=True)
class Needs:
    """Facts that rules read: period types and line items (None: all), value types, and months back from now (None: all)."""

    kinds: frozenset[str] | None = None
    value_types: frozenset[str] = frozenset({"Actual"})
    items: frozenset[str] | None = None
    months: int | None = None

    def __or__(self, other: Needs) -> Needs:
        """What serves both."""
        either = lambda a, b: None if a is None or b is None else a | b
        months = None if self.months is None or other.months is None else max(self.months, other.months)
        return Needs(either(self.kinds, other.kinds), self.value_types | other.value_types,
                     either(self.items, other.items), months)

    def of(self, fm: DataFrame, as_of: Column) -> DataFrame:
        """The needed rows of a fact view.  The conditions name its plain columns, so they reach the scan of a fact table."""
        kept = fm.where(F.col("value_type").isin(*sorted(self.value_types)))
        for column, allowed in (("period_type", self.kinds), ("line_item", self.items)):
            if allowed is not None:
                kept = kept.where(F.col(column).isin(*sorted(allowed)))
        return kept if self.months is None else kept.where(F.col("start_date") >= F.add_months(as_of, -self.months))


def needs(names: list[str] | None = None, ratios: Ratios = Ratios()) -> Needs:
    """What the named observations (all by default) read together."""
    monthly = frozenset({"Monthly"})
    own = {
        "growth_mom": Needs(monthly), "growth_qoq": Needs(frozenset({"Quarterly"})), "growth_yoy": Needs(),
        "variance_vs_budget": Needs(value_types=frozenset({"Actual", "Budget"})),
        "variance_vs_forecast": Needs(value_types=frozenset({"Actual", "Forecast"})),
        "trend_direction": Needs(monthly), "volatility_measure": Needs(monthly, months=12),
        "seasonal_variance": Needs(monthly, months=36), "absolute_change": Needs(),
        "magnitude_check": Needs(monthly, months=24),
        "efficiency_ratio": Needs(items=frozenset({ratios.base, *ratios.efficiency})),
        "margin_analysis": Needs(items=frozenset({ratios.base, *ratios.margins})),
        "ytd_performance": Needs(monthly),
    }
    first, *rest = [own[n] for n in names or own]
    for one in rest:
        first = first | one
    return first


# -- cells and the series frame ----------------------------------------------

def cells(fm: DataFrame) -> DataFrame:
    """One row per cell with the value types side by side; replaces the self-joins of Actual with Budget."""
    pick = lambda vt: F.max(F.when(F.col("value_type") == vt, F.col("value"))).alias(vt.lower())
    return fm.groupBy(*CELL).agg(pick("Actual"), pick("Budget"), pick("Forecast"))


def ytd_total(fm: DataFrame) -> DataFrame:
    """Sum of the monthly Actuals by year, with the first fact of the year as base metric."""
    monthly = fm.where((F.col("period_type") == "Monthly") & (F.col("value_type") == "Actual"))
    return (monthly.groupBy("company_id", "line_item", F.year("start_date").alias("year"))
                   .agg(F.sum("value").alias("ytd_value"),
                        F.min_by(V.row_hash(F.col("company_id"), F.col("period_label"), F.col("line_item"),
                                            F.col("value_type"), F.lit("")), "start_date").alias("base_metric_id"),
                        F.count(F.lit(1)).alias("months")))


def ytd_running(fm: DataFrame) -> DataFrame:
    """The monthly Actuals with their running total inside the year."""
    so_far = (W.partitionBy("company_id", "line_item", F.year("start_date")).orderBy("start_date")
               .rowsBetween(W.unboundedPreceding, 0))
    return (fm.where((F.col("period_type") == "Monthly") & (F.col("value_type") == "Actual"))
              .withColumn("ytd_value", F.sum("value").over(so_far)))


def _quoted(texts) -> str:
    """Texts as a list of SQL literals."""
    return ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in texts)


def series_frame(fm: DataFrame, as_of: Column, ratios: Ratios = Ratios()) -> DataFrame:
    """The wide frame; `as_of` is the month that counts as now (a date literal or a scalar subquery)."""
    series = "partition by company_id, line_item, period_type"
    in_period = "partition by company_id, period_type, start_date"
    back = lambda c, n: (f"max({c}) over ({series} order by period_seq "
                         f"range between {n} preceding and {n} preceding)")
    over = lambda what: f"{what} over ({series})"
    since = lambda months: f"start_date >= add_months(now, -{months})"
    value = "cast(actual as double)"
    year, two_years, three_years = (f"case when {since(m)} then {value} end" for m in (12, 24, 36))
    positive = f"case when {since(12)} and actual > 0 then {value} end"
    # The last few points of a series, numbered upwards in time: -age rises by one per point.
    recent = f"case when age <= {settings.TREND_PERIODS} then {value} end"
    step = f"case when age <= {settings.TREND_PERIODS} then cast(-age as double) end"
    same_month = f"over ({series}, month(start_date))"
    based = cells(fm).withColumn("now", as_of).selectExpr(
        "*", f"cast(max(case when line_item = {_quoted([ratios.base])} then actual end) over ({in_period}) as double) as base")
    with_ratio = based.selectExpr("*", f"case when base > 0 then {value} / base end as ratio")
    placed = with_ratio.selectExpr(
        "*", f"{back('actual', 1)} as prev",
        f"case period_type when 'Monthly' then {back('actual', 12)} when 'Quarterly' then {back('actual', 4)} "
        f"else {back('actual', 1)} end as year_ago",
        f"{back('ratio', 1)} as prev_ratio",
        f"case when actual is not null then row_number() over ({series} order by actual is null, period_seq desc) "
        "end as age",
        over(f"count({positive})") + " as n_pos", over(f"avg({positive})") + " as mean_pos",
        over(f"stddev_samp({positive})") + " as std_pos",
        over(f"count({two_years})") + " as n_24", over(f"avg({two_years})") + " as mean_24",
        over(f"stddev_samp({two_years})") + " as std_24",
        f"count({three_years}) {same_month} as n_season", f"avg({three_years}) {same_month} as mean_season",
        f"case when actual is not null then row_number() over ({series}, year(start_date) "
        "order by actual is null, start_date) end as nth_of_year",
        f"sum(actual) over ({series}, year(start_date)) as year_total",
        f"sum(actual) over ({series} order by year(start_date) range between 1 preceding and 1 preceding) "
        "as last_year_total")
    return placed.selectExpr(
        "*", over(f"count({recent})") + " as n_recent", over(f"regr_slope({recent}, {step})") + " as slope",
        over(f"avg({recent})") + " as mean_recent")


# -- observations ------------------------------------------------------------

def _change(current: str, previous: str) -> str:
    cur, prev = f"cast({current} as double)", f"cast({previous} as double)"
    return f"try_divide({cur} - {prev}, {prev}) * 100"


def _rules(ratios: Ratios) -> dict[str, tuple[str, str, str, str]]:
    """name -> (row condition, current value, reference value, calculated value) over the series frame, as SQL."""
    monthly = "period_type = 'Monthly'"
    since = lambda months: f"start_date >= add_months(now, -{months})"
    season = "case when n_season >= 2 then mean_season end"
    spread = "case when n_24 >= 12 and std_24 > 0 then std_24 end"
    return {
        "growth_mom": (monthly, "actual", "prev", _change("actual", "prev")),
        "growth_qoq": ("period_type = 'Quarterly'", "actual", "prev", _change("actual", "prev")),
        "growth_yoy": ("true", "actual", "year_ago", _change("actual", "year_ago")),
        "variance_vs_budget": ("true", "actual", "budget", _change("actual", "budget")),
        "variance_vs_forecast": ("true", "actual", "forecast", _change("actual", "forecast")),
        "trend_direction": (f"{monthly} and age = 1 and n_recent >= 3", "slope", "mean_recent",
                            "try_divide(slope, mean_recent)"),
        "volatility_measure": (f"{monthly} and age = 1 and n_pos >= 6", "std_pos", "mean_pos",
                               "try_divide(std_pos, mean_pos)"),
        "seasonal_variance": (f"{monthly} and {since(3)}", "actual", season, _change("actual", season)),
        "absolute_change": ("true", "actual", "prev", "abs(cast(actual as double) - cast(prev as double))"),
        "magnitude_check": (f"{monthly} and {since(1)}", "actual", "mean_24",
                            f"try_divide(cast(actual as double) - mean_24, {spread})"),
        "efficiency_ratio": (f"line_item in ({_quoted(ratios.efficiency)})", "ratio", "prev_ratio", "ratio"),
        "margin_analysis": (f"line_item in ({_quoted(ratios.margins)})", "ratio * 100", "prev_ratio * 100", "ratio * 100"),
        # Said once per year, on the year's first month.
        "ytd_performance": (f"{monthly} and nth_of_year = 1", "year_total", "last_year_total",
                            _change("year_total", "last_year_total")),
    }


def _emit(name: str, rule: tuple[str, str, str, str]) -> str:
    """The observation struct of a rule on its rows, null elsewhere."""
    condition, current, reference, calculated = rule
    number = settings.OBSERVATION_BY_NAME[name][0]
    kind, label = ("'Yearly'", "concat('YTD ', year(start_date))") if name == "ytd_performance" \
        else ("period_type", "period_label")
    return (f"case when {condition} and ({calculated}) is not null then named_struct('observation_id', {number}, "
            f"'observation_name', '{name}', 'period_type', {kind}, 'period_label', {label}, 'current_value', cast({current} as double), "
            f"'reference_value', cast({reference} as double), 'calculated_value', {calculated}) end")


def observe(fm: DataFrame, as_of: Column, names: list[str] | None = None, ratios: Ratios = Ratios()) -> DataFrame:
    """Rows of the named observations (all thirteen by default), before any materiality filter."""
    rules = _rules(ratios)
    structs = ", ".join(_emit(n, rules[n]) for n in names or rules)
    return (series_frame(needs(names, ratios).of(fm, as_of), as_of, ratios)
            .selectExpr("company_id", "line_item as metric_name",
                        f"inline(filter(array({structs}), o -> o is not null))")
            .select(*OBS))


def ytd_growth(fm: DataFrame) -> DataFrame:
    """Year-to-date total against the year before, labelled 'YTD yyyy'."""
    return observe(fm, F.lit(None).cast("date"), ["ytd_performance"])


def all_observations(fm: DataFrame, as_of: Column) -> DataFrame:
    """All thirteen observations from one pass over the facts."""
    return observe(fm, as_of)


# -- materiality and weights -------------------------------------------------

def _names(unit: str) -> str:
    return ", ".join(f"'{o[1]}'" for o in settings.OBSERVATIONS if o[2] == unit)


def threshold(override: float | None = None) -> Column:
    """The limit of an observation row in its own unit.

    Percentages: metric override, else the observation's own, else the default, times 100; an explicit
    `override` (already in %) replaces all of these.  Rows in other units use their own parameter only.
    """
    by_metric = " ".join(f"when '{m}' then {v}D" for m, v in settings.METRIC_MATERIALITY.items())
    own = " ".join(f"when '{o[1]}' then {o[3]}D" for o in settings.OBSERVATIONS if o[3] is not None)
    default = settings.DEFAULT_MATERIALITY
    own_or_default = f"case observation_name {own} else {default}D end"
    pct = f"{override}D" if override is not None else \
        f"100 * coalesce(case metric_name {by_metric} end, {own_or_default})"
    return F.expr(f"case when observation_name in ({_names('pct')}) then {pct} else {own_or_default} end")


def materiality_filter(obs: DataFrame, override: float | None = None) -> DataFrame:
    """Material rows only, with the `threshold` they passed."""
    size = f"case when observation_name in ({_names('ratio')}) then abs(calculated_value - 1) " \
           "else abs(calculated_value) end"
    return obs.withColumn("threshold", threshold(override)).where(f"{size} >= threshold")


def derived_rows(obs: DataFrame) -> DataFrame:
    """Observation rows in the shape of the derived-metric table."""
    calc = F.expr("case observation_name " + " ".join(
        f"when '{o[1]}' then '{o[6]}'" for o in settings.OBSERVATIONS) + " end")
    base = V.row_hash(F.col("company_id"), F.col("period_label"), F.col("metric_name"), F.lit("Actual"), F.lit(""))
    pct = F.expr(f"observation_name in ({_names('pct')})")
    return obs.select(
        "company_id", "period_label", "metric_name", calc.alias("calculation_type"),
        base.alias("base_metric_id"), F.col("calculated_value").cast("decimal(28,4)").alias("calculated_value"),
        F.when(pct, "%").otherwise("value").alias("unit"), F.array(base).alias("source_ids"),
        F.concat_ws(" ", calc, F.lit("for"), F.col("period_label")).alias("calculation_note"),
        F.lit("Ok").alias("corroboration_status"), F.col("period_type").alias("frequency"))


def weighted(obs: DataFrame) -> DataFrame:
    """Observations with importance, family weight and their product."""
    pick = lambda i, kind: F.expr("case observation_name " + " ".join(
        f"when '{o[1]}' then cast({o[i]} as {kind})" for o in settings.OBSERVATIONS) + " end")
    return obs.withColumns({"importance": pick(4, "int"), "family_weight": pick(7, "double")}) \
              .withColumn("score", F.col("importance") * F.col("family_weight"))


# -- series statistics as their own reports ----------------------------------

def trend_stats(fm: DataFrame, as_of: Column) -> DataFrame:
    """Mean, sample deviation and count of the Actuals of twelve months, where there are three or more."""
    value = F.col("value").cast("double")
    return (fm.where((F.col("value_type") == "Actual") & (F.col("period_type") == "Monthly")
                     & (F.col("start_date") >= F.add_months(as_of, -12)))
              .groupBy("company_id", F.col("line_item").alias("metric_name"))
              .agg(F.avg(value).alias("avg_value"), F.stddev_samp(value).alias("volatility"),
                   F.count(F.lit(1)).alias("period_count"))
              .where(F.col("period_count") >= 3))


def trend_slope(fm: DataFrame, n: int = settings.TREND_PERIODS, sensitivity: float = 0.02) -> DataFrame:
    """Regression slope of the last n monthly Actuals, scaled by their mean, with a direction."""
    value = F.col("value").cast("double")
    newest = W.partitionBy("company_id", "line_item").orderBy(F.desc("period_seq"))
    last = (fm.where((F.col("value_type") == "Actual") & (F.col("period_type") == "Monthly"))
              .withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n))
    stats = (last.groupBy("company_id", F.col("line_item").alias("metric_name"))
                 .agg(F.regr_slope(value, (-F.col("age")).cast("double")).alias("slope"),
                      F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("periods")))
    relative = F.try_divide("slope", "mean_value")
    return stats.withColumn("relative_slope", relative).withColumn(
        "direction", F.when(relative >= sensitivity, "up").when(relative <= -sensitivity, "down").otherwise("flat"))


def outliers(fm: DataFrame, k: float = settings.OUTLIER_FACTOR) -> DataFrame:
    """Values more than k sample deviations from the mean of their series and value type."""
    series = W.partitionBy(*SERIES, "value_type")
    value = F.col("value").cast("double")
    return (fm.withColumns({"mean_value": F.avg(value).over(series), "std_value": F.stddev_samp(value).over(series)})
              .withColumn("is_outlier", F.abs(value - F.col("mean_value")) > F.lit(k) * F.col("std_value")))
