"""Registry of queries and the views they start from.

A query is a function of `Tables`; next to it stands the same meaning in DuckDB SQL, written on its own.
`finish` gives every result plain types, so that both sides can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledger_spark.functions import periods as P
from ledger_spark.operators import events as E, mapping as MP, metrics as M, normalize as N, questions as Q
from ledger_spark.sources import dimensions as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FACT_VALUE = "decimal(28,2)"
ALL_FACTS = M.Needs(value_types=frozenset({"Actual", "Budget", "Forecast"}))
MONTHLY_FACTS = M.Needs(kinds=frozenset({"Monthly"}), value_types=ALL_FACTS.value_types)


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with its SQL where SQL can express it."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: finish(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def finish(df: DataFrame) -> DataFrame:
    """Decimals and doubles to doubles of four places, dates to text, arrays to comma-joined text.

    Rounding goes by way of eight places, so that the last bit of a sum does not decide an exact half.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = F.round(F.round(c.cast("double"), 8), 4) + F.lit(0.0)
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def r4(expression: str, alias: str) -> str:
    """SQL side of `finish` for numbers."""
    return f"round(round(CAST({expression} AS DOUBLE), 8), 4) + 0.0 AS {alias}"


def big(expression: str, alias: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {alias}"


class Tables:
    """The given tables of one scale folder and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    # -- facts -----------------------------------------------------------

    def ship_months(self, needs: M.Needs) -> DataFrame:
        """One aggregation of the needed lines to (company, month, value type) with the three measures.

        Return flag and ship date are tested as they are stored, so both tests reach the Parquet scan.
        Amounts are whole cents and whole percents, so a line's measures are integers in units of 0.0001.
        They are summed in two parts, millions and rest, which keeps every sum exact in a long for up to
        9e12 lines a group; decimals appear only on the few group rows.  Supplier is joined by whatever way
        fits its size, and the sums combine before the shuffle.
        """
        lines = self("lineitem")
        flags = {"Actual": "l_returnflag = 'A'", "Budget": "l_returnflag = 'N'",
                 "Forecast": "l_returnflag is null or l_returnflag not in ('A', 'N')"}
        if needs.value_types < set(flags):
            lines = lines.where(" or ".join(f"({test})" for kind, test in flags.items() if kind in needs.value_types))
        if needs.months is not None:
            lines = lines.where(F.col("l_shipdate") >= self.month_before(needs.months))
        lines = lines.join(self("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).selectExpr(
            "s_nationkey as company_id", "trunc(cast(l_shipdate as date), 'month') as month",
            "case l_returnflag when 'A' then 'Actual' when 'N' then 'Budget' else 'Forecast' end as value_type",
            "cast(rint(l_extendedprice * 100) as long) as cents",
            "cast(rint(l_discount * 100) as long) as disc", "cast(rint(l_tax * 100) as long) as tax")
        units = {"revenue": "cents * 100", "gross": "cents * (100 - disc)", "ebitda": "cents * (100 - disc - tax)"}
        parts = [F.expr(f"sum(({x}) {op} 1000000)").alias(f"{name}_{half}") for name, x in units.items()
                 for half, op in (("high", "div"), ("low", "%"))]
        whole = [f"cast(cast({n}_high as decimal(20,0)) * 100 + cast({n}_low as decimal(20,0)) * 0.0001 "
                 f"as decimal(30,4)) as {n}" for n in units]
        return lines.groupBy("company_id", "month", "value_type").agg(*parts) \
                    .selectExpr("company_id", "month", "value_type", *whole)

    def fm_for(self, needs: M.Needs) -> DataFrame:
        """The facts that rules need; quarters and years are sums of the month sums."""
        months = self.ship_months(needs)
        units = {"Monthly": "month", "Quarterly": "quarter", "Yearly": "year"}
        kinds = [k for k in units if needs.kinds is None or k in needs.kinds]
        if kinds == ["Monthly"]:
            rolled = months.selectExpr("company_id", "'Monthly' as period_type", "month as start_date", "value_type",
                                       "revenue", "gross", "ebitda")
        else:
            spans = ", ".join(f"named_struct('period_type', '{k}', 'start_date', trunc(month, '{units[k]}'))" for k in kinds)
            rolled = (months.selectExpr("*", f"inline(array({spans}))")
                            .groupBy("company_id", "period_type", "start_date", "value_type")
                            .agg(*[F.sum(c).alias(c) for c in ("revenue", "gross", "ebitda")]))
        measures = ", ".join(f"named_struct('line_item', '{item}', 'value', cast({c} as {FACT_VALUE}))" for item, c in (
            ("Revenue", "revenue"), ("Gross Profit", "gross"), ("EBITDA", "ebitda"))
            if needs.items is None or item in needs.items)
        kind, first = F.col("period_type"), F.col("start_date")
        return (rolled.selectExpr("*", f"inline(array({measures}))")
                      .select("company_id", "line_item", kind, P.period_label(first, kind).alias("period_label"),
                              first, P.period_seq(first, kind).alias("period_seq"), "value_type", "value"))

    @property
    def fm(self) -> DataFrame:
        """Monthly, quarterly and yearly facts of all value types."""
        return self.fm_for(ALL_FACTS)

    @property
    def fm_monthly(self) -> DataFrame:
        return self.fm_for(MONTHLY_FACTS)

    def observe(self, names: list[str] | None = None) -> DataFrame:
        """The named observations over no more facts than they read."""
        needs = M.needs(names)
        return M.observe(self.fm_for(needs), self.now_for(needs), names)

    def now_for(self, needs: M.Needs) -> Column:
        """The latest ship month, counted from the bound of `fm_for` where there is one.

        Two different subqueries over one table would be merged into one with two fields, and a field of a
        subquery is not handed to the scan; the same subquery twice is run once and is.
        """
        if needs.months is None:
            return self.as_of
        return F.add_months(self.month_before(needs.months).cast("date"), needs.months)

    def month_before(self, months: int) -> Column:
        """The first day of the month so many months before the latest, as a scalar subquery that the scan can be filtered with."""
        newest = F.trunc(F.max("l_shipdate").cast("date"), "month")
        kind = self("lineitem").schema["l_shipdate"].dataType
        return self("lineitem").agg(F.add_months(newest, -months).cast(kind).alias("bound")).scalar()

    @property
    def as_of(self) -> Column:
        """The latest ship month, from a one-column scan."""
        return self("lineitem").agg(F.trunc(F.max("l_shipdate").cast("date"), "month").alias("as_of")).scalar()

    @property
    def ship_calendar(self) -> DataFrame:
        return D.calendar(self("lineitem").agg(F.min("l_shipdate").alias("start"), F.max("l_shipdate").alias("end")))

    @property
    def order_calendar(self) -> DataFrame:
        return D.calendar(self("orders").agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end")))

    # -- observations and questions ---------------------------------------

    @property
    def material(self) -> DataFrame:
        return M.materiality_filter(M.all_observations(self.fm, self.as_of))

    @property
    def questions(self) -> DataFrame:
        return Q.match_templates(self.material)

    # -- dirty rows --------------------------------------------------------

    @property
    def raw_rows(self) -> DataFrame:
        rows = self("orders").selectExpr(
            "*", "CAST(o_totalprice AS DECIMAL(15,2)) AS v", "CAST(year(o_orderdate) AS STRING) AS yyyy",
            "lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm", "CAST(quarter(o_orderdate) AS STRING) AS qq",
            "substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate) - 2, 3) AS mon3")
        return rows.selectExpr(
            "o_orderkey AS row_id", "concat('file_', o_orderkey % 7, '.csv') AS source_file",
            "CAST(o_custkey % 25 AS STRING) AS company_id",
            "element_at(array('sales', ' Total Revenue ', 'gross_profit', 'ebitda', 'Widget Fees', NULL), "
            "CAST(o_orderkey % 6 + 1 AS INT)) AS line_item",
            "element_at(array(concat(mon3, ' ', yyyy), concat(yyyy, '-', mm), concat('Q', qq, ' ', yyyy), yyyy, "
            "concat('  ', mon3, '-', yyyy, ' '), concat('FY', substr(yyyy, 3, 2)), concat(yyyy, '-Q', qq), "
            "'n/a period'), CAST(o_orderkey % 8 + 1 AS INT)) AS period_label",
            "element_at(array(CAST(v AS STRING), concat('$', v), concat('(', v, ')'), concat('-', v), 'N/A'), "
            "CAST(o_orderkey % 5 + 1 AS INT)) AS value",
            "CASE o_orderstatus WHEN 'F' THEN 'Actual' WHEN 'O' THEN 'Budget' END AS value_type",
            "element_at(array('Sheet1', 'Page 12', '7', 'none'), CAST(o_orderkey % 4 + 1 AS INT)) AS source_page")

    @property
    def headers(self) -> DataFrame:
        """One observed header per order: spellings of known fields, of rule families, and unknown ones."""
        known = ", ".join(f"'{h}'" for h in HEADER_SPELLINGS)
        return self("orders").selectExpr(
            f"CASE WHEN o_orderkey % 5 = 4 THEN o_orderpriority ELSE "
            f"element_at(array({known}), CAST(o_orderkey % {len(HEADER_SPELLINGS)} + 1 AS INT)) END AS header")

    @property
    def judged(self) -> DataFrame:
        aliases = D.period_aliases(self.order_calendar)
        return N.judge(MP.map_rows(self.raw_rows), D.line_items(self.spark), aliases)

    @property
    def facts(self) -> DataFrame:
        return N.accepted(self.judged, ["row_id"])

    # -- events ------------------------------------------------------------

    @property
    def events(self) -> DataFrame:
        return self("events").select(
            "event_id", "ts", F.col("event_type").alias("name"), "value", F.col("user_id").alias("client"),
            F.get_json_object("props", "$.k").cast("int").alias("k"), "props")

    @property
    def errors(self) -> DataFrame:
        rows = self.events.where(F.col("name") == "error")
        tag = lambda prefix, n: F.concat(F.lit(prefix), (F.col("k") % n).cast("string"))
        return E.with_fingerprint(rows.select(
            "event_id", "ts", "value", "client", tag("E", 10).alias("error_type"), tag("mod", 4).alias("module"),
            tag("fn", 3).alias("function"), F.col("props").alias("message"),
            F.when(F.col("value") > 200, "CRITICAL").otherwise("ERROR").alias("severity")))

    @property
    def samples(self) -> DataFrame:
        return self.events.select("event_id", "ts", (F.col("client") % 10).alias("host"),
                                  F.least(F.col("value") / 4, F.lit(100.0)).alias("cpu_percent"),
                                  F.col("k").cast("double").alias("memory_percent"))


HEADER_SPELLINGS = ["Company_ID", "amount", " Period ", "Metric Name", "FREQ", "ccy", "page_number", "Remark",
                    "Entity ID", "Jan 1999", "YTD_2000", "Q3 1998", "Quarterly", "amounts", "scenario type",
                    "Curr_Code", "tab id", "Comments", "stmt_type", "Class", "acct", "desc", "customer_id",
                    "Value Date"]


# -- the same views in DuckDB SQL ------------------------------------------------

FM_SQL = """
base AS (
  SELECT s.s_nationkey AS company_id, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS mon,
         CASE l.l_returnflag WHEN 'A' THEN 'Actual' WHEN 'N' THEN 'Budget' ELSE 'Forecast' END AS value_type,
         CAST(l.l_extendedprice AS DECIMAL(15,2)) AS px, CAST(l.l_discount AS DECIMAL(4,2)) AS disc,
         CAST(l.l_tax AS DECIMAL(4,2)) AS tax
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey),
measured AS (
  SELECT company_id, mon, value_type, 'Revenue' AS line_item, CAST(px AS DECIMAL(18,4)) AS x FROM base
  UNION ALL SELECT company_id, mon, value_type, 'Gross Profit', CAST(px*(1-disc) AS DECIMAL(18,4)) FROM base
  UNION ALL SELECT company_id, mon, value_type, 'EBITDA', CAST(px*(1-disc-tax) AS DECIMAL(18,4)) FROM base),
fm AS (
  SELECT company_id, line_item, 'Monthly' AS period_type, strftime(mon, '%Y-%m') AS period_label, mon AS start_date,
         year(mon)*12 + month(mon) AS period_seq, value_type, CAST(SUM(x) AS DECIMAL(28,2)) AS value
  FROM measured GROUP BY ALL
  UNION ALL
  SELECT company_id, line_item, 'Quarterly', year(mon) || '-Q' || quarter(mon), CAST(date_trunc('quarter', mon) AS DATE),
         year(mon)*4 + quarter(mon), value_type, CAST(SUM(x) AS DECIMAL(28,2))
  FROM measured GROUP BY ALL
  UNION ALL
  SELECT company_id, line_item, 'Yearly', CAST(year(mon) AS VARCHAR), CAST(date_trunc('year', mon) AS DATE), year(mon),
         value_type, CAST(SUM(x) AS DECIMAL(28,2))
  FROM measured GROUP BY ALL),
act AS (SELECT *, CAST(value AS DOUBLE) AS v FROM fm WHERE value_type = 'Actual'),
nowd AS (SELECT CAST(date_trunc('month', max(l_shipdate)) AS DATE) AS d FROM lineitem)
"""

RAW_SQL = """
raw_rows AS (
SELECT o_orderkey AS row_id, 'file_' || (o_orderkey % 7) || '.csv' AS source_file,
  CAST(o_custkey % 25 AS VARCHAR) AS company_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'sales' WHEN 1 THEN ' Total Revenue ' WHEN 2 THEN 'gross_profit'
    WHEN 3 THEN 'ebitda' WHEN 4 THEN 'Widget Fees' ELSE NULL END AS line_item,
  CASE o_orderkey % 8 WHEN 0 THEN mon3 || ' ' || yyyy WHEN 1 THEN yyyy || '-' || mm
    WHEN 2 THEN 'Q' || qq || ' ' || yyyy WHEN 3 THEN yyyy WHEN 4 THEN '  ' || mon3 || '-' || yyyy || ' '
    WHEN 5 THEN 'FY' || substr(yyyy,3,2) WHEN 6 THEN yyyy || '-Q' || qq ELSE 'n/a period' END AS period_label,
  CASE o_orderkey % 5 WHEN 0 THEN CAST(v AS VARCHAR) WHEN 1 THEN '$' || v WHEN 2 THEN '(' || v || ')'
    WHEN 3 THEN '-' || v ELSE 'N/A' END AS value,
  CASE o_orderstatus WHEN 'F' THEN 'Actual' WHEN 'O' THEN 'Budget' ELSE NULL END AS value_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'Sheet1' WHEN 1 THEN 'Page 12' WHEN 2 THEN '7' ELSE 'none' END AS source_page,
  o_orderdate
FROM (SELECT *, CAST(o_totalprice AS DECIMAL(15,2)) AS v, CAST(year(o_orderdate) AS VARCHAR) AS yyyy,
        strftime(o_orderdate, '%m') AS mm, CAST(quarter(o_orderdate) AS VARCHAR) AS qq,
        strftime(o_orderdate, '%b') AS mon3 FROM orders) t)
"""

# The raw rows resolved by what each was made from, not by parsing: an independent answer.
JUDGED_SQL = RAW_SQL + """,
known AS (
SELECT row_id, company_id, source_file, source_page, value AS raw_value,
  CASE row_id % 6 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'Revenue' WHEN 2 THEN 'Gross Profit' WHEN 3 THEN 'EBITDA'
    WHEN 4 THEN 'Widget Fees' END AS item,
  CASE row_id % 6 WHEN 0 THEN 11001 WHEN 1 THEN 11001 WHEN 2 THEN 11002 WHEN 3 THEN 11003 END AS item_id,
  CASE WHEN row_id % 8 IN (0, 1, 4) THEN strftime(o_orderdate, '%Y-%m')
       WHEN row_id % 8 IN (2, 6) THEN year(o_orderdate) || '-Q' || quarter(o_orderdate)
       WHEN row_id % 8 IN (3, 5) THEN CAST(year(o_orderdate) AS VARCHAR) END AS canon,
  CASE WHEN row_id % 8 IN (0, 1, 4) THEN 'Monthly' WHEN row_id % 8 IN (2, 6) THEN 'Quarterly'
       WHEN row_id % 8 IN (3, 5) THEN 'Yearly' END AS kind,
  CASE WHEN row_id % 8 IN (0, 1, 4) THEN CAST(date_trunc('month', o_orderdate) AS DATE)
       WHEN row_id % 8 IN (2, 6) THEN CAST(date_trunc('quarter', o_orderdate) AS DATE)
       WHEN row_id % 8 IN (3, 5) THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS start_date,
  TRY_CAST(regexp_replace(regexp_replace(value, '^\\((.*)\\)$', '-\\1'), '[$]', '', 'g') AS DECIMAL(15,2)) AS amount,
  coalesce(value_type, 'Actual') AS vt
FROM raw_rows),
judged AS (
SELECT *, CASE WHEN item IS NULL THEN 'incomplete' WHEN canon IS NULL THEN 'period'
               WHEN item_id IS NULL THEN 'line_item' WHEN amount IS NULL THEN 'value' END AS reason
FROM known),
facts AS (SELECT *, CASE source_page WHEN 'Sheet1' THEN 1 WHEN 'Page 12' THEN 12 WHEN '7' THEN 7 END AS page,
  md5(concat_ws('_', company_id, canon, item, coalesce(vt, '<null>'), coalesce(source_file, '<null>'))) AS hash FROM judged WHERE reason IS NULL)
"""

HEADERS_SQL = f"""
headers AS (SELECT CASE WHEN o_orderkey % 5 = 4 THEN o_orderpriority
  ELSE list_extract({HEADER_SPELLINGS!r}, CAST(o_orderkey % {len(HEADER_SPELLINGS)} + 1 AS BIGINT)) END AS header
  FROM orders)
"""

EVENTS_SQL = """
ev AS (SELECT event_id, ts, event_type AS name, value, user_id AS client, props,
              CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
err0 AS (SELECT event_id, ts, value, client, 'E' || (k % 10) AS error_type, 'mod' || (k % 4) AS module,
              'fn' || (k % 3) AS function, props AS message,
              CASE WHEN value > 200 THEN 'CRITICAL' ELSE 'ERROR' END AS severity FROM ev WHERE name = 'error'),
err AS (SELECT *, substr(md5(concat_ws(':', error_type, module, function, substr(message, 1, 100))), 1, 12) AS error_id
        FROM err0),
mx AS (SELECT max(ts) AS t FROM events)
"""
