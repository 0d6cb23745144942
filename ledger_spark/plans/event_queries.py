"""Event-log analytics, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledger_spark.operators import events as E, normalize as N, mapping as MP
from ledger_spark.plans.registry import EVENTS_SQL, JUDGED_SQL, Tables, big, query, r4
from ledger_spark.session import scratch_path
from ledger_spark.sources import dimensions as D, sinks
from ledger_spark.streaming import jobs as J

HOUR = 3600
_STATS = ", ".join([big("count(*)", "events"), r4("sum(value)", "total"), r4("avg(value)", "average"),
                    r4("min(value)", "smallest"), r4("max(value)", "largest")])


@query("metric_summary", sql=f"WITH {EVENTS_SQL} SELECT name, {_STATS} FROM ev, mx WHERE ts >= t - INTERVAL 1440 MINUTE GROUP BY name")
def metric_summary(t: Tables):
    return E.metric_summary(t.events, E.latest(t("events"), back="1440 minutes"))


@query("metric_families", sql=f"WITH {EVENTS_SQL} SELECT name, {_STATS} FROM ev, mx WHERE ts >= t - INTERVAL 7 DAY "
       "AND (contains(name, 'error') OR contains(name, 'exception')) GROUP BY name")
def metric_families(t: Tables):
    rows = E.metric_family(t.events, ["error", "exception"])
    return E.metric_summary(rows, E.latest(t("events"), back="7 days"))


@query("perf_summary", sql=f"WITH {EVENTS_SQL} SELECT name, {big('count(*)', 'events')}, {r4('avg(value)', 'average')}, "
       f"{r4('min(value)', 'smallest')}, {r4('max(value)', 'largest')}, {r4('first(value ORDER BY ts DESC, event_id DESC)', 'latest')} "
       "FROM ev GROUP BY name")
def perf_summary(t: Tables):
    return E.perf_summary(t.events)


@query("perf_summary_recent", sql=f"WITH {EVENTS_SQL} SELECT name, {big('count(*)', 'events')}, {r4('avg(value)', 'average')}, "
       f"{r4('min(value)', 'smallest')}, {r4('max(value)', 'largest')}, {r4('first(value ORDER BY ts DESC, event_id DESC)', 'latest')} "
       "FROM ev, mx WHERE ts >= t - INTERVAL 60 MINUTE GROUP BY name")
def perf_summary_recent(t: Tables):
    return E.perf_summary(t.events, E.latest(t("events"), back="60 minutes"))


@query("tagged_counters", sql=f"WITH {EVENTS_SQL} SELECT {big('k % 4', 'path')}, {big('client % 3', 'method')}, {big('count(*)', 'requests')}, "
       f"""{big("count(*) FILTER (WHERE name = 'error')", 'errors')}, {r4("count(*) FILTER (WHERE name = 'error') / count(*)", 'error_ratio')}, """
       f"{r4('avg(value)', 'avg_ms')} FROM ev GROUP BY k % 4, client % 3")
def tagged_counters(t: Tables):
    rows = t.events.withColumns({"path": F.col("k") % 4, "method": F.col("client") % 3})
    return E.tagged_counts(rows, ["path", "method"])


@query("query_type_summary", sql=f"WITH {EVENTS_SQL} SELECT {big('k', 'query_type')}, {big('count(*)', 'events')}, {r4('avg(value)', 'avg_ms')}, "
       f"{r4('min(value)', 'min_ms')}, {r4('max(value)', 'max_ms')} FROM ev GROUP BY k")
def query_type_summary(t: Tables):
    return E.query_type_summary(t.events.withColumnRenamed("k", "query_type"), "query_type")


@query("query_type_recent", sql=f"WITH {EVENTS_SQL} SELECT {big('k', 'query_type')}, {big('count(*)', 'events')}, {r4('avg(value)', 'avg_ms')}, "
       f"{r4('min(value)', 'min_ms')}, {r4('max(value)', 'max_ms')} FROM ev, mx WHERE ts >= t - INTERVAL 1440 MINUTE GROUP BY k")
def query_type_recent(t: Tables):
    return E.query_type_summary(t.events.withColumnRenamed("k", "query_type"), "query_type", E.latest(t("events"), back="1440 minutes"))


@query("slow_operations", sql=f"WITH {EVENTS_SQL} SELECT event_id, name, {r4('value', 'value')}, "
       f"{r4('''CASE name WHEN 'view' THEN 100 WHEN 'click' THEN 200 ELSE 150 END''', 'threshold')} FROM ev "
       "WHERE (name = 'view' AND value > 100) OR (name = 'click' AND value > 200) OR (name = 'purchase' AND value > 150)")
def slow_operations(t: Tables):
    limits = {"view": 100.0, "click": 200.0, "purchase": 150.0}
    return E.slow_ops(t.events, "name", limits).select("event_id", "name", "value", "threshold")


@query("top_slow_operations", sql=f"SELECT event_id, {r4('value', 'value')} FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_slow_operations(t: Tables):
    return E.top_slow(t("events"), 25).select("event_id", "value")


@query("last_n_per_key", sql=f"WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS recency FROM ev) "
       f"SELECT name, event_id, {big('recency', 'recency')} FROM r WHERE recency <= 100")
def last_n_per_key(t: Tables):
    return E.last_n(t.events, "name", 100).select("name", "event_id", "recency")


@query("timed_calls", sql=f"WITH {EVENTS_SQL} SELECT 'f' || (k % 6) AS function, name <> 'error' AS success, {big('count(*)', 'calls')}, "
       f"{r4('sum(value)', 'total_ms')}, {r4('avg(value)', 'avg_ms')} FROM ev GROUP BY ALL")
def timed_calls(t: Tables):
    rows = t.events.withColumn("fn", F.concat(F.lit("f"), (F.col("k") % 6).cast("string")))
    return E.timed_calls(rows, "fn", F.col("name") != "error")


# -- errors ----------------------------------------------------------------------

@query("error_fingerprint", sql=f"WITH {EVENTS_SQL} SELECT event_id, error_id FROM err")
def error_fingerprint(t: Tables):
    return t.errors.select("event_id", "error_id")


@query("error_summary", sql=f"WITH {EVENTS_SQL} SELECT error_type, {big('count(*)', 'total_errors')}, {big('count(DISTINCT error_id)', 'unique_errors')} "
       "FROM err, mx WHERE ts >= t - INTERVAL 72 HOUR GROUP BY error_type")
def error_summary(t: Tables):
    return E.error_summary(t.errors, E.latest(t("events"), back="72 hours"))


@query("top_errors", sql=f"WITH {EVENTS_SQL} SELECT error_id, {big('count(*)', 'occurrences')} FROM err GROUP BY error_id "
       "ORDER BY count(*) DESC, error_id LIMIT 10")
def top_errors(t: Tables):
    return E.top_errors(t.errors)


@query("top_errors_recent", sql=f"WITH {EVENTS_SQL} SELECT error_id, {big('count(*)', 'occurrences')} FROM err, mx "
       "WHERE ts >= t - INTERVAL 24 HOUR GROUP BY error_id ORDER BY count(*) DESC, error_id LIMIT 10")
def top_errors_recent(t: Tables):
    return E.top_errors(t.errors, since=E.latest(t("events"), back="24 hours"))


@query("error_details", sql=f"WITH {EVENTS_SQL} SELECT error_id, error_type, {big('count(*)', 'occurrences')}, min(ts) AS first_seen, "
       "max(ts) AS last_seen FROM err GROUP BY error_id, error_type")
def error_details(t: Tables):
    return E.error_details(t.errors)


@query("related_errors", sql=f"""WITH {EVENTS_SQL}, seen AS (SELECT error_type, error_id, min(ts) AS f FROM err GROUP BY ALL),
p AS (SELECT a.error_type, a.error_id, b.error_id AS related_id,
  row_number() OVER (PARTITION BY a.error_type, a.error_id ORDER BY b.f, b.error_id) AS position
  FROM seen a JOIN seen b ON a.error_type = b.error_type AND a.error_id <> b.error_id)
SELECT error_type, error_id, {big('position', 'position')}, related_id FROM p WHERE position <= 5""")
def related_errors(t: Tables):
    return E.related_errors(t.errors)


_REPEATED = ("rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY error_id ORDER BY ts, event_id) AS occurrence FROM err) "
             "WHERE occurrence >= 5)")
_RATE = ("rate AS (SELECT * FROM (SELECT *, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS error_count FROM err) "
         "WHERE error_count >= 5)")


@query("alerts_repeated", sql=f"WITH {EVENTS_SQL}, {_REPEATED} SELECT event_id, error_id, {big('occurrence', 'occurrence')} FROM rep")
def alerts_repeated(t: Tables):
    return E.alerts_repeated(t.errors, 5).select("event_id", "error_id", "occurrence")


@query("alerts_critical", sql=f"WITH {EVENTS_SQL} SELECT event_id, error_id, {r4('value', 'value')} FROM err WHERE severity = 'CRITICAL'")
def alerts_critical(t: Tables):
    return E.alerts_critical(t.errors).select("event_id", "error_id", "value")


@query("alerts_error_rate", sql=f"WITH {EVENTS_SQL}, {_RATE} SELECT event_id, ts, {big('error_count', 'error_count')} FROM rate")
def alerts_error_rate(t: Tables):
    return E.alerts_rate(t.errors, 5, HOUR).select("event_id", "ts", "error_count")


@query("recent_alerts", sql=f"""WITH {EVENTS_SQL}, {_REPEATED}, {_RATE},
al AS (SELECT 'REPEATED_ERROR' AS alert_type, event_id, ts, error_id, 'Error ' || error_id || ' occurred ' || occurrence || ' times' AS message FROM rep
  UNION ALL SELECT 'CRITICAL_ERROR', event_id, ts, error_id, 'Critical error occurred: ' || message FROM err WHERE severity = 'CRITICAL'
  UNION ALL SELECT 'HIGH_ERROR_RATE', event_id, ts, error_id, 'High error rate: ' || error_count || ' errors in 3600 s' FROM rate)
SELECT al.* FROM al, mx WHERE ts >= t - INTERVAL 168 HOUR""")
def recent_alerts(t: Tables):
    since = E.latest(t("events"), back="168 hours")
    return E.recent_alerts(E.alerts_since(t.errors, since, 5, 5, HOUR), since)


@query("resolved_errors", sql=f"""WITH {EVENTS_SQL}, fixed AS (SELECT DISTINCT error_id FROM err WHERE value > 300)
SELECT event_id, error_id, error_id IN (SELECT error_id FROM fixed) AS resolved FROM err""")
def resolved_errors(t: Tables):
    """Fingerprints that once took longer than 300 ms count as fixed."""
    errors = t.errors
    return E.resolve(errors, errors.where(F.col("value") > 300)).select("event_id", "error_id", "resolved")


@query("error_retention", sql=f"""WITH {EVENTS_SQL} SELECT error_id, max(ts) AS last_seen, {big('count(*)', 'occurrences')},
  max(ts) < (SELECT t - INTERVAL 10 DAY FROM mx) AS dropped FROM err GROUP BY error_id""")
def error_retention(t: Tables):
    return E.retention(t.errors, E.latest(t("events"), back="10 days"))


@query("errors_retained", sql=f"""WITH {EVENTS_SQL} SELECT event_id, error_id FROM err WHERE error_id NOT IN (
  SELECT error_id FROM err GROUP BY error_id HAVING max(ts) < (SELECT t - INTERVAL 1 DAY FROM mx))""")
def errors_retained(t: Tables):
    """The errors of fingerprints seen on the last day; the others go with all their events."""
    return E.retain(t.errors, E.latest(t("events"), back="1 day")).select("event_id", "error_id")


@query("sliding_request_count", sql=f"""WITH {EVENTS_SQL} SELECT event_id, client, {big('count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)', 'requests')} FROM ev""")
def sliding_request_count(t: Tables):
    rows = t.events.select("event_id", "client", "ts")
    return E.trailing_count(rows, ["client"], 86400, "requests").drop("ts")


# A fold over each client's ordered times: the accumulator is the list of allowed times.
_LIMIT_SQL = f"""WITH {EVENTS_SQL},
c AS (SELECT client, list([epoch_us(ts)] ORDER BY ts, event_id) AS l FROM ev GROUP BY client),
a AS (SELECT client, list_reduce(l, lambda acc, x:
  CASE WHEN len(list_filter(acc, lambda y: x[1] - y < 86400000000)) < 3 THEN list_concat(acc, x) ELSE acc END, CAST([] AS BIGINT[])) AS allowed FROM c)
SELECT ev.event_id, ev.client, ev.ts, list_contains(a.allowed, epoch_us(ev.ts)) AS allowed FROM ev JOIN a USING (client)"""


@query("rate_limit_decisions", sql=_LIMIT_SQL)
def rate_limit_decisions(t: Tables):
    return E.rate_limit(t.events, limit=3, seconds=86400)


@query("health_status", sql=f"""WITH {EVENTS_SQL}, s AS (SELECT {big('client % 10', 'host')}, first(least(value / 4, 100.0) ORDER BY ts DESC, event_id DESC) AS c,
  first(CAST(k AS DOUBLE) ORDER BY ts DESC, event_id DESC) AS m FROM ev GROUP BY client % 10)
SELECT host, {r4('c', 'cpu_percent')}, {r4('m', 'memory_percent')}, CASE WHEN greatest(c, m) > 95 THEN 'unhealthy'
  WHEN greatest(c, m) > 90 THEN 'degraded' ELSE 'healthy' END AS status FROM s""")
def health_status(t: Tables):
    return E.health_status(t.samples)


@query("resource_warnings", sql=f"""WITH {EVENTS_SQL} SELECT {big('client % 10', 'host')}, {big('count(*) FILTER (WHERE k > 80)', 'high_memory')},
  {big('count(*) FILTER (WHERE least(value / 4, 100.0) > 80)', 'high_cpu')} FROM ev GROUP BY client % 10""")
def resource_warnings(t: Tables):
    return E.resource_warnings(t.samples)


# -- streams -----------------------------------------------------------------------

def _event_stream(t: Tables) -> DataFrame:
    """The events as a stream; a folder with one file here, a growing one in use."""
    raw = J.event_stream(t.spark, f"{t.sf_dir}/events*.parquet", t("events").schema)
    return raw.select("event_id", "ts", F.col("event_type").alias("name"), "value", F.col("user_id").alias("client"),
                      F.get_json_object("props", "$.k").cast("int").alias("k"), "props")


def _collected(t: Tables, df: DataFrame, name: str) -> DataFrame:
    path, checkpoint = scratch_path(t.spark, name), scratch_path(t.spark, f"{name}-state")
    J.run_to_table(df, path, checkpoint).awaitTermination()
    return t.spark.read.schema(df.schema).parquet(path)


@query("window_metric_summary", sql=f"""WITH {EVENTS_SQL}
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, name, {_STATS} FROM ev GROUP BY ALL""")
def window_metric_summary(t: Tables):
    """The batch form of the stream below, from the same expression."""
    return J.metric_windows(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")


@query("stream_metric_summary", sql=f"""WITH {EVENTS_SQL}
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, name, {_STATS}
FROM ev, mx WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= t - INTERVAL 10 MINUTE GROUP BY ALL""")
def stream_metric_summary(t: Tables):
    """Windows that closed behind the watermark."""
    return _collected(t, J.stream_metric_windows(_event_stream(t), "1 hour", None, "10 minutes"), "windows")


def _error_stream(t: Tables) -> DataFrame:
    tag = lambda prefix, n: F.concat(F.lit(prefix), (F.col("k") % n).cast("string"))
    return E.with_fingerprint(_event_stream(t).where(F.col("name") == "error").select(
        "event_id", "ts", "value", tag("E", 10).alias("error_type"), tag("mod", 4).alias("module"),
        tag("fn", 3).alias("function"), F.col("props").alias("message"),
        F.when(F.col("value") > 200, "CRITICAL").otherwise("ERROR").alias("severity")))


@query("stream_alerts", sql=f"""WITH {EVENTS_SQL}, rep AS (SELECT error_id, max(ts) AS ts, count(*) AS n FROM err GROUP BY error_id HAVING count(*) >= 20)
SELECT 'REPEATED_ERROR' AS alert_type, ts, error_id, {big('n', 'count')} FROM rep
UNION ALL SELECT 'CRITICAL_ERROR', ts, error_id, 1 FROM err WHERE severity = 'CRITICAL'
UNION ALL SELECT 'HIGH_ERROR_RATE', w, NULL, n FROM (SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS w, count(*) AS n FROM err GROUP BY ALL HAVING count(*) >= 5), (SELECT max(ts) AS t FROM err) m
  WHERE w <= t - INTERVAL 10 MINUTE""")
def stream_alerts(t: Tables):
    """The three alert streams, each with its own sink, read back as one table."""
    parts = [_collected(t, df, name) for name, df in (
        ("repeated", J.stream_repeated_alerts(_error_stream(t), 20, "30 days", "10 minutes")),
        ("critical", J.stream_critical_alerts(_error_stream(t))),
        ("rate", J.stream_rate_alerts(_error_stream(t), "1 hour", 5, "10 minutes")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_alert_rows", sql=f"""WITH {EVENTS_SQL}, {_REPEATED}, {_RATE}
SELECT 'REPEATED_ERROR' AS alert_type, event_id, ts, error_id FROM rep
UNION ALL SELECT 'CRITICAL_ERROR', event_id, ts, error_id FROM err WHERE severity = 'CRITICAL'
UNION ALL SELECT 'HIGH_ERROR_RATE', event_id, ts, NULL FROM rate""")
def stream_alert_rows(t: Tables):
    """The alerts of `alerts_repeated`, `alerts_critical` and `alerts_error_rate` from streams, a row for each event that alerts."""
    parts = [_collected(t, df, name) for name, df in (
        ("repeated-rows", J.stream_repeated_crossings(_error_stream(t), 5)),
        ("critical-rows", J.stream_critical_rows(_error_stream(t))),
        ("rate-rows", J.stream_rate_crossings(_error_stream(t), 5, HOUR)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_rate_limit", sql=_LIMIT_SQL)
def stream_rate_limit(t: Tables):
    return _collected(t, J.stream_rate_limit(_event_stream(t), 3, 86400), "limits")


@query("stream_ingest", sql=f"""WITH {JUDGED_SQL},
firsts AS (SELECT *, row_number() OVER (PARTITION BY company_id, canon, item, vt, source_file ORDER BY row_id) AS rn FROM facts)
SELECT row_id, company_id, canon AS period_label, item AS line_item, vt AS value_type, source_file, {r4('amount', 'value')}
FROM firsts WHERE rn = 1""")
def stream_ingest(t: Tables):
    """Raw rows dropped as CSV twice, the second time after the first is in the sink: it adds nothing."""
    folder, sink, state = (scratch_path(t.spark, n) for n in ("drops", "facts", "ingest-state"))
    raw = t.raw_rows
    aliases, items = D.period_aliases(t.order_calendar), D.line_items(t.spark)

    def to_facts(batch: DataFrame) -> DataFrame:
        judged = N.judge(MP.map_rows(batch), items, aliases)
        return N.accepted(judged, ["row_id"]).select(F.col("row_id").cast("long").alias("row_id"), *sinks.FACT_KEY, "value", "period_type")

    schema = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns]).schema
    for _ in range(2):
        raw.write.mode("append").option("header", True).csv(folder)
        J.stream_ingest(t.spark, folder, schema, sink, state, to_facts, order=["row_id"]).awaitTermination()
    return t.spark.read.parquet(sink).select("row_id", *sinks.FACT_KEY, "value")
