"""Event-log analytics.

Input rows have at least `event_id`, `ts`, `name`, `value`; error rows add `error_type`, `module`,
`function`, `message`, `severity`.  Aggregates combine before the shuffle, so a hot name or client costs no
more than its groups.  Ordered counts never put a whole key into one window: see `running_count` and
`trailing_count`.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ledger_spark import settings
from ledger_spark.functions import values as V
from ledger_spark.session import local_frame


def latest(df: DataFrame, ts: str = "ts", back: str | None = None) -> Column:
    """max(ts), or a bound before it, as a scalar subquery that filters can be pushed with."""
    bound = F.max(ts)
    if back:
        bound = bound - F.expr(f"interval {back}")
    return df.agg(bound.alias("bound")).scalar()


def _stats(value: str = "value") -> list[Column]:
    return [F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"), F.avg(value).alias("average"),
            F.min(value).alias("smallest"), F.max(value).alias("largest")]


# -- summaries ---------------------------------------------------------------

def metric_summary(ev: DataFrame, since: Column, name: str | None = None) -> DataFrame:
    rows = ev.where(F.col("ts") >= since)
    if name:
        rows = rows.where(F.col("name") == name)
    return rows.groupBy("name").agg(*_stats())


def metric_family(df: DataFrame, patterns: list[str]) -> DataFrame:
    return df.where(V.rlike_any(F.col("name"), patterns))


def recency(df: DataFrame, ts: str = "ts", number: str = "event_id") -> Column:
    """An order by time, then number, in which rows without either come first: one decimal where the number is integral.

    A decimal is kept in place by hash aggregates, while a struct makes Spark sort all rows.  It holds times of the years
    1 to 9999 in microseconds above 2 * 10**19, which is beyond every long moved up to start at 1.  Rows equal in both
    count as one event.
    """
    if not isinstance(df.schema[number].dataType, T.IntegralType):
        return F.struct(ts, number)
    high = F.coalesce(_micros(df, ts), F.lit(-10**18)).cast("decimal(19,0)") * F.expr("20000000000000000000BD")
    return high + F.coalesce(F.col(number).cast("decimal(20,0)") + F.expr("9223372036854775809BD"), F.expr("0BD"))


def perf_summary(ev: DataFrame, since: Column | None = None) -> DataFrame:
    """Statistics and the latest value of each name, of all time or since a bound."""
    rows = ev if since is None else ev.where(F.col("ts") >= since)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("average"),
                                    F.min("value").alias("smallest"), F.max("value").alias("largest"),
                                    F.max_by("value", recency(ev)).alias("latest"))


def tagged_counts(ev: DataFrame, tags: list[str]) -> DataFrame:
    errors = F.count_if(F.col("name") == "error")
    return ev.groupBy(*tags).agg(F.count(F.lit(1)).alias("requests"), errors.alias("errors"),
                                 F.try_divide(errors, F.count(F.lit(1))).alias("error_ratio"),
                                 F.avg("value").alias("avg_ms"))


def query_type_summary(ev: DataFrame, kind: str, since: Column | None = None) -> DataFrame:
    rows = ev if since is None else ev.where(F.col("ts") >= since)
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("avg_ms"),
                                  F.min("value").alias("min_ms"), F.max("value").alias("max_ms"))


def timed_calls(ev: DataFrame, function: str, success: Column) -> DataFrame:
    return ev.groupBy(F.col(function).alias("function"), success.alias("success")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("value").alias("total_ms"), F.avg("value").alias("avg_ms"))


# -- slow operations and buffers ---------------------------------------------

def slow_ops(ev: DataFrame, kind: str, thresholds: dict[str, float] = settings.SLOW_MS) -> DataFrame:
    """Events above the threshold of their kind.  The thresholds are a local table of a few rows."""
    limits = local_frame(ev.sparkSession, [kind, "threshold"], list(thresholds.items()))
    return ev.join(limits, kind).where(F.col("value") > F.col("threshold"))


def top_slow(ev: DataFrame, n: int = 10) -> DataFrame:
    return ev.orderBy(F.desc("value"), "event_id").limit(n)


def last_n(ev: DataFrame, key: str, n: int = settings.METRIC_BUFFER, bucket_seconds: int = 3600) -> DataFrame:
    """The last n per key with their `recency`, for any n; rows without a time come last.

    Rows are counted per key and time bucket.  Buckets with n newer rows behind them are left out before any row is
    shuffled, and rows are ranked inside the others only, so no task holds more of a key than one bucket.
    """
    rows = ev.withColumns({"_key": F.struct(key), "_bucket": F.coalesce(
        F.floor(_micros(ev, "ts") / (bucket_seconds * 1_000_000)), F.lit(-(1 << 62)))})
    newer = W.partitionBy("_key").orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    needed = (rows.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
                  .select("_key", "_bucket", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_newer"))
                  .where(F.col("_newer") < n))
    inside = F.row_number().over(W.partitionBy("_key", "_bucket").orderBy(F.desc("ts"), F.desc("event_id")))
    return (rows.join(needed, ["_key", "_bucket"]).withColumn("recency", (F.col("_newer") + inside).cast("int"))
                .where(F.col("recency") <= n).select(*ev.columns, "recency"))


# -- errors ------------------------------------------------------------------

def with_fingerprint(errors: DataFrame) -> DataFrame:
    return errors.withColumn("error_id", V.error_fingerprint(*[F.col(c) for c in
                                                               ("error_type", "module", "function", "message")]))


def error_summary(errors: DataFrame, since: Column) -> DataFrame:
    """Totals by error type; distinct fingerprints are counted on (type, fingerprint) pairs already reduced."""
    pairs = errors.where(F.col("ts") >= since).groupBy("error_type", "error_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("error_type").agg(F.sum("n").alias("total_errors"),
                                           F.count(F.lit(1)).alias("unique_errors"))


def top_errors(errors: DataFrame, n: int = 10, since: Column | None = None) -> DataFrame:
    rows = errors if since is None else errors.where(F.col("ts") >= since)
    return (rows.groupBy("error_id").agg(F.count(F.lit(1)).alias("occurrences"))
                  .orderBy(F.desc("occurrences"), "error_id").limit(n))


def error_details(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_id", "error_type").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def related_errors(errors: DataFrame, k: int = 5) -> DataFrame:
    """Up to k other fingerprints of the same type, the earliest seen first.

    The k + 1 earliest of a type contain the answer for each of its members, so no two fingerprints are
    paired beyond those: a type with many fingerprints does not multiply.
    """
    seen = errors.groupBy("error_type", "error_id").agg(F.min("ts").alias("first_seen"))
    order = [F.col("first_seen"), F.col("error_id")]
    ranked = seen.withColumn("_r", F.row_number().over(W.partitionBy("error_type").orderBy(*order)))
    front = (ranked.where(F.col("_r") <= k + 1).groupBy("error_type")
                   .agg(F.array_sort(F.collect_list(F.struct("_r", "error_id"))).alias("_front")))
    others = F.filter("_front", lambda x: x["error_id"] != F.col("error_id"))
    return (seen.join(front, "error_type")
                .select("error_type", "error_id", F.posexplode(F.slice(others, 1, k)).alias("_pos", "_o"))
                .select("error_type", "error_id", (F.col("_pos") + 1).alias("position"),
                        F.col("_o.error_id").alias("related_id")))


def resolve(errors: DataFrame, fixed: DataFrame) -> DataFrame:
    """Add `resolved`: true for fingerprints in the list."""
    marks = fixed.select("error_id").distinct().withColumn("_fixed", F.lit(True))
    return errors.join(marks, "error_id", "left").withColumn("resolved", F.coalesce("_fixed", F.lit(False))) \
                 .drop("_fixed")


def retention(errors: DataFrame, cutoff: Column) -> DataFrame:
    """Fingerprints with their last occurrence and whether the cut-off removes them."""
    return (errors.groupBy("error_id").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"))
                  .withColumn("dropped", F.col("last_seen") < cutoff))


def retain(errors: DataFrame, cutoff: Column) -> DataFrame:
    """The events of the fingerprints that stay."""
    gone = retention(errors, cutoff).where("dropped").select("error_id")
    return errors.join(gone, "error_id", "left_anti")


# -- ordered counts ----------------------------------------------------------

def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds on the time line of the column: a zone-free timestamp is measured without any zone, so
    that daylight saving in the session's zone does not bend its windows."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.expr(f"cast(cast(cast({ts} - timestamp_ntz'1970-01-01 00:00:00' as interval second) "
                      "as decimal(18,6)) * 1000000 as long)")
    return F.unix_micros(ts)


def running_count(df: DataFrame, key: str, order: list[str], name: str, bucket_seconds: int = 60) -> DataFrame:
    """1, 2, 3, … per key in `order` (whose first column is the time), without one window per key.

    Counts inside (key, time bucket) plus the total of the key's earlier buckets, which is a window over one
    small row per bucket.  A key with a third of all rows is spread over its buckets.
    """
    # A struct of the key is never null itself, so null keys join too and all steps share one partitioning.
    rows = df.withColumns({"_key": F.struct(key),
                           "_bucket": F.floor(_micros(df, order[0]) / (bucket_seconds * 1_000_000))})
    earlier = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = (rows.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
                  .select("_key", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    inside = F.row_number().over(W.partitionBy("_key", "_bucket").orderBy(*order))
    return (rows.withColumn("_inside", inside).join(totals, ["_key", "_bucket"])
                .withColumn(name, F.col("_before") + F.col("_inside"))
                .drop("_key", "_bucket", "_before", "_inside"))


def trailing_count(df: DataFrame, keys: list[str], seconds: int, name: str, ts: str = "ts",
                   closed: bool = True, pieces: int = settings.WINDOW_PIECES) -> DataFrame:
    """How many rows of the same keys lie in the `seconds` up to each row, that row and its ties included.

    `closed` counts a row exactly `seconds` old; otherwise it has just left.

    Time is cut into buckets as long as the window, so a row leaves the window in the bucket after its own.
    Each row appears twice: where it enters, and one bucket later where it leaves.  At the start of a bucket
    the window holds what leaves inside it.  A bucket is cut into `pieces`: their net changes are added up over
    one small row per piece, and only inside a piece are rows sorted and counted one by one.  So the work is
    linear however dense the window is, and a hot key, or no key at all, is spread over its pieces.
    """
    window = seconds * 1_000_000
    at = _micros(df, ts)
    bucket = F.floor(at / window)
    # Entry and exit lie one window apart, so in pieces of the same number; rows without time share one.
    piece = F.coalesce(F.floor(F.pmod(at, F.lit(window)) * pieces / window), F.lit(0))
    enter, leave = (0, 1) if closed else (1, 0)

    def moves(*entering: Column) -> DataFrame:
        """Entries and exits; only entries carry the other columns."""
        sides = [(bucket, at, enter, list(entering)), (bucket + 1, at + window, leave, [F.lit(None).alias("_row")] * len(entering))]
        both = F.explode(F.array(*[F.struct(F.struct(*keys, b.alias("_bucket")).alias("_key"), piece.alias("_piece"),
                                            when.alias("_at"), F.lit(phase).alias("_phase"), *row)
                                   for b, when, phase, row in sides]))
        return df.select(both.alias("_move")).select("_move.*")

    exits = F.when(F.col("_phase") == leave, 1).otherwise(0)
    change = F.when(F.col("_phase") == leave, -1).otherwise(1)
    whole = W.partitionBy("_key")
    earlier = whole.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    before = (moves().groupBy("_key", "_piece").agg(F.sum(change).alias("_net"), F.sum(exits).alias("_out"))
                     .select("_key", "_piece", (F.sum("_out").over(whole) + F.coalesce(F.sum("_net").over(earlier), F.lit(0)))
                             .alias("_before")))
    so_far = W.partitionBy("_key", "_piece").orderBy("_at", "_phase").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = moves(F.struct(*df.columns).alias("_row")).withColumn("_inside", F.sum(change).over(so_far))
    return (rows.where(F.col("_phase") == enter).join(before, ["_key", "_piece"])
                .select("_row.*", (F.col("_before") + F.col("_inside")).alias(name)))


def alerts_repeated(errors: DataFrame, n: int = settings.REPEATED_ERROR_COUNT) -> DataFrame:
    counted = running_count(errors, "error_id", ["ts", "event_id"], "occurrence")
    return counted.where(F.col("occurrence") >= n)


def alerts_critical(errors: DataFrame) -> DataFrame:
    return errors.where(F.col("severity") == "CRITICAL")


def alerts_rate(errors: DataFrame, n: int = settings.ERRORS_PER_MINUTE, seconds: int = 60) -> DataFrame:
    return trailing_count(errors, [], seconds, "error_count").where(F.col("error_count") >= n)


def _alert_rows(repeated: DataFrame, critical: DataFrame, crowded: DataFrame, seconds: int) -> DataFrame:
    """The three kinds of alert as one table (alert_type, event_id, ts, error_id, message)."""
    def shape(df: DataFrame, kind: str, message: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("alert_type"), "event_id", "ts", "error_id", message.alias("message"))
    return (shape(repeated, "REPEATED_ERROR",
                  F.concat(F.lit("Error "), F.col("error_id"), F.lit(" occurred "),
                           F.col("occurrence").cast("string"), F.lit(" times")))
            .unionByName(shape(critical, "CRITICAL_ERROR",
                               F.concat(F.lit("Critical error occurred: "), F.col("message"))))
            .unionByName(shape(crowded, "HIGH_ERROR_RATE",
                               F.concat(F.lit("High error rate: "), F.col("error_count").cast("string"),
                                        F.lit(f" errors in {seconds} s")))))


def all_alerts(errors: DataFrame, repeated: int, rate: int, seconds: int) -> DataFrame:
    """All alerts of the whole log; see `alerts_since` for those of late."""
    return _alert_rows(alerts_repeated(errors, repeated), alerts_critical(errors), alerts_rate(errors, rate, seconds), seconds)


def alerts_since(errors: DataFrame, since: Column, repeated: int = settings.REPEATED_ERROR_COUNT,
                 rate: int = settings.ERRORS_PER_MINUTE, seconds: int = 60) -> DataFrame:
    """`all_alerts` of the errors from `since` on, without ordering the history before it.

    Older errors, and those without a time, only add to the counts of their fingerprints; the trailing count reads one
    window more.
    """
    recent = errors.where(F.col("ts") >= since)
    counted = running_count(recent, "error_id", ["ts", "event_id"], "occurrence")
    before = errors.where(F.col("ts").isNull() | (F.col("ts") < since)).groupBy(F.col("error_id").alias("_id")) \
                   .agg(F.count(F.lit(1)).alias("_before"))
    counted = counted.join(before, F.col("error_id").eqNullSafe(F.col("_id")), "left").withColumn(
        "occurrence", F.col("occurrence") + F.coalesce("_before", F.lit(0))).drop("_id", "_before")
    lately = errors.where(F.col("ts") >= since - F.expr(f"interval {seconds} seconds"))
    crowded = alerts_rate(lately, rate, seconds).where(F.col("ts") >= since)
    return _alert_rows(counted.where(F.col("occurrence") >= repeated), alerts_critical(recent), crowded, seconds)


def recent_alerts(alerts: DataFrame, since: Column) -> DataFrame:
    return alerts.where(F.col("ts") >= since).orderBy(F.desc("ts"), "alert_type", "event_id")


# -- rate limiting -----------------------------------------------------------

def decider(limit: int, window: int):
    """A function (times, held) -> decisions: allow while fewer than `limit` allowed times lie in the last
    `window`; denied ones do not count.  `held` is the deque of allowed times and is carried by the caller.

    It is built here as a closure, so that tasks get it by value and need not import this package.
    """
    def decide(times, held):
        out = []
        for t in times:
            while held and t - held[0] >= window:
                held.popleft()
            ok = len(held) < limit
            if ok:
                held.append(t)
            out.append(ok)
        return out
    return decide


def rate_limit(ev: DataFrame, limit: int, seconds: int, client: str = "client") -> DataFrame:
    """(event_id, client, ts, allowed) for every request; requests without a client share one limit.

    A decision depends on earlier decisions, so no window function gives it.  It does so only inside a *busy
    stretch*, though.  A request is free if no more than `limit` requests of its client, itself included, lie
    in its window: it is allowed whatever came before.  After a window of free requests the allowed set is
    exactly those requests.  So time is cut into buckets as long as the window:

    * a bucket without a non-free request is all allowed and never reaches Python;
    * neighbouring buckets with one form a stretch, which is decided on its own, after a warm-up over the
      quiet bucket before it.

    A stretch streams through in time order, with at most `limit` timestamps of state.
    """
    window = seconds * 1_000_000
    who = F.coalesce(F.col(client).cast("string"), F.lit("unknown"))
    base = ev.select("event_id", F.col(client).alias("client"), "ts", who.alias("_who"))
    rows = trailing_count(base, ["_who"], seconds, "_seen", closed=False).withColumns(
        {"_micros": _micros(base, "ts"), "_bucket": F.floor(_micros(base, "ts") / window)})

    busy = rows.where(F.col("_seen") > limit).select("_who", "_bucket").distinct()
    by_time = W.partitionBy("_who").orderBy("_bucket")
    starts = F.coalesce(F.col("_bucket") - F.lag("_bucket").over(by_time) > 1, F.lit(True))
    islands = (busy.withColumn("_start", starts)
                   .withColumn("_stretch", F.sum(F.col("_start").cast("long")).over(by_time)))
    members = islands.select("_who", "_stretch", F.explode(F.when(
        F.col("_start"), F.array(F.col("_bucket") - 1, F.col("_bucket"))).otherwise(F.array("_bucket")))
        .alias("_bucket"))
    placed = rows.join(members, ["_who", "_bucket"], "left")

    decide = decider(limit, window)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, deque()
        for pdf in batches:
            allowed = []
            for key, part in pdf.groupby(["_who", "_stretch"], sort=False):
                if key != current:
                    current, held = key, deque()
                allowed += decide(part["_micros"].tolist(), held)
            yield pdf[["event_id", "client", "ts"]].assign(allowed=allowed)

    chained = (placed.where(F.col("_stretch").isNotNull())
                     .select("event_id", "client", "ts", "_who", "_stretch", "_micros")
                     .repartition("_who", "_stretch")
                     .sortWithinPartitions("_who", "_stretch", "_micros", "event_id"))
    types = dict(chained.dtypes)
    decided = chained.mapInPandas(run, f"event_id {types['event_id']}, client {types['client']}, "
                                       f"ts {types['ts']}, allowed boolean")
    free = placed.where(F.col("_stretch").isNull()).select("event_id", "client", "ts", F.lit(True).alias("allowed"))
    return free.unionByName(decided)


# -- host samples ------------------------------------------------------------

def health_status(samples: DataFrame, host: str = "host") -> DataFrame:
    """The status of each host at its latest sample."""
    newest = samples.groupBy(host).agg(*[F.max_by(c, recency(samples)).alias(c) for c in ("cpu_percent", "memory_percent")])
    worst = F.greatest("cpu_percent", "memory_percent")
    return newest.select(host, "cpu_percent", "memory_percent",
                         F.when(worst > settings.HEALTH_UNHEALTHY_PCT, "unhealthy")
                          .when(worst > settings.HEALTH_DEGRADED_PCT, "degraded")
                          .otherwise("healthy").alias("status"))


def resource_warnings(samples: DataFrame, host: str = "host") -> DataFrame:
    limit = settings.RESOURCE_WARNING_PCT
    return samples.groupBy(host).agg(F.count_if(F.col("memory_percent") > limit).alias("high_memory"),
                                     F.count_if(F.col("cpu_percent") > limit).alias("high_cpu"))
