"""Streaming ingest, metric windows, alerts and rate limiting.

Watermarks need `timestamp`, so event streams cast their `timestamp_ntz` column on the way in.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledger_spark.operators import events as E
from ledger_spark.sources import sinks


def event_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts",
                 fmt: str = "parquet", **options) -> DataFrame:
    """A stream over a growing folder; `maxFilesPerTrigger` and friends go in `options`."""
    return (spark.readStream.format(fmt).schema(schema).options(**options).load(path)
                 .withColumn(ts, F.col(ts).cast("timestamp")))


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything available now, into Parquet.  The checkpoint makes a restart exact."""
    return (df.writeStream.format("parquet").outputMode(mode).option("path", path)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# -- ingest ------------------------------------------------------------------

def stream_ingest(spark: SparkSession, folder: str, schema: T.StructType, sink: str, checkpoint: str,
                  to_facts, key: list[str] = sinks.FACT_KEY, partition: str = "period_label",
                  order: list[str] | None = None, **options) -> StreamingQuery:
    """New CSV files -> facts appended where their key is absent.

    A batch that is replayed after a failure finds its own rows and adds none, so the sink stays exact.
    The sink has a folder per period, and a batch looks for its keys in the folders of its own periods only.
    Of a key that a batch holds more than once the first by `order` stays.  `maxFilesPerTrigger` and friends go in
    `options`.  A batch is kept (and spilled) by Spark while it is worked on, and released then.
    """
    drops = spark.readStream.schema(schema).options(header=True, **options).csv(folder)

    def append(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        facts = to_facts(batch).persist()  # read for its periods and again for its rows
        known = sinks.held_keys(session, sink, facts.schema, facts, key, partition) \
            if _has_files(session, sink) else facts.limit(0)
        try:
            sinks.write_fact(sinks.append_new(known, facts, key, order), sink, partition)
        finally:
            facts.unpersist()

    return (drops.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())


def _has_files(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop)


# -- metric windows ----------------------------------------------------------

def metric_windows(ev: DataFrame, window: str, slide: str | None = None) -> DataFrame:
    """Count, sum, mean, min, max by name and time window: the same expression for batch and stream."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (ev.groupBy(span.alias("w"), "name")
              .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"),
                   F.avg("value").alias("average"), F.min("value").alias("smallest"),
                   F.max("value").alias("largest"))
              .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "name",
                      "events", "total", "average", "smallest", "largest"))


def stream_metric_windows(ev: DataFrame, window: str, slide: str | None, lateness: str) -> DataFrame:
    return metric_windows(ev.withWatermark("ts", lateness), window, slide)


# -- alerts ------------------------------------------------------------------

def stream_rate_alerts(errors: DataFrame, window: str, at_least: int, lateness: str) -> DataFrame:
    """Windows with too many errors, once they close."""
    return (errors.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"))
                  .agg(F.count(F.lit(1)).alias("error_count")).where(F.col("error_count") >= at_least)
                  .select(F.lit("HIGH_ERROR_RATE").alias("alert_type"),
                          F.col("w.end").alias("ts"), F.lit(None).cast("string").alias("error_id"),
                          F.col("error_count").alias("count")))


def stream_critical_alerts(errors: DataFrame) -> DataFrame:
    return E.alerts_critical(errors).select(F.lit("CRITICAL_ERROR").alias("alert_type"), "ts", "error_id",
                                            F.lit(1).cast("long").alias("count"))


def stream_repeated_alerts(errors: DataFrame, at_least: int, keep: str, lateness: str) -> DataFrame:
    """One alert per fingerprint and batch once it has occurred `at_least` times.

    State is one counter per fingerprint; it expires when the fingerprint has been silent for `keep`.  The
    events of a fingerprint stream through in Arrow batches and are only counted, never held.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def count(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total = state.get[0] if state.exists else 0
        last = None
        for pdf in batches:
            total += len(pdf)
            newest = pdf["ts"].max()
            last = newest if last is None else max(last, newest)
        state.update((total,))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_ms)
        if total >= at_least:
            yield pd.DataFrame({"alert_type": ["REPEATED_ERROR"], "ts": [last], "error_id": [key[0]],
                                "count": [total]})

    return (errors.withWatermark("ts", lateness).select("error_id", "ts").groupBy("error_id")
                  .applyInPandasWithState(count, "alert_type string, ts timestamp, error_id string, count long",
                                          "total long", "append", GroupStateTimeout.EventTimeTimeout))


# Alerts that do not depend on how the log is cut into batches.  What alerts is a set of rows that late ones can only add to, or
# move by a place: the rows of a fingerprint but for its earliest, and the rows whose trailing window is full.  So each row is decided when
# enough others have come, in whatever order, and is reported once, with its event.

def _micro_times(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def _report(kind: str, rows: list[tuple[int, int]], error_id: str | None = None) -> pd.DataFrame:
    times = pd.Series([t for t, _ in rows], dtype="int64").astype("datetime64[us]")
    return pd.DataFrame({"alert_type": kind, "event_id": pd.Series([i for _, i in rows], dtype="int64"), "ts": times,
                         "error_id": pd.Series([error_id] * len(rows), dtype="object")})


ALERT = "alert_type string, event_id long, ts timestamp, error_id string"


def stream_repeated_crossings(errors: DataFrame, at_least: int) -> DataFrame:
    """An alert for every error whose fingerprint has `at_least - 1` earlier ones (by time, then event_id), as `alerts_repeated` has.

    State is those earliest few of each fingerprint.  A late error that belongs among them pushes out the latest,
    which then is one too many and alerts.  Errors without a time take no part.
    """
    hold = at_least - 1

    def judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for pdf in batches:
            rows = sorted(held + list(zip(_micro_times(pdf["ts"]), pdf["event_id"].tolist())))
            held = rows[:hold]
            if len(rows) > hold:
                yield _report("REPEATED_ERROR", rows[hold:], key[0])
        state.update(([t for t, _ in held], [i for _, i in held]))

    return errors.where("ts is not null").select("error_id", F.col("event_id").cast("long").alias("event_id"), "ts").groupBy("error_id").applyInPandasWithState(
        judge, ALERT, "times array<long>, events array<long>", "append", GroupStateTimeout.NoTimeout)


def thinned(times: list[int], window: int, enough: int) -> list[int]:
    """Sorted `times` without those that no count up to `enough` over a window needs: of each bucket as long as the
    window the first and the last `enough` stay.  A window over a time between them reaches over one end of the
    bucket, so it has all the first or all the last of them.
    """
    out: list[int] = []
    for _, of in groupby(times, key=lambda t: t // window):
        of = list(of)
        out += of if len(of) <= 2 * enough else of[:enough] + of[-enough:]
    return out


def stream_rate_crossings(errors: DataFrame, at_least: int, seconds: int, keep: str | None = None) -> DataFrame:
    """An alert for every error with `at_least` errors in the `seconds` up to it, itself included, as `alerts_rate` has.

    Time is cut into buckets as long as the window; an error goes to its own and, as one that counts there, to the
    next, so no task has the whole log.  State is the errors of a bucket that have not alerted yet and the times that counts up to `at_least` need:
    a few times `at_least` of each, however many errors there are.  With `keep` it goes when a bucket has had no error for that
    long by the clock, and an error that comes later still is decided by what came since; this is for queries that run on, as
    Spark never ends an `availableNow` run of one with timeouts.  Errors without a time never alert.
    """
    window = seconds * 1_000_000
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None

    def judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, open_t, open_id = map(list, state.get) if state.exists else ([], [], [])
        waiting = list(zip(open_t, open_id))
        for pdf in batches:
            at = _micro_times(pdf["ts"])
            times = sorted(times + at)
            waiting += [(t, i) for t, i, own in zip(at, pdf["event_id"].tolist(), pdf["own"].tolist()) if own]
            full = [bisect_right(times, t) - bisect_left(times, t - window) >= at_least for t, _ in waiting]
            if any(full):
                yield _report("HIGH_ERROR_RATE", [w for w, f in zip(waiting, full) if f])
            waiting = [w for w, f in zip(waiting, full) if not f]
            times = thinned(times, window, at_least)
        state.update((times, [t for t, _ in waiting], [i for _, i in waiting]))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)

    bucket = F.floor(F.unix_micros("ts") / window)
    sides = F.explode(F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own"))))
    rows = errors.where("ts is not null").select(F.col("event_id").cast("long").alias("event_id"), "ts", sides.alias("side"))
    return rows.select("event_id", "ts", "side.*").groupBy("bucket").applyInPandasWithState(
        judge, ALERT, "times array<long>, open_times array<long>, open_events array<long>", "append",
        GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout)


def stream_critical_rows(errors: DataFrame) -> DataFrame:
    """An alert for every critical error; no state."""
    return E.alerts_critical(errors).select(F.lit("CRITICAL_ERROR").alias("alert_type"), F.col("event_id").cast("long").alias("event_id"), "ts", "error_id")


# -- rate limit --------------------------------------------------------------

def stream_rate_limit(ev: DataFrame, limit: int, seconds: int, client: str = "client") -> DataFrame:
    """Allow or deny each request as it arrives; state is the last allowed times of a client, at most `limit`.

    A client's requests of one micro-batch are put in time order, so the batch size (`maxFilesPerTrigger`)
    bounds what a task holds.  There is no watermark: a request that comes late is decided too, against the times held
    then.  For that a client's few times stay in the state store for good.
    """
    decide = E.decider(limit, seconds * 1_000_000)

    def judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else [])
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        micros = pdf["ts"].astype("datetime64[us]").astype("int64").tolist()
        allowed = decide(micros, held)
        state.update((list(held),))
        yield pd.DataFrame({"event_id": pdf["event_id"], "client": key[0], "ts": pdf["ts"], "allowed": allowed})

    types = dict(ev.dtypes)
    return (ev.select(F.col(client).alias("client"), "event_id", "ts")
              .groupBy("client")
              .applyInPandasWithState(judge, f"event_id {types['event_id']}, client {types[client]}, "
                                             "ts timestamp, allowed boolean",
                                      "held array<long>", "append", GroupStateTimeout.NoTimeout))
