"""Ordered counts, alerts and rate limiting against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators import events as E
from ledger_spark.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), c) for i, (s, c) in enumerate(rows)],
                                 "event_id long, ts timestamp_ntz, client long")


@pytest.fixture(scope="module")
def busy(spark):
    """One client owns two thirds of the rows and is over its limit for most of the time."""
    rng = random.Random(7)
    rows, t = [], 0.0
    for _ in range(1500):
        t += rng.choice([0, 0, 0.5, 1, 3]) if rng.random() < 0.995 else rng.choice([59, 60, 61, 200])
        rows.append((t, 1 if rng.random() < 0.66 else rng.randrange(2, 6)))
    return rows


def brute_limit(rows, limit, window):
    held, out = {}, []
    for t, c in rows:
        mine = held[c] = [x for x in held.get(c, []) if t - x < window]
        out.append(len(mine) < limit)
        if out[-1]:
            mine.append(t)
    return out


@pytest.mark.parametrize("limit, window", [(1, 60), (5, 60), (20, 60), (40, 30)])
def test_rate_limit(spark, busy, limit, window):
    got = {r["event_id"]: r["allowed"] for r in E.rate_limit(log(spark, busy), limit, window).collect()}
    assert [got[i] for i in range(len(busy))] == brute_limit(busy, limit, window)


def test_requests_without_client_count_together(spark):
    rows = [(float(i), None if i % 2 else 7) for i in range(40)]
    got = {r["event_id"]: r["allowed"] for r in E.rate_limit(log(spark, rows), 3, 60).collect()}
    assert [got[i] for i in range(40)] == brute_limit(rows, 3, 60)
    run = E.running_count(log(spark, rows), "client", ["ts", "event_id"], "n").collect()
    assert max(r["n"] for r in run if r["client"] is None) == 20 and len(run) == 40


@pytest.mark.parametrize("closed", [True, False])
def test_trailing_count(spark, busy, closed):
    got = {r["event_id"]: r["n"] for r in E.trailing_count(log(spark, busy), ["client"], 60, "n", closed=closed).collect()}
    for i, (t, c) in enumerate(busy):
        want = sum(1 for u, d in busy if d == c and u <= t and (t - u <= 60 if closed else t - u < 60))
        assert got[i] == want


def test_trailing_count_ignores_the_session_zone(spark):
    """02:30 does not exist on this day in New York; the rows lie an hour apart all the same."""
    times = [dt.datetime(2024, 3, 10, h, 30) for h in (0, 1, 2, 3, 4)]
    df = spark.createDataFrame(list(enumerate(times)), "event_id long, ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r["event_id"]: r["n"] for r in E.trailing_count(df, [], 3600, "n").collect()}
        run = E.running_count(df.withColumn("k", F.lit(1)), "k", ["ts", "event_id"], "n")
        assert {r["event_id"]: r["n"] for r in run.collect()} == {i: i + 1 for i in range(5)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {0: 1, 1: 2, 2: 2, 3: 2, 4: 2}


def test_running_count(spark, busy):
    got = {r["event_id"]: r["n"] for r in E.running_count(log(spark, busy), "client", ["ts", "event_id"], "n").collect()}
    seen = {}
    for i, (_, c) in enumerate(busy):
        seen[c] = seen.get(c, 0) + 1
        assert got[i] == seen[c]


def test_related_errors(spark, rows):
    df = spark.createDataFrame([("T", f"e{i}", T0 + dt.timedelta(seconds=i)) for i in range(8)],
                               "error_type string, error_id string, ts timestamp_ntz")
    got = E.related_errors(df).where("error_id = 'e2'").orderBy("position").collect()
    assert [r["related_id"] for r in got] == ["e0", "e1", "e3", "e4", "e5"]
    assert E.related_errors(df).where("error_id = 'e7'").count() == 5


def test_retention(spark):
    df = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(days=9)), ("b", T0)], "error_id string, ts timestamp_ntz")
    cutoff = F.lit(T0 + dt.timedelta(days=5)).cast("timestamp_ntz")
    assert {r["error_id"]: r["dropped"] for r in E.retention(df, cutoff).collect()} == {"a": False, "b": True}
    assert E.retain(df, cutoff).count() == 2


@pytest.mark.parametrize("cpu, memory, status", [(10.0, 95.5, "unhealthy"), (91.0, 10.0, "degraded"), (90.0, 5.0, "healthy")])
def test_health(spark, cpu, memory, status):
    df = spark.createDataFrame([(1, T0, 9, 99.0, 99.0), (2, T0 + dt.timedelta(seconds=1), 9, cpu, memory)],
                               "event_id long, ts timestamp_ntz, host int, cpu_percent double, memory_percent double")
    assert E.health_status(df).first()["status"] == status


def test_streams_across_restarts(spark, busy, tmp_path):
    """Two drops with a restart between them give the decisions of one run, and windows equal the batch."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    all_rows = log(spark, busy).withColumns({"name": F.lit("x"), "value": F.lit(1.0)})
    for low, high in ((0, 700), (700, 1500)):
        part = all_rows.where((F.col("event_id") >= low) & (F.col("event_id") < high))
        part.coalesce(1).write.mode("append").parquet(src)
        stream = J.event_stream(spark, src, part.schema)
        J.run_to_table(J.stream_rate_limit(stream, 5, 60), out, state).awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(out).collect()}
    assert [got[i] for i in range(len(busy))] == brute_limit(busy, 5, 60)

    windows, wstate = str(tmp_path / "w"), str(tmp_path / "ws")
    stream = J.event_stream(spark, src, all_rows.schema)
    J.run_to_table(J.stream_metric_windows(stream, "1 minute", None, "0 seconds"), windows, wstate).awaitTermination()
    closed = spark.read.parquet(windows)
    batch = J.metric_windows(all_rows.withColumn("ts", F.col("ts").cast("timestamp")), "1 minute")
    assert closed.exceptAll(batch).count() == 0
    assert batch.count() - closed.count() <= 1


def test_alert_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("a" if i % 3 else "b", T0 + dt.timedelta(seconds=i), "ERROR") for i in range(12)]
    df = spark.createDataFrame(rows, "error_id string, ts timestamp_ntz, severity string")
    df.write.parquet(src)
    stream = J.event_stream(spark, src, df.schema)
    out = str(tmp_path / "out")
    J.run_to_table(J.stream_repeated_alerts(stream, 5, "1 day", "1 minute"), out, str(tmp_path / "st")).awaitTermination()
    assert [(r["error_id"], r["count"]) for r in spark.read.parquet(out).collect()] == [("a", 8)]


@pytest.mark.parametrize("n", [1, 7, 5000])
def test_last_n_of_any_size(spark, busy, n):
    got = {(r["client"], r["recency"]): r["event_id"] for r in E.last_n(log(spark, busy), "client", n, bucket_seconds=30).collect()}
    want = {}
    for c in {c for _, c in busy}:
        mine = sorted(((t, i) for i, (t, d) in enumerate(busy) if d == c), reverse=True)[:n]
        want |= {(c, k): i for k, (_, i) in enumerate(mine, 1)}
    assert got == want


def test_ordered_counts_put_no_key_into_one_window(spark, busy):
    df = log(spark, busy)
    for counted in (E.last_n(df, "client", 5000), E.trailing_count(df, ["client"], 60, "n"), E.trailing_count(df, [], 60, "n")):
        plan = counted._jdf.queryExecution().executedPlan().toString()
        ranks = [line for line in plan.splitlines() if "Window [" in line and ("event_id" in line or "_at" in line)]
        assert ranks and all("_bucket" in line or "_piece" in line for line in ranks)


def test_late_request_gets_a_decision(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ([(0, 100), (1, 101), (2, 4000)], [(3, 5000), (4, 0)]):
        df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), 1) for i, s in part], "event_id long, ts timestamp_ntz, client long")
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = J.event_stream(spark, folder, df.schema)
        J.run_to_table(J.stream_rate_limit(stream, 5, 60), out, state).awaitTermination()
    assert {r["event_id"] for r in spark.read.parquet(out).collect()} == {0, 1, 2, 3, 4}


@pytest.fixture(scope="module")
def storm(spark):
    """Errors with bursts, ties, gaps, repeated rows and missing times; a hot fingerprint has most of them."""
    rng = random.Random(4)
    at = sorted(rng.choice([rng.randrange(4000), 600 + rng.randrange(50), 1999 + rng.randrange(3)]) for _ in range(1200))
    rows = [(i, None if i % 97 == 0 else T0 + dt.timedelta(seconds=s, microseconds=rng.choice([0, 0, 1, 999_999])),
             rng.choice(["hot", "hot", "hot", "a", "b", None]), "ERROR") for i, s in enumerate(at)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, error_id string, severity string")


@pytest.mark.parametrize("files", [1, 3, 10])
def test_alert_rows_do_not_depend_on_cuts(spark, storm, tmp_path, files):
    """The same log in any number of files, in no order of time, gives the rows of the batch operators."""
    src = str(tmp_path / "src")
    for i in range(files):
        storm.where(F.pmod(F.hash("event_id"), F.lit(files)) == i).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: J.event_stream(spark, src, storm.schema, maxFilesPerTrigger=1)
    got = {}
    for name, df in (("repeated", J.stream_repeated_crossings(stream(), 5)), ("rate", J.stream_rate_crossings(stream(), 20, 60))):
        out = str(tmp_path / name)
        J.run_to_table(df, out, str(tmp_path / f"{name}-state")).awaitTermination()
        got[name] = sorted(r["event_id"] for r in spark.read.schema(df.schema).parquet(out).collect())
    assert got["repeated"] == sorted(r["event_id"] for r in E.alerts_repeated(storm.where("ts is not null"), 5).collect())
    assert got["rate"] == sorted(r["event_id"] for r in E.alerts_rate(storm.where("ts is not null"), 20, 60).collect())


def test_thinned_times_keep_every_count():
    rng = random.Random(8)
    for _ in range(300):
        window, enough = rng.choice([10, 60]), rng.randrange(1, 6)
        times, kept = [], []
        for _ in range(rng.randrange(1, 5)):
            new = [rng.randrange(3 * window) for _ in range(rng.randrange(60))]
            times, kept = sorted(times + new), J.thinned(sorted(kept + new), window, enough)
            assert len(kept) <= 6 * enough
            for t in range(-window, 4 * window):
                count = lambda of: sum(t - window <= x <= t for x in of)
                assert min(enough, count(times)) == min(enough, count(kept))


def test_latest_by_packed_order(spark, rows):
    """Time, then number, nulls first, over the whole range of both; the aggregate sorts no rows."""
    lowest, highest = -2**63, 2**63 - 1
    day = lambda y: dt.datetime(y, 1, 1)
    data = [("a", day(2020), 1, 1.0), ("a", day(2020), 2, 2.0), ("a", None, highest, 3.0),
            ("b", day(1), lowest, 1.0), ("b", day(1), None, 2.0), ("b", None, highest, 3.0),
            ("c", day(9999), highest, 1.0), ("c", day(9999), highest - 1, 2.0), ("c", day(9998), highest, 3.0),
            ("d", None, None, 7.0), ("e", day(1960), -5, 1.0), ("e", day(1960), -6, 2.0)]
    for kind in ("timestamp", "timestamp_ntz"):
        ev = spark.createDataFrame(data, f"name string, ts {kind}, event_id long, value double")
        got = E.perf_summary(ev)
        assert rows(got.select("name", "latest")) == [("a", 2.0), ("b", 1.0), ("c", 1.0), ("d", 7.0), ("e", 1.0)]
        assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    texts = spark.createDataFrame([("a", day(2020), "x", 1.0), ("a", day(2020), "y", 2.0)], "name string, ts timestamp, event_id string, value double")
    assert rows(E.perf_summary(texts).select("latest")) == [(2.0,)]


def test_alerts_since_equal_recent_ones_of_all(spark, rows):
    start = dt.datetime(2024, 1, 1)
    data = [(i, start + dt.timedelta(seconds=37 * (i * i % 97)) if i % 10 else None, f"e{i % 3}", "CRITICAL" if i % 7 == 0 else "ERROR", "m")
            for i in range(120)]
    errors = spark.createDataFrame(data, "event_id long, ts timestamp, error_id string, severity string, message string")
    since = F.lit(start + dt.timedelta(seconds=1500))
    want = rows(E.recent_alerts(E.all_alerts(errors, 4, 3, 60), since))
    assert {r[0] for r in want} == {"REPEATED_ERROR", "CRITICAL_ERROR", "HIGH_ERROR_RATE"}
    assert rows(E.alerts_since(errors, since, 4, 3, 60)) == want
