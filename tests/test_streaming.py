"""Streams over files made of the events table, each against its batch twin."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casewright import streaming as K

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no driver tables")


@pytest.fixture(scope="module")
def days(spark, tmp_path_factory):
    """A file a day, in order of time."""
    path = str(tmp_path_factory.mktemp("days"))
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for day in range(1, 31, 6):
        e.where(F.dayofmonth("ts").between(day, day + 5)).coalesce(1).write.mode("append").parquet(path)
    return path, e


def drain(sdf, name, mode):
    q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return sdf.sparkSession.table(name)


def stream(spark, days):
    return K.stream_register(spark, days[0], days[1].schema, "parquet", 1)


def test_counts(spark, days):
    got = drain(K.stream_counts(stream(spark, days), "ts", ["event_type"], "1 day"), "k1", "complete")
    want = days[1].groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bursts(spark, days):
    got = drain(K.stream_bursts(stream(spark, days), "ts", ["user_id"], "2 days", "1 day", 2), "k2", "complete")
    each = days[1].select("user_id", F.explode(F.array(F.date_trunc("day", "ts"), F.date_trunc("day", "ts") - F.expr("interval 1 day"))).alias("start"))
    want = each.groupBy("start", "user_id").agg(F.count("*").alias("n")).where("n >= 2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0


def test_sessions(spark, days):
    got = drain(K.stream_sessions(stream(spark, days), "ts", ["user_id"], "6 hours"), "k3", "complete")
    want, six = [], 6 * 3600
    rows = sorted((r.user_id, r.ts) for r in days[1].select("user_id", "ts").collect())
    for user, ts in rows:
        if want and want[-1][0] == user and (ts - want[-1][2]).total_seconds() < six:
            want[-1][2:] = [ts, want[-1][3] + 1]
        else:
            want.append([user, ts, ts, 1])
    assert sorted((r.user_id, r.start, r.n, r.end - timedelta(seconds=six)) for r in got.collect()) == sorted((u, a, n, b) for u, a, b, n in want)


def test_dedupe(spark, days):
    twice = stream(spark, days).withColumn("event_id", F.floor(F.col("event_id") / 2))
    got = drain(K.stream_dedupe(twice, "ts", "event_id", "30 days"), "k9", "append")
    assert got.count() == days[1].select(F.floor(F.col("event_id") / 2)).distinct().count()


def test_interval_join(spark, days):
    a = stream(spark, days).where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"))
    b = stream(spark, days).where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bt"))
    got = drain(K.stream_interval_join(a, b, "user_id", "at", "bt", "2 DAYS", "30 days"), "k10", "append").count()
    e = days[1]
    x, y = e.where("event_type = 'signup'").selectExpr("user_id", "ts as at"), e.where("event_type = 'purchase'").selectExpr("user_id", "ts as bt")
    assert got == x.join(y, "user_id").where("bt >= at and bt <= at + interval 2 days").count() > 0


def test_caps_steer_and_pause(spark, days, tmp_path):
    """Each seat is steered with the row that crosses the cap and paused after the grace; a restart from the checkpoint gives no row twice."""
    late = days[1].limit(1).select(*(F.lit(-1).cast("long").alias(c) if c in ("event_id", "user_id") else F.lit("2024-06-01").cast("timestamp").alias(c) if c == "ts" else F.col(c) for c in days[1].columns))
    folder = str(tmp_path / "rows")
    want, spent = {}, {}
    for r in days[1].orderBy("ts").collect():
        spent[r.user_id] = spent.get(r.user_id, 0.0) + r.value
        if spent[r.user_id] > 500 and r.user_id not in want:
            want[r.user_id] = (int(r.ts.timestamp() * 1000), spent[r.user_id])
    for k, day in enumerate(range(1, 31, 6)):
        days[1].where(F.dayofmonth("ts").between(day, day + 5)).coalesce(1).write.mode("append").parquet(folder)
        if k == 4:
            late.write.mode("append").parquet(folder)
        if k in (1, 4):  # what is there by then; the second run goes on from the first's checkpoint
            sdf = K.stream_register(spark, folder, days[1].schema, "parquet", 1)
            out = tmp_path / "run"
            if k == 4:
                (out / "out/none").rename(tmp_path / "none")
            got = K.run_available(K.stream_caps(sdf, "user_id", "ts", "value", 500.0, 3_600_000, "7 days"), "append", str(out))
    rows = [r for r in got.collect() if r.user_id >= 0]
    steer = {r.user_id: (r.at_ms, r.total) for r in rows if r.action == "steer"}
    pause = {r.user_id: r.at_ms for r in rows if r.action == "pause"}
    assert len(rows) == 2 * len(want) and steer.keys() == want.keys() and pause == {k: at + 3_600_000 for k, (at, _) in want.items()}
    assert all(steer[k][0] == at and abs(steer[k][1] - total) < 1e-6 for k, (at, total) in want.items())


def test_liveness(spark, days):
    """A key is dark in the end just if event time has passed its last word by a day."""
    from pyspark.sql import Window

    got = drain(K.liveness(stream(spark, days).withColumn("user_id", F.col("event_id") % 40), "user_id", "ts", 86_400_000, "1 hour"), "k4", "update")
    last = {r.user_id: r.last for r in days[1].groupBy((F.col("event_id") % 40).alias("user_id")).agg(F.max(F.unix_millis("ts")).alias("last")).collect()}
    end = max(last.values()) - 3_600_000
    state = got.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_ms"), (F.col("state") == "live").cast("int")))).where("n = 1")
    assert {r.user_id: (r.last_ms, r.state) for r in state.collect()} == {k: (t, "dark" if t + 86_400_000 <= end else "live") for k, t in last.items()}


def test_chain(spark, days):
    from pyspark.sql import Window

    h = F.sha2(F.col("event_id").cast("string"), 256)
    chained = days[1].select((F.col("user_id") % 3).alias("reg"), "event_id", h.alias("h")).withColumn("prev", F.when(F.col("event_id") == 50, "x").otherwise(F.lag("h").over(Window.partitionBy("reg").orderBy("event_id"))))
    path = f"{days[0]}-chain"
    for lo in (0, 500):
        chained.where(F.col("event_id").between(lo, lo + 499)).coalesce(1).write.mode("append").parquet(path)
    got = drain(K.stream_chain(K.stream_register(spark, path, chained.schema, "parquet", 1), "reg", "event_id", "prev", "h"), "k9c", "append")
    assert [r.broken_at for r in got.collect()] == [50]


def test_late_evidence(spark, days):
    looked = spark.createDataFrame([("signup",), ("absent",)], "word string")
    got = drain(K.late_evidence(stream(spark, days), "event_type", "event_id", looked, "word"), "k8", "append")
    assert got.count() == days[1].where("event_type = 'signup'").count()


def test_stall(spark, days):
    coarse = stream(spark, days).withColumn("value", F.when(F.col("user_id") % 2 == 0, F.lit(1.0)).otherwise(F.col("value")))
    got = drain(K.stream_stall(coarse, "user_id", "ts", "value", 5 * 86_400_000), "k5", "update").groupBy("user_id").agg(F.max_by("verdict", "still_ms").alias("v")).collect()
    spans = {r.user_id: r.s for r in days[1].groupBy("user_id").agg((F.max(F.unix_millis("ts")) - F.min(F.unix_millis("ts"))).alias("s")).collect()}
    assert all((r.v == "suspected_stall") == (spans[r.user_id] >= 5 * 86_400_000) for r in got if r.user_id % 2 == 0)


def test_offers(spark, days):
    got = drain(K.stream_offers(stream(spark, days), "user_id", "ts", "event_type", "purchase", 86_400_000, "1 hour"), "k6", "update")
    first = days[1].groupBy("user_id").agg(F.min("ts").alias("made"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("took"))
    want = {r.user_id for r in first.where("took < made + interval 1 day").collect()}
    assert {r.user_id for r in got.where("status = 'accepted'").collect()} == want
    assert got.where("status = 'lapsed'").count() > 0


def test_caps_do_not_depend_on_how_rows_are_cut_or_tied(spark, tmp_path):
    """A key's rows come in many parts and out of order, some at one instant, and some bring it just to the cap, which does not cross it."""
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(seconds=i // 4), 1, 0.1) for i in range(60)] + [(100 + i, base + timedelta(seconds=i), 2, 0.1) for i in range(10)] + [(200, base, 3, 7.0), (201, base, 3, 0.5), (202, base, 3, 0.25)]
    folder = str(tmp_path / "rows")
    spark.createDataFrame(rows[::-1], "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(folder)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        sdf = K.stream_register(spark, folder, "event_id long, ts timestamp, user_id long, value double", "parquet", 1)
        got = K.run_available(K.stream_caps(sdf, "user_id", "ts", "value", 1.0, 1000, "7 days", ["event_id"]), "append", str(tmp_path / "run")).where("action = 'steer'").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    start = int(base.timestamp() * 1000)
    assert sorted((r.user_id, r.at_ms - start, r.total) for r in got) == [(1, 2000, 1.1), (3, 0, 7.0)]


def test_caps_batch_by_id_at_one_instant(spark, tmp_path):
    """Rows of one instant count in the order of their ids, however they lie, and just the cap is not over it."""
    from casewright.plans import all_queries

    rows = [(i, datetime(2024, 1, 1), 1, 66.6 if i < 30 else 2.0) for i in range(32)]
    spark.createDataFrame(rows[::-1], "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.total, r.over) for r in all_queries()["k7_caps_batch"](spark, str(tmp_path)).collect()}
    assert got == {i: (round(66.6 * min(i + 1, 30) + 2.0 * max(i - 29, 0), 4), i == 31) for i in range(32)}
