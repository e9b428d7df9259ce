"""Streams run to the end of what is there, each beside the SQL of its batch twin.

The events arrive as five folders of files, in order of time, and are read a fifth of the files at a time; the rows of a user and
folder lie in one file. What lies in one folder is less than a week apart, so that is the delay. A last row, far ahead in time, of a
user below zero, closes what is open where a query asks for it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright import streaming as K
from casewright.operators.joins import micros
from casewright.plans.registry import query, table
from casewright.sources.scratch import scratch_path

DELAY = "7 days"


def arrivals(spark, e, key: str, last=None):
    """A stream over the rows of ``e``, written as they would come."""
    path = scratch_path(spark)
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(4))
    for i in range(5):
        e.where(part == i).repartition(key).write.mode("append").parquet(path)
    if last is not None:
        last.write.mode("append").parquet(path)
    files = len(spark.read.schema(e.schema).parquet(path).inputFiles())
    return K.stream_register(spark, path, e.schema, "parquet", -(-files // 5))


def stream(spark, d, last: bool = False):
    """The events as a stream."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = None
    if last:
        end = e.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2024-06-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    return arrivals(spark, e, "user_id", end)


def done(sdf, mode):
    return K.run_available(sdf, mode, scratch_path(sdf.sparkSession))


@query("a17_follow", "SELECT event_type, count(*)::BIGINT AS n, true AS several FROM events GROUP BY 1")
def a17(spark, d):
    """All rows of a growing folder, once each, however they arrive."""
    got = done(stream(spark, d).select("event_id", "event_type"), "append").dropDuplicates(["event_id"])
    n = got.agg((F.max("batch") > F.min("batch")).alias("several"))
    return got.groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(n))  # one row


@query("k1_tumbling_counts", "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def k1(spark, d):
    got = done(K.stream_counts(stream(spark, d), "ts", ["event_type"], "1 day", DELAY), "update")
    return got.groupBy(micros("start").alias("start_us"), "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("k2_sliding_bursts", "SELECT epoch_us(s) AS start_us, user_id, count(*)::BIGINT AS n FROM (SELECT user_id, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1, 2 HAVING count(*) >= 3")
def k2(spark, d):
    got = done(K.stream_bursts(stream(spark, d), "ts", ["user_id"], "2 days", "1 day", 3, DELAY), "update")
    return got.groupBy(micros("start").alias("start_us"), "user_id").agg(F.max_by("n", "batch").alias("n"))


@query("k3_session_windows", "SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*)::BIGINT AS n FROM (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS run FROM (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 21600000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, run")
def k3(spark, d):
    got = done(K.stream_sessions(stream(spark, d, True), "ts", ["user_id"], "6 hours", DELAY), "append").where("user_id >= 0")
    return got.select("user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n").distinct()


END = "(SELECT max(epoch_us(ts) // 1000) - 604800000 AS w FROM events)"


@query("k4_dark_threads", f"SELECT user_id, max(epoch_us(ts) // 1000) AS last_ms, CASE WHEN max(epoch_us(ts) // 1000) + 86400000 <= max(w) THEN 'dark' ELSE 'live' END AS state FROM events, {END} GROUP BY 1")
def k4(spark, d):
    got = done(K.liveness(stream(spark, d), "user_id", "ts", 86_400_000, DELAY), "update")
    return got.groupBy("user_id").agg(F.max("last_ms").alias("last_ms"), F.max_by("state", F.struct("batch", F.col("state") == "dark")).alias("state"))


_SIGNAL = "CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE floor(value / 40) END"


@query("k5_stalls", f"WITH s AS (SELECT user_id, epoch_us(ts) // 1000 AS t, {_SIGNAL} AS v FROM events), c AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY user_id ORDER BY t) THEN t END AS change FROM s) SELECT user_id, max(t) - max(change) AS still_ms, CASE WHEN max(t) - max(change) >= 432000000 THEN 'suspected_stall' ELSE 'moving' END AS verdict FROM c GROUP BY 1")
def k5(spark, d):
    signal = F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(F.floor(F.col("value") / 40).cast("double"))
    got = done(K.stream_stall(stream(spark, d).withColumn("value", signal), "user_id", "ts", "value", 5 * 86_400_000), "update")
    return got.groupBy("user_id").agg(F.max_by(F.struct("still_ms", "verdict"), "batch").alias("r")).select("user_id", "r.still_ms", "r.verdict")


@query("k6_offers", f"SELECT user_id, CASE WHEN min(epoch_us(ts) // 1000) FILTER (event_type = 'purchase') < min(epoch_us(ts) // 1000) + 86400000 THEN 'accepted' WHEN max(epoch_us(ts) // 1000) >= min(epoch_us(ts) // 1000) + 86400000 OR min(epoch_us(ts) // 1000) + 86400000 <= max(w) THEN 'lapsed' ELSE 'pending' END AS status FROM events, {END} GROUP BY 1")
def k6(spark, d):
    got = done(K.stream_offers(stream(spark, d), "user_id", "ts", "event_type", "purchase", 86_400_000, DELAY), "update")
    return got.groupBy("user_id").agg(F.max_by("status", F.struct("batch", F.col("status") != "pending")).alias("status"))


GRACE_MS, CAP = 86_400_000, 2000.0


@query("k7_caps", f"WITH t AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER w AS n, sum(value::DECIMAL(28, 6)) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), s AS (SELECT user_id, arg_min(ms, n) AS ms, arg_min(total, n) AS total FROM t WHERE total > {CAP} GROUP BY 1) SELECT user_id, 'steer' AS action, ms AS at_ms, round(total, 4)::DOUBLE AS total FROM s UNION ALL SELECT user_id, 'pause', ms + {GRACE_MS}, NULL FROM s")
def k7s(spark, d):
    """Spending by seat as it comes in: steered at the cap, paused a day later; what was spent by the pause depends on when the clock rang, so it is not compared."""
    got = done(K.stream_caps(stream(spark, d, True), "user_id", "ts", "value", CAP, GRACE_MS, DELAY, ["event_id"]), "append").where("user_id >= 0")
    return got.select("user_id", "action", "at_ms", F.when(F.col("action") == "steer", F.round("total", 4)).alias("total"))


@query("k8_late_evidence", "SELECT event_id, event_type AS hit FROM events WHERE event_type IN ('signup', 'error')")
def k8(spark, d):
    looked = spark.createDataFrame([("signup",), ("error",), ("absent",)], "word string")
    got = done(K.late_evidence(stream(spark, d), "event_type", "event_id", looked, "word"), "append")
    return got.select("event_id", "hit").distinct()


@query("k9_dedupe", "SELECT event_id // 2 AS event_id, min(epoch_us(ts)) <= max(epoch_us(ts)) AS one_of_its_times FROM events GROUP BY 1")
def k9(spark, d):
    """Of rows with one id the first to arrive stays: one of them, and none twice."""
    twice = stream(spark, d).withColumn("event_id", F.floor(F.col("event_id") / 2))
    got = done(K.stream_dedupe(twice, "ts", "event_id", "40 days"), "append").select("event_id", micros("ts").alias("t"))
    span = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 2).alias("event_id")).agg(F.min(micros("ts")).alias("lo"), F.max(micros("ts")).alias("hi"))
    return got.join(span, "event_id").select("event_id", F.col("t").between(F.col("lo"), F.col("hi")).alias("one_of_its_times"))


@query("k9_chain", "SELECT user_id AS reg, event_id AS broken_at FROM events WHERE event_id % 97 = 5")
def k9c(spark, d):
    """Rows that do not name the row before them, as they arrive."""
    from pyspark.sql import Window

    own = F.sha2(F.col("event_id").cast("string"), 256)
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    before = F.lag(own).over(Window.partitionBy("reg").orderBy("event_id"))
    chained = e.withColumn("reg", F.col("user_id")).select("reg", "event_id", "ts", own.alias("h"), F.when(F.col("event_id") % 97 == 5, "torn").otherwise(before).alias("prev"))
    got = done(K.stream_chain(arrivals(spark, chained, "reg"), "reg", "event_id", "prev", "h"), "append")
    return got.select("reg", "broken_at").distinct()


@query("k10_interval_join", "SELECT a.event_id AS signup, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY")
def k10(spark, d):
    s = stream(spark, d)
    a = s.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("signup"))
    b = s.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bt"), F.col("event_id").alias("purchase"))
    return done(K.stream_interval_join(a, b, "user_id", "at", "bt", "2 DAYS", "30 days").select("signup", "purchase"), "append").select("signup", "purchase").distinct()
