"""Status of answers, registered operators, batch twins of streams, and composed detections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.operators import answers as L
from casewright.operators import sequence as S
from casewright.operators.joins import band_join, micros
from casewright.plans.registry import query, table
from casewright.sources.scratch import keep


@query("l1_registered_operator", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) > 3000")
def l1(spark, d):
    longer = L.register_operator("longer", lambda df, least: df.where(F.length("text") > least), {"least": int}, "texts over a length")
    L.register_sql(spark, "chars_of", "t STRING", "CAST(length(t) AS BIGINT)")
    return longer(table(spark, d, "documents"), least=3000).select("doc_id", F.expr("chars_of(text)").alias("n"))


@query("l2_recipe_coverage", "SELECT CASE WHEN lang = 'en' THEN 'searched' ELSE 'unsupported' END AS status, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def l2(spark, d):
    return L.run_recipe(table(spark, d, "documents"), F.col("lang") == "en", lambda df: df.where(F.col("text").contains("the")))[1]


@query("l4_status", "SELECT count(*) FILTER (event_id % 11 <> 0)::BIGINT AS read, count(*) FILTER (event_id % 11 = 0)::BIGINT AS rejected, 'partial' AS status, count(*) FILTER (event_id % 11 <> 0) || ' read, ' || count(*) FILTER (event_id % 11 = 0) || ' rejected' AS basis FROM events")
def l4(spark, d):
    return L.status(table(spark, d, "events"), F.col("event_id") % 11 != 0, F.col("event_id") % 11 == 0)


@query("k7_caps_batch", "SELECT event_id, round(sum(value::DECIMAL(28, 6)) OVER w, 4)::DOUBLE AS total, sum(value::DECIMAL(28, 6)) OVER w > 2000 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def k7(spark, d):
    """The batch twin of the budget watch: what each row brings its key to, in order of time and, at one instant, of id. Values count to a millionth."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.col("value").cast("decimal(28,6)")).over(w)
    return table(spark, d, "events").select("event_id", F.round(spent, 4).cast("double").alias("total"), (spent > 2000).alias("over"))


@query("p1_logons_after_failures", "WITH r AS (SELECT user_id, ts, event_type = 'error' AS f FROM events WHERE event_type IN ('error', 'signup')), i AS (SELECT *, coalesce(sum((NOT f)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM r) SELECT user_id, count(*) FILTER (f)::BIGINT AS failures FROM i GROUP BY user_id, i HAVING count(*) FILTER (f) >= 1 AND count(*) FILTER (NOT f) > 0")
def p1(spark, d):
    kind = F.col("event_type")
    return S.failures_then_success(table(spark, d, "events"), ["user_id"], "ts", kind == "error", kind == "signup", 1).select("user_id", "failures")


@query("p2_new_identity_sequence", "SELECT f.user_id, f.event_type, count(e.event_id)::BIGINT AS later FROM (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY 1, 2 HAVING min(ts) >= TIMESTAMP '2024-01-15') f LEFT JOIN events e ON e.user_id = f.user_id AND e.ts > f.t GROUP BY 1, 2")
def p2(spark, d):
    e = table(spark, d, "events")
    first = S.first_seen(e, ["user_id"], "event_type", "ts", F.lit("2024-01-15").cast("timestamp_ntz"))
    both = first.join(e.select("user_id", micros("ts").alias("t")), "user_id", "left")
    return both.groupBy("user_id", "event_type").agg(F.count_if(F.col("t") > F.col("first_us")).alias("later"))


@query("p22_daily_activity", "WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) AS t, event_type, hour(ts) AS h, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts) AS gap FROM events), a AS (SELECT user_id, day, count(*)::BIGINT AS n, count(DISTINCT event_type)::BIGINT AS kinds, count(DISTINCT h)::BIGINT AS hours, min(t) AS first_us, max(t) AS last_us, max(gap) AS longest_gap_us, count(*) FILTER (h < 6 OR h >= 22)::BIGINT AS at_night FROM e GROUP BY 1, 2), m AS (SELECT user_id, avg(n) AS usual, count(*)::BIGINT AS days FROM a GROUP BY 1) SELECT a.*, days, round(n / usual, 4) AS against_usual FROM a JOIN m USING (user_id)")
def p22(spark, d):
    """Each account's days: first and last act, hours with any, the longest pause, acts at night, and how the day compares with the account's usual one."""
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), micros("ts").alias("t"), "event_type", F.hour("ts").alias("h"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id", "day").orderBy("t"))
    days = e.withColumn("gap", gap).groupBy("user_id", "day").agg(
        F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.count_distinct("h").alias("hours"), F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.max("gap").alias("longest_gap_us"), F.count_if((F.col("h") < 6) | (F.col("h") >= 22)).alias("at_night"),
    )
    days = keep(days)
    usual = days.groupBy("user_id").agg(F.avg("n").alias("usual"), F.count("*").alias("days"))
    return days.join(usual, "user_id").withColumn("against_usual", F.round(F.col("n") / F.col("usual"), 4)).drop("usual")


@query("p24_additions_with_requests", "SELECT a.event_id, count(b.event_id)::BIGINT AS requests FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type IN ('view', 'click') AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 86400000000 GROUP BY 1")
def p24(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return band_join(e.where("event_type = 'signup'"), e.where("event_type in ('view', 'click')"), ["user_id"], "ts", "ts", 0, 86_400).groupBy("event_id").agg(F.count("*").alias("requests"))


@query("p36_two_captures", "SELECT coalesce(a.u, b.u) AS user_id, CASE WHEN b.u IS NULL THEN 'gone' WHEN a.u IS NULL THEN 'new' ELSE 'both' END AS state FROM (SELECT DISTINCT user_id AS u FROM events WHERE ts < TIMESTAMP '2024-01-10') a FULL JOIN (SELECT DISTINCT user_id AS u FROM events WHERE ts >= TIMESTAMP '2024-01-20') b ON a.u = b.u")
def p36(spark, d):
    e, at = table(spark, d, "events"), lambda s: F.lit(s).cast("timestamp_ntz")
    seen = e.groupBy("user_id").agg(F.bool_or(F.col("ts") < at("2024-01-10")).alias("a"), F.bool_or(F.col("ts") >= at("2024-01-20")).alias("b")).where("a or b")
    return seen.select("user_id", F.when(~F.col("b"), "gone").when(~F.col("a"), "new").otherwise("both").alias("state"))
