"""Composed detections: question sets answered by the operators, without new primitives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.operators import joins as J
from casewright.operators import scan as W
from casewright.operators import sequence as S
from casewright.operators.joins import micros
from casewright.plans.q_cases import EV, ev
from casewright.plans.registry import query, table
from casewright.sources.scratch import keep


def events(spark, d):
    return table(spark, d, "events")


RUN = "CASE WHEN event_type = 'click' THEN 'process' WHEN event_type = 'purchase' THEN 'service' WHEN event_type = 'view' AND k % 3 = 0 THEN 'task' WHEN event_type = 'view' AND k % 3 = 1 THEN 'script' END"


@query("p3_execution_records", f"WITH r AS (SELECT user_id, k, t, event_id, {RUN} AS kind FROM {EV}), x AS (SELECT * FROM r WHERE kind IS NOT NULL) SELECT user_id, k, count(*)::BIGINT AS runs, count(*) FILTER (kind = 'process')::BIGINT AS process, count(*) FILTER (kind = 'service')::BIGINT AS service, count(*) FILTER (kind = 'task')::BIGINT AS task, count(*) FILTER (kind = 'script')::BIGINT AS script, min(t) AS first_us, max(t) AS last_us, arg_min(kind, t) AS first_kind, count(DISTINCT kind)::BIGINT AS kinds, count(DISTINCT kind) = 1 AS lone FROM x GROUP BY 1, 2")
def p3(spark, d):
    """Executions of an account on a host by what recorded them; one kind of record alone is weak."""
    k = F.col("event_type")
    kind = F.when(k == "click", "process").when(k == "purchase", "service").when((k == "view") & (F.col("k") % 3 == 0), "task").when((k == "view") & (F.col("k") % 3 == 1), "script")
    rows = ev(spark, d).withColumn("kind", kind).where("kind is not null")
    each = {n: F.count_if(F.col("kind") == n) for n in ("process", "service", "task", "script")}
    kinds = F.count_distinct("kind")
    return rows.groupBy("user_id", "k").agg(F.count("*").alias("runs"), *(c.alias(n) for n, c in each.items()), F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.min_by("kind", "t").alias("first_kind"), kinds.alias("kinds"), (kinds == 1).alias("lone"))


@query("p5_named_but_absent", f"WITH e AS (SELECT *, CASE WHEN k IS DISTINCT FROM lag(k) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 1 ELSE 0 END AS n FROM {EV}), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id) AS stay FROM e), h AS (SELECT DISTINCT k FROM {EV} WHERE event_type = 'signup' AND user_id % 5 = 0) SELECT user_id, stay::BIGINT AS stay, any_value(s.k) AS host, count(*)::BIGINT AS rows, min(t) AS from_us, max(t) AS to_us, any_value(h.k) IS NULL AS absent FROM s LEFT JOIN h ON h.k = s.k GROUP BY 1, 2")
def p5(spark, d):
    """Each account from host to host, in order; hosts that it names and no evidence was taken of are absent."""
    e = ev(spark, d)
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    moved = F.coalesce((~F.col("k").eqNullSafe(F.lag("k").over(w))).cast("long"), F.lit(1))
    stays = e.withColumn("n", moved).withColumn("stay", F.sum("n").over(w)).groupBy("user_id", "stay").agg(F.first("k").alias("host"), F.count("*").alias("rows"), F.min("t").alias("from_us"), F.max("t").alias("to_us"))
    held = e.where("event_type = 'signup' and user_id % 5 = 0").select(F.col("k").alias("host"), F.lit(True).alias("held")).distinct()
    return stays.join(held, "host", "left").select("user_id", "stay", "host", "rows", "from_us", "to_us", F.col("held").isNull().alias("absent"))


@query("p8_copy_indicators", "SELECT a.event_id, count(*)::BIGINT AS near FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 3600000000 GROUP BY 1")
def p8(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts", "event_type")
    return J.band_join(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"), ["user_id"], "ts", "ts", -3600, 3600).groupBy("event_id").agg(F.count("*").alias("near"))


@query("p9_policy_changes", f"WITH f AS (SELECT k, user_id, min(t) AS t FROM {EV} WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT event_id, k, t, value AS after, lag(value) OVER (PARTITION BY k ORDER BY t, event_id) AS before, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS place FROM {EV} WHERE event_type = 'purchase') SELECT event_id, c.k AS policy, place::BIGINT AS place, before, after, count(f.user_id)::BIGINT AS scope FROM c LEFT JOIN f ON f.k = c.k AND f.t <= c.t GROUP BY ALL")
def p9(spark, d):
    """Changes of each policy in order, from what to what, and how many accounts it was linked to by then; a policy may have any number of both."""
    e = ev(spark, d)
    linked = e.where("event_type = 'view'").groupBy("k", "user_id").agg(F.min("t").alias("t")).select("k", "t", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("after"), F.lit(1).alias("link"))
    changes = e.where("event_type = 'purchase'").select("k", "t", F.lit(1).alias("turn"), "event_id", F.col("value").alias("after"), F.lit(0).alias("link"))
    order = ["t", "turn", "event_id"]
    rows = W.scan(W.ranged(linked.unionByName(changes), ["k"], order, keep), ["k"], order, total={"scope": F.col("link"), "place": F.col("turn")}).where("turn = 1").drop("_part")
    before = W.scan(W.ranged(rows, ["k"], order, keep), ["k"], order, previous={"before": F.col("after")})
    return before.select("event_id", F.col("k").alias("policy"), "place", "before", "after", "scope")


@query("p13_device_connections", f"WITH c AS (SELECT * FROM {EV} WHERE event_type = 'signup'), w AS (SELECT w.event_id, w.value, w.t - c.t AS after_us, c.k AS device FROM (SELECT * FROM {EV} WHERE event_type = 'purchase') w ASOF LEFT JOIN c ON w.user_id = c.user_id AND w.t >= c.t), d AS (SELECT k AS device, count(*)::BIGINT AS connections, count(DISTINCT user_id)::BIGINT AS accounts, min(t) AS first_us, max(t) AS last_us FROM c GROUP BY 1), f AS (SELECT device, count(*)::BIGINT AS files, round(sum(value), 4) AS bytes, min(after_us) AS soonest_us FROM w WHERE after_us <= 172800000000 GROUP BY 1) SELECT device, connections, accounts, first_us, last_us, coalesce(files, 0)::BIGINT AS files, bytes, soonest_us FROM d LEFT JOIN f USING (device)")
def p13(spark, d):
    """Devices by their connections, with the files that the account wrote within two days of its last connection before."""
    e = ev(spark, d)
    conn = e.where("event_type = 'signup'")
    written = J.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "t", "value"), conn.select("user_id", "t", F.struct("k", "t").alias("c")), ["user_id"], "t", "c")
    near = written.select("value", F.col("near_value.k").alias("device"), (F.col("t") - F.col("near_value.t")).alias("after_us")).where(F.col("after_us") <= 172_800_000_000)
    files = near.groupBy("device").agg(F.count("*").alias("files"), F.round(F.sum("value"), 4).alias("bytes"), F.min("after_us").alias("soonest_us"))
    devices = conn.groupBy(F.col("k").alias("device")).agg(F.count("*").alias("connections"), F.count_distinct("user_id").alias("accounts"), F.min("t").alias("first_us"), F.max("t").alias("last_us"))
    return devices.join(files, "device", "left").withColumn("files", F.coalesce("files", F.lit(0)))


@query("p14_usage_per_hour", f"WITH u AS (SELECT t // 3600000000 * 3600000000 AS hour_us, k % 10 AS app, count(*) AS n, sum(value) AS bytes FROM {EV} WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2), s AS (SELECT hour_us, sum(bytes) AS sync_bytes FROM u WHERE app IN (0, 7) GROUP BY 1) SELECT u.hour_us, app::BIGINT AS app, n::BIGINT AS n, round(bytes, 4) AS bytes, round(coalesce(sync_bytes, 0), 4) AS sync_bytes, bytes > coalesce(sync_bytes, 0) AS over FROM u LEFT JOIN s USING (hour_us) WHERE app NOT IN (0, 7)")
def p14(spark, d):
    """Bytes of each application by the hour against what the sync clients moved in that hour: more than they did needs another reason."""
    rows = ev(spark, d).where("event_type in ('click', 'purchase')").select((F.floor(F.col("t") / 3_600_000_000) * 3_600_000_000).cast("long").alias("hour_us"), (F.col("k") % 10).alias("app"), "value")
    used = keep(rows.groupBy("hour_us", "app").agg(F.count("*").alias("n"), F.sum("value").alias("bytes")))
    sync = used.where("app in (0, 7)").groupBy("hour_us").agg(F.sum("bytes").alias("sync_bytes"))
    out = used.where("app not in (0, 7)").join(sync, "hour_us", "left").withColumn("sync_bytes", F.coalesce("sync_bytes", F.lit(0.0)))
    return out.select("hour_us", "app", "n", F.round("bytes", 4).alias("bytes"), F.round("sync_bytes", 4).alias("sync_bytes"), (F.col("bytes") > F.col("sync_bytes")).alias("over"))


@query("p19_two_time_sets", "SELECT o_orderkey, CASE WHEN f IS NULL THEN 'one_set' WHEN f < o_orderdate THEN 'before' WHEN f - o_orderdate > INTERVAL 100 DAY THEN 'far' ELSE 'agree' END AS finding FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def p19(spark, d):
    other = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("f"))
    gap = micros("f") - micros("o_orderdate")
    finding = F.when(F.col("f").isNull(), "one_set").when(gap < 0, "before").when(gap > 100 * 86_400_000_000, "far").otherwise("agree")
    return table(spark, d, "orders").join(other, "o_orderkey", "left").select("o_orderkey", finding.alias("finding"))


@query("p23_logon_sessions", "SELECT o_custkey, max(open)::BIGINT AS most FROM (SELECT o_custkey, sum(x) OVER (PARTITION BY o_custkey ORDER BY t, x ROWS UNBOUNDED PRECEDING) AS open FROM (SELECT o_custkey, o_orderdate AS t, 1 AS x FROM orders UNION ALL SELECT o_custkey, o_orderdate + INTERVAL 90 DAY, -1 FROM orders)) GROUP BY 1")
def p23(spark, d):
    spans = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("interval 90 day")).alias("b"))
    return S.concurrent(spans, ["o_custkey"], "a", "b")


@query("p30_shared_across_hosts", "SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS hosts, min(epoch_us(l_shipdate)) AS first_us FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def p30(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("hosts"), F.min(micros("l_shipdate")).alias("first_us"))
    return rows.where("hosts >= 2")


@query("p34_hidden_rows", "SELECT user_id FROM events WHERE event_id % 2 = 0 GROUP BY 1 HAVING user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 1 AND event_type = 'view')")
def p34(spark, d):
    e = events(spark, d)
    return J.misses(e.where("event_id % 2 = 0").select("user_id").distinct(), e.where("event_id % 2 = 1 and event_type = 'view'").select("user_id"), ["user_id"])


@query("p37_sample_inventory", "WITH s AS (SELECT sha256(coalesce(text, '')) AS digest, md5(regexp_replace(coalesce(text, ''), '[0-9]+', '#', 'g')) AS template, count(*)::BIGINT AS copies, max(strlen(coalesce(text, '')))::BIGINT AS size, count(DISTINCT source)::BIGINT AS sources, min(doc_id) AS first FROM documents GROUP BY 1, 2), g AS (SELECT template, count(*) AS n, min(first) AS family FROM s GROUP BY 1) SELECT digest, copies, size, sources, s.first, family, (n - 1)::BIGINT AS relatives, CASE WHEN n > 1 THEN 'variant' WHEN copies > 1 THEN 'copied' ELSE 'single' END AS relation FROM s JOIN g USING (template)")
def p37(spark, d):
    """Samples by digest, with size, copies and sources, and those that differ from each other in numbers only, as a family."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2(t, 256).alias("digest"), F.md5(F.regexp_replace(t, "[0-9]+", "#")).alias("template"), F.octet_length(t).alias("size"))
    s = keep(rows.groupBy("digest", "template").agg(F.count("*").alias("copies"), F.max("size").cast("long").alias("size"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first")))
    g = s.groupBy("template").agg(F.count("*").alias("n"), F.min("first").alias("family"))
    relation = F.when(F.col("n") > 1, "variant").when(F.col("copies") > 1, "copied").otherwise("single")
    return s.join(g, "template").select("digest", "copies", "size", "sources", "first", "family", (F.col("n") - 1).alias("relatives"), relation.alias("relation"))


@query("p42_conversation_directions", "WITH c AS (SELECT *, lead(role) OVER w AS nxt, lag(role) OVER w AS prv FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS participants, arg_min(role, turn) AS opened, arg_max(role, turn) AS closed, count(*)::BIGINT AS turns, count(*) FILTER (role = 'user' AND nxt = 'assistant')::BIGINT AS out, count(*) FILTER (role = 'assistant' AND nxt = 'user')::BIGINT AS back, count(*) FILTER (role = prv)::BIGINT AS repeated, sum(strlen(text)) FILTER (role = 'user')::BIGINT AS sent_bytes, arg_max(role, turn) = 'user' AS unanswered FROM c GROUP BY 1")
def p42(spark, d):
    """Conversations: who took part, who opened and closed, which way it went and how often, and those left unanswered."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumns({"nxt": F.lead("role").over(w), "prv": F.lag("role").over(w)})
    role, last = F.col("role"), F.max_by("role", "turn")
    return c.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("participants"), F.min_by("role", "turn").alias("opened"), last.alias("closed"), F.count("*").alias("turns"), F.count_if((role == "user") & (F.col("nxt") == "assistant")).alias("out"),
        F.count_if((role == "assistant") & (F.col("nxt") == "user")).alias("back"), F.count_if(role == F.col("prv")).alias("repeated"), F.sum(F.when(role == "user", F.octet_length("text"))).alias("sent_bytes"), (last == "user").alias("unanswered"),
    )
