"""Sequence analytics, sorts and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.operators.aggregates import ranked
from casewright.operators import scan as W
from casewright.operators import sequence as S
from casewright.operators.joins import micros
from casewright.operators.quantiles import spread
from casewright.plans.q_aggregates import islands_sql
from casewright.plans.registry import query, table
from casewright.sources.scratch import keep

U = "PARTITION BY user_id ORDER BY ts"


def events(spark, d):
    return table(spark, d, "events")


@query("e1_intervals", f"SELECT user_id, median(g)::BIGINT AS median_us FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER ({U}) AS g FROM events) WHERE g IS NOT NULL GROUP BY 1")
def e1(spark, d):
    g = S.intervals(events(spark, d), ["user_id"], "ts").where("gap_us is not null")
    return g.groupBy("user_id").agg(F.rint(F.median("gap_us")).cast("long").alias("median_us"))


@query("e2_silences", f"SELECT * FROM (SELECT user_id, before, after, gap_us, row_number() OVER (PARTITION BY user_id ORDER BY gap_us DESC, after)::BIGINT AS place FROM (SELECT user_id, lag(event_id) OVER ({U}, event_id) AS before, event_id AS after, epoch_us(ts) - lag(epoch_us(ts)) OVER ({U}, event_id) AS gap_us FROM events) WHERE gap_us IS NOT NULL) WHERE place <= 3")
def e2(spark, d):
    return S.silences(events(spark, d), ["user_id"], "ts", "event_id")


@query("e3_gaps", "SELECT * FROM (SELECT event_type, epoch_us(ts) AS from_us, lead(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS to_us FROM events) WHERE to_us - from_us > 21600000000")
def e3(spark, d):
    return S.gaps(events(spark, d), ["event_type"], "ts", 6 * 3600)


@query("e3_missing_hours", "WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS b FROM events WHERE event_type = 'error') SELECT epoch_us(b) AS bucket_us FROM (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 hour)) AS b FROM h) WHERE b NOT IN (SELECT b FROM h)")
def e3m(spark, d):
    return S.missing_buckets(events(spark, d).where("event_type = 'error'"), "ts", "hour")


@query("e4_failures_then_success", "WITH r AS (SELECT user_id, ts, event_type = 'error' AS f, event_type IN ('purchase', 'signup') AS s FROM events WHERE event_type IN ('error', 'purchase', 'signup')), i AS (SELECT *, coalesce(sum(s::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM r) SELECT user_id, count(*) FILTER (f)::BIGINT AS failures, min(epoch_us(ts)) FILTER (f) AS first_us, max(epoch_us(ts)) FILTER (s) AS success_us FROM i GROUP BY user_id, i HAVING count(*) FILTER (f) >= 2 AND count(*) FILTER (s) > 0")
def e4(spark, d):
    kind = F.col("event_type")
    return S.failures_then_success(events(spark, d), ["user_id"], "ts", kind == "error", kind.isin("purchase", "signup"), 2)


@query("e5_bursts", "SELECT event_id, n::BIGINT AS n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 3")
def e5(spark, d):
    return S.bursts(events(spark, d), ["user_id"], "ts", 6 * 3600, 3).select("event_id", "n")


LAT, LON = "(event_id * 37 % 181) - 90", "(event_id * 91 % 361) - 180"


@query("e6_impossible_travel", f"WITH p AS (SELECT user_id, event_id, ts, {LAT} AS lat, {LON} AS lon, lag({LAT}) OVER w AS a, lag({LON}) OVER w AS o, lag(ts) OVER w AS t FROM events WINDOW w AS ({U})), k AS (SELECT *, 2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lon - o) / 2), 2)))) AS km, (epoch_us(ts) - epoch_us(t)) / 3.6e9 AS h FROM p) SELECT event_id, round(km, 2) AS km FROM k WHERE km > 0 AND (h <= 0 OR km / h > 500)")
def e6(spark, d):
    at = events(spark, d).withColumns({"lat": F.expr(LAT).cast("double"), "lon": F.expr(LON).cast("double")})
    return S.impossible_travel(at, ["user_id"], "ts", "lat", "lon", 500).select("event_id", F.round("km", 2).alias("km"))


@query("e7_first_seen", "SELECT user_id, event_type, min(epoch_us(ts)) AS first_us FROM events GROUP BY 1, 2 HAVING min(ts) >= TIMESTAMP '2024-01-15'")
def e7(spark, d):
    return S.first_seen(events(spark, d), ["user_id"], "event_type", "ts", F.lit("2024-01-15").cast("timestamp_ntz"))


@query("e8_sessions", f"SELECT user_id, run, n AS requests, end_us - start_us AS duration_us FROM ({islands_sql('user_id', 6 * 3600)})")
def e8(spark, d):
    return S.sessionise(events(spark, d), ["user_id"], "ts", 6 * 3600)


@query("e9_concurrent", "WITH o AS (SELECT o_custkey, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS b FROM orders), m AS (SELECT o_custkey, a AS t, 1 AS d FROM o UNION ALL SELECT o_custkey, b, -1 FROM o) SELECT o_custkey, max(open)::BIGINT AS most FROM (SELECT o_custkey, sum(d) OVER (PARTITION BY o_custkey ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM m) GROUP BY 1")
def e9(spark, d):
    spans = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("interval 30 day")).alias("b"))
    return S.concurrent(spans, ["o_custkey"], "a", "b")


@query("e10_phases", "SELECT conv_id, phase::BIGINT AS phase, role, count(*)::BIGINT AS rows FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS phase FROM (SELECT *, CASE WHEN role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS n FROM conversations)) GROUP BY 1, 2, 3")
def e10(spark, d):
    return S.phases(table(spark, d, "conversations"), ["conv_id"], "turn", "role")


@query("e11_claim_sequences", f"SELECT user_id, claim::BIGINT AS claim, count(*)::BIGINT AS steps, max((event_type = 'purchase')::INT) = 1 AS released FROM (SELECT *, sum((event_type = 'signup')::INT) OVER ({U}) AS claim FROM events) WHERE claim > 0 GROUP BY 1, 2")
def e11(spark, d):
    claim = F.sum((F.col("event_type") == "signup").cast("int")).over(Window.partitionBy("user_id").orderBy("ts"))
    rows = events(spark, d).withColumn("claim", claim.cast("long")).where("claim > 0")
    return rows.groupBy("user_id", "claim").agg(F.count("*").alias("steps"), F.bool_or(F.col("event_type") == "purchase").alias("released"))


@query("e12_holding_intervals", "WITH r AS (SELECT user_id % 20 AS seat, ts, CASE WHEN event_type = 'signup' THEN user_id END AS h FROM events WHERE event_type IN ('signup', 'purchase', 'error')), k AS (SELECT * FROM (SELECT *, lag(h) OVER (PARTITION BY seat ORDER BY ts) AS p FROM r) WHERE h IS NULL OR h IS DISTINCT FROM p) SELECT seat, h AS holder, f AS from_us, t AS to_us FROM (SELECT seat, h, epoch_us(ts) AS f, lead(epoch_us(ts)) OVER (PARTITION BY seat ORDER BY ts) AS t FROM k) WHERE h IS NOT NULL")
def e12(spark, d):
    kind = F.col("event_type")
    return W.holding_intervals(events(spark, d).withColumn("seat", F.col("user_id") % 20), ["seat"], "ts", kind == "signup", kind.isin("purchase", "error"), "user_id", keep)


@query("e13_fold_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def e13(spark, d):
    return S.fold_latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("e14_offer_status", "SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'accepted' WHEN o_orderkey % 7 = 0 THEN 'withdrawn' WHEN 1000 >= CASE WHEN o_orderkey % 2 = 0 THEN least(o_orderkey % 900 + 10 + 300, o_orderkey % 900 + 600) ELSE o_orderkey % 900 + 600 END THEN 'lapsed' WHEN o_orderkey % 2 = 0 THEN 'live' ELSE 'pending' END AS status FROM orders) GROUP BY 1")
def e14(spark, d):
    k = F.col("o_orderkey")
    status = S.offer_status(k % 900, F.when(k % 2 == 0, k % 900 + 10), 300, 600, (F.col("o_orderstatus") == "F") & (k % 5 == 0), k % 7 == 0, F.lit(1000))
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("e15_open_disputes", "SELECT l_orderkey, l_suppkey FROM (SELECT l_orderkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS r FROM lineitem WHERE l_returnflag IN ('R', 'A')) WHERE r = 1 AND l_returnflag = 'R'")
def e15(spark, d):
    acts = table(spark, d, "lineitem").where("l_returnflag in ('R', 'A')")
    return S.fold_latest(acts, ["l_orderkey", "l_suppkey"], ["l_shipdate", "l_linenumber"], ["l_returnflag"]).where("l_returnflag = 'R'").drop("l_returnflag")


CHAIN = """SELECT register, seq, CASE WHEN o_orderkey % 211 = 0 THEN body || '?' ELSE body END AS body, CASE WHEN o_orderkey % 307 = 0 THEN 'x' ELSE lag(sha256(body)) OVER (PARTITION BY register ORDER BY seq) END AS prev, sha256(body) AS h, o_orderkey
    FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_custkey END AS register, row_number() OVER (PARTITION BY CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_custkey END ORDER BY o_orderkey) AS seq, o_orderkey || '|' || o_orderstatus AS body, o_orderkey FROM orders)"""
SEALS = "SELECT register, max(seq) - 1 AS seal, arg_max(h, seq) FILTER (seq < m) AS sealed FROM (SELECT *, max(seq) OVER (PARTITION BY register) AS m FROM c0) WHERE register % 3 = 0 GROUP BY register HAVING max(seq) > 1"


@query("e16_verify_chain", f"""WITH c0 AS ({CHAIN}), c AS (SELECT * FROM c0 WHERE o_orderkey % 173 <> 0), s AS (SELECT register, seal, CASE WHEN register % 5 = 0 AND register > 0 THEN 'y' ELSE sealed END AS sealed FROM ({SEALS})),
    m AS (SELECT c.*, lag(seq) OVER w AS ps, lag(h) OVER w AS ph, seal, sealed FROM c LEFT JOIN s USING (register) WINDOW w AS (PARTITION BY register ORDER BY seq))
    SELECT register, count(*)::BIGINT AS rows, min(seq) FILTER (seq <> coalesce(ps, 0) + 1) AS first_gap, min(seq) FILTER (prev IS DISTINCT FROM ph) AS first_break, min(seq) FILTER (h <> sha256(body)) AS first_altered,
        CASE WHEN max(seal) IS NULL THEN 'none' WHEN bool_or(seq = seal AND h = sealed) THEN 'kept' ELSE 'broken' END AS seal, count(*) FILTER (seq > seal)::BIGINT AS after_seal FROM m GROUP BY 1""")
def e16(spark, d):
    """Registers, one with a tenth of all lines: numbers without a gap, each line on the one before, bodies as they were hashed, and what was sealed."""
    k = F.col("o_orderkey")
    lines = table(spark, d, "orders").select(F.when(k % 10 == 0, 0).otherwise(F.col("o_custkey")).cast("long").alias("register"), k.alias("k"), F.concat_ws("|", k.cast("string"), "o_orderstatus").alias("body"))
    lines = lines.withColumn("h", F.sha2("body", 256))
    rows = W.scan(W.ranged(lines, ["register"], ["k"], keep), ["register"], ["k"], previous={"prev": F.col("h")}, number="seq").drop("_part")
    rows = keep(rows.withColumns({"prev": F.when(k_odd(307), F.lit("x")).otherwise(F.col("prev")), "body": F.when(k_odd(211), F.concat("body", F.lit("?"))).otherwise(F.col("body"))}))
    most = rows.groupBy("register").agg(F.max("seq").alias("m")).where((F.col("m") > 1) & (F.col("register") % 3 == 0))
    seals = rows.join(most, "register").where("seq = m - 1").select("register", "seq", F.when((F.col("register") % 5 == 0) & (F.col("register") > 0), F.lit("y")).otherwise(F.col("h")).alias("digest"))
    return W.verify_chain(rows.where(~k_odd(173)), "register", "seq", "body", "prev", "h", seals, keep)


def k_odd(n):
    """Lines that the made register has wrong: every n-th key."""
    return F.col("k") % n == 0


STILL = "WITH s AS (SELECT user_id, ts, floor(value / 100) AS v FROM events), c AS (SELECT user_id, max(ts) AS last, arg_max(v, ts) AS v FROM s GROUP BY 1), m AS (SELECT c.user_id, c.last, max(s.ts) FILTER (s.v <> c.v) AS moved FROM c JOIN s USING (user_id) GROUP BY 1, 2)"


@query("e17_stall_verdict", f"{STILL} SELECT user_id, CASE WHEN TIMESTAMP '2024-01-30' - last > INTERVAL 2 DAY THEN 'unknown' WHEN moved IS NULL THEN 'suspected_stall' WHEN last - moved < INTERVAL 1 DAY THEN 'moving' ELSE 'quiet' END AS verdict FROM m")
def e17(spark, d):
    s = events(spark, d).select("user_id", "ts", F.floor(F.col("value") / 100).alias("v"))
    last = s.groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("v", "ts").alias("now"))
    moved = s.join(last, "user_id").groupBy("user_id", "last").agg(F.max(F.when(F.col("v") != F.col("now"), F.col("ts"))).alias("moved"))
    day = 86_400_000_000
    silent = micros(F.lit("2024-01-30").cast("timestamp_ntz")) - micros("last") > 2 * day
    return moved.select("user_id", F.when(silent, "unknown").when(F.col("moved").isNull(), "suspected_stall").when(micros("last") - micros("moved") < day, "moving").otherwise("quiet").alias("verdict"))


@query("e18_context_series", f"SELECT event_id, round(last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER ({U} ROWS UNBOUNDED PRECEDING), 4) AS ceiling FROM events")
def e18(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, d).select("event_id", F.round(F.last(F.when(F.col("event_type") == "signup", F.col("value")), ignorenulls=True).over(w), 4).alias("ceiling"))


@query("e19_lane_timeline", "SELECT event_id, round(100.0 * (epoch_us(ts) - lo) / (hi - lo), 2) AS percent FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)")
def e19(spark, d):
    e = events(spark, d)
    ends = F.broadcast(e.agg(F.min(micros("ts")).alias("lo"), F.max(micros("ts")).alias("hi")).withColumn("_k", F.lit(1)))  # one row
    return e.withColumn("_k", F.lit(1)).join(ends, "_k").select("event_id", F.round(100.0 * (micros("ts") - F.col("lo")) / (F.col("hi") - F.col("lo")), 2).alias("percent"))


@query("e20_clock_offset", "WITH o AS (SELECT o_orderpriority, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0 AS off FROM orders JOIN lineitem ON l_orderkey = o_orderkey), m AS (SELECT o_orderpriority, median(off) AS mid FROM o GROUP BY 1) SELECT o_orderpriority, mid AS offset_days, median(abs(off - mid)) AS spread_days, round(avg(off), 4) AS mean, count(*)::BIGINT AS anchors FROM o JOIN m USING (o_orderpriority) GROUP BY 1, 2")
def e20(spark, d):
    """Offset of one clock against the other, its spread and mean, by anchors that both have."""
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    # a row an offset, with how often it occurs: many anchors share one
    off = keep(both.groupBy("o_orderpriority", ((micros("l_shipdate") - micros("o_orderdate")) / 86_400_000_000.0).alias("off")).agg(F.count("*").alias("n")))
    own = spread(off, ["o_orderpriority"], F.col("off"), keep, middle="offset_days", name="spread_days", times=F.col("n"))
    mean = F.sum(F.col("off") * F.col("n")) / F.sum(F.when(F.col("off").isNotNull(), F.col("n")))
    return own.join(off.groupBy("o_orderpriority").agg(F.round(mean, 4).alias("mean"), F.sum("n").alias("anchors")), "o_orderpriority")


@query("e21_collapse_bursts", islands_sql("event_type", 1200))
def e21(spark, d):
    return W.islands(events(spark, d), ["event_type"], "ts", 1200, keep)


@query("e22_journal_pairs", f"SELECT event_id AS old, nxt AS new FROM (SELECT event_id, event_type, lead(event_id) OVER ({U}) AS nxt, lead(event_type) OVER ({U}) AS kind FROM events) WHERE event_type = 'view' AND kind = 'click'")
def e22(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    pairs = events(spark, d).select(F.col("event_id").alias("old"), "event_type", F.lead("event_id").over(w).alias("new"), F.lead("event_type").over(w).alias("kind"))
    return pairs.where("event_type = 'view' and kind = 'click'").select("old", "new")


@query("e23_boot_order", "SELECT user_id, count(*) FILTER (step < 0)::BIGINT AS steps_back FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY (event_id * 7) % 1009, event_id) AS step FROM events) GROUP BY 1")
def e23(spark, d):
    w = Window.partitionBy("user_id").orderBy((F.col("event_id") * 7) % 1009, "event_id")
    return events(spark, d).select("user_id", (micros("ts") - F.lag(micros("ts")).over(w)).alias("step")).groupBy("user_id").agg(F.count_if(F.col("step") < 0).alias("steps_back"))


@query("e24_still_in_place", "SELECT user_id FROM (SELECT user_id, arg_max(event_type, ts) AS a FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1) WHERE a = 'signup'")
def e24(spark, d):
    return S.still_in_place(events(spark, d), ["user_id"], "ts", "event_type", ["signup"], ["error"])


@query("e25_exposure", "SELECT user_id, min(epoch_us(ts)) FILTER (event_type = 'signup') AS effective_us, max(epoch_us(ts)) FILTER (event_type <> 'error') AS last_use_us, max(epoch_us(ts)) FILTER (event_type = 'error') AS action_us FROM events GROUP BY 1")
def e25(spark, d):
    kind, t = F.col("event_type"), micros("ts")
    return events(spark, d).groupBy("user_id").agg(F.min(F.when(kind == "signup", t)).alias("effective_us"), F.max(F.when(kind != "error", t)).alias("last_use_us"), F.max(F.when(kind == "error", t)).alias("action_us"))


@query("e26_reassemble", "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS digest, count(DISTINCT turn) = max(turn) + 1 AS complete FROM conversations GROUP BY 1")
def e26(spark, d):
    return S.reassemble(table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("e27_limit_verdict", "SELECT seat, bool_and(event_type = 'error') AS limited, max(epoch_us(ts)) AS until_us FROM (SELECT user_id % 20 AS seat, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id) GROUP BY 1")
def e27(spark, d):
    last = events(spark, d).groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type"), F.max("ts").alias("ts"))
    return last.groupBy((F.col("user_id") % 20).alias("seat")).agg(F.bool_and(F.col("event_type") == "error").alias("limited"), F.max(micros("ts")).alias("until_us"))


@query("f1_timeline_sort", "SELECT o_orderkey, o_orderdate IS NULL AS undated FROM orders ORDER BY o_orderdate, o_orderkey")
def f1(spark, d):
    return S.timeline_sort(table(spark, d, "orders"), "o_orderdate", ["o_orderkey"]).select("o_orderkey", F.col("o_orderdate").isNull().alias("undated"))


@query("f2_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::BIGINT AS place FROM lineitem) WHERE place <= 5")
def f2(spark, d):
    return S.top_k(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 5).select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("f3_rank_hosts", "SELECT o_custkey, round(sum(o_totalprice), 2) AS weight, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS reasons, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey)::BIGINT AS place FROM orders GROUP BY 1 QUALIFY place <= 100")
def f3(spark, d):
    w = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("weight"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("reasons"))
    return ranked(w, [F.desc("weight"), "o_custkey"], 100)


@query("f4_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def f4(spark, d):
    return S.paginate(table(spark, d, "part"), ["p_name", "p_partkey"], 20, 2).select("p_partkey", "p_name")


@query("f5_stratified_sample", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 3")
def f5(spark, d):
    return S.stratified_sample(table(spark, d, "documents"), "source", "doc_id", 3).select("source", "doc_id")


@query("g1_merge_timeline", "SELECT day, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*)::BIGINT AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, 'events' AS source FROM events UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d'), 'orders' FROM orders) GROUP BY 1")
def g1(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    rows = events(spark, d).select(day("ts"), F.lit("events").alias("source"), "user_id").unionByName(table(spark, d, "orders").select(day("o_orderdate"), F.lit("orders").alias("source")), allowMissingColumns=True)
    return rows.groupBy("day").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("n"))


@query("g2_shared", "SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS hosts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3")
def g2(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("hosts")).where("hosts >= 3")


@query("g3_difference", "SELECT 'gone' AS side, * FROM (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0 EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1) UNION ALL SELECT 'new', * FROM (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1 EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0)")
def g3(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    a, b = (o.where(F.col("o_orderkey") % 2 == k).drop("o_orderkey") for k in (0, 1))
    return a.exceptAll(b).select(F.lit("gone").alias("side"), "*").unionByName(b.exceptAll(a).select(F.lit("new").alias("side"), "*"))


@query("g4_distinct_first", "SELECT md5(line) AS line, min(doc_id) AS first FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def g4(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(F.md5("line").alias("line")).agg(F.min("doc_id").alias("first"))


@query("g5_distinct_events", "SELECT event_type, count(DISTINCT event_id)::BIGINT AS events, (count(*) - count(DISTINCT event_id))::BIGINT AS copies FROM (SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 4 = 0) GROUP BY 1")
def g5(spark, d):
    e = events(spark, d).select("event_id", "event_type")
    return e.unionByName(e.where("event_id % 4 = 0")).groupBy("event_type").agg(F.count_distinct("event_id").alias("events"), (F.count("*") - F.count_distinct("event_id")).alias("copies"))
