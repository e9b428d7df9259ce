"""Aggregations on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.operators import aggregates as A
from casewright.operators import trees as T
from casewright.operators.sweep import sweep
from casewright.operators.joins import micros
from casewright.plans.registry import query, table
from casewright.sources.scratch import keep


@query("d1_profile", "SELECT user_id, count(*)::BIGINT AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1")
def d1(spark, d):
    return A.profile_by(table(spark, d, "events"), ["user_id"], "ts")


VOLUME = "SELECT epoch_us(date_trunc('hour', ts)) AS bucket_us, count(*)::BIGINT AS n FROM events GROUP BY 1"


@query("d2_volume", VOLUME)
def d2(spark, d):
    return A.volume(table(spark, d, "events"), "ts", "hour")


@query("d2_busiest", f"{VOLUME} ORDER BY 2 DESC, 1 LIMIT 1")
def d2b(spark, d):
    return A.busiest(A.volume(table(spark, d, "events"), "ts", "hour"))


@query("d3_top_talkers", "SELECT l_suppkey, round(sum(l_quantity), 4) AS bytes, count(DISTINCT l_partkey)::BIGINT AS peers, row_number() OVER (ORDER BY round(sum(l_quantity), 4) DESC, l_suppkey)::BIGINT AS place FROM lineitem GROUP BY 1 QUALIFY place <= 1000")
def d3(spark, d):
    return A.top_talkers(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


@query("d4_rare_pairs", "SELECT l_suppkey, l_partkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) <= 1")
def d4(spark, d):
    return A.rare_pairs(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", 1)


@query("d4_lone_destinations", "SELECT o_custkey, min(o_orderpriority) AS only FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1")
def d4l(spark, d):
    return A.lone(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("d5_egress_rollup", "SELECT c_nationkey, o_orderpriority, count(*)::BIGINT AS requests, round(sum(l_quantity), 4) AS bytes, grouping(c_nationkey, o_orderpriority)::BIGINT AS level FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_nationkey, o_orderpriority)")
def d5(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    return rows.rollup("c_nationkey", "o_orderpriority").agg(F.count("*").alias("requests"), F.round(F.sum("l_quantity"), 4).alias("bytes"), F.grouping_id().alias("level"))


@query("d6_uploads", "SELECT l_suppkey, count(*) FILTER (l_quantity > 40 AND l_returnflag = 'N')::BIGINT AS uploads, round(coalesce(sum(l_quantity) FILTER (l_quantity > 40 AND l_returnflag = 'N'), 0), 4) AS bytes FROM lineitem GROUP BY 1")
def d6(spark, d):
    up = (F.col("l_quantity") > 40) & (F.col("l_returnflag") == "N")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(up).alias("uploads"), F.round(F.sum(F.when(up, F.col("l_quantity")).otherwise(0)), 4).alias("bytes"))


@query("d7_against_own_history", "WITH s AS (SELECT l_suppkey, year(l_shipdate) * 100 + month(l_shipdate) AS bucket, sum(l_quantity) AS b FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, median(b) AS mid FROM s GROUP BY 1), a AS (SELECT l_suppkey, median(abs(b - mid)) AS mad FROM s JOIN m USING (l_suppkey) GROUP BY 1) SELECT l_suppkey, bucket::BIGINT AS bucket, round(b, 4) AS bytes FROM s JOIN m USING (l_suppkey) JOIN a USING (l_suppkey) WHERE b > mid + 3 * mad")
def d7(spark, d):
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("long")
    return A.against_own_history(table(spark, d, "lineitem"), "l_suppkey", month, "l_quantity", 3, keep)


BEACON = """WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, count(*) AS k FROM events GROUP BY 1, 2), g AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM s),
    m AS (SELECT user_id, count(*) AS events, sum(k) - count(*) AS duplicates, median(gap) AS median_s, max(s) - min(s) AS span, arg_max(gap, s) AS final FROM g GROUP BY 1 HAVING count(*) >= 6),
    o AS (SELECT m.*, median(abs(gap - median_s)) AS mad_s, avg((abs(gap - median_s) <= 0.2 * median_s)::INT) AS share FROM g JOIN m USING (user_id) WHERE gap IS NOT NULL GROUP BY ALL)
    SELECT user_id, events::BIGINT AS events, duplicates::BIGINT AS duplicates, 0::BIGINT AS rejected, median_s, mad_s, round(mad_s / median_s, 4) AS mad_over_median, round(share, 4) AS share, round(events / (span / median_s + 1), 4) AS density, final > 4 * median_s AS long_final_gap,
        CASE WHEN median_s = 0 THEN 'unmeasurable' WHEN mad_s / median_s <= 0.1 AND share >= 0.8 THEN 'tight_cluster' WHEN mad_s / median_s <= 0.25 THEN 'clustered' WHEN mad_s / median_s <= 0.5 THEN 'loose_cluster' ELSE 'dispersed' END AS shape FROM o"""


@query("d8_beacon_score", BEACON)
def d8(spark, d):
    out = A.beacon_score(table(spark, d, "events"), ["user_id"], "ts", keep)
    return out.withColumns({c: F.round(c, 4) for c in ("share", "density", "mad_over_median")})


def islands_sql(keys: str, gap_s: int, source: str = "events") -> str:
    return f"SELECT {keys}, run::BIGINT AS run, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us, count(*)::BIGINT AS n FROM (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY ts) AS run FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {keys} ORDER BY ts) > {gap_s}000000 THEN 1 ELSE 0 END AS new FROM {source})) GROUP BY {keys}, run"


FLOWS = "SELECT user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CASE WHEN event_id % 3 = 0 THEN 1800 ELSE 86400 END * 1000000::BIGINT AS e, value AS b, event_id % 11 = 0 AS x FROM events"


@query("d9_merge_flows", f"WITH f AS ({FLOWS}), p AS (SELECT *, lag(s) OVER w AS ps, lag(e) OVER w AS pe, lag(x) OVER w AS px FROM f WINDOW w AS (PARTITION BY user_id, event_type ORDER BY s, e, b)), n AS (SELECT *, sum(CASE WHEN pe - ps >= 3600000000 AND NOT px AND s - pe <= 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY s, e, b ROWS UNBOUNDED PRECEDING) AS flow FROM p) SELECT user_id, event_type, flow::BIGINT AS flow, min(s) AS start_us, max(e) AS end_us, count(*)::BIGINT AS records, round(sum(b), 4) AS bytes, bool_or(x) AS ended FROM n GROUP BY 1, 2, 3")
def d9(spark, d):
    """Records of one flow that the exporter cut at its active timeout, put together; an end that was seen is an end."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    lasted = F.when(F.col("event_id") % 3 == 0, 1800).otherwise(86400).cast("long") * 1_000_000
    rows = table(spark, d, "events").select("user_id", "event_type", start.alias("s"), (start + lasted).alias("e"), F.col("value").alias("b"), (F.col("event_id") % 11 == 0).alias("x"))
    return A.merge_flows(rows, ["user_id", "event_type"], "s", "e", "b", F.col("x"), 3600, 6 * 3600, keep)


@query("d10_scan_detect", "SELECT l_suppkey, count(DISTINCT l_partkey)::BIGINT AS targets, count(*) FILTER (l_returnflag = 'R')::BIGINT AS failed FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 50")
def d10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("targets"), F.count_if(F.col("l_returnflag") == "R").alias("failed")).where("targets >= 50")


@query("d11_board_stats", "SELECT role, count(*)::BIGINT AS posts, count(DISTINCT conv_id)::BIGINT AS threads, sum(length(text))::BIGINT AS chars, min(length(text))::BIGINT AS shortest FROM conversations GROUP BY 1")
def d11(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("posts"), F.count_distinct("conv_id").alias("threads"), F.sum(F.length("text")).alias("chars"), F.min(F.length("text")).cast("long").alias("shortest"))


@query("d12_mentions", "WITH w AS (SELECT conv_id, turn, unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z]+'))) AS w FROM conversations), n AS (SELECT w, min(conv_id) AS named FROM (SELECT conv_id, w FROM w WHERE turn = 0 AND length(w) >= 6) GROUP BY 1 HAVING count(DISTINCT conv_id) = 1) SELECT w.conv_id AS who, n.named, count(DISTINCT turn)::BIGINT AS n FROM w JOIN n ON w.w = n.w AND w.conv_id <> n.named GROUP BY 1, 2")
def d12(spark, d):
    """Threads that use, as a whole word, a word by which just one thread opens."""
    said = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("w"))
    opens = said.where("turn = 0 and length(w) >= 6").groupBy("w").agg(F.min("conv_id").alias("named"), F.max("conv_id").alias("last")).where("named = last").drop("last")
    return said.join(opens, "w").where("conv_id <> named").groupBy(F.col("conv_id").alias("who"), "named").agg(F.count_distinct("turn").alias("n"))


@query("d13_artefacts", "SELECT p, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+[.][a-z]{2,}')) AS p FROM documents) WHERE length(p) >= 6 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def d13(spark, d):
    found = table(spark, d, "documents").select(F.explode(F.expr("regexp_extract_all(text, '[a-z]+[.][a-z]{2,}', 0)")).alias("p")).where("length(p) >= 6")
    return A.top_counts(found, "p", 10)


@query("d14_round_parts", "WITH s AS (SELECT o_orderpriority AS kind, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY 1), f AS (SELECT *, floor(v + 1e-9) AS f FROM s), r AS (SELECT *, v - f AS r, round(sum(v) OVER ()) - sum(f) OVER () AS extra FROM f) SELECT kind, (f + CASE WHEN row_number() OVER (ORDER BY r DESC, kind) <= extra THEN 1 ELSE 0 END)::BIGINT AS whole FROM r")
def d14(spark, d):
    sums = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg((F.sum("o_totalprice") / 1000).alias("v"))
    return A.round_parts(sums, "kind", "v", "kind")


@query("d15_context_audit", "WITH t AS (SELECT user_id, ts, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS climb FROM events) SELECT user_id, count(*)::BIGINT AS turns, round(max(value), 4) AS peak, round(arg_max(value, ts), 4) AS last, round(max(climb), 4) AS largest_climb, count(*) FILTER (climb < -200)::BIGINT AS compactions FROM t GROUP BY 1")
def d15(spark, d):
    climb = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts"))
    t = table(spark, d, "events").withColumn("climb", climb)
    return t.groupBy("user_id").agg(F.count("*").alias("turns"), F.round(F.max("value"), 4).alias("peak"), F.round(F.max_by("value", "ts"), 4).alias("last"), F.round(F.max("climb"), 4).alias("largest_climb"), F.count_if(F.col("climb") < -200).alias("compactions"))


@query("d16_skill_use", "SELECT event_type AS skill, count(*)::BIGINT AS loads, count(DISTINCT user_id)::BIGINT AS seats, (count(*) - count(DISTINCT user_id))::BIGINT AS reloads FROM events GROUP BY 1")
def d16(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("skill")).agg(F.count("*").alias("loads"), F.count_distinct("user_id").alias("seats"), (F.count("*") - F.count_distinct("user_id")).alias("reloads"))


@query("d17_top_counts", "SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def d17(spark, d):
    return A.top_counts(table(spark, d, "events"), "user_id", 20)


@query("d18_census", "SELECT c_mktsegment, count(*)::BIGINT AS agents, count(n)::BIGINT AS speaking, CASE WHEN count(n) = 0 THEN 'silent' WHEN count(n) < count(*) THEN 'partly' ELSE 'speaking' END AS verdict FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def d18(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    out = table(spark, d, "customer").join(n, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("*").alias("agents"), F.count("n").alias("speaking"))
    return out.withColumn("verdict", F.when(F.col("speaking") == 0, "silent").when(F.col("speaking") < F.col("agents"), "partly").otherwise("speaking"))


@query("d19_script_harvest", "SELECT md5(text) AS digest, count(*)::BIGINT AS uses, min(doc_id) AS first, (count(*) * (length(any_value(text)) - length(replace(any_value(text), chr(10), '')) + 1))::BIGINT AS score FROM documents GROUP BY 1 HAVING count(*) > 1")
def d19(spark, d):
    text_lines = F.length(F.any_value("text")) - F.length(F.replace(F.any_value("text"), F.lit("\n"), F.lit(""))) + 1
    out = table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("uses"), F.min("doc_id").alias("first"), (F.count("*") * text_lines).alias("score"))
    return out.where("uses > 1")


TREE = "SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"
SEARCHED = "SELECT 'c' || c_custkey AS node, 'object' AS how, CASE WHEN c_custkey % 7 = 0 THEN 'records rejected' END AS note FROM customer WHERE c_acctbal > 3000 UNION ALL SELECT 'n' || n_nationkey, 'container', CASE WHEN n_nationkey % 2 = 0 THEN 'stopped early' END FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'r4', 'container', NULL"


def places(spark, d):
    """Customers in nations in regions, and what was declared as searched: objects, and containers with all that lies in them."""
    name = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    tree = r.select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    tree = tree.unionByName(n.select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"))).unionByName(c.select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("parent")))
    objects = c.where("c_acctbal > 3000").select(name("c", "c_custkey").alias("node"), F.lit("object").alias("how"), F.when(F.col("c_custkey") % 7 == 0, "records rejected").alias("note"))
    held = n.where("n_nationkey % 5 = 0").select(name("n", "n_nationkey").alias("node"), F.lit("container").alias("how"), F.when(F.col("n_nationkey") % 2 == 0, "stopped early").alias("note"))
    return tree, objects.unionByName(held).unionByName(r.where("r_regionkey = 4").select(name("r", "r_regionkey").alias("node"), F.lit("container").alias("how"), F.lit(None).cast("string").alias("note")))


@query("d20_coverage", f"""WITH t AS ({TREE}), m AS ({SEARCHED}), up AS (SELECT t.node, t.node AS above FROM t UNION ALL SELECT t.node, t.parent FROM t WHERE parent IS NOT NULL UNION ALL SELECT t.node, u.parent FROM t JOIN t u ON u.node = t.parent WHERE u.parent IS NOT NULL),
    k AS (SELECT up.node, m.how, m.note FROM up JOIN m ON m.node = up.above AND (m.how = 'container' OR up.node = up.above)),
    b AS (SELECT node, bool_or(note IS NULL) AS whole, max(note) AS note, bool_or(how = 'object') AS o, bool_or(how = 'container') AS c, bool_or(how = 'object' AND note IS NULL) AS ow, bool_or(how = 'container' AND note IS NULL) AS cw, max(note) FILTER (how = 'object') AS n_o, max(note) FILTER (how = 'container') AS n_c FROM k GROUP BY 1),
    f AS (SELECT t.node, CASE WHEN o AND (NOT c OR ow > cw OR (ow = cw AND (ow OR n_o >= n_c))) THEN 'object' WHEN c THEN 'container' END AS how, coalesce(whole, false) AS whole, CASE WHEN whole THEN NULL ELSE note END AS note, t.node IN (SELECT parent FROM t WHERE parent IS NOT NULL) AS inner_ FROM t LEFT JOIN b USING (node)),
    s AS (SELECT up.above AS node, count(*) AS units, count(how) AS covered, count(*) FILTER (whole) AS full_, list_sort(list(DISTINCT note) FILTER (note IS NOT NULL)) AS notes FROM up JOIN f ON f.node = up.node WHERE NOT inner_ GROUP BY 1)
    SELECT s.node, f.how, units, covered, CASE WHEN full_ = units THEN 'complete' WHEN covered = 0 THEN 'none' ELSE 'partial' END AS cover, CASE WHEN full_ = units OR covered = 0 THEN '' ELSE concat_ws(';', nullif(array_to_string(notes, ';'), ''), CASE WHEN units > covered THEN (units - covered) || ' not searched' END) END AS reasons FROM s JOIN f ON f.node = s.node""")
def d20(spark, d):
    """Every object, and every container by the objects in it: searched wholly, in part and why, or not."""
    tree, searched = places(spark, d)
    return T.coverage(tree, "node", "parent", searched, False, keep).withColumn("reasons", F.array_join("reasons", ";"))


@query("d21_touch_coverage", "SELECT item_id, count(doc_id)::BIGINT AS touched, min(doc_id) AS first, CASE WHEN count(doc_id) = 0 THEN 'untouched' WHEN count(doc_id) = 1 THEN 'once' ELSE 'covered' END AS coverage FROM benchmark b LEFT JOIN (SELECT doc_id, text AS t FROM documents) d ON contains(d.t, b.text) GROUP BY 1")
def d21(spark, d):
    """Inputs, by their whole text, and the outputs that hold each; one that no output touches is named."""
    inputs = table(spark, d, "benchmark").select("item_id", "text")
    held = sweep(table(spark, d, "documents").select("doc_id", F.col("text").alias("t")), "doc_id", "t", inputs, "item_id", "text", keep).select("item_id", "doc_id").distinct()
    n = held.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    touched = F.coalesce("n", F.lit(0))
    return inputs.join(n, "item_id", "left").select("item_id", touched.alias("touched"), "first", F.when(touched == 0, "untouched").when(touched == 1, "once").otherwise("covered").alias("coverage"))


@query("d22_grounding", "WITH c AS (SELECT DISTINCT conv_id, turn, role, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM conversations), f AS (SELECT conv_id, w, min(turn) AS first FROM c GROUP BY 1, 2), j AS (SELECT DISTINCT doc_id AS conv_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents), g AS (SELECT c.conv_id, c.turn, c.w, f.first < c.turn AS said, j.w IS NOT NULL AS cited FROM c JOIN f USING (conv_id, w) LEFT JOIN j USING (conv_id, w) WHERE c.w <> '' AND c.role = 'assistant') SELECT conv_id, turn, count(*)::BIGINT AS words, count(*) FILTER (said)::BIGINT AS said, count(*) FILTER (cited AND NOT said)::BIGINT AS cited, CASE WHEN bool_and(said OR cited) THEN 'grounded' WHEN bool_or(said OR cited) THEN 'partly' ELSE 'ungrounded' END AS status FROM g GROUP BY 1, 2")
def d22(spark, d):
    """Each claim (an assistant's turn) by its words: said before it in the same conversation, or in the job that it cites, the document of the conversation's number."""
    split = lambda t: F.explode(F.array_distinct(F.split(t, "[ \\n]+"))).alias("w")
    turns = keep(table(spark, d, "conversations").select("conv_id", "turn", "role", split("text")).distinct())
    first = turns.groupBy("conv_id", "w").agg(F.min("turn").alias("first"))
    jobs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), split("text")).distinct().withColumn("hit", F.lit(True))
    claims = turns.where("role = 'assistant' and w <> ''").join(first, ["conv_id", "w"]).join(jobs, ["conv_id", "w"], "left")
    said, cited = F.col("first") < F.col("turn"), F.coalesce("hit", F.lit(False))
    out = claims.groupBy("conv_id", "turn").agg(F.count("*").alias("words"), F.count_if(said).alias("said"), F.count_if(cited & ~said).alias("cited"))
    found = F.col("said") + F.col("cited")
    return out.withColumn("status", F.when(found == F.col("words"), "grounded").when(found == 0, "ungrounded").otherwise("partly"))


@query("d23_answer_scoring", "SELECT lang, count(*) FILTER (regexp_matches(text, 'tion') AND NOT regexp_matches(text, '###'))::BIGINT AS found, count(*) FILTER (regexp_matches(text, '###'))::BIGINT AS contradicted, count(*) FILTER (NOT regexp_matches(text, 'tion') AND NOT regexp_matches(text, '###'))::BIGINT AS not_found FROM documents GROUP BY 1")
def d23(spark, d):
    yes, no = F.col("text").rlike("tion"), F.col("text").rlike("###")
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(yes & ~no).alias("found"), F.count_if(no).alias("contradicted"), F.count_if(~yes & ~no).alias("not_found"))


@query("d24_calibration", "SELECT level, count(*)::BIGINT AS n, round(avg(quality), 4) AS accuracy, round(avg(pow(p - quality, 2)), 4) AS brier FROM (SELECT quality, CASE WHEN n_chars > 2000 THEN 'high' WHEN n_chars > 500 THEN 'medium' ELSE 'low' END AS level, CASE WHEN n_chars > 2000 THEN 0.9 WHEN n_chars > 500 THEN 0.7 ELSE 0.4 END AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def d24(spark, d):
    level = F.when(F.col("n_chars") > 2000, "high").when(F.col("n_chars") > 500, "medium").otherwise("low")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("level", level)
    return A.calibration(rows, "level", "quality", {"high": 0.9, "medium": 0.7, "low": 0.4})


@query("d25_process_metrics", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::BIGINT AS closed, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')::BIGINT AS reversals, (SELECT count(*) FROM orders WHERE o_orderstatus = 'X' HAVING count(*) > 0)::BIGINT AS withdrawn")
def d25(spark, d):
    o = table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.nullif(F.count_if(F.col("o_orderstatus") == "X"), F.lit(0)).alias("withdrawn")).withColumn("_k", F.lit(1))
    rows = table(spark, d, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("reversals")).withColumn("_k", F.lit(1))
    return o.join(rows, "_k").drop("_k")


@query("d26_compare_runs", "SELECT coalesce(a.c, b.c) AS c, coalesce(a.n, 0)::BIGINT AS before, coalesce(b.n, 0)::BIGINT AS after FROM (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' GROUP BY 1) b ON a.c = b.c")
def d26(spark, d):
    early = F.col("o_orderdate") < "1998-06-01"
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after"))


@query("d27_parts_standing", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A')::BIGINT AS established, count(*) FILTER (l_returnflag = 'N')::BIGINT AS open, count(*) FILTER (l_returnflag = 'R')::BIGINT AS limited, bool_and(l_returnflag = 'A') AS all_established FROM lineitem GROUP BY 1")
def d27(spark, d):
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(flag == "A").alias("established"), F.count_if(flag == "N").alias("open"), F.count_if(flag == "R").alias("limited"), F.bool_and(flag == "A").alias("all_established"))


@query("d28_impact", "SELECT l_linestatus, l_returnflag, count(*)::BIGINT AS files, round(sum(l_quantity), 4) AS bytes, min(epoch_us(l_shipdate)) AS first_us, max(epoch_us(l_shipdate)) AS last_us FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)")
def d28(spark, d):
    return table(spark, d, "lineitem").rollup("l_linestatus", "l_returnflag").agg(F.count("*").alias("files"), F.round(F.sum("l_quantity"), 4).alias("bytes"), F.min(micros("l_shipdate")).alias("first_us"), F.max(micros("l_shipdate")).alias("last_us"))


@query("d29_flattening", "SELECT o_orderpriority, round(max(n) / sum(n), 4) AS share FROM (SELECT o_orderpriority, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def d29(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.count("*").alias("n"))
    return n.groupBy("o_orderpriority").agg(F.round(F.max("n") / F.sum("n"), 4).alias("share"))


@query("d30_finding_chains", "SELECT user_id, count(*)::BIGINT AS versions, arg_min(event_type, ts) AS first, arg_max(event_type, ts) AS last, round(min(value), 4) AS lowest, round(max(value), 4) AS highest FROM events GROUP BY 1")
def d30(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("versions"), F.min_by("event_type", "ts").alias("first"), F.max_by("event_type", "ts").alias("last"), F.round(F.min("value"), 4).alias("lowest"), F.round(F.max("value"), 4).alias("highest"))


@query("d31_op_census", "SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (value > 100)::BIGINT AS matched FROM events GROUP BY 1")
def d31(spark, d):
    return A.census(table(spark, d, "events"), ["event_type"], matched=F.count_if(F.col("value") > 100))


@query("d32_sensitive_index", "SELECT md5(text) AS digest, min(doc_id) AS first FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND text <> '' GROUP BY 1")
def d32(spark, d):
    marked = table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id").where("text <> ''")
    return marked.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first"))


@query("d33_classify_counts", "SELECT CASE WHEN regexp_matches(text, '[a-z0-9._]+@[a-z0-9.]+') THEN 'email' WHEN regexp_matches(text, '[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}') THEN 'address' WHEN regexp_matches(text, '[0-9]{9,}') THEN 'number' ELSE 'none' END AS class, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def d33(spark, d):
    t = F.col("text")
    kind = F.when(t.rlike("[a-z0-9._]+@[a-z0-9.]+"), "email").when(t.rlike("[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"), "address").when(t.rlike("[0-9]{9,}"), "number").otherwise("none")
    return table(spark, d, "documents").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("d34_baseline", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT hour(ts))::BIGINT AS hours FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1")
def d34(spark, d):
    before = table(spark, d, "events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return before.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count_distinct(F.hour("ts")).alias("hours"))
