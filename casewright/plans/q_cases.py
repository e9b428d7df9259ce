"""Composed detections over accounts, hosts and clouds; each answers a question with the rows that support it.

The event table plays the record: ``user_id`` the account or client, ``k`` of its props the host, service or
item, ``error`` a failure, refusal or removal, ``signup`` a logon, grant or start, ``purchase`` an act with bytes.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.operators import aggregates as A
from casewright.operators import families as Q
from casewright.operators import intervals as I
from casewright.operators import joins as J
from casewright.operators import predicates as P
from casewright.operators import scan as W
from casewright.operators import sequence as S
from casewright.operators.joins import micros
from casewright.operators.sweep import sweep
from casewright.plans.registry import query, table
from casewright.sources.scratch import keep

DAY = 86_400_000_000
K = "json_extract_string(props, '$.k')::BIGINT"
EV = f"(SELECT event_id, ts, epoch_us(ts) AS t, user_id, event_type, value, {K} AS k FROM events)"
CUT, CUT_SQL = "2024-01-15", "TIMESTAMP '2024-01-15'"


def ev(spark, d):
    return table(spark, d, "events").select("event_id", "ts", micros("ts").alias("t"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@query("p4_tampering", f"SELECT event_id, user_id, CASE k % 10 WHEN 0 THEN 'log_cleared' WHEN 1 THEN 'sensor_stopped' ELSE 'policy_changed' END AS act, nxt - t AS silence_us, coalesce(nxt - t > {DAY}, true) AS silent FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {EV}) WHERE event_type = 'error' AND k % 10 IN (0, 1, 2)")
def p4(spark, d):
    """Acts against logs and sensors, and how long the host then says nothing."""
    nxt = F.lead("t").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = ev(spark, d).withColumn("silence_us", nxt - F.col("t")).where("event_type = 'error'")
    act = P.flag_notable(F.col("k") % 10, {"log_cleared": [0], "sensor_stopped": [1], "policy_changed": [2]})
    return e.withColumn("act", act).where("act is not null").select("event_id", "user_id", "act", "silence_us", F.coalesce(F.col("silence_us") > DAY, F.lit(True)).alias("silent"))


@query("p6_ticket_anomalies", f"WITH b AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 HOURS PRECEDING AND CURRENT ROW) AS n, min(ts) OVER (PARTITION BY user_id, k) AS f FROM {EV}) SELECT user_id, k % 5 AS cipher, count(*)::BIGINT AS tickets, count(DISTINCT k)::BIGINT AS services, max(n)::BIGINT AS most, count(*) FILTER (event_type = 'error')::BIGINT AS refused, count(*) FILTER (f >= {CUT_SQL})::BIGINT AS to_new_services, k % 5 = 0 AND max(n) >= 2 AS weak_burst FROM b GROUP BY 1, 2")
def p6(spark, d):
    """Tickets of each client and cipher: services, the densest two hours, refusals, and tickets to services new to it."""
    e = S.bursts(ev(spark, d), ["user_id"], "ts", 7200, 1)
    new = S.first_seen(e, ["user_id"], "k", "ts", at(CUT)).select("user_id", "k", F.lit(1).alias("new"))
    e = e.join(new, ["user_id", "k"], "left").withColumn("cipher", F.col("k") % 5)
    out = e.groupBy("user_id", "cipher").agg(F.count("*").alias("tickets"), F.count_distinct("k").alias("services"), F.max("n").alias("most"), F.count_if(F.col("event_type") == "error").alias("refused"), F.count("new").alias("to_new_services"))
    return out.withColumn("weak_burst", (F.col("cipher") == 0) & (F.col("most") >= 2))


@query("p7_replication_requests", f"SELECT p.event_id, p.user_id, arg_max(s.event_id, s.t) AS logon, p.t - max(s.t) AS after_us FROM (SELECT * FROM {EV} WHERE event_type = 'purchase' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)) p LEFT JOIN (SELECT * FROM {EV} WHERE event_type = 'signup') s ON s.user_id = p.user_id AND s.t <= p.t GROUP BY p.event_id, p.user_id, p.t")
def p7(spark, d):
    """Replication asked for by accounts that are no controllers, with the logon before it."""
    e = ev(spark, d)
    controllers = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("user_id"))
    asked = J.misses(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), controllers, ["user_id"])
    logons = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("logon"))
    near = J.asof(asked, logons, ["user_id"], "ts", "logon", "prev")
    return near.select("event_id", "user_id", F.col("near_value").alias("logon"), (micros("ts") - micros("near_ts")).alias("after_us"))


FAILS = f"SELECT user_id, i, count(*) FILTER (f)::BIGINT AS failures, min(t) FILTER (f) AS first_us, max(t) FILTER (NOT f) AS success_us FROM (SELECT *, coalesce(sum((NOT f)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM (SELECT user_id, ts, t, event_type = 'error' AS f FROM {EV} WHERE event_type IN ('error', 'signup'))) GROUP BY 1, 2 HAVING count(*) FILTER (f) >= 2 AND count(*) FILTER (NOT f) > 0"


def guessed(spark, d):
    """Logons after two failures or more."""
    kind = F.col("event_type")
    return S.failures_then_success(ev(spark, d), ["user_id"], "ts", kind == "error", kind == "signup", 2)


@query("p10_initial_access", f"WITH g AS (SELECT user_id, min(success_us) AS g FROM ({FAILS}) GROUP BY 1), c AS (SELECT user_id, min(t) FILTER (event_type = 'click') AS c, min(t) FILTER (event_type = 'signup') AS s FROM {EV} GROUP BY 1) SELECT c.user_id, CASE WHEN g IS NOT NULL AND (c IS NULL OR g < c OR g = s) THEN 'brute_force' WHEN c < s THEN 'download_first' WHEN s IS NOT NULL THEN 'valid_credentials' ELSE 'undecided' END AS hypothesis, g AS guessed_us, c AS download_us, s AS logon_us FROM c LEFT JOIN g ON g.user_id = c.user_id")
def p10(spark, d):
    """How each host was entered, as a hypothesis with the three times that it rests on."""
    first = lambda k, n: F.min(F.when(F.col("event_type") == k, F.col("t"))).alias(n)
    seen = ev(spark, d).groupBy("user_id").agg(first("click", "download_us"), first("signup", "logon_us"))
    both = seen.join(guessed(spark, d).groupBy("user_id").agg(F.min("success_us").alias("guessed_us")), "user_id", "left")
    g, c, s = F.col("guessed_us"), F.col("download_us"), F.col("logon_us")
    said = F.when(g.isNotNull() & (c.isNull() | (g < c) | (g == s)), "brute_force").when(c < s, "download_first").when(s.isNotNull(), "valid_credentials").otherwise("undecided")
    return both.select("user_id", said.alias("hypothesis"), "guessed_us", "download_us", "logon_us")


@query("p11_program_execution", f"SELECT user_id, k AS program, count(*)::BIGINT AS n, string_agg(DISTINCT a, ',' ORDER BY a) AS artefacts, min(t) AS first_us, max(t) AS last_us FROM (SELECT *, CASE event_type WHEN 'click' THEN 'prefetch' WHEN 'purchase' THEN 'process' ELSE 'shortcut' END AS a FROM {EV} WHERE event_type IN ('click', 'purchase', 'view')) GROUP BY 1, 2")
def p11(spark, d):
    """Runs of each program by each account, and the kinds of record that say so."""
    e = ev(spark, d)
    sources = [e.where(F.col("event_type") == kind).withColumn("a", F.lit(name)) for kind, name in (("click", "prefetch"), ("purchase", "process"), ("view", "shortcut"))]
    rows = sources[0].unionByName(sources[1]).unionByName(sources[2])
    return A.census(rows, ["user_id", "k"], artefacts=F.array_join(F.array_sort(F.collect_set("a")), ","), first_us=F.min("t"), last_us=F.max("t")).withColumnRenamed("k", "program")


@query("p12_staging_bursts", f"WITH b AS (SELECT user_id, t, value, count(*) OVER w AS n, sum(value) OVER w AS s FROM {EV} WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOURS PRECEDING AND CURRENT ROW)), l AS (SELECT user_id, sum(value) AS lost FROM {EV} WHERE event_type = 'error' GROUP BY 1) SELECT user_id, max(n)::BIGINT AS most, count(*)::BIGINT AS files, round(max(s), 4) AS packed, round(coalesce(max(lost), 0), 4) AS lost, max(s) >= coalesce(max(lost), 0) AS explains_loss FROM b LEFT JOIN l USING (user_id) WHERE n >= 2 GROUP BY 1")
def p12(spark, d):
    """Bursts of gathering, the most packed in twelve hours, and whether that explains what was lost."""
    rows = ev(spark, d).where("event_type in ('click', 'purchase')")
    near = Window.partitionBy("user_id").orderBy("t").rangeBetween(-12 * 3_600_000_000, 0)
    hot = S.bursts(rows.withColumn("s", F.sum("value").over(near)), ["user_id"], "ts", 12 * 3600, 2)
    lost = ev(spark, d).where("event_type = 'error'").groupBy("user_id").agg(F.sum("value").alias("lost"))
    out = hot.groupBy("user_id").agg(F.max("n").alias("most"), F.count("*").alias("files"), F.max("s").alias("s")).join(lost, "user_id", "left").withColumn("lost", F.coalesce("lost", F.lit(0.0)))
    return out.select("user_id", "most", "files", F.round("s", 4).alias("packed"), F.round("lost", 4).alias("lost"), (F.col("s") >= F.col("lost")).alias("explains_loss"))


@query("p15_cleaning", f"SELECT user_id, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'cleared' END AS act, (t BETWEEN f AND l) AS inside, count(*)::BIGINT AS n, max(gap)::BIGINT AS longest_gap_us FROM (SELECT *, min(t) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS f, max(t) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS l, t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM {EV}) WHERE event_type IN ('error', 'signup') GROUP BY 1, 2, 3")
def p15(spark, d):
    """Deletions and cleared histories, inside and outside the window of the incident, with the longest gap before one."""
    e = S.intervals(ev(spark, d), ["user_id"], "ts", ["event_id"])
    window = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("t").alias("f"), F.max("t").alias("l"))
    acts = e.where("event_type in ('error', 'signup')").join(window, "user_id", "left")
    act = F.when(F.col("event_type") == "error", "deleted").otherwise("cleared")
    return acts.groupBy("user_id", act.alias("act"), F.col("t").between(F.col("f"), F.col("l")).alias("inside")).agg(F.count("*").alias("n"), F.max("gap_us").alias("longest_gap_us"))


HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


@query("p16_browser_history", f"SELECT {HOST} AS host, split_part(url, ':', 1) AS profile, count(*)::BIGINT AS visits, count(*) FILTER (regexp_matches(url, '[.]html([?#]|$)'))::BIGINT AS downloads, count(*) FILTER (contains(url, '?'))::BIGINT AS searches, count(DISTINCT url)::BIGINT AS urls FROM pages GROUP BY 1, 2")
def p16(spark, d):
    """Visits, downloads and searches of each profile and host."""
    p = table(spark, d, "pages").select("url", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.split_part("url", F.lit(":"), F.lit(1)).alias("profile"))
    return p.groupBy("host", "profile").agg(F.count("*").alias("visits"), F.count_if(F.col("url").rlike(r"[.]html([?#]|$)")).alias("downloads"), F.count_if(F.col("url").contains("?")).alias("searches"), F.count_distinct("url").alias("urls"))


@query("p17_history_gaps", f"WITH g AS (SELECT user_id, t AS from_us, lead(t) OVER (PARTITION BY user_id ORDER BY ts) AS to_us FROM {EV} WHERE event_type = 'view') SELECT g.user_id, from_us, to_us, count(e.event_id)::BIGINT AS survivors, CASE WHEN count(e.event_id) > 0 THEN 'cleared' ELSE 'idle' END AS reading FROM (SELECT * FROM g WHERE to_us - from_us > {2 * DAY}) g LEFT JOIN (SELECT * FROM {EV} WHERE event_type = 'click') e ON e.user_id = g.user_id AND e.t >= from_us AND e.t < to_us GROUP BY 1, 2, 3")
def p17(spark, d):
    """Gaps in the history with the cookies and cache entries that survive from inside them: none means nothing was done."""
    e = ev(spark, d)
    gaps = S.gaps(e.where("event_type = 'view'"), ["user_id"], "ts", 2 * 86_400)
    inside = I.interval_join(e.where("event_type = 'click'").select("user_id", "t"), gaps, ["user_id"], "t", "from_us", "to_us")
    out = gaps.join(inside.groupBy("user_id", "from_us").agg(F.count("*").alias("survivors")), ["user_id", "from_us"], "left").withColumn("survivors", F.coalesce("survivors", F.lit(0)))
    return out.withColumn("reading", F.when(F.col("survivors") > 0, "cleared").otherwise("idle"))


@query("p18_alternate_streams", "SELECT doc_id, source || ':' || coalesce(lang, '$DATA') AS stream, strlen(text)::BIGINT AS size, CASE WHEN regexp_matches(text, '<script|#!/') THEN 'script' WHEN regexp_matches(text, '^(PK|MZ|%PDF)') THEN 'binary' WHEN regexp_matches(text, 'https?://') THEN 'links' ELSE 'text' END AS kind, sha256(text) AS digest FROM documents WHERE strlen(text) > 0")
def p18(spark, d):
    """Every named stream with its size, digest and what it looks like."""
    docs = P.filter_files(table(spark, d, "documents").where(F.octet_length("text") > 0), "source")
    kinds = Q.target_outcomes(docs, "doc_id", [("script", F.col("text").rlike("<script|#!/")), ("binary", F.col("text").rlike("^(PK|MZ|%PDF)")), ("links", F.col("text").rlike("https?://")), ("text", F.lit(True))])
    named = docs.select("doc_id", F.concat_ws(":", "source", F.coalesce("lang", F.lit("$DATA"))).alias("stream"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"))
    return named.join(kinds.withColumnRenamed("state", "kind"), "doc_id")


@query("p20_destruction", f"WITH r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY ts) > 86400000000 THEN 1 ELSE 0 END AS new FROM {EV} WHERE event_type = 'error')) SELECT user_id, run::BIGINT AS run, min(t) AS start_us, max(t) AS end_us, count(*)::BIGINT AS acts, count(DISTINCT k)::BIGINT AS names, count(*) FILTER (k % 3 = 0)::BIGINT AS overwritten, count(*) FILTER (k % 3 = 1)::BIGINT AS renamed, CASE WHEN count(*) FILTER (k % 3 = 0) > 0 THEN 'wiped' WHEN count(*) FILTER (k % 3 = 1) = count(*) THEN 'moved' ELSE 'deleted' END AS reading FROM r GROUP BY 1, 2 HAVING count(*) >= 2")
def p20(spark, d):
    """Bursts of deletions told apart by their reasons: wiped, merely moved, or deleted."""
    acts = A.merge_runs(ev(spark, d).where("event_type = 'error'"), ["user_id"], "ts", 86_400)
    reason = P.flag_notable(F.col("k") % 3, {"overwritten": [0], "renamed": [1], "deleted": [2]})
    out = acts.withColumn("reason", reason).groupBy("user_id", "run").agg(
        F.min("t").alias("start_us"), F.max("t").alias("end_us"), F.count("*").alias("acts"), F.count_distinct("k").alias("names"),
        *(F.count_if(F.col("reason") == r).alias(r) for r in ("overwritten", "renamed")),
    )
    return out.where("acts >= 2").withColumn("reading", F.when(F.col("overwritten") > 0, "wiped").when(F.col("renamed") == F.col("acts"), "moved").otherwise("deleted"))


@query("p21_encryption_scope", "WITH f AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R')::BIGINT AS encrypted, count(*) FILTER (l_returnflag <> 'R')::BIGINT AS skipped, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 2) AS bytes, min(epoch_us(l_shipdate)) FILTER (l_returnflag = 'R') AS first_us, max(epoch_us(l_shipdate)) FILTER (l_returnflag = 'R') AS last_us FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey, max(n)::BIGINT AS most_a_day FROM (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) GROUP BY 1) SELECT f.*, coalesce(most_a_day, 0)::BIGINT AS most_a_day FROM f LEFT JOIN r USING (l_suppkey)")
def p21(spark, d):
    """Files renamed and left alone in each directory, bytes, first and last, and the highest rate."""
    li = table(spark, d, "lineitem")
    hit = F.col("l_returnflag") == "R"
    when = F.when(hit, micros("l_shipdate"))
    scope = li.groupBy("l_suppkey").agg(F.count_if(hit).alias("encrypted"), F.count_if(~hit).alias("skipped"), F.round(F.sum(F.when(hit, F.col("l_quantity")).otherwise(0.0)), 2).alias("bytes"), F.min(when).alias("first_us"), F.max(when).alias("last_us"))
    rate = li.where(hit).groupBy("l_suppkey", "l_shipdate").agg(F.count("*").alias("n")).groupBy("l_suppkey").agg(F.max("n").alias("most_a_day"))
    return scope.join(rate, "l_suppkey", "left").withColumn("most_a_day", F.coalesce("most_a_day", F.lit(0)))


def _next_sql(left: str, kind: str, name: str, keep: str) -> str:
    return f"SELECT {keep}, arg_min(n.event_id, n.t) AS {name}, min(n.t) AS {name}_us FROM {left} l LEFT JOIN (SELECT * FROM {EV} WHERE event_type = '{kind}') n ON n.user_id = l.user_id AND n.t >= l.at GROUP BY ALL"


_OPEN = _next_sql(f"(SELECT event_id AS message, user_id, t AS at FROM {EV} WHERE event_type = 'view' AND k % 4 = 0)", "click", "opened", "l.message, l.user_id")


@query("p25_message_to_process", f"WITH o AS ({_OPEN}) SELECT message, user_id, opened, process FROM (" + _next_sql("(SELECT message, user_id, opened, opened_us AS at FROM o WHERE opened IS NOT NULL)", "purchase", "process", "l.message, l.user_id, l.opened") + ")")
def p25(spark, d):
    """A message, the next thing its reader opened, and the first process after that."""
    e = ev(spark, d)
    side = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "ts", "event_id")
    messages = e.where("event_type = 'view' and k % 4 = 0").select(F.col("event_id").alias("message"), "user_id", "ts")
    opened = J.asof(messages, side("click"), ["user_id"], "ts", "event_id", "next").where("near_ts is not null")
    opened = opened.select("message", "user_id", F.col("near_value").alias("opened"), F.col("near_ts").alias("ts"))
    return J.asof(opened, side("purchase"), ["user_id"], "ts", "event_id", "next").select("message", "user_id", "opened", F.col("near_value").alias("process"))


@query("p26_ssh_guessing", f"SELECT f.user_id, f.failures, f.first_us, f.success_us, s.event_id AS accepted, md5(s.k::VARCHAR) AS fingerprint, (SELECT count(*) FROM {EV} e WHERE e.event_type = 'signup' AND e.k = s.k)::BIGINT AS uses FROM ({FAILS}) f JOIN (SELECT * FROM {EV} WHERE event_type = 'signup') s ON s.user_id = f.user_id AND s.t = f.success_us")
def p26(spark, d):
    """Runs of failures that end in a logon, with the key of that logon and how often the key is used at all."""
    logons = ev(spark, d).where("event_type = 'signup'")
    keys = logons.groupBy("k").agg(F.count("*").alias("uses"))
    accepted = logons.join(keys, "k").select("user_id", F.col("t").alias("success_us"), F.col("event_id").alias("accepted"), F.md5(F.col("k").cast("string")).alias("fingerprint"), "uses")
    return guessed(spark, d).join(accepted, ["user_id", "success_us"]).select("user_id", "failures", "first_us", "success_us", "accepted", "fingerprint", "uses")


@query("p27_privilege_use", f"SELECT user_id, 'pts/' || (k % 4) AS tty, CASE WHEN event_type = 'error' THEN 'refused' ELSE 'run' END AS outcome, count(*)::BIGINT AS n, count(DISTINCT 'cmd-' || k)::BIGINT AS commands, min(t) AS first_us FROM {EV} WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2, 3")
def p27(spark, d):
    """Privileged commands by account and terminal, run and refused; a hex-encoded command line is decoded first."""
    e = ev(spark, d).where("event_type in ('purchase', 'error')")
    line = F.format_string("sudo: user=%d TTY=pts/%d outcome=%s COMMAND=%s", "user_id", F.col("k") % 4, "event_type", F.hex(F.concat(F.lit("cmd-"), F.col("k").cast("string"))))
    part = lambda p: F.regexp_extract("line", p, 1)
    rows = e.select("t", line.alias("line")).select("t", part(r"user=(\d+)").cast("long").alias("user_id"), part(r"TTY=(\S+)").alias("tty"), part(r"outcome=(\S+)").alias("o"), F.decode(F.unhex(part(r"COMMAND=([0-9A-F]+)")), "UTF-8").alias("command"))
    ok = P.outcome(F.col("o"), ["purchase"], ["error"])
    return rows.groupBy("user_id", "tty", F.when(ok, "run").otherwise("refused").alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("command").alias("commands"), F.min("t").alias("first_us"))


@query("p28_started_in_window", f"WITH f AS (SELECT user_id, k, min(t) AS first_us, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'signup')::BIGINT AS starts FROM {EV} GROUP BY 1, 2) SELECT user_id, k AS unit, first_us, n, starts FROM f WHERE first_us >= epoch_us({CUT_SQL}) AND first_us < epoch_us(TIMESTAMP '2024-01-22')")
def p28(spark, d):
    """Units that a host starts for the first time in the window, with all their later runs."""
    e = ev(spark, d)
    new = S.first_seen(e, ["user_id"], "k", "ts", at(CUT)).where(F.col("first_us") < micros(at("2024-01-22")))
    runs = e.groupBy("user_id", "k").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "signup").alias("starts"))
    return new.join(runs, ["user_id", "k"]).withColumnRenamed("k", "unit")


@query("p29_clock_jumps", f"WITH g AS (SELECT o_custkey, epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders) SELECT o_custkey, count(*)::BIGINT AS lines, count(*) FILTER (g < 0)::BIGINT AS back, count(*) FILTER (g > {400 * DAY})::BIGINT AS ahead, coalesce(-min(g) FILTER (g < 0), 0)::BIGINT AS furthest_back_us FROM g GROUP BY 1")
def p29(spark, d):
    """Lines of each host that run backwards in file order, and leaps ahead."""
    gap = micros("o_orderdate") - F.lag(micros("o_orderdate")).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    g = table(spark, d, "orders").select("o_custkey", gap.alias("g"))
    return g.groupBy("o_custkey").agg(F.count("*").alias("lines"), F.count_if(F.col("g") < 0).alias("back"), F.count_if(F.col("g") > 400 * DAY).alias("ahead"), F.coalesce(-F.min(F.when(F.col("g") < 0, F.col("g"))), F.lit(0)).alias("furthest_back_us"))


@query("p31_command_history", "SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN conv_id * 1000 + turn END IGNORE NULLS) OVER w AS at_s, CASE WHEN turn % 3 = 0 THEN 'stated' WHEN last_value(CASE WHEN turn % 3 = 0 THEN turn END IGNORE NULLS) OVER w IS NULL THEN 'unknown' ELSE 'not_before' END AS basis, (count(*) OVER w)::BIGINT AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def p31(spark, d):
    """Commands in file order; one without a time is not before the last that has one."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    stated = F.col("turn") % 3 == 0
    last = F.last(F.when(stated, F.col("conv_id") * 1000 + F.col("turn")), ignorenulls=True).over(w)
    basis = F.when(stated, "stated").when(last.isNull(), "unknown").otherwise("not_before")
    return table(spark, d, "conversations").select("conv_id", "turn", last.alias("at_s"), basis.alias("basis"), F.count("*").over(w).alias("place"))


@query("p32_container_reach", "WITH w AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A'), m AS (SELECT DISTINCT l_suppkey AS c FROM lineitem WHERE l_discount >= 0.1) SELECT w.c AS container, count(*)::BIGINT AS written, count(h.p)::BIGINT AS on_host, CASE WHEN count(h.p) = 0 THEN 'contained' WHEN max(m.c) IS NOT NULL THEN 'reached' ELSE 'unexplained' END AS reach FROM w LEFT JOIN h ON h.p = w.p LEFT JOIN m ON m.c = w.c GROUP BY 1")
def p32(spark, d):
    """Paths each container wrote, those that the host changed too, and whether a mount explains them."""
    li = table(spark, d, "lineitem")
    written = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("container"), F.col("l_partkey").alias("p")).distinct()
    host = li.where("l_linestatus = 'F' and l_returnflag = 'A'").select(F.col("l_partkey").alias("p")).distinct().withColumn("host", F.lit(True))
    mounts = li.where("l_discount >= 0.1").select(F.col("l_suppkey").alias("container")).distinct().withColumn("mount", F.lit(True))
    both = written.join(host, "p", "left").groupBy("container").agg(F.count("*").alias("written"), F.count("host").alias("on_host")).join(mounts, "container", "left")
    return both.select("container", "written", "on_host", F.when(F.col("on_host") == 0, "contained").when(F.col("mount"), "reached").otherwise("unexplained").alias("reach"))


_BEATS = f"(SELECT user_id, s, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM (SELECT DISTINCT user_id, t // 1000000 AS s FROM {EV} WHERE event_type IN ('view', 'click')))"


@query("p33_miner", f"WITH m AS (SELECT user_id, count(*)::BIGINT AS connections, median(gap) AS every_s FROM {_BEATS} GROUP BY 1 HAVING count(*) >= 8), o AS (SELECT user_id, median(abs(gap - every_s)) AS spread_s FROM {_BEATS} JOIN m USING (user_id) WHERE gap IS NOT NULL GROUP BY 1), l AS (SELECT user_id, count(*)::BIGINT AS busy_hours, max(n)::BIGINT AS busiest FROM (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS n FROM {EV} GROUP BY 1, 2) GROUP BY 1) SELECT user_id, connections, every_s, spread_s, busy_hours, busiest FROM m JOIN o USING (user_id) JOIN l USING (user_id)")
def p33(spark, d):
    """How regularly each host calls the pool, and the hours its processor was busy."""
    e = ev(spark, d)
    beat = A.beacon_score(e.where("event_type in ('view', 'click')"), ["user_id"], "ts", keep, 8).select("user_id", F.col("events").alias("connections"), F.col("median_s").alias("every_s"), F.col("mad_s").alias("spread_s"))
    load = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("busy_hours"), F.max("n").alias("busiest"))
    return beat.join(load, "user_id")


@query("p35_injected_regions", f"SELECT l_orderkey AS pid, o_custkey AS parent, count(*)::BIGINT AS regions, round(sum(l_quantity), 2) AS bytes, coalesce(max(n), 0)::BIGINT AS connections FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT user_id, count(*) AS n FROM {EV} WHERE event_type = 'click' GROUP BY 1) ON user_id = o_custkey WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1, 2")
def p35(spark, d):
    """Flagged memory regions by process, with its parent and the connections of that."""
    flagged = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("pid")).agg(F.count("*").alias("regions"), F.round(F.sum("l_quantity"), 2).alias("bytes"))
    tree = table(spark, d, "orders").select(F.col("o_orderkey").alias("pid"), F.col("o_custkey").alias("parent"))
    net = ev(spark, d).where("event_type = 'click'").groupBy(F.col("user_id").alias("parent")).agg(F.count("*").alias("connections"))
    return flagged.join(tree, "pid").join(net, "parent", "left").withColumn("connections", F.coalesce("connections", F.lit(0)))


SHAPES = {"url": r"https?://[A-Za-z0-9./_-]+", "email": r"[A-Za-z0-9.]+@[A-Za-z0-9-]+[.][A-Za-z]+", "ipv4": r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "key": r"[A-Z]{4}[A-Z0-9]{12,}"}


@query("p38_config_extraction", "SELECT kind, CASE WHEN kind = 'key' THEN md5(v) ELSE v END AS value, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS documents, min(doc_id) AS first FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS v FROM documents" for k, p in SHAPES.items()) + ") GROUP BY 1, 2")
def p38(spark, d):
    """Addresses and key material named in samples; key material as a digest only."""
    from casewright.operators.texts import features

    found = features(table(spark, d, "documents"), "doc_id", "text", SHAPES)
    value = F.when(F.col("kind") == "key", F.md5("value")).otherwise(F.col("value"))
    return found.groupBy("kind", value.alias("value")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first"))


@query("p39_script_layers", "SELECT conv_id, turn, unnest([1, 2, 3])::BIGINT AS stage, unnest(['base64', 'hex', 'plain']) AS made_by, unnest([sha256(to_base64(encode(hex(encode(text))))), sha256(hex(encode(text))), sha256(text)]) AS digest FROM conversations WHERE text IS NOT NULL")
def p39(spark, d):
    """Each layer of an encoded script: what it is made by, and its digest, as it unwinds."""
    coded = F.regexp_replace(F.base64(F.hex(F.encode("text", "UTF-8")).cast("binary")), r"\s", "")
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", coded.alias("one"))
    rows = rows.withColumn("two", F.unbase64("one").cast("string")).withColumn("three", F.decode(F.unhex("two"), "UTF-8"))
    stages = [F.struct(F.lit(i).cast("long").alias("stage"), F.lit(by).alias("made_by"), F.sha2(c, 256).alias("digest")) for i, by, c in ((1, "base64", "one"), (2, "hex", "two"), (3, "plain", "three"))]
    return rows.select("conv_id", "turn", F.explode(F.array(*stages)).alias("s")).select("conv_id", "turn", "s.*")


@query("p40_document_relations", "SELECT md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS template, count(*)::BIGINT AS documents, count(DISTINCT source)::BIGINT AS authors, min(doc_id) AS first, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) >= 2")
def p40(spark, d):
    """Documents that are alike but for numbers, as one template, with the authors that share it."""
    docs = table(spark, d, "documents").where("text <> ''").withColumn("template", F.md5(F.regexp_replace("text", "[0-9]+", "#")))
    out = docs.groupBy("template").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("authors"), F.min("doc_id").alias("first"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return out.where("documents >= 2").withColumn("langs", F.when(F.col("langs") != "", F.col("langs")))


@query("p41_carvings", "WITH h AS (SELECT doc_id, name, strlen(substring(text, 1, o::INT - 1))::BIGINT AS \"at\", text FROM (SELECT doc_id, name, sig, text, unnest(range(1, length(text) - length(sig) + 2)) AS o FROM documents, (VALUES ('link', '://'), ('mail', '@'), ('list', '- ')) s(name, sig) WHERE contains(text, sig)) WHERE substring(text, o::INT, length(sig)) = sig) SELECT h.doc_id, name, h.\"at\", coalesce(lead(h.\"at\") OVER (PARTITION BY h.doc_id, name ORDER BY h.\"at\"), strlen(text)) - h.\"at\" AS size, epoch_us(ts) AS dated_us, row_number() OVER (PARTITION BY name ORDER BY ts NULLS LAST, h.doc_id, h.\"at\") AS place FROM h LEFT JOIN events ON event_id = h.doc_id")
def p41(spark, d):
    """Every hit of each signature in each block, up to the next one, and its place in time among all of its kind."""
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    marks = spark.createDataFrame([("link", "://"), ("mail", "@"), ("list", "- ")], "name string, mark string").select("name", F.encode("mark", "UTF-8").alias("mark"))
    hits = sweep(docs, "doc_id", "raw", marks, "name", "mark", keep).select("doc_id", "name", (F.col("at") - 1).alias("at"))
    hits = hits.join(docs.select("doc_id", F.length("raw").cast("long").alias("whole")), "doc_id")
    end = F.lead("at").over(Window.partitionBy("doc_id", "name").orderBy("at"))
    dated = hits.withColumn("size", F.coalesce(end, "whole") - F.col("at")).join(table(spark, d, "events").select(F.col("event_id").alias("doc_id"), micros("ts").alias("dated_us")), "doc_id", "left")
    order = ["undated", "dated_us", "doc_id", "at"]
    # three kinds, so each is larger than a task
    rows = W.ranged(dated.withColumn("undated", F.col("dated_us").isNull()), ["name"], order, keep)
    return W.scan(rows, ["name"], order, number="place").select("doc_id", "name", "at", "size", "dated_us", "place")


_LAT, _LON = "(event_id * 37) % 200 - 100", "(event_id * 53) % 360 - 180"


@query("p43_locations", f"SELECT user_id, event_type AS source, count(*)::BIGINT AS claims, count(*) FILTER (abs({_LAT}) <= 90)::BIGINT AS valid, min({_LAT}) FILTER (abs({_LAT}) <= 90)::BIGINT AS south, max({_LAT}) FILTER (abs({_LAT}) <= 90)::BIGINT AS north, min(t) AS first_us, max(t) AS last_us FROM {EV} GROUP BY 1, 2")
def p43(spark, d):
    """Where each device was said to be, by source; claims of one source never stand for another's."""
    e = ev(spark, d).withColumns({"lat": F.expr(_LAT), "lon": F.expr(_LON)})
    fine = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    lat = F.when(fine, F.col("lat"))
    return A.census(e, ["user_id", "event_type"], valid=F.count_if(fine), south=F.min(lat), north=F.max(lat), first_us=F.min("t"), last_us=F.max("t")).withColumnsRenamed({"event_type": "source", "n": "claims"})


@query("p44_application_use", f"WITH u AS (SELECT k, user_id, min(t) FILTER (event_type = 'signup') AS installed_us, min(t) AS first_us, max(t) AS last_us, count(*) AS n, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days, arg_max(event_type, t) = 'error' AS removed FROM {EV} GROUP BY 1, 2) SELECT k AS app, count(*)::BIGINT AS devices, count(installed_us)::BIGINT AS installs, sum(n)::BIGINT AS uses, sum(days)::BIGINT AS device_days, count(*) FILTER (first_us < installed_us)::BIGINT AS used_before_install, count(*) FILTER (removed)::BIGINT AS removed, min(first_us) AS first_us, max(last_us) AS last_us FROM u GROUP BY 1")
def p44(spark, d):
    """Installs of each application, its use over time, and devices from which it is gone."""
    e = ev(spark, d)
    u = e.groupBy("k", "user_id").agg(F.min(F.when(F.col("event_type") == "signup", F.col("t"))).alias("installed"), F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"), (F.max_by("event_type", "t") == "error").alias("gone"))
    return u.groupBy(F.col("k").alias("app")).agg(F.count("*").alias("devices"), F.count("installed").alias("installs"), F.sum("n").alias("uses"), F.sum("days").alias("device_days"), F.count_if(F.col("first") < F.col("installed")).alias("used_before_install"), F.count_if("gone").alias("removed"), F.min("first").alias("first_us"), F.max("last").alias("last_us"))


@query("p45_download_provenance", f"SELECT page_id, {HOST} AS origin, split_part(url, ':', 1) AS agent, min(page_id) OVER (PARTITION BY {HOST}) AS first_from_origin, (count(*) OVER (PARTITION BY {HOST}))::BIGINT AS from_origin, md5(html) AS digest FROM pages")
def p45(spark, d):
    """Each download with its origin, the agent that fetched it, and what else came from there."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("origin"), F.split_part("url", F.lit(":"), F.lit(1)).alias("agent"), F.md5("html").alias("digest"))
    known = p.groupBy("origin").agg(F.min("page_id").alias("first_from_origin"), F.count("*").alias("from_origin"))
    return p.join(known, "origin")


_STEPS = (("view", "recon"), ("click", "exploit"), ("signup", "reach"), ("purchase", "exfil"))


def _chain_sql() -> str:
    sql = f"SELECT user_id, min(t) FILTER (event_type = 'view') AS recon_us FROM {EV} GROUP BY 1"
    done = ["recon_us"]
    for kind, name in _STEPS[1:]:
        kept = ", ".join(f"c.{x}" for x in done)
        sql = f"SELECT c.user_id, {kept}, min(e.t) AS {name}_us FROM ({sql}) c LEFT JOIN {EV} e ON e.user_id = c.user_id AND e.event_type = '{kind}' AND e.t > c.{done[-1]} GROUP BY c.user_id, {kept}"
        done.append(f"{name}_us")
    return f"SELECT *, CASE WHEN exfil_us IS NOT NULL THEN 'exfil' WHEN reach_us IS NOT NULL THEN 'reach' WHEN exploit_us IS NOT NULL THEN 'exploit' WHEN recon_us IS NOT NULL THEN 'recon' ELSE 'none' END AS furthest FROM ({sql})"


@query("p46_changes_in_window", "SELECT l_suppkey AS directory, l_returnflag || l_linestatus AS change, count(*)::BIGINT AS files, round(sum(l_quantity), 2) AS bytes, min(epoch_us(l_shipdate)) AS first_us, max(epoch_us(l_shipdate)) AS last_us, count(DISTINCT l_orderkey)::BIGINT AS actors FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate < TIMESTAMP '1997-04-01' GROUP BY 1, 2")
def p46(spark, d):
    """Changes inside the window by directory and kind."""
    rows = P.time_window(table(spark, d, "lineitem"), "l_shipdate", "1997-03-01", "1997-03-31").withColumn("change", F.concat("l_returnflag", "l_linestatus"))
    out = A.census(rows, ["l_suppkey", "change"], bytes=F.round(F.sum("l_quantity"), 2), first_us=F.min(micros("l_shipdate")), last_us=F.max(micros("l_shipdate")), actors=F.count_distinct("l_orderkey"))
    return out.withColumnsRenamed({"l_suppkey": "directory", "n": "files"})


@query("p47_attack_chain", _chain_sql())
def p47(spark, d):
    """For each client the first time of each step after the step before, and the furthest step."""
    e = ev(spark, d).select("user_id", "event_type", "t")
    per, before = Window.partitionBy("user_id"), None
    for kind, name in _STEPS:
        here = F.col("event_type") == kind
        e = e.withColumn(f"{name}_us", F.min(F.when(here if before is None else here & (F.col("t") > F.col(before)), F.col("t"))).over(per))
        before = f"{name}_us"
    times = [f"{name}_us" for _, name in _STEPS]
    out = e.groupBy("user_id").agg(*(F.first(c).alias(c) for c in times))
    return out.withColumn("furthest", F.coalesce(*(F.when(F.col(f"{name}_us").isNotNull(), F.lit(name)) for _, name in reversed(_STEPS)), F.lit("none")))


@query("p48_vpn_anomalies", f"WITH a AS (SELECT user_id, count(*)::BIGINT AS guessed FROM ({FAILS}) GROUP BY 1), b AS (SELECT user_id, count(*)::BIGINT AS sessions, count(*) FILTER (hour(ts) < 6)::BIGINT AS at_night, sum((n2 IS NOT NULL AND n2 < t + 28800000000)::INT)::BIGINT AS overlapping FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY ts) AS n2 FROM {EV} WHERE event_type = 'signup') GROUP BY 1), c AS (SELECT user_id, count(*)::BIGINT AS new_sources FROM (SELECT user_id, k FROM {EV} GROUP BY 1, 2 HAVING min(ts) >= {CUT_SQL}) GROUP BY 1) SELECT user_id, sessions, at_night, overlapping, coalesce(guessed, 0)::BIGINT AS guessed, coalesce(new_sources, 0)::BIGINT AS new_sources FROM b LEFT JOIN a USING (user_id) LEFT JOIN c USING (user_id)")
def p48(spark, d):
    """Sessions of each account: at night, open at once (for eight hours), after guessing, and from new sources."""
    e = ev(spark, d)
    nxt = F.lead("t").over(Window.partitionBy("user_id").orderBy("ts"))
    s = e.where("event_type = 'signup'").withColumn("n", nxt)
    own = s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.count_if(F.hour("ts") < 6).alias("at_night"), F.count_if(F.col("n") < F.col("t") + 8 * 3_600_000_000).alias("overlapping"))
    new = S.first_seen(e, ["user_id"], "k", "ts", at(CUT)).groupBy("user_id").agg(F.count("*").alias("new_sources"))
    out = own.join(guessed(spark, d).groupBy("user_id").agg(F.count("*").alias("guessed")), "user_id", "left").join(new, "user_id", "left")
    return out.select("user_id", "sessions", "at_night", "overlapping", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("guessed", "new_sources")))


@query("p49_dns_tunnelling", f"WITH h AS (SELECT {HOST} AS h FROM pages), p AS (SELECT h, regexp_extract(h, '([^.]+[.][^.]+)$', 1) AS domain, strlen(split_part(h, '.', 1)) AS first, strlen(h) - strlen(replace(h, '.', '')) + 1 AS labels FROM h) SELECT domain, count(*)::BIGINT AS queries, count(DISTINCT h)::BIGINT AS names, max(first)::BIGINT AS longest_label, max(labels)::BIGINT AS most_labels, count(DISTINCT h) > 2 AND max(labels) > 2 AS channel, domain NOT IN ('example.com', 'example.net') AS past_resolver FROM p GROUP BY 1")
def p49(spark, d):
    """Names and queries of each domain, the shape of a channel, and domains that the resolver never saw."""
    h = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("h"))
    p = h.select("h", F.regexp_extract("h", r"([^.]+[.][^.]+)$", 1).alias("domain"), F.octet_length(F.split_part("h", F.lit("."), F.lit(1))).cast("long").alias("first"), F.size(F.split("h", r"\.")).cast("long").alias("labels"))
    out = p.groupBy("domain").agg(F.count("*").alias("queries"), F.count_distinct("h").alias("names"), F.max("first").alias("longest_label"), F.max("labels").alias("most_labels"))
    seen = spark.createDataFrame([("example.com",), ("example.net",)], "domain string")
    past = J.misses(out.select("domain"), seen, ["domain"]).withColumn("past_resolver", F.lit(True))
    return out.withColumn("channel", (F.col("names") > 2) & (F.col("most_labels") > 2)).join(past, "domain", "left").withColumn("past_resolver", F.coalesce("past_resolver", F.lit(False)))


@query("p50_certificates", f"SELECT l_partkey AS certificate, count(DISTINCT l_suppkey)::BIGINT AS servers, count(*) FILTER (l_returnflag = 'R')::BIGINT AS failed, ((max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate))) // {DAY})::BIGINT AS days, count(DISTINCT l_suppkey) > 1 AS shared, max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate)) < {30 * DAY} AS short_lived FROM lineitem GROUP BY 1")
def p50(spark, d):
    """Certificates by the servers that show them, failed validations and the time they are seen."""
    li = table(spark, d, "lineitem").withColumn("ok", P.outcome(F.col("l_returnflag"), ["A", "N"], ["R"]))
    span = F.max(micros("l_shipdate")) - F.min(micros("l_shipdate"))
    return li.groupBy(F.col("l_partkey").alias("certificate")).agg(F.count_distinct("l_suppkey").alias("servers"), F.count_if(~F.col("ok")).alias("failed"), F.floor(span / DAY).alias("days"), (F.count_distinct("l_suppkey") > 1).alias("shared"), (span < 30 * DAY).alias("short_lived"))


@query("p51_endpoints", f"SELECT user_id, k AS peer, count(*)::BIGINT AS packets, round(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0 END), 4) AS bytes_out, min(t) AS first_us, max(t) - min(t) AS duration_us, min(t) FILTER (event_type = 'view') IS NULL OR min(t) FILTER (event_type = 'view') > min(t) AS unresolved FROM {EV} GROUP BY 1, 2")
def p51(spark, d):
    """Conversations of two endpoints, and those reached before any name was asked for."""
    asked = F.min(F.when(F.col("event_type") == "view", F.col("t")))
    out = F.round(F.sum(F.when(F.col("event_type").isin("purchase", "signup"), F.col("value")).otherwise(0.0)), 4)
    return ev(spark, d).groupBy("user_id", F.col("k").alias("peer")).agg(F.count("*").alias("packets"), out.alias("bytes_out"), F.min("t").alias("first_us"), (F.max("t") - F.min("t")).alias("duration_us"), F.coalesce(asked > F.min("t"), F.lit(True)).alias("unresolved"))


@query("p52_enumeration", f"WITH b AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM {EV} WHERE event_type IN ('view', 'click')) SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS calls, count(DISTINCT k)::BIGINT AS services, max(n)::BIGINT AS most, max(n) >= 3 AS burst, count(*) FILTER (k % 7 = 0)::BIGINT AS credential_tests FROM b GROUP BY 1, 2")
def p52(spark, d):
    """Listing calls by identity and day, the densest six hours, and calls that only test a credential."""
    calls = S.bursts(ev(spark, d).where("event_type in ('view', 'click')"), ["user_id"], "ts", 6 * 3600, 1)
    return calls.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.count_distinct("k").alias("services"), F.max("n").alias("most"), (F.max("n") >= 3).alias("burst"), F.count_if(F.col("k") % 7 == 0).alias("credential_tests"))


@query("p53_privilege_changes", f"SELECT user_id, k AS target, CASE k % 3 WHEN 0 THEN 'policy' WHEN 1 THEN 'access_key' ELSE 'role' END AS kind, count(*) FILTER (event_type = 'signup')::BIGINT AS granted, count(*) FILTER (event_type = 'error')::BIGINT AS removed, max(t) AS last_us, arg_max(event_type, t) = 'signup' AS in_place FROM {EV} WHERE event_type IN ('signup', 'error') GROUP BY 1, 2, 3")
def p53(spark, d):
    """Grants and removals on each target, and what is still in place at the end."""
    e = ev(spark, d).where("event_type in ('signup', 'error')")
    still = S.still_in_place(e, ["user_id", "k"], "ts", "event_type", ["signup"], ["error"]).withColumn("in_place", F.lit(True))
    kind = P.flag_notable(F.col("k") % 3, {"policy": [0], "access_key": [1], "role": [2]})
    out = e.groupBy("user_id", "k", kind.alias("kind")).agg(F.count_if(F.col("event_type") == "signup").alias("granted"), F.count_if(F.col("event_type") == "error").alias("removed"), F.max("t").alias("last_us"))
    return out.join(still, ["user_id", "k"], "left").withColumn("in_place", F.coalesce("in_place", F.lit(False))).withColumnRenamed("k", "target")


@query("p54_resources_reached", f"SELECT CASE WHEN k % 10 = 0 THEN 'sensor' WHEN k % 10 < 4 THEN 'storage' WHEN k % 10 < 7 THEN 'compute' ELSE 'secret' END AS resource, event_type AS operation, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS identities, min(t) AS first_us, max(t) AS last_us, k % 10 = 0 AND event_type = 'error' AS disabled FROM {EV} GROUP BY 1, 2, 7")
def p54(spark, d):
    """Operations on each class of resource, and those that turn a sensor off."""
    resource = P.flag_notable(F.col("k") % 10, {"sensor": [0], "storage": [1, 2, 3], "compute": [4, 5, 6], "secret": [7, 8, 9]})
    e = ev(spark, d).withColumns({"resource": resource, "disabled": (F.col("k") % 10 == 0) & (F.col("event_type") == "error")})
    return A.census(e, ["resource", "event_type", "disabled"], identities=F.count_distinct("user_id"), first_us=F.min("t"), last_us=F.max("t")).withColumnRenamed("event_type", "operation")


@query("p55_mailbox", f"WITH r AS (SELECT user_id, count(*) FILTER (event_type = 'signup')::BIGINT AS rules, count(*) FILTER (event_type = 'signup' AND k % 5 = 0)::BIGINT AS forwarding, min(t) FILTER (event_type = 'signup') AS first_us, count(DISTINCT CASE WHEN event_type = 'signup' THEN k END)::BIGINT AS names FROM {EV} GROUP BY 1), l AS (SELECT user_id, count(*)::BIGINT AS in_effect FROM (SELECT user_id, k FROM {EV} WHERE event_type IN ('signup', 'error') GROUP BY 1, 2 HAVING arg_max(event_type, t) = 'signup') GROUP BY 1), s AS (SELECT e.user_id, count(*)::BIGINT AS sends_after FROM {EV} e JOIN r ON r.user_id = e.user_id AND e.event_type = 'purchase' AND e.t > r.first_us GROUP BY 1) SELECT user_id, rules, forwarding, names, first_us, coalesce(in_effect, 0)::BIGINT AS in_effect, coalesce(sends_after, 0)::BIGINT AS sends_after FROM r LEFT JOIN l USING (user_id) LEFT JOIN s USING (user_id)")
def p55(spark, d):
    """Rules made in each mailbox, those that forward and those still there, and mail sent after the first."""
    e = ev(spark, d)
    rule, first = F.col("event_type") == "signup", Window.partitionBy("user_id")
    e = e.withColumn("first_us", F.min(F.when(rule, F.col("t"))).over(first))
    out = e.groupBy("user_id").agg(
        F.count_if(rule).alias("rules"), F.count_if(rule & (F.col("k") % 5 == 0)).alias("forwarding"), F.count_distinct(F.when(rule, F.col("k"))).alias("names"),
        F.min("first_us").alias("first_us"), F.count_if((F.col("event_type") == "purchase") & (F.col("t") > F.col("first_us"))).alias("sends_after"),
    )
    still = S.still_in_place(e, ["user_id", "k"], "ts", "event_type", ["signup"], ["error"]).groupBy("user_id").agg(F.count("*").alias("in_effect"))
    return out.join(still, "user_id", "left").withColumn("in_effect", F.coalesce("in_effect", F.lit(0)))


@query("p56_sharing_downloads", f"WITH b AS (SELECT user_id, date_trunc('day', ts) AS day, sum(value) FILTER (event_type = 'purchase') AS bytes, count(*) FILTER (event_type = 'click')::BIGINT AS links FROM {EV} GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'purchase') > 0), m AS (SELECT user_id, median(bytes) AS mid FROM b GROUP BY 1), s AS (SELECT user_id, median(abs(bytes - mid)) AS dev FROM b JOIN m USING (user_id) GROUP BY 1) SELECT user_id, epoch_us(day) AS day_us, round(bytes, 4) AS bytes, links FROM b JOIN m USING (user_id) JOIN s USING (user_id) WHERE bytes > mid + 3 * dev")
def p56(spark, d):
    """Days on which an account takes out far more than it does, with the links it shared that day."""
    e, day = ev(spark, d), F.date_trunc("day", "ts")
    taken = A.against_own_history(e.where("event_type = 'purchase'"), "user_id", day, "value", 3, keep)
    links = e.groupBy("user_id", day.alias("bucket")).agg(F.count_if(F.col("event_type") == "click").alias("links"))
    return taken.join(links, ["user_id", "bucket"]).select("user_id", micros("bucket").alias("day_us"), "bytes", "links")


@query("p57_identity_anomalies", f"WITH s AS (SELECT *, hour(ts) AS h, min(ts) OVER (PARTITION BY user_id, k) AS f, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), base AS (SELECT DISTINCT user_id, hour(ts) AS h FROM {EV} WHERE ts < {CUT_SQL}) SELECT s.event_id, s.user_id, s.f >= {CUT_SQL} AS new_device, base.h IS NULL AS new_hour, coalesce(a = 'error' AND b = 'error', false) AS after_refusals FROM s LEFT JOIN base ON base.user_id = s.user_id AND base.h = s.h WHERE s.event_type = 'signup' AND s.ts >= {CUT_SQL}")
def p57(spark, d):
    """Sign-ins after the baseline: from a new device, at a new hour, after prompts refused twice."""
    w, e = Window.partitionBy("user_id").orderBy("ts", "event_id"), ev(spark, d).withColumn("h", F.hour("ts"))
    refused = F.coalesce((F.lag("event_type", 1).over(w) == "error") & (F.lag("event_type", 2).over(w) == "error"), F.lit(False))
    new = S.first_seen(e, ["user_id"], "k", "ts", at(CUT)).select("user_id", "k", F.lit(True).alias("new_device"))
    base = e.where(F.col("ts") < at(CUT)).select("user_id", "h").distinct().withColumn("known", F.lit(True))
    late = e.withColumn("after_refusals", refused).where((F.col("event_type") == "signup") & (F.col("ts") >= at(CUT)))
    return late.join(new, ["user_id", "k"], "left").join(base, ["user_id", "h"], "left").select("event_id", "user_id", F.coalesce("new_device", F.lit(False)).alias("new_device"), F.col("known").isNull().alias("new_hour"), "after_refusals")


@query("p58_admin_actions", f"SELECT a.event_id, a.user_id, CASE a.k % 3 WHEN 0 THEN 'role' WHEN 1 THEN 'policy' ELSE 'token' END AS action, count(e.event_id)::BIGINT AS alerts, CASE WHEN count(e.event_id) = 0 THEN 'undecided' WHEN min(e.t) <= a.t THEN 'response' ELSE 'intrusion' END AS side FROM (SELECT * FROM {EV} WHERE event_type = 'signup') a LEFT JOIN (SELECT * FROM {EV} WHERE event_type = 'error') e ON e.user_id = a.user_id AND e.t - a.t BETWEEN {-DAY} AND {DAY} GROUP BY a.event_id, a.user_id, a.k, a.t")
def p58(spark, d):
    """Administrative actions within a day of an alert: after its first they may be the response, before it the intrusion."""
    e = ev(spark, d).select("event_id", "user_id", "ts", "event_type", "k")
    acts = e.where("event_type = 'signup'").withColumn("action", P.flag_notable(F.col("k") % 3, {"role": [0], "policy": [1], "token": [2]}))
    near = J.band_join(acts.select("event_id", "user_id", "ts"), e.where("event_type = 'error'").select("user_id", "ts"), ["user_id"], "ts", "ts", -86_400, 86_400)
    seen = near.groupBy("event_id").agg(F.count("*").alias("alerts"), F.min(micros("r_ts")).alias("first"))
    out = acts.join(seen, "event_id", "left")
    side = F.when(F.col("alerts").isNull(), "undecided").when(F.col("first") <= micros("ts"), "response").otherwise("intrusion")
    return out.select("event_id", "user_id", "action", F.coalesce("alerts", F.lit(0)).alias("alerts"), side.alias("side"))


@query("p59_alert_verdicts", f"WITH a AS (SELECT *, lag(t) OVER (PARTITION BY user_id, k ORDER BY ts) AS before FROM {EV} WHERE event_type = 'error'), n AS (SELECT a.event_id, count(b.event_id)::BIGINT AS telemetry FROM a LEFT JOIN (SELECT * FROM {EV} WHERE event_type <> 'error') b ON b.user_id = a.user_id AND abs(b.t - a.t) <= 3600000000 GROUP BY 1) SELECT a.event_id, telemetry, coalesce(a.t - before <= {2 * DAY}, false) AS repeated, CASE WHEN a.t - before <= {2 * DAY} THEN 'same_activity' WHEN telemetry > 0 THEN 'corroborated' ELSE 'undecidable' END AS verdict FROM a JOIN n USING (event_id)")
def p59(spark, d):
    """Alerts with the telemetry within an hour, and those that are the same activity seen again within two days."""
    e = ev(spark, d)
    before = F.lag("t").over(Window.partitionBy("user_id", "k").orderBy("ts"))
    alerts = e.where("event_type = 'error'").withColumn("repeated", F.coalesce(F.col("t") - before <= 2 * DAY, F.lit(False))).select("event_id", "user_id", "ts", "repeated")
    near = J.band_join(alerts, e.where("event_type <> 'error'").select("user_id", "ts"), ["user_id"], "ts", "ts", -3600, 3600).groupBy("event_id").agg(F.count("*").alias("telemetry"))
    out = alerts.join(near, "event_id", "left").withColumn("telemetry", F.coalesce("telemetry", F.lit(0)))
    return out.select("event_id", "telemetry", "repeated", F.when(F.col("repeated"), "same_activity").when(F.col("telemetry") > 0, "corroborated").otherwise("undecidable").alias("verdict"))


@query("p60_exposure", "SELECT l_partkey AS item, CASE WHEN count(*) FILTER (l_returnflag = 'R' AND o_orderstatus = 'F') > 0 THEN 'left' WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'copied' ELSE 'accessed' END AS state, count(DISTINCT l_orderkey)::BIGINT AS artefacts, count(*) FILTER (l_returnflag = 'R' AND o_orderstatus = 'F') > 1 AS agreed FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def p60(spark, d):
    """For each item how far the evidence carries it, and whether a second artefact agrees."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    both = J.dealt(lines, lines.count(), "l_orderkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    copied = F.col("l_returnflag") == "R"
    # a row an item and artefact, where they lie, so that artefacts are counted and not held
    seen = both.groupBy("l_orderkey", "l_partkey").agg(F.count_if(copied & (F.col("o_orderstatus") == "F")).alias("gone"), F.count_if(copied).alias("copies"))
    out = seen.groupBy(F.col("l_partkey").alias("item")).agg(F.sum("gone").alias("gone"), F.sum("copies").alias("copies"), F.count("*").alias("artefacts"))
    return out.select("item", F.when(F.col("gone") > 0, "left").when(F.col("copies") > 0, "copied").otherwise("accessed").alias("state"), "artefacts", (F.col("gone") > 1).alias("agreed"))


_TYPES = (("web", "https?://"), ("mail", "@"), ("addresses", "[0-9]{1,3}([.][0-9]{1,3}){3}"), ("list", "(^|\\n)- "))


@query("p61_unknown_evidence", "SELECT types, count(*)::BIGINT AS files, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text))::BIGINT AS different, min(doc_id) AS example FROM (SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in sorted(_TYPES)) + ") AS types FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def p61(spark, d):
    """What unknown files look like, by every reader that fits, with counts, bytes and an example."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("types", F.array_join(P.matching_readers(F.col("text"), _TYPES), ","))
    return docs.groupBy("types").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.count_distinct(F.sha2("text", 256)).alias("different"), F.min("doc_id").alias("example"))


@query("p62_answer_board", "WITH h AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), q AS (SELECT b.item_id, count(h.doc_id)::BIGINT AS answers, count(DISTINCT quality)::BIGINT AS said, max(quality)::BIGINT AS best FROM benchmark b LEFT JOIN h USING (item_id) LEFT JOIN labels l ON l.doc_id = h.doc_id GROUP BY 1) SELECT item_id, answers, CASE WHEN answers = 0 THEN 'open' WHEN said > 1 THEN 'disputed' WHEN best = 1 THEN 'confirmed' ELSE 'answered' END AS standing FROM q")
def p62(spark, d):
    """Each question with the texts that hold its answer in full, and how they were marked."""
    asked = table(spark, d, "benchmark").select("item_id", "text")
    held = sweep(table(spark, d, "documents"), "doc_id", "text", asked, "item_id", "text", keep).select("item_id", "doc_id").distinct()
    marked = held.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("item_id").agg(F.count("*").alias("answers"), F.count_distinct("quality").alias("said"), F.max("quality").alias("best"))
    out = asked.select("item_id").join(marked, "item_id", "left")
    standing = F.when(F.col("answers").isNull(), "open").when(F.col("said") > 1, "disputed").when(F.col("best") == 1, "confirmed").otherwise("answered")
    return out.select("item_id", F.coalesce("answers", F.lit(0)).alias("answers"), standing.alias("standing"))


@query("p63_rapid_scoping", f"SELECT user_id, n, errors, first_us, last_us, row_number() OVER (ORDER BY errors DESC, n DESC, user_id) AS place FROM (SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS errors, min(t) AS first_us, max(t) AS last_us FROM {EV} GROUP BY 1) QUALIFY place <= 20")
def p63(spark, d):
    """The twenty hosts to collect first."""
    hosts = A.census(ev(spark, d), ["user_id"], errors=F.count_if(F.col("event_type") == "error"), first_us=F.min("t"), last_us=F.max("t"))
    return A.ranked(hosts, [F.desc("errors"), F.desc("n"), "user_id"], 20)


