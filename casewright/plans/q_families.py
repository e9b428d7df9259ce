"""Operators of single evidence families on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewright.operators import answers as A
from casewright.operators import families as Q
from casewright.operators import persistence as P
from casewright.operators import references as R
from casewright.operators import survey as S
from casewright.operators import trees as T
from casewright.operators.intervals import interval_join
from casewright.operators.joins import micros
from casewright.operators.scan import ranged, scan
from casewright.plans.q_aggregates import SEARCHED, TREE, places
from casewright.plans.q_joins import HOLDINGS, SEATS, holdings
from casewright.plans.registry import query, table
from casewright.sources.scratch import keep


@query("q1_normalise", "SELECT 'sign_in' AS provider, event_id::VARCHAR AS event_id, epoch_us(ts) AS time_us, user_id::VARCHAR AS principal, event_type AS action, NULL::VARCHAR AS resource, CASE WHEN event_type = 'error' THEN 'failure' END AS outcome FROM events UNION ALL SELECT 'ledger', o_orderkey::VARCHAR, epoch_us(o_orderdate), o_custkey::VARCHAR, o_orderpriority, NULL, o_orderstatus FROM orders")
def q1(spark, d):
    s = lambda c: F.col(c).cast("string")
    a = Q.normalise(table(spark, d, "events"), "sign_in", {"event_id": s("event_id"), "time_us": micros("ts"), "principal": s("user_id"), "action": F.col("event_type"), "outcome": F.when(F.col("event_type") == "error", "failure")})
    b = Q.normalise(table(spark, d, "orders"), "ledger", {"event_id": s("o_orderkey"), "time_us": micros("o_orderdate"), "principal": s("o_custkey"), "action": F.col("o_orderpriority"), "outcome": F.col("o_orderstatus")})
    return a.unionByName(b)


@query("q2_collapse_stages", "SELECT l_orderkey, arg_max(l_linestatus, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END) AS outcome, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS stages FROM (SELECT l_orderkey, l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def q2(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linestatus").alias("l_linestatus"))
    return Q.collapse_stages(rows, "l_orderkey", "l_returnflag", ["N", "A", "R"], "l_linestatus")


@query("q3_correlate", "SELECT l_orderkey, count(*)::BIGINT AS rows, string_agg(l_suppkey::VARCHAR, '>' ORDER BY l_linenumber, l_suppkey::VARCHAR) AS chain FROM lineitem GROUP BY 1")
def q3(spark, d):
    chain = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").cast("string").alias("s"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.array_join(F.transform(chain, lambda x: x["s"]), ">").alias("chain"))


@query("q4_assemble_audit", "SELECT event_id // 3 AS serial, min(user_id) FILTER (event_type = 'view') AS view, min(user_id) FILTER (event_type = 'click') AS click FROM events GROUP BY 1")
def q4(spark, d):
    return Q.assemble(table(spark, d, "events").withColumn("serial", F.floor(F.col("event_id") / 3)), "serial", "event_type", "user_id", ["view", "click"])


@query("q5_pair_sessions", "SELECT user_id, s AS start_us, CASE WHEN n IN ('purchase', 'error') THEN t END AS end_us FROM (SELECT user_id, event_type, epoch_us(ts) AS s, lead(epoch_us(ts)) OVER w AS t, lead(event_type) OVER w AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE event_type = 'signup'")
def q5(spark, d):
    return Q.pair_sessions(table(spark, d, "events"), ["user_id"], "ts", "event_type", "signup", ["purchase", "error"])


LAYERED = """SELECT '/' || l_partkey % 20 || '/' || l_suppkey % 10 || '/' || l_partkey AS path, (l_linenumber - 1)::INT AS layer, 'file' AS kind FROM lineitem WHERE l_linenumber <> 6 UNION SELECT '/' || l_partkey % 20 || '/' || l_suppkey % 10, (l_linenumber - 1)::INT, 'whiteout' FROM lineitem WHERE l_orderkey % 50 = 0 AND l_returnflag = 'R' AND l_linenumber <> 6
    UNION SELECT '/' || l_partkey % 20 || '/' || l_suppkey % 10 || '/' || l_partkey, (l_linenumber - 1)::INT, 'whiteout' FROM lineitem WHERE l_orderkey % 9 = 1 AND l_returnflag = 'A' AND l_linenumber <> 6 UNION SELECT '/' || l_partkey % 20, (l_linenumber - 1)::INT, 'opaque' FROM lineitem WHERE l_orderkey % 61 = 0 AND l_linenumber <> 6"""


@query("q6_effective_view", f"""WITH e AS ({LAYERED}), f AS (SELECT DISTINCT path, layer FROM e WHERE kind = 'file'), m AS (SELECT path AS above, layer AS lay, kind FROM e WHERE kind <> 'file'),
    c AS (SELECT f.path, max(lay) AS cut FROM (SELECT DISTINCT path FROM f) f JOIN m ON starts_with(f.path, m.above || '/') OR (f.path = m.above AND m.kind = 'whiteout') GROUP BY 1), t AS (SELECT path, max(layer) FILTER (cut IS NULL OR layer >= cut) AS top, list_sort(list(layer)) AS a FROM f LEFT JOIN c USING (path) GROUP BY 1)
    SELECT path, top AS layer, array_to_string(list_filter(a, lambda x: x < top), ',') AS hidden_in FROM t WHERE top IS NOT NULL UNION ALL SELECT NULL, g::INT, '' FROM (SELECT unnest(range(0, (SELECT max(layer) + 1 FROM e))) AS g) WHERE g NOT IN (SELECT layer FROM e)""")
def q6(spark, d):
    """Paths of the topmost layer that supplies each, under whiteouts of files and directories and opaque directories, and the layer that is not there."""
    rows = table(spark, d, "lineitem").where("l_linenumber <> 6").withColumn("layer", (F.col("l_linenumber") - 1).cast("int"))
    top = F.concat(F.lit("/"), (F.col("l_partkey") % 20).cast("string"))
    middle = F.concat(top, F.lit("/"), (F.col("l_suppkey") % 10).cast("string"))
    whole = F.concat(middle, F.lit("/"), F.col("l_partkey").cast("string"))
    entry = lambda cond, path, kind: rows.where(cond).select(path.alias("path"), "layer", F.lit(kind).alias("kind"))
    entries = entry("true", whole, "file").unionByName(entry("l_orderkey % 50 = 0 and l_returnflag = 'R'", middle, "whiteout"))
    entries = entries.unionByName(entry("l_orderkey % 9 = 1 and l_returnflag = 'A'", whole, "whiteout")).unionByName(entry("l_orderkey % 61 = 0", top, "opaque"))
    return T.effective_view(entries, rows.select("layer"), keep).withColumn("hidden_in", F.array_join("hidden_in", ","))


LINKS = """SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent, CASE WHEN o_orderkey % 29 = 0 THEN 'mismatch' WHEN o_orderkey % 37 = 0 THEN 'not available' ELSE 'match' END AS said FROM orders"""


@query("q7_chain_status", f"""WITH RECURSIVE l AS (SELECT * FROM ({LINKS}) WHERE node % 41 <> 0), leaf AS (SELECT node FROM l WHERE node NOT IN (SELECT parent FROM l WHERE parent IS NOT NULL)),
    w AS (SELECT leaf.node AS leaf, l.node, l.parent, l.said, 0::BIGINT AS n FROM leaf JOIN l USING (node) UNION ALL SELECT w.leaf, l.node, l.parent, l.said, w.n + 1 FROM w JOIN l ON l.node = w.parent),
    p AS (SELECT leaf, n, node, CASE WHEN parent IS NULL THEN NULL WHEN parent NOT IN (SELECT node FROM l) THEN 'parent missing' WHEN said <> 'match' THEN said END AS problem FROM w)
    SELECT leaf, arg_max(node, n) AS base, max(n) AS links, coalesce(arg_min(problem, n), '') AS first_problem, min(n) FILTER (problem IS NOT NULL) AS "at", CASE arg_min(problem, n) WHEN 'mismatch' THEN 'broken' WHEN 'not available' THEN 'incomplete' WHEN 'parent missing' THEN 'incomplete' ELSE 'complete' END AS status FROM p GROUP BY 1""")
def q7(spark, d):
    """Each chain from its leaf down to its base: the first link that does not match, is not available or leads nowhere."""
    k = F.col("o_orderkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    links = table(spark, d, "orders").select(k.alias("node"), before.alias("parent"), F.when(k % 29 == 0, "mismatch").when(k % 37 == 0, "not available").otherwise("match").alias("said")).where("node % 41 <> 0")
    return T.chain_status(links, "node", "parent", F.col("said"), keep).withColumn("first_problem", F.coalesce("first_problem", F.lit("")))


@query("q8_three_way", "SELECT k, CASE WHEN a AND b AND c THEN 'all' WHEN a AND NOT b THEN 'not_in_repository' WHEN b AND NOT a THEN 'not_in_catalogue' ELSE 'settings_differ' END AS state FROM (SELECT o_orderkey AS k, bool_or(s = 1) AS a, bool_or(s = 2) AS b, bool_or(s = 3) AS c FROM (SELECT o_orderkey, 1 AS s FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, 2 FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1)")
def q8(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("s")).unionByName(l.where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("k"), F.lit(2).alias("s"))).unionByName(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(3).alias("s")))
    has = rows.groupBy("k").agg(*(F.bool_or(F.col("s") == i).alias(n) for i, n in enumerate("abc", 1)))
    state = F.when(F.col("a") & F.col("b") & F.col("c"), "all").when(F.col("a") & ~F.col("b"), "not_in_repository").when(F.col("b") & ~F.col("a"), "not_in_catalogue").otherwise("settings_differ")
    return has.select("k", state.alias("state"))


@query("q9_deletion_states", "SELECT user_id, min(epoch_us(ts)) FILTER (event_type = 'view') AS view, min(epoch_us(ts)) FILTER (event_type = 'click') AS click, min(epoch_us(ts)) FILTER (event_type = 'purchase') AS purchase, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'click') THEN 'click' WHEN bool_or(event_type = 'view') THEN 'view' END AS furthest FROM events GROUP BY 1")
def q9(spark, d):
    return Q.deletion_states(table(spark, d, "events"), "user_id", "event_type", "ts", ["view", "click", "purchase"])


@query("q10_map_events", "SELECT CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' ELSE 'other' END AS category, count(*)::BIGINT AS n FROM events GROUP BY 1")
def q10(spark, d):
    return Q.map_events(table(spark, d, "events"), "event_type", {"view": "read", "purchase": "write"}).groupBy("category").agg(F.count("*").alias("n"))


@query("q11_target_outcomes", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'excluded' WHEN o.n IS NULL THEN 'not_attempted' WHEN c_acctbal < 0 THEN 'failed' WHEN o.n > 3 THEN 'collected' ELSE 'unknown' END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def q11(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rules = [("excluded", F.col("c_mktsegment") == "BUILDING"), ("not_attempted", F.col("n").isNull()), ("failed", F.col("c_acctbal") < 0), ("collected", F.col("n") > 3)]
    return Q.target_outcomes(table(spark, d, "customer").join(n, "c_custkey", "left"), "c_custkey", rules)


@query("q12_resolve_profile", "SELECT page_id, CASE WHEN regexp_matches(p, '^/en/[^/]*$') THEN '/en/*' ELSE '/d?/*.html' END AS glob FROM (SELECT page_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS p FROM pages) WHERE (regexp_matches(p, '^/en/[^/]*$') OR regexp_matches(p, '^/d[^/]/[^/]*\\.html$')) AND NOT regexp_matches(p, '^/[^/]*/1[^/]*$')")
def q12(spark, d):
    files = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://[^/]*([^?#]*)", 1).alias("p"))
    return Q.resolve_profile(files, "p", ["/en/*", "/d?/*.html"], ["/*/1*"]).select("page_id", "glob")


@query("q13_verify_packages", "SELECT a.doc_id, CASE WHEN b.h IS NULL THEN 'unowned' WHEN b.h = md5(a.text) THEN 'verified' ELSE 'changed' END AS state FROM documents a LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN '' ELSE md5(text) END AS h FROM documents WHERE doc_id % 2 = 1) b USING (doc_id)")
def q13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("own"))
    base = docs.where("doc_id % 2 = 1").select("doc_id", F.when(F.col("doc_id") % 10 == 1, "").otherwise(F.col("own")).alias("h"))
    state = F.when(F.col("h").isNull(), "unowned").when(F.col("h") == F.col("own"), "verified").otherwise("changed")
    return docs.join(base, "doc_id", "left").select("doc_id", state.alias("state"))


@query("q14_persistence", "SELECT kind, name, count(*)::BIGINT AS n FROM (SELECT 'service' AS kind, s_name AS name FROM supplier UNION ALL SELECT 'task', p_type FROM part UNION ALL SELECT 'key', c_mktsegment FROM customer) GROUP BY 1, 2")
def q14(spark, d):
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, t, c in (("service", "supplier", "s_name"), ("task", "part", "p_type"), ("key", "customer", "c_mktsegment"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "name").agg(F.count("*").alias("n"))


LINES = "SELECT 's' || l_suppkey AS unit, CASE l_returnflag WHEN 'A' THEN 'ExecStart' WHEN 'N' THEN 'Environment' ELSE 'User' END AS key, CASE WHEN l_partkey % 29 = 0 THEN '' ELSE 'p' || l_partkey END AS value, l_linenumber AS dropin, l_orderkey AS line, l_partkey AS part FROM lineitem"
LINKS = "SELECT 's' || s_suppkey AS name, '/dev/null' AS target FROM supplier WHERE s_suppkey % 10 = 3 UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 210 = 0 THEN 'c' || (c_custkey + 1) WHEN c_custkey % 3 = 0 THEN 's' || c_nationkey ELSE 'c' || (c_custkey - 1) END FROM customer UNION ALL SELECT 'c' || c_custkey, 's1' FROM customer WHERE c_custkey % 50 = 7"


@query("q14_effective_units", f"""WITH RECURSIVE a AS ({LINES}), cut AS (SELECT unit, max((dropin, line, part)) AS goal FROM a WHERE key = 'ExecStart' AND value = '' GROUP BY 1),
    k AS (SELECT a.unit, count(*) AS commands FROM a LEFT JOIN cut ON cut.unit = a.unit WHERE key = 'ExecStart' AND value <> '' AND (cut.goal IS NULL OR (dropin, line, part) > cut.goal) GROUP BY 1),
    n AS (SELECT unit, count(*) FILTER (key = 'ExecStart' AND value = '') AS resets FROM a GROUP BY 1), one AS (SELECT name, min(target) AS target, count(DISTINCT target) > 1 AS bad FROM ({LINKS}) GROUP BY 1), sure AS (SELECT name, target FROM one WHERE NOT bad),
    r AS (SELECT name, target AS goal, 0 AS n FROM sure UNION ALL SELECT r.name, s.target, n + 1 FROM r JOIN sure s ON s.name = r.goal WHERE n < 9), z AS (SELECT name, goal FROM r WHERE goal NOT IN (SELECT name FROM sure)),
    u AS (SELECT name, goal AS unit FROM z WHERE goal <> '/dev/null' AND goal NOT IN (SELECT name FROM one)), al AS (SELECT unit, count(*) AS aliases FROM u GROUP BY 1),
    w AS (SELECT coalesce(u.unit, c.name) AS unit, count(*) AS wants FROM (SELECT 'c' || c_custkey AS name FROM customer WHERE c_mktsegment = 'BUILDING') c LEFT JOIN u ON u.name = c.name GROUP BY 1),
    x AS (SELECT coalesce(u.unit, e.name) AS unit, count(*) AS runs FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 's' ELSE 'c' END || user_id AS name FROM events) e LEFT JOIN u ON u.name = e.name GROUP BY 1), m AS (SELECT name AS unit FROM z WHERE goal = '/dev/null'),
    f AS (SELECT v.unit, coalesce(commands, 0) AS commands, coalesce(resets, 0) AS resets, coalesce(aliases, 0) AS aliases, coalesce(wants, 0)::BIGINT AS wants, coalesce(runs, 0)::BIGINT AS runs, m.unit IS NOT NULL AS masked, n.unit IS NOT NULL AS own
        FROM (SELECT unit FROM n UNION SELECT unit FROM m UNION SELECT unit FROM x) v LEFT JOIN n USING (unit) LEFT JOIN k USING (unit) LEFT JOIN al USING (unit) LEFT JOIN w USING (unit) LEFT JOIN x USING (unit) LEFT JOIN m ON m.unit = v.unit)
    SELECT unit, commands, resets, aliases, wants, runs, masked, CASE WHEN masked THEN 'masked' WHEN NOT own THEN 'none' WHEN commands = 0 THEN 'no_command' WHEN wants > 0 THEN 'enabled' ELSE 'dormant' END AS configuration, CASE WHEN runs > 0 THEN 'seen' ELSE 'not_seen' END AS execution FROM f""")
def q14_units(spark, d):
    """Units as they stand after drop-ins, masks and chains of aliases, and beside that which were seen to run."""
    rows, c, name = table(spark, d, "lineitem"), table(spark, d, "customer"), lambda letter, n: F.concat(F.lit(letter), F.col(n).cast("string"))
    key = F.when(F.col("l_returnflag") == "A", "ExecStart").when(F.col("l_returnflag") == "N", "Environment").otherwise("User")
    value = F.when(F.col("l_partkey") % 29 == 0, "").otherwise(name("p", "l_partkey"))
    lines = rows.select(name("s", "l_suppkey").alias("unit"), key.alias("key"), value.alias("value"), F.col("l_linenumber").alias("dropin"), F.col("l_orderkey").alias("line"), F.col("l_partkey").alias("part"))
    k = F.col("c_custkey")
    target = F.when(k % 210 == 0, F.concat(F.lit("c"), (k + 1).cast("string"))).when(k % 3 == 0, name("s", "c_nationkey")).otherwise(F.concat(F.lit("c"), (k - 1).cast("string")))
    links = table(spark, d, "supplier").where("s_suppkey % 10 = 3").select(name("s", "s_suppkey").alias("name"), F.lit("/dev/null").alias("target"))
    links = links.unionByName(c.select(name("c", "c_custkey").alias("name"), target.alias("target"))).unionByName(c.where("c_custkey % 50 = 7").select(name("c", "c_custkey").alias("name"), F.lit("s1").alias("target")))
    wanted = c.where("c_mktsegment = 'BUILDING'").select(name("c", "c_custkey").alias("name"))
    ran = table(spark, d, "events").select(F.concat(F.when(F.col("event_id") % 3 == 0, "s").otherwise("c"), F.col("user_id").cast("string")).alias("name"))
    return P.persistence(lines, ["dropin", "line", "part"], links, wanted, ran, keep)


@query("q15_fold_lines", "SELECT conv_id, entry::BIGINT AS entry, string_agg(text, chr(10) ORDER BY turn) AS text, count(*)::BIGINT AS lines FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS entry FROM conversations) GROUP BY 1, 2")
def q15(spark, d):
    return Q.fold_lines(table(spark, d, "conversations"), ["conv_id"], "turn", "text", F.col("role") == "user")


SEEN = "SELECT l_orderkey AS key, CASE WHEN l_linenumber % 2 = 1 THEN 'extension' ELSE 'note' END AS kind, CASE WHEN l_linenumber % 2 = 1 THEN 'x' ELSE 'note' END || l_suppkey AS value, l_shipdate AS seen FROM lineitem"
_SET = "SELECT 'f' || s_nationkey AS family, CASE WHEN s_suppkey % 3 <> 2 THEN 'v' || ({0}) % 2 END AS variant, '{1}' AS kind, '{2}' || s_suppkey AS value, s_suppkey % 3 AS sources, TIMESTAMP '1997-01-01' + to_days((s_suppkey % 100)::INT) AS f, TIMESTAMP '1999-07-01' + to_days((s_suppkey % 100)::INT) AS t, TIMESTAMP '2026-01-01' + to_days((s_suppkey % 400)::INT) AS fresh FROM supplier WHERE {3}"
REFERENCE = f"{_SET.format('s_suppkey', 'extension', 'x', 's_suppkey % 4 <> 1')} UNION ALL {_SET.format('s_suppkey // 3', 'note', 'note', 's_suppkey % 3 <> 0')}"
CANDIDATES = f"""s AS ({REFERENCE}), h AS (SELECT o.key, s.family, s.variant, s.kind, s.sources, o.seen, s.fresh FROM ({SEEN}) o JOIN s ON s.kind = o.kind AND s.value = o.value), span AS (SELECT family, min(f) AS f, max(t) AS t FROM s GROUP BY 1),
    v AS (SELECT key, family, bool_or(e) AND bool_or(n) AND NOT bool_or(e AND n) AS differ FROM (SELECT key, family, variant, bool_or(kind = 'extension') AS e, bool_or(kind = 'note') AS n FROM h WHERE variant IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
    g AS (SELECT key, family, count(DISTINCT kind) AS features, max(sources) AS sources, min(seen) AS seen, min(fresh) < TIMESTAMP '2026-06-01' AS stale, bool_or(kind = 'extension') AS e, bool_or(kind = 'note') AS n FROM h GROUP BY 1, 2),
    c AS (SELECT g.key, g.family, features, CASE WHEN features >= 2 THEN 'corroborated' WHEN sources >= 2 THEN 'single_feature' ELSE 'weak_lead' END AS support, coalesce(differ, false) AS variants_differ,
        CASE WHEN seen < f THEN 'before_cited_sources' WHEN seen > t THEN 'after_cited_sources' ELSE 'within_cited_sources' END AS period, stale, e, n FROM g JOIN span USING (family) LEFT JOIN v ON v.key = g.key AND v.family = g.family)"""


def candidates(spark, d):
    """Features by order (what its lines were shipped by, under two kinds of name) against a reference set of suppliers by nation."""
    odd = F.col("l_linenumber") % 2 == 1
    obs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(odd, "extension").otherwise("note").alias("kind"), F.concat(F.when(odd, "x").otherwise("note"), F.col("l_suppkey").cast("string")).alias("value"), F.col("l_shipdate").alias("seen"))
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    after = lambda day, n: F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(n.cast("int"))

    def known(kind, word, variant):
        return s.select(
            F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("family"), F.when(k % 3 != 2, F.concat(F.lit("v"), (variant % 2).cast("string"))).alias("variant"), F.lit(kind).alias("kind"), F.concat(F.lit(word), k.cast("string")).alias("value"),
            (k % 3).alias("sources"), after("1997-01-01", k % 100).alias("dated_from"), after("1999-07-01", k % 100).alias("dated_to"), after("2026-01-01", k % 400).alias("fresh_until"), k.alias("s"),
        )

    refs = known("extension", "X", k).where("s % 4 <> 1").unionByName(known("note", "Note", F.floor(k / 3).cast("long")).where("s % 3 <> 0")).drop("s")
    return R.family_candidates(obs, refs, ["extension", "note"], F.lit("2026-06-01").cast("timestamp_ntz"))


@query("q16_family_candidates", f"WITH {CANDIDATES} SELECT key, family, features, support, variants_differ, period, stale FROM c")
def q16_candidates(spark, d):
    return candidates(spark, d).drop("mask")


@query("q16_family_match", f"""WITH {CANDIDATES}, k AS (SELECT *, CASE support WHEN 'corroborated' THEN 2 WHEN 'single_feature' THEN 1 ELSE 0 END * 64 + features AS r FROM c),
    b AS (SELECT key, count(*) AS families, max(r) AS top, bool_or(stale) AS stale, bool_or(variants_differ) OR (bool_or(e) AND bool_or(n) AND NOT bool_or(e AND n)) AS contradiction FROM k GROUP BY 1), w AS (SELECT k.key, count(*) AS n, min(family) AS one FROM k JOIN b ON b.key = k.key AND b.top = k.r GROUP BY 1)
    SELECT o.key, CASE WHEN b.key IS NULL THEN 'unidentified' WHEN families = 1 THEN 'candidate' WHEN w.n = 1 THEN 'leading_candidate' ELSE 'ambiguous' END AS outcome, CASE WHEN w.n = 1 THEN one END AS leading, coalesce(families, 0) AS families, coalesce(contradiction, false) AS contradiction, CASE WHEN stale THEN 'partial' ELSE 'complete' END AS status
    FROM (SELECT DISTINCT l_orderkey AS key FROM lineitem) o LEFT JOIN b ON b.key = o.key LEFT JOIN w ON w.key = o.key""")
def q16(spark, d):
    """Each order's family by its features: which leads, whether kinds of feature contradict each other, whether what was met is past its date."""
    return R.family_match(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key")), candidates(spark, d), ["extension", "note"])


@query("q17_lookup", """WITH a AS (SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'nation ' WHEN 1 THEN 'nation ' WHEN 2 THEN 'land ' ELSE 'nobody ' END || c_nationkey AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS variant FROM customer),
    n AS (SELECT n_nationkey AS entry, 'nation ' || n_nationkey AS name FROM nation UNION SELECT n_nationkey, 'land ' || n_nationkey FROM nation UNION SELECT n_nationkey, 'land ' || (n_nationkey + 1) FROM nation WHERE n_nationkey % 5 = 0),
    v AS (SELECT n_nationkey AS entry, CASE WHEN n_nationkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS v FROM nation WHERE n_nationkey % 5 <> 0), q AS (SELECT n_nationkey AS entry, '1-URGENT' AS need FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, '2-HIGH' FROM nation WHERE n_nationkey % 2 = 0),
    h AS (SELECT o_custkey AS key, o_orderpriority AS need, bool_or(o_orderstatus <> 'F') AS held FROM orders GROUP BY 1, 2 HAVING bool_or(o_orderstatus <> 'F') = bool_and(o_orderstatus <> 'F')),
    f AS (SELECT a.key, a.variant, n.entry FROM a LEFT JOIN n USING (name)), c AS (SELECT f.key, f.entry, count(need) AS needs, count(*) FILTER (held) AS met, count(*) FILTER (NOT held) AS unmet FROM f JOIN q USING (entry) LEFT JOIN h USING (key, need) GROUP BY 1, 2)
    SELECT f.key, f.variant, f.entry, CASE WHEN f.entry IS NULL THEN 'no_entry_in_snapshot' ELSE 'entry_found' END AS result,
        CASE WHEN f.entry IS NULL THEN NULL WHEN f.variant IS NULL THEN 'variant_not_given' WHEN v.v IS NULL THEN 'source_names_no_versions' WHEN v.v = f.variant THEN 'stated_for_this_variant' ELSE 'not_stated_for_this_variant' END AS variant_status,
        CASE WHEN f.entry IS NOT NULL THEN coalesce(needs, 0) END AS needs, CASE WHEN f.entry IS NOT NULL THEN coalesce(met, 0) END AS met, CASE WHEN f.entry IS NOT NULL THEN coalesce(unmet, 0) END AS unmet,
        CASE WHEN f.entry IS NULL THEN NULL WHEN needs IS NULL THEN 'none_stated' WHEN unmet > 0 THEN 'not_met' WHEN met = needs THEN 'all_met' ELSE 'unknown' END AS prerequisites, DATE '2026-01-01' + (f.entry * 30)::INT < DATE '2026-12-01' AS stale
    FROM f LEFT JOIN v USING (entry) LEFT JOIN c ON c.key = f.key AND c.entry = f.entry""")
def q17(spark, d):
    """Names that customers ask for, in any case and by alias, in a snapshot of nations: for their variant or not, with what it needs, in date or not."""
    c, n, k, e = table(spark, d, "customer"), table(spark, d, "nation"), F.col("c_custkey") % 4, F.col("n_nationkey")
    no = F.col("c_nationkey").cast("string")
    name = F.concat(F.when(k == 0, "nation_").when(k == 1, "NATION  ").when(k == 2, "Land-").otherwise("nobody "), no)
    asked = c.select(F.col("c_custkey").alias("key"), name.alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("variant"))
    entries = n.select(e.alias("entry"), F.col("n_name").alias("name"), F.date_add(F.lit("2026-01-01").cast("date"), (e * 30).cast("int")).alias("fresh_until"))
    land = lambda rows, m: rows.select(e.alias("entry"), F.concat(F.lit("land "), m.cast("string")).alias("name"))
    variants = n.where("n_nationkey % 5 <> 0").select(e.alias("entry"), F.when(e % 2 == 0, "Building").otherwise("Machinery").alias("variant"))
    needs = n.where("n_nationkey % 3 <> 0").select(e.alias("entry"), F.lit("1-URGENT").alias("need")).unionByName(n.where("n_nationkey % 2 = 0").select(e.alias("entry"), F.lit("2-HIGH").alias("need")))
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("need"), (F.col("o_orderstatus") != "F").alias("held"))
    return R.lookup(asked, entries, land(n, e).unionByName(land(n.where("n_nationkey % 5 = 0"), e + 1)), variants, needs, held, F.lit("2026-12-01").cast("date"))


SURVEYED = """f AS (SELECT doc_id, source, 'report' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.docx' WHEN 1 THEN '.docx.locked' WHEN 2 THEN '.PDF.id77.crypt' WHEN 3 THEN '.pdf' WHEN 4 THEN '.xyz' WHEN 5 THEN '.zip' ELSE '' END AS path, doc_id % 37 <> 0 AS ok,
        CASE WHEN doc_id % 10 = 0 THEN array_to_string([sha256(doc_id || ':' || i) for i in range(256)], '') ELSE hex(encode(coalesce(text, ''))) END AS h FROM documents),
    b AS (SELECT doc_id, unnest(regexp_extract_all(substring(h, 1, 131072), '..')) AS c FROM f WHERE ok AND length(h) > 8192), n AS (SELECT doc_id, c, count(*) AS n FROM b GROUP BY 1, 2),
    e AS (SELECT doc_id, -sum(n / t * log2(n / t)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM n) GROUP BY 1),
    s AS (SELECT f.doc_id, source, path, length(h) // 2 AS size, bits, CASE doc_id % 7 WHEN 1 THEN '.locked' WHEN 2 THEN '.crypt' END AS appended, CASE WHEN NOT ok THEN 'read_failed' WHEN doc_id % 7 IN (1, 2) OR bits >= 7.5 THEN 'candidate' WHEN length(h) <= 8192 THEN 'unmeasured' ELSE 'noncandidate' END AS status FROM f LEFT JOIN e USING (doc_id))"""


def survey(spark, d):
    """Documents as files with names of several shapes; a tenth hold random bytes, some could not be read."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    ext = F.when(k % 7 == 0, ".docx").when(k % 7 == 1, ".docx.locked").when(k % 7 == 2, ".PDF.id77.crypt").when(k % 7 == 3, ".pdf").when(k % 7 == 4, ".xyz").when(k % 7 == 5, ".zip").otherwise("")
    noise = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.sha2(F.concat(k.cast("string"), F.lit(":"), i.cast("string")), 256)), ""))
    raw = F.when(k % 10 == 0, noise).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    files = docs.select("doc_id", "source", F.concat(F.lit("report"), k.cast("string"), ext).alias("path"), (k % 37 != 0).alias("ok"), raw.alias("raw"))
    return S.tree_survey(files.withColumn("size", F.length("raw").cast("long")), "path", "size", "raw", "ok")


@query("q18_survey_files", f"WITH {SURVEYED} SELECT doc_id, status, round(bits, 4) AS head_entropy, appended, CASE WHEN status = 'candidate' THEN concat_ws(',', CASE WHEN appended IS NOT NULL THEN 'appended_extension_after_known_extension' END, CASE WHEN bits >= 7.5 THEN 'head_entropy_at_least_7.5' END) ELSE '' END AS reasons FROM s")
def q18_files(spark, d):
    return survey(spark, d).select("doc_id", "status", F.round("head_entropy", 4).alias("head_entropy"), "appended", "reasons")


@query("q18_tree_survey", f"WITH {SURVEYED} SELECT source, count(*)::BIGINT AS visited, " + ", ".join(f"count(*) FILTER (status = '{x}')::BIGINT AS {x}, coalesce(sum(size) FILTER (status = '{x}'), 0)::BIGINT AS {x}_bytes" for x in ("candidate", "noncandidate", "unmeasured", "read_failed")) + ", round(count(*) FILTER (status = 'candidate') / count(*), 4) AS fraction, CASE WHEN bool_or(status = 'read_failed') THEN 'partial' ELSE 'complete' END AS state FROM s GROUP BY 1")
def q18(spark, d):
    """Files and bytes that look encrypted, do not, were not measured and were not read, by the tree they are in."""
    return S.survey_totals(survey(spark, d), ["source"], "size")


@query("q18_survey_hours", f"WITH {SURVEYED} SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, count(*)::BIGINT AS files, count(*) FILTER (status = 'candidate')::BIGINT AS candidates FROM s LEFT JOIN events ON event_id = doc_id GROUP BY 1")
def q18_hours(spark, d):
    stamps = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "ts")
    return S.survey_hours(survey(spark, d).join(stamps, "doc_id", "left"), "ts")


@query("q19_match_audit", "SELECT DISTINCT a.event_id FROM events a JOIN events b ON a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND a.event_type = b.event_type AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 120000000")
def q19(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    return Q.match_audit(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["event_type"], "ts", "ts", "event_id")


@query("q20_after_seal", "SELECT user_id, count(*)::BIGINT AS late, bool_and(event_type IN ('view', 'error')) AS all_closing FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE n > 5 GROUP BY 1")
def q20(spark, d):
    return Q.after_seal(table(spark, d, "events"), ["user_id"], "ts", 5, "event_type", ["view", "error"])


@query("q21_citations", "SELECT event_id, unnest(CASE WHEN event_id % 2 = 0 THEN [event_id, event_id + 1, event_id + 2] ELSE [event_id] END) AS cited FROM events")
def q21(spark, d):
    i = F.col("event_id")
    text = F.when(i % 2 == 0, F.format_string("see #%d-#%d for it", i, i + 2)).otherwise(F.format_string("as E-%d says", i))
    return Q.citations(table(spark, d, "events").select("event_id", text.alias("t")), "event_id", "t")


ENTRIES = "SELECT DISTINCT conv_id * 1000 + turn AS seq, role = 'assistant' AS answer, conv_id % 9 = 4 AND turn % 4 = 1 AS old FROM conversations"


@query("q22_support_defects", f"""WITH e AS ({ENTRIES}), live AS (SELECT * FROM e WHERE NOT old), a AS (SELECT seq FROM live WHERE answer),
    c AS (SELECT seq, seq - 1 AS cited FROM e WHERE answer AND (seq // 1000) % 7 <> 0 UNION SELECT seq, seq - 2 FROM e WHERE answer AND (seq // 1000) % 2 = 0 AND seq % 1000 >= 2 UNION SELECT seq, seq + 500 FROM e WHERE answer AND (seq // 1000) % 13 = 0),
    t AS (SELECT DISTINCT conv_id * 1000 + turn AS seq, unnest(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: length(x) >= 10)) AS w FROM conversations), d AS (SELECT doc_id * 1000 + doc_id % 3 AS seq, count(*) AS n FROM labels WHERE quality = 0 AND toxic = 0 GROUP BY 1),
    j AS (SELECT DISTINCT (event_id // 100) * 1000 + user_id % 6 AS seq, event_id FROM events WHERE event_type = 'error' AND value >= 50), ca AS (SELECT c.* FROM c JOIN a USING (seq))
    SELECT seq, 'disputed' AS code, n::BIGINT AS n FROM d WHERE seq IN (SELECT seq FROM live) UNION ALL SELECT seq, 'no_support', 1 FROM a WHERE seq NOT IN (SELECT seq FROM c) UNION ALL SELECT seq, 'missing', count(*) FROM ca WHERE cited NOT IN (SELECT seq FROM e) GROUP BY 1
    UNION ALL SELECT ca.seq, 'replaced', count(*) FROM ca JOIN e ON e.seq = cited AND e.old GROUP BY 1 UNION ALL SELECT ca.seq, 'rests_on_disputed', count(*) FROM ca JOIN d ON d.seq = cited JOIN e ON e.seq = cited GROUP BY 1
    UNION ALL SELECT a.seq, 'unsupported_tokens', count(*) FROM a JOIN t USING (seq) WHERE NOT EXISTS (SELECT 1 FROM c JOIN t u ON u.seq = c.cited WHERE c.seq = a.seq AND u.w = t.w) GROUP BY 1 UNION ALL SELECT seq, 'failed_job', count(*) FROM j WHERE seq IN (SELECT seq FROM live) GROUP BY 1""")
def q22(spark, d):
    """What is wrong with the support of turns as entries: answers rest on the turns that they cite, turns on jobs, labels dispute turns."""
    c, s = table(spark, d, "conversations"), F.col("seq")
    seq = (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")
    conv = F.floor(s / 1000)
    rows = keep(c.select(seq, F.when(F.col("role") == "assistant", "answer").otherwise("entry").alias("kind"), ((F.col("conv_id") % 9 == 4) & (F.col("turn") % 4 == 1)).alias("superseded")).distinct())
    answers = rows.where("kind = 'answer'")
    cites = answers.where(conv % 7 != 0).select("seq", (s - 1).alias("cited")).unionByName(answers.where((conv % 2 == 0) & (s % 1000 >= 2)).select("seq", (s - 2).alias("cited"))).unionByName(answers.where(conv % 13 == 0).select("seq", (s + 500).alias("cited")))
    tokens = c.select(seq, F.explode(F.filter(F.split("text", "[ \n]+"), lambda w: F.length(w) >= 10)).alias("token"))
    disputes = table(spark, d, "labels").where("quality = 0").select((F.col("doc_id") * 1000 + F.col("doc_id") % 3).alias("target"), (F.col("toxic") == 0).alias("stands"))
    of = (F.floor(F.col("event_id") / 100) * 1000 + F.col("user_id") % 6).cast("long")
    rests = table(spark, d, "events").select(of.alias("seq"), F.col("event_id").alias("job"), (F.col("event_type") == "error").alias("failed"), (F.col("value") < 50).alias("qualified"))
    return A.support_defects(rows, cites, tokens, disputes, rests)


ROUTES = "SELECT 'n' || n_nationkey AS route, CASE WHEN n_nationkey % 6 = 5 THEN 'elsewhere' || n_nationkey ELSE 'n' || n_nationkey END AS target FROM nation UNION ALL SELECT 'c' || c_custkey, 'c' || c_custkey FROM customer"


@query("q23_routes_examined", f"""WITH t AS ({TREE}), m AS ({SEARCHED}), r AS ({ROUTES}), s AS (SELECT DISTINCT 'n' || s_nationkey AS target FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT route, CASE WHEN t.node IS NULL THEN 'unexamined' WHEN o.node IS NOT NULL THEN 'object' WHEN c1.node IS NOT NULL OR c2.node IS NOT NULL OR c3.node IS NOT NULL THEN 'container' WHEN s.target IS NOT NULL THEN 'coverage record' ELSE 'unexamined' END AS how,
        CASE WHEN t.node IS NULL THEN 'not tracked' WHEN o.node IS NULL AND c1.node IS NULL AND c2.node IS NULL AND c3.node IS NULL AND s.target IS NULL THEN 'never searched' END AS why
    FROM r LEFT JOIN t ON t.node = r.target LEFT JOIN t u ON u.node = t.parent LEFT JOIN (SELECT node FROM m WHERE how = 'object') o ON o.node = t.node LEFT JOIN (SELECT node FROM m WHERE how = 'container') c1 ON c1.node = t.node
        LEFT JOIN (SELECT node FROM m WHERE how = 'container') c2 ON c2.node = t.parent LEFT JOIN (SELECT node FROM m WHERE how = 'container') c3 ON c3.node = u.parent LEFT JOIN s ON s.target = r.target""")
def q23(spark, d):
    """Routes of the plan, examined by a declared object, a container above it or a coverage record; those that cannot be tracked stay unexamined."""
    tree, searched = places(spark, d)
    cover = T.coverage(tree, "node", "parent", searched.withColumn("note", F.lit(None).cast("string")), False, keep).select(F.col("node").alias("target"), "how")
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    lost = F.concat(F.lit("elsewhere"), F.col("n_nationkey").cast("string"))
    routes = n.select(name.alias("route"), F.when(F.col("n_nationkey") % 6 == 5, lost).otherwise(name).alias("target"))
    own = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    routes = routes.unionByName(c.select(own.alias("route"), own.alias("target")))
    records = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("target"), F.lit(True).alias("record")).distinct()
    met = routes.join(tree.select(F.col("node").alias("target"), F.lit(True).alias("held")), "target", "left").join(cover, "target", "left").join(records, "target", "left")
    how = F.when(F.col("held").isNull(), "unexamined").when(F.col("how").isNotNull(), F.col("how")).when(F.col("record"), "coverage record").otherwise("unexamined")
    return met.select("route", how.alias("how"), F.when(F.col("held").isNull(), "not tracked").when(F.col("how").isNull() & F.col("record").isNull(), "never searched").alias("why"))


@query("q24_quick_negatives", f"""WITH h AS ({HOLDINGS}), l AS (SELECT h.*, epoch_us(t) - epoch_us(f) AS held FROM h JOIN events e ON e.event_id = h.lead WHERE e.value < 60 AND t IS NOT NULL AND epoch_us(t) - epoch_us(f) <= 14400000000),
    j AS (SELECT event_id AS job, user_id % 20 AS seat, ts, user_id AS object FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT event_id, user_id % 20, ts, user_id + 1000 FROM events WHERE event_type = 'click' AND event_id % 4 = 0)
    SELECT lead, held AS held_us, min(job) AS job, min(object) AS object FROM l JOIN j ON j.seat = l.seat AND j.ts >= l.f AND j.ts <= l.t GROUP BY 1, 2 HAVING count(DISTINCT job) = 1 AND count(DISTINCT object) = 1""")
def q24(spark, d):
    """Negative leads that were closed within four hours after one job over one object."""
    e = table(spark, d, "events").withColumn("seat", F.col("user_id") % 20)
    found = e.select(F.col("event_id").alias("lead"), (F.col("value") < 60).alias("negative"))
    jobs = e.where("event_type in ('view', 'click')").select(F.col("event_id").alias("job"), "seat", "ts", F.col("user_id").alias("object"))
    more = e.where("event_type = 'click' and event_id % 4 = 0").select(F.col("event_id").alias("job"), "seat", "ts", (F.col("user_id") + 1000).alias("object"))
    return A.quick_negatives(holdings(spark, d).join(found, "lead"), jobs.unionByName(more), "seat", "f", "t", "ts", 4 * 3600)


@query("q25_preparation_findings", "SELECT o_orderkey, CASE WHEN bool_or(l_linestatus = 'O') THEN 'hold' ELSE 'warn' END AS finding FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' OR l_returnflag = 'R' GROUP BY 1")
def q25(spark, d):
    rows = table(spark, d, "lineitem").where("l_linestatus = 'O' or l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_linestatus") == "O").alias("h"))
    return table(spark, d, "orders").join(rows, "o_orderkey").select("o_orderkey", F.when(F.col("h"), "hold").otherwise("warn").alias("finding"))


@query("q26_seat_state", "SELECT state, count(*)::BIGINT AS n FROM (SELECT user_id, CASE WHEN bool_or(event_type = 'error') AND arg_max(event_type, ts) = 'error' THEN 'dead' WHEN arg_max(event_type, ts) = 'purchase' THEN 'done' WHEN max(ts) < TIMESTAMP '2024-01-25' THEN 'stalled' ELSE 'active' END AS state FROM events GROUP BY 1) GROUP BY 1")
def q26(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("k"), F.max("ts").alias("t"))
    state = F.when(F.col("k") == "error", "dead").when(F.col("k") == "purchase", "done").when(F.col("t") < F.lit("2024-01-25").cast("timestamp_ntz"), "stalled").otherwise("active")
    return last.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("q27_integrity_checks", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'N') THEN 'N' ELSE 'A' END AS status, count(*)::BIGINT AS checks FROM lineitem GROUP BY 1")
def q27(spark, d):
    return Q.worst_status(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["R", "N", "A"])


@query("q28_usage_intervals", "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS covers_us FROM events")
def q28(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", micros("ts").alias("at"))
    near = scan(ranged(rows, ["event_type"], ["at"], keep), ["event_type"], ["at"], previous={"before": F.col("at")})
    return near.select("event_id", (F.col("at") - F.col("before")).alias("covers_us"))


@query("q29_address_owner", f"WITH h AS ({HOLDINGS}) SELECT e.event_id, h.lead AS owner FROM ({SEATS}) e JOIN h ON h.seat = e.seat AND h.f <= e.ts AND (h.t IS NULL OR e.ts < h.t) WHERE e.event_type = 'click'")
def q29(spark, d):
    c = table(spark, d, "events").where("event_type = 'click'").select("event_id", "ts", (F.col("user_id") % 20).alias("seat"))
    return interval_join(c, holdings(spark, d), ["seat"], "ts", "f", "t").select("event_id", F.col("lead").alias("owner"))


@query("q30_counter_delta", "SELECT event_id, round(CASE WHEN b IS NULL THEN NULL WHEN value < b THEN value ELSE value - b END, 4) AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events)")
def q30(spark, d):
    return Q.counter_delta(table(spark, d, "events"), ["user_id"], "ts", "value").select("event_id", F.round("delta", 4).alias("delta"))
