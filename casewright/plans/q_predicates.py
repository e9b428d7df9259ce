"""Filters and predicates on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import predicates as P
from casewright.plans.registry import query, table

FLAGS = ("never", "nothing", "this", "was", "no")


@query("b1_match_any", "SELECT doc_id, (CASE WHEN regexp_matches(text, '(?i)license') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)disgusting') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)trash') THEN 1 ELSE 0 END)::BIGINT AS n FROM documents WHERE regexp_matches(text, '(?i)license|disgusting|trash')")
def b1(spark, d):
    return P.match_any(table(spark, d, "documents"), ["text"], ["license", "disgusting", "trash"]).select("doc_id", F.size("matched").cast("long").alias("n"))


@query("b2_search_page", "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, 'thon') AND NOT regexp_matches(text, '###') ORDER BY doc_id LIMIT 25 OFFSET 10")
def b2(spark, d):
    return P.search(table(spark, d, "documents"), "text", "thon", ["doc_id"], "###", 10, 25)[0].select("doc_id", "lang")


@query("b2_search_count", "SELECT count(*)::BIGINT AS matched FROM documents WHERE regexp_matches(text, 'thon') AND NOT regexp_matches(text, '###')")
def b2c(spark, d):
    return P.search(table(spark, d, "documents"), "text", "thon", ["doc_id"], "###")[1]


@query("b3_filter_events", "SELECT event_id, event_type FROM events WHERE event_type IN ('error','purchase') AND strftime(ts, '%Y-%m-%d %H:%M:%S') LIKE '2024-01-1%' AND contains(lower(replace(props, ' ', '')), '\"k\":1')")
def b3(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type", "props")
    hit = P.filter_events(e.withColumn("props", F.regexp_replace("props", "[ ]", "")), "event_type", ["error", "purchase"], "ts", "2024-01-1", '\\"k\\":1')
    return hit.select("event_id", "event_type")


@query("b4_filter_files", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_name), '1')) AND regexp_matches(p_name, '[0-9]$')")
def b4(spark, d):
    return P.filter_files(table(spark, d, "part"), "p_name", ["a", "1"], "[0-9]$").select("p_partkey", "p_name")


@query("b5_time_window", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-03' AND o_orderdate < TIMESTAMP '1997-05-07'")
def b5(spark, d):
    return P.time_window(table(spark, d, "orders"), "o_orderdate", "1996-02-03", "1997-05-06").select("o_orderkey")


def ledger(spark, d):
    """Orders as a register of entries."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("seq"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("value"), F.col("o_totalprice").alias("price"),
        F.when(key % 11 == 0, key - 7).alias("supersedes"), (key % 13 == 0).alias("sensitive"),
    )


LEDGER = "SELECT o_orderkey AS seq, o_orderdate AS ts, o_orderpriority AS kind, o_orderstatus AS value, o_totalprice AS price, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 7 END AS supersedes, o_orderkey % 13 = 0 AS sensitive FROM orders"
DROPPED = f"""
    WITH l AS ({LEDGER}), s AS (SELECT DISTINCT supersedes AS seq FROM l WHERE supersedes IS NOT NULL)
    SELECT l.*, CASE WHEN kind = '5-LOW' THEN 'not_asked_kind' WHEN ts IS NULL THEN 'undated' WHEN s.seq IS NOT NULL THEN 'superseded' WHEN l.seq % 97 = 0 THEN 'excluded'
      WHEN ts < TIMESTAMP '1995-06-01' OR ts >= TIMESTAMP '2000-01-01' THEN 'range' WHEN value = 'P' THEN 'unmatched' WHEN sensitive THEN 'sensitive' END AS left_out
    FROM l LEFT JOIN s USING (seq)"""


def dropped(spark, d):
    rows = ledger(spark, d)
    gone = rows.select(F.col("supersedes").alias("seq"), F.lit(True).alias("_superseded")).where("seq is not null").distinct()
    return P.account(
        rows.join(gone, "seq", "left"),
        [
            ("not_asked_kind", F.col("kind") == "5-LOW"), ("undated", F.col("ts").isNull()), ("superseded", F.col("_superseded").isNotNull()), ("excluded", F.col("seq") % 97 == 0),
            ("range", (F.col("ts") < "1995-06-01") | (F.col("ts") >= P.upper_bound("1999-12-31"))), ("unmatched", F.col("value") == "P"), ("sensitive", F.col("sensitive")),
        ],
    )


@query("b6_left_out_accounting", f"SELECT coalesce(left_out, 'kept') AS rule, count(*)::BIGINT AS n FROM ({DROPPED}) GROUP BY 1")
def b6(spark, d):
    return dropped(spark, d).groupBy(F.coalesce("left_out", F.lit("kept")).alias("rule")).agg(F.count("*").alias("n"))


@query("a13_timeline", f"SELECT seq, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, kind, value FROM ({DROPPED}) WHERE left_out IS NULL ORDER BY ts, seq")
def a13(spark, d):
    kept = dropped(spark, d).where("left_out is null").orderBy("ts", "seq")
    return kept.select("seq", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "kind", "value")


@query("b7_sensitivity", "SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN '[withheld]' ELSE regexp_replace(d.source, '[0-9]+', '[redacted]', 'g') END AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def b7(spark, d):
    marked = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return P.apply_sensitivity(marked, "toxic", ["source"], "withhold", ["[0-9]+"]).select("doc_id", "source")


_NAMES = "access_token|api_key|auth|key|password|passwd|secret|sig|token"
CARRIED = "SELECT page_id, CASE page_id % 9 WHEN 1 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=t' || page_id || '&sig=s' WHEN 2 THEN replace(url, '://', '://user:pw' || page_id || '@') WHEN 3 THEN url || '#access_token=a' || page_id || '&key=' ELSE url END AS u FROM pages"


@query("b8_mask_urls", f"SELECT page_id, regexp_replace(regexp_replace(u, '(://[^/?#@:]*):[^/?#]*@', '\\1:***@', 'g'), '([?&#](?:{_NAMES})=)[^&#]*', '\\1***', 'g') AS masked, array_to_string(list_sort(list_distinct(CASE WHEN regexp_matches(u, '://[^/?#@:]*:[^/?#]*@') THEN ['user-info'] ELSE [] END || regexp_extract_all(u, '[?&#]({_NAMES})=[^&#]+', 1))), ',') AS withheld FROM ({CARRIED})")
def b8(spark, d):
    """Urls, some with credentials in them, masked; and what was withheld of each."""
    k, url = F.col("page_id"), F.col("url")
    mark = F.when(url.contains("?"), "&").otherwise("?")
    carried = F.when(k % 9 == 1, F.concat(url, mark, F.lit("token=t"), k.cast("string"), F.lit("&sig=s"))).when(k % 9 == 2, F.replace(url, F.lit("://"), F.concat(F.lit("://user:pw"), k.cast("string"), F.lit("@"))))
    carried = carried.when(k % 9 == 3, F.concat(url, F.lit("#access_token=a"), k.cast("string"), F.lit("&key="))).otherwise(url)
    rows = table(spark, d, "pages").select("page_id", carried.alias("u"))
    return rows.select("page_id", P.mask_urls(F.col("u")).alias("masked"), F.array_join(P.withheld_names(F.col("u")), ",").alias("withheld"))


@query("b9_classify_event", "SELECT event_type, CASE WHEN event_type IN ('signup','error') THEN 'infrastructure' WHEN event_type = 'purchase' THEN 'operator' ELSE 'agent' END AS category, event_type = 'error' OR value > 400 AS failed, count(*)::BIGINT AS n FROM events GROUP BY 1, 2, 3")
def b9(spark, d):
    kind = F.when(F.col("event_type").isin("signup", "error"), "infrastructure").when(F.col("event_type") == "purchase", "operator").otherwise("agent")
    failed = (F.col("event_type") == "error") | (F.col("value") > 400)
    return table(spark, d, "events").groupBy("event_type", kind.alias("category"), failed.alias("failed")).agg(F.count("*").alias("n"))


@query("b10_flag_phrases", "SELECT doc_id, " + " || ".join(f"CASE WHEN regexp_matches(text, '(?i){P.EDGE[0]}{p}{P.EDGE[1]}') THEN '{p};' ELSE '' END" for p in FLAGS) + " AS flags FROM documents")
def b10(spark, d):
    used = P.flag_phrases(F.col("text"), FLAGS)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(used, lambda x: F.concat(x, F.lit(";"))), "").alias("flags"))


@query("b11_normalise_indicators", "SELECT kind, count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS different FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS v, 'domain' AS kind FROM pages UNION ALL SELECT url, 'url' FROM pages UNION ALL SELECT md5(text), 'md5' FROM benchmark) GROUP BY 1")
def b11(spark, d):
    pages = table(spark, d, "pages")
    shown = F.regexp_replace(F.regexp_replace("url", "^http", "hxxp"), r"\.", "[.]")
    raw = pages.select(F.regexp_extract(shown, "://([^/?#]*)", 1).alias("raw")).unionByName(pages.select(shown.alias("raw"))).unionByName(table(spark, d, "benchmark").select(F.md5("text").alias("raw")))
    typed = raw.select(P.refang(F.col("raw")).alias("v")).withColumn("kind", P.indicator_type(F.col("v")))
    return typed.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("v").alias("different"))


READERS = (("html", r"\.html([?#]|$)"), ("page", r"[?&]page=[0-9]+"), ("feed", "utm_source=feed"))


@query("b12_match_readers", "SELECT page_id, CASE WHEN contains(url, 'utm_source=feed') THEN 'feed,' ELSE '' END || CASE WHEN regexp_matches(url, '\\.html([?#]|$)') THEN 'html,' ELSE '' END || CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') THEN 'page,' ELSE '' END AS readers FROM pages")
def b12(spark, d):
    names = P.matching_readers(F.col("url"), READERS)
    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(names, lambda x: F.concat(x, F.lit(","))), "").alias("readers"))


@query("b13_secret_shaped", "SELECT doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS w FROM documents) WHERE length(w) BETWEEN 12 AND 128 AND regexp_matches(w, '^[A-Za-z0-9+/_=.-]+$') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') GROUP BY 1")
def b13(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "[ \\n]+")).alias("w"))
    return words.where(P.secret_shaped(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("b14_outcome", "SELECT CASE WHEN event_type IN ('purchase','signup') THEN 'success' WHEN event_type = 'error' THEN 'failure' ELSE 'interrupt' END AS outcome, count(*)::BIGINT AS n FROM events GROUP BY 1")
def b14(spark, d):
    ok = P.outcome(F.col("event_type"), ["purchase", "signup"], ["error"])
    name = F.when(ok, "success").when(~ok, "failure").otherwise("interrupt")
    return table(spark, d, "events").groupBy(name.alias("outcome")).agg(F.count("*").alias("n"))


@query("b15_flag_notable", "SELECT event_id, CASE WHEN event_type IN ('signup') THEN 'credential' WHEN event_type IN ('purchase','error') THEN 'policy' END AS notable FROM events")
def b15(spark, d):
    return table(spark, d, "events").select("event_id", P.flag_notable(F.col("event_type"), {"credential": ["signup"], "policy": ["purchase", "error"]}).alias("notable"))
