"""Scalar functions and corpus scans on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright import functions as X
from casewright.operators import joins as J
from casewright.operators import texts as T
from casewright.operators.joins import micros
from casewright.operators.sequence import haversine
from casewright.operators import quantiles as Z
from casewright.operators import zones as Zn
from casewright.operators.sweep import leak_scan, sweep
from casewright.plans.q_joins import NEEDLES, needles
from casewright.plans.registry import query, table
from casewright.sources.scratch import drop, keep

NUM = "(event_id * 1000003 + 1704067200)"


def _clock_sql(name, ticks, zero):
    v = f"{NUM}::HUGEINT"
    us = f"{v} * {1_000_000 // ticks}" if ticks <= 1_000_000 else f"{v} // {ticks // 1_000_000}"
    return f"SELECT event_id, '{name}' AS clock, ({us} + {zero}::HUGEINT * 1000000)::BIGINT AS micros FROM events"


@query("h1_epoch_candidates", "SELECT event_id, clock, micros, micros BETWEEN 0 AND 4102444800000000 AS plausible FROM (" + " UNION ALL ".join(_clock_sql(*c) for c in X.CLOCKS) + ")")
def h1(spark, d):
    rows = table(spark, d, "events").select("event_id", F.inline(X.epoch_candidates(F.expr(NUM))))
    return rows.withColumn("micros", F.col("micros").cast("long"))


@query("h2_dos_datetime", "SELECT p_partkey, CASE WHEN m BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 28 AND h < 24 AND mi < 60 AND s < 60 THEN epoch_us(make_timestamp(y::BIGINT, m::BIGINT, dd::BIGINT, h::BIGINT, mi::BIGINT, s::DOUBLE)) END AS us FROM (SELECT p_partkey, (w >> 25) % 128 + 1980 AS y, (w >> 21) % 16 AS m, (w >> 16) % 32 AS dd, (w >> 11) % 32 AS h, (w >> 5) % 64 AS mi, (w % 32) * 2 AS s FROM (SELECT p_partkey, (p_partkey * 7919 + p_size * 65536 + 1000000000) % 2147483648 AS w FROM part)) WHERE dd <= 28")
def h2(spark, d):
    w = F.expr("(p_partkey * 7919 + p_size * 65536 + 1000000000) % 2147483648")
    rows = table(spark, d, "part").withColumn("w", w).where(F.shiftright("w", 16).bitwiseAND(F.lit(31)) <= 28)
    return rows.select("p_partkey", micros(X.dos_datetime(F.col("w"))).alias("us"))


@query("h2_ole_date", "SELECT p_partkey, round((w + abs(x - w) - 25569) * 86400000000)::BIGINT AS us FROM (SELECT p_partkey, x, CASE WHEN x >= 0 THEN floor(x) ELSE ceil(x) END AS w FROM (SELECT p_partkey, (p_size - 25) * 100 + (p_partkey % 8) / 8.0 AS x FROM part))")
def h2o(spark, d):
    return table(spark, d, "part").select("p_partkey", X.ole_micros(F.expr("(p_size - 25) * 100 + cast(p_partkey % 8 as double) / 8.0")).alias("us"))


#: Changes of local time in 2024 (fixed values): zone, from, to (UTC), hours ahead of UTC in between.
ZONES_2024 = """(VALUES ('Europe/Berlin', TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31 01:00', 1.0), ('Europe/Berlin', '2024-03-31 01:00', '2024-10-27 01:00', 2), ('Europe/Berlin', '2024-10-27 01:00', '2025-01-01', 1),
    ('America/New_York', '2024-01-01', '2024-03-10 07:00', -5), ('America/New_York', '2024-03-10 07:00', '2024-11-03 06:00', -4), ('America/New_York', '2024-11-03 06:00', '2025-01-01', -5), ('Asia/Kolkata', '2024-01-01', '2025-01-01', 5.5)) z(zone, f, t, h)"""
WALL = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Europe/Berlin' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Kolkata' END AS zone,
    CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN TIMESTAMP '2024-03-31 00:30' ELSE TIMESTAMP '2024-10-27 00:30' END WHEN 1 THEN CASE WHEN event_id % 8 = 1 THEN TIMESTAMP '2024-03-10 00:30' ELSE TIMESTAMP '2024-11-03 00:30' END ELSE date_trunc('minute', ts) END + to_minutes(CASE WHEN event_id % 4 < 2 THEN event_id % 240 ELSE 0 END) AS wall FROM events"""


@query("h3_to_utc", f"WITH w AS ({WALL}), m AS (SELECT w.event_id, count(z.h) AS n, min(epoch_us(wall) - (h * 3600000000)::BIGINT) AS a, max(epoch_us(wall) - (h * 3600000000)::BIGINT) AS b FROM w LEFT JOIN {ZONES_2024} ON z.zone = w.zone AND epoch_us(wall) - (h * 3600000000)::BIGINT >= epoch_us(f) AND epoch_us(wall) - (h * 3600000000)::BIGINT < epoch_us(t) GROUP BY 1) SELECT event_id, CASE WHEN n >= 1 THEN a END AS us, CASE WHEN n = 2 THEN b END AS or_us, CASE WHEN zone IS NULL THEN 'no zone' WHEN n = 0 THEN 'non-existent' WHEN n = 2 THEN 'ambiguous' ELSE 'converted' END AS basis FROM w JOIN m USING (event_id)")
def h3(spark, d):
    """Wall-clock times around the changes of two zones, and of one without any; a time without a zone is named, never read as UTC."""
    k = F.col("event_id")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    base = F.when(k % 8 == 0, at("2024-03-31 00:30:00")).when(k % 4 == 0, at("2024-10-27 00:30:00")).when(k % 8 == 1, at("2024-03-10 00:30:00")).when(k % 4 == 1, at("2024-11-03 00:30:00"))
    minutes = F.when(base.isNull(), 0).otherwise(k % 240).cast("int")
    wall = F.coalesce(base, F.date_trunc("minute", "ts").cast("timestamp_ntz")) + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0).cast("decimal(18,6)"))
    zone = F.when(k % 4 == 0, "Europe/Berlin").when(k % 4 == 1, "America/New_York").when(k % 4 == 2, "Asia/Kolkata")
    rows = table(spark, d, "events").select("event_id", zone.alias("zone"), wall.alias("wall"))
    return Zn.local_to_utc(rows, "event_id", "wall", "zone", Zn.transitions(spark, rows.select("zone"), 2024, 2024), keep)


@query("h4_date_order", "SELECT o_orderpriority, CASE WHEN max(day(o_orderdate)) > 12 AND max(month(o_orderdate)) <= 12 THEN 'day_first' ELSE 'unproved' END AS date_order FROM orders GROUP BY 1")
def h4(spark, d):
    raw = table(spark, d, "orders").select("o_orderpriority", F.split(F.date_format("o_orderdate", "dd/MM/yyyy"), "/").alias("p"))
    first, second = F.max(F.col("p")[0].cast("int")), F.max(F.col("p")[1].cast("int"))
    return raw.groupBy("o_orderpriority").agg(F.when((first > 12) & (second <= 12), "day_first").when((second > 12) & (first <= 12), "month_first").otherwise("unproved").alias("date_order"))


@query("h5_bit_flags", "SELECT l_orderkey, l_linenumber, " + " || ".join(f"CASE WHEN l_partkey & {1 << i} <> 0 THEN '{n},' ELSE '' END" for i, n in enumerate("abcde")) + " AS flags FROM lineitem")
def h5(spark, d):
    flags = X.bit_flags(F.col("l_partkey"), "abcde")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(flags, lambda x: F.concat(x, F.lit(","))), "").alias("flags"))


_AZ, _NM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
CODED = f"SELECT doc_id, coalesce(d.text, '') || ' ' || CASE doc_id % 6 WHEN 0 THEN lower(hex(encode(b.text))) WHEN 1 THEN hex(encode(b.text)) WHEN 2 THEN to_base64(encode(b.text)) WHEN 3 THEN to_base64(encode('a' || b.text || 'z')) WHEN 4 THEN to_base64(encode('bc' || b.text)) ELSE translate(b.text, '{_AZ}', '{_NM}') END AS t FROM documents d JOIN benchmark b ON b.item_id = doc_id % 40"
_PHASE = "substr(to_base64(encode({0} || text)), {1} + 1, 8 * ({2} + strlen(text)) // 6 - {1})"


@query("h6_decode", f"WITH f AS ({CODED}), n AS (SELECT item_id, 'hex' AS form, lower(hex(encode(text))) AS w FROM benchmark UNION ALL SELECT item_id, 'hex', hex(encode(text)) FROM benchmark UNION ALL SELECT item_id, 'base64', {_PHASE.format(chr(39) * 2, 0, 0)} FROM benchmark UNION ALL SELECT item_id, 'base64', {_PHASE.format(chr(39) + 'a' + chr(39), 2, 1)} FROM benchmark UNION ALL SELECT item_id, 'base64', {_PHASE.format(chr(39) + 'aa' + chr(39), 3, 2)} FROM benchmark UNION ALL SELECT item_id, 'rot13', translate(text, '{_AZ}', '{_NM}') FROM benchmark UNION ALL SELECT item_id, 'plain', text FROM benchmark) SELECT doc_id, item_id, form, min(instr(t, w))::BIGINT AS first FROM f JOIN n ON contains(t, w) GROUP BY 1, 2, 3")
def h6(spark, d):
    """Literals hunted in any text in the forms that hide them: hex, base64 wherever they begin in what was encoded, rot13."""
    lit = table(spark, d, "benchmark").select("item_id", "text")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), (F.col("doc_id") % 40).alias("item_id")).join(lit, "item_id")
    k, raw = F.col("doc_id") % 6, lambda *c: F.encode(F.concat(*c), "UTF-8")
    coded = F.when(k == 0, F.lower(F.hex(raw("text")))).when(k == 1, F.hex(raw("text"))).when(k == 2, F.base64(raw("text"))).when(k == 3, F.base64(raw(F.lit("a"), "text", F.lit("z")))).when(k == 4, F.base64(raw(F.lit("bc"), "text"))).otherwise(X.rot13(F.col("text")))
    plain = F.when(k.isin(2, 3, 4), F.regexp_replace(coded, "[\r\n]", "")).otherwise(coded)
    files = docs.select("doc_id", F.concat("t", F.lit(" "), plain).alias("t"))
    found = sweep(files, "doc_id", "t", lit, "item_id", "text", keep, ("plain", "hex", "base64", "rot13"))
    return found.groupBy("doc_id", "item_id", "form").agg(F.min("at").alias("first"))


@query("h7_extract_urls", "SELECT page_id, len(regexp_extract_all(html, 'https?://[^ \"<>]+'))::BIGINT AS n FROM pages")
def h7(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.expr("regexp_extract_all(html, 'https?://[^ \"<>]+', 0)")).cast("long").alias("n"))


PATH = "regexp_extract(url, '://[^/]*([^?#]*)', 1)"


@query("h8_path_helpers", f"SELECT page_id, lower(regexp_extract({PATH}, '\\.([A-Za-z0-9]+)$', 1)) AS ext, string_split({PATH}, '/')[-1] AS base, (len(string_split({PATH}, '/')) - 1)::BIGINT AS depth FROM pages")
def h8(spark, d):
    p = F.regexp_extract("url", "://[^/]*([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", X.extension(p).alias("ext"), X.basename(p).alias("base"), F.size(X.ancestors(p)).cast("long").alias("depth"))


@query("h9_domain_features", "SELECT page_id, length(h)::BIGINT AS chars, len(string_split(h, '.'))::BIGINT AS labels, round(length(regexp_replace(h, '[^0-9]', '', 'g')) / length(h), 4) AS digits FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages)")
def h9(spark, d):
    h = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, d, "pages").select("page_id", F.length(h).cast("long").alias("chars"), F.size(F.split(h, r"\.")).cast("long").alias("labels"), F.round(F.length(F.regexp_replace(h, "[^0-9]", "")) / F.length(h), 4).alias("digits"))


@query("h10_entropy", "WITH c AS (SELECT doc_id, w, unnest(regexp_extract_all(t, '(?s).')) AS c FROM (SELECT doc_id, unnest(range(len(ws))) AS w, unnest(ws) AS t FROM (SELECT doc_id, regexp_extract_all(text, '(?s).{1,256}') AS ws FROM documents))), n AS (SELECT doc_id, w, c, count(*) AS n FROM c GROUP BY 1, 2, 3), b AS (SELECT doc_id, w, -sum(n / t * log2(n / t)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id, w) AS t FROM n) GROUP BY 1, 2) SELECT doc_id, count(*)::BIGINT AS windows, round(max(bits), 4) AS highest, round(avg(bits), 4) AS mean, count(*) FILTER (round(bits, 6) > 4.2)::BIGINT AS high FROM b GROUP BY 1")
def h10(spark, d):
    """Entropy of every window of 256 characters of the whole text, and how many are high."""
    bits = X.window_entropy(table(spark, d, "documents"), "doc_id", "text", 256)
    return bits.groupBy("doc_id").agg(F.count("*").alias("windows"), F.round(F.max("bits"), 4).alias("highest"), F.round(F.avg("bits"), 4).alias("mean"), F.count_if(F.round("bits", 6) > 4.2).alias("high"))


@query("h11_human_units", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey * 1000 >= 1048576 THEN printf('%.1f MB', l_partkey * 1000 / 1048576.0) WHEN l_partkey * 1000 >= 1024 THEN printf('%.1f KB', l_partkey * 1000 / 1024.0) ELSE printf('%d B', l_partkey * 1000) END AS size FROM lineitem")
def h11(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.human_bytes(F.col("l_partkey") * 1000).alias("size"))


@query("h12_sanitise", "SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '.', 'g')) AS clean FROM documents")
def h12(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.sanitise(F.col("text"))).alias("clean"))


@query("h13_canonical_digest", "SELECT event_id, sha256('{\"k\":\"' || json_extract_string(props, '$.k') || '\",\"type\":\"' || event_type || '\"}') AS digest FROM events")
def h13(spark, d):
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", X.canonical_digest(m).alias("digest"))


@query("h14_leading_command", "SELECT doc_id, regexp_extract(text, '^\\s*(\\S+)', 1) AS command FROM documents WHERE NOT contains(regexp_extract(text, '^\\s*(\\S+)', 1), '/') AND NOT contains(regexp_extract(text, '^\\s*(\\S+)', 1), '=')")
def h14(spark, d):
    first = X.first_word(F.col("text"))
    line = F.concat(F.lit("LANG=C sudo /usr/bin/"), F.regexp_replace("text", f"^{X.BLANK}+", ""))
    return table(spark, d, "documents").where(~first.contains("/") & ~first.contains("=")).select("doc_id", X.leading_command(line).alias("command"))


_A, _B = "(event_id * 37) % 256", "(event_id * 101 + 7) % 256"
ADDRESSES = f"""SELECT event_id, value, user_id, CASE event_id % 10 WHEN 0 THEN '10.' || {_A} || '.0.1' WHEN 1 THEN '172.' || event_id * 7 % 64 || '.3.' || {_B} WHEN 2 THEN '192.' || (160 + event_id % 16) || '.2.' || {_A} WHEN 3 THEN '100.' || event_id * 11 % 256 || '.9.9' WHEN 4 THEN {_B} || '.' || {_A} || '.2.5'
    WHEN 5 THEN '::ffff:10.0.' || {_A} || '.1' WHEN 6 THEN 'FE80::' || event_id WHEN 7 THEN 'fd12::' || event_id WHEN 8 THEN '2a00::' || event_id ELSE (256 + event_id % 9) || '.1.1.1' END AS a, {_B} || '.' || {_A} || '.' || (event_id % 256) || '.1' AS b FROM events"""
_CLASS = """CASE WHEN {0} LIKE 'FE80::%' THEN 'link_local' WHEN {0} LIKE 'fd12::%' THEN 'private' WHEN {0} LIKE '2a00::%' THEN 'public' WHEN {0} LIKE '::ffff:10.%' THEN 'private' WHEN {1} > 255 THEN 'invalid' WHEN {1} = 0 OR {1} >= 240 OR ({1} = 198 AND {2} IN (18, 19)) THEN 'reserved'
    WHEN {1} = 10 OR ({1} = 172 AND {2} BETWEEN 16 AND 31) OR ({1} = 192 AND {2} = 168) THEN 'private' WHEN {1} = 100 AND {2} BETWEEN 64 AND 127 THEN 'shared' WHEN {1} = 127 THEN 'loopback' WHEN {1} = 169 AND {2} = 254 THEN 'link_local'
    WHEN ({1} = 192 AND {2} = 0 AND {3} = 2) OR ({1} = 198 AND {2} = 51 AND {3} = 100) OR ({1} = 203 AND {2} = 0 AND {3} = 113) THEN 'documentation' WHEN {1} >= 224 THEN 'multicast' ELSE 'public' END"""
_PART = "TRY_CAST(split_part({}, '.', {}) AS INT)"
_OWN = "IN ('private', 'shared', 'loopback', 'link_local')"


@query("h15_address_class", f"""WITH d AS ({ADDRESSES}), c AS (SELECT *, {_CLASS.format('a', *(_PART.format('a', i) for i in (1, 2, 3)))} AS ca, {_CLASS.format('b', *(_PART.format('b', i) for i in (1, 2, 3)))} AS cb, user_id % 180 - 90 AS y1, user_id * 7 % 360 - 180 AS x1, event_id % 180 - 90 AS y2, event_id * 3 % 360 - 180 AS x2 FROM d)
    SELECT event_id, ca AS source_class, CASE WHEN ca = 'invalid' OR cb = 'invalid' THEN 'unknown' WHEN ca {_OWN} AND cb {_OWN} THEN 'internal' WHEN ca {_OWN} THEN 'outbound' WHEN cb {_OWN} THEN 'inbound' ELSE 'external' END AS side,
        round(2 * 6371 * asin(sqrt(least(1.0, sin(radians(y2 - y1) / 2) ** 2 + cos(radians(y1)) * cos(radians(y2)) * sin(radians(x2 - x1) / 2) ** 2))), 3) AS km FROM c""")
def h15(spark, d):
    """The class of each source, which way the traffic went, and how far apart two places are."""
    k, u, s = F.col("event_id"), F.col("user_id"), lambda c: c.cast("string")
    a, b = s((k * 37) % 256), s((k * 101 + 7) % 256)
    join = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    forms = [join("10.", a, ".0.1"), join("172.", s(k * 7 % 64), ".3.", b), join("192.", s(k % 16 + 160), ".2.", a), join("100.", s(k * 11 % 256), ".9.9"), join(b, ".", a, ".2.5"), join("::ffff:10.0.", a, ".1"), join("FE80::", s(k)), join("fd12::", s(k)), join("2a00::", s(k))]
    source = join(s(k % 9 + 256), ".1.1.1")
    for i, form in enumerate(forms):
        source = F.when(k % 10 == i, form).otherwise(source)
    rows = table(spark, d, "events").select("event_id", source.alias("a"), join(b, ".", a, ".", s(k % 256), ".1").alias("b"), (u % 180 - 90).alias("y1"), (u * 7 % 360 - 180).alias("x1"), (k % 180 - 90).alias("y2"), (k * 3 % 360 - 180).alias("x2"))
    km = haversine(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    classed = rows.select("event_id", X.address_class(F.col("a")).alias("source_class"), X.address_class(F.col("b")).alias("target_class"), F.round(km, 3).alias("km"))
    return classed.select("event_id", "source_class", X.side_of(F.col("source_class"), F.col("target_class")).alias("side"), "km")


@query("h16_time_anomalies", "SELECT l_orderkey, l_linenumber, l_shipdate < o_orderdate AS before_creation, epoch_us(l_shipdate) % 1000000 = 0 AS zero_fraction FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def h16(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("l_orderkey", "l_linenumber", (F.col("l_shipdate") < F.col("o_orderdate")).alias("before_creation"), (F.date_format("l_shipdate", "SSSSSS") == "000000").alias("zero_fraction"))


WORDSET = "SELECT id, w FROM (SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[0-9a-f]{8,}|[0-9]+', ' ', 'g'), '[^\\p{L}]+'), lambda x: x <> ''))) AS w FROM documents) WHERE len(w) >= 5"


PAIRS = f"WITH c AS (SELECT w, min(id) AS id FROM ({WORDSET}) GROUP BY 1) SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id < b.id AND len(a.w) >= 0.8 * len(b.w) AND len(b.w) >= 0.8 * len(a.w) WHERE len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))"


MEMBERS = f"m AS (SELECT s.id, c.id AS class, c.n FROM ({WORDSET}) s JOIN (SELECT w, min(id) AS id, count(*) AS n FROM ({WORDSET}) GROUP BY 1) c ON s.w = c.w)"


@query("j1_template_groups", f"WITH RECURSIVE p AS ({PAIRS}), {MEMBERS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.node), g AS (SELECT node, min(g) AS g FROM r GROUP BY 1) SELECT m.id AS node, coalesce(g.g, m.class) AS \"group\" FROM m LEFT JOIN g ON g.node = m.class WHERE g.g IS NOT NULL OR m.n > 1")
def j1(spark, d):
    """Every text of a template, copies too, under the smallest id of the group."""
    members, classes = T.word_classes(table(spark, d, "documents"), "doc_id", "text", keep)
    pairs = T.similar_classes(classes, keep)
    linked = J.groups(pairs, keep).withColumnRenamed("node", "class")
    drop(pairs, classes)
    met = members.join(linked, "class", "left").where("group is not null or size > 1")
    return met.select(F.col("id").alias("node"), F.coalesce("group", "class").alias("group"))


@query("j2_similar_pairs", f"WITH p AS ({PAIRS}), {MEMBERS}, l AS (SELECT a AS class, sum(n) AS others FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) JOIN (SELECT DISTINCT class AS b, n FROM m) USING (b) GROUP BY 1) SELECT m.id AS doc_id, m.class, m.n - 1 AS copies, (m.n - 1 + coalesce(others, 0))::BIGINT AS links, 'compared' AS status FROM m LEFT JOIN l USING (class) UNION ALL SELECT doc_id, NULL, NULL, NULL, 'unavailable' FROM documents WHERE doc_id NOT IN (SELECT id FROM ({WORDSET}))")
def j2(spark, d):
    """Every text with its class of equal word sets and its number of similar texts; texts with too few words are unavailable."""
    docs = table(spark, d, "documents")
    out = T.similar_texts(docs, "doc_id", "text", keep).withColumnRenamed("id", "doc_id").withColumn("status", F.lit("compared"))
    few = T.comparable(docs, "doc_id", "text").where("not comparable").select("doc_id", F.lit("unavailable").alias("status"))
    return out.unionByName(few, allowMissingColumns=True)


HOSTS = "SELECT DISTINCT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS n FROM pages"


@query("j3_lookalikes", f"SELECT DISTINCT a.n AS name, b.n AS known FROM ({HOSTS}) a JOIN ({HOSTS}) b ON b.page_id % 10 = 0 AND a.n <> b.n AND levenshtein(a.n, b.n) <= 2 WHERE a.n <> '' AND b.n <> ''")
def j3(spark, d):
    """Whole host names within two edits of a known one."""
    hosts = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("n")).where("n <> ''")
    return T.lookalikes(hosts, "n", hosts.where("page_id % 10 = 0"), "n", 2)


#: Headers of file types, by name (fixed values, public formats), as hex.
SIGNATURES = {
    "bmp": "424D", "gif87": "474946383761", "gif89": "474946383961", "gzip": "1F8B08", "html": "3C21", "jpeg": "FFD8FF", "lnk": "4C00000001140200", "mp4": "66747970", "ole": "D0CF11E0A1B11AE1", "pdf": "255044462D", "pe": "4D5A",
    "png": "89504E470D0A1A0A", "rar": "526172211A07", "regf": "72656766", "7z": "377ABCAF271C", "sqlite": "53514C69746520666F726D6174203300", "zip": "504B0304",
}
#: A signature in hex is inside the page, at a place that its number fixes.
PLANTED = "SELECT page_id, hex(encode(coalesce(html, ''))) || CASE page_id % 20 " + " ".join(f"WHEN {i} THEN '{h}00{h}'" for i, h in enumerate(SIGNATURES.values())) + " ELSE '' END || '00' AS h FROM pages"


@query("j4_signature_scan", f"SELECT page_id, name, (o + p - 2) // 2 AS \"at\" FROM (SELECT page_id, name, sig, o, blk, unnest(range(1, 201, 2)) AS p FROM (SELECT page_id, o, substring(h, o::INT, 240) AS blk FROM (SELECT page_id, h, unnest(range(1, length(h) + 1, 200)) AS o FROM ({PLANTED}))), (VALUES " + ", ".join(f"('{n}', '{h}')" for n, h in SIGNATURES.items()) + ") s(name, sig) WHERE contains(blk, sig)) WHERE substring(blk, p::INT, length(sig)) = sig")
def j4(spark, d):
    """Every place of every header, at any offset and overlapping too, in binary content; what is found is a candidate, not a file."""
    k = F.col("page_id") % 20
    tail = F.lit("")
    for i, h in enumerate(SIGNATURES.values()):
        tail = F.when(k == i, F.lit(f"{h}00{h}")).otherwise(tail)
    raw = F.concat(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), F.unhex(F.concat(tail, F.lit("00"))))
    known = spark.createDataFrame(list(SIGNATURES.items()), "name string, h string").select("name", F.unhex("h").alias("sig"))
    found = sweep(table(spark, d, "pages").select("page_id", raw.alias("raw")), "page_id", "raw", known, "name", "sig", keep)
    return found.select("page_id", "name", (F.col("at") - 1).alias("at"))


@query("j5_reverse_sweep", f"SELECT item_id, count(*)::BIGINT AS hits, count(DISTINCT doc_id)::BIGINT AS outputs, count(*) FILTER (doc_id = own)::BIGINT AS named, CASE WHEN bool_or(doc_id <> own) THEN 'held' ELSE 'stands' END AS negative FROM (SELECT DISTINCT doc_id, item_id, own, \"at\" FROM ({NEEDLES})) GROUP BY 1")
def j5(spark, d):
    """What each record looked for, over every output: a hit outside the object that the record names holds its negative."""
    asked = needles(spark, d).select(F.struct("item_id", "own").alias("record"), "n")
    hits = sweep(table(spark, d, "documents"), "doc_id", "text", asked, "record", "n", keep).select("doc_id", "record.item_id", "record.own")
    outside = F.bool_or(F.col("doc_id") != F.col("own"))
    return hits.groupBy("item_id").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("outputs"), F.count_if(F.col("doc_id") == F.col("own")).alias("named"), F.when(outside, "held").otherwise("stands").alias("negative"))


def _run_sql(kind, least, more=""):
    out = f"(regexp_extract(b, '([{kind}]*)$', 1) || regexp_extract(e, '^([{kind}]*)', 1))"
    size = f"(length({out}) + length(w))"
    marks = f"length(regexp_replace({out} || w, '[0-9A-Za-z]', '', 'g'))"
    return f"(regexp_matches(w, '^[{kind}]+$') AND {size} >= {least} AND regexp_matches({out}, '[0-9]')" + (f" AND regexp_matches({out}, '[A-Za-z]') AND {marks} * 8 < {size})" if more else ")")


#: Whether a short word ``w`` between ``b`` and ``e`` is a part of a longer number, hex string or base64 string.
IN_RUN = f"(regexp_matches(right(b, 1) || left(w, 1), '^[0-9][0-9]$') OR regexp_matches(right(w, 1) || left(e, 1), '^[0-9][0-9]$') OR {_run_sql('0-9A-Fa-f', 16)} OR {_run_sql('0-9A-Za-z+/', 20, 'x')} OR {_run_sql('0-9A-Za-z_-', 20, 'x')})"
WIDE = "regexp_replace({}, '(.)', '\\1' || chr(0), 'gs')"
FILES = f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN {WIDE.format('t')} WHEN doc_id % 7 = 1 THEN replace(replace(replace(t, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') ELSE t END AS t FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' ' || upper(md5(text)) ELSE text END AS t FROM documents)"""
LEAKS = f"""WITH w0 AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS w FROM documents), words AS (SELECT w FROM w0 JOIN labels USING (doc_id) WHERE w <> '' AND (length(w) >= 10 OR (length(w) >= 6 AND regexp_matches(w, '[^\\p{{L}}\\s]'))) GROUP BY 1 HAVING min(toxic) = 1),
    who AS (SELECT 'word' AS kind, w AS id, w, 'plain' AS form FROM words UNION ALL SELECT 'word', w, {WIDE.format('w')}, 'utf16' FROM words UNION ALL SELECT DISTINCT 'digest', doc_id::VARCHAR, md5(text), 'plain' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT DISTINCT 'digest', doc_id::VARCHAR, upper(md5(text)), 'plain' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
        UNION ALL SELECT DISTINCT 'digest', doc_id::VARCHAR, {WIDE.format('md5(text)')}, 'utf16' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT DISTINCT 'digest', doc_id::VARCHAR, {WIDE.format('upper(md5(text))')}, 'utf16' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
        UNION ALL SELECT 'word', w, replace(replace(w, '\\', '\\\\'), '"', '\\"'), 'json' FROM words WHERE contains(w, '"') OR contains(w, '\\')
        UNION ALL SELECT 'word', w, array_to_string([CASE WHEN unicode(c) > 126 THEN '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE c END for c in string_split(replace(replace(w, '\\', '\\\\'), '"', '\\"'), '')], ''), 'json' FROM words WHERE regexp_matches(w, '[^ -~]')),
    files AS MATERIALIZED ({FILES}), blocks AS MATERIALIZED (SELECT doc_id, o, substring(t, o::INT, 768) AS blk FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1, 512)) AS o FROM files)),
    near AS (SELECT doc_id, kind, id, form, w, o, blk, unnest(range(1, 513)) AS p FROM blocks, who WHERE (form = 'utf16') = (doc_id % 7 = 0) AND contains(blk, w)),
    hit AS (SELECT n.*, o + p - 1 AS "at", t FROM near n JOIN files USING (doc_id) WHERE substring(blk, p::INT, length(w)) = w),
    place AS (SELECT doc_id, kind, id, form, "at", CASE WHEN kind = 'word' AND length(id) < 8 THEN id END AS w, CASE WHEN form = 'utf16' THEN replace(b, chr(0), '') ELSE b END AS b, CASE WHEN form = 'utf16' THEN replace(e, chr(0), '') ELSE e END AS e
        FROM (SELECT *, substring(t, greatest(1, "at" - 64), least("at" - 1, 64)) AS b, substring(t, "at" + length(w), 64) AS e FROM hit))"""


@query("j6_leak_scan", f"{LEAKS} SELECT doc_id, kind, form, count(*)::BIGINT AS places, count(DISTINCT id)::BIGINT AS found, min(\"at\")::BIGINT AS first FROM place WHERE w IS NULL OR NOT {IN_RUN} GROUP BY 1, 2, 3")
def j6(spark, d):
    """Every secret-shaped word of marked texts that no text marked clean has, and every marked text's digest, in what is to be published: plain, UTF-16LE and JSON-escaped."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    split = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \\n]+"))).alias("w"))
    shaped = (F.length("w") >= 10) | ((F.length("w") >= 6) & F.col("w").rlike(r"[^\p{L}\s]"))
    words = split.where("w <> ''").where(shaped).join(labels, "doc_id").groupBy("w").agg(F.min("toxic").alias("t")).where("t = 1").select("w")
    digests = docs.select("doc_id", F.md5("text").alias("h")).join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id")
    k = F.col("doc_id")
    t = F.when(k % 5 == 0, F.concat("text", F.lit(" "), F.upper(F.md5("text")))).otherwise(F.col("text"))
    quoted = F.replace(F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    files = docs.select("doc_id", F.when(k % 7 == 0, F.regexp_replace(t, "(?s)(.)", "$1\u0000")).when(k % 7 == 1, quoted).otherwise(t).alias("t"))
    found = leak_scan(files, "doc_id", "t", words, "w", "w", digests, "doc_id", "h", keep)
    return found.groupBy("doc_id", "kind", "form").agg(F.count("*").alias("places"), F.count_distinct("id").alias("found"), F.min("at").alias("first"))


KINDS = {"email": "[a-z0-9._]+@[a-z0-9]+[.][a-z]+", "address": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "number": "[0-9]{9,}"}


@query("j7_features", "SELECT kind, value, count(*)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for k, p in KINDS.items()) + ") GROUP BY 1, 2")
def j7(spark, d):
    return T.features(table(spark, d, "documents"), "doc_id", "text", KINDS).groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("j8_new_paths", f"WITH p AS (SELECT page_id, {PATH} AS path, page_id % 4 = 0 AS recovered FROM pages) SELECT path, min(page_id) FILTER (recovered) AS first, count(*) FILTER (recovered)::BIGINT AS recovered, count(*) FILTER (NOT recovered)::BIGINT AS held, CASE WHEN count(*) FILTER (NOT recovered) = 0 THEN 'only recovered' ELSE 'in both' END AS standing FROM p GROUP BY 1 HAVING bool_or(recovered)")
def j8(spark, d):
    """Whole paths of recovered pages against those of the pages that are held: which of them only the recovery has."""
    path = F.regexp_extract("url", "://[^/]*([^?#]*)", 1)
    rows = table(spark, d, "pages").select("page_id", path.alias("path"), (F.col("page_id") % 4 == 0).alias("r"))
    out = rows.groupBy("path").agg(F.min(F.when(F.col("r"), F.col("page_id"))).alias("first"), F.count_if(F.col("r")).alias("recovered"), F.count_if(~F.col("r")).alias("held")).where("recovered > 0")
    return out.withColumn("standing", F.when(F.col("held") == 0, "only recovered").otherwise("in both"))


L3 = """WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1), c AS (SELECT event_type, value, sum(event_id % 7 + 1) OVER (PARTITION BY event_type ORDER BY value RANGE UNBOUNDED PRECEDING) AS upto, sum(event_id % 7 + 1) OVER (PARTITION BY event_type) AS whole FROM events),
    wm AS (SELECT event_type, min(value) AS wm FROM c WHERE upto >= whole * 0.5 GROUP BY 1), o AS (SELECT event_type, abs(value - wm) AS off, event_id % 7 + 1 AS w FROM events JOIN wm USING (event_type)),
    oc AS (SELECT event_type, off, sum(w) OVER (PARTITION BY event_type ORDER BY off RANGE UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY event_type) AS whole FROM o), wd AS (SELECT event_type, min(off) AS wd FROM oc WHERE upto >= whole * 0.5 GROUP BY 1),
    e AS (SELECT event_type, -sum(p * log2(p)) AS bits FROM (SELECT event_type, count(*) / sum(count(*)) OVER (PARTITION BY event_type) AS p FROM events GROUP BY event_type, user_id % 50) GROUP BY 1)
    SELECT event_type, round(median(abs(value - m)), 4) AS mad, round(any_value(wm), 4) AS weighted_median, round(any_value(wd), 4) AS weighted_mad, round(avg((least(value / 500, 1) - (user_id % 2)) ** 2), 4) AS brier, round(any_value(bits), 4) AS entropy FROM events JOIN m USING (event_type) JOIN wm USING (event_type) JOIN wd USING (event_type) JOIN e USING (event_type) GROUP BY 1"""


@query("l3_named_aggregates", L3)
def l3(spark, d):
    """Median deviation, plain and weighted, Brier score and entropy of groups that may hold any share of the rows."""
    e = table(spark, d, "events").select("event_type", "value", "user_id", (F.col("event_id") % 7 + 1).alias("w"))
    plain = Z.spread(e, ["event_type"], F.col("value"), keep)
    weighted = Z.spread(e, ["event_type"], F.col("value"), keep, F.col("w"), "weighted_median", "weighted_mad")
    scores = e.groupBy("event_type").agg(F.round(Z.brier(F.least(F.col("value") / 500, F.lit(1.0)), F.col("user_id") % 2), 4).alias("brier"))
    out = plain.join(weighted, "event_type").join(scores, "event_type").join(Z.entropy(e, ["event_type"], F.col("user_id") % 50), "event_type")
    return out.select("event_type", "brier", *(F.round(c, 4).alias(c) for c in ("mad", "weighted_median", "weighted_mad", "entropy")))
