"""Readers and sinks, fed with lines that Spark makes of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions import csv_safe
from casewright.plans.q_predicates import LEDGER, ledger
from casewright.plans.registry import query, table
from casewright.sources import readers as R
from casewright.sources.scratch import scratch_path


def _json_lines(spark, d):
    e = table(spark, d, "events")
    body = F.to_json(F.struct("event_id", "event_type", "user_id"))
    return e.select(F.when(F.col("event_id") % 10 == 3, F.substring(body, 1, 12)).when(F.col("event_id") % 10 == 4, "  ").otherwise(body).alias("value"))


@query("a1_register", "SELECT event_id, event_type, user_id FROM events WHERE event_id % 10 NOT IN (3, 4)")
def a1(spark, d):
    return R.parse_register(_json_lines(spark, d), "event_id long, event_type string, user_id long")[0]


@query("a1_torn", "SELECT count(*)::BIGINT AS torn FROM events WHERE event_id % 10 = 3")
def a1t(spark, d):
    return R.parse_register(_json_lines(spark, d), "event_id long, event_type string, user_id long")[1].agg(F.count("*").alias("torn"))


@query("a2_line_logs", "SELECT page_id, 'GET' AS method, regexp_extract(url, '://[^/]*(/[^ ]*)', 1) AS target, '200' AS status FROM pages WHERE page_id % 9 <> 0 AND regexp_matches(url, '://[^/]*/[^ ]*$')")
def a2(spark, d):
    target = F.regexp_extract("url", "://[^/]*(/[^ ]*)", 1)
    line = F.concat(F.lit("10.0.0.1 - ana [01/Jan/2024:00:00:00 +0000] \"GET "), target, F.lit(" HTTP/1.1\" 200 17"))
    rows = table(spark, d, "pages").where(F.col("url").rlike("://[^/]*/[^ ]*$")).select("page_id", F.when(F.col("page_id") % 9 == 0, "garbled").otherwise(line).alias("value"))
    return R.parse_line_logs(rows, "web").where("parsed").select("page_id", "method", "target", "status")


@query("a3_zeek", "SELECT event_id AS uid, CASE WHEN event_id % 6 <> 0 THEN event_type END AS service FROM events")
def a3(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws("\t", F.col("event_id").cast("string"), F.when(F.col("event_id") % 6 == 0, "-").otherwise(F.col("event_type"))).alias("value"), F.floor(F.col("event_id") / 10_000).alias("file"))  # files grow in number, not in size
    heads = e.select("file").distinct().select(F.lit(-1).cast("long").alias("event_id"), F.lit("#fields\tuid\tservice").alias("value"), "file")
    rows = R.parse_zeek(heads.unionByName(e), ["file"], "event_id")
    return rows.select(F.col("fields")["uid"].cast("long").alias("uid"), F.col("fields")["service"].alias("service"))


@query("a5_event_xml", "SELECT event_id AS at, CASE WHEN event_id % 97 <> 5 THEN event_id END AS record, CASE WHEN event_id % 97 <> 5 THEN (event_id % 5000)::INT END AS event_code, CASE WHEN event_id % 97 <> 5 THEN event_type END AS kind, CASE WHEN event_id % 97 <> 5 THEN props || ' <' || user_id || ' & co>' END AS props, CASE WHEN event_id % 97 <> 5 THEN 4 ELSE 0 END::INT AS fields, CASE WHEN event_id % 97 <> 5 THEN 'Sec & Co' END AS provider, event_id % 97 = 5 AS rejected FROM events")
def a5(spark, d):
    """Records with entities, CDATA, a name that repeats, an element without a name; those cut short are named."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    e = table(spark, d, "events")
    xml = F.concat(
        F.format_string("<Event xmlns='urn:e'><System><Provider Name='Sec &amp; Co'/><EventID Qualifiers='0'>%d</EventID><EventRecordID>%d</EventRecordID></System><EventData><Data Name='kind'>first</Data><Data>bare</Data><Data Name='kind'>", F.col("event_id") % 5000, F.col("event_id")),
        esc(F.col("event_type")), F.lit("</Data><Data Name='props'><![CDATA["), "props", F.lit(" <]]>"), F.col("user_id").cast("string"), F.lit(" &amp; co></Data></EventData></Event>"),
    )
    xml = F.when(F.col("event_id") % 97 == 5, F.left(xml, F.lit(120))).otherwise(xml)
    got = R.parse_event_xml(e.select(F.col("event_id").alias("at"), xml.alias("xml")), "xml")
    return got.select("at", "record", "event_code", F.col("named")["kind"].alias("kind"), F.col("named")["props"].alias("props"), F.size("data").alias("fields"), "provider", F.col("rejected").isNotNull().alias("rejected"))


def evidence(spark, d):
    """A folder of text files made of the documents, one folder a source."""
    path = scratch_path(spark)
    docs = table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value"), "source")
    docs.write.partitionBy("source").text(path)
    return path


@query("a6_catalog", "SELECT CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'timeline' ELSE 'filelist' END AS which, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, count(DISTINCT source)::BIGINT AS folders FROM documents WHERE source IS NOT NULL GROUP BY 1")
def a6(spark, d):
    """Files under their logical names."""
    files = R.catalog(R.census(spark, evidence(spark, d), "*.txt"), {"timeline": r"source=src[0-9]/", "filelist": r"source=src[0-9]{2,}/"})
    return files.groupBy("which").agg(F.sum("bytes").alias("bytes"), F.count_distinct(F.regexp_extract("path", "source=([^/]+)", 1)).alias("folders"))


@query("a7_census", "SELECT source AS folder, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY 1")
def a7(spark, d):
    """Bytes of all files under a root, by folder, without reading them."""
    return R.census(spark, evidence(spark, d), "*.txt").groupBy(F.regexp_extract("path", "source=([^/]+)", 1).alias("folder")).agg(F.sum("bytes").alias("bytes"))


@query("a4_filelist", "SELECT p_name || '_' || p_partkey AS name, '/' || p_brand || '/' || p_partkey AS path, p_size::BIGINT AS size, p_size % 7 = 0 AS deleted, CASE WHEN p_size % 5 > 0 THEN '2024-01-0' || (p_size % 5) END AS created FROM part")
def a4(spark, d):
    """A listing in UTF-16 with tabs, written and read again."""
    path = scratch_path(spark)
    made = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("2024-01-0"), (F.col("p_size") % 5).cast("string")))
    rows = table(spark, d, "part").select(
        F.concat_ws("_", "p_name", "p_partkey").alias("Filename"), F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_partkey").alias("Full Path"), F.col("p_size").alias("Size (bytes)"),
        made.alias("Created"), F.when(F.col("p_size") % 7 == 0, "yes").otherwise("no").alias("Is Deleted"),
    )
    rows.write.option("sep", "\t").option("header", True).option("encoding", "UTF-16").csv(path)
    return R.read_filelist(spark, path).select(F.col("Filename").alias("name"), F.col("Full Path").alias("path"), F.col("Size (bytes)").cast("long").alias("size"), (F.col("Is Deleted") == "yes").alias("deleted"), F.col("Created").alias("created"))


@query("a16_page_and_whole", "WITH w AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, (SELECT count(*) FROM w)::BIGINT AS matched, least((SELECT count(*) FROM w), 25)::BIGINT AS returned, (SELECT count(*) FROM w) > 25 AS truncated, (SELECT round(sum(o_totalprice), 2) FROM w) AS kept_total FROM w ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def a16(spark, d):
    """A page of a result with the counts of the whole, which is kept beside it."""
    path = scratch_path(spark)
    page, counts = R.page_and_keep(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25, path)
    whole = spark.read.parquet(path).agg(F.round(F.sum("o_totalprice"), 2).alias("kept_total"))
    return page.select("o_orderkey").join(F.broadcast(counts)).join(F.broadcast(whole))  # a row each


@query("a8_digest", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, sha1(text) AS sha1, strlen(text)::BIGINT AS size FROM documents")
def a8(spark, d):
    return R.digest(table(spark, d, "documents"), "text").select("doc_id", "sha256", "md5", "sha1", "size")


@query("a9_audit_envelopes", "SELECT event_type AS name, event_id AS id FROM events")
def a9(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 50).alias("file"), (F.floor(F.col("event_id") / 50) % 3).alias("form"), F.struct(F.col("event_type").alias("name"), F.col("event_id").alias("id")).alias("r"))
    # a file holds the records of one form, 50 ids of them however large the table
    files = e.groupBy("file", "form").agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("a"))
    value = F.when(F.col("form") == 0, F.concat(F.lit('{"Records":'), F.col("a"), F.lit("}"))).otherwise(F.col("a"))
    return R.explode_records(files.select(value.alias("value")), "value", "name string, id long").select("name", "id")


@query("a10_json_in_csv", "SELECT event_id, event_type AS operation, json_extract_string(props, '$.k')::BIGINT AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created, 1 + (event_id % 9 = 0)::INT::BIGINT AS copies FROM events")
def a10(spark, d):
    """A unified audit export, written as CSV with a record of JSON in each row, some of them twice."""
    path = scratch_path(spark)
    e = table(spark, d, "events")
    record = F.to_json(F.struct(F.col("event_id").cast("string").alias("Id"), F.col("event_type").alias("Operation"), F.get_json_object("props", "$.k").cast("long").alias("ItemCount"), F.lit('a "quoted", name').alias("ObjectId")))
    rows = e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("CreationDate"), F.explode(F.sequence(F.lit(1), F.lit(1) + (F.col("event_id") % 9 == 0).cast("int"))).alias("n"), record.alias("AuditData")).drop("n")
    rows.write.option("header", True).option("escape", '"').csv(path)
    got = R.read_audit_csv(spark, path, "AuditData", "Id string, Operation string, ItemCount long, ObjectId string", "Id", "CreationDate")
    return got.where(F.col("ObjectId") == 'a "quoted", name').select(F.col("Id").cast("long").alias("event_id"), F.col("Operation").alias("operation"), F.col("ItemCount").alias("k"), F.col("CreationDate").alias("created"), "copies")


@query("a11_vpc_flow", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS bytes, CASE l_returnflag WHEN 'N' THEN 'NODATA' ELSE 'OK' END AS status FROM lineitem")
def a11(spark, d):
    none = F.col("l_returnflag") == "N"
    line = F.concat_ws(" ", F.lit("2"), F.col("l_suppkey").cast("string"), F.when(none, "-").otherwise(F.col("l_partkey").cast("string")), F.when(none, "NODATA").otherwise("OK"))
    rows = R.parse_vpc_flow(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("value")), ["version", "dst", "bytes", "status"])
    return rows.select("l_orderkey", "l_linenumber", F.col("bytes").cast("long").alias("bytes"), "status")


@query("a12_syslog", "SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS us, event_type AS program FROM events")
def a12(spark, d):
    line = F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host "), F.col("event_type"), F.lit("[17]: seen"))
    rows = R.parse_line_logs(table(spark, d, "events").select("event_id", line.alias("value")), "syslog")
    return rows.select("event_id", R.syslog_time(F.col("timestamp_raw"), F.lit(2024)).alias("us"), "program")


@query("a14_export_ledger", f"SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS datetime, epoch_us(ts) AS timestamp, kind AS timestamp_desc, CASE WHEN sensitive THEN '[withheld]' ELSE value END AS message FROM ({LEDGER})")
def a14(spark, d):
    return R.timesketch(ledger(spark, d), "ts", "kind", "value", "sensitive")


@query("a15_csv_safe", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '''=' || lang ELSE lang END AS cell FROM documents")
def a15(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), F.col("lang"))).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", csv_safe(raw).alias("cell"))


@query("a18_export_inventory", "SELECT event_type, count(*)::BIGINT AS records, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last, (datediff('day', min(ts)::DATE, max(ts)::DATE) + 1 - count(DISTINCT ts::DATE))::BIGINT AS missing_days, count(*) = 200 AS at_cap FROM events GROUP BY 1")
def a18(spark, d):
    return R.export_inventory(table(spark, d, "events"), "event_type", "ts", 200)
