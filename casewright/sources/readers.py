"""Sources and sinks: registers, line logs, audit exports, flow logs and file listings as DataFrames.

Every reader keeps what it could not parse: a blank line is skipped, a torn one is counted and located, never fatal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_register(lines: DataFrame, schema: T.StructType | str, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON Lines, already read as text: the good rows, and the torn lines."""
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    full = T.StructType([*kind.fields, T.StructField("_torn", T.StringType())])
    rows = lines.where(F.trim(F.col(col)) != "").withColumn("_r", F.from_json(col, full, {"columnNameOfCorruptRecord": "_torn", "mode": "PERMISSIVE"}))
    bad = F.col("_r").isNull() | F.col("_r._torn").isNotNull() | ~F.ltrim(F.col(col)).startswith("{")
    rest = [c for c in lines.columns if c != col]
    return rows.where(~bad).select(*rest, *(F.col(f"_r.{f.name}") for f in kind.fields)), rows.where(bad).select(*rest, F.col(col).alias("torn"))


def read_register(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    return parse_register(spark.read.text(path), schema)


#: Line grammars: what each group of the pattern is (fixed values).
LINE_FORMATS = {
    "web": (r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\d+|-)', ("client", "user", "timestamp_raw", "method", "target", "status", "bytes")),
    "proxy": (r"^(\d+\.\d+) +(\d+) (\S+) (\S+)/(\d{3}) (\d+) (\S+) (\S+)", ("timestamp_raw", "elapsed", "client", "result", "status", "bytes", "method", "target")),
    "syslog": (r"^([A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d) (\S+) ([^\[:]+)(?:\[(\d+)\])?: (.*)$", ("timestamp_raw", "host", "program", "pid", "message")),
}


def parse_line_logs(df: DataFrame, fmt: str, col: str = "value") -> DataFrame:
    """One row a line: the fields, and ``parsed``; blank lines go. lines = parsed + unparsed + blank."""
    pattern, names = LINE_FORMATS[fmt]
    rows = df.where(F.trim(F.col(col)) != "")
    fits = F.col(col).rlike(pattern)
    fields = [F.when(fits, F.nullif(F.regexp_extract(col, pattern, i + 1), F.lit(""))).alias(n) for i, n in enumerate(names)]
    return rows.select("*", *fields, fits.alias("parsed"))


def parse_key_values(df: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """KEY=VALUE lines; a key that is absent is null."""
    return df.select("*", *(F.when(F.col(col).rlike(rf"(^|\s){k}="), F.regexp_extract(col, rf"(?:^|\s){k}=(\S*)", 1)).alias(k.lower()) for k in keys))


def syslog_time(raw: Column, year: Column) -> Column:
    """Microseconds of a stamp without a year, given the year."""
    return F.unix_micros(F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), F.regexp_replace(raw, " +", " ")), F.lit("yyyy MMM d HH:mm:ss")))


def rollover_years(df: DataFrame, keys: list[str], order: str, month: Column, first_year: int) -> DataFrame:
    """``year``: the first year, and one more each time the month goes down by more than one from line to line."""
    w = Window.partitionBy(*keys).orderBy(order)
    down = F.coalesce((month < F.lag(month).over(w) - 1).cast("int"), F.lit(0))
    return df.withColumn("_d", down).withColumn("year", F.lit(first_year) + F.sum("_d").over(w)).drop("_d")


def parse_zeek(lines: DataFrame, keys: list[str], order: str, col: str = "value") -> DataFrame:
    """Header-driven columns as a map: each row is read by the last ``#fields`` line of its file above it; ``-`` is null."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col(col).startswith("#fields"), F.slice(F.split(col, "\t"), 2, 10_000)), ignorenulls=True).over(w)
    rows = lines.withColumn("_h", head).where(~F.col(col).startswith("#") & (F.col(col) != ""))
    values = F.transform(F.split(col, "\t"), lambda v: F.when(v == "-", F.lit(None)).otherwise(F.when(v == "(empty)", F.lit("")).otherwise(v)))
    fits = F.size("_h") == F.size(F.split(col, "\t"))
    return rows.withColumn("fields", F.when(fits, F.map_from_arrays("_h", values))).drop("_h")


def read_filelist(spark: SparkSession, path: str) -> DataFrame:
    """A UTF-16 tab-separated listing with a header."""
    return spark.read.option("sep", "\t").option("header", True).option("encoding", "UTF-16").option("multiLine", True).csv(path)


#: Event records as Spark's XML reader takes them; what is optional or repeats stays so.
_EVENT = "System struct<Provider:struct<_Name:string>,EventID:struct<_VALUE:string>,TimeCreated:struct<_SystemTime:string>,EventRecordID:string>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>, _rejected string"


def parse_event_xml(df: DataFrame, col: str) -> DataFrame:
    """Event records in XML: ``event_code, time_raw, record, provider, data, named, rejected``.

    ``data`` is every Data element in order, as ``(name, value)``, those without a name or with one that repeats too; ``named`` the last value of each name.
    Entities and CDATA are read as XML. ``rejected`` is the text of what is not well-formed; null and well-formed records have none.
    """
    read = F.from_xml(F.col(col), _EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected", "ignoreSurroundingSpaces": "false"})
    data = F.transform(F.coalesce(F.col("_x.EventData.Data"), F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda x: F.struct(x["_Name"].alias("name"), F.coalesce(x["_VALUE"], F.lit("")).alias("value")))
    rows = df.withColumn("_x", read).withColumn("data", data)
    after = lambda i: F.slice("data", i + 2, F.size("data"))
    last = F.filter("data", lambda x, i: x["name"].isNotNull() & ~F.exists(after(i), lambda y: y["name"].eqNullSafe(x["name"])))
    return rows.select(
        *df.columns, F.trim("_x.System.EventID._VALUE").try_cast("int").alias("event_code"), F.col("_x.System.TimeCreated._SystemTime").alias("time_raw"), F.trim("_x.System.EventRecordID").try_cast("long").alias("record"),
        F.col("_x.System.Provider._Name").alias("provider"), "data", F.map_from_entries(last).alias("named"), F.col("_x._rejected").alias("rejected"),
    )


def census(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """One row for every file under a root: path, size, time of change. The content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("bytes"), "modificationTime")


def catalog(files: DataFrame, which: dict[str, str]) -> DataFrame:
    """Files under their logical names: the first pattern that a path fits, in the given order."""
    name = F.coalesce(*(F.when(F.col("path").rlike(p), F.lit(n)) for n, p in which.items()))
    return files.withColumn("which", name).where("which is not null")


def digest(df: DataFrame, col: str) -> DataFrame:
    raw = F.col(col).cast("binary")
    return df.select("*", F.sha2(raw, 256).alias("sha256"), F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"), F.octet_length(raw).cast("long").alias("size"))


def explode_records(df: DataFrame, col: str, record: str) -> DataFrame:
    """Audit envelopes: ``Records`` arrays, bare arrays, or a record by itself, one row each, as parsed by ``record``."""
    kind = T._parse_datatype_string(record)
    inside = F.from_json(F.get_json_object(col, "$.Records"), T.ArrayType(kind))
    bare = F.when(F.ltrim(F.col(col)).startswith("["), F.from_json(col, T.ArrayType(kind)))
    single = F.array(F.from_json(col, kind))
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(F.coalesce(inside, bare, single)).alias("at", "_r")).select(*rest, "at", "_r.*")


def read_audit_csv(spark: SparkSession, path: str, json_col: str, record: str, id_field: str, order: str) -> DataFrame:
    """A CSV export whose rows carry a record as JSON: its fields, the other columns, and ``copies``.

    A record that overlapping exports hold several times, by its id, counts once, as its first row by ``order``. A
    record that does not parse, or has no id, keeps its row with nulls.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rest = [c for c in rows.columns if c != json_col]
    parsed = rows.withColumn("_r", F.from_json(json_col, record)).select(*rest, "_r.*")
    known = parsed.where(F.col(id_field).isNotNull())
    once = known.groupBy(id_field).agg(F.min_by(F.struct(*parsed.columns), F.struct(order, F.xxhash64(*parsed.columns))).alias("_r"), F.count("*").alias("copies")).select("_r.*", "copies")
    return once.unionByName(parsed.where(F.col(id_field).isNull()).withColumn("copies", F.lit(1).cast("long")))


def parse_vpc_flow(df: DataFrame, fields: list[str], col: str = "value") -> DataFrame:
    """Space-separated flow rows in a given order; ``status`` keeps NODATA and SKIPDATA apart from flows of zero."""
    p = F.split(F.col(col), " ")
    return df.select("*", *(F.nullif(F.get(p, F.lit(i)), F.lit("-")).alias(f) for i, f in enumerate(fields)))


def export_inventory(df: DataFrame, file: str, ts: str, cap: int) -> DataFrame:
    """Per file: records, first and last time, days between them without a record, and whether the count equals a result cap."""
    days = F.count_distinct(F.to_date(ts))
    span = F.datediff(F.max(F.to_date(ts)), F.min(F.to_date(ts))) + 1
    return df.groupBy(file).agg(F.count("*").alias("records"), F.date_format(F.min(ts), "yyyy-MM-dd").alias("first"), F.date_format(F.max(ts), "yyyy-MM-dd").alias("last"), (span - days).cast("long").alias("missing_days"), (F.count("*") == cap).alias("at_cap"))


def write_timeline(df: DataFrame, path: str, fmt: str, columns: list[str], order: list[str]) -> None:
    """Sorted rows as Markdown table rows, CSV or JSON Lines; the write is distributed, files are in order."""
    rows = df.orderBy(*order).select(*columns)
    if fmt == "markdown":
        cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\|")
        rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("value")).write.text(path)
    elif fmt == "csv":
        rows.write.option("header", True).csv(path)
    elif fmt == "jsonl":
        rows.write.json(path)
    else:
        raise ValueError(fmt)


def timesketch(df: DataFrame, ts: str, desc: str, message: str, sensitive: str) -> DataFrame:
    """The export shape (datetime, timestamp, timestamp_desc, message), sensitive rows redacted."""
    return df.select(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), F.unix_micros(F.col(ts).cast("timestamp")).alias("timestamp"), F.col(desc).alias("timestamp_desc"), F.when(F.col(sensitive), "[withheld]").otherwise(F.col(message)).alias("message"))


def page_and_keep(df: DataFrame, order: list[str], limit: int, path: str) -> tuple[DataFrame, DataFrame]:
    """The first page and its counts; the whole result lies in ``path``, so a page never cuts it."""
    df.write.parquet(path)
    whole = df.sparkSession.read.parquet(path)
    counts = whole.agg(F.count("*").alias("matched")).select("matched", F.least("matched", F.lit(limit)).alias("returned"), (F.col("matched") > limit).alias("truncated"))
    return whole.orderBy(*order).limit(limit), counts
