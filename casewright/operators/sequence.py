"""Window functions and sequence analytics: gaps, islands, sessions, folds and chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.aggregates import merge_runs
from casewright.operators.joins import micros


def _w(keys: Sequence[str], *order):
    return Window.partitionBy(*keys).orderBy(*order)


def intervals(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str] = ()) -> DataFrame:
    """``gap_us``: microseconds since the row before of the same key; null for the first."""
    return df.withColumn("gap_us", micros(ts) - F.lag(micros(ts)).over(_w(keys, ts, *order)))


def silences(df: DataFrame, keys: Sequence[str], ts: str, id_col: str, n: int = 3) -> DataFrame:
    """The ``n`` longest gaps of each key with the rows on both sides; ties by the earlier."""
    w = _w(keys, ts, id_col)
    gaps = df.select(*keys, F.lag(id_col).over(w).alias("before"), F.col(id_col).alias("after"), (micros(ts) - F.lag(micros(ts)).over(w)).alias("gap_us")).where("gap_us is not null")
    return gaps.withColumn("place", F.row_number().over(_w(keys, F.desc("gap_us"), "after")).cast("long")).where(F.col("place") <= n)


def gaps(df: DataFrame, keys: Sequence[str], ts: str, max_gap_s: int) -> DataFrame:
    """Spans longer than allowed between neighbouring rows of a key."""
    nxt = F.lead(micros(ts)).over(_w(keys, ts))
    return df.select(*keys, micros(ts).alias("from_us"), nxt.alias("to_us")).where(F.col("to_us") - F.col("from_us") > max_gap_s * 1_000_000)


def missing_buckets(df: DataFrame, ts: str, bucket: str) -> DataFrame:
    """Buckets between the first and the last row that have none."""
    have = df.select(F.date_trunc(bucket, ts).alias("b")).distinct()
    every = have.agg(F.min("b").alias("lo"), F.max("b").alias("hi")).select(F.explode(F.expr(f"sequence(lo, hi, interval 1 {bucket})")).alias("b"))
    return every.join(have, "b", "left_anti").select(micros("b").alias("bucket_us"))


def failures_then_success(df: DataFrame, keys: Sequence[str], ts: str, failed: Column, success: Column, n: int) -> DataFrame:
    """Successes after ``n`` or more failures in a row: failures, and the time from the first of them."""
    rows = df.select(*keys, ts, failed.alias("_f"), success.alias("_s")).where("_f or _s")
    island = F.coalesce(F.sum(F.col("_s").cast("int")).over(_w(keys, ts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_i", island).groupBy(*keys, "_i").agg(F.count_if("_f").alias("failures"), F.min(F.when(F.col("_f"), micros(ts))).alias("first_us"), F.max(F.when(F.col("_s"), micros(ts))).alias("success_us"))
    return out.where((F.col("failures") >= n) & F.col("success_us").isNotNull()).drop("_i")


def bursts(df: DataFrame, keys: Sequence[str], ts: str, width_s: int, k: int) -> DataFrame:
    """Rows with ``k`` or more rows of the key in the ``width_s`` seconds up to and with them."""
    n = F.count("*").over(_w(keys, micros(ts)).rangeBetween(-width_s * 1_000_000, 0))
    return df.withColumn("n", n).where(F.col("n") >= k)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def impossible_travel(df: DataFrame, keys: Sequence[str], ts: str, lat: str, lon: str, kmh: float) -> DataFrame:
    """Neighbouring sign-ins whose distance would take more than ``kmh``; invalid coordinates take no part."""
    fine = df.where(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    w = _w(keys, ts)
    km = haversine(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    hours = (micros(ts) - F.lag(micros(ts)).over(w)) / 3.6e9
    return fine.withColumn("km", km).withColumn("hours", hours).where((F.col("km") > 0) & ((F.col("hours") <= 0) | (F.col("km") / F.col("hours") > kmh)))


def first_seen(df: DataFrame, keys: Sequence[str], value: str, ts: str, cutoff: Column) -> DataFrame:
    """Values a key shows from the cutoff on and never before."""
    return df.groupBy(*keys, value).agg(F.min(ts).alias("_t")).where(F.col("_t") >= cutoff).select(*keys, value, micros("_t").alias("first_us"))


def sessionise(df: DataFrame, keys: Sequence[str], ts: str, gap_s: int) -> DataFrame:
    return merge_runs(df, keys, ts, gap_s).groupBy(*keys, "run").agg(F.count("*").alias("requests"), (F.max(micros(ts)) - F.min(micros(ts))).alias("duration_us"))


def concurrent(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The most intervals of a key that are open at once; touching ends do not overlap."""
    marks = df.select(*keys, F.col(start).alias("t"), F.lit(1).alias("d")).unionByName(df.select(*keys, F.col(end).alias("t"), F.lit(-1).alias("d"))).where("t is not null")
    return marks.withColumn("open", F.sum("d").over(_w(keys, "t", "d").rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys).agg(F.max("open").alias("most"))


def phases(df: DataFrame, keys: Sequence[str], order: str, kind: str) -> DataFrame:
    """Runs of neighbouring rows of one kind."""
    w = _w(keys, order)
    new = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(0))
    return df.withColumn("_n", new).withColumn("phase", F.sum("_n").over(w).cast("long")).groupBy(*keys, "phase", kind).agg(F.count("*").alias("rows"))


def fold_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregation, not a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def offer_status(made: Column, seen: Column, ttl: int, max_age: int, accepted: Column, withdrawn: Column, now: Column) -> Column:
    bound = made + max_age
    until = F.when(seen.isNotNull(), F.least(seen + ttl, bound)).otherwise(bound)
    return F.when(accepted, "accepted").when(withdrawn, "withdrawn").when(now >= until, "lapsed").when(seen.isNotNull(), "live").otherwise("pending")


def still_in_place(events: DataFrame, keys: Sequence[str], ts: str, act: str, create: Sequence[str], remove: Sequence[str]) -> DataFrame:
    """Keys whose last act among creations and removals is a creation."""
    last = events.where(F.col(act).isin(*create, *remove)).groupBy(*keys).agg(F.max_by(act, ts).alias("_a"))
    return last.where(F.col("_a").isin(*create)).select(*keys)


def reassemble(df: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """Parts joined in order; ``complete`` if their numbers run from 0 without a gap. A block has as many parts as its writer gave it."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.col(text).alias("t"))))
    out = df.groupBy(*keys).agg(parts.alias("_p"), F.count_distinct(order).alias("_n"), F.max(order).alias("_m"))
    return out.select(*keys, F.sha2(F.array_join(F.transform("_p", lambda p: p["t"]), ""), 256).alias("digest"), (F.col("_n") == F.col("_m") + 1).alias("complete"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(_w(keys, *order)).cast("long")).where(F.col("place") <= k)


def stratified_sample(df: DataFrame, key: str, id_col: str, n: int) -> DataFrame:
    """``n`` rows of every source, chosen by the hash of their id."""
    return top_k(df, [key], [F.md5(F.col(id_col).cast("string")), id_col], n).drop("place")


def timeline_sort(df: DataFrame, ts: str, order: Sequence[str]) -> DataFrame:
    """By instant and then source order; undated rows come last, never at time zero."""
    return df.orderBy(F.col(ts).asc_nulls_last(), *order)


def paginate(df: DataFrame, order: Sequence[str], n: int, page: int) -> DataFrame:
    return df.orderBy(*order).offset(n * page).limit(n)
