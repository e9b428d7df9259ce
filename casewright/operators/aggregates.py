"""Aggregations over evidence rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.joins import micros
from casewright.operators.quantiles import median, spread
from casewright.operators.scan import ranged, scan


def profile_by(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows, first and last time (microseconds) of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(micros(ts)).alias("first_us"), F.max(micros(ts)).alias("last_us"))


def volume(df: DataFrame, ts: str, bucket: str) -> DataFrame:
    return df.groupBy(micros(F.date_trunc(bucket, ts)).alias("bucket_us")).agg(F.count("*").alias("n"))


def busiest(volumes: DataFrame) -> DataFrame:
    """The bucket with most rows; of equals the earliest."""
    return volumes.orderBy(F.desc("n"), "bucket_us").limit(1)


def top_talkers(df: DataFrame, key: str, peer: str, size: str, n: int = 1000) -> DataFrame:
    """Bytes and distinct peers of the ``n`` endpoints with most bytes, and their places; ties by key."""
    sums = df.groupBy(key).agg(F.round(F.sum(size), 4).alias("bytes"), F.count_distinct(peer).alias("peers"))
    return ranked(sums, [F.desc("bytes"), key], n)


def rare_pairs(df: DataFrame, a: str, b: str, k: int) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n")).where(F.col("n") <= k)


def lone(df: DataFrame, by: str, peer: str) -> DataFrame:
    """Keys that a single peer reaches."""
    return df.groupBy(by).agg(F.min(peer).alias("only"), F.count_distinct(peer).alias("_n")).where("_n = 1").drop("_n")


def against_own_history(df: DataFrame, key: str, bucket: Column, size: str, factor: float, keep) -> DataFrame:
    """Buckets of a key whose sum lies over its own median by more than ``factor`` median deviations."""
    sums = keep(df.groupBy(key, bucket.alias("bucket")).agg(F.sum(size).alias("bytes")))
    own = spread(sums, [key], F.col("bytes"), keep, middle="mid")
    return sums.join(own, key).where(F.col("bytes") > F.col("mid") + factor * F.col("mad")).select(key, "bucket", F.round("bytes", 4).alias("bytes"))


#: Shapes of a periodicity, by the ratio of median deviation to median, and the share of intervals near the median that the first asks for (our choice: only the names are known).
SHAPES, TIGHT_SHARE = (("tight_cluster", 0.1), ("clustered", 0.25), ("loose_cluster", 0.5)), 0.8


def beacon_score(df: DataFrame, keys: Sequence[str], ts: str, keep, min_events: int = 6, tolerance: float = 0.2) -> DataFrame:
    """How regular the events of a key are: a lead on shape, never a verdict.

    Distinct seconds count once, repeats as duplicates; rows without a time are ``rejected``. Columns: ``events, duplicates, rejected,
    median_s, mad_s, mad_over_median, share`` (of intervals within ``tolerance`` of the median), ``density`` (events against one
    every median over the span), ``long_final_gap`` (the last interval is over four medians) and ``shape``: see SHAPES, else
    dispersed, or unmeasurable where the median is zero. Keys with fewer distinct events than ``min_events`` are not scored. A key may have any
    number of events: its intervals are a scan over parts and its medians are selected, never held.
    """
    timed, without = df.where(F.col(ts).isNotNull()), df.groupBy(*keys).agg(F.count_if(F.col(ts).isNull()).alias("rejected"))
    seconds = timed.groupBy(*keys, F.floor(micros(ts) / 1_000_000).alias("_s")).agg(F.count("*").alias("_k"))
    rows = ranged(seconds, keys, ["_s"], keep)
    near = keep(scan(rows, keys, ["_s"], previous={"_before": F.col("_s")}).withColumn("gap", F.col("_s") - F.col("_before")).drop("_before", "_part"))
    sums = near.groupBy(*keys).agg(F.count("*").alias("events"), (F.sum("_k") - F.count("*")).alias("duplicates"), (F.max("_s") - F.min("_s")).alias("span"), F.max_by("gap", "_s").alias("final")).where(F.col("events") >= min_events)
    middle = keep(sums.join(median(near, keys, F.col("gap"), keep, "median_s"), list(keys)))
    off = keep(near.where("gap is not null").join(middle.select(*keys, "median_s"), list(keys)).select(*keys, F.abs(F.col("gap") - F.col("median_s")).alias("off"), "median_s"))
    share = off.groupBy(*keys).agg(F.avg((F.col("off") <= tolerance * F.col("median_s")).cast("double")).alias("share"))
    out = middle.join(median(off, keys, F.col("off"), keep, "mad_s"), list(keys)).join(share, list(keys))
    ratio = F.when(F.col("median_s") > 0, F.col("mad_s") / F.col("median_s"))
    shape = F.when(ratio.isNull(), "unmeasurable")
    for i, (name, most) in enumerate(SHAPES):
        shape = shape.when((ratio <= most) & (F.col("share") >= (0 if i else TIGHT_SHARE)), name)
    density = F.when(F.col("median_s") > 0, F.col("events") / (F.col("span") / F.col("median_s") + 1))
    out = out.withColumns({"mad_over_median": ratio, "density": density, "long_final_gap": F.col("final") > 4 * F.col("median_s"), "shape": shape.otherwise("dispersed")})
    return out.join(without, list(keys)).drop("span", "final")


def merge_runs(df: DataFrame, keys: Sequence[str], ts: str, gap_s: float, order: Sequence[str] = ()) -> DataFrame:
    """``run``: numbers the runs of a key that gaps of more than ``gap_s`` seconds part (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    new = F.coalesce((micros(ts) - F.lag(micros(ts)).over(w) > int(gap_s * 1_000_000)).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w).cast("long")).drop("_new")


def merge_flows(df: DataFrame, keys: Sequence[str], start: str, end: str, size: str, ended: Column, active_s: float, gap_s: float, keep) -> DataFrame:
    """One row a flow: ``flow, start_us, end_us, records, bytes, ended``. An exporter that cuts long flows at its active timeout writes one flow as several records.

    A record goes on with the one before if that lasted the active timeout, was not ended (FIN or RST), and left no gap of more than ``gap_s`` seconds. Times are microseconds.
    """
    rows = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(size).alias("_b"), ended.alias("_x"))
    order = ["_s", "_e", "_b"]
    near = scan(ranged(rows, keys, order, keep), keys, order, previous={"_p": F.struct("_s", "_e", "_x")})
    last = F.col("_p")
    goes_on = (last["_e"] - last["_s"] >= int(active_s * 1_000_000)) & ~last["_x"] & (F.col("_s") - last["_e"] <= int(gap_s * 1_000_000))
    marked = keep(near.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1).cast("long")).drop("_p"))
    numbered = scan(marked, keys, order, total={"flow": F.col("_new")})
    return numbered.groupBy(*keys, "flow").agg(F.min("_s").alias("start_us"), F.max("_e").alias("end_us"), F.count("*").alias("records"), F.round(F.sum("_b"), 4).alias("bytes"), F.bool_or("_x").alias("ended"))


def round_parts(df: DataFrame, part: str, value: str, order: str) -> DataFrame:
    """Whole numbers that add up to the rounded total: floors, then one more to the largest remainders, ties in order.

    One row a part, so the window holds as many rows as there are parts.
    """
    w = Window.partitionBy()
    floors = df.withColumn("_f", F.floor(F.col(value) + 1e-9)).withColumn("_r", F.col(value) - F.col("_f"))
    left = F.round(F.sum(value).over(w)).cast("long") - F.sum("_f").over(w)
    place = F.row_number().over(w.orderBy(F.desc("_r"), order))
    return floors.withColumn("_left", left).withColumn("_n", place).select(part, (F.col("_f") + (F.col("_n") <= F.col("_left")).cast("long")).alias("whole"))


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def calibration(df: DataFrame, level: str, truth: str, weights: dict[str, float]) -> DataFrame:
    """Per stated confidence: answers, accuracy and Brier score against the probability the level stands for."""
    p = F.coalesce(*(F.when(F.col(level) == k, F.lit(v)) for k, v in weights.items()))
    return df.groupBy(level).agg(F.count("*").alias("n"), F.round(F.avg(F.col(truth).cast("double")), 4).alias("accuracy"), F.round(F.avg(F.pow(p - F.col(truth), 2)), 4).alias("brier"))


def census(df: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in sums.items()))


def ranked(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The first ``n`` rows with their ``place``; only those meet in one task."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
