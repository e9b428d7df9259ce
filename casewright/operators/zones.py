"""Wall-clock times of a zone to UTC, by a table of the zone's changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.operators.intervals import interval_join
from casewright.operators.joins import micros

#: Zones change at full quarters of an hour of UTC.
_STEP_S = 900


def transitions(spark: SparkSession, zones: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """``(zone, from_us, to_us, ahead_us)``: how far each zone's clock is ahead, and from when to when (UTC), over whole years.

    Zones are those that the one column of ``zones`` names, as many as there are on earth at the most; the rules are those of Spark's own zone table.
    """
    lo, hi = (int(spark.sql(f"select unix_micros(to_timestamp_ltz('{y}-01-01 00:00:00Z'))").first()[0]) for y in (first_year, last_year + 1))
    named = zones.select(F.col(zones.columns[0]).alias("zone")).where("zone is not null").distinct()
    # every quarter of an hour of these years, for each zone by its name: what a zone has is fixed by the years
    steps = named.withColumn("at", F.explode(F.sequence(F.timestamp_seconds(F.lit(lo // 1_000_000)), F.timestamp_seconds(F.lit(hi // 1_000_000 - _STEP_S)), F.expr(f"INTERVAL {_STEP_S} SECONDS"))))
    here = steps.select("zone", micros("at").alias("us"), (micros(F.from_utc_timestamp("at", F.col("zone"))) - micros(F.from_utc_timestamp("at", F.lit("UTC")))).alias("ahead_us"))
    by = Window.partitionBy("zone").orderBy("us")
    starts = here.withColumn("_p", F.lag("ahead_us").over(by)).where("_p is null or _p <> ahead_us")
    return starts.select("zone", F.col("us").alias("from_us"), F.coalesce(F.lead("us").over(by), F.lit(hi)).alias("to_us"), "ahead_us")


def local_to_utc(df: DataFrame, id_col: str, wall: str, zone: str, changes: DataFrame, keep) -> DataFrame:
    """``(id, us, or_us, basis)``: the instant of a wall-clock time (a timestamp without zone) in its zone.

    ``basis``: converted; ambiguous (the clock showed it twice: ``us`` and ``or_us``); non-existent (the clock passed over it, or it lies outside
    the years of ``changes``); no zone, which is counted and never taken for UTC.
    """
    rows = keep(df.select(id_col, F.unix_micros(F.col(wall).cast("timestamp")).alias("_us"), F.col(zone).alias("zone")))
    # as wall-clock time, a period is shifted by what the clock is ahead in it: periods meet in autumn and leave a gap in spring
    shown = keep(changes.select("zone", (F.col("from_us") + F.col("ahead_us")).alias("_f"), (F.col("to_us") + F.col("ahead_us")).alias("_t"), "ahead_us"))
    met = interval_join(rows.where("zone is not null"), shown, ["zone"], "_us", "_f", "_t")
    found = met.groupBy(id_col).agg(F.min(F.col("_us") - F.col("ahead_us")).alias("us"), F.max(F.col("_us") - F.col("ahead_us")).alias("_last"), F.count("*").alias("_n"))
    out = rows.join(found, id_col, "left")
    basis = F.when(F.col("zone").isNull(), "no zone").when(F.col("_n").isNull(), "non-existent").when(F.col("_n") > 1, "ambiguous").otherwise("converted")
    return out.select(id_col, "us", F.when(F.col("_n") > 1, F.col("_last")).alias("or_us"), basis.alias("basis"))
