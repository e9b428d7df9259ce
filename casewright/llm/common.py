"""What the operators of this subpackage share: inputs, scratch tables, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting for the removal of shuffle files at the end of a query.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where one machine is all there is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='casewright-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A later stage that loses an executor rereads the files; it does not repeat
    the Python work above them. Shuffle files of the write go as it ends: nothing reads them again, and else they
    would lie about until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/casewright-{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`keep` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/casewright-" in path:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have the driver forget plans that are done, on which Spark deletes their shuffle files.

    Spark cleans up after handles that the driver's garbage collector has found, which a driver that
    does little may not run for half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of ``edges (a long, b long)`` as ``(node, component)``.

    Large-star and small-star rounds (Kiveris et al., 2014) over the edge table
    until a round changes nothing: each round is two groupings, no component is
    gathered in one task, and the tree is a star when it ends. ``component`` is the
    smallest node of the component. Loops and repeated edges are harmless; an
    empty table gives an empty table.
    """
    cur = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(limit):
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        nxt = keep(small, "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(cur)
        cur = nxt
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def hash_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """About ``size`` rows of ``df``, the same ones each time: those whose key hashes below a threshold set by a count.

    Unlike an ordered limit, no task sends more than its share.
    """
    n = df.count()
    if n <= size:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) < F.lit(-(-(size << 30) // n)))


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``most`` bytes of one column, so that what a task makes of them is bounded too."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)
