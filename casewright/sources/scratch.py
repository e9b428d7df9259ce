"""Tables between the steps of an iteration, in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new name in the shared checkpoint folder; a local folder only where one machine is all there is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='casewright-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


#: Spark's setting for the removal of shuffle files at the end of a query.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, which cuts its lineage.

    Shuffle files of the write go as it ends: nothing reads them again, and else they would lie about until the driver collects its garbage.
    """
    spark = df.sparkSession
    path, schema, before = scratch_path(spark), df.schema, spark.conf.get(_TIDY, "false")
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    return spark.read.schema(schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`keep` that no later plan reads; tables of other kinds are left alone."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if re.search(r"/table-[0-9a-f]{32}$", path):
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
