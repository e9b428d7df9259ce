"""Survey of a file tree for names and contents that look encrypted: candidates, what was not measured and what was not read, never how much was encrypted."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.joins import micros

#: Extensions of ordinary files (fixed values).
KNOWN_EXTENSIONS = ("bak", "bmp", "csv", "db", "doc", "docx", "gif", "htm", "html", "jpeg", "jpg", "json", "log", "mdb", "mp3", "mp4", "msg", "pdf", "png", "ppt", "pptx", "pst", "rtf", "sql", "tar", "txt", "vmdk", "xls", "xlsx", "xml", "zip")
HEAD, SMALL, BITS = 64 << 10, 4096, 7.5


def head_entropy(df: DataFrame, content: str, name: str = "head_entropy", head: int = HEAD) -> DataFrame:
    """``df`` with bits a byte of the first ``head`` bytes of the binary column ``content`` (which goes), null for null, 0 for empty. One count of bytes a file, no shuffle."""
    rest = [c for c in df.columns if c != content]
    schema = f"{df.select(*rest).schema.simpleString()[7:-1]}, {name}: double" if rest else f"{name}: double"

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("_head"):
                n = None if not v.is_valid else np.bincount(np.frombuffer(v.as_buffer(), np.uint8), minlength=256)
                if n is None or not n.sum():
                    out.append(None if n is None else 0.0)
                    continue
                p = n[n > 0] / n.sum()
                out.append(float(-(p * np.log2(p)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(out, pa.float64())], [*rest, name])

    # only the head leaves the scan
    return df.select(*rest, F.substring(content, 1, head).alias("_head")).mapInArrow(bits, schema.replace(":", " "))


def appended_extension(path: Column, known: Sequence[str] = KNOWN_EXTENSIONS) -> Column:
    """The last extension of a file's name if it is none of ``known`` and follows a known one, an identifier in between or not; else null."""
    parts = F.split(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.")
    n = F.size(parts)
    part = lambda back: F.when(n > back, F.get(parts, n - back))
    ok = lambda c: F.coalesce(c.isin(*known), F.lit(False))
    return F.when(~ok(part(1)) & (part(1) != "") & (ok(part(2)) | ok(part(3))), F.concat(F.lit("."), part(1)))


def tree_survey(files: DataFrame, path: str, size: str, content: str, read: str) -> DataFrame:
    """``files`` without their content and with ``head_entropy, appended, status, reasons``; a row a file.

    ``status``: read_failed where ``read`` is false or null; candidate for an appended extension or a head of 7.5 bits a byte and more;
    unmeasured for 4,096 bytes or less (their name still makes a candidate); else noncandidate, which says nothing of the content.
    ``reasons`` lists what made a candidate.
    """
    was_read = F.coalesce(F.col(read), F.lit(False))
    enough = was_read & (F.col(size) > SMALL)
    out = head_entropy(files.withColumn(content, F.when(enough, F.col(content))), content)
    appended = appended_extension(F.col(path))
    high = F.coalesce(F.round("head_entropy", 6) >= BITS, F.lit(False))
    reasons = F.concat_ws(",", F.when(appended.isNotNull(), "appended_extension_after_known_extension"), F.when(high, f"head_entropy_at_least_{BITS}"))
    status = F.when(~was_read, "read_failed").when(reasons != "", "candidate").when(~enough, "unmeasured").otherwise("noncandidate")
    return out.select("*", appended.alias("appended"), status.alias("status"), F.when(status == "candidate", reasons).otherwise("").alias("reasons"))


def survey_totals(survey: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Files and bytes by status, and candidates as a share of the files visited; partial where a file was not read."""
    states = ("candidate", "noncandidate", "unmeasured", "read_failed")
    at = {s: F.col("status") == s for s in states}
    out = survey.groupBy(*keys).agg(F.count("*").alias("visited"), *(F.count_if(c).alias(s) for s, c in at.items()), *(F.coalesce(F.sum(F.when(c, F.col(size))), F.lit(0)).cast("long").alias(f"{s}_bytes") for s, c in at.items()))
    return out.withColumns({"fraction": F.round(F.col("candidate") / F.col("visited"), 4), "state": F.when(F.col("read_failed") > 0, "partial").otherwise("complete")})


def survey_hours(survey: DataFrame, ts: str) -> DataFrame:
    """Files by the hour of their time stamp, all and candidates; those without one in an hour that is null. Such times are changed by copying."""
    hour = F.date_trunc("hour", ts)
    return survey.groupBy(micros(hour).alias("hour_us")).agg(F.count("*").alias("files"), F.count_if(F.col("status") == "candidate").alias("candidates"))
