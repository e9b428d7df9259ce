"""Exact duplicates by two passes of a Bloom filter (DataFrame functions only).

Pass one files every digest under two cells of a blocked Bloom filter and keeps the
cells that were hit more than once. Pass two probes the filter: a row with an untouched
cell is unique and goes straight through; only the others are shuffled by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import keep

#: Cells of one bitmap row, as Spark's bitmap functions lay them out.
BLOCK = 32768
#: The filter has about CELLS_PER_ROW cells a row, and never more than MAX_BITS: 64 MB to
#: broadcast at the most. Past 33 million rows it fills up, more unique rows
#: are shuffled (48 bytes each, text never), and the result is the same.
CELLS_PER_ROW, MIN_BITS, MAX_BITS = 16, 1 << 18, 1 << 29


def filter_bits(rows: int) -> int:
    bits = MIN_BITS
    while bits < rows * CELLS_PER_ROW and bits < MAX_BITS:
        bits *= 2
    return bits


def _number(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("long")


def _cells(sha: Column, blocks: int) -> list[Column]:
    block = F.pmod(_number(F.substring(sha, 1, 12)), F.lit(blocks))
    return [block * BLOCK + F.pmod(_number(F.substring(sha, at, 4)), F.lit(BLOCK)) for at in (13, 17)]


def repeated_cells(digests: DataFrame, bits: int) -> DataFrame:
    """``(block long, bits binary)``: the cells that at least two rows hit."""
    cells = digests.select(F.explode(F.array(*_cells(F.col("sha"), bits // BLOCK))).alias("cell"))
    hit = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    return hit.groupBy(F.floor(F.col("cell") / BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.pmod("cell", F.lit(BLOCK))).alias("bits"))


def _is_set(bits: Column, cell: Column) -> Column:
    at = F.pmod(cell, F.lit(BLOCK)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at % 8) == 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when byte for byte the same; null counts as empty. The row with
    the largest id stays (a null id is the smallest; of rows with one id and one text a
    single row stays). Texts of any length are digested whole. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    digests = keep(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    bits = filter_bits(digests.count())
    seen = F.broadcast(repeated_cells(digests, bits))  # at most MAX_BITS / 8 bytes
    one, two = _cells(F.col("sha"), bits // BLOCK)
    probed = digests.withColumn("block", F.floor(one / BLOCK)).join(seen, "block", "left")
    probed = probed.select("doc_id", "row", "sha", F.coalesce(_is_set(F.col("bits"), one) & _is_set(F.col("bits"), two), F.lit(False)).alias("maybe"))
    through = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    maybe = probed.where("maybe").select("doc_id", "row", "sha")
    groups = maybe.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")).where("group_size > 1")
    # A text that holds a third of all rows: groups are written, one row a key, so AQE can split the other side of the join.
    groups = keep(groups, "groups")
    alone = F.col("top").isNull()  # a false alarm of the filter
    same = maybe.join(groups, "sha", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("top.row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    return through.unionByName(same)
