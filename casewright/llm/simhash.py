"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the popcounts of its 32 two-bit segments. Flipping
one bit moves one count by one, so the Manhattan distance of two embeddings is never more
than the Hamming distance of the fingerprints. The grid has one axis for each group of
segments; two points within distance d agree exactly on all but d of the axes, so each point is
filed under every choice of ``axes - d`` axes and the range join is an equality on those cells. Pairs
that meet are tested by Manhattan distance, then verified on the fingerprints.

A cell that a large group of near copies fills is not joined with itself: every member is first
compared with the cell's most frequent fingerprint, which links nearly all of them;
then only members outside the cell's largest linked part are compared with the others.
That loses no component, and is linear in a group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import components, drop, keep, slices

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENT_BITS = 2
#: (most distinct fingerprints, axes): more axes give finer cells for larger tables.
AXES = ((30_000_000, 6), (1_000_000_000, 8), (None, 10))
_LOW = 0x5555555555555555
#: Shingles hashed in one go, which bounds memory for very long texts.
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 where there is no word."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(stops)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp long)``; the long holds the 64 bits as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def embed(fp: Column) -> Column:
    """The 32 segment popcounts in one long, in unary: 0, 1 and 2 are the bit pairs 00, 01 and 11."""
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(high).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two embeddings: unary codes differ in as many bits as the counts do."""
    return F.bit_count(a.bitwiseXOR(b))


def _cells(e: Column, axes: int, same: int) -> Column:
    """The cells of a point: for each choice of ``same`` axes, their counts."""
    segments = 64 // SEGMENT_BITS
    edges = [round(i * segments / axes) * SEGMENT_BITS for i in range(axes + 1)]
    masks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:])]
    out = []
    for k, chosen in enumerate(combinations(masks, same)):
        mask = sum(chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        out.append(F.xxhash64(F.lit(k), e.bitwiseAND(F.lit(mask))))
    return F.array(*out)


def _near(a: Column, b: Column, ea: Column, eb: Column, distance: int) -> Column:
    return (manhattan(ea, eb) <= distance) & (F.bit_count(a.bitwiseXOR(b)) <= distance)


def link(points: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(fp, component)`` for distinct ``points (fp long, n long)``; n is how many rows have it.

    ``component`` is one fingerprint of the component. A fingerprint without links is left out.
    """
    count = points.count()
    axes = next(a for most, a in AXES if most is None or count <= most)
    cells = points.select("fp", "n", embed(F.col("fp")).alias("e")).withColumn("cell", F.explode(_cells(F.col("e"), axes, axes - distance)))
    top = cells.groupBy("cell").agg(F.max(F.struct("n", "fp", "e")).alias("top"), F.count("*").alias("size")).where("size > 1")
    top = keep(top.select("cell", F.col("top.fp").alias("hub"), F.col("top.e").alias("hub_e")), "hubs")
    # cells of one point are gone from here on
    shared = keep(cells.join(top, "cell").select("cell", "fp", "e", "hub", "hub_e"), "cells")
    near_hub = _near(F.col("fp"), F.col("hub"), F.col("e"), F.col("hub_e"), distance)
    stars = keep(shared.where((F.col("fp") != F.col("hub")) & near_hub).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    parts = keep(components(stars), "parts")
    # a member that its hub's component holds needs no comparison with the rest of that component
    named = shared.join(parts.select(F.col("node").alias("fp"), F.col("component").alias("part")), "fp", "left")
    named = named.withColumn("part", F.coalesce("part", "fp"))
    hubs = parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_part"))
    named = keep(named.join(hubs, "hub", "left").withColumn("hub_part", F.coalesce("hub_part", "hub")).select("cell", "fp", "e", "part", "hub_part"), "named")
    odd = named.where("part <> hub_part").select("cell", F.col("fp").alias("x"), F.col("e").alias("xe"), F.col("part").alias("xp"))
    # of two odd members the smaller asks; members of the hub's part are only asked
    rest = odd.join(named, "cell").where(
        (F.col("xp") != F.col("part")) & ((F.col("part") == F.col("hub_part")) | (F.col("x") < F.col("fp"))) & _near(F.col("x"), F.col("fp"), F.col("xe"), F.col("e"), distance)
    )
    more = rest.select(F.col("x").alias("a"), F.col("fp").alias("b")).distinct()
    out = keep(components(stars.unionByName(more)).select(F.col("node").alias("fp"), "component"), "linked")
    drop(top, shared, stars, parts, named)
    return out


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Null and empty texts, and texts without a word, have fingerprint zero and link like
    any other. ``component_id`` is the smallest id of the component; ids that are null never are
    it unless the component has no other. Repeated rows stay repeated; an empty table gives an empty
    result. Other columns are ignored, whatever their names; very long texts are hashed in steps.
    """
    rows = keep(fingerprints(docs, id_col, text_col, shingle), "fps")
    points = keep(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), "points")
    parts = link(points.select("fp", "n"), distance)
    linked = points.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = keep(linked.groupBy("component").agg(F.min("low").alias("component_id")), "least")
    named = keep(linked.join(least, "component").select("fp", "component_id"), "named")
    drop(points, parts, least)
    # a fingerprint that a third of all rows share: one side has a row a key, so AQE may split the other
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
