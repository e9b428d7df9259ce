"""Importance resampling towards a target distribution, by bit-sliced aggregation.

A document's features are its runs of one to three words, each in one of a fixed number of buckets by
the crc32 of its bytes. Its bucket counts are kept as bit planes: bit b of plane k is bit k of the count of
bucket b. The gain of a bucket, an integer, is cut into planes of its absolute value, one set for gains above zero and one for
those below. The weight, the sum of gains over all features, is then a sum over pairs of planes:
``2 ** (k + j)`` times the popcount of document plane k AND gain plane j. All of it is integer
arithmetic, so weights are exact.

The crc32 of a run follows from those of its words: crc32 is linear, so putting n bytes behind a text is
four look-ups in a table for n, and no run is ever spelled out.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from casewright.llm.common import drop, keep, slices

BUCKETS, GRAMS, SEED = 10000, 3, 42
LEAST_WORDS, PERCENT = 20, 5
#: Words up to this length are hashed by arrays, longer ones one by one.
_SHORT = 48
#: Bytes of one text looked at in one go, and documents whose counts are held as a matrix.
_PIECE, _ROWS = 4 << 20, 128

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all bytes of characters beyond ASCII.
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True

_CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], np.uint32)  # the byte table, without the usual inversions


def _shifts(longest: int) -> np.ndarray:
    """``[n, i, v]``: what n zero bytes make of the register whose byte i is v and whose others are zero."""
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(longest):
        out[n + 1] = _CRC[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


_SHIFT = _shifts(_SHORT + 1)


def _append(crc: np.ndarray, tail: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 of texts with crc32 ``crc``, each followed by ``n`` bytes of crc32 ``tail``."""
    at = n.astype(np.int64) * 1024
    flat = _SHIFT.reshape(-1)
    out = tail.copy()
    for i in range(4):
        out ^= flat[at + 256 * i + ((crc >> np.uint32(8 * i)) & np.uint32(255))]
    return out


class Words:
    """Words of a piece of text: the document of each, its length, its crc32 and that of a space and it; long words are kept as bytes."""

    def __init__(self, data: np.ndarray, doc: np.ndarray, first: np.ndarray):
        """``doc``: the document of each byte's text, by ``first``, where texts begin in ``data``."""
        data = _LOWER[data]
        inside = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[:1].any(), inside[-1:].any()
        cut = first[(first > 0) & (first < len(data))]
        touching = cut[inside[cut] & inside[cut - 1]]  # a word ends and another begins where two texts meet
        at = np.sort(np.concatenate([np.flatnonzero(edge), touching, touching]))
        begin, end = at[0::2], at[1::2]
        self.doc = doc[np.searchsorted(first, begin, "right") - 1]
        self.size = end - begin
        reg, spaced = np.full(len(begin), 0xFFFFFFFF, np.uint32), np.full(len(begin), int(_CRC[0xFF ^ 32]) ^ 0x00FFFFFF, np.uint32)
        order = np.argsort(-np.minimum(self.size, _SHORT + 1), kind="stable")
        count = np.cumsum(np.bincount(np.minimum(self.size, _SHORT + 1), minlength=_SHORT + 2)[::-1])[::-1]  # words of at least so many bytes
        reg, spaced, place = reg[order], spaced[order], begin[order]
        for k in range(_SHORT):
            m = int(count[k + 1])
            if not m:
                break
            byte = data[place[:m] + k].astype(np.uint32)
            for r in (reg, spaced):
                r[:m] = _CRC[(r[:m] ^ byte) & np.uint32(255)] ^ (r[:m] >> np.uint32(8))
        self.crc, self.spaced = np.empty_like(reg), np.empty_like(spaced)
        self.crc[order], self.spaced[order] = ~reg, ~spaced
        self.long = {int(i): data[begin[i] : end[i]].tobytes() for i in np.flatnonzero(self.size > _SHORT)}
        for i, w in self.long.items():
            self.crc[i], self.spaced[i] = zlib.crc32(w), zlib.crc32(b" " + w)

    def buckets(self, buckets: int, grams: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """``(document, bucket)`` of each feature that ends at word ``skip`` or later."""
        docs, found = [self.doc[skip:]], [self.crc[skip:] % np.uint32(buckets)]
        run, far = self.crc, np.flatnonzero(self.size > _SHORT)
        for n in range(2, grams + 1):
            if len(self.crc) < n:
                break
            head, tail = run[:-1], self.spaced[n - 1 :]
            run = _append(head, tail, np.minimum(self.size[n - 1 :], _SHORT) + 1)
            for i in far[far >= n - 1].tolist():  # a long word at the end of the run
                run[i - n + 1] = zlib.crc32(b" " + self.long[i], int(head[i - n + 1]))
            ends = np.arange(n - 1, len(self.crc))
            whole = (self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1]) & (ends >= skip)
            docs.append(self.doc[n - 1 :][whole])
            found.append(run[whole] % np.uint32(buckets))
        return np.concatenate(docs), np.concatenate(found)


def counts(texts: list[memoryview | bytes], buckets: int = BUCKETS, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """``(words, bucket counts)`` of each text; a long one is read in pieces that share their last words."""
    n_words, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), buckets), np.int64)

    def add(w: Words, skip: int) -> None:
        n_words[:] += np.bincount(w.doc[skip:], minlength=len(texts))
        doc, bucket = w.buckets(buckets, grams, skip)
        out.reshape(-1)[:] += np.bincount(doc * buckets + bucket, minlength=out.size)

    small = [i for i, t in enumerate(texts) if 0 < len(t) <= _PIECE]
    if small:
        size = np.array([len(texts[i]) for i in small])
        first = np.cumsum(size) - size
        data = np.concatenate([np.frombuffer(texts[i], np.uint8) for i in small])
        add(Words(data, np.array(small), first), 0)
    for i in (i for i, t in enumerate(texts) if len(t) > _PIECE):
        data, at, held = np.frombuffer(texts[i], np.uint8), 0, b""
        while at < len(data):
            end = min(len(data), at + _PIECE)
            while end < len(data) and _WORD[_LOWER[data[end - 1]]]:  # never inside a word
                end += 1
            piece = np.concatenate([np.frombuffer(held, np.uint8), data[at:end]])
            before = Words(np.frombuffer(held, np.uint8), np.array([i]), np.array([0])).size if held else []
            add(Words(piece, np.array([i]), np.array([0])), len(before))
            last = [*held.split(), *_words(data[at:end])][-(grams - 1) :] if grams > 1 else []
            held = b"".join(w + b" " for w in last)
            at = end
    return n_words, out


def _words(data: np.ndarray) -> list[bytes]:
    low = _LOWER[data]
    return np.where(_WORD[low], low, np.uint8(32)).tobytes().split()


def planes(rows: np.ndarray) -> list[bytes]:
    """Of each row of non-negative integers its bit planes, lowest first, each filled up to whole 64-bit words."""
    rows = rows.astype(np.uint32 if rows.max(initial=0) >> 16 else np.uint16) if rows.max(initial=0) < 1 << 32 else rows
    most = rows.max(axis=1, initial=0)
    out: list[list[bytes]] = [[] for _ in rows]
    fill = bytes(-(-rows.shape[1] // 64) * 8 - -(-rows.shape[1] // 8))
    for k in range(int(most.max(initial=0)).bit_length()):
        deep = np.flatnonzero(most >> k)
        bits = np.packbits(rows[deep] & rows.dtype.type(1 << k) != 0, axis=1, bitorder="little")
        for i, r in zip(deep.tolist(), bits):
            out[i].append(r.tobytes() + fill)
    return [b"".join(x) for x in out]


def bit_sliced_sum(doc: np.ndarray, gain: np.ndarray) -> int:
    """Sum of count times gain over buckets, for planes ``[k, words]`` of counts and ``[j, words]`` of gains."""
    if not len(doc) or not len(gain):
        return 0
    ones = np.bitwise_count(doc[:, None, :] & gain[None, :, :]).sum(axis=2, dtype=np.int64)
    return sum(int(ones[k, j]) << (k + j) for k in range(len(doc)) for j in range(len(gain)))


def sliced(docs: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, planes)`` of each row, and a row with ``total``, the bucket counts of all its texts, for each task."""
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    names = ["doc_id", "n_words", "n_features", "planes", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, "text"):
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                texts = [x.as_buffer() if x.is_valid else b"" for x in part.column(1)]
                n, made = counts(texts, buckets, grams)
                total += made.sum(axis=0)
                cols = [part.column(0), pa.array(n), pa.array(made.sum(axis=1)), pa.array(planes(made), pa.binary()), pa.nulls(len(n), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        none = [pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(none, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, planes binary, total array<long>")


def totals(rows: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Bucket counts over all texts: a row a task, summed by bucket; what comes back has one number a bucket."""
    got = rows.where("total is not null").select(F.posexplode("total").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in got:
        out[r.bucket] = r.n
    return out


def gains(target: list[int], source: list[int]) -> list[int]:
    """``floor(1000 * ln(...))`` of the two smoothed shares of each bucket."""
    t, s, n = sum(target), sum(source), len(target)
    return [math.floor(1000 * math.log(((a + 1) * (s + n)) / ((b + 1) * (t + n)))) for a, b in zip(target, source)]


def luck(doc_id: int | None, seed: int = SEED) -> int:
    """A draw from the Gumbel distribution in thousandths, fixed by the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(rows: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of the documents of :func:`sliced`."""
    g = np.array(gain, np.int64)
    width = -(-len(g) // 64)
    up, down = (np.frombuffer(planes(np.maximum(x, 0)[None])[0], np.uint64).reshape(-1, width) for x in (g, -g))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = []
            for x in b.column(3).to_pylist():
                own = np.frombuffer(x, np.uint64).reshape(-1, width)
                weight.append(bit_sliced_sum(own, up) - bit_sliced_sum(own, down))
            score = [w + luck(i, seed) for w, i in zip(weight, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.where("total is null").select("doc_id", "n_words", "n_features", "planes").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list, quota: int) -> DataFrame:
    """``rows`` with ``rank``, 1 to ``quota`` in this order, else null.

    Rows are range-partitioned and written; a partition's ranks begin after the rows of those before it, so no task sorts more than its part.
    """
    parts = keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = {r._part: r.n for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    first, at = [], 0
    for p in sorted(sizes):
        first.append((p, at))
        at += sizes[p]
    drawn = [x for x in first if x[1] < quota]
    last = drawn[-1][0] if drawn else -1
    before = rows.sparkSession.createDataFrame(drawn, "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    top = parts.where(F.col("_part") <= last).withColumn("_nth", within).join(F.broadcast(before), "_part")
    place = F.col("_before") + F.col("_nth")
    top = top.withColumn("rank", F.when(place <= quota, place)).drop("_nth", "_before")
    return top.unionByName(parts.where(F.col("_part") > last).withColumn("rank", F.lit(None).cast("long"))).drop("_part")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, grams: int = GRAMS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, n_features, weight, score, rank``.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn without replacement, likelier the
    more their features are those of ``target``; they carry their rank. Null and empty texts have no features and weight 0; texts of
    any length are read whole. Ties go to the smaller id (null first), rows that repeat it in any order, each with a rank of its own. An empty
    ``target`` has only the smoothing; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    own = keep(sliced(docs, buckets, grams, id_col, text_col), "planes")
    aim = sliced(target.select(F.lit(0).alias("_id"), F.col(target_text).alias("_text")), buckets, grams, "_id", "_text")
    rows = keep(weighed(own, gains(totals(aim, buckets), totals(own, buckets)), seed), "weighed")
    drop(own)
    n = rows.where(F.col("n_words") >= least_words).count()
    fit = ranked(rows.where(F.col("n_words") >= least_words), [F.desc("score"), F.asc_nulls_first("doc_id")], percent * n // 100)
    out = fit.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
