"""Removal of every byte that a repeated string of ``length`` bytes covers.

Equal strings have the same least k-gram, so every window of ``length`` bytes
is filed under the hash of its least k-gram, its anchor. A run of windows with one anchor is
a segment of less than ``2 * length`` bytes. Anchors that occur once hold no repeat. Segments that
occur more than once are repeats as a whole. What is left, different segments
with a common anchor, is dealt by anchor into blocks of bounded size; in a block, the
Burrows-Wheeler transform of the segments is taken and its common-prefix values are derived in
increasing order by breadth-first backward extension of intervals, up to ``length``: rows that no
interval has reached by then continue a common prefix of at least that length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm.common import drop, keep, release, slices

LENGTH, GRAM = 400, 100
#: Bytes of one block, and segments of one anchor that one block takes; an anchor with more goes the way of
#: :func:`_windows`, which needs no block.
BLOCK, HOT = 1_000_000, 2048
#: Windows of a text that are looked at in one go, which bounds memory for very long texts.
_STEP = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POS = np.uint64(20)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base % 2**64), np.uint64)
    out[0] = 1
    return np.cumprod(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, first window, last window, several)`` of each run of windows with one anchor.

    A run has no more windows than one gram can lie in; where a periodic text has one anchor
    throughout, that makes a run every few hundred bytes. ``several`` if the anchor lies at more than one place in the run, without
    which no window occurs twice inside it.
    """
    n = len(text)
    if n < length:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e.astype(bool)
    if not _TABLES:
        most = _STEP + 2 * LENGTH
        _TABLES[0] = (_powers(most, int(_BASE)), _powers(most, pow(int(_BASE), -1, 2**64)))
    up, down = _TABLES[0]
    data, found = np.frombuffer(text, np.uint8), []
    span = length - gram + 1
    for at in range(0, n - length + 1, _STEP):
        part = data[at : at + _STEP + length - 1].astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        g = (total[gram:] - total[:-gram]) * down[: len(part) - gram + 1]
        del part, total
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        low = (g >> _POS << _POS) | np.arange(len(g), dtype=np.uint64)  # of equal ones the leftmost
        wide = 1
        while wide * 2 <= span:
            low = np.minimum(low[: len(low) - wide], low[wide:])
            wide *= 2
        if span > wide:
            low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
        places = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        hashes = g[(low[places] & np.uint64((1 << 20) - 1)).astype(np.int64)]
        same = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        begin = places[same]
        size = np.diff(np.append(begin, len(low)))
        pieces = -(-size // span)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(begin, pieces) + nth * span
        last = np.append(first[1:], len(low)) - 1
        several = np.searchsorted(places, last, "right") > np.searchsorted(places, first, "right")
        found.append((np.repeat(hashes[same], pieces), first + at, last + at, several))
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_order(sym: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, sorted by the first ``depth`` symbols at least, of less than 2^31 symbols.

    The last symbol occurs once, so no tied suffix runs past the end.
    """
    n = len(sym)
    bits = int(sym.max()).bit_length()
    held = 1
    while bits * (held + 1) <= 62:
        held += 1
    packed = np.zeros(n, np.int64)
    for i in range(held):
        packed[: n - i] |= sym[i:].astype(np.int64) << np.int64(bits * (held - 1 - i))
    sa = np.argsort(packed).astype(np.int32)
    packed = packed[sa]
    new = np.concatenate([[True], packed[1:] != packed[:-1]])
    del packed
    at = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, at, np.int32(0)))
    have = held
    while have < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
        if not len(tied):
            break
        p = sa[tied]
        k = (rank[p].astype(np.int64) << np.int64(31)) | rank[p + have]
        o = np.argsort(k)
        p, k = p[o], k[o]
        sa[tied] = p
        fresh = np.concatenate([[True], k[1:] != k[:-1]])
        new[tied] = fresh
        rank[p] = np.maximum.accumulate(np.where(fresh, tied, np.int32(0)))
        have *= 2
    rank[sa] = at
    return sa, rank


def long_prefixes(sym: np.ndarray, sa: np.ndarray, inverse: np.ndarray, length: int) -> np.ndarray:
    """For each row of the suffix array, whether it shares ``length`` symbols with the row before.

    Breadth-first: at level l the queue holds intervals of suffixes that begin with one string
    of l symbols. Extending an interval backward by each symbol of its part of the
    transform gives intervals of l + 1 symbols; the row after such an interval, if no shorter string
    has reached it, has a common prefix of l symbols with the row before it.
    """
    n = len(sym)
    back = sa - np.int32(1)  # the transform of row i is sym[back[i]]; the row of that suffix is step[i]
    step, char = inverse[back], sym[back]
    del back
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    head = sym[sa]
    left = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    del head
    right = np.append(left[1:] - 1, n - 1)
    open_[right + 1] = False  # value 0
    whose = np.empty(n, np.int64)
    for _ in range(1, length):
        if not len(left):
            break
        size = right - left + 1
        rows = np.repeat((left - np.cumsum(size) + size).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)
        image = step[rows]
        # of one interval and symbol, the images are neighbours
        group = np.repeat(np.arange(len(left)) << np.int64(32), size)
        group |= char[rows]
        del rows
        if len(image) * 16 > n:
            whose.fill(-1)
            whose[image] = group
            image = np.flatnonzero(whose >= 0)
            group = whose[image]
        else:
            o = np.argsort(image)
            image, group = image[o], group[o]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        left, right = image[first].astype(np.int64), image[np.append(first[1:] - 1, len(image) - 1)].astype(np.int64)
        fresh = open_[right + 1]
        left, right = left[fresh], right[fresh]
        open_[right + 1] = False
    return open_[:n]


def repeats_in_block(segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``(segment, offset)`` of every window of ``length`` bytes that occurs twice or more in the block."""
    count = len(segments)
    sizes = np.array([len(s) + 1 for s in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sym = np.frombuffer(b"".join(s + b"\0" for s in segments), np.uint8).astype(np.int32) + np.int32(count)
    sym[starts + sizes - 1] = np.arange(count)  # separators: smaller than any byte, all different
    sa, inverse = suffix_order(sym, length)
    same = long_prefixes(sym, sa, inverse, length)
    same |= np.concatenate([same[1:], [False]])
    at = np.sort(sa[same])
    seg = np.searchsorted(starts, at, side="right") - 1
    return seg, at - starts[seg]


def _ranges(owner: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs ``(owner, from, to)`` of neighbouring positions, in order."""
    if not len(at):
        return
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(at) - 1]])
    yield from zip(owner[first].tolist(), at[first].tolist(), at[last].tolist())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, s1, s2, owner, lo, hi, several = [], [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                if len(text) < length:
                    continue
                x, p, q, more = anchors(text, length, gram)
                both = [xxhash.xxh3_128_intdigest(text[f : t + length]) for f, t in zip(p.tolist(), q.tolist())]
                h.append(x)
                s1 += [d >> 64 for d in both]
                s2 += [d & 0xFFFFFFFFFFFFFFFF for d in both]
                owner.append(np.full(len(x), i))
                lo.append(p)
                hi.append(q)
                several.append(more)
            if not h:
                continue
            owner = pa.array(np.concatenate(owner))
            cols = [_signed(np.concatenate(h)), _signed(np.array(s1, np.uint64)), _signed(np.array(s2, np.uint64))]
            cols += [b.column(c).take(owner) for c in ("t1", "t2", "doc_id")]
            cols += [pa.array(np.concatenate(x), pa.int64()) for x in (lo, hi)]
            cols.append(pa.array(np.concatenate(several)))
            yield pa.RecordBatch.from_arrays(cols, names=["h", "s1", "s2", "t1", "t2", "doc_id", "lo", "hi", "own"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"h long, s1 long, s2 long, t1 long, t2 long, doc_id {kind}, lo long, hi long, own boolean")


_SEG = "h long, s1 long, s2 long, n long, hot boolean, t1 long, t2 long, lo long, bytes binary"


def _segments(found: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out: dict[str, list] = {c: [] for c in ("h", "s1", "s2", "n", "hot", "t1", "t2", "lo", "bytes")}
            for row in zip(*(b.column(c).to_pylist() for c in ("text", "t1", "t2", "want"))):
                text, t1, t2, want = row
                for w in want:
                    for c in ("h", "s1", "s2", "n", "hot", "lo"):
                        out[c].append(w[c])
                    out["t1"].append(t1)
                    out["t2"].append(t2)
                    out["bytes"].append(text[w["lo"] : w["hi"] + length])
            kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return found.select("text", "t1", "t2", "want").mapInArrow(run, _SEG)


_SPAN = "t1 long, t2 long, lo long, hi long"


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["t1", "t2", "lo", "hi"])


def _blocks(segs: DataFrame, length: int) -> DataFrame:
    """Repeated windows of segments that share an anchor, block by block."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        seg, at = repeats_in_block([r[7] for r in rows], length)
        # a segment that occurs more than once is a repeat anyway
        return _span_batch([(rows[s][4], rows[s][5], rows[s][6] + a, rows[s][6] + b) for s, a, b in _ranges(seg, at) if rows[s][3] == 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, seen, last = [], 0, set(), None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("h", "s1", "s2", "n", "t1", "t2", "lo", "bytes"))):
                if r[0] != last:
                    if size >= BLOCK:
                        yield solve(rows)
                        rows, size = [], 0
                    seen, last = set(), r[0]
                if r[1:3] not in seen:  # repeated rows of a table bring a segment twice
                    seen.add(r[1:3])
                    rows.append(r)
                    size += len(r[7])
        if rows:
            yield solve(rows)

    dealt = segs.where("not hot").repartition(F.col("h")).sortWithinPartitions("h")
    return dealt.mapInArrow(run, _SPAN)


def _windows(segs: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """The same for an anchor with more segments than a block takes: a count of its windows by hash; and scratch tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, n, t1, t2, lo, text in zip(*(b.column(c).to_pylist() for c in ("h", "n", "t1", "t2", "lo", "bytes"))):
                d = [xxhash.xxh3_128_intdigest(text[i : i + length]) for i in range(len(text) - length + 1)]
                k = len(d)
                cols = [_signed(np.array([x >> 64 for x in d], np.uint64)), _signed(np.array([x & 0xFFFFFFFFFFFFFFFF for x in d], np.uint64))]
                cols += [pa.array(np.full(k, v, np.int64)) for v in (h, n, t1, t2)] + [pa.array(np.arange(lo, lo + k))]
                yield pa.RecordBatch.from_arrays(cols, names=["w1", "w2", "h", "n", "t1", "t2", "at"])

    hot = segs.where("hot").dropDuplicates(["h", "s1", "s2"])
    w = keep(hot.mapInArrow(run, "w1 long, w2 long, h long, n long, t1 long, t2 long, at long"), "windows")
    twice = keep(w.groupBy("h", "w1", "w2").agg(F.count("*").alias("k")).where("k > 1").drop("k"), "twice")
    return w.where("n = 1").join(twice, ["h", "w1", "w2"]).select("t1", "t2", F.col("at").alias("lo"), F.col("at").alias("hi")), [w, twice]


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(t1, t2, spans array of (lo, hi))``: first bytes of repeated windows, for each different text that has any.

    What is counted for a key is written before it is joined back, so that adaptive execution can split
    a key that holds much of the table.
    """
    spark = texts.sparkSession
    rows = keep(_anchor_rows(texts, length, gram), "anchors")
    # anchors whose windows may repeat: they lie in several segments, or at several places of one
    twice = rows.groupBy("h").agg(F.count("*").alias("k"), F.min("s1").alias("a"), F.max("s1").alias("b"), F.bool_or("own").alias("own")).where("k > 1 or own")
    twice = keep(twice.select("h", (F.col("own") | (F.col("a") != F.col("b"))).alias("several")), "twice")
    common = keep(rows.drop("own").join(twice, "h"), "common")
    drop(rows, twice)
    segs = common.groupBy("h", "s1", "s2", "several").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "doc_id", "lo", "hi")).alias("one"))
    segs = keep(segs, "segs")
    whole = common.join(segs.where("n > 1").select("h", "s1", "s2"), ["h", "s1", "s2"]).select("t1", "t2", "lo", "hi").distinct()
    sizes = keep(segs.where("several").groupBy("h").agg((F.count("*") > hot).alias("hot")), "sizes")
    want = segs.where("several").join(sizes, "h")
    want = want.groupBy("one.t1", "one.t2", "one.doc_id").agg(F.collect_list(F.struct("h", "s1", "s2", "n", "hot", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"))).alias("want"))
    want = want.withColumnRenamed("doc_id", "want_id")
    # arrays of places have no proven size, so they are never broadcast
    found = texts.join(want.hint("merge"), ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("want_id")))
    pieces = keep(_segments(found, length), "pieces")
    by_hash, more = _windows(pieces, length)
    spans = whole.unionByName(_blocks(pieces, length)).unionByName(by_hash)
    out = keep(spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    drop(common, segs, sizes, pieces, *more)
    release(spark)
    return out


def cut(text: bytes, spans: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int]:
    """What is left of ``text``, and how many runs were removed."""
    parts, at, runs = [], 0, 0
    for lo, hi in sorted(spans):
        if lo > at or not runs:
            parts.append(text[at:lo])
            runs += 1
        at = max(at, hi + length)
    parts.append(text[at:])
    return b"".join(parts), runs


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """A row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, or with ``keep_columns`` all of ``docs`` with the text that is left.

    A byte goes if a string of ``length`` bytes that also starts anywhere else, in the same
    text or another, covers it; strings are judged on the input. Null counts as empty (and stays null as a text), and a
    text shorter than ``length`` stays whole. Of repeated rows each is a text of its own, so texts of
    ``length`` bytes or more go from all of them. The text that is left is UTF-8, less the bytes of
    characters that a removal cut through. An empty table gives an empty result; other columns, whatever their names, are
    carried with ``keep_columns`` and else ignored. Very long texts are read in steps.
    """
    rest = [c for c in docs.columns if c != text_col]
    whole = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    row = F.struct(*(F.col(f"`{c}`") for c in rest)) if keep_columns else F.col(id_col)  # the columns of the user, whatever their names
    source = docs.select(F.col(id_col).alias("doc_id"), row.alias("row"), F.col(text_col).isNull().alias("none"), whole.alias("text"))
    source = source.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    spans = repeated_spans(source.select("t1", "t2", "doc_id", "text"), length, gram, hot)
    both = source.join(spans.hint("merge"), ["t1", "t2"], "left").select("row", "none", "text", "spans")
    made = {"kept": T.StringType()} if keep_columns else {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out: list[list] = [[] for _ in made]
            for none, whole, spans in zip(*(b.column(c).to_pylist() for c in ("none", "text", "spans"))):
                kept, runs = cut(whole, [(s["lo"], s["hi"]) for s in spans], length) if spans else (whole, 0)
                values = (None if none else kept.decode("utf-8", "ignore"),) if keep_columns else (len(whole), len(whole) - len(kept), runs, hashlib.sha256(kept).hexdigest())
                for o, v in zip(out, values):
                    o.append(v)
            kinds = [pa.string()] if keep_columns else [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(v, k) for v, k in zip(out, kinds))], names=["row", *made])

    done = both.mapInArrow(run, T.StructType([both.schema["row"], *(T.StructField(c, k) for c, k in made.items())]))
    if keep_columns:
        return done.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
    return done.withColumnRenamed("row", "doc_id")
