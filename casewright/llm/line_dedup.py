"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

A line is the set of its words. Words are put in order of rarity, by their counts over all lines, so that two lines with a
Jaccard similarity of p/q share a word in their first ``n - ceil(n * p / q) + 1`` words (prefix filter); lines
are filed under those words. A word that occurs once is passed over. A frequent word would gather too many lines, so a line is
filed under each pair of it and a later word of the prefix, one word longer, that the next common word must
lie in. Lines that meet pass the length filter, the positional filter and a parity signature of the
sets, and are then verified word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.llm.common import drop, keep, release, slices

#: Similarity as a fraction; lines with fewer different words, that is without one, are left alone.
P, Q, LEAST_WORDS = 4, 5, 1
#: Smaller sets match only their equals, which are one class already, so they are not joined.
LEAST_JOINED = next(n for n in range(1, Q + 1) if n * Q // P > n)
#: A word is frequent from this count on, or from a 2^18th of all words if that is more: then no
#: more than 2^18 words are, which bounds what every task is told of them (2 MB).
FREQUENT, MOST_FREQUENT = 128, 1 << 18
#: The other words are ordered by class of their counts: 1, then from each of these counts on. The class stands in a table of CELLS cells
#: under the word's hash, a bit for each count (24 MB in all); words of one cell share the highest class. The order of
#: words is a matter of speed alone: any order that all lines share gives the same matches.
CLASSES, CELLS = (2, 4, 16), 1 << 26
#: Rows of one word compared at once; partners named for a line and word before the rest is left to the second round.
CHUNK, PARTNERS, EARLIEST = 1 << 18, 8, 1 << 14
#: Classes that are sent to every task when tokens are fetched; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
_HEAVY = 1 << 63
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text hashed in one go, and of a block of the table of classes.
_PIECE, _BLOCK = 1 << 20, 32768
#: Bits of the fields of a posting: earliness, words, place.
_ORD, _SIZE, _AT = 23, 20, 20
_FEW = (1 << _SIZE) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] += np.uint64(32)
_VALUE[_SPACE] = 0
_NEAR = np.cumprod(np.append(np.ones(1, np.uint64), np.full(0xFFFF, _MIX)))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX2
    return x ^ (x >> np.uint64(29))


def word_hashes(text: bytes, piece: int = _PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(hash, line)`` of the words of a text, lower-cased A-Z and cut at ASCII space, some of them at a time.

    63 bits of a polynomial in the word's bytes.
    """
    data, lo, line = np.frombuffer(text, np.uint8), 0, 0
    while lo < len(data):
        hi = min(len(data), lo + piece)
        while hi < len(data) and not _SPACE[data[hi]]:  # a word is read whole
            more = np.flatnonzero(_SPACE[data[hi : hi + piece]])
            hi = hi + int(more[0]) if len(more) else min(len(data), hi + piece)
        part = data[lo:hi]
        space = _SPACE[part]
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        breaks = np.flatnonzero(part == 10)
        if len(start):
            at = np.arange(len(part) - start[0]) - np.repeat(start - start[0], np.diff(np.append(start, len(part))))
            value = _VALUE[part[start[0] :]] * _NEAR[at & 0xFFFF]
            if len(part) > 1 << 16:
                value *= (at >> 16).astype(np.uint64) * _MIX2 | np.uint64(1)
            yield _scramble(np.add.reduceat(value, start - start[0]) * _MIX) >> np.uint64(1), line + np.searchsorted(breaks, start)
        line += len(breaks)
        lo = hi


def word_counts(texts: DataFrame) -> DataFrame:
    """``(h, n)``: hashes of words and how often they occur, over all lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        held, count = [], 0
        for b in slices(batches, "text"):
            for h, _ in word_hashes(b"\n".join(t or b"" for t in b.column("text").to_pylist())):
                held.append(h)
                count += len(h)
                if count > 4_000_000:
                    yield out()
                    held, count = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Order:
    """Words by rarity: the frequent ones by count, the others by class of their counts and then by hash."""

    def __init__(self, frequent: np.ndarray, bits: list[np.ndarray]):
        place = np.argsort(frequent)
        self.frequent, self.place, self.bits = frequent[place].astype(np.uint64), place.astype(np.uint64), bits

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Of different hashes: class and 61 bits of the hash, or above all of those the place among the frequent."""
        cell = h & np.uint64(CELLS - 1)
        level = sum((b[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(np.uint64) for b in self.bits) if self.bits else np.uint64(0)
        out = (level << np.uint64(61)) | (h >> np.uint64(2))
        if len(self.frequent):
            i = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
            out = np.where(self.frequent[i] == h, self.place[i] + np.uint64(_HEAVY), out)
        return out


#: Keys below this are words that occur once.
_TWICE = np.uint64(1 << 61)


def rarity(texts: DataFrame) -> Order:
    """The order of words by their counts over all ``texts``: of bounded size, whatever the vocabulary."""
    counts = keep(word_counts(texts), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT, -(-total // MOST_FREQUENT))
    got = counts.where(F.col("n") >= least).toPandas().sort_values(["n", "h"])
    cell = F.col("h").bitwiseAND(F.lit(CELLS - 1))
    levels = F.explode(F.array(*(F.when(F.col("n") >= c, F.lit(k)) for k, c in enumerate(CLASSES))))
    marks = counts.where((F.col("n") >= CLASSES[0]) & (F.col("n") < least)).select(levels.alias("level"), cell.alias("cell")).where("level is not null")
    marks = marks.groupBy("level", F.shiftright("cell", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit(_BLOCK - 1))).alias("bits"))
    bits = [np.zeros(CELLS // 8, np.uint8) for _ in CLASSES]
    for level, block, part in marks.collect():  # at most 3 * CELLS / 8 bytes
        bits[level][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = np.frombuffer(part, np.uint8)
    drop(counts)
    return Order(got["h"].to_numpy(np.int64), bits)


def _sign(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def lines(texts: DataFrame, order: Order) -> DataFrame:
    """A row per line with a word: ``c1, c2`` (of equal sets the same), ``row, doc_id, line, size, rare, tokens``.

    ``tokens`` is there once per class and batch, in the earliest line, from LEAST_JOINED words on: 8 bytes for each rare word, then 4 for each frequent one, both in order of rarity.
    """
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            b = b.take(pc.sort_indices(b.select(["doc_id", "row"]), [("doc_id", "ascending"), ("row", "ascending")], null_placement="at_start"))
            all_ = [t or b"" for t in b.column("text").to_pylist()]
            found = list(word_hashes(b"\n".join(all_)))
            if not found:
                continue
            first = np.cumsum([0] + [t.count(b"\n") + 1 for t in all_])
            coded = pa.array(np.concatenate([x for x, _ in found])).dictionary_encode()
            word, of = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            line = np.concatenate([x for _, x in found])
            del found, coded
            key = shared.value.keys(word)
            by = np.argsort(key)
            code = np.empty(len(by), np.uint64)
            code[by] = np.arange(len(by), dtype=np.uint64)
            both = (line.astype(np.uint64) << np.uint64(32)) | code[of]
            both.sort()
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
            key, line = key[by][both & np.uint64(0xFFFFFFFF)], (both >> np.uint64(32)).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            size = np.diff(np.append(start, len(line)))
            heavy = key >= np.uint64(_HEAVY)
            rare = size - np.add.reduceat(heavy.astype(np.int64), start)
            c1, c2 = (_scramble(np.add.reduceat(_scramble(key * m), start) + size.astype(np.uint64)) for m in (_MIX, _MIX2))
            number = line[start]
            owner = np.searchsorted(first, number, side="right") - 1
            # the earliest line of each set brings its words
            same = np.lexsort((np.arange(len(c1)), c2, c1))
            lead = np.zeros(len(c1), bool)
            lead[same[np.concatenate([[True], (c1[same][1:] != c1[same][:-1]) | (c2[same][1:] != c2[same][:-1])])]] = True
            lead &= size >= LEAST_JOINED
            told = np.repeat(lead, size)
            key, heavy = key[told], heavy[told]
            units = np.where(heavy, 1, 2)
            at = np.cumsum(units) - units
            data = np.empty(int(units.sum()), np.uint32)
            data[at] = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            data[at[~heavy] + 1] = (key[~heavy] >> np.uint64(32)).astype(np.uint32)
            ends = np.cumsum(np.where(lead, 4 * (size + rare), 0))
            tokens = pa.Array.from_buffers(pa.binary(), len(size), [pa.py_buffer(np.packbits(lead, bitorder="little").tobytes()), pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            take = pa.array(owner)
            cols = [_sign(c1), _sign(c2), b.column("row").take(take), b.column("doc_id").take(take), pa.array((number - first[owner]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(rare.astype(np.int32)), tokens]
            yield pa.RecordBatch.from_arrays(cols, names=["c1", "c2", "row", "doc_id", "line", "size", "rare", "tokens"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"c1 long, c2 long, row long, doc_id {kind}, line int, size int, rare int, tokens binary")


def _unpack(tokens: bytes, rare: int) -> set[int]:
    return {*memoryview(tokens)[: 8 * rare].cast("Q"), *(x + _HEAVY for x in memoryview(tokens)[8 * rare :].cast("I"))}


def _pairs(words: np.ndarray, single: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines (rows of ``words``, their first words in order) under their frequent words, and the places of those."""
    i, j = np.triu_indices(first + 1, 1)
    chosen = (i >= single) & (i < first)
    i, j = i[chosen], j[chosen]
    mixed = (words[:, i] * _MIX) ^ (words[:, j] * _MIX2)
    mixed ^= mixed >> np.uint64(31)
    return mixed * _MIX | np.uint64(1), i


def postings(rows: DataFrame) -> DataFrame:
    """``(key, cls, sig, sig2, rest)``: each class under each of its keys; each word flips a bit of the 128 of the signature.

    ``rest`` packs earliness, words and place; beyond 2^20 words both are cut to what filters take for unknown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "tokens", 2 << 20):
            rare, tokens = b.column("rare").to_numpy().astype(np.int64), b.column("tokens")
            begin = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64) // 4
            units = np.frombuffer(tokens.buffers()[2], np.uint32)
            n = np.diff(begin) - rare
            start = np.cumsum(n) - n
            place, few = np.arange(n.sum()) - np.repeat(start, n), np.repeat(rare, n)
            at = np.repeat(begin[:-1], n) + place + np.minimum(place, few)  # two units for each rare word
            few = place < few
            x = units[at].astype(np.uint64)
            x[few] |= units[at[few] + 1].astype(np.uint64) << np.uint64(32)
            x[~few] += np.uint64(_HEAVY)
            spot = (x * _MIX) >> np.uint64(57)
            bit, none = np.uint64(1) << (spot & np.uint64(63)), np.uint64(0)
            sig, sig2 = (np.bitwise_xor.reduceat(np.where(half, bit, none), start) for half in (spot < 64, spot >= 64))
            first = n - -(-n * P // Q) + 1
            single = np.minimum(first, rare)
            chosen = (place < np.repeat(single, n)) & (x >= _TWICE)
            key, at, each = [x[chosen] << np.uint64(1)], [place[chosen]], [np.repeat(np.arange(len(n)), n)[chosen]]
            shape = np.where(first > single, first << 32 | single, -1)
            for v in np.unique(shape[shape >= 0]).tolist():  # lines of one shape together
                k = np.flatnonzero(shape == v)
                f, g = v >> 32, v & 0xFFFFFFFF
                step = max(1, (1 << 20) // (f + 1) ** 2)
                for lo in range(0, len(k), step):
                    part = k[lo : lo + step]
                    own, i = _pairs(x[start[part][:, None] + np.arange(f + 1)], g, f)
                    key.append(own.ravel())
                    at.append(np.tile(i, len(part)))
                    each.append(np.repeat(part, len(i)))
            each = np.concatenate(each)
            rest = (b.column("ord").to_numpy()[each].astype(np.uint64) << np.uint64(_SIZE + _AT)) | (np.minimum(n, _FEW).astype(np.uint64)[each] << np.uint64(_AT)) | np.minimum(np.concatenate(at), _FEW).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([_sign(np.concatenate(key)), b.column("c1").take(pa.array(each)), _sign(sig[each]), _sign(sig2[each]), _sign(rest)], names=["key", "cls", "sig", "sig2", "rest"])

    return rows.select("c1", "ord", "rare", "tokens").mapInArrow(run, "key long, cls long, sig long, sig2 long, rest long")


def _sizes_match(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """Length and positional filters; neither drops a match at its first common word."""
    both = a["size"] + b["size"]
    most = np.minimum(a["size"] - a["at"], b["size"] - b["at"])  # the word itself and all after it
    ok = (P * a["size"] <= Q * b["size"]) & (P * b["size"] <= Q * a["size"]) & ((P + Q) * most >= P * both)
    return ok | (a["size"] == _FEW) | (b["size"] == _FEW)


def _signs_match(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """The signatures differ in no more bits than the sets may differ in words."""
    off = np.bitwise_count(a["sig"] ^ b["sig"]).astype(np.int32) + np.bitwise_count(a["sig2"] ^ b["sig2"])
    ok = (P + Q) * off <= (Q - P) * (a["size"] + b["size"])
    return (ok | (a["size"] == _FEW) | (b["size"] == _FEW)) & (a["cls"] != b["cls"])


def _meet(posts: DataFrame) -> DataFrame:
    """``(x, y, keys, more)``: for each line and key the first earlier lines that pass the filters, and under how many keys; ``more`` if there may be others."""

    def solve(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(c["key"])
        xs, ys = [], []
        start = np.flatnonzero(np.concatenate([[True], c["key"][1:] != c["key"][:-1]]))
        length = np.diff(np.concatenate([start, [n]]))
        left = np.repeat(start + length, length) - np.arange(n)  # rows from this one to the end of its key
        lag = 1
        live = np.flatnonzero(left > lag)
        while len(live):
            y, x = live, live + lag  # rows come in order, so the partner is the earlier one
            ok = _sizes_match({k: c[k][x] for k in sizes}, {k: c[k][y] for k in sizes})
            x, y = x[ok], y[ok]
            ok = _signs_match({k: c[k][x] for k in signs}, {k: c[k][y] for k in signs})
            xs.append(x[ok])
            ys.append(y[ok])
            lag += 1
            live = live[left[live] > lag]
        if not xs:
            e = np.zeros(0, np.int64)
            return e, e, e.astype(bool)
        x, y = np.concatenate(xs), np.concatenate(ys)
        tie = c["ord"][x] == c["ord"][y]  # lines of one text: either may be the later
        x, y = np.concatenate([x, y[tie]]), np.concatenate([y, x[tie]])
        o = np.lexsort((y, x))
        x, y = x[o], y[o]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
        runs = np.diff(np.concatenate([first, [len(x)]]))
        nth, many = np.arange(len(x)) - np.repeat(first, runs), np.repeat(runs > PARTNERS, runs)
        took = nth < PARTNERS
        return c["cls"][x[took]], c["cls"][y[took]], many[took]

    def large(c: dict[str, np.ndarray], ref: dict[str, np.ndarray], whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One key with many rows: each row against the earliest ones, until it has a partner. Unless they are the ``whole`` of the key, a row without one is left over."""
        n, width = len(c["key"]), 256
        open_, xs, ys = np.arange(n), [], []
        for at in range(0, len(ref["key"]), width):
            if not len(open_):
                break
            y = slice(at, at + width)
            hit = np.zeros(len(open_), bool)
            for lo in range(0, len(open_), 4096):
                x = open_[lo : lo + 4096]
                one, two = {k: c[k][x][:, None] for k in (*sizes, *signs)}, {k: ref[k][y][None] for k in (*sizes, *signs)}
                ok = _sizes_match(one, two) & _signs_match(one, two) & (c["ord"][x][:, None] >= ref["ord"][y][None])
                some = ok.any(axis=1)
                hit[lo : lo + 4096] = some
                xs.append(c["cls"][x[some]])
                ys.append(ref["cls"][y][ok[some].argmax(axis=1)])
            open_ = open_[~hit]
        if not whole:
            xs.append(c["cls"][open_])
            ys.append(c["cls"][open_])  # itself: no partner among the earliest
        x, y = np.concatenate(xs), np.concatenate(ys)
        return x, y, np.ones(len(x), bool)

    names, sizes, signs = ["key", "cls", "sig", "sig2", "rest"], ("size", "at"), ("cls", "sig", "sig2", "size")

    def batch(made: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        t = pa.table({"x": made[0], "y": made[1], "more": made[2]}).group_by(["x", "y"]).aggregate([("more", "max")])
        return pa.RecordBatch.from_arrays([t["x"].combine_chunks(), t["y"].combine_chunks(), t["more_max"].combine_chunks()], names=["x", "y", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, ref = 0, None

        def columns(bs: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
            t = pa.Table.from_batches(bs)
            out = {k: t[k].to_numpy() for k in names}
            rest = out["rest"]
            return out | {"sig": out["sig"].view(np.uint64), "sig2": out["sig2"].view(np.uint64), "ord": rest >> (_SIZE + _AT), "size": (rest >> _AT & _FEW).astype(np.int32), "at": (rest & _FEW).astype(np.int32)}

        def split(c: dict[str, np.ndarray], limit: int) -> Iterator[tuple]:
            """Small keys together, each large one by itself."""
            start = np.flatnonzero(np.concatenate([[True], c["key"][1:] != c["key"][:-1]]))
            length = np.diff(np.concatenate([start, [len(c["key"])]]))
            big = length > limit
            small = np.repeat(~big, length)
            if small.any():
                yield solve({k: v[small] for k, v in c.items()})
            for s, n in zip(start[big].tolist(), length[big].tolist()):
                one = {k: v[s : s + n] for k, v in c.items()}
                yield large(one, {k: v[:EARLIEST] for k, v in one.items()}, n <= EARLIEST)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count, ref
            c = columns(held)
            n = len(c["key"])
            cut = n if last else int(np.searchsorted(c["key"], c["key"][-1]))
            if ref is not None:  # the key of the chunk before goes on
                more = int(np.searchsorted(c["key"], ref["key"][0], side="right"))
                if more:
                    yield batch(large({k: v[:more] for k, v in c.items()}, ref, False))
                    c = {k: v[more:] for k, v in c.items()}
                    n, cut = n - more, max(0, cut - more)
                if not n:  # and may go on in the next
                    held, count = [], 0
                    return
                ref = None
            if n and not cut and not last:  # one key fills the chunk
                ref = {k: v[:EARLIEST] for k, v in c.items()}
                yield batch(large(c, ref, False))
                held, count = [], 0
                return
            for made in split({k: v[:cut] for k, v in c.items()}, 512):
                yield batch(made)
            held = [pa.RecordBatch.from_arrays([pa.array(c[k][cut:].view(np.int64)) for k in names], names=names)]
            count = n - cut

        for b in batches:
            held.append(pa.RecordBatch.from_arrays([b.column(k) for k in names], names=names))
            count += b.num_rows
            if count >= CHUNK:
                yield from flush(False)
        if count:
            yield from flush(True)

    dealt = posts.repartition(F.col("key")).sortWithinPartitions("key", "rest", "cls")
    return dealt.mapInArrow(run, "x long, y long, more boolean").groupBy("x", "y").agg(F.count("*").alias("keys"), F.max("more").alias("more"))


def _sets(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(c1, c2, rare, tokens)``, a row per class, of the classes that ``pairs (x, y)`` name by ``c1``."""
    wanted = keep(pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct(), "need")
    hint = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    out = keep(rows.join(hint, F.col("c1") == F.col("cls")).select("c1", "c2", "rare", "tokens", F.struct("doc_id", "row", "line").alias("first")), "sets")
    drop(wanted)
    return out


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(x, x2, y, y2)`` of the pairs of ``c1`` whose sets are similar enough, counted word by word."""
    once = sets.dropDuplicates(["c1", "c2"])
    side = lambda c: once.select(F.col("c1").alias(c), F.col("c2").alias(f"{c}2"), F.col("rare").alias(f"{c}r"), F.col("tokens").alias(f"{c}t"))
    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "xt"):
            good = []
            for xr, xt, yr, yt in zip(*(b.column(c).to_pylist() for c in ("xr", "xt", "yr", "yt"))):
                one, two = _unpack(xt, xr), _unpack(yt, yr)
                common = len(one & two)
                good.append(common * Q >= P * (len(one) + len(two) - common))
            yield b.select(["x", "x2", "y", "y2"]).filter(pa.array(good, pa.bool_()))

    return both.select("x", "x2", "y", "y2", "xr", "xt", "yr", "yt").mapInArrow(run, "x long, x2 long, y long, y2 long")


def _earlier(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``c1, c2`` of the classes with a verified partner whose first line comes before their own."""
    good = keep(_verify(pairs, sets), "verified")
    first = keep(sets.groupBy("c1", "c2").agg(F.min("first").alias("first")), "first")
    side = lambda c: first.select(F.col("c1").alias(c), F.col("c2").alias(f"{c}2"), F.col("first").alias(f"{c}f"))
    placed = good.join(side("x"), ["x", "x2"]).join(side("y"), ["y", "y2"])
    late = F.col("xf") > F.col("yf")
    out = keep(placed.select(F.when(late, F.col("x")).otherwise(F.col("y")).alias("c1"), F.when(late, F.col("x2")).otherwise(F.col("y2")).alias("c2")).distinct(), "later")
    drop(good, first)
    return out


def _earliness(texts: DataFrame) -> Column:
    """A rank of 23 bits that never falls as ids rise; 0 for null ids and for ids that are no numbers."""
    if dict(texts.dtypes)["doc_id"] not in ("bigint", "int", "smallint", "tinyint"):
        return F.lit(0)
    lo, hi = texts.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None:
        return F.lit(0)
    share = (F.col("doc_id").cast("double") - F.lit(float(lo))) / F.lit(max(1.0, float(hi) - float(lo)))
    return F.coalesce(F.floor(share * ((1 << _ORD) - 1)).cast("int"), F.lit(0))


def removed_lines(texts: DataFrame) -> DataFrame:
    """``(row, doc_id, line)`` of every line that matches an earlier one, for ``texts (row, doc_id, text binary)``."""
    spark = texts.sparkSession
    order = rarity(texts)
    release(spark)
    all_rows = keep(lines(texts, order).withColumn("ord", _earliness(texts)), "lines")
    rows = all_rows.where("tokens is not null")
    met = keep(_meet(postings(rows)), "met")
    release(spark)
    pairs = met.where("x <> y")
    sets = _sets(rows, pairs)
    # the partner that shares most keys is tried first; only lines it does not settle try the others
    best = keep(pairs.groupBy("x").agg(F.max_by("y", F.struct("keys", "y")).alias("y")), "best")
    later = _earlier(best, sets)
    release(spark)
    settled = later.select(F.col("c1").alias("x"))
    others = pairs.select("x", "y").join(best, ["x", "y"], "left_anti").join(settled, "x", "left_anti")
    later = keep(later.unionByName(_earlier(others, sets)).distinct(), "later")
    drop(sets, best)
    release(spark)
    # a line whose named partners are not earlier matches, and that has others, is compared with all of its keys
    more = met.where("more").select(F.col("x").alias("c1")).distinct()
    open_ = keep(rows.join(more, "c1").select("c1", "c2").distinct().join(later, ["c1", "c2"], "left_anti"), "open")
    if not open_.isEmpty():
        asking = postings(rows.join(open_, ["c1", "c2"], "left_semi")).groupBy("key", "cls").agg(F.min(F.struct("rest", "sig", "sig2")).alias("m"))
        a = keep(asking.select("key", F.col("cls").alias("cls_x"), F.col("m.rest").alias("rest_x"), F.col("m.sig").alias("sig_x"), F.col("m.sig2").alias("sig2_x")), "again")
        hint = F.broadcast(a) if a.count() <= MOST_BROADCAST // 4 else a
        field = lambda c, low, few: F.shiftright(F.col(c), low).bitwiseAND(F.lit(few))
        size, size_x, at, at_x = (field(c, low, _FEW) for low in (_AT, 0) for c in ("rest", "rest_x"))
        close = (
            (P * size <= Q * size_x) & (P * size_x <= Q * size) & ((P + Q) * F.least(size - at, size_x - at_x) >= P * (size + size_x))
            & ((P + Q) * (F.bit_count(F.col("sig").bitwiseXOR(F.col("sig_x"))) + F.bit_count(F.col("sig2").bitwiseXOR(F.col("sig2_x")))) <= (Q - P) * (size + size_x))
        )
        near = (F.col("cls") != F.col("cls_x")) & (F.shiftright("rest", _SIZE + _AT) <= F.shiftright("rest_x", _SIZE + _AT)) & (close | (size == _FEW) | (size_x == _FEW))  # only an earlier line counts
        again = keep(postings(rows).join(hint, "key").where(near).select(F.col("cls_x").alias("x"), F.col("cls").alias("y")).distinct(), "pairs")
        sets = _sets(rows, again)
        later = keep(later.unionByName(_earlier(again, sets)).distinct(), "later")
        drop(a, again, sets)
    first = all_rows.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count("*").alias("n"))
    # a line that a third of the texts have: what is known of a class is written, so AQE can split the other side of the join
    state = keep(first.join(later.withColumn("gone", F.lit(True)), ["c1", "c2"], "left").where("gone or n > 1"), "state")
    own = F.struct("doc_id", "row", "line")
    out = all_rows.join(state, ["c1", "c2"]).where(F.col("gone").isNotNull() | (own != F.col("first"))).select("row", "doc_id", "line")
    out = keep(out.groupBy("row", "doc_id").agg(F.collect_set("line").alias("gone")), "removed")
    drop(all_rows, met, later, open_, state)
    release(spark)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """A row per input row: ``doc_id, n_lines, n_removed, kept_sha256``, or with ``keep_columns`` all of ``docs`` with the text that is left.

    A line goes if an earlier one, by id and then place, has a Jaccard similarity of P/Q or more of
    their sets of words (lower-cased A-Z, cut at ASCII space); lines are judged on the input. Lines without
    a word stay. Null counts as empty: no line. Rows that repeat an id and a
    text count as one text and lose the same lines; null ids come first. An empty table gives an empty result. Other columns,
    whatever their names, are carried with ``keep_columns`` and else ignored. Very long texts are read in steps, a line's set of words whole.
    """
    rest = [c for c in docs.columns if c != text_col]
    own = F.struct(*(F.col(f"`{c}`") for c in rest)) if keep_columns else F.col(id_col)
    whole = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    source = docs.select(F.col(id_col).alias("doc_id"), own.alias("own"), F.col(text_col).isNull().alias("none"), whole.alias("text"))
    source = source.withColumn("row", F.xxhash64("doc_id", "text"))
    gone = removed_lines(source.select("row", "doc_id", "text")).select(F.col("row").alias("r"), F.col("doc_id").alias("d"), "gone")
    source = source.join(gone, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select("own", "none", "text", "gone")
    kinds = {"kept": T.StringType()} if keep_columns else {"n_lines": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out: list[list] = [[] for _ in kinds]
            for text, none, gone in zip(*(b.column(c).to_pylist() for c in ("text", "none", "gone"))):
                kept = text
                if gone:
                    lost = set(gone)
                    kept = b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in lost)
                made = (None if none else kept.decode("utf-8", "replace"),) if keep_columns else (0 if none else text.count(b"\n") + 1, len(gone or ()), hashlib.sha256(kept).hexdigest())
                for o, v in zip(out, made):
                    o.append(v)
            made = (pa.string(),) if keep_columns else (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("own"), *(pa.array(v, k) for v, k in zip(out, made))], names=["own", *kinds])

    done = source.mapInArrow(run, T.StructType([source.schema["own"], *(T.StructField(c, k) for c, k in kinds.items())]))
    if keep_columns:
        return done.select(*(F.col("kept").alias(c) if c == text_col else F.col(f"own.`{c}`") for c in docs.columns))
    return done.withColumnRenamed("own", "doc_id")
