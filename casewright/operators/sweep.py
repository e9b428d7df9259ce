"""Many needles in many texts, every place of each, in one pass over the bytes.

Windows of 1, 2, 4, 8 ... bytes at all places of a block of texts are hashed by doubling. A needle of up to 32
bytes is looked up by its length: two windows that cover it, one at each end. A longer one is looked up by its first window of the largest
power of two that it holds, then by its last. What agrees is compared byte by byte, a longer needle by its digest. So the time grows with the bytes read and with the
number of different short lengths, not with the number of needles.

Needles are hashed in tasks, once. What goes to every task is some 50 bytes a needle, however long it is, held in arrays; as many at a time as are under a
bound. With more, the texts are read once for each portion.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]

#: Bytes of what is sent of needles at a time, and bytes of texts that are looked at together.
PORTION, BLOCK = 96 << 20, 1 << 18
#: Lengths looked up one by one.
SHORT = 32
#: Bytes of the digest of a longer needle, and of what else is sent of any.
DIGEST, SENT = 16, 40
#: Bytes of needles that are hashed together.
_HASHED = 4 << 20
#: Characters kept before and behind a place, for rules about what a needle stands in.
AROUND = 64
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _double(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of ``2 * size`` bytes from those of ``size``."""
    left = w[..., :-size]
    return (left ^ (left >> np.uint64(29))) * _A + w[..., size:] * _B


def _both(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first ^ (first >> np.uint64(31))) * _C + last * _A


def _ends(needles: Sequence[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last window of needles of ``n`` bytes."""
    g = 1 << (n.bit_length() - 1)
    rows = np.frombuffer(b"".join(needles), np.uint8).reshape(-1, n)
    out = []
    for part in (rows[:, :g], rows[:, n - g :]):
        w = part.astype(np.uint64) + np.uint64(1)
        while w.shape[1] > 1:  # of the windows that doubling makes, those that the first is made of
            left = w[:, 0::2]
            w = (left ^ (left >> np.uint64(29))) * _A + w[:, 1::2] * _B
        out.append(w[:, 0])
    return out[0], out[1]


def _digest(needle: bytes | memoryview) -> bytes:
    return hashlib.blake2b(needle, digest_size=DIGEST).digest()


class _Table:
    """Different needles of one length, or of one class of lengths, by hash."""

    def __init__(self, hashes: np.ndarray, which: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.which = hashes[order], which[order].astype(np.int32)
        bits = min(22, max(12, int(len(hashes)).bit_length() + 6))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.hashes * _C) >> self.shift] = True

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Places whose hash may be one of the needles'."""
        return np.flatnonzero(self.seen[(h * _C) >> self.shift])

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, needle)`` of each needle with the hash at a place."""
        at = self.maybe(h)
        lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.which[np.repeat(lo, n) + nth]


class Needles:
    """Needles by size, hashes of both ends and mark: its bytes up to ``SHORT``, else its digest; ``marks`` are one behind the other."""

    def __init__(self, size: np.ndarray, first: np.ndarray, last: np.ndarray, marks: np.ndarray):
        self.size, self.last, self.marks = size, last, marks
        width = np.where(size <= SHORT, size, DIGEST)
        self.mark = np.cumsum(width) - width
        self.longest = int(size.max(initial=0))
        self.short: dict[int, _Table] = {}
        self.long: dict[int, _Table] = {}
        heads: dict[int, list[np.ndarray]] = {}
        for n in np.unique(size[(size > 0) & (size <= SHORT)]).tolist():
            which = np.flatnonzero(size == n)
            self.short[n] = _Table(_both(first[which], last[which]), which)
            heads.setdefault(1 << (n.bit_length() - 1), []).append(first[which])
        # first windows of all short needles of one class, so that most places are passed over once for all its lengths
        self.heads = {g: _Table(h := np.unique(np.concatenate(x)), np.arange(len(h))) for g, x in heads.items()}
        power = np.where(size > SHORT, 2 ** np.floor(np.log2(np.maximum(size, 1))).astype(np.int64), 0)
        for g in np.unique(power[power > 0]).tolist():
            which = np.flatnonzero(power == g)
            self.long[g] = _Table(first[which], which)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, needle)``: every place where a needle begins."""
        w, g, found = data.astype(np.uint64) + np.uint64(1), 1, []
        most = max([*self.short, *self.long], default=0)
        while len(w) and g <= most:
            begin = self.heads[g].maybe(w) if g in self.heads else None
            for n in (n for n in self.short if g <= n < 2 * g and n <= len(data)):
                near = begin[begin <= len(data) - n]
                at, which = self.short[n].look(_both(w[near], w[near + n - g]))
                at = near[at]
                same, mark = np.ones(len(at), bool), self.mark[which]
                for k in range(n):
                    same &= data[at + k] == self.marks[mark + k]
                found.append((at[same], which[same]))
            if g in self.long:
                at, which = self.long[g].look(w)
                end = at + self.size[which] - g
                ok = end < len(w)
                at, which, end = at[ok], which[ok], end[ok]
                ok = w[end] == self.last[which]
                at, which = at[ok], which[ok]
                ends = zip(at.tolist(), self.size[which].tolist(), self.mark[which].tolist())
                same = np.array([_digest(data[a : a + n]) == self.marks[m : m + DIGEST].tobytes() for a, n, m in ends], bool)
                found.append((at[same], which[same]))
            w = _double(w, g) if len(w) > g else w[:0]
            g *= 2
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, which = (np.concatenate(x) for x in zip(*found))
        return at, which


_MADE: dict[str, Needles] = {}


def _made(name: str, sent: Sequence[np.ndarray]) -> Needles:
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Needles(*sent)
    return _MADE[name]


def _prepared(needles: DataFrame, forms: Sequence[str], chars: bool) -> DataFrame:
    """``(n, form, size, first, last, mark)`` of each form of the needles ``(n, needle)``: the form's number, and what :class:`Needles` is made of."""

    def batch(made: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        size = np.array([len(m) for _, _, m in made], np.int64)
        first, last = np.zeros(len(made), np.uint64), np.zeros(len(made), np.uint64)
        order = np.argsort(size, kind="stable")
        for which in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            first[which], last[which] = _ends([made[i][2] for i in which.tolist()], int(size[which[0]]))
        marks = [m if len(m) <= SHORT else _digest(m) for _, _, m in made]
        cols = [pa.array([n for n, _, _ in made], pa.int64()), pa.array([f for _, f, _ in made], pa.int32()), pa.array(size), pa.array(first.view(np.int64)), pa.array(last.view(np.int64)), pa.array(marks, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["n", "form", "size", "first", "last", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for b in batches:
            for n, w in zip(b.column(0), b.column(1)):
                for m, form in _forms(w.as_py(), forms, chars).items():
                    made.append((n.as_py(), forms.index(form), m))
                    size += len(m) + SENT
                if size > _HASHED:
                    yield batch(made)
                    made, size = [], 0
        if made:
            yield batch(made)

    return needles.mapInArrow(run, "n long, form int, size long, first long, last long, mark binary")


def _blocks(texts: list[bytes], longest: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, int, int]]:
    """``(texts, where each begins, bytes, bytes before these, places that count)``: short texts together, a long one in parts that overlap."""
    held, size = [], 0
    most = max(BLOCK, 2 * longest)
    for i, t in enumerate([*texts, None]):
        if held and (t is None or size + len(t) > most):
            first = np.cumsum([0] + [len(texts[k]) for k in held])
            yield held, first, np.frombuffer(b"".join(texts[k] for k in held), np.uint8), 0, size
            held, size = [], 0
        if t is not None and len(t) > most:
            for at in range(0, len(t), most):
                part = np.frombuffer(t, np.uint8)[at : at + most + longest]
                yield [i], np.array([0, len(part)]), part, at, min(most, len(part))
        elif t:
            held.append(i)
            size += len(t)


def _portion(texts: DataFrame, key: str, col: str, needles: DataFrame, forms: Sequence[str], around: int) -> DataFrame:
    """``(key, needle number, form, at, before, behind)`` for one portion of prepared needles."""
    spark = texts.sparkSession
    listed = needles.toArrow()  # a portion
    n, form, size, first, last = (listed[c].to_numpy() for c in ("n", "form", "size", "first", "last"))
    marks = np.frombuffer(b"".join(b"".join(c.to_pylist()) for c in listed["mark"].chunks), np.uint8)
    sent, name = spark.sparkContext.broadcast((n, form.astype(np.int8), size, first.view(np.uint64), last.view(np.uint64), marks)), uuid.uuid4().hex
    del listed, n, form, size, first, last, marks
    chars = dict(texts.dtypes)[col] == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, form, *rest = sent.value
        own, named = _made(name, rest), np.array(forms, object)
        for b in batches:
            rows = [x or b"" for x in b.column(1).to_pylist()]
            passed: dict[int, int] = {}
            for held, first, data, before, count in _blocks(rows, own.longest):
                at, which = own.find(data)
                text = np.searchsorted(first, at, "right") - 1
                ok = (at + own.size[which] <= first[text + 1]) & (at < count)
                at, which, text = at[ok], which[ok], text[ok]
                letters = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if chars else np.arange(len(data) + 1)
                start = passed.get(held[0], 0) if before else 0
                if len(held) == 1:
                    passed[held[0]] = start + int(letters[min(count, len(data))])
                if not len(at):
                    continue
                place = letters[at] - letters[first[text]] + 1 + start
                left, right = [None] * len(at), [None] * len(at)
                if around:
                    for k in np.flatnonzero(own.size[which] <= 4 * around).tolist():
                        a, z = int(at[k]), int(at[k] + own.size[which[k]])
                        t = rows[held[text[k]]]
                        a, z = (a + before, z + before) if before or len(held) == 1 else (a - int(first[text[k]]), z - int(first[text[k]]))
                        left[k] = t[max(0, a - 4 * around) : a].decode("utf-8", "ignore")[-around:]
                        right[k] = t[z : z + 4 * around].decode("utf-8", "ignore")[:around]
                rows_of = pa.array(np.array(held)[text])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows_of), pa.array(number[which]), pa.array(named[form[which]], pa.string()), pa.array(place, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())],
                    names=["key", "needle", "form", "at", "before", "behind"],
                )

    kind = dict(texts.dtypes)[key]
    return texts.select(F.col(key).alias("key"), F.col(col).cast("binary").alias("text")).mapInArrow(run, f"key {kind}, needle long, form string, at long, before string, behind string")


def _phases(plain: bytes, form: str) -> list[bytes]:
    """How a literal shows in base64 or base32 wherever it begins in what was encoded: only characters that its own bits fill."""
    bits, group, code = (6, 3, base64.b64encode) if form == "base64" else (5, 5, base64.b32encode)
    out = []
    for k in range(group):
        shown = code(bytes(k) + plain)[-(-8 * k // bits) : 8 * (k + len(plain)) // bits]
        out += [shown] if shown else []
    return out


def _forms(needle: str | bytes, forms: Sequence[str], chars: bool) -> dict[bytes, str]:
    """The bytes of each form, the first named where two are the same."""
    out: dict[bytes, str] = {}
    plain = needle if isinstance(needle, bytes) else needle.encode()
    for f in forms:
        if f == "plain":
            made = [plain]
        elif f == "utf16":  # in a text, as its bytes show one by one: a zero after each character
            made = ["".join(c + "\0" for c in plain.decode()).encode() if chars else plain.decode().encode("utf-16-le")]
        elif f == "json":
            made = [json.dumps(plain.decode())[1:-1].encode(), json.dumps(plain.decode(), ensure_ascii=False)[1:-1].encode()]
        elif f == "hex":
            made = [plain.hex().encode(), plain.hex().upper().encode()]
        elif f == "rot13":
            made = [codecs.encode(plain.decode(), "rot13").encode()]
        elif f in ("base64", "base32"):
            made = _phases(plain, f)
        else:
            raise ValueError(f"no form {f!r}")
        for m in made:
            out.setdefault(m, f)
    return out


def sweep(texts: DataFrame, key: str, col: str, needles: DataFrame, needle_key: str, needle: str, keep: Keep, forms: Sequence[str] = ("plain",), around: int = 0, portion: int = PORTION) -> DataFrame:
    """``(key, needle_key, form, at, before, behind)``: every place (characters from 1; bytes in a binary column) of each needle, overlapping ones too.

    ``forms`` are plain, utf16, json, hex (either case), rot13, base64 and base32 (wherever the needle begins in what was encoded); where two forms of a needle are the same bytes, the first counts. With ``around``, the characters on both sides of
    places of short needles follow. Empty needles and nulls match nothing. ``keep`` writes a table.
    """
    chars = dict(texts.dtypes)[col] == "string"
    asked = keep(needles.where(F.length(needle) > 0).select(F.col(needle_key).alias("_key"), F.col(needle).alias("_needle")))
    numbered = keep(asked.select("_needle").distinct().withColumn("_n", F.monotonically_increasing_id()))
    asked = keep(asked.distinct().join(numbered, "_needle").select("_key", "_n"))
    prepared = keep(_prepared(numbered.select("_n", "_needle"), list(forms), chars))
    total = prepared.agg(F.sum(F.octet_length("mark") + SENT)).first()[0] or 0
    portions = max(1, -(-total // portion))
    out = None
    for k in range(portions):
        mine = prepared if portions == 1 else prepared.where(F.pmod(F.xxhash64("n"), F.lit(portions)) == k)
        made = _portion(texts, key, col, mine, forms, around)
        out = made if out is None else out.unionByName(made)
    found = out.join(asked, out.needle == asked._n)
    return found.select(F.col("key").alias(key), F.col("_key").alias(needle_key), "form", "at", "before", "behind")


def in_longer_run(before: Column, needle: Column, behind: Column) -> Column:
    """Whether a short needle is a part of something longer that happens to hold it: a number, a long hex string or a base64 string."""
    out = F.concat(before, behind)
    digits = (F.concat(F.right(before, F.lit(1)), F.left(needle, F.lit(1))).rlike("^[0-9]{2}$")) | (F.concat(F.right(needle, F.lit(1)), F.left(behind, F.lit(1))).rlike("^[0-9]{2}$"))

    def run(kind: str) -> tuple[Column, Column]:
        """Letters of the run outside the needle, and the run's length."""
        outside = F.concat(F.regexp_extract(before, f"([{kind}]*)$", 1), F.regexp_extract(behind, f"^([{kind}]*)", 1))
        return outside, F.when(needle.rlike(f"^[{kind}]+$"), F.length(outside) + F.length(needle)).otherwise(0)

    outside, size = run("0-9A-Fa-f")
    long = (size >= 16) & outside.rlike("[0-9]")
    for kind in ("0-9A-Za-z+/", "0-9A-Za-z_-"):
        outside, size = run(kind)
        marks = F.length(F.regexp_replace(F.concat(outside, needle), "[0-9A-Za-z]", ""))
        long |= (size >= 20) & outside.rlike("[0-9]") & outside.rlike("[A-Za-z]") & (marks * 8 < size)
    return digits | long | (out.isNull())


#: Needles of fewer characters count only where they are no part of a longer run.
SHORT_WORD = 8


def leak_scan(texts: DataFrame, key: str, col: str, words: DataFrame, word_key: str, word: str, digests: DataFrame, digest_key: str, digest: str, keep: Keep) -> DataFrame:
    """``(key, kind, id, form, at)``: every place of a sensitive word (plain, UTF-16LE, JSON-escaped) or digest (either case).

    Ids of words and digests are given as text.
    """
    both = words.select(F.lit("word").alias("kind"), F.col(word_key).cast("string").alias("id"), F.col(word).alias("w"))
    hexes = digests.select(F.lit("digest").alias("kind"), F.col(digest_key).cast("string").alias("id"), F.explode(F.array_distinct(F.array(F.lower(digest), F.upper(digest)))).alias("w"))
    asked = both.unionByName(hexes).select(F.struct("kind", "id", F.when((F.col("kind") == "word") & (F.length("w") < SHORT_WORD), F.col("w")).alias("short")).alias("who"), "w")
    found = sweep(texts, key, col, asked, "who", "w", keep, ("plain", "utf16", "json"), AROUND)
    # in UTF-16, what stands around a word has a zero after each character too
    bare = lambda c: F.when(F.col("form") == "utf16", F.translate(c, "\0", "")).otherwise(F.col(c))
    whole = F.col("who.short").isNull() | ~in_longer_run(bare("before"), F.col("who.short"), bare("behind"))
    return found.where(whole).select(key, "who.kind", "who.id", "form", "at")
