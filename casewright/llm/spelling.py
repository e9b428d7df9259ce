"""Spelling variants: words one edit apart, by search schemes over a bidirectional FM-index.

Two words one edit apart agree in one half of the shorter one, or in one half of either if they are
equally long: the error lies in the other half. So a word is filed under both halves, and under those that a word one
shorter would have, and words that share a half, by its place and the length of the word asked for, meet in
one block. In a block the words are written one after the other, each ended by a delimiter, and
the Burrows-Wheeler transform of that text is taken. A query starts at the delimiters,
matches its half exactly by backward extension of an interval of suffix ranks, then extends across the other half, where one
step may replace or insert a symbol, and ends with a delimiter. The index of the words as they stand extends to the left, that of the
words reversed to the right; the scheme needs each direction in blocks of its own.

All queries of a block take each step together, as arrays of intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import drop, keep
from casewright.llm.suffix_dedup import suffix_order

#: Runs of letters: ASCII ones, and Latin-1 from its first accented capital on.
RUNS = "[A-Za-zÀ-ÿ]"
LEAST, TIMES, RATIO = 5, 3, 2
#: Symbols of a block's text, words of one half that one block takes (a half with more is cut in slices), and queries that take their steps together.
BLOCK, HALF, TOGETHER = 1 << 20, 1 << 14, 1 << 13
_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))


def words(docs: DataFrame, least: int = LEAST, times: int = TIMES, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: distinct runs of letters, A-Z lower-cased, of at least ``least`` code points that occur ``times`` times or more.

    With ``slip``, a run loses a code point where the crc32 of its document's id (null: none), a colon and the run is a
    multiple of ``slip``; which one, says the crc32 modulo its length. Null texts have no words.
    """
    # a run that is too short stays so, so it need not be cut out
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUNS + f"{{{max(1, least)},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    if slip:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = F.col("h") % F.length("run")
        less = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
        runs = runs.select(F.when(F.col("h") % slip == 0, less).otherwise(F.col("run")).alias("run")).where(F.length("run") >= least)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= times)


class Index:
    """Backward search over distinct words, each followed by a delimiter."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        """``flat``: the code points of the words one after the other; ``size``: the length of each."""
        self.alphabet = np.unique(flat)
        n = len(size)
        ends = np.cumsum(size + 1) - 1
        sym = np.empty(len(flat) + n, np.int64)
        inside = np.ones(len(sym), bool)
        inside[ends] = False
        sym[inside] = np.searchsorted(self.alphabet, flat) + n
        sym[ends] = np.arange(n)  # delimiters differ, so no two suffixes are equal
        top = int(sym.max())
        sa, _ = suffix_order(np.concatenate([sym, np.full(62, top + 1), [top + 2]]), int(size.max(initial=0)) + 2)
        sa = sa[:-63].astype(np.int64)  # larger symbols, put at the end since the sort packs up to 62 together, sort last
        self.n, self.words = len(sym), n
        before = sym[sa - 1]
        self.before = np.where((sa == 0) | (before < n), 0, before - n + 1)  # the transform; 0 is the delimiter
        order = np.argsort(self.before, kind="stable")
        self.ranks = self.before[order] * np.int64(self.n) + order
        whole = order[: np.count_nonzero(self.before == 0)]
        self.word_of = np.searchsorted(ends, sa[whole])  # of rows that begin a word

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each string with symbol ``c`` put before it."""
        at = c * np.int64(self.n)
        return np.searchsorted(self.ranks, at + lo), np.searchsorted(self.ranks, at + hi)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(interval, symbol, lo, hi)`` of every symbol but the delimiter that stands before an interval's suffixes."""
        size, sigma = hi - lo, len(self.alphabet)
        few = np.flatnonzero(size <= sigma)
        many = np.flatnonzero(size > sigma)
        rep = np.repeat(few, size[few])
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
        seen = np.unique(rep * (sigma + 1) + self.before[lo[rep] + nth])
        of, c = np.divmod(seen, sigma + 1)
        of, c = np.concatenate([of, np.repeat(many, sigma)]), np.concatenate([c, np.tile(np.arange(1, sigma + 1), len(many))])
        of, c = of[c > 0], c[c > 0]
        a, b = self.step(c, lo[of], hi[of])
        ok = b > a
        return of[ok], c[ok], a[ok], b[ok]

    def one_off(self, flat: np.ndarray, size: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, word)``: words that come from a query by one replaced or inserted symbol, none of it in the query's last ``exact`` ones."""
        ends, n = np.cumsum(size), len(size)
        code = np.searchsorted(self.alphabet, flat)
        code = np.where(self.alphabet[np.minimum(code, len(self.alphabet) - 1)] == flat, code + 1, -1)
        char = lambda q, t: code[ends[q] - 1 - t]  # noqa: E731  the t-th symbol from the right
        q, lo, hi = np.arange(n), np.zeros(n, np.int64), np.full(n, self.words, np.int64)
        one = tuple(np.zeros(0, np.int64) for _ in range(3))  # the states that have had their error
        found: list[np.ndarray] = []
        for t in range(int(size.max(initial=0)) + 1):
            late = exact[q] <= t
            of, c, a, b = self.branches(lo[late], hi[late])
            asks = q[late][of]
            inserted = (asks, a, b)
            here = t < size[asks]
            other = np.zeros(len(asks), bool)
            other[here] = c[here] != char(asks[here], t)
            replaced = asks[other], a[other], b[other]
            one = tuple(np.concatenate(x) for x in zip(one, inserted))
            done = size[one[0]] == t
            a, b = self.step(np.zeros(done.sum(), np.int64), one[1][done], one[2][done])
            found.append(np.stack([one[0][done], np.where(b > a, a, -1)]))
            one = self._follow(*(x[~done] for x in one), char, t)
            one = tuple(np.concatenate(x) for x in zip(one, replaced))
            on = size[q] > t
            q, lo, hi = self._follow(q[on], lo[on], hi[on], char, t)
            if not len(q) and not len(one[0]):
                break
        asks, at = np.concatenate(found, axis=1)
        asks, at = asks[at >= 0], self.word_of[at[at >= 0]]
        return np.divmod(np.unique(asks * np.int64(self.words) + at), np.int64(max(1, self.words)))

    def _follow(self, q, lo, hi, char, t):
        c = char(q, t)
        ok = c > 0
        q, (a, b) = q[ok], self.step(c[ok], lo[ok], hi[ok])
        ok = b > a
        return q[ok], a[ok], b[ok]


def _flat(words_: pa.Array, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points one after the other, and the length of each word; ``backwards`` turns each word round."""
    size = pc.utf8_length(words_).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.frombuffer("".join(words_.to_pylist()).encode("utf-32-le"), np.uint32)
    if backwards:
        start = np.cumsum(size) - size
        flat = flat[np.repeat(2 * start + size - 1, size) - np.arange(len(flat))]
    return flat, size


def _pairs(index: Index, named: pa.Array, asked: pa.Array, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(asked, named)`` places of near words; those that agree in the first half are left to the blocks of first halves."""
    flat, size = _flat(asked, backwards)
    half = size // 2
    out = []
    cuts = [*range(0, len(size), TOGETHER), len(size)]
    starts = np.append(0, np.cumsum(size))
    for a, b in zip(cuts, cuts[1:]):
        q, w = index.one_off(flat[starts[a] : starts[b]], size[a:b], (half if backwards else size - half)[a:b])
        out.append((q + a, w))
    q, w = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    if not backwards and len(q):
        left, right = asked.take(pa.array(q)).to_pylist(), named.take(pa.array(w)).to_pylist()
        new = np.array([not v.startswith(u[: len(u) // 2]) for u, v in zip(left, right)])
        q, w = q[new], w[new]
    return q, w


class _Block:
    """Words of a task, read key by key, until their text is a block's."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.rows: list[pa.RecordBatch] = []
        self.index: Index | None = None
        self.size, self.side, self.alone = 0, False, False

    def _near(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.index is None:
            held = pa.Table.from_batches(self.rows).filter(pc.field("listed")).combine_chunks()
            column = held.column("word").combine_chunks() if held.num_rows else pa.array([], pa.string())
            code = column.dictionary_encode()
            self.named = code.dictionary
            first = np.full(len(self.named), 0, np.int64)
            first[code.indices.to_numpy(zero_copy_only=False)[::-1]] = np.arange(len(code))[::-1]
            self.n = held.column("n").combine_chunks().take(pa.array(first)) if held.num_rows else pa.array([], pa.int64())
            if len(self.named):
                self.index = Index(*_flat(self.named, self.side))
        if self.index is None or not asked.num_rows:
            return
        word, n = asked.column("word"), asked.column("n")
        q, w = _pairs(self.index, self.named, word, self.side)
        q, w = pa.array(q), pa.array(w)
        left, right, ln, rn = word.take(q), self.named.take(w), n.take(q), self.n.take(w)
        yield pa.RecordBatch.from_arrays([left, right, rn], names=["word", "near", "near_n"])
        longer = pc.not_equal(pc.utf8_length(left), pc.utf8_length(right))  # equally long ones ask for each other
        yield pa.RecordBatch.from_arrays([right.filter(longer), left.filter(longer), ln.filter(longer)], names=["word", "near", "near_n"])

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            held = pa.Table.from_batches(self.rows)
            for b in held.filter(pc.field("asks")).combine_chunks().to_batches():
                yield from self._near(b)
        self.clear()

    def add(self, b: pa.RecordBatch, side: bool, alone: bool) -> Iterator[pa.RecordBatch]:
        """Rows of whole keys, of which the last may go on; in a key, words that only ask come last. A slice is a block of its own."""
        if self.rows and (side != self.side or self.size >= self.most or self.index or alone or self.alone):
            yield from self.close()
        self.side, self.alone = side, alone
        self.rows.append(b)
        self.size += pc.sum(pc.utf8_length(b.column("word"))).as_py() + b.num_rows

    def more(self, b: pa.RecordBatch, side: bool) -> Iterator[pa.RecordBatch]:
        """Further rows of the last key. Those that only ask find all words of the key there, and are not held."""
        listed = b.filter(b.column("listed"))
        if listed.num_rows:
            self.rows.append(listed)
            self.size += pc.sum(pc.utf8_length(listed.column("word"))).as_py() + listed.num_rows
        rest = b.filter(pc.invert(b.column("listed")))
        if rest.num_rows:
            yield from self._near(rest)


def _filed(vocabulary: DataFrame, least: int) -> DataFrame:
    """``(first, m, half, word, n, asks, listed)``: each word under its halves, and under those that a word one shorter would have."""
    out = []
    for less in (0, 1):
        m = F.length("word") - less
        head = F.floor(m / 2).cast("int")
        for first, half in ((True, F.substring("word", F.lit(1), head)), (False, F.right(F.col("word"), m - head))):
            out.append(F.struct(F.lit(first).alias("first"), m.alias("m"), F.xxhash64(half, m, F.lit(first)).alias("half"), F.lit(less == 0).alias("asks"), F.lit(True).alias("listed")))
    rows = vocabulary.withColumn("f", F.explode(F.array(*out))).select("f.*", "word", "n")
    return rows.where((F.col("m") >= least) | F.col("asks"))


def near_words(vocabulary: DataFrame, least: int = LEAST, block: int = BLOCK, most: int = HALF) -> DataFrame:
    """``(word, near, near_n)``: all pairs of words exactly one insertion, deletion or replacement apart, each both ways.

    ``vocabulary (word, n)`` has distinct words, of ``least`` code points at least; it is read twice.
    """
    filed = _filed(vocabulary, least)
    large = filed.groupBy("half").agg(F.count("*").alias("size")).where(F.col("size") > most).select("half", F.ceil(F.col("size") / most).cast("int").alias("slices"))
    large = keep(large, "halves")
    # A half that very many words share: each slice of its words is a block of its own, which all its queries visit.
    filed = filed.join(large, "half", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")
    dealt = filed.withColumn("slice", F.explode(F.when((F.col("slices") > 1) & F.col("asks"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(own))))
    dealt = dealt.withColumn("listed", F.col("slice") == own).select("first", "half", "slice", "slices", "listed", "asks", "word", "n")
    size = vocabulary.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    tasks = max(1, -(-4 * size // block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = _Block(block), None
        for b in batches:
            side = b.column(0).to_numpy(zero_copy_only=False)
            half, cut = b.column(1).to_numpy(), b.column(2).to_numpy()
            alone = b.column(3).to_numpy() > 1
            edge = np.flatnonzero((half[1:] != half[:-1]) | (cut[1:] != cut[:-1]) | (side[1:] != side[:-1])) + 1
            # runs of whole keys that stay under a block go in together
            cuts = [0, *edge.tolist(), b.num_rows]
            lo = 0
            for k in range(1, len(cuts)):
                hi = cuts[k]
                key = (bool(side[cuts[k - 1]]), int(half[cuts[k - 1]]), int(cut[cuts[k - 1]]))
                if k == 1 and key == last:
                    yield from held.more(b.slice(0, hi), key[0])
                    lo = hi
                elif k == len(cuts) - 1 or hi - lo >= 4096 or bool(side[hi]) != key[0] or alone[lo] or alone[hi]:
                    yield from held.add(b.slice(lo, hi - lo), key[0], bool(alone[lo]))
                    lo = hi
                last = key
        yield from held.close()

    parted = dealt.repartition(tasks, "first", "half", "slice").sortWithinPartitions("first", "half", "slice", F.desc("listed"))
    return parted.mapInArrow(run, "word string, near string, near_n long")


def _settled(rows: DataFrame) -> DataFrame:
    """``root`` of each ``(word, form)``: the end of its chain of forms, by pointer doubling.

    A form occurs more often than its word, so chains have no cycle, and a round halves what is left of them.
    """
    rows = keep(rows.withColumn("root", F.coalesce("form", "word")), "roots")
    while True:
        up = rows.where("form is not null").select(F.col("word").alias("root"), F.col("root").alias("_up"))
        new = keep(rows.join(up, "root", "left").withColumns({"_old": F.col("root"), "root": F.coalesce("_up", "root")}).drop("_up"), "roots")
        drop(rows)
        rows = new.drop("_old")
        if new.where("_old <> root").isEmpty():
            return rows


def spelling_groups(vocabulary: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``vocabulary (word, n)``: ``word, form, root, n, n_near, form_n``.

    Near words are exactly one inserted, deleted or replaced code point apart. ``form`` is the near word with the largest n (ties: the
    first in code-point order), if it occurs at least ``ratio`` (over 1) times as often; ``root`` is where the chain of forms ends. Words under ``least``
    code points or null are left out, and of rows that repeat a word the counts are summed. An empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("forms must occur more often than the words that they replace, or chains could be circles")
    held = keep(vocabulary.where(F.length("word") >= least).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    near = near_words(held, least).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("top"))
    near = keep(near, "near")
    rows = held.join(near, "word", "left")
    often = -F.col("top.less") >= ratio * F.col("n")
    rows = rows.select("word", F.when(often, F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, -F.col("top.less")).alias("form_n"))
    out = _settled(rows)
    drop(held, near)
    return out.select("word", "form", "root", "n", "n_near", "form_n")
