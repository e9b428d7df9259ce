"""Benchmark decontamination by a distributed positional inverted index (DataFrame functions only).

The index holds a posting, document and position, for each training word that a test item uses, and one for each document's
end, which is its length. Postings stay where their text was read and are written once. A question is an equality join: a
term at position ``q`` of an item, found at ``p``, says that the item may lie at offset ``p - q``. Of every window of
an item the rarest term is looked up first; offsets at which the second rarest of the same window is not found go; what is
left is intersected with the lists of all terms, and runs of enough consecutive positions are exact matches.

Proximity: all words of an item, in any order, within a number of words; starts at postings of its terms, in blocks of that many
positions, of documents that have its rarest term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import drop, keep

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Terms, documents or offsets that are sent to all tasks: at most so many numbers, or so many bytes of words. Past it the join is a shuffle.
MOST_NUMBERS, MOST_BYTES = 1 << 20, 32 << 20
_END = -1
_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
#: ASCII letters and digits, and all characters beyond ASCII.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: Column) -> Column:
    """Words of a text as they stand; none of null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0)), F.array().cast("array<string>"))


def lowered(word: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _sent(df: DataFrame) -> DataFrame:
    """A table of numbers, broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() * len(df.columns) <= MOST_NUMBERS else df


@dataclass
class PhraseIndex:
    """``asked (item, item_id, q, term, n)``: words of the items; ``postings (row, term, pos, doc_id)``: where documents have them.

    ``row`` is a number for each document row; the posting of the end of a document, the only one with its id, has the term -1.
    """

    asked: DataFrame
    postings: DataFrame

    def drop(self) -> None:
        drop(self.asked, self.postings)


def build(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> PhraseIndex:
    """Index ``docs`` for the words of ``items``."""
    item = items.select(F.col(item_col).cast("string").alias("item_id"), F.monotonically_increasing_id().alias("item"), split_words(F.col(item_text)).alias("words"))
    item = keep(item.select("item", "item_id", F.size("words").cast("long").alias("n"), F.posexplode("words").alias("q", "word")).withColumn("word", lowered(F.col("word"))), "items")
    terms = keep(item.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")
    asked = keep(item.join(terms, "word").select("item", "item_id", F.col("q").cast("long").alias("q"), "term", "n"), "asked")
    n, size = terms.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    ends = terms.unionByName(docs.sparkSession.createDataFrame([("", _END)], "word string, term long"))  # no word is empty
    if n <= MOST_NUMBERS and (size or 0) <= MOST_BYTES:
        ends = F.broadcast(ends)
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    placed = numbered.select("doc_id", "row", F.posexplode(F.concat(split_words(F.col("text")), F.array(F.lit("")))).alias("pos", "word"))
    found = placed.withColumn("word", lowered(F.col("word"))).join(ends, "word")
    postings = keep(found.select("row", "term", "pos", F.when(F.col("term") == _END, F.col("doc_id")).alias("doc_id")), "postings")
    drop(item, terms)
    return PhraseIndex(asked, postings)


def _offsets(index: PhraseIndex, anchors: DataFrame) -> DataFrame:
    """``(row, item, at, rarest)``: where the item's first word would be, maybe before the document's, for each posting of an anchor ``(item, q, term, rarest)``."""
    return index.postings.join(_sent(anchors), "term").select("row", "item", (F.col("pos") - F.col("q")).alias("at"), "rarest")


def _narrowed(wide: DataFrame, by: DataFrame, on: list[str]) -> DataFrame:
    return wide.join(_sent(by), on, "left_semi")


def phrases(index: PhraseIndex, window: int = WINDOW) -> DataFrame:
    """``(row, item, item_id, first, last)``: maximal runs of a document's words in which every ``window`` words are a window of the item."""
    asked = index.asked.withColumn("size", F.least("n", F.lit(window)))
    often = index.postings.where(F.col("term") != _END).groupBy("term").agg(F.count("*").alias("df"))
    rated = asked.join(often, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # each word votes in all windows over it, so no item is gathered whole
    start = F.explode(F.sequence(F.greatest(F.col("q") - F.col("size") + 1, F.lit(0)), F.least("q", F.col("n") - F.col("size"))))
    windows = rated.withColumn("s", start).groupBy("item", "s").agg(F.array_sort(F.collect_list(F.struct("df", "q", "term"))).alias("rare")).where("rare[0].df > 0")
    two = F.get("rare", F.least(F.lit(1), F.size("rare") - 1))  # a window of one word: that word again
    windows = keep(windows.select("item", F.col("rare")[0].alias("one"), two.alias("two")), "windows")
    first = keep(_offsets(index, windows.select("item", "one.q", "one.term", F.col("one.q").alias("rarest")).distinct()), "first")
    second = _offsets(index, windows.select("item", "two.q", "two.term", F.col("one.q").alias("rarest")).distinct())
    both = keep(_narrowed(second, first, ["row", "item", "at", "rarest"]).select("row", "item", "at").distinct(), "both")
    need = both.join(asked, "item").select("row", (F.col("at") + F.col("q")).alias("pos"), "term", "item", "item_id", "at", "q", "size")
    near = _narrowed(index.postings, both.select("row").distinct(), ["row"]).select("row", "pos", "term")
    met = need.join(near, ["row", "pos", "term"])
    run = F.col("q") - F.row_number().over(Window.partitionBy("row", "item", "at").orderBy("q"))  # an item's words at the most
    runs = met.withColumn("run", run).groupBy("row", "item", "at", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("size").alias("size"), F.first("item_id").alias("item_id"))
    out = keep(runs.where(F.col("last") - F.col("first") + 1 >= F.col("size")).select("row", "item", "item_id", "first", "last"), "spans")
    drop(windows, first, both)
    return out


def proximity(index: PhraseIndex, within: int) -> DataFrame:
    """``(row, item, item_id, first, last)``: least spans of at most ``within`` words that hold every word of an item, in any order."""
    terms = index.asked.select("item", "item_id", "term").distinct()
    often = index.postings.where(F.col("term") != _END).groupBy("term").agg(F.count("*").alias("df"))
    rated = terms.join(often, "term", "left").groupBy("item", "item_id").agg(F.count("*").alias("k"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("rare"))
    rated = keep(rated.where("rare.df > 0").select("item", "item_id", "k", F.col("rare.term").alias("term")), "rare")
    block = F.floor(F.col("pos") / within)
    # a span that has the rarest term begins in that posting's block or the one before
    hot = index.postings.join(_sent(rated.select("item", "term")), "term").select("row", "item", F.explode(F.array(block, block - 1)).alias("block")).distinct()
    hot = keep(hot, "hot")
    filed = index.postings.join(_sent(terms.join(rated.select("item"), "item", "left_semi").select("item", "term")), "term")
    filed = filed.select("row", "item", "term", F.col("pos").cast("long").alias("pos"), F.explode(F.array(block, block - 1)).alias("block")).join(hot, ["row", "item", "block"], "left_semi")
    ahead = Window.partitionBy("row", "item", "block").orderBy("pos").rangeBetween(0, within - 1)  # two blocks at the most
    seen = filed.withColumn("seen", F.collect_list(F.struct("pos", "term")).over(ahead)).where(F.col("block") == block)
    kinds = F.array_distinct(F.transform("seen", lambda x: x["term"]))
    full = seen.withColumn("kinds", kinds).join(rated.select("item", "item_id", "k"), "item").where(F.size("kinds") == F.col("k"))
    last = F.array_max(F.transform("kinds", lambda t: F.filter("seen", lambda x: x["term"] == t)[0]["pos"]))
    spans = full.select("row", "item", "item_id", F.col("pos").alias("first"), last.alias("last"))
    out = keep(spans.groupBy("row", "item", "item_id", "last").agg(F.max("first").alias("first")).select("row", "item", "item_id", "first", "last"), "spans")
    drop(rated, hot)
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in a run of words that is ``window`` consecutive words of an item, or the whole of a shorter item. Null and empty texts have no
    words and are clean; items without a word are nowhere. ``n_items`` counts different item ids; rows that repeat an item's id count as one, and those with
    a null id hit words but are not listed. Texts of any length are read whole; repeated rows stay repeated; an empty table gives an empty
    result, no items leave all clean. Other columns are ignored, whatever their names.
    """
    index = build(docs, items, id_col, text_col, item_col, item_text)
    spans = phrases(index, window)
    hit = spans.select("row", "item_id", F.explode(F.sequence("first", "last")).alias("pos"))
    hit = keep(hit.groupBy("row").agg(F.countDistinct("pos").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("ids")), "hit")
    lengths = index.postings.where(F.col("term") == _END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    out = lengths.join(hit, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
    out = keep(out, "clean")
    drop(spans, hit)
    index.drop()
    return out
