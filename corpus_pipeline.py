"""The corpus pipeline: language, lines, near-duplicates, repeated strings, packing.

Every stage takes all rows that the one before kept and returns the columns of ``documents``; the
last returns the packed pieces. ``ORACLE_SQL`` is None: no stage but the first's filter can be said in SQL,
so tests hold each against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import language_gru
from casewright.llm.common import keep
from casewright.llm.line_dedup import line_dedup
from casewright.llm.packing import pack_documents
from casewright.llm.simhash import simhash
from casewright.llm.suffix_dedup import suffix_dedup

#: A document goes if it has no letter, or if no language is at least this likely.
LEAST_LANGUAGE_SCORE = 0.35


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: a letter in the text, and a language likely enough.

    Null and empty texts, and texts without a letter, go. Where no document has a language to learn from, all others stay. Repeated rows
    are judged alike; very long texts are read whole; an empty table stays empty; other columns, whatever their names, are carried.
    """
    rest = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("own"), "text")
    names, model = language_gru.train(docs)
    named = language_gru.identify(own, (names, model), keep_columns=True)
    bare = (F.col("lang_pred") == language_gru.UNKNOWN) & (F.col("score") == 1)  # no letter
    doubtful = F.lit(bool(names)) & (F.col("score") < LEAST_LANGUAGE_SCORE)
    return named.where(~bare & ~doubtful).select(*(F.col(c) if c == "text" else F.col(f"own.`{c}`") for c in docs.columns))


def line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier one.

    Null texts stay null and empty ones empty; rows that repeat id and text lose the same lines; an empty
    table stays empty; other columns, whatever their names, are carried.
    """
    return _counted(line_dedup(docs, keep_columns=True))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Texts without a word, null ones too, have one fingerprint, so one of them stays; rows that repeat the id that stays, stay. Rows
    with a null id stay. An empty table stays empty; other columns, whatever their names, are carried.
    """
    groups = simhash(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that also start anywhere else.

    Null texts stay null; of repeated rows each is a text of its own, so what they share goes from all. An empty table stays
    empty; other columns, whatever their names, are carried.
    """
    return _counted(suffix_dedup(docs, keep_columns=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences.

    Null and empty texts are one token; repeated rows are packed each; very long texts are cut; an empty table has no piece; other
    columns are ignored.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", line),
    ("near_duplicates", near),
    ("substrings", substring),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what one returns is written and read again. An empty table gives no piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
