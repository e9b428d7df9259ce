"""The registered query of each operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import ann_additive, language_gru, quality_knn, url_labels
from casewright.llm.bpe import encode
from casewright.llm.common import table
from casewright.llm.exact_dedup import exact_dedup
from casewright.llm.line_dedup import line_dedup
from casewright.llm.packing import pack_documents
from casewright.llm.phrase_index import decontaminate
from casewright.llm.resampling import resample
from casewright.llm.simhash import simhash
from casewright.llm.spelling import spelling_groups, words
from casewright.llm.suffix_dedup import suffix_dedup
from casewright.llm.url_filter import url_filter


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.train(docs, table(spark, sf_dir, "labels")))


def op2_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_gru.identify(docs, language_gru.train(docs))


def op3_pack_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), url_labels.labelled(spark), list(url_labels.RULES))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_ann_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_additive.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(words(table(spark, sf_dir, "documents"), slip=97))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_knn": op1_quality_knn,
    "op2_language_gru": op2_language_gru,
    "op3_pack_cost": op3_pack_cost,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_ann_additive": op10_ann_additive,
    "op11_decontaminate": op11_decontaminate,
    "op12_spelling": op12_spelling,
    "op13_resample": op13_resample,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_decontaminate": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest([list_slice(w, i, i + least(10, len(w)) - 1) for i in range(1, len(w) - least(10, len(w)) + 2)]) AS gram FROM b WHERE len(w) > 0),
        s AS (SELECT DISTINCT n FROM g),
        p AS (SELECT row, n, unnest(range(1, len(w) - n + 2)) AS o, unnest([list_slice(w, i, i + n - 1) for i in range(1, len(w) - n + 2)]) AS gram FROM d, s WHERE len(w) >= n),
        m AS (SELECT p.row, p.o, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram),
        h AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(o, o + n)) AS k FROM m) GROUP BY row),
        i AS (SELECT row, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS v FROM (SELECT DISTINCT row, item_id::VARCHAR AS v FROM m WHERE item_id IS NOT NULL) GROUP BY row)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(v, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN h USING (row) LEFT JOIN i USING (row)""",
}
