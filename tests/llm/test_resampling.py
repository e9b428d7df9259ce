"""Importance resampling against features spelled out one by one."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import resampling as R

RNG = random.Random(13)
SCHEMA = "doc_id long, text string, n_words string, planes string, total int, rank string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def features(t, grams=3):
    w = words(t)
    return [" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]


def slow_buckets(t, buckets=10000):
    return Counter(zlib.crc32(x.encode()) % buckets for x in features(t))


def some(n):
    return " ".join(RNG.choice(["Alpha", "the", "É", "ÉÀ", "x1", "漢字", "of", "b", "w" * 60]) for _ in range(n))


TEXTS = [None, "", " .", "a", "A-b_c", "é1 z " * 50, "x" * 100 + " y " + "z" * 49 + " q", "q " + "w" * 48 + " e", "word " * 5000, "\x00a\x7fb"] + [some(RNG.randrange(60)) for _ in range(90)]
ROWS = [(i, t, "n", "p", 1, "r") for i, t in enumerate(TEXTS)] + [(20, TEXTS[20], "n", "p", 1, "r"), (None, some(25), "n", "p", 1, "r")]


@pytest.mark.parametrize("piece", [30, 4 << 20])
def test_counts(monkeypatch, piece):
    """Long texts are read in pieces that give the same counts."""
    monkeypatch.setattr(R, "_PIECE", piece)
    texts = TEXTS + ["".join(RNG.choice("ab Cé\n漢9.") for _ in range(RNG.randrange(200))) for _ in range(200)]
    n, got = R.counts([(t or "").encode() for t in texts])
    for i, t in enumerate(texts):
        assert n[i] == len(words(t))
        assert {b: c for b, c in enumerate(got[i].tolist()) if c} == slow_buckets(t)


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(3)
    count, gain = rng.integers(0, 1 << 20, (7, 300)), rng.integers(-20000, 20000, 300)
    count[0] = 0
    cut = lambda x: [np.frombuffer(p, np.uint64).reshape(-1, 5) for p in R.planes(x)]
    up, down = cut(np.maximum(gain, 0)[None])[0], cut(np.maximum(-gain, 0)[None])[0]
    assert [R.bit_sliced_sum(c, up) - R.bit_sliced_sum(c, down) for c in cut(count)] == (count * gain).sum(axis=1).tolist()


def slow(rows, target, percent=5, least=20):
    own, aim = Counter(), Counter()
    for r in rows:
        own.update(slow_buckets(r[1]))
    for t in target:
        aim.update(slow_buckets(t))
    s, t = sum(own.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in range(10000)}
    out = []
    for r in rows:
        weight = sum(gain[b] * n for b, n in slow_buckets(r[1]).items())
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(features(r[1])), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(r[1]))])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


@pytest.mark.parametrize("percent", [5, 60, 100, 0])
def test_resample(spark, percent):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    target = ["Alpha the of", "É 漢字 x1", None, ""]
    got = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(ROWS, target, percent)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame(ROWS[:40], SCHEMA)
    assert R.resample(none, docs).count() == 0
    assert sorted((tuple(r) for r in R.resample(docs, none).collect()), key=str) == slow(ROWS[:40], [])


def test_ranks_over_many_partitions(spark):
    """Rows that tie in score, and rows that repeat the id too, have ranks without a gap."""
    rows = spark.range(5000).select((F.col("id") % 40).alias("doc_id"), (F.col("id") % 7).alias("score"))
    got = R.ranked(rows.repartition(9), [F.desc("score"), F.asc_nulls_first("doc_id")], 3000).collect()
    assert len(got) == 5000
    top = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in top] == list(range(1, 3001))
    order = [(-r.score, r.doc_id) for r in top]
    assert order == sorted(order) and max(order) <= min((-r.score, r.doc_id) for r in got if not r["rank"])
