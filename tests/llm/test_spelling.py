"""Spelling variants against all pairs of a small vocabulary."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from casewright.llm import spelling as S

RNG = random.Random(12)


def variants(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return out - {w}


def slow_near(vocabulary):
    letters = set("".join(vocabulary))
    return {w: variants(w, letters) & set(vocabulary) for w in vocabulary}


def slow_groups(vocabulary, ratio=2):
    out, form = [], {}
    near = slow_near(vocabulary)
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best is not None and vocabulary[best] >= ratio * n else None
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocabulary.get(form[w])))
    return sorted(out, key=str)


def some(n, letters, sizes):
    out = {}
    while len(out) < n:
        w = "".join(RNG.choice(letters) for _ in range(RNG.choice(sizes)))
        out[w] = RNG.choice([3, 4, 6, 12, 24, 50, 500])
    return out


VOCABULARIES = [some(300, "ab", range(5, 9)), some(500, "abcé", range(5, 12)), {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "baaaaaaaa": 48, "漢字漢字漢": 3, "漢字漢字": 9, "漢漢字漢字漢": 7}, {"a" * 3000: 3, "a" * 2999 + "b": 9, "a" * 3001: 4, "onlyone": 5}]


@pytest.mark.parametrize("k", range(len(VOCABULARIES)))
def test_index_finds_one_error_outside_the_exact_part(k):
    vocabulary = sorted(VOCABULARIES[k])
    flat = lambda ws: (np.array([ord(c) for w in ws for c in w]), np.array([len(w) for w in ws]))
    index = S.Index(*flat(vocabulary))
    asked = [w for w in vocabulary if len(w) < 100][:80] or vocabulary
    letters = set("".join(vocabulary))
    for cut in (2, 1):
        exact = np.array([len(w) // cut if cut == 2 else 0 for w in asked])
        q, w = index.one_off(*flat(asked), exact)
        got = {(asked[a], vocabulary[b]) for a, b in zip(q.tolist(), w.tolist())}
        assert len(got) == len(q)
        want = {(u, v) for u in asked for v in vocabulary if len(u) < 100 and v in variants(u, letters) and len(v) >= len(u)}
        keep = {(u, v) for u, v in want if any(v == x + u[len(u) - e :] for e in [len(u) // 2 if cut == 2 else 0] for x in [v[: len(v) - e]])}
        assert len(asked[0]) > 100 or got == keep


@pytest.mark.parametrize("block,most", [(1 << 20, 1 << 14), (200, 7), (3000, 40)])
@pytest.mark.parametrize("k", range(len(VOCABULARIES)))
def test_near_words(spark, k, block, most):
    """Every pair once each way, whatever the size of blocks and slices."""
    vocabulary = {w: n for w, n in VOCABULARIES[k].items() if len(w) >= 5}
    got = S.near_words(spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3), block=block, most=most).collect()
    letters = set("".join(vocabulary))
    want = {(w, v) for w, near in slow_near(vocabulary).items() for v in near} if k < 3 else {(u, v) for u in vocabulary for v in vocabulary if min(len(u), len(v)) > 9 and u != v and (u, v) != ("a" * 3001, "a" * 2999 + "b") and (v, u) != ("a" * 3001, "a" * 2999 + "b")}
    assert letters and sorted((r.word, r.near) for r in got) == sorted(want)
    assert all(r.near_n == vocabulary[r.near] for r in got)


def slow_words(rows, slip):
    got = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            got[run] += 1
    return {w: n for w, n in got.items() if len(w) >= 5 and n >= 3}


STEMS = ["Letter", "lettre", "letters", "ÉCOLES", "Écolesx", "aaaaab", "short", "sheet", "abc", "naïve"]
ROWS = [(i, " ".join(RNG.choice(STEMS) + RNG.choice(["", "", "", "s", "e", "xyz"]) for _ in range(RNG.randrange(80))) + RNG.choice([".", "9", "_end"])) for i in range(80)]
ROWS += [(90, None), (91, ""), (92, "... 12"), (None, "Letter lettre letters"), (3, ROWS[3][1]), (93, "Longword" * 400 + " " + "Longword" * 400 + " " + "Longword" * 400), (94, "Ünï " * 3000)]


@pytest.mark.parametrize("slip", [None, 97, 5])
def test_words_and_groups(spark, slip):
    docs = spark.createDataFrame([(*r, "w", 1) for r in ROWS], "doc_id long, text string, word string, n int").repartition(3)
    want = slow_words(ROWS, slip)
    got = S.words(docs, slip=slip)
    assert {r.word: r.n for r in got.collect()} == want and got.columns == ["word", "n"]
    made = S.spelling_groups(got)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in made.collect()), key=str) == slow_groups(want)


def test_chains_ties_and_odd_vocabularies(spark):
    """Chains run to their end, of equal counts the first word wins, repeated words are summed, short and null ones left out."""
    chain = {"a" * 5 + "b" * k: 3 * 2**k for k in range(12)}
    tie = {"ttttt": 3, "ttttx": 6, "tttta": 6, "uuuuu": 4, "uuuuv": 7}
    rows = [*chain.items(), *tie.items(), ("tttta", 0), (None, 4), ("ab", 9), ("", 9)]
    got = S.spelling_groups(spark.createDataFrame(rows, "word string, n long")).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_groups(chain | tie)
    assert {r.root for r in got if r.word.startswith("aaaaa")} == {"aaaaa" + "b" * 11}
    assert S.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        S.spelling_groups(spark.createDataFrame(rows, "word string, n long"), ratio=1)
