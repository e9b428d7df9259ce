"""The positional index against windows compared one by one."""

from __future__ import annotations

import hashlib
import random
import re
from pathlib import Path

import pytest

from casewright.llm import phrase_index as P

RNG = random.Random(11)
VOCABULARY = ["the", "of", "Ab", "É", "é", "x1", "漢字", "rare", "tail", "ÀB"]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow(docs, items, window):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(window, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def some(n, choice=VOCABULARY):
    return RNG.choice([" ", ", ", "\n"]).join(RNG.choice(choice) for _ in range(n))


ITEMS = [(i, some(RNG.randrange(0, 30))) for i in range(12)] + [(3, "the of"), (20, "rare"), (21, None), (22, ""), (None, "tail tail tail tail"), (23, "nowhere at all"), (24, "the " * 14), (100, "É é")]
DOCS = [(i, some(RNG.randrange(40)) + RNG.choice(["", " " + (RNG.choice(ITEMS)[1] or "")]) + RNG.choice([".", " x", " the"])) for i in range(60)]
DOCS += [(70, None), (71, ""), (72, "\x00 .. _"), (None, ITEMS[4][1]), (5, DOCS[5][1]), (5, DOCS[5][1]), (73, some(4000)), (74, "the " * 3000), (75, "THE OF"), (76, "é É")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "w") for r in DOCS], "doc_id long, text string, pos int, row int, term string").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, 1, "w") for r in ITEMS], "item_id long, text string, item int, word string").repartition(2)


@pytest.mark.parametrize("window", [10, 3, 1])
def test_decontaminate(docs, items, window):
    got = P.decontaminate(docs, items, window)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(DOCS, ITEMS, window)


def test_nothing_to_broadcast(monkeypatch, docs, items):
    """Tables past the bound are joined by shuffles, with the same result."""
    monkeypatch.setattr(P, "MOST_NUMBERS", 0)
    assert sorted((tuple(r) for r in P.decontaminate(docs, items, 4).collect()), key=str) == slow(DOCS, ITEMS, 4)


def test_empty_tables(docs, items):
    assert P.decontaminate(docs.limit(0), items).count() == 0
    assert {r.contaminated for r in P.decontaminate(docs, items.limit(0)).collect()} == {False}


@pytest.mark.parametrize("within", [1, 3, 8])
def test_proximity(spark, docs, within):
    items = [(1, "rare tail"), (2, "É"), (3, "x1 漢字 ab"), (4, "nowhere rare"), (5, "rare rare the"), (6, "")]
    index = P.build(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.item_id, r.first, r.last, n) for r, n in [(r, r.row) for r in P.proximity(index, within).collect()])
    rows = {r.row: (r.doc_id, r.pos) for r in index.postings.where("term = -1").collect()}
    want = []
    for i, t in {(i, t) for i, t in DOCS if i is not None and i != 5}:
        w = words(t)
        for item, text in items:
            need = set(words(text))
            spans = set()
            for a in range(len(w)):
                for b in range(a, min(len(w), a + within)):
                    if need and need <= set(w[a : b + 1]):
                        spans.add((a, b))
                        break
            want += [(str(item), a, b, i) for a, b in spans if not any((a, b) != s and a <= s[0] and s[1] <= b for s in spans)]
    made = sorted((item, a, b, rows[n][0]) for item, a, b, n in got if rows[n][0] not in (None, 5))
    assert made == sorted(want) and (made or within == 1)


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    pytest.importorskip("public_tokenizers")
    from casewright.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(ORACLE_SQL["op11_decontaminate"])
    names = [c[0] for c in want.description]
    got = QUERIES["op11_decontaminate"](spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and any(r.n_items for r in got)
