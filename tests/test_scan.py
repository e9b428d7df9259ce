"""Windows over parts, and points in intervals by cells, against plain loops."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import intervals as I
from casewright.operators import scan as W
from casewright.sources.scratch import keep

RNG = random.Random(3)
#: One key has two thirds of all rows; a key may be null.
ROWS = [(RNG.choice(["hot"] * 6 + ["a", "b", None]), n, RNG.choice([None, RNG.randrange(9)])) for n in RNG.sample(range(5000), 900)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scan(spark, parts, descending):
    df = spark.createDataFrame(ROWS, "k string, n int, v int").repartition(3)
    rows = W.ranged(df, ["k"], ["n"], keep, descending, parts)
    assert parts == 1 or rows.where("k = 'hot'").select("_part").distinct().count() > parts // 3
    got = W.scan(rows, ["k"], ["n"], descending, previous={"before": F.col("v")}, last={"held": F.col("v")}, total={"sum": F.col("v")}, number="nth").collect()
    want, state = {}, {}
    for k, n, v in sorted(ROWS, key=lambda r: -r[1] if descending else r[1]):
        before, held, total, nth = state.get(k, (None, None, None, 0))
        now = v if v is not None else held
        total = total if v is None else (total or 0) + v
        state[k] = v, now, total, nth + 1
        want[n] = (before, now, total, nth + 1)
    assert {r.n: (r.before, r.held, r["sum"], r.nth) for r in got} == want and len(got) == len(ROWS)


@pytest.mark.parametrize("parts", [1, 9])
def test_islands_and_asof_over_parts(spark, parts):
    df = spark.createDataFrame([(k or "x", n) for k, n, _ in ROWS], "k string, n long").withColumn("ts", F.timestamp_seconds("n"))
    got = {(r.k, r.run): (r.start_us, r.end_us, r.n) for r in W.islands(df, ["k"], "ts", 12, keep, parts).collect()}
    want, seen = {}, {}
    for k, n in sorted((k or "x", n) for k, n, _ in ROWS):
        run, last = seen.get(k, (0, n))
        run += n - last > 12
        seen[k] = run, n
        a = want.setdefault((k, run), [n, n, 0])
        a[1], a[2] = n, a[2] + 1
    assert got == {k: (a * 1_000_000, b * 1_000_000, c) for k, (a, b, c) in want.items()}
    left, right = df.where("n % 3 = 0"), df.where("n % 3 <> 0 or n % 2 = 0").select("k", "ts", F.col("n").alias("v"))
    for direction in ("prev", "next"):
        near = {r.n: r.near_value for r in W.asof(left, right, ["k"], "ts", "v", keep, direction, parts).collect()}
        for k, n in {(k or "x", n) for k, n, _ in ROWS if n % 3 == 0}:
            others = [m for j, m, _ in ROWS if (j or "x") == k and (m % 3 or m % 2 == 0) and (m <= n if direction == "prev" else m >= n)]
            assert near[n] == (max(others) if direction == "prev" else min(others)) if others else near[n] is None


def test_chain_names_gap_break_and_altered_line(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    bodies = {r: [f"{r}-{i}" for i in range(1, 21)] for r in "abcd"}
    lines = [[r, i + 1, t, sha(b[i - 1]) if i else None, sha(t)] for r, b in bodies.items() for i, t in enumerate(b)]
    lines = [x for x in lines if (x[0], x[1]) != ("b", 7)]
    lines[4][2] += "!"  # a5
    next(x for x in lines if x[:2] == ["c", 9])[3] = "x"
    seals = spark.createDataFrame([("a", 18, sha("a-18")), ("b", 20, "y"), ("c", 25, "z")], "register string, seq int, digest string")
    df = spark.createDataFrame(lines, "r string, n int, t string, p string, h string").repartition(3)
    got = {x.r: tuple(x)[1:] for x in W.verify_chain(df, "r", "n", "t", "p", "h", seals, keep, 6).select("r", "rows", "first_gap", "first_break", "first_altered", "after_seal", "seal").collect()}
    assert got == {"a": (20, None, None, 5, 2, "kept"), "b": (19, 8, 8, None, 0, "broken"), "c": (20, None, 9, None, 0, "broken"), "d": (20, None, None, None, 0, "none")}


@pytest.mark.parametrize("kind", ["long", "double", "timestamp"])
@pytest.mark.parametrize("closed", [False, True])
def test_points_in_intervals(spark, kind, closed):
    rng = random.Random(9)
    spans = [(rng.choice("hhhk"), i, rng.choice([None, *[rng.randrange(-50, 1100)] * 9]), None) for i in range(250)]
    spans = [(k, i, f, None if rng.random() < 0.1 else (f or 0) + rng.choice([-5, 0, 1, 7, 60, 800])) for k, i, f, _ in spans]
    points = [(rng.choice("hhk"), i, rng.choice([None, *[rng.randrange(1000)] * 20])) for i in range(300)]
    p = spark.createDataFrame(points, "k string, p int, at long").withColumn("at", F.col("at").cast(kind))
    s = spark.createDataFrame(spans, "k string, s int, f long, t long").withColumns({"f": F.col("f").cast(kind), "t": F.col("t").cast(kind)})
    got = [(r.p, r.s) for r in I.interval_join(p, s, ["k"], "at", "f", "t", closed).collect()]
    inside = lambda x, f, t: x is not None and f is not None and f <= x and (t is None or x < t or (closed and x == t))
    want = {(i, j) for k, i, x in points for q, j, f, t in spans if k == q and inside(x, f, t)}
    assert len(got) == len(set(got)) and set(got) == want
    # few candidates that are not matches, whatever the length of the intervals
    assert I.candidates(p, s, ["k"], "at", "f", "t").count() <= len(want) + 2 * len(points)
    assert I.interval_join(p.limit(0), s, ["k"], "at", "f", "t").count() == I.interval_join(p, s.limit(0), ["k"], "at", "f", "t").count() == 0


def test_the_plan_has_no_range_condition_alone(spark, capsys):
    p, s = spark.range(1000).selectExpr("1 as k", "id as at"), spark.range(1000).selectExpr("1 as k", "id as f", "id + 3 as t")
    made = I.interval_join(p, s, ["k"], "at", "f", "t")
    assert made.count() == 2997 + 0 and I.candidates(p, s, ["k"], "at", "f", "t").count() < 3 * 2997
    made.explain("formatted")
    joins = [x for x in capsys.readouterr().out.splitlines() if x.startswith("Left keys")]
    assert joins and all("_level" in x and "_cell" in x for x in joins)


def test_keys_of_few_intervals_are_filed_in_no_cells(spark):
    """Many small keys, a busy one and a null one: a row a point and interval of a small key, not a row a size of cell."""
    s = spark.range(4000).selectExpr("if(id < 300, 0, if(id % 50 = 1, null, id div 10)) as k", "id as s", "(id * 37) % 1000 as f", "(id * 37) % 1000 + id % 60 as t")
    p = spark.range(4000).selectExpr("if(id < 300, 0, if(id % 50 = 2, null, id div 10)) as k", "id as p", "(id * 91) % 1000 as at")
    small_s, small_p = s.where("k > 0"), p.where("k > 0")
    plan = I.interval_join(small_p, small_s, ["k"], "at", "f", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "_cell" not in plan
    for a, b in ((p, s), (small_p, small_s)):
        got = sorted(tuple(r) for r in I.interval_join(a, b, ["k"], "at", "f", "t").select("p", "s").collect())
        assert got == sorted(tuple(r) for r in a.join(b, "k").where("at >= f and at < t").select("p", "s").collect()) and got


def test_filed_intervals_are_not_broadcast_by_their_estimate(spark, tmp_path):
    """Spark takes a filed side for as small as the file it is read from; 300,000 rows of cells are no broadcast."""
    path = str(tmp_path / "s")
    spark.range(20_000).selectExpr("id % 4 as k", "id as f", "id + 900 as t").coalesce(1).write.parquet(path)
    s = spark.read.parquet(path)
    made = I.interval_join(spark.range(20_000).selectExpr("id % 4 as k", "id as at"), s, ["k"], "at", "f", "t")
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
