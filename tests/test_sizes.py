"""Steps whose work or memory must not grow faster than the rows: results against brute force, and how the rows are dealt."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest

from casewright.operators import joins as J
from casewright.plans import all_queries
from casewright.sources.scratch import keep

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="no driver tables")


def test_shared_pairs(spark):
    """Jobs by the objects they share, long and short ones, against all pairs of jobs."""
    rng = random.Random(5)
    jobs = {j: set(rng.sample(range(25), rng.choice([1, 2, 3, 4, 9, 14]))) for j in range(60)}
    want = {(a, b, n) for a, b in combinations(jobs, 2) if (n := len(jobs[a] & jobs[b])) >= 2}
    items = spark.createDataFrame([(j, o) for j, s in jobs.items() for o in s] + [(None, 1), (3, None)], "j int, o int")
    for paired in (32, 4):
        got = [tuple(r) for r in J.shared_pairs(items, "j", "o", keep, paired).collect()]
        assert Counter(got) == Counter(want)


@tables
def test_exposure_gives_each_task_a_bounded_number_of_rows(spark, monkeypatch):
    """Six thousand lines, at most a thousand a task: six tasks or more where the session asks for four."""
    monkeypatch.setattr(J, "TASK_ROWS", 1000, raising=False)
    plan = all_queries()["p60_exposure"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert max(int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\)", plan)) >= 6
    assert "distinct" not in plan


def test_an_address_is_read_once(spark):
    """Its class and side in an expression that does not grow with the branches that use it."""
    from pyspark.sql import functions as F

    from casewright import functions as X

    one = spark.createDataFrame([("::ffff:10.0.0.1", " 8.8.8.8 "), ("fe80::1", "192.168.1.2"), ("1.2.3.4", None), ("10.1.2.256", "10.0.0.1")], "a string, b string")
    out = one.select("a", X.address_class(F.col("a")).alias("kind"), X.traffic_side(F.col("a"), F.col("b")).alias("side"))
    assert {tuple(r)[1:] for r in out.collect()} == {("private", "outbound"), ("link_local", "internal"), ("public", "unknown"), ("invalid", "unknown")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("25[0-5]") <= 6  # twice in the pattern of each address that is read


def test_a_directory_is_looked_up_once_for_all_paths_in_it(spark):
    """No table of a view has a row for each path and directory above it."""
    from pyspark.sql import functions as F

    from casewright.operators import trees as T

    sizes = []

    def held(df):
        out = df.localCheckpoint()
        sizes.append(out.count() if "_above" in out.columns and len(out.columns) == 2 and "_dir" in out.columns else 0)
        return out

    entries = spark.range(2000).select(F.concat(F.lit("/a/b/"), (F.col("id") % 2).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("path"), F.lit(0).alias("layer"), F.lit("file").alias("kind"))
    marks = spark.createDataFrame([("/a/b", 1, "whiteout"), ("/a/b/0/4", 1, "file"), ("/a/b/1/3", 2, "whiteout"), ("/a/b/1/5", 2, "file")], "path string, layer int, kind string")
    got = {tuple(r) for r in T.effective_view(entries.unionByName(marks), spark.createDataFrame([(0,), (1,), (2,)], "layer int"), held).select("path", "layer", F.array_join("hidden_in", ",")).collect()}
    assert got == {("/a/b/0/4", 1, "0"), ("/a/b/1/5", 2, "0")}
    assert 0 < max(sizes) <= 8


def test_spread_of_values_that_say_how_often_they_occur(spark):
    from pyspark.sql import functions as F

    from casewright.operators import quantiles as Z

    rng = random.Random(3)
    rows = [("ab"[i % 2], float(rng.randrange(9)), rng.randrange(1, 6)) for i in range(40)]
    once = spark.createDataFrame(rows, "k string, v double, n int")
    many = spark.createDataFrame([(k, v) for k, v, n in rows for _ in range(n)], "k string, v double")
    for most in (100_000, 5):
        want = {tuple(r) for r in Z.spread(many, ["k"], F.col("v"), keep).select("k", "median", "mad").collect()}
        assert {tuple(r) for r in Z.spread(once, ["k"], F.col("v"), keep, most=most, times=F.col("n")).select("k", "median", "mad").collect()} == want


def test_stalls_visit_no_row_by_itself(monkeypatch):
    """A key's frames, in two batches, against a walk from row to row."""
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    import pandas as pd

    from casewright import streaming as K

    sdf = MagicMock()
    K.stream_stall(sdf, "k", "ts", "v", 5000)
    step = sdf.groupBy.return_value.applyInPandasWithState.call_args[0][0]
    rng = random.Random(4)
    parts = [[(1000 * (100 * p + i), float(rng.randrange(2))) for i in range(50)] + [(1000 * (100 * p + 60 + i), 1.0) for i in range(9)] for p in range(3)]

    class State(SimpleNamespace):
        exists, get = False, None

        def update(self, new):
            self.exists, self.get = True, new

    state, value, since = State(), None, 0
    monkeypatch.setattr(pd.DataFrame, "itertuples", MagicMock(side_effect=AssertionError("row by row")))
    for batch in (parts[:1], parts[1:]):
        frames = []
        for rows in batch:
            for t, v in rows:
                value, since = (value, since) if v == value else (v, t)
            mixed = rng.sample(rows, len(rows))
            frames.append(pd.DataFrame({"k": 7, "ts": pd.to_datetime([t for t, _ in mixed], unit="ms"), "v": [v for _, v in mixed]}))
        (out,) = list(step((7,), iter(frames), state))
        still = batch[-1][-1][0] - since
        assert out.iloc[0].tolist() == [7, still, "suspected_stall" if still >= 5000 else "moving"]
