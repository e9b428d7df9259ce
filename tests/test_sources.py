"""Sinks, and readers of real files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from casewright.operators import answers
from casewright.plans import all_queries
from casewright.sources import readers as R


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(2, "b|c"), (1, "a"), (3, None)], "seq long, value string")


def test_register_file(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"seq": 1, "kind": "a"}\n\n{"seq": 2, "ki\nnot json\n{"seq": 3}\n')
    good, torn = R.read_register(spark, str(tmp_path), "seq long, kind string")
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (3, None)] and torn.count() == 2


def test_timeline_sinks(spark, rows, tmp_path):
    R.write_timeline(rows, f"{tmp_path}/m", "markdown", ["seq", "value"], ["seq"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/m").orderBy("value").collect()] == ["| 1 | a |", "| 2 | b\\|c |", "| 3 |  |"]
    R.write_timeline(rows, f"{tmp_path}/j", "jsonl", ["seq", "value"], ["seq"])
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    R.write_timeline(rows, f"{tmp_path}/c", "csv", ["seq"], ["seq"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["seq"]
    with pytest.raises(ValueError):
        R.write_timeline(rows, f"{tmp_path}/x", "pdf", ["seq"], ["seq"])


def test_a_page_never_cuts_the_result(rows, tmp_path):
    page, counts = R.page_and_keep(rows, ["seq"], 2, f"{tmp_path}/all")
    assert [r.seq for r in page.collect()] == [1, 2] and tuple(counts.first()) == (3, 2, True)
    assert rows.sparkSession.read.parquet(f"{tmp_path}/all").count() == 3


def test_filelist_in_utf16(spark, tmp_path):
    (tmp_path / "list.tsv").write_bytes("Filename\tSize (bytes)\nä.txt\t12\n".encode("utf-16"))
    assert [tuple(r) for r in R.read_filelist(spark, str(tmp_path / "list.tsv")).collect()] == [("ä.txt", "12")]


def test_years_of_rollovers(spark):
    lines = spark.createDataFrame([(i, m) for i, m in enumerate([11, 12, 12, 1, 2, 1, 12, 1])], "n long, m int")
    got = R.rollover_years(lines.withColumn("f", F.lit(1)), ["f"], "n", F.col("m"), 2020).orderBy("n").collect()
    assert [r.year for r in got] == [2020, 2020, 2020, 2021, 2021, 2021, 2021, 2022]


def test_key_values(spark):
    df = spark.createDataFrame([("SRC=10.0.0.1 DST= LEN=7",)], "value string")
    assert tuple(R.parse_key_values(df, ["SRC", "DST", "PROTO"]).first())[1:] == ("10.0.0.1", "", None)


def test_zeek_second_header(spark):
    lines = [(0, "#fields\ta\tb"), (1, "1\t-"), (2, "2\t(empty)"), (3, "#fields\tb\ta"), (4, "x\t3"), (5, "short")]
    df = spark.createDataFrame(lines, "n long, value string").withColumn("f", F.lit(1))
    got = [r.fields for r in R.parse_zeek(df, ["f"], "n").orderBy("n").collect()]
    assert got == [{"a": "1", "b": None}, {"a": "2", "b": ""}, {"a": "3", "b": "x"}, None]


def test_registered_operators_check_their_parameters(rows):
    op = answers.register_operator("first", lambda df, n: df.limit(n), {"n": int}, "the first rows")
    assert op(rows, n=1).count() == 1 and answers.register_operator("first", op.fn, op.params, op.use).version == op.version + 1
    with pytest.raises(TypeError):
        op(rows, n="1")
    with pytest.raises(TypeError):
        op(rows, m=1)


def test_entry_and_keys():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert json.dumps(sorted(e.queries()))


def test_made_files_are_of_bounded_size(spark, tmp_path, monkeypatch):
    """A larger table makes more files of events, not larger ones."""
    n = 45_000
    spark.range(n).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    fed, zeek, records = {}, R.parse_zeek, R.explode_records
    monkeypatch.setattr(R, "parse_zeek", lambda lines, *a: zeek(fed.setdefault("a3", lines), *a))
    monkeypatch.setattr(R, "explode_records", lambda files, *a: records(fed.setdefault("a9", files), *a))
    for name, column in (("a3_zeek", "uid"), ("a9_audit_envelopes", "id")):
        got = all_queries()[name](spark, str(tmp_path)).agg(F.count("*"), F.count_distinct(column), F.min(column), F.max(column)).first()
        assert tuple(got) == (n, n, 0, n - 1)
    sizes = fed["a3"].groupBy("file").count()
    assert sizes.agg(F.max("count"), F.count("*")).first()[:] == (10_001, 5)  # and a head
    each = fed["a9"].select(F.size(F.split("value", '"id"')) - 1)
    assert each.agg(F.max(each.columns[0]), F.count("*")).first()[:] == (50, 900)
