"""What every answer states of itself, and operators that a user registers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def status(df: DataFrame, read: Column, rejected: Column) -> DataFrame:
    """One row: rows read and rejected, and complete, partial or failed with its basis."""
    out = df.agg(F.count_if(read).alias("read"), F.count_if(rejected).alias("rejected"))
    word = F.when(F.col("read") + F.col("rejected") == 0, "failed").when(F.col("rejected") > 0, "partial").otherwise("complete")
    return out.withColumns({"status": word, "basis": F.format_string("%d read, %d rejected", "read", "rejected")})


def brier(p: Column, truth: Column) -> Column:
    return F.avg(F.pow(p - truth, 2))


@dataclass(frozen=True)
class Registered:
    """A named operator: a function of DataFrames with the names and kinds of its parameters."""

    name: str
    fn: Callable[..., DataFrame]
    params: dict[str, type]
    use: str
    version: int = 1

    def __call__(self, df: DataFrame, **args) -> DataFrame:
        if args.keys() - self.params.keys():
            raise TypeError(f"{self.name} has no {sorted(args.keys() - self.params.keys())}")
        for k, kind in self.params.items():
            if k in args and not isinstance(args[k], kind):
                raise TypeError(f"{self.name}: {k} is no {kind.__name__}")
        return self.fn(df, **args)


_OPERATORS: dict[str, Registered] = {}


def register_operator(name: str, fn: Callable[..., DataFrame], params: dict[str, type], use: str) -> Registered:
    """Register ``fn`` under ``name``; a second registration is its next version."""
    old = _OPERATORS.get(name)
    _OPERATORS[name] = Registered(name, fn, params, use, old.version + 1 if old else 1)
    return _OPERATORS[name]


def operator(name: str) -> Registered:
    return _OPERATORS[name]


def register_sql(spark: SparkSession, name: str, params: str, body: str) -> None:
    """A scalar function in SQL, inlined into the plans that call it."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURN {body}")


def run_recipe(df: DataFrame, applies: Column, rows: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What a recipe makes of the rows it applies to, and its coverage: searched and unsupported counts."""
    coverage = df.groupBy(F.when(applies, "searched").otherwise("unsupported").alias("status")).agg(F.count("*").alias("n"))
    return rows(df.where(applies)), coverage


def support_defects(entries: DataFrame, cites: DataFrame, tokens: DataFrame, disputes: DataFrame, rests: DataFrame) -> DataFrame:
    """``(seq, code, n)``: what is wrong with the support of each entry that stands.

    ``entries (seq, kind, superseded)``; ``cites (seq, cited)``; ``tokens (seq, token)``, the specifics of each entry's text; ``disputes (target, stands)``; ``rests
    (seq, job, failed, qualified)``. Codes: disputed (a dispute of it stands); no_support (an answer cites nothing); missing (cites what is not there);
    replaced (cites what was superseded); rests_on_disputed; unsupported_tokens (specifics that no cited entry has); failed_job (rests on a job that failed
    and does not say why it holds). A superseded entry has none. Repeated rows count once.
    """
    e = entries.select("seq", "kind", "superseded").distinct()
    live = e.where("not coalesce(superseded, false)")
    answers = live.where("kind = 'answer'").select("seq")
    seqs = live.select("seq").distinct()
    against = disputes.where("stands").groupBy(F.col("target").alias("seq")).agg(F.count("*").alias("n"))
    code = lambda df, c: df.select("seq", F.lit(c).alias("code"), F.col("n").cast("long").alias("n"))
    cited = answers.join(cites.select("seq", "cited").distinct(), "seq")
    state = e.select(F.col("seq").alias("cited"), F.coalesce("superseded", F.lit(False)).alias("_old"))
    marks = cited.join(state, "cited", "left").join(against.select(F.col("seq").alias("cited"), F.lit(True).alias("_against")), "cited", "left")
    sums = marks.groupBy("seq").agg(F.count_if(F.col("_old").isNull()).alias("missing"), F.count_if("_old").alias("replaced"), F.count_if(F.col("_old").isNotNull() & F.col("_against")).alias("rests_on_disputed"))
    of_cited = sums.select("seq", F.explode(F.create_map(*(x for c in ("missing", "replaced", "rests_on_disputed") for x in (F.lit(c), F.col(c)))))).toDF("seq", "code", "n").where("n > 0")
    t = tokens.select("seq", "token").where("token is not null").distinct()
    backed = cited.join(t.withColumnRenamed("seq", "cited"), "cited").select("seq", "token").distinct()
    bare = t.join(answers, "seq", "left_semi").join(backed, ["seq", "token"], "left_anti").groupBy("seq").agg(F.count("*").alias("n"))
    failed = rests.where("failed and not coalesce(qualified, false)").select("seq", "job").distinct().join(seqs, "seq", "left_semi").groupBy("seq").agg(F.count("*").alias("n"))
    none = answers.join(cites.select("seq"), "seq", "left_anti").withColumn("n", F.lit(1))
    out = code(seqs.join(against, "seq"), "disputed").unionByName(code(none, "no_support")).unionByName(of_cited.select("seq", "code", F.col("n").cast("long").alias("n")))
    return out.unionByName(code(bare, "unsupported_tokens")).unionByName(code(failed, "failed_job"))


def quick_negatives(leads: DataFrame, jobs: DataFrame, seat: str, start: str, end: str, at: str, held_s: int = 120) -> DataFrame:
    """``(lead, held_us, job, object)``: negative leads that a seat closed after one job over one object, held ``held_s`` seconds or less.

    ``leads (lead, seat, start, end, negative)``, ``jobs (job, seat, at, object)`` with a row an object that a job read. A job belongs to a lead
    that its seat held when it ran. Leads still held, or closed without a job, are none. They are cues for review, not faults.
    """
    from casewright.operators.intervals import interval_join
    from casewright.operators.joins import micros

    held = micros(end) - micros(start)
    short = leads.where("negative").where(held <= held_s * 1_000_000).select("lead", seat, start, end, held.alias("held_us"))
    did = interval_join(jobs.select("job", seat, at, "object"), short, [seat], at, start, end, True)
    # distinct jobs and objects are one each where the lowest is the highest: no sets
    by_lead = did.groupBy("lead", "held_us").agg(F.min("job").alias("_a"), F.max("job").alias("_b"), F.min("object").alias("_c"), F.max("object").alias("_d"))
    return by_lead.where("_a = _b and _c = _d").select("lead", "held_us", F.col("_a").alias("job"), F.col("_c").alias("object"))
