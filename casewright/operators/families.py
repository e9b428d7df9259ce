"""Operators of single evidence families, built of the general ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.joins import micros


def normalise(df: DataFrame, provider: str, columns: dict[str, Column]) -> DataFrame:
    """One row shape for all providers; what a provider does not state is null."""
    names = ("event_id", "time_us", "principal", "action", "resource", "outcome")
    return df.select(F.lit(provider).alias("provider"), *(columns.get(n, F.lit(None).cast("string")).alias(n) for n in names))


def collapse_stages(df: DataFrame, key: str, stage: str, order: Sequence[str], outcome: str) -> DataFrame:
    """Rows of one request by its stages: the outcome of the last response stage, and the stages seen."""
    rank = F.coalesce(*(F.when(F.col(stage) == s, F.lit(i)) for i, s in enumerate(order)), F.lit(-1))
    seen = F.array_join(F.array_sort(F.collect_set(stage)), ",")
    return df.groupBy(key).agg(F.max_by(F.col(outcome), F.when(rank > 0, rank)).alias("outcome"), seen.alias("stages"))


def assemble(df: DataFrame, key: str, kind: str, value: str, kinds: Sequence[str]) -> DataFrame:
    """Records of several kinds that share an event id, as one row with a column a kind."""
    return df.groupBy(key).agg(*(F.min(F.when(F.col(kind) == k, F.col(value))).alias(k) for k in kinds))


def pair_sessions(df: DataFrame, keys: Sequence[str], ts: str, kind: str, start: str, ends: Sequence[str]) -> DataFrame:
    """A start and the next end on the same line, as a lead; a start before any end stays open."""
    w = Window.partitionBy(*keys).orderBy(ts)
    rows = df.where(F.col(kind).isin(start, *ends)).select(*keys, F.col(kind).alias("_k"), micros(ts).alias("start_us"), F.lead(micros(ts)).over(w).alias("_t"), F.lead(kind).over(w).alias("_n"))
    return rows.where(F.col("_k") == start).select(*keys, "start_us", F.when(F.col("_n").isin(*ends), F.col("_t")).alias("end_us"))


def deletion_states(df: DataFrame, key: str, state: str, ts: str, states: Sequence[str]) -> DataFrame:
    """The first time of each of the states, which each need evidence of their own, and the furthest reached."""
    times = df.groupBy(key).agg(*(F.min(F.when(F.col(state) == s, micros(ts))).alias(s) for s in states))
    return times.withColumn("furthest", F.coalesce(*(F.when(F.col(s).isNotNull(), F.lit(s)) for s in reversed(states))))


def map_events(df: DataFrame, code: str, mapping: dict[str, str], other: str = "other") -> DataFrame:
    """``category`` by a declared map; codes that it lacks stay ``other`` with their raw name."""
    return df.withColumn("category", F.coalesce(*(F.when(F.col(code) == k, F.lit(v)) for k, v in mapping.items()), F.lit(other)))


def target_outcomes(targets: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Each target in one state: the first rule that holds, else unknown."""
    return targets.select(key, F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules), F.lit("unknown")).alias("state"))


def glob_to_regex(glob: str) -> str:
    out = ""
    for c in glob:
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "/_-" else "\\" + c)
    return f"^{out}$"


def resolve_profile(files: DataFrame, col: str, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Files that an include glob selects and no exclude glob drops, with the first glob that does."""
    hit = F.coalesce(*(F.when(F.col(col).rlike(glob_to_regex(g)), F.lit(g)) for g in include))
    out = files.withColumn("glob", hit).where("glob is not null")
    for g in exclude:
        out = out.where(~F.col(col).rlike(glob_to_regex(g)))
    return out


def fold_lines(df: DataFrame, keys: Sequence[str], order: str, text: str, starts: Column) -> DataFrame:
    """Entries of several lines: each begins at a stamp line; what comes before the first is entry 0."""
    entry = F.sum(starts.cast("int")).over(Window.partitionBy(*keys).orderBy(order))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.withColumn("entry", entry.cast("long")).groupBy(*keys, "entry").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"), F.count("*").alias("lines"))


def match_audit(trace: DataFrame, audit: DataFrame, keys: Sequence[str], lt: str, rt: str, id_col: str, within_s: int = 120) -> DataFrame:
    """Ids of actions with an audit line of the same command within so many seconds either side."""
    from casewright.operators.joins import band_join

    return band_join(trace, audit, keys, lt, rt, -within_s, within_s).select(id_col).distinct()


def after_seal(df: DataFrame, keys: Sequence[str], order: str, n: int, kind: str, closing: Sequence[str]) -> DataFrame:
    """Rows past the first ``n`` of a register, and whether all of them only close it."""
    late = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") > n)
    return late.groupBy(*keys).agg(F.count("*").alias("late"), F.bool_and(F.col(kind).isin(*closing)).alias("all_closing"))


def citations(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """``(id, cited)``: entries that a text cites as ``#12``, ``E-12`` or ``#3-#7``; ranges of up to 50."""
    one = F.transform(F.regexp_extract_all(F.col(col), F.lit(r"(?:#|E-)(\d{1,9})"), F.lit(1)), lambda x: x.cast("long"))
    lo, hi = (F.regexp_extract_all(F.col(col), F.lit(r"#(\d{1,9})-#(\d{1,9})"), F.lit(i)) for i in (1, 2))
    spans = F.flatten(F.transform(F.arrays_zip(lo.alias("a"), hi.alias("b")), lambda p: F.when((p["b"].cast("long") >= p["a"].cast("long")) & (p["b"].cast("long") - p["a"].cast("long") <= 50), F.sequence(p["a"].cast("long"), p["b"].cast("long"))).otherwise(F.array().cast("array<long>"))))
    return df.select(id_col, F.explode(F.array_distinct(F.concat(one, spans))).alias("cited"))


def worst_status(df: DataFrame, key: str, status: str, order: Sequence[str]) -> DataFrame:
    """The worst of a key's checks by a declared order, and how many there were."""
    rank = F.coalesce(*(F.when(F.col(status) == s, F.lit(i)) for i, s in enumerate(order)))
    return df.groupBy(key).agg(F.min_by(status, rank).alias("status"), F.count("*").alias("checks"))


def counter_delta(df: DataFrame, keys: Sequence[str], ts: str, counter: str) -> DataFrame:
    """Growth of a cumulative counter from row to row; a fall is a reset, after which the value itself is the growth."""
    before = F.lag(counter).over(Window.partitionBy(*keys).orderBy(ts))
    return df.withColumn("delta", F.when(before.isNull(), F.lit(None)).when(F.col(counter) < before, F.col(counter)).otherwise(F.col(counter) - before))
