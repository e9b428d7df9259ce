"""Windows larger than a task: a two-level prefix scan.

Rows are range-partitioned by key and order and written with the number of their part, so a key that holds a third of
all rows lies in many parts, next to each other. A window runs inside each part; what it would need from earlier parts is one row for
each part and key, and only the key that a part begins with can have come before: as many rows as there are parts. They
are scanned by themselves and carried in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.joins import micros

Keep = Callable[[DataFrame], DataFrame]


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Keep, descending: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with ``_part``, rows of each part contiguous by ``keys`` and ``order``; written by ``keep``, so parts stay as they are."""
    cols = [*keys, *(F.desc(c) if descending else F.asc(c) for c in order)]
    dealt = df.repartitionByRange(parts, *cols) if parts else df.repartitionByRange(*cols)
    return keep(dealt.withColumn("_part", F.spark_partition_id()))


def scan(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], descending: bool = False,
    previous: dict[str, Column] | None = None, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, number: str | None = None,
) -> DataFrame:
    """``rows`` of :func:`ranged` with, by key and in order: ``previous``, a value of the row before; ``last``, the last value up to
    here that is not null; ``total``, a running sum; ``number``, the place from 1.

    ``order`` must tell rows of a key apart where the result depends on it. Null keys are a key.
    """
    previous, last, total = previous or {}, last or {}, total or {}
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    here = Window.partitionBy("_part", *keys).orderBy(*by)
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at, pick = F.struct(*order), F.min_by if descending else F.max_by
    out = rows.withColumn("_nth", F.row_number().over(here))
    ends = [F.count("*").alias("_e_n")]
    for k, c in previous.items():
        out = out.withColumn(f"_p_{k}", F.lag(F.struct(c.alias("v"))).over(here))
        ends.append(pick(F.struct(c.alias("v")), at).alias(f"_e_p_{k}"))
    for k, c in last.items():
        out = out.withColumn(f"_l_{k}", F.last(c, ignorenulls=True).over(so_far))
        ends.append(pick(c, F.when(c.isNotNull(), at)).alias(f"_e_l_{k}"))
    for k, c in total.items():
        out = out.withColumn(f"_t_{k}", F.sum(c).over(so_far))
        ends.append(F.sum(c).alias(f"_e_t_{k}"))
    parts = Window.partitionBy(*keys).orderBy("_part")  # a row a part
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.lag(f"_e_p_{k}").over(parts).alias(f"_c_p_{k}") for k in previous]
    carry += [F.last(f"_e_l_{k}", ignorenulls=True).over(before).alias(f"_c_l_{k}") for k in last]
    carry += [F.sum(f"_e_t_{k}").over(before).alias(f"_c_t_{k}") for k in total]
    summary = rows.groupBy("_part", *keys).agg(*ends)
    named = [F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)]
    carried = summary.select(F.col("_part").alias("_of"), *named, F.sum("_e_n").over(before).alias("_c_n"), *carry).where("_c_n is not null")
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    out = out.join(F.broadcast(carried), same, "left")  # a row a part at the most
    for k in previous:
        out = out.withColumn(k, F.when(F.col("_nth") == 1, F.col(f"_c_p_{k}.v")).otherwise(F.col(f"_p_{k}.v")))
    for k in last:
        out = out.withColumn(k, F.coalesce(f"_l_{k}", f"_c_l_{k}"))
    for k in total:
        out = out.withColumn(k, F.when(F.col(f"_c_t_{k}").isNull(), F.col(f"_t_{k}")).otherwise(F.coalesce(F.col(f"_t_{k}"), F.lit(0)) + F.col(f"_c_t_{k}")))
    if number:
        out = out.withColumn(number, (F.col("_nth") + F.coalesce("_c_n", F.lit(0))).cast("long"))
    gone = [f"_{x}_{k}" for x, d in (("p", previous), ("l", last), ("t", total)) for k in d] + [f"_c_{x}_{k}" for x, d in (("p", previous), ("l", last), ("t", total)) for k in d]
    return out.drop("_nth", "_c_n", "_of", *(f"_k_{i}" for i in range(len(keys))), *gone)


def islands(df: DataFrame, keys: Sequence[str], ts: str, gap_s: float, keep: Keep, parts: int | None = None) -> DataFrame:
    """One row a run of a key, parted by gaps of more than ``gap_s`` seconds: ``run, start_us, end_us, n``."""
    rows = ranged(df.select(*keys, micros(ts).alias("_t")), keys, ["_t"], keep, parts=parts)
    near = scan(rows, keys, ["_t"], previous={"_before": F.col("_t")})
    new = F.coalesce((F.col("_t") - F.col("_before") > int(gap_s * 1_000_000)).cast("long"), F.lit(0).cast("long"))
    flagged = keep(near.withColumn("_new", new).drop("_before"))
    numbered = scan(flagged, keys, ["_t"], total={"run": F.col("_new")})
    return numbered.groupBy(*keys, "run").agg(F.min("_t").alias("start_us"), F.max("_t").alias("end_us"), F.count("*").alias("n"))


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, value: str, keep: Keep, direction: str = "prev", parts: int | None = None) -> DataFrame:
    """``left`` with ``near_ts`` and ``near_value`` of the nearest row of ``right`` before (or after) it, for keys of any size.

    A row of ``right`` at the same instant counts as before and as after; of several at one instant the one with the largest value.
    """
    kind = dict(right.dtypes)
    both = left.withColumns({"_side": F.lit(1), "_rank": F.lit(None).cast(kind[value]), "_hit": F.lit(None).cast(f"struct<t:{kind[ts]},v:{kind[value]}>")}).unionByName(
        right.select(*by, ts, F.lit(0).alias("_side"), F.col(value).alias("_rank"), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")).alias("_hit")), allowMissingColumns=True
    )
    back = direction == "next"
    # at one instant, rows of the right side come first in either direction
    both = both.withColumn("_turn", (-F.col("_side") if back else F.col("_side")))
    order = [ts, "_turn", "_rank"]
    rows = ranged(both, by, order, keep, back, parts)
    near = scan(rows, by, order, back, last={"_near": F.col("_hit")}).where("_side = 1")
    return near.withColumns({"near_ts": F.col("_near.t"), "near_value": F.col("_near.v")}).drop("_side", "_rank", "_hit", "_turn", "_near", "_part")


def holding_intervals(events: DataFrame, keys: Sequence[str], ts: str, starts: Column, ends: Column, holder: str, keep: Keep, parts: int | None = None) -> DataFrame:
    """``from_us, to_us`` of each holding: a start by the same holder changes nothing, any other start or end closes; open ends are null."""
    rows = events.where(starts | ends).select(*keys, micros(ts).alias("from_us"), F.when(starts, F.col(holder)).alias("holder"))
    met = scan(ranged(rows, keys, ["from_us"], keep, parts=parts), keys, ["from_us"], previous={"_p": F.col("holder")}).drop("_part")
    kept = met.where(~(F.col("holder").isNotNull() & F.col("holder").eqNullSafe(F.col("_p")))).drop("_p")
    back = ranged(kept, keys, ["from_us"], keep, True, parts)
    return scan(back, keys, ["from_us"], True, previous={"to_us": F.col("from_us")}).where("holder is not null").select(*keys, "holder", "from_us", "to_us")


def verify_chain(lines: DataFrame, register: str, seq: str, body: str, prev: str, digest: str, seals: DataFrame, keep: Keep, parts: int | None = None) -> DataFrame:
    """One row a register: ``rows, first_gap, first_break, first_altered, seal, after_seal``.

    Numbers run from 1 without a gap, else ``first_gap`` is the first that does not follow; ``first_break`` is the first line whose ``prev`` is not
    the digest of the line before (null for the first); ``first_altered`` the first whose ``digest`` is not the sha256 of its body. ``seals (register, seq,
    digest)``: kept if that line is there with that digest, broken if not, none without one; ``after_seal`` counts later lines.
    """
    rows = ranged(lines.select(register, F.col(seq).alias("_s"), F.col(body).alias("_b"), F.col(prev).alias("_v"), F.col(digest).alias("_d")), [register], ["_s", "_d"], keep, parts=parts)
    met = scan(rows, [register], ["_s", "_d"], previous={"_ps": F.col("_s"), "_pd": F.col("_d")})
    seal = F.broadcast(seals) if seals.limit(100_001).count() <= 100_000 else seals
    met = met.join(seal.select(F.col("register").alias(register), F.col("seq").alias("_seal"), F.col("digest").alias("_sealed")), register, "left")
    first = lambda bad: F.min(F.when(bad, F.col("_s")))
    out = met.groupBy(register).agg(
        F.count("*").alias("rows"), first(F.col("_s") != F.coalesce("_ps", F.lit(0)) + 1).alias("first_gap"), first(~F.col("_v").eqNullSafe(F.col("_pd"))).alias("first_break"),
        first(~F.col("_d").eqNullSafe(F.sha2("_b", 256))).alias("first_altered"), F.max("_seal").alias("_seal"), F.max((F.col("_s") == F.col("_seal")) & (F.col("_d") == F.col("_sealed"))).alias("_ok"),
        F.count_if(F.col("_s") > F.col("_seal")).alias("after_seal"),
    )
    return out.withColumn("seal", F.when(F.col("_seal").isNull(), "none").when(F.col("_ok"), "kept").otherwise("broken")).drop("_seal", "_ok")
