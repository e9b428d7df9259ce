"""Exact quantiles of groups of any size, with or without weights, and what is measured by them.

A mergeable sketch of each large group gives cut points. The weight between them is summed exactly, the part in which the wanted rank
falls is kept, and the rest is dropped; that is repeated until what is left of a group is small enough to be sorted.
No buffer ever holds the values of a group, and the result does not depend on the sketch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame], DataFrame]

#: Rows of a group that are sorted at once; cut points of a round, and the accuracy of their sketch; groups whose cut points are broadcast.
MOST, CUTS, ACCURACY, FEW = 100_000, 32, 2_000, 1_000
_STATE = ("_n", "_lo", "_hi", "_at", "_base")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Join on keys, nulls alike."""
    named = b.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in b.columns if c not in keys))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return a.join(F.broadcast(named) if few else named, cond, how).drop(*(f"_k{i}" for i in range(len(keys))))


def quantile(df: DataFrame, keys: Sequence[str], value: Column, keep: Keep, p: float = 0.5, weight: Column | None = None, name: str = "quantile", most: int = MOST, times: Column | None = None) -> DataFrame:
    """``(keys, name double)``: the quantile of each group; ``keys`` are one at least, and ``df`` is read more than once.

    Without ``weight``, places between two values are interpolated, so ``p = 0.5`` is the median. With it, the least value at which the weight so far reaches
    ``p`` of the whole. ``times``, without it, says how often a row counts, for tables that have each value once. Null and NaN values, and weights that are null or not above zero, count for nothing; a group without any other is left out.
    """
    rows = df.select(*keys, value.cast("double").alias("_v"), next((c for c in (weight, times) if c is not None), F.lit(1.0)).cast("double").alias("_w")).where("_v is not null and not isnan(_v) and _w > 0")
    at = F.col("_all") * p if weight is not None else (F.col("_all") - 1) * p
    total = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_w").alias("_all")).withColumn("_at", at)
    # of each group: the ranks wanted (from 0, or as weights), and the weight that was dropped below what is left
    whole = (lambda f: f("_at").cast("double")) if weight is None else (lambda f: F.col("_at"))
    state = keep(total.withColumns({"_lo": whole(F.floor), "_hi": whole(F.ceil), "_base": F.lit(0.0)}).select(*keys, *_STATE))
    if not state.where(F.col("_n") > most).isEmpty():
        rows, state = _narrow(rows, state, keys, weight is None, keep, most)
    return _sorted(rows, state, keys, weight is None, name)


def _narrow(rows: DataFrame, state: DataFrame, keys: Sequence[str], plain: bool, keep: Keep, most: int) -> tuple[DataFrame, DataFrame]:
    """What is left of the rows of large groups, with the rows of the others, and the ranks in it."""
    large = F.col("_n") > most
    done = [(_same(rows, state.where(~large).select(*keys), keys, "left_semi"), state.where(~large))]
    state = state.where(large)
    rows = _same(rows, state.select(*keys), keys, "left_semi")
    points = F.array(*(F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)))
    while True:
        few = state.limit(FEW + 1).count() <= FEW
        cuts = keep(rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_v", points, F.lit(ACCURACY))).alias("_cuts")))
        # a part is what lies between two cuts, or what equals one, so a value that repeats without end is a part of its own
        part = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        cut = _same(rows, cuts, keys, few=few).withColumn("_part", part).drop("_cuts")
        parts = cut.groupBy(*keys, "_part").agg(F.sum("_w").alias("_pw"), F.count("*").alias("_pn"), (F.min("_v") < F.max("_v")).alias("_several"))
        upto = F.sum("_pw").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        held = _same(parts.withColumn("_upto", upto), state.drop("_n"), keys).withColumn("_upto", F.col("_upto") + F.col("_base")).withColumn("_from", F.col("_upto") - F.col("_pw"))
        wanted = (F.col("_upto") > F.col("_lo")) & (F.col("_from") <= F.col("_hi")) if plain else (F.col("_upto") >= F.col("_lo")) & (F.col("_from") < F.col("_lo"))
        held = keep(held.where(wanted))
        rows = keep(_same(cut, held.select(*keys, F.col("_part").alias("_of")), keys, few=few).where("_part = _of").select(*keys, "_v", "_w"))
        more = F.bool_or(F.col("_several") & (F.col("_pn") > most)).alias("_more")
        left = keep(held.groupBy(*keys).agg(F.sum("_pn").alias("_n"), *(F.first(c).alias(c) for c in ("_lo", "_hi", "_at")), F.min("_from").alias("_base"), more))
        settled, state = left.where("not _more").select(*keys, *_STATE), left.where("_more").select(*keys, *_STATE)
        done.append((_same(rows, settled.select(*keys), keys, "left_semi"), settled))
        if state.isEmpty():
            break
        rows = _same(rows, state.select(*keys), keys, "left_semi")
    rows, state = done[0]
    for r, s in done[1:]:
        rows, state = rows.unionByName(r), state.unionByName(s)
    return rows, state


def _sorted(rows: DataFrame, state: DataFrame, keys: Sequence[str], plain: bool, name: str) -> DataFrame:
    values = rows.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"))  # values that repeat are one row
    w = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _same(values.withColumn("_upto", F.sum("_w").over(w)), state, keys).withColumn("_upto", F.col("_upto") + F.col("_base"))
    if not plain:
        return placed.where(F.col("_upto") >= F.col("_lo")).groupBy(*keys).agg(F.min("_v").alias(name))
    value_at = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("_v")))
    ends = placed.groupBy(*keys).agg(value_at("_lo").alias("_a"), value_at("_hi").alias("_b"), F.first("_at").alias("_at"), F.first("_lo").alias("_lo"))
    return ends.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_lo"))).alias(name))


def median(df: DataFrame, keys: Sequence[str], value: Column, keep: Keep, name: str = "median", **more) -> DataFrame:
    return quantile(df, keys, value, keep, name=name, **more)


def spread(df: DataFrame, keys: Sequence[str], value: Column, keep: Keep, weight: Column | None = None, middle: str = "median", name: str = "mad", most: int = MOST, times: Column | None = None) -> DataFrame:
    """``(keys, middle, name)``: the (weighted) median of each group and the (weighted) median of distances from it."""
    mid = keep(quantile(df, keys, value, keep, 0.5, weight, middle, most, times))
    rows = df.select(*keys, value.cast("double").alias("_x"), *([] if weight is None else [weight.alias("_u")]), *([] if times is None else [times.alias("_n_of")]))
    off = _same(rows, mid.select(*keys, F.col(middle).alias("_m")), keys)
    dev = quantile(off, keys, F.abs(F.col("_x") - F.col("_m")), keep, 0.5, None if weight is None else F.col("_u"), name, most, None if times is None else F.col("_n_of"))
    return _same(mid, dev, keys)


def brier(probability: Column, truth: Column) -> Column:
    """Mean squared distance of stated probabilities from what came true."""
    return F.avg(F.pow(probability - truth.cast("double"), 2))


def entropy(df: DataFrame, keys: Sequence[str], category: Column, name: str = "entropy") -> DataFrame:
    """``(keys, name)``: bits of the categories of each group; a null category is one of them."""
    counts = df.groupBy(*keys, category.alias("_c")).agg(F.count("*").cast("double").alias("_n"))
    # -sum(n/N log2 n/N) = log2 N - sum(n log2 n) / N, so one pass over the counts will do
    return counts.groupBy(*keys).agg((F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias(name))
