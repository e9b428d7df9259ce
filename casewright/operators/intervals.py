"""Points in intervals by a dyadic index.

Time between the first and last point is cut in cells, and those in cells twice as large, and so on. An interval is
cut into the few aligned cells that cover it, at most two of each size, and a point lies in one cell of each size. So the join is an
equality on size and cell; it makes no candidate that is not a match, but at the two smallest cells of an interval, which it covers in part.
A key of few intervals needs no cells: its points meet all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.operators.joins import micros, small

#: Sizes of cells: the smallest is a 2^-DEEPEST of the time between the points at the least.
DEEPEST = 40
#: Up to so many intervals of a key are compared with each of its points; cells would file and ask more rows than that.
FEW = 32


def _number(df: DataFrame, col: str) -> Column:
    kind = dict(df.dtypes)[col]
    return micros(col).cast("double") if kind.startswith(("timestamp", "date")) else F.col(col).cast("double")


def cells(first: Column, last: Column, depth: int) -> Column:
    """``array<struct<level, cell>>``: the aligned cells that make up the smallest cells ``first`` to ``last``."""
    up = lambda x, n: F.ceil(x / F.pow(F.lit(2.0), n)).cast("long")
    down = lambda x, n: F.floor(x / F.pow(F.lit(2.0), n)).cast("long")

    def at(level: Column) -> Column:
        lo, hi = up(first, level), down(last + 1, level)
        # what the next size does not cover; nothing is larger than the whole
        inner_lo, inner_hi = 2 * up(first, level + 1), 2 * down(last + 1, level + 1)
        none = (inner_lo >= inner_hi) | (level == depth)
        a = F.filter(F.array(lo, hi - 1), lambda c: (c >= lo) & (c < hi) & (none | (c < inner_lo) | (c >= inner_hi)))
        return F.transform(F.array_distinct(a), lambda c: F.struct(level.cast("int").alias("level"), c.alias("cell")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(depth)), at))


def _meet(points: DataFrame, held: DataFrame, on: Sequence[str]) -> DataFrame:
    """An equi-join in which Spark's estimate, which knows nothing of the cells, chooses no broadcast."""
    looked = small(held)
    return points.join(looked if looked is not held else held.hint("merge"), list(on))


def candidates(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and an interval from ``start`` to ``end`` that share a cell, or a key of few intervals: all matches, and few other pairs."""
    rest = [c for c in intervals.columns if c not in keys]
    lo, hi = points.agg(F.min(_number(points, at)), F.max(_number(points, at))).first()
    if lo is None:
        return points.limit(0).join(intervals, list(keys))
    begin, stop = _number(intervals, start), F.coalesce(_number(intervals, end), F.lit(math.inf))
    held = intervals.where(begin.isNotNull() & (F.col(end).isNull() | (F.col(start) <= F.col(end))) & (begin <= hi) & (stop >= lo)).dropna(subset=list(keys))
    sizes = held.groupBy(*keys).agg(F.count("*").alias("_n"))
    some, most = sizes.agg(F.count_if(F.col("_n") <= FEW), F.max("_n")).first()
    if keys and (most or 0) <= FEW:
        return _meet(points, held, keys).select(*points.columns, *rest)
    if not keys or not some:
        return _filed(points, held, keys, at, begin, stop, lo, hi, most)
    busy = small(sizes.where(F.col("_n") > FEW).select(*keys))  # a row for every FEW intervals at the most
    part = lambda df, how: df.join(busy, list(keys), how)
    plain = _meet(part(points, "left_anti"), part(held, "left_anti"), keys).select(*points.columns, *rest)
    return plain.unionByName(_filed(part(points, "left_semi"), part(held, "left_semi"), keys, at, begin, stop, lo, hi, most))


def _filed(points: DataFrame, held: DataFrame, keys: Sequence[str], at: str, begin: Column, stop: Column, lo: float, hi: float, most: int) -> DataFrame:
    """Pairs that share a cell; ``most`` is the number of intervals of the key that has most."""
    rest = [c for c in held.columns if c not in keys]
    depth = min(DEEPEST, math.ceil(math.log2(most + 2)) + 4)  # cells as fine as there are interval ends of a key, and somewhat finer
    unit = max((hi - lo) / ((1 << depth) - 1), 1e-9)
    cell = lambda x: F.floor((x - F.lit(lo)) / F.lit(unit)).cast("long")
    filed = held.withColumn("_in", F.explode(cells(cell(F.greatest(begin, F.lit(lo))), cell(F.least(stop, F.lit(hi))), depth)))
    filed = filed.select(*keys, F.col("_in.level").alias("_level"), F.col("_in.cell").alias("_cell"), *rest)
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())  # depth + 1 at the most
    ask = F.array(*(F.struct(F.lit(v).alias("level"), F.shiftright("_fine", v).alias("cell")) for v in levels)) if levels else F.array().cast("array<struct<level:int,cell:bigint>>")
    asked = points.withColumn("_fine", cell(_number(points, at))).withColumn("_in", F.explode(ask))
    asked = asked.select(*points.columns, F.col("_in.level").alias("_level"), F.col("_in.cell").alias("_cell"))
    return _meet(asked, filed, [*keys, "_level", "_cell"]).select(*points.columns, *rest)


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, closed: bool = False) -> DataFrame:
    """Points with each interval ``[start, end)`` of their key that they lie in, or ``[start, end]`` if ``closed``; an open end is null and never closes.

    Intervals without a start, or that end before they begin, hold nothing. Columns of ``intervals`` other than the keys follow those of
    ``points``. A key with very many intervals is spread over its cells.
    """
    before = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    return candidates(points, intervals, keys, at, start, end).where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | before))


def malformed(df: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals that end before they begin: no overlap is judged for them."""
    return df.where(F.col(start) > F.col(end))


def _sided(df: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str, name: str, lowest) -> DataFrame:
    begin = F.coalesce(start, F.lit(lowest).cast(dict(df.dtypes)[start]))
    return df.where(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) <= F.col(end))).select(*keys, F.col(id_col).alias(name), begin.alias(f"{name}_from"), F.col(end).alias(f"{name}_to"))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str) -> DataFrame:
    """``(keys, a, b)``: an interval of ``a`` and one of ``b``, closed, of one key, that meet; an open bound is null and meets everything.

    Of two that meet, the later begins inside the earlier. :func:`malformed` ones are in no pair.
    """
    low = [df.agg(F.least(F.min(start), F.min(end))).first()[0] for df in (a, b)]
    lowest = min((x for x in low if x is not None), default=None)
    if lowest is None:  # no bound at all: all meet
        lowest = "1970-01-01" if dict(a.dtypes)[start].startswith(("timestamp", "date")) else 0
    x, y = _sided(a, keys, id_col, start, end, "a", lowest), _sided(b, keys, id_col, start, end, "b", lowest)
    later_b = interval_join(y.select(*keys, "b", "b_from"), x, keys, "b_from", "a_from", "a_to", closed=True)
    later_a = interval_join(x.select(*keys, "a", "a_from"), y, keys, "a_from", "b_from", "b_to", closed=True).where("a_from > b_from")
    return later_b.select(*keys, "a", "b").unionByName(later_a.select(*keys, "a", "b"))


def overlap_pairs(df: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str) -> DataFrame:
    """``(keys, a, b)`` with a < b of one key whose closed intervals meet, each pair once; see :func:`overlap_join`."""
    lowest = df.agg(F.least(F.min(start), F.min(end))).first()[0]
    if lowest is None:
        lowest = "1970-01-01" if dict(df.dtypes)[start].startswith(("timestamp", "date")) else 0
    x, y = _sided(df, keys, id_col, start, end, "a", lowest), _sided(df, keys, id_col, start, end, "b", lowest)
    met = interval_join(y.select(*keys, "b", "b_from"), x, keys, "b_from", "a_from", "a_to", closed=True)
    met = met.where((F.col("a_from") < F.col("b_from")) | ((F.col("a_from") == F.col("b_from")) & (F.col("a") < F.col("b"))))
    return met.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
