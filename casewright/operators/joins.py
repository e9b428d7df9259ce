"""Joins of evidence: exact, by suffix, by range, by nearest time, by interval, and closures."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.sources.scratch import drop

#: A side is broadcast only if a look at it shows that it has no more rows and no more bytes than this.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted and measured, are few and short, else as it is."""
    n, size = df.limit(most + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= most and (size or 0) <= BROADCAST_BYTES else df


#: Rows that a task is given where each of them, or nearly, is a key that the task holds in memory.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """``df``, which has about that many rows, dealt by ``cols`` to as many tasks as its rows need, however many the session asks for."""
    return df.repartition(max(-(-rows // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *cols)


def micros(col: str | Column) -> Column:
    """Microseconds since the epoch; a time without zone counts in the session's zone, which is UTC here."""
    return F.unix_micros((F.col(col) if isinstance(col, str) else col).cast("timestamp"))


def sweep_exact(evidence: DataFrame, indicators: DataFrame, keys: Sequence[str]) -> DataFrame:
    return evidence.join(indicators, list(keys))


def host_suffixes(host: Column) -> Column:
    """A host name and all of its parent domains, the longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def sweep_domain(df: DataFrame, host: str, domains: DataFrame, domain: str) -> DataFrame:
    """Rows whose host is an indicator domain or lies under one; an equi-join on exploded suffixes."""
    return df.withColumn("_suffix", F.explode(host_suffixes(F.col(host)))).join(domains.withColumnRenamed(domain, "_suffix"), "_suffix").withColumnRenamed("_suffix", domain)


def ipv4_number(col: Column) -> Column:
    p = F.split(col, r"\.")
    return sum((F.get(p, i).cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))


def sweep_cidr(df: DataFrame, addr: str, ranges: DataFrame) -> DataFrame:
    """Rows inside ``ranges (name, net long, bits int)``: one equi-join for each prefix length in use."""
    lengths = [r.bits for r in ranges.select("bits").distinct().orderBy("bits").collect()]  # 33 at the most
    cut = F.explode(F.array(*(F.struct(F.lit(b).alias("bits"), F.shiftright(F.col(addr), 32 - b).alias("_net")) for b in lengths)))
    keyed = df.withColumn("_k", cut).select(*df.columns, F.col("_k.bits").alias("bits"), F.col("_k._net").alias("_net"))
    nets = ranges.withColumn("_net", F.expr("shiftright(net, 32 - bits)")).drop("net")
    return keyed.join(nets, ["bits", "_net"]).drop("_net")


def misses(left: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(hits, list(keys), "left_anti")


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, value: str, direction: str = "prev", tolerance: str | None = None) -> DataFrame:
    """``left`` with the value and time of the nearest row of ``right`` before (or after) it; one window, no range join.

    A row of ``right`` at the same instant counts as before and as after.
    """
    both = left.withColumns({"_side": F.lit(1), "_hit": F.lit(None).cast(f"struct<t:{dict(right.dtypes)[ts]},v:{dict(right.dtypes)[value]}>")}).unionByName(
        right.select(*by, ts, F.lit(0).alias("_side"), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")).alias("_hit")), allowMissingColumns=True
    )
    order = [F.col(ts), F.col("_side")] if direction == "prev" else [F.col(ts).desc(), F.col("_side")]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_near", F.last("_hit", ignorenulls=True).over(w)).where("_side = 1")
    near = F.col("_near")
    if tolerance:
        gap = F.abs(micros(ts) - micros(near["t"]))
        near = F.when(gap <= F.expr(f"{tolerance}"), near)
    return out.withColumns({"near_ts": near["t"], "near_value": near["v"]}).drop("_side", "_hit", "_near")


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lt: str, rt: str, lo_s: int, hi_s: int, bucket_s: int | None = None) -> DataFrame:
    """Pairs of one key with ``lo <= right - left <= hi`` seconds; time is cut in buckets, so a busy key is split.

    Columns of ``right`` other than the keys get the prefix ``r_``.
    """
    size = bucket_s or max(1, hi_s - lo_s)
    l = left.withColumn("_b", F.floor(micros(lt) / (size * 1_000_000)))
    near = F.explode(F.sequence(F.floor((micros(rt) - hi_s * 1_000_000) / (size * 1_000_000)), F.floor((micros(rt) - lo_s * 1_000_000) / (size * 1_000_000))))
    r = right.withColumn("_b", near).select("_b", *keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    gap = micros(f"r_{rt}") - micros(lt)
    return l.join(r, [*keys, "_b"]).where(gap.between(lo_s * 1_000_000, hi_s * 1_000_000)).drop("_b")


def assign(pairs: DataFrame, a: str, b: str, cost: str, keep) -> DataFrame:
    """``(a, b, cost)``: one-to-one, the cheapest pair first, and so on among those left; ties to the smaller ``a``, then ``b``."""
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"), F.col(cost).alias("cost"))
    edges = keep(known.groupBy("x", "y").agg(F.min("cost").alias("cost")))
    alone = lambda c: edges.select(c, F.col(c).alias("id"), F.lit(0).cast("long").alias("rank")).distinct()
    return assign_alike(edges, alone("x"), alone("y"), keep).select(F.col("a").alias(a), F.col("b").alias(b), F.col("cost").alias(cost))


def assign_alike(edges: DataFrame, xs: DataFrame, ys: DataFrame, keep) -> DataFrame:
    """``(a, b, cost)`` as :func:`assign`, for ends that are known by class: ``edges (x, y, cost)`` of classes, and their members ``(x, id, rank)`` and ``(y, id, rank)``, ranked by id from 0.

    The members of a class have the same costs, so they are taken in order of their ids. A round settles each edge that is the only cheapest one of both its ends,
    for as many members as both have left, and edges of one cost that join each of some classes with each of others, whose members meet in order of their ids. Of
    other ties it takes the pairs that are the best of both their ends. That is what the cheapest first would take too. Rounds are few unless costs form long chains; what they take is written by ``keep``.
    """
    size = lambda m, c: m.groupBy(c).agg(F.count("*").alias(f"n{c}"))
    zero = F.lit(0).cast("long")
    left = keep(edges.join(size(xs, "x"), "x").join(size(ys, "y"), "y").select("x", "y", "cost", "nx", "ny", zero.alias("ux"), zero.alias("uy")))
    runs, pairs, held = [], [], []
    while not left.isEmpty():
        before = left
        least = lambda c: left.groupBy(c).agg(F.min("cost").alias(f"c{c}"))  # noqa: B023, E731
        of_x, of_y = F.col("cost") == F.col("cx"), F.col("cost") == F.col("cy")
        near = keep(left.join(least("x"), "x").join(least("y"), "y").where(of_x | of_y).withColumn("tight", of_x & of_y))
        ends = lambda c, o, mine: near.where(mine).groupBy(c).agg(F.count("*").alias(f"d{c}"), F.count_if("tight").alias(f"t{c}"), F.min(o).alias(f"l{c}"))  # noqa: B023, E731
        tight = keep(near.where("tight").join(ends("x", "y", of_x), "x").join(ends("y", "x", of_y), "y"))
        single = (F.col("dx") == 1) & (F.col("dy") == 1)
        run = tight.where(single).select("x", "y", "cost", "ux", "uy", F.least(F.col("nx") - F.col("ux"), F.col("ny") - F.col("uy")).alias("k"))
        runs.append(run)
        gone = {c: run.select(c, "k") for c in "xy"}
        ties = tight.where(~single)
        held.append(tight)
        if not ties.isEmpty():
            found, used = _ties(near, ties, xs, ys, keep)
            met = keep(found)
            drop(*used)
            held.append(met)
            pairs.append(met.select("a", "b", "cost"))
            gone = {c: gone[c].unionByName(met.groupBy(c).agg(F.count("*").alias("k"))) for c in "xy"}
        for c in "xy":
            left = left.join(gone[c], c, "left").withColumn(f"u{c}", F.col(f"u{c}") + F.coalesce("k", zero)).drop("k")
        left = keep(left.where("ux < nx and uy < ny"))
        drop(before, near)
    if not runs:
        return edges.select(F.col("x").alias("a"), F.col("y").alias("b"), "cost")
    all_runs = reduce(DataFrame.unionByName, runs)
    first = all_runs.join(xs, "x").where("rank >= ux and rank < ux + k").select(F.col("id").alias("a"), "y", "cost", (F.col("rank") - F.col("ux") + F.col("uy")).alias("rank"))
    out = keep(reduce(DataFrame.unionByName, [first.join(ys, ["y", "rank"]).select("a", F.col("id").alias("b"), "cost"), *pairs]))
    drop(left, *held)
    return out


def _ties(near: DataFrame, ties: DataFrame, xs: DataFrame, ys: DataFrame, keep) -> tuple[DataFrame, list[DataFrame]]:
    """``(x, y, a, b, cost)`` that a round of :func:`assign_alike` takes of edges that have others of their cost at an end, and the tables that it reads."""
    shape = ties.groupBy(F.col("ly").alias("group"), "cost").agg(
        F.count("*").alias("m"), F.count_distinct("x").alias("mx"), F.count_distinct("y").alias("my"), F.max("dx").alias("dx"), F.max("dy").alias("dy"), F.bool_and((F.col("dx") == F.col("tx")) & (F.col("dy") == F.col("ty"))).alias("all"),
    )
    # each of some with each of others, and with no one else at this cost
    whole = keep(shape.where((F.col("m") == F.col("mx") * F.col("my")) & (F.col("dx") == F.col("my")) & (F.col("dy") == F.col("mx")) & F.col("all")).select("group", "cost"))
    inside = ties.withColumn("group", F.col("ly"))
    own = keep(inside.join(whole, ["group", "cost"]))

    def ranked(c: str, members: DataFrame, name: str) -> DataFrame:
        rest = own.select("group", "cost", c, f"u{c}").distinct().join(members, c).where(F.col("rank") >= F.col(f"u{c}"))
        return rest.select("group", "cost", c, F.col("id").alias(name), F.row_number().over(Window.partitionBy("group", "cost").orderBy("id")).alias("i"))

    met = ranked("x", xs, "a").join(ranked("y", ys, "b"), ["group", "cost", "i"]).select("x", "y", "a", "b", "cost")
    odd = keep(inside.join(whole, ["group", "cost"], "left_anti").select("x", "y"))
    if odd.isEmpty():
        return met, [whole, own, odd]
    first = lambda members, c, name: members.select(c, F.col("rank").alias(f"u{c}"), F.col("id").alias(name))
    told = keep(near.join(first(xs, "x", "a"), ["x", "ux"]).join(first(ys, "y", "b"), ["y", "uy"]))
    best_x = told.where("cost = cx").groupBy("x").agg(F.min("b").alias("fb"))
    best_y = told.where("cost = cy").groupBy("y").agg(F.min("a").alias("fa"))
    one = told.where("tight").join(odd, ["x", "y"], "left_semi").join(best_x, "x").join(best_y, "y").where("a = fa and b = fb")
    return met.unionByName(one.select("x", "y", "a", "b", "cost")), [whole, own, odd, told]


def _alike(rows: DataFrame, id_col: str, keep) -> tuple[DataFrame, DataFrame]:
    """Classes of ids with the same set of rows, each named by its smallest id: ``(cls, id, rank)``, and the rows of a class ``(cls, ...)``."""
    rest = [c for c in rows.columns if c != id_col]
    own = rows.where(" and ".join(f"`{c}` is not null" for c in rows.columns)).distinct()
    digests = own.groupBy(id_col).agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64(*rest)).alias("_p"), F.bit_xor(F.xxhash64(F.lit(1), *rest)).alias("_q"))
    classes = Window.partitionBy("_n", "_p", "_q").orderBy(id_col)
    ranked = digests.select(F.first(id_col).over(classes).alias("cls"), F.col(id_col).alias("id"), (F.row_number().over(classes).cast("long") - 1).alias("rank"))
    members = keep(ranked)
    return members, own.join(members.where("rank = 0").select(F.col("id").alias(id_col)), id_col, "left_semi").withColumnRenamed(id_col, "cls")


def _size_band(size: str, percent: float, most: float | None = None) -> Column:
    """A number of sizes above zero, so that those within ``percent`` of one, and no further off than ``most``, have its number or one beside it."""
    slack = 1.001 / (1 - percent / 100)
    width, value = max(-math.log1p(-percent / 100) * slack, 1e-6), F.col(size).cast("double")
    place = F.ln(value) / width
    if most is not None:  # from the size on of which ``most`` is a smaller part than ``percent``, all steps are as wide
        turn = most * 100 / max(percent, 1e-6)
        place = F.when(value <= turn, place).otherwise(math.log(turn) / width + (value - turn) / (most * slack))
    return F.when(F.col(size) > 0, F.floor(place)).when(F.col(size) == 0, F.lit(1 << 40))


#: Pairs of transfers and items that are listed at once, for each of both and at least; estimated from one transfer of SAMPLE.
LISTED, LEAST_LISTED, SAMPLE = 1, 1 << 21, 16


def _near(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, percent: float, within_s: int, low: float, high: float) -> DataFrame:
    """``(x, y, cost)`` of rows of ``left (transfer, _sent)`` and ``right (item, held)`` that fit, at a cost above ``low`` and up to ``high``."""
    finite = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    if percent < 100:
        most = None if high == math.inf else max(high, 1e-4) * 1.001 + 1e-4  # costs are rounded
        band = _size_band("held", percent, most)
        right_of = right.where(finite("held")).where("held >= 0").withColumn("_z", F.explode(F.array(band - 1, band, band + 1)))
        near = band_join(left.where(finite("_sent")).where("_sent >= 0").withColumn("_z", _size_band("_sent", percent, most)), right_of, [*keys, "_z"], ts, ts, -within_s, 0).drop("_z")
        odd = left.where(~finite("_sent"))
        if high == math.inf and not odd.isEmpty():
            near = near.unionByName(band_join(odd, right, keys, ts, ts, -within_s, 0))
    else:
        near = band_join(left, right, keys, ts, ts, -within_s, 0)
    off = F.abs(F.col("_sent") - F.col("r_held"))
    fit = near.where(off <= F.col("_sent") * percent / 100).select(F.col("transfer").alias("x"), F.col("r_item").alias("y"), F.round(off, 4).alias("cost"))
    fit = fit.where(F.col("cost") > low) if low >= 0 else fit
    return fit.where(F.col("cost") <= high) if high < math.inf else fit


def _reach(near: DataFrame, most: int) -> float:
    """The cost up to which about ``most`` pairs have one, from the pairs of one transfer of SAMPLE; infinite if all are no more."""
    step = F.ceil(4 * F.log2(F.greatest(F.col("cost").cast("double"), F.lit(1e-4))))
    many, last = 0, None
    for at, n in sorted(map(tuple, near.groupBy(step.alias("at")).agg(F.count("*").alias("n")).collect())):  # some 200 steps
        many += n * SAMPLE
        if many > most:
            at = at if last is None else last
            return 2 ** (at / 4) * (1 + 1e-9) if at < 4000 else math.inf
        last = at
    return math.inf


def match_transfers(staged: DataFrame, out: DataFrame, keys: Sequence[str], id_col: str, size: str, ts: str, percent: float, within_s: int, keep) -> DataFrame:
    """``(transfer, staged, off, status)``: transfers matched to items staged before them, within ``within_s`` seconds and ``percent`` of their size.

    No item serves two transfers; unmatched ones of both sides are listed. Ids with the same rows are compared once, and only with those of a like size. The cheapest
    pairs come first, so where there are many, those up to some cost are listed and settled, and then those of what is left: what is written grows with the rows, not with all pairs, unless
    a great many pairs have one cost.
    """
    names = [*keys, ts, id_col, size]
    (sent, left), (items, right) = (_alike(df.select(*names), id_col, keep) for df in (out, staged))
    left, right = keep(left.withColumnsRenamed({"cls": "transfer", size: "_sent"})), keep(right.withColumnsRenamed({"cls": "item", size: "held"}))
    sent, items, low, parts = sent.withColumnRenamed("cls", "x"), items.withColumnRenamed("cls", "y"), -1.0, []
    most = max(LEAST_LISTED, LISTED * (sent.count() + items.count()))
    while True:
        some = left.where(F.pmod(F.xxhash64("transfer"), F.lit(SAMPLE)) == 0)
        high = _reach(_near(some, right, keys, ts, percent, within_s, low, math.inf), most)
        edges = keep(_near(left, right, keys, ts, percent, within_s, low, high).groupBy("x", "y").agg(F.min("cost").alias("cost")))
        parts.append(assign_alike(edges, sent, items, keep))
        if high == math.inf:
            break
        if parts[-1].inputFiles() != edges.inputFiles():
            drop(edges)
        low = high
        before = sent, items, left, right
        (sent, left), (items, right) = _left_over(sent, left, "x", "transfer", parts[-1], "a", keep), _left_over(items, right, "y", "item", parts[-1], "b", keep)
        drop(*before)
    got = reduce(DataFrame.unionByName, parts)
    taken = keep(got.select(F.col("a").alias("transfer"), F.col("b").alias("staged"), F.col("cost").alias("off")))
    drop(edges, sent, items, left, right, *parts)
    rest = out.select(F.col(id_col).alias("transfer")).join(taken, "transfer", "left_anti").withColumn("status", F.lit("unmatched transfer"))
    spare = staged.select(F.col(id_col).alias("staged")).join(taken, "staged", "left_anti").withColumn("status", F.lit("unmatched item"))
    return taken.withColumn("status", F.lit("matched")).unionByName(rest, allowMissingColumns=True).unionByName(spare, allowMissingColumns=True)


def _left_over(members: DataFrame, rows: DataFrame, c: str, cls: str, taken: DataFrame, end: str, keep) -> tuple[DataFrame, DataFrame]:
    """Members of classes that are not taken, ranked anew, since a class is taken in order of its ids; and the rows of classes that have any."""
    gone = members.join(taken.select(F.col(end).alias("id")), "id").groupBy(c).agg(F.count("*").alias("_u"))
    used = F.coalesce("_u", F.lit(0))
    still = keep(members.join(gone, c, "left").where(F.col("rank") >= used).select(c, "id", (F.col("rank") - used).alias("rank")))
    return still, keep(rows.join(still.where("rank = 0").select(F.col(c).alias(cls)), cls, "left_semi"))


def reconcile(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, status)``: matched, mismatch, missing, added, digest_missing, duplicate."""
    side = lambda df, n: df.groupBy(key).agg(F.first(value, ignorenulls=True).alias(n), F.count("*").alias(f"{n}_n"))
    both = side(expected, "_e").join(side(actual, "_a"), key, "full_outer")
    status = (
        F.when((F.coalesce("_e_n", F.lit(0)) > 1) | (F.coalesce("_a_n", F.lit(0)) > 1), "duplicate").when(F.col("_a_n").isNull(), "missing").when(F.col("_e_n").isNull(), "added")
        .when(F.col("_e").isNull() | F.col("_a").isNull(), "digest_missing").when(F.col("_e") == F.col("_a"), "matched").otherwise("mismatch")
    )
    return both.select(key, status.alias("status"))


def unique_match(left: DataFrame, left_id: str, right: DataFrame, right_id: str, key: str) -> DataFrame:
    """``(left_id, status, match, candidates)``: the one row of ``right``, else unresolved or not_found."""
    found = left.select(left_id, key).join(right.select(right_id, key), key, "left").groupBy(left_id).agg(F.count(right_id).alias("candidates"), F.min(right_id).alias("_one"))
    status = F.when(F.col("candidates") == 0, "not_found").when(F.col("candidates") == 1, "matched").otherwise("unresolved")
    return found.select(left_id, status.alias("status"), F.when(F.col("candidates") == 1, F.col("_one")).alias("match"), "candidates")


def standing(df: DataFrame, seq: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    return df.join(df.select(F.col(supersedes).alias(seq)).where(F.col(seq).isNotNull()).distinct(), seq, "left_anti")


def first_producer(df: DataFrame, digest: Column, seq: str) -> DataFrame:
    """``first``: the first row with the same content, if that is an earlier one; empty content never is."""
    first = df.where(digest.isNotNull()).groupBy(digest.alias("_d")).agg(F.min(seq).alias("_f"))
    return df.withColumn("_d", digest).join(first, "_d", "left").withColumn("first", F.when(F.col("_f") < F.col(seq), F.col("_f"))).drop("_d", "_f")


def _composed(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(col: Column) -> Column:
    """Unicode normal form C, which Spark has no expression for."""
    return F.pandas_udf(_composed, "string")(col)


def fold_key(col: Column) -> Column:
    """Names that differ in normal form, case and white space only share a key."""
    return F.lower(F.trim(F.regexp_replace(composed(col), r"\s+", " ")))


#: Objects of a job up to which all pairs of them are listed.
PAIRED = 32


def shared_pairs(items: DataFrame, job: str, obj: str, keep, paired: int = PAIRED) -> DataFrame:
    """``(a, b, shared)``, ``a < b``: jobs that share two objects or more, and how many; ``items`` are distinct and read more than once.

    Most jobs that meet share one object, so jobs meet by pairs of objects: who shares n of them meets n * (n - 1) / 2 times. Of a job with more than ``paired`` objects not all pairs
    are listed; it meets the others by single objects.
    """
    rows = items.select(F.col(job).alias("job"), F.col(obj).alias("obj")).where("job is not null and obj is not null")
    sizes = keep(rows.groupBy("job").agg(F.count("*").alias("_n")).where("_n > 1"))
    few = rows.join(sizes.where(F.col("_n") <= paired).select("job"), "job", "left_semi")
    ends = few.groupBy("job").agg(F.array_sort(F.collect_list("obj")).alias("_o"))
    of_job = F.flatten(F.transform("_o", lambda x, i: F.transform(F.slice("_o", i + 2, F.size("_o")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    total = sizes.where(F.col("_n") <= paired).agg(F.sum(F.expr("_n * (_n - 1) div 2"))).first()[0] or 0
    listed = dealt(ends.select("job", F.explode(of_job).alias("_p")).select("job", "_p.x", "_p.y"), total, "x", "y")
    # a pair of objects that one job alone has joins nothing
    met = keep(listed.join(listed.groupBy("x", "y").agg(F.count("*").alias("_m")).where("_m > 1").select("x", "y"), ["x", "y"], "left_semi"))
    times = met.withColumnRenamed("job", "a").join(met.withColumnRenamed("job", "b"), ["x", "y"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("_t"))
    out = times.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("_t"))) / 2).cast("long").alias("shared"))
    long = keep(sizes.where(F.col("_n") > paired).select("job"))
    if long.isEmpty():
        return out
    mine = rows.join(long, "job", "left_semi").select(F.col("job").alias("l"), "obj")
    other = rows.join(long.withColumn("_long", F.lit(True)), "job", "left").select(F.col("job").alias("o"), "obj", "_long")
    # two long jobs meet once, from the smaller
    pairs = mine.join(other, "obj").where("l <> o and (_long is null or l < o)").groupBy("l", "o").agg(F.count("*").alias("shared")).where("shared >= 2")
    return out.unionByName(pairs.select(F.least("l", "o").alias("a"), F.greatest("l", "o").alias("b"), "shared"))


def groups(edges: DataFrame, keep, rounds: int = 50) -> DataFrame:
    """``(node, group)`` of ``edges (a, b)``: the smallest node that each reaches.

    Each round a node takes the least group among its neighbours' and its own, and then the group of that group, so
    chains are halved; ``keep(df)`` cuts the lineage of a round.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    named = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("group")))
    for _ in range(rounds):
        near = both.join(named.select(F.col("node").alias("b"), F.col("group").alias("g")), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("g"))
        low = named.join(near, "node").select("node", "group", F.least("group", "g").alias("low"))
        up = named.select(F.col("node").alias("low"), F.col("group").alias("up"))
        new = keep(low.join(up, "low", "left").select("node", F.col("group").alias("old"), F.least("low", "up").alias("group")))
        drop(named)
        named = new.select("node", "group")
        if new.where("old <> group").isEmpty():
            drop(both)
            return named
    raise RuntimeError("groups did not settle")


def resolve_refs(refs: DataFrame, producers: DataFrame) -> DataFrame:
    """``(job, producer)`` of ``refs (job, ref)``: what each job names as its input, by job, digest or path.

    A ref is ``job:<id>``, ``sha256:<digest>`` or ``path:<path>``. ``producers (job long, digest, path)`` lists what jobs put out; of several that put out the same
    digest or path, the first made it. A ref that names nothing known has no row.
    """
    kind, name = F.substring_index("ref", ":", 1), F.expr("substring(ref, instr(ref, ':') + 1)")
    named = refs.select("job", kind.alias("kind"), name.alias("name"))
    known = producers.select(F.lit("sha256").alias("kind"), F.lower("digest").alias("name"), "job").unionByName(producers.select(F.lit("path").alias("kind"), F.col("path").alias("name"), "job"))
    first = known.unionByName(producers.select(F.lit("job").alias("kind"), F.col("job").cast("string").alias("name"), "job")).groupBy("kind", "name").agg(F.min("job").alias("producer"))
    return named.withColumn("name", F.when(F.col("kind") == "sha256", F.lower("name")).otherwise(F.col("name"))).join(first, ["kind", "name"]).select("job", "producer").distinct()


def closure(edges: DataFrame, seeds: DataFrame, keep, max_depth: int | None = None) -> tuple[DataFrame, bool]:
    """``(node, depth)``: what is reached from ``seeds (node)`` along ``edges (src, dst)``, at the least depth; and whether ``max_depth`` cut it.

    A frontier join per level; ``keep(df)`` cuts the lineage of a level, for
    example a checkpoint. A node that was reached is never entered again, so cycles end. Without a bound all levels are walked.
    """
    seen = keep(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while True:
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        depth += 1
        frontier = keep(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen, False
        if max_depth is not None and depth > max_depth:
            return seen, True
        seen = keep(seen.unionByName(frontier))
