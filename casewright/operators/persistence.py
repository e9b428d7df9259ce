"""What starts by itself: configuration as it stands after drop-ins, masks and aliases, apart from what was seen to run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.operators import trees as T

Keep = Callable[[DataFrame], DataFrame]


def standing_assignments(lines: DataFrame, order: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Assignments ``(unit, key, value, ...)`` that still stand when a unit and its drop-ins are read in ``order``.

    Of a key in ``lists`` an empty assignment takes back all before it and the later ones add up; of any other key the last one stands, and an empty
    one leaves none. What takes back is one row a unit and key before it is joined, so a unit with very many lines does not meet in one task.
    """
    at = F.struct(*order)
    many = F.col("key").isin(*lists)
    empty = F.coalesce(F.col("value"), F.lit("")) == ""
    rows = lines.withColumn("_at", at)
    cut = rows.groupBy("unit", "key").agg(F.max(F.when(empty | ~many, F.col("_at"))).alias("_cut")).where("_cut is not null")
    met = rows.join(cut, ["unit", "key"], "left")
    stands = F.when(many, F.col("_cut").isNull() | (F.col("_at") > F.col("_cut"))).otherwise(F.col("_at") == F.col("_cut"))
    return met.where(stands & ~empty).drop("_at", "_cut")


def resolve_links(links: DataFrame, keep: Keep) -> DataFrame:
    """``(name, unit, masked, state)``: where each alias ends, over any number of others, and whether that is nowhere (``/dev/null``).

    ``links (name, target)``. A name in two places with two targets is contested, one whose aliases run in a circle is cyclic; neither has a unit.
    """
    one = links.groupBy("name").agg(F.min("target").alias("target"), (F.count_distinct("target") > 1).alias("_contested"))
    sure = one.where("not _contested")
    # an alias of what is no link ends there: such targets are the roots
    ends = sure.select(F.col("target").alias("name")).distinct().join(sure.select("name"), "name", "left_anti").withColumn("target", F.lit(None).cast("string"))
    tree = T.forest(sure.select("name", "target").unionByName(ends), "name", "target", F.col("name"), keep)
    found = sure.select("name").join(tree.select(F.col("node").alias("name"), "root", F.col("state").alias("_s")), "name")
    masked, cyclic = F.col("root") == "/dev/null", F.col("_s") == "cyclic"
    state = F.when(cyclic, "cyclic").when(masked, "masked").otherwise("alias")
    out = found.select("name", F.when(~masked & ~cyclic, F.col("root")).alias("unit"), F.coalesce(masked, F.lit(False)).alias("masked"), state.alias("state"))
    lost = one.where("_contested").select("name", F.lit(None).cast("string").alias("unit"), F.lit(False).alias("masked"), F.lit("contested").alias("state"))
    contested = out.join(lost.select(F.col("name").alias("unit"), F.lit(True).alias("_c")), "unit", "left")
    lost_too = contested.select("name", F.when(F.col("_c").isNull(), F.col("unit")).alias("unit"), "masked", F.when(F.col("_c"), "contested").otherwise(F.col("state")).alias("state"))
    return lost_too.unionByName(lost)


def persistence(lines: DataFrame, order: Sequence[str], links: DataFrame, wanted: DataFrame, ran: DataFrame, keep: Keep, command: str = "ExecStart", lists: Sequence[str] = ("ExecStart",)) -> DataFrame:
    """``(unit, commands, resets, aliases, wants, masked, configuration, runs, execution)``, a row a unit that is configured, masked or was seen to run.

    ``links (name, target)`` are aliases and masks, ``wanted (name)`` enablement links, ``ran (name)`` runs, the last two by unit or alias. A mask hides a unit's own
    lines. ``configuration``: masked, enabled (wanted, with a command), dormant (a command that nothing wants), no_command or none (runs
    only). It never says that a unit ran: that is ``execution``, seen or not_seen.
    """
    stand = standing_assignments(lines, order, lists)
    commands = stand.where(F.col("key") == command).groupBy("unit").agg(F.count("*").alias("commands"))
    empty = F.coalesce(F.col("value"), F.lit("")) == ""
    units = lines.groupBy("unit").agg(F.count_if(empty & F.col("key").isin(*lists)).alias("resets")).withColumn("_configured", F.lit(True))
    ends = keep(resolve_links(links, keep))
    aliases = ends.where("unit is not null").groupBy("unit").agg(F.count("*").alias("aliases"))
    masks = ends.where("masked").select(F.col("name").alias("unit"), F.lit(True).alias("masked"))

    def by_unit(names: DataFrame, n: str) -> DataFrame:
        counted = names.groupBy("name").agg(F.count("*").alias(n))
        real = counted.join(ends.where("unit is not null").select("name", "unit"), "name", "left")
        return real.groupBy(F.coalesce("unit", "name").alias("unit")).agg(F.sum(n).alias(n))

    out = units
    for more in (commands, aliases, by_unit(wanted, "wants"), masks, by_unit(ran, "runs")):
        out = out.join(more, "unit", "full")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("commands", "resets", "aliases", "wants", "runs")}
    masked = F.coalesce("masked", F.lit(False))
    out = out.where(F.col("_configured").isNotNull() | masked | (n["runs"] > 0))
    state = F.when(masked, "masked").when(F.col("_configured").isNull(), "none").when(n["commands"] == 0, "no_command").when(n["wants"] > 0, "enabled").otherwise("dormant")
    return out.select("unit", *(c.alias(k) for k, c in n.items()), masked.alias("masked"), state.alias("configuration"), F.when(n["runs"] > 0, "seen").otherwise("not_seen").alias("execution"))
