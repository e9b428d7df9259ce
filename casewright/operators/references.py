"""Observations against a dated reference set: which family a set of features points to, and what is known under a name."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _apart(kinds: Sequence[str], mask: str) -> tuple[dict[str, Column], Column]:
    """Aggregates over masks, and whether two kinds both occur and never in one mask. Sums of bits, no sets."""
    bit = {k: F.col(mask).bitwiseAND(F.lit(1 << i)) != 0 for i, k in enumerate(kinds)}
    aggs = {f"_any_{k}": F.bool_or(b) for k, b in bit.items()}
    apart = F.lit(False)
    for a, b in combinations(kinds, 2):
        aggs[f"_both_{a}_{b}"] = F.bool_or(bit[a] & bit[b])
        apart = apart | (F.col(f"_any_{a}") & F.col(f"_any_{b}") & ~F.col(f"_both_{a}_{b}"))
    return aggs, F.coalesce(apart, F.lit(False))


def family_candidates(obs: DataFrame, refs: DataFrame, kinds: Sequence[str], as_of: Column) -> DataFrame:
    """``(key, family, features, support, variants_differ, period, stale)``: every family that a key's features point to.

    ``obs (key, kind, value, seen)``; ``refs (family, variant, kind, value, sources, dated_from, dated_to, fresh_until)``, a row a feature. Values are equal in any
    case; kinds outside ``kinds`` and nulls match nothing. ``support``: corroborated by two kinds of feature, single_feature where one kind has a
    feature of two sources, else weak_lead. ``variants_differ``: two kinds point to variants of the family and to none in common; a feature without a
    variant says nothing of them. ``period`` sets what was seen (its first day) against the dates of the family's sources, which is no contradiction.
    Repeated rows count once.
    """
    bits = F.coalesce(*(F.when(F.col("kind") == k, F.lit(1 << i)) for i, k in enumerate(kinds)))
    known = refs.select("family", "variant", "kind", F.lower("value").alias("_v"), "sources", "dated_from", "dated_to", "fresh_until").where("_v is not null")
    seen = obs.where(bits.isNotNull()).select("key", "kind", F.lower("value").alias("_v"), "seen").where("_v is not null")
    hits = seen.join(known, ["kind", "_v"]).withColumn("_bit", bits)
    span = refs.groupBy("family").agg(F.min("dated_from").alias("_from"), F.max("dated_to").alias("_to"))
    by_variant = hits.groupBy("key", "family", "variant").agg(
        F.bit_or("_bit").alias("_mask"), F.max("sources").alias("_sources"), F.min("seen").alias("_seen"), F.min("fresh_until").alias("_fresh"),
    )
    aggs, apart = _apart(kinds, "_vmask")
    by_variant = by_variant.withColumn("_vmask", F.when(F.col("variant").isNotNull(), F.col("_mask")).otherwise(0))
    out = by_variant.groupBy("key", "family").agg(
        F.bit_or("_mask").alias("_mask"), F.max("_sources").alias("_sources"), F.min("_seen").alias("_seen"), F.min("_fresh").alias("_fresh"), *(a.alias(n) for n, a in aggs.items())
    ).join(span, "family", "left")
    n = F.bit_count("_mask").cast("long")
    support = F.when(n >= 2, "corroborated").when(F.col("_sources") >= 2, "single_feature").otherwise("weak_lead")
    dated = F.col("_seen").isNotNull() & F.col("_from").isNotNull() & F.col("_to").isNotNull()
    period = F.when(~dated, "not_stated").when(F.col("_seen") < F.col("_from"), "before_cited_sources").when(F.col("_seen") > F.col("_to"), "after_cited_sources").otherwise("within_cited_sources")
    stale = F.coalesce(F.col("_fresh") < as_of, F.lit(False))
    return out.select("key", "family", n.alias("features"), support.alias("support"), apart.alias("variants_differ"), period.alias("period"), stale.alias("stale"), F.col("_mask").alias("mask"))


def family_match(keys: DataFrame, candidates: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``(key, outcome, leading, families, contradiction, status)``, a row a key of ``keys (key)``, from ``family_candidates``.

    ``outcome``: unidentified (no family of the set; an unknown one is not ruled out), candidate (one), leading_candidate (one of several with more support
    than the others, named in ``leading``), else ambiguous. ``contradiction``: two kinds point to families and to none in common, or to
    variants of one that differ. ``status`` is partial where a family that was met is past its date.
    """
    strong = F.when(F.col("support") == "corroborated", 2).when(F.col("support") == "single_feature", 1).otherwise(0)
    rank = strong * 64 + F.col("features")
    aggs, apart = _apart(kinds, "mask")
    best = candidates.withColumn("_rank", rank).groupBy("key", "_rank").agg(
        F.count("*").alias("_n"), F.min("family").alias("_one"), F.bool_or("stale").alias("_stale"), F.bool_or("variants_differ").alias("_vary"), *(a.alias(n) for n, a in aggs.items())
    )
    again = {n: F.bool_or(n) for n in aggs}
    top = best.groupBy("key").agg(
        F.sum("_n").alias("families"), F.max(F.struct("_rank", "_n", "_one")).alias("_top"), F.bool_or("_stale").alias("_stale"), F.bool_or("_vary").alias("_vary"), *(a.alias(n) for n, a in again.items())
    )
    out = keys.select("key").distinct().join(top, "key", "left")
    n = F.coalesce("families", F.lit(0)).cast("long")
    outcome = F.when(n == 0, "unidentified").when(n == 1, "candidate").when(F.col("_top._n") == 1, "leading_candidate").otherwise("ambiguous")
    leading = F.when(F.col("_top._n") == 1, F.col("_top._one"))
    against = F.coalesce(apart | F.col("_vary"), F.lit(False))
    return out.select("key", outcome.alias("outcome"), leading.alias("leading"), n.alias("families"), against.alias("contradiction"), F.when(F.col("_stale"), "partial").otherwise("complete").alias("status"))


def plain_name(name: Column) -> Column:
    """A name as it is looked up: in lower case, with one blank for whatever is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def lookup(asked: DataFrame, entries: DataFrame, aliases: DataFrame, variants: DataFrame, needs: DataFrame, held: DataFrame, as_of: Column) -> DataFrame:
    """``(key, entry, result, variant_status, needs, met, unmet, prerequisites, stale)``: what a snapshot holds under each name.

    ``asked (key, name, variant)``, ``entries (entry, name, fresh_until)``, ``aliases (entry, name)``, ``variants (entry, variant)``, ``needs (entry, need)``,
    ``held (key, need, held)``. Names and aliases match as ``plain_name``. A name without an entry is ``no_entry_in_snapshot``, which does not say
    that there is none; its other columns are null. ``variant_status``: variant_not_given, source_names_no_versions, stated_for_this_variant or
    not_stated_for_this_variant. A need is met or unmet as ``held`` says; not said, or said both ways, it is unknown, and so are
    ``prerequisites`` unless one is unmet (not_met) or all are met (all_met; none_stated without any). Repeated rows count once.
    """
    names = entries.select("entry", plain_name(F.col("name")).alias("_n")).unionByName(aliases.select("entry", plain_name(F.col("name")).alias("_n"))).where("_n <> ''").distinct()
    found = asked.select("key", "variant", plain_name(F.col("name")).alias("_n")).distinct().join(names, "_n", "left")
    stated = variants.where("variant is not null").select("entry", F.lower("variant").alias("_v"), F.lit(True).alias("_stated")).distinct()
    some = stated.select("entry", F.lit(True).alias("_some")).distinct()
    found = found.withColumn("_v", F.lower("variant")).join(stated, ["entry", "_v"], "left").join(some, "entry", "left")
    said = held.where("held is not null").groupBy("key", "need").agg(F.min("held").alias("_lo"), F.max("held").alias("_hi")).where("_lo = _hi").select("key", "need", F.col("_lo").alias("_held"))
    pairs = found.where("entry is not null").select("key", "entry").distinct()
    asked_for = pairs.join(needs.select("entry", "need").distinct(), "entry").join(said, ["key", "need"], "left")
    counts = asked_for.groupBy("key", "entry").agg(F.count("*").alias("_needs"), F.count_if("_held").alias("_met"), F.count_if(~F.col("_held")).alias("_unmet"))
    out = found.join(counts, ["key", "entry"], "left").join(entries.select("entry", "fresh_until").groupBy("entry").agg(F.min("fresh_until").alias("_fresh")), "entry", "left")
    there = F.col("entry").isNotNull()
    of_variant = F.when(~there, None).when(F.col("variant").isNull(), "variant_not_given").when(F.col("_some").isNull(), "source_names_no_versions").when(F.col("_stated"), "stated_for_this_variant").otherwise("not_stated_for_this_variant")
    n, met, unmet = (F.when(there, F.coalesce(c, F.lit(0))) for c in ("_needs", "_met", "_unmet"))
    ready = F.when(~there, None).when(n == 0, "none_stated").when(unmet > 0, "not_met").when(met == n, "all_met").otherwise("unknown")
    return out.select(
        "key", "variant", "entry", F.when(there, "entry_found").otherwise("no_entry_in_snapshot").alias("result"), of_variant.alias("variant_status"), n.alias("needs"), met.alias("met"), unmet.alias("unmet"),
        ready.alias("prerequisites"), F.when(there, F.coalesce(F.col("_fresh") < as_of, F.lit(False))).alias("stale"),
    )
