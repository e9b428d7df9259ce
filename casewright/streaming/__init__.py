"""Structured Streaming forms of the batch computations: each takes and returns a streaming DataFrame.

Watermarks bound the state; a row later than the delay is dropped by Spark and shows in the query's
progress as ``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout


def run_available(sdf: DataFrame, mode: str, path: str) -> DataFrame:
    """Run a stream over all that is there now, and return every row it gave out, with its ``batch``.

    Each batch is written to ``path``, and a batch that is run again replaces itself, so a restart from the
    checkpoint gives the same rows.
    """

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{path}/out/{batch}")

    spark, kind = sdf.sparkSession, T.StructType([*sdf.schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], kind).write.parquet(f"{path}/out/none")
    before = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)
    try:
        query = sdf.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE[0], before)
    return spark.read.schema(kind).parquet(f"{path}/out/*")


def stream_register(spark: SparkSession, path: str, schema, fmt: str = "json", files: int = 100) -> DataFrame:
    """Follow a growing folder of register files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def stream_counts(sdf: DataFrame, ts: str, keys: Sequence[str], width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    return sdf.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def stream_bursts(sdf: DataFrame, ts: str, keys: Sequence[str], width: str, slide: str, k: int, delay: str = "10 minutes") -> DataFrame:
    n = sdf.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= k).select(F.col("window.start").alias("start"), *keys, "n")


def stream_sessions(sdf: DataFrame, ts: str, keys: Sequence[str], gap: str, delay: str = "10 minutes") -> DataFrame:
    s = sdf.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def stream_dedupe(sdf: DataFrame, ts: str, id_col: str, delay: str = "1 hour") -> DataFrame:
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def stream_interval_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, within: str, delay: str = "10 minutes") -> DataFrame:
    """Rows of ``right`` of the same key, at or after ``left`` and within a span of it."""
    a, b = left.withWatermark(lt, delay).alias("a"), right.withWatermark(rt, delay).alias("b")
    return a.join(b, F.expr(f"a.{key} = b.{key} AND b.{rt} >= a.{lt} AND b.{rt} <= a.{lt} + INTERVAL {within}"))


def late_evidence(sdf: DataFrame, text: str, id_col: str, looked_for: DataFrame, word: str) -> DataFrame:
    """New evidence against the words that answers looked for: a stream-static join, one row a hit."""
    words = sdf.select(id_col, F.explode(F.array_distinct(F.split(F.lower(text), r"\W+"))).alias("_w"))
    return words.join(looked_for.select(F.lower(F.col(word)).alias("_w"), F.col(word).alias("hit")), "_w").drop("_w")


#: Operators with timers and more than one state need this store.
_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Spending is added in whole millionths, so a sum does not depend on the order in which it is made.
_UNIT = 1_000_000


class _Budget(StatefulProcessor):
    """State of a key: what it has spent, and when it was steered and paused, each in a value of its own; a timer ends the grace."""

    def __init__(self, key: str, ts: str, order: Sequence[str], value: str, cap: float, grace_ms: int):
        self.names, self.order, self.cap, self.grace_ms = (key, ts, value), [ts, *order], round(cap * _UNIT), grace_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "total long")
        self.steered = handle.getValueState("steered", "at long")
        self.paused = handle.getValueState("paused", "at long")

    def _row(self, key, action: str, at: int, total: int) -> pd.DataFrame:
        return pd.DataFrame({self.names[0]: [key[0]], "action": [action], "at_ms": [at], "total": [total / _UNIT]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, ts, value = self.names
        before = self.spent.get()[0] if self.spent.exists() else 0
        total, first, looking = before, None, not self.steered.exists()
        for part in rows:  # parts of a key come in any order, and where one is cut is Spark's choice
            total += int(part[value].sum())
            if looking:  # of all parts so far, the earliest rows that spend, up to the one that crosses the cap
                first = pd.concat([first, part[part[value] > 0]]).sort_values(self.order)
                over = (before + first[value].cumsum() > self.cap).to_numpy()
                first = first.iloc[: over.argmax() + 1] if over.any() else first
        self.spent.update((total,))
        if looking and total > self.cap:
            at = int(first[ts].iloc[-1].value // 1_000_000)
            self.steered.update((at,))
            # a timer in the past would never ring
            self.handle.registerTimer(max(at + self.grace_ms, timerValues.getCurrentWatermarkInMs() + 1))
            yield self._row(key, "steer", at, before + int(first[value].sum()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.steered.get()[0] + self.grace_ms
        if not self.paused.exists():
            self.paused.update((at,))
            yield self._row(key, "pause", at, self.spent.get()[0])

    def close(self) -> None:
        pass


def stream_caps(sdf: DataFrame, key: str, ts: str, value: str, cap: float, grace_ms: int, delay: str = "10 minutes", order: Sequence[str] = ()) -> DataFrame:
    """``key, action, at_ms, total``: steer at the row with which a key's spending crosses ``cap``, pause when event time has passed that by ``grace_ms``.

    Rows of a key are taken by ``ts``, and by the columns of ``order`` at one instant, within a batch; batches follow each other in time, up to ``delay``. Values
    are not below zero and count to a millionth. A null value spends nothing.
    """
    kind = f"{key} {sdf.schema[key].dataType.simpleString()}, action string, at_ms long, total double"
    spent = F.coalesce(F.round(F.col(value).cast("double") * _UNIT).cast("long"), F.lit(0).cast("long"))
    rows = sdf.withWatermark(ts, delay).select(key, ts, *order, spent.alias(value))
    return rows.groupBy(key).transformWithStateInPandas(_Budget(key, ts, order, value, cap, grace_ms), kind, "Append", "EventTime")


def liveness(sdf: DataFrame, key: str, ts: str, quiet_ms: int, delay: str = "10 minutes") -> DataFrame:
    """``live`` when a key speaks, ``dark`` when event time has passed its last word by ``quiet_ms``; the state is one time a key."""

    def step(k, frames, state):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_ms": [last], "state": ["dark"]})
            return
        last = state.get[0] if state.exists else 0
        for f in frames:
            last = max(last, int(pd.Timestamp(f[ts].max()).value // 1_000_000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "last_ms": [last], "state": ["live"]})

    kind = sdf.schema[key].dataType.simpleString()
    return sdf.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, last_ms long, state string", "last_ms long", "update", GroupStateTimeout.EventTimeTimeout)


def stream_stall(sdf: DataFrame, key: str, ts: str, signal: str, window_ms: int) -> DataFrame:
    """How long each key's signal has kept its value by its own samples: moving, or suspected_stall from ``window_ms`` on."""

    def step(k, frames, state):
        value, since, last = state.get if state.exists else (None, 0, 0)
        for f in frames:
            at = f[ts].to_numpy("datetime64[ns]").astype("int64") // 1_000_000
            by_time = at.argsort(kind="stable")
            at, v = at[by_time], f[signal].to_numpy("float64")[by_time]
            # places where the value is not the one before; the last of them is when it began to stand still
            moved = np.flatnonzero(np.append(value is None or v[0] != value, v[1:] != v[:-1]))
            if len(moved):
                value, since = float(v[-1]), int(at[moved[-1]])
            last = max(last, int(at[-1]))
        state.update((value, since, last))
        yield pd.DataFrame({key: [k[0]], "still_ms": [last - since], "verdict": ["suspected_stall" if last - since >= window_ms else "moving"]})

    kind = sdf.schema[key].dataType.simpleString()
    return sdf.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, still_ms long, verdict string", "value double, since long, last long", "update", GroupStateTimeout.NoTimeout)


def stream_offers(sdf: DataFrame, key: str, ts: str, kind_col: str, accept: str, ttl_ms: int, delay: str = "10 minutes") -> DataFrame:
    """An offer is pending from its first row; it ends accepted by a row of that kind, or lapsed when event time passes its TTL."""

    def step(k, frames, state):
        if state.hasTimedOut:
            state.update((state.get[0], "lapsed"))
            yield pd.DataFrame({key: [k[0]], "status": ["lapsed"]})
            return
        made, status = state.get if state.exists else (None, "pending")
        for f in frames:
            for t, kind in f.sort_values(ts)[[ts, kind_col]].itertuples(index=False):
                at = int(pd.Timestamp(t).value // 1_000_000)
                made = at if made is None else made
                if status == "pending":
                    status = "lapsed" if at >= made + ttl_ms else "accepted" if kind == accept else status
        state.update((made, status))
        if status == "pending":
            state.setTimeoutTimestamp(max(made + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "status": [status]})

    kind = sdf.schema[key].dataType.simpleString()
    return sdf.withWatermark(ts, delay).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string", "made long, status string", "update", GroupStateTimeout.EventTimeTimeout)


def stream_chain(sdf: DataFrame, key: str, order: str, prev: str, hash_col: str) -> DataFrame:
    """Online check that each row names the hash of the row before; the state is the last hash of a register."""

    def step(k, frames, state):
        rows = pd.concat(list(frames)).sort_values(order)
        last, broken = (state.get[0] if state.exists else None), []
        for r in rows[[order, prev, hash_col]].itertuples(index=False):
            named = None if pd.isna(r[1]) else r[1]
            if named != last:
                broken.append(r[0])
            last = r[2]
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(broken), "broken_at": broken})

    kinds = {c: sdf.schema[c].dataType.simpleString() for c in (key, order)}
    return sdf.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, broken_at {kinds[order]}", "last string", "append", GroupStateTimeout.NoTimeout)
