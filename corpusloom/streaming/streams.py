"""Stream jobs and their batch forms: request rates, repetition schedules, incremental enrichment."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions.scale import scan, shuffle_width
from corpusloom.sources.sinks import last_per_key

# Window and allowance of callers; the schedule's constants.
WINDOW_SECONDS, ALLOWED = 60, 20
EASE, EASE_FLOOR, LAPSE_COST, HARD_COST, EASY_GAIN = 2.3, 1.3, 0.2, 0.15, 0.1
HARD_STEP, EASY_STEP, EASY_START = 1.2, 1.3, 3
DAY_MS, MINUTE_MS = 86_400_000, 60_000
CARD = "ease double, interval double, lapses long, reps long, due double"


def request_rate(events: DataFrame, seconds: int = WINDOW_SECONDS, allowed: int = ALLOWED) -> DataFrame:
    """Add ``recent`` (requests of the caller in the trailing window, this one
    included) and ``limited``.  All requests count, also refused ones.

    A window never reaches past the time slot before, so callers are split by
    slot and a busy caller is many tasks.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    slot = F.floor(us / (seconds * 1_000_000))
    e = events.withColumns({"_us": us, "_slot": slot})
    both = e.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_slot", F.col("_slot") + F.when(F.col("_own"), 0).otherwise(1))
    w = Window.partitionBy("caller", "_slot").orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    out = both.withColumn("recent", F.count(F.lit(1)).over(w)).filter("_own")
    return out.drop("_us", "_slot", "_own").withColumn("limited", F.col("recent") > allowed)


class TrailingCounts(StatefulProcessor):
    """Times of each caller as list state; a timer clears a caller once the
    watermark has passed the last time that can still be counted with others."""

    def __init__(self, span: int, keep: int):
        self.span, self.keep = span, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = np.array([t[0] for t in self.times.get()] if self.times.exists() else [], dtype=np.int64)
        new = np.sort(np.concatenate([b["us"].to_numpy(dtype=np.int64) for b in rows]))
        every = np.sort(np.concatenate([known, new]))
        recent = np.searchsorted(every, new, side="right") - np.searchsorted(every, new - self.span, side="right")
        self.times.put([(int(t),) for t in every[every > every[-1] - self.keep]])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(every[-1] + self.keep) // 1000 + 1)
        yield pd.DataFrame({"caller": key[0], "us": new, "recent": recent})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"caller": pd.Series([key[0]]).iloc[:0], "us": np.zeros(0, np.int64), "recent": np.zeros(0, np.int64)})

    def close(self) -> None:
        pass


def keyed_state(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    """``df`` by ``key`` through a processor; its states need the RocksDB store.
    Clock time would ask for batches without data for ever, so a run over what
    is available would not end; what has expired goes with the next data instead."""
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df.groupBy(key).transformWithStateInPandas(processor, schema, "append", time_mode)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything there is to read goes through ``stream`` into a Parquet table; each batch once."""
    stream.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def request_rate_stream(events: DataFrame, seconds: int = WINDOW_SECONDS, allowed: int = ALLOWED, late: str = "10 minutes") -> DataFrame:
    """(caller, ts, recent, limited) of every request of a stream: the trailing
    count of ``request_rate``, kept exactly.

    A caller's state holds the times within one window and the lateness before
    the newest one, and goes once the watermark has passed them all.  A late
    request is counted with what is known of its own window; counts already
    given are not given again.  Requests behind the watermark are dropped.
    """
    span = seconds * 1_000_000
    keep = span + int(pd.Timedelta(late).total_seconds() * 1_000_000)
    caller = events.schema["caller"].dataType.simpleString()
    e = events.withWatermark("ts", late).select("caller", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = keyed_state(e, "caller", TrailingCounts(span, keep), f"caller {caller}, us long, recent long", "EventTime")
    return out.select("caller", F.timestamp_micros("us").alias("ts"), "recent", (F.col("recent") > allowed).alias("limited"))


def _next_interval(interval: float, grade: int, ease: float) -> float:
    if grade == 0:
        return 0.0
    if interval == 0:
        return float(EASY_START if grade == 3 else 1)
    step = HARD_STEP if grade == 1 else ease * EASY_STEP if grade == 3 else ease
    # the interval of a key that never lapses grows without end, so it stays a double
    return max(1.0, math.floor(round(interval * step, 6) + 0.5)) if interval < 1e15 else min(interval * step, 1e300)


def _ease_change(grade):
    return F.when(grade == 0, -LAPSE_COST).when(grade == 1, -HARD_COST).when(grade == 3, EASY_GAIN).otherwise(0.0)


def repetition_history(events: DataFrame) -> DataFrame:
    """Schedule state of a key after each graded event: ease, interval, lapses, reps, due (ms).

    ``events`` has (key, seq, ms, grade 0..3).  Ease with its floor is a
    running sum corrected by a running minimum, and a lapse resets the
    interval, so only the stretch between two lapses is walked in order, row
    by row over sorted batches; a busy key is split at its lapses.
    """
    d = events.withColumn("_d", _ease_change(F.col("grade")))
    s = scan(d, ["key"], ["seq"], {"_sum": ("sum", F.col("_d")), "reps": ("sum", F.lit(1).cast("long")), "lapses": ("sum", (F.col("grade") == 0).cast("long"))})
    m = scan(s, ["key"], ["seq"], {"_low": ("min", F.col("_sum"))})
    ease = F.col("_sum") + F.greatest(F.lit(EASE), EASE_FLOOR - F.col("_low"))
    m = m.withColumn("ease", F.round(ease, 9)).withColumn("_before", F.round(F.col("ease") - F.col("_d"), 9))
    # the floor may swallow part of the change, so the ease before comes from the row before
    prev = m.select("key", (F.col("reps") + 1).alias("reps"), F.col("ease").alias("_prev"))
    rows = m.join(prev, ["key", "reps"], "left").withColumn("_before", F.coalesce("_prev", F.lit(EASE)))
    n = shuffle_width(events.sparkSession)
    ordered = rows.select("key", "lapses", "seq", "ms", "grade", "reps", "ease", "_before").repartition(n, "key", "lapses").sortWithinPartitions("key", "lapses", "seq")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, interval = None, 0.0
        for pdf in batches:
            out = []
            for key, lapse, grade, ease in zip(pdf["key"], pdf["lapses"], pdf["grade"], pdf["_before"]):
                if (key, lapse) != stretch:
                    stretch, interval = (key, lapse), 0.0
                interval = _next_interval(interval, grade, ease)
                out.append(interval)
            pdf["interval"] = out
            pdf["due"] = [float(ms) + (MINUTE_MS if g == 0 else i * DAY_MS) for ms, g, i in zip(pdf["ms"], pdf["grade"], out)]
            yield pdf.drop(columns=["_before"])

    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    names = [c for c in ordered.columns if c != "_before"]
    return ordered.mapInPandas(walk, ", ".join(f"{c} {kinds[c]}" for c in names) + ", interval double, due double")


def repetition_state(events: DataFrame) -> DataFrame:
    """The last state of every key."""
    h = repetition_history(events)
    last = h.groupBy("key").agg(F.max_by(F.struct("ease", "interval", "lapses", "reps", "due"), "seq").alias("s"))
    return last.select("key", "s.*")


class Schedule(StatefulProcessor):
    """The schedule of each key as value state, which lives for ``days`` after the last grade."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.card = handle.getValueState("card", CARD, ttlDurationMs=self.days * DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ease, interval, lapses, reps, due = self.card.get() if self.card.exists() else (EASE, 0.0, 0, 0, 0.0)
        batch = pd.concat(list(rows)).sort_values("seq")
        for ms, g in zip(batch["ms"], batch["grade"]):
            interval = _next_interval(interval, g, round(ease, 9))
            change = {0: -LAPSE_COST, 1: -HARD_COST, 3: EASY_GAIN}.get(int(g), 0.0)
            ease = max(EASE_FLOOR, ease + change)
            lapses, reps = lapses + int(g == 0), reps + 1
            due = float(ms) + (MINUTE_MS if g == 0 else interval * DAY_MS)
        self.card.update((float(ease), float(interval), int(lapses), int(reps), float(due)))  # a state takes no other type for its own
        yield pd.DataFrame({"key": [key[0]], "ease": [round(ease, 9)], "interval": [interval], "lapses": [lapses], "reps": [reps], "due": [due]})

    def close(self) -> None:
        pass


def repetition_stream(events: DataFrame, days: int = 3650) -> DataFrame:
    """The same schedule kept as state per key over a stream of (key, seq, ms, grade):
    one row per key and batch, the one with most ``reps`` being the latest.  A
    key without a grade for ``days`` days of clock time starts anew."""
    return keyed_state(events, "key", Schedule(days), "key long, " + CARD, "ProcessingTime")


def latest_cards(rows: DataFrame) -> DataFrame:
    """The last state of every key among the rows of ``repetition_stream``."""
    return rows.groupBy("key").agg(F.max_by(F.struct("ease", "interval", "lapses", "reps", "due"), "reps").alias("s")).select("key", "s.*")


def incremental_sink(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str], checkpoint: str):
    """Start a stream that enriches only rows whose key is not in the sink yet.

    A batch goes to its own folder, rewritten whole on a retry, so a batch
    that runs twice leaves the sink as if it ran once.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        fresh = last_per_key(batch, keys)
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [str(f.getPath()) for f in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [d for d in done if not d.endswith(f"batch={number}")]
        if done:
            fresh = fresh.join(spark.read.parquet(*done).select(*keys), list(keys), "left_anti")
        enrich(fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
