"""Structured Streaming forms of the ordered-event operators.

Batch windows in ``operators.lifecycle`` are the checked versions; these keep the same
rules with state per key. Event times are TIMESTAMP: an NTZ column is cast first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


LEDGER = "key string, seq long, action string, generation int, live_before boolean, violation string"


def ledger_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """acquire / use / release / scope_exit rows of one resource, in sequence order within a trigger."""
    generation, live = state.get if state.exists else (0, False)
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    out = []
    for seq, action in zip(rows["seq"], rows["action"], strict=True):
        before = live
        if action == "acquire":
            generation, live = generation + 1, True
        if generation == 0:
            continue
        bad = None
        if action == "release":
            bad, live = (None if before else "duplicate_release"), False
        elif action == "use" and not before:
            bad = "use_after_release"
        elif action == "scope_exit" and before:
            bad = "leak"
        out.append((key[0], int(seq), action, generation, bool(before), bad))
    state.update((generation, live))
    yield pd.DataFrame(out, columns=["key", "seq", "action", "generation", "live_before", "violation"])


def ledger_stream(events: DataFrame, key: Column, seq: Column, action: Column) -> DataFrame:
    """Ledger rows as events arrive; late rows of a key join the trigger that sees them."""
    rows = events.select(key.cast("string").alias("key"), seq.cast("long").alias("seq"), action.alias("action"))
    return rows.groupBy("key").applyInPandasWithState(ledger_step, LEDGER, "generation int, live boolean", "append", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, at: str, by: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts under a watermark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, size, slide or size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def session_counts(events: DataFrame, at: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Quiescence: runs of events without a gap longer than ``gap``."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def first_seen(events: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once, within the watermark: append-only dedupe."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all available input into a table of that name, and reads it."""
    spark = stream.sparkSession
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
