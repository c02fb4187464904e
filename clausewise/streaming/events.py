"""Precursors (W1, W3) of an unbounded stream of single events.

Every key has a state: the events that are still ahead of the watermark, and a
ring of the last ``n`` events since the key's last trigger.  When the watermark
passes an event it can no longer be overtaken, so events go through the ring in
the order of the batch operator (time, then id), whatever the micro-batches they
came in, and a trigger sends the ring out as its precursors.  An event-time timeout
wakes keys that hold events which the watermark has passed meanwhile.

The state is bounded by ``n`` rows of a key and its events within the watermark's
delay; Spark keeps it in its state store, so a restart goes on where the last
committed micro-batch ended.  Events later than the delay are dropped by Spark, as
the watermark says; those still ahead of it at the end of a finite input stay in
the state until a later event moves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.constants import PRECURSOR_WINDOW
from clausewise.session import ship_package

_STATE = "at array<bigint>, id array<bigint>, hit array<boolean>, ring array<bigint>, begun boolean"


def read_event_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Events arriving as Parquet files in ``folder``; the schema is taken from the files present at start."""
    ship_package(spark)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder)


def through_ring(ring: list[int], begun: bool, events: list[tuple[int, bool]], n: int, include_leading: bool) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Ring after ordered ``(id, is a trigger)`` events, and ``(id, trigger, distance)`` of the precursors."""
    out = []
    for event, trigger in events:
        if trigger:
            out += [(held, event, len(ring) - i) for i, held in enumerate(ring)]
            # the first event of a key may precede the next trigger although it is one
            ring = [event] if include_leading and not begun else []
        else:
            ring = [*ring, event][-n:]
        begun = True
    return ring, out


def event_precursors_stream(events: DataFrame, key: str, ts: str, event_id: str, is_trigger: Column, n: int = PRECURSOR_WINDOW,
                            include_leading_trigger: bool = True, delay: str = "1 hour") -> DataFrame:
    """``(key, event_id, trigger_of, precursor_distance)`` as triggers come to pass; ids are long, ``delay`` bounds disorder."""
    ship_package(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    rows = (events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(event_id).cast("long").alias("id"),
                          F.coalesce(is_trigger, F.lit(False)).alias("hit"))
                  .filter("ts IS NOT NULL").withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, ids, hits, ring, begun = state.get if state.exists else ([], [], [], [], False)
        waiting = list(zip(at, ids, hits, strict=True))
        for b in batches:
            waiting += zip(b["at"].tolist(), b["id"].tolist(), b["hit"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs()
        ready = sorted(w for w in waiting if w[0] <= passed * 1000)
        waiting = [w for w in waiting if w[0] > passed * 1000]
        ring, out = through_ring(list(ring), begun, [(i, h) for _, i, h in ready], n, include_leading_trigger)
        state.update(([w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting], ring, bool(begun or ready)))
        if waiting:
            state.setTimeoutTimestamp(max(-(-min(waiting)[0] // 1000) - 1, passed + 1))
        yield pd.DataFrame({"key": pd.Series([k[0]] * len(out), dtype="object"), "id": pd.Series([o[0] for o in out], dtype="int64"),
                            "trigger_of": pd.Series([o[1] for o in out], dtype="int64"), "distance": pd.Series([o[2] for o in out], dtype="int64")})

    found = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, id bigint, trigger_of bigint, distance bigint", _STATE, "append", "EventTimeTimeout")
    return found.select(F.col("key").alias(key), F.col("id").alias(event_id), "trigger_of", F.col("distance").alias("precursor_distance"))
