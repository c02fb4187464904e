"""Precursors of a stream of single events equal the batch operator, out of order and over a restart."""

import datetime
import random
import time

from pyspark.sql import functions as F

from clausewise.operators import precursors as W
from clausewise.streaming import clauses as S
from clausewise.streaming import events as E

SF = "/root/testdata/sf0.001"
HOUR = 3_600


def test_stream_of_events_equals_batch_over_disorder_and_restart(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    # a key of its own for null, and events at one time
    rows = [tuple(r) for r in ev.collect()]
    rows += [(10_000 + i, rows[i][1], None, "error" if i % 5 == 0 else "view") for i in range(60)] + [(20_000 + i, rows[0][1], 77, "error" if i == 4 else "view") for i in range(9)]
    draw = random.Random(3)
    arrival = sorted(rows, key=lambda r: r[1] + datetime.timedelta(seconds=draw.uniform(0, 2 * HOUR)))
    last = max(r[1] for r in rows)
    # what moves the watermark past everything: an event of another key, much later
    arrival += [(-1, last + datetime.timedelta(days=1), -5, "view"), (-2, last + datetime.timedelta(days=2), -5, "view")]
    parts = [arrival[i:i + 150] for i in range(0, len(arrival) - 2, 150)]
    parts[-1] = [r for r in parts[-1] if r[0] >= 0]
    parts += [[r] for r in arrival[-2:]]

    def run(first):
        for i, part in enumerate(parts):
            if (i < 4) == first:
                spark.createDataFrame(part, ev.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
                time.sleep(0.05)  # files are taken in the order of their time
        stream = E.read_event_stream(spark, str(tmp_path / "in"))
        found = E.event_precursors_stream(stream, "user_id", "ts", "event_id", F.col("event_type") == "error", 7, delay="3 hours")
        S.write_parquet_stream(found, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(300)
        return spark.read.parquet(str(tmp_path / "out")).count()

    some = run(True)      # the first four files, then the query ends
    assert 0 < some < run(False)   # a new query goes on from the checkpoint
    batch = W.precursors(spark.createDataFrame(rows, ev.schema), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 7, trigger_id="event_id")
    want = sorted((str(r.user_id), r.event_id, r.trigger_of, r.precursor_distance) for r in batch.collect())
    got = sorted((str(r.user_id), r.event_id, r.trigger_of, r.precursor_distance) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want and len(want) > 300


def test_ring_is_the_definition():
    draw = random.Random(1)
    for _ in range(200):
        events = [(i, draw.random() < 0.3) for i in range(draw.randint(0, 30))]
        n, leading = draw.randint(1, 5), draw.random() < 0.5
        cut = draw.randint(0, len(events))
        ring, one = E.through_ring([], False, events[:cut], n, leading)
        _, two = E.through_ring(ring, cut > 0, events[cut:], n, leading)
        want = []
        for i, (event, trigger) in enumerate(events):
            ahead = next((j for j in range(i + 1, min(i + n, len(events) - 1) + 1) if events[j][1]), None)
            if ahead is not None and (not trigger or (leading and i == 0)):
                want.append((event, ahead, ahead - i))
        assert sorted(one + two) == sorted(want)
