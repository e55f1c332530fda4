"""Stateful operators on streams in several batches, against plain folds."""

import random

from pyspark.sql import functions as F

from roadweave.streaming.emission import throttled
from roadweave.streaming.learning import arm_means, event_lifecycle, windowed_counts


def drained(spark, tmp_path, rows, schema, make, mode):
    """Rows written file by file, one to a micro-batch, and what the stream gives."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if not k:
            stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
            name = f"out_{abs(hash(str(tmp_path))) % 10**9}"
            q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_throttle_over_batches(spark, tmp_path):
    r = random.Random(1)
    ticks = sorted(r.sample(range(200), 60))
    offers = [(run, t, f"p{t}", r.random() < 0.1) for t in ticks for run in (1, 2)]
    parts = [offers[:40], offers[40:90], offers[90:]]
    out = drained(spark, tmp_path, parts, "run_id int, tick long, payload string, force boolean", lambda s: throttled(s, 12), "append").collect()
    for run in (1, 2):
        want, last, pending, dropped = [], -1, None, 0
        for _, t, p, force in [x for x in offers if x[0] == run]:
            dropped += pending is not None
            pending = (t, p)
            if force or last < 0 or t - last >= 12:
                want.append((len(want), t, p, dropped, force))
                last, pending, dropped = t, None, 0
        got = sorted((x["frame_seq"], x["tick"], x["payload"], x["n_dropped"], x["forced"]) for x in out if x["run_id"] == run)
        assert got == want


def test_arm_means_over_batches(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randrange(3), r.randrange(2), r.random()) for _ in range(60)]
    out = drained(spark, tmp_path, [rows[:20], rows[20:25], rows[25:]], "od_id int, arm int, reward double", arm_means, "update")
    best = {(x["od_id"], x["arm"]): x for x in out.orderBy("pulls").collect()}
    for key, x in best.items():
        own = [w for a, b, w in rows if (a, b) == key]
        assert x["pulls"] == len(own) and abs(x["reward"] - sum(own) / len(own)) < 1e-9


def test_lifecycle_in_any_order(spark):
    schema = "event_id long, tick long, kind string, start_tick long, end_tick long"
    rows = [(1, 5, "tick", 3, 7), (1, 9, "tick", 3, 7), (2, 1, "clear", 3, 7), (2, 4, "tick", 3, 7), (3, 0, "tick", 3, 7), (4, 6, "tick", 3, 7), (4, 6, "clear", 3, 7), (5, 3, "tick", 3, 7), (5, 7, "tick", 3, 7)]
    got = {r["event_id"]: (r["active_at"], r["cleared_at"], r["stage"]) for r in event_lifecycle(spark.createDataFrame(rows[::-1], schema)).collect()}
    assert got == {1: (5, 9, "cleared"), 2: (None, 1, "cleared"), 3: (None, None, "scheduled"), 4: (None, 6, "cleared"), 5: (3, None, "active")}


def test_late_rows_do_not_count(spark, tmp_path):
    at = lambda h, m: f"2024-01-01 {h:02d}:{m:02d}:00"
    parts = [[(at(1, 5), "a", 1.0), (at(1, 50), "a", 2.0)], [(at(3, 0), "a", 4.0)], [(at(1, 10), "a", 100.0), (at(5, 0), "a", 8.0)], [(at(7, 0), "a", 16.0)]]
    make = lambda s: windowed_counts(s.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"))
    out = drained(spark, tmp_path, parts, "ts string, event_type string, value double", make, "append").collect()
    assert sorted((str(r["start"])[11:16], r["n"], r["total"]) for r in out) == [("01:00", 2, 3.0), ("03:00", 1, 4.0), ("05:00", 1, 8.0)]
