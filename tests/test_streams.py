"""Ordered streams over shuffled micro-batches against the batch forms; restart of a scan."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import frames as fr
from tapeloom.operators import signal as sg
from tapeloom.streaming import ordered as od
from tapeloom.streaming import runs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def feed(spark, folder, batches, schema):
    """One file per micro-batch, in order."""
    for n, rows in enumerate(batches):
        path = f"{folder}/{n:03d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + n * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drain(stream, folder):
    """Rows of an append stream, and the state rows left after every batch."""
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in run.recentProgress) if p["stateOperators"]]
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), left


def late(rows, seed, cuts=4, spread=40):
    """Micro-batches of rows (second, ...): each row up to ``spread`` seconds late, then a row that moves the watermark on."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[0] + rng.uniform(0, spread))
    edges = sorted(rng.sample(range(1, len(order)), cuts - 1))
    return [order[a:b] for a, b in zip([0, *edges], [*edges, len(order)])]


def at(second):
    return T0 + timedelta(seconds=second)


@pytest.mark.parametrize("seed", [1])
def test_quiet_runs_of_late_frames(spark, tmp_path, seed):
    rng = random.Random(seed)
    frames = [(i, f"r{k}", i, rng.random() < 0.6, i == 119 and k == 0) for k in range(3) for i in range(120)]
    batches = [[(r, at(s), i, q, z) for s, r, i, q, z in b] for b in late(frames, seed)]
    batches += [[("end", at(100_000), 0, False, False)], [("end", at(200_000), 1, False, False)]]
    stream = feed(spark, f"{tmp_path}/in", batches, "rec_id string, ts timestamp, frame_idx long, quiet boolean, last boolean")
    out, left = drain(od.quiet_runs(stream, watermark="1 minute", idle_ms=5000), str(tmp_path))
    want = []
    for k in range(3):
        a = None
        flags = [q for _, r, _, q, _ in frames if r == f"r{k}"] + [False]
        for i, q in enumerate(flags):
            if q and a is None:
                a = i
            elif not q and a is not None:
                want.append((f"r{k}", a, i))
                a = None
    assert sorted(tuple(r) for r in out.where("rec_id <> 'end'").collect()) == sorted(want)
    assert max(left) > 1 and left[-1] <= 2  # only the row that moved the watermark is still there


def test_frames_behind_the_watermark_and_holes(spark, tmp_path):
    """A frame that never comes ends a run once the watermark passed; one that comes later still is dropped."""
    rows = [[("r", at(0), 0, True), ("r", at(1), 1, True), ("r", at(3), 3, True)], [("x", at(500), 0, False)], [("x", at(600), 1, False)],
            [("r", at(2), 2, True)], [("x", at(9000), 2, False)], [("x", at(9900), 3, False)]]
    stream = feed(spark, f"{tmp_path}/in", rows, "rec_id string, ts timestamp, frame_idx long, quiet boolean")
    out, _ = drain(od.quiet_runs(stream, watermark="10 seconds", idle_ms=1_000_000), str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [("r", 0, 2), ("r", 3, 4)]


def test_order_check_across_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, k, i * 3 + k, float(rng.randint(0, 9))) for k in range(4) for i in range(60)]
    batches = [[(k, at(s), n, p) for s, k, n, p in b] for b in late(rows, 3)] + [[(-1, at(90_000), 0, 0.0)], [(-1, at(190_000), 1, 1.0)]]
    stream = feed(spark, f"{tmp_path}/in", batches, "rec_id long, ts timestamp, ordinal long, pts double")
    out, left = drain(od.order_violations(stream, "1 minute", 1000), str(tmp_path))
    want = []
    for k in range(4):
        own = [(n, p) for _, r, n, p in rows if r == k]
        want += [(k, n, p, q) for (_, q), (n, p) in zip(own, own[1:]) if p <= q]
    assert sorted(tuple(r) for r in out.where("rec_id >= 0").collect()) == sorted(want) and left[-1] <= 2


def test_recordings_of_a_shard_share_one_state(spark, tmp_path):
    """Many small recordings, some ended and some idle, cost no state row and no visit each."""
    rng = random.Random(9)
    rows = [(i * 5 + k % 7, f"r{k}", i, rng.random() < 0.6, i == 11 and k % 3 == 0) for k in range(40) for i in range(12)]
    batches = [[(r, at(s), i, q, z) for s, r, i, q, z in b] for b in late(rows, 4)]
    batches += [[("end", at(100_000), 0, False, False)], [("end", at(200_000), 1, False, False)]]
    stream = feed(spark, f"{tmp_path}/in", batches, "rec_id string, ts timestamp, frame_idx long, quiet boolean, last boolean")
    out, left = drain(od.ordered(stream, od.QuietRuns(), "frame_idx", "1 minute", idle_ms=5000, shards=3), str(tmp_path))
    want = []
    for k in range(40):
        flags = [q for _, r, _, q, _ in rows if r == f"r{k}"] + [False]
        edges = [i for i, q in enumerate(flags) if q != (i > 0 and flags[i - 1])]
        want += [(f"r{k}", a, b) for a, b in zip(edges[::2], edges[1::2])]
    assert sorted(tuple(r) for r in out.where("rec_id <> 'end'").collect()) == sorted(want)
    assert 1 < max(left) <= 3 and left[-1] <= 1


@pytest.mark.parametrize("tolerant", [False, True])
def test_repaired_blocks_equal_the_batch_form(spark, tmp_path, tolerant):
    rng = random.Random(7)
    rows, limits = [], []
    for k in range(3):
        begin, limit = 0, 0
        for i in range(25):
            size = rng.randint(0, 9)
            begin = max(0, begin + rng.randint(-4, 14))
            rows.append((i, k, i, begin, [float(rng.randint(1, 9)) for _ in range(size)]))
            begin += size
        limits.append((k, begin + (30, -5, 3)[k]))
    length = dict(limits)
    batches = [[(k, at(s), i, b, x, length[k], i == 24) for s, k, i, b, x in part] for part in late(rows, 11, spread=15)]
    stream = feed(spark, f"{tmp_path}/in", batches, "rec_id long, ts timestamp, block_idx long, first_sample long, samples array<double>, limit long, last boolean")
    out, left = drain(od.repaired_blocks(stream, 10, tolerant), str(tmp_path))
    samples, holes = od.split_outputs(out)
    blocks = spark.createDataFrame([(k, i, b, x) for _, k, i, b, x in rows], "rec_id long, block_idx long, first_sample long, samples array<double>")
    want, broken = fr.regularize_blocks(blocks, spark.createDataFrame(limits, "rec_id long, limit long"), 10, tolerant=tolerant)
    rows_of = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert rows_of(samples, "rec_id", "first_sample", "samples", "filler") == rows_of(want, "rec_id", "first_sample", "samples", "filler")
    assert rows_of(holes, "rec_id", "start", "end") == rows_of(broken, "rec_id", "start", "end")
    assert left[-1] == 0


def test_quiet_meter_for_any_cut(spark, tmp_path):
    """Blocks cut inside the 20 ms windows, late and in many batches: the report of the batch form."""
    rng = np.random.default_rng(3)
    rate, rows, spans = 1000, [], []
    for k in range(2):
        loud = np.repeat(rng.random(12) < 0.5, 400)[:4710]
        x = np.where(loud, 0.5, 0.0001) * np.sign(rng.normal(size=(2, len(loud))))
        begin, i = 0, 0
        while begin < x.shape[1]:
            n = int(rng.integers(1, 333))
            rows.append((i, k, i, x[:, begin : begin + n].tolist(), begin + n >= x.shape[1]))
            spans.append((k, begin, x[:, begin : begin + n].tolist()))
            begin, i = begin + n, i + 1
    batches = [[(k, at(s), i, x, z) for s, k, i, x, z in part] for part in late(rows, 4, spread=10)]
    stream = feed(spark, f"{tmp_path}/in", batches, "rec_id long, ts timestamp, block_idx long, samples array<array<double>>, last boolean")
    out, left = drain(od.live_quiet_meter(stream, rate, -40.0, 0.5), str(tmp_path))
    blocks = spark.createDataFrame(spans, "rec_id long, first_sample long, samples array<array<double>>")
    report, over = sg.quiet_meter(blocks, rate, -40.0, 0.5)
    got = sorted((r["rec_id"], r["longest"], r["within"]) for r in out.where("kind = 'report'").collect())
    assert got == sorted((r["rec_id"], r["max_detected_seconds"], r["within_limit"]) for r in report.collect())
    runs_ = sorted((r["rec_id"], round(r["start"], 9), round(r["end"], 9)) for r in out.where("kind = 'run'").collect())
    assert runs_ == sorted((r["rec_id"], round(r["start"], 9), round(r["end"], 9)) for r in over.collect()) and runs_
    assert left[-1] == 0


def test_append_mode_drops_late_rows_and_state(spark, tmp_path):
    """Windows and sessions are emitted once, when the watermark passed them, and leave the state."""
    rows = [[("a", at(s), 1.0 + s % 3) for s in range(0, 100, 5)], [("a", at(400), 2.0)], [("a", at(7), 30.0), ("a", at(410), 3.0)], [("z", at(90_000), 0.5)], [("z", at(190_000), 0.5)]]
    schema = "rec_id string, ts timestamp, value double"
    stream = feed(spark, f"{tmp_path}/a", rows, schema)
    out, left = drain(runs.stream_scores(stream, "50 seconds", watermark="30 seconds"), f"{tmp_path}/w")
    got = {int(r["start"].timestamp() - at(0).timestamp()): (r["n"], r["top"]) for r in out.where("rec_id = 'a'").collect()}
    assert got == {0: (10, 3.0), 50: (10, 3.0), 400: (2, 3.0)} and left[-1] <= 1
    merged, left = drain(runs.stream_merge(stream.withColumnRenamed("value", "seconds"), 4.0, "30 seconds"), f"{tmp_path}/m")
    got = sorted((r["start"].timestamp() - at(0).timestamp(), r["spans"]) for r in merged.where("rec_id = 'a'").collect())
    assert got == [(0.0, 20), (400.0, 1), (410.0, 1)] and left[-1] <= 1


def test_scan_goes_on_after_a_failure(spark, tmp_path):
    """The work fails in its third batch; the restart reads only what is left, and the table is whole."""
    for n in range(6):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02d}")
        for name in os.listdir(f"{tmp_path}/in/{n:02d}"):
            os.utime(f"{tmp_path}/in/{n:02d}/{name}", (1_700_000_000 + n * 10,) * 2)
    flag = f"{tmp_path}/broken"
    open(flag, "w").close()

    def work(df):
        def run(batches):
            for b in batches:
                if os.path.exists(flag) and (b["id"] == 25).any():
                    raise RuntimeError("model lost")
                yield b.assign(twice=b["id"] * 2)

        return df.mapInPandas(run, "id long, twice long")

    start = lambda: od.restartable_scan(spark, f"{tmp_path}/in/*", "id long", work, f"{tmp_path}/out", f"{tmp_path}/state", files=1)
    first = start()
    with pytest.raises(Exception, match="model lost"):
        first.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(20))
    os.remove(flag)
    second = start()
    second.awaitTermination()
    assert sum(p["numInputRows"] for p in second.recentProgress) == 40
    spark.range(60, 70).coalesce(1).write.parquet(f"{tmp_path}/in/99")
    start().awaitTermination()
    rows = sorted((r["id"], r["twice"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert rows == [(i, 2 * i) for i in range(70)]
