"""What joins and scans shuffle grows with their inputs, not with pairs, frames looked at or readers."""

import numpy as np
from pyspark.sql import functions as F

from tapeloom.operators import intervals as iv
from tapeloom.operators import joins
from tapeloom.operators import packets as pk
from tapeloom.plans import planning as pl


def shuffled(spark, work):
    """What ``work`` returns, and how many rows it put into shuffles."""
    scala = spark.sparkContext._jsc.sc()
    none = spark._jvm.java.util.ArrayList()

    def total():
        scala.listenerBus().waitUntilEmpty()
        quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = scala.statusStore().stageList(none, False, False, quantiles, none)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    found = work()
    return found, sum(n for stage, n in total().items() if stage not in before)


def test_pairs_of_ranges_and_points_are_not_shuffled(spark, request):
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    points = spark.range(1000).select(F.lit("r").alias("rec_id"), F.col("id").alias("p"), (F.col("id") * 0.5).alias("at"))
    ranges = spark.range(60).select(F.lit("r").alias("rec_id"), F.col("id").alias("k"), F.col("id").cast("double").alias("lo"), (F.col("id") + 400.25).alias("hi"))
    pairs = joins.stab(ranges, points, "at", "lo", "hi")
    got, rows = shuffled(spark, lambda: [(r["k"], r["p"]) for r in pairs.select("range.k", "point.p").collect()])
    assert sorted(got) == [(k, p) for k in range(60) for p in range(1000) if k <= p * 0.5 <= k + 400.25]
    assert len(got) > 45_000 and rows < 5_000


def test_packs_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "PACK", 3)
    rng = np.random.default_rng(11)
    at = [(int(r), int(t)) for r, t in zip(rng.integers(0, 2, 90), rng.integers(0, 60, 90))]
    spans = [(int(r), int(a), int(a + n)) for r, a, n in zip(rng.integers(0, 2, 40), rng.integers(0, 60, 40), rng.integers(-2, 30, 40))]
    spans += spans[:5]
    points = spark.createDataFrame([(r, t, i) for i, (r, t) in enumerate(at)], "rec_id int, at long, i int")
    ranges = spark.createDataFrame(spans, "rec_id int, lo long, hi long")
    for lo_open in (False, True):
        for hi_open in (False, True):
            got = joins.stab(ranges, points, "at", "lo", "hi", chunk=16, lo_open=lo_open, hi_open=hi_open).collect()
            want = [
                (r, a, b, i) for r, a, b in spans for i, (q, t) in enumerate(at)
                if q == r and (a < t if lo_open else a <= t) and (t < b if hi_open else t <= b) and a <= b
            ]
            assert sorted((x["rec_id"], x["range"]["lo"], x["range"]["hi"], x["point"]["i"]) for x in got) == sorted(want)


def test_quiet_cut_does_not_repeat_an_edge_for_its_frames(spark):
    rng = np.random.default_rng(5)
    wide = [float(x) for x in rng.integers(-80, -20, 400)]
    # Some frames are missing, and long stretches are equally quiet.
    known = [f for f in range(400) if f % 11 != 4]
    levels = spark.createDataFrame([(1, f, wide[f], wide[f]) for f in known], "rec_id int, frame_idx long, db double, wide double")
    rows = [(1, float(t) / 4, side, 0.5, 400) for t in range(0, 800, 2) for side in ("start", "end")]
    edges = spark.createDataFrame(rows, "rec_id int, time double, side string, dt double, n long")
    cut = pl.quiet_cut(edges, levels, ["rec_id", "time", "side"])
    got, sent = shuffled(spark, lambda: {(r["time"], r["side"]): r["frame"] for r in cut.collect()})
    want = {}
    for _, t, side, dt, n in rows:
        pos = max(0, min(n - 1, int(np.ceil(t / dt) if side == "start" else np.floor(t / dt))))
        near = range(pos, min(n - 1, pos + 12) + 1) if side == "start" else range(max(0, pos - 12), pos + 1)
        costs = [(max(wide[f], -62.0) + abs(f - pos) * dt * 1.2, f) for f in near if f % 11 != 4]
        if costs:
            want[t, side] = min(costs)[1]
    assert got == want
    assert sent < 5 * len(rows)


def test_keyframe_groups_shuffle_packets_once(spark):
    rows = spark.range(6000).select(
        F.pmod("id", F.lit(3)).alias("rec_id"), F.expr("id div 3").alias("ordinal"), (F.expr("id div 3") * 2.0).alias("pts"),
        F.lit(2.0).alias("duration"), (F.pmod(F.expr("id div 3"), F.lit(50)) == 0).alias("is_key"),
    )
    got, sent = shuffled(spark, lambda: pk.keyframe_groups(rows, block=128).collect())
    assert sorted((r["rec_id"], r["first"], r["stop"], r["start"], r["end"]) for r in got) == [
        (k, a, a + 50, a * 2.0, a * 2.0 + 100) for k in range(3) for a in range(0, 2000, 50)
    ]
    assert sent < 2 * 6000


def test_disjoint_sets_meet_in_one_pass(spark):
    rng = np.random.default_rng(21)

    def spans(seed):
        at, out = 0, []
        for n in range(200):
            a = at + int(rng.integers(0, 4))
            at = a + int(rng.integers(1, 40))
            out.append((0, a, at, n + seed))
        return out

    left, right = spans(0), spans(1000)
    frames = [spark.createDataFrame(x, f"rec_id long, start long, end long, {c} long") for x, c in ((left, "i"), (right, "j"))]
    got, sent = shuffled(spark, lambda: [tuple(r) for r in iv.intersect_disjoint(*frames, chunk=64).select("l.i", "r.j", "start", "end").collect()])
    want = [(i, j, max(a, c), min(b, d)) for _, a, b, i in left for _, c, d, j in right if min(b, d) > max(a, c)]
    assert sorted(got) == sorted(want) and len(want) > 200
    _, paired = shuffled(spark, lambda: iv.intersect(*frames, chunk=64).collect())
    assert sent < paired / 2
