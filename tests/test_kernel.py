"""Interval kernel against brute force on seeded random rows; chunks far smaller than the data."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import intervals as iv
from tapeloom.operators import joins, scan

from helpers import by_recording, gaps, merge, minus

KEYS = [f"r{i}" for i in range(8)]


def rows(seed, floats=False, count=14):
    rng = random.Random(seed)
    out = []
    for key in KEYS[:-1]:
        for _ in range(rng.randint(0, count)):
            a = rng.randint(0, 90)
            b = a + rng.choice([-2, 0, 1, 2, 3, 5, 8, 40])
            out.append((key, a + 0.25, b + 0.25) if floats else (key, a, b))
    return out


def frame(spark, data, floats=False):
    kind = "double" if floats else "long"
    return spark.createDataFrame(data, f"rec_id string, start {kind}, end {kind}").repartition(3)


def grouped(data):
    out = {}
    for k, a, b in data:
        out.setdefault(k, []).append([a, b])
    return out


@pytest.mark.parametrize("floats", [False, True])
@pytest.mark.parametrize("gap", [0, 1, 25])
def test_merge(spark, gap, floats):
    data = rows(3 + gap, floats)
    got = by_recording(iv.merge(frame(spark, data, floats), gap, chunk=7), "start", "end")
    want = {k: m for k, v in grouped(data).items() if (m := merge(v, gap))}
    assert got == want


def test_complement_keeps_empty_recordings(spark):
    data = rows(11)
    recs = spark.createDataFrame([(k, 100) for k in KEYS], "rec_id string, duration long")
    got = by_recording(iv.complement(frame(spark, data), recs, chunk=9), "start", "end")
    want = {k: gaps(grouped(data).get(k, []), 100) for k in KEYS}
    assert got == {k: v for k, v in want.items() if v}
    assert got[KEYS[-1]] == [[0, 100]]


def test_subtract_and_self(spark):
    left, right = rows(21), rows(22)
    got = by_recording(iv.subtract(frame(spark, left), frame(spark, right), chunk=10), "start", "end")
    other = grouped(right)
    want = {k: m for k, v in grouped(left).items() if (m := minus([x for x in v if x[1] > x[0]], other.get(k, [])))}
    assert got == want
    assert iv.subtract(frame(spark, left), frame(spark, left), chunk=10).count() == 0


def test_merge_is_idempotent_and_complement_twice(spark):
    data = rows(31)
    once = iv.merge(frame(spark, data), chunk=6)
    assert by_recording(iv.merge(once, chunk=11), "start", "end") == by_recording(once, "start", "end")
    recs = spark.createDataFrame([(k, 60) for k in KEYS], "rec_id string, duration long")
    twice = iv.complement(iv.complement(frame(spark, data), recs, chunk=6), recs, chunk=13)
    clipped = [(k, a, min(b, 60)) for k, a, b in data]
    want = {k: m for k, v in grouped(clipped).items() if (m := merge(v))}
    assert by_recording(twice, "start", "end") == want


def test_overlap_length_and_friends(spark):
    left, right = rows(41), rows(42)
    left = [(k, a, b, i) for i, (k, a, b) in enumerate(left)]
    l = spark.createDataFrame(left, "rec_id string, start long, end long, id long")
    r = frame(spark, right)
    other = {k: merge(v) for k, v in grouped(right).items()}
    length = {i: sum(max(0, min(b, d) - max(a, c)) for c, d in other.get(k, [])) if b > a else 0 for k, a, b, i in left}
    got = {x["id"]: x["overlap"] for x in iv.overlap_length(l, r, ["id"], chunk=8).collect()}
    assert got == length
    solid = [x for x in left if x[2] > x[1]]
    hit = {x["id"] for x in iv.overlapping(l, r, ["id"], chunk=8).collect()}
    assert hit == {i for k, a, b, i in solid if any(c < b and d > a for c, d in grouped(right).get(k, []) if d > c)}
    free = {x["id"] for x in iv.unblocked(l, r, ["id"], chunk=8).collect()}
    assert free == {i for k, a, b, i in left if length[i] < b - a - 1e-6}


def test_covered_needs_one_interval(spark):
    left, right = rows(51), rows(52)
    l = spark.createDataFrame([(k, a, b, i) for i, (k, a, b) in enumerate(left)], "rec_id string, start long, end long, id long")
    got = {x["id"]: x["covered"] for x in iv.covered(l, frame(spark, right), chunk=5).collect()}
    for i, (k, a, b) in enumerate(left):
        assert got[i] == (b > a and any(c <= a and d >= b for c, d in grouped(right).get(k, [])))


def test_range_join_pairs(spark):
    left, right = rows(61), rows(62)
    pairs = joins.range_join(frame(spark, left), frame(spark, right), chunk=7).collect()
    got = sorted((p["l"]["start"], p["l"]["end"], p["r"]["start"], p["r"]["end"], p["rec_id"]) for p in pairs)
    want = sorted(
        (a, b, c, d, k)
        for k, a, b in left
        for j, c, d in right
        if j == k and b > a and d > c and c < b and d > a
    )
    assert got == want


def test_stab_ends(spark):
    ranges = spark.createDataFrame([("r", 0, 5), ("r", 5, 9), ("r", 5, 9)], "rec_id string, lo long, hi long")
    points = spark.createDataFrame([("r", 0), ("r", 5), ("r", 9), ("r", 20)], "rec_id string, t long")
    for lo_open in (False, True):
        for hi_open in (False, True):
            got = sorted(
                (x["range"]["lo"], x["point"]["t"])
                for x in joins.stab(ranges, points, "t", "lo", "hi", chunk=3, lo_open=lo_open, hi_open=hi_open).collect()
            )
            want = sorted(
                (lo, t)
                for lo, hi in [(0, 5), (5, 9), (5, 9)]
                for t in (0, 5, 9, 20)
                if (t > lo if lo_open else t >= lo) and (t < hi if hi_open else t <= hi)
            )
            assert got == want


def test_split_by(spark):
    left, right = rows(71), rows(72)
    l = spark.createDataFrame([(k, a, b, i) for i, (k, a, b) in enumerate(left)], "rec_id string, start long, end long, id long")
    got = iv.split_by(l, frame(spark, right), ["id"], chunk=6).collect()
    for i, (k, a, b) in enumerate(left):
        mine = [x for x in got if x["id"] == i]
        rest = minus([[a, b]] if b > a else [], grouped(right).get(k, []))
        taken = minus([[a, b]] if b > a else [], rest)
        assert sorted([x["start"], x["end"]] for x in mine if not x["permitted"]) == rest
        assert sorted([x["start"], x["end"]] for x in mine if x["permitted"]) == taken


def test_running_and_neighbours(spark):
    rng = random.Random(5)
    data = [(k, t * 1.5, rng.randint(-5, 5) if rng.random() > 0.2 else None) for k in KEYS for t in sorted(rng.sample(range(200), 40))]
    df = spark.createDataFrame(data, "rec_id string, t double, v long").repartition(5)
    scans = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "z": ("last", F.col("v"))}
    got = {(x["rec_id"], x["t"]): x for x in scan.running(df, scans, ["t"], chunk=4).collect()}
    near = {(x["rec_id"], x["t"]): x for x in scan.neighbours(df, ["t"], before=3, after=2, fields=["t"], chunk=4).collect()}
    for k in KEYS:
        mine = [(t, v) for r, t, v in data if r == k]
        for i, (t, v) in enumerate(mine):
            seen = [x for _, x in mine[:i] if x is not None]
            row = got[(k, t)]
            assert row["s"] == (sum(seen) if seen else None)
            assert row["m"] == (max(seen) if seen else None)
            assert row["z"] == (seen[-1] if seen else None)
            assert [x["t"] for x in near[(k, t)]["prev"]] == [x for x, _ in mine[max(0, i - 3) : i]]
            assert [x["t"] for x in near[(k, t)]["next"]] == [x for x, _ in mine[i + 1 : i + 3]]


def test_islands(spark):
    rng = random.Random(9)
    data = [(k, float(t), t + 2.0, rng.random() > 0.3) for k in KEYS for t in sorted(rng.sample(range(80), 45))]
    df = spark.createDataFrame(data, "rec_id string, start double, end double, ok boolean").repartition(4)
    runs = scan.islands(
        df,
        {"start": ("first", F.col("start")), "end": ("last", F.col("end")), "n": ("count", F.lit(1)), "ok": ("first", F.col("ok"))},
        lambda p, c: ~p["ok"] | ~c["ok"] | (c["start"] > p["end"]),
        uses=["start", "end", "ok"],
        chunk=5,
    ).where("ok")
    want = {}
    for k in KEYS:
        run, out = [], []
        for _, a, b, ok in [d for d in data if d[0] == k]:
            if run and (not ok or a > run[-1][1]):
                out.append([run[0][0], run[-1][1], len(run)])
                run = []
            if ok:
                run.append((a, b))
        if run:
            out.append([run[0][0], run[-1][1], len(run)])
        want[k] = out
    assert by_recording(runs, "start", "end", "n") == want
