"""Splices against exact fractions and a plain loop."""

import random
from bisect import bisect_right
from fractions import Fraction

from pyspark.sql import functions as F

from tapeloom.functions.clock import whole_ticks
from tapeloom.operators import packets as pk


def test_whole_ticks_are_exact(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        num, den = rng.choice([(1, 90000), (1, 44100), (1001, 30000), (1, 1000), (3, 7), (2, 1), (1, 8)])
        seconds = rng.choice([rng.uniform(-5e4, 5e4), rng.randint(-9999, 9999) / 8, rng.randint(-9999, 9999) / 16, rng.uniform(-1, 1) * 1e-4, float(rng.randint(-99, 99)), round(rng.uniform(-100, 100), 3)])
        rows.append((seconds, num, den))
    df = spark.createDataFrame(rows, "s double, num long, den long").withColumn("t", whole_ticks(F.col("s"), F.col("num"), F.col("den")))
    wrong = [(r, round(Fraction(str(r["s"])) * r["den"] / r["num"])) for r in df.collect() if r["t"] != round(Fraction(str(r["s"])) * r["den"] / r["num"])]
    assert not wrong


MAPPING = "rec_id int, seq long, source_start double, source_end double, output_start double, first long, stop long"
PACKETS = "rec_id int, stream string, ordinal long, pts long, dts long, duration long, num long, den long, size long"


def splice(packets, mapping):
    """Kept packets and faults of one recording, packet by packet in decode order."""
    kept, faults, last = [], [], {}
    starts, firsts = [m[0] for m in mapping], [m[3] for m in mapping]
    for stream, ordinal, pts, dts, duration, num, den, size in packets:
        if not size:
            continue
        if pts is None:
            faults.append((stream, ordinal, None, "no presentation time"))
            continue
        if stream == "audio" and duration <= 0:
            faults.append((stream, ordinal, None, "audio without duration"))
            continue
        second = pts * num / den
        j = (bisect_right(firsts, ordinal) if stream == "video" else bisect_right(starts, second + 1e-8)) - 1
        if j < 0 or (ordinal >= mapping[j][4] if stream == "video" else second + duration * num / den > mapping[j][1] + 1e-7):
            continue
        shift = round(Fraction(str(mapping[j][2] - mapping[j][0])) * den / num)
        kept.append((stream, ordinal, j, pts + shift, None if dts is None else dts + shift))
        if dts is None:
            faults.append((stream, ordinal, j, "no decode time"))
            continue
        if stream in last and dts + shift <= last[stream]:
            faults.append((stream, ordinal, j, "decode time does not rise"))
        last[stream] = dts + shift
    found = {(s, j) for s, _, j, _, _ in kept}
    faults += [(s, None, j, "interval without packets") for s in ("audio", "video") for j in range(len(mapping)) if (s, j) not in found]
    return kept, faults


def test_splice_against_a_loop(spark):
    rng = random.Random(4)
    packets, mappings, kept, faults = [], [], [], []
    for rec in range(5):
        num, den = rng.choice([(1, 90000), (1001, 30000), (1, 600)])
        mine, mapping, out, first = [], [], 0.0, 2
        at = 0.1 * rec
        for _ in range(6):
            start, stop = at + rng.choice([0.0, 0.3, 1.37]), first + rng.randint(1, 9)
            end = start + rng.choice([0.05, 1.0, 2.48])
            mapping.append((start, end, out, first, stop))
            out, at, first = out + end - start, end + 0.4, stop + rng.randint(0, 4)
        for k in range(70):
            ticks = k * 0.2 * den / num
            size = rng.choice([0, 10, 20, 30, 40])
            mine.append(("video", k, None if k % 31 == 7 else round(ticks) + k % 3, None if k % 29 == 4 else round(ticks) - (4000 if k % 17 == 3 else 2), round(0.2 * den / num), num, den, size))
            mine.append(("audio", k, round(k * 0.2 * 44100), k * 8820, 0 if k % 23 == 5 else 8820, 1, 44100, size))
        packets += [(rec, *p) for p in mine]
        mappings += [(rec, j, *m) for j, m in enumerate(mapping)]
        a, b = splice(mine, mapping)
        kept += [(rec, *r) for r in a]
        faults += [(rec, *r) for r in b]
    df = spark.createDataFrame(packets, PACKETS).repartition(3)
    got, wrong = pk.splice_packets(df, spark.createDataFrame(mappings, MAPPING), chunk=3.0, block=16)
    rows = got.select("rec_id", "stream", "ordinal", "seq", "output_pts", "output_dts").collect()
    assert sorted(str(tuple(r)) for r in rows) == sorted(map(str, kept))
    assert sorted(str(tuple(r)) for r in wrong.collect()) == sorted(map(str, faults))
    assert {f[-1] for f in faults} == {"no presentation time", "audio without duration", "no decode time", "decode time does not rise", "interval without packets"}


def test_audio_alone_needs_no_video(spark):
    mapping = spark.createDataFrame([(1, 0, 0.0, 1.0, 0.0, None, None), (1, 1, 2.0, 3.0, 1.0, None, None)], MAPPING)
    rows = [(1, "audio", i, i * 100, i * 100, 100, 1, 1000, 5) for i in range(25)]
    kept, faults = pk.splice_packets(spark.createDataFrame(rows, PACKETS), mapping)
    assert faults.count() == 0
    segments = pk.splice_segments(kept, mapping)
    assert [(r["audio_packets"], round(r["audio_end_gap"], 9)) for r in segments.orderBy("seq").collect()] == [(10, 0.0), (5, 0.5)]
    report = pk.splice_report(segments).first()
    assert round(report["max_audio_boundary_gap"], 9) == 0.5 and report["average_bitrate"] == 15 * 5 * 8 / 2.0
