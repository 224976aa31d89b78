"""Results that must not depend on caps, cuts of blocks or page sizes."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.catalog import frame_queries
from tapeloom.catalog.plan_queries import _noise
from tapeloom.operators import intervals as iv
from tapeloom.operators import packets as pk
from tapeloom.operators import scoring as sc
from tapeloom.operators import signal
from tapeloom.operators.sequences import _consumed
from tapeloom.plans import review as rv


def test_review_runs_the_requested_passes(spark):
    recs = spark.createDataFrame([("a", 0.5, 100.0, 5), ("b", 0.5, 100.0, 2)], "rec_id string, dt double, duration double, review_max_passes int")
    none = spark.createDataFrame([], "rec_id string, start double, end double")
    plan = lambda r, s: r.select("rec_id", F.lit(0).cast("long").alias("start"), F.lit(200).cast("long").alias("end"))
    check = lambda k, n: k.select("rec_id").distinct().where(F.lit(n < 5)).select("rec_id", F.lit(1.0).alias("start"), F.lit(2.0).alias("end"))
    status, _ = rv.review_loop(recs, none, plan, check)
    assert {r["rec_id"]: (r["status"], r["passes"]) for r in status.collect()} == {"a": ("passed", 5), "b": ("needs_review", 2)}


def test_quiet_meter_is_blind_to_cuts(spark):
    x = np.ones(400)
    x[31:240] = 0.0
    found = []
    for cuts in ([400], [15, 400], [7, 133, 250, 400]):
        at, rows = 0, []
        for end in cuts:
            rows.append(("r", at, [x[at:end].tolist(), (x[at:end] / 2).tolist()]))
            at = end
        blocks = spark.createDataFrame(rows, "rec_id string, first_sample long, samples array<array<double>>")
        report, over = signal.quiet_meter(blocks, 200, -20.0, 0.5, window=0.02)
        found.append((report.collect()[0]["max_detected_seconds"], [tuple(r) for r in over.collect()]))
    assert found[0] == found[1] == found[2] and found[0][0] == 1.04


def test_prompts_need_their_own_idx(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    prompts = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "idx int, embedding array<double>")
    assert sc.cosine_scores(v, prompts).collect()[0]["values"] == [1.0, 2.0, 3.0]
    for bad in (prompts.unionByName(prompts.limit(1)), None):
        with pytest.raises(ValueError):
            sc.cosine_scores(v, prompts if bad is None else bad, 2 if bad is None else 10)


def test_consumed_hits_against_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for r in range(3):
        first = np.sort(rng.choice(600, 120, replace=False))
        stop = first + rng.integers(5, 40, 120)
        rows += [(r, int(a), int(b)) for a, b in zip(first, stop)]
        free = -1
        for a, b in zip(first, stop):
            if a >= free:
                want.add((r, int(a)))
                free = b
    hits = spark.createDataFrame(rows, "rec_id int, first long, stop long")
    assert {tuple(x) for x in _consumed(hits, 80, ["rec_id"], 64).collect()} == want


def test_status_of_limited_groups(spark):
    cols = "rec_id int, first long, stop long"
    before = spark.createDataFrame([(1, 0, 50), (2, 0, 50), (3, 0, 50)], cols)
    after = spark.createDataFrame([(1, 0, 50), (2, 0, 25)], cols)
    assert {r["rec_id"]: r["status"] for r in pk.limit_status(before, after).collect()} == {1: "kept", 2: "cut", 3: "empty"}


def test_log_mel_says_what_it_cuts(spark):
    df = spark.createDataFrame([(n, [1] * n) for n in (100, 720, 1200)], "n int, samples array<int>")
    got = {r["n"]: (r["truncated"], r["features"] is None) for r in signal.log_mel(df, frames=3).collect()}
    assert got == {100: (False, True), 720: (False, False), 1200: (True, False)}


def test_log_mel_hands_on_few_windows_at_a_time(spark, monkeypatch):
    """A batch of many windows must not become one batch of features, each half a megabyte."""
    rows = [(n, [(n * 31 + i) % 97 - 48 for i in range(600 if n % 5 else 100)]) for n in range(50)]
    df = spark.createDataFrame(rows, "n int, samples array<int>")
    got = {r["n"]: r["features"] for r in signal.log_mel(df.coalesce(1), frames=3).collect()}
    assert {n for n, f in got.items() if f is None} == set(range(0, 50, 5)) and len(got) == 50
    alone = signal.log_mel(df.where("n = 17"), frames=3).collect()[0]["features"]
    assert got[17] == alone and len(alone) == 3

    stage = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: stage.append(f) or self)
    signal.log_mel(df, frames=3)
    whole = pa.RecordBatch.from_pydict({"n": [r[0] for r in rows], "truncated": [False] * 50, "samples": [r[1] for r in rows]})
    sizes = [b.num_rows for b in stage[0](iter([whole]))]
    assert sum(sizes) == 50 and max(sizes) <= 16


def test_log_mel_of_whole_recordings(spark, tmp_path):
    """Every frame of a recording counts, also one that crosses the end of a block of 800 samples."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(64) * 0.1).tolist(), 0) for i in [*range(57), 99]]  # 3200, 448 and 64 samples
    rows[56] = (56, rows[56][1][:40], 0)
    rows = spark.createDataFrame([*rows[:57], (150, rows[57][1], 0)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["rec_id"], r["block_idx"]): r for r in frame_queries.signal_log_mel(spark, str(tmp_path)).collect()}
    want = {}
    for rec in (0, 1, 3):
        x = np.concatenate([np.float64(r["embedding"]) for r in rows.where(f"vec_id div 50 = {rec}").orderBy("vec_id").collect()])
        for t in range(0, len(x) - 399, 160):
            f = x[t : t + 400] - x[t : t + 400].mean()
            f = np.concatenate([f[:1], f[1:]]) - 0.97 * np.concatenate([f[:1], f[:-1]])
            power = np.abs(np.fft.rfft(f * np.hanning(400), 512)) ** 2
            mel = (np.log(np.maximum(1.192092955078125e-07, power @ signal.mel_bank())) + 4.2677393) / (2 * 4.5689974)
            want.setdefault((rec, t // 800), []).append(mel)
    assert sum(map(len, want.values())) == 18 + 1 and set(got) == {*want, (3, 0)}
    assert {k: r["frames"] for k, r in got.items()} == {**{k: len(m) for k, m in want.items()}, (3, 0): 0}
    assert got[3, 0]["mean"] is None and got[3, 0]["spread"] is None and not any(r["truncated"] for r in got.values())
    for k, m in want.items():
        assert abs(got[k]["mean"] - 1000 * np.mean(m)) < 1 and abs(got[k]["spread"] - 1000 * np.std(m)) < 1


def test_noise_is_made_a_few_blocks_at_a_time():
    rows = pd.DataFrame({"o_orderkey": range(1000), "rec_id": 0, "i": range(1000)})
    parts = list(_noise(iter([rows])))
    assert max(map(len, parts)) <= 128
    whole = pd.concat(parts, ignore_index=True)
    assert whole["i"].tolist() == list(range(1000))
    at = lambda n, p: (n * 4000 + (p - p % 32 if 200 <= n % 400 < 240 else p)) * 48271 % 65537 % 8001 - 4000
    for n in (0, 127, 128, 210, 999):
        assert np.frombuffer(whole["samples"][n], "<i2").tolist() == [at(n, p) for p in range(4000)]


def test_chunk_in_another_unit_is_an_error(spark):
    df = spark.createDataFrame([("r", 0.0, 86_400_000_000.0)], "rec_id string, start double, end double")
    with pytest.raises(Exception, match="chunks"):
        iv.merge(df, 0).count()
    assert iv.merge(df, 0, chunk=600_000_000).count() == 1
