"""Readers, sinks, memoised scoring, packets and the shape of plans."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import intervals as iv
from tapeloom.operators import packets as pk
from tapeloom.operators import scan
from tapeloom.operators import scoring as sc
from tapeloom.sources import readers, reports

from helpers import merge


def test_jsonl_torn_tail(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.jsonl").write_text('{"offset": 0}\n{"offset": 600}\n{"offs\n\n  \n')
    (good / "b.jsonl").write_text('{"offset": 5}\n')
    got = readers.read_resumable_jsonl(spark, str(good), "offset long")
    assert sorted(r["offset"] for r in got.collect()) == [0, 5, 600]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.jsonl").write_text('{"offset": 0}\n{"offs\n{"offset": 600}\n')
    with pytest.raises(Exception, match="broken line"):
        readers.read_resumable_jsonl(spark, str(bad), "offset long").collect()


def test_score_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"description": "x", "rows": [{"start": 0, "end": 3, "semantic": {"mouth": 0.5}}, {"start": 1, "end": 4, "top": {"Speech": 0.25}}]}')
    rows = readers.read_scores(spark, str(tmp_path)).orderBy("start").collect()
    assert rows[0]["semantic"] == {"mouth": 0.5} and rows[1]["top"] == {"Speech": 0.25}


def test_partition_overwrite_keeps_others(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "rec_id string, v int")
    reports.overwrite_partitions(df, path)
    reports.overwrite_partitions(spark.createDataFrame([("b", 3)], "rec_id string, v int"), path)
    assert sorted((r["rec_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_chapter_files(spark, tmp_path):
    rows = spark.createDataFrame(
        [("r", 1, 0.0, 65.0, "tapping", [], 0), ("r", 2, 65.0, 3700.0, "mixed", ["brushing", "tapping"], 2)],
        "rec_id string, index int, start double, end double, category string, alternatives array<string>, review_findings int",
    )
    reports.write_chapters(rows, str(tmp_path / "c"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "c" / "text")).collect()]
    assert lines[0].startswith("00:00:00 — 00:01:05") and "、" in lines[1] and lines[1].endswith("含待复听位置")


def test_scorer_sees_each_missing_window_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def scorer(batches):
        for b in batches:
            seen.add(len(b))
            yield b[["rec_id", "key"]].assign(scores=[{"x": s} for s in b["start"]])

    w = spark.createDataFrame([("r", 1.0, 2.0), ("r", 1.0, 2.0), ("r", 3.0, 4.0), ("r", 1.000001, 2.0)], "rec_id string, start double, end double")
    empty = spark.createDataFrame([], "rec_id string, key string, model string, scores map<string,double>")
    rows, fresh = sc.score_missing(w, empty, scorer, "m")
    assert rows.count() == 4 and rows.where("scores is null").count() == 0 and fresh.count() == 2 and seen.value == 2
    stored = fresh.unionByName(fresh)  # an append-only cache after a retry
    again, more = sc.score_missing(w, stored, scorer, "m")
    assert again.count() == 4 and more.count() == 0
    assert sc.score_missing(w, stored, scorer, "other")[1].count() == 2


def trim(keeps, quiet, budget):
    joined, at = [], 0.0
    for a, b in keeps:
        joined += [[at + max(a, c) - a, at + min(b, d) - a] for c, d in quiet if min(b, d) > max(a, c)]
        at += b - a
    cuts = [[a + budget / 2, b - budget / 2] for a, b in merge(joined, 1e-8) if b - a > budget + 1e-8]
    gone, at = [], 0.0
    for a, b in keeps:
        gone += [[a + max(0, c - at), a + min(b - a, d - at)] for c, d in cuts if d > at and c < at + b - a]
        at += b - a
    return gone


def test_limit_groups_against_loop(spark):
    rng = random.Random(6)
    aligned, groups, quiet, want = [], [], [], {}
    for r in range(6):
        mine, pieces, at = [], [], 0.0
        q = [[float(a), a + rng.choice([0.3, 0.8, 1.7, 2.5])] for a in range(0, 40, 3) if rng.random() < 0.7]
        quiet += [(r, a, b) for a, b in q]
        for g in range(30):
            mine.append((g * 25, (g + 1) * 25, float(g), g + 1.0))
        groups += [(r, *g) for g in mine]
        for first, last in ((0, 12), (15, 30)):
            aligned.append((r, float(first), float(last), first * 25, last * 25, float(first), float(last)))
            pieces += [[g, first] for g in range(first, last)]
        spans = lambda p: [[float(g), g + 1.0] for g, _ in p]
        if trim([[0.0, 12.0], [15.0, 30.0]], q, 1.0):
            while pieces:
                gone = trim(spans(pieces), q, 1.0)
                if not gone:
                    break
                pieces = [p for p in pieces if not any(min(p[0] + 1, d) > max(p[0], c) + 1e-8 for c, d in gone)]
        want[r] = sorted(g for g, _ in pieces)
    out = pk.limit_groups(
        spark.createDataFrame(aligned, "rec_id int, source_start double, source_end double, first long, stop long, analysis_start double, analysis_end double"),
        spark.createDataFrame(groups, "rec_id int, first long, stop long, start double, end double"),
        spark.createDataFrame(quiet, "rec_id int, start double, end double"),
        1.0,
        chunk=8.0,
    ).collect()
    for r in want:
        got = sorted(g for x in out if x["rec_id"] == r for g in range(x["first"] // 25, x["stop"] // 25))
        assert got == want[r]


def test_hot_recording_is_split(spark):
    """A recording with all rows is scanned by many tasks and still gives the exact answer."""
    rows = spark.range(60_000).select(F.lit("hot").alias("rec_id"), (F.col("id") * 3.0).alias("start"), (F.col("id") * 3.0 + F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0)).alias("end"))
    merged = iv.merge(rows, 0, chunk=600.0)
    assert merged.count() == 30_000
    spread = rows.withColumn("_ck", scan.slot(F.col("start"), 600.0)).groupBy("_ck").count().agg(F.max("count")).first()[0]
    assert spread <= 200
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition" in line]
    # Every window over rows is partitioned by the chunk; only chunk summaries use the recording alone.
    assert windows and all("_ck" in line for line in windows)
