"""Sets of tables published together, and scores that outlive a failing scorer."""

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import scoring as sc
from tapeloom.sources import published as pb
from tapeloom.sources import reports


def rows(spark, n, mark):
    at = F.col("id").cast("double")
    return spark.range(n).select(F.lit("r").alias("rec_id"), F.col("id").alias("seq"), at.alias("start"), (at + 1).alias("end"), at.alias("time"), at.alias("source_start"), at.alias("source_end"),
                                 at.alias("output_start"), at.alias("output_end"), F.lit(mark).alias("reason"), F.lit(mark).alias("decision"))


def test_a_failing_report_leaves_the_old_set(spark, tmp_path):
    root = str(tmp_path / "set")
    assert pb.current(spark, root)["number"] == -1
    assert reports.published_report(spark, root, "cut_list").count() == 0
    assert reports.publish_reports({n: rows(spark, 3, "old") for n in reports.REPORTS}, root, note={"run": 1}) == 0
    last = list(reports.REPORTS)[-1]
    broken = rows(spark, 5, "new").withColumn("reason", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        reports.publish_reports({n: broken if n == last else rows(spark, 5, "new") for n in reports.REPORTS}, root)
    assert pb.current(spark, root)["note"] == {"run": 1}
    for name in reports.REPORTS:
        got = reports.published_report(spark, root, name).collect()
        assert len(got) == 3 and all(r["rec_id"] == "r" for r in got)
        if "reason" in got[0].asDict():
            assert {r["reason"] for r in got} == {"old"}
    assert len(pb.sweep(spark, root)) == len(reports.REPORTS) - 1 + 1  # what the failed run left
    assert reports.publish_reports({n: rows(spark, 5, "new") for n in reports.REPORTS}, root) == 1
    assert reports.published_report(spark, root, last).count() == 5 and reports.published_report(spark, root, last, number=0).count() == 3
    pb.sweep(spark, root, keep=1)
    assert reports.published_report(spark, root, last).count() == 5


def test_of_two_writers_one_is_told(spark, tmp_path):
    root = str(tmp_path / "race")
    pb.commit(spark, root, -1, {"t": []})
    assert pb.commit(spark, root, 0, {"t": ["a"]}) == 1
    with pytest.raises(pb.Conflict):
        pb.commit(spark, root, 0, {"t": ["b"]})
    assert pb.current(spark, root)["tables"] == {"t": ["a"]}
    assert pb.appended(spark, root, "u", spark.range(3)) == 2
    assert pb.appended(spark, root, "u", spark.range(4)) == 3
    assert pb.published(spark, root, "u", "id long").count() == 7 and pb.current(spark, root)["tables"]["t"] == ["a"]


def test_finished_batches_survive_a_failing_scorer(spark, tmp_path):
    root = str(tmp_path / "store")
    seen = spark.sparkContext.accumulator(0)
    windows = spark.range(90).select(F.concat(F.lit("r"), F.col("id") % 3).alias("rec_id"), F.col("id").cast("double").alias("start"), (F.col("id") + 1.0).alias("end"))
    windows = windows.unionByName(windows.limit(10))

    def scorer(fail):
        def run(batches):
            for b in batches:
                if fail is not None and (b["start"] == fail).any():
                    raise RuntimeError("device lost")
                seen.add(len(b))
                yield b[["rec_id", "key"]].assign(scores=[{"x": s} for s in b["start"]])

        return run

    # The window that fails is in the third of nine batches.
    from tapeloom.functions.clock import span_key

    part = F.pmod(F.xxhash64("rec_id", span_key(F.col("start"), F.col("end"))), F.lit(9))
    bad = windows.where(part == 2).agg(F.max("start")).first()[0]
    before = windows.distinct().where(part < 2).count()
    with pytest.raises(Exception, match="device lost"):
        sc.score_durably(windows, root, scorer(bad), "m", batch_rows=10)
    assert sc.stored_scores(spark, root).count() == before and 0 < before < 90
    done = seen.value
    got = sc.score_durably(windows, root, scorer(None), "m", batch_rows=10)
    assert got.count() == 100 and got.where("scores is null or scores['x'] <> start").count() == 0
    assert seen.value - done == 90 - before
    # Another model scores anew and both stay; compaction keeps the rows of the models named.
    sc.score_durably(windows, root, scorer(None), "n", batch_rows=1000)
    assert sc.stored_scores(spark, root).groupBy("model").count().count() == 2
    sc.compact_scores(spark, root, ["n"], files=2)
    assert sc.stored_scores(spark, root).count() == 90 and len(pb.current(spark, root)["tables"]["scores"]) == 1
    assert sc.score_durably(windows, root, scorer(-1.0), "n").where("scores is null").count() == 0
    assert sc.score_durably(windows.limit(0), str(tmp_path / "none"), scorer(None), "m").count() == 0
