"""Compression classifier against plain loops, and on held-out rows."""

import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from tapeloom.llm import compression
from tapeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, quality string, good_bytes int"


def corpus(spark, n=400):
    rng = np.random.default_rng(1)
    good, bad = [f"plain{i} word{i}" for i in range(40)], [f"SHOUT{i}!!" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad, 30 + i % 50)), None, "clash", 1) for i in range(n)]
    labels = [(i, i % 2, 0) for i in range(n)] + [(None, 1, 0), (1, None, 0), (2, 7, 0), (n + 1, 0, 0), (3, 0, 0)]
    return rows, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_of_whole_texts_equal_plain_loops(spark):
    rows, docs, labels = corpus(spark)
    extra = [(None, "no id", None, None, 1), (1001, None, None, None, 1), (1002, "", None, None, 1), (1003, "word " * 50_000, None, None, 1), (5, "plain1 word1", None, None, 1), (5, "plain1 word1", None, None, 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    good, bad, weights = compression.fit(docs, labels)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["good_bytes"], r["bad_bytes"], r["n_bytes"], round(r["score"], 12), r["held_out"], r["predicted"]) for r in compression.qualities(docs, labels).collect()))
    want = []
    for doc_id, text, *_ in rows + extra:
        data, sizes = (text or "").encode(), []
        for held in (good, bad):
            squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(squeeze.compress(data[a : a + 1024])) for a in range(0, max(len(data), 1), 1024)))
        a, b = sizes
        p = 1 / (1 + np.exp(-(weights[0] + weights[1] * (b - a) / (len(data) + 100) + weights[2] * np.log((a + b) / (len(data) + 1)))))
        held_out = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
        want.append((doc_id is None, doc_id or 0, a, b, len(data), round(float(p), 12), held_out, int(p >= 0.5)))
    assert got == sorted(want)
    own = [r[7] == r[1] % 2 for r in got if r[1] < 400 and not r[0] and r[4] > 100]
    assert sum(own) > 0.95 * len(own)


def test_calibration_is_the_minimum():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(300), rng.normal(3, 2, 300), rng.normal(-1, 0.1, 300)])
    y = (x[:, 1] + 5 * x[:, 2] + rng.normal(size=300) > -2).astype(int)
    w = compression.calibrate(x, y)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(w):
        p = 1 / (1 + np.exp(-x @ w))
        return -np.sum(target * np.log(p) + (1 - target) * np.log(1 - p)) + 0.5 * 1e-3 * 300 * np.sum((w[1:] * x[:, 1:].std(axis=0)) ** 2)

    for k in range(3):
        for step in (-1e-3, 1e-3):
            assert loss(w) <= loss(w + step * np.eye(3)[k]) + 1e-9
    # One class, one row, no rows: still defined, and apart classes don't run away.
    assert compression.calibrate(x[:0], y[:0]).tolist() == [0, 0, 0]
    ones = compression.calibrate(x, np.ones(300, dtype=int))
    assert np.all(1 / (1 + np.exp(-x @ ones)) > 0.99)
    assert np.all(np.isfinite(compression.calibrate(x, (x[:, 1] > 3).astype(int))))


def test_held_out_labels_are_never_learned(spark):
    """Turning the held-out labels round changes nothing."""
    _, docs, labels = corpus(spark)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.fit(docs, labels) == compression.fit(docs, turned)


def test_without_labels_classes_or_rows(spark):
    _, docs, labels = corpus(spark, 40)
    assert {r["score"] for r in compression.qualities(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["predicted"] for r in compression.qualities(docs, labels.filter("quality = 1")).collect()} == {1}
    assert compression.qualities(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    marks = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    scored = QUERIES["op13_compression_quality"](spark, SF).filter("held_out").join(marks, "doc_id")
    right = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.93
