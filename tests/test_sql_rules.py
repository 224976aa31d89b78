"""Queries against their SQL on rows whose last digit depends on the width or the order of a sum."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from compare import normal
from tapeloom.catalog import load


def same(spark, tmp_path, name, table, rows):
    pq.write_table(rows, f"{tmp_path}/{table}.parquet")
    queries, oracles = load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(normal(v) for v in r) for r in cur.fetchall())
    got = sorted(tuple(normal(r[n]) for n in names) for r in queries[name](spark, str(tmp_path)).collect())
    assert got == want and got


def vectors(count):
    rows = (np.random.default_rng(7).standard_normal((count, 64)) / 8).astype(np.float32)
    return pa.table({"vec_id": np.arange(count), "embedding": pa.array(list(rows), pa.list_(pa.float32())), "label": np.arange(count) % 10})


def test_read_scores_rounds_doubles(spark, tmp_path):
    same(spark, tmp_path, "read_scores", "embeddings", vectors(1500))


def test_envelope_is_of_32_bits(spark, tmp_path):
    same(spark, tmp_path, "seam_apply_envelope", "embeddings", vectors(10000))


def test_trace_is_of_32_bits(spark, tmp_path):
    same(spark, tmp_path, "signal_spectral_trace", "embeddings", vectors(12000))


def test_shifted_words_add_up_in_any_order(spark, tmp_path):
    """Recordings far from zero, where sums of doubles lose the last microsecond."""
    text = " ".join("word" * (1 + i % 3) for i in range(900))
    n = 400
    rows = pa.table({
        "conv_id": pa.array([11000 + 7 * i for i in range(n)], pa.int64()), "turn": pa.array([i % 5 for i in range(n)], pa.int64()),
        "role": ["user"] * n, "text": [text[: 2000 + i] for i in range(n)],
    })
    same(spark, tmp_path, "transcript_shift_clock", "conversations", rows)
