"""Streaming windows, sessions and block reports; scans in order are in ``ordered``.

Inputs are streaming DataFrames; outputs are streaming DataFrames to be written
in append mode with a checkpoint location: windows and sessions are emitted once,
when the watermark has passed them, and leave the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_merge(spans: DataFrame, gap_seconds: Column | float = 0.0, watermark: str = "10 minutes") -> DataFrame:
    """Merge timestamped spans ``(rec_id, ts, seconds)`` as sessions of dynamic length.

    A session closes when the watermark passes its end.  The gap is taken off the
    end again.
    """
    gap = gap_seconds if isinstance(gap_seconds, Column) else F.lit(float(gap_seconds))
    micros = F.round((F.col("seconds") + gap) * 1_000_000).cast("long")
    length = F.concat(micros.cast("string"), F.lit(" microseconds"))
    merged = spans.withWatermark("ts", watermark).where(F.col("seconds") > 0).groupBy("rec_id", F.session_window("ts", length)).agg(
        F.count(F.lit(1)).alias("spans")
    )
    back = F.make_dt_interval(secs=gap.cast("decimal(18,6)"))
    return merged.select("rec_id", F.col("session_window.start").alias("start"), (F.col("session_window.end") - back).alias("end"), "spans")


def stream_block_gaps(blocks: DataFrame, rate: int, watermark: str = "1 minute") -> DataFrame:
    """Trim overlap and report holes over ``(rec_id, ts, block_idx, first_sample, length)``.

    Blocks later than the watermark are dropped by Spark.  Each remaining block
    says how many of its first samples to drop, how many zeros precede it and
    whether that hole is longer than a second (a violation for a side table).
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor = state.get[0] if state.exists else 0
        out = []
        for rows in [pd.concat(list(batches)).sort_values("block_idx", kind="stable")]:
            for r in rows.itertuples(index=False):
                skip = min(r.length, max(0, cursor - r.first_sample))
                zeros = max(0, r.first_sample - cursor)
                out.append((r.rec_id, r.block_idx, int(skip), int(zeros), zeros > rate))
                cursor = max(cursor, r.first_sample + r.length)
        state.update((int(cursor),))
        yield pd.DataFrame(out, columns=["rec_id", "block_idx", "skip", "zeros", "violation"])

    return blocks.withWatermark("ts", watermark).groupBy("rec_id").applyInPandasWithState(
        step, "rec_id long, block_idx long, skip long, zeros long, violation boolean", "cursor long", "append", GroupStateTimeout.NoTimeout
    )


def stream_scores(rows: DataFrame, width: str = "10 seconds", slide: str | None = None, watermark: str = "1 minute", value: str = "value") -> DataFrame:
    """Largest and mean score per recording on a fixed grid of windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        rows.withWatermark("ts", watermark)
        .groupBy("rec_id", window)
        .agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top"), F.avg(value).alias("mean"))
        .select("rec_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "top", "mean")
    )
