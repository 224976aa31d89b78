"""Times headline queries on the supplied tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tapeloom.catalog import load
from tapeloom.catalog.plan_queries import noise_blocks
from tapeloom.operators.sequences import spectral_drops
from tapeloom.operators.signal import spectral_trace
from tapeloom.session import local_session, materialize, shared_path

HEADLINE = [
    "kept_time", "interval_merge_gap", "interval_subtract", "interval_overlap_seconds", "interval_intersect", "grid_cut_windows",
    "label_summarize", "evidence_tapping_runs", "evidence_airflow_events", "evidence_extend_breaks", "transcript_classify_segments",
    "transcript_word_intervals", "frame_quiet_spans", "frame_db", "frame_trim_quiet_removed", "signal_spectral_trace",
    "timeline_output_to_source", "packet_keyframe_groups", "packet_assign", "packet_reconcile", "chapter_list",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["interval_pad"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    # Spectral scan of stored 16 kHz sound: a quarter second per block.
    pcm = shared_path(spark, "pcm")
    noise_blocks(spark, sf).write.parquet(pcm)
    stored = spark.read.parquet(pcm)
    seconds = stored.count() / 4
    start = time.perf_counter()
    spectral_drops(materialize(spectral_trace(stored))).write.format("noop").mode("overwrite").save()
    times["spectral_scan"] = round(time.perf_counter() - start, 3)
    scan = {"audio_seconds": seconds, "times_real_time": round(seconds / times["spectral_scan"], 1)}
    result = {"metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "spectral_scan": scan}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
