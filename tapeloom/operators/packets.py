"""Packet tables: keyframe groups, alignment, assignment and reconciliation.

Packets are numbered per recording by ``ordinal`` (decode order); every ordered
pass is cut into blocks of ordinals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import whole_ticks
from ..session import materialize
from . import frames as fr
from . import intervals as iv
from .joins import covering
from .scan import CHUNK, islands, neighbours

BY = ("rec_id",)
BLOCK = 8192


def missing_times(packets: DataFrame) -> DataFrame:
    """Packets without a presentation time; no grouping is safe with them."""
    return packets.where(F.col("pts").isNull())


def keyframe_groups(packets: DataFrame, rate=25.0, by: Sequence[str] = BY, block: int = BLOCK) -> DataFrame:
    """Packets from each keyframe up to the next one.

    A missing duration counts as one frame of ``rate``.  Packets before the first
    keyframe belong to no group.
    """
    by = list(by)
    fallback = 1 / rate if isinstance(rate, Column) else F.lit(1.0 / rate)
    length = F.when(F.col("duration") > 0, F.col("duration")).otherwise(fallback)
    rows = packets.where(F.col("pts").isNotNull()).withColumn("_stop", F.col("pts") + length)
    aggs = {
        "start": ("first", F.col("pts")),
        "first": ("min", F.col("ordinal")),
        "stop": ("max", F.col("ordinal") + 1),
        "min_pts": ("min", F.col("pts")),
        "max_end": ("max", F.col("_stop")),
        "_key": ("first", F.col("is_key")),
    }
    groups = islands(rows, aggs, lambda a, b: b["is_key"], order=["ordinal"], uses=["ordinal", "is_key"], by=by, chunk=block, stored=True)
    groups = materialize(groups.where("_key").drop("_key"))
    groups = neighbours(groups, ["first"], after=1, fields=["start"], by=by, chunk=block)
    following = F.get("next", F.lit(0))["start"]
    return groups.select(*by, "first", "stop", "start", F.coalesce(following, F.col("max_end")).alias("end"), "min_pts", "max_end")


def align_groups(groups: DataFrame, intervals: DataFrame, by: Sequence[str] = BY, chunk=CHUNK, block: int = BLOCK) -> DataFrame:
    """Closed groups wholly inside one interval; neighbours in one interval are joined.

    ``intervals`` has ``source_start, source_end, analysis_start``.
    """
    by = list(by)
    spans = intervals.select(*by, F.col("source_start").alias("start"), F.col("source_end").alias("end"), "analysis_start")
    held = covering(groups, spans, at="start", slack=1e-7, by=by, chunk=chunk)
    inside = (
        (F.col("start") >= F.col("span.start") - 1e-7)
        & (F.col("end") <= F.col("span.end") + 1e-7)
        & (F.col("min_pts") >= F.col("start") - 1e-7)
        & (F.col("max_end") <= F.col("end") + 1e-5)
    )
    held = held.where(inside).withColumn("unit", F.col("span.start")).withColumn("_a", F.col("span.analysis_start"))
    aggs = {
        "source_start": ("first", F.col("start")),
        "source_end": ("last", F.col("end")),
        "first": ("min", F.col("first")),
        "stop": ("max", F.col("stop")),
        "unit": ("first", F.col("unit")),
        "_a": ("first", F.col("_a")),
    }
    apart = lambda a, b: (a["stop"] != b["first"]) | (a["unit"] != b["unit"])
    runs = islands(held.drop("span"), aggs, apart, order=["first"], uses=["first", "stop", "unit"], by=by, chunk=block)
    begin = F.col("_a") + F.col("source_start") - F.col("unit")
    return runs.select(
        *by,
        "source_start",
        "source_end",
        "first",
        "stop",
        begin.alias("analysis_start"),
        (begin + F.col("source_end") - F.col("source_start")).alias("analysis_end"),
    )


def limit_groups(
    aligned: DataFrame, groups: DataFrame, quiet: DataFrame, budget: float, by: Sequence[str] = BY, chunk=CHUNK
) -> DataFrame:
    """Drop whole groups that touch quiet beyond the budget until none is left over it.

    Every round trims the joined clock of all open recordings at once; a
    recording that needs no cut leaves the loop, as does one whose excess touches
    none of its groups.  So every round removes a group of each recording that stays.
    A recording that loses all its groups has no row; see ``limit_status``.
    """
    by = list(by)
    # United quiet is as good as its pieces, which meet again on the joined clock.
    aligned, quiet = materialize(aligned), materialize(iv.merge(quiet, 0, by, chunk))
    spans = aligned.select(*by, F.col("analysis_start").alias("start"), F.col("analysis_end").alias("end"))
    _, excess = fr.trim_quiet(spans, quiet, F.lit(float(budget)), False, by, chunk, stored=True)
    touched = materialize(excess.select(*by).distinct())
    done = aligned.join(touched, by, "left_anti").select(*by, "source_start", "source_end", "first", "stop", "analysis_start", "analysis_end")
    open_ = aligned.join(touched, by, "left_semi")
    units = open_.select(
        *by,
        F.col("first").alias("start"),
        F.col("stop").alias("end"),
        "source_start",
        F.col("analysis_start").alias("_a"),
    )
    held = covering(groups.select(*by, "first", "stop", "start", "end"), units, at="first", by=by, chunk=BLOCK)
    held = held.where(F.col("stop") <= F.col("span.end"))
    begin = F.col("span._a") + F.col("start") - F.col("span.source_start")
    pieces = held.select(
        *by,
        F.col("span.start").alias("unit"),
        "first",
        "stop",
        F.col("start").alias("source_start"),
        F.col("end").alias("source_end"),
        begin.alias("start"),
        (begin + F.col("end") - F.col("start")).alias("end"),
    )
    pieces = materialize(pieces)
    quiet = materialize(quiet.join(touched, by, "left_semi"))
    settled = []
    while True:
        _, removed = fr.trim_quiet(pieces.select(*by, "start", "end"), quiet, F.lit(float(budget)), False, by, chunk, stored=True)
        removed = materialize(removed.select(*by, "start", "end"))
        still = removed.select(*by).distinct()
        settled.append(pieces.join(still, by, "left_anti"))
        if removed.isEmpty():
            break
        live = pieces.join(still, by, "left_semi")
        hit = materialize(iv.overlap_length(live, removed, ["first"], by, chunk))
        moving = materialize(hit.where(F.col("overlap") > 1e-8).select(*by).distinct())
        settled.append(hit.drop("overlap").join(moving, by, "left_anti"))
        pieces = materialize(hit.where(F.col("overlap") <= 1e-8).drop("overlap").join(moving, by, "left_semi"))
        quiet = materialize(quiet.join(moving, by, "left_semi"))
        if len(settled) >= 16:  # keeps the plan short however many rounds there are
            settled = [materialize(reduce(DataFrame.unionByName, settled))]
    rows = reduce(DataFrame.unionByName, settled)
    aggs = {
        "source_start": ("first", F.col("source_start")),
        "source_end": ("last", F.col("source_end")),
        "first": ("min", F.col("first")),
        "stop": ("max", F.col("stop")),
        "analysis_start": ("first", F.col("start")),
        "analysis_end": ("last", F.col("end")),
    }
    apart = lambda a, b: (a["stop"] != b["first"]) | (a["unit"] != b["unit"])
    order = ["first"]
    cut = islands(rows.select(*by, "unit", "first", "stop", "source_start", "source_end", "start", "end"), aggs, apart, order, ["first", "stop", "unit"], by, BLOCK)
    return done.unionByName(cut.select(*done.columns))


def limit_status(aligned: DataFrame, limited: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``kept``, ``cut`` or ``empty`` for every recording that went into ``limit_groups``."""
    length = F.sum(F.col("stop") - F.col("first"))
    before = aligned.groupBy(*by).agg(length.alias("_before"))
    after = limited.groupBy(*by).agg(length.alias("_after"))
    status = F.when(F.col("_after").isNull(), "empty").when(F.col("_after") < F.col("_before"), "cut").otherwise("kept")
    return before.join(after, list(by), "left").select(*by, status.alias("status"))


def align_frames(frames: DataFrame, intervals: DataFrame, by: Sequence[str] = BY, chunk=CHUNK) -> DataFrame:
    """First and last whole frame inside each source interval.

    ``frames`` has ``frame_idx, start, end`` in display order.
    """
    by = list(by)
    spans = intervals.select(*by, F.col("source_start").alias("start"), F.col("source_end").alias("end"), "analysis_start")
    held = covering(frames.select(*by, "frame_idx", "start", "end"), spans, at="start", slack=1e-7, by=by, chunk=chunk)
    held = held.where((F.col("start") >= F.col("span.start") - 1e-7) & (F.col("end") <= F.col("span.end") + 1e-7))
    found = held.groupBy(*by, F.col("span.start").alias("_s"), F.col("span.analysis_start").alias("_a")).agg(
        F.min("start").alias("source_start"),
        F.max("end").alias("source_end"),
        F.min("frame_idx").alias("video_frame_first"),
        (F.max("frame_idx") + 1).alias("video_frame_stop"),
    )
    at = lambda c: (F.col("_a") + F.col(c) - F.col("_s"))
    return found.select(
        *by,
        "source_start",
        "source_end",
        at("source_start").alias("analysis_start"),
        at("source_end").alias("analysis_end"),
        "video_frame_first",
        "video_frame_stop",
    )


def assign_packets(packets: DataFrame, mapping: DataFrame, by: Sequence[str] = BY, chunk=CHUNK, time_base=None) -> DataFrame:
    """Packets that lie wholly inside a mapped interval, on the output clock.

    ``seq`` names the interval.  With ``time_base`` (seconds per tick) the shift
    is rounded to whole ticks.
    """
    by = list(by)
    spans = mapping.select(*by, F.col("source_start").alias("start"), F.col("source_end").alias("end"), "seq", "output_start")
    found = covering(packets, spans, at="pts", slack=1e-8, by=by, chunk=chunk)
    found = found.where(F.col("pts") + F.col("duration") <= F.col("span.end") + 1e-7)
    shift = F.col("span.output_start") - F.col("span.start")
    if time_base is not None:
        shift = F.bround(shift / F.lit(time_base), 0) * F.lit(time_base)
    return found.withColumn("seq", F.col("span.seq")).withColumn("output_pts", F.col("pts") + shift).drop("span")


def segment_packet_stats(assigned: DataFrame, mapping: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per mapped interval: packets, gaps to its ends and average bit rate; ``empty`` marks violations."""
    by = list(by)
    sums = assigned.groupBy(*by, "seq").agg(
        F.count(F.lit(1)).alias("packets"),
        F.min("pts").alias("audio_start"),
        F.max(F.col("pts") + F.col("duration")).alias("audio_end"),
        F.sum("size").alias("bytes"),
    )
    rows = mapping.select(*by, "seq", "source_start", "source_end").join(sums, [*by, "seq"], "left")
    return rows.select(
        *by,
        "seq",
        F.coalesce("packets", F.lit(0).cast("long")).alias("packets"),
        "audio_start",
        "audio_end",
        (F.col("audio_start") - F.col("source_start")).alias("start_gap"),
        (F.col("source_end") - F.col("audio_end")).alias("end_gap"),
        (F.col("bytes") * 8 / (F.col("source_end") - F.col("source_start"))).alias("bitrate"),
        F.col("packets").isNull().alias("empty"),
    )


def reconcile_packets(left: DataFrame, right: DataFrame, tol, by: Sequence[str] = BY) -> tuple[DataFrame, DataFrame]:
    """Row-by-row comparison of two packet lists.

    Returns the mismatches (missing on a side, other payload, other clock) and
    per recording the number of packets and the largest clock error.
    """
    by = list(by)
    side = lambda df, n: df.select(*by, "ordinal", *[F.col(c).alias(f"{n}_{c}") for c in ("pts", "size", "payload")])
    rows = side(left, "l").join(side(right, "r"), [*by, "ordinal"], "full_outer")
    error = F.abs(F.col("l_pts") - F.col("r_pts"))
    issue = (
        F.when(F.col("l_payload").isNull() | F.col("r_payload").isNull(), "missing packet")
        .when((F.col("l_size") != F.col("r_size")) | (F.col("l_payload") != F.col("r_payload")), "payload differs")
        .when(F.col("l_pts").isNull() | F.col("r_pts").isNull(), "time missing")
        .when(error > F.lit(tol), "clock differs")
    )
    rows = rows.withColumn("error", error).withColumn("issue", issue)
    summary = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("packets"), F.max("error").alias("max_error"), F.count("issue").alias("mismatches")
    )
    return rows.where(F.col("issue").isNotNull()).select(*by, "ordinal", "issue", "error"), summary


def order_violations(packets: DataFrame, clock: str = "pts", by: Sequence[str] = BY, block: int = BLOCK) -> DataFrame:
    """Packets whose time does not exceed the time of the packet before."""
    rows = neighbours(packets, ["ordinal"], before=1, fields=[clock], by=by, chunk=block)
    earlier = F.get("prev", F.lit(0))[clock]
    return rows.withColumn("previous", earlier).where(F.col(clock) <= F.col("previous")).drop("prev")


def payload_digest(packets: DataFrame, by: Sequence[str] = BY, fan: int = 4096) -> DataFrame:
    """Order-sensitive digest, bytes and number of packets per stream.

    A tree of digests: ``fan`` packets make one node, ``fan`` nodes the next, so
    no group ever holds the whole stream.
    """
    by = list(by)
    nodes = packets.select(*by, F.col("ordinal").alias("_n"), F.sha2("payload", 256).alias("_h"), F.col("size").cast("long").alias("_b"), F.lit(1).cast("long").alias("_c"))
    for level in range(3):
        place = F.floor(F.col("_n") / fan).cast("long") if level < 2 else F.lit(0).cast("long")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_h"))), lambda x: x["_h"]), "")
        nodes = nodes.withColumn("_up", place).groupBy(*by, "_up").agg(
            F.sha2(joined, 256).alias("_h"), F.sum("_b").alias("_b"), F.sum("_c").alias("_c")
        ).withColumnRenamed("_up", "_n")
    return nodes.select(*by, F.col("_h").alias("digest"), F.col("_b").alias("bytes"), F.col("_c").alias("packets"))


def splice_packets(
    packets: DataFrame, mapping: DataFrame, by: Sequence[str] = BY, chunk=CHUNK, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Packets of both streams that a cut keeps, on the output clock in whole ticks, and what forbids copying them.

    ``packets`` is ``(by, stream, ordinal, pts, dts, duration, num, den, size)``: ``stream``
    is audio or video, ``ordinal`` counts the packets of a stream in decode order, times
    are ticks of ``num / den`` seconds.  ``mapping`` is ``(by, seq, source_start,
    source_end, output_start, first, stop)``; ``first`` and ``stop`` are null without video.
    A video packet belongs to the keyframe groups ``[first, stop)`` that hold its ordinal,
    an audio packet to the interval that holds it in time.  Both clocks move by the same
    whole number of ticks.  Packets of no size are skipped.

    The faults (by, stream, ordinal, seq, fault) are packets without a presentation time,
    audio without duration, kept packets without a decode time or with one that doesn't
    exceed that of the kept packet before, and intervals that got no packet of a stream.
    """
    by = list(by)
    real = packets.where(F.col("size") > 0)
    at = lambda c: F.col(c) * F.col("num") / F.col("den")
    timed = real.where(F.col("pts").isNotNull())
    audio = timed.where((F.col("stream") == "audio") & (F.col("duration") > 0)).withColumn("_at", at("pts"))
    row = ["seq", "source_start", "source_end", "output_start"]
    spans = mapping.select(*by, F.col("source_start").alias("start"), F.col("source_end").alias("end"), *row)
    heard = covering(audio, spans, at="_at", slack=1e-8, by=by, chunk=chunk).drop("_at")
    heard = heard.where(at("pts") + at("duration") <= F.col("span.end") + 1e-7)
    groups = mapping.where(F.col("first").isNotNull()).select(*by, F.col("first").alias("start"), F.col("stop").alias("end"), *row)
    seen = covering(timed.where(F.col("stream") == "video"), groups, at="ordinal", by=by, chunk=block)
    seen = seen.where(F.col("ordinal") < F.col("span.end"))
    plain = lambda df: df.select(*packets.columns, *[F.col(f"span.{c}").alias(c) for c in row])
    shift = whole_ticks(F.col("output_start") - F.col("source_start"), F.col("num"), F.col("den"))
    kept = plain(heard).unionByName(plain(seen)).withColumn("_shift", shift)
    kept = kept.withColumn("output_pts", F.col("pts") + F.col("_shift")).withColumn("output_dts", F.col("dts") + F.col("_shift"))
    kept = materialize(kept.drop("_shift", *row[1:]))

    named = lambda df, fault: df.select(*by, "stream", "ordinal", F.col("seq").cast("long").alias("seq"), F.lit(fault).alias("fault"))
    none = F.lit(None).cast("long")
    silent = timed.where((F.col("stream") == "audio") & ~F.coalesce(F.col("duration") > 0, F.lit(False)))
    decoded = neighbours(kept.where(F.col("output_dts").isNotNull()), ["ordinal"], before=1, fields=["output_dts"], by=[*by, "stream"], chunk=block)
    falling = decoded.where(F.col("output_dts") <= F.get("prev", F.lit(0))["output_dts"])
    wanted = mapping.select(*by, "seq", F.explode(F.when(F.col("first").isNull(), F.array(F.lit("audio"))).otherwise(F.array(F.lit("audio"), F.lit("video")))).alias("stream"))
    bare = wanted.join(kept.select(*by, "seq", "stream").distinct(), [*by, "seq", "stream"], "left_anti").withColumn("ordinal", none)
    parts = [
        named(real.where(F.col("pts").isNull()).withColumn("seq", none), "no presentation time"),
        named(silent.withColumn("seq", none), "audio without duration"),
        named(kept.where(F.col("dts").isNull()), "no decode time"),
        named(falling, "decode time does not rise"),
        named(bare, "interval without packets"),
    ]
    return kept, reduce(DataFrame.unionByName, parts)


def splice_segments(kept: DataFrame, mapping: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per interval of a splice: packets of each stream and the gaps between its ends and its sound, in seconds."""
    by = list(by)
    second = lambda ticks: ticks * F.col("num") / F.col("den")
    sound, picture = F.col("stream") == "audio", F.col("stream") == "video"
    sums = kept.groupBy(*by, "seq").agg(
        F.count(F.when(sound, 1)).alias("audio_packets"),
        F.count(F.when(picture, 1)).alias("video_packets"),
        F.min_by(second(F.col("pts")), F.when(sound, F.col("ordinal"))).alias("_a"),
        F.max_by(second(F.col("pts")) + second(F.col("duration")), F.when(sound, F.col("ordinal"))).alias("_z"),
        F.sum(F.when(sound, F.col("size"))).alias("audio_bytes"),
    )
    rows = mapping.select(*by, "seq", "source_start", "source_end").join(sums, [*by, "seq"], "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(
        *by, "seq", "source_start", "source_end", count("audio_packets"), count("video_packets"), count("audio_bytes"),
        (F.col("_a") - F.col("source_start")).alias("audio_start_gap"), (F.col("source_end") - F.col("_z")).alias("audio_end_gap"),
    )


def splice_report(segments: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per recording: intervals, seconds, packets, mean bit rate and ``max_audio_boundary_gap`` of a splice."""
    seconds = F.sum(F.col("source_end") - F.col("source_start"))
    return segments.groupBy(*list(by)).agg(
        F.count(F.lit(1)).alias("segments"),
        seconds.alias("duration"),
        F.sum("audio_packets").alias("audio_packets"),
        F.sum("video_packets").alias("video_packets"),
        (F.sum("audio_bytes") * 8 / seconds).alias("average_bitrate"),
        F.max(F.greatest("audio_start_gap", "audio_end_gap")).alias("max_audio_boundary_gap"),
    )
