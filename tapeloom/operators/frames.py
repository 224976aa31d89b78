"""Sample blocks and frame levels: re-blocking, quiet runs, pause limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import to_db
from ..session import attach, materialize
from . import intervals as iv
from .scan import framed, islands, neighbours, running

BY = ("rec_id",)
BLOCK = 8192


def frame_levels(frames: DataFrame, size: int = 1024, samples: str = "samples") -> DataFrame:
    """RMS of the loudest channel and peak of each whole frame; partial frames are dropped.

    ``samples`` is an array of channels, each an array of ``size`` values.
    """
    energy = lambda ch: F.aggregate(ch, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    rms = F.array_max(F.transform(samples, lambda ch: F.sqrt(energy(ch) / size)))
    peak = F.array_max(F.transform(samples, lambda ch: F.array_max(F.transform(ch, lambda x: F.abs(x)))))
    whole = frames.where(F.forall(samples, lambda ch: F.size(ch) == size))
    return whole.withColumn("rms", rms).withColumn("peak", peak).drop(samples)


def regularize_blocks(
    blocks: DataFrame, limits: DataFrame, rate: int, by: Sequence[str] = BY, tolerant: bool = False, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Put blocks ``(block_idx, first_sample, samples)`` on one sample clock.

    Overlap with earlier samples is trimmed, holes are filled with zeros and the
    output ends at ``limit``.  Returns the blocks and the violations: holes
    (inside or at the end) longer than one second, unless ``tolerant``.  Filler
    is cut into pieces of one second.  ``block_idx`` is unique in a recording.

    What stays of a block is decided from its index, begin and length alone (``length``
    is read where the blocks have that column); samples join the decision last.
    """
    by = list(by)
    size = F.col("length") if "length" in blocks.columns else F.size("samples")
    rows = blocks.select(*by, "block_idx", "first_sample", (F.col("first_sample") + size.cast("long")).alias("_stop"))
    rows = running(rows, {"_seen": ("max", F.col("_stop"))}, ["block_idx"], by, block)
    rows = rows.withColumn("_cursor", F.greatest(F.coalesce("_seen", F.lit(0)), F.lit(0)))
    rows = attach(rows, limits.select(*by, "limit"), by, F.col("block_idx"))
    start = F.greatest("first_sample", "_cursor")
    count = F.least("_stop", "limit") - start
    cut = rows.where(count > 0).select(*by, "block_idx", start.alias("_start"), count.cast("int").alias("_count"))
    kept = blocks.select(*by, "block_idx", "first_sample", "samples").join(cut, [*by, "block_idx"])
    kept = kept.select(
        *by,
        F.col("_start").alias("first_sample"),
        F.slice("samples", (F.col("_start") - F.col("first_sample") + 1).cast("int"), F.col("_count")).alias("samples"),
        F.lit(False).alias("filler"),
    )
    inner = rows.where(F.col("first_sample") > F.col("_cursor")).select(
        *by, F.col("_cursor").alias("start"), F.col("first_sample").alias("end"), "limit"
    )
    ends = rows.groupBy(*by).agg(F.max("_stop").alias("start"))
    tail = limits.select(*by, "limit").join(ends, by, "left").select(
        *by, F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("limit").cast("long").alias("end"), F.col("limit").cast("long").alias("limit")
    )
    holes = inner.select(*by, F.col("start").cast("long"), F.col("end").cast("long"), F.col("limit").cast("long")).unionByName(tail)
    holes = holes.where(F.col("end") > F.col("start"))
    broken = holes.where(F.col("end") - F.col("start") > rate).select(*by, "start", "end")
    fill = holes.select(*by, "start", F.least("end", "limit").alias("end")).where(F.col("end") > F.col("start"))
    fill = fill.withColumn("first_sample", F.explode(F.sequence("start", F.col("end") - 1, F.lit(rate).cast("long"))))
    zero = F.lit(0).cast(blocks.schema["samples"].dataType.elementType)
    fill = fill.select(
        *by,
        "first_sample",
        F.array_repeat(zero, F.least(F.lit(rate), F.col("end") - F.col("first_sample")).cast("int")).alias("samples"),
        F.lit(True).alias("filler"),
    )
    return kept.unionByName(fill), broken.limit(0) if tolerant else broken


def reblock(blocks: DataFrame, size: int, by: Sequence[str] = BY, after: int = 0) -> DataFrame:
    """Re-cut blocks ``(first_sample, samples)`` to ``size`` samples each (the last may be shorter).

    A block is sliced once per target it touches; a target only ever gathers its
    own ``size`` samples and, for windows that cross its end, ``after`` more of those that follow.
    """
    by = list(by)
    first = F.floor((F.col("first_sample") - after) / size).cast("long")
    last = F.floor((F.col("first_sample") + F.size("samples") - 1) / size).cast("long")
    parts = blocks.where(F.size("samples") > 0).withColumn("block_idx", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("first_sample"), F.col("block_idx") * size)
    hi = F.least(F.col("first_sample") + F.size("samples"), (F.col("block_idx") + 1) * size + after)
    piece = F.slice("samples", (lo - F.col("first_sample") + 1).cast("int"), (hi - lo).cast("int"))
    rows = parts.select(*by, "block_idx", lo.alias("_lo"), piece.alias("_piece"))
    gathered = rows.groupBy(*by, "block_idx").agg(F.array_sort(F.collect_list(F.struct("_lo", "_piece"))).alias("_p"))
    if after:  # no block of what follows alone
        gathered = gathered.where(F.get("_p", F.lit(0))["_lo"] < (F.col("block_idx") + 1) * size)
    return gathered.select(
        *by,
        "block_idx",
        F.get("_p", F.lit(0))["_lo"].alias("first_sample"),
        F.flatten(F.transform("_p", lambda x: x["_piece"])).alias("samples"),
    )


def timestamp_jumps(frames: DataFrame, frame_seconds, tol=0.1, by: Sequence[str] = BY, block: int = BLOCK) -> DataFrame:
    """Frames whose step from the previous source time differs from the frame duration."""
    step = frame_seconds if isinstance(frame_seconds, Column) else F.lit(frame_seconds)
    rows = neighbours(frames, ["frame_idx"], before=1, fields=["source_time"], by=by, chunk=block)
    jump = F.col("source_time") - F.get("prev", F.lit(0))["source_time"]
    return rows.withColumn("step", jump).where(F.abs(F.col("step") - step) > tol).drop("prev")


def with_db(levels: DataFrame, by: Sequence[str] = BY, block: int = BLOCK) -> DataFrame:
    """Add ``db`` and ``wide``, the level of the loudest of nine frames around each frame."""
    top = framed(levels, "frame_idx", 4, 4, lambda f: {"_m": F.max("rms").over(f(-4, 4))}, by, block)
    return top.withColumn("db", to_db(F.col("rms"))).withColumn("wide", to_db(F.col("_m"))).drop("_m")


def moving_max(levels: DataFrame, taps: int = 9, by: Sequence[str] = BY, block: int = BLOCK) -> DataFrame:
    half = taps // 2
    return framed(levels, "frame_idx", half, half, lambda f: {"wide_rms": F.max("rms").over(f(-half, half))}, by, block)


def is_quiet(threshold_db: Column, rms: str = "rms", peak: str = "peak") -> Column:
    limit = F.pow(F.lit(10.0), threshold_db / 20)
    return (F.col(rms) < limit) & (F.col(peak) < limit * 10 ** (3 / 20))


def quiet_spans(levels: DataFrame, threshold_db=-58.0, by: Sequence[str] = BY, block: int = BLOCK) -> DataFrame:
    """Maximal runs of quiet frames as ``[start, end)`` frame numbers; holes are not closed."""
    level = threshold_db if isinstance(threshold_db, Column) else F.lit(threshold_db)
    rows = levels.where(is_quiet(level)).select(*by, "frame_idx")
    aggs = {"start": ("min", F.col("frame_idx")), "end": ("max", F.col("frame_idx") + 1)}
    return islands(
        rows, aggs, lambda a, b: b["frame_idx"] > a["frame_idx"] + 1, order=["frame_idx"], uses=["frame_idx"], by=by, chunk=block
    )


def output_clock(keeps: DataFrame, by: Sequence[str] = BY, chunk=600.0) -> DataFrame:
    """Add ``output_start`` and ``output_end``: kept intervals laid end to end in time order."""
    length = F.col("end") - F.col("start")
    rows = running(keeps, {"_at": ("sum", length)}, ["start"], by, chunk)
    at = F.coalesce("_at", F.lit(0))
    kind = keeps.schema["start"].dataType
    return rows.withColumn("output_start", at.cast(kind)).withColumn("output_end", (at + length).cast(kind)).drop("_at")


def joined_spans(keeps: DataFrame, quiet: DataFrame, by: Sequence[str] = BY, chunk=600.0) -> DataFrame:
    """Quiet time on the joined clock; quiet that meets across a cut becomes one span."""
    clock = output_clock(keeps.select(*by, "start", "end"), by, chunk)
    return _joined(clock, quiet, by, chunk)


def _joined(clock: DataFrame, quiet: DataFrame, by, chunk, intersect=iv.intersect) -> DataFrame:
    pairs = intersect(quiet.select(*by, "start", "end"), clock, by, chunk)
    shift = F.col("r.output_start") - F.col("r.start")
    moved = pairs.select(*by, (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))
    return iv.merge(moved, 1e-8, by, chunk)


def long_middles(quiet: DataFrame, budget: Column, integer: bool = False) -> DataFrame:
    """What is cut out of the quiet spans longer than ``budget``: all but half of it at each end."""
    left = F.floor(budget / 2) if integer else budget / 2
    kind = quiet.schema["start"].dataType
    cut = F.struct((F.col("start") + left).cast(kind).alias("a"), (F.col("end") - (budget - left)).cast(kind).alias("b"))
    rows = quiet.where(F.col("end") - F.col("start") > budget + 1e-8).withColumn("_cut", cut)
    return rows.withColumn("start", F.col("_cut.a")).withColumn("end", F.col("_cut.b")).drop("_cut")


def trim_quiet(
    keeps: DataFrame, quiet: DataFrame, budget: Column, integer: bool = False, by: Sequence[str] = BY, chunk=600.0,
    stored: bool = False, disjoint: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Cut the middle out of every joined quiet span longer than ``budget``.

    ``budget`` is a column of ``keeps`` that is constant per recording, or a
    literal.  Returns the kept and the removed intervals on the source clock,
    each with the start of its keep as ``unit``.  Inputs, the joined clock and
    the cuts are stored, because the steps below read each of them repeatedly;
    pass ``stored`` when the inputs already are tables, ``disjoint`` when neither keeps
    nor quiet overlap among themselves.
    """
    by = list(by)
    intersect = iv.intersect_disjoint if disjoint else iv.intersect
    keeps, quiet = keeps.select(*by, "start", "end", budget.alias("_b")), quiet.select(*by, "start", "end")
    if not stored:
        keeps, quiet = materialize(keeps), materialize(quiet)
    clock = materialize(output_clock(keeps.select(*by, "start", "end"), by, chunk))
    limits = keeps.groupBy(*by).agg(F.max("_b").alias("_b"))
    long = _joined(clock, quiet, by, chunk, intersect).join(limits, by)
    cuts = materialize(long_middles(long, F.col("_b"), integer).select(*by, "start", "end"))
    placed = clock.select(
        *by, F.col("output_start").alias("start"), F.col("output_end").alias("end"), F.col("start").alias("_source"), F.col("end").alias("_stop")
    )
    pairs = intersect(cuts, placed, by, chunk)
    shift = F.col("r._source") - F.col("r.start")
    removed = pairs.select(
        *by, F.col("r._source").alias("unit"), (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end")
    )
    units = keeps.select(*by, F.col("start").alias("unit"), "start", "end")
    kept = iv.subtract(units, removed, [*by, "unit"], chunk)
    return kept, removed


def fade_seconds(limit: Column, join_fade: Column) -> Column:
    return F.least(join_fade, limit * 0.225)


def quiet_budget(limit: Column, join_fade: Column, join_enabled: Column, dt: Column) -> Column:
    """Longest pause to keep: the limit minus a margin and minus both fades."""
    margin = F.least(limit * 0.1, F.greatest(F.lit(0.1), dt * 2))
    fades = F.when(join_enabled, fade_seconds(limit, join_fade) * 2).otherwise(F.lit(0.0))
    return F.greatest(dt, limit - margin - fades)


def frame_budget(policy: DataFrame) -> Column:
    """Whole-frame budget from policy columns and ``dt``; always at least one frame."""
    budget = quiet_budget(F.col("max_pause_seconds"), F.col("join_fade_seconds"), F.col("join_fade_enabled"), F.col("dt"))
    return F.greatest(F.lit(1).cast("long"), F.floor(budget / F.col("dt")).cast("long"))


def limit_pauses(
    keeps: DataFrame, quiet: DataFrame, policy: DataFrame, by: Sequence[str] = BY, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Frame form of :func:`trim_quiet` with the budget of each recording."""
    limits = policy.select(*by, frame_budget(policy).alias("_budget"))
    rows = keeps.select(*by, "start", "end").join(limits, list(by))
    return trim_quiet(rows, quiet, F.col("_budget"), True, by, block)


def gestures(levels: DataFrame, units: DataFrame, silence_db, dt, by: Sequence[str] = BY, block: int = BLOCK) -> DataFrame:
    """Per unit ``[start, end)`` of frames: active frames and the longest gesture.

    A gesture closes gaps of up to six frames (seven taps, false outside the unit).
    """
    from .joins import covering

    by = list(by)
    floor = silence_db if isinstance(silence_db, Column) else F.lit(silence_db)
    spans = units.select(*by, "start", "end")
    rows = levels.select(*by, "frame_idx", (to_db(F.col("rms")) > floor + 6).alias("active"))
    held = covering(rows, spans, at="frame_idx", by=by, chunk=block)
    held = held.where(F.col("frame_idx") < F.col("span.end"))
    held = held.select(*by, F.col("span.start").alias("unit"), "frame_idx", F.col("active").cast("int").alias("_a"))
    ids = [*by, "unit"]
    wide = framed(held, "frame_idx", 3, 3, lambda f: {"_d": F.max("_a").over(f(-3, 3))}, ids, block)
    closed = framed(
        wide,
        "frame_idx",
        3,
        3,
        lambda f: {"_c": F.when(F.count("_d").over(f(-3, 3)) == 7, F.min("_d").over(f(-3, 3))).otherwise(0)},
        ids,
        block,
    )
    runs = islands(
        closed.where(F.col("_c") == 1).select(*ids, "frame_idx"),
        {"n": ("count", F.lit(1))},
        lambda a, b: b["frame_idx"] > a["frame_idx"] + 1,
        order=["frame_idx"],
        uses=["frame_idx"],
        by=ids,
        chunk=block,
    )
    longest = runs.groupBy(*ids).agg((F.max("n") * F.lit(dt)).alias("longest"))
    active = held.groupBy(*ids).agg(F.sum("_a").cast("long").alias("active"), F.count(F.lit(1)).alias("frames"))
    units = spans.withColumn("unit", F.col("start"))
    out = units.join(active, ids, "left").join(longest, ids, "left")
    return out.select(
        *by,
        "start",
        "end",
        F.coalesce("active", F.lit(0).cast("long")).alias("active"),
        F.coalesce("frames", F.lit(0).cast("long")).alias("frames"),
        F.coalesce("longest", F.lit(0.0)).alias("longest"),
    )
