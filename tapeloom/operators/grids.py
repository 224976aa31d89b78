"""Window and probe generation.  Every operator is a map over its input rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BY = ("rec_id",)


def _steps(length: Column, step) -> Column:
    """0 … ceil(length / step) - 1, empty when nothing fits."""
    count = F.ceil(length / F.lit(step)).cast("long")
    none = F.array().cast("array<bigint>")
    return F.when(count >= 1, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(none)


def hop_windows(intervals: DataFrame, width, step, min_len=0.0, full_only: bool = False) -> DataFrame:
    """Hopping windows anchored at the start of each interval and clipped to its end."""
    a, b = F.col("start"), F.col("end")
    room = b - F.lit(width) + F.lit(1e-6) - a if full_only else b - a
    rest = [c for c in intervals.columns if c not in ("start", "end")]
    rows = intervals.select(*rest, "start", "end", F.explode(_steps(room, step)).alias("_i"))
    at = F.col("start") + F.col("_i") * F.lit(step)
    stop = at + F.lit(width)
    rows = rows.select(*rest, at.alias("start"), (stop if full_only else F.least(stop, F.col("end"))).alias("_e"), "end")
    if not full_only:
        rows = rows.where(F.col("end") - F.col("start") >= F.lit(min_len))
    return rows.select(*rest, "start", F.col("_e").alias("end"))


def tumble(recordings: DataFrame, width, by: Sequence[str] = BY, duration: str = "duration") -> DataFrame:
    """Cover of every recording by windows that do not overlap; the last one is clipped."""
    kind = recordings.schema[duration].dataType
    whole = recordings.select(*by, F.lit(0).cast(kind).alias("start"), F.col(duration).alias("end"))
    return hop_windows(whole, width, width)


def chunk_with_overlap(
    recordings: DataFrame, length, overlap=0, by: Sequence[str] = BY, duration: str = "duration"
) -> DataFrame:
    """Chunks every ``length`` that reach ``overlap`` into the next one."""
    rows = recordings.select(*by, F.col(duration).alias("_d"), F.explode(_steps(F.col(duration), length)).alias("_i"))
    at = F.col("_i") * F.lit(length)
    return rows.select(*by, at.alias("start"), F.least(at + F.lit(length) + F.lit(overlap), F.col("_d")).alias("end"))


def review_windows(recordings: DataFrame, tile=28, reach=4, by: Sequence[str] = BY, duration: str = "duration") -> DataFrame:
    """Group ``tile``: full cover; group ``edge``: a probe around every interior tile border."""
    whole = F.ceil(duration)
    base = recordings.select(*by, F.col(duration).alias("_d"), F.explode(_steps(whole, tile)).alias("_i"))
    at = F.col("_i") * F.lit(tile)
    tiles = F.struct(F.lit("tile").alias("pass"), at.alias("start"), F.least(at + F.lit(tile), F.col("_d")).alias("end"))
    edges = F.struct(F.lit("edge").alias("pass"), (at - F.lit(reach)).alias("start"), F.least(at + F.lit(reach), F.col("_d")).alias("end"))
    both = F.when(F.col("_i") > 0, F.array(tiles, edges)).otherwise(F.array(tiles))
    return base.select(*by, F.explode(both).alias("_w")).select(*by, "_w.*")


def cut_windows(
    chunks: DataFrame, mapping: DataFrame, step=5.0, context=10.0, by: Sequence[str] = BY, chunk=600.0
) -> DataFrame:
    """Windows of ``step`` that restart at every output cut, with a probe of ``context`` around each.

    The cuts inside a chunk split it into parts; no window and no probe crosses a cut.
    """
    by = list(by)
    ends = F.explode(F.array(F.col("output_start"), F.col("output_end")))
    cuts = mapping.select(*by, ends.alias("cut")).union(
        chunks.select(*by, F.explode(F.array("start", "end")).alias("cut"))
    )
    parts = between_cuts(chunks, cuts, by, chunk)
    rows = parts.select(*by, "start", "end", F.explode(_steps(F.col("end") - F.col("start") - F.lit(1e-8), step)).alias("_i"))
    at = F.col("start") + F.col("_i") * F.lit(step)
    rows = rows.select(*by, F.col("start").alias("_a"), F.col("end").alias("_b"), at.alias("start"), F.least(F.col("end"), at + F.lit(step)).alias("_f"))
    centre = (F.col("start") + F.col("_f")) / 2
    half = F.lit(context / 2)
    lo = F.greatest(F.col("_a"), F.least(centre - half, F.col("_b") - F.lit(context)))
    return rows.select(*by, "start", F.col("_f").alias("end"), lo.alias("probe_start"), "_b").select(
        *by, "start", "end", "probe_start", F.least(F.col("_b"), F.col("probe_start") + F.lit(context)).alias("probe_end")
    )


def between_cuts(spans: DataFrame, cuts: DataFrame, by: Sequence[str] = BY, chunk=600.0) -> DataFrame:
    """Disjoint spans cut at every cut point strictly inside them."""
    from .intervals import merge
    from .scan import neighbours

    by = list(by)
    points = cuts.select(*by, F.col("cut").alias("t")).distinct()
    cover = merge(spans, 0, by, chunk)
    pieces = neighbours(points, ["t"], after=1, fields=["t"], by=by, chunk=chunk).select(
        *by, F.col("t").alias("start"), F.get("next", F.lit(0))["t"].alias("end")
    )
    pieces = pieces.where(F.col("end").isNotNull())
    from .joins import covering

    held = covering(pieces, cover, at="start", by=by, chunk=chunk)
    return held.where((F.col("span.end") >= F.col("end")) & (F.col("span.start") <= F.col("start"))).select(*by, "start", "end")


def edge_probes(free: DataFrame, min_len=2.0) -> DataFrame:
    """Mirrored two-second probes near both ends of each free section."""
    a, b = F.col("start"), F.col("end")
    offsets = F.filter(
        F.array(*[F.lit(float(x)) for x in (0, 2, 4, 7, 11, 15)]),
        lambda x: x + 2 < F.least(F.lit(18.0), (b - a) / 2),
    )
    rows = free.where(b - a >= min_len).select("*", F.posexplode(offsets).alias("probe", "_x"))
    left = F.struct(F.lit("start").alias("side"), (a + F.col("_x")).alias("s"), (a + F.col("_x") + 2).alias("e"))
    right = F.struct(F.lit("end").alias("side"), (b - F.col("_x") - 2).alias("s"), (b - F.col("_x")).alias("e"))
    rows = rows.withColumn("_p", F.explode(F.array(left, right)))
    return rows.select(
        *free.columns, "probe", F.col("_p.side").alias("side"), F.col("_p.s").alias("probe_start"), F.col("_p.e").alias("probe_end")
    )


def phase_probes(candidates: DataFrame, duration="duration") -> DataFrame:
    """Probes before, after and inside a suspect phase; nothing when the context is short."""
    a, b = F.col("start"), F.col("end")
    before, after = F.greatest(F.lit(0.0), a - 4), F.least(F.col(duration), b + 4)
    count = F.ceil(b - F.lit(2.0) + F.lit(1e-6) - a).cast("long")
    inner = F.transform(
        F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0).cast("long"))),
        lambda i: F.struct(F.lit("body").alias("role"), (a + i).alias("s"), (a + i + 2).alias("e")),
    )
    final = F.struct(F.lit("body").alias("role"), (b - 2).alias("s"), b.alias("e"))
    steps = F.when(F.element_at(inner, -1)["e"] < b - 1e-6, F.array_append(inner, final)).otherwise(inner)
    body = F.when(b - a <= 2, F.array(F.struct(F.lit("body").alias("role"), a.alias("s"), b.alias("e")))).otherwise(steps)
    edges = F.array(
        F.struct(F.lit("before").alias("role"), before.alias("s"), a.alias("e")),
        F.struct(F.lit("after").alias("role"), b.alias("s"), after.alias("e")),
    )
    rows = candidates.where(F.least(a - before, after - b) >= 2)
    rows = rows.select(*candidates.columns, F.posexplode(F.concat(edges, body)).alias("probe", "_p"))
    return rows.select(
        *candidates.columns, "probe", F.col("_p.role").alias("role"), F.col("_p.s").alias("probe_start"), F.col("_p.e").alias("probe_end")
    )


def finding_probes(findings: DataFrame, duration="duration") -> DataFrame:
    """One ten-second context and three-second probes over each short finding."""
    a, b, d = F.col("start"), F.col("end"), F.col(duration)
    rows = findings.where(~F.coalesce(F.col("review_only"), F.lit(False)) & (b - a > 0) & (b - a <= 8))
    context = F.greatest(F.lit(0.0), F.least((a + b) / 2 - 5, d - 10))
    until = F.least(d, context + F.greatest(F.lit(10.0), b - context))
    lo, hi = F.greatest(F.lit(0.0), a - 0.3), F.least(d, b + 0.3)
    last = F.greatest(lo, hi - 3)
    starts = F.array_append(F.transform(_steps(last - lo, 1.5), lambda i: lo + i * 1.5), last)
    probes = F.transform(
        starts, lambda t: F.struct(F.lit("probe").alias("role"), t.alias("s"), F.least(d, t + 3).alias("e"))
    )
    head = F.array(F.struct(F.lit("context").alias("role"), context.alias("s"), until.alias("e")))
    rows = rows.select(*findings.columns, F.posexplode(F.concat(head, probes)).alias("probe", "_p"))
    return rows.select(
        *findings.columns, "probe", F.col("_p.role").alias("role"), F.col("_p.s").alias("probe_start"), F.col("_p.e").alias("probe_end")
    )


def mark_quiet(
    windows: DataFrame, blocks: DataFrame, rate: int, block_size: int, floor_db=-62.0, min_samples=400,
    full_scale: float = 32768.0, by: Sequence[str] = BY,
) -> DataFrame:
    """Add ``quiet``: the window is empty, too short or its RMS lies under the floor.

    ``blocks`` holds ``(block_idx, samples)`` of ``block_size`` samples each.  A
    window names the blocks it touches, so the join is an equi join on the block
    number; inner blocks contribute their precomputed energy and only the two
    edge blocks are sliced.
    """
    by = list(by)
    key = [*by, "start", "end"]
    lo = F.greatest(F.bround(F.col("start") * rate, 0).cast("long"), F.lit(0).cast("long"))
    hi = F.bround(F.col("end") * rate, 0).cast("long")
    spans = windows.select(*key, lo.alias("_lo"), hi.alias("_hi")).distinct()
    first = F.floor(F.col("_lo") / block_size).cast("long")
    last = F.floor((F.col("_hi") - 1) / block_size).cast("long")
    touched = spans.where(F.col("_hi") > F.col("_lo")).withColumn("block_idx", F.explode(F.sequence(first, last)))
    energy = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    stored = blocks.select(*by, "block_idx", "samples", energy(F.col("samples")).alias("_all"), F.size("samples").alias("_size"))
    joined = touched.join(stored, by + ["block_idx"])
    base = F.col("block_idx") * block_size
    start = F.greatest(F.col("_lo") - base, F.lit(0))
    stop = F.least(F.col("_hi") - base, F.col("_size"))
    count = F.greatest(stop - start, F.lit(0)).cast("int")
    part = F.when(count == F.col("_size"), F.col("_all")).otherwise(
        energy(F.slice("samples", (start + 1).cast("int"), count))
    )
    sums = joined.groupBy(*key).agg(F.sum(part).alias("_e"), F.sum(count).alias("_n"))
    floor = (full_scale * 10 ** (floor_db / 20)) ** 2
    quiet = (F.col("_n") < max(min_samples, 1)) | (F.col("_e") / F.greatest(F.col("_n"), F.lit(1)) < floor)
    return windows.join(sums, key, "left").withColumn("quiet", F.coalesce(quiet, F.lit(True))).drop("_e", "_n")
