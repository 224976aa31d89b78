"""Frame levels, sample blocks and seams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import signal
from .evidence_queries import micros
from .fixtures import HOP_CHUNK, levels, packets, scored_view, sql_gaps, sql_merge, sql_us, table, us, vectors, with_views  # noqa: F401
from .registry import query

DB = -26.0
QUIET = "rms < pow(10, -26.0::DOUBLE / 20) AND peak < pow(10, -26.0::DOUBLE / 20) * pow(10, 3.0::DOUBLE / 20)"
SAMPLES = "SELECT rec_id, block_idx, block_idx * 64 + generate_subscripts(em, 1) - 1 AS i, unnest(em) AS v FROM vectors"
RUNS = (
    "SELECT rec_id, min(ordinal) AS s, max(ordinal) + 1 AS e FROM (SELECT rec_id, ordinal, ordinal - row_number() OVER (PARTITION BY rec_id ORDER BY ordinal) AS g "
    f"FROM shipped WHERE {QUIET}) GROUP BY rec_id, g"
)


def micro(c, name=None):
    return F.round(F.col(c) * 1e6).cast("long").alias(name or c)


@query(
    "frame_levels",
    with_views(
        f"SELECT rec_id, block_idx AS frame_idx, {sql_us('greatest(sqrt(avg(v * v) FILTER (i % 64 < 32)), sqrt(avg(v * v) FILTER (i % 64 >= 32)))')} AS rms, "
        f"{sql_us('max(abs(v))')} AS peak FROM x GROUP BY rec_id, block_idx",
        "vectors",
        x=SAMPLES,
    ),
)
def frame_levels(spark, sf):
    """Two channels of 32 samples per block."""
    v = vectors(spark, sf)
    frames = v.select(
        "rec_id", F.col("block_idx").alias("frame_idx"), F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("samples")
    )
    return fr.frame_levels(frames, 32).select("rec_id", "frame_idx", micro("rms"), micro("peak"))


def _ragged(spark, sf):
    """Blocks of 64 samples that overlap by up to 3 or leave holes of up to 3, with long holes at times."""
    v = vectors(spark, sf)
    jump = F.when(F.pmod("vec_id", F.lit(23)) == 22, 40).otherwise(F.pmod(F.col("vec_id") * 5, F.lit(7)) - 3)
    return v.select("rec_id", "block_idx", (F.col("block_idx") * 64 + F.greatest(jump, -F.col("block_idx") * 64)).alias("first_sample"), F.col("embedding").alias("samples"))


_RAGGED = (
    "SELECT rec_id, block_idx, block_idx * 64 + greatest(CASE WHEN vec_id % 23 = 22 THEN 40 ELSE vec_id * 5 % 7 - 3 END, -block_idx * 64) AS f, em FROM vectors"
)
_CURSOR = (
    "SELECT *, greatest(coalesce(max(f + 64) OVER (PARTITION BY rec_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS c FROM b"
)
_LIMIT = 3150


@query(
    "frame_regularize_blocks",
    with_views(
        f"SELECT rec_id, CAST(greatest(f, c) AS BIGINT) AS first_sample, CAST(least(f + 64, {_LIMIT}) - greatest(f, c) AS BIGINT) AS n, "
        f"{sql_us('list_sum(em[CAST(greatest(f, c) - f + 1 AS BIGINT):CAST(least(f + 64, ' + str(_LIMIT) + ') - f AS BIGINT)])')} AS total, FALSE AS filler "
        f"FROM k WHERE least(f + 64, {_LIMIT}) > greatest(f, c) UNION ALL "
        f"SELECT rec_id, CAST(a + i * 32 AS BIGINT), CAST(least(32, least(z, {_LIMIT}) - a - i * 32) AS BIGINT), 0, TRUE FROM (SELECT *, unnest(generate_series(0, CAST(ceil((least(z, {_LIMIT}) - a) / 32.0) AS BIGINT) - 1)) AS i FROM ("
        f"SELECT rec_id, c AS a, f AS z FROM k WHERE f > c UNION ALL SELECT rec_id, max(f + 64), {_LIMIT} FROM k GROUP BY rec_id) WHERE least(z, {_LIMIT}) > a)",
        "vectors",
        b=_RAGGED,
        k=_CURSOR,
    ),
)
def frame_regularize_blocks(spark, sf):
    rows = _ragged(spark, sf)
    limits = rows.select("rec_id").distinct().withColumn("limit", F.lit(_LIMIT).cast("long"))
    blocks, _ = fr.regularize_blocks(rows, limits, 32, block=8)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return blocks.select("rec_id", "first_sample", F.size("samples").cast("long").alias("n"), us(total).alias("total"), "filler")


@query(
    "frame_block_holes",
    with_views(
        f"SELECT rec_id, CAST(a AS BIGINT) AS start, CAST(z AS BIGINT) AS \"end\" FROM (SELECT rec_id, c AS a, f AS z FROM k UNION ALL SELECT rec_id, max(f + 64), {_LIMIT} FROM k GROUP BY rec_id) WHERE z - a > 32",
        "vectors",
        b=_RAGGED,
        k=_CURSOR,
    ),
)
def frame_block_holes(spark, sf):
    rows = _ragged(spark, sf)
    limits = rows.select("rec_id").distinct().withColumn("limit", F.lit(_LIMIT).cast("long"))
    return fr.regularize_blocks(rows, limits, 32, block=8)[1].select("rec_id", "start", "end")


@query(
    "frame_reblock",
    with_views(
        f"SELECT rec_id, CAST(i // 300 AS BIGINT) AS block_idx, CAST(min(i) AS BIGINT) AS first_sample, count(*) AS n, {sql_us('sum(v * (i % 300 + 1))')} AS weighted FROM x GROUP BY rec_id, i // 300",
        "vectors",
        x=SAMPLES,
    ),
)
def frame_reblock(spark, sf):
    v = vectors(spark, sf).select("rec_id", (F.col("block_idx") * 64).alias("first_sample"), F.col("embedding").alias("samples"))
    out = fr.reblock(v, 300)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("rec_id", "block_idx", "first_sample", F.size("samples").cast("long").alias("n"), us(weighted).alias("weighted"))


@query(
    "frame_timestamp_jumps",
    with_views(
        f"SELECT rec_id, ordinal AS frame_idx, {sql_us('step')} AS step FROM (SELECT rec_id, ordinal, pts - lag(pts) OVER (PARTITION BY rec_id ORDER BY ordinal) AS step FROM shipped) WHERE abs(step - 25) > 20",
        "shipped",
    ),
)
def frame_timestamp_jumps(spark, sf):
    rows = packets(spark, sf).select("rec_id", F.col("ordinal").alias("frame_idx"), F.col("pts").alias("source_time"))
    return fr.timestamp_jumps(rows, 25.0, 20, block=256).select("rec_id", "frame_idx", us(F.col("step")).alias("step"))


@query(
    "frame_db",
    with_views(
        f"SELECT rec_id, ordinal AS frame_idx, {sql_us('20 * log10(greatest(rms, 1e-10))')} AS db, "
        f"{sql_us('20 * log10(greatest(max(rms) OVER (PARTITION BY rec_id ORDER BY ordinal ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 1e-10))')} AS wide FROM shipped",
        "shipped",
    ),
)
def frame_db(spark, sf):
    return fr.with_db(levels(spark, sf), block=256).select("rec_id", "frame_idx", micro("db"), micro("wide"))


@query("frame_quiet_spans", with_views('SELECT rec_id, s AS start, e AS "end" FROM q', "shipped", q=RUNS))
def frame_quiet_spans(spark, sf):
    return fr.quiet_spans(levels(spark, sf), DB, block=256)


# Keeps: every second stretch of 40 frames.
_KEEPS = "SELECT DISTINCT rec_id, ordinal // 40 * 40 AS s, ordinal // 40 * 40 + 33 AS e FROM shipped WHERE ordinal // 40 % 2 = 0"
_CLOCK = (
    "SELECT *, coalesce(sum(e - s) OVER (PARTITION BY rec_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM keeps"
)
_JOINED = dict(
    q=RUNS,
    keeps=_KEEPS,
    clock=_CLOCK,
    j0="SELECT c.rec_id, greatest(q.s, c.s) - c.s + c.o AS s, least(q.e, c.e) - c.s + c.o AS e FROM q JOIN clock c ON q.rec_id = c.rec_id AND q.s < c.e AND c.s < q.e",
    j=sql_merge("j0"),
)


def keeps(spark, sf):
    base = F.floor(F.col("ordinal") / 40)
    rows = packets(spark, sf).where(F.pmod(base, F.lit(2)) == 0).select("rec_id", (base * 40).alias("start"), (base * 40 + 33).alias("end"))
    return rows.distinct()


@query(
    "timeline_output_clock",
    with_views('SELECT rec_id, s AS start, CAST(o AS BIGINT) AS output_start, CAST(o + e - s AS BIGINT) AS output_end FROM clock', "shipped", keeps=_KEEPS, clock=_CLOCK),
)
def timeline_output_clock(spark, sf):
    return fr.output_clock(keeps(spark, sf), chunk=256).select("rec_id", "start", "output_start", "output_end")


@query("frame_joined_spans", with_views('SELECT rec_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM j', "shipped", **_JOINED))
def frame_joined_spans(spark, sf):
    quiet = fr.quiet_spans(levels(spark, sf), DB, block=256)
    return fr.joined_spans(keeps(spark, sf), quiet, chunk=256)


_BUDGET = 5
_TRIM = dict(
    **_JOINED,
    cuts=f"SELECT rec_id, s + {_BUDGET} // 2 AS s, e - ({_BUDGET} - {_BUDGET} // 2) AS e FROM j WHERE e - s > {_BUDGET}",
    removed="SELECT c.rec_id, c.s AS unit, greatest(x.s, c.o) - c.o + c.s AS s, least(x.e, c.o + c.e - c.s) - c.o + c.s AS e FROM cuts x JOIN clock c ON c.rec_id = x.rec_id AND x.s < c.o + c.e - c.s AND c.o < x.e",
    u="SELECT rec_id || '/' || s AS k, s AS lo, e AS hi FROM keeps",
    rk="SELECT rec_id || '/' || unit AS k, s, e FROM removed",
    g=sql_gaps("rk", "u", "k"),
)


def _trimmed(spark, sf, which):
    quiet = fr.quiet_spans(levels(spark, sf), DB, block=256)
    parts = fr.trim_quiet(keeps(spark, sf), quiet, F.lit(_BUDGET), True, chunk=256)
    return parts[which].select("rec_id", "unit", "start", "end")


@query("frame_trim_quiet_removed", with_views('SELECT rec_id, CAST(unit AS BIGINT) AS unit, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM removed', "shipped", **_TRIM))
def frame_trim_quiet_removed(spark, sf):
    return _trimmed(spark, sf, 1)


@query(
    "frame_trim_quiet_kept",
    with_views(
        "SELECT CAST(split_part(k, '/', 1) AS BIGINT) AS rec_id, CAST(split_part(k, '/', 2) AS BIGINT) AS unit, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM g",
        "shipped",
        **_TRIM,
    ),
)
def frame_trim_quiet_kept(spark, sf):
    return _trimmed(spark, sf, 0)


def frame_policy(spark, sf):
    """Pause settings per supplier; frames of 0.05 s."""
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("rec_id"),
        (0.3 + F.pmod("s_suppkey", F.lit(7)) * 0.1).alias("max_pause_seconds"),
        (0.05 + F.pmod("s_suppkey", F.lit(5)) * 0.05).alias("join_fade_seconds"),
        (F.pmod("s_suppkey", F.lit(2)) == 0).alias("join_fade_enabled"),
        F.lit(0.05).alias("dt"),
    )


_POLICY = (
    "SELECT s_suppkey AS rec_id, 0.3::DOUBLE + s_suppkey % 7 * 0.1::DOUBLE AS p, 0.05::DOUBLE + s_suppkey % 5 * 0.05::DOUBLE AS f, s_suppkey % 2 = 0 AS j FROM supplier"
)
_B = "greatest(0.05::DOUBLE, p - least(p * 0.1::DOUBLE, 0.1::DOUBLE) - CASE WHEN j THEN least(f, p * 0.225::DOUBLE) * 2 ELSE 0 END)"


@query(
    "frame_quiet_budget",
    with_views(
        f"SELECT rec_id, {sql_us(_B)} AS budget, {sql_us('least(f, p * 0.225::DOUBLE)')} AS fade, greatest(1, CAST(floor({_B} / 0.05::DOUBLE) AS BIGINT)) AS frames FROM policy",
        policy=_POLICY,
    ),
)
def frame_quiet_budget(spark, sf):
    p = frame_policy(spark, sf)
    budget = fr.quiet_budget(F.col("max_pause_seconds"), F.col("join_fade_seconds"), F.col("join_fade_enabled"), F.col("dt"))
    fade = fr.fade_seconds(F.col("max_pause_seconds"), F.col("join_fade_seconds"))
    return p.select("rec_id", us(budget).alias("budget"), us(fade).alias("fade"), fr.frame_budget(p).alias("frames"))


_LIMITED = {
    **_JOINED,
    "policy": _POLICY,
    "b": f"SELECT rec_id, greatest(1, CAST(floor({_B} / 0.05::DOUBLE) AS BIGINT)) AS b FROM policy",
    "cuts": "SELECT j.rec_id, s + b // 2 AS s, e - (b - b // 2) AS e FROM j JOIN b ON b.rec_id = j.rec_id WHERE e - s > b",
    "removed": _TRIM["removed"],
}


@query("frame_limit_pauses", with_views('SELECT rec_id, CAST(unit AS BIGINT) AS unit, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM removed', "shipped", **_LIMITED))
def frame_limit_pauses(spark, sf):
    quiet = fr.quiet_spans(levels(spark, sf), DB, block=256)
    _, removed = fr.limit_pauses(keeps(spark, sf), quiet, frame_policy(spark, sf), block=256)
    return removed.select("rec_id", "unit", "start", "end")


@query(
    "frame_longest_gesture",
    with_views(
        f'SELECT k.rec_id, k.s AS start, k.e AS "end", CAST(coalesce(a.n, 0) AS BIGINT) AS active, {sql_us("coalesce(l.n, 0) * 0.05::DOUBLE")} AS longest FROM keeps k '
        "LEFT JOIN (SELECT rec_id, s, sum(a) AS n FROM fr GROUP BY rec_id, s) a ON a.rec_id = k.rec_id AND a.s = k.s "
        "LEFT JOIN (SELECT rec_id, s, max(n) AS n FROM (SELECT rec_id, s, count(*) AS n FROM (SELECT *, ordinal - row_number() OVER (PARTITION BY rec_id, s ORDER BY ordinal) AS g FROM closed WHERE c = 7) GROUP BY rec_id, s, g) GROUP BY rec_id, s) l "
        "ON l.rec_id = k.rec_id AND l.s = k.s",
        "shipped",
        keeps=_KEEPS,
        fr="SELECT k.rec_id, k.s, f.ordinal, CAST(20 * log10(greatest(f.rms, 1e-10)) > -24.0 AS INTEGER) AS a FROM keeps k JOIN shipped f ON f.rec_id = k.rec_id AND f.ordinal >= k.s AND f.ordinal < k.e",
        wide="SELECT *, max(a) OVER (PARTITION BY rec_id, s ORDER BY ordinal ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS d FROM fr",
        closed="SELECT *, sum(d) OVER (PARTITION BY rec_id, s ORDER BY ordinal ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS c FROM wide",
    ),
)
def frame_longest_gesture(spark, sf):
    out = fr.gestures(levels(spark, sf), keeps(spark, sf), -30.0, 0.05, block=256)
    return out.select("rec_id", "start", "end", "active", us(F.col("longest")).alias("longest"))


def stereo(spark, sf):
    """One block of 64 samples in two channels, the second one half as loud."""
    v = vectors(spark, sf)
    return v.select(
        "rec_id", "block_idx", (F.col("block_idx") * 64).alias("first_sample"),
        F.array(F.col("embedding"), F.transform("embedding", lambda x: x * 0.5)).alias("samples"),
    )


_METER = dict(
    x=SAMPLES,
    w="SELECT rec_id, i // 4 AS k, min(i) AS a, max(i) + 1 AS z, sqrt(avg(v * v)) AS rms, max(abs(v)) AS pk FROM x GROUP BY rec_id, i // 4",
    qw="SELECT *, k - row_number() OVER (PARTITION BY rec_id ORDER BY k) AS g FROM w WHERE rms < pow(10, -15.0::DOUBLE / 20) AND pk < pow(10, -15.0::DOUBLE / 20) * pow(10, 3.0::DOUBLE / 20)",
    r="SELECT rec_id, min(a) / 200.0::DOUBLE AS s, max(z) / 200.0::DOUBLE AS e FROM qw GROUP BY rec_id, g",
)


@query(
    "frame_quiet_meter",
    with_views(
        f"SELECT v.rec_id, {sql_us('round_even(coalesce(m.l, 0), 4)')} AS longest, coalesce(m.l, 0) <= 0.3::DOUBLE + 1e-6 AS within_limit FROM (SELECT DISTINCT rec_id FROM vectors) v "
        "LEFT JOIN (SELECT rec_id, max(e - s) AS l FROM r GROUP BY rec_id) m ON m.rec_id = v.rec_id",
        "vectors",
        **_METER,
    ),
)
def frame_quiet_meter(spark, sf):
    report, _ = signal.quiet_meter(stereo(spark, sf), 200, -15.0, 0.3, chunk_seconds=2.0)
    return report.select("rec_id", us(F.col("max_detected_seconds")).alias("longest"), "within_limit")


@query("frame_quiet_over_limit", with_views(SECONDS_ := f'SELECT rec_id, {sql_us("s")} AS start, {sql_us("e")} AS "end" FROM r WHERE e - s >= 0.3::DOUBLE AND e - s > 0.3::DOUBLE + 1e-6', "vectors", **_METER))
def frame_quiet_over_limit(spark, sf):
    return micros(signal.quiet_meter(stereo(spark, sf), 200, -15.0, 0.3, chunk_seconds=2.0)[1])


# Spectrum of 64-sample blocks at 256 Hz (0.25 s), 64-point transform.
_DFT = dict(
    m="SELECT rec_id, block_idx, i % 64 AS n, v - avg(v) OVER (PARTITION BY rec_id, block_idx) AS v FROM x",
    t="SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS w FROM m",
    f="SELECT rec_id, block_idx, k, pow(sum(w * cos(2 * pi() * k * n / 64)), 2) + pow(sum(w * sin(2 * pi() * k * n / 64)), 2) AS p FROM t, (SELECT unnest(generate_series(1, 32)) AS k) GROUP BY rec_id, block_idx, k",
    g="SELECT rec_id, block_idx, sum(p) FILTER (k * 4 BETWEEN 8 AND 120) AS total, sum(p * k * 4) FILTER (k * 4 BETWEEN 8 AND 120) AS moment, sum(p) FILTER (k * 4 BETWEEN 40 AND 120) AS high FROM f GROUP BY rec_id, block_idx",
    r="SELECT rec_id, block_idx, sqrt(avg(v * v)) AS rms FROM m GROUP BY rec_id, block_idx",
)
TRACE = dict(rate=256, step=0.25, n_fft=64, audible=(8, 120), high=(40, 120), full_scale=1.0)


@query(
    "signal_spectral_trace",
    with_views(
        # The trace holds 32-bit values; what is rounded here is such a value.
        "SELECT g.rec_id, g.block_idx AS i, CAST(round(CAST(20 * log10(rms) AS FLOAT)::DOUBLE * 100) AS BIGINT) AS db, CAST(round(CAST(10 * log10(high / total) AS FLOAT)::DOUBLE * 100) AS BIGINT) AS high_db, "
        "CAST(round(CAST(moment / total AS FLOAT)::DOUBLE * 100) AS BIGINT) AS centroid FROM g JOIN r ON r.rec_id = g.rec_id AND r.block_idx = g.block_idx",
        "vectors",
        x=SAMPLES,
        **_DFT,
    ),
)
def signal_spectral_trace(spark, sf):
    v = vectors(spark, sf).select("rec_id", F.col("block_idx").alias("i"), F.col("embedding").alias("samples"))
    t = signal.spectral_trace(v, **TRACE)
    return t.select("rec_id", "i", *[F.round(F.col(c).cast("double") * 100).cast("long").alias(c) for c in ("db", "high_db", "centroid")])


@query("signal_log_mel")
def signal_log_mel(spark, sf):
    """Features of joined blocks of 800 samples: frames, mean and spread of all their bins (tested against a plain loop).

    A frame belongs to the block it begins in, so a block also reads the 240 samples that its last
    frames need; what only pads the features is not counted.
    """
    v = vectors(spark, sf).select("rec_id", (F.col("block_idx") * 64).alias("first_sample"), F.transform("embedding", lambda x: x * 32768).alias("samples"))
    blocks = fr.reblock(v, 800, after=240)
    frames = F.greatest(F.floor((F.size("samples") - 400) / 160) + 1, F.lit(0)).cast("int")
    f = signal.log_mel(blocks.withColumn("frames", frames))
    bins = F.transform(F.flatten(F.slice("features", 1, F.col("frames"))), lambda x: x.cast("double"))
    f = f.select("rec_id", "block_idx", "frames", "truncated", bins.alias("bins"))
    # No frame: no bins, and nothing to divide by.
    of = lambda term: F.aggregate("bins", F.lit(0.0), lambda a, x: a + term(x)) / F.nullif(F.size("bins"), F.lit(0))
    f = f.select("rec_id", "block_idx", "frames", "truncated", of(lambda x: x).alias("mean"), of(lambda x: x * x).alias("square"))
    spread = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    spread = F.when(F.col("mean").isNotNull(), spread)
    thousandths = lambda c: F.round(c * 1000).cast("long")
    return f.select("rec_id", "block_idx", "frames", thousandths(F.col("mean")).alias("mean"), thousandths(spread).alias("spread"), "truncated")


# Seams: every block begins a mapped piece; pieces of 1.25 to 2.75 s follow each other on the output clock (32 samples per second).
def pieces(spark, sf):
    at = lambda b: b * 2.0 + F.pmod(b * b, F.lit(7)) * 0.25
    b = F.col("block_idx")
    return vectors(spark, sf).select("rec_id", at(b).alias("output_start"), at(b + 1).alias("output_end"))


_AT = "({b}) * 2.0::DOUBLE + ({b}) * ({b}) % 7 * 0.25::DOUBLE"
_PIECES = f"SELECT rec_id, {_AT.format(b='block_idx')} AS a, {_AT.format(b='block_idx + 1')} AS z FROM vectors"
_RAMPS = (
    "SELECT rec_id, cut, unnest([FALSE, TRUE]) AS incoming, unnest([cut - n, cut]) AS s, unnest([cut, cut + m]) AS e FROM ("
    "SELECT rec_id, CAST(round_even(na * 32, 0) AS BIGINT) AS cut, greatest(1, CAST(round_even(least(0.9::DOUBLE, (z - a) / 4) * 32, 0) AS BIGINT)) AS n, "
    "greatest(1, CAST(round_even(least(0.9::DOUBLE, (nz - na) / 4) * 32, 0) AS BIGINT)) AS m FROM (SELECT *, lead(a) OVER w AS na, lead(z) OVER w AS nz FROM pieces WINDOW w AS (PARTITION BY rec_id ORDER BY a)) WHERE na IS NOT NULL)"
)


@query("seam_ramps", with_views('SELECT rec_id, cut AS seam, s AS start, e AS "end", incoming FROM ramps', "vectors", pieces=_PIECES, ramps=_RAMPS))
def seam_ramps(spark, sf):
    return signal.seam_ramps(pieces(spark, sf), 32, 0.9, chunk=HOP_CHUNK)


@query(
    "seam_edge_ramps",
    with_views(
        'SELECT rec_id, unnest([0, greatest(0, d - m)]) AS start, unnest([n, d]) AS "end", unnest([TRUE, FALSE]) AS incoming FROM ('
        "SELECT rec_id, CAST(round_even(max(z) * 32, 0) AS BIGINT) AS d, greatest(1, CAST(round_even(least(0.9::DOUBLE, arg_min(z - a, a) / 4) * 32, 0) AS BIGINT)) AS n, "
        "greatest(1, CAST(round_even(least(0.9::DOUBLE, arg_max(z - a, a) / 4) * 32, 0) AS BIGINT)) AS m FROM pieces GROUP BY rec_id)",
        "vectors",
        pieces=_PIECES,
    ),
)
def seam_edge_ramps(spark, sf):
    p = pieces(spark, sf)
    recs = p.groupBy("rec_id").agg(F.max("output_end").alias("duration"))
    return signal.edge_ramps(p, recs, 32, 0.9)


_FADED = dict(
    pieces=_PIECES,
    ramps=_RAMPS,
    x=SAMPLES,
    hit="SELECT x.rec_id, x.i, x.block_idx, x.v, r.incoming, r.s, r.e, r.cut FROM x LEFT JOIN ramps r ON r.rec_id = x.rec_id AND x.i >= r.s AND x.i < r.e",
)


def _envelope(spark, sf):
    blocks = vectors(spark, sf).select("rec_id", "block_idx", F.col("embedding").alias("samples"))
    return signal.apply_envelope(blocks, signal.seam_ramps(pieces(spark, sf), 32, 0.9, chunk=HOP_CHUNK), 64)


@query(
    "seam_apply_envelope",
    with_views(
        # Samples and gains are 32-bit values, as in the operator; sums run in the order of the samples.
        "SELECT rec_id, block_idx, CAST(round(coalesce(sum(CAST(CASE WHEN s IS NULL THEN CAST(v AS FLOAT) ELSE CAST(v AS FLOAT) * CAST(CASE WHEN e - s = 1 THEN 0 WHEN incoming THEN (i - s) / (e - s - 1.0::DOUBLE) "
        "ELSE 1 - (i - s) / (e - s - 1.0::DOUBLE) END AS FLOAT) END AS DOUBLE) * (i % 64 + 1) ORDER BY i), 0) * 1000) AS BIGINT) AS weighted FROM hit GROUP BY rec_id, block_idx",
        "vectors",
        **_FADED,
    ),
)
def seam_apply_envelope(spark, sf):
    blocks, _ = _envelope(spark, sf)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return blocks.select("rec_id", "block_idx", F.round(weighted * 1000).cast("long").alias("weighted"))


_LEVELS = "SELECT rec_id, cut, 10 * log10(greatest(avg(v * v) FILTER (NOT incoming), 1e-12)) AS l, 10 * log10(greatest(avg(v * v) FILTER (incoming), 1e-12)) AS r FROM hit WHERE s IS NOT NULL GROUP BY rec_id, cut"


@query(
    "seam_levels",
    with_views(
        "SELECT rec_id, cut AS seam, CAST(round(l * 100) AS BIGINT) AS left_db, CAST(round(r * 100) AS BIGINT) AS right_db, CAST(round((r - l) * 100) AS BIGINT) AS difference FROM y WHERE l IS NOT NULL AND r IS NOT NULL",
        "vectors",
        **_FADED,
        y=_LEVELS,
    ),
)
def seam_levels(spark, sf):
    _, energy = _envelope(spark, sf)
    rows = signal.seam_levels(energy).where(F.col("left_rms_db").isNotNull() & F.col("right_rms_db").isNotNull())
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return rows.select("rec_id", "seam", cents("left_rms_db").alias("left_db"), cents("right_rms_db").alias("right_db"), cents("level_difference_db").alias("difference"))


@query(
    "seam_discontinuity",
    with_views(
        "SELECT rec_id, cut AS seam, CAST(round(jump * 1000) AS BIGINT) AS jump, CAST(round(jump / greatest(q, 1e-8) * 100) AS BIGINT) AS ratio, jump > 0.01 AND jump / greatest(q, 1e-8) > 3 AS review FROM ("
        "SELECT rec_id, cut, max(d) FILTER (k BETWEEN 152 AND 167) AS jump, quantile_cont(d, 0.999) FILTER (k < 96 OR k >= 224) AS q FROM ("
        "SELECT c.rec_id, c.cut, x.i - c.cut + 160 AS k, abs(CAST(lead(x.v) OVER (PARTITION BY c.rec_id, c.cut ORDER BY x.i) AS FLOAT) - CAST(x.v AS FLOAT)) AS d "
        "FROM cuts c JOIN x ON x.rec_id = c.rec_id AND x.i >= c.cut - 160 AND x.i < c.cut + 160) WHERE d IS NOT NULL GROUP BY rec_id, cut)",
        "vectors",
        pieces=_PIECES,
        ramps=_RAMPS,
        x=SAMPLES,
        cuts="SELECT DISTINCT r.rec_id, cut FROM ramps r JOIN (SELECT rec_id, max(i) + 1 AS n FROM x GROUP BY rec_id) m ON m.rec_id = r.rec_id WHERE cut >= 160 AND cut + 160 <= n",
    ),
)
def seam_discontinuity(spark, sf):
    seams = signal.seam_ramps(pieces(spark, sf), 32, 0.9, chunk=HOP_CHUNK).select("rec_id", "seam").distinct()
    blocks = vectors(spark, sf).select("rec_id", "block_idx", F.col("embedding").alias("samples"))
    rows = signal.seam_discontinuity(seams, blocks, 64, reach=160)
    return rows.select("rec_id", "seam", F.round(F.col("jump") * 1000).cast("long").alias("jump"), F.round(F.col("ratio") * 100).cast("long").alias("ratio"), F.col("review_suggested").alias("review"))
