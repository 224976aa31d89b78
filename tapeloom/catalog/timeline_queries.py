"""Clock mapping, packets and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocabulary import TITLES
from ..operators import chapters as ch
from ..operators import frames as fr
from ..operators import labels
from ..operators import packets as pk
from ..operators import timeline as tl
from ..operators.scan import running
from ..session import materialize
from .evidence_queries import micros
from .fixtures import packets, shipped, spans, sql_gaps, sql_merge, sql_us, table, us, with_views
from .frame_queries import DB, RUNS, _CLOCK, _KEEPS, keeps
from .label_queries import IDENTIFY, _MENU, _menu_sql, menu_scores
from .registry import query

C = 512.0
OUT = f'SELECT rec_id, {sql_us("s")} AS start, {sql_us("e")} AS "end" FROM '

# Findings on the output clock: short spans from orders of the supplier number.
_FINDINGS = (
    "SELECT o_orderkey % {n} AS rec_id, o_orderkey AS id, o_custkey % 300 * 0.5::DOUBLE AS s, o_custkey % 300 * 0.5::DOUBLE + o_orderkey % 9 * 0.25::DOUBLE AS e, "
    "o_orderstatus = 'P' AS review_only FROM orders"
)
N = "(SELECT count(*) FROM supplier)"


def findings(spark, sf):
    o = table(spark, sf, "orders").withColumn("n", F.lit(table(spark, sf, "supplier").count()))
    at = F.pmod("o_custkey", F.lit(300)) * 0.5
    return o.select(
        F.pmod("o_orderkey", F.col("n")).alias("rec_id"),
        F.col("o_orderkey").alias("id"),
        at.alias("start"),
        (at + F.pmod("o_orderkey", F.lit(9)) * 0.25).alias("end"),
        (F.col("o_orderstatus") == "P").alias("review_only"),
    )


_M2 = dict(
    findings=_FINDINGS.format(n=N),
    keeps=_KEEPS,
    clock=_CLOCK,
    z="SELECT c.rec_id, greatest(f.s, c.o * 0.5::DOUBLE) - c.o * 0.5::DOUBLE + c.s * 0.5::DOUBLE AS s, least(f.e, (c.o + c.e - c.s) * 0.5::DOUBLE) - c.o * 0.5::DOUBLE + c.s * 0.5::DOUBLE AS e "
    "FROM findings f JOIN clock c ON c.rec_id = f.rec_id AND f.s < (c.o + c.e - c.s) * 0.5::DOUBLE AND c.o * 0.5::DOUBLE < f.e AND f.e > f.s WHERE NOT f.review_only",
    m=sql_merge("z", "0.25"),
    m65=sql_merge("z", "0.65"),
)


@query("timeline_output_to_source", with_views(OUT + "m", "shipped", **_M2))
def timeline_output_to_source(spark, sf):
    return micros(tl.output_to_source(findings(spark, sf), keeps(spark, sf), 0.5, chunk=C))


@query("timeline_audit_map", with_views(OUT + "m65", "shipped", **_M2))
def timeline_audit_map(spark, sf):
    return micros(tl.audit_map(findings(spark, sf), keeps(spark, sf), 0.5, chunk=C))


_MAPPING = "SELECT rec_id, s * 0.5::DOUBLE + 1000 AS a, e * 0.5::DOUBLE + 1000 AS ae, o * 0.5::DOUBLE AS os, (o + e - s) * 0.5::DOUBLE AS oe, s % 240 = 0 AS gone FROM clock"


def mapping(spark, sf):
    clock = fr.output_clock(keeps(spark, sf), chunk=C)
    # Some rows lack the analysis clock.
    gone = F.pmod("start", F.lit(240)) == 0
    at = lambda c: F.when(~gone, F.col(c) * 0.5 + 1000)
    return clock.select(
        "rec_id", at("start").alias("analysis_start"), at("end").alias("analysis_end"),
        (F.col("output_start") * 0.5).alias("output_start"), (F.col("output_end") * 0.5).alias("output_end"),
    )


_MAPPED = dict(findings=_FINDINGS.format(n=N), keeps=_KEEPS, clock=_CLOCK, mp=_MAPPING)


@query(
    "timeline_mapped_output_to_source",
    with_views(
        OUT + "m",
        "shipped",
        **_MAPPED,
        z="SELECT p.rec_id, greatest(f.s, os) - os + a AS s, least(f.e, oe) - os + a AS e FROM findings f JOIN mp p ON p.rec_id = f.rec_id AND f.s < oe AND os < f.e AND f.e > f.s WHERE NOT review_only AND NOT gone",
        m=sql_merge("z", "0.25"),
    ),
)
def timeline_mapped_output_to_source(spark, sf):
    known = mapping(spark, sf).where(F.col("analysis_start").isNotNull())
    return micros(tl.mapped_output_to_source(findings(spark, sf), known, chunk=C))


_FORWARD = dict(
    **_MAPPED,
    src="SELECT rec_id, id, s * 1.5::DOUBLE + 1000 AS s, e * 1.5::DOUBLE + 1001 AS e FROM findings",
    z="SELECT p.rec_id, greatest(f.s, a) - a + os AS s, least(oe, least(f.e, ae) - a + os) AS e FROM src f JOIN mp p ON p.rec_id = f.rec_id AND f.s < ae AND a < f.e WHERE NOT gone",
    m=sql_merge("z"),
)


def _sources(spark, sf):
    f = findings(spark, sf)
    return f.select("rec_id", "id", (F.col("start") * 1.5 + 1000).alias("start"), (F.col("end") * 1.5 + 1001).alias("end"))


@query("timeline_source_to_output", with_views(OUT + "m", "shipped", **_FORWARD))
def timeline_source_to_output(spark, sf):
    return micros(tl.source_to_output(_sources(spark, sf), mapping(spark, sf), chunk=C))


_PERMIT = dict(
    findings=_FINDINGS.format(n=N),
    reviews="SELECT s_suppkey AS rec_id, CASE s_suppkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'speech_found' END AS status FROM supplier",
    mask0="SELECT rec_id, s - 0.1::DOUBLE AS s, e + 20 AS e FROM findings WHERE id % 40 = 0",
    m=sql_merge("mask0"),
    u="SELECT DISTINCT rec_id, -1.0::DOUBLE AS lo, 100000.0::DOUBLE AS hi FROM findings",
    g=sql_gaps("m", "u"),
    live="SELECT f.* FROM findings f JOIN reviews r ON r.rec_id = f.rec_id WHERE r.status != 'failed' AND f.e > f.s",
    cut="SELECT f.rec_id, f.id, greatest(f.s, m.s) AS s, least(f.e, m.e) AS e, TRUE AS permitted FROM live f JOIN m ON m.rec_id = f.rec_id AND f.s < m.e AND m.s < f.e UNION ALL "
    "SELECT f.rec_id, f.id, greatest(f.s, g.s), least(f.e, g.e), FALSE FROM live f JOIN g ON g.rec_id = f.rec_id AND f.s < g.e AND g.s < f.e UNION ALL "
    "SELECT f.rec_id, f.id, f.s, f.e, FALSE FROM findings f JOIN reviews r ON r.rec_id = f.rec_id WHERE r.status = 'failed'",
)


def _permissions(spark, sf):
    f = findings(spark, sf)
    n = F.pmod("s_suppkey", F.lit(4))
    status = F.when(n == 0, "passed").when(n == 1, "failed").otherwise("speech_found")
    reviews = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("rec_id"), status.alias("status"))
    mask = f.where(F.pmod("id", F.lit(40)) == 0).select("rec_id", (F.col("start") - 0.1).alias("start"), (F.col("end") + 20).alias("end"))
    return tl.apply_permissions(f, reviews, mask, ["id"], chunk=C)


@query(
    "timeline_apply_permissions",
    with_views(f'SELECT rec_id, id, {sql_us("s")} AS start, {sql_us("e")} AS "end", permitted FROM cut', **_PERMIT),
)
def timeline_apply_permissions(spark, sf):
    return micros(_permissions(spark, sf)[0], "id", "permitted")


@query(
    "timeline_review_status",
    with_views(
        "SELECT r.rec_id, CASE WHEN status = 'failed' THEN status WHEN EXISTS (SELECT 1 FROM cut c WHERE c.rec_id = r.rec_id AND NOT permitted) THEN 'speech_found' ELSE 'passed' END AS status FROM reviews r",
        **_PERMIT,
    ),
)
def timeline_review_status(spark, sf):
    return _permissions(spark, sf)[1]


@query(
    "timeline_source_intervals",
    with_views(
        f'SELECT k.rec_id, k.s AS start, k.e AS "end", {sql_us("a.pts")} AS source_start, {sql_us("b.pts + 0.5::DOUBLE")} AS source_end FROM keeps k '
        "JOIN shipped a ON a.rec_id = k.rec_id AND a.ordinal = k.s JOIN shipped b ON b.rec_id = k.rec_id AND b.ordinal = k.e - 1",
        "shipped",
        keeps=_KEEPS,
    ),
)
def timeline_source_intervals(spark, sf):
    frames = packets(spark, sf).select("rec_id", F.col("ordinal").alias("frame_idx"), F.col("pts").alias("source_time"))
    rows = tl.source_intervals(keeps(spark, sf), frames, 0.5)
    return rows.select("rec_id", "start", "end", us(F.col("source_start")).alias("source_start"), us(F.col("source_end")).alias("source_end"))


# Packets.
_GROUPS = (
    "SELECT *, coalesce(lead(s) OVER (PARTITION BY rec_id ORDER BY first), max_end) AS e FROM ("
    "SELECT rec_id, grp, min(ordinal) AS first, max(ordinal) + 1 AS stop, min_by(pts, ordinal) AS s, min(pts) AS min_pts, max(pts + duration) AS max_end FROM ("
    "SELECT *, sum(is_key::INT) OVER (PARTITION BY rec_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS grp FROM shipped) WHERE grp > 0 GROUP BY rec_id, grp)"
)


def groups(spark, sf):
    return pk.keyframe_groups(packets(spark, sf), block=256)


@query(
    "packet_keyframe_groups",
    with_views(
        f'SELECT rec_id, first, stop, {sql_us("s")} AS start, {sql_us("e")} AS "end", {sql_us("min_pts")} AS min_pts, {sql_us("max_end")} AS max_end FROM g',
        "shipped",
        g=_GROUPS,
    ),
)
def packet_keyframe_groups(spark, sf):
    g = groups(spark, sf)
    return g.select("rec_id", "first", "stop", *[us(F.col(c)).alias(c) for c in ("start", "end", "min_pts", "max_end")])


# Source intervals: stretches of 700 every 1000 on the packet clock.
_SOURCES = "SELECT DISTINCT rec_id, floor(pts / 1000) * 1000 + 13 AS s, floor(pts / 1000) * 1000 + 713 AS e FROM shipped"


def sources(spark, sf):
    base = F.floor(F.col("pts") / 1000) * 1000.0
    return packets(spark, sf).select(
        "rec_id", (base + 13).alias("source_start"), (base + 713).alias("source_end"), (base + 5).alias("analysis_start"), (base + 705).alias("analysis_end")
    ).distinct()


_ALIGNED = dict(
    g=_GROUPS,
    src=_SOURCES,
    held="SELECT g.*, i.s AS unit FROM g JOIN src i ON i.rec_id = g.rec_id AND g.s >= i.s - 1e-7 AND g.e <= i.e + 1e-7 AND g.min_pts >= g.s - 1e-7 AND g.max_end <= g.e + 1e-5",
    runs="SELECT *, sum(CASE WHEN pstop = first AND punit = unit THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY first ROWS UNBOUNDED PRECEDING) AS run FROM ("
    "SELECT *, lag(stop) OVER w AS pstop, lag(unit) OVER w AS punit FROM held WINDOW w AS (PARTITION BY rec_id ORDER BY first))",
    al="SELECT rec_id, min(first) AS first, max(stop) AS stop, min(s) AS s, max(e) AS e, min(s) - min(unit) + min(unit) - 8 AS a FROM runs GROUP BY rec_id, run",
)


@query(
    "packet_align_groups",
    with_views(
        f"SELECT rec_id, first, stop, {sql_us('s')} AS source_start, {sql_us('e')} AS source_end, {sql_us('a')} AS analysis_start FROM al", "shipped", **_ALIGNED
    ),
)
def packet_align_groups(spark, sf):
    rows = pk.align_groups(groups(spark, sf), sources(spark, sf), chunk=2000.0, block=256)
    return rows.select("rec_id", "first", "stop", *[us(F.col(c)).alias(c) for c in ("source_start", "source_end", "analysis_start")])


@query("packet_limit_groups")
def packet_limit_groups(spark, sf):
    """Fix point over whole groups (brute-force test in tests/test_store.py)."""
    g = groups(spark, sf)
    rows = pk.align_groups(g, sources(spark, sf), chunk=2000.0, block=256)
    quiet = packets(spark, sf).where(F.pmod("ordinal", F.lit(9)) < 4).select(
        "rec_id", (F.col("pts") - 8).alias("start"), (F.col("pts") + F.col("duration") - 8).alias("end")
    )
    out = pk.limit_groups(rows, g, quiet, 60.0, chunk=2000.0)
    return out.select("rec_id", "first", "stop", *[us(F.col(c)).alias(c) for c in ("source_start", "source_end", "analysis_start")])


@query(
    "packet_align_frames",
    with_views(
        f"SELECT rec_id, {sql_us('min(pts)')} AS source_start, {sql_us('max(pts + duration)')} AS source_end, {sql_us('min(pts) - 8')} AS analysis_start, min(ordinal) AS video_frame_first, max(ordinal) + 1 AS video_frame_stop "
        "FROM (SELECT p.*, i.s AS unit FROM shipped p JOIN src i ON i.rec_id = p.rec_id AND p.pts >= i.s - 1e-7 AND p.pts + p.duration <= i.e + 1e-7) GROUP BY rec_id, unit",
        "shipped",
        src=_SOURCES,
    ),
)
def packet_align_frames(spark, sf):
    frames = packets(spark, sf).select(
        "rec_id", F.col("ordinal").alias("frame_idx"), F.col("pts").alias("start"), (F.col("pts") + F.col("duration")).alias("end")
    )
    rows = pk.align_frames(frames, sources(spark, sf), chunk=2000.0)
    return rows.select(
        "rec_id", *[us(F.col(c)).alias(c) for c in ("source_start", "source_end", "analysis_start")], "video_frame_first", "video_frame_stop"
    )


_ASSIGN = dict(
    src=_SOURCES,
    mp="SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY s) AS seq, coalesce(sum(e - s) OVER (PARTITION BY rec_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM src",
    latest="SELECT p.rec_id, p.ordinal, p.pts, p.duration, p.size, m.seq, m.s, m.e, m.o FROM shipped p ASOF JOIN mp m ON m.rec_id = p.rec_id AND p.pts + 1e-8 >= m.s",
    asg="SELECT * FROM latest WHERE pts + duration <= e + 1e-7",
)


def packet_mapping(spark, sf):
    s = sources(spark, sf).select("rec_id", F.col("source_start").alias("start"), F.col("source_end").alias("end"))
    clock = fr.output_clock(s, chunk=2000.0)
    seq = F.floor(F.col("start") / 1000).cast("long") + 1
    return clock.select("rec_id", seq.alias("seq"), F.col("start").alias("source_start"), F.col("end").alias("source_end"), "output_start", "output_end")


@query(
    "packet_assign",
    with_views(f"SELECT rec_id, ordinal, {sql_us('s')} AS source, {sql_us('pts + o - s')} AS output_pts FROM asg", "shipped", **_ASSIGN),
)
def packet_assign(spark, sf):
    rows = pk.assign_packets(packets(spark, sf), packet_mapping(spark, sf), chunk=2000.0)
    source = (F.col("seq") - 1) * 1000.0 + 13
    return rows.select("rec_id", "ordinal", us(source).alias("source"), us(F.col("output_pts")).alias("output_pts"))


@query(
    "packet_segment_stats",
    with_views(
        f"SELECT m.rec_id, {sql_us('m.s')} AS source, coalesce(n, 0) AS packets, coalesce({sql_us('a - m.s')}, -1) AS start_gap, coalesce({sql_us('m.e - z')}, -1) AS end_gap, "
        f"coalesce({sql_us('b * 8 / (m.e - m.s)')}, -1) AS bitrate, n IS NULL AS \"empty\" FROM mp m LEFT JOIN ("
        "SELECT rec_id, seq, count(*) AS n, min(pts) AS a, max(pts + duration) AS z, CAST(sum(size) AS DOUBLE) AS b FROM asg GROUP BY rec_id, seq) s ON s.rec_id = m.rec_id AND s.seq = m.seq",
        "shipped",
        **_ASSIGN,
    ),
)
def packet_segment_stats(spark, sf):
    m = packet_mapping(spark, sf)
    rows = pk.segment_packet_stats(pk.assign_packets(packets(spark, sf), m, chunk=2000.0), m)
    none = F.lit(-1).cast("long")
    return rows.select(
        "rec_id", us((F.col("seq") - 1) * 1000.0 + 13).alias("source"), "packets",
        *[F.coalesce(us(F.col(c)), none).alias(c) for c in ("start_gap", "end_gap", "bitrate")], "empty",
    )


def _payload(spark, sf):
    return packets(spark, sf).withColumn("payload", F.concat_ws("/", "l_orderkey", "size"))


_COPY = (
    "SELECT rec_id, ordinal, pts + CASE WHEN ordinal % 13 = 0 THEN 0.5::DOUBLE ELSE 0 END AS pts, size, CASE WHEN ordinal % 17 = 0 THEN 'x' ELSE '' END || l_orderkey || '/' || size AS payload FROM shipped WHERE ordinal % 19 != 0"
)
_RECONCILE = dict(
    l="SELECT rec_id, ordinal, pts, size, l_orderkey || '/' || size AS payload FROM shipped WHERE ordinal % 23 != 0",
    r=_COPY,
    j="SELECT coalesce(l.rec_id, r.rec_id) AS rec_id, coalesce(l.ordinal, r.ordinal) AS ordinal, abs(l.pts - r.pts) AS err, CASE WHEN l.payload IS NULL OR r.payload IS NULL THEN 'missing packet' "
    "WHEN l.size != r.size OR l.payload != r.payload THEN 'payload differs' WHEN abs(l.pts - r.pts) > 0.1 THEN 'clock differs' END AS issue FROM l FULL OUTER JOIN r ON l.rec_id = r.rec_id AND l.ordinal = r.ordinal",
)


def _reconciled(spark, sf):
    p = _payload(spark, sf)
    n = lambda k: F.pmod("ordinal", F.lit(k))
    left = p.where(n(23) != 0)
    right = p.where(n(19) != 0).withColumn("pts", F.col("pts") + F.when(n(13) == 0, 0.5).otherwise(0.0))
    right = right.withColumn("payload", F.concat(F.when(n(17) == 0, "x").otherwise(""), F.col("payload")))
    return pk.reconcile_packets(left, right, 0.1)


@query("packet_reconcile", with_views("SELECT rec_id, ordinal, issue FROM j WHERE issue IS NOT NULL", "shipped", **_RECONCILE))
def packet_reconcile(spark, sf):
    return _reconciled(spark, sf)[0].select("rec_id", "ordinal", "issue")


@query(
    "packet_reconcile_summary",
    with_views(f"SELECT rec_id, count(*) AS packets, {sql_us('max(err)')} AS max_error, count(issue) AS mismatches FROM j GROUP BY rec_id", "shipped", **_RECONCILE),
)
def packet_reconcile_summary(spark, sf):
    return _reconciled(spark, sf)[1].select("rec_id", "packets", us(F.col("max_error")).alias("max_error"), "mismatches")


@query(
    "packet_order_violations",
    with_views(
        "SELECT rec_id, ordinal, size, previous FROM (SELECT *, lag(size) OVER (PARTITION BY rec_id ORDER BY ordinal) AS previous FROM shipped) WHERE size <= previous",
        "shipped",
    ),
)
def packet_order_violations(spark, sf):
    return pk.order_violations(packets(spark, sf), "size", block=256).select("rec_id", "ordinal", "size", "previous")


_DIGEST = dict(
    n0="SELECT rec_id, ordinal AS n, sha256(l_orderkey || '/' || size) AS h, size AS b FROM shipped",
    n1="SELECT rec_id, n // 64 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h, sum(b) AS b, count(*) AS c FROM n0 GROUP BY rec_id, n // 64",
    n2="SELECT rec_id, n // 64 AS n, sha256(string_agg(h, '' ORDER BY n)) AS h, sum(b) AS b, sum(c) AS c FROM n1 GROUP BY rec_id, n // 64",
    n3="SELECT rec_id, sha256(string_agg(h, '' ORDER BY n)) AS h, sum(b) AS b, sum(c) AS c FROM n2 GROUP BY rec_id",
)


@query(
    "packet_payload_digest",
    with_views("SELECT rec_id, h AS digest, CAST(b AS BIGINT) AS bytes, CAST(c AS BIGINT) AS packets FROM n3", "shipped", **_DIGEST),
)
def packet_payload_digest(spark, sf):
    return pk.payload_digest(_payload(spark, sf), fan=64)


# Splices: both streams of a recording in ticks, cut where the aligned keyframe groups are.
# Video ticks are 1001/30000 s in odd recordings and 1/90000 s in even ones, audio ticks 1/44100 s.
_TICKS = (
    "SELECT rec_id, stream, ordinal, CASE WHEN ordinal % 1013 = 7 THEN NULL ELSE CAST(pts AS BIGINT) * den // num + CASE WHEN stream = 'video' THEN ordinal % 3 * 2 ELSE 0 END END AS pts, "
    "CASE WHEN ordinal % 97 = 5 THEN NULL ELSE CAST(pts AS BIGINT) * den // num - CASE WHEN ordinal % 40 = 0 THEN 3 * den // num ELSE 0 END END AS dts, "
    "CASE WHEN ordinal % 211 = 3 THEN 0 ELSE CAST(duration AS BIGINT) * den // num END AS duration, num, den, CASE WHEN ordinal % 53 = 0 THEN 0 ELSE size END AS size FROM shipped, "
    "LATERAL (SELECT unnest(['audio', 'video']) AS stream), LATERAL (SELECT CASE WHEN stream = 'video' AND rec_id % 2 = 1 THEN 1001 ELSE 1 END AS num, "
    "CASE WHEN stream = 'audio' THEN 44100 WHEN rec_id % 2 = 1 THEN 30000 ELSE 90000 END AS den)"
)
_SPLICE = dict(
    **_ALIGNED,
    mp="SELECT rec_id, row_number() OVER w - 1 AS seq, s, e, first, stop, coalesce(sum(e - s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM al WINDOW w AS (PARTITION BY rec_id ORDER BY s)",
    ticks=_TICKS,
    timed="SELECT * FROM ticks WHERE size > 0 AND pts IS NOT NULL",
    hit="SELECT t.*, m.seq, m.s, m.e, m.o FROM timed t JOIN mp m ON t.rec_id = m.rec_id AND t.stream = 'video' AND t.ordinal >= m.first AND t.ordinal < m.stop "
    "UNION ALL SELECT * FROM (SELECT t.*, m.seq, m.s, m.e, m.o FROM (SELECT *, pts * num / den::DOUBLE AS at FROM timed WHERE stream = 'audio' AND duration > 0) AS q "
    "ASOF JOIN mp m ON q.rec_id = m.rec_id AND q.at + 1e-8 >= m.s JOIN timed t ON t.rec_id = q.rec_id AND t.stream = 'audio' AND t.ordinal = q.ordinal) WHERE pts * num / den::DOUBLE + duration * num / den::DOUBLE <= e + 1e-7",
    rest="SELECT *, ((CAST(o - s AS BIGINT) * den) % num + num) % num AS r FROM hit",
    moved="SELECT *, (CAST(o - s AS BIGINT) * den - r) // num AS q FROM rest",
    kept="SELECT *, q + CASE WHEN 2 * r > num OR (2 * r = num AND q % 2 != 0) THEN 1 ELSE 0 END AS shift FROM moved",
)


def ticked(spark, sf):
    p = shipped(spark, sf).withColumn("stream", F.explode(F.array(F.lit("audio"), F.lit("video"))))
    video, odd = F.col("stream") == "video", F.pmod("rec_id", F.lit(2)) == 1
    p = p.withColumn("num", F.when(video & odd, 1001).otherwise(1).cast("long"))
    p = p.withColumn("den", F.when(~video, 44100).when(odd, 30000).otherwise(90000).cast("long"))
    ticks = lambda c: F.expr(f"cast({c} as bigint) * den div num")
    n = lambda k: F.pmod("ordinal", F.lit(k))
    return p.select(
        "rec_id", "stream", "ordinal",
        F.when(n(1013) != 7, ticks("pts") + F.when(video, n(3) * 2).otherwise(0)).alias("pts"),
        F.when(n(97) != 5, ticks("pts") - F.when(n(40) == 0, F.expr("3 * den div num")).otherwise(0)).alias("dts"),
        F.when(n(211) == 3, 0).otherwise(ticks("duration")).alias("duration"), "num", "den",
        F.when(n(53) == 0, 0).otherwise(F.col("size")).alias("size"),
    )


def splice_mapping(spark, sf):
    rows = pk.align_groups(groups(spark, sf), sources(spark, sf), chunk=2000.0, block=256)
    before = {"seq": ("sum", F.lit(1)), "output_start": ("sum", F.col("source_end") - F.col("source_start"))}
    rows = running(rows, before, ["source_start"], chunk=2000.0)
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return materialize(rows.select("rec_id", zero("seq", "long"), "source_start", "source_end", zero("output_start", "double"), "first", "stop"))


@query(
    "packet_splice",
    with_views("SELECT rec_id, stream, ordinal, seq, CAST(pts + shift AS BIGINT) AS output_pts, CAST(dts + shift AS BIGINT) AS output_dts FROM kept", "shipped", **_SPLICE),
)
def packet_splice(spark, sf):
    kept, _ = pk.splice_packets(ticked(spark, sf), splice_mapping(spark, sf), chunk=2000.0, block=256)
    return kept.select("rec_id", "stream", "ordinal", "seq", "output_pts", "output_dts")


@query(
    "packet_splice_faults",
    with_views(
        "SELECT rec_id, stream, ordinal, CAST(NULL AS BIGINT) AS seq, 'no presentation time' AS fault FROM ticks WHERE size > 0 AND pts IS NULL "
        "UNION ALL SELECT rec_id, stream, ordinal, NULL, 'audio without duration' FROM timed WHERE stream = 'audio' AND duration <= 0 "
        "UNION ALL SELECT rec_id, stream, ordinal, seq, 'no decode time' FROM kept WHERE dts IS NULL "
        "UNION ALL SELECT rec_id, stream, ordinal, seq, 'decode time does not rise' FROM (SELECT *, lag(dts + shift) OVER (PARTITION BY rec_id, stream ORDER BY ordinal) AS p FROM kept WHERE dts IS NOT NULL) WHERE dts + shift <= p "
        "UNION ALL SELECT rec_id, stream, NULL, seq, 'interval without packets' FROM (SELECT rec_id, seq, unnest(['audio', 'video']) AS stream FROM mp EXCEPT SELECT rec_id, seq, stream FROM kept)",
        "shipped",
        **_SPLICE,
    ),
)
def packet_splice_faults(spark, sf):
    return pk.splice_packets(ticked(spark, sf), splice_mapping(spark, sf), chunk=2000.0, block=256)[1]


@query(
    "packet_splice_report",
    with_views(
        f"SELECT m.rec_id, count(*) AS segments, {sql_us('sum(e - s)')} AS duration, CAST(sum(coalesce(a, 0)) AS BIGINT) AS audio_packets, CAST(sum(coalesce(v, 0)) AS BIGINT) AS video_packets, "
        f"coalesce({sql_us('max(greatest(f - s, e - z))')}, -1) AS max_audio_boundary_gap, coalesce({sql_us('sum(b) * 8 / sum(e - s)')}, -1) AS average_bitrate FROM mp m LEFT JOIN ("
        "SELECT rec_id, seq, count(*) FILTER (stream = 'audio') AS a, count(*) FILTER (stream = 'video') AS v, min_by(pts * num / den::DOUBLE, ordinal) FILTER (stream = 'audio') AS f, "
        "max_by(pts * num / den::DOUBLE + duration * num / den::DOUBLE, ordinal) FILTER (stream = 'audio') AS z, CAST(sum(size) FILTER (stream = 'audio') AS DOUBLE) AS b FROM kept GROUP BY rec_id, seq) k "
        "ON k.rec_id = m.rec_id AND k.seq = m.seq GROUP BY m.rec_id",
        "shipped",
        **_SPLICE,
    ),
)
def packet_splice_report(spark, sf):
    mapping = splice_mapping(spark, sf)
    kept, _ = pk.splice_packets(ticked(spark, sf), mapping, chunk=2000.0, block=256)
    rows = pk.splice_report(pk.splice_segments(kept, mapping))
    none = F.lit(-1).cast("long")
    return rows.select(
        "rec_id", "segments", us(F.col("duration")).alias("duration"), "audio_packets", "video_packets",
        *[F.coalesce(us(F.col(c)), none).alias(c) for c in ("max_audio_boundary_gap", "average_bitrate")],
    )


# Chapters: non-overlapping two-second windows with the category of their vector.
def menu_windows(spark, sf):
    rows = menu_scores(spark, sf, 1.4).withColumn("end", F.col("start") + 2.0).withColumn("_a", labels.identify(F.col("semantic"), _MENU))
    return rows.select("rec_id", "start", "end", F.col("_a.category").alias("category"), F.col("_a.alternatives").alias("alternatives"))


_W = (
    "SELECT rec_id, s, s + 2 AS e, category, CASE WHEN category = 'mixed' THEN list_sort(close[1:3]) ELSE CAST([] AS VARCHAR[]) END AS alt FROM ranked"
)
_CHAPTERS = dict(
    menu=_menu_sql(1.4),
    ranked=IDENTIFY,
    w=_W,
    findings="SELECT o_orderkey % (SELECT count(DISTINCT rec_id) FROM vectors) AS rec_id, o_custkey % 300 * 0.5::DOUBLE AS s, o_custkey % 300 * 0.5::DOUBLE + o_orderkey % 9 * 0.25::DOUBLE AS e FROM orders",
    runs="SELECT *, sum(CASE WHEN pc = category AND pa = alt AND abs(pe - s) < 1e-5 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM ("
    "SELECT *, lag(category) OVER x AS pc, lag(alt) OVER x AS pa, lag(e) OVER x AS pe FROM w WINDOW x AS (PARTITION BY rec_id ORDER BY s))",
    ch="SELECT rec_id, run AS idx, min(s) AS s, max(e) AS e, any_value(category) AS category, any_value(alt) AS alt, count(*) AS n FROM runs GROUP BY rec_id, run",
    full="SELECT ch.*, (SELECT count(*) FROM findings f WHERE f.rec_id = ch.rec_id AND f.s < ch.e AND f.e > ch.s AND f.e > f.s) AS hits FROM ch",
)


def _chapters(spark, sf):
    from .fixtures import vectors

    n = vectors(spark, sf).select("rec_id").distinct().count()
    o = table(spark, sf, "orders").withColumn("n", F.lit(n))
    at = F.pmod("o_custkey", F.lit(300)) * 0.5
    f = o.select(F.pmod("o_orderkey", F.col("n")).alias("rec_id"), at.alias("start"), (at + F.pmod("o_orderkey", F.lit(9)) * 0.25).alias("end"))
    return ch.chapters(menu_windows(spark, sf), f, chunk=20.0)


@query(
    "chapter_list",
    with_views(
        f'SELECT rec_id, CAST(idx AS BIGINT) AS index, {sql_us("s")} AS start, {sql_us("e")} AS "end", category, array_to_string(alt, \'|\') AS alternatives, n AS windows, hits AS review_findings, category IN (\'unknown\', \'mixed\') AS needs_confirmation FROM full_',
        "vectors",
        **{**{k: v for k, v in _CHAPTERS.items() if k != "full"}, "full_": _CHAPTERS["full"]},
    ),
)
def chapter_list(spark, sf):
    return micros(_chapters(spark, sf), "index", "category", F.array_join("alternatives", "|").alias("alternatives"), "windows", "review_findings", "needs_confirmation")


@query(
    "chapter_findings",
    with_views(
        f'SELECT ch.rec_id, CAST(ch.idx AS BIGINT) AS index, {sql_us("f.s")} AS start, {sql_us("f.e")} AS "end" FROM ch JOIN findings f ON f.rec_id = ch.rec_id AND f.s < ch.e AND f.e > ch.s AND f.e > f.s',
        "vectors",
        **{k: v for k, v in _CHAPTERS.items() if k != "full"},
    ),
)
def chapter_findings(spark, sf):
    """The findings attached to every chapter."""
    rows = _chapters(spark, sf).select("rec_id", "index", F.explode("findings").alias("f"))
    return micros(rows.select("rec_id", "index", "f.start", "f.end"), "index")


_TITLE = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items()) + " END"
_HMS = "format('{{:02d}}:{{:02d}}:{{:02d}}', CAST({c} AS BIGINT) // 3600, CAST({c} AS BIGINT) // 60 % 60, CAST({c} AS BIGINT) % 60)"


@query(
    "chapter_text",
    with_views(
        f"SELECT rec_id, CAST(idx AS BIGINT) AS index, {_HMS.format(c='floor(s)')} || ' — ' || {_HMS.format(c='floor(e)')} || '  ' || {_TITLE.format(c='category')} || "
        f"CASE WHEN len(alt) > 0 THEN '（' || array_to_string(list_transform(alt, lambda x: {_TITLE.format(c='x')}), '、') || '）' ELSE '' END || "
        "CASE WHEN hits > 0 THEN ' · 含待复听位置' ELSE '' END AS line FROM full_",
        "vectors",
        **{**{k: v for k, v in _CHAPTERS.items() if k != "full"}, "full_": _CHAPTERS["full"]},
    ),
)
def chapter_text(spark, sf):
    return ch.chapter_text(_chapters(spark, sf))
