"""Window and probe grids over event spans, vectors and day recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids
from ..operators import intervals as iv
from .fixtures import US_CHUNK, days, hop_recordings, only, spans, sql_us, us, vectors, with_views
from .registry import query

# Spans in seconds: the microsecond clock divided once, so both engines start from equal doubles.
SECONDS = "SELECT rec_id, id, s / 1000000.0::DOUBLE AS s, e / 1000000.0::DOUBLE AS e, category FROM spans"


def seconds(spark, sf):
    s = spans(spark, sf)
    return s.select("rec_id", "id", (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), "category")


def _steps(n: str) -> str:
    return f"unnest(generate_series(0, CAST(ceil({n}) AS BIGINT) - 1))"


@query(
    "grid_hop_windows",
    with_views(
        f'SELECT id, {sql_us("w")} AS start, {sql_us("least(w + 6.0::DOUBLE, e)")} AS "end" FROM '
        f"(SELECT id, s + i * 2.0::DOUBLE AS w, e FROM (SELECT *, {_steps('(e - s) / 2.0::DOUBLE')} AS i FROM sec)) "
        "WHERE e - w >= 0.4::DOUBLE",
        "spans",
        sec=SECONDS,
    ),
)
def grid_hop_windows(spark, sf):
    w = grids.hop_windows(seconds(spark, sf), 6.0, 2.0, 0.4)
    return w.select("id", us(F.col("start")).alias("start"), us(F.col("end")).alias("end"))


@query(
    "grid_hop_full_windows",
    with_views(
        f'SELECT id, {sql_us("w")} AS start, {sql_us("w + 3.0::DOUBLE")} AS "end" FROM '
        f"(SELECT id, s + i * 1.0::DOUBLE AS w FROM (SELECT *, {_steps('(e - 3.0::DOUBLE + 0.000001::DOUBLE - s) / 1.0::DOUBLE')} AS i FROM sec))",
        "spans",
        sec=SECONDS,
    ),
)
def grid_hop_full_windows(spark, sf):
    w = grids.hop_windows(seconds(spark, sf), 3.0, 1.0, full_only=True)
    return w.select("id", us(F.col("start")).alias("start"), us(F.col("end")).alias("end"))


@query(
    "grid_tumble",
    with_views(
        'SELECT rec_id, i * 10000000 AS start, least((i + 1) * 10000000, d) AS "end" FROM '
        f"(SELECT *, {_steps('d / 10000000.0::DOUBLE')} AS i FROM days)",
        "days",
    ),
)
def grid_tumble(spark, sf):
    return grids.tumble(days(spark, sf), 10_000_000)


def _long(spark, sf):
    """Recordings of awkward lengths: one per event."""
    s = spans(spark, sf)
    return s.select(F.col("id").alias("rec_id"), (F.col("start") / 1e8).alias("duration"))


LONG = "SELECT id AS rec_id, s / 100000000.0::DOUBLE AS d FROM spans"


@query(
    "grid_chunk_with_overlap",
    with_views(
        f'SELECT rec_id, i * 300000000 AS start, {sql_us("least(i * 300.0::DOUBLE + 302.0::DOUBLE, d)")} AS "end" FROM '
        f"(SELECT *, {_steps('d / 300.0::DOUBLE')} AS i FROM recs WHERE d > 0)",
        "spans",
        recs=LONG,
    ),
)
def grid_chunk_with_overlap(spark, sf):
    w = grids.chunk_with_overlap(_long(spark, sf), 300.0, 2.0)
    return w.select("rec_id", us(F.col("start")).alias("start"), us(F.col("end")).alias("end"))


@query(
    "grid_review_windows",
    with_views(
        f'SELECT rec_id, pass, {sql_us("a")} AS start, {sql_us("b")} AS "end" FROM ('
        "SELECT rec_id, 'tile' AS pass, i * 28 AS a, least(i * 28.0::DOUBLE + 28, d) AS b FROM t UNION ALL "
        "SELECT rec_id, 'edge', i * 28 - 4, least(i * 28.0::DOUBLE + 4, d) FROM t WHERE i > 0)",
        "spans",
        recs=LONG,
        t=f"SELECT *, {_steps('ceil(d) / 28.0::DOUBLE')} AS i FROM recs WHERE d > 0",
    ),
)
def grid_review_windows(spark, sf):
    w = grids.review_windows(_long(spark, sf))
    return w.select("rec_id", "pass", us(F.col("start")).alias("start"), us(F.col("end")).alias("end"))


_CUTS = (
    "SELECT DISTINCT rec_id, t FROM (SELECT rec_id, unnest([s, e]) AS t FROM mapping UNION ALL "
    "SELECT rec_id, unnest([a, b]) FROM chunks)"
)
_MAPPING = "SELECT rec_id, s, e FROM (SELECT rec_id, s / 1000000.0::DOUBLE AS s, e / 1000000.0::DOUBLE AS e FROM spans WHERE category = 'error')"


@query(
    "grid_cut_windows",
    with_views(
        f'SELECT rec_id, {sql_us("w")} AS start, {sql_us("f")} AS "end", {sql_us("lo")} AS probe_start, '
        f'{sql_us("least(b, lo + 10.0::DOUBLE)")} AS probe_end FROM ('
        "SELECT *, greatest(a, least((w + f) / 2 - 5.0::DOUBLE, b - 10.0::DOUBLE)) AS lo FROM ("
        "SELECT *, a + i * 5.0::DOUBLE AS w, least(b, a + i * 5.0::DOUBLE + 5.0::DOUBLE) AS f FROM ("
        f"SELECT *, {_steps('(b - a - 0.00000001::DOUBLE) / 5.0::DOUBLE')} AS i FROM parts)))",
        "spans",
        "days",
        mapping=_MAPPING,
        chunks=f"SELECT rec_id, i * 300.0::DOUBLE AS a, least(i * 300.0::DOUBLE + 300, 86400) AS b FROM (SELECT *, {_steps('288')} AS i FROM days)",
        cuts=_CUTS,
        parts="SELECT rec_id, t AS a, b FROM (SELECT rec_id, t, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS b FROM cuts) "
        "WHERE b IS NOT NULL AND t >= 0 AND b <= 86400",
    ),
)
def grid_cut_windows(spark, sf):
    recs = days(spark, sf).withColumn("duration", F.lit(86400.0))
    chunks = grids.chunk_with_overlap(recs, 300.0)
    s = only(seconds(spark, sf), "error")
    mapping = s.select("rec_id", F.col("start").alias("output_start"), F.col("end").alias("output_end"))
    w = grids.cut_windows(chunks, mapping, chunk=3600.0)
    return w.select("rec_id", *[us(F.col(c)).alias(c) for c in ("start", "end", "probe_start", "probe_end")])


@query(
    "grid_edge_probes",
    with_views(
        "SELECT id, side, probe, "
        f"{sql_us('CASE WHEN side = 0 THEN s + x ELSE e - x - 2 END')} AS probe_start, "
        f"{sql_us('CASE WHEN side = 0 THEN s + x + 2 ELSE e - x END')} AS probe_end FROM (SELECT *, unnest([0, 1]) AS side FROM ("
        "SELECT id, s, e, unnest([0.0, 2.0, 4.0, 7.0, 11.0, 15.0])::DOUBLE AS x, unnest([0, 1, 2, 3, 4, 5]) AS probe FROM sec WHERE e - s >= 2)) "
        "WHERE x + 2 < least(18.0::DOUBLE, (e - s) / 2)",
        "spans",
        sec=SECONDS,
    ),
)
def grid_edge_probes(spark, sf):
    w = grids.edge_probes(seconds(spark, sf))
    side = F.when(F.col("side") == "start", 0).otherwise(1)
    return w.select("id", side.alias("side"), "probe", us(F.col("probe_start")).alias("probe_start"), us(F.col("probe_end")).alias("probe_end"))


_PHASE = dict(
    c="SELECT id, s, e, greatest(0, s - 4) AS a0, least(86400.0::DOUBLE, e + 4) AS b1 FROM sec",
    ok="SELECT * FROM c WHERE least(s - a0, b1 - e) >= 2",
    inner_="SELECT id, s + i AS a, s + i + 2 AS b, e FROM (SELECT *, unnest(generate_series(0, CAST(ceil(e - 2.0::DOUBLE + 0.000001::DOUBLE - s) AS BIGINT) - 1)) AS i FROM ok WHERE e - s > 2)",
    inside="SELECT id, s AS a, e AS b FROM ok WHERE e - s <= 2 UNION ALL SELECT id, a, b FROM inner_ UNION ALL "
    "SELECT ok.id, ok.e - 2, ok.e FROM ok JOIN (SELECT id, max(b) AS b FROM inner_ GROUP BY id) m ON m.id = ok.id WHERE m.b < ok.e - 0.000001::DOUBLE",
)


@query(
    "grid_phase_probes",
    with_views(
        f"SELECT id, role, {sql_us('a')} AS probe_start, {sql_us('b')} AS probe_end FROM ("
        "SELECT id, 'before' AS role, a0 AS a, s AS b FROM ok UNION ALL SELECT id, 'after', e, b1 FROM ok "
        "UNION ALL SELECT id, 'body', a, b FROM inside)",
        "spans",
        sec=SECONDS,
        **_PHASE,
    ),
)
def grid_phase_probes(spark, sf):
    w = grids.phase_probes(seconds(spark, sf).withColumn("duration", F.lit(86400.0)))
    return w.select("id", "role", us(F.col("probe_start")).alias("probe_start"), us(F.col("probe_end")).alias("probe_end"))


@query(
    "grid_finding_probes",
    with_views(
        f"SELECT id, role, {sql_us('a')} AS probe_start, {sql_us('b')} AS probe_end FROM ("
        "SELECT id, 'context' AS role, c0 AS a, least(86400.0::DOUBLE, c0 + greatest(10.0::DOUBLE, e - c0)) AS b FROM f UNION ALL "
        "SELECT id, 'probe', t, least(86400.0::DOUBLE, t + 3) FROM (SELECT id, lo + i * 1.5::DOUBLE AS t FROM ("
        "SELECT *, unnest(generate_series(0, CAST(ceil((last - lo) / 1.5::DOUBLE) AS BIGINT) - 1)) AS i FROM f) UNION ALL SELECT id, last FROM f))",
        "spans",
        sec=SECONDS,
        f="SELECT *, greatest(lo, hi - 3) AS last FROM (SELECT id, s, e, greatest(0, least((s + e) / 2 - 5, 86400.0::DOUBLE - 10)) AS c0, "
        "greatest(0, s - 0.3::DOUBLE) AS lo, least(86400.0::DOUBLE, e + 0.3::DOUBLE) AS hi FROM sec "
        "WHERE category != 'view' AND e - s > 0 AND e - s <= 8)",
    ),
)
def grid_finding_probes(spark, sf):
    f = seconds(spark, sf).withColumn("duration", F.lit(86400.0)).withColumn("review_only", F.col("category") == "view")
    w = grids.finding_probes(f)
    return w.select("id", "role", us(F.col("probe_start")).alias("probe_start"), us(F.col("probe_end")).alias("probe_end"))


_RATE = 32


@query(
    "grid_mark_quiet",
    with_views(
        f'SELECT rec_id, {sql_us("s")} AS start, {sql_us("e")} AS "end", coalesce(n < 64 OR en / n < 0.015625, TRUE) AS quiet FROM ('
        "SELECT w.rec_id, w.s, w.e, sum(x.v * x.v) AS en, count(x.v) AS n FROM w LEFT JOIN x ON x.rec_id = w.rec_id "
        f"AND x.i >= CAST(round_even(w.s * {_RATE}, 0) AS BIGINT) AND x.i < CAST(round_even(w.e * {_RATE}, 0) AS BIGINT) GROUP BY ALL)",
        "vectors",
        "hop_recordings",
        w="SELECT rec_id, i * 1.7::DOUBLE AS s, least(i * 1.7::DOUBLE + 3.1::DOUBLE, d) AS e FROM (SELECT *, unnest(generate_series(0, CAST(ceil(d / 1.7::DOUBLE) AS BIGINT) - 1)) AS i FROM hop_recordings)",
        x="SELECT rec_id, block_idx * 64 + generate_subscripts(em, 1) - 1 AS i, unnest(em) AS v FROM vectors",
    ),
)
def grid_mark_quiet(spark, sf):
    v = vectors(spark, sf)
    recs = hop_recordings(spark, sf)
    w = grids.hop_windows(iv.whole(recs), 3.1, 1.7)
    blocks = v.select("rec_id", "block_idx", F.col("embedding").alias("samples"))
    # RMS floor of 1/8, the scale of these vectors.
    q = grids.mark_quiet(w, blocks, _RATE, 64, floor_db=-18.061799739838872, min_samples=64, full_scale=1.0)
    return q.select("rec_id", us(F.col("start")).alias("start"), us(F.col("end")).alias("end"), "quiet")
