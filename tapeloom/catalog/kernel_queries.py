"""Interval algebra on event spans of whole days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import joins
from .fixtures import US_CHUNK, days, only, spans, sql_gaps, sql_merge, with_views
from .registry import query

C = US_CHUNK
OUT = 'SELECT rec_id, s AS start, e AS "end" FROM '
TWENTY = 20_000_000
COMP = sql_gaps("m", "u")
KEPT = with_views(
    "SELECT d.rec_id, CAST(count(g.s) AS BIGINT) AS sections, CAST(coalesce(sum(g.e - g.s), 0) AS BIGINT) AS kept "
    "FROM days d LEFT JOIN (SELECT * FROM g WHERE e - s >= 40000000) g ON g.rec_id = d.rec_id GROUP BY d.rec_id",
    "spans",
    "days",
    p="SELECT rec_id, greatest(s - 5000000, 0) AS s, least(e + 7000000, 86400000000) AS e FROM spans",
    m=sql_merge("p", str(TWENTY)),
    u="SELECT rec_id, 0 AS lo, d AS hi FROM days",
    g=COMP,
)


@query("kept_time", KEPT)
def kept_time(spark, sf):
    """Per day: sections left after removing padded, merged speech, and their length."""
    speech = iv.pad(spans(spark, sf), 5_000_000, 7_000_000, 0, 86_400_000_000)
    removed = iv.merge(speech, TWENTY, chunk=C)
    free = iv.complement(removed, days(spark, sf), chunk=C).where(F.col("end") - F.col("start") >= 40_000_000)
    sums = free.groupBy("rec_id").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.col("end") - F.col("start")).alias("kept"))
    none = F.lit(0).cast("long")
    return days(spark, sf).join(sums, "rec_id", "left").select(
        "rec_id", F.coalesce("sections", none).alias("sections"), F.coalesce("kept", none).alias("kept")
    )


@query("interval_merge", with_views(OUT + "m", "spans", m=sql_merge("spans")))
def interval_merge(spark, sf):
    return iv.merge(spans(spark, sf), chunk=C)


@query("interval_merge_gap", with_views(OUT + "m", "spans", m=sql_merge("spans", str(TWENTY))))
def interval_merge_gap(spark, sf):
    return iv.merge(spans(spark, sf), TWENTY, chunk=C)


@query(
    "interval_complement",
    with_views(OUT + "g", "spans", "days", m=sql_merge("spans"), u="SELECT rec_id, 0 AS lo, d AS hi FROM days", g=COMP),
)
def interval_complement(spark, sf):
    return iv.complement(spans(spark, sf), days(spark, sf), chunk=C)


_ALL = "u AS (SELECT rec_id, -1 AS lo, 999999999999 AS hi FROM days)"
_MINUS = dict(
    l="SELECT rec_id, s, e FROM spans WHERE category IN ('view', 'click', 'purchase')",
    r="SELECT rec_id, s, e FROM spans WHERE category IN ('error', 'signup')",
    ml=sql_merge("l"),
    m=sql_merge("r"),
    u="SELECT rec_id, -1 AS lo, 999999999999 AS hi FROM days",
    g=COMP,
)


@query(
    "interval_subtract",
    with_views(
        'SELECT ml.rec_id, greatest(ml.s, g.s) AS start, least(ml.e, g.e) AS "end" FROM ml JOIN g '
        "ON ml.rec_id = g.rec_id AND ml.s < g.e AND g.s < ml.e",
        "spans",
        "days",
        **_MINUS,
    ),
)
def interval_subtract(spark, sf):
    s = spans(spark, sf)
    return iv.subtract(only(s, "view", "click", "purchase"), only(s, "error", "signup"), chunk=C)


@query(
    "interval_covers",
    with_views(
        "SELECT l.id, EXISTS (SELECT 1 FROM spans r WHERE r.rec_id = l.rec_id AND r.category IN ('view', 'purchase') "
        "AND r.s <= l.s AND r.e >= l.e AND l.e > l.s) AS covered FROM spans l WHERE l.category IN ('error', 'click', 'signup')",
        "spans",
    ),
)
def interval_covers(spark, sf):
    s = spans(spark, sf)
    return iv.covered(only(s, "error", "click", "signup"), only(s, "view", "purchase"), eps=0, chunk=C).select("id", "covered")


@query(
    "interval_intersect",
    with_views(
        'SELECT l.rec_id, l.id AS left_id, r.id AS right_id, greatest(l.s, r.s) AS start, least(l.e, r.e) AS "end" '
        "FROM spans l JOIN spans r ON l.rec_id = r.rec_id AND l.s < r.e AND r.s < l.e AND l.e > l.s AND r.e > r.s "
        "WHERE l.category IN ('click', 'signup') AND r.category IN ('view', 'error', 'purchase')",
        "spans",
    ),
)
def interval_intersect(spark, sf):
    s = spans(spark, sf).select("rec_id", "id", "category", "start", "end")
    pairs = iv.intersect(only(s, "click", "signup").drop("category"), only(s, "view", "error", "purchase").drop("category"), chunk=C)
    return pairs.select("rec_id", F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), "start", "end")


_OVERLAP = (
    "SELECT l.id, CAST(coalesce(sum(CASE WHEN m.s IS NOT NULL THEN least(l.e, m.e) - greatest(l.s, m.s) END), 0) AS BIGINT) AS overlap, max(l.e - l.s) AS len "
    "FROM (SELECT * FROM spans WHERE category IN ('click', 'signup')) l LEFT JOIN m "
    "ON l.rec_id = m.rec_id AND l.s < m.e AND m.s < l.e AND l.e > l.s GROUP BY l.id"
)
_OTHER = dict(r="SELECT rec_id, s, e FROM spans WHERE category IN ('view', 'error', 'purchase')", m=sql_merge("r"), o=_OVERLAP)


def _click_other(spark, sf):
    s = spans(spark, sf)
    return only(s, "click", "signup"), only(s, "view", "error", "purchase")


@query("interval_overlap_seconds", with_views("SELECT id, overlap FROM o", "spans", **_OTHER))
def interval_overlap_seconds(spark, sf):
    a, b = _click_other(spark, sf)
    return iv.overlap_length(a, b, ["id"], chunk=C).select("id", "overlap")


@query("interval_fully_blocked", with_views("SELECT id FROM o WHERE overlap < len", "spans", **_OTHER))
def interval_fully_blocked(spark, sf):
    a, b = _click_other(spark, sf)
    return iv.unblocked(a, b, ["id"], eps=0, chunk=C).select("id")


@query("interval_overlaps_any", with_views("SELECT id FROM o WHERE overlap > 0", "spans", **_OTHER))
def interval_overlaps_any(spark, sf):
    a, b = _click_other(spark, sf)
    return iv.overlapping(a, b, ["id"], chunk=C).select("id")


@query("interval_not_overlaps_any", with_views("SELECT id FROM o WHERE overlap = 0", "spans", **_OTHER))
def interval_not_overlaps_any(spark, sf):
    a, b = _click_other(spark, sf)
    return iv.overlapping(a, b, ["id"], negate=True, chunk=C).select("id")


@query(
    "interval_pad",
    with_views(
        'SELECT id, greatest(s - 5000000, 0) AS start, least(e + 7000000, 86400000000) AS "end" FROM spans', "spans"
    ),
)
def interval_pad(spark, sf):
    return iv.pad(spans(spark, sf), 5_000_000, 7_000_000, 0, 86_400_000_000).select("id", "start", "end")


_UNITS = (
    "SELECT rec_id, id, s - (id % 3) * 1000 AS s, CASE WHEN id % 50 = 0 THEN s - 1 ELSE e END AS e "
    "FROM spans WHERE category IN ('click', 'purchase')"
)


@query(
    "interval_check_disjoint",
    with_views(
        "SELECT id, 'bounds' AS rule FROM units WHERE NOT (s >= 0 AND s < e AND e <= 86400000000) UNION ALL "
        "SELECT units.id, 'overlap' AS rule FROM units JOIN m ON units.rec_id = m.rec_id AND units.s < m.e AND m.s < units.e "
        "AND units.e > units.s GROUP BY units.id",
        "spans",
        units=_UNITS,
        r="SELECT rec_id, s, e FROM spans WHERE category IN ('error', 'view', 'signup')",
        m=sql_merge("r"),
    ),
)
def interval_check_disjoint(spark, sf):
    s = spans(spark, sf)
    units = only(s, "click", "purchase").select(
        "rec_id",
        "id",
        (F.col("start") - F.pmod("id", F.lit(3)) * 1000).alias("start"),
        F.when(F.pmod("id", F.lit(50)) == 0, F.col("start") - 1).otherwise(F.col("end")).alias("end"),
    )
    return iv.disjoint_violations(units, only(s, "error", "view", "signup"), days(spark, sf), ["id"], eps=0, chunk=C).select("id", "rule")


@query(
    "interval_split_by",
    with_views(
        'SELECT id, s AS start, e AS "end", permitted FROM ('
        "SELECT l.id, greatest(l.s, m.s) AS s, least(l.e, m.e) AS e, TRUE AS permitted FROM l JOIN m "
        "ON l.rec_id = m.rec_id AND l.s < m.e AND m.s < l.e WHERE l.e > l.s UNION ALL "
        "SELECT l.id, greatest(l.s, g.s), least(l.e, g.e), FALSE FROM l JOIN g "
        "ON l.rec_id = g.rec_id AND l.s < g.e AND g.s < l.e WHERE l.e > l.s)",
        "spans",
        "days",
        l="SELECT rec_id, id, s, e FROM spans WHERE category IN ('click', 'error')",
        r="SELECT rec_id, s, e FROM spans WHERE category IN ('view', 'signup', 'purchase')",
        m=sql_merge("r"),
        u="SELECT rec_id, -1 AS lo, 999999999999 AS hi FROM days",
        g=COMP,
    ),
)
def interval_split_by(spark, sf):
    s = spans(spark, sf)
    return iv.split_by(only(s, "click", "error"), only(s, "view", "signup", "purchase"), ["id"], chunk=C).select("id", "start", "end", "permitted")


@query(
    "interval_common",
    with_views(
        'SELECT a.rec_id, greatest(a.s, m.s) AS start, least(a.e, m.e) AS "end" FROM ml a JOIN m '
        "ON a.rec_id = m.rec_id AND a.s < m.e AND m.s < a.e",
        "spans",
        "days",
        **_MINUS,
    ),
)
def interval_common(spark, sf):
    s = spans(spark, sf)
    return iv.common(only(s, "view", "click", "purchase"), only(s, "error", "signup"), chunk=C)


@query(
    "point_in_range",
    with_views(
        "SELECT r.id AS range_id, p.id AS point_id FROM spans r JOIN spans p ON r.rec_id = p.rec_id "
        "AND p.s BETWEEN r.s AND r.e WHERE r.category IN ('error', 'view') AND p.category IN ('signup', 'click', 'purchase')",
        "spans",
    ),
)
def point_in_range(spark, sf):
    s = spans(spark, sf).select("rec_id", "id", "category", "start", "end")
    pairs = joins.stab(only(s, "error", "view").drop("category"), only(s, "signup", "click", "purchase").drop("category"), "start", "start", "end", chunk=C)
    return pairs.select(F.col("range.id").alias("range_id"), F.col("point.id").alias("point_id"))
