"""Sequences, policies and plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.vocabulary import RETENTION
from ..operators import frames as fr
from ..operators import intervals as iv
from ..operators import sequences as sq
from ..operators import signal
from ..plans import planning as pl
from ..plans import policy as po
from ..plans import review as rv
from ..session import materialize
from .evidence_queries import micros, sql_runs
from .fixtures import (
    HOP_CHUNK, US_CHUNK, days, described, hop_recordings, levels, shipped, spans, sql_gaps, sql_merge, sql_us, table, us, vectors,
    with_views,
)
from .frame_queries import _KEEPS, keeps
from .grid_queries import SECONDS as SEC
from .grid_queries import seconds
from .label_queries import CALM_W, semantic_positive_sql
from .registry import query
from .transcript_queries import _ALIGNED_WORDS, aligned

OUT = f'SELECT rec_id, {sql_us("s")} AS start, {sql_us("e")} AS "end" FROM '
C = 600.0


# Policies per day from the event spans.
def day_options(spark, sf):
    d = days(spark, sf)
    n = F.dayofmonth(F.to_date("rec_id"))
    text = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    options = F.map_filter(
        F.create_map(
            F.lit("mode"), F.when(n % 5 == 0, F.lit("extract")).when(n % 5 == 1, F.lit("strict")).when(n == 7, F.lit("fast")),
            F.lit("strict_pre"), F.when(n % 3 == 0, (n * 3).cast("string")),
            F.lit("max_pause_seconds"), F.when(n % 4 == 0, (n / 8).cast("string")),
            F.lit("keep_drinking"), F.when(n % 2 == 0, text(n % 4 == 0)),
            F.lit("keep_tapping"), F.when(n % 3 == 1, text(n % 2 == 0)),
            F.lit("silence_seconds"), F.lit("7"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return d.select("rec_id", options.alias("options"))


_N = "CAST(split_part(rec_id, '-', 3) AS INTEGER)"
_DAY_POLICY = (
    f"SELECT rec_id, n, CASE WHEN n % 5 = 0 THEN 'extract' WHEN n % 5 = 1 THEN 'strict' WHEN n = 7 THEN NULL ELSE 'relaxed' END AS mode, "
    "CASE WHEN n % 3 = 0 THEN CASE WHEN n * 3 <= 60 THEN CAST(n * 3 AS DOUBLE) END ELSE 5.0 END AS strict_pre, "
    "CASE WHEN n % 4 = 0 THEN CASE WHEN n / 8.0 BETWEEN 0.3 AND 10 THEN CAST(n / 8.0 AS DOUBLE) END ELSE 1.5 END AS max_pause_seconds, "
    "CASE WHEN n % 2 = 0 THEN n % 4 = 0 ELSE FALSE END AS keep_drinking, CASE WHEN n % 3 = 1 THEN n % 2 = 0 ELSE TRUE END AS keep_tapping "
    f"FROM (SELECT rec_id, {_N} AS n FROM days)"
)


@query(
    "policy_resolve",
    with_views(
        f"SELECT rec_id, coalesce(mode, 'invalid') AS mode, coalesce({sql_us('strict_pre')}, -1) AS strict_pre, coalesce({sql_us('max_pause_seconds')}, -1) AS max_pause, keep_drinking, keep_tapping FROM pol",
        "days",
        pol=_DAY_POLICY,
    ),
)
def policy_resolve(spark, sf):
    policy, _ = po.resolve_policy(day_options(spark, sf))
    none = F.lit(-1).cast("long")
    return policy.select(
        "rec_id", F.coalesce("mode", F.lit("invalid")).alias("mode"), F.coalesce(us(F.col("strict_pre")), none).alias("strict_pre"),
        F.coalesce(us(F.col("max_pause_seconds")), none).alias("max_pause"), "keep_drinking", "keep_tapping",
    )


@query(
    "policy_violations",
    with_views(
        "SELECT rec_id, field FROM (SELECT rec_id, CASE WHEN mode IS NULL THEN 'mode' END AS field FROM pol UNION ALL SELECT rec_id, CASE WHEN strict_pre IS NULL THEN 'strict_pre' END FROM pol "
        "UNION ALL SELECT rec_id, CASE WHEN max_pause_seconds IS NULL THEN 'max_pause_seconds' END FROM pol) WHERE field IS NOT NULL",
        "days",
        pol=_DAY_POLICY,
    ),
)
def policy_violations(spark, sf):
    return po.resolve_policy(day_options(spark, sf))[1].select("rec_id", "field")


# Event types as categories, spread over the users.
_CATS = ["transitions", *RETENTION, "voice"]


def categorised(spark, sf):
    names = F.array(*[F.lit(c) for c in _CATS])
    s = spans(spark, sf)
    return s.select("rec_id", F.get(names, F.pmod("id", F.lit(len(_CATS))).cast("int")).alias("category"), "start", "end")


_CATEGORISED = f"SELECT rec_id, [{', '.join(repr(c) for c in _CATS)}][id % {len(_CATS)} + 1] AS category, s, e FROM spans"
_DROPPED = (
    "category = 'transitions' OR category IN ('loud_laugh', 'airflow', 'impacts') OR (category = 'drinking' AND NOT keep_drinking) OR (category = 'tapping' AND NOT keep_tapping)"
)
_UNION = dict(
    pol=_DAY_POLICY,
    cat=_CATEGORISED,
    drop_="SELECT c.rec_id, s, e FROM cat c JOIN pol ON pol.rec_id = c.rec_id WHERE " + _DROPPED,
    m=sql_merge("drop_"),
)


@query("policy_union", with_views('SELECT rec_id, s AS start, e AS "end" FROM m', "spans", "days", **_UNION))
def policy_union(spark, sf):
    policy, _ = po.resolve_policy(day_options(spark, sf))
    return po.policy_union(categorised(spark, sf), policy, chunk=US_CHUNK)


@query(
    "policy_extract_scope",
    with_views(
        'SELECT rec_id, s AS start, e AS "end" FROM em',
        "spans",
        "days",
        **_UNION,
        pos="SELECT rec_id, s, e FROM cat WHERE category = 'voice'",
        pm=sql_merge("pos"),
        u="SELECT days.rec_id, 0 AS lo, d AS hi FROM days JOIN pol ON pol.rec_id = days.rec_id WHERE mode = 'extract'",
        out_=sql_gaps("pm", "u"),
        every="SELECT rec_id, s, e FROM m UNION ALL SELECT c.rec_id, s, e FROM cat c JOIN u ON u.rec_id = c.rec_id WHERE category IN ('airflow', 'drinking', 'impacts', 'loud_laugh') UNION ALL SELECT rec_id, s, e FROM out_",
        em=sql_merge("every"),
    ),
)
def policy_extract_scope(spark, sf):
    policy, _ = po.resolve_policy(day_options(spark, sf))
    cats = categorised(spark, sf)
    excluded = materialize(po.policy_union(cats, policy, chunk=US_CHUNK))
    recs = days(spark, sf).join(policy.where("mode = 'extract'").select("rec_id"), "rec_id", "left_semi")
    return po.extract_scope(excluded, cats, cats.where("category = 'voice'"), recs, chunk=US_CHUNK)


# Talk episodes: error and signup events in seconds.
_EPISODES = dict(sec=SEC, t="SELECT rec_id, s, e FROM sec WHERE category IN ('error', 'signup')", ep=sql_merge("t", "1.5"))


def episodes(spark, sf):
    talk = seconds(spark, sf).where(F.col("category").isin("error", "signup"))
    return materialize(iv.merge(talk, 1.5, chunk=C))


_DENSE = (
    "(n >= 4 AND stop - s <= 135 AND spoken >= 8 AND spoken / greatest(stop - s, 1) >= 0.15) OR (n >= 3 AND spoken >= 20) "
    "OR (n >= 2 AND spoken >= 35 AND spoken / greatest(stop - s, 1) >= 0.3)"
)


@query(
    "plan_dense_runs",
    with_views(
        OUT + "m",
        "spans",
        **_EPISODES,
        g="SELECT rec_id, s, count(*) OVER w AS n, sum(e - s) OVER w AS spoken, max(e) OVER w AS stop FROM ep WINDOW w AS (PARTITION BY rec_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 120 FOLLOWING)",
        h=f"SELECT rec_id, s, stop AS e FROM g WHERE {_DENSE}",
        m=sql_merge("h", "25"),
    ),
)
def plan_dense_runs(spark, sf):
    return micros(pl.dense_runs(episodes(spark, sf), chunk=C))


# Frames of half a second over the shipped line items.
def _facts(spark, sf):
    n = shipped(spark, sf).groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"))
    # One row per recording, read by most steps of a plan.
    return materialize(n.select("rec_id", "n", F.lit(0.5).alias("dt"), (F.col("n") * 0.5).alias("duration")))


def _wide(spark, sf):
    return materialize(fr.with_db(levels(spark, sf), block=256))


_TIMES = "SELECT DISTINCT o_orderkey % (SELECT count(*) FROM supplier) AS rec_id, o_custkey % 600 * 0.4::DOUBLE AS t, unnest(['start', 'end']) AS side FROM orders"


@query(
    "plan_quiet_cut",
    with_views(
        f"SELECT rec_id, side, {sql_us('t')} AS at, frame FROM (SELECT rec_id, side, t, arg_min(ordinal, {{'c': greatest(wide, -62) + abs(ordinal - pos) * 0.5::DOUBLE * 1.2::DOUBLE, 'o': ordinal}}) AS frame FROM ("
        "SELECT e.*, w.ordinal, w.wide FROM edges e JOIN w ON w.rec_id = e.rec_id AND w.ordinal BETWEEN CASE WHEN side = 'start' THEN pos ELSE greatest(0, pos - 12) END AND CASE WHEN side = 'start' THEN least(n - 1, pos + 12) ELSE pos END) GROUP BY rec_id, side, t)",
        "shipped",
        w="SELECT rec_id, ordinal, 20 * log10(greatest(max(rms) OVER (PARTITION BY rec_id ORDER BY ordinal ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 1e-10)) AS wide FROM shipped",
        n="SELECT rec_id, count(*) AS n FROM shipped GROUP BY rec_id",
        edges=f"SELECT t.*, n, greatest(0, least(n - 1, CAST(CASE WHEN side = 'start' THEN ceil(t / 0.5::DOUBLE) ELSE floor(t / 0.5::DOUBLE) END AS BIGINT))) AS pos FROM ({_TIMES}) t JOIN n ON n.rec_id = t.rec_id",
    ),
)
def plan_quiet_cut(spark, sf):
    o = table(spark, sf, "orders").withColumn("c", F.lit(table(spark, sf, "supplier").count()))
    times = o.select(F.pmod("o_orderkey", F.col("c")).alias("rec_id"), (F.pmod("o_custkey", F.lit(600)) * 0.4).alias("time")).distinct()
    edges = times.join(_facts(spark, sf), "rec_id").withColumn("side", F.explode(F.array(F.lit("start"), F.lit("end"))))
    cut = pl.quiet_cut(edges, _wide(spark, sf), ["rec_id", "side", "time"])
    return cut.select("rec_id", "side", us(F.col("time")).alias("at"), "frame")


# Strict plans: talk at the start of every keep, and every turn of the conversations, dealt over the recordings on
# a clock of an eighth; whispers from parts, music from one market segment, an exclusion for each supplier.
_DEALT = "(SELECT count(*) FROM supplier)"
_TURNS = "(s.rec_id * 37 + s.turn * 101) % 600 * 0.5::DOUBLE"
_STRICT = dict(
    keeps_=_KEEPS,
    n="SELECT rec_id, count(*) AS n FROM shipped GROUP BY rec_id",
    aw=_ALIGNED_WORDS,
    k=f"SELECT s.rec_id * 1000 + s.turn AS rec_id, {_TURNS} + (a - s.s) / 8 AS s, {_TURNS} + (z - s.s) / 8 AS e FROM aw JOIN segments s ON s.rec_id = aw.rec_id AND s.turn = aw.turn WHERE z > a",
    kg=sql_merge("k", "0.9"),
    spoken="SELECT rec_id, s * 0.5::DOUBLE AS s, s * 0.5::DOUBLE + 1.3::DOUBLE AS e FROM keeps_ "
    f"UNION ALL SELECT rec_id // 1000 % {_DEALT}, s, e FROM kg "
    f"UNION ALL SELECT rec_id % {_DEALT}, {_TURNS}, {_TURNS} + (e - s.s) / 8 FROM segments s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.rec_id = s.rec_id * 1000 + s.turn)",
    whispers=f"SELECT p_partkey % {_DEALT} AS rec_id, p_size * 6.0::DOUBLE AS s, p_size * 6.0::DOUBLE + p_size % 4 + 0.5::DOUBLE AS e FROM part",
    music=f"SELECT c_custkey % {_DEALT} AS rec_id, c_nationkey * 12.0::DOUBLE AS s, c_nationkey * 12.0::DOUBLE + 5 AS e FROM customer WHERE c_mktsegment = 'BUILDING'",
    excluded="SELECT s_suppkey AS rec_id, s_nationkey * 8.0::DOUBLE AS s, s_nationkey * 8.0::DOUBLE + 6 AS e FROM supplier",
)


def _turns(spark, sf):
    """Segments of the conversations on the clocks of the recordings."""
    at = F.pmod(F.col("rec_id") * 37 + F.col("turn") * 101, F.lit(600)) * 0.5
    # Under another name, since "start" inside the lambda would mean the new column.
    on = lambda t: F.col("_at") + (t - F.col("_from")) / 8
    rows = aligned(spark, sf).withColumn("_at", at).withColumn("_from", F.col("start"))
    words = F.transform("words", lambda w: w.withField("start", on(w["start"])).withField("end", on(w["end"])))
    dealt = F.pmod("rec_id", F.lit(table(spark, sf, "supplier").count()))
    return rows.select(dealt.alias("rec_id"), on(F.col("start")).alias("start"), on(F.col("end")).alias("end"), words.alias("words"))


def _masks(spark, sf):
    """Whispers, music and exclusions."""
    c = table(spark, sf, "supplier").count()
    span = lambda key, start, length: (key.alias("rec_id"), start.alias("start"), (start + length).alias("end"))
    size = F.col("p_size")
    whispers = table(spark, sf, "part").select(*span(F.pmod("p_partkey", F.lit(c)), size * 6.0, F.pmod(size, F.lit(4)) + 0.5))
    music = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(*span(F.pmod("c_custkey", F.lit(c)), F.col("c_nationkey") * 12.0, 5.0))
    excluded = table(spark, sf, "supplier").select(*span(F.col("s_suppkey"), F.col("s_nationkey") * 8.0, 6.0))
    return whispers, music, excluded


def _talk(spark, sf):
    """Talk at the start of every keep."""
    return materialize(keeps(spark, sf).select("rec_id", (F.col("start") * 0.5).alias("start"), (F.col("start") * 0.5 + 1.3).alias("end")))


def _settings(spark, sf):
    s = table(spark, sf, "supplier")
    options = F.create_map(
        F.lit("strict_min_section"), F.lit("10"),
        F.lit("strict_dense_gap"), F.pmod("s_suppkey", F.lit(4)).cast("string"),
        F.lit("silence_db"), F.lit("-30"),
        F.lit("join_fade_enabled"), F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "true").otherwise("false"),
    )
    return materialize(po.resolve_policy(s.select(F.col("s_suppkey").alias("rec_id"), options.alias("options")))[0])


@query(
    "plan_strict",
    with_views(
        'SELECT g.rec_id, s AS start, e AS "end" FROM g WHERE (e - s) * 0.5 >= 10',
        "shipped",
        "segments",
        **_STRICT,
        em=sql_merge("spoken", "1.5"),
        whm=sql_merge("whispers"),
        always="SELECT rec_id, -1e6::DOUBLE AS lo, 1e6::DOUBLE AS hi FROM (SELECT DISTINCT rec_id FROM em)",
        aloud=sql_gaps("whm", "always"),
        ep="SELECT em.rec_id, greatest(em.s, x.s) AS s, least(em.e, x.e) AS e FROM em JOIN aloud x ON x.rec_id = em.rec_id AND em.s < x.e AND x.s < em.e",
        ahead="SELECT rec_id, s, count(*) OVER o AS n, sum(e - s) OVER o AS spoken, max(e) OVER o AS stop FROM ep WINDOW o AS (PARTITION BY rec_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 120 FOLLOWING)",
        dense=f"SELECT rec_id, s, stop AS e FROM ahead WHERE {_DENSE}",
        runs=sql_merge("dense", "25"),
        talk="SELECT rec_id, s, e FROM ep UNION ALL SELECT rec_id, s, e FROM runs",
        pad="SELECT t.rec_id, greatest(0, s - 5) AS s, least(n * 0.5::DOUBLE, e + 7) AS e, t.rec_id % 4 AS gap FROM talk t JOIN n ON n.rec_id = t.rec_id",
        r0="SELECT rec_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY rec_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= gap THEN 0 ELSE 1 END AS f FROM (SELECT DISTINCT * FROM pad WHERE e > s))) GROUP BY rec_id, run",
        away="SELECT rec_id, s, e FROM r0 UNION SELECT * FROM music UNION SELECT * FROM excluded",
        w="SELECT rec_id, ordinal, 20 * log10(greatest(max(rms) OVER (PARTITION BY rec_id ORDER BY ordinal ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 1e-10)) AS wide FROM shipped",
        edges="SELECT r.rec_id, r.s, r.e, n, greatest(0, least(n - 1, CAST(floor(s / 0.5::DOUBLE) AS BIGINT))) AS pa, greatest(0, least(n - 1, CAST(ceil(e / 0.5::DOUBLE) AS BIGINT))) AS pb FROM away r JOIN n ON n.rec_id = r.rec_id",
        cut="SELECT x.rec_id, x.s, x.e, arg_min(w.ordinal, {'c': greatest(wide, -62) + abs(w.ordinal - pa) * 0.6::DOUBLE, 'o': w.ordinal}) FILTER (w.ordinal BETWEEN greatest(0, pa - 12) AND pa) AS a, "
        "arg_min(w.ordinal, {'c': greatest(wide, -62) + abs(w.ordinal - pb) * 0.6::DOUBLE, 'o': w.ordinal}) FILTER (w.ordinal BETWEEN pb AND least(n - 1, pb + 12)) AS b FROM edges x JOIN w ON w.rec_id = x.rec_id AND w.ordinal BETWEEN pa - 12 AND pb + 12 GROUP BY ALL",
        bl="SELECT rec_id, a AS s, b AS e FROM cut",
        m=sql_merge("bl"),
        u="SELECT rec_id, 0 AS lo, n AS hi FROM n",
        g=sql_gaps("m", "u"),
    ),
)
def plan_strict(spark, sf):
    return pl.plan_strict(_turns(spark, sf), _talk(spark, sf), *_masks(spark, sf), _wide(spark, sf), _facts(spark, sf), _settings(spark, sf), block=256)


def _scene_scores(spark, sf):
    """Scores for two-second probes: every probe of the free sections, from the frame it starts at."""
    from ..operators import grids

    free = iv.complement(_talk(spark, sf), _facts(spark, sf), chunk=C)
    w = grids.edge_probes(free).select("rec_id", F.col("probe_start").alias("start"), F.col("probe_end").alias("end")).distinct()
    h = lambda k, n: F.pmod(F.floor(F.col("start") * 10) * k, F.lit(n)) / float(n)
    return materialize(w.select("*", h(7, 19).alias("texture"), (h(11, 23) * 0.2).alias("breath"), (h(13, 29) * 0.5).alias("speech"), (h(5, 17) * 0.65).alias("lexical")))


def _scenes(spark, sf):
    return pl.plan_scenes(_talk(spark, sf), _wide(spark, sf), _facts(spark, sf), _settings(spark, sf), _scene_scores(spark, sf), block=256)


@query("plan_scenes")
def plan_scenes(spark, sf):
    """Accepted scenes (guards, cuts and gestures are tested against plain loops)."""
    accepted, _ = _scenes(spark, sf)
    return accepted.select("rec_id", "start", "end", "start_boundary", "end_boundary")


@query("plan_rejected")
def plan_rejected(spark, sf):
    return _scenes(spark, sf)[1].select("rec_id", us(F.col("raw_start")).alias("raw_start"), us(F.col("raw_end")).alias("raw_end"), "reason")


@query("plan_accept_units")
def plan_accept_units(spark, sf):
    kept, _ = pl.accept_units(keeps(spark, sf), _wide(spark, sf), _facts(spark, sf), _settings(spark, sf), block=256)
    return kept


@query(
    "plan_summary",
    with_views(
        f"SELECT n.rec_id, coalesce(k.c, 0) AS segments, {sql_us('coalesce(k.l, 0) * 0.5::DOUBLE')} AS duration, coalesce(a.v, 0) AS voice, coalesce(a.t, 0) AS tapping FROM (SELECT DISTINCT rec_id FROM shipped) n "
        "LEFT JOIN (SELECT rec_id, count(*) AS c, sum(e - s) AS l FROM keeps_ GROUP BY rec_id) k ON k.rec_id = n.rec_id "
        "LEFT JOIN (SELECT rec_id, count(*) FILTER (s % 3 = 0) AS v, count(*) FILTER (s % 3 = 1) AS t FROM keeps_ GROUP BY rec_id) a ON a.rec_id = n.rec_id",
        "shipped",
        keeps_=_KEEPS,
    ),
)
def plan_summary(spark, sf):
    k = keeps(spark, sf)
    n = F.pmod("start", F.lit(3))
    cats = k.select("rec_id", F.when(n == 0, "voice").when(n == 1, "tapping").otherwise("other").alias("category"))
    rows = pl.plan_summary(k, k.where(F.lit(False)), cats, _facts(spark, sf))
    return rows.select("rec_id", "segments", us(F.col("duration")).alias("duration"), "voice", "tapping")


@query(
    "plan_review_loop",
    with_views(
        "SELECT DISTINCT rec_id, CASE WHEN rec_id % 4 > rec_id % 5 THEN 'needs_review' ELSE 'passed' END AS status, least(rec_id % 4 + 1, rec_id % 5 + 1) AS passes FROM shipped",
        "shipped",
    ),
)
def plan_review_loop(spark, sf):
    """Replan after findings; the reviewer flags fixed output times on the first passes, of one to five requested."""
    recs = _facts(spark, sf).withColumn("review_max_passes", F.pmod("rec_id", F.lit(5)) + 1)

    def plan(recordings, spoken):
        free = iv.complement(spoken, recordings, chunk=C)
        step = lambda c, up: (F.ceil(c * 2) if up else F.floor(c * 2)).cast("long")
        return free.select("rec_id", step(F.col("start"), True).alias("start"), step(F.col("end"), False).alias("end")).where("end > start")

    def check(found, number):
        who = found.select("rec_id").distinct().where(F.pmod("rec_id", F.lit(4)) >= number)
        return who.select("rec_id", F.lit(5.0 * number).alias("start"), F.lit(5.0 * number + 2).alias("end"))

    status, _ = rv.review_loop(recs, _talk(spark, sf), plan, check)
    return status.select("rec_id", "status", F.col("passes").cast("long").alias("passes"))


# Drinks: the similarity map of the vectors, sharpened so that sips and caps occur.
def sips(spark, sf):
    df = described(spark, sf, 1.0, lift=2.8)
    kind = F.pmod(F.floor("vec_id"), F.lit(13))
    boost = lambda label, when, by: F.when(when, by).otherwise(0.0)
    m = F.col("semantic")
    semantic = F.map_zip_with(
        m,
        F.create_map(
            F.lit("drinking"), boost("drinking", kind.isin(3, 4, 5, 6), 0.5),
            F.lit("swallow"), boost("swallow", kind.isin(3, 4, 5, 6), 0.5),
            F.lit("bottle_cap"), boost("bottle_cap", kind.isin(1, 2, 7, 8), 0.5),
        ),
        lambda k, a, b: a + F.coalesce(b, F.lit(0.0)),
    )
    at = F.col("start") / 2
    return materialize(df.withColumns({"semantic": semantic, "start": at, "end": at + 3.0}))


@query("sequence_drink_decisions")
def sequence_drink_decisions(spark, sf):
    """Drink gestures with their evidence (brute-force test in tests/test_sequences.py)."""
    decisions, _ = sq.drink_sequences(sips(spark, sf), chunk=HOP_CHUNK)
    return micros(decisions, "decision", "repeated", "cap_before", "adjacent_cap", "strong_windows")


@query("sequence_review_drinking")
def sequence_review_drinking(spark, sf):
    fine = sips(spark, sf)
    recs = fine.groupBy("rec_id").agg(F.max("end").alias("duration"))
    coarse = fine.withColumn("end", F.least(F.col("start") + 10.0, F.lit(52.0)))
    blocked = fine.where(F.pmod("vec_id", F.lit(50)) == 40).select("rec_id", "start", "end")
    _, removed = sq.review_drinking(recs, blocked, coarse, fine, chunk=HOP_CHUNK)
    return micros(removed)


# Sound of 16 kHz made from orders: noise with dull stretches of 10 s every 100 s.
def _noise(batches):
    place = np.arange(4000, dtype=np.int64)
    for batch in batches:
        # A block takes 32 kB in each step below, so a few at a time are made and handed on.
        for first in range(0, len(batch), 128):
            part = batch.iloc[first : first + 128]
            order, i = part["o_orderkey"].to_numpy(), part["i"].to_numpy()
            dull = ((i % 400 >= 200) & (i % 400 < 240))[:, None]
            at = order[:, None] * 4000 + np.where(dull, place - place % 32, place)
            samples = (at * 48271 % 65537 % 8001 - 4000).astype("<i2")
            yield pd.DataFrame({"rec_id": part["rec_id"], "i": i, "samples": [x.tobytes() for x in samples]})


def noise_blocks(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("o_orderkey div 61600").alias("rec_id"), F.pmod("o_orderkey", F.lit(61600)).alias("i"))
    # The file is one split; its rows become 8 kB each, so they are spread first.
    return o.repartition(64).mapInPandas(_noise, "rec_id long, i long, samples binary")


@query("signal_trace_and_drops")
def signal_trace_and_drops(spark, sf):
    """Spectral scan and drop candidates of a 16 kHz track, a quarter second per order."""
    trace = materialize(signal.spectral_trace(noise_blocks(spark, sf)))
    return micros(sq.spectral_drops(trace))


def _drops(spark, sf):
    v = vectors(spark, sf)
    n = F.pmod("block_idx", F.lit(25))
    flat = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", F.floor(i / 16).cast("int") * 16))
    rows = v.select("rec_id", F.col("block_idx").alias("i"), F.when(n.between(12, 17), flat).otherwise(F.col("embedding")).alias("samples"))
    # One block stands for a quarter second; the spectrum uses 64 samples at 16 kHz.
    trace = materialize(signal.spectral_trace(rows, step=0.004, n_fft=64, full_scale=1.0))
    return sq.spectral_drops(trace)


@query("sequence_spectral_drops")
def sequence_spectral_drops(spark, sf):
    return micros(_drops(spark, sf), "first", "stop")


@query("sequence_review_transitions")
def sequence_review_transitions(spark, sf):
    drops = _drops(spark, sf)
    recs = hop_recordings(spark, sf).select("rec_id", F.lit(12.5).alias("duration"))
    from ..operators import grids

    probes = grids.phase_probes(drops.select("rec_id", "start", "end").join(recs, "rec_id"))
    spans_ = probes.select("rec_id", "role", F.col("probe_start").alias("start"), F.col("probe_end").alias("end"))
    inside = F.col("role") == "body"
    odd = F.pmod("rec_id", F.lit(2)) == 1
    scores = spans_.select(
        "rec_id", "start", "end", F.when(inside, 0.01).otherwise(0.6).alias("texture"),
        F.create_map(F.lit("mouth"), F.when(inside, F.when(odd, 0.4).otherwise(0.12)).otherwise(0.38), F.lit("other"), F.when(inside, 0.36).otherwise(0.12), F.lit("background"), F.when(inside, 0.36).otherwise(0.1)).alias("semantic"),
    )
    scores = materialize(scores)
    blocked = drops.where(F.lit(False)).select("rec_id", "start", "end")
    decided, _ = sq.review_transitions(drops, blocked, recs, scores.drop("semantic"), scores, chunk=HOP_CHUNK)
    return micros(decided, "decision", "reason")


_POS = f"coalesce({semantic_positive_sql(0.17, 0.005)}, FALSE)"
_CONFIRM = dict(
    w=CALM_W,
    tbl="SELECT * REPLACE (least(s + 10, 104.0::DOUBLE) AS e) FROM w",
    mu="SELECT rec_id, s, e FROM w WHERE vec_id % 47 = 3",
    m=sql_merge("mu"),
    u="SELECT rec_id, 0.0::DOUBLE AS lo, d AS hi FROM hop_recordings",
    free=sql_gaps("m", "u"),
    hop="SELECT rec_id, a AS s, least(a + 10, e) AS e FROM (SELECT *, s + 5.0::DOUBLE * unnest(generate_series(0, CAST(ceil((e - s) / 5.0::DOUBLE) AS BIGINT) - 1)) AS a FROM free) WHERE e - a >= 3",
    rows_="SELECT hop.rec_id, hop.s, hop.e, tbl.* EXCLUDE (rec_id, s, e) FROM hop LEFT JOIN tbl ON tbl.rec_id = hop.rec_id AND tbl.s = hop.s AND tbl.e = hop.e",
    runs=sql_runs("rows_", _POS, "s > pe + 0.000001"),
    reg="SELECT rec_id, min_by(s + least(2.5, (e - s) / 4), s) AS s, max_by(e - least(2.5, (e - s) / 4), s) AS e FROM runs GROUP BY rec_id, run "
    f"HAVING count(*) >= 2 AND count(*) FILTER ({semantic_positive_sql(0.20, 0.025)}) >= 2",
    good="SELECT * FROM reg UNION ALL SELECT rec_id, s, e FROM w WHERE vec_id % 31 = 3",
    mg=sql_merge("good"),
    bad="SELECT rec_id, s, e FROM w WHERE vec_id % 19 = 3 OR vec_id % 47 = 3",
    mb=sql_merge("bad"),
    u2="SELECT rec_id, -1.0::DOUBLE AS lo, 1000000.0::DOUBLE AS hi FROM hop_recordings",
    gb=sql_gaps("mb", "u2"),
)


@query(
    "sequence_confirm_regions",
    with_views(
        f'SELECT g.rec_id, {sql_us("greatest(g.s, b.s)")} AS start, {sql_us("least(g.e, b.e)")} AS "end" FROM mg g JOIN gb b ON b.rec_id = g.rec_id AND g.s < b.e AND b.s < g.e',
        "vectors",
        "hop_recordings",
        **_CONFIRM,
    ),
)
def sequence_confirm_regions(spark, sf):
    from .label_queries import calm

    w = calm(spark, sf)
    recs = hop_recordings(spark, sf)
    table_ = w.withColumn("end", F.least(F.col("start") + 10.0, F.lit(104.0)))
    hit = lambda k: w.where(F.pmod("vec_id", F.lit(k)) == 3).select("rec_id", "start", "end")
    return micros(sq.confirm_regions(recs, table_, hit(47), hit(31), [hit(19), hit(47)], chunk=HOP_CHUNK))
